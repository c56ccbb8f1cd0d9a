"""Intermediate tables in the folder that the whole cluster shares, and a bounded bit filter.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir`` and reading it
again, so a lost executor costs only the tasks it was running.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only where none is set and all runs on one machine (tests)."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if _own_dir is None:
        _own_dir = f"file://{tempfile.mkdtemp(prefix='phasegrid-')}"
    return _own_dir


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and return a frame that reads it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that one operator writes on its way; ``clear`` deletes all but those still to be read."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        got = self.spark.read.schema(df.schema).parquet(path)
        self.paths[path] = got
        return got

    def clear(self, *keep: DataFrame) -> None:
        for path in [p for p, df in self.paths.items() if not any(df is k for k in keep)]:
            del self.paths[path]
            folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


#: Bits a filter has for each key, bits of a block, words of 64 bits in it, and the most bits a filter may have (32 MiB).
BITS_PER_KEY, BLOCK, WORDS, MAX_BITS = 32, 4096, 64, 1 << 28


@dataclass
class BitFilter:
    """A blocked Bloom filter of two bits a key, with a fixed upper bound on its size.

    It is a table of blocks, which is broadcast; rows are probed by a join on the
    block's number, inside generated code. Every key put in is found; how often
    others are grows when more than ``MAX_BITS / BITS_PER_KEY`` keys are in, so
    what is decided with it has to be right either way.
    """

    blocks: DataFrame
    size: int

    @staticmethod
    def places(key: Sequence[Column], size: int) -> tuple[Column, Column, Column]:
        """Block number and the two places in it."""
        h = F.xxhash64(*key)
        place = lambda by: F.shiftrightunsigned(h, by).bitwiseAND(F.lit(BLOCK - 1)).cast("int")
        return F.pmod(F.shiftrightunsigned(h, 24), F.lit(size // BLOCK)), place(0), place(12)

    @staticmethod
    def size_for(keys: int, max_bits: int = MAX_BITS) -> int:
        wanted = 1 << max(15, (max(1, keys) * BITS_PER_KEY - 1).bit_length())
        return min(max_bits, wanted)

    @classmethod
    def of_keys(cls, df: DataFrame, key: Sequence[Column], keys: int, max_bits: int = MAX_BITS) -> BitFilter:
        """A filter that holds every key of ``df``."""
        size = cls.size_for(keys, max_bits)
        return cls._built(cls._cells(df, key, size), size)

    @classmethod
    def of_repeated(cls, df: DataFrame, key: Sequence[Column], keys: int, max_bits: int = MAX_BITS) -> BitFilter:
        """A filter that holds every key which ``df`` has in two rows or more.

        First pass of two: rows are counted by cell (combined before the shuffle,
        which carries cell numbers only) and a cell hit once is left empty.
        """
        size = cls.size_for(keys, max_bits)
        return cls._built(cls._cells(df, key, size).groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").select("cell"), size)

    @classmethod
    def _cells(cls, df: DataFrame, key: Sequence[Column], size: int) -> DataFrame:
        block, a, b = cls.places(key, size)
        return df.select(F.explode(F.array(block * BLOCK + a, block * BLOCK + b)).alias("cell"))

    @classmethod
    def _built(cls, cells: DataFrame, size: int) -> BitFilter:
        """Bits are set on the executors: cells to words, the at most ``WORDS`` words of a block to one row."""
        bit = F.expr(f"shiftleft(1L, cast(cell % {WORDS} as int))")
        words = cells.groupBy(F.expr(f"cell div {WORDS}").alias("word")).agg(F.bit_or(bit).alias("bits"))
        held = F.map_from_entries(F.collect_list(F.struct(F.expr(f"cast(word % {WORDS} as int)").alias("at"), "bits")))
        blocks = words.groupBy(F.expr(f"word div {WORDS}").alias("block")).agg(held.alias("held"))
        in_place = F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda k: F.coalesce(F.try_element_at("held", k), F.lit(0).cast("long")))
        return cls(materialise(blocks.select("block", in_place.alias("words")), "filter"), size)

    def marked(self, df: DataFrame, key: Sequence[Column], name: str) -> DataFrame:
        """Second pass: ``df`` with a column that is true where all bits of a row's key are set. No row moves."""
        block, a, b = self.places(key, self.size)
        blocks = self.blocks.select(F.col("block").alias("__block"), F.col("words").alias("__words"))
        bit = lambda at: F.getbit(F.get("__words", F.shiftright(at, 6)), at.bitwiseAND(F.lit(WORDS - 1))) == 1
        found = df.join(F.broadcast(blocks), block == F.col("__block"), "left")
        return found.withColumn(name, F.coalesce(bit(a) & bit(b), F.lit(False))).drop("__block", "__words")
