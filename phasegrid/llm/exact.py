"""Exact deduplication by two-pass Bloom filtering.

The first pass fills a bounded filter with the hashes that may occur more than
once. In the second pass only rows whose hash is in the filter shuffle; all
others are known to be alone and pass straight through. Which rows are copies is
then decided on the full SHA-256, so the filter's errors cost time, never rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasegrid.llm.store import BITS_PER_KEY, MAX_BITS, BitFilter, materialise, shared_dir

#: Groups with this share of all rows count as hot; there are fewer than 1/share of them.
HOT_SHARE, HOT_LEAST = 1e-3, 1000


def normalised(text: str = "text") -> Column:
    """White-space runs become one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def text_digest(text: str = "text") -> Column:
    return F.sha2(normalised(text), 256)


def shards_for(rows: int, max_bits: int = MAX_BITS) -> int:
    """How many filters of at most ``max_bits`` the rows need."""
    return max(1, -(-rows * BITS_PER_KEY // max_bits))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """Each row's group of equal normalised texts, dropped rows too.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256``: one row for each
    row of ``docs``. The smallest id of a group stays. Null texts are empty texts;
    a row without an id stays only if its whole group has none; of rows equal in
    id and text one stays. An empty table gives an empty result. Other columns of
    ``docs`` are ignored.

    Digests are written in shards by their hash, as many as filters of ``max_bits``
    are needed to stay sparse. Each shard has its own filter, which is broadcast
    while the shard is split; so what is broadcast at once has a bound, and however
    many rows there are, few that are alone are shuffled.
    """
    spark = docs.sparkSession
    total = docs.count()
    shards, folder = shards_for(total, max_bits), f"{shared_dir(spark)}/digests-{uuid.uuid4().hex}"
    digest = docs.select(F.col(id_col).alias("doc_id"), text_digest(text_col).alias("text_sha256"))
    stored = f"doc_id {digest.schema['doc_id'].dataType.simpleString()}, text_sha256 string"
    digest.withColumn("shard", F.pmod(F.xxhash64("text_sha256", F.lit(1)), F.lit(shards))).write.partitionBy("shard").parquet(folder)
    split = f"{shared_dir(spark)}/split-{uuid.uuid4().hex}"
    for k in range(shards if total else 0):
        own = spark.read.schema(f"{stored}, shard long").parquet(folder).where(F.col("shard") == k).drop("shard")
        key = [F.col("text_sha256")]
        marked = BitFilter.of_repeated(own, key, -(-total // shards), max_bits).marked(own, key, "repeated")
        if shards == 1:
            return _grouped(marked, total)
        marked.write.parquet(f"{split}/shard={k}")
    if not total:
        return _grouped(digest.withColumn("repeated", F.lit(False)), 0)
    written = spark.read.option("basePath", split).parquet(*[f"{split}/shard={k}" for k in range(shards)])
    return _grouped(written.select("doc_id", "text_sha256", "repeated"), total)


def _grouped(rows: DataFrame, total: int) -> DataFrame:
    """The groups among the rows marked ``repeated``; the others pass."""
    alone = rows.where(~F.col("repeated")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")

    # One row for each id and text, with the number of times it occurs, so that no group is ever gathered.
    some = materialise(rows.where("repeated").groupBy("text_sha256", "doc_id").agg(F.count("*").alias("times")), "repeated")
    groups = materialise(some.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.sum("times").alias("group_size")), "groups")

    # A hot group's rows find their group in a broadcast table of fewer than 1 / HOT_SHARE rows, wherever they are.
    least = max(HOT_LEAST, int(total * HOT_SHARE))
    hot = F.broadcast(groups.where(F.col("group_size") > least))
    in_hot = some.join(hot, "text_sha256")
    in_rest = some.join(hot, "text_sha256", "left_anti").join(groups.where(F.col("group_size") <= least), "text_sha256")
    copies = in_hot.unionByName(in_rest).withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)
    return alone.unionByName(copies.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns and no others.

    Of equal normalised texts the row with the smallest id stays (rows without an
    id come last; ties go to the smaller row hash). Null texts are empty texts; an
    empty table gives an empty result. Only possibly repeated rows shuffle, and of
    a group no more than one row for each map task.

    The filter that texts are probed with holds only the digests that ``exact_groups``
    has found more than once.
    """
    key, columns = "__digest", docs.columns
    twice = materialise(exact_groups(docs, id_col, text_col).where("group_size > 1").select("text_sha256").distinct(), "twice")
    keyed = docs.withColumn(key, text_digest(text_col))
    marked = BitFilter.of_keys(twice, [F.col("text_sha256")], twice.count()).marked(keyed, [F.col(key)], "__repeated")
    first = F.struct(F.col(id_col).isNull(), F.col(id_col), F.xxhash64(*[F.col(f"`{c}`") for c in columns]))
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    stay = marked.where("__repeated").groupBy(key).agg(F.min_by(row, first).alias("row")).select("row.*")
    return marked.where("not __repeated").select(*[f"`{c}`" for c in columns]).unionByName(stay)
