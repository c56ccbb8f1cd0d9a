"""Readers of signal files. Each gives a row for each channel: ``path, channel, sfreq, start_s, samples``.

Files come through Spark's binary source, so they may lie in any store that Spark
reads; a file is decoded in one task. A file that can't be decoded gives a row
with ``error`` set and no samples instead of ending the job.
"""

from __future__ import annotations

import configparser
import io
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, channel string, sfreq double, start_s double, samples array<double>, error string"
Channel = tuple[str, float, float, np.ndarray]


def _number(text: bytes) -> float:
    return float(text.decode("ascii").strip() or 0)


def decode_edf(data: bytes) -> Iterator[Channel]:
    """Channels of an EDF file, scaled to physical units; annotation channels are left out."""
    count, records, length = int(_number(data[252:256])), int(_number(data[236:244])), _number(data[244:252])
    at = 256

    def fields(width: int) -> list[bytes]:
        nonlocal at
        out = [data[at + k * width : at + (k + 1) * width] for k in range(count)]
        at += count * width
        return out

    labels = [b.decode("latin-1").strip() for b in fields(16)]
    fields(80)
    units = [b.decode("latin-1").strip() for b in fields(8)]
    low, high, dig_low, dig_high = ([_number(b) for b in fields(8)] for _ in range(4))
    fields(80)
    each = [int(_number(b)) for b in fields(8)]
    fields(32)
    block = np.frombuffer(data, dtype="<i2", offset=at)
    width = sum(each)
    if records < 0:
        records = len(block) // width
    block = block[: records * width].reshape(records, width)
    first = np.cumsum([0, *each])
    for k, label in enumerate(labels):
        if "Annotations" in label:
            continue
        scale = (high[k] - low[k]) / ((dig_high[k] - dig_low[k]) or 1.0)
        volts = {"uV": 1e-6, "µV": 1e-6, "mV": 1e-3}.get(units[k], 1.0)
        x = (block[:, first[k] : first[k + 1]].reshape(-1) - dig_low[k]) * scale + low[k]
        yield label, each[k] / length, 0.0, x * volts


def decode_brainvision(header: str, payload: bytes) -> Iterator[Channel]:
    """Channels of a BrainVision pair: multiplexed or vectorised 16-bit integers or 32-bit floats, in volts."""
    ini = configparser.ConfigParser(interpolation=None, strict=False, allow_no_value=True)
    ini.optionxform = str
    ini.read_string(header[header.index("[") :].split("[Comment]")[0])
    common = ini["Common Infos"]
    count, rate = int(common["NumberOfChannels"]), 1e6 / float(common["SamplingInterval"])
    kind = {"INT_16": "<i2", "IEEE_FLOAT_32": "<f4"}[ini.get("Binary Infos", "BinaryFormat", fallback="INT_16")]
    x = np.frombuffer(payload, dtype=kind).astype(np.float64)
    x = x.reshape(-1, count).T if common.get("DataOrientation", "MULTIPLEXED") == "MULTIPLEXED" else x.reshape(count, -1)
    for k in range(count):
        name, _, resolution, unit = (ini["Channel Infos"][f"Ch{k + 1}"].split(",") + ["", "", ""])[:4]
        volts = {"V": 1.0, "mV": 1e-3}.get(unit.strip(), 1e-6)
        yield name.replace("\\1", ","), rate, 0.0, x[k] * float(resolution or 1) * volts


def decode_npz(data: bytes) -> Iterator[Channel]:
    """Channels of a block: ``data`` [sample, channel], ``ch_names, sfreq, start_sec``; widened to double."""
    with np.load(io.BytesIO(data), allow_pickle=False) as z:
        x = z["data"].astype(np.float64)
        for k, name in enumerate(z["ch_names"]):
            yield str(name), float(z["sfreq"]), float(z["start_sec"]), x[:, k]


def _rows(files: Iterator[pd.DataFrame], decode: Callable[[pd.Series], Iterator[Channel]]) -> Iterator[pd.DataFrame]:
    for frame in files:
        for _, file in frame.iterrows():
            try:
                rows = [(file["path"], name, rate, start, x.tolist(), None) for name, rate, start, x in decode(file)]
            except Exception as e:  # noqa: BLE001 - what is wrong with a file is told in its row
                rows = [(file["path"], None, None, None, None, f"{type(e).__name__}: {e}")]
            yield pd.DataFrame(rows, columns=["path", "channel", "sfreq", "start_s", "samples", "error"])


def _binary(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


def read_edf(spark: SparkSession, path: str) -> DataFrame:
    return _binary(spark, path, "*.edf").mapInPandas(lambda files: _rows(files, lambda f: decode_edf(f["content"])), SCHEMA)


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    return _binary(spark, path, "*.npz").mapInPandas(lambda files: _rows(files, lambda f: decode_npz(f["content"])), SCHEMA)


def read_brainvision(spark: SparkSession, path: str) -> DataFrame:
    """Header and data files of one name in one folder belong together."""
    stem = F.regexp_replace("path", r"\.(vhdr|eeg|dat)$", "")
    heads = _binary(spark, path, "*.vhdr").select(stem.alias("stem"), "path", F.col("content").alias("head"))
    data = _binary(spark, path, "*.{eeg,dat}").select(stem.alias("stem"), "content")
    both = heads.join(data, "stem").select("path", "head", "content")
    return both.mapInPandas(lambda files: _rows(files, lambda f: decode_brainvision(f["head"].decode("utf-8", "replace"), f["content"])), SCHEMA)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Channel metadata with fixed types; columns that the file lacks are null."""
    raw = spark.read.option("header", True).csv(path)
    wanted = {"pt": "string", "name": "string", "final_label": "string", "reg": "string", "hemi": "string", **dict.fromkeys(("ch1_soz", "ch2_soz", "ch1_resected", "ch2_resected"), "boolean")}
    return raw.select(*[(F.col(c).cast(t) if c in raw.columns else F.lit(None).cast(t)).alias(c) for c, t in wanted.items()])


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated events or channels, with the file's path.

    Each file's columns are found by the names in its own header, in any order; one
    that a file lacks, ``n/a``, an empty value and one that isn't of its type are
    null. These tables are small: a file is a row until its lines are parted.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.split("value", r"\r?\n").alias("lines"))
    rows = files.select("path", F.split(F.get("lines", F.lit(0)), "\t").alias("header"), F.posexplode("lines").alias("nth", "line")).where("nth > 0 and trim(line) <> ''")
    values = rows.withColumn("cells", F.split("line", "\t"))
    want = [f.strip().split() for f in schema.split(",")]

    def cell(name: str, kind: str) -> Column:
        text = F.get("cells", F.array_position("header", F.lit(name)).cast("int") - 1)
        return F.when(~text.isin("n/a", ""), text).try_cast(kind).alias(name)

    return values.select(*[cell(*c) for c in want], "path")


def sample_of(onset: str = "onset", sample: str = "sample", rate: float = 1000.0):
    """The sample number of an event: as given, else from its onset."""
    return F.coalesce(F.col(sample).cast("long"), (F.col(onset) * rate).cast("long"))


def subject_of(path: str = "path"):
    """The part of the file name before its first underscore."""
    return F.regexp_extract(path, r"([^/_]+)_[^/]*$", 1)


def ranges(recordings: DataFrame, most_s: float = 600.0) -> DataFrame:
    """``*, part_start_s, part_dur_s``: a recording of ``dur_s`` seconds in parts that are pulled on their own."""
    n = F.ceil(F.col("dur_s") / most_s).cast("int")
    parts = recordings.where("dur_s > 0").select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("__k"))
    start = F.col("__k") * most_s
    return parts.select(*recordings.columns, start.alias("part_start_s"), F.least(F.lit(float(most_s)), F.col("dur_s") - start).alias("part_dur_s"))


def write_blocks(signals: DataFrame, path: str) -> None:
    """Signals as Parquet, a folder for each subject, so that readers open only the subjects they ask for."""
    signals.write.mode("overwrite").partitionBy("subject").parquet(path)


def write_table(df: DataFrame, path: str, form: str = "csv") -> None:
    """A result table as CSV with a header, as JSON or as Parquet."""
    writer = df.write.mode("overwrite")
    (writer.option("header", True) if form == "csv" else writer).format(form).save(path)


def numbered(name: str) -> tuple[str, int] | None:
    """Shaft and contact of a channel name, for use outside of Spark."""
    m = re.match(r"([A-Za-z]+)(\d+)$", name)
    return (m[1], int(m[2])) if m else None
