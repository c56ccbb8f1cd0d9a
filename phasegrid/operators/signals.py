"""Signals as rows: array layout ``(keys, samples)`` and long layout ``(keys, i, x)``."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phasegrid.operators.coupling import _stacked, by_length


def to_long(df: DataFrame, keys: Sequence[str], samples: str = "samples") -> DataFrame:
    """``*keys, i, x``: a row for each sample; 32-bit samples are widened first."""
    return df.select(*keys, F.posexplode(F.col(samples).cast("array<double>")).alias("i", "x"))


def valid(samples: Column, least_std: float = 1e-9) -> Column:
    """All samples finite and not constant; false for a null or empty signal."""
    wide = samples.cast("array<double>")
    finite = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    n = F.size(wide)
    mean = F.aggregate(wide, F.lit(0.0), lambda a, x: a + x) / n
    spread = F.aggregate(wide, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    return F.when(F.coalesce(n, F.lit(0)) < 1, False).otherwise(finite & (F.sqrt(spread / n) >= least_std))


def zscored(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*keys)
    return long.withColumn("z", (F.col("x") - F.avg("x").over(w)) / (F.stddev_pop("x").over(w) + 1e-12))


def robust_zscored(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """By median and 1.4826 MAD; by the standard deviation where the MAD is 0."""
    w = Window.partitionBy(*keys)
    away = long.withColumn("m", F.median("x").over(w)).withColumn("sd", F.stddev_pop("x").over(w))
    mad = 1.4826 * F.median(F.abs(F.col("x") - F.col("m"))).over(w)
    scaled = away.withColumn("mad", mad)
    return scaled.withColumn("z", (F.col("x") - F.col("m")) / (F.when(F.col("mad") == 0, F.col("sd")).otherwise(F.col("mad")) + 1e-12)).drop("m", "sd", "mad")


def detrended(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """x without its least-squares line over i."""
    w = Window.partitionBy(*keys)
    return long.withColumn("x", F.col("x") - F.regr_intercept("x", "i").over(w) - F.regr_slope("x", "i").over(w) * F.col("i"))


def bipolar(contacts: DataFrame, shaft: Sequence[str], num: str = "num", samples: str = "samples") -> DataFrame:
    """``*shaft, num, samples``: contact k minus contact k + 1 of the same shaft; a gap in the numbers pairs nothing."""
    wide = F.col(samples).cast("array<double>")
    a = contacts.select(*shaft, F.col(num).alias("num"), wide.alias("a"))
    b = contacts.select(*shaft, (F.col(num) - 1).alias("num"), wide.alias("b"))
    return a.join(b, [*shaft, "num"]).select(*shaft, "num", F.zip_with("a", "b", lambda x, y: x - y).alias("samples"))


def roll(samples: str, by: int) -> Column:
    """The array turned right by ``by`` places."""
    n = F.size(samples)
    k = F.pmod(F.lit(by), n)
    return F.concat(F.slice(samples, n - k + 1, k), F.slice(samples, F.lit(1), n - k))


def local_maxima(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Samples above both neighbours; the first and the last one have only one and don't count."""
    w = Window.partitionBy(*keys).orderBy("i")
    near = long.withColumn("l", F.lag("x").over(w)).withColumn("r", F.lead("x").over(w))
    return near.where("x > l and x > r").drop("l", "r")


def triggered(df: DataFrame, keys: Sequence[str], samples: str, event: str, half: int, strict: bool = True) -> DataFrame:
    """``*keys, offset, mean_x, n``: average of [event - half, event + half) over rows whose window is inside.

    The window is cut from the row's own array, so no join is needed. ``strict``
    leaves out a window that starts with the signal's first sample.
    """
    e = F.col(event)
    inside = ((e > half) if strict else (e >= half)) & (e < F.size(samples) - half)
    window = F.slice(F.col(samples).cast("array<double>"), (e - half + 1).cast("int"), F.lit(2 * half))
    cut = df.where(inside).select(*keys, F.posexplode(window).alias("k", "x"))
    return cut.groupBy(*keys, (F.col("k") - half).alias("offset")).agg(F.avg("x").alias("mean_x"), F.count("*").alias("n"))


def relative_power(df: DataFrame, keys: Sequence[str], bands: Mapping[str, tuple[int, int]], whole: tuple[int, int], samples: str = "samples") -> DataFrame:
    """``*keys, *bands``: trapezoid area of the DFT power over low <= k < high, as a share of that over ``whole``; null without any."""
    names = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            for batch in by_length(got, len(names)):
                use, x = _stacked(batch.column(len(names)))
                power = np.abs(np.fft.rfft(x, axis=1)) ** 2
                area = lambda b: np.trapezoid(power[:, b[0] : b[1]], axis=1)
                total = area(whole)
                shares = [pa.array(np.where(total > 0, area(b) / np.where(total > 0, total, 1), 0), mask=total <= 0) for b in bands.values()]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(use)) for k in range(len(names))), *shares], [*names, *bands])

    out = T.StructType([*(df.schema[k] for k in names), *(T.StructField(b, T.DoubleType()) for b in bands)])
    return df.select(*names, F.col(samples).cast("array<double>").alias("samples")).mapInArrow(run, out)
