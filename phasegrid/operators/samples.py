"""Signals as a row for each sample, ``*keys, k, v``: spectra, peaks and resampling as joins, windows and partial sums.

Samples of a signal are numbered by ``k`` without gaps, from any number on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phasegrid.session import written


def numbered(rows: DataFrame, keys: Sequence[str], k: str = "k", v: str = "v", detrend: bool = False) -> DataFrame:
    """``*keys, i, v, n``: samples counted from 0 and how many there are; with ``detrend`` without the signal's least-squares line.

    Sums by signal are combined before the shuffle. Constant signals and those with
    a value that is null or not finite are left out.
    """
    value = F.col(v).cast("double")
    sums = [F.min(k).alias("__k0"), F.count("*").alias("n"), F.count_if(value.isNull() | F.isnan(value) | (F.abs(value) == math.inf)).alias("__odd"), F.min(value).alias("__lo"), F.max(value).alias("__hi")]
    if detrend:
        sums += [F.regr_slope(value, F.col(k).cast("double")).alias("__b"), F.avg(value).alias("__mv"), F.avg(F.col(k).cast("double")).alias("__mk")]
    known = rows.groupBy(*keys).agg(*sums).where("__odd = 0 and __lo < __hi")
    flat = value - F.col("__mv") - F.col("__b") * (F.col(k) - F.col("__mk")) if detrend else value
    return rows.join(known, list(keys)).select(*keys, (F.col(k) - F.col("__k0")).alias("i"), flat.alias("v"), "n")


def scored(rows: DataFrame, keys: Sequence[str], v: str = "v") -> DataFrame:
    """``rows`` with the value's z-score in its signal in its place."""
    sums = rows.groupBy(*keys).agg(F.avg(v).alias("__m"), F.stddev_pop(v).alias("__s"))
    return rows.join(sums, list(keys)).withColumn(v, (F.col(v) - F.col("__m")) / (F.col("__s") + 1e-12)).drop("__m", "__s")


# spectra


def segments(rows: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """``*keys, seg, size, samples``: stretches of ``size`` samples, or of the whole signal if it is shorter, each half over the next.

    ``rows`` are ``numbered``. A sample goes to the one or two stretches that hold it.
    """
    own = rows.withColumn("size", F.least(F.lit(size), F.col("n")).cast("long")).withColumn("__step", F.col("size") - F.floor(F.col("size") / 2))
    low = F.greatest(F.lit(0).cast("long"), F.floor((F.col("i") - F.col("size")) / F.col("__step")) + 1)
    high = F.least(F.floor(F.col("i") / F.col("__step")), F.floor((F.col("n") - F.col("size")) / F.col("__step")))
    placed = own.withColumn("__lo", low).withColumn("__hi", high).where("__lo <= __hi").select(*keys, "size", "__step", "i", "v", F.explode(F.sequence("__lo", "__hi")).alias("seg"))
    at = F.struct((F.col("i") - F.col("seg") * F.col("__step")).alias("at"), "v")
    return placed.groupBy(*keys, "seg", "size").agg(F.transform(F.sort_array(F.collect_list(at)), lambda x: x["v"]).alias("samples"))


def periodograms(parts: DataFrame, keys: Sequence[str], sfreq: float) -> DataFrame:
    """``*keys, seg, size, power``: one-sided power density of each stretch, its mean taken off, Hann window."""
    names = [*keys, "seg", "size"]
    schema = T.StructType([*(parts.schema[c] for c in names), T.StructField("power", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, lengths = [None] * batch.num_rows, batch.column(batch.num_columns - 2).to_numpy()
            flat = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                x = np.stack([flat[k] for k in at])
                window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
                p = np.abs(np.fft.rfft((x - x.mean(axis=1, keepdims=True)) * window, axis=1)) ** 2 / (sfreq * (window**2).sum())
                p[:, 1 : -1 if n % 2 == 0 else None] *= 2
                for k, row in zip(at, p, strict=True):
                    out[k] = row
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.list_(pa.float64()))], [*names, "power"])

    return parts.select(*names, "samples").mapInArrow(run, schema)


def welch(rows: DataFrame, keys: Sequence[str], size: int, sfreq: float) -> DataFrame:
    """``*keys, f, hz, power``: the mean of the stretches' periodograms, by frequency.

    The sums for each key and frequency add up, so signals in parts, or several
    signals under one key, may be put together before or after.
    """
    each = periodograms(segments(rows, keys, size), keys, sfreq).select(*keys, "size", F.posexplode("power").alias("f", "p"))
    sums = each.groupBy(*keys, "size", "f").agg(F.sum("p").alias("total"), F.count("*").alias("n_segments"))
    return sums.select(*keys, "f", (F.col("f") * sfreq / F.col("size")).alias("hz"), (F.col("total") / F.col("n_segments")).alias("power"))


def band_shares(powers: DataFrame, keys: Sequence[str], bands: dict[str, tuple[float, float]], whole: tuple[float, float]) -> DataFrame:
    """``*keys`` and each band's share of the trapezoid area over ``whole``; bands are closed below and open above."""

    def area(low: float, high: float) -> Column:
        own = (F.col("hz") >= low) & (F.col("hz") < high)
        p, f = F.when(own, F.col("power")), F.when(own, F.col("hz"))
        return F.coalesce(F.sum(p) - (F.min_by(p, f) + F.max_by(p, f)) / 2, F.lit(0.0))

    got = powers.groupBy(*keys).agg(area(*whole).alias("__all"), *[area(*b).alias(name) for name, b in bands.items()])
    return got.where("`__all` > 0").select(*keys, *[(F.col(name) / F.col("__all")).alias(name) for name in bands])


# peaks


def local_maxima(rows: DataFrame, keys: Sequence[str], k: str = "k", v: str = "v", height: float | None = None) -> DataFrame:
    """``*keys, at, height``: samples above both neighbours, of a plateau the middle one (the earlier of two); a signal's ends are none."""
    w = Window.partitionBy(*keys).orderBy(k)
    run = F.sum(F.coalesce((F.col(v) != F.lag(v).over(w)).cast("int"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    level = rows.withColumn("__run", run).groupBy(*keys, "__run").agg(F.min(k).alias("__lo"), F.max(k).alias("__hi"), F.first(v).alias("height"))
    by = Window.partitionBy(*keys).orderBy("__run")
    top = level.withColumn("__up", (F.col("height") > F.lag("height").over(by)) & (F.col("height") > F.lead("height").over(by))).where("`__up`")
    top = top if height is None else top.where(F.col("height") >= height)
    return top.select(*keys, F.floor((F.col("__lo") + F.col("__hi")) / 2).cast("long").alias("at"), "height")


#: Width of a block of candidates, in distances.
BLOCK = 4096


def apart(peaks: DataFrame, keys: Sequence[str], distance: float) -> DataFrame:
    """The rows of ``peaks`` (*keys, at, height) that stay when the highest goes first and drops all nearer than ``distance``; of equal ones the later goes first.

    Rounds: a candidate that is first among the undecided ones within the distance
    stays, whatever is farther away, and those near it go. This gives what one pass in
    order of height gives. A round works on blocks of places, each with two
    distances of its neighbours' candidates, so a signal is not one task; only what
    is still undecided goes on.
    """
    gap = math.ceil(distance)
    if gap <= 1:
        return peaks
    width, halo = BLOCK * gap, 2 * (gap - 1)
    undecided, kept = peaks.select(*keys, "at", "height"), []
    while True:
        blocks = F.sequence(F.floor((F.col("at") - halo) / width), F.floor((F.col("at") + halo) / width))
        spread = undecided.select(*keys, "at", "height", F.explode(blocks).alias("__block"))
        near = Window.partitionBy(*keys, "__block").orderBy("at").rangeBetween(-(gap - 1), gap - 1)
        first = F.max(F.struct("height", "at")).over(near)["at"] == F.col("at")
        told = spread.withColumn("__stays", first)
        told = told.withColumn("__beaten", F.max("__stays").over(near)).where(F.floor(F.col("at") / width) == F.col("__block"))
        done = written(told.where("`__stays` or not `__beaten`").select(*keys, "at", "height", "__stays"), "peaks")
        kept.append(done.where("`__stays`").drop("__stays"))
        undecided = done.where("not `__stays`").drop("__stays")
        if undecided.isEmpty():
            break
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    return out


# resampling


def resampled(rows: DataFrame, keys: Sequence[str], up: int, down: int, taps: Sequence[float]) -> DataFrame:
    """``*keys, i, v``: ``rows`` (``numbered``) at ``up`` / ``down`` times their rate, through a filter of an odd number of taps.

    Output j is the sum of x[i] * taps[m] * up over i * up + m - half = j * down: each
    sample meets the taps of its residue class, and products are summed by output,
    partly before the shuffle. Samples beyond the ends count as zeros.
    """
    common = math.gcd(up, down)
    up, down = up // common, down // common
    if up == down:
        return rows.select(*keys, "i", "v")
    half = (len(taps) - 1) // 2
    held = rows.sparkSession.createDataFrame([(m, float(h) * up, (half - m) % down) for m, h in enumerate(taps)], "m long, h double, residue long")
    met = rows.join(F.broadcast(held), F.pmod(F.col("i") * up, F.lit(down)) == F.col("residue"))
    out = F.floor((F.col("i") * up + F.col("m") - half) / down)
    return met.select(*keys, "n", out.alias("j"), (F.col("v") * F.col("h")).alias("part")).where(f"j >= 0 and j * {down} < n * {up}").groupBy(*keys, "j").agg(F.sum("part").alias("v")).withColumnRenamed("j", "i")
