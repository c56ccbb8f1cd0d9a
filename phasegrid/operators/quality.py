"""Quality control of a subject's clips: event averages on a common axis, a bounded heat map, an example and one long trace.

Clips are rows ``subject, clip, channel`` with cleaned ``samples``; a clip is short
enough for a row. Windows are cut from a clip's own row; behind that, everything is a row for each event or place.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phasegrid.functions import dsp
from phasegrid.operators import events as ev
from phasegrid.operators import kernels

TRACE = ["subject", "clip", "channel"]
#: The part of a heat map's rows that later events replace.
REPLACED = 20


def cleaned(clips: DataFrame, sfreq: float, line: float) -> DataFrame:
    """Clips without their least-squares line and the mains. Those with a value that isn't finite, or constant ones, go."""

    def kernel(own, x):
        for k, y in enumerate(dsp.filtfilt(dsp.notch(line, sfreq), dsp.detrend(x))):
            yield k, y.tolist()

    return kernels.map_signals(clips, TRACE, "samples", "samples array<double>", kernel)


def banded(clips: DataFrame, sfreq: float, slow: tuple[float, float], spindle: tuple[float, float], depth: float = 0.75, distance_s: float = 0.6, more: Sequence[str] = ()) -> DataFrame:
    """``*TRACE, *more, n, raw, so, sp_z, troughs``: cleaned clips, the slow band, the score of the spindle band's envelope, and the sample numbers of slow troughs of ``depth`` standard deviations."""

    def kernel(own, x):
        so = dsp.bandpass(x, *slow, sfreq)
        sp = dsp.zscore(np.abs(dsp.analytic(dsp.bandpass(x, *spindle, sfreq))))
        for k in range(len(x)):
            yield k, x.shape[1], x[k], so[k], sp[k], dsp.find_peaks(-so[k] / so[k].std(), depth, max(1, int(distance_s * sfreq))).astype(np.int32)

    return kernels.map_signals(clips, [*TRACE, *more], "samples", "n int, raw array<double>, so array<double>, sp_z array<double>, troughs array<int>", kernel)


def inside(half: int) -> Column:
    """The troughs of banded clips whose window lies inside."""
    return F.filter("troughs", lambda t: (t > half) & (t < F.col("n") - half))


def trough_events(rows: DataFrame, half: int) -> DataFrame:
    """``*TRACE, at, n, nth, of``: troughs of banded clips whose window lies inside, numbered in their subject and counted in their clip.

    A clip's first number is the sum of the counts of those before it, so what is put in order is a row for each clip.
    """
    own = rows.select(*TRACE, "n", inside(half).alias("places")).withColumn("of", F.size("places").cast("long")).where("of > 0")
    before = Window.partitionBy("subject").orderBy("clip", "channel").rowsBetween(Window.unboundedPreceding, -1)
    counted = own.withColumn("__before", F.coalesce(F.sum("of").over(before), F.lit(0).cast("long")))
    each = counted.select(*TRACE, "n", "of", "__before", F.posexplode("places").alias("place", "at"))
    return each.select(*TRACE, "at", "n", (F.col("__before") + F.col("place") + 1).alias("nth"), "of")


def between(values: Column, at: Column) -> Column:
    """An array's value at a fractional place, on the line between those beside it."""
    low = F.get(values, F.floor(at).cast("int"))
    return low + (F.get(values, F.ceil(at).cast("int")) - low) * (at - F.floor(at))


def event_epochs(rows: DataFrame, places: Column, sfreq: float, half: int, target: float, values: Sequence[str] = ("raw", "so", "sp_z")) -> DataFrame:
    """``*TRACE, nth, j`` and ``values``: the windows around events at ``target`` samples a second; their last sample holds up to the end.

    ``places`` are sample numbers inside, or structs of ``at`` and ``nth``. A window is cut from its clip's own row, and
    only then spread out: no table of places is joined with one of samples.
    """
    count = int(round(2 * half / sfreq * target))

    def cut(e: Column) -> Column:
        at = e["at"] if numbered else e
        return F.struct((e["nth"] if numbered else F.lit(None).cast("long")).alias("nth"), *[F.slice(v, at - half + 1, F.lit(2 * half)).alias(v) for v in values])

    numbered = dict(rows.select(places.alias("p")).dtypes)["p"] != "array<int>"
    windows = rows.select(*TRACE, F.explode(F.transform(places, cut)).alias("w")).select(*TRACE, "w.*")
    each = windows.select("*", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("j"))
    at = F.least(F.col("j") * sfreq / target, F.lit(2.0 * half - 1))
    return each.select(*TRACE, "nth", "j", *[between(F.col(v), at).alias(v) for v in values])


def epoch_averages(epochs: DataFrame) -> DataFrame:
    """``subject, j, raw, so, sp_z, n_events``: means over a subject's events."""
    return epochs.groupBy("subject", "j").agg(*[F.avg(c).alias(c) for c in ("raw", "so", "sp_z")], F.count("*").alias("n_events"))


def kept_events(events: DataFrame, most: int) -> DataFrame:
    """The rows of ``events`` that a heat map keeps, and their ``slot``; see ``heat_rows``."""
    turn = F.col("nth") % most
    slot = F.when(F.col("nth") <= most, F.col("nth") - 1).when(turn < most // REPLACED, turn)
    own = events.withColumn("slot", slot).where("slot is not null")
    rest = [c for c in events.columns if c not in ("subject", "nth")]
    return own.groupBy("subject", "slot").agg(F.max_by(F.struct("nth", *rest), "nth").alias("e")).select("subject", "slot", "e.*")


def heat_rows(events: DataFrame, epochs: DataFrame, most: int) -> DataFrame:
    """``subject, slot, j, z``: at most ``most`` epochs of a subject, each as its robust score.

    The first ``most`` events have a slot each; later ones replace the first
    twentieth of the slots in turn. A slot keeps its latest event, which is a
    maximum, so subjects' parts can be put together in any order.
    """
    kept = kept_events(events, most).select("subject", "slot", "nth")
    own = epochs.join(kept, ["subject", "nth"]).groupBy("subject", "slot").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "so"))), lambda x: x["so"]).alias("so"))

    def median(x: Column) -> Column:
        s, n = F.array_sort(x), F.size(x)
        return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2

    away = own.withColumn("m", median(F.col("so"))).withColumn("away", F.transform("so", lambda v: v - F.col("m")))
    mad = away.withColumn("mad", 1.4826 * median(F.transform("away", F.abs)))
    mean = F.aggregate("so", F.lit(0.0), lambda s, v: s + v) / F.size("so")
    flat = mad.withColumn("mean", mean).withColumn("sd", F.sqrt(F.aggregate("so", F.lit(0.0), lambda s, v: s + (v - F.col("mean")) * (v - F.col("mean"))) / F.size("so")))
    scale = F.when(F.col("mad") > 0, F.col("mad")).otherwise(F.col("sd")) + 1e-12
    return flat.withColumn("scale", scale).select("subject", "slot", F.posexplode("away").alias("j", "v"), "scale").select("subject", "slot", "j", (F.col("v") / F.col("scale")).alias("z"))


def example_windows(rows: DataFrame, half: int, sfreq: float, half_s: float = 4.0) -> DataFrame:
    """``subject, clip, channel, low, high``: of a subject's banded clips with events the one with the largest waves, around its middle event.

    Scores are compared to a billionth: copies of a clip have the same one, wherever they were filtered.
    """

    def percentile(x: Column) -> Column:
        return between(F.sort_array(x), 0.95 * (F.size(x) - 1))

    score = F.round(percentile(F.transform("so", F.abs)) + 0.2 * percentile(F.col("sp_z")), 9)
    own = rows.select(*TRACE, "n", inside(half).alias("places"), score.alias("score")).where("size(places) > 0")
    middle = own.withColumn("at", F.get("places", F.floor(F.size("places") / 2).cast("int")))
    best = middle.groupBy("subject").agg(F.min_by(F.struct("clip", "channel", "n", "at"), F.struct(-F.col("score"), "clip", "channel")).alias("e")).select("subject", "e.*")
    wide = int(half_s * sfreq)
    return best.select(*TRACE, F.greatest(F.lit(0), F.col("at") - wide).cast("long").alias("low"), F.least(F.col("n"), F.col("at") + wide).cast("long").alias("high"))


def long_traces(clips: DataFrame, sfreq: float, slow: tuple[float, float], spindle: tuple[float, float], most_s: float = 180.0, target: float = 100.0) -> DataFrame:
    """``subject, channel, clip, j, raw, so, sp_z``: the channel with most seconds, its clips in order until ``most_s``, at ``target`` samples a second.

    Of channels with equal seconds the one with more clips, then the last by name.
    A clip that reaches over ``most_s`` is cut before its bands are made.
    """
    sized = clips.select(*TRACE, (F.size("samples") / sfreq).alias("dur"))
    best = sized.groupBy("subject", "channel").agg(F.sum("dur").alias("s"), F.count("*").alias("c")).groupBy("subject").agg(F.max_by("channel", F.struct("s", "c", "channel")).alias("channel"))
    used = ev.until_cap(sized.join(best, ["subject", "channel"]), ["subject"], ["clip"], "dur", most_s).select(*TRACE, "used")
    count = F.greatest(F.lit(2), (F.col("used") * sfreq).cast("int"))
    short = clips.join(used, TRACE).withColumn("samples", F.slice("samples", F.lit(1), count))
    out = F.greatest(F.lit(2), F.rint(F.col("used") * target).cast("int"))
    values = ("raw", "so", "sp_z")

    def place(j: Column) -> Column:
        at = F.least(j * F.col("used") / F.col("out") * sfreq, F.col("n") - 1.0)
        return F.struct(j.alias("j"), *[between(F.col(v), at).alias(v) for v in values])

    rows = banded(short.withColumn("out", out), sfreq, slow, spindle, more=["used", "out"])
    return rows.select(*TRACE, F.explode(F.transform(F.sequence(F.lit(0), F.col("out") - 1), place)).alias("w")).select(*TRACE, "w.*")


def summary(clips: DataFrame, rows: DataFrame, sfreq: float, half: int) -> DataFrame:
    """``subject, n_clips, n_channels, n_traces, duration_s, n_events`` of subjects with events."""
    traces = clips.groupBy("subject").agg(F.countDistinct("clip").alias("n_clips"), F.countDistinct("channel").alias("n_channels"), F.count("*").alias("n_traces"), F.sum(F.size("samples") / sfreq).alias("duration_s"))
    return traces.join(rows.groupBy("subject").agg(F.sum(F.size(inside(half))).alias("n_events")).where("n_events > 0"), "subject")
