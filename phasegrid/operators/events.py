"""Point events: masks, grids, runs, epochs and phases. Times are seconds (double) or whole samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seconds(ts: str | Column) -> Column:
    """Seconds since 1970 of a timestamp without a zone, to the microsecond."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(c.cast("timestamp")) / 1e6


def outside_marks(events: DataFrame, marks: DataFrame, keys: Sequence[str], t: str, mark: str, within: float, closed_left: bool = True) -> DataFrame:
    """Events with no mark of their keys near.

    An event goes if mark - within <= t < mark + within (``closed_left``), or if
    abs(t - mark) < within otherwise. Marks are looked up in the event's own and
    the two next stretches of ``within`` seconds, so the join is on equal keys and
    its cost does not grow with the product of both tables.
    """
    bucket = lambda c: F.floor(c / within)
    around = marks.select(*keys, F.col(mark).alias("__m"), F.explode(F.sequence(bucket(F.col(mark)) - 1, bucket(F.col(mark)) + 1)).alias("__b"))
    t_col, m = F.col(t), F.col("__m")
    low = t_col >= m - within if closed_left else t_col > m - within
    own = events.withColumn("__b", bucket(t_col))
    on = [own[k] == around[k] for k in keys] + [own["__b"] == around["__b"], low, t_col < m + within]
    return own.join(around, on, "left_anti").drop("__b")


def on_grid(events: DataFrame, keys: Sequence[str], t: str, value: str, step: float) -> DataFrame:
    """``*keys, k, v``: mean value of each step of time, with a null for each step between the first and the last that has none."""
    filled = events.groupBy(*keys, F.floor(F.col(t) / step).alias("k")).agg(F.avg(value).alias("v"))
    spine = filled.groupBy(*keys).agg(F.min("k").alias("lo"), F.max("k").alias("hi")).select(*keys, F.explode(F.sequence("lo", "hi")).alias("k"))
    return spine.join(filled, [*keys, "k"], "left")


def interpolated(grid: DataFrame, keys: Sequence[str], k: str = "k", v: str = "v") -> DataFrame:
    """Gaps filled on the line between the values beside them; the ends hold a value by construction of the grid.

    The next value is the last one met in descending order: a running frame costs one
    step a row, one that reaches to the end of the partition reads it again for each.
    """
    back = Window.partitionBy(*keys).orderBy(k).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(F.desc(k)).rowsBetween(Window.unboundedPreceding, 0)
    at = F.when(F.col(v).isNotNull(), F.struct(F.col(k).alias("k"), F.col(v).alias("v")))
    both = grid.withColumn("__a", F.last(at, ignorenulls=True).over(back)).withColumn("__z", F.last(at, ignorenulls=True).over(ahead))
    a, z = F.col("__a"), F.col("__z")
    line = a["v"] + (z["v"] - a["v"]) * (F.col(k) - a["k"]) / (z["k"] - a["k"])
    return both.withColumn("filled", F.coalesce(F.col(v), line, a["v"], z["v"])).drop("__a", "__z")


def knots(events: DataFrame, keys: Sequence[str], t: str, value: str, step: float) -> DataFrame:
    """``*keys, k, v, low, high, next_k, next_v``: the steps with a mean value, the steps each fills up to the next one, and that one's value.

    What ``on_grid`` and ``interpolated`` give, before it is spread out: only steps
    with events are shuffled and sorted, gaps are filled from a row's own columns.
    Keys without any value have one row, whose value is null.
    """
    held = events.groupBy(*keys, F.floor(F.col(t) / step).alias("k")).agg(F.avg(value).alias("v")).where("k is not null")
    known = held.withColumn("v", F.when(~F.greatest(*[F.col(c).isNull() for c in keys], F.lit(False)), F.col("v")))
    whole, by = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("k")
    ends = known.withColumn("__lo", F.min("k").over(whole)).withColumn("__hi", F.max("k").over(whole)).withColumn("__some", F.count("v").over(whole))
    own = ends.where("v is not null or (`__some` = 0 and k = `__lo`)")
    low = F.when(F.lag("k").over(by).isNull(), F.col("__lo")).otherwise(F.col("k"))
    return own.select(*keys, "k", "v", low.alias("low"), F.coalesce(F.lead("k").over(by) - 1, F.col("__hi")).alias("high"), F.lead("k").over(by).alias("next_k"), F.lead("v").over(by).alias("next_v"))


def on_line(at: Column) -> Column:
    """A knot's value at one of its steps: on the line to the next one, held at the ends."""
    line = F.col("v") + (F.col("next_v") - F.col("v")) * (at - F.col("k")) / (F.col("next_k") - F.col("k"))
    return F.when((at > F.col("k")) & F.col("next_k").isNotNull(), line).otherwise(F.col("v"))


def spread(knots: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``*keys, k, v, filled`` from knots: a row for each step, as ``interpolated`` gives it."""
    own = knots.select("*", F.explode(F.sequence("low", "high")).alias("__at"))
    return own.select(*keys, F.col("__at").alias("k"), F.when(F.col("__at") == F.col("k"), F.col("v")).alias("v"), on_line(F.col("__at")).alias("filled"))


def joined_up() -> Column:
    """An aggregate over knots, or parts of them: their values in order as one array."""
    part = F.struct("low", F.transform(F.sequence("low", "high"), on_line).alias("x"))
    return F.flatten(F.transform(F.sort_array(F.collect_list(part)), lambda p: p["x"]))


def best_window(grid: DataFrame, keys: Sequence[str], width: int, k: str = "k", v: str = "v") -> DataFrame:
    """``*keys, start, mean_v``: the earliest of the best full windows of ``width`` steps; the very last start is not tried."""
    own = Window.partitionBy(*keys).orderBy(k)
    ahead = own.rowsBetween(0, width - 1)
    n = F.count("*").over(Window.partitionBy(*keys))
    slid = grid.withColumn("m", F.avg(v).over(ahead)).withColumn("pos", F.row_number().over(own) - 1).withColumn("n", n)
    return slid.where(F.col("pos") < F.col("n") - width).groupBy(*keys).agg(F.max_by(F.struct(k, "m"), F.struct(F.col("m"), -F.col(k))).alias("b")).select(*keys, F.col(f"b.{k}").alias("start"), F.col("b.m").alias("mean_v"))


def capped_runs(grid: DataFrame, keys: Sequence[str], flag: str, cap: int, k: str = "k") -> DataFrame:
    """``*keys, first_k, last_k, n``: stretches of consecutive flagged steps, cut after ``cap`` steps."""
    w = Window.partitionBy(*keys).orderBy(k)
    island = F.col(k) - F.row_number().over(w)
    runs = grid.where(F.col(flag)).withColumn("__r", island)
    part = F.floor((F.row_number().over(Window.partitionBy(*keys, "__r").orderBy(k)) - 1) / cap)
    return runs.withColumn("__p", part).groupBy(*keys, "__r", "__p").agg(F.min(k).alias("first_k"), F.max(k).alias("last_k"), F.count("*").alias("n")).drop("__r", "__p")


def until_cap(rows: DataFrame, keys: Sequence[str], order: Sequence[str], length: str, cap: float) -> DataFrame:
    """Rows in order until their lengths add up to ``cap``; ``used`` is what each contributes, the last one cut."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = F.sum(length).over(w) - F.col(length)
    return rows.withColumn("used", F.least(F.col(length), F.lit(float(cap)) - before)).where("used > 0")


def first_n(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """The first rows of each key; the filter on the rank is applied before the shuffle too."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def rayleigh(phases: DataFrame, keys: Sequence[str], phase: str = "phase", least: int = 5) -> DataFrame:
    """``*keys, n, mrl, pref_phase, rayleigh_p``: resultant, circular mean and Zar's p of groups of ``least`` or more."""
    sums = phases.groupBy(*keys).agg(F.count(phase).alias("n"), F.sum(F.cos(phase)).alias("c"), F.sum(F.sin(phase)).alias("s")).where(F.col("n") >= least)
    r = F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s")) / F.col("n")
    z = F.col("n") * r * r
    p = F.exp(-z) * (1 + (2 * z - z * z) / (4 * F.col("n")))
    return sums.select(*keys, "n", r.alias("mrl"), F.atan2("s", "c").alias("pref_phase"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)).alias("rayleigh_p"))


def windows_around(events: DataFrame, grid: DataFrame, keys: Sequence[str], e: str, half: int, k: str = "k", v: str = "v") -> DataFrame:
    """``*keys, e, offset, v``: the grid's values from ``half`` steps before an event to just before ``half`` after it.

    Each event names the steps it needs, so the join is on equal keys.
    """
    wanted = events.select(*keys, F.col(e).alias("e"), F.explode(F.sequence(F.lit(-half), F.lit(half - 1))).alias("offset"))
    wanted = wanted.withColumn(k, F.col("e") + F.col("offset"))
    return wanted.join(grid.select(*keys, k, v), [*keys, k]).select(*keys, "e", "offset", v)


def rounded_sample(onset: Column, rate: float) -> Column:
    """Nearest sample, halves to even."""
    return F.rint(onset * rate).cast("long")


def truncated_sample(onset: Column, rate: float) -> Column:
    return (onset * rate).cast("long")
