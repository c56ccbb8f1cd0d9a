"""Queries over point events: the ``events`` table, a channel for each user, a type for each kind of event."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phasegrid.operators import events as ev
from phasegrid.operators import inference, rollup
from phasegrid.plans import sql

HOUR = 3600.0


def table(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").withColumn("t", ev.seconds("ts"))


def _grid(spark, d):
    return ev.on_grid(table(spark, d), ["user_id"], "t", "value", HOUR)


def _marked(spark, d, closed_left):
    own = table(spark, d)
    marks = own.where("event_type = 'error'").select("user_id", F.col("t").alias("mark"))
    return ev.outside_marks(own.where("event_type <> 'error'"), marks, ["user_id"], "t", "mark", 1800.0, closed_left).select("event_id", "user_id", "event_type")


def ied_mask_antijoin(spark, d):
    """Events with no error of the same user in [-30 min, +30 min)."""
    return _marked(spark, d, True)


def ied_mask_open(spark, d):
    """The same with both ends open."""
    return _marked(spark, d, False)


def triggered_average(spark, d):
    """Mean hourly value from four hours before a purchase to just before four after, over the gap-filled grid."""
    grid = ev.interpolated(_grid(spark, d), ["user_id"]).select("user_id", "k", F.col("filled").alias("v"))
    buys = table(spark, d).where("event_type = 'purchase'").select("user_id", F.floor(F.col("t") / HOUR).alias("k0"))
    return ev.windows_around(buys, grid, ["user_id"], "k0", 4).groupBy("offset").agg(F.round(F.avg("v"), 7).alias("mean_v"), F.count("*").alias("n"))


def upstate_mean(spark, d):
    """Each user's mean over the first three hours from a purchase on, for users with five values or more."""
    grid = _grid(spark, d).where("v is not null")
    buys = table(spark, d).where("event_type = 'purchase'").select("user_id", F.floor(F.col("t") / HOUR).alias("k0"))
    up = ev.windows_around(buys, grid, ["user_id"], "k0", 4).groupBy("user_id").agg(F.avg(F.when(F.col("offset").between(0, 2), F.col("v"))).alias("m"), F.count("*").alias("n"))
    return up.where("n >= 5").select("user_id", F.round("m", 7).alias("up_mean"), "n")


def split_half(spark, d):
    """Means of every other event of each user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    odd = table(spark, d).withColumn("odd", (F.row_number().over(w) - 1) % 2)
    halves = odd.groupBy("user_id").agg(F.avg(F.when(F.col("odd") == 0, F.col("value"))).alias("a"), F.avg(F.when(F.col("odd") == 1, F.col("value"))).alias("b"))
    return halves.select("user_id", F.round("a", 8).alias("even_mean"), F.round("b", 8).alias("odd_mean"))


def _after_purchase(spark, d):
    """A row for each purchase with values in the three hours from it on: its own value, their mean, and its place among the user's."""
    grid = _grid(spark, d).where("v is not null")
    buys = table(spark, d).where("event_type = 'purchase'").withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1)
    wanted = buys.select("user_id", "event_id", "place", F.col("value").alias("depth"), F.floor(F.col("t") / HOUR).alias("k0"))
    hours = wanted.withColumn("k", F.explode(F.sequence(F.col("k0"), F.col("k0") + 2))).join(grid, ["user_id", "k"])
    return hours.groupBy("user_id", "event_id", "place", "depth").agg(F.avg("v").alias("up"))


def _halves(spark, d):
    """Each user's mean after purchases of even and of odd place, to a billionth, and over all."""
    of = lambda k: F.round(F.avg(F.when(F.col("place") % 2 == k, F.col("up"))), 9)
    return _after_purchase(spark, d).groupBy("user_id").agg(of(0).alias("a"), of(1).alias("b"), F.avg("up").alias("up"), F.count("*").alias("n")).where("a is not null and b is not null")


def split_half_reliability(spark, d):
    """Rank correlation over users between the halves' means after a purchase."""
    return rollup.spearman(_halves(spark, d), [], "a", "b").select(F.round("rho", 9).alias("rho"), "n")


#: Purchases drawn for the correlation, of a user and of all.
EVENTS_EACH, EVENTS_POOLED = 400, 3000


def validation_summary(spark, d):
    """Users and events, the mean over users with its interval, how the halves agree, and how the mean after a purchase goes with the purchase's own value, over a drawn sample of purchases."""
    each = _after_purchase(spark, d).withColumn("up", F.round("up", 9)).withColumn("drawn", F.md5(F.concat_ws("|", F.lit("9"), F.col("user_id").cast("string"), F.col("event_id").cast("string"))))
    each = ev.first_n(each, ["user_id"], ["drawn"], EVENTS_EACH).orderBy("drawn").limit(EVENTS_POOLED)
    halves = _halves(spark, d)
    interval = inference.bootstrap(halves, [], ["user_id"], "up").select(F.round("ci_lo", 7).alias("ci_lo"), F.round("ci_hi", 7).alias("ci_hi"), F.lit(0).alias("all"))
    one = halves.agg(F.count("*").alias("n_users"), F.sum("n").alias("n_events"), F.round(F.avg("up"), 7).alias("mean_up")).withColumn("all", F.lit(0)).join(interval, "all")
    split = rollup.spearman(halves, [], "a", "b").select(F.lit(0).alias("all"), F.round("rho", 9).alias("split_r"))
    depth = rollup.spearman(each, [], "depth", "up").select(F.lit(0).alias("all"), F.round("rho", 9).alias("depth_r"))
    return one.join(split, "all").join(depth, "all").drop("all")


def validation_by_cohort(spark, d):
    """The same for three cohorts of users: number, mean, standard error, interval, and the halves' rank correlation."""
    halves = _halves(spark, d).withColumn("cohort", F.col("user_id") % 3)
    means = halves.groupBy("cohort").agg(F.count("*").alias("n_subj"), F.round(F.avg("up"), 7).alias("mean_up"), F.round(F.stddev_pop("up") / F.sqrt(F.count("*")), 7).alias("sem"))
    interval = inference.bootstrap(halves, ["cohort"], ["user_id"], "up").select("cohort", F.round("ci_lo", 7).alias("ci_lo"), F.round("ci_hi", 7).alias("ci_hi"))
    return means.join(interval, "cohort").join(rollup.spearman(halves, ["cohort"], "a", "b").select("cohort", F.round("rho", 9).alias("split_r")), "cohort")


def event_phase_rayleigh(spark, d):
    """Time of day as phase: resultant, preferred phase and p of each event type."""
    phase = table(spark, d).withColumn("phase", F.pmod(F.col("t"), F.lit(86400.0)) / 86400.0 * 2 * math.pi - math.pi)
    r = ev.rayleigh(phase, ["event_type"])
    return r.select("event_type", "n", F.round("mrl", 9).alias("mrl"), F.round("pref_phase", 6).alias("pref_phase"), F.round("rayleigh_p", 7).alias("rayleigh_p"))


def rayleigh_share(spark, d):
    """Users whose events prefer a time of day (p < 0.05), of those with 20 events or more."""
    phase = table(spark, d).withColumn("phase", F.pmod(F.col("t"), F.lit(86400.0)) / 86400.0 * 2 * math.pi - math.pi)
    return ev.rayleigh(phase, ["user_id"], least=20).agg(F.count_if(F.col("rayleigh_p") < 0.05).alias("n_locked"), F.count("*").alias("n_users"))


def gaps_islands_capped(spark, d):
    """Stretches of consecutive hours with an event of a user, at most three hours each."""
    busy = _grid(spark, d).withColumn("busy", F.col("v").isNotNull())
    return ev.capped_runs(busy, ["user_id"], "busy", 3).select("user_id", "first_k", "last_k", "n")


def sliding_best_window(spark, d):
    """The nine hours of each user with the largest mean value, gaps filled."""
    grid = ev.interpolated(_grid(spark, d), ["user_id"]).select("user_id", "k", F.col("filled").alias("v"))
    return ev.best_window(grid, ["user_id"], 9).select("user_id", F.round("mean_v", 6).alias("mean_v"))


def gap_interp(spark, d):
    return ev.interpolated(_grid(spark, d), ["user_id"]).select("user_id", "k", F.round("filled", 8).alias("filled"))


def usable_share(spark, d):
    """Share of hours with a value; usable from 70 percent on."""
    return _grid(spark, d).groupBy("user_id").agg(F.round(F.avg(F.col("v").isNotNull().cast("double")), 9).alias("share"), (F.avg(F.col("v").isNotNull().cast("double")) >= 0.7).alias("usable"))


def percentile_stage(spark, d):
    """Hours at or above the user's 55th percentile count as staged."""
    grid = ev.knots(table(spark, d), ["user_id"], "t", "value", HOUR).where("v is not null").select("user_id", "v")
    staged = rollup.with_percentile(grid, ["user_id"], "v", 0.55, "cut").withColumn("staged", F.col("v") >= F.col("cut"))
    return staged.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("staged").alias("n_staged"))


def value_percentiles(spark, d):
    """Exact percentiles with linear interpolation, median and count of each event type."""
    got = rollup.exact_percentiles(table(spark, d), ["event_type"], "value", (0.025, 0.975, 0.95, 0.98, 0.5))
    return got.select("event_type", *[F.round(F.col("percentiles")[k], 7).alias(n) for k, n in enumerate(("p025", "p975", "p95", "p98", "median"))], "n")


def tumbling_epochs(spark, d):
    """Fixed epochs of 30 minutes."""
    w = table(spark, d).groupBy(F.window("ts", "30 minutes"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 8).alias("mean_value"))
    return w.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("epoch"), "event_type", "n", "mean_value")


def sliding_epochs(spark, d):
    """Nine-hour windows every three hours."""
    w = table(spark, d).groupBy(F.window("ts", "9 hours", "3 hours")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 8).alias("mean_value"))
    return w.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("epoch"), "n", "mean_value")


def session_runs(spark, d):
    """Runs of a user's events without a gap of two hours."""
    s = table(spark, d).groupBy("user_id", F.session_window("ts", "2 hours")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return s.select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("begin"), "n", "total")


def cumulative_cap(spark, d):
    """Each user's first events until their values add up to 180, the last one cut."""
    own = ev.until_cap(table(spark, d), ["user_id"], ["ts", "event_id"], "value", 180.0)
    return own.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("used"), 6).alias("used"))


def kept_rows(spark, d):
    """Every third event of a user, forty at most."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    placed = table(spark, d).withColumn("place", F.row_number().over(w) - 1)
    return placed.where("place % 3 = 0 and place < 120").select("user_id", "event_id", "place")


def first_events(spark, d):
    return ev.first_n(table(spark, d), ["user_id"], ["ts", "event_id"], 5).select("user_id", "rank", "event_id")


def best_channel(spark, d):
    """The user with the most events of each type; ties by the larger total, then the smaller id."""
    per = table(spark, d).groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    best = F.max_by(F.struct("user_id", "n"), F.struct(F.col("n"), F.col("total"), -F.col("user_id")))
    return per.groupBy("event_type").agg(best.alias("b")).select("event_type", "b.user_id", "b.n")


def sample_indices(spark, d):
    """Onsets in minutes as samples at 500 a minute: rounded half to even, and cut off."""
    onset = F.col("value") / 60
    own = table(spark, d).select("event_id", ev.rounded_sample(onset, 500.0).alias("nearest"), ev.truncated_sample(onset, 500.0).alias("cut"))
    return own


def event_type_normalised(spark, d):
    """Two kinds merged, one kept, the others dropped."""
    kind = F.when(F.col("event_type").isin("click", "view"), "seen").when(F.col("event_type") == "purchase", "bought")
    return table(spark, d).withColumn("kind", kind).where("kind is not null").groupBy("user_id", "kind").agg(F.count("*").alias("n"))


def json_props(spark, d):
    got = table(spark, d).withColumn("k", F.from_json("props", "k int")["k"])
    return got.groupBy("event_type").agg(F.sum("k").cast("long").alias("sum_k"), F.count_if(F.col("k").isNull()).alias("n_missing"), F.max("k").alias("max_k"))


def night_bins(spark, d):
    """Six equal stretches of a user's recording; mean and standard error in each."""
    own = table(spark, d).withColumn("t0", F.min("t").over(Window.partitionBy("user_id"))).withColumn("t1", F.max("t").over(Window.partitionBy("user_id")))
    tbin = F.least(F.lit(5), F.floor((F.col("t") - F.col("t0")) * 6 / (F.col("t1") - F.col("t0")))).cast("int")
    got = own.where("t1 > t0").groupBy("user_id", tbin.alias("tbin")).agg(F.avg("value").alias("m"), (F.stddev_pop("value") / F.sqrt(F.count("*"))).alias("sem"), F.count("*").alias("n"))
    return got.select("user_id", "tbin", F.round("m", 7).alias("mean_value"), F.round("sem", 7).alias("sem"), "n")


QUERIES = {f.__name__: f for f in (
    split_half_reliability, validation_summary, validation_by_cohort,
    ied_mask_antijoin, ied_mask_open, triggered_average, upstate_mean, split_half, event_phase_rayleigh, rayleigh_share, gaps_islands_capped, sliding_best_window, gap_interp, usable_share, percentile_stage,
    value_percentiles, tumbling_epochs, sliding_epochs, session_runs, cumulative_cap, kept_rows, first_events, best_channel, sample_indices, event_type_normalised, json_props, night_bins,
)}

_T = "e AS (SELECT *, epoch_us(ts) / 1e6 AS t FROM events)"
_G = _T + """, f AS (SELECT user_id, floor(t / 3600)::BIGINT AS k, avg(value) AS v FROM e GROUP BY 1, 2),
    g AS (SELECT s.user_id, s.k, f.v FROM (SELECT user_id, unnest(range(min(k), max(k) + 1)) AS k FROM f GROUP BY 1) s LEFT JOIN f USING (user_id, k))"""
_I = _G + """, n AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN k END IGNORE NULLS) OVER b AS ak, last_value(v IGNORE NULLS) OVER b AS av,
        first_value(CASE WHEN v IS NOT NULL THEN k END IGNORE NULLS) OVER a AS zk, first_value(v IGNORE NULLS) OVER a AS zv FROM g
        WINDOW b AS (PARTITION BY user_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY user_id ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    i AS (SELECT user_id, k, coalesce(v, av + (zv - av) * (k - ak) / (zk - ak)) AS filled FROM n)"""
_RAY = """, p AS (SELECT *, (t - floor(t / 86400) * 86400) / 86400 * 2 * pi() - pi() AS phase FROM e),
    r AS (SELECT {key}, count(*) AS n, sqrt(pow(sum(cos(phase)), 2) + pow(sum(sin(phase)), 2)) / count(*) AS mrl, atan2(sum(sin(phase)), sum(cos(phase))) AS pref FROM p GROUP BY 1),
    q AS (SELECT *, greatest(0.0, least(1.0, exp(-n * mrl * mrl) * (1 + (2 * n * mrl * mrl - pow(n * mrl * mrl, 2)) / (4 * n)))) AS pv FROM r)"""
_ANTI = f"WITH {_T} SELECT event_id, user_id, event_type FROM e WHERE event_type <> 'error' AND NOT EXISTS (SELECT 1 FROM e m WHERE m.event_type = 'error' AND m.user_id = e.user_id AND e.t {{low}} m.t - 1800 AND e.t < m.t + 1800)"

_UP = _G + """, b AS (SELECT user_id, event_id, value AS depth, floor(t / 3600)::BIGINT AS k0, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS place FROM e WHERE event_type = 'purchase'),
    u AS (SELECT b.user_id, event_id, place, depth, avg(v) AS up FROM b JOIN g ON g.user_id = b.user_id AND g.k BETWEEN k0 AND k0 + 2 WHERE v IS NOT NULL GROUP BY 1, 2, 3, 4),
    h AS (SELECT user_id, user_id % 3 AS cohort, round(avg(up) FILTER (place % 2 = 0), 9) AS a, round(avg(up) FILTER (place % 2 = 1), 9) AS b, avg(up) AS up, count(*) AS n FROM u GROUP BY 1 HAVING a IS NOT NULL AND b IS NOT NULL)"""
_RANK = "rank() OVER ({p} ORDER BY {v}) + (count(*) OVER (PARTITION BY {k}{v}) - 1) / 2"
_AB = f"{_RANK.format(p='', k='', v='a')} AS ra, {_RANK.format(p='', k='', v='b')} AS rb"
_ABC = f"{_RANK.format(p='PARTITION BY cohort', k='cohort, ', v='a')} AS ra, {_RANK.format(p='PARTITION BY cohort', k='cohort, ', v='b')} AS rb"

ORACLES = {
    "split_half_reliability": f"WITH {_UP} SELECT round(corr(ra, rb), 9) AS rho, count(*) AS n FROM (SELECT {_AB} FROM h)",
    "validation_summary": f"""WITH {_UP}, s AS (SELECT round(corr(ra, rb), 9) AS split_r FROM (SELECT {_AB} FROM h)), {sql.bootstrap("h", [], ["user_id"], "up")},
        drawn AS (SELECT *, md5('9|' || user_id || '|' || event_id) AS draw FROM u QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY draw) <= {EVENTS_EACH}),
        d AS (SELECT depth AS a, round(up, 9) AS b FROM drawn ORDER BY draw LIMIT {EVENTS_POOLED}), r AS (SELECT round(corr(ra, rb), 9) AS depth_r FROM (SELECT {_AB} FROM d))
        SELECT n_users, n_events, mean_up, round(ci_lo, 7) AS ci_lo, round(ci_hi, 7) AS ci_hi, split_r, depth_r FROM (SELECT count(*) AS n_users, sum(n)::BIGINT AS n_events, round(avg(up), 7) AS mean_up FROM h), s, r, ci""",
    "validation_by_cohort": f"""WITH {_UP}, {sql.bootstrap("h", ["cohort"], ["user_id"], "up")}
        SELECT h.cohort, count(*) AS n_subj, round(avg(up), 7) AS mean_up, round(stddev_pop(up) / sqrt(count(*)), 7) AS sem, round(any_value(ci_lo), 7) AS ci_lo, round(any_value(ci_hi), 7) AS ci_hi, round(corr(ra, rb), 9) AS split_r FROM (SELECT *, {_ABC} FROM h) h JOIN ci USING (cohort) GROUP BY 1""",
    "ied_mask_antijoin": _ANTI.format(low=">="),
    "ied_mask_open": _ANTI.format(low=">"),
    "triggered_average": f"WITH {_I}, b AS (SELECT user_id, floor(t / 3600)::BIGINT AS k0 FROM e WHERE event_type = 'purchase') SELECT (i.k - b.k0)::INT AS \"offset\", round(avg(filled), 7) AS mean_v, count(*) AS n FROM b JOIN i ON i.user_id = b.user_id AND i.k >= b.k0 - 4 AND i.k < b.k0 + 4 GROUP BY 1",
    "upstate_mean": f"WITH {_G}, b AS (SELECT user_id, floor(t / 3600)::BIGINT AS k0 FROM e WHERE event_type = 'purchase') SELECT b.user_id, round(avg(CASE WHEN g.k - b.k0 BETWEEN 0 AND 2 THEN v END), 7) AS up_mean, count(*) AS n FROM b JOIN g ON g.user_id = b.user_id AND g.k >= b.k0 - 4 AND g.k < b.k0 + 4 WHERE v IS NOT NULL GROUP BY 1 HAVING count(*) >= 5",
    "split_half": f"WITH {_T}, o AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) % 2 AS odd FROM e) SELECT user_id, round(avg(value) FILTER (odd = 0), 8) AS even_mean, round(avg(value) FILTER (odd = 1), 8) AS odd_mean FROM o GROUP BY 1",
    "event_phase_rayleigh": f"WITH {_T}{_RAY.format(key='event_type')} SELECT event_type, n, round(mrl, 9) AS mrl, round(pref, 6) AS pref_phase, round(pv, 7) AS rayleigh_p FROM q WHERE n >= 5",
    "rayleigh_share": f"WITH {_T}{_RAY.format(key='user_id')} SELECT count(*) FILTER (pv < 0.05) AS n_locked, count(*) AS n_users FROM q WHERE n >= 20",
    "gaps_islands_capped": f"WITH {_G}, r AS (SELECT user_id, k, k - row_number() OVER (PARTITION BY user_id ORDER BY k) AS r FROM g WHERE v IS NOT NULL), p AS (SELECT *, (row_number() OVER (PARTITION BY user_id, r ORDER BY k) - 1) // 3 AS p FROM r) SELECT user_id, min(k) AS first_k, max(k) AS last_k, count(*) AS n FROM p GROUP BY user_id, r, p",
    "sliding_best_window": f"WITH {_I}, w AS (SELECT user_id, k, avg(filled) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING) AS m, row_number() OVER (PARTITION BY user_id ORDER BY k) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM i) SELECT user_id, round(max(m), 6) AS mean_v FROM w WHERE pos < n - 9 GROUP BY 1",
    "gap_interp": f"WITH {_I} SELECT user_id, k, round(filled, 8) AS filled FROM i",
    "usable_share": f"WITH {_G} SELECT user_id, round(avg((v IS NOT NULL)::INT), 9) AS share, avg((v IS NOT NULL)::INT) >= 0.7 AS usable FROM g GROUP BY 1",
    "percentile_stage": f"WITH {_G}, c AS (SELECT user_id, quantile_cont(v, 0.55) AS c FROM g GROUP BY 1) SELECT user_id, count(*) AS n, count(*) FILTER (v >= c) AS n_staged FROM g JOIN c USING (user_id) WHERE v IS NOT NULL GROUP BY 1",
    "value_percentiles": "SELECT event_type, round(quantile_cont(value, 0.025), 7) AS p025, round(quantile_cont(value, 0.975), 7) AS p975, round(quantile_cont(value, 0.95), 7) AS p95, round(quantile_cont(value, 0.98), 7) AS p98, round(median(value), 7) AS median, count(value) AS n FROM events GROUP BY 1",
    "tumbling_epochs": "SELECT strftime(time_bucket(INTERVAL 30 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS epoch, event_type, count(*) AS n, round(avg(value), 8) AS mean_value FROM events GROUP BY 1, 2",
    "sliding_epochs": "SELECT strftime(make_timestamp(((epoch_us(ts) // 10800000000) - o) * 10800000000), '%Y-%m-%d %H:%M:%S') AS epoch, count(*) AS n, round(avg(value), 8) AS mean_value FROM events, range(0, 3) r(o) GROUP BY 1",
    "session_runs": "WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS begin, count(*) AS n, round(sum(value), 6) AS total FROM s GROUP BY user_id, s",
    "cumulative_cap": "WITH c AS (SELECT *, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - value AS b FROM events) SELECT user_id, count(*) AS n, round(sum(least(value, 180.0 - b)), 6) AS used FROM c WHERE least(value, 180.0 - b) > 0 GROUP BY 1",
    "kept_rows": "SELECT user_id, event_id, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS place FROM events) WHERE place % 3 = 0 AND place < 120",
    "first_events": "SELECT user_id, rank::INT AS rank, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rank FROM events) WHERE rank <= 5",
    "best_channel": "SELECT event_type, user_id, n FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, total DESC, user_id) AS r FROM (SELECT event_type, user_id, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2)) WHERE r = 1",
    "sample_indices": "SELECT event_id, round_even(value / 60 * 500.0, 0)::BIGINT AS nearest, trunc(value / 60 * 500.0)::BIGINT AS cut FROM events",
    "event_type_normalised": "SELECT user_id, CASE WHEN event_type IN ('click', 'view') THEN 'seen' ELSE 'bought' END AS kind, count(*) AS n FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY 1, 2",
    "json_props": "SELECT event_type, sum((props->>'k')::INT)::BIGINT AS sum_k, count(*) FILTER ((props->>'k') IS NULL) AS n_missing, max((props->>'k')::INT) AS max_k FROM events GROUP BY 1",
    "night_bins": f"WITH {_T}, b AS (SELECT *, min(t) OVER (PARTITION BY user_id) AS t0, max(t) OVER (PARTITION BY user_id) AS t1 FROM e) SELECT user_id, least(5, floor((t - t0) * 6 / (t1 - t0)))::INT AS tbin, round(avg(value), 7) AS mean_value, round(stddev_pop(value) / sqrt(count(*)), 7) AS sem, count(*) AS n FROM b WHERE t1 > t0 GROUP BY 1, 2",
}
