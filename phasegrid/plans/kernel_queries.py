"""Queries over recordings: each user's hourly values, gaps filled, at 24 samples a day.

Rates and bands are per day, so that the slow band is one cycle a day. Filtering,
spectra, peaks and resampling work on blocks or single samples of the signals; the
kernels that take whole signals have no SQL form.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phasegrid.functions import dsp
from phasegrid.operators import blocks, inference, kernels, quality, rollup, samples
from phasegrid.operators import events as ev
from phasegrid.plans import event_queries, relational_queries, sql
from phasegrid.session import scratch, written
from phasegrid.sources import ranges

RATE = 24.0
SLOW, SPINDLE, RIPPLE = (0.5, 1.25), (2.0, 4.0), (6.0, 11.0)


#: Hours of a block; signals are longer, so filters go on from block to block.
HOURS = 256


def _knots(spark: SparkSession, d: str) -> DataFrame:
    return ev.knots(event_queries.table(spark, d), ["user_id"], "t", "value", event_queries.HOUR)


def hours(spark: SparkSession, d: str) -> DataFrame:
    """``user_id, k, v``: a row for each hour from the user's first event to the last."""
    return ev.spread(_knots(spark, d), ["user_id"]).select("user_id", "k", F.col("filled").alias("v"))


def slow_hours(spark: SparkSession, d: str) -> DataFrame:
    """``user_id, i, x``: the slow band, line taken off, zero phase."""
    own = blocks.blocks_of_knots(_knots(spark, d), ["user_id"], HOURS)
    return blocks.samples_of_blocks(blocks.bandpassed_blocks(own, ["user_id"], *SLOW, RATE), ["user_id"])


def recordings(spark: SparkSession, d: str) -> DataFrame:
    """``user_id, samples, marks``: a user's hours from the first event to the last, and the hours of purchases in it."""
    signals = _knots(spark, d).groupBy("user_id").agg(ev.joined_up().alias("samples"), F.min("low").alias("k0"))
    marks = event_queries.table(spark, d).where("event_type = 'purchase'").groupBy("user_id").agg(F.sort_array(F.collect_list(F.floor(F.col("t") / 3600))).alias("hours"))
    at = F.transform(F.coalesce("hours", F.array().cast("array<bigint>")), lambda h: (h - F.col("k0")).cast("int"))
    return signals.join(marks, "user_id", "left").select("user_id", "samples", at.alias("marks"))


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def pac_surrogate_z(spark, d):
    return _rounded(kernels.coupling_z(recordings(spark, d), ["user_id"], "samples", SLOW, SPINDLE, RATE))


def pac_masked(spark, d):
    """Without the last sixth of every day."""
    return _rounded(kernels.coupling_z(recordings(spark, d), ["user_id"], "samples", SLOW, SPINDLE, RATE, mask=lambda key, n: np.arange(n) % 24 < 20))


def sos_bandpass(spark, d):
    return slow_hours(spark, d).select("user_id", F.col("i").cast("int").alias("i"), F.round("x", 4).alias("x"))


def hilbert_kernel(spark, d):
    got = kernels.analytic(recordings(spark, d), ["user_id"], "samples", *SLOW, RATE)
    return _rounded(got.select("user_id", F.posexplode(F.arrays_zip("phase", "envelope")).alias("i", "z")).select("user_id", "i", "z.phase", "z.envelope"), 4)


#: Days and channels (users by their last two digits) that the range scan asks for; hours of a record and of a part.
SCAN_DAYS, SCAN_CHANNELS, RECORD_HOURS, PART_HOURS = (3, 12), ("u07", "u42"), 24, 96


def _recorded(spark, d):
    """A folder of EDF recordings, one for each hundred users: their filled hours on one axis, an hour as a second, zeros where a user has none."""
    folder = scratch(spark, "recordings")
    hour = F.floor(F.col("t") / event_queries.HOUR)
    low, high = event_queries.table(spark, d).agg(F.min(hour), F.max(hour)).first()
    if low is None:
        return folder
    values = _knots(spark, d).groupBy("user_id").agg(ev.joined_up().alias("held"), F.min("low").alias("first"), F.max("high").alias("last"))
    zeros = lambda n: F.array_repeat(F.lit(0.0), n.cast("int"))
    dense = F.concat(zeros(F.col("first") - F.lit(low)), F.transform("held", lambda v: F.coalesce(v, F.lit(0.0))), zeros(F.lit(high) - F.col("last")))
    named = values.select(F.format_string("rec%06d", F.floor(F.col("user_id") / 100)).alias("recording"), F.format_string("u%02d", F.col("user_id") % 100).alias("channel"), dense.alias("samples"))
    ranges.write_edf(named, folder, 1.0, RECORD_HOURS, "V").count()
    return folder


def edf_range_scan(spark, d):
    """Some channels of recordings in some days, read by ranges: the sum of each part's samples and where it lies."""
    spark.dataSource.register(ranges.EdfRanges)
    asked = spark.read.format("edf_ranges").option("part_s", PART_HOURS).option("channels", ",".join(SCAN_CHANNELS)).option("from_s", SCAN_DAYS[0] * 24).option("to_s", SCAN_DAYS[1] * 24)
    got = asked.load(_recorded(spark, d)).withColumn("recording", F.regexp_extract("path", r"(rec\d+)", 1))
    return got.select("recording", "channel", F.col("start_s").cast("int").alias("start_h"), F.size("samples").alias("n"), F.round(F.aggregate("samples", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


def edf_channel_details(spark, d):
    """Rate, length and samples of each recording's channels, from headers alone."""
    spark.dataSource.register(ranges.EdfDetails)
    got = spark.read.format("edf_details").load(_recorded(spark, d))
    return got.select(F.regexp_extract("path", r"(rec\d+)", 1).alias("recording"), "channel", "sfreq", F.col("dur_s").cast("int").alias("dur_h"), "n_samples", "unit")


#: The line and its multiples that are taken out.
LINE = 5.0


def notched_signals(spark, d):
    """Signals without their line and without a comb of notches at ``LINE`` cycles a day, one after the other, zero phase."""
    own = blocks.blocks_of_knots(_knots(spark, d), ["user_id"], HOURS)
    for k, f in enumerate(np.arange(LINE, RATE / 2, LINE)):
        # a filter reads its blocks twice; the one before it shall run once
        own = blocks.filtered_blocks(written(own, "notched") if k else own, ["user_id"], dsp.notch(f, RATE), detrend=k == 0)
    return blocks.samples_of_blocks(own, ["user_id"]).select("user_id", F.col("i").cast("int").alias("i"), F.round("x", 4).alias("x"))


#: Hours of an epoch, the least share of them with a value, the slow band and the whole of its ratio, and the share of epochs that count as awake.
EPOCH_HOURS, OBSERVED, DELTA, DELTA_WHOLE, AWAKE = 48, 0.05, (0.5, 4.0), (0.5, 10.0), 0.55


def night_blocks(spark, d):
    """What a night is pulled in: epochs whose delta ratio is in the user's upper part, in runs of three at most.

    Gaps of an epoch are filled before its spectrum is taken; one with too few
    values has no ratio.
    """
    grid = ev.spread(_knots(spark, d), ["user_id"])
    epoch = F.floor((F.col("k") - F.min("k").over(Window.partitionBy("user_id"))) / EPOCH_HOURS)
    cut = grid.withColumn("epoch", epoch)
    enough = cut.groupBy("user_id", "epoch").agg(F.count("*").alias("n"), F.avg(F.col("v").isNotNull().cast("double")).alias("share")).where(f"n = {EPOCH_HOURS} and share >= {OBSERVED}")
    rows = cut.join(enough.select("user_id", "epoch"), ["user_id", "epoch"]).select("user_id", "epoch", "k", F.col("filled").alias("v"))
    powers = samples.welch(samples.numbered(rows, ["user_id", "epoch"]), ["user_id", "epoch"], 24, RATE)
    ratio = samples.band_shares(powers, ["user_id", "epoch"], {"ratio": DELTA}, DELTA_WHOLE)
    staged = rollup.with_percentile(ratio, ["user_id"], "ratio", AWAKE, "limit").select("user_id", F.col("epoch").alias("k"), (F.col("ratio") >= F.col("limit")).alias("nrem"))
    runs = ev.capped_runs(staged, ["user_id"], "nrem", 3)
    return runs.select("user_id", (F.col("first_k") * EPOCH_HOURS).alias("start_h"), (F.col("n") * EPOCH_HOURS).alias("dur_h"))


WELCH_BANDS, WELCH_WHOLE, WELCH_HOURS = {"slow": (0.5, 1.25), "delta": (0.5, 2.0), "spindle": (2.0, 4.0), "gamma": (6.0, 12.0)}, (0.5, 10.0), 192


def welch_kernel(spark, d):
    """Each band's share of the power, from stretches of eight days, each half over the next."""
    own = samples.numbered(hours(spark, d), ["user_id"], detrend=True).where("n >= 8")
    return _rounded(samples.band_shares(samples.welch(own, ["user_id"], WELCH_HOURS, RATE), ["user_id"], WELCH_BANDS, WELCH_WHOLE))


def peaks_kernel(spark, d):
    """Troughs of the slow band's z-score, a standard deviation deep or more and 0.6 days apart."""
    own = written(slow_hours(spark, d), "slow")
    z = samples.scored(own, ["user_id"], "x").withColumn("x", -F.col("x"))
    found = samples.apart(samples.local_maxima(z, ["user_id"], "i", "x", 1.0), ["user_id"], 0.6 * RATE)
    return found.select("user_id", F.col("at").cast("int").alias("at"), F.round("height", 6).alias("depth"))


def nesting_timecourse(spark, d):
    """Envelopes around slow troughs, summed over all signals, and their mean."""
    got = kernels.locked_envelopes(recordings(spark, d), ["user_id"], "samples", SLOW, {"spindle": SPINDLE, "ripple": RIPPLE}, RATE, 1.0)
    return got.groupBy("band", "offset").agg(F.round(F.sum("total") / F.sum("n"), 6).alias("mean_z"), F.sum("n").alias("n"))


def nesting_by_subject(spark, d):
    """Mean envelope in the first half day after a trough, of signals with five troughs or more."""
    got = kernels.locked_envelopes(recordings(spark, d), ["user_id"], "samples", SLOW, {"spindle": SPINDLE}, RATE, 1.0)
    up = got.groupBy("user_id").agg((F.sum(F.when(F.col("offset").between(0, 12), F.col("total"))) / F.sum(F.when(F.col("offset").between(0, 12), F.col("n")))).alias("up_z"), F.max("n").alias("n_events"))
    return _rounded(up.where("n_events >= 5"))


def ripple_triggered_z(spark, d):
    return _rounded(kernels.triggered_z(recordings(spark, d), ["user_id"], "samples", "marks", 0.5, 4.0, RATE, 12, least=5))


def event_hierarchy(spark, d):
    """Rayleigh statistics of the phases at faster events, by leg and signal."""
    got = kernels.event_hierarchy(recordings(spark, d), ["user_id"], "samples", SLOW, SPINDLE, RIPPLE, RATE)
    return _rounded(ev.rayleigh(got, ["user_id", "leg"]))


#: Forty frequencies, on a logarithmic scale from one cycle a day to below half the rate.
FREQUENCIES = [float(f) for f in np.round(np.geomspace(1, 11, 40), 4)]


def time_frequency_map(spark, d):
    got = kernels.time_frequency(recordings(spark, d), ["user_id"], "samples", "marks", FREQUENCIES, RATE, 12)
    mean = got.groupBy("freq", "offset").agg((F.sum("total") / F.sum("n")).alias("m"), F.sum("n").alias("n"))
    w = Window.partitionBy("freq")
    return mean.select("freq", "offset", F.round((F.col("m") - F.avg("m").over(w)) / (F.stddev_pop("m").over(w) + 1e-12), 6).alias("z"), "n")


def _taps(down: int) -> list[float]:
    """The anti-alias filter of resampling: Kaiser window, beta 5."""
    return dsp.lowpass_taps(20 * down + 1, 1.0 / down, np.kaiser(20 * down + 1, 5.0)).tolist()


def _decimating_taps(factor: int) -> list[float]:
    """That of decimation: Hamming window."""
    return dsp.lowpass_taps(20 * factor + 1, 1.0 / factor, np.hamming(20 * factor + 1)).tolist()


def _resampled(spark, d, down, taps):
    own = samples.numbered(hours(spark, d), ["user_id"]).where("n >= 8")
    return samples.resampled(own, ["user_id"], 1, down, taps).select("user_id", F.col("i").cast("int").alias("i"), F.round("v", 5).alias("x"))


def resampled_signals(spark, d):
    """Every fourth hour, through the filter of polyphase resampling."""
    return _resampled(spark, d, 4, _taps(4))


def decimated_signals(spark, d):
    """Every other hour, through the filter of decimation."""
    return _resampled(spark, d, 2, _decimating_taps(2))


def long_traces(spark, d):
    got = kernels.long_trace(recordings(spark, d), ["user_id"], "samples", RATE, 12.0, 20.0)
    return _rounded(got.select("user_id", F.posexplode("samples").alias("i", "x")))


#: Half a window in hours, points a day of the common axis, distance of troughs in days, rows of a heat map, days and points a day of a long trace, half an example in days.
QC_HALF, QC_TARGET, QC_DISTANCE, QC_ROWS, QC_DAYS, QC_LONG, QC_EXAMPLE = 24, 10.0, 0.6, 40, 40.0, 10.0, 4.0


def _clips(spark, d):
    """Users as clips: ten subjects with five channels and as many clips as there are, cleaned."""
    own = recordings(spark, d).select((F.col("user_id") % 10).alias("subject"), F.floor(F.col("user_id") / 50).alias("clip"), (F.floor(F.col("user_id") / 10) % 5).alias("channel"), "samples")
    return quality.cleaned(own, RATE, LINE)


def _bands(clips):
    return quality.banded(clips, RATE, SLOW, SPINDLE, 0.75, QC_DISTANCE)


def qc_averages(spark, d):
    """A subject's mean windows around slow troughs, on a common axis."""
    rows = _bands(_clips(spark, d))
    return _rounded(quality.epoch_averages(quality.event_epochs(rows, quality.inside(QC_HALF), RATE, QC_HALF, QC_TARGET)))


def qc_heat_rows(spark, d):
    """At most ``QC_ROWS`` of a subject's windows, later events in the place of the first slots."""
    rows = written(_bands(_clips(spark, d)).select(*quality.TRACE, "n", "so", "troughs"), "qc")
    found = quality.trough_events(rows, QC_HALF)
    places = quality.kept_events(found, QC_ROWS).groupBy(*quality.TRACE).agg(F.collect_list(F.struct("at", "nth")).alias("places"))
    epochs = quality.event_epochs(rows.join(places, quality.TRACE), F.col("places"), RATE, QC_HALF, QC_TARGET, ("so",))
    return _rounded(quality.heat_rows(found, epochs, QC_ROWS), 5)


def qc_summary(spark, d):
    """Counts and seconds of each subject, and the clip that serves as its example."""
    clips = _clips(spark, d)
    rows = _bands(clips)
    return _rounded(quality.summary(clips, rows, RATE, QC_HALF).join(quality.example_windows(rows, QC_HALF, RATE, QC_EXAMPLE), "subject"))


def qc_long_traces(spark, d):
    """Each subject's channel with most hours, its clips one after the other up to ``QC_DAYS`` days."""
    return _rounded(quality.long_traces(_clips(spark, d), RATE, SLOW, SPINDLE, QC_DAYS, QC_LONG))


def bootstrap_ci(spark, d):
    """Mean of the nations' means and its interval, by region and state."""
    o = relational_queries._orders(spark, d).groupBy("r_name", "o_orderstatus", "n_name").agg(F.avg("o_totalprice").alias("v"))
    return _rounded(inference.bootstrap(o, ["r_name", "o_orderstatus"], ["n_name"], "v"), 4)


def wilcoxon_p(spark, d):
    """Signed-rank test of the nations' means between two states, by region."""
    o = relational_queries._orders(spark, d)
    pairs = rollup.paired_states(o, ["r_name", "n_name"], "o_orderstatus", "o_totalprice", ["O", "F"])
    return _rounded(inference.signed_rank_test(pairs.withColumn("difference", F.round(F.col("O") - F.col("F"), 6)), ["r_name"], "difference"), 9)


def one_sample_wilcoxon(spark, d):
    """Whether the nations' mean totals lie around that of all nations, by state."""
    o = relational_queries._orders(spark, d).groupBy("o_orderstatus", "n_name").agg(F.avg("o_totalprice").alias("v"))
    middle = o.groupBy("o_orderstatus").agg(F.median("v").alias("m"))
    return _rounded(inference.signed_rank_test(o.join(middle, "o_orderstatus").withColumn("difference", F.round(F.col("v") - F.col("m") - 1, 6)), ["o_orderstatus"], "difference"), 9)


def spearman_p(spark, d):
    r = rollup.spearman(relational_queries.t(spark, d, "customer"), ["c_mktsegment"], "c_acctbal", "c_nationkey")
    return _rounded(r.withColumn("p", kernels.spearman_p("rho", "n")), 8)


def region_profile(spark, d):
    """Rank-sum tests of each pair of regions on the customers' mean totals."""
    v = relational_queries._orders(spark, d).groupBy("r_name", "o_custkey").agg(F.avg("o_totalprice").alias("v"))
    u = rollup.rank_sum(v, [], "r_name", "v")
    return _rounded(u.withColumn("p", inference.rank_sum_p(F.col("u").cast("double"), F.col("n_a"), F.col("n_b"), F.col("ties"))).withColumn("u", F.col("u").cast("double")).drop("ties"), 9)


QUERIES = {f.__name__: f for f in (
    edf_range_scan, edf_channel_details, qc_averages, qc_heat_rows, qc_summary, qc_long_traces, notched_signals, night_blocks, pac_surrogate_z, pac_masked, sos_bandpass, hilbert_kernel, welch_kernel, peaks_kernel, nesting_timecourse, nesting_by_subject, ripple_triggered_z, event_hierarchy, time_frequency_map, resampled_signals, decimated_signals,
    long_traces, bootstrap_ci, wilcoxon_p, one_sample_wilcoxon, spearman_p, region_profile,
)}


def _recursion(name: str, source: str, sections: np.ndarray) -> str:
    """A recursive CTE that runs second-order sections over ``source`` (user_id, t, x), from the steady state of its first sample."""
    first, step, columns, x, scale = [], [], [], "q.x", 1.0
    for k, (b0, b1, b2, _, a1, a2) in enumerate(sections.tolist(), 1):
        level = (b0 + b1 + b2) / (1 + a1 + a2)
        first += ["0.0::DOUBLE", f"{(level - b0) * scale!r}::DOUBLE * x", f"{(b2 - a2 * level) * scale!r}::DOUBLE * x"]
        step += [f"{b0!r}::DOUBLE * {x} + f.z{k}1 AS o{k}", f"{b1!r}::DOUBLE * {x} - {a1!r}::DOUBLE * o{k} + f.z{k}2", f"{b2!r}::DOUBLE * {x} - {a2!r}::DOUBLE * o{k}"]
        columns += [f"y{k}", f"z{k}1", f"z{k}2"]
        x, scale = f"o{k}", scale * level
    return f"""{name}(user_id, t, {", ".join(columns)}) AS (SELECT user_id, 0::BIGINT, {", ".join(first)} FROM {source} WHERE t = 1
        UNION ALL SELECT f.user_id, f.t + 1, {", ".join(step)} FROM {name} f JOIN {source} q ON q.user_id = f.user_id AND q.t = f.t + 1)"""


def _filtered(tag: str, source: str, sections: np.ndarray) -> str:
    """CTEs; the last, ``tag``, has user_id, i, n, x of ``source`` (the same columns) filtered there and back, both ends extended."""
    last = f"y{len(sections)}"
    return f"""{tag}_e AS (SELECT user_id, min_by(x, i) AS head, max_by(x, i) AS tail, least({dsp.edge_of(sections)}, any_value(n) - 1) AS edge FROM {source} GROUP BY 1),
        {tag}_x AS (SELECT user_id, i AS p, x FROM {source} UNION ALL SELECT user_id, -i, 2 * head - x FROM {source} JOIN {tag}_e USING (user_id) WHERE i BETWEEN 1 AND edge
            UNION ALL SELECT user_id, 2 * (n - 1) - i, 2 * tail - x FROM {source} JOIN {tag}_e USING (user_id) WHERE i BETWEEN n - 1 - edge AND n - 2),
        {tag}_q1 AS MATERIALIZED (SELECT user_id, p, row_number() OVER (PARTITION BY user_id ORDER BY p) AS t, x FROM {tag}_x), {_recursion(f"{tag}_f1", f"{tag}_q1", sections)},
        {tag}_q2 AS MATERIALIZED (SELECT f.user_id, q.p, row_number() OVER (PARTITION BY f.user_id ORDER BY f.t DESC) AS t, f.{last} AS x FROM {tag}_f1 f JOIN {tag}_q1 q USING (user_id, t)), {_recursion(f"{tag}_f2", f"{tag}_q2", sections)},
        {tag} AS MATERIALIZED (SELECT s.user_id, s.i, s.n, f.{last} AS x FROM {tag}_f2 f JOIN {tag}_q2 q USING (user_id, t) JOIN {source} s ON s.user_id = f.user_id AND s.i = q.p)"""


def _band(tag: str, band: tuple[float, float], source: str = "x") -> str:
    return _filtered(tag, source, dsp.butter_bandpass(*band, RATE))


_S = f"""WITH RECURSIVE {event_queries._I}, s AS (SELECT user_id, k - min(k) OVER (PARTITION BY user_id) AS i, filled AS v, count(*) OVER (PARTITION BY user_id) AS n FROM i),
    line AS (SELECT user_id, regr_slope(v, i) AS b, regr_intercept(v, i) AS a FROM s WHERE n >= 8 GROUP BY 1 HAVING min(v) < max(v)),
    x AS (SELECT user_id, i, n, v, v - a - b * i AS x FROM s JOIN line USING (user_id))"""
def _analytic(tag: str, source: str) -> str:
    """CTEs; ``tag`` has user_id, i, phase, envelope of ``source``'s analytic signal, by the discrete Fourier transform."""
    return f"""{tag}_c AS MATERIALIZED (SELECT user_id, n, k, sum(x * cos(2 * pi() * ((k * i) % n) / n)) AS re, -sum(x * sin(2 * pi() * ((k * i) % n) / n)) AS im
            FROM (SELECT *, unnest(range(1, (n + 1) // 2)) AS k FROM {source}) GROUP BY 1, 2, 3),
        {tag}_h AS (SELECT c.user_id, t.i, sum(c.re * sin(2 * pi() * ((k * t.i) % c.n) / c.n) + c.im * cos(2 * pi() * ((k * t.i) % c.n) / c.n)) * 2 / any_value(c.n) AS h
            FROM {tag}_c c JOIN {source} t USING (user_id) GROUP BY 1, 2),
        {tag} AS MATERIALIZED (SELECT user_id, i, atan2(h, x) AS phase, sqrt(x * x + h * h) AS envelope FROM {tag}_h JOIN {source} USING (user_id, i))"""


def _coupling(mask: str) -> str:
    """Modulation index, its z among 120 hashed shifts and the preferred phase, over hours that ``mask`` lets through."""
    mi = f"({math.log(dsp.BINS)!r} + sum(greatest(m / tot, 1e-12) * ln(greatest(m / tot, 1e-12)))) / {math.log(dsp.BINS)!r}"
    width = 2 * math.pi / dsp.BINS
    return f"""{_S}, {_band("slow", SLOW)}, {_band("fast", SPINDLE)}, {_analytic("pa", "slow")}, {_analytic("aa", "fast")},
        used AS (SELECT user_id, least({dsp.BINS - 1}, floor((pa.phase + pi()) / {width!r}))::INT AS bin, aa.envelope AS a, row_number() OVER (PARTITION BY user_id ORDER BY i) - 1 AS p, count(*) OVER (PARTITION BY user_id) AS m FROM pa JOIN aa USING (user_id, i) WHERE {mask}),
        lists AS MATERIALIZED (SELECT user_id, m, list(a ORDER BY p) AS amps, list(bin ORDER BY p) AS bins FROM used GROUP BY 1, 2 HAVING m >= {5 * RATE}),
        drawn AS (SELECT *, CASE WHEN j < 0 THEN 0 ELSE lo + floor((('0x' || substr(md5(user_id || '|' || j), 1, 8))::BIGINT + 0.5) / 4294967296.0 * (greatest(floor(0.9 * m)::BIGINT, lo + 1) - lo))::BIGINT END AS shift
            FROM (SELECT *, floor(0.1 * m)::BIGINT AS lo, unnest(range(-1, 120)) AS j FROM lists)),
        turned AS (SELECT user_id, j, bins[p + 1] AS bin, amps[(p - shift + m) % m + 1] AS a FROM (SELECT *, unnest(range(0, m)) AS p FROM drawn)),
        sums AS (SELECT user_id, j, bin, avg(a) AS m FROM turned GROUP BY 1, 2, 3),
        whole AS (SELECT u.user_id, u.j, b.bin, coalesce(s.m, 0) AS m FROM (SELECT DISTINCT user_id, j FROM sums) u CROSS JOIN (SELECT unnest(range({dsp.BINS})) AS bin) b LEFT JOIN sums s USING (user_id, j, bin)),
        mis AS (SELECT user_id, j, {mi} AS mi, arg_max(bin, (m, -bin)) AS best FROM (SELECT *, sum(m) OVER (PARTITION BY user_id, j) AS tot FROM whole) GROUP BY 1, 2),
        z AS (SELECT user_id, avg(mi) FILTER (j >= 0) AS mean, stddev_pop(mi) FILTER (j >= 0) AS sd FROM mis GROUP BY 1)
        SELECT user_id, round(mi, 6) AS mi, round((mi - mean) / (sd + 1e-12), 6) AS mi_z, round(-pi() + (best + 0.5) * {width!r}, 6) AS pref_phase FROM mis JOIN z USING (user_id) WHERE j = -1"""


def _z(tag: str, source: str, value: str, sign: str = "") -> str:
    """A CTE ``tag``: user_id, i, z of a value's score in its signal."""
    return f"{tag} AS MATERIALIZED (SELECT user_id, i, {sign}({value} - avg({value}) OVER (PARTITION BY user_id)) / (stddev_pop({value}) OVER (PARTITION BY user_id) + 1e-12) AS z FROM {source})"


def _peaks(tag: str, source: str, height: float, gap: int) -> str:
    """CTEs; ``tag`` has user_id, i, z of the peaks of ``source`` that stay ``gap`` apart, the highest first."""
    return f"""{tag}_t AS (SELECT user_id, list({{'z': z, 'place': i}}) AS c FROM (SELECT *, lag(z) OVER w AS a, lead(z) OVER w AS b FROM {source} WINDOW w AS (PARTITION BY user_id ORDER BY i)) WHERE z > a AND z > b AND z >= {height} GROUP BY 1),
        {tag}_p(user_id, top, c) AS (SELECT user_id, list_max(c), c FROM {tag}_t UNION ALL
            SELECT user_id, list_max(rest), rest FROM (SELECT user_id, list_filter(c, lambda e: abs(e.place - top.place) >= {gap}) AS rest FROM {tag}_p) WHERE len(rest) > 0),
        {tag} AS MATERIALIZED (SELECT user_id, top.place AS i, top.z AS z FROM {tag}_p)"""


#: Slow troughs, the windows of 24 hours to both sides that lie inside, and the score of a band's envelope in them.
_TROUGHS = f"{_S}, {_band('y', SLOW)}, {_z('yz', 'y', 'x', '-')}, {_peaks('troughs', 'yz', 1.0, 15)}, sizes AS (SELECT DISTINCT user_id, n FROM x), inside AS (SELECT user_id, i AS e FROM troughs JOIN sizes USING (user_id) WHERE i > 24 AND i < n - 24)"


def _envelope(tag: str, band: tuple[float, float]) -> str:
    return f"{_band(f'{tag}_b', band)}, {_analytic(f'{tag}_a', f'{tag}_b')}, {_z(tag, f'{tag}_a', 'envelope')}"


def _locked(tag: str) -> str:
    return f"SELECT user_id, '{tag}' AS band, ({tag}.i - e)::INT AS \"offset\", z FROM inside JOIN {tag} USING (user_id) WHERE {tag}.i - e BETWEEN -24 AND 23"


_HALF, _LEAST, _SURROGATES = 12, 5, 200
_TRIGGERED = f"""{_S}, {_band("w", (0.5, 4.0))}, marks AS (SELECT user_id, floor(t / 3600)::BIGINT - k0 AS mark FROM e JOIN (SELECT user_id, min(k) AS k0 FROM i GROUP BY 1) USING (user_id) WHERE event_type = 'purchase'),
        enough AS (SELECT user_id FROM marks GROUP BY 1 HAVING count(*) >= {_LEAST}), sizes AS (SELECT DISTINCT user_id, n FROM x),
        valid AS (SELECT user_id, mark, n FROM marks JOIN enough USING (user_id) JOIN sizes USING (user_id) WHERE mark >= {_HALF} AND mark < n - {_HALF}),
        counts AS (SELECT user_id, any_value(n) AS n, count(*) AS m FROM valid GROUP BY 1 HAVING count(*) >= {_LEAST}),
        ids AS (SELECT user_id, n, m, unnest(range({_SURROGATES} * m)) AS id FROM counts),
        drawn AS (SELECT user_id, id // m AS s, {_HALF} + floor((('0x' || substr(md5(user_id || '|' || (id // 4)), 1 + 8 * (id % 4), 8))::BIGINT + 0.5) / 4294967296.0 * (n - 2 * {_HALF}))::BIGINT AS mark FROM ids),
        picked AS (SELECT user_id, -1 AS s, mark FROM valid JOIN counts USING (user_id) UNION ALL SELECT * FROM drawn),
        cut AS (SELECT p.user_id, s, o, avg(w.x) AS m FROM picked p, range(-{_HALF}, {_HALF}) r(o), w WHERE w.user_id = p.user_id AND w.i = p.mark + o GROUP BY 1, 2, 3),
        heights AS (SELECT user_id, s, max(m) - min(m) AS h FROM cut GROUP BY 1, 2)
        SELECT user_id, round((any_value(h) FILTER (s < 0) - avg(h) FILTER (s >= 0)) / (stddev_pop(h) FILTER (s >= 0) + 1e-12), 6) AS z, any_value(m)::INT AS n_events FROM heights JOIN counts USING (user_id) GROUP BY 1"""
_HIERARCHY = f"""{_S}, {_band("y", SLOW)}, {_analytic("slow", "y")}, {_envelope("spindle", SPINDLE)}, {_envelope("ripple", RIPPLE)}, {_peaks("sp", "spindle", 1.5, 8)}, {_peaks("rp", "ripple", 2.0, 1)},
        phases AS (SELECT user_id, 'slow_spindle' AS leg, phase FROM sp JOIN slow USING (user_id, i) UNION ALL SELECT rp.user_id, 'spindle_ripple', phase FROM rp JOIN spindle s ON s.user_id = rp.user_id AND s.i = rp.i AND s.z > 1 JOIN spindle_a a ON a.user_id = rp.user_id AND a.i = rp.i),
        sums AS (SELECT user_id, leg, count(*) AS n, sqrt(pow(sum(cos(phase)), 2) + pow(sum(sin(phase)), 2)) / count(*) AS mrl, atan2(sum(sin(phase)), sum(cos(phase))) AS pref FROM phases GROUP BY 1, 2 HAVING count(*) >= 5)
        SELECT user_id, leg, n, round(mrl, 6) AS mrl, round(pref, 6) AS pref_phase, round(greatest(0.0, least(1.0, exp(-n * mrl * mrl) * (1 + (2 * n * mrl * mrl - pow(n * mrl * mrl, 2)) / (4 * n)))), 6) AS rayleigh_p FROM sums"""
_SLOW = f"{_S}, {_band('y', SLOW)}"
_ROLES = "user_id % 10 AS subject, user_id // 50 AS clip, user_id // 10 % 5 AS channel"
_QC = f"""{_S}, {_filtered("clean", "x", dsp.notch(LINE, RATE))}, {_band("so", SLOW, "clean")}, {_band("fast", SPINDLE, "clean")}, {_analytic("aa", "fast")}, {_z("sp", "aa", "envelope")},
    bands AS MATERIALIZED (SELECT c.user_id, c.i, c.n, c.x AS raw, so.x AS so, sp.z AS sp_z FROM clean c JOIN so USING (user_id, i) JOIN sp USING (user_id, i)),
    deep AS (SELECT user_id, i, -so / stddev_pop(so) OVER (PARTITION BY user_id) AS z FROM bands), {_peaks("troughs", "deep", 0.75, int(QC_DISTANCE * RATE))},
    found AS MATERIALIZED (SELECT {_ROLES}, user_id, t.i AS place, n, row_number() OVER (PARTITION BY user_id % 10 ORDER BY user_id // 50, user_id // 10 % 5, t.i) AS nth, count(*) OVER (PARTITION BY user_id) AS many
        FROM troughs t JOIN (SELECT DISTINCT user_id, n FROM bands) USING (user_id) WHERE t.i > {QC_HALF} AND t.i < n - {QC_HALF}),
    asked AS (SELECT subject, user_id, nth, j::INT AS j, place - {QC_HALF} + least(j * {RATE} / {QC_TARGET}, {2 * QC_HALF - 1}) AS p FROM found, range(0, {round(2 * QC_HALF / RATE * QC_TARGET)}) r(j)),
    epochs AS MATERIALIZED (SELECT subject, user_id, nth, j, a.raw + (b.raw - a.raw) * (p - floor(p)) AS raw, a.so + (b.so - a.so) * (p - floor(p)) AS so, a.sp_z + (b.sp_z - a.sp_z) * (p - floor(p)) AS sp_z
        FROM asked JOIN bands a USING (user_id) JOIN bands b USING (user_id) WHERE a.i = floor(p) AND b.i = ceil(p))"""
_AREA = "coalesce(sum(p) FILTER (hz >= {0} AND hz < {1}) - (arg_min(p, hz) FILTER (hz >= {0} AND hz < {1}) + arg_max(p, hz) FILTER (hz >= {0} AND hz < {1})) / 2, 0)"


def _welch(source: str, keys: str, size: int) -> str:
    """CTEs; the last, ``powers``, has the keys, hz and p of ``source`` (keys, i, n, x): Hann windows, each half over the next."""
    return f"""p AS (SELECT *, least({size}, n) AS size, least({size}, n) - least({size}, n) // 2 AS step FROM {source}),
        cut AS (SELECT {keys}, seg, size, i - seg * step AS place, x FROM (SELECT *, unnest(range(greatest(0, (i - size + step) // step), least(i // step, (n - size) // step) + 1)) AS seg FROM p)),
        tapered AS (SELECT {keys}, seg, size, place, (x - avg(x) OVER (PARTITION BY {keys}, seg)) * (0.5 - 0.5 * cos(2 * pi() * place / size)) AS x, sum(pow(0.5 - 0.5 * cos(2 * pi() * place / size), 2)) OVER (PARTITION BY {keys}, seg) AS mass FROM cut),
        parts AS (SELECT {keys}, seg, size, f, (pow(sum(x * cos(2 * pi() * ((f * place) % size) / size)), 2) + pow(sum(x * sin(2 * pi() * ((f * place) % size) / size)), 2)) / ({RATE} * any_value(mass)) * CASE WHEN f = 0 OR 2 * f = size THEN 1 ELSE 2 END AS p
            FROM tapered, range(0, {size // 2 + 1}) fs(f) WHERE 2 * f <= size GROUP BY {keys}, seg, size, f),
        powers AS (SELECT {keys}, f * {RATE} / size AS hz, avg(p) AS p FROM parts GROUP BY {keys}, f, size)"""


def _fir(down: int, taps: list[float]) -> str:
    half = (len(taps) - 1) // 2
    return f"""{_S}, taps AS (SELECT unnest(range({len(taps)})) AS m, unnest({taps!r}) AS h)
        SELECT user_id, ((i + m - {half}) // {down})::INT AS i, round(sum(v * h), 5) AS x FROM x, taps WHERE (i + m - {half}) % {down} = 0 AND i + m >= {half} AND i + m - {half} < n GROUP BY 1, 2"""


_AXIS = f"""WITH {event_queries._I}, ends AS (SELECT min(k) AS lo, max(k) AS hi FROM i), users AS (SELECT DISTINCT user_id, 'rec' || lpad((user_id // 100)::VARCHAR, 6, '0') AS recording, 'u' || lpad((user_id % 100)::VARCHAR, 2, '0') AS channel FROM i),
    records AS (SELECT lo, (hi - lo) // {RECORD_HOURS} + 1 AS n FROM ends)"""
ORACLES = {
    "edf_range_scan": f"""{_AXIS}, hours AS (SELECT recording, channel, user_id, h, lo + h AS k FROM users, (SELECT lo, unnest(range({SCAN_DAYS[0] * 24}, least({SCAN_DAYS[1] * 24}, n * {RECORD_HOURS}))) AS h FROM records) WHERE channel IN {SCAN_CHANNELS}),
        held AS (SELECT recording, channel, greatest(h // {PART_HOURS} * {PART_HOURS}, {SCAN_DAYS[0] * 24})::INT AS start_h, (floor((greatest(-1000, least(1000, coalesce(filled, 0))) + 1000) * (65535 / 2000) - 32768 + 0.5) + 32768) * (2000 / 65535) - 1000 AS x FROM hours LEFT JOIN i USING (user_id, k))
        SELECT recording, channel, start_h, count(*)::INT AS n, round(sum(x), 5) AS total FROM held GROUP BY 1, 2, 3""",
    "edf_channel_details": f"{_AXIS} SELECT recording, channel, 1.0::DOUBLE AS sfreq, (n * {RECORD_HOURS})::INT AS dur_h, n * {RECORD_HOURS} AS n_samples, 'V' AS unit FROM users, records",
    "qc_averages": f"{_QC} SELECT subject, j, round(avg(raw), 6) AS raw, round(avg(so), 6) AS so, round(avg(sp_z), 6) AS sp_z, count(*) AS n_events FROM epochs GROUP BY 1, 2",
    "qc_heat_rows": f"""{_QC}, slots AS (SELECT subject, CASE WHEN nth <= {QC_ROWS} THEN nth - 1 WHEN nth % {QC_ROWS} < {QC_ROWS // quality.REPLACED} THEN nth % {QC_ROWS} END AS slot, max(nth) AS nth FROM found GROUP BY 1, 2 HAVING slot IS NOT NULL),
        own AS (SELECT subject, slot, j, so, so - median(so) OVER (PARTITION BY subject, slot) AS away FROM epochs JOIN slots USING (subject, nth)),
        scaled AS (SELECT *, 1.4826 * median(abs(away)) OVER (PARTITION BY subject, slot) AS mad, stddev_pop(so) OVER (PARTITION BY subject, slot) AS sd FROM own)
        SELECT subject, slot::INT AS slot, j, round(away / (CASE WHEN mad > 0 THEN mad ELSE sd END + 1e-12), 5) AS z FROM scaled""",
    "qc_summary": f"""{_QC}, traces AS (SELECT {_ROLES}, user_id, any_value(n) AS n, quantile_cont(abs(so), 0.95) + 0.2 * quantile_cont(sp_z, 0.95) AS score FROM bands GROUP BY user_id),
        totals AS (SELECT subject, count(DISTINCT clip) AS n_clips, count(DISTINCT channel) AS n_channels, count(*) AS n_traces, round(sum(n / {RATE}), 6) AS duration_s FROM traces GROUP BY 1),
        numbers AS (SELECT subject, count(*) AS n_events FROM found GROUP BY 1),
        middle AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY place) - 1 = many // 2),
        best AS (SELECT m.subject, m.clip, m.channel, greatest(0, m.place - {int(QC_EXAMPLE * RATE)}) AS low, least(m.n, m.place + {int(QC_EXAMPLE * RATE)}) AS high FROM middle m JOIN traces t USING (user_id) QUALIFY row_number() OVER (PARTITION BY m.subject ORDER BY t.score DESC, m.clip, m.channel) = 1)
        SELECT * FROM totals JOIN numbers USING (subject) JOIN best USING (subject)""",
    "qc_long_traces": f"""{_S}, {_filtered("clean", "x", dsp.notch(LINE, RATE))}, sizes AS (SELECT {_ROLES}, user_id, any_value(n) / {RATE} AS dur FROM clean GROUP BY user_id),
        best AS (SELECT subject, channel FROM sizes GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY subject ORDER BY sum(dur) DESC, count(*) DESC, channel DESC) = 1),
        used AS (SELECT *, least(dur, {QC_DAYS} - (sum(dur) OVER (PARTITION BY subject ORDER BY clip) - dur)) AS take FROM sizes JOIN best USING (subject, channel)),
        short AS (SELECT c.user_id, c.i, greatest(2, trunc(take * {RATE}))::BIGINT AS n, c.x FROM clean c JOIN used USING (user_id) WHERE take > 0 AND c.i < greatest(2, trunc(take * {RATE}))), {_band("so", SLOW, "short")}, {_band("fast", SPINDLE, "short")}, {_analytic("aa", "fast")}, {_z("sp", "aa", "envelope")},
        bands AS MATERIALIZED (SELECT c.user_id, c.i, c.n, c.x AS raw, so.x AS so, sp.z AS sp_z FROM short c JOIN so USING (user_id, i) JOIN sp USING (user_id, i)),
        asked AS (SELECT *, unnest(range(0, points)) AS j FROM (SELECT *, greatest(2, round_even(take * {QC_LONG}, 0))::BIGINT AS points FROM used WHERE take > 0)),
        placed AS (SELECT a.*, least(j * take / points * {RATE}, n - 1.0) AS p FROM asked a JOIN (SELECT DISTINCT user_id, n FROM short) USING (user_id))
        SELECT subject, clip, channel, j::INT AS j, round(a.raw + (b.raw - a.raw) * (p - floor(p)), 6) AS raw, round(a.so + (b.so - a.so) * (p - floor(p)), 6) AS so, round(a.sp_z + (b.sp_z - a.sp_z) * (p - floor(p)), 6) AS sp_z
        FROM placed JOIN bands a USING (user_id) JOIN bands b USING (user_id) WHERE a.i = floor(p) AND b.i = ceil(p)""",
    "pac_surrogate_z": _coupling("true"),
    "pac_masked": _coupling("i % 24 < 20"),
    "hilbert_kernel": f"{_SLOW}, {_analytic('a', 'y')} SELECT user_id, i::INT AS i, round(phase, 4) AS phase, round(envelope, 4) AS envelope FROM a",
    "sos_bandpass": f"{_SLOW} SELECT user_id, i::INT AS i, round(x, 4) AS x FROM y",
    "peaks_kernel": f"""{_SLOW}, {_z("yz", "y", "x", "-")}, {_peaks("troughs", "yz", 1.0, 15)} SELECT user_id, i::INT AS "at", round(z, 6) AS depth FROM troughs""",
    "nesting_timecourse": f"""{_TROUGHS}, {_envelope("spindle", SPINDLE)}, {_envelope("ripple", RIPPLE)}, each AS ({_locked("spindle")} UNION ALL {_locked("ripple")}) SELECT band, "offset", round(avg(z), 6) AS mean_z, count(*) AS n FROM each GROUP BY 1, 2""",
    "nesting_by_subject": f"""{_TROUGHS}, {_envelope("spindle", SPINDLE)}, each AS ({_locked("spindle")}) SELECT user_id, round(avg(z) FILTER ("offset" BETWEEN 0 AND 12), 6) AS up_z, count(*) // 48 AS n_events FROM each GROUP BY 1 HAVING count(*) // 48 >= 5""",
    # the tail of the t distribution as a ratio of two integrals of a power of the cosine, by Simpson's rule
    "spearman_p": """WITH r AS (SELECT c_mktsegment, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_mktsegment, c_acctbal) - 1) / 2 AS ra,
            rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) - 1) / 2 AS rb FROM customer),
        c AS (SELECT c_mktsegment, corr(ra, rb) AS rho, count(*) AS n FROM r GROUP BY 1),
        w AS (SELECT k, CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END AS w FROM range(0, 4001) t(k)),
        areas AS (SELECT c_mktsegment, rho, n, sum(w * pow(cos(asin(abs(rho)) + k * (pi() / 2 - asin(abs(rho))) / 4000), n - 3)) * (pi() / 2 - asin(abs(rho))) AS tail, sum(w * pow(cos(k * pi() / 2 / 4000), n - 3)) * pi() / 2 AS whole FROM c, w GROUP BY 1, 2, 3)
        SELECT c_mktsegment, round(rho, 8) AS rho, n, round(tail / whole, 8) AS p FROM areas""",
    "ripple_triggered_z": _TRIGGERED,
    "event_hierarchy": _HIERARCHY,
    "long_traces": f"""{_S}, asked AS (SELECT user_id, n, unnest(range(0, ceil(least(n / {RATE}, 20.0) * 12)::BIGINT)) AS j FROM x WHERE i = 0),
        placed AS (SELECT user_id, j, least(j * {RATE} / 12, n - 1) AS p FROM asked)
        SELECT user_id, j::INT AS i, round(a.x + (b.x - a.x) * (p - floor(p)), 6) AS x FROM placed JOIN x a USING (user_id) JOIN x b USING (user_id) WHERE a.i = floor(p) AND b.i = ceil(p)""",
    "welch_kernel": f"""{_S}, {_welch("x", "user_id", WELCH_HOURS)}, areas AS (SELECT user_id, {_AREA.format(*WELCH_WHOLE)} AS whole, {", ".join(f"{_AREA.format(*b)} AS {name}" for name, b in WELCH_BANDS.items())} FROM powers GROUP BY 1)
        SELECT user_id, {", ".join(f"round({name} / whole, 6) AS {name}" for name in WELCH_BANDS)} FROM areas WHERE whole > 0""",
    "notched_signals": f"""{_S}, {", ".join(_filtered(f"n{k}", f"n{k - 1}" if k else "x", dsp.notch(f, RATE)) for k, f in enumerate(np.arange(LINE, RATE / 2, LINE)))}
        SELECT user_id, i::INT AS i, round(x, 4) AS x FROM n{len(np.arange(LINE, RATE / 2, LINE)) - 1}""",
    "night_blocks": f"""WITH {event_queries._I}, c AS (SELECT i.user_id, i.k, i.filled AS x, g.v IS NOT NULL AS seen, (i.k - min(i.k) OVER (PARTITION BY i.user_id)) // {EPOCH_HOURS} AS epoch FROM i JOIN g USING (user_id, k)),
        ok AS (SELECT user_id, epoch FROM c GROUP BY 1, 2 HAVING count(*) = {EPOCH_HOURS} AND avg(seen::INT) >= {OBSERVED} AND min(x) < max(x)),
        x AS (SELECT user_id, epoch, k - min(k) OVER (PARTITION BY user_id, epoch) AS i, {EPOCH_HOURS} AS n, x FROM c JOIN ok USING (user_id, epoch)), {_welch("x", "user_id, epoch", 24)},
        ratios AS (SELECT user_id, epoch, {_AREA.format(*DELTA)} / {_AREA.format(*DELTA_WHOLE)} AS ratio FROM powers GROUP BY 1, 2),
        nrem AS (SELECT user_id, epoch FROM ratios QUALIFY ratio >= quantile_cont(ratio, {AWAKE}) OVER (PARTITION BY user_id)),
        runs AS (SELECT user_id, epoch, epoch - row_number() OVER (PARTITION BY user_id ORDER BY epoch) AS r FROM nrem),
        pieces AS (SELECT *, (row_number() OVER (PARTITION BY user_id, r ORDER BY epoch) - 1) // 3 AS p FROM runs)
        SELECT user_id, min(epoch) * {EPOCH_HOURS} AS start_h, count(*) * {EPOCH_HOURS} AS dur_h FROM pieces GROUP BY user_id, r, p""",
    "bootstrap_ci": f"""WITH {relational_queries._O}, means AS (SELECT r_name, o_orderstatus, n_name, avg(o_totalprice) AS v FROM o GROUP BY 1, 2, 3), {sql.bootstrap("means", ["r_name", "o_orderstatus"], ["n_name"], "v")}
        SELECT r_name, o_orderstatus, round(mean, 4) AS mean, round(ci_lo, 4) AS ci_lo, round(ci_hi, 4) AS ci_hi, n FROM ci""",
    "wilcoxon_p": f"""WITH RECURSIVE {relational_queries._O}, pairs AS (SELECT r_name, n_name, round(avg(o_totalprice) FILTER (o_orderstatus = 'O') - avg(o_totalprice) FILTER (o_orderstatus = 'F'), 6) AS d FROM o GROUP BY 1, 2), {sql.signed_rank("pairs", "r_name", "d")}""",
    "one_sample_wilcoxon": f"""WITH RECURSIVE {relational_queries._O}, means AS (SELECT o_orderstatus, n_name, avg(o_totalprice) AS v FROM o GROUP BY 1, 2), away AS (SELECT o_orderstatus, round(v - median(v) OVER (PARTITION BY o_orderstatus) - 1, 6) AS d FROM means), {sql.signed_rank("away", "o_orderstatus", "d")}""",
    "region_profile": f"""WITH {relational_queries._O}, v AS (SELECT r_name, o_custkey, avg(o_totalprice) AS v FROM o GROUP BY 1, 2),
        names AS (SELECT DISTINCT r_name FROM v), pairs AS (SELECT x.r_name AS a, y.r_name AS b, v.r_name, v.v FROM names x JOIN names y ON x.r_name < y.r_name JOIN v ON v.r_name IN (x.r_name, y.r_name)),
        ranked AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY a, b, v) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY a, b, v) AS t FROM pairs WINDOW w AS (PARTITION BY a, b ORDER BY v)),
        sums AS (SELECT a, b, count(*) FILTER (r_name = a) AS n_a, count(*) FILTER (r_name = b) AS n_b, sum(r) FILTER (r_name = a) - count(*) FILTER (r_name = a) * (count(*) FILTER (r_name = a) + 1) / 2.0 AS u, sum(pow(t, 2) - 1) AS ties FROM ranked GROUP BY 1, 2),
        z AS (SELECT *, (greatest(u, n_a * n_b - u) - n_a * n_b / 2 - 0.5) / sqrt(n_a * n_b / 12 * (n_a + n_b + 1 - ties / ((n_a + n_b) * (n_a + n_b - 1.0)))) / sqrt(2) AS z FROM sums)
        SELECT a, b, n_a, n_b, u::DOUBLE AS u, round(CASE WHEN z > 0 THEN {sql.erfc("z")} ELSE 1 END, 9) AS p FROM z""",
    "resampled_signals": _fir(4, _taps(4)),
    "decimated_signals": _fir(2, _decimating_taps(2)),
}
