"""Queries over array-valued signals: the ``embeddings`` table, one signal of 64 samples a row, its label as state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phasegrid.operators import coupling, inference, signals
from phasegrid.plans import sql

PHASE, AMP = (2, 4), (12, 18)
LEGS = [("so_sp", (1, 2), (5, 8)), ("sp_rp", (5, 8), (16, 24)), ("so_rp", (1, 2), (16, 24))]


def table(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet")


def _long(spark: SparkSession, d: str) -> DataFrame:
    return signals.to_long(table(spark, d), ["vec_id", "label"], "embedding")


def _curve(spark: SparkSession, d: str) -> DataFrame:
    return coupling.curves(coupling.phase_amplitude_sums(table(spark, d), ["label"], [("leg", PHASE, AMP)], "embedding"), ["label"])


def tort_mi_by_label(spark, d):
    return coupling.modulation(_curve(spark, d), ["label"]).select("label", F.round("mi", 9).alias("mi"))


def phase_amp_curve(spark, d):
    return _curve(spark, d).select("label", "bin", F.round("mean_amp", 9).alias("mean_amp"))


def preferred_phase(spark, d):
    return coupling.preferred(_curve(spark, d), ["label"]).select("label", "pref_bin", F.round("pref_phase", 9).alias("pref_phase"))


def aligned_curve_xval(spark, d):
    sums = coupling.phase_amplitude_sums(table(spark, d), ["label"], [("leg", PHASE, AMP)], "embedding", block=8)
    return coupling.aligned(sums, ["label"]).select("label", "pos", F.round("value", 9).alias("value"))


def aligned_centre_by_signal(spark, d):
    """Per-channel alignment: the centre value of each signal's own curve."""
    sums = coupling.phase_amplitude_sums(table(spark, d), ["vec_id"], [("leg", PHASE, AMP)], "embedding", block=8)
    return coupling.aligned(sums, ["vec_id"]).where("pos = 9").select("vec_id", F.round("value", 8).alias("centre"))


def hierarchy_legs(spark, d):
    sums = coupling.phase_amplitude_sums(table(spark, d), ["label"], LEGS, "embedding", block=8)
    return coupling.aligned(sums, ["label", "leg"]).where("pos = 9").select("label", "leg", F.round("value", 9).alias("centre"))


def hierarchy_interval(spark, d):
    """Each leg's mean centre over the channels (labels), and its bootstrap interval."""
    sums = coupling.phase_amplitude_sums(table(spark, d), ["label"], LEGS, "embedding", block=8)
    got = inference.bootstrap(coupling.aligned(sums, ["label", "leg"]).where("pos = 9"), ["leg"], ["label"], "value")
    return got.select("leg", *[F.round(c, 8).alias(c) for c in ("mean", "ci_lo", "ci_hi")], "n")


def night_coupling(spark, d):
    """Coupling across the night: the centre of each channel's (label's) aligned curve in six equal stretches of the recording, mean and standard error over channels."""
    own = table(spark, d)
    low, high = own.agg(F.min("vec_id"), F.max("vec_id")).first()
    tbin = F.least(F.lit(5), F.floor((F.col("vec_id") - F.lit(low)) * 6 / F.lit(max(1, (high or 0) - (low or 0))))).cast("int")
    sums = coupling.phase_amplitude_sums(own.withColumn("tbin", tbin), ["label", "tbin"], [("leg", PHASE, AMP)], "embedding", block=8)
    centre = coupling.aligned(sums, ["label", "tbin"]).where("pos = 9")
    got = centre.groupBy("tbin").agg(F.avg("value").alias("m"), (F.stddev_pop("value") / F.sqrt(F.count("*"))).alias("sem"), F.count("*").alias("n"))
    return got.select("tbin", F.round("m", 8).alias("centre"), F.round("sem", 8).alias("sem"), "n")


#: Eight phase bands by twelve amplitude bands, as harmonics of a signal's 64 samples.
GRID_PHASES, GRID_AMPLITUDES = [(k, k + 1) for k in range(1, 9)], [(k, k + 1) for k in range(8, 32, 2)]


def comodulogram_grid(spark, d):
    grid = coupling.comodulogram(table(spark, d), ["label"], GRID_PHASES, GRID_AMPLITUDES, "embedding")
    return grid.withColumn("mi", F.round("mi", 9))


def rel_band_power(spark, d):
    return signals.relative_power(table(spark, d), ["vec_id", "label"], {"slow": (1, 4), "delta": (1, 6), "spindle": (10, 14), "gamma": (20, 31)}, (1, 28), "embedding").select(
        "vec_id", "label", *[F.round(c, 9).alias(c) for c in ("slow", "delta", "spindle", "gamma")]
    )


def detrend_residual_std(spark, d):
    return signals.detrended(_long(spark, d), ["vec_id"]).groupBy("vec_id").agg(F.round(F.stddev_pop("x"), 9).alias("residual_std"))


def zscore_signal(spark, d):
    return signals.zscored(_long(spark, d), ["vec_id"]).select("vec_id", "i", F.round("z", 7).alias("z"))


def robust_z(spark, d):
    return signals.robust_zscored(_long(spark, d), ["vec_id"]).select("vec_id", "i", F.round("z", 6).alias("z"))


def signal_validity(spark, d):
    return table(spark, d).select("vec_id", signals.valid(F.col("embedding")).alias("valid"), (F.size("embedding") >= 2 * 20).alias("long_enough"))


def bipolar_pairs(spark, d):
    """Contacts are numbered along a shaft (label); only direct neighbours pair, never across a gap."""
    pairs = signals.bipolar(table(spark, d).select("label", F.col("vec_id").alias("num"), F.col("embedding").alias("samples")), ["label"])
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)
    return pairs.select("label", "num", F.size("samples").alias("n"), F.round(total, 6).alias("total"))


def block_parity_means(spark, d):
    own = _long(spark, d).withColumn("half", (F.floor(F.col("i") / 8) % 2).cast("int"))
    return own.groupBy("label", "half").agg(F.round(F.avg("x"), 9).alias("mean_x"), F.count("*").alias("n"))


def circular_shift(spark, d):
    """Each signal rolled by a tenth of its length."""
    return table(spark, d).select("vec_id", signals.roll("embedding", 6).alias("x")).select("vec_id", F.posexplode("x").alias("i", "v")).select("vec_id", "i", F.round(F.col("v").cast("double"), 7).alias("v"))


def local_maxima(spark, d):
    return signals.local_maxima(_long(spark, d), ["vec_id"]).groupBy("vec_id").agg(F.count("*").alias("n_peaks"), F.round(F.max("x"), 7).alias("highest"))


def peak_order(spark, d):
    """Rows ordered by the place of their largest sample (first of equals), the ten earliest of each label."""
    at = table(spark, d).select("vec_id", "label", (F.array_position("embedding", F.array_max("embedding")) - 1).alias("peak_at"))
    w = Window.partitionBy("label").orderBy("peak_at", "vec_id")
    return at.withColumn("rank", F.row_number().over(w)).where("rank <= 10").select("label", "rank", "vec_id", "peak_at")


def epoch_average(spark, d):
    """Average window of four samples before to four after each signal's largest sample, strictly inside."""
    at = table(spark, d).withColumn("e", F.array_position("embedding", F.array_max("embedding")) - 1)
    return signals.triggered(at, ["label"], "embedding", "e", 4, strict=True).select("label", "offset", F.round("mean_x", 7).alias("mean_x"), "n")


def recording_totals(spark, d):
    """Traces and seconds of each label at 64 samples a second."""
    return table(spark, d).groupBy("label").agg(F.count("*").alias("n_traces"), F.sum(F.size("embedding") / F.lit(64.0)).alias("seconds"))


def peak_to_peak(spark, d):
    span = (F.array_max("embedding") - F.array_min("embedding")).cast("double")
    return table(spark, d).groupBy("label").agg(F.round(F.avg(span), 6).alias("mean_ptp"), F.round(F.stddev_pop(span) / F.sqrt(F.count("*")), 6).alias("sem_ptp"))


QUERIES = {f.__name__: f for f in (
    night_coupling, tort_mi_by_label, phase_amp_curve, preferred_phase, aligned_curve_xval, aligned_centre_by_signal, hierarchy_legs, hierarchy_interval, comodulogram_grid, rel_band_power, detrend_residual_std,
    zscore_signal, robust_z, signal_validity, bipolar_pairs, block_parity_means, circular_shift, local_maxima, peak_order, epoch_average, recording_totals, peak_to_peak,
)}

_LONG = "s AS (SELECT vec_id, label, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)"


def _dft(legs, key: str, block: int | None = None) -> str:
    """CTEs up to ``sums(key, leg, half, bin, s, n)``."""
    top = max(max(p[1], a[1]) for _, p, a in legs)
    band = lambda b, part: f"sum(CASE WHEN k BETWEEN {b[0]} AND {b[1]} THEN {part} END)"
    re, im = "re * cos(2 * pi() * k * i / 64) - im * sin(2 * pi() * k * i / 64)", "re * sin(2 * pi() * k * i / 64) + im * cos(2 * pi() * k * i / 64)"
    half = f"((i // {block}) % 2)" if block else "0"
    per_leg = " UNION ALL ".join(
        f"SELECT {key}, '{name}' AS leg, {half} AS half, least(17, floor((atan2({band(p, im)}, {band(p, re)}) + pi()) / (2 * pi() / 18)))::INT AS bin, "
        f"sqrt(pow({band(a, re)}, 2) + pow({band(a, im)}, 2)) * 2 / 64 AS amp FROM coef, range(0, 64) t(i) GROUP BY vec_id, label, i"
        for name, p, a in legs
    )
    return f"""{_LONG}, coef AS (SELECT vec_id, label, k, sum(x * cos(2 * pi() * k * i / 64)) AS re, -sum(x * sin(2 * pi() * k * i / 64)) AS im
        FROM s, range(1, {top + 1}) t(k) GROUP BY 1, 2, 3),
        each AS ({per_leg}), sums AS (SELECT {key}, leg, half, bin, sum(amp) AS s, count(*) AS n FROM each GROUP BY ALL),
        curve AS (SELECT k.{key}, k.leg, k.half, b.bin::INT AS bin, coalesce(s / n, 0.0) AS mean_amp
            FROM (SELECT DISTINCT {key}, leg, half FROM sums) k CROSS JOIN range(0, 18) b(bin) LEFT JOIN sums USING ({key}, leg, half, bin))"""


def _aligned(legs, key: str) -> str:
    return _dft(legs, key, 8) + f""",
        arrays AS (SELECT {key}, leg, half, list(mean_amp ORDER BY bin) AS c FROM curve GROUP BY 1, 2, 3),
        turned AS (SELECT a.{key}, a.leg, list_position(a.c, list_max(a.c)) - 1 AS best, b.c AS b FROM arrays a JOIN arrays b ON a.{key} = b.{key} AND a.leg = b.leg AND a.half = 0 AND b.half = 1),
        al AS (SELECT {key}, leg, pos::INT AS pos, b[((pos - 9 + best + 18) % 18) + 1] - list_sum(b) / 18 AS value FROM turned CROSS JOIN range(0, 18) t(pos))"""


_MI = "(ln(18.0) + sum(greatest(mean_amp / tot, 1e-12) * ln(greatest(mean_amp / tot, 1e-12)))) / ln(18.0)"
_ONE = [("leg", PHASE, AMP)]
_GRID = [(f"{p[0]}|{a[0]}", p, a) for p in GRID_PHASES for a in GRID_AMPLITUDES]

_NIGHT = "r AS (SELECT min(vec_id) AS lo, greatest(1, max(vec_id) - min(vec_id)) AS span FROM embeddings), binned AS (SELECT vec_id, label * 10 + least(5, floor((vec_id - lo) * 6 / span))::INT AS label, embedding FROM embeddings, r)"

ORACLES = {
    "hierarchy_interval": f"WITH {_aligned(LEGS, 'label')}, centres AS (SELECT label, leg, value FROM al WHERE pos = 9), {sql.bootstrap('centres', ['leg'], ['label'], 'value')} SELECT leg, round(mean, 8) AS mean, round(ci_lo, 8) AS ci_lo, round(ci_hi, 8) AS ci_hi, n FROM ci",
    "night_coupling": f"WITH {_NIGHT}, {_aligned(_ONE, 'label').replace('FROM embeddings', 'FROM binned')} SELECT (label % 10)::INT AS tbin, round(avg(value), 8) AS centre, round(stddev_pop(value) / sqrt(count(*)), 8) AS sem, count(*) AS n FROM al WHERE pos = 9 GROUP BY 1",
    "tort_mi_by_label": f"WITH {_dft(_ONE, 'label')} SELECT label, round({_MI}, 9) AS mi FROM (SELECT *, sum(mean_amp) OVER (PARTITION BY label) AS tot FROM curve) GROUP BY label",
    "phase_amp_curve": f"WITH {_dft(_ONE, 'label')} SELECT label, bin, round(mean_amp, 9) AS mean_amp FROM curve",
    "preferred_phase": f"WITH {_dft(_ONE, 'label')} SELECT label, bin AS pref_bin, round(-pi() + (bin + 0.5) * 2 * pi() / 18, 9) AS pref_phase FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY mean_amp DESC, bin) AS r FROM curve) WHERE r = 1",
    "aligned_curve_xval": f"WITH {_aligned(_ONE, 'label')} SELECT label, pos, round(value, 9) AS value FROM al",
    "aligned_centre_by_signal": f"WITH {_aligned(_ONE, 'vec_id')} SELECT vec_id, round(value, 8) AS centre FROM al WHERE pos = 9",
    "hierarchy_legs": f"WITH {_aligned(LEGS, 'label')} SELECT label, leg, round(value, 9) AS centre FROM al WHERE pos = 9",
    "comodulogram_grid": f"WITH {_dft(_GRID, 'label')} SELECT label, split_part(leg, '|', 1)::INT AS phase_low, split_part(leg, '|', 2)::INT AS amp_low, round({_MI}, 9) AS mi FROM (SELECT *, sum(mean_amp) OVER (PARTITION BY label, leg) AS tot FROM curve) GROUP BY label, leg",
    "rel_band_power": f"""WITH {_LONG}, p AS (SELECT vec_id, label, k, pow(sum(x * cos(2 * pi() * k * i / 64)), 2) + pow(sum(x * sin(2 * pi() * k * i / 64)), 2) AS p FROM s, range(0, 33) t(k) GROUP BY 1, 2, 3),
        e AS (SELECT *, lag(p) OVER (PARTITION BY vec_id ORDER BY k) AS q FROM p),
        a AS (SELECT vec_id, label, """ + ", ".join(f"sum(CASE WHEN k > {lo} AND k < {hi} THEN (p + q) / 2 END) AS {n}" for n, (lo, hi) in {"slow": (1, 4), "delta": (1, 6), "spindle": (10, 14), "gamma": (20, 31), "whole": (1, 28)}.items()) + """ FROM e GROUP BY 1, 2)
        SELECT vec_id, label, round(slow / whole, 9) AS slow, round(delta / whole, 9) AS delta, round(spindle / whole, 9) AS spindle, round(gamma / whole, 9) AS gamma FROM a""",
    "detrend_residual_std": f"WITH {_LONG}, f AS (SELECT vec_id, regr_slope(x, i) AS b, regr_intercept(x, i) AS a FROM s GROUP BY 1) SELECT vec_id, round(stddev_pop(x - a - b * i), 9) AS residual_std FROM s JOIN f USING (vec_id) GROUP BY vec_id",
    "zscore_signal": f"WITH {_LONG} SELECT vec_id, i::INT AS i, round((x - avg(x) OVER w) / (stddev_pop(x) OVER w + 1e-12), 7) AS z FROM s WINDOW w AS (PARTITION BY vec_id)",
    "robust_z": f"""WITH {_LONG}, m AS (SELECT vec_id, median(x) AS m, stddev_pop(x) AS sd FROM s GROUP BY 1), d AS (SELECT s.vec_id, 1.4826 * median(abs(x - m)) AS mad FROM s JOIN m USING (vec_id) GROUP BY 1)
        SELECT vec_id, i::INT AS i, round((x - m) / (CASE WHEN mad = 0 THEN sd ELSE mad END + 1e-12), 6) AS z FROM s JOIN m USING (vec_id) JOIN d USING (vec_id)""",
    "signal_validity": f"WITH {_LONG}, g AS (SELECT vec_id, bool_and(x IS NOT NULL AND isfinite(x)) AND stddev_pop(x) >= 1e-9 AS valid FROM s GROUP BY 1) SELECT vec_id, valid, len(embedding) >= 40 AS long_enough FROM embeddings JOIN g USING (vec_id)",
    "bipolar_pairs": "SELECT a.label, a.vec_id AS num, len(a.embedding)::INT AS n, round(list_sum(list_transform(range(1, 65), lambda k: a.embedding[k]::DOUBLE - b.embedding[k]::DOUBLE)), 6) AS total FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id = a.vec_id + 1",
    "block_parity_means": f"WITH {_LONG} SELECT label, ((i // 8) % 2)::INT AS half, round(avg(x), 9) AS mean_x, count(*) AS n FROM s GROUP BY 1, 2",
    "circular_shift": f"WITH {_LONG} SELECT vec_id, ((i + 6) % 64)::INT AS i, round(x, 7) AS v FROM s",
    "local_maxima": f"WITH {_LONG}, n AS (SELECT *, lag(x) OVER w AS l, lead(x) OVER w AS r FROM s WINDOW w AS (PARTITION BY vec_id ORDER BY i)) SELECT vec_id, count(*) AS n_peaks, round(max(x), 7) AS highest FROM n WHERE x > l AND x > r GROUP BY 1",
    "peak_order": "SELECT label, rank::INT AS rank, vec_id, peak_at FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY peak_at, vec_id) AS rank FROM (SELECT vec_id, label, (list_position(embedding, list_max(embedding)) - 1)::BIGINT AS peak_at FROM embeddings)) WHERE rank <= 10",
    "epoch_average": f"WITH {_LONG}, e AS (SELECT vec_id, label, list_position(embedding, list_max(embedding)) - 1 AS e FROM embeddings) SELECT label, (i - e)::INT AS \"offset\", round(avg(x), 7) AS mean_x, count(*) AS n FROM s JOIN e USING (vec_id, label) WHERE e > 4 AND e < 60 AND i >= e - 4 AND i < e + 4 GROUP BY 1, 2",
    "recording_totals": "SELECT label, count(*) AS n_traces, sum(len(embedding) / 64.0)::DOUBLE AS seconds FROM embeddings GROUP BY 1",
    "peak_to_peak": "SELECT label, round(avg(d), 6) AS mean_ptp, round(stddev_pop(d) / sqrt(count(*)), 6) AS sem_ptp FROM (SELECT label, (list_max(embedding) - list_min(embedding))::DOUBLE AS d FROM embeddings) GROUP BY 1",
}
