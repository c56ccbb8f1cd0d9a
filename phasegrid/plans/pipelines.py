"""Whole analyses as compositions. Signals are rows ``cohort, subject, segment, state, channel, region, sfreq, samples``.

Every function takes and returns DataFrames; kernels run at one rate, so a table
with several rates is split by ``sfreq`` first (``by_rate``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasegrid.operators import coupling, inference, kernels, rollup
from phasegrid.operators import events as ev
from phasegrid.operators import signals as signal_ops

# Bands in Hz.
BANDS = {"slow": (0.5, 1.25), "delta": (0.5, 4.0), "theta": (4.0, 8.0), "spindle": (11.0, 16.0), "beta": (16.0, 30.0), "gamma": (30.0, 80.0)}
SLOW, SPINDLE, RIPPLE, WHOLE = (0.5, 1.25), (11.0, 16.0), (80.0, 120.0), (0.5, 45.0)


def by_rate(signals: DataFrame, analysis: Callable[[DataFrame, float], DataFrame], rates: Sequence[float]) -> DataFrame:
    """An analysis of each of the known rates, together."""
    out = None
    for r in rates:
        got = analysis(signals.where(F.col("sfreq") == r), float(r))
        out = got if out is None else out.unionByName(got)
    return out


def normative_signals(signals: DataFrame, channels: DataFrame) -> DataFrame:
    """Signals of unflagged channels with a region, which they get."""
    flags = ["ch1_soz", "ch2_soz", "ch1_resected", "ch2_resected"]
    named = rollup.normative(channels, flags).withColumn("region", rollup.first_match(rollup.ROI_RULES, F.col("final_label"), F.col("reg"))).where("region is not null")
    return signals.drop("region").join(named.select(F.col("pt").alias("subject"), F.col("name").alias("channel"), "region"), ["subject", "channel"])


def slow_power_by_state(signals: DataFrame, sfreq: float) -> tuple[DataFrame, DataFrame]:
    """(channel by state, region by state with intervals): relative slow power, clip to channel to subject to region."""
    power = kernels.band_powers(signals, ["subject", "channel", "region", "state", "segment"], "samples", BANDS, WHOLE, sfreq)
    channel = power.groupBy("subject", "channel", "region", "state").agg(*[F.avg(b).alias(b) for b in BANDS], F.count("*").alias("n_clips"))
    subject = channel.groupBy("region", "state", "subject").agg(F.avg("slow").alias("slow"))
    return channel, inference.bootstrap(subject, ["region", "state"], ["subject"], "slow")


def state_test(channel: DataFrame, value: str, regions: Sequence[str], states: Sequence[str] = ("W", "N3")) -> DataFrame:
    """Signed-rank test between two states over subjects, all channels of the regions together."""
    subject = channel.where(F.col("region").isin(list(regions))).groupBy("subject", "state").agg(F.avg(value).alias("v"))
    pairs = rollup.paired_states(subject, ["subject"], "state", "v", list(states))
    differences = pairs.select(F.lit(value).alias("measure"), (F.col(states[1]) - F.col(states[0])).alias("difference"))
    return inference.signed_rank_test(differences, ["measure"], "difference")


def coupling_by_state(signals: DataFrame, sfreq: float, phase=SLOW, amplitude=SPINDLE, surrogates: int = 120) -> DataFrame:
    """Channel by state: mean index and z over clips, circular mean of the preferred phases."""
    got = kernels.coupling_z(signals, ["subject", "channel", "region", "state", "segment"], "samples", phase, amplitude, sfreq, surrogates)
    circular = F.atan2(F.avg(F.sin("pref_phase")), F.avg(F.cos("pref_phase")))
    return got.groupBy("subject", "channel", "region", "state").agg(F.avg("mi").alias("mi"), F.avg("mi_z").alias("mi_z"), circular.alias("pref_phase"), F.count("*").alias("n_clips"))


def bipolar_signals(signals: DataFrame, channels: DataFrame | None = None) -> DataFrame:
    """Differences of neighbouring contacts of a shaft; a pair goes if either contact is in the onset zone."""
    own = signals
    if channels is not None:
        zone = channels.select("subject", "channel", F.coalesce(F.col("soz_region").cast("int"), F.lit(0)).alias("__soz"))
        own = own.join(zone, ["subject", "channel"], "left").where(F.coalesce("__soz", F.lit(0)) == 0).drop("__soz")
    parts = own.select("subject", "segment", "sfreq", F.regexp_extract("channel", r"^([A-Za-z]+)\d+$", 1).alias("shaft"), F.regexp_extract("channel", r"(\d+)$", 1).cast("int").alias("num"), "samples").where("shaft <> ''")
    pairs = signal_ops.bipolar(parts, ["subject", "segment", "sfreq", "shaft"])
    name = F.concat("shaft", F.col("num").cast("string"), F.lit("-"), "shaft", (F.col("num") + 1).cast("string"))
    return pairs.select("subject", "segment", "sfreq", name.alias("channel"), F.col("shaft").alias("region"), "samples")


def ripple_coupling(signals: DataFrame, sfreq: float, surrogates: int = 120, mask=None) -> DataFrame:
    """Per channel: index and z of spindles and of ripples on the slow phase, over valid samples only."""
    keys = ["subject", "channel", "region"]
    sp = kernels.coupling_z(signals, keys, "samples", SLOW, SPINDLE, sfreq, surrogates, mask).select(*keys, F.col("mi").alias("mi_spindle"), F.col("mi_z").alias("miz_spindle"))
    rp = kernels.coupling_z(signals, keys, "samples", SLOW, RIPPLE, sfreq, surrogates, mask).select(*keys, F.col("mi").alias("mi_ripple"), F.col("mi_z").alias("miz_ripple"), F.col("pref_phase").alias("ripple_pref_phase"))
    return sp.join(rp, keys)


def event_phases(signals: DataFrame, marks: DataFrame, sfreq: float) -> DataFrame:
    """Rayleigh statistics of the slow phase at marked events, by region and kind of event."""
    phase = kernels.analytic(signals, ["subject", "channel", "region"], "samples", *SLOW, sfreq).select("subject", "channel", "region", "phase")
    at = ev.rounded_sample(F.col("onset_s"), sfreq)
    kind = F.when(F.col("etype").isin("fr", "frandr"), "fr").when(F.col("etype") == "ripple", "ripple")
    own = marks.withColumn("kind", kind).where("kind is not null").withColumn("at", at)
    met = own.join(phase, ["subject", "channel"]).where((F.col("at") >= 0) & (F.col("at") < F.size("phase")))
    return ev.rayleigh(met.select("region", "kind", F.expr("element_at(phase, cast(at + 1 as int))").alias("phase")), ["region", "kind"])


def ripple_triggered(signals: DataFrame, marks: DataFrame, sfreq: float, half_s: float = 1.0, least: int = 30) -> DataFrame:
    """z of the ripple-triggered slow wave of each channel with enough ripples."""
    at = F.collect_list(ev.truncated_sample(F.col("onset_s"), sfreq).cast("int")).alias("marks")
    listed = marks.where("etype = 'ripple'").groupBy("subject", "channel").agg(at)
    return kernels.triggered_z(signals.join(listed, ["subject", "channel"]), ["subject", "channel", "region"], "samples", "marks", 0.5, 4.0, sfreq, int(half_s * sfreq), least=least)


def nesting(signals: DataFrame, sfreq: float, half_s: float = 1.5) -> DataFrame:
    """Each subject's mean spindle envelope 0 to 0.75 s after slow troughs, subjects with twenty troughs or more."""
    sums = kernels.locked_envelopes(signals, ["subject", "channel"], "samples", SLOW, {"spindle": SPINDLE}, sfreq, half_s)
    up = F.col("offset").between(0, int(0.75 * sfreq))
    n = sums.groupBy("subject", "channel").agg(F.max("n").alias("n")).groupBy("subject").agg(F.sum("n").alias("n_events"))
    z = sums.where(up).groupBy("subject").agg((F.sum("total") / F.sum("n")).alias("z_upstate"))
    return z.join(n, "subject").where("n_events >= 20")


def aligned_coupling(signals: DataFrame, sfreq: float, legs: dict[str, tuple[tuple[float, float], tuple[float, float]]], keys: Sequence[str] = ("subject",), block_s: float = 5.0) -> DataFrame:
    """``*keys, leg, centre``: cross-validated aligned coupling. ``keys`` say whether a subject or a channel is aligned as one."""
    names = list(keys)
    sums = coupling.phase_amplitude_sums(signals, names, [(leg, *bands) for leg, bands in legs.items()], "samples", int(block_s * sfreq), sfreq=sfreq)
    return coupling.aligned(sums, [*names, "leg"]).where(f"pos = {coupling.dsp.BINS // 2}").select(*names, "leg", F.col("value").alias("centre"))


def cohort_summary(centres: DataFrame, by: Sequence[str], key: str = "subject") -> DataFrame:
    """Mean, interval, and positives of all as a string, e.g. over the channels of a night."""
    got = inference.bootstrap(centres, list(by), [key], "centre")
    positive = centres.groupBy(*by).agg(F.count_if(F.col("centre") > 0).alias("k"), F.count("*").alias("all"))
    return got.join(positive, list(by)).withColumn("positive", F.concat(F.col("k").cast("string"), F.lit("/"), F.col("all").cast("string"))).drop("k", "all")


def staged(epochs: DataFrame, sfreq: float, pct: float = 0.55) -> DataFrame:
    """``epoch, delta_ratio, nrem``: 30 s epochs of one recording; the upper share of delta ratios counts as NREM, asleep or not."""
    ratio = kernels.band_powers(epochs, ["recording", "epoch"], "samples", {"delta_ratio": (0.5, 4.0)}, (0.5, 25.0), sfreq)
    return rollup.with_percentile(ratio, ["recording"], "delta_ratio", pct, "cut").select("recording", "epoch", "delta_ratio", (F.col("delta_ratio") >= F.col("cut")).alias("nrem"))


def night_blocks(hypnogram: DataFrame, epoch_s: float = 30.0, most_s: float = 600.0) -> DataFrame:
    """Stretches of NREM epochs, ten minutes at most: what a night is pulled in."""
    runs = ev.capped_runs(hypnogram.withColumn("k", F.col("epoch").cast("long")), ["recording"], "nrem", int(most_s / epoch_s))
    return runs.select("recording", (F.col("first_k") * epoch_s).alias("start_s"), (F.col("n") * epoch_s).alias("dur_s"))


def ranked_datasets(found: DataFrame, most: int = 12) -> DataFrame:
    """Reachable datasets by contacts in the region of interest, then by duration."""
    return found.where("reachable").orderBy(F.desc("n_mtl"), F.desc("dur_h"), "dataset").limit(most)


def quality_control(signals: DataFrame) -> DataFrame:
    """Per subject: clips, channels, traces and their seconds."""
    return signals.groupBy("subject").agg(F.countDistinct("segment").alias("n_clips"), F.countDistinct("channel").alias("n_channels"), F.count("*").alias("n_channel_clips"), F.sum(F.size("samples") / F.col("sfreq")).alias("duration_s"))
