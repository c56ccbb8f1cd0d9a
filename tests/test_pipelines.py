"""Whole analyses on signals with a planted answer, and streams against batches."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from phasegrid.operators import coupling, kernels
from phasegrid.operators import events as ev
from phasegrid.plans import event_queries, pipelines, stream_queries
from phasegrid.streaming import blocks

FS = 200.0
T = np.arange(0, 40, 1 / FS)


def signal(seed, modulated, slow_gain=3.0):
    r = np.random.default_rng(seed)
    phase = 2 * np.pi * 0.8 * T + r.uniform(0, 6) + np.cumsum(r.standard_normal(len(T))) * 0.03
    gain = 1 + 0.9 * np.sin(phase) if modulated else 1.0
    return (slow_gain * np.cos(phase) + gain * np.cos(2 * np.pi * 13 * T + r.uniform(0, 6)) + 0.3 * r.standard_normal(len(T))).tolist()


@pytest.fixture(scope="module")
def signals(spark):
    rows = []
    for s in range(6):
        for state, modulated, gain in (("W", False, 0.5), ("N3", True, 3.0)):
            for c in range(2):
                rows.append(("c", f"s{s}", f"{state}0", state, f"LA{c + 1}", "entorhinal", FS, signal(s * 10 + c + 5 * modulated, modulated, gain)))
    rows.append(("c", "bad", "N30", "N3", "LA1", "entorhinal", FS, [1.0] * len(T)))
    rows.append(("c", "bad", "N31", "N3", "LA1", "entorhinal", FS, None))
    return spark.createDataFrame(pd.DataFrame(rows, columns="cohort subject segment state channel region sfreq samples".split()), "cohort string, subject string, segment string, state string, channel string, region string, sfreq double, samples array<double>").cache()


def test_power_by_state(signals):
    channel, region = pipelines.slow_power_by_state(signals, FS)
    means = {r.state: r["mean"] for r in region.collect()}
    assert means["N3"] > means["W"] + 0.2
    test = pipelines.state_test(channel, "slow", ["entorhinal"]).first()
    assert test.n == 6 and test.p == pytest.approx(2 / 64)


def test_coupling_by_state(signals):
    got = pipelines.by_rate(signals, lambda s, r: pipelines.coupling_by_state(s, r, surrogates=30), [FS])
    z = {r.state: r.z for r in got.groupBy("state").agg(F.avg("mi_z").alias("z")).collect()}
    assert z["N3"] > 5 > z["W"] and got.where("subject = 'bad'").count() == 0
    rounded = lambda df: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())
    assert rounded(got) == rounded(pipelines.coupling_by_state(signals.repartition(5), FS, surrogates=30))


def test_aligned_coupling(signals):
    centres = pipelines.aligned_coupling(signals, FS, {"so_sp": (pipelines.SLOW, pipelines.SPINDLE)}, ["subject", "channel", "state"])
    got = pipelines.cohort_summary(centres, ["leg", "state"], "subject").collect()
    by = {r.state: r for r in got}
    assert by["N3"]["mean"] > 0.3 and by["N3"].positive == "12/12" and abs(by["W"]["mean"]) < 0.1


def test_nesting_and_quality(signals):
    got = pipelines.nesting(signals.where("state = 'N3'"), FS).collect()
    assert len(got) == 6 and all(abs(r.z_upstate) > 0.05 and r.n_events >= 20 for r in got)
    q = {r.subject: r for r in pipelines.quality_control(signals.where("samples is not null")).collect()}
    assert q["s0"].n_channels == 2 and q["s0"].duration_s == pytest.approx(160)


def test_bipolar_never_crosses_a_gap(spark):
    rows = [("s", "g", 1.0, c, [float(k)] * 3) for k, c in enumerate(["LA1", "LA2", "LA4", "LB1", "LB2"])]
    df = spark.createDataFrame(rows, "subject string, segment string, sfreq double, channel string, samples array<double>")
    zones = spark.createDataFrame([("s", "LB2", 1), ("s", "LA1", None)], "subject string, channel string, soz_region int")
    assert {r.channel: r.samples for r in pipelines.bipolar_signals(df).collect()} == {"LA1-LA2": [-1.0] * 3, "LB1-LB2": [-1.0] * 3}
    assert [r.channel for r in pipelines.bipolar_signals(df, zones).collect()] == ["LA1-LA2"]


def test_event_phases(spark, signals):
    one = signals.where("subject = 's0' and state = 'N3' and channel = 'LA1'")
    x = np.array(one.first().samples)
    from phasegrid.functions import dsp

    phase = np.angle(dsp.analytic(dsp.bandpass(dsp.detrend(x[None]), *pipelines.SLOW, FS)))[0]
    at = [k for k in range(400, len(x) - 400) if abs(phase[k]) < 0.2][:60]
    marks = spark.createDataFrame([("s0", "LA1", "fr" if k % 2 else "frandr", t / FS) for k, t in enumerate(at)] + [("s0", "LA1", "other", 1.0)], "subject string, channel string, etype string, onset_s double")
    got = pipelines.event_phases(one, marks, FS).collect()
    assert len(got) == 1 and got[0].kind == "fr" and got[0].n == len(at) and got[0].mrl > 0.95 and abs(got[0].pref_phase) < 0.2 and got[0].rayleigh_p < 1e-6


def test_ripple_triggered(spark, signals):
    one = signals.where("subject = 's1' and state = 'N3' and channel = 'LA1'")
    x = np.array(one.first().samples)
    from phasegrid.functions import dsp

    peaks = dsp.find_peaks(dsp.zscore(dsp.bandpass(x[None], 0.5, 1.25, FS))[0], 0.5, 100)
    marks = spark.createDataFrame([("s1", "LA1", "ripple", float(t + 0.2) / FS) for t in peaks], "subject string, channel string, etype string, onset_s double")
    got = pipelines.ripple_triggered(one, marks, FS, least=10).collect()
    assert len(got) == 1 and got[0].z > 3


def test_night(spark):
    r = np.random.default_rng(0)
    rows = [("n", e, ((3 if 10 <= e < 50 else 0.1) * np.cos(2 * np.pi * 1.5 * np.arange(600) / 20) + r.standard_normal(600)).tolist()) for e in range(90)]
    hyp = pipelines.staged(spark.createDataFrame(rows, "recording string, epoch int, samples array<double>"), 20.0, 0.56)
    got = sorted((r.start_s, r.dur_s) for r in pipelines.night_blocks(hyp).collect())
    assert got[0] == (300.0, 600.0) and got[1] == (900.0, 600.0)


def test_mask_boundaries(spark):
    e = spark.createDataFrame([("a", t) for t in (0.0, 1.0, 1.5, 2.0, 2.5, 3.0, 9.0)] + [("b", 2.0), (None, 2.0)], "u string, t double")
    m = spark.createDataFrame([("a", 2.0), ("a", 2.0)], "u string, m double")
    closed = sorted(r.t for r in ev.outside_marks(e, m, ["u"], "t", "m", 1.0).where("u = 'a'").collect())
    opened = sorted(r.t for r in ev.outside_marks(e, m, ["u"], "t", "m", 1.0, closed_left=False).where("u = 'a'").collect())
    assert closed == [0.0, 3.0, 9.0] and opened == [0.0, 1.0, 3.0, 9.0]
    assert ev.outside_marks(e, m, ["u"], "t", "m", 1.0).where("u = 'b' or u is null").count() == 2


def minutes(spark, steps):
    return spark.createDataFrame(steps, "key string, k long").select("key", "k", F.timestamp_seconds(F.col("k") * 60 + 7).alias("ts"))


@pytest.mark.parametrize(("late", "shuffled"), [("3 minutes", False), ("2 hours", True)])
def test_stream_of_runs_equals_batch(spark, tmp_path, late, shuffled):
    """Files in order with a short delay, where runs come out as time goes on, and files in random order with a long one."""
    r = np.random.default_rng(3)
    steps = sorted({(str(u), int(k)) for u in "abc" for k in r.integers(0, 90, 60)} | {("long", k) for k in range(20)} | {("one", 4)}, key=lambda s: (s[1], s[0]))
    batch = sorted(map(tuple, ev.capped_runs(minutes(spark, steps).withColumn("on", F.lit(True)), ["key"], "on", 5).collect()))
    parts = [steps[k::6] for k in range(6)] if shuffled else [steps[k * len(steps) // 6 : (k + 1) * len(steps) // 6] for k in range(6)]
    folder, out = str(tmp_path / "in"), []
    for part in [*parts, [(None, 1000)]]:
        minutes(spark, [*part, *part[:3]]).coalesce(1).write.mode("append").parquet(folder)
    stream = blocks.capped_runs(blocks.read_blocks(spark, folder, 1), "key", "ts", 60, 5, late)
    blocks.each_batch(stream, lambda df, epoch: out.append(sorted(map(tuple, df.collect()))), "runs")
    assert sorted(x for rows in out for x in rows) == batch
    assert shuffled or sum(bool(rows) for rows in out) > 3


def test_each_batch_hands_on_every_trigger(spark, tmp_path):
    for k in range(3):
        minutes(spark, [("a", k)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = []
    blocks.each_batch(blocks.read_blocks(spark, str(tmp_path / "in"), 1), lambda df, epoch: seen.append((epoch, [r.k for r in df.collect()])), "each")
    assert seen == [(0, [0]), (1, [1]), (2, [2])]


@pytest.mark.parametrize("stream, batch", [("stream_sessions", "session_runs"), ("stream_epochs", "tumbling_epochs"), ("stream_sliding", "sliding_epochs")])
def test_streams_of_many_files_in_random_order_equal_batch(spark, tmp_path, stream, batch):
    r = np.random.default_rng(5)
    (tmp_path / "events.parquet").mkdir()
    start = np.datetime64("2024-01-01", "us")
    for k in range(12):
        at = start + r.integers(0, 30 * 86400, 200).astype("timedelta64[s]")
        pd.DataFrame({"event_id": np.arange(200) + 200 * k, "user_id": r.integers(0, 15, 200), "event_type": "view", "ts": at, "value": r.integers(0, 9, 200).astype(float)}).to_parquet(tmp_path / f"events.parquet/{k:02}.parquet")
    got, want = (sorted(map(tuple, q(spark, str(tmp_path)).collect())) for q in (stream_queries.QUERIES[stream], event_queries.QUERIES[batch]))
    assert got == want


def test_accumulators_add_up(signals):
    legs = [("l", (1, 40), (400, 640))]
    whole = coupling.phase_amplitude_sums(signals, ["subject"], legs, block=1000).groupBy("half", "bin").agg(F.sum("amp_sum").alias("s"), F.sum("n").alias("n"))
    parts = [coupling.phase_amplitude_sums(signals.where(c), ["subject"], legs, block=1000) for c in ("subject < 's3'", "subject >= 's3'")]
    both = parts[0].unionByName(parts[1]).groupBy("half", "bin").agg(F.sum("amp_sum").alias("s"), F.sum("n").alias("n"))
    a, b = ({(r.half, r.bin): (round(r.s, 6), r.n) for r in x.collect()} for x in (whole, both))
    assert a == b


def test_kernels_skip_bad_rows(signals):
    assert kernels.filtered(signals, ["subject", "segment"], "samples", *pipelines.SLOW, FS).where("subject = 'bad'").count() == 0
    assert kernels.filtered(signals.limit(0), ["subject"], "samples", *pipelines.SLOW, FS).count() == 0
