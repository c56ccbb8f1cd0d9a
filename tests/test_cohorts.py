"""Loaders on folders made here, against the same steps on whole arrays; quality control's bounded rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_sources import edf

from phasegrid.functions import dsp
from phasegrid.operators import quality
from phasegrid.plans import cohorts
from phasegrid.sources import recordings

REGIONS = [("hippocampal", ["lb", "lc"], []), ("entorhinal", ["la"], [])]
RATE, SECONDS = 200, 25


def noise(seed, names, seconds=SECONDS):
    r = np.random.default_rng(seed)
    return {n: 100 * r.standard_normal(RATE * seconds) for n in names}


def test_continuous_recordings_by_parts(spark, tmp_path):
    for sub, seed in (("sub-01", 1), ("sub-02", 2)):
        folder = tmp_path / sub / "ieeg"
        folder.mkdir(parents=True)
        (folder / f"{sub}_task_ieeg.edf").write_bytes(edf(noise(seed, ["LA1", "LA2", "LA3", "LA5", "LB1", "LB2", "X1", "X2", "EKG"]), RATE, SECONDS))
    (tmp_path / "sub-01" / "ieeg" / "sub-01_task_channels.tsv").write_text("name\tsoz_region\nLA1\t0\nLB2\t1\n")
    (tmp_path / "sub-02" / "ieeg" / "sub-02_task_channels.tsv").write_text("name\ttype\nLA1\tSEEG\n")
    (tmp_path / "sub-01" / "ieeg" / "sub-01_task_events.tsv").write_text("onset\tsample\n1.0\t123\n2.5\tn/a\nn/a\tn/a\n")
    signals, marks = cohorts.bids_recordings(spark, str(tmp_path), "c", float(RATE), 50.0, REGIONS, part_s=7)
    rows = signals.collect()
    assert sorted({(r.subject, r.channel, r.region) for r in rows}) == [("sub-01", "LA1-LA2", "entorhinal"), ("sub-01", "LA2-LA3", "entorhinal"), ("sub-02", "LA1-LA2", "entorhinal"), ("sub-02", "LA2-LA3", "entorhinal"), ("sub-02", "LB1-LB2", "hippocampal")]
    whole = {(r.path.split("/")[-1][:6], r.channel): np.array(r.samples) for r in recordings.read_edf(spark, str(tmp_path)).collect()}
    for subject, channel in {(r.subject, r.channel) for r in rows}:
        a, b = channel.split("-")
        want = dsp.notch_comb(dsp.detrend(whole[subject, a] - whole[subject, b]), 50.0, RATE)[0]
        own = sorted((r for r in rows if (r.subject, r.channel) == (subject, channel)), key=lambda r: r.start)
        assert [r.start for r in own] == [0, 1400, 2800, 4200] and np.allclose(np.concatenate([r.samples for r in own]), want, atol=1e-12)
    assert sorted(map(tuple, marks.collect())) == [("sub-01", 123), ("sub-01", 500)]


@pytest.fixture(scope="module")
def clips(tmp_path_factory):
    folder = tmp_path_factory.mktemp("clips")
    x = {}
    for k, channels in enumerate((["LA1", "LB1"], ["LB1"], ["LA1", "LC1"], ["LA1"])):
        x[k] = noise(10 + k, channels, 4)
        (folder / f"sub-RID0001_N3_{k}.edf").write_bytes(edf(x[k], RATE, 4))
    (folder / "sub-RID0001_W_0.edf").write_bytes(edf(noise(20, ["LA1"], 4), RATE, 4))
    (folder / "sub-RID0001_N3_9.edf").write_bytes(b"broken")
    return folder, x


def test_clips_of_normative_channels(spark, clips):
    folder, _ = clips
    meta = spark.createDataFrame([("sub-RID0001", "LA1", "left entorhinal", None), ("sub-RID0001", "LB1", "left hippocampus", True), ("sub-RID0001", "LC1", "nothing", None)], "pt string, name string, final_label string, ch1_soz boolean").withColumn("reg", F.lit(None).cast("string"))
    got = cohorts.clip_signals(spark, str(folder), "atlas", meta, "N3", float(RATE), 60.0).collect()
    assert sorted((r.segment, r.channel, r.region) for r in got) == [(k, "LA1", "entorhinal") for k in (0, 2, 3)]
    whole = {r.path.rsplit("/", 1)[1]: np.array(r.samples) for r in recordings.read_edf(spark, str(folder)).where("channel = 'LA1'").collect()}
    for r in got:
        assert np.allclose(r.samples, dsp.filtfilt(dsp.notch(60.0, RATE), dsp.detrend(whole[f"sub-RID0001_N3_{r.segment}.edf"]))[0], atol=1e-12)


def test_channel_state_clips(spark, clips):
    folder, _ = clips
    got = cohorts.channel_state_clips(spark, str(folder), "sub-RID0001", "LA1", "N3", 3).orderBy("segment").collect()
    assert [r.segment for r in got] == [0, 2] and all(abs(np.mean(r.samples)) < 1e-12 for r in got)


def test_brainvision_pairs(spark, tmp_path):
    x = np.random.default_rng(1).standard_normal((4000, 3)).astype("<f4")
    (tmp_path / "sub-07_ieeg.eeg").write_bytes(x.tobytes())
    (tmp_path / "sub-07_ieeg.vhdr").write_text("Brain Vision Data Exchange Header File Version 1.0\n[Common Infos]\nDataFile=x.eeg\nDataOrientation=MULTIPLEXED\nNumberOfChannels=3\nSamplingInterval=500\n[Binary Infos]\nBinaryFormat=IEEE_FLOAT_32\n[Channel Infos]\nCh1=LB1,,1,V\nCh2=LB2,,1,V\nCh3=Z9,,1,V\n")
    (row,) = cohorts.brainvision_pairs(spark, str(tmp_path), "z", REGIONS, 2000.0, 300.0).collect()
    y = dsp.detrend(x[:, 0].astype(float) - x[:, 1])
    for f in (300.0, 600.0, 900.0):
        y = dsp.filtfilt(dsp.notch(f, 2000.0), y)
    assert (row.subject, row.channel, row.region, row.sfreq) == ("sub-07", "LB1-LB2", "hippocampal", 1000.0) and np.allclose(row.samples, dsp.decimate(y, 2)[0], atol=1e-9)


def test_heat_rows_keep_the_latest_of_each_slot(spark):
    """A hundred events and forty slots: the first two slots are taken over in turn, and parts of the events in any order give the same."""
    events = spark.createDataFrame([("s", 1, "c", k) for k in range(1, 101)], "subject string, clip int, channel string, nth int").repartition(7)
    epochs = events.select("subject", "clip", "channel", "nth", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("j")).withColumn("so", F.col("nth") * 10.0 + F.col("j") * F.col("j"))
    got = {(r.slot, r.j): r.z for r in quality.heat_rows(events, epochs, 40).collect()}
    assert len(got) == 200
    for slot in range(40):
        nth = max(n for n in range(1, 101) if (n - 1 == slot if n <= 40 else n % 40 == slot and slot < 2))
        x = nth * 10.0 + np.arange(5) ** 2.0
        assert [got[slot, j] for j in range(5)] == pytest.approx(dsp.robust_z(x)[0].tolist())
    flat = quality.heat_rows(events, epochs.withColumn("so", F.when(F.col("j") == 0, 5.0).otherwise(1.0)), 40).where("slot = 3").orderBy("j").collect()
    assert [r.z for r in flat] == pytest.approx(dsp.robust_z(np.array([5.0, 1, 1, 1, 1]))[0].tolist())
