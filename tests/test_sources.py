"""Readers on files made here."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from phasegrid.operators import rollup
from phasegrid.sources import names, recordings


def edf(channels, rate, seconds):
    """An EDF file of one-second records; digital range of 16 bits over -1000..1000 uV."""
    n = len(channels)
    pad = lambda v, w: str(v).encode()[:w].ljust(w)
    head = pad(0, 8) + pad("", 80) + pad("", 80) + pad("01.01.24", 8) + pad("00.00.00", 8) + pad(256 * (n + 1), 8) + pad("", 44) + pad(seconds, 8) + pad(1, 8) + pad(n, 4)
    for width, value in ((16, None), (80, ""), (8, "uV"), (8, -1000), (8, 1000), (8, -32768), (8, 32767), (80, ""), (8, rate), (32, "")):
        head += b"".join(pad(c if value is None else value, width) for c in channels)
    data = [np.round((np.clip(x, -1000, 1000) + 1000) / 2000 * 65535 - 32768).astype("<i2").reshape(seconds, rate) for x in channels.values()]
    return head + np.concatenate(data, axis=1).tobytes()


def test_edf(spark, tmp_path):
    t = np.arange(0, 3, 1 / 100)
    x = {"LA1": 100 * np.sin(t), "LA2": 50 * np.cos(t)}
    (tmp_path / "sub-RID0031_N3_7.edf").write_bytes(edf(x, 100, 3))
    (tmp_path / "sub-RID0031_N3_8.edf").write_bytes(b"broken")
    got = recordings.read_edf(spark, str(tmp_path)).collect()
    good = {r.channel: r for r in got if r.error is None}
    assert set(good) == {"LA1", "LA2"} and len([r for r in got if r.error]) == 1
    assert good["LA1"].sfreq == 100 and np.allclose(np.array(good["LA1"].samples) * 1e6, x["LA1"], atol=0.02)
    index = names.clip_index(recordings.read_edf(spark, str(tmp_path)).where("error is null"), "path").select("pt", "state", "idx").distinct().collect()
    assert [tuple(r) for r in index] == [("sub-RID0031", "N3", 7)]


@pytest.mark.parametrize(("kind", "dtype"), [("INT_16", "<i2"), ("IEEE_FLOAT_32", "<f4")])
def test_brainvision(spark, tmp_path, kind, dtype):
    x = np.arange(20).reshape(10, 2).astype(dtype)
    (tmp_path / "sub-01.eeg").write_bytes(x.tobytes())
    (tmp_path / "sub-01.vhdr").write_text(f"Brain Vision Data Exchange Header File Version 1.0\n[Common Infos]\nDataFile=sub-01.eeg\nDataOrientation=MULTIPLEXED\nNumberOfChannels=2\nSamplingInterval=500\n[Binary Infos]\nBinaryFormat={kind}\n[Channel Infos]\nCh1=AL1,,0.5,µV\nCh2=AL2,,1,µV\n")
    got = {r.channel: r for r in recordings.read_brainvision(spark, str(tmp_path)).collect()}
    assert got["AL1"].sfreq == 2000 and np.allclose(got["AL1"].samples, x[:, 0] * 0.5e-6) and np.allclose(got["AL2"].samples, x[:, 1] * 1e-6)


def test_npz(spark, tmp_path):
    np.savez(tmp_path / "block_0000.npz", data=np.ones((5, 2), dtype=np.float32), ch_names=np.array(["a", "b"]), sfreq=4.0, start_sec=30.0)
    got = recordings.read_npz(spark, str(tmp_path)).orderBy("channel").collect()
    assert [(r.channel, r.sfreq, r.start_s, r.samples) for r in got] == [("a", 4.0, 30.0, [1.0] * 5), ("b", 4.0, 30.0, [1.0] * 5)]


def test_metadata_rules(spark, tmp_path):
    (tmp_path / "m.csv").write_text("pt,name,final_label,reg,ch1_soz,ch2_soz\np,A1,left parahippocampal,,false,\np,A2,left hippocampus,,,\np,A3,entorhinal,,true,\np,A4,,ParaHippocampal_L,,\np,A5,,parahippocampal_L,,\np,A6,x,,,true\np,A7,nothing,,,\np,A8,left middle temporal gyrus,,,\np,A9,temporal pole,,,\np,A10,,Temporal_Mid_L,,\np,A11,,Temporal_Pole_Sup_L,,\np,A12,,Entorhinal_L,,\n")
    m = recordings.read_metadata(spark, str(tmp_path / "m.csv"))
    kept = rollup.normative(m, ["ch1_soz", "ch2_soz", "ch1_resected", "ch2_resected"])
    got = {r["name"]: r.roi for r in kept.select("name", rollup.first_match(rollup.ROI_RULES, F.col("final_label"), F.col("reg")).alias("roi")).collect()}
    assert got == {"A1": "parahippocampal", "A2": "hippocampal", "A4": "parahippocampal", "A5": None, "A7": None, "A8": "temporal_neocortex", "A9": None, "A10": "temporal_neocortex", "A11": None, "A12": None}


def test_tsv_and_ranges(spark, tmp_path):
    (tmp_path / "sub-02_run-01_events.tsv").write_text("onset\ttrial_type\n1.5\tripple_AL1-2\nn/a\tfr_AL1-2\n")
    e = recordings.read_tsv(spark, str(tmp_path), "onset double, sample long, trial_type string").select("onset", recordings.sample_of(rate=500.0).alias("at"), recordings.subject_of().alias("sub"))
    assert sorted(map(tuple, e.collect()), key=repr) == sorted([(1.5, 750, "sub-02"), (None, None, "sub-02")], key=repr)
    parts = recordings.ranges(spark.createDataFrame([("r", 1300.0), ("z", 0.0)], "id string, dur_s double")).collect()
    assert sorted((r.part_start_s, r.part_dur_s) for r in parts) == [(0.0, 600.0), (600.0, 600.0), (1200.0, 100.0)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0)], "subject string, x double")
    recordings.write_blocks(df, str(tmp_path / "blocks"))
    assert spark.read.parquet(str(tmp_path / "blocks")).where("subject = 'a'").count() == 1
    for form in ("csv", "json", "parquet"):
        recordings.write_table(df, str(tmp_path / form), form)
        assert spark.read.option("header", True).format(form).load(str(tmp_path / form)).count() == 1
