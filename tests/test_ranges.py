"""The range source against whole files, by counting bytes, and on a file that no row could hold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from phasegrid.sources import ranges, recordings
from test_sources import edf


@pytest.fixture(scope="module")
def night(tmp_path_factory):
    r = np.random.default_rng(1)
    x = {f"LA{k}": 300 * r.standard_normal(20 * 50) for k in range(1, 5)}
    path = tmp_path_factory.mktemp("edf") / "night.edf"
    path.write_bytes(edf(x, 50, 20))
    return path, x


@pytest.fixture
def source(spark):
    """A reader of its own for each test: options stay with it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for kind in (ranges.EdfRanges, ranges.EdfFilteredRanges, ranges.EdfDetails):
        spark.dataSource.register(kind)
    yield spark.read.format("edf_filtered_ranges").option("part_s", 6)
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_parts_put_together_are_the_file(spark, source, night):
    path, _ = night
    whole = {r.channel: r.samples for r in recordings.read_edf(spark, str(path)).collect()}
    rows = source.load(str(path)).collect()
    assert sorted({(r.start_s, r.end_s) for r in rows}) == [(0, 6), (6, 12), (12, 18), (18, 20)] and {r.sfreq for r in rows} == {50.0}
    got = {c: np.concatenate([r.samples for r in sorted(rows, key=lambda r: r.start_s) if r.channel == c]) for c in whole}
    assert all(np.allclose(got[c], whole[c], atol=1e-15, rtol=0) for c in whole)


def test_filters_choose_channels_and_times(spark, source, night):
    path, _ = night
    df = source.load(str(path)).where("channel in ('LA2', 'LA4') and start_s >= 6 and end_s < 20")
    assert sorted((r.channel, r.start_s) for r in df.collect()) == [("LA2", 6.0), ("LA2", 12.0), ("LA4", 6.0), ("LA4", 12.0)]
    plain = spark.read.format("edf_ranges").option("part_s", 6)
    asked = plain.option("channels", "LA1").option("from_s", 7).option("to_s", 13).load(str(path)).collect()
    assert sorted((r.start_s, r.end_s, len(r.samples)) for r in asked) == [(7.0, 12.0, 250), (12.0, 13.0, 50)]


class Counting:
    def __init__(self, file):
        self.file, self.read, self.failures = file, 0, 0

    def read_at(self, n, at):
        if self.failures:
            self.failures -= 1
            raise OSError("for a moment")
        self.read += n
        return self.file.read_at(n, at)


def test_only_the_bytes_asked_for_are_read(night, monkeypatch):
    path, x = night
    monkeypatch.setattr(ranges, "GAP", 0)
    monkeypatch.setattr(ranges, "WAIT_S", 0.0)
    file, size = ranges.opened(str(path))
    counted = Counting(file)
    h = ranges.header_of(counted, size)
    assert counted.read == 256 * 5
    counted.read, counted.failures = 0, 2
    (batch,) = ranges.read_part(counted, h, ranges.Part(str(path), 3, 5), {"LA2"})
    assert counted.read == 2 * 50 * 2  # records, samples, bytes
    assert np.allclose(batch.column("samples")[0].values.to_numpy() * 1e6, x["LA2"][150:250], atol=0.02)
    counted.read = 0
    list(ranges.read_part(counted, h, ranges.Part(str(path), 0, 2), None))
    assert counted.read == 2 * h.width


def test_a_store_that_keeps_failing_ends_the_read(night, monkeypatch):
    monkeypatch.setattr(ranges, "WAIT_S", 0.0)
    file, size = ranges.opened(str(night[0]))
    counted = Counting(file)
    counted.failures = ranges.TRIES
    with pytest.raises(OSError):
        ranges.header_of(counted, size)


def test_a_recording_of_more_than_two_gigabytes(spark, source, tmp_path):
    """A sparse file of 3 GB: 60,000 records of one second, 25,000 samples each; two records in its last part are not zero."""
    path = tmp_path / "long.edf"
    rate, seconds = 25_000, 60_000
    head = bytearray(edf({"A": np.zeros(rate)}, rate, 1)[:512])
    head[236:244] = b"-1      "
    with path.open("wb") as f:
        f.write(head)
        f.seek(512 + 2 * rate * 59_990)
        f.write(np.full(2 * rate, 32767, dtype="<i2").tobytes())
        f.truncate(512 + 2 * rate * seconds)
    details = spark.read.format("edf_details").load(str(path)).collect()
    assert [(r.sfreq, r.dur_s, r.n_samples) for r in details] == [(rate, seconds, rate * seconds)]
    part = source.option("part_s", 6).load(str(path)).where("start_s >= 59988 and end_s <= 59994").select("start_s", F.explode("samples").alias("v"))
    top = part.groupBy("start_s").agg(F.count_if(F.col("v") > 9e-4).alias("n"), F.count("*").alias("all")).collect()
    assert [tuple(r) for r in top] == [(59988.0, 2 * rate, 6 * rate)]


def test_folders_and_files_cut_short(spark, source, night, tmp_path):
    raw = night[0].read_bytes()
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.edf").write_bytes(raw)
    (tmp_path / "sub" / "b.edf").write_bytes(raw[: len(raw) - 3 * 50 * 2])  # a record short of three channels
    (tmp_path / "sub" / "c.edf").write_bytes(raw[: 256 * 5])
    rows = source.load(str(tmp_path)).where("channel = 'LA1'").groupBy("path").agg(F.max("end_s").alias("end")).collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.end) for r in rows) == [("a.edf", 20.0), ("b.edf", 19.0)]
    assert spark.read.format("edf_details").load(str(tmp_path)).where("dur_s = 0").count() == 4


def test_written_recordings_come_back(spark, source, tmp_path):
    rows = [("r1", "b", [1.5, -2000.0, 3.0, 4.0, 5.0]), ("r1", "a", [0.25, 0.5]), ("r2", "a", [7.0])]
    df = spark.createDataFrame(rows, "recording string, channel string, samples array<double>")
    assert sorted(r.channels for r in ranges.write_edf(df, str(tmp_path / "out"), 1.0, 2.0, "V").collect()) == [1, 2]
    got = {(r.path[-6:-4], r.channel): r.samples for r in spark.read.format("edf_ranges").load(str(tmp_path / "out")).collect()}
    want = {("r1", "b"): [1.5, -1000.0, 3, 4, 5, 0], ("r1", "a"): [0.25, 0.5, 0, 0, 0, 0], ("r2", "a"): [7.0, 0]}
    assert set(got) == set(want) and all(np.allclose(got[k], want[k], atol=0.016) for k in want)
