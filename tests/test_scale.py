"""What has to hold for large tables: plans without joins of spread-out rows, kernels in pieces, gaps filled from knots, percentiles by the SQL's rule."""

import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from phasegrid.functions import dsp
from phasegrid.operators import blocks, coupling, rollup
from phasegrid.operators import events as ev
from phasegrid.plans import catalog, event_queries, kernel_queries

DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def plan_run(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_averages_of_windows_join_nothing(spark):
    """Windows were found by joining a row for each of their points, which Spark took for a small table and broadcast."""
    assert "Join" not in plan(catalog.QUERIES["qc_averages"](spark, DIR)).replace("LeftOuter", "")


def test_heat_rows_cut_only_the_windows_they_keep(spark, monkeypatch):
    cut = []
    own = kernel_queries.quality.event_epochs
    monkeypatch.setattr(kernel_queries.quality, "event_epochs", lambda *a, **k: cut.append(own(*a, **k)) or cut[-1])
    rows = catalog.QUERIES["qc_heat_rows"](spark, DIR).count()
    assert cut[0].count() == rows


def test_example_and_long_traces_have_no_row_for_each_sample(spark):
    for name in ("qc_summary", "qc_long_traces"):
        assert "sp_z#" in plan(catalog.QUERIES[name](spark, DIR)) and "posexplode" not in plan(catalog.QUERIES[name](spark, DIR)), name


def test_staged_hours_meet_the_threshold_as_in_sql(spark, tmp_path):
    """101 hours: the percentile is the 56th value and a bit of rounding."""
    r = np.random.default_rng(0)
    (tmp_path / "t").mkdir()
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    table = pa.table({"user_id": np.repeat(np.arange(400), 101), "k": np.tile(np.arange(101), 400), "value": np.round(r.uniform(0, 200, 40400), 2) / r.choice([1, 2, 3], 40400)})
    con.execute(f"COPY (SELECT row_number() OVER () AS event_id, TIMESTAMP '2024-01-01' + k * INTERVAL 1 HOUR AS ts, user_id, 'view' AS event_type, value, '' AS props FROM \"table\") TO '{tmp_path}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = con.execute(catalog.ORACLES["percentile_stage"]).fetchall()
    got = catalog.QUERIES["percentile_stage"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_percentile_of_a_column(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 4.0), ("b", None), ("c", 7.0)], "k string, v double")
    got = {r.k: r.p for r in rollup.with_percentile(df, ["k"], "v", 0.5, "p").collect()}
    assert got == {"a": 2.5, "b": None, "c": 7.0}


def test_kernels_take_pieces_of_a_batch():
    """A batch went through the kernels whole, whatever its rows."""
    rows = pa.array([np.arange(720.0) for _ in range(1000)] + [None, np.zeros(0), np.arange(8.0)], pa.list_(pa.float64()))
    sizes = [p.num_rows for p in coupling.by_length(pa.RecordBatch.from_arrays([rows], ["x"]), 0)]
    assert sum(sizes) == 1001 and max(sizes) * 720 <= coupling.PIECE
    use, x = coupling._stacked(pa.array([None, [1.0, None], [1.0, 3.0], [2.0, 2.0], [], [5.0], [float("nan"), 1.0], [4.0, 1.0]], pa.list_(pa.float64())))
    assert use.tolist() == [2, 7] and x.tolist() == [[1.0, 3.0], [4.0, 1.0]]


def test_filters_are_worked_out_once_in_a_process():
    assert dsp.state_space(dsp.butter_bandpass(1, 2, 24)) is dsp.state_space(dsp.butter_bandpass(1, 2, 24))


@pytest.fixture(scope="module")
def gaps(spark):
    rows = [(1, 2.5, 4.0), (1, 2.6, 6.0), (1, 7.0, 1.0), (1, 9.0, None), (2, 3.0, None), (2, 5.0, None), (3, 0.0, None), (3, 4.0, 2.0), (3, 8.0, float("nan")), (4, 1.0, 3.0), (None, 1.0, 3.0), (None, 3.0, 4.0), (4, None, 9.0)]
    return spark.createDataFrame(rows, "u int, t double, x double").repartition(5)


def test_knots_give_the_filled_grid(gaps):
    want = ev.interpolated(ev.on_grid(gaps, ["u"], "t", "x", 1.0), ["u"]).select("u", "k", "v", "filled")
    got = ev.spread(ev.knots(gaps, ["u"], "t", "x", 1.0), ["u"])
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_blocks_of_knots(gaps):
    own = ev.knots(gaps, ["u"], "t", "x", 1.0)
    want = blocks.blocks_of_samples(ev.spread(own, ["u"]), ["u"], "k", "filled", 3)
    assert sorted(map(repr, blocks.blocks_of_knots(own, ["u"], 3).collect())) == sorted(map(repr, want.collect()))


def test_hours_are_shuffled_as_events_only(spark):
    """The grid was shuffled and sorted as a row for each hour, twice."""
    for name in ("hours", "recordings"):
        text = getattr(kernel_queries, name)(spark, DIR)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [user_id" not in text.split("marks")[0] or name == "recordings", name
    assert event_queries.HOUR == 3600.0 and "Join" not in plan(kernel_queries.hours(spark, DIR))


def test_recordings_written_without_looking_up_each_hour(spark, monkeypatch):
    """Each hour was looked up in a map of all others."""
    seen = []
    own = kernel_queries.ranges.write_edf
    monkeypatch.setattr(kernel_queries.ranges, "write_edf", lambda df, *a: seen.append(df) or own(df, *a))
    assert catalog.QUERIES["edf_range_scan"](spark, DIR).count() and "map_from_entries" not in plan(seen[0])
    lengths = seen[0].select(F.size("samples").alias("n")).distinct().collect()
    assert len(lengths) == 1


def rows_of_joins(df):
    """Rows that each join of a collected frame gave."""
    found, left = [], [df._jdf.queryExecution().executedPlan()]
    while left:
        p = left.pop()
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            left.append(p.executedPlan())
        elif name.endswith("QueryStage"):
            left.append(p.plan())
        else:
            left += [p.children().apply(k) for k in range(p.children().size())]
            if "Join" in name:
                found.append(p.metrics().apply("numOutputRows").value())
    return found


def test_rank_sums_have_no_row_for_each_pair_of_groups(spark):
    """Each value was copied for every other group, in one task where the values were few enough to be broadcast."""
    values = spark.range(6000).select((F.col("id") % 12).alias("g"), F.xxhash64("id").alias("v"))
    u = rollup.rank_sum(values, [], "g", "v")
    assert len(u.collect()) == 66
    assert max(rows_of_joins(u)) <= 6000


@pytest.mark.parametrize("fit", [7, 100_000])
def test_rank_sums_over_ranges(spark, monkeypatch, fit):
    """More groups than are counted side by side, ties, keys of very different sizes, NaN, nulls, and ranges of a few values."""
    monkeypatch.setattr(rollup, "FIT", fit)
    r = np.random.default_rng(1)
    rows = [("big", f"g{r.integers(19):02}", float(v)) for v in r.integers(0, 90, 700)]
    rows += [("small", g, v) for g, v in (("x", 1.0), ("y", 1.0), ("y", float("nan")), ("x", float("nan")), ("z", -0.0), ("x", 0.0), ("z", None), ("w", None), (None, 3.0))]
    rows += [("alone", "x", 1.0), (None, "x", 1.0), (None, "y", 2.0)]
    got = {(x.k, x.a, x.b): (x.n_a, x.n_b, x.u, x.ties) for x in rollup.rank_sum(spark.createDataFrame(rows, "k string, g string, v double"), ["k"], "g", "v").collect()}
    sides = {}
    for k, g, v in rows:
        if k is not None and g is not None and v is not None:
            sides.setdefault((k, g), []).append(np.inf if np.isnan(v) else v)
    want = {}
    for (k, a), x in sides.items():
        for (other, b), y in sides.items():
            if k == other and a < b:
                sizes = np.unique([*x, *y], return_counts=True)[1].astype(float)
                want[k, a, b] = (len(x), len(y), sum((p > q) + (p == q) / 2 for p in x for q in y), float(np.sum(sizes**3 - sizes)))
    assert got == want and len(want) == 171 + 3
    assert rollup.rank_sum(spark.createDataFrame([], "k string, g string, v double"), [], "g", "v").count() == 0


def test_running_counts_do_not_bring_a_key_together(spark, monkeypatch):
    """Values were shuffled by their key to meet their cuts."""
    monkeypatch.setattr(rollup, "FIT", 50)
    hist = spark.range(400).select((F.col("id") % 7 == 0).alias("k"), F.pmod(F.xxhash64("id"), F.lit(10**6)).alias("v"), (F.col("id") % 3 + 1).alias("c")).groupBy("k", "v").agg(F.sum("c").alias("c"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for tables beyond it
    try:
        got = rollup.with_running_counts(hist, ["k"], "v", ["c"])
        found = {(r.k, r.v): r.below_c for r in got.collect()}
        assert not re.search(r"(SortMerge|ShuffledHash)Join \[k#\d+\]", plan_run(got))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    rows = hist.collect()
    want = {(r.k, r.v): sum(x.c for x in rows if x.k == r.k and x.v < r.v) for r in rows}
    assert found == want
