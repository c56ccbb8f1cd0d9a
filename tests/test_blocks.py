"""Filtering by blocks against whole signals, and against a plain recursion."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from phasegrid.functions import dsp
from phasegrid.operators import blocks


def plain(sections, x):
    """One channel, one sample at a time, from the steady state of its first sample."""
    for b0, b1, b2, _, a1, a2 in sections:
        s = (b0 + b1 + b2) / (1 + a1 + a2)
        z1, z2, out = (s - b0) * x[0], (b2 - a2 * s) * x[0], []
        for v in x:
            y = b0 * v + z1
            z1, z2 = b1 * v - a1 * y + z2, b2 * v - a2 * y
            out.append(y)
        x = out
    return np.array(x)


@pytest.mark.parametrize(("low", "high", "rate"), [(0.5, 1.25, 24.0), (0.5, 1.25, 1024.0), (80.0, 120.0, 2000.0), (0.5, 4.0, 500.0)])
def test_stretches_equal_a_recursion(low, high, rate):
    sections = dsp.butter_bandpass(low, high, rate)
    x = np.cumsum(np.random.default_rng(1).standard_normal(1000))
    for n in (5, 63, 64, 65, 1000):
        edge = min(dsp.edge_of(sections), n - 1)
        long = np.concatenate([2 * x[0] - x[edge:0:-1], x[:n], 2 * x[n - 1] - x[n - 2 : n - edge - 2 : -1] if n - edge - 2 >= 0 else 2 * x[n - 1] - x[n - 2 :: -1]])
        want = plain(sections, plain(sections, long)[::-1])[::-1][edge : edge + n]
        assert np.allclose(dsp.filtfilt(sections, x[:n])[0], want, atol=1e-9 * np.abs(x).max(), rtol=0)


def signals_of():
    r = np.random.default_rng(3)
    x = {("a", n): np.cumsum(r.standard_normal(n)) + 0.01 * np.arange(n) for n in (8, 21, 22, 64, 65, 100, 999)}
    return {k: v.tolist() for k, v in x.items()} | {("flat", 50): [2.0] * 50, ("gap", 50): [1.0] * 20 + [float("nan")] + [3.0] * 29, ("short", 7): [1.0, 2.0, 3.0, 1.0, 2.0, 5.0, 1.0], ("none", 0): [], ("null", 0): None}


@pytest.mark.parametrize("size", [4, 30, 64, 5000])
def test_blocks_equal_whole_signals(spark, size):
    x = signals_of()
    df = spark.createDataFrame([(k, n, v) for (k, n), v in x.items()], "name string, n int, samples array<double>")
    cut = blocks.blocks_of_signals(df, ["name", "n"], size=size)
    got = blocks.samples_of_blocks(blocks.bandpassed_blocks(cut, ["name", "n"], 0.5, 1.25, 24.0), ["name", "n"]).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r["name"], r.n, r.i)):
        by.setdefault((r["name"], r.n), []).append(r.x)
    assert set(by) == {k for k in x if k[0] == "a"}
    for k, y in by.items():
        assert np.allclose(y, dsp.bandpass(dsp.detrend(x[k]), 0.5, 1.25, 24.0)[0], atol=1e-9, rtol=0)


def test_blocks_from_samples_begin_anywhere(spark):
    x = np.random.default_rng(4).standard_normal(300)
    rows = spark.createDataFrame([("u", k - 7, float(v)) for k, v in enumerate(x)], "name string, k long, v double")
    got = blocks.samples_of_blocks(blocks.bandpassed_blocks(blocks.blocks_of_samples(rows, ["name"], size=32), ["name"], 0.5, 1.25, 24.0), ["name"]).orderBy("i").collect()
    assert [r.i for r in got] == list(range(300)) and np.allclose([r.x for r in got], dsp.bandpass(dsp.detrend(x), 0.5, 1.25, 24.0)[0], atol=1e-9, rtol=0)


def test_ten_million_samples(spark):
    """At the rate that makes one long polynomial unstable; no row holds more than a block."""
    n = 10_000_000
    wave = F.sin(F.col("id") * 0.005) + F.sin(F.col("id") * 0.9) + F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0
    rows = spark.range(0, n, 1, 8).select(F.lit("u").alias("name"), F.col("id").alias("k"), wave.alias("v"))
    cut = blocks.blocks_of_samples(rows, ["name"], size=blocks.SIZE)
    got = blocks.bandpassed_blocks(cut, ["name"], 0.5, 1.25, 1000.0)
    parts = got.select("start", "samples").toPandas().sort_values("start")
    y = np.concatenate(parts["samples"].to_list())
    x = np.concatenate(cut.select("block", "samples").toPandas().sort_values("block")["samples"].to_list())
    want = dsp.bandpass(dsp.detrend(x), 0.5, 1.25, 1000.0)[0]
    assert len(y) == n and np.abs(y - want).max() < 1e-9 * np.abs(want).max()
