"""The long layout against kernels over whole arrays, and rules against a plain pass."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from phasegrid.functions import dsp
from phasegrid.operators import samples

SIZES = (5, 24, 191, 192, 193, 700)


@pytest.fixture(scope="module")
def signals():
    r = np.random.default_rng(2)
    return {("a", n): np.cumsum(r.standard_normal(n)) + 5 for n in SIZES} | {("flat", 30): np.full(30, 2.0)}


@pytest.fixture(scope="module")
def rows(spark, signals):
    data = [(a, n, k - 3, float(v)) for (a, n), x in signals.items() for k, v in enumerate(x)] + [("odd", 0, 0, 1.0), ("odd", 0, 1, None), ("odd", 0, 2, 3.0), ("nan", 0, 0, float("nan")), ("nan", 0, 1, 3.0)]
    return spark.createDataFrame(data, "name string, size_of int, k long, v double").repartition(7)


KEYS = ["name", "size_of"]


def test_welch_and_shares(rows, signals):
    numbered = samples.numbered(rows, KEYS, detrend=True)
    powers = samples.welch(numbered, KEYS, 192, 24.0)
    got = {}
    for r in powers.orderBy("f").collect():
        got.setdefault((r["name"], r.size_of), []).append((r.hz, r.power))
    assert set(got) == {k for k in signals if k[0] == "a"}
    bands = {"slow": (0.5, 1.25), "none": (11.0, 11.05), "all": (0.5, 10.0)}
    shares = {(r["name"], r.size_of): r for r in samples.band_shares(powers, KEYS, bands, (0.5, 10.0)).collect()}
    for key, pairs in got.items():
        f, p = dsp.welch(dsp.detrend(signals[key]), 24.0, 192)
        assert np.allclose(pairs, np.stack([f, p[0]], axis=1), atol=1e-9)
        whole = dsp.band_area(f, p, 0.5, 10.0)[0]
        for name, b in bands.items() if whole > 0 else ():
            assert shares[key][name] == pytest.approx(dsp.band_area(f, p, *b)[0] / whole, abs=1e-9)


@pytest.mark.parametrize(("up", "down"), [(1, 4), (1, 2), (3, 2), (2, 2)])
def test_resampling(rows, signals, up, down):
    half = 10 * max(up, down)
    taps = dsp.lowpass_taps(2 * half + 1, 1.0 / max(up, down), np.kaiser(2 * half + 1, 5.0))
    got = {}
    for r in samples.resampled(samples.numbered(rows, KEYS), KEYS, up, down, taps).orderBy("i").collect():
        got.setdefault((r["name"], r.size_of), []).append(r.v)
    assert set(got) == {k for k in signals if k[0] == "a"}
    for key, y in got.items():
        assert np.allclose(y, dsp.resample(signals[key], up, down)[0], atol=1e-9)


def one_pass(x, height, distance):
    """Plateaus and distances told one after the other."""
    peaks, k = [], 1
    while k < len(x) - 1:
        end = k
        while end < len(x) - 1 and x[end + 1] == x[k]:
            end += 1
        if x[k] > x[k - 1] and end < len(x) - 1 and x[k] > x[end + 1]:
            peaks.append((k + end) // 2)
        k = end + 1
    left, kept = [p for p in peaks if x[p] >= height], []
    for p in sorted(left, key=lambda p: (x[p], p), reverse=True):
        if all(abs(p - q) >= distance for q in kept):
            kept.append(p)
    return sorted(kept)


@pytest.mark.parametrize(("distance", "block"), [(1, 4096), (4, 1), (4, 3), (9.5, 4096), (40, 1)])
def test_peaks_equal_one_pass(spark, monkeypatch, distance, block):
    monkeypatch.setattr(samples, "BLOCK", block)
    r = random.Random(4)
    signals = {k: [float(r.randrange(5)) for _ in range(n)] for k, n in enumerate((3, 10, 100, 400))} | {9: [float(k % 10 if k < 150 else 20 - k % 7) + k / 20 for k in range(200)], 10: [1.0] * 20}
    rows = spark.createDataFrame([(s, k, v) for s, x in signals.items() for k, v in enumerate(x)], "s int, k long, v double").repartition(5)
    got = samples.apart(samples.local_maxima(rows, ["s"], height=1.0), ["s"], distance).orderBy("s", "at").collect()
    assert [(r.s, r.at) for r in got] == [(s, p) for s, x in signals.items() for p in one_pass(x, 1.0, distance)]
    assert all(r.height == signals[r.s][r.at] for r in got)


def test_scores(rows, signals):
    got = samples.scored(samples.numbered(rows, KEYS), KEYS).where("size_of = 700").orderBy("i").agg(F.collect_list("v")).first()[0]
    assert np.allclose(got, dsp.zscore(signals["a", 700])[0], atol=1e-9)
