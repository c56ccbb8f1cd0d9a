"""Intervals and p-values against published numbers, plain versions and enumeration."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from phasegrid.functions import stats
from phasegrid.operators import inference


def test_erfc(spark):
    x = [0.0, 1e-9, 0.3, 1.0, 2.5, 6.28, 6.29, 9.0, 26.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(inference.erfc(F.col("x"))).collect()]
    assert got == pytest.approx([math.erfc(v) for v in x], rel=1e-13, abs=1e-300)


def told(spark, groups):
    rows = [(k, float(v) if v is not None else None) for k, d in groups.items() for v in d]
    return {r.k: (r.n, r.w, r.p) for r in inference.signed_rank_test(spark.createDataFrame(rows, "k string, d double"), ["k"], "d").collect()}


def test_published_signed_rank_values(spark):
    """Fifteen pairs: all positive, and those with a rank sum of 8 against, have the published p of 6.1035e-5 and 0.0015259."""
    got = told(spark, {"all": range(1, 16), "some": [-1, -2, -5, *(k for k in range(1, 16) if k not in (1, 2, 5))]})
    assert got["all"] == (15, 0.0, pytest.approx(6.103515625e-05, rel=1e-12))
    w = got["some"][1]
    ways = sum(sum(r for r in c) <= w for n in range(16) for c in itertools.combinations(range(1, 16), n))
    assert got["some"] == (15, 8.0, pytest.approx(2 * ways / 2**15, rel=1e-12)) and got["some"][2] == pytest.approx(0.0015259, abs=5e-8)


def test_signed_rank_equals_plain_version(spark):
    r = random.Random(3)
    groups = {f"n{n}": [r.gauss(0.3, 1) for _ in range(n)] for n in (1, 2, 7, 30, 50, 51, 80)}
    groups |= {"ties": [r.randrange(-3, 5) for _ in range(40)], "zero": [0.0, 1.0, 2.0, -3.0, 4.5, None], "nothing": [0.0, None]}
    got = told(spark, groups)
    assert set(got) == set(groups) - {"nothing"}
    for k, (n, w, p) in got.items():
        x = np.array([v for v in groups[k] if v is not None], dtype=float)
        assert (w, p) == pytest.approx(stats.wilcoxon(x), rel=1e-9) and n == (x != 0).sum()


def test_rank_sum_p(spark):
    rows = [(3.0, 4, 5, 0.0), (10.0, 4, 5, 6.0), (0.0, 30, 20, 60.0), (0.5, 1, 1, 6.0), (300.0, 30, 20, 0.0)]
    got = spark.createDataFrame(rows, "u double, a long, b long, ties double").select(inference.rank_sum_p(*map(F.col, ("u", "a", "b", "ties")))).collect()
    for (u, a, b, ties), r in zip(rows, got, strict=True):
        spread = a * b / 12 * (a + b + 1 - ties / ((a + b) * (a + b - 1)))
        z = (max(u, a * b - u) - a * b / 2 - 0.5) / math.sqrt(spread) if spread > 0 else 0
        assert r[0] == pytest.approx(min(1.0, math.erfc(z / math.sqrt(2))), rel=1e-10)


def plain_bootstrap(key, rows, draws, seed):
    """(mean, low, high) by the documented draw."""
    means = []
    for d in range(draws):
        total = weight = 0.0
        for subject, v in rows:
            digest = hashlib.md5(f"{seed}|{key}|{subject}|{d // 4}".encode()).hexdigest()
            u = (int(digest[8 * (d % 4) : 8 * (d % 4) + 8], 16) + 0.5) / 2**32
            w, p, cdf = 0, math.exp(-1), math.exp(-1)
            while u > cdf and w < 13:
                w += 1
                p /= w
                cdf += p
            total, weight = total + w * v, weight + w
        if weight:
            means.append(total / weight)
    return [np.mean([v for _, v in rows]), *(np.percentile(means, [2.5, 97.5]) if len(rows) > 1 else [None, None])]


def test_bootstrap_equals_plain_version(spark):
    r = random.Random(1)
    groups = {"a": [(k, r.gauss(5, 2)) for k in range(15)], "b": [(0, 1.0), (1, 3.0)], "one": [(7, 4.0)]}
    rows = [(k, s, v) for k, g in groups.items() for s, v in g] + [("a", 99, None), ("a", 98, float("nan")), ("none", 1, None)]
    got = {x.k: x for x in inference.bootstrap(spark.createDataFrame(rows, "k string, s int, v double").repartition(5), ["k"], ["s"], "v", draws=101, seed=4).collect()}
    assert set(got) == set(groups)
    for k, g in groups.items():
        assert [got[k]["mean"], got[k].ci_lo, got[k].ci_hi] == pytest.approx(plain_bootstrap(k, g, 101, 4)) and got[k].n == len(g)
    whole = inference.bootstrap(spark.createDataFrame(rows, "k string, s int, v double"), [], ["k", "s"], "v", draws=20).collect()
    assert len(whole) == 1 and whole[0].n == 18


def test_bootstrap_covers_the_mean(spark):
    """Of 200 groups of 40 normal values, about 95 percent of the intervals hold the true mean, and they are as wide as resampling makes them."""
    r = np.random.default_rng(2)
    x = r.normal(1.0, 1.0, (200, 40))
    df = spark.createDataFrame([(g, s, float(v)) for g, row in enumerate(x) for s, v in enumerate(row)], "g int, s int, v double")
    got = inference.bootstrap(df, ["g"], ["s"], "v", draws=400).toPandas()
    held = ((got.ci_lo <= 1) & (got.ci_hi >= 1)).mean()
    plain = [np.subtract(*stats.bootstrap_ci(row, draws=400)[::-1]) for row in x]
    assert 0.88 <= held <= 0.99 and (got.ci_hi - got.ci_lo).mean() == pytest.approx(np.mean(plain), rel=0.05)


def test_no_group_is_gathered(spark):
    df = spark.range(10).selectExpr("id % 2 AS k", "id AS s", "rand() AS v")
    plan = inference.bootstrap(df, ["k"], ["s"], "v")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "partial_sum" in plan


@pytest.mark.parametrize("fit", [1, 7, 100_000])
def test_exact_percentiles(spark, monkeypatch, fit):
    from phasegrid.operators import rollup

    monkeypatch.setattr(rollup, "FIT", fit)
    monkeypatch.setattr(rollup, "RANGES", 4)
    r = random.Random(5)
    groups = {"a": [r.gauss(0, 1) for _ in range(300)], "b": [float(r.randrange(6)) for _ in range(200)], "c": [4.0], "d": [1.0, 2.0]}
    rows = [(k, 1, v) for k, x in groups.items() for v in x] + [("a", 1, None), ("none", 1, None)]
    shares = (0.0, 0.025, 0.5, 0.975, 1.0)
    df = spark.createDataFrame(rows, "k string, n int, v double").repartition(4).drop("n")
    got = {x.k: x for x in rollup.exact_percentiles(df, ["k"], "v", shares).collect()}
    assert set(got) == set(groups)
    for k, x in groups.items():
        assert got[k].percentiles == pytest.approx(np.percentile(x, [100 * s for s in shares])) and got[k].n == len(x)
    whole = rollup.exact_percentiles(df, [], "v", [0.5]).collect()
    assert len(whole) == 1 and whole[0].percentiles[0] == pytest.approx(np.median([v for _, _, v in rows if v is not None]))
