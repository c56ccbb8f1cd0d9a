"""Intervals and tests as columns: no group is ever gathered in a task, and no Python runs on the executors.

Bootstrap weights are drawn from a hash of (seed, group, subject, draw), so each
subject's row adds its share to each draw wherever it lies, and the same numbers come
out of any engine with MD5. Exact p-values are folds over the ranks of one row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasegrid.operators import rollup

#: Draws of a bootstrap; a digest serves four.
DRAWS, EACH = 2000, 4
#: Cumulative Poisson probabilities of mean 1, as far as a number of 32 bits can tell.
POISSON = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(13)]
#: Most pairs of an exact signed-rank test.
EXACT = 50
#: Step and terms of the sum for the complementary error function.
ERFC_STEP, ERFC_TERMS = 0.5, 12


def bootstrap(df: DataFrame, keys: Sequence[str], subject: Sequence[str], value: str, draws: int = DRAWS, seed: int = 0) -> DataFrame:
    """``*keys, mean, ci_lo, ci_hi, n``: the mean over subjects and its 2.5 and 97.5 percentiles over resamples.

    In a resample each subject counts a Poisson number of times (mean 1), drawn for
    itself, instead of subjects being drawn until there are as many: partial sums of
    weights and weighted values are all that is shuffled, and what meets for a group
    is ``draws`` numbers. A resample without any subject is left out. ``subject`` names
    a row in its group; rows with the same name get the same weights. Null values
    and NaN are left out; below two values there is no interval.
    """
    by = list(keys) or ["__all"]
    own = df if keys else df.withColumn("__all", F.lit(0))
    own = own.withColumn("__v", F.col(value).cast("double")).where("`__v` is not null and not isnan(`__v`)")
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (*keys, *subject)]
    rows = own.select(*by, "__v", F.concat_ws("|", F.lit(str(seed)), *text).alias("__name"), F.explode(F.sequence(F.lit(0), F.lit(-(-draws // EACH) - 1))).alias("__b"))
    digest = F.md5(F.concat("__name", F.lit("|"), F.col("__b").cast("string")))
    parts = rows.withColumn("__d", digest).select(*by, "__v", "__b", F.posexplode(F.array(*[F.substring("__d", 1 + 8 * k, 8) for k in range(EACH)])).alias("__k", "__hex"))
    u = (F.conv("__hex", 16, 10).cast("double") + 0.5) / 4294967296.0
    weight = sum(((F.col("__u") > p).cast("double") for p in POISSON), F.lit(0.0))
    weighed = parts.where(F.col("__b") * EACH + F.col("__k") < draws).withColumn("__u", u).withColumn("__w", weight)
    means = weighed.groupBy(*by, "__b", "__k").agg((F.sum(F.col("__w") * F.col("__v")) / F.sum("__w")).alias("__m"), F.sum("__w").alias("__all_w")).where("`__all_w` > 0")
    ends = means.groupBy(*by).agg(F.percentile("__m", F.array(F.lit(0.025), F.lit(0.975))).alias("__ci"))
    base = own.groupBy(*by).agg(F.avg("__v").alias("mean"), F.count("*").alias("n"))
    end = lambda k: F.when(F.col("n") >= 2, F.col("__ci")[k])
    return base.join(ends, by, "left").select(*keys, "mean", end(0).alias("ci_lo"), end(1).alias("ci_hi"), "n")


def erfc(x: Column) -> Column:
    """The complementary error function of a number of at least 0, by the trapezoid rule with its pole's correction; good to about 1e-15."""
    h, pi = ERFC_STEP, math.pi
    terms = sum((math.exp(-(((k + 0.5) * h) ** 2)) / (x * x + ((k + 0.5) * h) ** 2) for k in range(ERFC_TERMS)), F.lit(0.0))
    value = 2 * h / pi * x * F.exp(-x * x) * terms + F.when(x < pi / h, 2 / (1 + F.exp(F.least(2 * pi * x / h, F.lit(700.0))))).otherwise(0.0)
    return F.when(x == 0, 1.0).otherwise(value)


def signed_rank_ways(n: Column) -> Column:
    """How many sign patterns of ``n`` ranks have each rank sum, from 0 up."""

    def put(ways: Column, rank: Column) -> Column:
        more = F.array_repeat(F.lit(0.0), rank)
        return F.zip_with(F.concat(ways, more), F.concat(more, ways), lambda a, b: a + b)

    ranks = F.filter(F.sequence(F.lit(0), n.cast("int")), lambda r: r > 0)
    return F.aggregate(ranks, F.array(F.lit(1.0)), put)


def signed_rank_test(df: DataFrame, keys: Sequence[str], difference: str) -> DataFrame:
    """``*keys, n, w, p``: the smaller rank sum of the signed-rank test and its two-sided p.

    Exact up to ``EXACT`` differences without ties and zeros, else by the normal
    form with correction for ties; zeros and nulls are dropped, which ``n`` counts as
    told apart from zero. Groups without a difference that isn't zero give no row.
    """
    by = list(keys) or ["__all"]
    own = df if keys else df.withColumn("__all", F.lit(0))
    sums = rollup.signed_rank(own, by, difference)
    zeros = own.groupBy(*by).agg(F.count_if(F.col(difference) == 0).alias("__zeros"))
    both = sums.join(zeros, by)
    n, w = F.col("n").cast("double"), F.least("w_plus", "w_minus").cast("double")
    counted = F.slice("__ways", F.lit(1), (F.floor(w) + 1).cast("int"))
    exact = F.least(F.lit(1.0), 2 * F.aggregate(counted, F.lit(0.0), lambda s, x: s + x) / F.pow(F.lit(2.0), n))
    spread = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    normal = erfc(F.abs(w - n * (n + 1) / 4) / F.sqrt(2 * spread))
    can = (F.col("n") <= EXACT) & (F.col("ties") == 0) & (F.col("__zeros") == 0)
    ways = F.when(can, signed_rank_ways(F.least(F.col("n"), F.lit(EXACT))))
    return both.withColumn("__ways", ways).select(*keys, "n", w.alias("w"), F.when(can, exact).otherwise(normal).alias("p"))


def rank_sum_p(u: Column, a: Column, b: Column, ties: Column) -> Column:
    """Two-sided normal p of a rank sum, corrected for continuity and for ties (sum of t^3 - t); 1 where all values are equal."""
    n, product = (a + b).cast("double"), a.cast("double") * b
    spread = product / 12 * (n + 1 - F.try_divide(ties.cast("double"), n * (n - 1)))
    z = (F.greatest(u, product - u) - product / 2 - 0.5) / F.sqrt(spread)
    return F.when(spread > 0, F.least(F.lit(1.0), F.when(z >= 0, erfc(F.greatest(z, F.lit(0.0)) / math.sqrt(2))).otherwise(1.0))).otherwise(1.0)
