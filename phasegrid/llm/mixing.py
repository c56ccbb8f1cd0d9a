"""Mixing sources to target weights by Poisson replication.

Every document draws its number of copies from a Poisson distribution whose mean
is its source's target repetition rate. The draw inverts the distribution at a
uniform number hashed from seed and document, so it needs no random state and
comes out the same on any retry or partitioning. A large mean is split into equal
parts with draws of their own, whose sum has the distribution of the whole. Copies are then dealt out and
sorted by a hash, which is a global shuffle without sampling the input.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasegrid.llm.store import materialise

#: Largest mean of one draw: with it exp(-rate) is well above zero and the inversion has a fixed number of steps.
MAX_RATE, STEPS = 64.0, 160
BROADCAST_SOURCES = 100_000


def uniform(seed: int, *key: Column) -> Column:
    """A number in (0, 1) hashed from seed and key: 32 bits of MD5, taken at the middle of their interval."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("")) for k in key])
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def poisson_quantile(u: Column, rate: Column) -> Column:
    """The least k with P(X <= k) >= u for X ~ Poisson(rate), rate <= MAX_RATE; k is at most STEPS."""
    # the state holds number and rate, so that what they are made of is worked out once and not at each step
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("cdf"), F.lit(0).alias("k"), u.alias("u"), rate.alias("rate"))

    def step(s: Column, i: Column) -> Column:
        p = s["p"] * s["rate"] / i
        return F.when(s["cdf"] >= s["u"], s).otherwise(F.struct(p.alias("p"), (s["cdf"] + p).alias("cdf"), i.alias("k"), s["u"].alias("u"), s["rate"].alias("rate")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda s: s["k"])


def poisson_copies(seed: int, key: list[Column], rate: Column) -> Column:
    """A draw from Poisson(rate) for any rate: the sum of draws from its equal parts of ``MAX_RATE`` at most.

    The first part is hashed from seed and key alone, each other one from its number as well.
    """
    parts = F.greatest(F.lit(1), F.ceil(rate / MAX_RATE).cast("int"))
    each = rate / parts
    rest = F.aggregate(F.sequence(F.lit(2), parts), F.lit(0), lambda n, i: n + poisson_quantile(uniform(seed, *key, i), each))
    return poisson_quantile(uniform(seed, *key), each) + F.when(parts > 1, rest).otherwise(0)


def mix_sources(
    docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, total: float | None = None, seed: int = 17,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", with_rates: bool = False,
) -> DataFrame:
    """Replicate documents so that sources occur in the target weights, in shuffled order.

    ``weights``: target share by source (any positive scale; a source that is not
    named gets none). Without them a source's weight is its row count to ``power``.
    ``total``: expected number of rows out, the input's by default. A source of n
    rows gets the rate total * share / n, however large it is.

    All columns of ``docs`` are kept; with ``with_rates`` also ``mix_rate,
    copy_index, shuffle_key``, which replace columns so named. A null source is
    the source ''. What a row draws and where its copies go is hashed from its id,
    source and text (if there is one), so rows without an id, or with one id, are drawn each for
    itself; rows equal in all three draw the same number. An empty table gives an
    empty result.

    Rates are joined from one row for each source. They are broadcast for at most
    ``BROADCAST_SOURCES`` sources, so the hot source's documents stay where they
    are; beyond that both sides are tables that a skewed join can split.
    """
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    # the join key has a name of its own, so that a column of docs can't clash with it
    sizes = docs.groupBy(source.alias("__source")).agg(F.count("*").alias("__n"))
    if weights is None:
        sizes = sizes.withColumn("__w", F.pow(F.col("__n").cast("double"), F.lit(float(power))))
    else:
        named = docs.sparkSession.createDataFrame([(str(k), float(v)) for k, v in sorted(weights.items())], "__source string, __w double")
        sizes = sizes.join(named, "__source", "left").na.fill(0.0, ["__w"])
    sizes = materialise(sizes, "sources")
    sources, all_weight, all_rows = sizes.agg(F.count("*"), F.sum("__w"), F.sum("__n")).first()
    wanted = float(total if total is not None else all_rows or 0)
    rate = F.try_divide(F.lit(wanted) * F.col("__w"), F.lit(float(all_weight or 0)) * F.col("__n"))
    rates = sizes.select("__source", F.coalesce(rate, F.lit(0.0)).alias("__rate"))
    if sources <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)

    columns = [F.col(f"`{c}`") for c in docs.columns if not (with_rates and c in ("mix_rate", "copy_index", "shuffle_key"))]
    drawn = docs.withColumn("__source", source).join(rates, "__source")
    drawn = drawn.withColumn("__text", F.md5(F.coalesce(F.col(text_col), F.lit("")) if text_col in docs.columns else F.lit("")))
    drawn = drawn.withColumn("__copies", poisson_copies(seed, [F.col(id_col), F.col("__source"), F.col("__text")], F.col("__rate")))
    spread = drawn.where("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    spread = spread.withColumn("__key", F.md5(F.concat_ws("|", F.lit(str(seed + 1)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col("__source"), F.col("__text"), F.col("__copy").cast("string"))))
    out = spread.repartition("__key").sortWithinPartitions("__key")
    extra = [F.col("__rate").alias("mix_rate"), F.col("__copy").alias("copy_index"), F.col("__key").alias("shuffle_key")] if with_rates else []
    return out.select(*columns, *extra)


def expected_share(counts: dict[str, int], power: float = 0.5) -> dict[str, float]:
    """The shares that ``power`` aims at, for reports and tests."""
    raised = {k: math.pow(n, power) for k, n in counts.items()}
    return {k: v / sum(raised.values()) for k, v in raised.items()}
