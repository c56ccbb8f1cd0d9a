"""Relational roll-ups: means of means, paired states, rank statistics, metadata rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phasegrid.session import written

# Regions, patterns of the lower-case label, patterns of the code; in the order they are tried.
ROI_RULES = [
    ("entorhinal", ["entorhinal"], []),
    ("parahippocampal", ["parahippocampal"], ["ParaHippocampal"]),
    ("hippocampal", ["hippocamp"], ["Hippocampus"]),
    ("amygdala", ["amygdala"], ["Amygdala"]),
    ("temporal_neocortex", ["middle temporal", "superior temporal", "inferior temporal"], ["Temporal_Mid", "Temporal_Sup", "Temporal_Inf"]),
]


def first_match(rules: Sequence[tuple[str, Sequence[str], Sequence[str]]], label: Column, code: Column | None = None) -> Column:
    """The first rule of which a pattern is in the lower-case label, or a code pattern in the code as it is; null without any."""
    out = None
    for name, in_label, in_code in rules:
        hit = F.lit(False)
        for p in in_label:
            hit = hit | F.coalesce(F.lower(label).contains(p), F.lit(False))
        for p in in_code if code is not None else ():
            hit = hit | F.coalesce(code.contains(p), F.lit(False))
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out


def normative(channels: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Channels none of whose flags is true; a null or missing flag counts as false."""
    for f in flags:
        if f in channels.columns:
            channels = channels.where(~F.coalesce(F.col(f).cast("boolean"), F.lit(False)))
    return channels


def mean_of_means(df: DataFrame, levels: Sequence[Sequence[str]], value: str) -> DataFrame:
    """``*levels[-1], value, n``: averages over ever coarser keys, each over the averages before it (not weighted by their counts)."""
    for keys in levels:
        df = df.groupBy(*keys).agg(F.avg(value).alias(value), F.count(value).alias("n"))
    return df


def paired_states(df: DataFrame, keys: Sequence[str], state: str, value: str, states: Sequence[str]) -> DataFrame:
    """A column for each state; keys without a value in all of them are left out."""
    return df.groupBy(*keys).pivot(state, list(states)).agg(F.avg(value)).dropna(subset=list(states))


#: Distinct values of a key that are put in order in one task.
FIT = 100_000


def in_ranges(hist: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``hist`` with ``__range``: ranges of a key's values, ascending, each with about ``FIT`` rows at most; equal values share one.

    ``hist`` is counted and read again, so it has to be written. Keys that fit one range have
    no cuts, and the others one for each ``FIT`` rows: that is what is broadcast.
    """
    names = list(keys)
    most = hist.groupBy(*names).count().agg(F.max("count")).first()[0] or 0
    if most <= FIT:
        return hist.withColumn("__range", F.lit(0))
    ranges = most // FIT + 1
    shares = F.array(*[F.lit(k / ranges) for k in range(1, ranges)])
    cuts = hist.groupBy(*names).agg(F.percentile_approx(value, shares, F.lit(20 * ranges)).alias("__cuts"), F.floor(F.lit(ranges * FIT) / F.count("*")).alias("__every"))
    cuts = cuts.where(F.col("__every") < ranges).select(*names, F.filter("__cuts", lambda c, k: (k + 1) % F.col("__every") == 0).alias("__cuts"))
    # approximate quantiles taken again could be others
    cuts = F.broadcast(written(cuts, "cuts"))
    own = hist.join(cuts, names, "left") if names else hist.crossJoin(cuts)
    # the cuts up to a value are counted by halving; what lies beyond the last is null
    halves = F.array(*[F.lit(1 << k) for k in reversed(range(ranges.bit_length()))])
    below = F.aggregate(halves, F.lit(0), lambda at, step: F.when(F.get("__cuts", at + step - 1) <= F.col(value), at + step).otherwise(at))
    return own.withColumn("__range", below).drop("__cuts")


def with_running_counts(hist: DataFrame, keys: Sequence[str], value: str, counts: Sequence[str]) -> DataFrame:
    """``hist`` with ``below_<c>`` for each of ``counts``: the sum of c over the key's rows with a smaller value.

    ``hist`` has one row for each key and value, and is written. Sums run inside a
    range of ``in_ranges``, and a range starts from the totals of those before it. So
    a key's values are never all in one task.
    """
    dealt = in_ranges(written(hist, "counts"), keys, value)
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    totals = dealt.groupBy(*keys, "__range").agg(*[F.sum(c).alias(f"__{c}") for c in counts])
    starts = totals.select(*keys, "__range", *[F.coalesce(F.sum(f"__{c}").over(before), zero).alias(f"__start_{c}") for c in counts])
    inside = Window.partitionBy(*keys, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.join(starts, [*keys, "__range"])
    running = [(F.coalesce(F.sum(c).over(inside), zero) + F.col(f"__start_{c}")).alias(f"below_{c}") for c in counts]
    return placed.select(*hist.columns, *running)


#: Ranges that the values of a key are dealt to, when percentiles are looked for.
RANGES = 64


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """``*keys, percentiles, n``: exact percentiles, between two values on the line, as an array in the order of ``shares``.

    Selection by counts: values are dealt to ranges, the ranges' totals tell where
    the wanted ranks are, and only those ranges are kept and cut again, until what
    is left of each fits a task. Nulls are left out; a key without a value gives no row.
    """
    names = list(keys)
    hist = df.where(F.col(value).isNotNull()).groupBy(*names, F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    totals = hist.groupBy(*names).agg(F.sum("__c").alias("n"))
    place = F.array(*[F.struct(F.lit(k).alias("share"), (F.lit(float(q)) * (F.col("n") - 1)).alias("at")) for k, q in enumerate(shares)])
    wanted = totals.select(*names, F.explode(place).alias("p"))
    ends = F.explode(F.array(F.struct(F.lit(0).alias("end"), F.floor("p.at").alias("rank")), F.struct(F.lit(1).alias("end"), F.ceil("p.at").alias("rank"))))
    wanted = wanted.select(*names, F.lit(0).cast("long").alias("__cell"), F.col("p.share").alias("share"), (F.col("p.at") - F.floor("p.at")).alias("part"), ends.alias("e"))
    wanted = wanted.select(*names, "__cell", "share", "part", "e.end", "e.rank")
    left, cell = hist.withColumn("__cell", F.lit(0).cast("long")), [*names, "__cell"]
    cuts_at = F.array(*[F.lit(k / RANGES) for k in range(1, RANGES)])
    while (left.groupBy(*cell).count().agg(F.max("count")).first()[0] or 0) > FIT:
        cuts = left.groupBy(*cell).agg(F.percentile_approx("__v", cuts_at, F.lit(20 * RANGES)).alias("__cuts"))
        dealt = left.join(cuts, cell).withColumn("__range", F.size(F.filter("__cuts", lambda c: c <= F.col("__v")))).drop("__cuts")
        sums = dealt.groupBy(*cell, "__range").agg(F.sum("__c").alias("__t"))
        start = F.coalesce(F.sum("__t").over(Window.partitionBy(*cell).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
        found = wanted.join(sums.withColumn("__start", start), cell).where("rank >= `__start` and rank < `__start` + `__t`")
        inner = F.col("__cell") * RANGES + F.col("__range")
        wanted = written(found.select(*names, inner.alias("__cell"), "share", "part", "end", (F.col("rank") - F.col("__start")).alias("rank")), "ranks")
        left = written(dealt.withColumn("__cell", inner).drop("__range").join(wanted.select(*cell).distinct(), cell, "left_semi"), "ranges")
    below = F.coalesce(F.sum("__c").over(Window.partitionBy(*cell).orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    met = wanted.join(left.withColumn("__below", below), cell).where("rank >= `__below` and rank < `__below` + `__c`")
    both = met.groupBy(*names, "share").agg(F.max(F.when(F.col("end") == 0, F.col("__v"))).alias("lo"), F.max(F.when(F.col("end") == 1, F.col("__v"))).alias("hi"), F.first("part").alias("part"))
    each = both.withColumn("v", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part"))
    listed = each.groupBy(*names).agg(F.transform(F.sort_array(F.collect_list(F.struct("share", "v"))), lambda x: x["v"]).alias("percentiles"))
    return listed.join(totals, names) if names else listed.crossJoin(F.broadcast(totals))


def with_percentile(df: DataFrame, keys: Sequence[str], value: str, share: float, name: str) -> DataFrame:
    """``df`` with the exact percentile of its keys' values in a column: ``lo + (hi - lo) * part`` of the two values beside it.

    Where a value is compared with it, the rule counts: a weighted sum of both can lie
    one digit beside a value that the percentile meets. Nulls are left out of it.
    """
    whole = Window.partitionBy(*keys)
    rank = F.row_number().over(whole.orderBy(F.asc_nulls_last(value))) - 1
    own = df.withColumn("__rank", rank).withColumn("__at", F.lit(float(share)) * (F.count(value).over(whole) - 1))
    low, high = (F.max(F.when(F.col("__rank") == end("__at"), F.col(value))).over(whole) for end in (F.floor, F.ceil))
    return own.withColumn("__lo", low).withColumn("__hi", high).withColumn(name, F.col("__lo") + (F.col("__hi") - F.col("__lo")) * (F.col("__at") - F.floor("__at"))).drop("__rank", "__at", "__lo", "__hi")


def signed_rank(df: DataFrame, keys: Sequence[str], difference: str) -> DataFrame:
    """``*keys, n, w_plus, w_minus, ties`` of the signed-rank statistic; null and zero differences are dropped, ties share their average rank.

    ``ties`` is the sum of t^3 - t over the tied sizes.
    """
    own = df.where(F.col(difference) != 0).groupBy(*keys, F.abs(difference).alias("__a")).agg(F.count("*").alias("c"), F.count_if(F.col(difference) > 0).alias("up"))
    ranked = with_running_counts(own, keys, "__a", ["c"]).withColumn("r", F.col("below_c") + (F.col("c") + 1) / 2)
    t = F.col("c").cast("double")
    return ranked.groupBy(*keys).agg(F.sum("c").alias("n"), F.sum(F.col("up") * F.col("r")).alias("w_plus"), F.sum((F.col("c") - F.col("up")) * F.col("r")).alias("w_minus"), F.sum(t * t * t - t).alias("ties"))


#: Groups whose counts are kept running side by side; the rows of a key with more groups are read once for every so many.
WIDE = 8
#: Rows of a table that is broadcast.
FEW = 100_000


def rank_sum(df: DataFrame, keys: Sequence[str], group: str, value: str) -> DataFrame:
    """``*keys, a, b, n_a, n_b, u, ties``: the rank-sum statistic of each pair of groups a < b.

    ``ties`` is the sum of t^3 - t over the pair's tied values. A key's values are put in
    order once for all its groups: a row meets the running counts of ``WIDE`` groups,
    and what is summed up for each range and group tells all pairs. With L(a, b) the pairs
    of a row of a and one of b that is not larger, u is (n_a n_b + L(a, b) - L(b, a)) / 2.
    Null values are left out.
    """
    names = list(keys)
    own = df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    hist = written(own.groupBy(*names, F.col(group).alias("__g"), F.col(value).alias("__v")).agg(F.count("*").alias("__c")), "ranks")
    c, slots = F.col("__c").cast("double"), range(WIDE)
    groups = hist.groupBy(*names, "__g").agg(F.sum("__c").alias("__n"), F.sum(c * c * c).alias("__cubes"))
    groups = groups.withColumn("__at", F.row_number().over(Window.partitionBy(*names).orderBy("__g")) - 1).withColumn("__last", F.max("__at").over(Window.partitionBy(*names)))
    groups = F.broadcast(groups) if groups.limit(FEW + 1).count() <= FEW else groups
    blocks = F.explode(F.sequence(F.lit(0), F.floor(F.col("__last") / WIDE).cast("int"))).alias("__block")
    rows = in_ranges(hist, names, "__v").join(groups.select(*names, "__g", "__at", "__last"), [*names, "__g"]).select(*names, blocks, "__range", "__v", "__at", "__c")

    def of(slot: int, count: str) -> Column:
        return F.sum(F.when(F.col("__at") - F.col("__block") * WIDE == slot, F.col(count)).otherwise(0))

    cell = [*names, "__block", "__range"]
    inside = Window.partitionBy(*cell).orderBy("__v")
    upto, same = inside.rangeBetween(Window.unboundedPreceding, Window.currentRow), inside.rangeBetween(Window.currentRow, Window.currentRow)
    met = rows.select(*cell, "__at", "__c", *[of(s, "__c").over(upto).alias(f"__upto{s}") for s in slots], *[of(s, "__c").over(same).alias(f"__same{s}") for s in slots])
    sums = met.groupBy(*cell, "__at").agg(F.sum("__c").alias("__n"), *[F.sum(c * F.col(f"__upto{s}")).alias(f"__l{s}") for s in slots], *[F.sum(c * c * F.col(f"__same{s}")).alias(f"__t{s}") for s in slots])
    # what is left has a row for each range and group; whole numbers of any size
    before = Window.partitionBy(*names, "__block").orderBy("__range").rangeBetween(Window.unboundedPreceding, -1)
    placed = sums.select("*", *[F.coalesce(of(s, "__n").over(before), F.lit(0)).cast("decimal(19,0)").alias(f"__start{s}") for s in slots])
    n = F.col("__n").cast("decimal(19,0)")
    each = [F.struct((F.col("__block") * WIDE + s).alias("__to"), (F.col(f"__l{s}").cast("decimal(38,0)") + n * F.col(f"__start{s}")).alias("__l"), F.col(f"__t{s}").alias("__t")) for s in slots]
    ahead = F.col("__at") < F.col("__to")
    pairs = placed.select(*names, "__at", F.inline(F.array(*each))).where("__at <> __to").groupBy(*names, F.least("__at", "__to").alias("__a"), F.greatest("__at", "__to").alias("__b"))
    pairs = pairs.agg(F.sum(F.when(ahead, F.col("__l")).otherwise(-F.col("__l"))).alias("__d"), F.sum("__t").alias("__t"))
    a, b = (groups.select(*names, F.col("__at").alias(f"__{x}"), F.col("__g").alias(x), F.col("__n").alias(f"n_{x}"), F.col("__cubes").alias(f"__cubes_{x}")) for x in "ab")
    u = (F.col("n_a").cast("decimal(19,0)") * F.col("n_b").cast("decimal(19,0)") + F.col("__d")).cast("double") / 2
    ties = F.col("__cubes_a") + F.col("__cubes_b") + 3 * F.col("__t") - F.col("n_a") - F.col("n_b")
    return pairs.join(a, [*names, "__a"]).join(b, [*names, "__b"]).select(*names, "a", "b", "n_a", "n_b", u.alias("u"), ties.alias("ties"))


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """``*keys, rho, n``: correlation of average ranks; rows with a null in either are left out, and rho is null where a side has one value only."""
    own = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("__all", F.lit(0))
    by = ["__all", *keys]
    pairs = own.groupBy(*by, F.col(x).alias("__x"), F.col(y).alias("__y")).agg(F.count("*").alias("c"))

    def ranks(v: str, name: str) -> DataFrame:
        hist = with_running_counts(pairs.groupBy(*by, v).agg(F.sum("c").alias("c")), by, v, ["c"])
        return hist.select(*by, v, (F.col("below_c") + (F.col("c") + 1) / 2).alias(name))

    # the mean of n ranks is (n + 1) / 2, ties or not
    n = pairs.groupBy(*by).agg(F.sum("c").alias("n"))
    ranked = pairs.join(ranks("__x", "rx"), [*by, "__x"]).join(ranks("__y", "ry"), [*by, "__y"]).join(n, by)
    dx, dy = F.col("rx") - (F.col("n") + 1) / 2, F.col("ry") - (F.col("n") + 1) / 2
    sums = ranked.groupBy(*by).agg(F.first("n").alias("n"), *[F.sum(F.col("c") * a * b).alias(s) for a, b, s in ((dx, dy, "sxy"), (dx, dx, "sxx"), (dy, dy, "syy"))])
    return sums.select(*keys, F.try_divide(F.col("sxy"), F.sqrt(F.col("sxx") * F.col("syy"))).alias("rho"), "n")
