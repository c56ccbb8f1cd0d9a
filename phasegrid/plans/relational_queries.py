"""Queries over the star schema in the roles of channel metadata, subjects, states and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phasegrid.operators import events as ev
from phasegrid.operators import rollup
from phasegrid.sources import names


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _orders(spark, d):
    """Orders with their customer, nation and region: value = total price, state = status, subject = customer."""
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment")
    n = t(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", F.col("n_regionkey").alias("r_regionkey"))
    return o.join(c, "o_custkey").join(n, "c_nationkey").join(t(spark, d, "region"), "r_regionkey")


PART_RULES = [("ring", ["ring"], ["Brand#1"]), ("widget", ["widget"], ["Brand#2"]), ("bolt", ["bolt"], ["Brand#3"]), ("other", [], ["Brand#4"])]


def roi_classify(spark, d):
    """First rule that fits the name or the brand; the order of the rules decides."""
    return t(spark, d, "part").select("p_partkey", rollup.first_match(PART_RULES, F.col("p_name"), F.col("p_brand")).alias("roi"))


def clip_name_parse(spark, d):
    """File names made from orders, read back by the clip-name pattern; those of another state don't match."""
    state = F.when(F.col("o_orderstatus") == "O", "W").when(F.col("o_orderstatus") == "P", "N3").otherwise("N4")
    path = F.concat(F.lit("x/y/sub-RID"), F.lpad(F.col("o_custkey").cast("string"), 4, "0"), F.lit("_"), state, F.lit("_"), (F.col("o_orderkey") % 9).cast("string"), F.lit(".edf"))
    return names.clip_index(t(spark, d, "orders").select("o_orderkey", path.alias("path")), "path").select("o_orderkey", "pt", "state", "idx", "filename")


def channel_names(spark, d):
    """Shaft, contact number, pair label and stripped region code of names like LAH3, made from customers."""
    made = F.concat(F.when(F.col("c_custkey") % 2 == 0, "L").otherwise("R"), F.element_at(F.array(*map(F.lit, ("A", "AH", "EC", "PHG", "X"))), (F.col("c_custkey") % 5 + 1).cast("int")), (F.col("c_custkey") % 12 + 1).cast("string"))
    return t(spark, d, "customer").select("c_custkey", *names.channel_parts(made))


def normative_filter(spark, d):
    """Channels without a flag; null flags count as unset."""
    c = t(spark, d, "customer").select(
        "c_custkey", F.when(F.col("c_acctbal") < 0, True).when(F.col("c_acctbal") < 5000, False).alias("ch1_soz"), (F.col("c_nationkey") == 3).alias("ch2_soz"), F.when(F.col("c_mktsegment") == "BUILDING", True).alias("ch1_resected"),
    )
    return rollup.normative(c, ["ch1_soz", "ch2_soz", "ch1_resected", "ch2_resected"]).select("c_custkey")


def state_pivot_pairs(spark, d):
    p = rollup.paired_states(t(spark, d, "orders"), ["o_custkey"], "o_orderstatus", "o_totalprice", ["O", "F"])
    return p.select("o_custkey", F.round("O", 6).alias("w_mean"), F.round("F", 6).alias("n3_mean"))


def mean_of_means(spark, d):
    """Clip to channel to subject to group: each average over the averages below it."""
    o = _orders(spark, d)
    levels = [["o_custkey", "n_name", "r_name", "o_orderstatus"], ["n_name", "r_name", "o_orderstatus"], ["r_name", "o_orderstatus"]]
    return rollup.mean_of_means(o, levels, "o_totalprice").select("r_name", "o_orderstatus", F.round("o_totalprice", 5).alias("mean_value"), "n")


def weighted_rollup(spark, d):
    """Plain means at every level at once, which differ from the means of means."""
    r = _orders(spark, d).rollup("r_name", "n_name", "o_orderstatus").agg(F.avg("o_totalprice").alias("m"), F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))
    return r.select("r_name", "n_name", "o_orderstatus", F.round("m", 5).alias("mean_value"), "n", "level")


def region_pairs_theta(spark, d):
    """All pairs of regions in order of name, with the number of nations of each."""
    n = t(spark, d, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count("*").alias("n")).join(t(spark, d, "region"), "r_regionkey")
    a, b = n.select(F.col("r_name").alias("a"), F.col("n").alias("n_a")), n.select(F.col("r_name").alias("b"), F.col("n").alias("n_b"))
    return a.join(b, F.col("a") < F.col("b"))


def semi_intersect(spark, d):
    """Customers with an open and a finished order."""
    o = t(spark, d, "orders")
    return o.where("o_orderstatus = 'O'").select("o_custkey").intersect(o.where("o_orderstatus = 'F'").select("o_custkey"))


def cached_files(spark, d):
    """Orders whose customer is on file, as a semi-join against the listing."""
    listing = t(spark, d, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("o_custkey"))
    return t(spark, d, "orders").join(listing, "o_custkey", "left_semi").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def anti_except(spark, d):
    """Customers without an order of 450,000 or more."""
    return t(spark, d, "customer").select(F.col("c_custkey").alias("custkey")).exceptAll(t(spark, d, "orders").where("o_totalprice >= 450000").select(F.col("o_custkey").alias("custkey")).distinct())


def union_cohorts(spark, d):
    """Suppliers and customers as two cohorts side by side."""
    s = t(spark, d, "supplier").select(F.lit("supplier").alias("cohort"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("v"))
    c = t(spark, d, "customer").select(F.lit("customer").alias("cohort"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("v"))
    return s.unionByName(c).groupBy("cohort", "nation").agg(F.count("*").alias("n"), F.round(F.avg("v"), 7).alias("mean_v"))


def top_k(spark, d):
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    return rows.orderBy(F.desc("l_extendedprice"), F.desc("l_quantity"), "l_orderkey", "l_linenumber").limit(12)


def first_n_per_group(spark, d):
    order = [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"]
    rows = t(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    return ev.first_n(rows, ["l_suppkey"], order, 8).select("l_suppkey", "rank", "l_orderkey", "l_linenumber", "l_extendedprice")


def max_by_best(spark, d):
    """The dearest line of each flag; ties by quantity, then the smaller keys."""
    best = F.max_by(F.struct("l_orderkey", "l_linenumber", "l_extendedprice"), F.struct(F.col("l_extendedprice"), F.col("l_quantity"), -F.col("l_orderkey"), -F.col("l_linenumber")))
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(best.alias("b")).select("l_returnflag", "b.*")


def representative_order(spark, d):
    """For customers with both states, the one with the largest second-state mean in each segment."""
    p = rollup.paired_states(t(spark, d, "orders"), ["o_custkey"], "o_orderstatus", "o_totalprice", ["O", "F"])
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    best = F.max_by(F.struct("o_custkey", "F"), F.struct(F.col("F"), -F.col("o_custkey")))
    return p.join(c, "o_custkey").groupBy("c_mktsegment").agg(best.alias("b")).select("c_mktsegment", "b.o_custkey", F.round("b.F", 6).alias("n3_mean"))


def count_positive(spark, d):
    """Positives of all, as a count, a share and a ratio string."""
    g = t(spark, d, "supplier").groupBy("s_nationkey").agg(F.count_if(F.col("s_acctbal") > 5000).alias("k"), F.count("*").alias("n"))
    return g.select("s_nationkey", "k", "n", F.round(F.col("k") / F.col("n"), 9).alias("share"), F.concat(F.col("k").cast("string"), F.lit("/"), F.col("n").cast("string")).alias("ratio"))


def value_counts(spark, d):
    return t(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.countDistinct("c_nationkey").alias("n_nations"))


def min_n_groups(spark, d):
    """Customers with at least five orders of one state."""
    return t(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n")).where("n >= 5")


def composite_counts(spark, d):
    return _orders(spark, d).groupBy("r_name", "c_mktsegment").agg(F.count("*").alias("n"))


def trapezoid_area(spark, d):
    """Area under quantity over discount steps, inside the band of 2 to 8 percent."""
    g = t(spark, d, "lineitem").groupBy("l_returnflag", F.round(F.col("l_discount") * 100).cast("int").alias("f")).agg(F.sum("l_quantity").alias("p")).where("f >= 2 and f < 8")
    w = Window.partitionBy("l_returnflag").orderBy("f")
    piece = (F.col("p") + F.lag("p").over(w)) / 2 * (F.col("f") - F.lag("f").over(w))
    return g.withColumn("piece", piece).groupBy("l_returnflag").agg(F.round(F.sum("piece"), 6).alias("area"))


def spearman(spark, d):
    r = rollup.spearman(t(spark, d, "customer"), ["c_mktsegment"], "c_acctbal", "c_nationkey")
    return r.select("c_mktsegment", F.round("rho", 9).alias("rho"), "n")


def mann_whitney_u(spark, d):
    """Rank-sum statistic of the account balances of each pair of segments."""
    return rollup.rank_sum(t(spark, d, "customer"), [], "c_mktsegment", "c_acctbal").select("a", "b", "n_a", "n_b", F.col("u").cast("double").alias("u"))


def wilcoxon_w(spark, d):
    """Signed-rank sums of the differences of the paired state means (to a millionth, where sums in another order may differ) in each segment."""
    p = rollup.paired_states(t(spark, d, "orders"), ["o_custkey"], "o_orderstatus", "o_totalprice", ["O", "F"])
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    diff = p.join(c, "o_custkey").withColumn("diff", F.round(F.col("F") - F.col("O"), 6))
    return rollup.signed_rank(diff, ["c_mktsegment"], "diff").select("c_mktsegment", "n", F.col("w_plus").cast("double"), F.col("w_minus").cast("double"))


def summary_json(spark, d):
    """One JSON document for each segment."""
    g = t(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.max("c_nationkey").alias("hi"))
    return g.select("c_mktsegment", F.to_json(F.struct("n", "hi")).alias("doc"))


def hashed_subsample(spark, d):
    """At most twenty customers of a segment, in the order of a seeded hash."""
    key = F.md5(F.concat(F.lit("7|"), F.col("c_custkey").cast("string")))
    picked = ev.first_n(t(spark, d, "customer").withColumn("key", key), ["c_mktsegment"], ["key", "c_custkey"], 20)
    return picked.select("c_mktsegment", "rank", "c_custkey")


def _contacts(spark, d):
    """Electrode contacts made from customers, a recording for each nation; every seventh has no number."""
    shaft = F.element_at(F.array(*map(F.lit, SHAFTS)), (F.col("c_custkey") % len(SHAFTS) + 1).cast("int"))
    name = F.concat(shaft, F.when(F.col("c_custkey") % 7 == 0, "").otherwise((F.col("c_custkey") % 12 + 1).cast("string")))
    return t(spark, d, "customer").select("c_custkey", "c_nationkey", name.alias("name"))


SHAFTS = ("LA", "LB", "LC", "LH", "RA")
# Contacts that belong to the region, by name, and the largest number used; staging contacts in order of preference.
REGION, MOST_CONTACT, STAGING = "^(LA|LB|LC|LH)", 6, ("LB4", "LC4", "LB6", "LH4", "LC6")


def contact_filter(spark, d):
    """Contacts of the region with a number up to the largest used; a name without a number counts as 999."""
    return names.usable_contacts(_contacts(spark, d), "name", REGION, MOST_CONTACT).select("c_custkey", "name", "contact")


def staging_channel(spark, d):
    """Each recording's first preferred contact that exists; without one the first usable contact."""
    own = _contacts(spark, d)
    usable = names.usable_contacts(own, "name", REGION, MOST_CONTACT)
    return names.preferred_channel(own, usable, ["c_nationkey"], "name", STAGING, "c_custkey").select("c_nationkey", "channel")


def manifest_payload(spark, d):
    """Blocks of a manifest (orders) with the samples of their files (line items): count, sum, and whether the file is there."""
    manifest = t(spark, d, "orders").select("o_orderkey", F.format_string("block_%07d.npz", F.col("o_orderkey")).alias("file"), F.col("o_totalprice").alias("start_s"))
    payload = t(spark, d, "lineitem").where("l_quantity < 40").select(F.format_string("block_%07d.npz", F.col("l_orderkey")).alias("file"), "l_quantity")
    sums = payload.groupBy("file").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("total"))
    out = manifest.join(sums, "file", "left")
    return out.select("file", "start_s", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("total", F.lit(0.0)).alias("total"), F.col("n").isNotNull().alias("found"))


QUERIES = {f.__name__: f for f in (
    contact_filter, staging_channel, manifest_payload,
    roi_classify, clip_name_parse, channel_names, normative_filter, state_pivot_pairs, mean_of_means, weighted_rollup, region_pairs_theta, semi_intersect, cached_files, anti_except, union_cohorts, top_k, first_n_per_group,
    max_by_best, representative_order, count_positive, value_counts, min_n_groups, composite_counts, trapezoid_area, spearman, mann_whitney_u, wilcoxon_w, summary_json, hashed_subsample,
)}

_O = "o AS (SELECT * FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"
_P = "p AS (SELECT o_custkey, avg(o_totalprice) FILTER (o_orderstatus = 'O') AS w, avg(o_totalprice) FILTER (o_orderstatus = 'F') AS n3 FROM orders GROUP BY 1 HAVING w IS NOT NULL AND n3 IS NOT NULL)"
_CH = "CASE WHEN c_custkey % 2 = 0 THEN 'L' ELSE 'R' END || ['A', 'AH', 'EC', 'PHG', 'X'][c_custkey % 5 + 1] || (c_custkey % 12 + 1)"

_CONTACTS = "c AS (SELECT c_custkey, c_nationkey, ['LA', 'LB', 'LC', 'LH', 'RA'][c_custkey % 5 + 1] || CASE WHEN c_custkey % 7 = 0 THEN '' ELSE (c_custkey % 12 + 1)::VARCHAR END AS name FROM customer), u AS (SELECT *, coalesce(try_cast(regexp_extract(name, '^[A-Za-z]+([0-9]+)$', 1) AS INT), 999) AS contact FROM c), k AS (SELECT * FROM u WHERE regexp_matches(name, '^(LA|LB|LC|LH)') AND contact <= 6)"

ORACLES = {
    "contact_filter": f"WITH {_CONTACTS} SELECT c_custkey, name, contact FROM k",
    "staging_channel": f"WITH {_CONTACTS}, p AS (SELECT c_nationkey, name, list_position(['LB4', 'LC4', 'LB6', 'LH4', 'LC6'], name) AS place, 0 AS nth FROM c WHERE name IN ('LB4', 'LC4', 'LB6', 'LH4', 'LC6') UNION ALL SELECT c_nationkey, name, 99, c_custkey FROM k) SELECT c_nationkey, arg_min(name, (place, nth)) AS channel FROM p GROUP BY 1",
    "manifest_payload": "SELECT printf('block_%07d.npz', o_orderkey) AS file, o_totalprice AS start_s, count(l_quantity) AS n, coalesce(sum(l_quantity), 0.0) AS total, count(l_quantity) > 0 AS found FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity < 40 GROUP BY o_orderkey, o_totalprice",
    "roi_classify": "SELECT p_partkey, CASE " + " ".join("WHEN " + " OR ".join([f"contains(lower(p_name), '{x}')" for x in a] + [f"contains(p_brand, '{x}')" for x in b]) + f" THEN '{n}'" for n, a, b in PART_RULES) + " END AS roi FROM part",
    "clip_name_parse": "SELECT o_orderkey, 'sub-RID' || lpad(o_custkey::VARCHAR, 4, '0') AS pt, CASE o_orderstatus WHEN 'O' THEN 'W' ELSE 'N3' END AS state, (o_orderkey % 9)::INT AS idx, pt || '_' || state || '_' || idx || '.edf' AS filename FROM orders WHERE o_orderstatus <> 'F'",
    "channel_names": f"SELECT c_custkey, regexp_extract({_CH}, '^([A-Za-z]+)', 1) AS shaft, regexp_extract({_CH}, '([0-9]+)$', 1)::INT AS contact, regexp_replace(shaft, '^[LR]', '') AS code, shaft || contact || '-' || (contact + 1) AS pair FROM customer",
    "normative_filter": "SELECT c_custkey FROM customer WHERE NOT (c_acctbal < 0) AND NOT (c_nationkey = 3) AND c_mktsegment <> 'BUILDING'",
    "state_pivot_pairs": f"WITH {_P} SELECT o_custkey, round(w, 6) AS w_mean, round(n3, 6) AS n3_mean FROM p",
    "mean_of_means": f"WITH {_O}, a AS (SELECT o_custkey, n_name, r_name, o_orderstatus, avg(o_totalprice) AS v FROM o GROUP BY 1, 2, 3, 4), b AS (SELECT n_name, r_name, o_orderstatus, avg(v) AS v FROM a GROUP BY 1, 2, 3) SELECT r_name, o_orderstatus, round(avg(v), 5) AS mean_value, count(v) AS n FROM b GROUP BY 1, 2",
    "weighted_rollup": f"WITH {_O} SELECT r_name, n_name, o_orderstatus, round(avg(o_totalprice), 5) AS mean_value, count(*) AS n, grouping_id(r_name, n_name, o_orderstatus)::INT AS level FROM o GROUP BY ROLLUP (r_name, n_name, o_orderstatus)",
    "region_pairs_theta": "WITH n AS (SELECT r_name, count(*) AS n FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1) SELECT a.r_name AS a, a.n AS n_a, b.r_name AS b, b.n AS n_b FROM n a JOIN n b ON a.r_name < b.r_name",
    "semi_intersect": "SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'",
    "cached_files": "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) GROUP BY 1",
    "anti_except": "SELECT c_custkey AS custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice >= 450000",
    "union_cohorts": "SELECT cohort, nation, count(*) AS n, round(avg(v), 7) AS mean_v FROM (SELECT 'supplier' AS cohort, s_nationkey AS nation, s_acctbal AS v FROM supplier UNION ALL SELECT 'customer', c_nationkey, c_acctbal FROM customer) GROUP BY 1, 2",
    "top_k": "SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity FROM lineitem ORDER BY l_extendedprice DESC, l_quantity DESC, l_orderkey, l_linenumber LIMIT 12",
    "first_n_per_group": "SELECT l_suppkey, rank::INT AS rank, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_quantity) AS rank FROM lineitem) WHERE rank <= 8",
    "max_by_best": "SELECT l_returnflag, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_quantity DESC, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1",
    "representative_order": f"WITH {_P} SELECT c_mktsegment, o_custkey, round(n3, 6) AS n3_mean FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY n3 DESC, o_custkey) AS r FROM p JOIN customer ON c_custkey = o_custkey) WHERE r = 1",
    "count_positive": "SELECT s_nationkey, count(*) FILTER (s_acctbal > 5000) AS k, count(*) AS n, round(k / n, 9) AS share, k || '/' || n AS ratio FROM supplier GROUP BY 1",
    "value_counts": "SELECT c_mktsegment, count(*) AS n, count(DISTINCT c_nationkey) AS n_nations FROM customer GROUP BY 1",
    "min_n_groups": "SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) >= 5",
    "composite_counts": f"WITH {_O} SELECT r_name, c_mktsegment, count(*) AS n FROM o GROUP BY 1, 2",
    "trapezoid_area": "WITH g AS (SELECT l_returnflag, round(l_discount * 100)::INT AS f, sum(l_quantity) AS p FROM lineitem GROUP BY 1, 2), e AS (SELECT *, lag(p) OVER w AS q, lag(f) OVER w AS g FROM g WHERE f >= 2 AND f < 8 WINDOW w AS (PARTITION BY l_returnflag ORDER BY f)) SELECT l_returnflag, round(sum((p + q) / 2 * (f - g)), 6) AS area FROM e GROUP BY 1",
    "spearman": "WITH r AS (SELECT c_mktsegment, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_mktsegment, c_acctbal) - 1) / 2 AS x, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) - 1) / 2 AS y FROM customer) SELECT c_mktsegment, round(corr(x, y), 9) AS rho, count(*) AS n FROM r GROUP BY 1",
    "mann_whitney_u": """WITH c AS (SELECT c_mktsegment AS g, c_acctbal AS v FROM customer), n AS (SELECT g, count(*) AS n FROM c GROUP BY 1),
        p AS (SELECT x.g AS a, y.g AS b, x.n AS n_a, y.n AS n_b FROM n x JOIN n y ON x.g < y.g),
        r AS (SELECT a, b, n_a, n_b, g, rank() OVER (PARTITION BY a, b ORDER BY v) + (count(*) OVER (PARTITION BY a, b, v) - 1) / 2 AS r FROM p JOIN c ON g = a OR g = b)
        SELECT a, b, n_a, n_b, (sum(r) FILTER (g = a) - n_a * (n_a + 1) / 2)::DOUBLE AS u FROM r GROUP BY a, b, n_a, n_b""",
    "wilcoxon_w": f"WITH {_P}, d AS (SELECT c_mktsegment, round(n3 - w, 6) AS d FROM p JOIN customer ON c_custkey = o_custkey), r AS (SELECT *, rank() OVER (PARTITION BY c_mktsegment ORDER BY abs(d)) + (count(*) OVER (PARTITION BY c_mktsegment, abs(d)) - 1) / 2 AS r FROM d WHERE d <> 0) SELECT c_mktsegment, count(*) AS n, coalesce(sum(r) FILTER (d > 0), 0)::DOUBLE AS w_plus, coalesce(sum(r) FILTER (d < 0), 0)::DOUBLE AS w_minus FROM r GROUP BY 1",
    "summary_json": "SELECT c_mktsegment, '{\"n\":' || count(*) || ',\"hi\":' || max(c_nationkey) || '}' AS doc FROM customer GROUP BY 1",
    "hashed_subsample": "SELECT c_mktsegment, rank::INT AS rank, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('7|' || c_custkey), c_custkey) AS rank FROM customer) WHERE rank <= 20",
}
