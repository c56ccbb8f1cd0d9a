"""Pieces of DuckDB SQL that several oracles share."""

from __future__ import annotations

from phasegrid.operators import inference


def bootstrap(source: str, keys: list[str], subject: list[str], value: str, name: str = "ci") -> str:
    """CTEs; the last, ``name``, has ``keys, mean, ci_lo, ci_hi, n`` of ``source``. It draws the weights that the operator draws."""
    own = ", ".join(keys) if keys else "0 AS one"
    by = ", ".join(keys) if keys else "one"
    text = " || '|' || ".join(["'0'", *(f"coalesce({c}::VARCHAR, '')" for c in (*keys, *subject))])
    weight = " + ".join(f"(u > {p!r})::INT" for p in inference.POISSON)
    blocks = -(-inference.DRAWS // inference.EACH)
    return f"""{name}_b AS (SELECT {own}, {value}::DOUBLE AS v, unnest(range({blocks})) AS b, {text} AS name FROM {source} WHERE {value} IS NOT NULL),
        {name}_u AS (SELECT {by}, v, b, k, (('0x' || substr(md5(name || '|' || b), (1 + 8 * k)::BIGINT, 8))::BIGINT + 0.5) / 4294967296.0 AS u FROM {name}_b, range({inference.EACH}) r(k)),
        {name}_m AS (SELECT {by}, b, k, sum(w * v) / sum(w) AS m FROM (SELECT *, {weight} AS w FROM {name}_u) GROUP BY {by}, b, k HAVING sum(w) > 0),
        {name}_e AS (SELECT {by}, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM {name}_m GROUP BY {by}),
        {name}_a AS (SELECT {by}, avg(v) AS mean, count(*) AS n FROM {name}_b WHERE b = 0 GROUP BY {by}),
        {name} AS (SELECT {by}, mean, CASE WHEN n > 1 THEN lo END AS ci_lo, CASE WHEN n > 1 THEN hi END AS ci_hi, n FROM {name}_a LEFT JOIN {name}_e USING ({by}))"""


def erfc(x: str) -> str:
    """The complementary error function of a number above 0."""
    h = inference.ERFC_STEP
    terms = f"list_sum(list_transform(range({inference.ERFC_TERMS}), lambda k: exp(-pow((k + 0.5) * {h}, 2)) / (pow({x}, 2) + pow((k + 0.5) * {h}, 2))))"
    return f"(2 * {h} / pi() * {x} * exp(-pow({x}, 2)) * {terms} + CASE WHEN {x} < pi() / {h} THEN 2 / (1 + exp(2 * pi() * {x} / {h})) ELSE 0 END)"


def signed_rank(source: str, key: str, difference: str) -> str:
    """A query's end, behind ``WITH RECURSIVE ...``: key, n, w and the exact p, or the normal one, of each group of ``source``."""
    return f"""ways(m, w) AS (SELECT 0, [1.0::DOUBLE] UNION ALL SELECT m + 1, list_transform(range(1, len(w) + m + 2), lambda i: coalesce(w[i], 0) + CASE WHEN i > m + 1 THEN w[i - m - 1] ELSE 0 END) FROM ways WHERE m < {inference.EXACT}),
        told AS (SELECT {key} AS key, {difference} AS d FROM {source} WHERE {difference} IS NOT NULL),
        ranked AS (SELECT key, d, rank() OVER (PARTITION BY key ORDER BY abs(d)) + (count(*) OVER (PARTITION BY key, abs(d)) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY key, abs(d)) AS t FROM told WHERE d <> 0),
        sums AS (SELECT key, count(*) AS n, least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)) AS w, sum(pow(t, 2) - 1) AS ties FROM ranked GROUP BY 1),
        tested AS (SELECT s.*, CASE WHEN n <= {inference.EXACT} AND ties = 0 AND NOT EXISTS (SELECT 1 FROM told z WHERE z.key = s.key AND z.d = 0) THEN least(1, 2 * list_sum(ways.w[1 : floor(s.w)::INT + 1]) / pow(2, n)) END AS exact,
            abs(s.w - n * (n + 1) / 4) / sqrt(2 * (n * (n + 1) * (2 * n + 1) / 24 - ties / 48)) AS z FROM sums s LEFT JOIN ways ON m = n)
        SELECT key AS {key}, n, w::DOUBLE AS w, round(coalesce(exact, {erfc("z")}), 9) AS p FROM tested"""
