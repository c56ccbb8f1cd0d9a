"""Hard negatives, conversation tries and decontamination: odd input, brute force, and the ways taken only by large tables."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from phasegrid.llm import leaks, negatives, trie

# hard negatives

VECTORS = "vec_id long, embedding array<float>, label int, key string, score int"


def vectors_of(seed, n, width=6, labels=3, step=4):
    r = random.Random(seed)
    return [(k, [r.randrange(-3, 4) / step for _ in range(width)], r.randrange(labels)) for k in range(n)]


def brute_negatives(rows):
    ok = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if i is not None and v is not None and lab is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v, lab) in enumerate(ok):
        if i % 10:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), j, k == lab) for b, (j, w, k) in enumerate(ok) if a != b)
        for s, j, _ in [x for x in scored if x[2]][: negatives.POSITIVES]:
            fits = [(n, -t) for t, n, own in scored if not own and 80 * -s <= 100 * -t <= 100 * -s]
            out += [(i, j, r, n, -s, t) for r, (n, t) in enumerate(fits[: negatives.NEGATIVES], 1)]
    return sorted(out)


def mined(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS)
    got = negatives.hard_negatives(df, F.col("id") % 10 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("seed", range(2))
def test_negatives_equal_brute_force(spark, seed):
    rows = vectors_of(seed, 300)
    assert mined(spark, rows) == brute_negatives(rows)


def test_negatives_with_blocks_of_few_anchors_and_rows(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ANCHOR_BYTES", 400)
    monkeypatch.setattr(negatives, "LEAST_ROWS", 40)
    monkeypatch.setattr(negatives, "TILE", (3, 50))
    rows = vectors_of(5, 260)
    assert mined(spark, rows) == brute_negatives(rows)


def test_negatives_of_odd_rows(spark):
    """Nulls, values that aren't finite, one vector in a third of the rows, repeated ids and anchors, vectors of unequal length, no positives."""
    rows = vectors_of(7, 60) + [(100 + k, [0.5, 0.5, 0.25, 0.0, 0.0, 0.25], k % 2) for k in range(40)]
    rows += [(200, None, 1), (210, [1.0] * 6, None), (None, [1.0] * 6, 1), (220, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (230, [float("nan")] * 6, 1), (240, [float("inf")] * 6, 0)]
    rows += [(20, [0.5] * 6, 1), (20, [0.5] * 6, 1), (21, [0.5] * 6, 0), (21, [0.5] * 6, 0), (250, [1.0], 1), (260, [1.0] * 9, 2), (270, [], 1), (280, [0.5] * 6, 77)]
    assert mined(spark, rows) == brute_negatives(rows)
    assert mined(spark, []) == [] and mined(spark, [(10, [1.0], 1)]) == []


def test_scores_beyond_floating_point_are_exact():
    import numpy as np

    a = np.array([[3e9, 1.0], [1.0, 1.0]])
    assert negatives.products(a, np.array([[2e9, 1.0]])).tolist() == [[6 * 10**18 + 1], [2 * 10**9 + 1]]
    assert negatives.products(a[1:], a[1:]).tolist() == [[2]]


# conversation tries


def brute_trie(convs):
    """``convs``: id -> list of (role, text)."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, own in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(own) - 1) * (len(p[-1][1].encode()) if p else 0)
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(own), len(p), min(members[p[:-1]]) if p else None, len(own), children[p], leaves[p], saved[p], sha(ends[p])) for p, own in members.items())


def order(convs):
    key = lambda r, t: hashlib.sha256(f"{len(r)}|{r}|{t}".encode()).hexdigest()[: trie.NAME]
    return {c: [(r or "", t or "") for _, r, t in sorted(turns, key=lambda x: (x[0] is not None, x[0] or 0, key(x[1] or "", x[2] or "")))] for c, turns in convs.items()}


def rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + turns[h:]
    return out


TURNS = "conv_id long, turn long, role string, text string, key string, path string, depth int"


def tabled(spark, convs, extra=()):
    return spark.createDataFrame([(c, k, r, t, "x", "y", 0) for c, turns in convs.items() for k, r, t in turns] + [(*e, "x", "y", 0) for e in extra], TURNS)


def conversations(seed, n, words=2, longest=9):
    r = random.Random(seed)
    return {c: [(k, r.choice(["user", "assistant"]), r.choice(["a", "é", "long text"][:words])) for k in range(r.randrange(1, longest))] for c in range(n)}


def trie_of(convs):
    return sorted(map(tuple, trie.prefix_trie(convs).collect()), key=repr)


def same(spark, convs, extra=()):
    named = trie.named_turns(tabled(spark, convs, extra))
    assert trie_of(named) == sorted(brute_trie(order(convs)), key=repr)
    assert trie_of(trie.rebuilt_conversations(named)) == sorted(brute_trie(rebuilt(order(convs))), key=repr)


def test_trie_equals_brute_force(spark):
    same(spark, conversations(1, 200))


def test_trie_of_odd_conversations(spark):
    """Nulls, equal turn numbers, repeated rows, empty texts, one very long conversation, a third of all equal, one alone."""
    convs = conversations(2, 60) | {k: [(0, "user", "same"), (1, None, None)] for k in range(100, 140)}
    convs |= {200: [(None, "user", "x"), (0, "user", ""), (0, "user", "b"), (0, "a", "b")], 201: [(1, "user", "x")] * 3, 202: [(k, "user", f"{k % 3}") for k in range(260)], 203: [(k, "user", f"{k % 3}") for k in range(250)]}
    same(spark, convs, [(None, 1, "user", "nobody's"), (None, None, None, None)])
    same(spark, {-7: [(0, "user", "a")]})
    empty = trie.named_turns(tabled(spark, {}, [(None, 0, "user", "a")]))
    assert trie_of(empty) == [] and trie_of(trie.rebuilt_conversations(empty)) == []


def test_trie_of_conversations_without_turns(spark):
    convs = spark.createDataFrame([(1, None), (2, [])], f"conv_id long, turns {trie.TURNS}")
    assert trie_of(convs) == brute_trie({1: [], 2: []})


def test_trie_when_all_is_cut_small(spark, monkeypatch):
    """Many shards, short splitters, few waiting nodes and small pieces give the same nodes."""
    for name, value in (("LEAST_SHARDS", 40), ("SPLITTER_BYTES", 40 * 3 * trie.NAME), ("MOST_WAITING", 5), ("PIECE", 3)):
        monkeypatch.setattr(trie, name, value)
    same(spark, conversations(3, 150) | {k: [(0, "user", "a"), (1, "user", "é")] for k in range(300, 360)} | {k: [(0, "b", "b"), (1, "b", str(k))] for k in range(400, 440)})


def test_trie_shuffles_no_text(spark):
    plan = trie.named_turns(tabled(spark, {1: [(0, "user", "a")]}))._jdf.queryExecution().executedPlan().toString()
    exchange = next(x for x in plan.split("\n") if "ObjectHashAggregate(keys=[conv_id" in x and "partial" in x)
    assert "text" not in exchange


# decontamination


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_leaks(docs, items, least=10):
    windows = defaultdict(set)
    for name, text in items:
        w = words_of(text)
        n = min(least, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k : k + n])].add("" if name is None else str(name))
    sizes, out = {len(g) for g in windows}, []
    for i, text in docs:
        w, hit, names = words_of(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    names |= own
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def leaks_in(spark, docs, items, **how):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, n_words string, item_id int")
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    return sorted(map(tuple, leaks.leak_report(d, b, **how).collect()), key=repr)


def stream(seed, n, vocabulary):
    r = random.Random(seed)
    return " ".join(r.choice(vocabulary) for _ in range(n))


ITEMS = [(k, stream(k, 14 + k, "a b c".split())) for k in range(6)] + [(20, "One two, THREE"), (21, "two three"), (22, "three"), (3, "an other text of item three with words of its own as well"), (None, "a text of an item that has no id but ten words"), (30, None), (31, " ,. "), (32, "Ünï-ÇÖDÉ 日本 9x")]
DOCS = [(k, stream(100 + k, 400, "a b c".split())) for k in range(8)] + [(50, None), (51, ""), (52, "one two three! ONE; two"), (53, "so three"), (54, ITEMS[2][1] + " . " + ITEMS[4][1]), (54, ITEMS[2][1]), (None, "no two-three"), (55, "ünï Çödé 日本 9X, É"), (55, "Ünï ÇÖDÉ 日本 9X")]


def test_leaks_equal_brute_force(spark):
    assert leaks_in(spark, DOCS, ITEMS) == brute_leaks(DOCS, ITEMS)
    assert leaks_in(spark, DOCS, ITEMS, least=3) == brute_leaks(DOCS, ITEMS, 3)
    longer = [x for x in ITEMS if len(words_of(x[1])) >= 10]
    assert leaks_in(spark, DOCS, longer) == brute_leaks(DOCS, longer)


def test_leaks_through_more_than_one_automaton(spark, monkeypatch):
    monkeypatch.setattr(leaks, "PART", 7)
    assert leaks_in(spark, DOCS, ITEMS, most_words=40) == brute_leaks(DOCS, ITEMS)


def test_leaks_of_empty_tables(spark):
    assert leaks_in(spark, DOCS, []) == brute_leaks(DOCS, [])
    assert leaks_in(spark, [], ITEMS) == []


def test_leaks_in_a_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(leaks, "BYTES", 1000)
    docs = [(1, stream(5, 60_000, "a b d e".split()) + " " + ITEMS[5][1] + " x" * 5), (2, "x" * 200_000)]
    assert leaks_in(spark, docs, ITEMS) == brute_leaks(docs, ITEMS)


def test_automaton_accepts_what_items_hold():
    grown = leaks.Growing()
    items = [[1, 2, 1, 2, 3], [2, 3, 1], [2, 3], [3, 1, 2, 1]]
    for x in items:
        grown.add(x)
    parts = {tuple(x[a:b]) for x in items for a in range(len(x)) for b in range(a, len(x) + 1)}
    reached, at = {()}, {(): 0}
    while at:
        at = {(*p, c): to for p, k in at.items() for c, to in grown.steps[k].items()}
        reached |= set(at)
    assert reached == parts


def test_decontaminate_cuts_spans_and_drops_covered_documents(spark):
    item = "the quick brown fox jumps over the lazy dog by the river bank today"
    rows = [(1, f"Before it. {item.title()}! Then more words of which there are fifteen or more than that, so it stays whole.", "e"), (2, f"{item} end", "e"), (3, "clean text", None), (4, None, "e"), (5, "", "e")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.text for r in leaks.decontaminate(d, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {1: "Before it. ! Then more words of which there are fifteen or more than that, so it stays whole.", 3: "clean text", 4: None, 5: ""}
    kept = leaks.decontaminate(d, spark.createDataFrame([(1, item)], "item_id long, text string"), longest=20, most_covered=1.0)
    assert kept.columns == d.columns and sorted(map(tuple, kept.collect())) == sorted(rows)
