"""Operators that SQL can't express, against plain versions written from their definitions."""

import hashlib
import math
import random
from bisect import bisect_right

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from phasegrid.llm import fingerprint, langid, pieces, quality, tokens, toxicity, words

TOP = (1 << 64) - 1


# fingerprints


def mixed(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & TOP
    x = (x ^ x >> 27) * 0x94D049BB133111EB & TOP
    return x ^ x >> 31


def tossed(left, own):
    """Twice the lowest bit in which two differing names differ, plus that bit of the own one."""
    low = (left ^ own) & -(left ^ own)
    return 2 * (low.bit_length() - 1) + (own & low > 0)


def parsed(text):
    """Names of each level, one text and one name at a time."""
    names, level = [ord(c) + 1 for c in text], 0
    while names:
        yield names
        runs = []
        for x in names:
            if runs and runs[-1][0] == x:
                runs[-1][1] += 1
            else:
                runs.append([x, 1])
        names = [x if n == 1 else mixed((x * 0x9E3779B97F4A7C15 + n) & TOP) for x, n in runs]
        if len(names) == 1:
            return
        labels = [tossed(names[k - 1] if k else names[0] ^ TOP, x) for k, x in enumerate(names)]
        for _ in range(3):
            labels = [tossed(labels[k - 1] if k else x ^ 1, x) for k, x in enumerate(labels)]
        for value in (5, 4, 3):
            around = [7, *labels, 7]
            labels = [x if x != value else min({0, 1, 2} - {around[k], around[k + 2]}) for k, x in enumerate(labels)]
        inner = range(1, len(labels) - 1)
        tops = {k for k in inner if labels[k - 1] < labels[k] > labels[k + 1]}
        lows = {k for k in inner if labels[k - 1] > labels[k] < labels[k + 1] and not {k - 1, k + 1} & tops}
        starts = sorted({0} | tops | lows)
        level += 1
        place = [mixed((k + 1) * 0x9E3779B97F4A7C15 & TOP) | 1 for k in range(64)]
        names = [mixed((sum(names[k] * place[(k - a) & 63] for k in range(a, b)) + level) & TOP) for a, b in zip(starts, [*starts[1:], len(names)], strict=True)]


def test_parse_equals_a_plain_one():
    r = random.Random(1)
    texts = ["", "a", "aaaa", "ab", "abab" * 30, "é日本\U0001f600 x", "a" * 500 + "b" * 3] + ["".join(r.choice("abcde \n") for _ in range(r.randrange(400))) for _ in range(30)]
    got = {k: [] for k in range(len(texts))}
    for _, names, doc in fingerprint.levels(texts):
        for k in np.unique(doc):
            got[int(k)].append(names[doc == k].tolist())
    assert got == {k: list(parsed(t)) for k, t in enumerate(texts)}
    for t, values in zip(texts, fingerprint.sketches(texts), strict=True):
        own = list(parsed(t))
        used = [x for level in own[fingerprint.FIRST_LEVEL :] for x in level]
        if len(used) < fingerprint.FEW:
            used = [x for level in own[1:] or own for x in level]
        least = {}
        for x in used:
            least[x & 63] = min(least.get(x & 63, TOP), x >> 6)
        assert values.tolist() == [mixed(least[b]) % 0xFFFF if b in least else 0xFFFF for b in range(64)]


def test_short_texts_have_a_graded_likeness():
    """Half-edited texts of some words are neither strangers nor the same; unrelated ones are hardly alike."""
    r = random.Random(4)
    words = ["".join(r.choice("abcdefghijklmnoprstuvwz") for _ in range(r.randrange(3, 9))) for _ in range(400)]
    texts = [" ".join(r.sample(words, k)) for k in (2, 3, 4, 6, 9) for _ in range(40)]
    edits = [fingerprint.edited_text(t, u) for t, u in zip(texts, texts[1:] + texts[:1], strict=True)]
    values = fingerprint.sketches([*texts, *edits])
    own, edited = values[: len(texts)], values[len(texts) :]
    near, strange = fingerprint.likeness(own, edited), fingerprint.likeness(own, np.roll(own, 1, axis=0))
    assert ((near > 0) & (near < 1)).mean() > 0.7 and near.mean() > 0.15 and strange.mean() < 0.05
    one = fingerprint.sketches(["", "a", "b", "aaa"])
    assert (one[0] == fingerprint.EMPTY).all() and len({tuple(x) for x in one[:3].tolist()}) == 3
    assert (one[3] == one[1]).all()  # a run of one character counts as that character


def test_ranges_of_many_partitions(spark):
    cuts = sorted(random.Random(2).sample(range(10**9), 80_000))
    df = spark.range(3000).withColumn("x", F.pmod(F.xxhash64("id"), F.lit(10**9)))
    assert all(r.k == bisect_right(cuts, r.x) for r in df.select("x", fingerprint.cuts_below(cuts, F.col("x")).alias("k")).collect())


# classifiers


def test_toxicity_step_is_the_gradient():
    """One step over one batch moves each weight along the numerical derivative of the texts' likelihood."""
    texts = ["bad words here. nice day", "nice day. nice words", "a bad day. here", "bad nice. day words here", "nice here. words", "day day. bad"]
    labels, size = [1, 0, 1, 1, 0, 0], 1 << toxicity.BITS
    sentences = [[np.concatenate([toxicity.word_features([w])[0] for w in of]) for of in toxicity.sentence_words(t)[1]] for t in texts]
    in_texts = np.bincount(np.concatenate([np.unique(np.concatenate(of)) for of in sentences]), minlength=size)

    def likelihood(w):
        total = 0.0
        for of, y in zip(sentences, labels, strict=True):
            clean = sum(math.log1p(-1 / (1 + math.exp(-(w[places].sum() + w[-1])))) for places in of)
            total += math.log(-math.expm1(clean)) if y else clean
        return total / len(texts)

    start = np.zeros(size + 1)
    start[-1] = toxicity.BIAS
    got = toxicity.fit(texts, labels, epochs=1)
    checked = 0
    for k in [*np.flatnonzero(in_texts)[::3], size]:
        step = np.zeros(size + 1)
        step[k] = 1e-4
        g = (likelihood(start + step) - likelihood(start - step)) / 2e-4 if k == size or in_texts[k] >= toxicity.LEAST_TEXTS else 0.0
        want = start[k] + toxicity.RATE * g / math.sqrt(1e-6 + g * g)
        if k != size:
            want = max(want - toxicity.L1 * toxicity.RATE, 0.0)
        assert got[k] == pytest.approx(want, abs=1e-4)
        checked += g != 0
    assert checked > 5


def test_quality_updates_are_those_of_the_paper():
    r = random.Random(3)
    texts = [" ".join(r.choice("good fine clear spam spam buy now !!".split()) for _ in range(r.randrange(1, 25))) for _ in range(40)] + [""]
    labels = [int("good" in t) for t in texts]
    z, n = {}, {}

    def weight(i):
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= quality.L1 else -(zi - math.copysign(quality.L1, zi)) / ((quality.BETA + math.sqrt(n.get(i, 0.0))) / quality.ALPHA + quality.L2)

    for _ in range(2):
        for t, y in zip(texts, labels, strict=True):
            places, values = quality.features(t)
            x = {**dict(zip(places.tolist(), values.tolist(), strict=True)), 1 << quality.BITS: 0.3}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * x[i] for i in x)))
            for i, v in x.items():
                g = (p - y) * v
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / quality.ALPHA
                z[i], n[i] = z.get(i, 0.0) + g - sigma * w[i], n.get(i, 0.0) + g * g
    got = quality.fit(texts, labels, epochs=2)
    assert len(got) == (1 << quality.BITS) + 1
    assert all(got[i] == pytest.approx(weight(i), abs=1e-5) for i in z)
    assert set(np.flatnonzero(got).tolist()) <= set(z)


def test_samples_are_bounded_by_rows_and_characters(spark):
    rows = [(1, "one text")] * 3000 + [(k, f"{k} " + "x" * 96) for k in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, None) for k in range(1, 60)] + [(2, 1, None)], "doc_id long, toxic int, quality int")
    got = words.labelled_sample(docs, labels, "toxic", 3, 1, 20).collect()
    assert 0 < len(got) <= 20 and len({r.text for r in got}) == len(got)
    few = words.labelled_sample(docs, labels, "toxic", 3, 1, 50, most_chars=1000).collect()
    assert 0 < sum(len(r.text) for r in few) <= 1000
    assert words.labelled_sample(docs, labels, "quality", 3, 1, 20).count() == 0


@pytest.mark.parametrize("operator", [toxicity.classify_toxicity, quality.classify_quality])
def test_classifiers_on_odd_rows(spark, operator):
    rows = [(1, None), (2, ""), (3, "word " * 60_000), (None, "no id"), (4, "twice"), (4, "twice"), (4, "other"), (5, "...")]
    docs = spark.createDataFrame([(*x, 0.5, "clash") for x in rows], "doc_id long, text string, score double, label string")
    labels = spark.createDataFrame([(k, None, None) for k in range(6)] + [(4, 1, 1), (4, 0, 0), (2, 0, 0), (None, 1, 1)], "doc_id long, toxic int, quality int")
    got = operator(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert len({r.score for r in got if r.doc_id is not None and r.doc_id in (1, 2)}) == 1
    assert operator(docs.limit(0), labels).count() == 0
    assert operator(docs, labels.limit(0)).count() == len(rows)


# token counts


def test_widening_stays_linear():
    """A text without a place to cut is encoded over a few times its length in all, not its square."""
    seen = []

    def encode(part):
        seen.append(len(part))
        return list(range(len(part))), [(k, k + 1) for k in range(len(part))]

    ids, _ = tokens.splice("x" * 1_000_000, encode)
    assert len(ids) == 1_000_000 and sum(seen) < 8_000_000


# the pipeline


def brute_copies(docs, seed=17):
    """Poisson counts from the hashed number, by summing probabilities."""
    n = {}
    for d in docs:
        n[d.source or ""] = n.get(d.source or "", 0) + 1
    share = {s: math.sqrt(k) for s, k in n.items()}
    out = []
    for d in docs:
        s = d.source or ""
        rate = len(docs) * share[s] / sum(share.values()) / n[s]
        name = f"{'' if d.doc_id is None else d.doc_id}|{s}|{hashlib.md5((d.text or '').encode()).hexdigest()}"
        u = (int(hashlib.md5(f"{seed}|{name}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32
        k, p = 0, math.exp(-rate)
        cdf = p
        while cdf < u:
            k += 1
            p *= rate / k
            cdf += p
        out += [(d.doc_id, d.text)] * k
    return sorted(out, key=repr)


def test_pipeline_against_plain_stages(spark):
    """Each stage on what the one before it kept."""
    r = random.Random(5)
    vocabulary = {"aa": "the and with from house river stone".split(), "bb": "der und mit von haus fluss stein".split()}
    rows = []
    for k in range(60):
        lang = "aa" if k % 2 else "bb"
        rows.append((k, " ".join(r.choice(vocabulary[lang]) + r.choice(["", "", "s", "en"]) for _ in range(60)), lang, f"s{k % 3}", 0))
    near = rows[7][1].split()
    near[30] = "changed"
    rows += [(100, rows[4][1], None, "s0", 0), (101, "  ".join(rows[5][1].split()), "aa", None, 0), (102, " ".join(near), "aa", "s1", 0), (103, None, None, None, None), (104, "12 34", "aa", "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    told = stages["language"](spark, docs, "").cache()
    assert {x.doc_id: x.lang for x in told.collect()} == {**{k: x[2] for k, x in enumerate(rows[:60])}, 100: "bb", 101: "aa", 102: "aa"}
    once = stages["exact_copies"](spark, told, "").cache()
    assert sorted(x.doc_id for x in once.collect()) == [*range(60), 102]
    kept = stages["near_copies"](spark, once, "").cache()
    assert sorted(x.doc_id for x in kept.collect()) == [*range(60)]
    mixed_docs = stages["mixture"](spark, kept, "").cache()
    assert sorted(((x.doc_id, x.text) for x in mixed_docs.collect()), key=repr) == brute_copies(kept.collect())
    own = pieces.Pieces(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    for x in stages["encoding"](spark, mixed_docs, "").collect():
        text = rows[x.doc_id][1]
        assert x.round_trip and own.decode(x.pieces) == text and x.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_pipeline_stages_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, "")
        assert got.count() == 0
        assert name == "encoding" or got.columns == docs.columns


def test_pieces_when_stretches_are_forgotten(monkeypatch):
    """Results are the same whatever a worker remembers."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    draw = random.Random(11)
    texts = [" ".join("".join(draw.choice("abcé日\n") for _ in range(draw.randrange(1, 9))) for _ in range(draw.randrange(40))) for _ in range(60)]
    texts += ["", "x" * 500, "the the the"]
    one = [pieces.Pieces(path).encode(t) for t in texts[:5]]
    whole = pieces.Pieces(path)
    expected = [whole.encode(t) for t in texts]
    monkeypatch.setattr(pieces, "REMEMBERED", 20)
    short = pieces.Pieces(path)
    assert [short.encode(t) for t in texts] == expected and expected[:5] == one
    assert len(short.known) < len(whole.known)


# language identification


def plain_passes(word, vocabulary, p, k):
    """(log of the sum over segmentations, expected count of each piece) of a word in language k, in logarithms, one place at a time."""
    edges = [(end + 1 - int(vocabulary.lengths[i]), end + 1, i) for end, i in vocabulary.automaton.iter(word)] + [(c, c + 1, vocabulary.size - 1) for c in range(len(word))]
    add = lambda a, b: b if a == -math.inf else a if b == -math.inf else max(a, b) + math.log1p(math.exp(-abs(a - b)))
    alpha, beta = [-math.inf] * (len(word) + 1), [-math.inf] * (len(word) + 1)
    alpha[0] = beta[-1] = 0.0
    for b, e, i in sorted(edges, key=lambda x: x[1]):
        alpha[e] = add(alpha[e], alpha[b] + math.log(p[i, k]))
    for b, e, i in sorted(edges, key=lambda x: -x[0]):
        beta[b] = add(beta[b], beta[e] + math.log(p[i, k]))
    counts = np.zeros(len(p))
    for b, e, i in edges:
        counts[i] += math.exp(alpha[b] + math.log(p[i, k]) + beta[e] - alpha[-1])
    return alpha[-1], counts


def test_words_of_any_length_equal_plain_passes():
    v = langid.Vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    r = np.random.default_rng(1)
    p = r.random((v.size, 2)) ** 6
    p /= p.sum(axis=0)
    p[-1] = langid.UNCOVERED
    letters = "abcdefghilmnoprstué日本"
    words = [langid.MARK + "".join(r.choice(list(letters), n)) for n in (1, 5, 39, 40, 41, 80, 100, 700)] + ["ж" * 120, langid.MARK + "the"]
    lattice = langid.Lattice.of(words, v)
    want = np.array([[plain_passes(w, v, p, k)[0] for k in range(2)] for w in words])
    assert np.allclose(lattice.log_probabilities(p), want, rtol=1e-10)
    n = r.integers(0, 5, (len(words), 2)).astype(float)
    counts = np.stack([sum(n[j, k] * plain_passes(w, v, p, k)[1] for j, w in enumerate(words)) for k in range(2)], axis=1)
    assert np.allclose(langid.expected_counts(lattice, p, n), counts, rtol=1e-8, atol=1e-12)


def test_text_without_spaces_is_one_word():
    assert langid.words_of("Ab" * 300 + " c1d") == [langid.MARK + "ab" * 300, langid.MARK + "c", langid.MARK + "d"]
    v = langid.Vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    scorer = langid.Scorer(langid.Model(["x", "y"], np.full((v.size, 2), 1.0 / v.size)), v)
    once, n = scorer.sums(["ab" * 300, "", "ab cd ab"])
    again, _ = scorer.sums(["ab" * 300, "", "ab cd ab"])
    assert n.tolist() == [1, 0, 3] and np.array_equal(once, again) and all(len(w) <= langid.LONGEST for w in scorer.index)


def test_words_are_batched_by_length(monkeypatch):
    monkeypatch.setattr(langid, "TOGETHER", 30)
    got = list(langid.batches_of({"a" * n for n in (1, 2, 3, 9, 14, 100)}))
    assert sorted(len(w) for part in got for w in part) == [1, 2, 3, 9, 14, 100] and all(len(part) == 1 or len(part) * (max(map(len, part)) + 1) <= 30 for part in got)
