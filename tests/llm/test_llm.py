"""Small cases of every text operator: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from phasegrid.llm import chat, exact, fingerprint, langid, mixing, near, pieces, quality, tokens, toxicity
from phasegrid.llm.store import BitFilter

BPE = public_tokenizers.path("piece_bpe_32k.model")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in is it on as with by be this from are or an at was for that red blue house river stone light cloud".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) * (r.random() < 0.3) for _ in range(n))


ODD = [(1, None), (2, ""), (3, " \t\n "), (4, "A"), (5, "a" * 70_000), (None, "no id"), (None, None), (7, "twice"), (7, "twice"), (7, "other"), (8, "é日本\U0001f600 x"), (9, prose(1, 30)), (10, prose(1, 30))]


@pytest.fixture(scope="module")
def odd(spark):
    """Awkward rows, with extra columns named like results."""
    rows = [(i, t, "en", "s", 0, "x", True, 1.0, "k", 3) for i, t in ODD]
    return spark.createDataFrame(rows, SCHEMA + ", keep_id string, kept boolean, score double, text_sha256 string, n int")


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


# exact dedup


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        seen = Counter()
        for i in ids:
            seen[i] += 1
            out.append((i, keep, len(ids), i == keep and seen[i] == 1, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact_groups(odd, none):
    assert rows_of(exact.exact_groups(odd), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == brute_exact(ODD)
    assert exact.exact_groups(none).count() == 0


def test_exact_dedup_keeps_whole_rows(spark, odd, none):
    got = exact.exact_dedup(odd)
    assert got.columns == odd.columns
    assert rows_of(got, "doc_id", "text") == sorted({(1, None), (4, "A"), (5, "a" * 70_000), (None, "no id"), (7, "twice"), (7, "other"), (8, ODD[10][1]), (9, ODD[11][1]), (3, " \t\n ")}, key=repr)
    assert exact.exact_dedup(none).count() == 0


def test_exact_groups_in_shards(spark, odd, none):
    """With filters of 32,768 bits each, 3,000 rows need three shards; the groups are the same."""
    rows = [(k, f"text {k % 2900}") for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert exact.shards_for(3000, 1 << 15) == 3
    got = exact.exact_groups(df, max_bits=1 << 15)
    assert rows_of(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == brute_exact(rows)
    two = [(k, f"t{k % 2}") for k in range(300)]  # of three shards one is empty at least
    got = exact.exact_groups(spark.createDataFrame(two, "doc_id long, text string"), max_bits=1 << 12)
    assert rows_of(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == brute_exact(two)


def test_exact_hot_group(spark):
    rows = [(i, "same" if i % 3 else f"own {i}") for i in range(6000)]
    got = exact.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert rows_of(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == brute_exact(rows)


def test_filter_holds_all_and_little_else(spark):
    df = spark.range(4000)
    held = BitFilter.of_keys(df.where("id % 2 = 0"), [F.col("id")], 2000)
    got = held.marked(df, [F.col("id")], "m").collect()
    assert len(got) == 4000 and all(r.m for r in got if r.id % 2 == 0)
    assert sum(r.m for r in got if r.id % 2) < 100
    twice = BitFilter.of_repeated(df.union(df.where("id < 10")), [F.col("id")], 4010, max_bits=1 << 15)
    assert all(r.m for r in twice.marked(df.where("id < 10"), [F.col("id")], "m").collect())
    assert not any(r.m for r in BitFilter.of_keys(df.limit(0), [F.col("id")], 0).marked(df, [F.col("id")], "m").collect())


# near-duplicates


def brute_near(rows, words, percent):
    def own(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()

    sets = {i: own(t) for i, t in rows}
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                if i < j and sets[i] and sets[j] and label[i] != label[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                    low, high = sorted((label[i], label[j]))
                    label = {k: low if v == high else v for k, v in label.items()}
                    changed = True
    return sorted((i, len(sets[i]), label[i], label[i] == i) for i in sets)


def edited(text, r, times):
    w = text.split()
    for _ in range(times):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_near_components(spark, words, percent):
    r = random.Random(percent)
    rows, bases = [], [prose(100 + k, 90) for k in range(8)]
    for b in bases:
        rows += [edited(b, r, r.randrange(5)) for _ in range(12)]
    rows += [None, "", "a", "A", "a b", "  a  B ", prose(5, 400), prose(5, 400).upper()]
    rows = list(enumerate(rows))
    r.shuffle(rows)
    got = near.near_components(spark.createDataFrame([(*x, "c", 1) for x in rows], "doc_id long, text string, component_id string, n long"), words, percent)
    assert rows_of(got, "doc_id", "n_shingles", "component_id", "kept") == sorted(brute_near(rows, words, percent), key=repr)


@pytest.mark.parametrize(("crowd", "words", "percent"), [(2, 3, 85), (8, 5, 80)])
def test_crowds_that_do_not_merge(spark, monkeypatch, crowd, words, percent):
    """Copies edited around the threshold, and texts that share one long passage."""
    monkeypatch.setattr(near, "CROWD", crowd)
    r = random.Random(crowd)
    rows = [edited(prose(100 + b, 120), r, r.randrange(8)) for b in range(3) for _ in range(40)]
    rows += [prose(999, 60) + " " + prose(2000 + k, r.randrange(5, 60)) for k in range(40)]
    r.shuffle(rows)
    rows = list(enumerate(rows))
    got = near.near_components(spark.createDataFrame(rows, "doc_id long, text string"), words, percent)
    assert rows_of(got, "doc_id", "n_shingles", "component_id", "kept") == sorted(brute_near(rows, words, percent), key=repr)


def test_near_dedup_odd_rows(odd, none):
    got = near.near_dedup(odd)
    assert got.columns == odd.columns
    assert {r.doc_id for r in got.collect()} == {1, 2, 3, 4, 5, None, 7, 8, 9}
    assert near.near_dedup(none).count() == 0


def test_keys_find_every_pair_under_the_distance(spark):
    """Pairs 2 * chunks - 1 lanes apart always share a key, wherever the lanes are."""
    r, chunks = np.random.default_rng(3), near.CHUNKS
    lanes, top = chunks * near.LANES, 1 << near.BITS

    def packed(values):
        return [int(sum(int(v) << (near.BITS * k) for k, v in enumerate(values[j : j + near.LANES]))) for j in range(0, lanes, near.LANES)]

    base, rows = r.integers(0, top, lanes), []
    for k in range(200):
        other = base.copy()
        at = r.choice(lanes, 2 * chunks - 1, replace=False)
        other[at] ^= r.integers(1, top, len(at))
        rows.append([k, *packed(other)])
    df = spark.createDataFrame([[-1, *packed(base)], *rows], "id long, " + ", ".join(f"{c} long" for c in near.chunk_names(chunks)))
    keys = {x.id: set(x.k) for x in df.select("id", near.masked_keys(chunks).alias("k")).collect()}
    assert all(keys[-1] & keys[k] for k in range(200))
    far = df.alias("a").join(df.alias("b"), F.col("a.id") == -1).select(F.col("b.id").alias("id"), near.differing_lanes("a", "b", chunks).alias("d")).collect()
    assert {x.d for x in far if x.id >= 0} == {2 * chunks - 1}


def test_chunks_grow_with_the_distance(spark):
    assert near.chunks_for(100) == near.chunks_for(85) == near.CHUNKS < near.chunks_for(70) < near.chunks_for(50)
    for bad in (0, 5, 101):
        with pytest.raises(ValueError, match="dissimilar"):
            near.chunks_for(bad)
    # pairs just above one half: each of two texts has 30 % of its words changed in one stretch
    rows = []
    for k in range(60):
        words = [f"w{k}x{j}" for j in range(100)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:69] + [f"v{k}x{j}" for j in range(31)]))]
    got = near.near_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 50)
    assert rows_of(got, "doc_id", "n_shingles", "component_id", "kept") == sorted(brute_near(rows, 3, 50), key=repr)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 90)], "v long, p long")
    got = {r.v: r.c for r in near.components(edges).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, 90: 90, 100: 90}


# mixing


def test_mixing_hits_the_shares_and_repeats(spark):
    rows = [(k, "t", "en", "big" if k % 10 else "small", 1) for k in range(6000)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix_sources(df, power=0.5, with_rates=True)
    share = {r.source: r["count"] for r in got.groupBy("source").count().collect()}
    want = mixing.expected_share({"big": 5400, "small": 600})
    assert abs(share["small"] / sum(share.values()) - want["small"]) < 0.03
    assert abs(sum(share.values()) - 6000) < 300
    again = mixing.mix_sources(df.repartition(7), power=0.5, with_rates=True)
    assert rows_of(got, "shuffle_key") == rows_of(again, "shuffle_key")
    weighted = mixing.mix_sources(df, weights={"small": 1.0}, total=1200)
    assert {r.source for r in weighted.select("source").distinct().collect()} == {"small"}
    assert abs(weighted.count() - 1200) < 150


def test_poisson_quantile(spark):
    df = spark.range(20000).select(((F.col("id") + 0.5) / 20000).alias("u"))
    got = [r.k for r in df.select(mixing.poisson_quantile(F.col("u"), F.lit(2.5)).alias("k")).collect()]
    assert got == sorted(got) and abs(np.mean(got) - 2.5) < 0.01 and abs(np.var(got) - 2.5) < 0.05


def test_mixing_repeats_a_rare_source_beyond_one_draw(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 20, "rare").otherwise("big").alias("source"))
    got = mixing.mix_sources(df, weights={"rare": 1.0, "big": 1.0}, with_rates=True)
    count = {r.source: (r.n, r.rate) for r in got.groupBy("source").agg(F.count("*").alias("n"), F.max("mix_rate").alias("rate")).collect()}
    assert count["rare"][1] == 100.0
    # Poisson sums of mean 2,000: five standard deviations
    assert all(abs(n - 2000) < 5 * 2000**0.5 for n, _ in count.values())
    copies = got.where("source = 'rare'").groupBy("doc_id").agg(F.count("*").alias("n"), F.max("copy_index").alias("last"), F.countDistinct("shuffle_key").alias("keys")).collect()
    assert len(copies) == 20 and all(r.n == r.last == r.keys for r in copies)


def test_draws_of_large_means_are_poisson(spark):
    df = spark.range(20000).select(mixing.poisson_copies(3, [F.col("id")], F.lit(300.0)).alias("k"))
    mean, var = df.agg(F.avg("k"), F.var_samp("k")).first()
    assert abs(mean - 300) < 5 * (300 / 20000) ** 0.5
    assert abs(var - 300) < 5 * 300 * (2 / 20000) ** 0.5
    small = spark.range(500).withColumn("rate", F.col("id") / 8)
    same = mixing.poisson_copies(3, [F.col("id")], F.col("rate")) == mixing.poisson_quantile(mixing.uniform(3, F.col("id")), F.col("rate"))
    assert small.where(same).count() == 500


def test_mixing_odd_rows(spark, odd, none):
    got = mixing.mix_sources(odd, weights={"s": 1.0}, total=1300.0, with_rates=True)
    assert got.columns == [*odd.columns, "mix_rate", "copy_index", "shuffle_key"]
    rows = got.collect()
    # rate 100: every row comes out about a hundred times, rows equal in id, source and text equally often
    assert {r.mix_rate for r in rows} == {100.0}
    n = Counter((r.doc_id, r.text) for r in rows)
    assert set(n) == {(i, t) for i, t in ODD} and all(60 < v / ODD.count(k) < 140 for k, v in n.items())
    assert n[7, "twice"] % 2 == 0
    assert mixing.mix_sources(none).count() == 0
    unnamed = spark.createDataFrame([(i, None, "s", None) for i in (1, 2)], "doc_id long, text string, source string, lang string")
    assert mixing.mix_sources(unnamed, weights={"t": 1.0}).count() == 0


def test_rows_without_an_id_are_drawn_each_for_itself(spark):
    df = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("s").alias("source"))
    got = mixing.mix_sources(df, weights={"s": 1.0}, total=30_000.0, with_rates=True)
    n, keys, texts, part = got.agg(F.count("*"), F.countDistinct("shuffle_key"), F.countDistinct("text"), F.count_if(F.pmod(F.hash("shuffle_key"), F.lit(8)) == 0)).first()
    # each copy has a place of its own in the shuffle; of texts drawn 1.5 times on average e^-1.5 are left out
    assert abs(n - 30_000) < 1_000 and keys == n
    assert abs(texts - 20_000 * (1 - np.exp(-1.5))) < 400 and abs(part - n / 8) < 400


# chat


def test_chat_keeps_maximal_conversations(spark):
    turns = [("u", "hi"), ("a", "yes"), ("u", None), ("a", "bye")]
    rows = [(1, k, *turns[k]) for k in range(2)] + [(2, k, *turns[k]) for k in range(4)] + [(3, k + 5, *turns[k]) for k in range(4)]
    rows += [(4, 0, "u", "hi"), (4, 1, "a", "no"), (5, None, None, None), (None, 0, "u", "x"), (6, 0, "u", "hia"), (6, 1, "", "yes"), (7, 0, "u", "hi"), (7, 0, "u", "hi")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, n_turns string")
    got = {r.conv_id: (r.n_turns, r.copies, r.rendered) for r in chat.render_conversations(df).collect()}
    assert sorted(got) == [2, 4, 5, 6, 7]
    assert got[2][:2] == (4, 2)
    assert got[2][2] == "<|im_start|>u\nhi<|im_end|>\n<|im_start|>a\nyes<|im_end|>\n<|im_start|>u\n<|im_end|>\n<|im_start|>a\nbye<|im_end|>\n"
    assert chat.render_conversations(df.limit(0)).count() == 0


# tokens


@pytest.fixture(scope="module")
def counter():
    return tokens.Counter(WORD_BPE, 40, 4)


def test_counts_equal_whole_text(counter):
    parts = ["a", "bc", " ", "  ", "\n", "é", "é", "<|endoftext|>", "<|startoftext|> ", "'s", "123", "中文", "ΑΣ", "　", "!!", "a" * 60, " ", "\x1f", "İ"]
    for seed in range(200):
        r = random.Random(seed)
        t = "".join(r.choice(parts) for _ in range(r.randrange(100)))
        assert counter.counts([t]) == [len(counter.encode(t)[0])]
        assert tokens.splice(t, counter.encode, 40, 4)[0] == counter.encode(t)[0]


def test_overlap_widens_where_nothing_can_be_cut(counter):
    t = "x" * 300 + " " + "yz " * 50
    ids, widened = tokens.splice(t, counter.encode, 40, 4)
    assert ids == counter.encode(t)[0] and widened > 0


def test_token_counts(odd, none):
    whole = tokens.Counter(WORD_BPE)
    got = rows_of(tokens.token_counts(odd, WORD_BPE), "doc_id", "n_bytes", "n_tokens", "over_limit")
    want = [(i, len((t or "").encode()), len(whole.encode(t or "")[0])) for i, t in ODD]
    assert got == sorted(((*w, w[2] > 2048) for w in want), key=repr)
    assert tokens.token_counts(none, WORD_BPE).count() == 0


# pieces


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Pieces(BPE)


def test_pieces_round_trip(vocabulary):
    for t in ["", " ", "  a  b ", "日本語 テスト\n\tx", "\U0001f600 á", "a" * 500, "\x00\x01\r\n", "é" * 50, " x"]:
        assert vocabulary.decode(vocabulary.encode(t)[0]) == t


def test_best_path_by_trying_all(vocabulary):
    def brute(s):
        best = {0: (0.0, ())}
        for end in range(1, len(s) + 1):
            options = [(best[k][0] + vocabulary.scores[s[k:end]], best[k][1] + (s[k:end],)) for k in range(end) if s[k:end] in vocabulary.scores]
            if s[end - 1] not in vocabulary.scores:
                options.append((best[end - 1][0] + vocabulary.least, best[end - 1][1] + (s[end - 1],)))
            best[end] = max(options, key=lambda o: o[0])
        return best[len(s)][0]

    for seed in range(60):
        r = random.Random(seed)
        s = "▁" + "".join(r.choice("etaoinshrdlué日\r") for _ in range(r.randrange(1, 14)))
        assert vocabulary.best(s)[1] == brute(s)


def test_pieces_as_the_library_does_for_a_unigram_model(vocabulary):
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    import sentencepiece

    m = pb.ModelProto()
    with open(BPE, "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1
    least = min(p.score for p in m.pieces if p.score > pieces.OFF)
    for p in m.pieces:
        if p.score <= pieces.OFF:
            if len(p.piece) == 1:
                p.score = least
            else:
                p.type = 5
    library = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    for seed in range(40):
        t = prose(seed, 40) + " Größe é"
        assert vocabulary.encode(t)[0] == library.encode(t)


def test_encode_and_decode_documents(odd, none):
    coded = pieces.encode_documents(odd, BPE)
    assert all(r.round_trip and r.n_pieces == len(r.pieces) for r in coded.collect())
    assert rows_of(pieces.decode_documents(coded, BPE), "doc_id", "text") == sorted(((i, t or "") for i, t in ODD), key=repr)
    assert pieces.encode_documents(none, BPE).count() == 0


# fingerprints


def test_equal_substrings_share_interior_names():
    shared = prose(3, 600)
    for a, b in zip(fingerprint.levels([shared]), fingerprint.levels(["some words first " + shared + " and last"]), strict=False):
        one, two = set(a[1].tolist()), set(b[1].tolist())
        if len(one) > 100:
            assert len(one & two) / len(one) > 0.95


def test_texts_do_not_mix_in_a_batch():
    texts = ["", "a", "aa", "ab", prose(1, 50), "z" * 1000, prose(2, 80), "abab" * 100]
    together = fingerprint.sketches(texts)
    for k, t in enumerate(texts):
        assert (together[k] == fingerprint.sketches([t])[0]).all()
    assert fingerprint.from_text(fingerprint.to_text(together)).tolist() == together.tolist()
    assert fingerprint.likeness(together[:1], together[:1])[0] == 1.0


def test_edit_comparison(spark, odd, none):
    rows = [(k * 3, prose(k, 5 + k)) for k in range(120)] + [(3, "again"), (1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = fingerprint.edit_comparison(df).collect()
    order = sorted(((i, t or "") for i, t in rows), key=lambda x: (-x[0], hashlib.sha256(x[1].encode()).hexdigest()))
    want = Counter()
    for (i, t), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        e = fingerprint.edited_text(t, following)
        s = fingerprint.sketches([t, e, following])
        want[(i, len(t), hashlib.sha256(e.encode()).hexdigest(), *fingerprint.to_text(s[:2]), float(fingerprint.likeness(s[:1], s[1:2])[0]), float(fingerprint.likeness(s[:1], s[2:])[0]))] += 1
    assert Counter(tuple(r) for r in got) == want
    assert len(fingerprint.edit_comparison(odd).collect()) == len(ODD)
    assert fingerprint.edit_comparison(none).count() == 0
    assert fingerprint.fingerprints(odd).count() == len(ODD)
    one = fingerprint.edit_comparison(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest()


# language


def test_forward_sums_all_segmentations():
    v = langid.Vocabulary(BPE)
    names = {v.automaton.get(p): p for p in v.automaton}
    p = np.random.default_rng(0).random((v.size, 2)) * 1e-3
    by_name = {n: p[k] for k, n in names.items()}

    def brute(s):
        total = [np.ones(2)]
        for end in range(1, len(s) + 1):
            own = total[end - 1] * p[-1]
            for k in range(end):
                if s[k:end] in by_name:
                    own = own + total[k] * by_name[s[k:end]]
            total.append(own)
        return np.log(total[-1])

    words = ["▁the", "▁größe", "▁日本", "▁x"]
    assert np.allclose(langid.Lattice.of(words, v).log_probabilities(p), [brute(w) for w in words])


def test_languages_are_told_apart(spark, none):
    en, de = "the house and the river with stones for this".split(), "der fluss und das haus mit steinen für diese".split()
    r = random.Random(0)
    rows = [(k, " ".join(r.choice(en if k % 2 else de) for _ in range(12)), "en" if k % 2 else "de", "s", 0) for k in range(200)]
    rows += [(1000, None, "en", "s", 0), (1001, "", None, "s", 0), (1002, "123 ²!", "de", "s", 0), (None, "the river", None, "s", 0), (1003, "x" * 500, None, "s", 0)]
    got = langid.identify_languages(spark.createDataFrame(rows, SCHEMA), BPE).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert all(by[k].lang_pred == ("en" if k % 2 else "de") for k in range(200))
    assert [by[k].lang_pred for k in (1000, 1001, 1002)] == ["und"] * 3 and by[None].lang_pred == "en" and not by[None].held_out
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    assert langid.identify_languages(none, BPE).count() == 0
    unlearned = langid.identify_languages(spark.createDataFrame([(1, "word", None, "s", 0)], SCHEMA), BPE).collect()
    assert unlearned[0].lang_pred == "und" and unlearned[0].score == 0


# classifiers


def labelled(spark):
    r = random.Random(1)
    rows, labels = [], []
    for k in range(500):
        bad = k % 3 == 0
        text = ". ".join(" ".join(r.choice(WORDS) for _ in range(8)) for _ in range(5))
        rows.append((k, text.replace(". ", ". nasty word ", 2) if bad else text, "en", "s", 0))
        labels.append((k, int(not bad), int(bad)))
    rows += [(900, None, None, None, None), (901, "", "en", "s", 0), (None, "word", "en", "s", 0)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels + [(0, None, None), (1, 1, 0), (7777, 1, 1)], "doc_id long, quality int, toxic int")


def test_toxicity_finds_texts_and_sentences(spark, none):
    docs, labels = labelled(spark)
    got = toxicity.classify_toxicity(docs, labels).collect()
    assert len(got) == 503 and all(0 <= r.score <= 1 for r in got)
    known = [r for r in got if r.doc_id is not None and r.doc_id < 500]
    assert all(r.predicted == (r.doc_id % 3 == 0) for r in known)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in known)
    text = {r.doc_id: r.text for r in docs.collect()}
    found = [text[r.doc_id][s.start : s.end] for r in known for s in r.offending]
    assert found and all("nasty" in f for f in found)
    assert toxicity.classify_toxicity(docs, labels.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.classify_toxicity(docs.limit(0), labels).count() == 0


def test_quality_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    got = quality.classify_quality(docs, labels).collect()
    assert len(got) == 503 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 50 and all(r.predicted == (r.doc_id % 3 != 0) for r in held)
    assert quality.classify_quality(docs.limit(0), labels).count() == 0
    assert {r.score for r in quality.classify_quality(docs, labels.limit(0)).collect()} == {0.5}


# pipeline


def test_pipeline_stages(spark, odd):
    import corpus_pipeline

    docs = spark.createDataFrame([(k, prose(k // 2, 60) if k < 60 else "!!!", "en", f"s{k % 3}", 0) for k in range(70)] + [(99, None, None, None, None)], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, "")
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "language":
            assert ids == set(range(60))
        if name in ("exact_copies", "near_copies"):
            assert ids == set(range(0, 60, 2))
        if name != "encoding":
            assert docs.columns == before.columns
    assert all(r.round_trip for r in docs.collect())
    assert corpus_pipeline.STAGES[0][1](spark, odd.limit(0), "").count() == 0
