"""The queries of this subpackage and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasegrid.llm import chat, exact, fingerprint, langid, leaks, mixing, near, negatives, pieces, quality, tokens, toxicity, trie


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_comparison(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_components(table(spark, sf_dir, "documents"), words=3, percent=85)


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources drawn to the square root of their row counts, whole documents."""
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"), power=0.5, seed=17, with_rates=True)
    return mixed.withColumn("mix_rate", F.round("mix_rate", 9))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render_conversations(table(spark, sf_dir, "conversations"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    relabelled = vectors.withColumn("label", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)"))
    return negatives.hard_negatives(relabelled, F.col("id") % 100 == 0)


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(trie.rebuilt_conversations(trie.named_turns(table(spark, sf_dir, "conversations"))))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_document_fingerprints": op1_document_fingerprints,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_toxicity": op3_toxicity,
    "op4_language_id": op4_language_id,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_near_dedup": op6_near_dedup,
    "op7_mix_sources": op7_mix_sources,
    "op8_chat_format": op8_chat_format,
    "op9_token_counts": op9_token_counts,
    "op10_quality": op10_quality,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_decontamination": op13_decontamination,
}

ORACLES = {
    "op5_exact_dedup": r"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)""",
    "op6_near_dedup": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + least(3, len(w)) - 1], ' ') AS shingle FROM (SELECT *, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
        links AS (SELECT x, y FROM common JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
        ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
        reached(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT y, c FROM reached JOIN ways ON x = doc_id WHERE c < y)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, min(c) AS component_id, doc_id = min(c) AS kept FROM reached LEFT JOIN n USING (doc_id) GROUP BY 1, 2""",
    "op7_mix_sources": """
        WITH RECURSIVE sizes AS (SELECT coalesce(source, '') AS src, count(*) AS n FROM documents GROUP BY 1),
        rates AS (SELECT src, (SELECT sum(n) FROM sizes)::DOUBLE * sqrt(n::DOUBLE) / ((SELECT sum(sqrt(n::DOUBLE)) FROM sizes) * n) AS rate FROM sizes),
        each AS (SELECT src, rate, greatest(1, ceil(rate / 64.0))::INTEGER AS parts, rate / greatest(1, ceil(rate / 64.0)) AS mean FROM rates),
        steps AS (
            SELECT src, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS cdf FROM each
            UNION ALL
            SELECT src, mean, k + 1, p * mean / (k + 1), cdf + p * mean / (k + 1) FROM steps WHERE k < 160),
        bands AS (SELECT src, k, cdf, lag(cdf, 1, -1.0) OVER (PARTITION BY src ORDER BY k) AS low FROM steps),
        named AS (SELECT *, coalesce(source, '') AS src, coalesce(doc_id::VARCHAR, '') || '|' || coalesce(source, '') || '|' || md5(coalesce(text, '')) AS name, row_number() OVER () AS nth FROM documents),
        parted AS (SELECT d.nth, d.src, d.name, unnest(range(1, e.parts + 1)) AS part FROM named d JOIN each e USING (src)),
        drawn AS (SELECT *, (('0x' || substr(md5('17|' || name || CASE WHEN part > 1 THEN '|' || part ELSE '' END), 1, 8))::BIGINT + 0.5) / 4294967296.0 AS u FROM parted),
        counted AS (SELECT d.nth, sum(b.k) AS copies FROM drawn d JOIN bands b ON b.src = d.src AND d.u > b.low AND (d.u <= b.cdf OR b.k = 160) GROUP BY 1)
        SELECT doc_id, text, lang, source, n_chars, round(rate, 9) AS mix_rate, c::INTEGER AS copy_index, md5('18|' || name || '|' || c) AS shuffle_key
        FROM (SELECT n.*, r.rate, unnest(range(1, c.copies::BIGINT + 1)) AS c FROM named n JOIN counted c USING (nth) JOIN rates r USING (src))""",
    "op8_chat_format": """
        WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
                   FROM conversations WHERE conv_id IS NOT NULL),
        c AS (SELECT conv_id, count(*) AS n_turns, list({'r': role, 't': text} ORDER BY place) AS turns,
                     string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY place) AS rendered FROM t GROUP BY 1),
        firsts AS (SELECT DISTINCT turns[1:i] AS begun FROM (SELECT turns, unnest(range(1, n_turns)) AS i FROM c)),
        g AS (SELECT turns, min(conv_id) AS conv_id, count(*) AS copies FROM c GROUP BY 1)
        SELECT c.conv_id, c.n_turns, g.copies, c.rendered FROM c JOIN g USING (conv_id) WHERE NOT EXISTS (SELECT 1 FROM firsts WHERE begun = g.turns)""",
    "op11_hard_negatives": """
        WITH v AS (SELECT row_number() OVER () AS nth, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
                   FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.nth, a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.nth <> b.nth WHERE a.vec_id % 100 = 0),
        p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY nth ORDER BY score DESC, vec_id) <= 5)
        SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.nth, p.vec_id ORDER BY n.score DESC, n.vec_id)::INTEGER AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
        FROM p JOIN s n ON n.nth = p.nth AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score QUALIFY rank <= 5""",
    "op12_conversation_trie": """
        WITH RECURSIVE bits AS (SELECT n, n AS c, 0 AS step FROM (SELECT unnest(range(0, 256)) AS n)
            UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM bits WHERE step < 8),
        crc AS (SELECT list(c ORDER BY n) AS held FROM bits WHERE step = 8),
        own AS (SELECT conv_id, list(sha256(concat_ws('|', length(coalesce(role, ''))::VARCHAR, coalesce(role, ''), coalesce(text, ''))) || '|' || octet_length(encode(coalesce(text, '')))
                    ORDER BY turn NULLS FIRST, sha256(concat_ws('|', length(coalesce(role, ''))::VARCHAR, coalesce(role, ''), coalesce(text, '')))) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
        hashed AS (SELECT conv_id, turns, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                    lambda s, b: xor(s >> 8, held[(xor(s, b) & 255) + 1]))) % 9 AS h FROM own, crc),
        rebuilt AS (SELECT a.conv_id, list_concat(coalesce(b.turns, [])[1 : a.h], a.turns[a.h + 1 :]) AS turns FROM hashed a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 5),
        begun AS (SELECT conv_id, turns[1 : d] AS path, d, len(turns) = d AS ends FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)),
        nodes AS (SELECT path, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ended,
                    (count(*) - 1) * coalesce(string_split(path[d], '|')[2]::BIGINT, 0) AS saved FROM begun GROUP BY 1, 2),
        parents AS (SELECT path[1 : depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
        whole AS (SELECT n.*, coalesce(p.n_children, 0) AS n_children FROM nodes n LEFT JOIN parents p USING (path)),
        trees AS (SELECT path[1 : d] AS path, sum((n_children = 0)::INTEGER)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM whole) GROUP BY 1)
        SELECT w.conv_id, w.depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, t.n_leaves, t.saved_tokens, sha256(w.ended) AS ends_sha256
        FROM whole w JOIN trees t USING (path) LEFT JOIN whole p ON w.depth > 0 AND p.path = w.path[1 : w.depth - 1]""",
    "op13_decontamination": r"""
        WITH i AS (SELECT coalesce(item_id::VARCHAR, '') AS name, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        windows AS (SELECT DISTINCT name, least(10, len(w)) AS size, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
        d AS (SELECT row_number() OVER () AS nth, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        runs AS (SELECT nth, k, size, array_to_string(w[k : k + size - 1], ' ') AS gram FROM (SELECT nth, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)),
        hits AS (SELECT nth, k, size, name FROM runs JOIN windows USING (size, gram)),
        words AS (SELECT nth, count(DISTINCT place) AS n_hit FROM (SELECT nth, unnest(range(k, k + size)) AS place FROM hits) GROUP BY 1),
        items AS (SELECT nth, count(*) AS n_items, sha256(string_agg(name, ',' ORDER BY name)) AS items_sha256 FROM (SELECT DISTINCT nth, name FROM hits) GROUP BY 1)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN words USING (nth) LEFT JOIN items USING (nth)""",
}
