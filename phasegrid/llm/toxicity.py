"""Toxicity by multiple-instance learning.

A text is toxic if any of its sentences is. Each sentence gets a probability from
logistic regression over its hashed words and their runs of characters (which
catch inflected forms), and a noisy-or joins them into the text's. Only texts have labels: the likelihood's gradient
hands a text's label down to its sentences, most to the likeliest. The trained
model then tells which sentences offend.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasegrid.llm.quality import sigmoid
from phasegrid.llm.words import LONGEST, REMEMBERED, held_out, labelled_sample, mix, ngram_hashes, turn_to, word_hashes

BITS = 18
#: Labelled texts that a model is fitted on at most, passes over them, texts of a step.
MOST_TEXTS, EPOCHS, STEP = 8_000, 8, 200
#: Lengths of the character runs.
RUNS = (4, 5)
#: A feature has to occur in so many texts of the sample; rate and shrinkage of the updates; log-odds of a sentence without features.
LEAST_TEXTS, RATE, L1, BIAS = 4, 0.3, 1e-4, -8.0
SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?\n]+|$)")
WORD = re.compile(r"\w+")
THRESHOLD, OFFENDING = 0.7, 0.5
#: Texts that a worker holds at once.
TOGETHER = 256


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Stretches up to and with a run of ``.!?`` or line ends; those without a word are left out."""
    return [m.span() for m in SENTENCE.finditer(text) if WORD.search(m[0])]


def word_features(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(places, starts): a word's are those of the word itself and of its runs of 4 and 5 characters, ends marked."""
    marked = [f"<{w}>" for w in words]
    sizes = np.array([len(m) for m in marked])
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    hashes, owners = [word_hashes(words)], [np.arange(len(words))]
    for n in RUNS:
        if len(codes) >= n:
            inside = owner[: len(owner) - n + 1] == owner[n - 1 :]
            hashes.append(ngram_hashes(codes, n)[inside])
            owners.append(owner[: len(owner) - n + 1][inside])
    every = np.concatenate(owners)
    order = np.argsort(every, kind="stable")
    places = (mix(np.concatenate(hashes)) >> np.uint64(64 - BITS)).astype(np.int64)[order]
    return places, np.searchsorted(every[order], np.arange(len(words)))


def sentence_words(text: str) -> tuple[list[tuple[int, int]], list[list[str]]]:
    """Sentences and their distinct words in lower case."""
    spans = sentence_spans(text)
    return spans, [list(dict.fromkeys(WORD.findall(text[a:b].lower()))) for a, b in spans]


class Scorer:
    """Scores sentences. A sentence's log-odds are the sum of its words'; a worker remembers those of many words."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.known = weights.astype(np.float64), {}

    def words(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        fresh = [w for w in set(words) if w not in known]
        if fresh:
            places, starts = word_features(fresh)
            known.update(zip(fresh, np.add.reduceat(self.weights[places], starts).tolist(), strict=True))
        out = np.fromiter(map(known.__getitem__, words), dtype=np.float64, count=len(words))
        for w in fresh:
            if len(w) > LONGEST:
                del known[w]
        return out

    def sentences(self, text: str) -> tuple[list[tuple[int, int]], np.ndarray]:
        spans, words = sentence_words(text)
        if not spans:
            return spans, np.zeros(0)
        starts = np.cumsum([0, *map(len, words)])[:-1]
        return spans, sigmoid(np.add.reduceat(self.words([w for of in words for w in of]), starts) + self.weights[-1])


def noisy_or(p: np.ndarray) -> float:
    return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum()))


def fit(texts: list[str], labels: list[int], epochs: int = EPOCHS) -> np.ndarray:
    """Weights of the places and, last, the bias: gradient steps with rates by place, shrunk toward zero."""
    size = 1 << BITS
    rows = [[of for of in sentence_words(t)[1] if of] for t in texts]
    full = [k for k, r in enumerate(rows) if r]
    if not full:
        return np.array([0.0] * size + [BIAS], dtype=np.float32)
    number = {w: k for k, w in enumerate(sorted({w for r in rows for of in r for w in of}))}
    places, starts = word_features(list(number))
    ends = np.append(starts[1:], len(places))
    rows = [(np.array([number[w] for of in r for w in of]), np.cumsum([0, *map(len, r)])[:-1]) if r else None for r in rows]
    in_texts = np.bincount(np.concatenate([np.unique(np.concatenate([places[starts[w] : ends[w]] for w in np.unique(rows[k][0])])) for k in full]), minlength=size)
    used = in_texts >= LEAST_TEXTS
    w, squares = np.zeros(size + 1), np.full(size + 1, 1e-6)
    w[-1] = BIAS
    for _ in range(epochs):
        for begin in range(0, len(full), STEP):
            step = full[begin : begin + STEP]
            words = np.concatenate([rows[k][0] for k in step])
            offsets = np.cumsum([0, *(len(rows[k][0]) for k in step)])
            at = np.concatenate([rows[k][1] + o for k, o in zip(step, offsets, strict=False)])
            first = np.cumsum([0, *(len(rows[k][1]) for k in step)])
            y = np.array([labels[k] for k in step], dtype=np.float64)
            kinds, kind = np.unique(words, return_inverse=True)  # words of the step, each with its places
            counts = ends[kinds] - starts[kinds]
            begins = np.cumsum([0, *counts])[:-1]
            own = places[np.repeat(starts[kinds] - begins, counts) + np.arange(counts.sum())]
            odds = np.add.reduceat(w[own], begins)
            p = np.minimum(sigmoid(np.add.reduceat(odds[kind], at) + w[-1]), 1 - 1e-9)
            clean = np.exp(np.add.reduceat(np.log1p(-p), first[:-1]))  # the chance that no sentence is toxic
            pull = np.where(y > 0, clean / np.maximum(1 - clean, 1e-6), -1.0)
            g_sentence = np.repeat(pull, np.diff(first)) * p
            g_word = np.bincount(kind, weights=np.repeat(g_sentence, np.diff(at, append=len(words))), minlength=len(kinds))
            g = np.bincount(own, weights=np.repeat(g_word, counts), minlength=size + 1)
            g[:size] *= used
            g[-1] = g_sentence.sum()
            g /= len(step)
            squares += g * g
            w += RATE * g / np.sqrt(squares)
            w[:-1] = np.maximum(w[:-1] - L1 * RATE, 0.0)  # harmless words don't make up for an offending one
    return w.astype(np.float32)


def train(sample: DataFrame) -> np.ndarray:
    """Weights from a bounded sample (``text, label, rank``), fitted in one task; for an empty sample those that call nothing toxic."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["rank", "text"])
        return pd.DataFrame({"weights": [fit(rows["text"].tolist(), rows["label"].tolist()).tobytes()]})

    got = sample.groupBy(F.lit(0).alias("all")).applyInPandas(run, "weights binary").first()
    return np.frombuffer(got.weights, dtype=np.float32) if got else np.array([0.0] * (1 << BITS) + [BIAS], dtype=np.float32)


def toxicity_scores(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted, offending`` of each whole text.

    ``offending`` lists start, end (characters) and score of the sentences that
    score ``OFFENDING`` or more, in order. Null and empty texts, and texts without
    a word, score 0 and have none. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("toxicity")
        scorer = Scorer(shared.value)
        for batch in (b.slice(k, TOGETHER) for b in batches for k in range(0, b.num_rows, TOGETHER)):
            scores, found = [], []
            for t in batch.column(1):
                spans, p = scorer.sentences(t.as_py() or "")
                scores.append(noisy_or(p))
                found.append([{"start": spans[k][0], "end": spans[k][1], "score": float(p[k])} for k in np.flatnonzero(p >= OFFENDING)])
            s = np.array(scores, dtype=np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(found, spans_type)], ["doc_id", "score", "predicted", "offending"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, score double, predicted int, offending array<struct<start:int,end:int,score:double>>")


def classify_toxicity(docs: DataFrame, labels: DataFrame, parts: int = 3, part: int = 1, most: int = MOST_TEXTS) -> DataFrame:
    """``doc_id, held_out, score, predicted, offending`` for each row of ``docs``.

    Learns from at most ``most`` texts with ``labels.toxic`` outside the held-out part
    (crc32 of the id modulo ``parts`` is ``part``); null labels teach nothing, an id
    labelled more than once has its largest label. A row without an id is scored
    and is not held out; rows that share an id are scored each by its own text. A
    score of just the threshold predicts 1. No label to learn from: nothing is toxic.
    An empty table gives an empty result; very long texts are scored whole.
    """
    scored = toxicity_scores(docs, train(labelled_sample(docs, labels, "toxic", parts, part, most)))
    return scored.select("doc_id", held_out("doc_id", parts, part).alias("held_out"), "score", "predicted", "offending")
