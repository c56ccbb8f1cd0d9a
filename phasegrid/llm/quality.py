"""Quality classifier: logistic regression over hashed word n-grams, trained with FTRL-proximal updates.

A text's features are the counts of its words, punctuation runs, pairs of
neighbours and repetitions at a distance of one or two, hashed to ``2**BITS`` places and scaled to length one. Training goes
through a bounded sample of labelled texts in a fixed order, one text at a time,
in one task; scoring is a sparse dot product for each text, in place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasegrid.llm.words import held_out, labelled_sample, ngram_hashes, turn_to, word_hashes

BITS = 18
#: Labelled texts that a model is fitted on at most; times it goes through them.
MOST_TEXTS, EPOCHS = 8_000, 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.2, 0.1
TOKEN = re.compile(r"\w+|[^\w\s]+")
#: What a token that equals the one before it, or the one before that, counts as besides.
_AGAIN = np.uint64(0xA5A5A5A5A5A5A5A5)
THRESHOLD = 0.7
#: Texts that a worker holds at once.
TOGETHER = 256


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of a text, values of Euclidean length one; empty for a text without words."""
    words = word_hashes(TOKEN.findall(text))
    again = np.concatenate([ngram_hashes(words[:1], 1)[:0], *(np.full((words[k:] == words[:-k]).sum(), _AGAIN + np.uint64(k << 45)) for k in (1, 2))])
    places = (np.concatenate([ngram_hashes(words, 1), ngram_hashes(words, 2), again]) >> np.uint64(64 - BITS)).astype(np.int64)
    places, counts = np.unique(places, return_counts=True)
    values = counts.astype(np.float64)
    return places, values / max(1.0, np.sqrt((values * values).sum()))


class Ftrl:
    """Follow the regularised leader, one example at a time; weights exist only where they are read."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, places: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(places)
        g = (sigmoid(w @ values) - label) * values
        n = self.n[places]
        self.z[places] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[places] = n + g * g


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


def fit(texts: list[str], labels: list[int], epochs: int = EPOCHS) -> np.ndarray:
    """``2**BITS`` weights and, last, the bias."""
    size = 1 << BITS
    model = Ftrl(size + 1)
    rows = [features(t) for t in texts]
    rows = [(np.append(p, size), np.append(v, 0.3)) for p, v in rows]
    for _ in range(epochs):
        for (places, values), label in zip(rows, labels, strict=True):
            model.update(places, values, label)
    return model.weights(slice(None)).astype(np.float32)


def score(text: str, weights: np.ndarray) -> float:
    places, values = features(text)
    return float(sigmoid(weights[places] @ values + 0.3 * weights[-1]))


def train(sample: DataFrame) -> np.ndarray:
    """Weights from a bounded sample (``text, label, rank``), fitted in one task; zeros for an empty sample."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["rank", "text"])
        return pd.DataFrame({"weights": [fit(rows["text"].tolist(), rows["label"].tolist()).tobytes()]})

    got = sample.groupBy(F.lit(0).alias("all")).applyInPandas(run, "weights binary").first()
    return np.frombuffer(got.weights, dtype=np.float32) if got else np.zeros((1 << BITS) + 1, dtype=np.float32)


def quality_scores(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` of each whole text. Null and empty texts get the bias alone; other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("quality")
        w = shared.value
        for batch in (b.slice(k, TOGETHER) for b in batches for k in range(0, b.num_rows, TOGETHER)):
            scores = np.array([score(t.as_py() or "", w) for t in batch.column(1)], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double, predicted int")


def classify_quality(docs: DataFrame, labels: DataFrame, parts: int = 4, part: int = 2, most: int = MOST_TEXTS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``.

    Learns from at most ``most`` texts with ``labels.quality`` outside the held-out
    part (crc32 of the id modulo ``parts`` is ``part``); null labels teach nothing,
    an id labelled more than once has its largest label. A row without an id is
    scored and is not held out; rows that share an id are scored each by its own
    text. A score of just the threshold predicts 1. Without any label every score is
    0.5. An empty table gives an empty result; very long texts are scored whole.
    """
    scored = quality_scores(docs, train(labelled_sample(docs, labels, "quality", parts, part, most)))
    return scored.select("doc_id", held_out("doc_id", parts, part).alias("held_out"), "score", "predicted")
