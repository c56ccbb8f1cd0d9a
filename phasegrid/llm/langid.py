"""Language identification by segmentation-marginalised unigrams.

Over the pieces of a fixed public vocabulary each language has a distribution. A
word's probability in a language is the sum over all its segmentations into
pieces, which the forward algorithm adds up; a text's is the product over its
words. The distributions come from expectation maximisation (forward-backward)
over the words of a bounded sample of texts with a known language.

Words are runs of letters in lower case with a space mark before them. Those of a
batch that have not been seen are scored together, by numpy, one end position at
a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phasegrid.llm.pieces import MARK
from phasegrid.llm.words import bounded_sample, fold, held_out, remembers, turn_to

WORD = re.compile(r"[^\W\d_]+")
#: Texts that the distributions are fitted on at most; rounds of expectation maximisation; added to each expected count.
MOST_TEXTS, MOST_CHARS, ROUNDS, SMOOTHING = 2_000, 32_000_000, 3, 0.05
#: Probability of a character that no piece covers, times the pieces' rest; places after which sums are scaled anew, against underflow.
UNCOVERED, EVERY = 1e-6, 16
#: Words a worker remembers, the longest of them, and places of words that are worked on together.
REMEMBERED, LONGEST, TOGETHER = 150_000, 64, 150_000
UNDETERMINED = "und"


class Vocabulary:
    """The pieces of a model file that words can be made of; probabilities are not read from it."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.automaton, lengths = ahocorasick.Automaton(), []
        for k in range(model.get_piece_size()):
            piece = model.id_to_piece(k)
            if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k)) and WORD.fullmatch(piece.removeprefix(MARK) or "a"):
                self.automaton.add_word(piece, len(lengths))
                lengths.append(len(piece))
        self.automaton.make_automaton()
        self.lengths = np.array(lengths, dtype=np.int64)
        self.size = len(lengths) + 1  # the last one is the uncovered character


@dataclass
class Lattice:
    """All pieces in all places of some words: edges by end, then word."""

    sizes: np.ndarray
    word: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    piece: np.ndarray

    @classmethod
    def of(cls, words: Sequence[str], vocabulary: Vocabulary) -> Lattice:
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        matches = chain.from_iterable(vocabulary.automaton.iter("\n".join(words)))  # no piece goes over a line end
        at, piece = np.fromiter(matches, dtype=np.int64).reshape(-1, 2).T
        at, length = at + 1, vocabulary.lengths[piece]
        starts = np.cumsum(np.concatenate([[0], sizes + 1]))[:-1]
        word = np.searchsorted(starts, at - 1, "right") - 1
        end = at - starts[word]
        # every character can also stand uncovered
        each = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(len(each)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        word, begin = np.concatenate([word, each]), np.concatenate([end - length, place])
        end, piece = np.concatenate([end, place + 1]), np.concatenate([piece, np.full(len(each), vocabulary.size - 1)])
        order = np.lexsort((word, end))
        return cls(sizes, *(a[order].astype(np.int32) for a in (word, begin, end, piece)))

    def forward(self, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """alpha[word, place, language] from the weight of each edge and language, and the logarithm that each was scaled by.

        An edge reaches back no farther than the longest piece, so every few places
        the last ones of a word are scaled to a largest sum of 1, whatever its length.
        """
        alpha = np.zeros((len(self.sizes), int(self.sizes.max(initial=0)) + 1, weight.shape[1]))
        scale = np.zeros_like(alpha)
        alpha[:, 0] = 1.0
        reach = int((self.end - self.begin).max(initial=1))
        cuts = np.searchsorted(self.end, np.arange(1, alpha.shape[1] + 1))
        for place in range(1, alpha.shape[1]):
            own = slice(cuts[place - 1], cuts[place])
            word = self.word[own]
            scale[:, place] = scale[:, place - 1]
            if len(word):
                first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
                alpha[word[first], place] = np.add.reduceat(alpha[word, self.begin[own]] * weight[own], first)
            if place % EVERY == 0:
                _rescale(alpha[:, max(0, place - reach + 1) : place + 1], scale[:, max(0, place - reach + 1) : place + 1])
        return alpha, scale

    def backward(self, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """beta[word, place, language]: the sums behind each place, scaled in the same way."""
        beta = np.zeros((len(self.sizes), int(self.sizes.max(initial=0)) + 1, weight.shape[1]))
        scale = np.zeros_like(beta)
        beta[np.arange(len(self.sizes)), self.sizes] = 1.0
        reach = int((self.end - self.begin).max(initial=1))
        cuts = np.searchsorted(self.end, np.arange(1, beta.shape[1] + 1))
        for place in range(beta.shape[1] - 1, 0, -1):
            own = slice(cuts[place - 1], cuts[place])
            np.add.at(beta, (self.word[own], self.begin[own]), beta[self.word[own], place] * weight[own])
            if place % EVERY == 0:
                window = slice(max(0, place - reach), place)
                inside = place <= self.sizes  # the words that the pass has reached
                part, own_scale = beta[inside, window], scale[inside, window]
                _rescale(part, own_scale)
                beta[inside, window], scale[inside, window] = part, own_scale
                scale[inside, : window.start] = own_scale[:, :1]
        return beta, scale

    def weight(self, probabilities: np.ndarray) -> np.ndarray:
        return probabilities[self.piece]

    def whole(self, alpha: np.ndarray, scale: np.ndarray) -> np.ndarray:
        """[word, language]: log of the sum over all segmentations."""
        at = np.arange(len(self.sizes)), self.sizes
        return np.log(np.maximum(alpha[at], 1e-300)) + scale[at]

    def log_probabilities(self, probabilities: np.ndarray) -> np.ndarray:
        return self.whole(*self.forward(self.weight(probabilities)))


def _rescale(sums: np.ndarray, scale: np.ndarray) -> None:
    """Scale [word, place, language] to a largest place of 1 for each word and language; where all are 0, nothing changes."""
    top = sums.max(axis=1, keepdims=True)
    top[top == 0] = 1.0
    sums /= top
    scale += np.log(top)


def batches_of(words: Sequence[str]) -> Iterator[list[str]]:
    """Words by length, so many together that the places of all, filled up to the longest, are ``TOGETHER`` or one word's."""
    part: list[str] = []
    for w in sorted(words, key=lambda w: (len(w), w)):
        if part and (len(part) + 1) * (len(w) + 1) > TOGETHER:
            yield part
            part = []
        part.append(w)
    if part:
        yield part


@dataclass
class Model:
    languages: list[str]
    probabilities: np.ndarray  # [piece, language]


def words_of(text: str) -> list[str]:
    """Words with their mark. Text without white space is one word, however long."""
    return [MARK + w for w in WORD.findall(text.lower())]


def fit(counts: dict[str, dict[str, int]], vocabulary: Vocabulary, rounds: int = ROUNDS) -> Model:
    """Distributions from word counts by language."""
    languages = sorted(counts)
    parts = []
    for words in batches_of({w for of in counts.values() for w in of}):
        n = np.array([[counts[x].get(w, 0) for x in languages] for w in words], dtype=np.float64).reshape(len(words), len(languages))
        parts.append((n, Lattice.of(words, vocabulary)))
    p = np.full((vocabulary.size, len(languages)), 1.0 / vocabulary.size)
    p[-1] = UNCOVERED
    for _ in range(rounds):
        expected = np.full_like(p, SMOOTHING)
        for n, lattice in parts:
            counted = expected_counts(lattice, p, n)
            expected += counted
        p = expected / expected[:-1].sum(axis=0)
        p[-1] = UNCOVERED
    return Model(languages, p)


def expected_counts(lattice: Lattice, p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """[piece, language]: how often pieces are expected in words that occur ``n`` [word, language] times, over all segmentations."""
    weight = lattice.weight(p)
    alpha, before = lattice.forward(weight)
    beta, behind = lattice.backward(weight)
    logs = before[lattice.word, lattice.begin] + behind[lattice.word, lattice.end] - lattice.whole(alpha, before)[lattice.word]
    share = alpha[lattice.word, lattice.begin] * weight * beta[lattice.word, lattice.end] * np.exp(logs) * n[lattice.word]
    return np.stack([np.bincount(lattice.piece, weights=share[:, k], minlength=len(p)) for k in range(p.shape[1])], axis=1) if p.shape[1] else np.zeros_like(p)


class Scorer:
    """Scores texts; a worker remembers the log-probabilities of many words, one row each, and whether they hold a letter."""

    def __init__(self, model: Model, vocabulary: Vocabulary):
        self.model, self.vocabulary = model, vocabulary
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.rows = np.zeros((0, len(self.model.languages)))

    def sums(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log-probability of each text and language, number of its words)."""
        words = [words_of(t) for t in texts]
        if len(self.index) > REMEMBERED:
            self._forget()
        fresh = {w for of in words for w in of if w not in self.index}
        for part in batches_of(fresh):
            self.index.update(zip(part, range(len(self.rows), len(self.rows) + len(part)), strict=True))
            self.rows = np.concatenate([self.rows, Lattice.of(part, self.vocabulary).log_probabilities(self.model.probabilities)])
        counts = np.array([len(of) for of in words])
        at = np.fromiter((self.index[w] for of in words for w in of), dtype=np.int64, count=int(counts.sum()))
        for w in fresh:
            if len(w) > LONGEST:
                del self.index[w]
        owner, total = np.repeat(np.arange(len(texts)), counts), np.zeros((len(texts), len(self.model.languages)))
        for k in range(total.shape[1]):
            total[:, k] = np.bincount(owner, weights=self.rows[at, k], minlength=len(texts))
        return total, counts


def identify(texts: Sequence[str], scorer: Scorer) -> tuple[list[str], np.ndarray]:
    """(language, its posterior under equal priors) of each text; ``und`` and 0 where there is no letter or nothing was learned."""
    languages = scorer.model.languages
    if not languages or not len(texts):
        return [UNDETERMINED] * len(texts), np.zeros(len(texts))
    total, counts = scorer.sums(texts)
    best = total.argmax(axis=1)
    posterior = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
    letters = [n > 0 and any(c.isalpha() for c in t) for n, t in zip(counts, texts, strict=True)]
    return [languages[k] if has else UNDETERMINED for k, has in zip(best, letters, strict=True)], np.where(letters, posterior, 0.0)


_scorers: dict[tuple[str, bytes], Scorer] = {}
remembers("langid", lambda: _scorers.clear())


def _scorer(model: Model, path: str) -> Scorer:
    """One for each worker and model, so that what it remembers outlives a task."""
    key = (path, hashlib.sha256("\n".join(model.languages).encode() + model.probabilities.tobytes()).digest())
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(model, Vocabulary(path))
    return _scorers[key]


def train(docs: DataFrame, path: str, parts: int = 4, part: int = 2, most: int = MOST_TEXTS) -> Model:
    """Fit on at most ``most`` texts with a language (``MOST_CHARS`` characters in all), outside the held-out part.

    Rows whose ids have the smallest hashes are taken. Their words are counted by
    Spark; the distributions are fitted to the bounded sample's counts in one task,
    and only they reach the driver.
    """
    known = docs.where(F.col("lang").isNotNull() & (fold("doc_id", parts) != part))
    ids = known.select(F.col("doc_id").alias("__id"), F.xxhash64("doc_id").alias("rank")).orderBy("rank", "__id").limit(most).distinct()
    # the language goes with the text, as rows that share an id may differ in it
    tagged = known.select("doc_id", F.concat_ws("\n", "lang", F.coalesce("text", F.lit(""))).alias("text"))
    own = F.split("text", "\n", 2)
    sample = bounded_sample(tagged, ids, most, MOST_CHARS).select(own[0].alias("lang"), own[1].alias("text")).repartition("text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, words = [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = words_of(text or "")
                langs += [lang] * len(own)
                words += own
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string())], ["lang", "word"])

    counted = sample.select("lang", "text").mapInArrow(count, "lang string, word string").groupBy("lang", "word").agg(F.count("*").alias("n"))

    def fitted(rows: pd.DataFrame) -> pd.DataFrame:
        counts: dict[str, dict[str, int]] = {}
        for lang, word, n in zip(rows["lang"], rows["word"], rows["n"], strict=True):
            counts.setdefault(lang, {})[word] = n
        model = fit(counts, Vocabulary(path))
        return pd.DataFrame({"languages": [model.languages], "probabilities": [model.probabilities.tobytes()]})

    got = counted.groupBy(F.lit(0).alias("all")).applyInPandas(fitted, "languages array<string>, probabilities binary").first()
    return Model(list(got.languages), np.frombuffer(got.probabilities).reshape(-1, len(got.languages))) if got else Model([], np.zeros((1, 0)))


def predict(docs: DataFrame, model: Model, path: str) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score``, which replace columns so named. Nothing shuffles; null and empty texts are ``und``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = [c for c in docs.columns if c not in ("lang_pred", "lang_score")]
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("langid")
        scorer = _scorer(shared.value, path)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                own = batch.slice(k, 256)
                found, scores = identify([t or "" for t in own.column(at).to_pylist()], scorer)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(found, pa.string()), pa.array(scores)], [*columns, "lang_pred", "lang_score"])

    source = docs.select(*[f"`{c}`" for c in columns])
    schema = T.StructType([*source.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])
    return source.mapInArrow(run, schema)


def identify_languages(docs: DataFrame, path: str, parts: int = 4, part: int = 2, most: int = MOST_TEXTS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for each row of ``docs``.

    Learns from ``text`` and non-null ``lang`` of at most ``most`` rows outside the
    held-out part (crc32 of the id modulo ``parts`` is ``part``); predictions see
    the text alone. Ties go to the language first in order. A row without an id is
    predicted and is not held out; rows that share an id are predicted each by its
    own text. Nothing to learn from: every text is ``und``. An empty table gives an
    empty result; very long texts are scored whole; other columns are ignored.
    """
    got = predict(docs.select("doc_id", "text"), train(docs, path, parts, part, most), path)
    return got.select("doc_id", held_out("doc_id", parts, part).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
