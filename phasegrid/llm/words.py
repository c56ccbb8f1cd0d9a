"""Word hashes remembered by each worker, and bounded samples of labelled rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words a worker remembers, and the longest one it does.
REMEMBERED, LONGEST = 150_000, 64
#: Characters of a sample that a model is fitted on, at most.
MOST_CHARS = 64_000_000
_known: dict[str | bytes, int] = {}

_forget: dict[str, Callable[[], None]] = {"words": _known.clear}


_owner = ""


def remembers(owner: str, forget: Callable[[], None]) -> None:
    """An operator that keeps something in its workers says how to drop it."""
    _forget[owner] = forget


def turn_to(owner: str) -> None:
    """A reused worker that starts on another operator's rows drops what it kept for others."""
    global _owner
    if owner != _owner:
        _owner = owner
        for forget in _forget.values():
            forget()


U = np.uint64
_A, _B, _C, _D = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0xD6E8FEB86659FD93)


def word_hashes(words: Sequence[str] | Sequence[bytes]) -> np.ndarray:
    """64-bit hashes of words (as UTF-8), the same on every machine."""
    known = _known
    try:
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    except KeyError:
        pass
    if len(known) > REMEMBERED:
        known.clear()
    digest, long = xxhash.xxh3_64_intdigest, []
    for w in set(words):
        if w not in known:
            known[w] = digest(w if isinstance(w, bytes) else w.encode("utf-8", "surrogatepass"))
            if len(w) > LONGEST:
                long.append(w)
    out = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    for w in long:
        del known[w]
    return out


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * _D
    x = (x ^ (x >> U(32))) * _D
    return x ^ (x >> U(32))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n words, from the words' hashes."""
    if len(words) < n:
        return words[:0]
    total = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for k in range(n):
        total = (total * _B) + words[k : len(words) - n + 1 + k] * _A
        total ^= total >> U(29)
    return mix(total + U(n) * _C)


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a row without an id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def held_out(id_col: str, parts: int, part: int) -> Column:
    return F.coalesce(fold(id_col, parts) == part, F.lit(False))


def bounded_sample(rows: DataFrame, ids: DataFrame, most: int, most_chars: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``text, rank`` and the columns of ``ids`` but ``__id``, of ``most`` texts and ``most_chars`` characters at most.

    ``ids`` has ``__id`` and ``rank``, ``most`` rows at most, and is broadcast. Of rows equal in id
    and text one is taken; null texts are empty. Only the sample's texts move, to the
    one task that fits a model on them: both bounds hold whatever is repeated.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = rows.select(F.col(id_col).alias("__id"), text.alias("text")).join(F.broadcast(ids), "__id")
    kept = [c for c in ids.columns if c not in ("__id", "rank")]
    once = own.groupBy("rank", "__id", F.xxhash64("text").alias("__text")).agg(F.first("text").alias("text"), *[F.first(c).alias(c) for c in kept])
    first = once.orderBy("rank", "__id", "__text").limit(most)
    so_far = F.sum(F.length("text").cast("long")).over(Window.orderBy("rank", "__id", "__text").rowsBetween(Window.unboundedPreceding, 0))
    return first.withColumn("__so_far", so_far).where(F.col("__so_far") <= most_chars).select("text", "rank", *kept)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, part: int, most: int, id_col: str = "doc_id", text_col: str = "text", most_chars: int = MOST_CHARS) -> DataFrame:
    """``text, label, rank``: texts of at most ``most`` labelled ids outside the held-out part, see ``bounded_sample``.

    The ids are those with the smallest hashes, so that the sample is fixed; an id
    labelled more than once has its largest label.
    """
    open_ids = labels.where(F.col(label).isNotNull() & (fold(id_col, parts) != part)).groupBy(id_col).agg(F.max(label).cast("int").alias("label"))
    chosen = open_ids.select(F.col(id_col).alias("__id"), "label", F.xxhash64(id_col).alias("rank")).orderBy("rank", "__id").limit(most)
    return bounded_sample(docs, chosen, most, most_chars, id_col, text_col).select("text", "label", "rank")
