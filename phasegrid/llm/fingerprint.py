"""Document fingerprints by locally consistent parsing.

A text is parsed into phrases, phrases into longer phrases, and so on. At each
level runs of one name are folded, deterministic coin tossing turns names into a
handful of labels (twice the lowest bit in which a name differs from its left
neighbour, plus that bit, repeated until the labels are below six, then reduced
to three), and label maxima, with the minima between them, start the phrases. A
boundary thus depends on a few neighbours only, so equal substrings get the same
phrase names inside, wherever they stand. A name is a 64-bit hash of what it is
made of. The fingerprint is a one-permutation sketch of the names of level
``FIRST_LEVEL`` and up; a text with fewer than ``FEW`` of them, some words long,
adds its names of lower levels, so that the likeness of short texts is graded too.

numpy parses many texts at once; the only state between rows is the arrays of
one batch, whose characters are bounded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of lower levels are a few characters long and occur in most texts of a language.
FIRST_LEVEL, LEVELS = 3, 40
#: Names of FIRST_LEVEL and up with which a text needs no others.
FEW = 8
#: Bins of a sketch; each is 16 bits in the fingerprint, with EMPTY for a bin without a name.
BINS, EMPTY = 64, 0xFFFF
#: Characters parsed together (a longer text is parsed alone, whole).
TOGETHER = 150_000

U = np.uint64
_M1, _M2, _M3 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * _M2
    x = (x ^ (x >> U(27))) * _M3
    return x ^ (x >> U(31))


#: Odd multipliers of the places in a phrase; a phrase is a few names long.
_PLACE = _mix(np.arange(1, 65, dtype=np.uint64) * _M1) | U(1)


def _coin_table(size: int) -> np.ndarray:
    """table[left * size + own]: the label that coin tossing gives ``own`` next to ``left``."""
    left, own = np.divmod(np.arange(size * size, dtype=np.int64), size)
    low = (left ^ own) & -(left ^ own)
    at = np.bitwise_count((low - 1).astype(np.uint64)).astype(np.int64)
    return np.where(left == own, 0, 2 * at + ((own & low) > 0)).astype(np.uint8)


def _reduce_table(value: int) -> np.ndarray:
    """table[left * 64 + own * 8 + right]: ``own``, but ``value`` becomes the least of 0..2 that no neighbour has."""
    out = np.empty(512, dtype=np.uint8)
    for k in range(512):
        left, own, right = k >> 6, k >> 3 & 7, k & 7
        out[k] = own if own != value else min({0, 1, 2} - {left, right})
    return out


_COIN = [_coin_table(128), _coin_table(16), _coin_table(8)]
_REDUCE = [_reduce_table(v) for v in (5, 4, 3)]
#: What stands for the neighbour beyond either end of a text.
_END = 7


def _starts(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where phrases begin. Equal neighbours have been folded; ``first`` marks a text's first name."""
    left = np.empty_like(names)
    left[0], left[1:] = 0, names[:-1]
    left[first] = ~names[first]
    low = names ^ left
    low &= U(0) - low
    labels = np.bitwise_count(low - U(1)) * np.uint8(2) + ((names & low) > 0).astype(np.uint8)
    for table, size in zip(_COIN, (128, 16, 8), strict=True):
        at = labels.astype(np.uint16)
        at[1:] += labels[:-1].astype(np.uint16) * np.uint16(size)
        at[first] = labels[first] + np.uint16(size) * (labels[first] ^ np.uint16(1))
        labels = table[at]
    last = np.empty_like(first)
    last[-1], last[:-1] = True, first[1:]

    def windows(x: np.ndarray) -> np.ndarray:
        before, after = np.empty_like(x), np.empty_like(x)
        before[1:], after[:-1] = x[:-1], x[1:]
        before[first], after[last] = _END, _END
        return before.astype(np.uint16) * np.uint16(64) + x.astype(np.uint16) * np.uint16(8) + after

    for table in _REDUCE:
        labels = table[windows(labels)]
    before, after = np.full_like(labels, _END), np.full_like(labels, _END)
    before[1:], after[:-1] = labels[:-1], labels[1:]
    inside = ~first & ~last
    top = inside & (labels > before) & (labels > after)
    bottom = inside & (labels < before) & (labels < after)
    near = top.copy()
    near[1:] |= top[:-1]
    near[:-1] |= top[1:]
    return first | top | (bottom & ~near)


def _fold(names: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A run of one name becomes a name made of the name and its length."""
    new = np.empty(len(names), dtype=bool)
    new[0] = True
    np.not_equal(names[1:], names[:-1], out=new[1:])
    new[1:] |= doc[1:] != doc[:-1]
    if new.all():
        return names, doc
    at = np.flatnonzero(new)
    length, own = _gaps(at, len(names)), names[at]
    runs = np.flatnonzero(length > 1)
    own[runs] = _mix(own[runs] * _M1 + length[runs].astype(np.uint64))
    return own, doc[at]


def _gaps(at: np.ndarray, end: int) -> np.ndarray:
    """Lengths of the stretches that start at ``at``; the last ends at ``end``."""
    out = np.empty(len(at), dtype=np.int32)
    np.subtract(at[1:], at[:-1], out=out[:-1], casting="unsafe")
    out[-1] = end - at[-1]
    return out


def levels(texts: Sequence[str], start: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(level, names, index of the text of each name), for level 0 (characters) upward.

    A text with a single name left goes no higher; ``start`` only numbers level 0.
    """
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    names, doc = code.astype(np.uint64) + U(1), np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    for level in range(start, start + LEVELS):
        if not len(names):
            return
        yield level, names, doc
        names, doc = _fold(names, doc)
        first = np.empty(len(doc), dtype=bool)
        first[0] = True
        np.not_equal(doc[1:], doc[:-1], out=first[1:])
        ends = np.append(first[1:], True)
        if (first & ends).any():  # texts of one name are done
            go = ~(first & ends)
            names, doc, first = names[go], doc[go], first[go]
            if not len(names):
                return
        at = np.flatnonzero(_starts(names, first))
        # a phrase's name: a multilinear hash of its members by their places in it
        place = np.arange(len(names), dtype=np.int32) - np.repeat(at.astype(np.int32), _gaps(at, len(names)))
        names, doc = _mix(np.add.reduceat(names * _PLACE[place & 63], at) + U(level + 1)), doc[at]


def sketches(texts: Sequence[str]) -> np.ndarray:
    """A row of BINS 16-bit values for each text.

    A text with fewer than FEW names of FIRST_LEVEL and up also uses its phrases of
    lower levels, and one that is a run of one character that character.
    """
    n = len(texts)
    least = np.full(n * BINS, ~U(0), dtype=np.uint64)
    highest, upper = np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=np.int64)
    lower: list[tuple[int, np.ndarray, np.ndarray]] = []

    def put(names: np.ndarray, doc: np.ndarray) -> None:
        np.minimum.at(least, doc.astype(np.int64) * BINS + (names & U(BINS - 1)).astype(np.int64), names >> U(6))

    for level, names, doc in levels(texts):
        highest[doc] = level
        if level >= FIRST_LEVEL:
            upper += np.bincount(doc, minlength=n)
            put(names, doc)
        else:
            lower.append((level, names, doc))
    for level, names, doc in lower:
        needs = (upper < FEW) & ((level > 0) | (highest == 0))
        if needs.any():
            own = needs[doc]
            put(names[own], doc[own])
    values = (_mix(least) % U(EMPTY)).astype(np.uint16)
    values[least == ~U(0)] = EMPTY
    return values.reshape(n, BINS)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bins among those that either fingerprint fills, row by row; 1 for two empty ones."""
    filled = (a != EMPTY) | (b != EMPTY)
    used = filled.sum(axis=1)
    return np.where(used > 0, ((a == b) & filled).sum(axis=1) / np.maximum(used, 1), 1.0)


def to_text(values: np.ndarray) -> list[str]:
    """Fingerprints as hex strings, four digits for each bin."""
    return [row.tobytes().hex() for row in np.ascontiguousarray(values.astype(">u2"))]


def from_text(fingerprints: Sequence[str]) -> np.ndarray:
    return np.frombuffer(bytes.fromhex("".join(fingerprints)), dtype=">u2").astype(np.uint16).reshape(len(fingerprints), BINS)


def _batched(texts: Sequence[str]) -> Iterator[slice]:
    begin = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > TOGETHER:
            yield slice(begin, k)
            begin, size = k, 0
        size += len(t)
    if begin < len(texts):
        yield slice(begin, len(texts))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` for each row of ``docs``, without any shuffle. Null counts as the empty text, whose bins are all empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for s in _batched(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0)[s.start : s.stop], pa.array(to_text(sketches(texts[s])))], ["doc_id", "fingerprint"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, fingerprint string")


def edited_text(text: str, following: str) -> str:
    """The last floor(n / 2) characters replaced by the first as many, or all, of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


#: Ranges of ids that a shuffle partition gets on average.
RANGES_EACH = 8


def edit_comparison(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text and of the next document, compared.

    The next document is the one with the next smaller id, and the one with the
    largest id after the smallest; rows equal in id are ordered by their text's
    hash. Returns ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next``, a row for each row. Null texts
    are empty. Rows without an id stand in no order: their edited text is their
    own first half and ``near_next`` is null. Other columns are ignored. Ids have to
    be integers that fit a long. An empty table gives an empty result.

    Rows are dealt to many ranges of ids, cut at approximate quantiles. A range
    also gets the first row of the next range, so each is worked through alone in
    one sorted pass; texts shuffle once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ranges = RANGES_EACH * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [k / ranges for k in range(1, ranges)]
    cuts = rows.agg(F.percentile_approx("doc_id", shares, 20 * ranges)).first()[0] or []
    cuts = sorted(set(cuts), reverse=True)
    # the range's number counts upward as ids fall; the cuts are at most as many as the ranges asked for
    found = F.lit(len(cuts)) - cuts_below(cuts, F.col("doc_id")) if cuts else F.lit(0)
    ranged = rows.where("doc_id is not null").withColumn("range", found.cast("int")).withColumn("order", F.struct(-F.col("doc_id"), F.sha2("text", 256)))
    heads = ranged.groupBy("range").agg(F.min("order").alias("order")).orderBy("range").collect()  # a row for each range
    if not heads:
        lent = None
    else:
        before = {heads[k].range: heads[k - 1].range for k in range(len(heads))}
        firsts = spark.createDataFrame([(h.range, before[h.range], h.order[0], h.order[1]) for h in heads], "range int, lent_to int, a long, b string")
        # of rows equal in id and text any one will do
        lent = (
            ranged.join(F.broadcast(firsts.select("range", "lent_to", "a", "b")), "range").where("order.col1 = a and order.col2 = b")
            .groupBy("range").agg(F.first("lent_to").alias("lent_to"), F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
            .select(F.col("lent_to").alias("range"), F.lit(True).alias("lent"), "doc_id", "text")
        )
    own = ranged.select("range", F.lit(False).alias("lent"), "doc_id", "text")
    alone = rows.where("doc_id is null").select(F.lit(None).cast("int").alias("range"), F.lit(False).alias("lent"), "doc_id", "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    dealt = own if lent is None else own.unionByName(lent)
    dealt = dealt.repartition("range").sortWithinPartitions("range", "lent", F.desc("doc_id"), F.sha2("text", 256))
    return dealt.select("range", "lent", "doc_id", "text").mapInArrow(_compare, schema).unionByName(alone.select("range", "lent", "doc_id", "text").mapInArrow(_compare, schema))


def cuts_below(cuts: Sequence[int], value: Column) -> Column:
    """How many of ``cuts`` are at most ``value``, by bisection of one constant array, so that the plan doesn't grow with them."""
    held = F.from_json(F.lit(str(sorted(cuts))), "array<bigint>")

    def halve(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["low"] + s["high"], 1)
        above = F.get(held, mid) <= value
        return F.when(s["low"] >= s["high"], s).otherwise(F.struct(F.when(above, mid + 1).otherwise(s["low"]).alias("low"), F.when(above, s["high"]).otherwise(mid).alias("high")))

    start = F.struct(F.lit(0).alias("low"), F.lit(len(cuts)).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(cuts).bit_length())), start, halve, lambda s: s["low"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order; each is compared with the one behind it in its range. The last own row of a range is followed by the lent one."""
    waiting: list[tuple] = []  # rows in order, the last without its next row as yet

    def flush(rows: list[tuple]) -> pa.RecordBatch | None:
        """All but the last of ``rows``."""
        edits, mine, follows = [], [], []
        for (rng, lent, _, text), (next_rng, _, _, following) in zip(rows, rows[1:], strict=False):
            if not lent:
                has = rng is not None and next_rng == rng
                mine.append(len(follows))
                edits.append(edited_text(text, following if has else ""))
            follows.append(rng is not None and next_rng == rng and not lent)
        if not edits:
            return None
        texts = [r[3] for r in rows]
        values = _all_sketches([*texts, *edits])
        base, after, edited = values[mine], values[np.array(mine) + 1], values[len(texts) :]
        near = likeness(base, after)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[k][2] for k in mine], pa.int64()), pa.array([len(rows[k][3]) for k in mine], pa.int64()),
                pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edits]), pa.array(to_text(base)), pa.array(to_text(edited)),
                pa.array(likeness(base, edited)), pa.array([float(x) if follows[k] else None for k, x in zip(mine, near, strict=True)], pa.float64()),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    size = 0
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            waiting.append(row)
            size += len(row[3])
            if size > TOGETHER and len(waiting) > 1:
                if (out := flush(waiting)) is not None:
                    yield out
                waiting, size = waiting[-1:], len(row[3])
    if waiting:
        out = flush([*waiting, (None, True, None, "")])
        if out is not None:
            yield out


def _all_sketches(texts: list[str]) -> np.ndarray:
    return np.concatenate([sketches(texts[s]) for s in _batched(texts)])
