"""Token counts of texts of any length by overlap resynchronisation.

A huge text is encoded in overlapping chunks, with offsets. Two neighbours are
spliced at a place where both have a token boundary and where the tokenizer is
proven to start afresh; when their overlap has no such place it is widened, up to
the rest of the text. Texts below the chunk size are cut at every such place, and
each distinct piece is encoded once.

Proof for ``word_bpe_49k.json``: special strings hold no white space and are
found before anything else; normalisation (composition, white-space runs to one
space, lower case) joins nothing across ASCII white space; the splitting pattern
keeps no white space in any match and none of its alternatives looks around; BPE
works inside a match. So the tokens of ``a + " " + b`` are those of ``a``, then
those of ``b``, and any place next to ASCII white space is stable.
``stable_places`` is that statement; another tokenizer needs its own.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from phasegrid.llm.words import remembers, turn_to

STABLE = re.compile(r"(?<=[ \t\n\r])(?=[^ \t\n\r])")
WORD = re.compile(r"[^ \t\n\r]+")
#: Characters of a chunk and of the first overlap; texts longer than a chunk are huge.
CHUNK, OVERLAP = 16_384, 256
#: Pieces a worker remembers, and the longest one it does.
REMEMBERED, LONGEST = 800_000, 64


def stable_places(text: str, start: int, end: int) -> Iterator[int]:
    """Places in [start, end) where encoding may be cut: first characters after ASCII white space."""
    return (m.start() for m in STABLE.finditer(text, start, end))


def splice(text: str, encode, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[list[int], int]:
    """Token ids of ``text`` from overlapping chunks, and the number of widenings.

    ``encode(part)`` gives (ids, [(start, end) of each token in part]). A splice
    place has to be stable and no token of either chunk may span it.
    """
    ids: list[int] = []
    begin, widened = 0, 0
    while True:
        end = min(len(text), begin + chunk)
        own, spans = encode(text[begin:end])
        width = overlap
        while end < len(text):
            low = max(begin + 1, end - width)
            following, next_spans = encode(text[low : min(len(text), end + 1)])
            left, right = [begin + s for s, _ in spans], [low + s for s, _ in next_spans]
            # a cut in the middle of a word spoils the first and the last token of a chunk, not those by a stable place inside
            places = [p for p in stable_places(text, low, end) if _agrees(p, left, own, right, following, end)]
            if places:
                at = places[len(places) // 2]
                ids += own[: bisect_left(left, at)]
                begin = at
                break
            widened += 1
            if low == begin + 1:  # nothing to cut at in the whole chunk: it becomes twice as long, so all tries together cost no more than the last two
                end = min(len(text), begin + 2 * (end - begin))
                own, spans = encode(text[begin:end])
                width = overlap
            else:
                width *= 2
        else:
            return ids + own, widened


def _agrees(at: int, left: list[int], own: list[int], right: list[int], following: list[int], end: int) -> bool:
    """Both encodings start a token at the place and go on with the same one."""
    i, j = bisect_left(left, at), bisect_left(right, at)
    return i < len(left) and j < len(right) and left[i] == right[j] == at and own[i] == following[j]


class Counter:
    """Counts tokens with the tokenizer in a file; one for each worker."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.chunk, self.overlap = Tokenizer.from_file(path), chunk, overlap
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, int] = {}

    def encode(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        got = self.tokenizer.encode(text, add_special_tokens=False)
        return got.ids, got.offsets

    def each(self, words: list[str]) -> list[int]:
        """Tokens of each word, from one call: a word's tokens start inside it (see the proof above)."""
        starts = np.cumsum([0, *(len(w) + 1 for w in words)])
        spans = self.tokenizer.encode(" ".join(words), add_special_tokens=False).offsets
        at = np.searchsorted(starts, [s for s, _ in spans], "right") - 1
        return np.bincount(at, minlength=len(words)).tolist()

    def counts(self, texts: list[str]) -> list[int]:
        words = [WORD.findall(t) if len(t) <= self.chunk else None for t in texts]
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        fresh = list({w for of in words if of for w in of if w not in known})
        for k in range(0, len(fresh), 500):
            part = fresh[k : k + 500]
            known.update(zip(part, self.each(part), strict=True))
        out = [len(splice(t, self.encode, self.chunk, self.overlap)[0]) if of is None else sum(map(known.__getitem__, of)) for t, of in zip(texts, words, strict=True)]
        for w in fresh:
            if len(w) > LONGEST:
                del known[w]
        return out


_counters: dict[tuple[str, int, int], Counter] = {}
remembers("tokens", lambda: _counters.clear())


def counter(path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Counter:
    key = (path, chunk, overlap)
    if key not in _counters:
        _counters[key] = Counter(*key)
    return _counters[key]


def token_counts(docs: DataFrame, path: str, limit: int = 2048, chunk: int = CHUNK, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text, one row for each row of ``docs``.

    ``n_tokens`` is what the library gives for the whole text, without begin, end
    or added tokens; special strings inside a text count as it treats them. Null
    and empty texts have 0 bytes and 0 tokens; ids may be null or repeat; other
    columns are ignored; an empty table gives an empty result. ``path`` has to
    name a file that the executors can read.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("tokens")
        own = counter(path, chunk, overlap)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                texts = [t or "" for t in part.column(1).to_pylist()]
                n = np.array(own.counts(texts), dtype=np.int64)
                size = np.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
