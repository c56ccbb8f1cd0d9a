"""SentencePiece encoding and decoding.

The pieces of a public vocabulary stand in an Aho-Corasick automaton. One pass
over a stretch of text yields, by following output links, every piece that ends
at each character; each relaxes the best score there (Viterbi). Scores are those
stored with the pieces, so the segmentation is the one with the largest sum, as
in a unigram model. A character that no piece covers becomes byte pieces.

No piece has a space mark after another character, a tab or a line end, so a text
falls apart at its words without changing the best path; a worker remembers words
it has seen, and when they become too many the half that it met most.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator, Sequence
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasegrid.llm.words import remembers, turn_to

MARK = "▁"
#: Pieces with such a score are switched off in the vocabulary; those of one character get the least other score.
OFF = -1e8
#: What an uncovered character scores below the least piece.
PENALTY = 10.0
#: Stretches a worker remembers, and the longest one it does.
REMEMBERED, LONGEST = 300_000, 64
#: Texts that a worker encodes at once.
TOGETHER = 256


class Pieces:
    """A vocabulary read from a model file."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.count = model.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * self.count
        self.byte_ids = [0] * 256
        self.automaton, self.scores = ahocorasick.Automaton(), {}
        for k in range(self.count):
            piece, score = model.id_to_piece(k), model.get_score(k)
            if model.is_byte(k):
                value = int(piece[3:-1], 16)
                self.byte_ids[value], self.bytes_of[k] = k, bytes([value])
            elif not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k)):
                self.bytes_of[k] = piece.replace(MARK, " ").encode()
                if score > OFF:
                    self.automaton.add_word(piece, (len(piece), score, k))
                    self.scores[piece] = score
        least = min(self.scores.values())
        for k in (k for k in range(self.count) if len(model.id_to_piece(k)) == 1 and model.get_score(k) <= OFF):
            self.automaton.add_word(model.id_to_piece(k), (1, least, k))
            self.scores[model.id_to_piece(k)] = least
        self.automaton.make_automaton()
        self.least = least - PENALTY
        self.single = {p for p in self.scores if len(p) == 1}
        if any(MARK in p.lstrip(MARK) or re.search(r"[\t\n]", p) for p in self.scores):
            raise ValueError("a piece goes across words or lines")
        self.piece_bytes = np.frombuffer(b"".join(self.bytes_of), dtype=np.uint8)
        self.piece_sizes = np.array([len(b) for b in self.bytes_of], dtype=np.int64)
        self.piece_starts = np.cumsum(self.piece_sizes) - self.piece_sizes
        #: Stretches seen so far: their numbers, and by number the ids, one behind the other, the score and how often it was met.
        self.known: dict[str, int] = {}
        self.ids, self.ends, self.sums = array("i"), array("q", [0]), array("d")
        self.met = np.zeros(0, dtype=np.int64)

    def forget(self) -> None:
        """Drop stretches, all but the ``REMEMBERED / 2`` that were met most; what they were met for counts half from now on."""
        numbers = np.fromiter(self.known.values(), dtype=np.int64, count=len(self.known))
        chosen = np.sort(np.argsort(-self.met[numbers], kind="stable")[: REMEMBERED // 2])
        names, numbers = list(self.known), numbers[chosen]
        self.known = {names[k]: n for n, k in enumerate(chosen.tolist())}
        ids, ends = np.array(self.ids, dtype=np.int32), np.array(self.ends, dtype=np.int64)
        starts, sizes = ends[numbers], ends[numbers + 1] - ends[numbers]
        self.ids, self.ends = array("i", gathered(ids, starts, sizes).tobytes()), array("q", np.cumsum([0, *sizes]).tobytes())
        self.sums, self.met = array("d", np.array(self.sums)[numbers].tobytes()), self.met[numbers] // 2

    #: A word with the space marks before it, marks alone, or a line end or tab.
    STRETCH = re.compile(f"{MARK}*[^{MARK}\\t\\n]+|{MARK}+|[\\t\\n]")

    def best(self, stretch: str) -> tuple[list[int], float]:
        """Viterbi over one stretch: piece ids and their score. Of equal sums the one with the longer last piece wins."""
        n = len(stretch)
        score, back, number = [0.0] + [-np.inf] * n, [0] * (n + 1), [-1] * (n + 1)
        # where no character is uncovered, each place is settled by the matches that end there
        done = n if self.single.issuperset(stretch) else 0
        for end, (length, own, k) in self.automaton.iter(stretch):
            while done < end:  # characters before this match's last one are settled
                done += 1
                self._uncovered(stretch, done, score, back, number)
            end += 1
            if (total := score[end - length] + own) > score[end]:
                score[end], back[end], number[end] = total, length, k
        while done < n:
            done += 1
            self._uncovered(stretch, done, score, back, number)
        ids: list[int] = []
        at = n
        while at:
            k = number[at]
            ids += [k] if k >= 0 else [self.byte_ids[b] for b in reversed(stretch[at - 1].encode("utf-8", "surrogatepass"))]
            at -= back[at]
        ids.reverse()
        return ids, score[n]

    def _uncovered(self, stretch: str, end: int, score: list[float], back: list[int], number: list[int]) -> None:
        if stretch[end - 1] not in self.single and (total := score[end - 1] + self.least) > score[end]:
            score[end], back[end], number[end] = total, 1, -1

    def encode_all(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(piece ids of all texts one behind the other, how many each text has, the score of each).

        A space is put before a text that is not empty.
        """
        if len(self.sums) > REMEMBERED:
            self.forget()
        stretches: list[str] = []
        counts = np.zeros(len(texts), dtype=np.int64)
        for k, t in enumerate(texts):
            if t:
                own = self.STRETCH.findall(MARK + t.replace(" ", MARK))
                stretches += own
                counts[k] = len(own)
        known = self.known
        at = np.fromiter(map(known.get, stretches, repeat(-1)), dtype=np.int64, count=len(stretches))
        missing = np.flatnonzero(at < 0)
        unknown = [stretches[k] for k in missing.tolist()]
        fresh = list(dict.fromkeys(unknown))
        for stretch in fresh:
            ids, score = self.best(stretch)
            known[stretch] = len(self.sums)
            self.ids.extend(ids)
            self.ends.append(len(self.ids))
            self.sums.append(score)
        at[missing] = np.fromiter(map(known.__getitem__, unknown), dtype=np.int64, count=len(unknown))
        for stretch in fresh:
            if len(stretch) > LONGEST:
                del known[stretch]
        self.met = np.bincount(at, minlength=len(self.sums)) + np.pad(self.met, (0, len(self.sums) - len(self.met)))
        ids, ends, sums = np.array(self.ids, dtype=np.int32), np.array(self.ends, dtype=np.int64), np.array(self.sums)
        owner = np.repeat(np.arange(len(texts)), counts)
        sizes = np.bincount(owner, weights=ends[at + 1] - ends[at], minlength=len(texts)).astype(np.int64)
        return gathered(ids, ends[at], ends[at + 1] - ends[at]), sizes, np.bincount(owner, weights=sums[at], minlength=len(texts))

    def encode(self, text: str) -> tuple[list[int], float]:
        """Piece ids of a whole text and their score."""
        ids, _, score = self.encode_all([text])
        return ids.tolist(), float(score[0])

    def decode_all(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """The texts of piece ids: those that were encoded, but for space marks in them, which become spaces."""
        data = gathered(self.piece_bytes, self.piece_starts[ids], self.piece_sizes[ids]).tobytes()
        ends = np.cumsum(sizes)
        upto = np.concatenate([[0], np.cumsum(self.piece_sizes[ids])])
        return [data[upto[e - n] : upto[e]].decode("utf-8", "surrogatepass").replace(MARK, " ")[1:] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]

    def decode(self, ids: Sequence[int]) -> str:
        return self.decode_all(np.array(ids, dtype=np.int64), np.array([len(ids)]))[0]


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Stretches of ``values``, one behind the other."""
    upto = np.cumsum(sizes)
    return values[np.repeat(starts - upto + sizes, sizes) + np.arange(int(upto[-1]) if len(upto) else 0)]


_loaded: dict[str, Pieces] = {}
remembers("pieces", lambda: _loaded.clear())


def pieces(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, pieces, n_pieces, score, round_trip, decoded_sha256`` of every whole text.

    ``round_trip``: decoding the pieces gives the text again, which holds for every
    text without the space mark itself; ``decoded_sha256`` is of the decoded text.
    Null and empty texts have no pieces. Other columns are ignored; ids may be null
    or repeat. Nothing shuffles.
    """
    ids_type = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("pieces")
        own = pieces(path)
        for batch in batches:
            for k in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(k, TOGETHER)
                texts = [t or "" for t in part.column(1).to_pylist()]
                flat, sizes, scores = own.encode_all(texts)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat)).cast(ids_type)
                again = own.decode_all(flat, sizes)
                same = pa.array([a == t for a, t in zip(again, texts, strict=True)], pa.bool_())
                digest = pa.array([hashlib.sha256(a.encode("utf-8", "surrogatepass")).hexdigest() for a in again], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(sizes), pa.array(scores), same, digest], ["doc_id", "pieces", "n_pieces", "score", "round_trip", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, pieces array<int>, n_pieces long, score double, round_trip boolean, decoded_sha256 string")


def decode_documents(coded: DataFrame, path: str, id_col: str = "doc_id", pieces_col: str = "pieces") -> DataFrame:
    """``doc_id, text`` from piece ids; a null list gives the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("pieces")
        own = pieces(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(ids or []) for ids in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return coded.select(id_col, F.col(pieces_col).cast("array<int>")).mapInArrow(run, f"doc_id {coded.schema[id_col].dataType.simpleString()}, text string")
