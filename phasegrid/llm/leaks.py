"""Benchmark decontamination: a generalised suffix automaton of the items, through which documents are streamed.

The automaton accepts every run of words that occurs in an item. While a document's
words pass through it, its state is the longest run ending at the current word that
some item has, so each place tells whether a window of an item ends there. A window
is ``least`` words in a row; an item of fewer words is one window.

Only stretches in which each word and the next stand next to each other in some item,
and which are long enough, pass through the automaton: at all other places the longest
match is known to be too short. They are found for whole batches of texts at once.

Documents never move. The automaton is built on the executors from groups of items of
at most about ``MOST_WORDS`` words, so what is broadcast has a bound; where the items
are more, documents pass through one group's automaton after the other.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from io import BytesIO

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasegrid.llm.store import Scratch
from phasegrid.llm.words import mix, turn_to, word_hashes

#: Words of a window.
LEAST = 10
#: Words of the items in one automaton, about; longer items are cut into parts that overlap, so no window is lost.
MOST_WORDS, PART = 1_000_000, 50_000
#: Texts and bytes that a worker holds as words at once.
TOGETHER, BYTES = 256, 1 << 20
#: Steps that a worker remembers.
REMEMBERED = 100_000
#: ASCII but letters and digits parts words; A-Z count as a-z.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
WORD = re.compile(rb"[^ ]+")

U = np.uint64


def normalised(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE)


def hashes_of(text: bytes) -> np.ndarray:
    """The words' hashes; of a long text some at a time are held as words."""
    parts, at = [], 0
    while at < len(text):
        end = text.find(b" ", at + BYTES)
        end = len(text) if end < 0 else end
        parts.append(word_hashes(text[at:end].split()))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)


class Growing:
    """A generalised suffix automaton that takes one sequence after the other. State 0 is the empty run."""

    def __init__(self) -> None:
        self.steps: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]

    def _new(self, size: int, link: int, steps: dict[int, int]) -> int:
        self.steps.append(steps)
        self.link.append(link)
        self.size.append(size)
        return len(self.size) - 1

    def _split(self, p: int, c: int) -> int:
        """The state of the longest run of ``p`` with ``c`` behind it, parted from longer ones."""
        q = self.steps[p][c]
        if self.size[q] == self.size[p] + 1:
            return q
        own = self._new(self.size[p] + 1, self.link[q], dict(self.steps[q]))
        self.link[q] = own
        while p >= 0 and self.steps[p].get(c) == q:
            self.steps[p][c] = own
            p = self.link[p]
        return own

    def add(self, sequence: Iterable[int]) -> None:
        last = 0
        for c in sequence:
            if c in self.steps[last]:
                last = self._split(last, c)
                continue
            own, p = self._new(self.size[last] + 1, 0, {}), last
            while p >= 0 and c not in self.steps[p]:
                self.steps[p][c] = own
                p = self.link[p]
            if p >= 0:
                self.link[own] = self._split(p, c)
            last = own


def _sets(pairs: list[tuple[int, int]], states: int) -> tuple[np.ndarray, np.ndarray]:
    """(state, item) pairs as the items of each state, and where a state's begin."""
    held = np.unique(np.array(pairs, dtype=np.int64).reshape(-1, 2), axis=0)
    return np.searchsorted(held[:, 0], np.arange(states + 1)), held[:, 1]


class Automaton:
    """A finished automaton in arrays, which is what is shipped."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.arrays = arrays
        self.words, self.pairs = arrays["words"], arrays["pairs"]
        self.least, self.shortest = (int(x) for x in arrays["limits"])
        self._memo: dict[int, int] = {}

    @classmethod
    def of(cls, names: Sequence[str], sequences: Sequence[np.ndarray], least: int) -> Automaton:
        """From each item's name and its words' hashes."""
        full = [(n, s) for n, s in zip(names, sequences, strict=True) if len(s)]
        words = np.unique(np.concatenate([s for _, s in full])) if full else np.zeros(0, dtype=np.uint64)
        known, of = sorted({n for n, _ in full}), {}
        for k, n in enumerate(known):
            of[n] = k
        own = [(of[n], np.searchsorted(words, s).tolist()) for n, s in full]
        grown = Growing()
        for _, s in own:
            grown.add(s)
        states = len(grown.size)
        up = list(range(states))  # the state that holds the last ``least`` words of a state's runs
        for k in sorted(range(states), key=grown.size.__getitem__):
            if grown.link[k] >= 0 and grown.size[grown.link[k]] >= least:
                up[k] = up[grown.link[k]]
        windows, whole = [], []
        for item, s in own:
            at = 0
            for place, c in enumerate(s, 1):
                at = grown.steps[at][c]
                if place >= least:
                    windows.append((up[at], item))
            if len(s) < least:  # it was added from the start, so it is the longest run of its state
                whole.append((at, item, len(s)))
        # short items that end a state's runs: its own, and the next state on the way up that has some
        above, short = [-1] * states, {k for k, _, _ in whole}
        for k in sorted(range(states), key=grown.size.__getitem__):
            if (link := grown.link[k]) >= 0:
                above[k] = link if link in short else above[link]
        base = max(1, len(words))
        keys = [k * base + c for k in range(states) for c in grown.steps[k]]
        order = np.argsort(np.array(keys, dtype=np.int64))
        to = np.array([t for k in range(states) for t in grown.steps[k].values()], dtype=np.int32)
        table = np.zeros(1 << max(12, (16 * sum(len(s) for _, s in own)).bit_length()), dtype=bool)
        for _, s in own:
            a = np.array(s, dtype=np.uint64)
            table[mix(a[:-1] * U(base) + a[1:]) & U(len(table) - 1)] = True
        lengths = np.zeros(states, dtype=np.int32)
        for k, _, n in whole:
            lengths[k] = n
        arrays = {
            "words": words, "pairs": table, "keys": np.array(keys, dtype=np.int64)[order], "to": to[order],
            "link": np.array(grown.link, dtype=np.int32), "size": np.array(grown.size, dtype=np.int32), "up": np.array(up, dtype=np.int32),
            "above": np.array(above, dtype=np.int32), "short": lengths, "names": np.array(known, dtype=object).astype("U"),
            "limits": np.array([least, min([least, *(len(s) for _, s in own)])]),
        }
        arrays["window_at"], arrays["window_items"] = _sets(windows, states)
        arrays["whole_at"], arrays["whole_items"] = _sets([(k, i) for k, i, _ in whole], states)
        return cls(arrays)

    def dump(self) -> bytes:
        np.savez(out := BytesIO(), **self.arrays)
        return out.getvalue()

    @classmethod
    def load(cls, blob: bytes) -> Automaton:
        with np.load(BytesIO(blob)) as held:
            return cls({k: held[k] for k in held.files})

    def _step(self, key: int) -> int:
        found = self._memo.get(key)
        if found is None:
            keys = self.arrays["keys"]
            k = int(np.searchsorted(keys, key))
            found = int(self.arrays["to"][k]) if k < len(keys) and keys[k] == key else -1
            if len(self._memo) >= REMEMBERED:
                self._memo.clear()
            self._memo[key] = found
        return found

    def stretches(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last places of the runs of words that may hold a window; -1 is a word that no item has."""
        known = ids >= 0
        a = np.where(known, ids, 0).astype(np.uint64)
        joined = known[:-1] & known[1:] & self.pairs[mix(a[:-1] * U(max(1, len(self.words))) + a[1:]) & U(len(self.pairs) - 1)]
        first, last = known.copy(), known.copy()
        first[1:] &= ~joined
        last[:-1] &= ~joined
        begin, end = np.flatnonzero(first), np.flatnonzero(last)
        enough = end - begin + 1 >= self.shortest
        return begin[enough], end[enough]

    def follow(self, ids: Sequence[int], at: int, spans: list[list[int]], items: set[int]) -> None:
        """Stream words that begin at place ``at``; hit words go to ``spans`` (begin, end behind), items to ``items``."""
        x, base, step = self.arrays, len(self.words), self._step
        link, size, up, above, short = (memoryview(x[k]) for k in ("link", "size", "up", "above", "short"))
        windows, whole = set(), set()
        state = length = 0
        for place, c in enumerate(ids, at + 1):
            to = step(state * base + c)
            while to < 0 and state:
                state = link[state]
                length = size[state]
                to = step(state * base + c)
            state, length = (to, length + 1) if to >= 0 else (0, 0)
            widest = 0
            if length >= self.least:
                widest = self.least
                windows.add(up[state])
            k = state
            while k > 0:
                if 0 < short[k] <= length:
                    widest = max(widest, short[k])
                    whole.add(k)
                k = above[k]
            if widest:
                begin = place - widest
                while spans and spans[-1][1] >= begin:
                    begin = min(begin, spans.pop()[0])
                spans.append([begin, place])
        for found, name in ((windows, "window"), (whole, "whole")):
            for k in found:
                items.update(x[f"{name}_items"][x[f"{name}_at"][k] : x[f"{name}_at"][k + 1]].tolist())

    def scan(self, texts: Sequence[str | None]) -> list[tuple[int, list[list[int]], list[str]]]:
        """For each text its number of words, its hit spans of words and the items whose windows it has."""
        own = [hashes_of(normalised(t)) for t in texts]
        out: list[tuple[int, list[list[int]], list[str]]] = [(len(h), [], []) for h in own]
        if not len(self.words):
            return out
        ends = np.cumsum([len(h) + 1 for h in own])
        all_hashes = np.concatenate([x for h in own for x in (h, np.zeros(1, dtype=np.uint64))])
        ids = np.minimum(np.searchsorted(self.words, all_hashes), len(self.words) - 1)
        ids[self.words[ids] != all_hashes] = -1
        ids[ends - 1] = -1  # between two texts
        found: dict[int, set[int]] = {}
        begin, end = self.stretches(ids)
        for text, b, e in zip(np.searchsorted(ends, begin, side="right").tolist(), begin.tolist(), end.tolist(), strict=True):
            first = int(ends[text]) - len(own[text]) - 1
            self.follow(ids[b : e + 1].tolist(), b - first, out[text][1], found.setdefault(text, set()))
        for text, items in found.items():
            out[text][2].extend(self.arrays["names"][sorted(items)].tolist())
        return out


def item_parts(items: DataFrame, least: int, id_col: str, text_col: str) -> DataFrame:
    """``name, part, words, n``: the items' word hashes, long items in parts that overlap by ``least`` - 1 words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("leaks")
        for batch in batches:
            for name, text in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                own = hashes_of(normalised(text)).view(np.int64)
                for part, at in enumerate(range(0, max(1, len(own) - least + 1), PART)):
                    piece = own[at : at + PART + least - 1]
                    yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([part], pa.int32()), pa.array([piece]), pa.array([len(piece)], pa.int64())], ["name", "part", "words", "n"])

    named = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"), F.col(text_col).alias("text"))
    return named.mapInArrow(run, "name string, part int, words array<long>, n long").where("n > 0")


def automata(items: DataFrame, least: int, id_col: str, text_col: str, most_words: int, scratch: Scratch) -> Iterator[Automaton]:
    """One automaton for each group of items, built in a task of its own; the driver holds one at a time."""
    parts = scratch.table(item_parts(items, least, id_col, text_col), "items")
    total = parts.agg(F.sum("n")).first()[0] or 0
    groups = max(1, -(-total // most_words))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["name", "part"])
        made = Automaton.of(list(group["name"]), [np.asarray(w, dtype=np.int64).view(np.uint64) for w in group["words"]], least)
        return pd.DataFrame({"group": [group["group"].iloc[0]], "blob": [made.dump()]})

    dealt = parts.withColumn("group", F.pmod(F.xxhash64("name", "part"), F.lit(groups)))
    built = scratch.table(dealt.groupBy("group").applyInPandas(build, "group long, blob binary"), "automata")
    for k in range(groups):
        row = built.where(F.col("group") == k).first()
        yield Automaton.load(row.blob) if row else Automaton.of([], [], least)


SPANS = "array<struct<begin:int,end:int>>"


def _found(docs: DataFrame, text_col: str, carry: Sequence[str], automaton: Automaton) -> DataFrame:
    """``carry`` and ``__words, __spans, __items``."""
    blob = docs.sparkSession.sparkContext.broadcast(automaton.dump())
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry] + ["__words long", f"__spans {SPANS}", "__items array<string>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("leaks")
        held = Automaton.load(blob.value)
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                got = held.scan(part.column(part.num_columns - 1).to_pylist())
                ends = np.cumsum([0, *(len(s) for _, s, _ in got)]).astype(np.int32)
                places = np.array([p for _, spans, _ in got for p in spans], dtype=np.int32).reshape(-1, 2)
                spans = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(places[:, 0]), pa.array(places[:, 1])], ["begin", "end"]))
                new = [pa.array([n for n, _, _ in got], pa.int64()), spans, pa.array([i for _, _, i in got], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *new], [*carry, "__words", "__spans", "__items"])

    text = F.col(f"`{text_col}`").alias("__scanned")
    return docs.select(*[F.col(f"`{c}`") for c in carry], text).mapInArrow(run, schema)


def find_leaks(docs: DataFrame, items: DataFrame, carry: Sequence[str], least: int = LEAST, id_col: str = "item_id", text_col: str = "text", most_words: int = MOST_WORDS) -> DataFrame:
    """For each row of ``docs`` the columns ``carry`` and where it has words of ``items``.

    ``__words`` is the number of its words, ``__spans`` the runs of words inside
    windows of items (begin, end behind; in order, apart from each other), and
    ``__items`` the names of the items that the windows are from, sorted as strings.
    Words are compared by 64-bit hashes. Null and empty texts have no words. Items
    that share an id are one item with the windows of all; an item without an id
    is named by the empty string; one without words has no windows. Repeated and
    tied rows of ``docs`` are searched each for itself; no row is dropped.
    """
    scratch = Scratch(docs.sparkSession)
    made = automata(items, least, id_col, text_col, most_words, scratch)
    first, following = next(made), next(made, None)
    if following is None:
        scratch.clear()
        return _found(docs, "text", carry, first)
    # more groups: the texts with windows of any, by a digest of the text, and from there to the rows
    key = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    texts = docs.select(key.alias("__key"), F.col("text"))
    found = []
    while first is not None:
        hit = _found(texts, "text", ["__key"], first).where("size(__items) > 0")
        found.append(scratch.table(hit.groupBy("__key").agg(F.first("__spans").alias("__spans"), F.first("__items").alias("__items")), "hits"))
        first, following = following, next(made, None) if following is not None else None
    union = found[0]
    for more in found[1:]:
        union = union.unionByName(more)
    gathered = union.groupBy("__key").agg(F.flatten(F.collect_list("__spans")).alias("__some"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("__items")))).alias("__names"))
    merged = scratch.table(gathered.select("__key", merged_spans(F.col("__some")).alias("__some"), "__names"), "leaks")
    scratch.clear(merged)
    counted = _found(docs.withColumn("__key", key), "text", [*carry, "__key"], Automaton.of([], [], least)).drop("__spans", "__items")
    none = F.array()
    return counted.join(merged, "__key", "left").select(*[F.col(f"`{c}`") for c in carry], "__words", F.coalesce("__some", none.cast(SPANS)).alias("__spans"), F.coalesce("__names", none.cast("array<string>")).alias("__items"))


def merged_spans(spans: Column) -> Column:
    """Spans in order, those that touch as one."""
    start = F.array().cast(SPANS)

    def put(held: Column, s: Column) -> Column:
        last = F.element_at(held, F.lit(-1))
        wider = F.array(F.struct(last["begin"].alias("begin"), F.greatest(last["end"], s["end"]).alias("end")))
        return F.when((F.size(held) > 0) & (F.try_element_at(held, F.lit(-1))["end"] >= s["begin"]), F.concat(F.slice(held, F.lit(1), F.size(held) - 1), wider)).otherwise(F.concat(held, F.array(s)))

    return F.aggregate(F.array_sort(spans), start, put)


def hit_words() -> Column:
    return F.aggregate("__spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])


def leak_report(docs: DataFrame, items: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for each row of ``docs``; see ``find_leaks``."""
    found = find_leaks(docs, items, ["doc_id"], least, most_words=most_words).withColumn("n_hit", hit_words())
    return found.select("doc_id", F.col("__words").alias("n_words"), "n_hit", F.size("__items").cast("long").alias("n_items"), F.sha2(F.array_join("__items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def _without(text: str, spans: Sequence[dict[str, int]], longest: int) -> str:
    """``text`` without the spans of more than ``longest`` words, from the first word to the end of the last."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    bounds = [m.span() for m in WORD.finditer(raw.translate(TABLE))]
    out, at = [], 0
    for s in spans:
        if s["end"] - s["begin"] > longest:
            out.append(raw[at : bounds[s["begin"]][0]])
            at = bounds[s["end"] - 1][1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, items: DataFrame, least: int = LEAST, longest: int = LEAST - 1, most_covered: float = 0.5) -> DataFrame:
    """``docs`` without what they have of ``items``, in their columns.

    Hit spans of more than ``longest`` words are cut out of ``text``, from their
    first character to their last. A document of whose words more than the share
    ``most_covered`` are hit goes; so no document without a hit does, and null
    texts stay null. See ``find_leaks`` for ties, repeats and empty tables.
    """
    names = docs.columns
    if taken := {"__words", "__spans", "__items", "__key"} & set(names):
        raise ValueError(f"columns {sorted(taken)} are used here")
    kept = find_leaks(docs, items, names, least).where(hit_words() <= F.lit(most_covered) * F.col("__words"))
    place = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if not s else _without(t, s, longest) for t, s in zip(batch.column(place).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)]
            columns = batch.columns[:-1]
            columns[place] = pa.array(texts, columns[place].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return kept.select(*[F.col(f"`{c}`") for c in names], "__spans").mapInArrow(run, docs.schema)
