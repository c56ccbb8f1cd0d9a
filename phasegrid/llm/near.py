"""Near-duplicates: MinHash signatures, a multi-index Hamming join, confirmation on full sets, components.

A signature has chunks of ``LANES`` min-hashes of ``BITS`` bits. Two texts whose
signatures differ in at most ``2 * chunks - 1`` lanes have, by pigeonhole, a chunk
with at most one differing lane; with each lane of each chunk masked in turn, they
meet under a key. So no pair under that distance is missed. A pair farther apart
is missed only if two lanes or more differ in every chunk; there are as many chunks
as make this less likely than ``CHANCE`` for a pair just similar enough.

Texts with equal sets are one node from the start. A key's nodes are not paired
with each other: each is compared with a pivot, pairs that are confirmed merge
components, and only keys that still hold several components go another round,
with more pivots and without those that have met everyone. What is left
undone is exactly pairs inside a component. Keys under which more than ``CROWD``
nodes do not merge, such as copies of one text that are each edited a little too
much, would need too many pivots; they are resolved exactly by comparing what sets
differ in from a common centre. No group is ever gathered in a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasegrid.llm.store import BitFilter, Scratch, materialise
from phasegrid.llm.words import mix, ngram_hashes, turn_to, word_hashes

#: Lanes of a chunk and bits of a lane; the least number of chunks; the accepted chance that a pair just similar enough is missed.
LANES, BITS, CHUNKS, CHANCE = 5, 12, 8, 5e-5
#: A key that more nodes than this still meet under after the first round is resolved with ``across_crowds``.
CROWD = 64
#: Nodes that a crowd's centre is made of at most. It only orders the work: results are the same with any centre.
CENTRE = 64
#: Pivots under a key in the second round, and how many times as many in each round after.
FIRST_PIVOTS, MORE_PIVOTS = 2, 4
#: Words of a shingle and the least similarity in percent, where a contract says nothing else.
WORDS, PERCENT = 5, 80
#: Texts that a worker holds at once.
TOGETHER = 256

U = np.uint64


def chunks_for(percent: int) -> int:
    """How many chunks a pair just similar enough needs, so that in one of them at most one lane differs."""
    p = 1 - percent / 100
    spoiled = 1 - (1 - p) ** LANES - LANES * p * (1 - p) ** (LANES - 1)
    if not 0 < percent <= 100 or spoiled > 0.95:
        raise ValueError(f"{percent} percent is too dissimilar for chunks of {LANES} lanes")
    return max(CHUNKS, ceil(log(CHANCE) / log(spoiled))) if spoiled > 0 else CHUNKS


def most_different(percent: int, chunks: int) -> int:
    """The least distance that a pair at the threshold exceeds with a chance of ``CHANCE`` at most."""
    n, p = chunks * LANES, 1 - percent / 100
    tail, r = 1.0, 0
    while r < n:
        tail -= comb(n, r) * p**r * (1 - p) ** (n - r)
        if tail <= CHANCE:
            break
        r += 1
    return r


def chunk_names(chunks: int) -> list[str]:
    return [f"c{k}" for k in range(chunks)]


def shingles(text: str, words: int) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles; A-Z in lower case, words parted by ASCII white space.

    A text of fewer words is one shingle, a text without words has none.
    """
    own = word_hashes(text.encode("utf-8", "surrogatepass").lower().split())  # bytes: lower() and split() know ASCII only
    return np.unique(ngram_hashes(own, min(words, len(own)))) if len(own) else own


@lru_cache
def _hash_family(size: int) -> tuple[np.ndarray, np.ndarray]:
    k = np.arange(1, size + 1, dtype=np.uint64)
    return mix(k * U(0x9E3779B97F4A7C15))[:, None], (mix((k + U(100)) * U(0xC2B2AE3D27D4EB4F)) | U(1))[:, None]


def signature(own: np.ndarray, chunks: int = CHUNKS) -> np.ndarray:
    """``chunks`` numbers of ``LANES`` lanes of ``BITS`` bits."""
    salt, factor = _hash_family(chunks * LANES)
    least = np.concatenate([((own[None, :] ^ salt[k : k + 8]) * factor[k : k + 8]).min(axis=1) for k in range(0, len(salt), 8)])
    lanes = (mix(least) & U((1 << BITS) - 1)).reshape(chunks, LANES) << (np.arange(LANES, dtype=np.uint64) * U(BITS))
    return np.bitwise_or.reduce(lanes, axis=1).view(np.int64)


def features(docs: DataFrame, words: int, chunks: int) -> DataFrame:
    """``doc_id, n, h1, h2, c0...``: size, 128-bit hash and signature of each text's set; zeros for an empty one."""
    names = ["doc_id", "n", "h1", "h2", *chunk_names(chunks)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("near")
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                out = np.zeros((part.num_rows, 3 + chunks), dtype=np.int64)
                for k, text in enumerate(part.column(1)):
                    own = shingles(text.as_py() or "", words)
                    if len(own):
                        out[k, 0] = len(own)
                        out[k, 1:3] = np.array([mix(own).sum(dtype=np.uint64), mix(own ^ U(0x5555555555555555)).sum(dtype=np.uint64)], dtype=np.uint64).view(np.int64)
                        out[k, 3:] = signature(own, chunks)
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, out.T.copy())], names)

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in names[1:]))


def sets_of(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, shingles``: the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("near")
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                sets = [shingles(t.as_py() or "", words) for t in part.column(1)]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))], ["doc_id", "shingles"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, shingles array<long>")


def sets_among(ids: DataFrame, docs: DataFrame, words: int, scratch: Scratch) -> DataFrame:
    """``doc_id, shingles`` of the documents with these ids (``id``, distinct) and of few others.

    Each set is made where its text lies; a bounded filter tells which are needed.
    """
    held = BitFilter.of_keys(ids, [F.col("id")], ids.count())
    return scratch.table(sets_of(held.marked(docs, [F.col("doc_id")], "__among").where("__among").select("doc_id", "text"), words), "sets")


def _lane(k: int) -> int:
    """Mask of a lane."""
    return ((1 << BITS) - 1) << (BITS * k)


def masked_keys(chunks: int) -> Column:
    """Each chunk with each lane masked, hashed with its place: the allowed chunk errors, enumerated."""
    return F.array(*[F.xxhash64(F.lit(j * LANES + k), F.col(c).bitwiseAND(F.lit(~_lane(k)))) for j, c in enumerate(chunk_names(chunks)) for k in range(LANES)])


def differing_lanes(a: str, b: str, chunks: int) -> Column:
    terms = [(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}")).bitwiseAND(F.lit(_lane(k))) != 0).cast("int") for c in chunk_names(chunks) for k in range(LANES)]
    return reduce(lambda x, y: x + y, terms)


class Confirmer:
    """Tells which pairs of nodes are similar, by their full sets."""

    def __init__(self, nodes: DataFrame, docs: DataFrame, words: int, percent: int, chunks: int, scratch: Scratch):
        self.nodes, self.docs, self.words, self.percent, self.chunks, self.scratch = nodes, docs, words, percent, chunks, scratch
        #: Sets made so far; until there are some, each call makes those that its pairs need.
        self.sets: DataFrame | None = None

    def similar(self, pairs: DataFrame) -> DataFrame:
        """The rows of ``pairs`` (v, p, distinct) whose sets are similar. Those whose sizes or signatures tell otherwise go first.

        No step behind a join needs its partitioning, so that a pivot many nodes
        have met is a skewed key which the join itself may split.
        """
        a, b = self.nodes.alias("a"), self.nodes.alias("b")
        close = pairs.join(a, F.col("a.v") == pairs["v"]).join(b, F.col("b.v") == pairs["p"])
        sizes = 100 * F.least("a.n", "b.n") >= self.percent * F.greatest("a.n", "b.n")
        lanes = differing_lanes("a", "b", self.chunks) <= most_different(self.percent, self.chunks)
        close = self.scratch.table(close.where(sizes).where(lanes).select(pairs["v"], pairs["p"]), "close")
        sets = self.sets
        if sets is None:
            sets = sets_among(close.select(F.explode(F.array("v", "p")).alias("id")).distinct(), self.docs, self.words, self.scratch)
        x, y = sets.alias("x"), sets.alias("y")
        both = close.join(x, F.col("x.doc_id") == F.col("v")).join(y, F.col("y.doc_id") == F.col("p"))
        common = F.size(F.array_intersect("x.shingles", "y.shingles"))
        counted = both.select("v", "p", common.alias("common"), (F.size("x.shingles") + F.size("y.shingles")).alias("sizes"))
        return self.scratch.table(counted.where(f"100 * common >= {self.percent} * (sizes - common)").select("v", "p"), "found")


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``v, c``: for each node of ``edges`` (v, p) the smallest node that it is connected with.

    Labels spread to neighbours, then each takes its label's label, until nothing
    changes: rounds grow with the logarithm of the longest path, not with its length.
    """
    table = materialise if scratch is None else scratch.table
    both = table(edges.select("v", "p").union(edges.select("p", "v")).distinct(), "edges")
    labels = table(both.groupBy("v").agg(F.least(F.col("v"), F.min("p")).alias("c")), "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("p"), "c"), "p").groupBy("v").agg(F.min("c").alias("m"))
        spread = table(labels.join(near, "v").select("v", F.least("c", "m").alias("c"), F.col("c").alias("old")), "spread")
        jumped = table(spread.join(spread.select(F.col("v").alias("c"), F.col("c").alias("cc")), "c").select("v", F.col("cc").alias("c"), "old"), "labels")
        labels = jumped.select("v", "c")
        if jumped.where("c != old").isEmpty():
            return labels


def across_crowds(members: DataFrame, labels: DataFrame, confirmer: Confirmer) -> DataFrame:
    """Similar pairs ``v, p``, as many as components need, among nodes that meet under the keys of ``members`` (key, v).

    Crowds are keys connected by nodes. A crowd has a centre, a set of shingles,
    and a node's delta is the symmetric difference of its set and the centre. Sets
    x, y are similar if and only if S(x) + S(y) <= 2 (100 + percent) * |common part
    of the deltas|, where S = (100 + percent) * |delta| - (100 - percent) * |set|,
    whatever the centre is. So where S(x) + S(y) <= 0 both are similar to the node
    of least S, and a star to it stands for all such pairs. Any other pair shares
    an element of its deltas early enough that the ones behind it can still make up
    the common part: elements are put in one order, and pairs meet under an element
    only where their places allow it. Only these early elements are ever listed.

    Deltas are small, and their early elements rare, when the centre has what most
    of the crowd has and the order puts frequent elements last. Both are estimated
    from ``CENTRE`` nodes of the crowd, which decides how much is listed, not what
    is found.
    """
    scratch, percent, sets = confirmer.scratch, confirmer.percent, confirmer.sets
    up, down = 100 + percent, 100 - percent
    firsts = members.groupBy("key").agg(F.min("v").alias("p"))
    crowds = components(scratch.table(members.join(firsts, "key").select("v", "p").distinct(), "stars"), scratch)
    crowds = scratch.table(crowds.select("v", F.col("c").alias("crowd")).join(labels, "v", "left").select("v", "crowd", F.coalesce("c", "v").alias("c")), "crowds")
    own = sets.withColumnRenamed("doc_id", "v")

    # the centre, and other frequent elements by the power of two of their frequency
    drawn = crowds.groupBy("crowd", F.pmod(F.xxhash64("v", F.lit(7)), F.lit(CENTRE)).alias("part")).agg(F.min("v").alias("v")).select("crowd", "v")
    drawn = scratch.table(drawn.join(own, "v"), "drawn")
    held = drawn.select("crowd", F.explode("shingles").alias("h")).groupBy("crowd", "h").agg(F.count("*").alias("f")).where("f > 1")
    held = held.join(drawn.groupBy("crowd").agg(F.count("*").alias("size")), "crowd").withColumn("most", F.expr("2 * f > size"))
    tiers = int(log(CENTRE, 2)) + 1
    tier = F.floor(F.log2(F.when(F.col("most"), F.col("size") - F.col("f") + 1).otherwise(F.col("f"))))
    each = [F.sort_array(F.collect_list(F.when(F.col("tier") == k, F.col("h")))).alias(f"t{k}") for k in range(1, tiers)]
    centre = scratch.table(held.withColumn("tier", tier).groupBy("crowd").agg(F.sort_array(F.collect_list(F.when(F.col("most"), F.col("h")))).alias("centre"), *each), "centre")

    nothing = F.array().cast("array<bigint>")
    known = crowds.join(own, "v").join(centre, "crowd", "left").withColumns({c: F.coalesce(c, nothing) for c in centre.columns[1:]})
    delta = F.concat(F.array_except("centre", "shingles"), F.array_except("shingles", "centre"))
    ordered = [F.sort_array(F.array_except("delta", F.concat(*[f"t{k}" for k in range(1, tiers)])))] + [F.sort_array(F.array_intersect("delta", f"t{k}")) for k in range(1, tiers)]
    deltas = known.withColumn("delta", delta).select("crowd", "v", "c", F.size("shingles").cast("long").alias("n"), F.concat(*ordered).alias("in_order"))
    deltas = scratch.table(deltas.withColumn("many", F.size("in_order").cast("long")).withColumn("s", up * F.col("many") - down * F.col("n")), "deltas")

    # all pairs that need no common part: a star to the least score of the crowd
    least = scratch.table(deltas.groupBy("crowd").agg(F.min(F.struct("s", "v")).alias("m")).select("crowd", F.col("m.s").alias("low"), F.col("m.v").alias("p")), "least")
    near = scratch.table(deltas.join(least, "crowd").where("v != p and s + low <= 0").select("v", "p"), "near")
    same = scratch.table(deltas.select("v", F.col("c").alias("p")).where("v != p").union(near), "same")
    grouped = deltas.drop("c").join(components(same, scratch), "v", "left").withColumn("c", F.coalesce("c", "v")).join(least.select("crowd", "low"), "crowd")

    # the others, by the elements that they may have in common; a partner's score has two lower bounds: the crowd's, and what its size and delta can be
    largest = F.expr(f"n * 100 div {percent}")
    partner = F.greatest("low", up * F.col("many") - down * (F.col("n") + largest) - down * largest)
    # from a place on the elements, that one too, have to do for the partner that asks least
    prefix = F.greatest(F.lit(0), F.least(F.col("many"), F.col("many") - F.ceil((F.col("s") + partner) / (2 * up)) + 1)).cast("int")
    placed = grouped.select("crowd", "v", "c", "s", "many", F.posexplode(F.slice("in_order", F.lit(1), prefix)).alias("at", "h"))
    placed = scratch.table(placed.select("crowd", "h", "v", "c", "s", (F.col("many") - F.col("at")).alias("left")), "placed")
    x, y = placed.alias("x"), placed.alias("y")
    reach = F.least("x.left", "y.left") * (2 * up) >= F.col("x.s") + F.col("y.s")
    on = (F.col("x.crowd") == F.col("y.crowd")) & (F.col("x.h") == F.col("y.h")) & (F.col("x.v") < F.col("y.v")) & (F.col("x.c") != F.col("y.c")) & reach
    met = scratch.table(x.join(y, on).select(F.col("x.v").alias("v"), F.col("y.v").alias("p")), "met")
    return near.union(confirmer.similar(scratch.table(met.distinct(), "pairs")))


def linked(nodes: DataFrame, docs: DataFrame, words: int, percent: int, chunks: int, scratch: Scratch) -> DataFrame:
    """``v, c``: components of all similar nodes; a node without a partner may be missing."""
    keys = nodes.select("v", F.explode(masked_keys(chunks)).alias("key"))
    # first pass: the keys under which nodes meet, each with its first pivot (combined before the shuffle)
    shared = scratch.table(keys.groupBy("key").agg(F.min("v").alias("p"), F.max("v").alias("q")).where("p < q").select("key", "p"), "shared")
    meeting = scratch.table(keys.join(shared, "key").where("v != p"), "meeting")
    fresh = scratch.table(meeting.select("v", "p").distinct(), "pairs")
    tested, active, pivots, first = fresh, meeting.select("key", "v"), FIRST_PIVOTS, True
    confirmer = Confirmer(nodes, docs, words, percent, chunks, scratch)
    found = confirmer.similar(fresh)
    labels = components(found, scratch)
    while True:
        # members that have met all others under their key are out; keys of one component are done
        named = scratch.table(active.join(labels, "v", "left").select("key", "v", F.coalesce("c", "v").alias("c")), "named")
        open_keys = scratch.table(named.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("key", "n"), "open")
        if open_keys.isEmpty():
            return labels
        named = scratch.table(named.join(open_keys, "key"), "active")
        if confirmer.sets is None:
            # all that is still to be compared lies among these; their sets are made once
            confirmer.sets = sets_among(named.select(F.col("v").alias("id")).distinct(), docs, words, scratch)
        if first:
            first, crowded = False, scratch.table(named.where(f"n > {CROWD}").select("key", "v"), "crowded")
            if not crowded.isEmpty():
                found = scratch.table(found.union(across_crowds(crowded, labels, confirmer)).distinct(), "found")
                labels, active = components(found, scratch), named.where(f"n <= {CROWD}").select("key", "v")
                continue
        # from each part of a key's nodes the first of the first and the last of the last component: one isn't of the largest
        ends = named.groupBy("key", F.pmod(F.xxhash64("v", F.lit(pivots)), F.lit(pivots)).alias("part")).agg(F.min(F.struct("c", "v")).alias("lo"), F.max(F.struct("c", "v")).alias("hi"))
        chosen = scratch.table(ends.select("key", F.explode(F.array("lo", "hi")).alias("at")).select("key", F.col("at.v").alias("p"), F.col("at.c").alias("pc")).distinct(), "pivots")
        across = named.join(chosen, "key").where("c != pc").select(F.least("v", "p").alias("v"), F.greatest("v", "p").alias("p")).distinct()
        fresh = scratch.table(across.join(tested, ["v", "p"], "left_anti"), "pairs")
        active = scratch.table(named.join(chosen.select("key", F.col("p").alias("v")), ["key", "v"], "left_anti").select("key", "v"), "active")
        pivots *= MORE_PIVOTS
        if fresh.isEmpty():
            continue
        tested = tested.union(fresh)
        new = confirmer.similar(fresh)
        if not new.isEmpty():
            found = scratch.table(found.union(new).distinct(), "found")
            labels = components(found, scratch)


def near_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs``.

    Two texts are linked when 100 * common >= percent * union over their distinct
    word shingles; ``component_id`` is the smallest id reachable, ``kept`` says
    whether it is the row's own. Null and empty texts have no shingles and no link,
    nor has a row without an id, which is kept. Rows that share an id are
    documents of their own, but where each is the smallest of its set they are one
    node. Other columns are ignored; an empty table gives an empty result. A
    ``percent`` under which ``LANES`` lanes are no use raises an error.
    """
    chunks, scratch = chunks_for(percent), Scratch(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = materialise(features(own, words, chunks), "features")
    firsts = [F.first(c).alias(c) for c in ("n", *chunk_names(chunks))]
    nodes = scratch.table(rows.where("n > 0 and doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("v"), *firsts), "nodes")
    labels = linked(nodes, own, words, percent, chunks, scratch)
    named = materialise(nodes.select("h1", "h2", "v").join(labels, "v", "left").select("h1", "h2", F.coalesce("c", "v").alias("c")), "named")
    scratch.clear()
    out = rows.select("doc_id", "n", "h1", "h2").join(named, ["h1", "h2"], "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("c")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def near_dedup(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` of which ``near_components`` keeps the id, whole.

    A filter over the dropped ids lets most rows pass where they are; only those it
    may hold are shuffled to be looked up.
    """
    dropped = materialise(near_components(docs, words, percent, id_col, text_col).where("not kept").select("doc_id").distinct(), "dropped")
    marked = BitFilter.of_keys(dropped, [F.col("doc_id")], dropped.count()).marked(docs, [F.col(id_col)], "__maybe")
    some = marked.where("__maybe").join(dropped.select(F.col("doc_id").alias("__id")), F.col(id_col) == F.col("__id"), "left_anti")
    return marked.where("not __maybe").unionByName(some).drop("__maybe")
