"""Hard negatives by slot-decomposed selection.

An anchor's positives, in falling order of score, are upper limits: together they cut
the scores into disjoint slots, of which slot i has the scores from the (i+1)-th limit,
not included, to the i-th. Whatever negatives a positive may take, those up to its own
limit, are those of its slot and all lower ones. So a task keeps only the first few
negatives of each slot, these are combined for each slot alone, and one merge from the
lowest slot up answers all windows, which overlap.

Scores are counted twice in blocks: anchors against the rows of their own label, for
the positives, and against all rows of other labels, for the slots. A block is some
anchors, which a task holds, and a part of the rows, which stream past them. Each task
leaves a bounded number of entries for each anchor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phasegrid.llm.store import Scratch
from phasegrid.llm.words import turn_to

#: Positives of an anchor, negatives of a positive; the least score of a negative in percent of the positive's.
POSITIVES, NEGATIVES, PERCENT = 5, 5, 80
#: Factor of components before they are rounded down.
SCALE = 256
#: Bytes of the anchors that a task holds, about; rows that stream past them in one part, at most and at least.
ANCHOR_BYTES, MOST_ROWS, LEAST_ROWS = 16 << 20, 1 << 22, 2048
#: Anchors and rows whose scores are counted at once.
TILE = 1024, 2048
#: Fewest blocks, where there are rows enough.
BLOCKS = 48


def usable(rows: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """``id, label, vec`` of the rows that take part."""
    vec = F.col(vec_col)
    odd = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | x.isin(float("inf"), float("-inf")))
    some = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), vec.alias("vec"))
    return some.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & ~odd)


def whole_numbers(vectors: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of rounded components, shorter ones filled up with zeros."""
    out = np.zeros((len(vectors), width))
    lengths = np.diff(vectors.offsets.to_numpy())
    out[np.arange(width)[None, :] < lengths[:, None]] = np.floor(SCALE * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products as longs.

    Floating point is exact while no partial sum can leave the whole numbers that it
    holds, which the lengths of the vectors tell.
    """
    most = np.sqrt((a * a).sum(axis=1).max(initial=0)) * np.sqrt((b * b).sum(axis=1).max(initial=0))
    if most < 1 << 23:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if most < 1 << 52:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def firsts(groups: np.ndarray, scores: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the first ``most`` entries of each group: higher scores first, then smaller ids."""
    order = np.lexsort((ids, -scores, groups))
    own = groups[order]
    begins = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, dtype=np.int64)
    rank = np.arange(len(own)) - np.repeat(begins, np.diff(np.append(begins, len(own))))
    return order[rank < most]


class Block:
    """Anchors of a block and the best entries so far."""

    def __init__(self, keys: np.ndarray, vectors: np.ndarray, labels: np.ndarray, limits: list[np.ndarray] | None, most: int, same: bool):
        self.keys, self.vectors, self.labels, self.most, self.same = keys, vectors, labels, most, same
        self.slots = 1
        if limits is not None:
            self.slots = max([1, *map(len, limits)])
            #: limits from the highest down, filled up with a limit that no score exceeds
            self.limits = np.full((len(keys), self.slots), np.iinfo(np.int64).min)
            #: the least score that any window takes; a limit below zero has no window
            self.lower = np.full((len(keys), 1), np.iinfo(np.int64).max)
            for k, own in enumerate(limits):
                self.limits[k, : len(own)] = own
                if len(own) and (some := own[own >= 0]).size:
                    self.lower[k] = -(-PERCENT * int(some.min()) // 100)
        #: entries of each tile of anchors: group, score, id
        self.held = {x: (np.zeros(0, dtype=np.int64),) * 3 for x in range(0, len(keys), TILE[0])}

    def see(self, ids: np.ndarray, vectors: np.ndarray, labels: np.ndarray) -> None:
        for x in range(0, len(self.keys), TILE[0]):
            own = slice(x, x + TILE[0])
            for y in range(0, len(ids), TILE[1]):
                rows = slice(y, y + TILE[1])
                scores = products(self.vectors[own], vectors[rows])
                fits = (self.labels[own][:, None] == labels[rows][None, :]) == self.same
                if not self.same:
                    fits &= (scores <= self.limits[own][:, :1]) & (scores >= self.lower[own])
                else:
                    self._thin(fits, scores)
                at, row = np.nonzero(fits)
                found = scores[at, row]
                slot = np.zeros(len(at), dtype=np.int64)
                if not self.same:
                    for k in range(1, self.slots):
                        slot += found <= self.limits[own][at, k]
                self._keep(x, (at + x) * self.slots + slot, found, ids[rows][row])

    def _thin(self, fits: np.ndarray, scores: np.ndarray) -> None:
        """Of many scores leave those that reach the last one that counts."""
        if fits.shape[1] > 8 * self.most:
            masked = np.where(fits, scores, np.iinfo(np.int64).min)
            fits &= scores >= np.partition(masked, -self.most, axis=1)[:, -self.most][:, None]

    def _keep(self, tile: int, *entries: np.ndarray) -> None:
        both = [np.concatenate(x) for x in zip(self.held[tile], entries, strict=True)]
        best = firsts(*both, self.most)
        self.held[tile] = tuple(x[best] for x in both)

    def entries(self) -> pa.RecordBatch:
        groups, scores, ids = (np.concatenate(x) for x in zip(*self.held.values(), strict=True))
        return pa.RecordBatch.from_arrays([pa.array(self.keys[groups // self.slots]), pa.array((groups % self.slots).astype(np.int32)), pa.array(scores), pa.array(ids)], ["key", "slot", "score", "id"])


def _blocks(most: int, same: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over rows sorted by block, anchors first: the best entries of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("negatives")
        now, waiting, block = None, [], None

        def begun() -> Block:
            t = pa.Table.from_batches(waiting).combine_chunks()
            vectors = t.column("vec").combine_chunks()
            width = int(np.diff(vectors.offsets.to_numpy()).max(initial=0))
            limits = None if same else [np.array(x, dtype=np.int64) for x in t.column("limits").to_pylist()]
            return Block(t.column("key").to_numpy(), whole_numbers(vectors, width), t.column("label").to_numpy(), limits, most, same)

        for batch in batches:
            cells = batch.column("cell").to_numpy()
            cuts = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(cells)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if cells[a] != now:
                    if block is not None:
                        yield block.entries()
                    now, waiting, block = cells[a], [], None
                anchors = int(np.count_nonzero(part.column("is_anchor").to_numpy(zero_copy_only=False)))
                if anchors:
                    waiting.append(part.slice(0, anchors))
                if anchors < part.num_rows and waiting:
                    if block is None:
                        block = begun()
                    rows = part.slice(anchors)
                    vectors = rows.column("vec")
                    width = max(block.vectors.shape[1], int(np.diff(vectors.offsets.to_numpy()).max(initial=0)))
                    block.see(rows.column("key").to_numpy(), whole_numbers(vectors, width)[:, : block.vectors.shape[1]], rows.column("label").to_numpy())
        if block is not None:
            yield block.entries()

    return run


def _scored(anchors: DataFrame, rows: DataFrame, by_label: bool, blocks: int, parts: int, most: int) -> DataFrame:
    """``key, slot, score, id``: for each anchor and slot the first ``most`` entries."""
    tasks = blocks * parts
    label = F.col("label") if by_label else F.lit(0)
    a = anchors.select("key", "label", "vec", "limits", F.lit(True).alias("is_anchor"), F.pmod(F.xxhash64("key", F.lit(3)), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    r = rows.select(F.col("id").alias("key"), "label", "vec", F.lit(None).cast("array<long>").alias("limits"), F.lit(False).alias("is_anchor"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.pmod(F.xxhash64("id", F.lit(5)), F.lit(parts)).cast("int").alias("part"))
    cells = a.unionByName(r).withColumn("cell", F.xxhash64(label, "block", "part"))
    dealt = cells.repartition(tasks, "cell").sortWithinPartitions("cell", F.desc("is_anchor"))
    best = dealt.select("cell", "is_anchor", "key", "label", "vec", "limits").mapInArrow(_blocks(most, by_label), "key long, slot int, score long, id long")
    order = Window.partitionBy("key", "slot").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _without_itself(found: Column) -> Column:
    """The entries but one that is the anchor's own row: its score and id. Any such entry will do, since equal ones are equal."""
    at = F.array_position(found, F.struct((-F.col("self_score")).alias("less"), F.col("anchor_id").alias("id")))
    return F.when(at > 0, F.concat(F.slice(found, F.lit(1), at - 1), F.slice(found, at + 1, F.lit(POSITIVES + 1)))).otherwise(F.slice(found, F.lit(1), F.lit(POSITIVES)))


def hard_negatives(rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Hard negatives of each anchor and each of its positives.

    Returns ``anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score``. ``is_anchor`` is a condition on the id, as column ``id``. A
    component x counts as floor(256 * x), a score is an inner product. Higher scores
    come first, ties by smaller id. Positives are the first ``POSITIVES`` other rows of
    the anchor's label; the negatives of a positive are the first ``NEGATIVES`` rows of
    other labels with ``PERCENT`` percent to all of its score. Each row takes part for
    itself, so repeated ids and vectors give ties, and an anchor that occurs twice
    gives its rows twice. Rows with a null id, label, vector or component or a
    component that isn't finite take no part; the end of a shorter vector counts as
    zeros. Scores have to fit a long. An anchor without positives, or whose positives
    have no negatives, gives no row; nor does an empty table. Other columns are ignored.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark)
    own = usable(rows, id_col, vec_col, label_col)
    # anchors that are equal in all that counts are one, with a number of copies
    alike = own.where(is_anchor).groupBy("id", "label", "vec").agg(F.count("*").alias("copies"))
    anchors = scratch.table(alike.withColumn("key", F.monotonically_increasing_id()).withColumn("limits", F.lit(None).cast("array<long>")), "anchors")
    sizes = anchors.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("width")).first()
    total = own.count()
    blocks = max(1, -(-sizes.n * 8 * (sizes.width or 1) // ANCHOR_BYTES))
    parts = max(1, -(-total // MOST_ROWS), min(total // LEAST_ROWS, -(-BLOCKS // blocks)))

    same = _scored(anchors, own, True, blocks, parts, POSITIVES + 1)
    each = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), F.col("id").alias("id"))))
    number = lambda x: F.floor(SCALE * x.cast("double")).cast("long")
    self_score = F.aggregate(F.transform("vec", lambda x: number(x) * number(x)), F.lit(0).cast("long"), lambda s, x: s + x)
    near = same.groupBy("key").agg(each.alias("found")).join(anchors.select("key", F.col("id").alias("anchor_id"), "copies", self_score.alias("self_score")), "key")
    near = near.select("key", "anchor_id", "copies", _without_itself(F.col("found")).alias("positives"))
    near = scratch.table(near.withColumn("limits", F.transform("positives", lambda p: -p["less"])).where("size(limits) > 0"), "positives")

    limited = anchors.drop("limits").join(near.select("key", "limits"), "key")
    others = _scored(limited, own, False, blocks, parts, NEGATIVES)
    both = near.join(_slots(others), "key")
    window = F.explode(_windows(F.col("slots"), F.size("positives")))
    out = both.select("anchor_id", "copies", "positives", window.alias("w")).withColumn("positive", F.get("positives", F.col("w.at")))
    fits = F.filter("w.best", lambda n: -100 * n["less"] >= -PERCENT * F.col("positive.less"))
    out = out.select("anchor_id", "copies", F.col("positive.id").alias("positive_id"), (-F.col("positive.less")).alias("positive_score"), F.posexplode(fits).alias("nth", "n"))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select("anchor_id", "positive_id", (F.col("nth") + 1).cast("int").alias("rank"), F.col("n.id").alias("negative_id"), "positive_score", (-F.col("n.less")).alias("negative_score"))


def _slots(entries: DataFrame) -> DataFrame:
    """``key, slots``: the entries of each slot, at most ``NEGATIVES``, in order, by the slot's number."""
    each = entries.groupBy("key", "slot").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), F.col("id").alias("id")))).alias("best"))
    return each.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("slot", "best"))).alias("slots"))


def _windows(slots: Column, limits: Column) -> Column:
    """``at, best`` for each limit: a slot's entries come before those of the slot below, so merging is joining and cutting."""
    nothing = F.array().cast("array<struct<less:bigint,id:bigint>>")
    start = F.array().cast("array<struct<at:int,best:array<struct<less:bigint,id:bigint>>>>")

    def up(done: Column, at: Column) -> Column:
        below = F.coalesce(F.get(done, F.lit(0))["best"], nothing)
        best = F.slice(F.concat(F.coalesce(F.try_element_at(slots, at), nothing), below), F.lit(1), F.lit(NEGATIVES))
        return F.concat(F.array(F.struct(at.alias("at"), best.alias("best"))), done)

    return F.aggregate(F.sequence(limits - 1, F.lit(0), F.lit(-1)), start, up)
