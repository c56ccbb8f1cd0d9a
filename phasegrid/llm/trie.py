"""The prefix trie of conversations, by a splitter skeleton.

Conversations are paths of turns. Distinct paths are sorted and cut into shards at
splitter paths. A node whose conversations lie in two shards or more is a proper
prefix of a splitter; these nodes are the skeleton, which is as small as the splitters
are. Each shard is worked through once in order and finishes all other nodes of its
own. Of skeleton nodes it leaves a partial aggregate, and these are reduced by node.

The work in a shard keeps the nodes of one path open, and what waits for the parent of
a finished node; where many wait for one parent, they leave without it and are joined
with it afterwards. So memory has a bound whatever a shard holds.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasegrid.llm.store import Scratch
from phasegrid.llm.words import turn_to

#: Characters of a turn's name: 128 bits in hexadecimal digits.
NAME = 32
#: Turns of a shard, about; the fewest and most shards; sampled paths for each splitter.
SHARD_TURNS, LEAST_SHARDS, MOST_SHARDS, SAMPLED = 200_000, 16, 16_384, 4
#: Bytes of all splitters, at most. It is the bound of what is broadcast; a splitter that would be longer is cut.
SPLITTER_BYTES = 16 << 20
#: Finished nodes that wait for their parents in a task, at most.
MOST_WAITING = 100_000
#: Ids in one piece of a hashed sequence.
PIECE = 10_000

TURNS = "array<struct<name:string,size:bigint>>"
#: A node: ``kind`` 0 is a whole one, 1 a whole one that others wait for, 2 a part of a skeleton node, whose key is its path. ``end_conv`` is the one that ends there, if it is one.
NODE = "kind long, key string, parent string, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends long, end_conv long, size long"


def named_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, turns``: each conversation's turns in order, as names (a hash of role and text) and the text's bytes in UTF-8.

    Turns are ordered by ``turn`` (null first), equal ones by their names; null role
    and text count as empty. Rows without a ``conv_id`` belong to no conversation. Texts are
    hashed where they lie and don't move; a conversation's names meet in one row.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    name = F.substring(F.sha2(F.concat_ws("|", F.length(role).cast("string"), role, text), 256), 1, NAME)
    own = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").alias("turn"), name.alias("name"), F.octet_length(text).cast("long").alias("size")).alias("t"))
    each = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["name"].alias("name"), t["size"].alias("size")))
    return own.groupBy("conv_id").agg(each.alias("turns"))


def rebuilt_conversations(convs: DataFrame) -> DataFrame:
    """Each conversation c behind the first h turns of conversation c - c % 5, itself from turn h on; h is crc32(c) % 9."""
    own = convs.withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int"))
    base = convs.select(F.col("conv_id").alias("base"), F.col("turns").alias("first"))
    both = own.join(base, own["conv_id"] - own["conv_id"] % 5 == base["base"], "left")
    first = F.coalesce(F.slice("first", F.lit(1), F.col("h")), F.array().cast(TURNS))
    return both.select("conv_id", F.concat(first, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def _common(a: str, b: str) -> int:
    """How many turns two paths begin with in common."""
    most = min(len(a), len(b)) // NAME
    if a[: most * NAME] == b[: most * NAME]:
        return most
    low, high = 0, most - 1
    while low < high:  # the last depth at which they agree
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[: mid * NAME] == b[: mid * NAME] else (low, mid - 1)
    return low


def splitters(paths: DataFrame, shards: int) -> list[str]:
    """At most ``shards`` - 1 paths that cut ``paths`` (distinct) into parts of about the same size.

    Taken from a sample by hash, of fixed size. A splitter is only as long as
    tells it from the sampled path before it, and no longer than its share of ``SPLITTER_BYTES``.
    """
    longest = max(1, SPLITTER_BYTES // (NAME * shards))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, before, nth = set(), "", 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                nth += 1
                if nth % SAMPLED == 0:
                    found.add(path[: NAME * min(longest, _common(before, path) + 1)])
                before = path
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found - {""}), pa.string())], ["path"])

    sample = paths.select("path", F.xxhash64("path").alias("__h")).orderBy("__h", "path").limit(SAMPLED * shards)
    cut = sample.select("path").repartition(1).sortWithinPartitions("path").mapInArrow(run, "path string")
    return sorted(r.path for r in cut.collect())


class _Open:
    """A node of the path that is being worked through."""

    __slots__ = ("children", "conv", "end_conv", "ends", "leaves", "left", "members", "saved", "size", "skeleton", "waiting")

    def __init__(self, size: int, skeleton: bool):
        self.size, self.skeleton = size, skeleton
        self.members = self.children = self.leaves = self.saved = self.ends = 0
        self.conv: int | None = None
        self.end_conv: int | None = None
        self.waiting: list[tuple] = []
        self.left = False  # some of its children went without it


class _Shard:
    """Distinct paths of one shard, in order, become nodes."""

    def __init__(self, before: str | None, behind: str | None):
        self.bounds = [s for s in (before, behind) if s is not None]
        self.path, self.open, self.waiting, self.rows = "", [], 0, []

    def _key(self, depth: int) -> str:
        return hashlib.sha256(self.path[: depth * NAME].encode()).hexdigest()[:NAME]

    def _left(self, at: _Open, depth: int) -> None:
        """The finished children of a node go on without it."""
        key = self._key(depth)
        self.rows.extend((*r[:2], key, *r[3:]) for r in at.waiting)
        self.waiting -= len(at.waiting)
        at.waiting, at.left = [], True

    def _close(self) -> None:
        depth = len(self.open) - 1
        at = self.open.pop()
        above = self.open[-1] if self.open else None
        if at.skeleton:
            self._left(at, depth)
            prefix = self.path[: depth * NAME]
            self.rows.append((2, prefix, None, at.conv, depth, None, at.members, at.children, at.leaves, at.saved, at.ends, at.end_conv, at.size))
        else:
            at.leaves = at.leaves if at.children else 1
            at.saved += (at.members - 1) * at.size
            self.rows.extend((*r[:5], at.conv, *r[6:]) for r in at.waiting)
            self.waiting -= len(at.waiting)
            key = self._key(depth) if at.ends > 1 or at.left else None
            row = (int(at.left), key, None, at.conv, depth, None, at.members, at.children, at.leaves, at.saved, at.ends, at.end_conv, at.size)
            if above is None:
                self.rows.append(row)
            else:
                above.waiting.append(row)
                self.waiting += 1
        if above is not None:
            above.members += at.members
            above.conv = at.conv if above.conv is None else min(above.conv, at.conv)
            above.leaves += at.leaves
            above.saved += at.saved
            above.children += not at.skeleton
            if self.waiting > MOST_WAITING:
                most = max(range(len(self.open)), key=lambda d: len(self.open[d].waiting))
                self._left(self.open[most], most)

    def take(self, path: str, sizes: Sequence[int], conv: int, times: int) -> None:
        same = _common(self.path, path)
        while len(self.open) > same + 1:
            self._close()
        self.path = path
        deepest = max((min(_common(path, s), len(s) // NAME - 1) for s in self.bounds), default=-1)
        for depth in range(len(self.open), len(path) // NAME + 1):
            self.open.append(_Open(sizes[depth - 1] if depth else 0, depth <= deepest))
        last = self.open[-1]
        last.members += times
        last.ends, last.end_conv = times, conv
        last.conv = conv if last.conv is None else min(last.conv, conv)

    def finish(self) -> None:
        while self.open:
            self._close()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split() for c in NODE.split(", ")]
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if kind == "string" else pa.int64()) for c, (_, kind) in zip(columns, names, strict=True)], [n for n, _ in names])


def shard_nodes(paths: DataFrame, cuts: list[str], shards: int) -> DataFrame:
    """Rows of ``NODE``; a skeleton node's partial aggregates have its path as ``key`` and no ``parent_conv_id``."""
    held = paths.sparkSession.sparkContext.broadcast(cuts)
    schema = "shard int, path string, conv_id long, times long, sizes array<long>"

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            at = [bisect_right(own, p) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *batch.columns], ["shard", "path", "conv_id", "times", "sizes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("trie")
        own, now, shard = held.value, None, None
        for batch in batches:
            for at, path, conv, times, sizes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != now:
                    if shard is not None:
                        shard.finish()
                        yield _batch(shard.rows)
                    now, shard = at, _Shard(own[at - 1] if at else None, own[at] if at < len(own) else None)
                shard.take(path, sizes, conv, times)
                if len(shard.rows) >= 10_000:
                    yield _batch(shard.rows)
                    shard.rows = []
        if shard is not None:
            shard.finish()
            yield _batch(shard.rows)

    dealt = paths.mapInArrow(placed, schema).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "path")
    return dealt.mapInArrow(run, NODE)


def end_hashes(convs: DataFrame, scratch: Scratch) -> DataFrame:
    """``key, sha``: for each path that is two conversations or more, the hash of their ids, ascending and joined; for some others too.

    Rows are dealt to ranges of (path, id), so the ids of one path may fill many
    tasks. Paths that lie inside one task are finished there. Of a task's first and
    last path, and of long ones, the joined ids go on in pieces, which are hashed in
    order: the hash of one long string is one sequence of steps, but it takes no
    memory, and only the ids themselves pass through it.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, goes_on, out = None, [], True, []

        def made() -> pa.RecordBatch:
            rows = list(zip(*out, strict=True)) if out else [[]] * 4
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], ["key", "at", "piece", "sha"])

        def end() -> None:
            joined = ",".join(map(str, ids))
            if goes_on:
                out.append((key, ids[0], joined, None))
            elif len(ids) > 1:
                out.append((key, None, None, hashlib.sha256(joined.encode()).hexdigest()))
            ids.clear()

        for batch in batches:
            for own, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own != key and ids:
                    end()
                    goes_on = False
                elif len(ids) >= PIECE:
                    goes_on = True
                    end()
                key = own
                ids.append(conv)
                if len(out) >= 1000:
                    yield made()
        if ids:
            goes_on = True
            end()
        yield made()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, out = None, None, []
        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], ["key", "sha"])
        for batch in batches:
            for own, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own == key:
                    sha.update(f",{piece}".encode())
                    continue
                if key is not None:
                    out.append((key, sha.hexdigest()))
                key, sha = own, hashlib.sha256(piece.encode())
            if len(out) >= 1000:
                yield made()
                out = []
        if key is not None:
            out.append((key, sha.hexdigest()))
            yield made()

    ranged = convs.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    some = scratch.table(ranged.mapInArrow(pieces, "key string, at long, piece string, sha string"), "ends")
    going = some.where("piece is not null").select("key", "at", "piece").repartition("key").sortWithinPartitions("key", "at")
    return some.where("sha is not null").select("key", "sha").unionByName(going.select("key", "piece").mapInArrow(hashed, "key string, sha string"))


def _key_of(path: Column) -> Column:
    return F.substring(F.sha2(path, 256), 1, NAME)


def reduced_skeleton(partial: DataFrame) -> DataFrame:
    """The skeleton's nodes, whole, from the shards' partial aggregates (``key`` is a path)."""
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens", "ends")]
    nodes = partial.withColumnRenamed("key", "path").groupBy("path").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.max("end_conv").alias("end_conv"), F.max("size").alias("size"), *sums)
    above = nodes.where("depth > 0").select(F.expr(f"substring(path, 1, cast((depth - 1) * {NAME} as int))").alias("path"))
    children = above.groupBy("path").agg(F.count("*").alias("more_children"))
    tops = nodes.select(F.explode(F.expr(f"transform(sequence(0L, depth), d -> substring(path, 1, cast(d * {NAME} as int)))")).alias("path"), F.expr("(n_convs - 1) * size").alias("own"))
    saved = tops.groupBy("path").agg(F.sum("own").alias("more_saved"))
    both = nodes.join(children, "path", "left").join(saved, "path", "left")
    return both.withColumns({"n_children": F.expr("n_children + coalesce(more_children, 0)"), "saved_tokens": F.expr("saved_tokens + coalesce(more_saved, 0)"), "key": _key_of(F.col("path"))}).drop("more_children", "more_saved", "size")


def prefix_trie(convs: DataFrame) -> DataFrame:
    """A row for each node of the prefix trie of ``convs`` (conv_id, distinct, and turns as ``named_turns`` gives them).

    A node is a distinct sequence of first turns; the root has none. Conversations
    that begin with it are its members. Returns ``conv_id`` (the smallest member),
    ``depth``, ``parent_conv_id`` (of the parent; null at the root), ``n_convs``
    (members), ``n_children``, ``n_leaves`` (childless nodes of its subtree, itself
    included), ``saved_tokens`` (over its subtree, the bytes of each node's last text
    times its members but one) and ``ends_sha256`` (of the ids of the members that
    end there, ascending and joined by commas). A conversation without turns ends at the
    root. Null turns count as none. An empty table gives an empty result, since no
    conversation begins with the root. Equal conversations are counted before they are
    shuffled. Other columns are ignored.
    """
    scratch = Scratch(convs.sparkSession)
    path = F.coalesce(F.array_join(F.transform("turns", lambda t: t["name"]), ""), F.lit(""))
    sizes = F.coalesce(F.transform("turns", lambda t: t["size"]), F.array().cast("array<long>"))
    rows = scratch.table(convs.select("conv_id", path.alias("path"), sizes.alias("sizes")).withColumn("key", _key_of(F.col("path"))), "paths")
    paths = scratch.table(rows.groupBy("path").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("times"), F.first("sizes").alias("sizes")), "distinct")
    total = paths.agg(F.sum(F.size("sizes") + 1)).first()[0] or 0
    shards = min(MOST_SHARDS, max(LEAST_SHARDS, -(-total // SHARD_TURNS)))
    made = scratch.table(shard_nodes(paths, splitters(paths, shards), shards), "nodes")
    skeleton = scratch.table(reduced_skeleton(made.where("kind = 2")), "skeleton")

    columns = ["key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends", "end_conv"]
    done = made.where("kind < 2 and parent is null").select(columns)
    waiting = made.where("kind < 2 and parent is not null").drop("parent_conv_id")
    # parents in the skeleton are few and may have any number of children; other parents have those of their shard
    parent = lambda df: df.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    top = F.broadcast(parent(skeleton))
    below = waiting.join(top, "parent").select(columns)
    rest = waiting.join(top, "parent", "left_anti").join(parent(made.where("kind = 1")), "parent").select(columns)
    higher = skeleton.select("path", F.col("conv_id").alias("parent_conv_id"))
    inner = skeleton.withColumn("above", F.expr(f"if(depth > 0, substring(path, 1, cast((depth - 1) * {NAME} as int)), null)")).drop("path")
    inner = inner.join(higher.withColumnRenamed("path", "above"), "above", "left").select(columns)
    nodes = done.unionByName(below).unionByName(rest).unionByName(inner)
    once = nodes.where("ends <= 1").withColumn("sha", F.sha2(F.coalesce(F.col("end_conv").cast("string"), F.lit("")), 256))
    often = nodes.where("ends > 1").join(end_hashes(rows, scratch), "key")
    return once.unionByName(often.select(once.columns)).select(*columns[1:8], F.col("sha").alias("ends_sha256"))
