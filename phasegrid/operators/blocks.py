"""Signals in blocks: rows ``*keys, block, samples``, of which none holds a whole signal.

A recursive filter is a linear system, so a block acts on the filter's state as an
affine map. Each block is summed up by its maps for both directions of time, a few
dozen numbers, in parallel; the maps are composed from block to block, there and back;
and each block is filtered from the states that it begins with. Samples are read twice
and shuffled once, to meet their states.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phasegrid.functions import dsp
from phasegrid.operators import events as ev

#: Samples of a block, where nothing else is said.
SIZE = 65_536


def blocks_of_samples(rows: DataFrame, keys: Sequence[str], k: str = "k", v: str = "v", size: int = SIZE) -> DataFrame:
    """``*keys, block, samples`` from a row for each sample, numbered by ``k``. A signal's first and last block may be short."""
    cell = rows.select(*keys, F.floor(F.col(k) / size).cast("long").alias("block"), F.struct(F.col(k).alias("k"), F.col(v).cast("double").alias("v")).alias("at"))
    each = F.transform(F.sort_array(F.collect_list("at")), lambda x: x["v"])
    return cell.groupBy(*keys, "block").agg(each.alias("samples"))


def blocks_of_knots(knots: DataFrame, keys: Sequence[str], size: int = SIZE) -> DataFrame:
    """The same from the knots of gridded events (``events.knots``), which are cut at the blocks' ends."""
    cut = knots.select("*", F.explode(F.sequence(F.floor(F.col("low") / size), F.floor(F.col("high") / size))).alias("block"))
    low, high = F.greatest(F.col("low"), F.col("block") * size), F.least(F.col("high"), F.col("block") * size + size - 1)
    return cut.withColumn("low", low).withColumn("high", high).groupBy(*keys, "block").agg(ev.joined_up().alias("samples"))


def blocks_of_signals(signals: DataFrame, keys: Sequence[str], samples: str = "samples", size: int = SIZE) -> DataFrame:
    """The same from array rows."""
    last = F.floor((F.size(samples) - 1) / size)
    cut = signals.where(F.size(samples) > 0).select(*keys, samples, F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    return cut.select(*keys, "block", F.slice(F.col(samples).cast("array<double>"), (F.col("block") * size + 1).cast("int"), F.lit(size)).alias("samples"))


def samples_of_blocks(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``*keys, i, x`` from blocks with their ``start``."""
    return blocks.select(*keys, "start", F.posexplode("samples").alias("at", "x")).select(*keys, (F.col("start") + F.col("at")).alias("i"), "x")


class _System:
    """A filter and what blocks of some length do in it, each worked out once."""

    def __init__(self, sections: np.ndarray):
        self.space, self.edge = dsp.state_space(sections), dsp.edge_of(sections)
        self.crossed = lru_cache(1024)(self._crossed)
        self.trend = lru_cache(1024)(self._trend)

    def maps(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """End states from zero: of the rows forward, and of that output backward."""
        y, there = self.space.run(x)
        return there, self.space.run(y[:, ::-1])[1]

    def _crossed(self, n: int) -> np.ndarray:
        """What the forward state before ``n`` samples adds to the backward state behind them."""
        y, _ = self.space.run(np.zeros((self.space.size, n)), np.eye(self.space.size))
        return self.space.run(y[:, ::-1])[1]

    def _trend(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """``maps`` of a constant and of a ramp."""
        return self.maps(np.stack([np.ones(n), np.arange(n, dtype=np.float64)]))


@lru_cache(maxsize=128)
def _system(raw: bytes) -> _System:
    """The system of these sections, worked out once in a process and not for each signal."""
    return _System(np.frombuffer(raw).reshape(-1, 6))


#: Columns of a block's summary; the prefix keeps them apart from keys.
_SUMMED = "__n long, __total double, __weighted double, __low double, __high double, __head array<double>, __tail array<double>, __there array<double>, __back array<double>"


def _summed(blocks: DataFrame, keys: list[str], sections: np.ndarray) -> DataFrame:
    """A small row for each block: its length, sums, ends and maps."""
    names = [*keys, "block", *(f.split()[0] for f in _SUMMED.split(", "))]
    schema = T.StructType([*(blocks.schema[k] for k in [*keys, "block"]), *T._parse_datatype_string(_SUMMED).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system = _system(raw)
        for batch in batches:
            rows = []
            for value in batch.column(batch.num_columns - 1):
                x = np.array(value.values.to_numpy(zero_copy_only=False), dtype=np.float64)
                there, back = system.maps(x[None, :])
                rows.append((len(x), x.sum(), x @ np.arange(len(x)), x.min(), x.max(), x[: system.edge + 1], x[-system.edge - 1 :], there[0], back[0]))
            if rows:
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(list(c)) for c in zip(*rows, strict=True))], names)

    raw = np.ascontiguousarray(sections, dtype=np.float64).tobytes()
    own = blocks.where("size(samples) > 0").select(*keys, "block", F.col("samples").cast("array<double>"))
    return own.mapInArrow(run, schema)


def _structs(column: pa.ListArray) -> Iterator[dict]:
    """For each list of structs a dict of its fields: arrays of numbers, lists of arrays."""
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(column).to_numpy())])
    flat = column.flatten()
    whole = {}
    for field, child in zip(flat.type, flat.flatten(), strict=True):
        if pa.types.is_list(child.type):
            at = np.cumsum(pc.list_value_length(child).to_numpy())[:-1]
            whole[field.name] = np.split(child.flatten().to_numpy(zero_copy_only=False), at) if len(child) else []
        else:
            whole[field.name] = child.to_numpy(zero_copy_only=False)
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        yield {name: values[a:b] for name, values in whole.items()}


def _composed(system: _System, rows: dict, detrend: bool, least: int) -> list[tuple]:
    """For each of a signal's blocks, in order: first sample, the line in it (value at its start, slope), forward and backward state. ``rows`` has an array or list for each column."""
    n = rows["__n"]
    start, all_n = np.concatenate([[0], np.cumsum(n)[:-1]]), int(n.sum())
    total, low, high = rows["__total"].sum(), rows["__low"].min(), rows["__high"].max()
    if all_n < least or not np.isfinite([total, low, high]).all() or low == high:
        return []
    slope = level = 0.0
    if detrend:
        middle = (all_n - 1) / 2
        weighted = rows["__weighted"].sum() + (start * rows["__total"]).sum() - middle * total
        slope = weighted / (all_n * (all_n**2 - 1) / 12)
        level = total / all_n - slope * middle
    at = level + slope * start
    space, edge = system.space, min(system.edge, all_n - 1)
    there, back = np.stack(rows["__there"]), np.stack(rows["__back"])
    for k, size in enumerate(n.tolist()):
        (ones, ramp), (ones_back, ramp_back) = system.trend(size)
        there[k] -= at[k] * ones + slope * ramp
        back[k] -= at[k] * ones_back + slope * ramp_back

    def ends(column: str, order: Sequence[int]) -> np.ndarray:
        """The first or last ``edge`` + 1 samples, which may lie in several blocks."""
        parts, held = [], 0
        for k in order:
            if held > edge:
                break
            parts.append(rows[f"__{column}"][k])
            held += len(parts[-1])
        return np.concatenate(parts if column == "head" else parts[::-1])

    head, tail = ends("head", range(len(n)))[: edge + 1], ends("tail", range(len(n) - 1, -1, -1))[-edge - 1 :]
    head = head - level - slope * np.arange(edge + 1)
    tail = tail - level - slope * np.arange(all_n - edge - 1, all_n)
    before = (2 * head[0] - head[:0:-1])[None, :]
    state = space.run(before, space.steady(before[:, 0]))[1]
    forward = []
    for k, size in enumerate(n.tolist()):
        forward.append(state[0])
        state = state @ space.over(size) + there[k]
    behind = space.run((2 * tail[-1] - tail[-2::-1])[None, :], state)[0][:, ::-1]
    state = space.run(behind, space.steady(behind[:, 0]))[1]
    backward = []
    for k in range(len(n) - 1, -1, -1):
        backward.append(state[0])
        state = state @ space.over(int(n[k])) + back[k] + forward[k] @ system.crossed(int(n[k]))
    return list(zip(rows["block"].tolist(), start.tolist(), at.tolist(), [slope] * len(n), forward, backward[::-1], strict=True))


def filtered_blocks(blocks: DataFrame, keys: Sequence[str], sections: np.ndarray, detrend: bool = False, least: int = 8) -> DataFrame:
    """``*keys, block, start, samples``: zero-phase filtering, as ``dsp.filtfilt`` of the whole signals gives it.

    ``start`` is a block's first sample number in its signal. Blocks of a signal are
    taken in the order of their numbers, of any lengths. With ``detrend`` the
    signal's least-squares line is taken off first. Signals with a value that is
    null or not finite, constant ones and those of fewer than ``least`` samples
    give no row; empty blocks neither. What meets in one task of a signal is a row
    of some hundred numbers for each block.
    """
    names, raw = list(keys), np.ascontiguousarray(sections, dtype=np.float64).tobytes()
    states = "block long, start long, __at double, __slope double, __forward array<double>, __backward array<double>"
    schema = T.StructType([*(blocks.schema[k] for k in names), *T._parse_datatype_string(states).fields])

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, of = [], []
            for k, rows in enumerate(_structs(batch.column(len(names)))):
                own = _composed(_system(raw), rows, detrend, least)
                out += own
                of += [k] * len(own)
            if out:
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
                columns = [pa.array(list(c), kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(of)) for k in range(len(names))), *columns], schema.names)

    # a row for each signal, many of them in a batch: a call for each signal would cost more than its few products
    summed = _summed(blocks, names, sections)
    listed = F.sort_array(F.collect_list(F.struct(*[c for c in summed.columns if c not in names])))
    found = summed.groupBy(*names).agg(listed.alias("__blocks")).mapInArrow(compose, schema)
    both = blocks.select(*names, "block", F.col("samples").cast("array<double>").alias("samples")).join(found, [*names, "block"])
    out = T.StructType([*(blocks.schema[k] for k in names), *T._parse_datatype_string("block long, start long, samples array<double>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = dsp.state_space(sections)
        for batch in batches:
            done = []
            own = [batch.column(batch.num_columns - 5 + k).to_numpy(zero_copy_only=False) for k in range(5)]
            for x, at, slope, forward, backward in zip(*own, strict=True):
                x = np.asarray(x, dtype=np.float64)
                y = space.run((x - at - slope * np.arange(len(x)))[None, :], np.asarray(forward)[None, :])[0]
                done.append(space.run(y[:, ::-1], np.asarray(backward)[None, :])[0][0, ::-1])
            if done:
                yield pa.RecordBatch.from_arrays([*batch.columns[:-5], pa.array(done, pa.list_(pa.float64()))], [*names, "block", "start", "samples"])

    return both.select(*names, "block", "start", "samples", "__at", "__slope", "__forward", "__backward").mapInArrow(run, out)


def bandpassed_blocks(blocks: DataFrame, keys: Sequence[str], low: float, high: float, sfreq: float, order: int = 3) -> DataFrame:
    """The least-squares line taken off, then a zero-phase band-pass; see ``filtered_blocks``."""
    return filtered_blocks(blocks, keys, dsp.butter_bandpass(low, high, sfreq, order), detrend=True)
