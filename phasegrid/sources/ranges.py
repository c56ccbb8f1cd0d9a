"""A Spark data source that reads EDF recordings by ranges of time and by channel.

A partition is a stretch of one recording, ``part_s`` seconds at most. A task opens
the file, which may lie in any store that Arrow's file systems know, and reads the
bytes of the records and channels asked for, no others. So a recording of any length
is read in parallel and no row holds more than a part of it.

    spark.dataSource.register(EdfRanges)
    spark.read.format("edf_ranges").option("channels", "LA1,LA2").option("from_s", 3600).load("s3://bucket/night.edf")

The options ``channels`` (separated by commas), ``from_s`` and ``to_s`` choose what is
read. ``edf_filtered_ranges`` also takes the query's filters on ``channel`` (equal to a
value or one of several) and on ``start_s`` and ``end_s`` (compared with a number),
where Spark hands them to Python sources (``spark.sql.python.filterPushdown.enabled``).
``edf_details`` reads headers only: a row for each channel with its rate and the
recording's length.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

#: Seconds of a part, tries of a read and seconds to wait before the next one.
PART_S, TRIES, WAIT_S = 600.0, 3, 0.5
#: Bytes between two wanted stretches that are read along, since a read of its own would cost more.
GAP = 4096

SCHEMA = "path string, channel string, sfreq double, start_s double, end_s double, samples array<double>"
DETAILS = "path string, channel string, sfreq double, dur_s double, n_samples bigint, unit string"


@dataclass
class Header:
    """What an EDF header tells: labels, and for each signal its scale to volts, its samples in a record and where they begin in it."""

    labels: list[str]
    units: list[str]
    scale: list[float]
    offset: list[float]
    each: list[int]
    records: int
    record_s: float
    data_at: int

    @property
    def width(self) -> int:
        """Bytes of a record."""
        return 2 * sum(self.each)

    @classmethod
    def parse(cls, head: bytes, size: int) -> Header:
        text = lambda b: b.decode("latin-1").strip()
        number = lambda b: float(text(b) or 0)
        count = int(number(head[252:256]))
        at, columns = 256, []
        for width in (16, 80, 8, 8, 8, 8, 8, 80, 8, 32):
            columns.append([head[at + k * width : at + (k + 1) * width] for k in range(count)])
            at += count * width
        low, high, dig_low, dig_high = ([number(b) for b in columns[k]] for k in (3, 4, 5, 6))
        units = [text(b) for b in columns[2]]
        volts = [{"uV": 1e-6, "µV": 1e-6, "mV": 1e-3}.get(u, 1.0) for u in units]
        scale = [(h - a) / ((dh - d) or 1.0) for a, h, d, dh in zip(low, high, dig_low, dig_high, strict=True)]
        offset = [a - d * s for a, d, s in zip(low, dig_low, scale, strict=True)]
        each = [int(number(b)) for b in columns[8]]
        found = cls([text(b) for b in columns[0]], units, [s * v for s, v in zip(scale, volts, strict=True)], [o * v for o, v in zip(offset, volts, strict=True)], each, int(number(head[236:244])), number(head[244:252]), at)
        whole = (size - at) // found.width if found.width else 0
        if found.records < 0 or found.records > whole:  # unknown while recording, or a file cut short
            found.records = whole
        return found

    def signals(self) -> list[int]:
        """The signals; annotations are none."""
        return [k for k, label in enumerate(self.labels) if "Annotations" not in label and self.each[k]]


def retried(read: Callable[[], bytes]) -> bytes:
    """A store may fail for a moment."""
    for k in range(TRIES):
        try:
            return read()
        except OSError:
            if k == TRIES - 1:
                raise
            time.sleep(WAIT_S * 2**k)
    raise AssertionError


def opened(path: str) -> tuple[Any, int]:
    """A file that can be read at any place, and its size."""
    store, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store.open_input_file(inner), store.get_file_info(inner).size


def header_of(file: Any, size: int) -> Header:
    first = retried(lambda: file.read_at(256, 0))
    signals = int(first[252:256].decode("latin-1").strip() or 0)
    return Header.parse(first + retried(lambda: file.read_at(256 * signals, 256)), size)


def recordings_at(path: str) -> list[str]:
    """The EDF files of a folder and those below it, or the one file."""
    store, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    if store.get_file_info(inner).type == fs.FileType.File:
        return [path]
    found = store.get_file_info(fs.FileSelector(inner, recursive=True))
    prefix = path.rstrip("/")
    return sorted(prefix + f.path[len(inner.rstrip("/")) :] for f in found if f.type == fs.FileType.File and f.path.endswith(".edf"))


@dataclass
class Part(InputPartition):
    """Records ``first`` to ``last``, not included, of a file."""

    path: str
    first: int
    last: int

    def __post_init__(self) -> None:
        super().__init__(None)


@dataclass
class Wanted:
    channels: set[str] | None = None
    from_s: float = 0.0
    to_s: float = float("inf")
    #: Bounds that whole rows have to meet: the ends of a part.
    row: list[tuple[str, str, float]] = field(default_factory=list)

    def takes(self, start_s: float, end_s: float) -> bool:
        at = {"start_s": start_s, "end_s": end_s}
        compare = {"<": float.__lt__, "<=": float.__le__, ">": float.__gt__, ">=": float.__ge__, "=": float.__eq__}
        return all(compare[op](at[name], value) for name, op, value in self.row)


class RangeReader(DataSourceReader):
    def __init__(self, path: str, wanted: Wanted, part_s: float):
        self.path, self.wanted, self.part_s = path, wanted, part_s

    def partitions(self) -> list[Part]:
        out = []
        for path in recordings_at(self.path):
            file, size = opened(path)
            with file:
                h = header_of(file, size)
            step = max(1, int(self.part_s / h.record_s)) if h.record_s > 0 else max(1, h.records)
            first = max(0, int(self.wanted.from_s // h.record_s)) if h.record_s > 0 else 0
            last = h.records if self.wanted.to_s == float("inf") or h.record_s <= 0 else min(h.records, int(-(-self.wanted.to_s // h.record_s)))
            # parts begin at multiples of a part's length, so that they are the same whatever is asked for
            for k in range(first - first % step, last, step):
                a, b = k, min(k + step, h.records)
                if self.wanted.takes(a * h.record_s, b * h.record_s):
                    out.append(Part(path, max(a, first), min(b, last)))
        return out

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there was none to read
            return
        file, size = opened(partition.path)
        with file:
            h = header_of(file, size)
            yield from read_part(file, h, partition, self.wanted.channels)


class FilteredRangeReader(RangeReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes what it can answer exactly, gives back the rest."""
        signs = {EqualTo: "=", LessThan: "<", LessThanOrEqual: "<=", GreaterThan: ">", GreaterThanOrEqual: ">="}
        for f in filters:
            name = f.attribute if hasattr(f, "attribute") else ()
            if name == ("channel",) and isinstance(f, (EqualTo, In)):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted.channels = own if self.wanted.channels is None else self.wanted.channels & own
            elif name in (("start_s",), ("end_s",)) and type(f) in signs and isinstance(f.value, (int, float)):
                self.wanted.row.append((name[0], signs[type(f)], float(f.value)))
            else:
                yield f


def stretches(h: Header, signals: list[int]) -> list[tuple[int, int]]:
    """Byte ranges of a record that hold the signals; those closer than ``GAP`` are one."""
    at = np.concatenate([[0], np.cumsum(h.each)]) * 2
    out: list[tuple[int, int]] = []
    for k in signals:
        a, b = int(at[k]), int(at[k + 1])
        if out and a - out[-1][1] <= GAP:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def read_part(file: Any, h: Header, part: Part, channels: set[str] | None) -> Iterator[pa.RecordBatch]:
    """A batch for each channel: its samples in volts from the part's first record on."""
    signals = [k for k in h.signals() if channels is None or h.labels[k] in channels]
    n = part.last - part.first
    if not signals or n <= 0:
        return
    own, held = stretches(h, signals), {}
    if len(own) == 1 and own[0][1] - own[0][0] + GAP >= h.width:  # as good as all: one read
        raw = retried(lambda: file.read_at(n * h.width, h.data_at + part.first * h.width))
        held[own[0]] = np.frombuffer(raw, np.uint8).reshape(n, h.width)[:, own[0][0] : own[0][1]]
    else:
        for a, b in own:
            raw = b"".join(retried(lambda r=r: file.read_at(b - a, h.data_at + r * h.width + a)) for r in range(part.first, part.last))  # noqa: B023
            held[a, b] = np.frombuffer(raw, np.uint8).reshape(n, b - a)
    at = np.concatenate([[0], np.cumsum(h.each)]) * 2
    start, end = part.first * h.record_s, part.last * h.record_s
    for k in signals:
        (a, _), block = next((s, x) for s, x in held.items() if s[0] <= at[k] < s[1])
        x = np.ascontiguousarray(block[:, at[k] - a : at[k + 1] - a]).view("<i2").reshape(-1) * h.scale[k] + h.offset[k]
        rate = h.each[k] / h.record_s if h.record_s > 0 else float(h.each[k])
        yield pa.RecordBatch.from_arrays([pa.array([part.path]), pa.array([h.labels[k]]), pa.array([rate]), pa.array([start]), pa.array([end]), pa.array([x], pa.list_(pa.float64()))], ["path", "channel", "sfreq", "start_s", "end_s", "samples"])


class EdfRanges(DataSource):
    """``path, channel, sfreq, start_s, end_s, samples``: a row for each channel and part of each recording."""

    @classmethod
    def name(cls) -> str:
        return "edf_ranges"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> RangeReader:
        o = self.options
        channels = {c.strip() for c in o["channels"].split(",")} if o.get("channels") else None
        wanted = Wanted(channels, float(o.get("from_s", 0)), float(o.get("to_s", "inf")))
        return RangeReader(o["path"], wanted, float(o.get("part_s", PART_S)))


class EdfFilteredRanges(EdfRanges):
    """The same, choosing what it reads by the query's filters too; needs ``spark.sql.python.filterPushdown.enabled``."""

    @classmethod
    def name(cls) -> str:
        return "edf_filtered_ranges"

    def reader(self, schema: StructType) -> RangeReader:
        plain = super().reader(schema)
        return FilteredRangeReader(plain.path, plain.wanted, plain.part_s)


class DetailsReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Part]:
        return [Part(p, 0, 0) for p in recordings_at(self.path)]

    def read(self, partition: Part | None) -> Iterator[tuple]:
        if partition is None:
            return
        file, size = opened(partition.path)
        with file:
            h = header_of(file, size)
        for k in h.signals():
            n = h.records * h.each[k]
            rate = h.each[k] / h.record_s if h.record_s > 0 else float(h.each[k])
            yield partition.path, h.labels[k], rate, h.records * h.record_s if h.record_s > 0 else n / rate, n, h.units[k]


class EdfDetails(DataSource):
    """``path, channel, sfreq, dur_s, n_samples, unit``: from headers; the length is that of the records, else samples by rate."""

    @classmethod
    def name(cls) -> str:
        return "edf_details"

    def schema(self) -> str:
        return DETAILS

    def reader(self, schema: StructType) -> DetailsReader:
        return DetailsReader(self.options["path"])


#: Physical bounds of written files and the digital ones; values beyond are cut.
PHYSICAL, DIGITAL = (-1000, 1000), (-32768, 32767)


def edf_bytes(channels: dict[str, np.ndarray], sfreq: float, record_s: float, unit: str) -> bytes:
    """An EDF file of channels of one length; the last record is filled up with zeros."""
    each = int(round(sfreq * record_s))
    longest = max((len(x) for x in channels.values()), default=0)
    records = -(-longest // each)
    pad = lambda v, width: str(v).encode("latin-1", "replace")[:width].ljust(width)
    head = pad(0, 8) + pad("", 80) + pad("", 80) + pad("01.01.00", 8) + pad("00.00.00", 8) + pad(256 * (len(channels) + 1), 8) + pad("", 44) + pad(records, 8) + pad(f"{record_s:g}", 8) + pad(len(channels), 4)
    for width, value in ((16, None), (80, ""), (8, unit), (8, PHYSICAL[0]), (8, PHYSICAL[1]), (8, DIGITAL[0]), (8, DIGITAL[1]), (80, ""), (8, each), (32, "")):
        head += b"".join(pad(name if value is None else value, width) for name in channels)
    scale = (DIGITAL[1] - DIGITAL[0]) / (PHYSICAL[1] - PHYSICAL[0])
    blocks = []
    for x in channels.values():
        full = np.zeros(records * each)
        full[: len(x)] = x
        blocks.append(np.floor((np.clip(full, *PHYSICAL) - PHYSICAL[0]) * scale + DIGITAL[0] + 0.5).astype("<i2").reshape(records, each))
    return head + (np.concatenate(blocks, axis=1).tobytes() if blocks else b"")


def write_edf(signals: DataFrame, folder: str, sfreq: float, record_s: float, unit: str = "uV") -> DataFrame:
    """``path, channels``: ``signals`` (recording, channel, samples) as a file for each recording, which a task writes whole."""

    def write(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        store, inner = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        store.create_dir(inner, recursive=True)
        rows = rows.sort_values("channel")
        with store.open_output_stream(f"{inner}/{key[0]}.edf") as out:
            out.write(edf_bytes({str(c): np.asarray(x, dtype=np.float64) for c, x in zip(rows["channel"], rows["samples"], strict=True)}, sfreq, record_s, unit))
        return pd.DataFrame([(f"{folder}/{key[0]}.edf", len(rows))], columns=["path", "channels"])

    own = signals.select(F.col("recording").cast("string").alias("recording"), F.col("channel").cast("string").alias("channel"), "samples")
    return own.groupBy("recording").applyInPandas(write, "path string, channels long")
