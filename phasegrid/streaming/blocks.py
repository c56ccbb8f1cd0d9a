"""Streams of blocks and events. Accumulators add up, so a stream's result is that of the batch.

Late data: with a delay ``late``, an event farther than it behind the newest one of
the triggers before is dropped from sessions in every mode, and from windows unless
the mode is complete; state then has a bound. Without one (None) nothing is dropped
and all sessions are kept, which needs the complete mode: so are tables replayed,
whose files may be in any order of time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phasegrid.operators import coupling
from phasegrid.session import scratch

LATE = "10 minutes"


def read_blocks(spark: SparkSession, path: str, files_each: int = 4) -> DataFrame:
    """A file stream over a Parquet table, a few files a trigger."""
    schema = spark.read.parquet(path).schema
    # as a pattern, so that a table in a single file will do as well as one in a folder
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(f"{path[:-1]}[{path[-1]}]")


def drained(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Run a stream over all there is now; the table that its last trigger leaves (complete) or all triggers add to (append).

    A trigger writes a folder of its own, over what an earlier try of it has left,
    so a batch that is run again is not there twice.
    """
    spark = stream.sparkSession
    out = scratch(spark, name)

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/trigger-{epoch}")

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", scratch(spark, f"{name}-progress")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(out)


def accumulated(blocks: DataFrame, keys: Sequence[str], legs, samples: str, block: int | None) -> DataFrame:
    """Running phase-amplitude sums of each key: state is bins x halves numbers a key, whatever has gone by."""
    sums = coupling.phase_amplitude_sums(blocks, keys, legs, samples, block)
    return sums.groupBy(*keys, "leg", "half", "bin").agg(F.sum("amp_sum").alias("amp_sum"), F.sum("n").alias("n"))


def epochs(events: DataFrame, ts: str, width: str, slide: str | None = None, by: Sequence[str] = (), late: str = LATE) -> DataFrame:
    """Counts and sums of ``value`` in fixed or sliding windows."""
    seen = events.withWatermark(ts, late)
    return seen.groupBy(F.window(ts, width, slide) if slide else F.window(ts, width), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, ts: str, gap: str, by: Sequence[str], late: str | None = LATE) -> DataFrame:
    """Counts and sums of ``value`` in runs without a gap."""
    seen = events if late is None else events.withWatermark(ts, late)
    return seen.groupBy(*by, F.session_window(ts, gap)).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def capped_runs(events: DataFrame, key: str, ts: str, step_s: int, cap: int, late: str) -> DataFrame:
    """``key, first_k, last_k, n``: runs of consecutive steps of ``step_s`` seconds that have an event, cut after ``cap`` steps.

    Events may come in any order, no more than ``late`` behind the newest. State of a
    key is the first and last step of its runs that may still grow; a timer at the
    time from which a run can't wakes the key, so it is emitted whether or not the
    key has more events. Whole pieces of a long run are emitted as soon as no event
    can come before their end. Null keys and times give no run.
    """
    schema = T.StructType([events.schema[key], *T._parse_datatype_string("first_k long, last_k long, n long").fields])
    step_ms = 1000 * step_s

    def run(group: tuple, frames: Iterator[pd.DataFrame], kept) -> Iterator[pd.DataFrame]:
        held = kept.get[0] if kept.exists else []
        runs = list(zip(held[::2], held[1::2], strict=True))
        for frame in frames if not kept.hasTimedOut else ():
            runs += [(k, k) for k in set(frame["k"].dropna().astype(int).tolist())]
        settled = kept.getCurrentWatermarkMs() // step_ms  # steps before this one have had all their events
        merged: list[list[int]] = []
        for first, last in sorted(runs):
            if merged and first <= merged[-1][1] + 1:
                merged[-1][1] = max(merged[-1][1], last)
            else:
                merged.append([first, last])
        out, left = [], []
        for first, last in merged:
            over = last + 1 < settled
            while first <= last and (over or (last - first + 1 >= cap and first + cap <= settled)):
                end = min(first + cap - 1, last)
                out.append((group[0], first, end, end - first + 1))
                first = end + 1
            if first <= last:
                left.append((first, last))
        if left:
            kept.update(([k for r in left for k in r],))
            kept.setTimeoutTimestamp(max(kept.getCurrentWatermarkMs() + 1, min((last + 2) * step_ms for _, last in left)))
        elif kept.exists:
            kept.remove()
        if out and group[0] is not None:
            yield pd.DataFrame(out, columns=schema.names)

    seen = events.withWatermark(ts, late).select(key, ts, F.floor(F.unix_micros(ts) / (1_000_000 * step_s)).alias("k"))
    return seen.groupBy(key).applyInPandasWithState(run, schema, "runs array<long>", "append", "EventTimeTimeout")


def each_batch(stream: DataFrame, act: Callable[[DataFrame, int], None], name: str) -> None:
    """Drive a stream to its end, handing each trigger's rows to ``act``."""
    spark = stream.sparkSession
    stream.writeStream.foreachBatch(act).option("checkpointLocation", scratch(spark, name)).trigger(availableNow=True).start().awaitTermination()
