"""Streaming queries: the tables replayed as file streams, each with the oracle of its batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from phasegrid.operators import coupling
from phasegrid.plans import event_queries, signal_queries
from phasegrid.session import scratch
from phasegrid.streaming import blocks


def stream_accumulators(spark, d):
    """Phase-amplitude sums added up block by block, then the aligned curve."""
    stream = blocks.read_blocks(spark, f"{d}/embeddings.parquet")
    sums = blocks.drained(blocks.accumulated(stream, ["label"], [("leg", signal_queries.PHASE, signal_queries.AMP)], "embedding", 8), "complete", "sums")
    return coupling.aligned(sums, ["label"]).select("label", "pos", F.round("value", 9).alias("value"))


def stream_epochs(spark, d):
    """Fixed windows of 30 minutes."""
    got = blocks.drained(blocks.epochs(blocks.read_blocks(spark, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "30 minutes", by=["event_type"]), "complete", "epochs")
    return got.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("epoch"), "event_type", "n", F.round(F.col("total") / F.col("n"), 8).alias("mean_value"))


def stream_sliding(spark, d):
    """Nine-hour windows every three hours."""
    got = blocks.drained(blocks.epochs(blocks.read_blocks(spark, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "9 hours", "3 hours"), "complete", "sliding")
    return got.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("epoch"), "n", F.round(F.col("total") / F.col("n"), 8).alias("mean_value"))


def stream_sessions(spark, d):
    """Runs of a user's events without a gap of two hours."""
    got = blocks.drained(blocks.sessions(blocks.read_blocks(spark, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "2 hours", ["user_id"], late=None), "complete", "sessions")
    return got.select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("begin"), "n", F.round("total", 6).alias("total"))


def stream_capped_runs(spark, d):
    """A user's runs of hours with an event, three hours at most, from files in random order; a last file with an event far ahead closes what is open."""
    folder = scratch(spark, "shuffled")
    own = spark.read.parquet(f"{d}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    own.repartition(8, F.xxhash64("ts", "user_id")).write.parquet(folder)
    span = own.agg((F.unix_seconds(F.max("ts")) - F.unix_seconds(F.min("ts"))).alias("s"), F.max("ts").alias("end")).first()
    late = (span.s or 0) + 3600
    ahead = own.limit(0).unionByName(spark.range(1).select(F.lit(None).cast("long").alias("user_id"), F.timestamp_seconds(F.unix_seconds(F.lit(span.end)) + 2 * late + 3 * 3600).alias("ts")))
    ahead.coalesce(1).write.mode("append").parquet(folder)
    return blocks.drained(blocks.capped_runs(blocks.read_blocks(spark, folder), "user_id", "ts", 3600, 3, f"{late} seconds"), "append", "runs")


QUERIES = {f.__name__: f for f in (stream_accumulators, stream_epochs, stream_sliding, stream_sessions, stream_capped_runs)}

ORACLES = {
    "stream_accumulators": signal_queries.ORACLES["aligned_curve_xval"],
    "stream_epochs": event_queries.ORACLES["tumbling_epochs"],
    "stream_sliding": event_queries.ORACLES["sliding_epochs"],
    "stream_capped_runs": event_queries.ORACLES["gaps_islands_capped"],
    "stream_sessions": event_queries.ORACLES["session_runs"],
}
