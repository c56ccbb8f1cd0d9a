"""Cohort loaders: folders of recordings become signals ready for the analyses, and marks.

Continuous recordings are read by ranges and stay in blocks, so their length has no
bound; clips are short and stay whole.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phasegrid.functions import dsp
from phasegrid.operators import blocks, kernels, rollup
from phasegrid.sources import names, ranges, recordings

SUBJECT = r"(sub-[^/_]+)"
#: Folder and name of a subject's tables beside its recording.
TABLES = "*/ieeg/*{}.tsv"


def _contact(channel: Column) -> tuple[Column, Column]:
    """Shaft and number of a contact; an empty shaft for a name that isn't one."""
    return F.regexp_extract(channel, r"^([A-Za-z]+)\d+$", 1), F.regexp_extract(channel, r"^[A-Za-z]+(\d+)$", 1).cast("int")


def bipolar_parts(parts: DataFrame, keys: Sequence[str], regions: Sequence[tuple[str, Sequence[str], Sequence[str]]], zone: DataFrame | None = None) -> DataFrame:
    """``*keys, channel, region, sfreq, start_s, samples``: differences of neighbouring contacts of a shaft, part by part.

    ``zone`` (*keys, contact) names contacts of the onset zone; a pair with one goes,
    and so does a pair whose first contact has no region.
    """
    shaft, number = _contact(F.col("channel"))
    own = parts.withColumn("__shaft", shaft).withColumn("__num", number).where("`__shaft` <> ''")
    if zone is not None:
        own = own.join(zone.select(*keys, F.col("contact").alias("channel")).distinct(), [*keys, "channel"], "left_anti")
    next_one = own.select(*keys, "start_s", "__shaft", (F.col("__num") - 1).alias("__num"), F.col("channel").alias("__next"), F.col("samples").alias("__other"))
    both = own.join(next_one, [*keys, "start_s", "__shaft", "__num"])
    region = rollup.first_match(regions, F.col("channel"))
    difference = F.zip_with("samples", "__other", lambda x, y: x - y)
    return both.select(*keys, F.concat("channel", F.lit("-"), "__next").alias("channel"), region.alias("region"), "sfreq", "start_s", difference.alias("samples")).where("region is not null")


def notched(own: DataFrame, keys: Sequence[str], line: float, sfreq: float, top: float | None = None) -> DataFrame:
    """Blocks without their least-squares line, ``line`` and its multiples below ``top`` or half the rate."""
    for k, f in enumerate(np.arange(line, min(sfreq / 2, top or sfreq), line)):
        own = blocks.filtered_blocks(own, keys, dsp.notch(float(f), sfreq), detrend=k == 0)
    return own


def bids_recordings(spark: SparkSession, folder: str, cohort: str, sfreq: float, line: float, regions: Sequence[tuple[str, Sequence[str], Sequence[str]]], part_s: float = ranges.PART_S) -> tuple[DataFrame, DataFrame]:
    """(signals, marks) of a folder of subjects with an EDF recording, a channel table and an event table each.

    Signals are blocks ``cohort, subject, channel, region, block, start, samples`` of
    bipolar pairs outside the onset zone, without line noise; marks are ``subject,
    at``, the sample numbers of events. Recordings at another rate are left out; a
    subject without tables has no zone and no marks.
    """
    spark.dataSource.register(ranges.EdfRanges)
    parts = spark.read.format("edf_ranges").option("part_s", part_s).load(folder).where(F.col("sfreq") == sfreq).withColumn("subject", F.regexp_extract("path", SUBJECT, 1))
    channels = _table(spark, folder, "channels", "name string, soz_region int")
    zone = channels.where("soz_region <> 0").select("subject", F.col("name").alias("contact"))
    pairs = bipolar_parts(parts, ["subject"], regions, zone)
    numbered = pairs.select("subject", "channel", "region", F.floor(F.col("start_s") / part_s).alias("block"), "samples")
    signals = notched(numbered, ["subject", "channel", "region"], line, sfreq).select(F.lit(cohort).alias("cohort"), "subject", "channel", "region", "block", "start", "samples")
    events = _table(spark, folder, "events", "onset double, sample long")
    return signals, events.select("subject", recordings.sample_of(rate=sfreq).alias("at")).where("at is not null")


def _table(spark: SparkSession, folder: str, kind: str, schema: str) -> DataFrame:
    found = recordings.read_tsv(spark, f"{folder.rstrip('/')}/{TABLES.format(kind)}", schema)
    return found.withColumn("subject", F.regexp_extract("path", SUBJECT, 1)).drop("path")


def clip_signals(spark: SparkSession, folder: str, cohort: str, metadata: DataFrame, state: str, sfreq: float, line: float) -> DataFrame:
    """``cohort, subject, segment, channel, region, sfreq, samples``: clips of a state, of unflagged channels with a region, without their line and the mains.

    Clips that can't be decoded, are at another rate, constant or not finite are left out.
    """
    flags = ["ch1_soz", "ch2_soz", "ch1_resected", "ch2_resected"]
    region = rollup.first_match(rollup.ROI_RULES, F.col("final_label"), F.col("reg"))
    wanted = rollup.normative(metadata, flags).withColumn("region", region).where("region is not null").select(F.col("pt").alias("subject"), F.col("name").alias("channel"), "region")
    clips = names.clip_index(recordings.read_edf(spark, folder).where("error is null"), "path").where((F.col("state") == state) & (F.col("sfreq") == sfreq))
    own = clips.select(F.col("pt").alias("subject"), F.col("idx").alias("segment"), "channel", "samples").join(F.broadcast(wanted) if _small(wanted) else wanted, ["subject", "channel"])

    def kernel(rows, x):
        for k, y in enumerate(dsp.filtfilt(dsp.notch(line, sfreq), dsp.detrend(x))):
            yield k, y.tolist()

    done = kernels.map_signals(own, ["subject", "segment", "channel", "region"], "samples", "samples array<double>", kernel)
    return done.select(F.lit(cohort).alias("cohort"), "subject", "segment", "channel", "region", F.lit(float(sfreq)).alias("sfreq"), "samples")


#: Rows of channel metadata that are broadcast.
MOST_BROADCAST = 1_000_000


def _small(df: DataFrame) -> bool:
    return df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST


def channel_state_clips(spark: SparkSession, folder: str, subject: str, channel: str, state: str, most: int = 8) -> DataFrame:
    """``segment, sfreq, samples``: the first ``most`` clips of one channel in one state, each without its least-squares line."""
    clips = names.clip_index(recordings.read_edf(spark, folder).where("error is null"), "path")
    own = clips.where((F.col("pt") == subject) & (F.col("state") == state))
    # a clip counts whether or not it has the channel
    first = own.select("idx").distinct().orderBy("idx").limit(most)
    held = own.where(F.col("channel") == channel).join(F.broadcast(first), "idx").select(F.col("idx").alias("segment"), "sfreq", "samples")

    def kernel(rows, x):
        for k, y in enumerate(dsp.detrend(x)):
            yield k, y.tolist()

    return kernels.map_signals(held, ["segment", "sfreq"], "samples", "samples array<double>", kernel)


def brainvision_pairs(spark: SparkSession, folder: str, cohort: str, regions: Sequence[tuple[str, Sequence[str], Sequence[str]]], sfreq: float, line: float, factor: int = 2) -> DataFrame:
    """``cohort, subject, channel, region, sfreq, samples``: bipolar pairs of BrainVision recordings, without line noise, at 1 / ``factor`` of their rate."""
    raw = recordings.read_brainvision(spark, folder).where("error is null").where(F.col("sfreq") == sfreq).withColumn("subject", F.regexp_extract("path", SUBJECT, 1))
    pairs = bipolar_parts(raw.withColumn("start_s", F.lit(0.0)), ["subject"], regions)
    comb = [float(f) for f in np.arange(line, sfreq / 2, line)]

    def kernel(rows, x):
        x = dsp.detrend(x)
        for f in comb:
            x = dsp.filtfilt(dsp.notch(f, sfreq), x)
        for k, y in enumerate(dsp.decimate(x, factor)):
            yield k, y.tolist()

    done = kernels.map_signals(pairs, ["subject", "channel", "region"], "samples", "samples array<double>", kernel)
    return done.select(F.lit(cohort).alias("cohort"), "subject", "channel", "region", F.lit(sfreq / factor).alias("sfreq"), "samples")
