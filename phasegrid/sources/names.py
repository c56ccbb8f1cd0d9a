"""Parsing of clip file names and channel names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Pattern of clip names, states in order, pattern of channel names.
CLIP = r"(sub-RID\d+)_(W|N2|N3|R)_(\d+)\.edf"
STATES = ["W", "N2", "N3", "R"]
CHANNEL = r"^([A-Za-z]+)(\d+)$"


def clip_index(listing: DataFrame, path: str = "path") -> DataFrame:
    """The listing with ``pt, state, idx, filename``; names of another form are dropped."""
    name = F.substring_index(F.col(path), "/", -1)
    got = listing.withColumn("filename", name)
    for k, c in enumerate(("pt", "state", "idx"), 1):
        got = got.withColumn(c, F.regexp_extract("filename", f"^{CLIP}$", k))
    return got.where("pt <> ''").withColumn("idx", F.col("idx").cast("int"))


def channel_parts(name: Column) -> list[Column]:
    """Shaft, contact number, code without the side, and the label of the pair with the next contact; null for another form."""
    fits = name.rlike(CHANNEL)
    shaft = F.when(fits, F.regexp_extract(name, CHANNEL, 1))
    contact = F.when(fits, F.regexp_extract(name, CHANNEL, 2)).cast("int")
    pair = F.concat(shaft, contact.cast("string"), F.lit("-"), (contact + 1).cast("string"))
    return [shaft.alias("shaft"), contact.alias("contact"), F.regexp_replace(shaft, "^[LR]", "").alias("code"), pair.alias("pair")]


def usable_contacts(channels: DataFrame, name: str, region: str, most: int) -> DataFrame:
    """``channels`` with ``contact``, those of the region with a contact number up to ``most``; a name without one counts as 999."""
    number = F.coalesce(F.regexp_extract(name, r"^[A-Za-z]+([0-9]+)$", 1).try_cast("int"), F.lit(999))
    return channels.withColumn("contact", number).where(F.col(name).rlike(region) & (F.col("contact") <= most))


def preferred_channel(channels: DataFrame, usable: DataFrame, keys: Sequence[str], name: str, preferred: Sequence[str], order: str) -> DataFrame:
    """``*keys, channel``: of each recording the first of ``preferred`` among all its channels, without one its first usable channel by ``order``."""
    place = F.array_position(F.array(*map(F.lit, preferred)), F.col(name))
    listed = channels.where(F.col(name).isin(*preferred)).select(*keys, F.struct(place.alias("place"), F.lit(0).cast("long").alias("nth"), F.col(name).alias("name")).alias("c"))
    others = usable.select(*keys, F.struct(F.lit(len(preferred) + 1).cast("long").alias("place"), F.col(order).cast("long").alias("nth"), F.col(name).alias("name")).alias("c"))
    return listed.unionByName(others).groupBy(*keys).agg(F.min("c").alias("c")).select(*keys, F.col("c.name").alias("channel"))
