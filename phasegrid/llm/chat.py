"""Chat formatting after collapsing cumulative snapshots. DataFrame functions only.

Logs often hold a conversation once for every turn it grew by. A conversation is
dropped when its turns are the first turns of a longer one; of conversations with
the same turns the smallest id stays. Prefixes are compared by rolling hashes:
running sums of a hash of (position, role, text), which one window gives for all
prefixes at once. A turn's place is hashed in, so the sum knows the order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Hex digits of each of the two running sums' terms: 2^20 turns of 40 bits stay below 2^63.
TERM = 10


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """``conv_id, place, length, role, text, s1, s2``: a row for each turn, with the hash (place, s1, s2) of the turns up to it.

    Turns are ordered by ``turn`` (null first), then role, then text; null role
    and text count as empty. Rows without a ``conv_id`` belong to no conversation.
    """
    own = turns.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")])
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = own.withColumn("place", F.row_number().over(order))
    # lengths keep role and text apart whatever they hold
    digest = F.sha2(F.concat_ws("|", F.col("place").cast("string"), F.length("role").cast("string"), F.col("role"), F.col("text")), 256)
    hashed = placed.withColumn("digest", digest)
    term = lambda k: F.conv(F.substring("digest", 1 + k * TERM, TERM), 16, 10).cast("long")
    so_far = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return hashed.select(
        "conv_id", "place", F.count("*").over(Window.partitionBy("conv_id")).alias("length"), "role", "text",
        F.sum(term(0)).over(so_far).alias("s1"), F.sum(term(1)).over(so_far).alias("s2"),
    )


def maximal_conversations(hashed: DataFrame) -> DataFrame:
    """``conv_id, copies``: the conversations that no longer one begins with; copies counts those with the same turns."""
    whole = hashed.where("place = length").select("conv_id", "place", "s1", "s2")
    # combined before the shuffle: a first turn that a third of all conversations share is one row for each task
    distinct = whole.groupBy("place", "s1", "s2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    begun = hashed.where("place < length").select("place", "s1", "s2").distinct()
    return distinct.join(begun, ["place", "s1", "s2"], "left_anti").select("conv_id", "copies")


def render_conversations(turns: DataFrame) -> DataFrame:
    """Maximal conversations in chat markup.

    Returns ``conv_id, n_turns, copies, rendered``; a turn is
    ``<|im_start|>role\\ntext<|im_end|>\\n``. Long and empty texts are kept whole;
    an empty table gives an empty result. A conversation comes out as one value, so
    its turns, and only they, meet in one task. Columns other than ``conv_id, turn,
    role, text`` are ignored.
    """
    hashed = prefix_hashes(turns)
    kept = hashed.join(maximal_conversations(hashed), "conv_id")
    turn = F.concat(F.lit("<|im_start|>"), F.col("role"), F.lit("\n"), F.col("text"), F.lit("<|im_end|>\n"))
    parts = F.sort_array(F.collect_list(F.struct("place", turn.alias("part"))))
    return kept.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"), F.first("copies").alias("copies"), F.array_join(F.transform(parts, lambda p: p["part"]), "").alias("rendered"),
    )
