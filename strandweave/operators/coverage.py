"""Continuous coverage and gaps of the intervals of each entity.

Two levels. The first works per entity and shard, a shard being 2^16 positions: each interval is clipped to the shard
of its start, and the clipped intervals are merged there. What is clipped off lies in later shards, from the next one's
first position on, so that an end is all that remains of it: the furthest end of a shard's intervals is its reach. The
second level stitches: the running maximum of the reaches of an entity's earlier shards tells each shard how far it is
covered from outside, which absorbs the blocks up to there; only blocks that touch a shard's end with more clipped off
are coalesced across shards. An entity of any size is thus spread over its shards, and no interval is copied to the
shards that it spans. As the first step keeps one row per entity and start, combined on the map side, a shard never
holds more than 2^16 rows, however many rows an entity has.

Positions are closed intervals. Intervals are of one block if they share a position, directly or through others;
intervals that merely touch stay apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A shard is 2 to the power of this many positions.
SHARD_BITS = 16


def _local_blocks(intervals: DataFrame, bits: int) -> DataFrame:
    """(entity, shard, block_start, block_end, beyond): the blocks of each shard's clipped intervals, merged within it.

    ``block_end`` is clipped to the shard; ``beyond`` is the furthest end of the block's intervals as they were.
    """
    sharded = intervals.withColumn("shard", F.shiftright("start", bits))
    clipped = sharded.withColumn("clip", F.least("end", F.shiftleft(F.col("shard") + 1, bits) - 1))
    longest = clipped.groupBy("entity", "shard", "start").agg(F.max("clip").alias("clip"), F.max("end").alias("end"))
    in_shard = Window.partitionBy("entity", "shard").orderBy("start")
    before = in_shard.rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("clip").over(before)
    marked = longest.withColumn("opens", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0))
    island = marked.withColumn("island", F.sum("opens").over(in_shard.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        island.groupBy("entity", "shard", "island")
        .agg(F.min("start").alias("block_start"), F.max("clip").alias("block_end"), F.max("end").alias("beyond"))
        .drop("island")
    )


def _stitched(local: DataFrame) -> DataFrame:
    """The local blocks with ``outside``, the furthest position that the entity's earlier shards cover."""
    summary = local.groupBy("entity", "shard").agg(F.max("beyond").alias("shard_reach"))
    earlier = Window.partitionBy("entity").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    reached = summary.select("entity", "shard", F.max("shard_reach").over(earlier).alias("outside"))
    return local.join(reached, ["entity", "shard"])


def merge_intervals(rows: DataFrame, entity: str, start: str, end: str, shard_bits: int = SHARD_BITS) -> DataFrame:
    """(entity, kind, start_pos, end_pos): the blocks of each entity and the gaps between neighbouring blocks.

    ``start`` and ``end`` are longs, both positions included; further columns are not read. Rows with a null entity or
    position, or with start after end, are no intervals and are left out. Repeated rows change nothing. A gap is given
    where at least one position lies between two blocks. An empty table gives no rows.
    """
    e, s, t = F.col(entity), F.col(start).cast("bigint"), F.col(end).cast("bigint")
    intervals = rows.where(e.isNotNull() & (s <= t)).select(e.alias("entity"), s.alias("start"), t.alias("end"))
    blocks = _stitched(_local_blocks(intervals, shard_bits))
    in_shard = Window.partitionBy("entity", "shard").orderBy("block_start")
    blocks = (
        blocks.withColumn("covered", F.greatest(F.col("outside"), F.lag("beyond").over(in_shard)))
        .withColumn("absorbed", F.coalesce(F.col("block_start") <= F.col("outside"), F.lit(False)))
        .withColumn("crosses", F.col("beyond") > F.col("block_end"))
    )
    # What a block gives, in one pass: a finished block or the head of a chain, the gap before it, or, absorbed, what it
    # adds to a chain's end.
    free, start, end = ~F.col("absorbed"), F.col("block_start"), F.col("beyond")
    given = lambda when, kind, s, e: F.when(when, F.struct(F.lit(kind).alias("kind"), s.alias("start_pos"), e.alias("end_pos")))
    parts = F.array(
        given(free & ~F.col("crosses"), "block", start, end),
        given(free & F.col("crosses"), "head", start, end),
        given(free & (start - F.col("covered") > 1), "gap", F.col("covered") + 1, start - 1),
        given(F.col("absorbed") & (end > F.col("outside")), "more", start, end),
    )
    pieces = blocks.select("entity", F.explode(F.filter(parts, lambda p: p.isNotNull())).alias("p")).select("entity", "p.*")
    # A chain is a crossing block and what later shards add to its end; few blocks cross, none is gathered per entity.
    links = pieces.where(F.col("kind").isin("head", "more"))
    so_far = Window.partitionBy("entity").orderBy("start_pos").rowsBetween(Window.unboundedPreceding, 0)
    head = F.when(F.col("kind") == "head", F.col("start_pos"))
    chains = links.withColumn("chain", F.last(head, ignorenulls=True).over(so_far)).groupBy("entity", "chain").agg(F.max("end_pos").alias("end_pos"))
    chains = chains.select("entity", F.lit("block").alias("kind"), F.col("chain").alias("start_pos"), "end_pos")
    return pieces.where(F.col("kind").isin("block", "gap")).unionByName(chains).withColumnRenamed("entity", entity)
