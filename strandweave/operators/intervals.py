"""Segment algebra: half-open, 0-based intervals as columns and as collections of rows per key.

A collection is the rows (key, start, end) of one key. Segments of a collection that overlap are merged; segments that
merely touch stay apart; empty segments vanish.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid(start: Column, end: Column) -> Column:
    """The segment as a struct; an error if it ends before it starts or starts below zero."""
    fine = (start >= 0) & (end >= start)
    return F.when(fine, F.struct(start.cast("bigint").alias("start"), end.cast("bigint").alias("end"))).otherwise(
        F.raise_error(F.lit("a segment must not end before it starts or start below zero"))
    )


def width(start: Column, end: Column) -> Column:
    return end - start


def is_in(position: Column, start: Column, end: Column) -> Column:
    return (start <= position) & (position < end)


def is_exclusive(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Whether two segments share nothing; touching ones don't."""
    return (e1 <= s2) | (s1 >= e2)


def is_overlapping(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return ~is_exclusive(s1, e1, s2, e2)


def is_subset(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Whether the first segment lies in the second."""
    return (s1 >= s2) & (e1 <= e2)


def is_superset(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return is_subset(s2, e2, s1, e1)


def flank(start: Column, end: Column, length: int | Column, left: Column | None = None, right: Column | None = None) -> tuple[Column, Column]:
    """Start and end moved outwards by ``length``, within ``left`` and ``right``; a right bound of 0 is none."""
    length = F.lit(length) if isinstance(length, int) else length
    low, far = F.coalesce(left, F.lit(0)) if left is not None else F.lit(0), end + length
    return F.greatest(low, start - length), far if right is None else F.least(far, F.when(right != 0, right).otherwise(far))


def collapse(rows: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Each key's segments, sorted out: empty ones dropped, overlapping ones merged."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = rows.where(F.col(end) > F.col(start)).withColumn("_reach", reach)
    opens = F.when(F.col("_reach").isNull() | (F.col(start) >= F.col("_reach")), 1).otherwise(0)
    numbered = opened.withColumn("_island", F.sum(opens).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).select(*keys, start, end)


def invert(rows: DataFrame, bounds: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """What of each key's bounds its collapsed segments leave free; all of it for a key without segments.

    ``bounds`` has one row (keys, start, end) per key. An error if a segment lies outside them. Touching segments leave
    no gap. The gap before each segment and the one after the last come from one ordered pass.
    """
    spans = bounds.select(*keys, F.col(start).alias("_from"), F.col(end).alias("_to"))
    joined = spans.join(collapse(rows, keys, start, end), keys, "left")
    order = Window.partitionBy(*keys).orderBy(start)
    inside = F.col(start).isNull() | is_subset(F.col(start), F.col(end), F.col("_from"), F.col("_to"))
    before = F.coalesce(F.lag(end).over(order), F.col("_from"))
    placed = joined.withColumn("_before", before).withColumn("_last", F.lead(start).over(order).isNull())
    gap = F.struct(F.col("_before").alias("s"), F.coalesce(F.col(start), F.col("_to")).alias("e"))
    tail = F.struct(F.when(F.col("_last") & F.col(end).isNotNull(), F.col(end)).alias("s"), F.col("_to").alias("e"))
    gaps = F.when(inside, F.array(gap, tail)).otherwise(F.raise_error(F.lit("segments must lie within their bounds")))
    out = placed.select(*keys, F.explode(gaps).alias("g"))
    return out.where("g.e > g.s").select(*keys, F.col("g.s").alias(start), F.col("g.e").alias(end))


def collection_span(rows: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Start, end and number of segments of each key's collection; zeros for keys whose segments are all empty."""
    there = F.col(end) > F.col(start)
    totals = rows.groupBy(*keys).agg(F.min(F.when(there, F.col(start))).alias("s"), F.max(F.when(there, F.col(end))).alias("e"))
    counts = collapse(rows, keys, start, end).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("bigint")
    return totals.join(counts, keys, "left").select(*keys, *[F.coalesce(c, zero).alias(a) for c, a in (("s", "span_start"), ("e", "span_end"), ("n", "n_segments"))])


def flank_collections(rows: DataFrame, keys: list[str], length: int, left: Column | None = None, right: Column | None = None, start: str = "start", end: str = "end") -> DataFrame:
    """Each key's segments, flanked one by one and collapsed again."""
    s, e = flank(F.col(start), F.col(end), length, left, right)
    there = rows.where(F.col(end) > F.col(start))
    return collapse(there.withColumns({start: s, end: e}), keys, start, end)


def from_positions(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Runs of consecutive positions as segments; repeated positions count once."""
    order = Window.partitionBy(*keys).orderBy(position)
    distinct = rows.select(*keys, position).distinct()
    runs = distinct.withColumn("_run", F.col(position) - F.row_number().over(order))
    return runs.groupBy(*keys, "_run").agg(F.min(position).alias("start"), (F.max(position) + 1).alias("end")).drop("_run")


def from_collections(collections: list[DataFrame], keys: list[str]) -> DataFrame:
    """The union of collections, collapsed."""
    return collapse(reduce(DataFrame.unionByName, [c.select(*keys, "start", "end") for c in collections]), keys)


def _binned(rows: DataFrame, start: str, end: str, bits: int) -> DataFrame:
    """The rows once per bin of 2^bits positions that they touch."""
    bins = F.sequence(F.shiftright(F.col(start), bits), F.shiftright(F.col(end) - 1, bits))
    return rows.withColumn("_bin", F.explode(bins))


def overlapping_rows(left: DataFrame, right: DataFrame, keys: list[str], bits: int = 14, start: str = "start", end: str = "end") -> DataFrame:
    """The left rows that overlap a right row of the same key: an equi-join on key and bin, then the exact test.

    A row is met in each bin it touches but given once, as the join only asks whether there is a partner.
    """
    marked = left.where(F.col(end) > F.col(start)).withColumn("_row", F.monotonically_increasing_id())
    other = collapse(right, keys, start, end).select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e"))
    a, b = _binned(marked, start, end, bits), _binned(other, "_s", "_e", bits)
    met = a.join(b, [*keys, "_bin"]).where(is_overlapping(F.col(start), F.col(end), F.col("_s"), F.col("_e")))
    return met.dropDuplicates(["_row"]).select(*left.columns)


def overlapping_collections(left: DataFrame, right: DataFrame, keys: list[str], bits: int = 14) -> DataFrame:
    """The keys whose collections overlap; empty collections overlap nothing."""
    return overlapping_rows(collapse(left, keys), right, keys, bits).select(*keys).distinct()


def subset_collections(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The keys whose left segments each lie within one right segment; empty collections are subsets of nothing.

    The right segment that starts last at or before a left one is the only one that can hold it, which a single ordered
    pass over both finds; no pairs are built.
    """
    mine, other = collapse(left, keys), collapse(right, keys)
    nothing = F.lit(None).cast("bigint")
    both = mine.select(*keys, "start", "end", nothing.alias("reach"), F.lit(1).alias("rank")).unionByName(
        other.select(*keys, "start", "end", F.col("end").alias("reach"), F.lit(0).alias("rank"))
    )
    order = Window.partitionBy(*keys).orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, 0)
    held = both.withColumn("reach", F.last("reach", ignorenulls=True).over(order)).where("rank = 1")
    inside = F.coalesce(F.col("end") <= F.col("reach"), F.lit(False))
    return held.groupBy(*keys).agg(F.bool_and(inside).alias("all_in")).where("all_in").select(*keys)


def span_exclusive(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, exclusive): whether the spans of two collections share nothing."""
    a = collection_span(left, keys).select(*keys, F.col("span_start").alias("s1"), F.col("span_end").alias("e1"))
    b = collection_span(right, keys).select(*keys, F.col("span_start").alias("s2"), F.col("span_end").alias("e2"))
    return a.join(b, keys).select(*keys, is_exclusive(F.col("s1"), F.col("e1"), F.col("s2"), F.col("e2")).alias("exclusive"))
