"""References to keys that another table doesn't hold, at the time of the reference or ever.

Keys are split into a prefix, the width of their trailing digits and the integer these make. The sorted integers of
the parent keys are compressed into contiguous runs. Each reference is matched as-of to the run that starts at or
before it; beyond that run's end the parent never had the key. Whether a key that is held was there at the time of the
reference is a second as-of match, to the parent's changes (added, removed) of the same key, made in the same pass.

Runs are cut at multiples of 2^12, which makes the match local to a block of keys, so that nothing is sorted globally.
A block that draws more than its share of the references (one key may draw a third of them) is split over salts, to
each of which the block's runs and changes, bounded by its keys' histories, are copied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from strandweave.functions.keys import key_form
from strandweave.session import partitions

#: A block is 2 to the power of this many integers.
BLOCK_BITS = 12
#: A block is hot from this fraction of a shuffle partition's fair share on; it bounds the hot blocks, too.
HOT_SHARE = 4
_PARTS = ("prefix", "width", "block")
#: The first moment of time, which only the starts of runs have, and the one after it.
_START, _DAWN = -(2**63), -(2**63) + 1


def split_key(key: Column) -> list[Column]:
    """The columns prefix, width, number, block of a key; keys without trailing digits have width 0, number 0."""
    digits = F.regexp_extract(key, r"([0-9]{1,18})\z", 1)
    number = F.coalesce(F.when(digits != "", digits).cast("bigint"), F.lit(0).cast("bigint"))
    prefix = F.substring(key, F.lit(1), F.char_length(key) - F.char_length(digits))
    return [
        prefix.alias("prefix"),
        F.char_length(digits).alias("width"),
        number.alias("number"),
        F.shiftright(number, BLOCK_BITS).alias("block"),
    ]


def key_runs(keys: DataFrame) -> DataFrame:
    """Runs of contiguous integers (prefix, width, block, run_start, run_end) from distinct split keys."""
    ordered = Window.partitionBy(*_PARTS).orderBy("number")
    numbered = keys.withColumn("island", F.col("number") - F.row_number().over(ordered))
    return numbered.groupBy(*_PARTS, "island").agg(F.min("number").alias("run_start"), F.max("number").alias("run_end")).drop("island")


def key_changes(parents: DataFrame) -> DataFrame:
    """When each split key appeared and went: (prefix, width, block, number, us, there).

    Lifetimes of a key that overlap or touch are one. A row removed at or before it was added, or with a null
    ``added``, never lived, but makes the key known from then (a null: from the beginning of time) on.
    """
    key = [*_PARTS, "number"]
    # The distinct moments, with how many lifetimes begin or end there; combined before the shuffle, as rows repeat.
    lives = F.col("removed").isNull() | (F.col("removed") > F.col("added"))
    begun = parents.select(
        *key,
        F.coalesce("added", F.lit(_DAWN)).alias("us"),
        F.when(F.col("added").isNotNull() & lives, F.lit(1)).otherwise(F.lit(0)).alias("step"),
    )
    ended = parents.where(F.col("removed") > F.col("added")).select(*key, F.col("removed").alias("us"), F.lit(-1).alias("step"))
    moments = begun.unionByName(ended).groupBy(*key, "us").agg(F.sum("step").alias("step"))
    in_time = Window.partitionBy(*key).orderBy("us")
    alive = moments.withColumn("alive", F.sum("step").over(in_time.rowsBetween(Window.unboundedPreceding, 0)) > 0)
    changed = alive.withColumn("was", F.lag("alive").over(in_time))
    return changed.where(F.col("was").isNull() | (F.col("was") != F.col("alive"))).select(*key, "us", F.col("alive").alias("there"))


def salts_of(counts: list[tuple[tuple, int]], whole: int, slots: int) -> dict[tuple, int]:
    """The salts of the blocks that have more than 1/``slots`` of ``whole`` references: one for each such share begun."""
    return {block: -(-n * slots // whole) for block, n in counts if n * slots > whole}


def _hot_blocks(refs: DataFrame) -> dict[tuple[str, str, int, int], int]:
    """The salts of each block with more than 1/(HOT_SHARE * partitions) of the references; fewer blocks than that can be.

    One aggregate tells both the largest blocks, of which as many come to the driver as can be hot, and the whole.
    """
    slots = HOT_SHARE * partitions(refs.sparkSession)
    seen = Observation()
    counts = refs.groupBy("ref_table", *_PARTS).agg(F.count(F.lit(1)).alias("n")).observe(seen, F.sum("n").alias("whole"))
    top = counts.orderBy(F.desc("n")).limit(slots).collect()
    whole = seen.get["whole"] or 0
    return salts_of([((r.ref_table, r.prefix, r.width, r.block), r.n) for r in top], whole, slots)


def orphan_references(refs: DataFrame, parents: dict[str, DataFrame], row_id: str, at: str) -> DataFrame:
    """(row_id, ref_table, ref_key, at, fault) of the references that don't hold when made.

    ``refs`` has ``row_id``, the timestamp ``at`` and, per referred table, a column of that table's name with the
    reference; ``parents`` has a table (key, added_at, removed_at) by the same name. Keys are compared in key form;
    a reference without one refers to nothing. The fault is ``missing`` if the table never has the key, ``late`` if
    all its rows of the key were added after ``at``, else ``deleted``. A parent row with a null ``added_at`` makes the
    key known, but not there. A reference with a null time finds nothing there: ``missing``, or else ``deleted``.
    Repeated rows are reported each by their own ``row_id``.
    """
    names = list(parents)
    long = refs.select(
        F.col(row_id).alias("row_id"),
        F.unix_micros(F.col(at)).alias("us"),
        F.explode(F.array(*[F.struct(F.lit(n).alias("ref_table"), key_form(n).alias("key")) for n in names])).alias("ref"),
    ).where("ref.key is not null")
    references = long.select("row_id", "us", F.col("ref.ref_table").alias("ref_table"), F.col("ref.key").alias("key"), *split_key(F.col("ref.key")))
    known = None
    for name in names:
        key, added, removed = parents[name].columns[:3]
        p = parents[name].select(
            F.lit(name).alias("ref_table"), key_form(F.col(key)).alias("key"), F.unix_micros(F.col(added)).alias("added"), F.unix_micros(F.col(removed)).alias("removed")
        )
        known = p if known is None else known.unionByName(p)
    known = known.where("key is not null").select("ref_table", "added", "removed", *split_key(F.col("key")))
    # The table's name becomes part of the prefix for the steps that treat all tables alike.
    known = known.withColumn("prefix", F.concat_ws("\u0001", "ref_table", "prefix")).drop("ref_table")
    runs, changes = key_runs(known.select(*_PARTS, "number").distinct()), key_changes(known)

    hot = _hot_blocks(references)
    low = F.lit(_START).cast("bigint")
    nothing = F.lit(None)
    right = runs.select(
        *_PARTS, F.col("run_start").alias("number"), low.alias("us"), F.lit(0).alias("rank"), "run_end", nothing.cast("boolean").alias("there")
    ).unionByName(
        changes.select(*_PARTS, "number", "us", F.lit(1).alias("rank"), nothing.cast("bigint").alias("run_end"), "there")
    )
    left = references.withColumn("prefix", F.concat_ws("\u0001", "ref_table", "prefix"))
    if hot:
        # At most HOT_SHARE * partitions literals.
        salts = F.create_map(*[x for (t, p, w, b), n in hot.items() for x in (F.lit(f"{t}\u0001{p}\u0001{w}\u0001{b}"), F.lit(n))])
        count = F.coalesce(F.element_at(salts, F.concat_ws("\u0001", "prefix", "width", "block")), F.lit(1))
        left = left.withColumn("salt", F.pmod(F.xxhash64("row_id"), count).cast("int"))
        right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), count - 1)))
    else:
        left, right = left.withColumn("salt", F.lit(0)), right.withColumn("salt", F.lit(0))
    nulls = {"run_end": "bigint", "there": "boolean"}
    left = left.withColumn("rank", F.lit(2)).select(*_PARTS, "number", F.coalesce("us", low).alias("us"), "rank", *[nothing.cast(t).alias(c) for c, t in nulls.items()], "salt", "row_id", "ref_table", "key")
    right = right.select(*_PARTS, "number", "us", "rank", *nulls, "salt", nothing.cast(dict(left.dtypes)["row_id"]).alias("row_id"), nothing.cast("string").alias("ref_table"), nothing.cast("string").alias("key"))
    # As-of: the last run start and the last change at or before the reference, in the order of integer and time.
    # Changes sort after a run that starts at their number, references after the changes of their own moment.
    as_of = Window.partitionBy(*_PARTS, "salt").orderBy("number", "us", "rank").rowsBetween(Window.unboundedPreceding, 0)
    matched = (
        left.unionByName(right)
        .withColumn("run", F.last("run_end", ignorenulls=True).over(as_of))
        .withColumn("change", F.last(F.when(F.col("there").isNotNull(), F.struct("number", "there")), ignorenulls=True).over(as_of))
        .where(F.col("rank") == 2)
    )
    held = F.coalesce(F.col("run") >= F.col("number"), F.lit(False))
    begun = F.coalesce(F.col("change.number") == F.col("number"), F.lit(False))
    fault = (
        F.when(~held, F.lit("missing"))
        .when(begun & F.col("change.there"), F.lit(None))
        .when(begun | (F.col("us") == low), F.lit("deleted"))
        .otherwise(F.lit("late"))
    )
    return matched.select(
        F.col("row_id").alias(row_id), "ref_table", F.col("key").alias("ref_key"), F.timestamp_micros(F.when(F.col("us") != low, F.col("us"))).alias(at), fault.alias("fault")
    ).where(F.col("fault").isNotNull())


def orphans_by_period(orphans: DataFrame, at: str) -> DataFrame:
    """(ref_table, period, fault, n_references) per referred table and month (YYYY-MM, UTC)."""
    return orphans.groupBy("ref_table", F.date_format(at, "yyyy-MM").alias("period"), "fault").agg(F.count(F.lit(1)).alias("n_references"))
