"""Entity-attribute-value rows into one typed row per entity.

The rows are reduced to one typed row per entity and attribute and written once as narrow tables (a directory per
attribute, all bucketed by entity). A leaf of the join tree is a multiway outer join of a few narrow tables: as they are
bucketed alike, one grouped pass over the buckets merges them. The leaves are combined through a balanced tree of outer
joins from the entities' spine. Nothing moves in either: the two shuffles of the plan are the reduction, which combines
on the map side, and the placement by entity, which then holds a row per entity and attribute at most, so that an entity
or attribute with a third of all rows costs no task more than its share.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.functions import keys
from strandweave.session import delete_at_end, partitions_for, scratch_path

#: The narrow tables that a leaf of the join tree merges, and the leaves that are joined to one reading of the spine.
FAN_IN = 8
#: The files that the narrow tables are laid out for; beyond, several attributes share a directory.
MAX_FILES = 100_000
#: The bytes of input to a bucket, as the optimiser estimates them; there are as many buckets as shuffle partitions at most.
BUCKET_BYTES = 16 << 20
#: The definitions up to which they are broadcast to the rows; beyond, Spark joins them by shuffle.
SMALL_DEFS = 100_000
SPINE = "spine"


@dataclass(frozen=True)
class Attribute:
    """A defined attribute: its key, its type, whether it may hold several values, its mark for a missing value."""

    key: str
    value_type: str
    is_multi: bool
    missing_marker: str | None


def read_definitions(defs: DataFrame) -> list[Attribute]:
    """The definitions, by key; of keys with the same plain name the first in order holds. Null keys are ignored.

    They become the wide table's schema, which the driver holds in any case.
    """
    rows = (
        defs.where(F.col("attr_key").isNotNull())
        .select("attr_key", "value_type", "is_multi", "missing_marker")
        .distinct()
        .orderBy("attr_key", "value_type", "is_multi", "missing_marker")
        .collect()
    )
    taken: dict[str, Attribute] = {}
    for row in rows:
        if name := _plain(row.attr_key):
            taken.setdefault(name, Attribute(row.attr_key, row.value_type or "string", bool(row.is_multi), row.missing_marker))
    return list(taken.values())


def _plain(key: str) -> str:
    return "".join(c for c in key.lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789")


def reduce_values(rows: DataFrame, attributes: list[Attribute], entity: str, key: str, value: str) -> DataFrame:
    """(entity, slot_no, long, double, text, items, fault): one typed row per entity and attribute, by its number.

    One of ``long``, ``double`` and ``text`` holds the value that all readable ones agree on; they are compared by their
    extremes, so that no list of values is ever gathered for an attribute that should have one. For a multi attribute
    ``items`` holds the distinct readable values in order. Rows of attributes unknown have the number -1.
    """
    spark = rows.sparkSession
    defs = spark.createDataFrame(
        [(_plain(a.key), i, a.value_type, a.is_multi, (a.missing_marker or "").strip(" ").lower()) for i, a in enumerate(attributes)],
        "name string, slot_no int, kind string, multi boolean, marker string",
    )
    named = rows.select(F.col(entity).alias("entity"), F.trim(F.col(value)).alias("value"), keys.plain_name(F.col(key)).alias("name")).where(
        F.col("entity").isNotNull()
    )
    known = named.join(F.broadcast(defs) if len(attributes) <= SMALL_DEFS else defs, "name", "left")
    says = F.col("slot_no").isNotNull() & (F.col("value") != "") & (F.lower("value") != F.col("marker"))
    v, kind = F.when(says, F.col("value")), F.col("kind")
    typed = known.select(
        "entity",
        F.coalesce("slot_no", F.lit(-1)).alias("slot_no"),
        F.coalesce("multi", F.lit(False)).alias("multi"),
        v.alias("value"),
        F.when(kind == "integer", keys.as_integer(v)).when(kind == "boolean", keys.as_boolean(v)).alias("long"),
        F.when(kind == "double", keys.as_double(v)).alias("double"),
        F.when(kind == "date", keys.as_date_text(v)).when(~kind.isin("integer", "boolean", "double"), v).alias("text"),
    )
    readable = F.coalesce(F.col("long").cast("string"), F.col("double").cast("string"), F.col("text"))
    extremes = [f(c).alias(f"{c}_{e}") for c in ("long", "double", "text") for f, e in ((F.min, "lo"), (F.max, "hi"))]
    reduced = typed.groupBy("entity", "slot_no").agg(
        F.max("multi").alias("multi"), F.count("value").alias("said"), F.count(readable).alias("readable"), *extremes,
        F.array_sort(F.collect_set(F.when(F.col("multi"), readable))).alias("items"),
    )
    # Only one of the three comparisons isn't null.
    differ = F.coalesce(F.col("long_lo") < F.col("long_hi"), F.col("double_lo") < F.col("double_hi"), F.col("text_lo") < F.col("text_hi"), F.lit(False))
    single = ~F.col("multi")
    fault = F.when((F.col("said") > 0) & (F.col("readable") == 0), "unreadable").when(single & differ, "conflict")
    agreed = [F.when(single & ~differ, F.col(f"{c}_lo")).alias(c) for c in ("long", "double", "text")]
    return reduced.select("entity", "slot_no", *agreed, F.when(F.size("items") > 0, F.col("items")).alias("items"), fault.alias("fault"))


def store_narrow(reduced: DataFrame, n_attributes: int) -> tuple[DataFrame, int]:
    """The narrow tables, written once and read back with ``shelf``, and the number of attributes of a shelf.

    A shelf is a directory; it holds one attribute, or several where there would be more than ``MAX_FILES`` files. The
    catalog is only used to make Spark write and know the buckets: the entry is dropped at once, and the files go when
    the application ends.
    """
    spark, buckets = reduced.sparkSession, partitions_for(reduced, BUCKET_BYTES)
    per_shelf = max(1, -(-n_attributes * buckets // MAX_FILES))
    name, path = f"strandweave_narrow_{uuid.uuid4().hex}", scratch_path(spark, SPINE)
    delete_at_end(spark, path)
    # The files' places must be known without the catalog.
    tracked = "spark.sql.hive.manageFilesourcePartitions"
    before = spark.conf.get(tracked, None)
    spark.conf.set(tracked, "false")
    try:
        (
            reduced.withColumn("shelf", F.floor(F.col("slot_no") / per_shelf).cast("int"))
            .repartition(buckets, "entity")
            .write.partitionBy("shelf")
            .bucketBy(buckets, "entity")
            .sortBy("entity")
            .option("path", path)
            .format("parquet")
            .saveAsTable(name)
        )
        return spark.table(name), per_shelf
    finally:
        spark.sql(f"drop table if exists {name}")
        spark.conf.unset(tracked) if before is None else spark.conf.set(tracked, before)


def _leaf(stored: DataFrame, per_shelf: int, numbers: range, attributes: list[Attribute]) -> DataFrame:
    """The multiway outer join of a few narrow tables: entity, value_n and fault_n of each."""
    shelves = sorted({n // per_shelf for n in numbers})
    rows = stored.where(F.col("shelf").isin(shelves) & F.col("slot_no").between(numbers[0], numbers[-1]))
    parts = []
    for n in numbers:
        a = attributes[n]
        spark_type = {"integer": "int", "boolean": "boolean", "double": "double", "date": "date"}.get(a.value_type, "string")
        own = F.col("slot_no") == n
        if a.is_multi:
            value = F.max(F.when(own, F.col("items"))).cast(f"array<{spark_type}>")
        else:
            value = F.max(F.when(own, F.col({"integer": "long", "boolean": "long", "double": "double"}.get(a.value_type, "text")))).cast(spark_type)
        parts += [value.alias(f"value_{n}"), F.max(F.when(own, F.col("fault"))).alias(f"fault_{n}")]
    return rows.groupBy("entity").agg(*parts)


def _balanced(tables: list[DataFrame]) -> DataFrame:
    """Combine tables that all hold every entity, pairwise and level by level."""
    while len(tables) > 1:
        paired = [a.join(b, "entity", "left") for a, b in zip(tables[::2], tables[1::2])]
        tables = paired + tables[len(paired) * 2 :]
    return tables[0]


def widen(rows: DataFrame, defs: DataFrame, entity: str, key: str = "attr_key", value: str = "attr_value") -> DataFrame:
    """One row per entity with a typed column per defined attribute, and the map ``faults`` of attribute to fault.

    ``rows`` may have any further columns; they are not read. Rows with a null entity belong to none and are left out.
    An entity whose rows name no defined attribute, or say nothing, still gets its row, of nulls. A cell is null where
    nothing is said, where nothing readable is said (``unreadable``) and where the readable values differ
    (``conflict``); repeated equal values agree. A multi attribute becomes the sorted array of its distinct values and
    can only be unreadable. An attribute named like the entity column or ``faults`` gets the prefix ``attr_``. An
    empty table gives no rows.
    """
    attributes = read_definitions(defs)
    if not attributes:
        faults = F.lit(None).cast("map<string,string>").alias("faults")
        return rows.where(F.col(entity).isNotNull()).select(entity).distinct().select(entity, faults)
    stored, per_shelf = store_narrow(reduce_values(rows, attributes, entity, key, value), len(attributes))
    spine = stored.groupBy("entity").agg(F.lit(1).alias("there")).select("entity")
    leaves = [_leaf(stored, per_shelf, range(at, min(at + FAN_IN, len(attributes))), attributes) for at in range(0, len(attributes), FAN_IN)]
    # Spark forgets the partitioning of full outer joins; left ones from a spine of all entities have the same rows.
    joined = [reduce(lambda left, right: left.join(right, "entity", "left"), leaves[at : at + FAN_IN], spine) for at in range(0, len(leaves), FAN_IN)]
    wide = _balanced(joined)
    reserved = {entity.lower(), "faults"}
    columns = [
        F.col(f"value_{i}").alias(f"attr_{a.key}" if a.key.lower() in reserved else a.key) for i, a in enumerate(attributes)
    ]
    faults = F.create_map(*[x for i, a in enumerate(attributes) for x in (F.lit(a.key), F.col(f"fault_{i}"))])
    return wide.select(F.col("entity").alias(entity), *columns, F.map_filter(faults, lambda _, f: f.isNotNull()).alias("faults"))


def cell_faults(wide: DataFrame, entity: str, attributes: list[str]) -> DataFrame:
    """(entity, attr_key, fault) of the wide table's cells without one value, of the given attributes."""
    return wide.select(entity, F.explode("faults").alias("attr_key", "fault")).where(F.col("attr_key").isin(*attributes))
