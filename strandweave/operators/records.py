"""Alignment records as rows: map, filter, count, split, and tags joined from reads.

Records have the columns of ``sources.sam``; ``record_index`` is their order in their file. Tables of several files have
``file_no``, a file's place among them, or only ``file``; order and identity are then of file and index together. User
functions are Columns.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave.errors import BamError

UNMAPPED, PAIRED = 0x4, 0x1
#: The bits of one bitmap of run ends, as the built-in aggregate makes them.
_BITMAP = 32768


def file_keys(rows: DataFrame) -> list[str]:
    """The columns that tell a row's file; none for a table of one file."""
    return [c for c in ("file_no", "file") if c in rows.columns][:1]


def numbered_files(rows: DataFrame) -> DataFrame:
    """The rows with ``file_no``: as it is, else by the order of the files' names, else 0."""
    if "file_no" in rows.columns:
        return rows
    if "file" not in rows.columns:
        return rows.withColumn("file_no", F.lit(0))
    # The names of the files, not their rows, meet in one task.
    names = rows.select("file").distinct().withColumn("file_no", F.row_number().over(Window.orderBy("file")) - 1)
    return rows.join(names, "file")


def positioned(rows: DataFrame, index: str) -> DataFrame:
    """The rows with ``position``, their order over all files: the index, after the indices of the files before."""
    keys = file_keys(rows)
    if not keys:
        return rows.withColumn("position", F.col(index))
    sizes = rows.groupBy(*keys).agg((F.max(index) + 1).alias("_size"))
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    return rows.join(offsets, keys).withColumn("position", F.col("_offset") + F.col(index)).drop("_offset")


def map_records(records: DataFrame, **columns: Column) -> DataFrame:
    """One row per record with the given columns."""
    return records.select(*[c.alias(n) for n, c in columns.items()])


def apply_records(records: DataFrame, record: Column) -> DataFrame:
    """The records that a struct expression makes of each, nulls left out, in file order by ``record_index``."""
    return records.select(record.alias("r")).where(F.col("r").isNotNull()).select("r.*")


def filter_records(records: DataFrame, predicate: Column) -> DataFrame:
    """The records for which the predicate isn't false; null keeps a record."""
    return records.where(F.coalesce(predicate, F.lit(True)))


def count_records(records: DataFrame, predicate: Column | None = None) -> DataFrame:
    """The number of records, of those for which the predicate is true if one is given."""
    kept = records if predicate is None else records.where(predicate)
    return kept.agg(F.count(F.lit(1)).alias("n"))


def checked_pairs(records: DataFrame, split: Column | None = None, index: str = "record_index") -> DataFrame:
    """The records with ``paired``, ``pair_index`` and ``pair_last``; an error where paired ones don't come in twos of one group.

    Mates share file, name and HI tag (none if unmapped). ``pair_last`` marks the mate that comes second, ``pair_index``
    is that mate's ``index``; unpaired records are their own. ``index`` is unique within a file.
    """
    hit = F.when(F.col("flag").bitwiseAND(UNMAPPED) == 0, F.col("tags")["HI"])
    key = Window.partitionBy(*file_keys(records), "paired", "qname", "hit")
    marked = records.withColumn("paired", F.col("flag").bitwiseAND(PAIRED) > 0).withColumn("hit", hit)
    if split is not None:
        marked = marked.withColumn("split_id", split)
    counted = marked.withColumn("mates", F.count(F.lit(1)).over(key)).withColumn("second", F.max(index).over(key))
    wrong = F.col("mates") != 2
    if split is not None:
        counted = counted.withColumn("lo", F.min("split_id").over(key)).withColumn("hi", F.max("split_id").over(key))
        wrong = wrong | (F.col("lo") != F.col("hi"))
    own = F.when(~F.col("paired"), F.col(index)).when(wrong, F.raise_error(F.concat(F.lit("mates of a pair missing or apart: "), F.col("qname"))).cast("bigint")).otherwise(F.col("second"))
    out = counted.withColumn("pair_index", own).withColumn("pair_last", ~F.col("paired") | (F.col(index) == F.col("second")))
    return out.select(*records.columns, *(["split_id"] if split is not None else []), "paired", "pair_index", "pair_last")


def split_records(records: DataFrame, split: Column | None = None, n: int | None = None, check_pairs: bool = True) -> DataFrame:
    """The records with ``split_id``, by a Column or into ``n`` runs of the files' order; exactly one of the two.

    For ``n`` a run closes once it holds more than the number of records divided by ``n``, so that runs are one record
    (or a pair) longer than that and may be fewer than ``n``. A pair is placed where its second mate comes and weighs 2.
    Several files are split as one, in their order; mates are of one file. Records are placed by running sums over
    blocks of the order: only the blocks' totals meet in one task.
    """
    if (split is None) == (n is None):
        raise BamError("give either a split column or a number of splits")
    if split is not None:
        if not check_pairs:
            return records.withColumn("split_id", split)
        # The group hangs on the check, which would be pruned otherwise.
        checked = F.when(F.col("pair_index").isNotNull(), F.col("split_id")).alias("split_id")
        return checked_pairs(records, split).select(*records.columns, checked)
    placed = positioned(records, "record_index")
    if check_pairs:
        marked = checked_pairs(placed, index="position")
        weight = F.when(F.col("paired"), 2).otherwise(1)
    else:
        marked, weight = placed.withColumn("pair_index", F.col("position")).withColumn("pair_last", F.lit(True)), F.lit(1)
    size = records.count() // n + 1
    rank = _placed(marked.where("pair_last").select("pair_index", weight.alias("weight")), "pair_index", size)
    return marked.join(rank.select("pair_index", "split_id"), "pair_index").select(*records.columns, "split_id")


def _running_sum(rows: DataFrame, order: str, value: str, block_bits: int = 16) -> DataFrame:
    """``so_far``: the sum up to and with each row, from sums within a block and the totals of the blocks before it."""
    blocked = rows.withColumn("block", F.shiftright(order, block_bits))
    totals = blocked.groupBy("block").agg(F.sum(value).alias("total"))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("block", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("before"))
    inside = F.sum(value).over(Window.partitionBy("block").orderBy(order))
    return blocked.withColumn("inside", inside).join(before, "block").withColumn("so_far", F.col("before") + F.col("inside")).drop("block", "inside", "before")


def _placed(units: DataFrame, order: str, size: int) -> DataFrame:
    """``split_id`` of units of weight 1 or 2 in runs that close once they reach ``size``.

    A run that starts after the sum x closes at x + size, or at x + size + 1 if no unit ends there. The k-th run can
    thus only close at k * size + j with j <= k; whether units end there is all that the driver needs to know: one bit
    each, in a bitmap per run.
    """
    summed = _running_sum(units, order, "weight")
    run, over = F.floor(F.col("so_far") / size), F.col("so_far") % size
    near = summed.where((run >= 1) & (over <= run)).select((run * size).alias("base"), over.alias("over"))
    maps = near.groupBy("base", F.floor(F.col("over") / _BITMAP).alias("part")).agg(F.bitmap_construct_agg((F.col("over") % _BITMAP).cast("bigint")).alias("bits"))
    ends = {(r.base, r.part): r.bits for r in maps.collect()}

    def ended(x: int) -> bool:
        # A run longer than ``size`` may close in what counts as a later run's range; its own base is the one asked.
        part, bit = divmod(x % size, _BITMAP)
        bits = ends.get((x - x % size, part))
        return bits is not None and bool(bits[bit // 8] >> bit % 8 & 1)

    closings, at = [], 0
    while ended(at := at + size if ended(at + size) else at + size + 1):
        closings.append(at)
    # The k-th closing lies between k * size and k * (size + 1), so that all but a few are known to be passed or not.
    listed, x = F.from_json(F.lit(json.dumps(closings)), "array<bigint>"), F.col("so_far") - 1
    sure = F.least(F.floor(x / (size + 1)), F.lit(len(closings))).cast("int")
    open_ = F.slice(listed, sure + 1, F.greatest(F.floor(x / size).cast("int") - sure, F.lit(0)))
    passed = sure + F.size(F.filter(open_, lambda c: c < F.col("so_far")))
    return summed.withColumn("split_id", passed.cast("string"))


def tag_records(records: DataFrame, reads: list[DataFrame], tags: list[Column], check_name: bool = True, merge: bool = False) -> DataFrame:
    """The records with tags from reads of the same name.

    ``reads[i]`` has the columns of ``sources.fastq``; ``tags[i]`` is a map<string,string> expression over them. Tags of
    later reads replace those of earlier ones, and of repeated names the last read counts. The tags replace a record's
    own, or with ``merge`` are added. With ``check_name`` a record without reads is an error, else it stays as it is.
    """
    each = [r.select(F.col("name").alias("qname"), t.alias("t"), F.struct(*file_keys(r), "read_index").alias("at")) for i, (r, t) in enumerate(zip(reads, tags))]
    last = [e.groupBy("qname").agg(F.max_by("t", "at").alias(f"t{i}")) for i, e in enumerate(each)]
    named = reduce(lambda a, b: a.join(b, "qname", "full"), last)
    empty = _no_tags()
    joined = records.join(named.withColumn("_new", _merged([F.coalesce(F.col(f"t{i}"), empty) for i in range(len(last))])).select("qname", "_new"), "qname", "left")
    missing = F.raise_error(F.concat(F.lit("no read for "), F.col("qname"))).cast("map<string,string>") if check_name else F.col("tags")
    new = _merged([F.coalesce("tags", empty), F.col("_new")]) if merge else F.col("_new")
    return joined.withColumn("tags", F.when(F.col("_new").isNull(), missing).otherwise(new)).select(*records.columns)


def _no_tags() -> Column:
    return F.create_map().cast("map<string,string>")


def _merged(maps: list[Column]) -> Column:
    """The union of maps; later ones win."""
    return reduce(lambda a, b: F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b), maps)


def reads_to_records(reads: DataFrame, group: str, tags: Column | None = None, **given: Column) -> DataFrame:
    """Unmapped records of reads: flag 4 and the read group's tag, with further ``tags`` if given.

    ``record_index`` is the read's index in its file; the columns that tell the file are kept. ``given`` are expressions
    over the reads that take the place of an unmapped read's columns.
    """
    own, far = F.create_map(F.lit("RG"), F.lit(group)), F.lit(0).cast("bigint")
    columns = {
        "qname": F.col("name"), "flag": F.lit(UNMAPPED), "rname": F.lit("*"), "pos": far, "mapq": F.lit(0), "cigar": F.lit("*"), "rnext": F.lit("*"), "pnext": far, "tlen": far,
        "seq": F.col("sequence"), "qual": F.col("quality"), "tags": own if tags is None else _merged([tags, own]),
    }
    made = [given.get(name, column).alias(name) for name, column in columns.items()]
    return reads.select(*file_keys(reads), F.col("read_index").alias("record_index"), *made)


def zip_reads(reads: list[DataFrame]) -> DataFrame:
    """(file_no, read_index, reads): the reads of several sides next to each other, as many as the shortest file has.

    A side may be several files; the i-th file of each side belong together, as do reads of the same index in them.
    """
    one = [
        r.select("file_no", "read_index", F.struct(*[c for c in r.columns if c not in ("file_no", "read_index")]).alias(f"r{i}"))
        for i, r in enumerate(map(numbered_files, reads))
    ]
    joined = reduce(lambda a, b: a.join(b, ["file_no", "read_index"]), one)
    return joined.select("file_no", "read_index", F.array(*[f"r{i}" for i in range(len(reads))]).alias("reads"))


def zipped_records(reads: list[DataFrame], record: Column, group: str) -> DataFrame:
    """The records that a struct expression makes of the zipped ``reads``, nulls left out, with the group's RG tag.

    The struct names columns of a record; those it leaves out are an unmapped read's.
    """
    made = zip_reads(reads).select("file_no", "read_index", record.alias("_r")).where(F.col("_r").isNotNull())
    given = {c: F.col("_r")[c] for c in made.select("_r.*").columns}
    tags = F.coalesce(given.pop("tags"), _no_tags()) if "tags" in given else None
    blank = {c: F.lit("*") for c in ("name", "sequence", "quality")}
    return reads_to_records(made.withColumns(blank), group, tags, **given)


def layout_records(reads: list[DataFrame], chemistry, tag_map: dict[str, tuple[str, str] | str], group: str, sequence_key: str = "cdna") -> DataFrame:
    """Unmapped records cut from several files' reads by a layout.

    ``tag_map`` maps a parser's name to its sequence tag, or to the tags of sequence and quality. The parser
    ``sequence_key`` gives the record's own sequence. A side may be several files, as in ``zip_reads``.
    """
    if len(reads) != chemistry.n:
        raise BamError(f"{chemistry.name} needs {chemistry.n} files")
    unknown = {*tag_map, sequence_key} - set(chemistry.parsers)
    flat = [t for v in tag_map.values() for t in ([v] if isinstance(v, str) else v)]
    if unknown or len(set(flat)) != len(flat):
        raise BamError(f"unknown parsers {sorted(unknown)} or repeated tags")
    part = lambda f: [F.col("reads")[i][f] for i in range(chemistry.n)]
    cut = chemistry.parse_reads(part("name"), part("sequence"), part("quality"), concatenate=True)
    pairs = []
    for key, tags in tag_map.items():
        names = [tags] if isinstance(tags, str) else list(tags)
        pairs += [x for n, f in zip(names, ("sequence", "quality")) for x in (F.lit(n), cut[key][f])]
    named = zip_reads(reads).select(
        "file_no", "read_index", F.col("reads")[0]["name"].alias("name"), cut[sequence_key]["sequence"].alias("sequence"), cut[sequence_key]["quality"].alias("quality"), (F.create_map(*pairs) if pairs else _no_tags()).alias("_tags")
    )
    return reads_to_records(named, group, F.col("_tags"))
