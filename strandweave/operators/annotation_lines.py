"""Annotation lines into entries, with the lines that can't be parsed set apart.

A block of lines is parsed as a unit: one compiled pattern runs over the block's text, and its positions are compared.
The block parses or fails, without telling where. A block that fails is bisected and its halves are parsed by the same
parser, down to single lines; a single line that fails is diagnosed by the strict rules, which name the first reason or
find that it is an entry after all. The stretches that parse are split into typed columns by Arrow, all stretches of a
batch at once, and never meet the strict rules.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The lines of a block. Among many bad lines, blocks much longer than the stretches between these only fail.
BLOCK_LINES = 1024
#: The rules of a line's columns.
COLUMNS = ("chromosome", "source", "feature", "start_pos", "end_pos", "score", "strand", "frame", "attributes")
SCORE = r"(?:\.|[+-]?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)"
STRAND = r"[+.-]"
FRAME = r"[.012]"
POSITION = r"[0-9]+"
ITEM = r' *(?:[^\t ;"]+ +(?:[^\t ;"][^\t;"]*|"[^\t"]*" *))?'
ITEMS = rf"{ITEM}(?:;{ITEM})*"
LARGEST = 2**63 - 1

_STRICT = {n: re.compile(p) for n, p in (("score", SCORE), ("strand", STRAND), ("frame", FRAME), ("position", POSITION), ("items", ITEMS))}
#: A line that is surely an entry, but for its positions' order, within a block's text. Nothing is tried twice
#: (possessive), so that a block costs time in proportion to its text. Positions of over 18 digits are left to the strict rules.
_FILLED, _SHORT = r" *+[^\t\n ][^\t\n]*+", r" *+[0-9]{1,18}+ *+"
_SURE_ITEM = r' *+(?:[^\t\n ;"]++ ++(?:[^\t\n ;"][^\t\n;"]*+|"[^\t\n"]*+" *+))?+'
_SURE = {
    "chromosome": _FILLED, "source": r"[^\t\n]*+", "feature": _FILLED, "start_pos": _SHORT, "end_pos": _SHORT,
    "score": f" *+{SCORE} *+", "strand": f" *+{STRAND} *+", "frame": f" *+{FRAME} *+", "attributes": rf"{_SURE_ITEM}(?:;{_SURE_ITEM})*+",
}
_BLOCK = re.compile("(?:" + "\t".join(_SURE[c] for c in COLUMNS) + "\n)++")
_POSITIONS = re.compile(r"^[^\t\n]*+\t[^\t\n]*+\t[^\t\n]*+\t *+([0-9]++) *+\t *+([0-9]++)", re.MULTILINE)
_TYPES = {"start_pos": pa.int64(), "end_pos": pa.int64()}


def diagnose(line: str | None) -> str | dict:
    """The first reason why a line isn't an entry, or its values."""
    columns = line.split("\t") if line is not None else []
    if len(columns) != len(COLUMNS):
        return "columns"
    if not _STRICT["items"].fullmatch(columns[8]):
        return "quoting"
    row = dict(zip(COLUMNS, [*(c.strip(" ") for c in columns[:8]), columns[8]]))
    if not row["chromosome"] or not row["feature"]:
        return "value"
    for name in ("start_pos", "end_pos"):
        digits = row[name]
        if not _STRICT["position"].fullmatch(digits):
            return "value"
        row[name] = int(digits) if len(digits.lstrip("0")) < 20 else LARGEST + 1
    if not 1 <= row["start_pos"] <= row["end_pos"] <= LARGEST:
        return "value"
    if not all(_STRICT[k].fullmatch(row[k]) for k in ("score", "strand", "frame")):
        return "value"
    return row


def parse_block(lines: list[str]) -> bool:
    """Whether a block parses: all of its lines are entries for sure."""
    text = "\n".join(lines) + "\n"
    # A line with a line break of its own isn't surely an entry.
    if text.count("\n") != len(lines) or not _BLOCK.fullmatch(text):
        return False
    return all(1 <= int(start) <= int(end) for start, end in _POSITIONS.findall(text))


def isolate(lines: list[str | None]) -> tuple[list[int], list[tuple[int, str | dict]]]:
    """The offsets of the lines that parse in blocks, and (offset, reason or entry) of those that stand alone."""
    texts = [line or "" for line in lines]
    parsed: list[int] = []
    alone: list[tuple[int, str | dict]] = []
    todo = [(0, len(lines))]
    while todo:
        at, end = todo.pop()
        if at == end:
            continue
        if parse_block(texts[at:end]):
            parsed.extend(range(at, end))
        elif end - at > 1:
            middle = (at + end) // 2
            todo += [(middle, end), (at, middle)]
        else:
            alone.append((at, diagnose(lines[at])))
    return parsed, alone


def split_columns(lines: pa.Array) -> list[pa.Array]:
    """The typed columns of lines that parse."""
    parts = pc.split_pattern(lines, "\t").flatten()
    columns = [parts.take(pa.array(np.arange(i, len(parts), len(COLUMNS)))) for i in range(len(COLUMNS))]
    return [c if name == "attributes" else pc.cast(pc.utf8_trim(c, " "), _TYPES.get(name, pa.string())) for name, c in zip(COLUMNS, columns)]


_OUT = "line_id {id}, reason string, chromosome string, source string, feature string, start_pos bigint, end_pos bigint, score string, strand string, frame string, attributes string"


def _parser(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["line_id", "reason", *COLUMNS]
    for batch in batches:
        ids, lines = batch.column(0), batch.column(1).cast(pa.string())
        texts = lines.to_pylist()
        parsed, alone = [], []
        for at in range(0, len(texts), BLOCK_LINES):
            whole, single = isolate(texts[at : at + BLOCK_LINES])
            parsed += [at + offset for offset in whole]
            alone += [(at + offset, value) for offset, value in single]
        if parsed:
            places = pa.array(parsed, pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(places), pa.nulls(len(parsed), pa.string()), *split_columns(lines.take(places))], names=names)
        if alone:
            values = [v if isinstance(v, dict) else {"reason": v} for _, v in alone]
            columns = [pa.array([v.get(c) for v in values], _TYPES.get(c, pa.string())) for c in names[1:]]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array([o for o, _ in alone], pa.int64())), *columns], names=names)


def attribute_map(items: Column) -> Column:
    """The items of a well-formed ninth column as a map; of repeated names the last holds."""
    item = r'([^ ;"]+) +(?:"([^"]*)"|([^ ;"][^;"]*))'
    names, quoted, bare = (F.regexp_extract_all(items, F.lit(item), F.lit(i)) for i in (1, 2, 3))
    values = F.zip_with(quoted, bare, lambda q, b: F.when(b != "", F.rtrim(b)).otherwise(q))
    # From entries with the last of a name first kept: reversed, then filtered to first places.
    pairs = F.reverse(F.arrays_zip(names.alias("k"), values.alias("v")))
    keys = F.transform(pairs, lambda p: p["k"])
    last = F.filter(pairs, lambda p, i: F.array_position(keys, p["k"]) == i + 1)
    return F.map_from_entries(last)


def parse_lines(rows: DataFrame, line_id: str, line: str) -> DataFrame:
    """One row per line that isn't a comment: its entry, or null columns and the ``reason`` why there is none.

    Columns: ``line_id``'s name, reason, chromosome, source, feature, start_pos, end_pos, score, strand, frame and the
    map attributes; further columns of ``rows`` are not read. Lines that start with # are comments and left out. One
    final carriage return is dropped. Reasons, first that applies: ``columns`` (null, blank, or not nine columns),
    ``quoting`` (the ninth column isn't a list of items), ``value`` (a value of the first eight is invalid). Values are
    given trimmed of blanks. Repeated lines are repeated. An empty table gives no rows.
    """
    kept = rows.where(F.col(line).isNull() | ~F.col(line).startswith("#"))
    thin = kept.select(F.col(line_id).alias("line_id"), F.regexp_replace(F.col(line), r"\r\z", "").alias("line"))
    out = thin.mapInArrow(_parser, _OUT.format(id=dict(thin.dtypes)["line_id"]))
    return out.withColumn("attributes", attribute_map(F.col("attributes"))).withColumnRenamed("line_id", line_id)
