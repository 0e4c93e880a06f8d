"""SAM text as rows. Tags keep their type letter in ``tag_types``; missing fields are as in the text (``*``, 0)."""

from __future__ import annotations

from collections.abc import Iterator

from strandweave.sources.text import lines_of

SCHEMA = (
    "file string, record_index bigint, qname string, flag int, rname string, pos bigint, mapq int, cigar string, rnext string, "
    "pnext bigint, tlen bigint, seq string, qual string, tags map<string,string>, tag_types map<string,string>"
)
#: Fixed value: the least header.
HEADER = "@HD\tVN:1.6\tSO:unsorted"


def rows(path: str) -> Iterator[tuple]:
    """The records, header lines left out."""
    index = 0
    for line in lines_of(path):
        if line.startswith("@") or not line:
            continue
        f = line.split("\t")
        if len(f) < 11:
            raise ValueError(f"{path}: a record needs eleven fields: {line}")
        tags = [t.split(":", 2) for t in f[11:]]
        yield (path, index, f[0], int(f[1]), f[2], int(f[3]), int(f[4]), f[5], f[6], int(f[7]), int(f[8]), f[9], f[10], {t[0]: t[2] for t in tags}, {t[0]: t[1] for t in tags})
        index += 1


def header_of(path: str) -> str:
    """The header lines."""
    head = []
    for line in lines_of(path):
        if not line.startswith("@"):
            break
        head.append(line)
    return "\n".join(head)


def typed_tags(row) -> list[tuple[str, str, str]]:
    """(tag, type, value) of a row; integers and text are told apart where no types are given."""
    fields = row.asDict() if hasattr(row, "asDict") else row
    tags, types = fields.get("tags") or {}, fields.get("tag_types") or {}
    return [(k, types.get(k, "Z"), v) for k, v in tags.items()]


def line_of(row) -> str:
    """The text of a record."""
    fixed = [row[c] for c in ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")]
    return "\t".join([*map(str, fixed), *(f"{t}:{k}:{v}" for t, k, v in typed_tags(row))])
