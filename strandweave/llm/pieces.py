"""Splitting oversized items at natural boundaries.

An item is measured in tokens (each character, or each match of a pattern). The prefix sums of the tokens' offsets
turn a limit in tokens into a position and back; the boundaries of each kind are sorted arrays of token counts. A
piece's end is found by binary search: the last boundary of the most wanted kind under the limit, else of the next
kind, else a hard cut at the limit. The next piece steps back by the overlap.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The boundaries of nucleotide sequences, ends of gaps first, then ends of masked stretches.
SEQUENCE_BOUNDARIES = ("[Nn]{10,}", "[a-z]{20,}")
_PIECES = "item_id {id}, piece_no bigint, piece_start bigint, piece_end bigint"


def token_offsets(text: str, token: re.Pattern | None) -> np.ndarray:
    """The position after each token, with 0 before the first; what follows the last token counts to it."""
    if token is None:
        return np.arange(len(text) + 1)
    ends = [m.end() for m in token.finditer(text) if m.end() > m.start()]
    if not ends:
        return np.array([0, len(text)]) if text else np.array([0])
    ends[-1] = len(text)
    return np.array([0, *ends])


def boundary_counts(text: str, patterns: Sequence[re.Pattern], offsets: np.ndarray) -> list[np.ndarray]:
    """Per pattern the sorted token counts at which a match ends; ends within a token count at the token before."""
    found = []
    for pattern in patterns:
        ends = np.fromiter((m.end() for m in pattern.finditer(text)), dtype=np.int64)
        found.append(np.unique(np.searchsorted(offsets, ends, side="right") - 1))
    return found


def cut(n_tokens: int, boundaries: Sequence[np.ndarray], limit: int, overlap: int) -> list[tuple[int, int]]:
    """The pieces of an item as token ranges."""
    pieces, start = [], 0
    while n_tokens - start > limit:
        end = start + limit
        for ends in boundaries:
            last = np.searchsorted(ends, start + limit, side="right") - 1
            if last >= 0 and ends[last] > start + overlap:
                end = int(ends[last])
                break
        pieces.append((start, end))
        start = end - overlap
    pieces.append((start, n_tokens))
    return pieces


def split_oversized(
    rows: DataFrame,
    item_id: str,
    text: str,
    limit: int = 2000,
    overlap: int = 100,
    boundaries: Sequence[str] = SEQUENCE_BOUNDARIES,
    token: str | None = None,
) -> DataFrame:
    """(item_id, piece_no, piece_start, piece_end) of every item of more than ``limit`` tokens.

    Positions are characters, 0-based and half-open; pieces are numbered from 1, overlap by ``overlap`` tokens and hold
    at most ``limit``. ``boundaries`` are patterns whose matches' ends are natural cuts, most wanted first; an end
    counts if more than ``overlap`` tokens of the piece lie before it, so that pieces always advance. ``token`` is the
    pattern of a token, by default each character is one. Null and empty items, and those within the limit, give no
    pieces. Repeated items are cut each. Further columns are not read. An empty table gives no rows.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be at least 0 and less than the limit")
    wanted = [re.compile(p) for p in boundaries]
    unit = re.compile(token) if token else None

    def pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, numbers, starts, ends = [], [], [], []
            for row, value in enumerate(batch.column(1)):
                item = value.as_py()
                offsets = token_offsets(item, unit)
                if len(offsets) - 1 <= limit:
                    continue
                found = cut(len(offsets) - 1, boundary_counts(item, wanted, offsets), limit, overlap)
                at += [row] * len(found)
                numbers += range(1, len(found) + 1)
                starts += [int(offsets[s]) for s, _ in found]
                ends += [int(offsets[e]) for _, e in found]
            columns = [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(x, pa.int64()) for x in (numbers, starts, ends))]
            yield pa.RecordBatch.from_arrays(columns, names=["item_id", "piece_no", "piece_start", "piece_end"])

    # A token has at least one character, so that short items need no Python.
    large = rows.where(F.char_length(text) > limit).select(F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    out = large.mapInArrow(pieces_of, _PIECES.format(id=dict(large.dtypes)["item_id"]))
    return out.withColumnRenamed("item_id", item_id)


def piece_texts(rows: DataFrame, pieces: DataFrame, item_id: str, text: str) -> DataFrame:
    """The pieces with the column ``piece``, their text; items are matched by ``item_id``, which must be unique."""
    items = rows.select(item_id, F.col(text).alias("_text"))
    cut_out = F.substring(F.col("_text"), F.col("piece_start").cast("int") + 1, (F.col("piece_end") - F.col("piece_start")).cast("int"))
    return pieces.join(items, item_id).select(*pieces.columns, cut_out.alias("piece"))
