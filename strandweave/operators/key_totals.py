"""Per-key totals that a few frequent keys don't unbalance.

Every task works through its input split with dense accumulator arrays: the keys of a batch are dictionary-encoded,
the codes index arrays of counts (bincount), totals, first and last times (scatter-reduce). What leaves a task is one
row per key it met, whatever the number of rows behind it; the array blocks are then summed key by key in a
distributed reduction. No row is moved to a task because of its key, so splits of equal size stay equal work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The keys that the accumulators of a task hold; a block is passed on and a new one begun beyond it.
BLOCK_KEYS = 200_000
PARTIAL = "key string, n_rows bigint, total bigint, first_us bigint, last_us bigint"
#: A floating sum beyond it may be a 64-bit sum that wrapped.
_SAFE = float(2**63 - 2**40)
_NEVER_FIRST, _NEVER_LAST = np.iinfo(np.int64).max, np.iinfo(np.int64).min


class Accumulators:
    """Dense arrays of counts, totals, firsts and lasts, indexed by the code of a key."""

    def __init__(self) -> None:
        self.codes: dict[str | None, int] = {}
        self._room(1024)

    def _room(self, size: int) -> None:
        def grown(name: str, fill: int, dtype: type = np.int64) -> np.ndarray:
            new = np.full(size, fill, dtype=dtype)
            if hasattr(self, name):
                old = getattr(self, name)
                new[: len(old)] = old
            return new

        self.counts, self.totals, self.rough = grown("counts", 0), grown("totals", 0), grown("rough", 0, np.float64)
        self.first, self.last = grown("first", _NEVER_FIRST), grown("last", _NEVER_LAST)

    def add(self, batch: pa.RecordBatch) -> None:
        """Add the rows (key, length, us) of a batch."""
        encoded = batch.column(0).dictionary_encode(null_encoding="encode")
        local = np.fromiter(
            (self.codes.setdefault(k, len(self.codes)) for k in encoded.dictionary.to_pylist()), dtype=np.int64
        )
        while len(self.codes) > len(self.counts):
            self._room(2 * len(self.counts))
        at = local[encoded.indices.to_numpy(zero_copy_only=False)]
        size = len(self.counts)
        self.counts += np.bincount(at, minlength=size)
        lengths = batch.column(1).fill_null(0).to_numpy(zero_copy_only=False)
        np.add.at(self.totals, at, lengths)
        # Floating sums tell a 64-bit sum that wraps: they can't be off by as much as a wrap.
        np.add.at(self.rough, at, lengths.astype(np.float64))
        if np.abs(self.rough).max(initial=0.0) > _SAFE:
            raise OverflowError("a key's total is beyond 64 bits")
        timed = np.asarray(batch.column(2).is_valid().to_numpy(zero_copy_only=False), dtype=bool)
        us = batch.column(2).fill_null(0).to_numpy(zero_copy_only=False)[timed]
        np.minimum.at(self.first, at[timed], us)
        np.maximum.at(self.last, at[timed], us)

    def block(self) -> pa.RecordBatch:
        """The accumulated rows, one per key."""
        n = len(self.codes)
        first, last = self.first[:n], self.last[:n]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(list(self.codes), pa.string()),
                pa.array(self.counts[:n]),
                pa.array(self.totals[:n]),
                pa.array(first, mask=first == _NEVER_FIRST),
                pa.array(last, mask=last == _NEVER_LAST),
            ],
            names=["key", "n_rows", "total", "first_us", "last_us"],
        )


def _accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = Accumulators()
    for batch in batches:
        if batch.num_rows:
            sums.add(batch)
        if len(sums.codes) > BLOCK_KEYS:
            yield sums.block()
            sums = Accumulators()
    if sums.codes:
        yield sums.block()


def key_totals(rows: DataFrame, key: str, length: str, at: str) -> DataFrame:
    """(key_value, n_rows, total_length, first_at, last_at) per key of ``rows``.

    ``key`` is a column of strings, ``length`` of longs, ``at`` of timestamps; further columns are not read. Null keys
    make a key of their own (null). Null lengths add nothing; a key whose rows have no time has null times. Totals are
    exact 64-bit sums (a total within 2^40 of overflow is an error in a task, as is an overflow of the reduction). An empty table gives no rows.
    """
    thin = rows.select(
        F.col(key).cast("string").alias("key"), F.col(length).cast("bigint").alias("length"), F.unix_micros(F.col(at)).alias("us")
    )
    reduced = (
        thin.mapInArrow(_accumulate, PARTIAL)
        .groupBy("key")
        .agg(F.sum("n_rows").alias("n"), F.sum("total").alias("t"), F.min("first_us").alias("f"), F.max("last_us").alias("l"))
    )
    return reduced.select(
        F.col("key").alias("key_value"),
        F.col("n").alias("n_rows"),
        F.col("t").alias("total_length"),
        F.timestamp_micros("f").alias("first_at"),
        F.timestamp_micros("l").alias("last_at"),
    )


def frequent_keys(totals: DataFrame, share: float) -> DataFrame:
    """The keys of ``key_totals`` that have more than ``share`` of the rows with a key; null keys don't count.

    There are fewer than 1/share such keys, whatever the number of keys.
    """
    keyed = totals.where(F.col("key_value").isNotNull())
    whole = keyed.agg(F.sum("n_rows").alias("n")).scalar()
    return keyed.where(F.col("n_rows") > whole * F.lit(share))
