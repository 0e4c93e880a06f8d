"""Smoothed character n-gram models of fixed size.

Counts of character trigrams, bigrams and single characters are kept in tables of a fixed number of places, to which
n-grams are hashed; a model's size is thus bounded whatever the corpus. The probability of a character after two others
interpolates the three orders. A fourth table counts whole runs of characters beyond ASCII with the characters next to
them. Counts are taken over all texts, in a distributed sum.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The tables' sizes as powers of two: trigrams, bigrams, characters, runs. Eight bytes a place bound what is broadcast.
BITS = (22, 21, 17, 20)
#: A run of characters beyond ASCII with its neighbours; the one after may be the one before the next run.
RUN = re.compile(r"(?=([\x00-\x7f][^\x00-\x7f]+[\x00-\x7f]))[\x00-\x7f][^\x00-\x7f]+")
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
#: Stands before and after every text.
EDGE = "\u0002"
#: The weight of the next lower order, as a number of occurrences.
SMOOTH = 0.5


def codes(text: str) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def places(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of the trigrams, bigrams and characters that end at each point from the third on."""
    x = points.astype(np.uint64)
    a, b, c = x[:-2] * _MIX[0], x[1:-1] * _MIX[1], x[2:] * _MIX[2]
    hashed = [(h ^ (h >> np.uint64(29))) * _MIX[0] for h in (a + b + c, b + c)]
    folded = (points[2:] & np.uint32((1 << BITS[2]) - 1)).astype(np.int64)
    return (*((h >> np.uint64(64 - bits)).astype(np.int64) for h, bits in zip(hashed, BITS)), folded)


def contexts(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places, as of ``places``, of the bigram and the character before each point from the third on."""
    x = points.astype(np.uint64)
    two = x[:-2] * _MIX[1] + x[1:-1] * _MIX[2]
    two = (two ^ (two >> np.uint64(29))) * _MIX[0]
    folded = (points[1:-1] & np.uint32((1 << BITS[2]) - 1)).astype(np.int64)
    return (two >> np.uint64(64 - BITS[1])).astype(np.int64), folded


def _multiplicity(owner: np.ndarray, at: np.ndarray, bits: int) -> np.ndarray:
    """How often the value at each index occurs among those of the same owner."""
    keys = (owner << bits) | at
    order = np.argsort(keys)
    placed = keys[order]
    starts = np.flatnonzero(np.diff(placed, prepend=-1))
    out = np.empty(len(keys), dtype=np.int64)
    out[order] = np.repeat(np.diff(starts, append=len(placed)), np.diff(starts, append=len(placed)))
    return out


def run_place(run: str) -> int:
    """The place of a run with its neighbours."""
    return zlib.crc32(run.encode("utf-8", "surrogatepass")) >> (32 - BITS[3])


@dataclass
class CharModel:
    """Counts of the three orders and of runs."""

    tri: np.ndarray
    bi: np.ndarray
    uni: np.ndarray
    runs: np.ndarray

    def __getstate__(self) -> list[tuple]:
        """The tables, each as its places that aren't empty or as a whole, whichever is smaller, in the least type that holds it."""
        packed = []
        for table in (self.tri, self.bi, self.uni, self.runs):
            at = np.flatnonzero(table).astype(np.uint32)
            least = np.min_scalar_type(int(table.max(initial=0)))
            sparse = len(at) * (4 + least.itemsize) < len(table) * least.itemsize
            packed.append((len(table), at if sparse else None, table[at].astype(least) if sparse else table.astype(least)))
        return packed

    def __setstate__(self, packed: list[tuple]) -> None:
        tables = []
        for size, at, counts in packed:
            table = np.zeros(size, dtype=np.int64)
            table[slice(None) if at is None else at] = counts
            tables.append(table)
        self.__init__(*tables)

    def __post_init__(self) -> None:
        self.total = float(self.uni.sum())
        # Characters never seen share one part in a million.
        self.floor = 1e-6 / 1e5

    def log_probs(self, points: np.ndarray, owner: np.ndarray | None = None) -> np.ndarray:
        """The log probability of each point from the third on, given the two before.

        ``owner``: the points are of texts that were counted themselves, by number; what a text adds to the counts is
        taken out of its own probabilities.
        """
        if len(points) < 3:
            return np.zeros(0)
        (t, b, u), (two, one) = places(points), contexts(points)
        tri, bi, uni, bi_before, uni_before = self.tri[t], self.bi[b], self.uni[u], self.bi[two], self.uni[one]
        if owner is not None:
            own = owner[2:]
            times = [_multiplicity(own, at, bits) for at, bits in zip((t, b, u), BITS)]
            # What stands before a point was itself a point, but for a text's first ones, whose edges are left in.
            before = [np.concatenate([[0], x[:-1]]) * (own == np.concatenate([[-1], own[:-1]])) for x in times[1:]]
            tri, bi, uni, bi_before, uni_before = (
                np.maximum(n - x, 0) for n, x in zip((tri, bi, uni, bi_before, uni_before), (*times, *before))
            )
        p1 = (1 - 1e-6) * uni / max(self.total, 1.0) + self.floor
        p2 = (bi + SMOOTH * p1) / (uni_before + SMOOTH)
        p3 = (tri + SMOOTH * p2) / (bi_before + SMOOTH)
        # Hashed counts of an n-gram may exceed its context's by collisions.
        return np.log(np.minimum(p3, 1.0))

    def without(self, part: CharModel) -> CharModel:
        """The model of the texts that are left without those of ``part``, which are among its own."""
        return CharModel(self.tri - part.tri, self.bi - part.bi, self.uni - part.uni, self.runs - part.runs)

    def occurrences(self, chars: str) -> np.ndarray:
        """How often each character occurs."""
        return self.uni[codes(chars) & np.uint32((1 << BITS[2]) - 1)]

    def scores(self, texts: list[str]) -> np.ndarray:
        """The log probability of each text from its third character on, all in one pass."""
        if not texts:
            return np.zeros(0)
        sums = np.concatenate([[0.0, 0.0, 0.0], np.cumsum(self.log_probs(codes("".join(texts))))])
        ends = np.cumsum([len(t) for t in texts])
        starts = ends - [len(t) for t in texts]
        # sums[i + 1] is the sum up to character i; a text's own trigrams begin at its third character.
        return sums[ends] - sums[np.minimum(starts + 2, ends)]


def counted(texts: Iterator[list[str]]) -> Iterator[pa.RecordBatch]:
    """(level, place, n): the counts of all texts."""
    sums = [np.zeros(1 << bits, dtype=np.int64) for bits in BITS]
    for part in texts:
        framed = [EDGE + EDGE + t + EDGE for t in part]
        # All texts as one row of points; the edges keep the texts apart, and what ends in two of them is of no text.
        points = codes("".join(framed))
        if len(points) < 3:
            continue
        edge = points == ord(EDGE)
        within = ~(edge[2:] & edge[1:-1])
        for total, at in zip(sums, places(points)):
            total += np.bincount(at[within], minlength=len(total))
        for text in framed:
            if not text.isascii():
                for m in RUN.finditer(text):
                    sums[3][run_place(m[1])] += 1
    for level, total in enumerate(sums):
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), level), pa.int32()), pa.array(at), pa.array(total[at])], names=["level", "place", "n"]
            )


def counts(texts: DataFrame, column: str, change: Callable[[list[str]], list[str]] | None = None, fold: str | None = None) -> DataFrame:
    """(fold, level, place, n): the counts of all non-null texts of a column, or of what ``change`` makes of them, by the
    values of the column ``fold`` (0 without one)."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[str]]]:
        for batch in batches:
            of = batch.column(1).to_numpy()
            for k in np.unique(of):
                yield int(k), batch.column(0).filter(pa.array(of == k)).to_pylist()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, group in groupby(parts(batches), itemgetter(0)):
            own = (t for _, t in group)
            for batch in counted(map(change, own) if change else own):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(batch), k), pa.int32()), *batch.columns], names=["fold", *batch.schema.names])

    of = F.col(fold).cast("int") if fold else F.lit(0)
    thin = texts.where(F.col(column).isNotNull()).select(F.col(column).alias("text"), of.alias("fold"))
    return thin.mapInArrow(count, "fold int, level int, place bigint, n bigint").groupBy("fold", "level", "place").agg(F.sum("n").alias("n"))


def collected(counts: DataFrame) -> CharModel:
    """The model of the counts (level, place, n), each place once. What comes to the driver is bounded by ``BITS``."""
    sums = counts.select("level", "place", "n").toArrow()
    tables = [np.zeros(1 << bits, dtype=np.int64) for bits in BITS]
    level, place, n = (sums.column(i).to_numpy() for i in range(3))
    for at, total in enumerate(tables):
        own = level == at
        total[place[own]] = n[own]
    return CharModel(*tables)


def train(texts: DataFrame, column: str, change: Callable[[list[str]], list[str]] | None = None) -> CharModel:
    """The model of all non-null texts of a column, or of what ``change`` makes of them."""
    return collected(counts(texts, column, change))
