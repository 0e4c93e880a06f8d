"""Correcting sequences to a whitelist.

Work is done per distinct sequence. Exact matches are an equi-join; near ones are equi-joins, too: both sides are
turned into keys with up to ``d`` positions masked, the concrete forms of a few ambiguous codes included, so that
sequences within the distance share a key. Sequences that stand for more than ``FORMS`` concrete ones (a failed read
may be all N) are not expanded: they are compared with the whitelist as bit masks, block by block of the whitelist.
Candidates are then compared exactly, as packed longs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave.functions.sequence import ALPHABET, CODES, DIGITS, disambiguate, fixed_packed, packed_agreement, packed_mismatch

MASKED = "_"
#: The concrete forms up to which a sequence is expanded into keys.
FORMS = 64
#: The whitelist sequences of a block that is compared as bit masks; it bounds what is broadcast.
BLOCK = 1 << 20
#: The whitelist's rows, and its masked keys, up to which a join broadcasts them; beyond, Spark joins by shuffle.
SMALL_LIST, SMALL_KEYS = 100_000, 1_000_000
_SIZES = {c: max(1, int(d, 16).bit_count()) for c, d in zip(CODES, DIGITS)}
_NIBBLE = np.zeros(128, dtype=np.uint64)
_NIBBLE[[ord(c) for c in CODES]] = [int(d, 16) for d in DIGITS]


@dataclass
class Whitelist:
    """The distinct sequences (w) of a whitelist, their common length and their number."""

    rows: DataFrame
    length: int
    size: int

    def near(self, df: DataFrame, rows: int, limit: int) -> DataFrame:
        """The frame, broadcast if the whitelist is known to make it small."""
        return F.broadcast(df) if rows <= limit else df


def _masked(sequence: Column, length: int, d: int) -> Column:
    """Every form of a sequence with exactly min(d, length) positions masked."""
    forms = []
    for positions in combinations(range(length), min(d, length)):
        parts, at = [], 0
        for p in positions:
            parts += [F.substring(sequence, at + 1, p - at), F.lit(MASKED)]
            at = p + 1
        forms.append(F.concat(*parts, F.substring(sequence, at + 1, length - at)))
    return F.array(*forms) if forms else F.array(sequence)


def _forms(sequence: Column) -> Column:
    """The number of concrete sequences that one stands for, gaps not counted, as a double."""
    n = F.lit(1.0)
    for size in sorted(set(_SIZES.values()) - {1}):
        codes = "".join(c for c, k in _SIZES.items() if k == size)
        n = n * F.pow(F.lit(float(size)), F.char_length(F.regexp_replace(sequence, f"[^{codes}]", "")))
    return n


def checked_whitelist(whitelist: DataFrame, column: str) -> Whitelist:
    """The whitelist's distinct sequences; an error if it is empty, of several lengths, or not of nucleotide codes."""
    wl = whitelist.where(F.col(column).isNotNull()).select(F.upper(column).alias("w")).distinct()
    shape = wl.agg(
        F.min(F.char_length("w")).alias("lo"), F.max(F.char_length("w")).alias("hi"), F.bool_and(F.col("w").rlike(ALPHABET)).alias("fine"), F.count(F.lit(1)).alias("n")
    ).first()
    if shape.lo is None:
        raise ValueError("the whitelist is empty")
    if shape.lo != shape.hi or not shape.fine:
        raise ValueError("the whitelist must hold nucleotide sequences of one length")
    return Whitelist(wl, shape.lo, shape.n)


def _bits(sequences: list[str], length: int) -> np.ndarray:
    """[sequences, chunks]: sixteen bases to a word, a nibble each."""
    chars = np.frombuffer("".join(sequences).encode("ascii"), dtype=np.uint8).reshape(len(sequences), length)
    nibbles = np.zeros((len(sequences), -(-length // 16) * 16), dtype=np.uint64)
    nibbles[:, :length] = _NIBBLE[chars]
    shifts = np.arange(16, dtype=np.uint64) * np.uint64(4)
    return (nibbles.reshape(len(sequences), -1, 16) << shifts).sum(axis=2, dtype=np.uint64)


def _compared(sequences: DataFrame, listed: list[str], length: int, d: int) -> DataFrame:
    """(s, w, mismatches) of all sequences with all listed ones, within ``d``; as bit masks, vectorised over the list."""
    shared = sequences.sparkSession.sparkContext.broadcast((pa.array(listed), _bits(listed, length)))
    ones = np.uint64(0x1111111111111111)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, bits = shared.value
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for text, own in zip(texts, _bits(texts, length)) if texts else ():
                m = bits & own
                m |= m >> np.uint64(1)
                m |= m >> np.uint64(2)
                apart = length - np.bitwise_count(m & ones).sum(axis=1, dtype=np.int64)
                at = np.flatnonzero(apart <= d)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array([text] * len(at)), names.take(pa.array(at)), pa.array(apart[at], pa.int32())], names=["s", "w", "mismatches"])

    return sequences.select("s").mapInArrow(compare, "s string, w string, mismatches int")


def _blocks(whitelist: DataFrame, size: int) -> Iterator[list[str]]:
    """The whitelist in blocks of about ``BLOCK`` sequences."""
    n = max(1, -(-size // BLOCK))
    for i in range(n):
        part = whitelist if n == 1 else whitelist.where(F.pmod(F.xxhash64("w"), F.lit(n)) == i)
        if listed := [r.w for r in part.select("w").collect()]:
            yield listed


def candidates(sequences: DataFrame, whitelist: Whitelist, d: int) -> DataFrame:
    """(s, w, mismatches): whitelist sequences within ``d`` mismatches of each distinct sequence of the whitelist's length.

    Most meet by masked keys. Pairs with a side of more than ``FORMS`` concrete forms are compared as bit masks: such
    sequences with the whole whitelist, and all others with the whitelist's own such members, block by block.
    """
    length = whitelist.length
    sided = sequences.select("s", _forms(F.col("s")).alias("forms"))
    listed = whitelist.rows.select("w", _forms(F.col("w")).alias("forms"))
    narrow = lambda df: df.where(F.col("forms") <= FORMS)

    def keyed(df: DataFrame, c: str) -> DataFrame:
        # A gap agrees with nothing: it is put back into the forms, and keys that still show one are shared by none.
        gapped = F.transform(disambiguate(F.translate(F.col(c), "-", "A")), lambda x: _with_gaps(x, F.col(c), length))
        forms = F.when(F.contains(F.col(c), F.lit("-")), gapped).when(F.col("forms") > 1, disambiguate(F.col(c))).otherwise(F.array(c))
        keys = F.flatten(F.transform(forms, lambda x: _masked(x, length, d)))
        return df.select(c, F.explode(F.array_distinct(keys)).alias("k")).where(~F.contains(F.col("k"), F.lit("-")))

    packed = lambda df, c, p: df.withColumns({f"{p}{i}": x for i, x in enumerate(fixed_packed(F.col(c), length))})
    left = packed(keyed(narrow(sided), "s"), "s", "a")
    right = whitelist.near(packed(keyed(narrow(listed), "w"), "w", "b"), whitelist.size * max(1, len(list(combinations(range(length), min(d, length))))), SMALL_KEYS)
    chunks = range(-(-length // 15))
    apart = length - packed_agreement([F.col(f"a{i}") for i in chunks], [F.col(f"b{i}") for i in chunks])
    met = left.join(right, "k").select("s", "w", apart.cast("int").alias("mismatches")).where(F.col("mismatches") <= d).distinct()
    wide = sided.where(F.col("forms") > FORMS)
    for block in _blocks(whitelist.rows, whitelist.size):
        met = met.unionByName(_compared(wide, block, length, d))
    broad = listed.where(F.col("forms") > FORMS)
    n_broad = broad.count()
    if n_broad:
        for block in _blocks(broad, n_broad):
            met = met.unionByName(_compared(narrow(sided), block, length, d))
    return met


def _with_gaps(form: Column, sequence: Column, length: int) -> Column:
    """A concrete form with the sequence's gaps put back in."""
    return F.concat(*[F.when(F.substring(sequence, i + 1, 1) == "-", F.lit("-")).otherwise(F.substring(form, i + 1, 1)) for i in range(length)])


def correct_simple(sequences: DataFrame, column: str, whitelist: DataFrame, whitelist_column: str, d: int = 1) -> DataFrame:
    """(sequence, corrected) per distinct sequence.

    A whitelist member stays; else the only member without a mismatch is taken, else the only one within ``d``; else
    null. Sequences must be nucleotide codes; those of another length than the whitelist's are not corrected. Nulls are
    left out.
    """
    wl = checked_whitelist(whitelist, whitelist_column)
    distinct = sequences.where(F.col(column).isNotNull()).select(F.upper(column).alias("s")).distinct()
    exact = distinct.join(wl.near(wl.rows.select(F.col("w").alias("exact")), wl.size, SMALL_LIST), F.col("s") == F.col("exact"), "left")
    open_ = exact.where(F.col("exact").isNull() & (F.char_length("s") == wl.length)).select("s")
    near = candidates(open_, wl, d).groupBy("s").agg(
        F.count(F.when(F.col("mismatches") == 0, 1)).alias("n_zero"), F.min(F.when(F.col("mismatches") == 0, F.col("w"))).alias("zero"),
        F.count(F.lit(1)).alias("n"), F.min("w").alias("one"),
    )
    best = F.when(F.col("n_zero") == 1, F.col("zero")).when((F.col("n_zero") == 0) & (F.col("n") == 1), F.col("one"))
    out = exact.join(near.select("s", best.alias("near")), "s", "left")
    return out.select(F.col("s").alias(column), F.coalesce("exact", "near").alias("corrected"))


def correct_posterior(
    reads: DataFrame, read_id: str, sequence: str, quality: str, whitelist: DataFrame, whitelist_column: str, d: int = 1, confidence: float = 0.95
) -> DataFrame:
    """(read_id, sequence, corrected) per read, by the posterior of its candidates.

    Exact members stay, and so does an only member without a mismatch. Counts of these are the prior, plus one for each
    member; members that share a sequence without mismatch share its reads. Each other read goes to the member with the
    largest prior times the error probabilities at its mismatches, if that member's share of the sum over all
    candidates reaches ``confidence``; the first in order on ties. Null sequences are left out. Reads of equal sequence
    and qualities are scored once; the quality of an N, at which nothing can mismatch but a gap, doesn't tell them apart.
    """
    wl = checked_whitelist(whitelist, whitelist_column)
    length, listed = wl.length, wl.near(wl.rows, wl.size, SMALL_LIST)
    rd = reads.where(F.col(sequence).isNotNull()).select(F.col(read_id).alias("id"), F.upper(sequence).alias("s"), F.col(quality).alias("q"))
    per = rd.groupBy("s").agg(F.count(F.lit(1)).alias("reads"))
    exact = per.join(listed, per.s == F.col("w")).select("s", "w", "reads")
    open_ = per.join(listed, per.s == F.col("w"), "left_anti").where(F.char_length("s") == length)
    found = candidates(open_.select("s"), wl, d)
    zero = found.where("mismatches = 0").withColumn("shared", F.count(F.lit(1)).over(Window.partitionBy("s"))).select("s", "w", "shared")
    settled = exact.select("s", "w").unionByName(zero.where("shared = 1").select("s", "w"))
    counted = (
        exact.select("w", F.col("reads").cast("double").alias("n"))
        .unionByName(zero.join(open_, "s").select("w", (F.col("reads") / F.col("shared")).alias("n")))
        .unionByName(wl.rows.select("w", F.lit(0.0).alias("n")))
        .groupBy("w").agg(F.sum("n").alias("n"))
    )
    whole = counted.agg((F.sum("n") + F.count(F.lit(1))).alias("t")).scalar()
    prior = wl.near(counted.select("w", F.log10((F.col("n") + 1) / whole).alias("prior")), wl.size, SMALL_LIST)
    gapped = wl.rows.where(F.contains(F.col("w"), F.lit("-"))).limit(1).count() > 0
    score = lambda i: F.ascii(F.substring("q", i + 1, 1)) - 33
    told = F.col("q") if gapped else F.concat(*[F.when(F.substring("s", i + 1, 1) == "N", F.lit("!")).otherwise(F.substring("q", i + 1, 1)) for i in range(length)])
    rd = rd.withColumn("told", F.when(F.char_length("s") == length, told))
    kinds = rd.join(settled, "s", "left_anti").where(F.char_length("s") == length).select("s", F.col("told").alias("q")).distinct()
    packs = {**{f"a{i}": x for i, x in enumerate(fixed_packed(F.col("s"), length))}, **{f"b{i}": x for i, x in enumerate(fixed_packed(F.col("w"), length))}}
    chunks = range(-(-length // 15))
    apart = packed_mismatch([F.col(f"a{i}") for i in chunks], [F.col(f"b{i}") for i in chunks], length)
    cost = sum((F.when(no, score(i)).otherwise(0) for i, no in enumerate(apart)), F.lit(0))
    scored = kinds.join(found.join(prior, "w").withColumns(packs), "s").withColumn("ll", F.col("prior") - cost / 10.0)
    ranked = scored.groupBy("s", "q").agg(F.max("ll").alias("best"), F.min_by("w", F.struct(-F.col("ll"), F.col("w"))).alias("w"), F.sum(F.pow(F.lit(10.0), "ll")).alias("mass"))
    sure = ranked.where(F.col("best") - F.log10("mass") >= F.log10(F.lit(confidence))).select("s", F.col("q").alias("told"), F.col("w").alias("likely"))
    out = rd.join(settled.withColumnRenamed("w", "settled"), "s", "left").join(sure, ["s", "told"], "left")
    return out.select(F.col("id").alias(read_id), F.col("s").alias(sequence), F.coalesce("settled", "likely").alias("corrected"))
