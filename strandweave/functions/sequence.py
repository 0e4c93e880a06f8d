"""Nucleotide sequences as Column expressions.

A sequence's bases become hexadecimal digits, one bit for each of A, C, G and T, so that ambiguity codes are unions and
two bases agree if their digits share a bit. Fifteen digits fit one long, on which comparisons are a few bit
operations, inside generated code.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: The nucleotide codes, their complements, and their digits (A 1, C 2, G 4, T 8; a gap has no bit).
CODES = "ACGTRYSWKMBDHVN-"
DIGITS = "12485A69C3EDB7F0"
COMPLEMENT_FROM = "ACGTNRYSWKMBDHV"
COMPLEMENT_TO = "TGCANYRWSMKVHDB"
#: The base sets of the digits, in the order A, C, G, T; and the code of each set.
BASES_OF = {c: "".join(b for i, b in enumerate("ACGT") if int(d, 16) >> i & 1) for c, d in zip(CODES, DIGITS)}
CODE_OF = {int(d, 16): c for c, d in zip(CODES, DIGITS)}
ALPHABET = "^[ACGTRYSWKMBDHVN-]*$"
STRICT = "^[ACGTacgt]*$"
_CHUNK = 15
#: The rows of a list of sequences that ride along as a literal.
LIST_ROWS = 10_000
_ONES = int("1" * _CHUNK, 16)


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def checked(sequence: str | Column) -> Column:
    """The sequence in upper case; an error if it holds anything but nucleotide codes."""
    s = F.upper(_c(sequence))
    return F.when(s.isNull() | s.rlike(ALPHABET), s).otherwise(F.raise_error(F.concat(F.lit("unknown nucleotide in "), s)))


def complement(sequence: str | Column, reverse: bool = False) -> Column:
    """The complement, in upper case, reversed on demand; an error on gaps and unknown codes; null of null."""
    s = F.upper(_c(sequence))
    fine = F.when(s.isNull() | s.rlike("^[ACGTNRYSWKMBDHV]*$"), s).otherwise(F.raise_error(F.concat(F.lit("no complement for "), s)))
    out = F.translate(fine, COMPLEMENT_FROM, COMPLEMENT_TO)
    return F.reverse(out) if reverse else out


def digits(sequence: str | Column) -> Column:
    """One hexadecimal digit per base."""
    return F.translate(checked(sequence), CODES, DIGITS)


def packed(sequence: str | Column) -> Column:
    """The digits as longs of fifteen bases each, the last one shorter."""
    # The digits are bound as the element of an array, or each chunk would derive them again.
    def chunks(d: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.floor((F.char_length(d) - 1) / _CHUNK), F.lit(0)).cast("int"))
        return F.transform(starts, lambda i: F.coalesce(F.conv(F.substring(d, i * _CHUNK + 1, F.lit(_CHUNK)), 16, 10).cast("bigint"), F.lit(0)))

    return F.element_at(F.transform(F.array(digits(sequence)), chunks), 1)


def _agreeing(a: Column, b: Column) -> Column:
    """How many bases of two packed longs share a bit."""
    m = a.bitwiseAND(b)
    folded = m.bitwiseOR(F.shiftright(m, 1)).bitwiseOR(F.shiftright(m, 2)).bitwiseOR(F.shiftright(m, 3))
    return F.bit_count(folded.bitwiseAND(F.lit(_ONES)))


def fixed_packed(sequence: Column, length: int) -> list[Column]:
    """The longs of a sequence in upper case that is known to have that length, as columns of generated code."""
    d = F.translate(sequence, CODES, DIGITS)
    return [F.conv(F.substring(d, at + 1, min(_CHUNK, length - at)), 16, 10).cast("bigint") for at in range(0, length, _CHUNK)]


def packed_agreement(a: list[Column], b: list[Column]) -> Column:
    """How many bases of two lists of packed longs share a bit."""
    return sum((_agreeing(x, y) for x, y in zip(a, b)), F.lit(0))


def packed_mismatch(a: list[Column], b: list[Column], length: int) -> list[Column]:
    """For each position whether the bases of two lists of packed longs share no bit."""
    apart = []
    for i in range(length):
        chunk, at = divmod(i, _CHUNK)
        shift = 4 * (min(_CHUNK, length - chunk * _CHUNK) - 1 - at)
        apart.append(F.shiftright(a[chunk].bitwiseAND(b[chunk]), shift).bitwiseAND(F.lit(15)) == 0)
    return apart


def packed_hamming(a: Column, b: Column, length: Column) -> Column:
    """The Hamming distance of two packed sequences of a common length."""
    return length - F.aggregate(F.zip_with(a, b, _agreeing), F.lit(0), lambda acc, x: acc + x)


def hamming(a: str | Column, b: str | Column) -> Column:
    """The positions at which two sequences share no base; an error on different lengths; null if either is null."""
    a, b = _c(a), _c(b)
    same = F.when(F.char_length(a) == F.char_length(b), F.char_length(a)).otherwise(
        F.when(a.isNotNull() & b.isNotNull(), F.raise_error(F.lit("sequences must have equal length")).cast("int"))
    )
    return packed_hamming(packed(a), packed(b), same)


def cigar(reference: str | Column, query: str | Column, mismatch: bool = False) -> Column:
    """The CIGAR string of two aligned sequences with gaps as ``-``.

    ``I`` where the reference has the gap, ``D`` where the query has, else ``M``, or ``X`` with ``mismatch`` where the
    bases share nothing. An error on different lengths, gaps in both, or unknown codes.
    """
    r, q = _c(reference), _c(query)
    rd, qd = F.translate(r, CODES, DIGITS), F.translate(q, CODES, DIGITS)
    fine = (F.char_length(r) == F.char_length(q)) & r.rlike(ALPHABET) & q.rlike(ALPHABET)
    bit = lambda d: F.conv(d, 16, 10).cast("int")

    def state(x: Column, y: Column) -> Column:
        out = F.when((x == "0") & (y == "0"), F.raise_error(F.lit("gaps in both sequences"))).when(x == "0", "I").when(y == "0", "D")
        if mismatch:
            out = out.when(bit(x).bitwiseAND(bit(y)) == 0, "X")
        return out.otherwise("M")

    states = F.array_join(F.zip_with(F.split(rd, ""), F.split(qd, ""), state), "")
    runs = F.regexp_extract_all(states, F.lit("(M+|I+|D+|X+)"), F.lit(1))
    out = F.array_join(F.transform(runs, lambda x: F.concat(F.char_length(x).cast("string"), F.substring(x, 1, 1))), "")
    return F.when(r.isNull() | q.isNull(), F.lit(None)).when((r == "") & (q == ""), "").when(fine, out).otherwise(F.raise_error(F.lit("sequences must be nucleotides of equal length")))


def quality_values(quality: str | Column) -> Column:
    """The Phred+33 values of a quality string."""
    q = _c(quality)
    return F.when(F.char_length(q) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.split(q, ""), lambda c: F.ascii(c) - 33))


def quality_probs(quality: str | Column) -> Column:
    """The error probabilities of a quality string."""
    return F.transform(quality_values(quality), lambda v: F.pow(F.lit(10.0), -v / 10.0))


def disambiguate(sequence: str | Column) -> Column:
    """All concrete sequences that an ambiguous one stands for; of those, the first position varies fastest.

    The array has the product of the positions' bases as its size; a gap stands for none, so that it becomes empty.
    """
    s = checked(sequence)
    bases = F.create_map(*[x for c, b in BASES_OF.items() for x in (F.lit(c), F.array(*[F.lit(y) for y in b]).cast("array<string>"))])
    letters = F.filter(F.split(s, ""), lambda x: x != "")
    start = F.array(F.lit(""))
    return F.aggregate(letters, start, lambda acc, x: F.flatten(F.transform(F.element_at(bases, x), lambda b: F.transform(acc, lambda p: F.concat(p, b)))))


def likely_code(a: Column, c: Column, g: Column, t: Column, ambiguous: bool = False) -> Column:
    """The base of the largest weight, the first of A, C, G, T on ties, or with ``ambiguous`` the code of all of them."""
    best = F.greatest(a, c, g, t)
    if not ambiguous:
        return F.when(a == best, "A").when(c == best, "C").when(g == best, "G").otherwise("T")
    mask = sum(F.when(x == best, F.lit(1 << i)).otherwise(F.lit(0)) for i, x in enumerate((a, c, g, t)))
    return F.element_at(F.create_map(*[x for m, code in CODE_OF.items() for x in (F.lit(m), F.lit(code))]), mask)


def _edit_distance(a: str, b: str) -> int:
    """Edit distance in which codes that share a base agree; other characters agree with themselves only."""
    bit = {c: int(d, 16) for c, d in zip(CODES, DIGITS)}
    x, y = (np.array([bit.get(c, 0) for c in t], dtype=np.int64) for t in (a, b))
    same = (x[:, None] & y[None, :]) > 0
    other = np.frombuffer(b.encode("utf-32-le"), dtype=np.uint32)
    for i, c in enumerate(a):
        if c not in bit:
            same[i] |= other == ord(c)
    row, steps = np.arange(len(b) + 1), np.arange(len(b) + 1)
    for i in range(len(a)):
        new = np.concatenate([[i + 1], np.minimum(row[1:] + 1, row[:-1] + ~same[i])])
        row = np.minimum.accumulate(new - steps) + steps
    return int(row[-1])


@F.pandas_udf(IntegerType())
def _edit_distances(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series([None if x is None or y is None else _edit_distance(x, y) for x, y in zip(a, b)], dtype="Int32")


def levenshtein(a: str | Column, b: str | Column, ambiguous: bool = True) -> Column:
    """The edit distance. With ``ambiguous``, codes that share a base agree; plain sequences stay on the JVM."""
    a, b = _c(a), _c(b)
    if not ambiguous:
        return F.levenshtein(a, b)
    plain = a.rlike(r"^[ACGT]*\z") & b.rlike(r"^[ACGT]*\z")
    # Python is given nulls where the built-in function does, so that it has nothing to do for them.
    coded = _edit_distances(F.when(~plain, a), F.when(~plain, b))
    return F.when(plain, F.levenshtein(a, b)).otherwise(coded)


def hamming_to_list(sequence: str | Column, others: list[str]) -> Column:
    """The Hamming distances of a sequence to a list of sequences, in the list's order; an error on different lengths."""
    # The sequence is bound as the element of an array, so that its digits are derived once for the whole list.
    listed = F.array(*[F.lit(o) for o in others]).cast("array<string>")
    return F.transform(listed, lambda o: hamming(_c(sequence), o))


def hamming_matrix(rows: DataFrame, key: str, sequence: str, others: DataFrame, other_key: str, other: str) -> DataFrame:
    """(key, other_key, distance): every row's sequence with every one of ``others``.

    ``others`` is a list of at most ``LIST_ROWS`` rows, which is checked and then sent along with the rows; larger ones
    go in blocks of that size, each a pass over ``rows``. Null sequences have null distances.
    """
    named = others.select(F.col(other_key).alias("k"), F.col(other).alias("s"))
    blocks = max(1, -(-named.count() // LIST_ROWS))
    out = None
    for i in range(blocks):
        part = named if blocks == 1 else named.where(F.pmod(F.xxhash64("k", "s"), F.lit(blocks)) == i)
        listed = [(r.k, r.s) for r in part.collect()]
        kind = dict(named.dtypes)["k"]
        pairs = F.from_json(F.lit(json.dumps([{"k": k, "s": s} for k, s in listed], default=str)), f"array<struct<k:{kind},s:string>>")
        each = rows.select(F.col(key).alias("_key"), F.col(sequence).alias("_s"), F.explode(pairs).alias("_o"))
        met = each.select(F.col("_key").alias(key), F.col("_o.k").alias(other_key), hamming("_s", "_o.s").alias("distance"))
        out = met if out is None else out.unionByName(met)
    return out


def hamming_pairwise(rows: DataFrame, key: str, sequence: str) -> DataFrame:
    """(i, j, distance): the symmetric distances of all rows of a list; ``key`` is unique and ordered.

    The full matrix is what is asked for; each pair is compared once, and the list goes in blocks as in ``hamming_matrix``.
    """
    half = hamming_matrix(rows, key, sequence, rows.select(F.col(key).alias("_j"), sequence), "_j", sequence)
    half = half.where(F.col(key) <= F.col("_j")).select(F.col(key).alias("i"), F.col("_j").alias("j"), "distance")
    return half.select(F.explode(F.when(F.col("i") < F.col("j"), F.array(F.struct("i", "j", "distance"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "distance"))).otherwise(F.array(F.struct("i", "j", "distance")))).alias("p")).select("p.*")
