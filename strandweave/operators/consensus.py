"""Consensus sequences of groups of reads.

Which reads a consensus is called from depends on the consensus itself, round after round; this loop runs in a numpy
kernel per group. Reads of a group with equal sequence and qualities are counted before they are moved, on the map side
first, so that a kernel holds distinct reads, weighted by their number.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.errors import SequenceError
from strandweave.functions.sequence import CODE_OF, CODES, DIGITS

_MASK = np.zeros(256, dtype=np.uint8)
for _code, _digit in zip(CODES, DIGITS):
    _MASK[ord(_code)] = _MASK[ord(_code.lower())] = int(_digit, 16)
_KNOWN = np.isin(np.arange(256), [ord(c) for c in CODES + CODES.lower()])
_BITS = np.array([1, 2, 4, 8], dtype=np.uint8)


def _encoded(sequences: Sequence[str], qualities: Sequence[Sequence[int] | str]) -> tuple[np.ndarray, np.ndarray]:
    """Bit masks and qualities, [sequences, longest]; a Phred+33 string stands for its values."""
    lengths = np.array([len(s) for s in sequences])
    if not (lengths == [len(q) for q in qualities]).all():
        raise SequenceError("each sequence needs as many qualities as it has bases")
    chars = np.frombuffer("".join(sequences).encode("latin-1", "replace"), dtype=np.uint8)
    if not _KNOWN[chars].all():
        raise SequenceError(f"unknown nucleotide {chr(chars[~_KNOWN[chars]][0])}")
    inside = np.arange(lengths.max()) < lengths[:, None]
    masks, weights = np.zeros(inside.shape, dtype=np.uint8), np.zeros(inside.shape, dtype=np.int64)
    masks[inside] = _MASK[chars]
    if isinstance(qualities[0], str):
        weights[inside] = np.frombuffer("".join(qualities).encode("latin-1"), dtype=np.uint8).astype(np.int64) - 33
    else:
        weights[inside] = [v for q in qualities for v in q]
    return masks, weights


def _weights_of(masks: np.ndarray, weights: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """[4, length]: the summed qualities of each base, each sequence as often as it counts."""
    return np.stack([counts @ np.where(masks & bit, weights, 0) for bit in _BITS])


def _median(weights: np.ndarray, counts: np.ndarray) -> float:
    """The median of all qualities, padding included, each sequence as often as it counts."""
    values, times = weights.ravel(), np.repeat(counts, weights.shape[1])
    order = np.argsort(values, kind="stable")
    upto = np.cumsum(times[order])
    middle = [(upto[-1] - 1) // 2, upto[-1] // 2]
    return float(values[order][np.searchsorted(upto, middle, side="right")].mean())


def _most_likely(by_base: np.ndarray) -> np.ndarray:
    """The mask of all bases of the largest weight, per position."""
    return ((by_base == by_base.max(axis=0)) * _BITS[:, None]).sum(axis=0).astype(np.uint8)


def _text(by_base: np.ndarray, ambiguous: bool) -> str:
    if ambiguous:
        return "".join(CODE_OF[int(m)] for m in _most_likely(by_base))
    return "".join("ACGT"[i] for i in by_base.argmax(axis=0))


def call_consensus(
    sequences: Sequence[str],
    qualities: Sequence[Sequence[int] | str] | None = None,
    q_threshold: float | None = None,
    proportion: float = 0.05,
    allow_ambiguous: bool = False,
    counts: Sequence[int] | None = None,
) -> tuple[list[str], list[int], list[list[int]]]:
    """Consensuses, the consensus number of each sequence, and the consensuses' qualities.

    In rounds: the bases of the largest summed quality make a consensus (ties keep all); sequences whose qualities at
    disagreeing positions sum to at most ``q_threshold`` x length x ``proportion``, or to the least such sum, are
    assigned to it, and it is called again from these; the others go on to the next round. Shorter sequences are
    padded with bases that agree with nothing and cost nothing. Without a threshold the median of the padded qualities
    is it; without qualities all are 1. Equal consensuses of different rounds are one. Consensuses are numbered by the
    sequences assigned, most first, ties by first appearance. Of tied bases the first of A, C, G, T is given, or
    with ``allow_ambiguous`` their code. ``counts`` says how often each sequence occurs with its qualities, by default once.
    """
    if qualities is None:
        qualities, q_threshold = [[1] * len(s) for s in sequences], 1
    if len(sequences) != len(qualities):
        raise SequenceError("as many qualities as sequences are needed")
    if not len(sequences):
        return [], [], []
    masks, weights = _encoded(sequences, qualities)
    times = np.ones(len(sequences), dtype=np.int64) if counts is None else np.asarray(counts, dtype=np.int64)
    limit = (q_threshold or _median(weights, times)) * masks.shape[1] * proportion
    labels: dict[str, int] = {}
    label_of = np.zeros(len(sequences), dtype=np.int64)
    rest = np.arange(len(sequences))
    while len(rest):
        m, w, n = masks[rest], weights[rest], times[rest]
        if n.sum() == 1:
            by_base, chosen = np.stack([(m[0] & bit > 0).astype(np.int64) for bit in _BITS]), np.array([True])
        else:
            guess = _most_likely(_weights_of(m, w, n))
            cost = np.where(m & guess, 0, w).sum(axis=1)
            chosen = cost <= max(limit, cost.min())
            by_base = _weights_of(m[chosen], w[chosen], n[chosen])
        label_of[rest[chosen]] = labels.setdefault(_text(by_base, allow_ambiguous), len(labels))
        rest = rest[~chosen]
    held: Counter = Counter()
    for label, n in zip(label_of.tolist(), times.tolist()):
        held[label] += n
    order = [label for label, _ in held.most_common()]
    texts = list(labels)
    number = {label: i for i, label in enumerate(order)}
    consensuses = [texts[label] for label in order]
    out_qualities = []
    for label in order:
        own = label_of == label
        agree = masks[own] & _MASK[np.frombuffer(texts[label].encode(), dtype=np.uint8)] > 0
        out_qualities.append(np.where(agree, weights[own], 0).max(axis=0).tolist())
    return consensuses, [number[x] for x in label_of.tolist()], out_qualities


def consensus_by_group(
    rows: DataFrame, group: str, order: str, sequence: str, quality: str | None = None, q_threshold: float | None = None, proportion: float = 0.05, allow_ambiguous: bool = False
) -> DataFrame:
    """(group, consensus_no, consensus, consensus_quality, n_sequences) of each group's sequences.

    ``order`` says what a first appearance is; ``quality`` is a Phred+33 string, and so is the consensus's. Null
    sequences are left out. A group's distinct reads are held in one task's memory, as each round compares all of them.
    """
    kind = dict(rows.dtypes)[group]
    thin = rows.where(F.col(sequence).isNotNull()).select(
        F.col(group).alias("g"), F.col(order).alias("o"), F.col(sequence).alias("s"), (F.col(quality) if quality else F.lit(None).cast("string")).alias("q")
    )
    distinct = thin.groupBy("g", "s", "q").agg(F.min("o").alias("o"), F.count(F.lit(1)).alias("n"))

    def call(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["o", "s", "q"], kind="stable")
        times = pdf["n"].tolist()
        texts, numbers, qualities = call_consensus(pdf["s"].tolist(), pdf["q"].tolist() if quality else None, q_threshold, proportion, allow_ambiguous, times)
        counts = np.bincount(numbers, weights=times, minlength=len(texts)).astype(np.int64)
        return pd.DataFrame(
            {
                "g": [pdf["g"].iloc[0]] * len(texts),
                "consensus_no": range(len(texts)),
                "consensus": texts,
                "consensus_quality": ["".join(map(chr, np.array(q) + 33)) for q in qualities],
                "n_sequences": counts,
            }
        )

    out = distinct.groupBy("g").applyInPandas(call, f"g {kind}, consensus_no int, consensus string, consensus_quality string, n_sequences int")
    return out.withColumnRenamed("g", group)


def positional_weights(rows: DataFrame, group: str, sequence: str, quality: str) -> DataFrame:
    """(group, position, a, c, g, t): the summed qualities of each base at each 0-based position, as built-in aggregates."""
    from strandweave.functions.sequence import digits, quality_values

    each = rows.select(group, F.posexplode(F.arrays_zip(F.split(digits(sequence), "").alias("d"), quality_values(quality).alias("q"))).alias("position", "x"))
    mask = F.conv(F.col("x.d"), 16, 10).cast("int")
    sums = [F.sum(F.when(mask.bitwiseAND(F.lit(bit)) > 0, F.col("x.q")).otherwise(0)).cast("bigint").alias(b) for b, bit in zip("acgt", (1, 2, 4, 8))]
    return each.where(F.col("x.d") != "").groupBy(group, "position").agg(*sums)
