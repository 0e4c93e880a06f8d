"""Evaluation texts that leak into a corpus.

Texts become passages of 26 words, one from every 13th word on, so that any 13 consecutive words lie in one passage as
a whole. The passages of the evaluation items are weighted by TF-IDF, with document frequencies counted over the whole
corpus, and a randomised SVD, whose products are summed over the passages' partitions, gives their latent space. Every
passage of the corpus is projected there, and items whose passages have a high cosine to it become candidates. These
are compared word by word: the longest common run tells copied passages, the longest common subsequence and the share
of the passage's rare words and numbers (what an answer consists of) tell paraphrases.

No passage is multiplied with all of an item block's: two passages that share so many words as either check asks for
share one of the rarest few of them, which an inverted index over the item passages' words finds; only these pairs get
a cosine.

Items are cut into parts of a bounded number of words, and parts are handled in blocks of a bounded number of words,
each a pass over the corpus, so that what is broadcast has a bound whatever the items.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.session import delete_at_end, scratch_path

#: Fixed value: a word is a maximal run of letters and digits.
WORD = regex.compile(r"[\p{L}\p{N}]+")
#: The words that a copied passage has at least; a passage has twice as many.
RUN_WORDS = 13
#: The dimensions of the latent space, the extra ones of the sketch and the power iterations.
RANK, EXTRA, POWER = 256, 16, 2
#: The cosine from which an item is a candidate, and the length, as a share of the item passage's, under which a
#: projection counts as of that length (a passage of few weighty words is like anything).
COSINE, SHORT = 0.25, 0.5
#: The words of a part of an item, of which the next part repeats a passage's, and the words that a block aims at.
PART_WORDS, BLOCK_WORDS = 26_000, 1_000_000
#: A paraphrase shares this part of a passage's words in order, and this part of its rare words.
LCS_SHARE, ANSWER_SHARE = 0.6, 0.5
#: A word is rare in up to so many documents, or one in a thousand.
RARE = 5
_SLICE, _PAIRS = 2048, 32768
#: The words that a task counts before it passes the counts on.
COUNTED_WORDS = 200_000
#: The spellings that a task remembers the number of; it starts anew beyond them.
REMEMBERED = 500_000


def words(text: str) -> list[str]:
    """The words of a text, lower-cased."""
    return [w.lower() for w in WORD.findall(text)]


def windows(n: int) -> list[tuple[int, int]]:
    """The passages of a text of n words as ranges."""
    return [(s, min(s + 2 * RUN_WORDS, n)) for s in range(0, max(n - RUN_WORDS, 0) + 1, RUN_WORDS)] if n else []


def parts_of(ws: list[str]) -> list[list[str]]:
    """The words of an item in parts that hold all of its passages; most items are one part."""
    step = PART_WORDS - RUN_WORDS
    return [ws[s : s + PART_WORDS] for s in range(0, max(len(ws) - RUN_WORDS, 1), step)]


def lcs_length(a: list[int], b: list[int]) -> int:
    """The length of the longest common subsequence, by bit-parallel dynamic programming."""
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    row = (1 << len(a)) - 1
    for x in b:
        both = row & at.get(x, 0)
        row = (row + both) | (row - both)
    return len(a) - (row & ((1 << len(a)) - 1)).bit_count()


def longest_run(a: list[int], b: list[int]) -> int:
    """The length of the longest run of words that both have; negative numbers equal nothing."""
    best, last = 0, {}
    at: dict[int, list[int]] = {}
    for j, y in enumerate(b):
        if y >= 0:
            at.setdefault(y, []).append(j)
    for x in a:
        now = {j: last.get(j - 1, 0) + 1 for j in at.get(x, ())}
        best = max(best, max(now.values(), default=0))
        last = now
    return best


@dataclass
class ItemIndex:
    """The items of a block: their words as numbers, and their passages in latent space."""

    ids: list
    words: list[list[int]]
    numbers: dict[str, int]
    weights: np.ndarray
    basis: np.ndarray
    passages: list[tuple[int, int, int]]
    latent: np.ndarray
    lengths: np.ndarray
    rare: np.ndarray
    codes: np.ndarray | None = None
    starts: np.ndarray | None = None
    holders: np.ndarray | None = None


def _vectors(parts: list[list[int]], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The TF-IDF entries of passages, sorted by passage: passage, word, weight; unknown words have none."""
    row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    word = np.fromiter((w for p in parts for w in p), dtype=np.int64, count=len(row))
    known = word >= 0
    cells, times = np.unique(row[known] * len(weights) + word[known], return_counts=True)
    row, word = np.divmod(cells, len(weights))
    return row, word, ((1.0 + np.log(times)) * weights[word]).astype(np.float32)


def project(parts: list[list[int]], weights: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The passages' TF-IDF vectors times a matrix of a row per word."""
    out = np.zeros((len(parts), basis.shape[1]), dtype=np.float32)
    for at in range(0, len(parts), _SLICE):
        row, word, value = _vectors(parts[at : at + _SLICE], weights)
        if len(row):
            starts = np.flatnonzero(np.diff(row, prepend=-1))
            out[at + row[starts]] = np.add.reduceat(basis[word] * value[:, None], starts, axis=0)
    return out


def _summed(passages: DataFrame, weights: np.ndarray, basis: np.ndarray, gram: bool) -> np.ndarray:
    """A'(AB) of the passages' matrix A, or (AB)'(AB), summed over partitions."""
    shared = passages.sparkSession.sparkContext.broadcast((weights, basis))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, basis = shared.value
        total = np.zeros((basis.shape[1] if gram else len(weights), basis.shape[1]), dtype=np.float64)
        for batch in batches:
            parts = batch.column(0).to_pylist()
            y = project(parts, weights, basis)
            if gram:
                total += y.T.astype(np.float64) @ y
            else:
                row, word, value = _vectors(parts, weights)
                np.add.at(total, word, y[row] * value[:, None])
        used = np.flatnonzero(total.any(axis=1))
        for at in range(0, len(used), _SLICE):
            rows = used[at : at + _SLICE]
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(list(total[rows]), pa.list_(pa.float64()))], names=["row", "v"])

    # Rows are added up where they meet; what comes back is one matrix, bounded by the block's words.
    def added(batch: pa.Table) -> pa.Table:
        v = np.stack(batch.column("v").to_numpy()).sum(axis=0)
        return pa.table({"row": batch.column("row")[:1], "v": pa.array([v], pa.list_(pa.float64()))})

    sums = passages.mapInArrow(products, "row bigint, v array<double>").groupBy("row").applyInArrow(added, "row bigint, v array<double>").toArrow()
    out = np.zeros((basis.shape[1] if gram else len(weights), basis.shape[1]))
    if sums.num_rows:
        out[sums.column("row").to_numpy()] = np.stack(sums.column("v").to_numpy())
    return out


def latent_basis(passages: DataFrame, weights: np.ndarray, rank: int = RANK, seed: int = 7) -> np.ndarray:
    """The leading right singular vectors of the passages' TF-IDF matrix, by randomised range finding."""
    size = min(rank + EXTRA, len(weights))
    basis = np.random.default_rng(seed).standard_normal((len(weights), size)).astype(np.float32)
    for _ in range(POWER):
        basis = np.linalg.qr(_summed(passages, weights, basis, gram=False))[0].astype(np.float32)
    values, vectors = np.linalg.eigh(_summed(passages, weights, basis, gram=True))
    leading = np.argsort(values)[::-1][:rank]
    leading = leading[values[leading] > 1e-6 * max(values.max(), 1e-12)]
    return (basis @ vectors[:, leading]).astype(np.float32)


def word_frequencies(docs: DataFrame) -> DataFrame:
    """(word, n): in how many documents each word occurs, over all documents; the null word has their number."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        given = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update({w.lower() for w in set(WORD.findall(text))})
                if len(seen) > COUNTED_WORDS:
                    yield given()
                    seen.clear()
            seen[None] += batch.num_rows
        yield given()

    return docs.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def item_parts(items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """(id, block_key, words): the items' parts with at least as many words as a copied passage."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                own = [p for p in parts_of(words(text)) if len(p) >= RUN_WORDS]
                at += [row] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.list_(pa.string()))], names=["id", "words"])

    texts = items.where(F.col(item_text).isNotNull()).select(F.col(item_id).alias("id"), F.col(item_text).alias("text")).distinct()
    return texts.mapInArrow(cut, f"id {dict(texts.dtypes)['id']}, words array<string>").withColumn("block_key", F.xxhash64("id", "words"))


def build_index(spark: SparkSession, parts: list[tuple], frequencies: dict[str, int], n: int, rank: int = RANK) -> ItemIndex:
    """The index of a block of (id, words), with the document frequencies of its words and the number of documents."""
    numbers: dict[str, int] = {}
    coded = [[numbers.setdefault(w, len(numbers)) for w in ws] for _, ws in parts]
    frequency = np.array([frequencies.get(w, 0) for w in numbers], dtype=np.int64)
    weights = np.log((1.0 + n) / (1.0 + frequency)) + 0.05
    passages = [(k, s, e) for k, ws in enumerate(coded) for s, e in windows(len(ws))]
    texts = [coded[k][s:e] for k, s, e in passages]
    frame = spark.createDataFrame(pa.table({"words": pa.array(texts, pa.list_(pa.int64()))})).repartition(max(1, len(texts) // 2000))
    basis = latent_basis(frame, weights, rank)
    latent = project(texts, weights, basis)
    rare = frequency <= max(RARE, n // 1000)
    rare |= np.array([w.isdigit() for w in numbers])
    return ItemIndex([i for i, _ in parts], coded, numbers, weights, basis, passages, latent, np.linalg.norm(latent, axis=1), rare, *inverted(texts))


def occurrences(passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(passage, code) of the words of passages, sorted: word and how often it came before in one number, so that no two
    of a passage are equal; unknown words are left out."""
    row, word = np.repeat(np.arange(len(passages)), [len(p) for p in passages]), np.concatenate([*passages, np.zeros(0, dtype=np.int64)]).astype(np.int64)
    row, word = row[word >= 0], word[word >= 0]
    order = np.lexsort((word, row))
    row, word = row[order], word[order]
    first = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(word, prepend=-1) != 0))
    before = np.arange(len(row)) - np.repeat(first, np.diff(first, append=len(row)))
    return row, word * (2 * RUN_WORDS) + before


def inverted(passages: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted codes of the words of passages, for each where its passages begin, and the passages."""
    owner, code = occurrences([np.array(p, dtype=np.int64) for p in passages])
    order = np.argsort(code, kind="stable")
    codes = np.unique(code)
    return codes, np.searchsorted(code[order], np.append(codes, np.iinfo(np.int64).max)), owner[order]


class Searcher:
    """Compares documents with the items of an index."""

    def __init__(self, index: ItemIndex, cosine: float, short: float = SHORT, paraphrases: bool = False) -> None:
        self.index, self.cosine, self.paraphrases = index, cosine, paraphrases
        self.least_known = math.ceil(LCS_SHARE * RUN_WORDS) if paraphrases else 2 * RUN_WORDS + 1
        lengths = np.maximum(index.lengths, 1e-9)
        self.unit, self.least = index.latent / lengths[:, None], short * lengths
        self.item = np.array([k for k, _, _ in index.passages])
        # 13 words as one number: the sum of the words' numbers times powers of an odd base, modulo 2^64.
        self.powers = np.array([pow(0x9E3779B97F4A7C15, j, 1 << 64) for j in range(RUN_WORDS)], dtype=np.uint64)
        self.grams: dict[int, set[int]] = {}
        self.shared = math.ceil(LCS_SHARE * RUN_WORDS) if paraphrases else RUN_WORDS
        self.spelled: dict[str, int] = {}
        if index.starts is None:
            index.codes, index.starts, index.holders = inverted([index.words[k][s:e] for k, s, e in index.passages])

    def hashes(self, coded: np.ndarray) -> np.ndarray:
        """A number for every 13 consecutive words."""
        runs = np.lib.stride_tricks.sliding_window_view(coded.astype(np.uint64) + np.uint64(1), RUN_WORDS)
        return (runs * self.powers).sum(axis=1, dtype=np.uint64)

    def passages_of(self, texts: list[str]) -> tuple[list[np.ndarray], list[int], list[tuple[int, int]], list[np.ndarray]]:
        """The documents' words as numbers, and the passages worth a projection: document, range, words.

        A copied passage has 13 consecutive words that items have, a paraphrase so many words of them that the shortest
        passage's share is reached; passages without either hold neither.
        """
        numbers, spelled = self.index.numbers, self.spelled
        coded, owner, spans, parts = [], [], [], []
        for d, text in enumerate(texts):
            found = WORD.findall(text)
            try:
                own = [spelled[w] for w in found]
            except KeyError:
                if len(spelled) > REMEMBERED:
                    spelled.clear()
                spelled.update((w, numbers.get(w.lower(), -1)) for w in set(found) if w not in spelled)
                own = [spelled[w] for w in found]
            ws = np.array(own, dtype=np.int64)
            coded.append(ws)
            if len(ws) < RUN_WORDS:
                continue
            known = np.concatenate([[0], np.cumsum(ws >= 0)])
            full = np.concatenate([[0], np.cumsum(known[RUN_WORDS:] - known[:-RUN_WORDS] == RUN_WORDS)])
            if not full[-1] and known[-1] < self.least_known:
                continue
            for s, e in windows(len(ws)):
                if full[e - RUN_WORDS + 1] > full[s] or known[e] - known[s] >= self.least_known:
                    owner.append(d)
                    spans.append((s, e))
                    parts.append(ws[s:e])
        return coded, owner, spans, parts

    def shares(self, part: list[int], c: int) -> tuple[float, float]:
        """The shares of an item's passage that a document's has: of its words in order, of its rare words."""
        k, s, e = self.index.passages[c]
        passage = self.index.words[k][s:e]
        wanted = {w for w in passage if self.index.rare[w]}
        return lcs_length(passage, part) / len(passage), len(wanted & set(part)) / len(wanted) if wanted else 0.0

    def alike(self, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(passage, item passage) of the pairs that may share ``shared`` words: those that share one of the passage's rarest.

        Of n words, n - shared + 1 can't all be among those that aren't shared.
        """
        index = self.index
        row, code = occurrences(parts)
        at = np.minimum(np.searchsorted(index.codes, code), len(index.codes) - 1)
        row, at = row[index.codes[at] == code], at[index.codes[at] == code]
        often = index.starts[at + 1] - index.starts[at]
        order = np.lexsort((often, row))
        row, at, often = row[order], at[order], often[order]
        n = np.bincount(row, minlength=len(parts))
        rank = np.arange(len(row)) - (np.cumsum(n) - n)[row]
        rarest = rank < (n - self.shared + 1)[row]
        row, at, often = row[rarest], at[rarest], often[rarest]
        step = np.arange(often.sum()) - np.repeat(np.cumsum(often) - often, often)
        met = np.unique(np.repeat(row, often) * len(index.passages) + index.holders[np.repeat(index.starts[at], often) + step])
        return np.divmod(met, len(index.passages))

    def search(self, texts: list[str]) -> Iterator[tuple[int, int, float, int, float, float]]:
        """(document, item, cosine, common run, common subsequence, share of rare words) of the candidates.

        All passage pairs that share enough words are compared from the cosine on. The cosine and the last two are of
        the pair that passes both shares, or of all if none does, with the largest cosine; the run is of the texts as a whole.
        """
        coded, owner, spans, parts = self.passages_of(texts)
        best: dict[tuple[int, int], tuple[bool, float, float, float]] = {}
        for at in range(0, len(parts), _SLICE):
            rows, near = self.alike(parts[at : at + _SLICE])
            if not len(rows):
                continue
            # Only passages with a pair are projected.
            used, rows = np.unique(rows, return_inverse=True)
            z = project([parts[at + u].tolist() for u in used], self.index.weights, self.index.basis)
            lengths = np.linalg.norm(z, axis=1)
            for some in range(0, len(rows), _PAIRS):
                r, c = rows[some : some + _PAIRS], near[some : some + _PAIRS]
                cosines = np.einsum("ij,ij->i", self.unit[c], z[r]) / np.maximum(lengths[r], self.least[c])
                for i in np.flatnonzero(cosines >= self.cosine):
                    part, k = parts[at + used[r[i]]].tolist(), int(c[i])
                    key = owner[at + used[r[i]]], int(self.item[k])
                    shares = self.shares(part, k) if self.paraphrases else (0.0, 0.0)
                    value = (shares[0] >= LCS_SHARE and shares[1] >= ANSWER_SHARE, float(cosines[i]), *shares)
                    if key not in best or value > best[key]:
                        best[key] = value
        hashed: dict[int, list[int]] = {}
        for (d, k), (_, cosine, common, answered) in best.items():
            if d not in hashed:
                hashed[d] = self.hashes(coded[d]).tolist()
            if k not in self.grams:
                self.grams[k] = set(self.hashes(np.array(self.index.words[k])).tolist())
            run = 0 if self.grams[k].isdisjoint(hashed[d]) else longest_run(coded[d].tolist(), self.index.words[k])
            yield d, k, cosine, run, common, answered


_LEAKS = "doc_id {doc}, item_id {item}, cosine double, run_words int, lcs_share double, answer_share double"


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str,
    doc_text: str,
    item_id: str,
    item_text: str,
    cosine: float = COSINE,
    rank: int = RANK,
    paraphrases: bool = True,
) -> DataFrame:
    """(doc_id, item_id, cosine, run_words, lcs_share, answer_share) per document and item that may have leaked into it.

    ``run_words`` is the longest run of words that both texts have, if it has ``RUN_WORDS`` or more, else 0: a copied
    passage; of an item of more than ``PART_WORDS`` words it is the longest within one part. Without one, rows are given
    if ``paraphrases`` and any similar passage shares ``LCS_SHARE`` of its words in order and ``ANSWER_SHARE`` of its
    rare words and numbers. Words are compared lower-cased, whatever stands between them. Null, empty and short texts
    hold no passage. Repeated rows are reported once per id. Further columns are not read. Empty tables give no rows.
    """
    spark = docs.sparkSession
    texts = docs.where(F.col(doc_text).isNotNull()).select(F.col(doc_text).alias("text"))
    parts = item_parts(items, item_id, item_text)
    thin = docs.where(F.col(doc_text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("text"))
    schema = _LEAKS.format(doc=dict(thin.dtypes)["doc_id"], item=dict(parts.dtypes)["id"])
    found = spark.createDataFrame([], schema)
    whole = parts.agg(F.sum(F.size("words")).alias("n")).first().n or 0
    blocks = -(-whole // BLOCK_WORDS)
    if blocks:
        # One pass over the corpus counts the items' words for all blocks.
        vocabulary = parts.select(F.pmod("block_key", F.lit(blocks)).alias("block"), F.explode("words").alias("word")).distinct()
        known = vocabulary.select("word").distinct().withColumn("known", F.lit(True))
        path = scratch_path(spark, "frequencies")
        delete_at_end(spark, path)
        word_frequencies(texts).join(known, "word", "left").where("word is null or known").select("word", "n").write.parquet(path)
        frequencies = spark.read.parquet(path)
        n = frequencies.where("word is null").agg(F.sum("n").alias("n")).first().n or 0
        for block in range(blocks):
            own = parts.where(F.pmod("block_key", F.lit(blocks)) == block).select("id", "words").orderBy("id", "words").collect()
            if own:
                of_words = frequencies.join(vocabulary.where(F.col("block") == block), "word").select("word", "n").collect()
                index = build_index(spark, [(r.id, r.words) for r in own], {r.word: r.n for r in of_words}, n, rank)
                found = found.unionByName(thin.mapInArrow(_searcher(spark.sparkContext.broadcast(index), cosine, paraphrases), schema))
    strongest = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("run_words", "cosine", "lcs_share", "answer_share")).alias("m"))
    return strongest.select(
        F.col("doc_id").alias(doc_id), F.col("item_id").alias(item_id), "m.cosine", "m.run_words", "m.lcs_share", "m.answer_share"
    )


def _searcher(shared, cosine: float, paraphrases: bool):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(shared.value, cosine, paraphrases=paraphrases)
        ids = pa.array(shared.value.ids)
        for batch in batches:
            rows = [
                f
                for f in searcher.search(batch.column(1).to_pylist())
                if f[3] >= RUN_WORDS or paraphrases and f[4] >= LCS_SHARE and f[5] >= ANSWER_SHARE
            ]
            columns = [pa.array([f[i] for f in rows], t) for i, t in ((2, pa.float64()), (3, pa.int32()), (4, pa.float64()), (5, pa.float64()))]
            at, which = (pa.array([f[i] for f in rows], pa.int64()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), ids.take(which), *columns], names=["doc_id", "item_id", "cosine", "run_words", "lcs_share", "answer_share"]
            )

    return search
