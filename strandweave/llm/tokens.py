"""Encoding texts with a public byte-level BPE tokenizer.

Two bytes that never stand side by side inside a token of the vocabulary can't be merged, nor can anything across
them: between them the encoding is certain to be cut. Where the tokenizer's own word pattern can't look across such a
cut either, the text is split there; the fragments are encoded independently and their ids are joined. Fragments are
short and recur, so that each worker encodes a fragment once and looks it up from then on, and texts of any length
cost time in proportion to it.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files are; a parameter of every function that needs them.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the word pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The fragments that a worker remembers; it starts anew beyond them.
REMEMBERED = 400_000
#: The white space beyond ASCII.
WIDE_SPACES = (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_WIDE_SPACE_FORMS = [chr(c).encode() for c in WIDE_SPACES]
_MAY_END_SPACE = np.isin(np.arange(256), [form[-1] for form in _WIDE_SPACE_FORMS])


@lru_cache(maxsize=4)
def vocabulary(path: str) -> dict[bytes, int]:
    """The tokens and ids of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def forced_pairs(path: str) -> np.ndarray:
    """[256, 256]: whether a byte followed by another occurs inside no token of the vocabulary."""
    forced = np.ones((256, 256), dtype=bool)
    for token in vocabulary(path):
        codes = np.frombuffer(token, dtype=np.uint8)
        forced[codes[:-1], codes[1:]] = False
    return forced


@lru_cache(maxsize=4)
def encoding(path: str):
    """The tokenizer of a rank file, without special tokens."""
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=vocabulary(path), special_tokens={})


def certain_cuts(data: np.ndarray, forced: np.ndarray) -> np.ndarray:
    """The offsets in UTF-8 bytes at which the encoding is certain to be cut.

    A cut lies between two characters whose adjoining bytes are a forced pair. The word pattern looks across it in two
    cases only, which are left alone: white space before the cut, whose run depends on what follows, and an apostrophe
    after it, which begins a contraction only at a word's start.
    """
    if len(data) < 2:
        return np.zeros(0, dtype=np.int64)
    before, after = data[:-1], data[1:]
    cut = forced[before, after] & ((after & 0xC0) != 0x80) & (after != 0x27)
    cut &= ~((before == 0x20) | ((before >= 0x09) & (before <= 0x0D)) | ((before >= 0x1C) & (before <= 0x1F)))
    at = np.flatnonzero(cut) + 1
    doubtful = np.flatnonzero(_MAY_END_SPACE[data[at - 1]])
    if len(doubtful):
        near = at[doubtful]
        ends = np.zeros(len(near), dtype=bool)
        for form in _WIDE_SPACE_FORMS:
            same = near >= len(form)
            for back, byte in enumerate(reversed(form), 1):
                same &= data[near - back] == byte
            ends |= same
        at = np.delete(at, doubtful[ends])
    return at


class Encoder:
    """Encodes texts fragment by fragment; remembers a bounded number of fragments."""

    def __init__(self, path: str) -> None:
        self.path, self.known = path, {}

    def _learn(self, fragment: bytes) -> list[int]:
        found = encoding(self.path).encode_ordinary(fragment.decode())
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        if len(fragment) <= 64:
            self.known[fragment] = found
        return found

    def __call__(self, texts: pa.Array) -> pa.Array:
        """The ids of each text of a batch; the cuts of all its texts are found in one pass."""
        texts = pa.concat_arrays([texts.fill_null("").cast(pa.large_string())])
        size = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=size + 1 + texts.offset)[texts.offset :]
        body = texts.buffers()[2]
        data = body.to_pybytes() if body is not None else b""
        first, last = int(offsets[0]), int(offsets[-1])
        cuts = certain_cuts(np.frombuffer(data, dtype=np.uint8)[first:last], forced_pairs(self.path)) + first
        # Texts begin and end at cuts, too. An empty text has no fragment.
        bounds = np.unique(np.concatenate([cuts, offsets]))
        edges = bounds.tolist()
        known, learn, lengths, ids = self.known, self._learn, [], []
        for start, end in zip(edges, edges[1:]):
            fragment = data[start:end]
            found = known.get(fragment)
            if found is None:
                found = learn(fragment)
            ids += found
            lengths.append(len(found))
        counts = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])[np.searchsorted(bounds, offsets)]
        return pa.LargeListArray.from_arrays(pa.array(counts), pa.array(ids, pa.int32())).cast(pa.list_(pa.int32()))


def encode_texts(rows: DataFrame, doc_id: str, text: str, tokenizer: str = "byte_bpe_50k", tokenizers: str = TOKENIZERS) -> DataFrame:
    """(doc_id, ids): the token ids of every text, an array of integers.

    ``tokenizer`` names a rank file of the directory ``tokenizers``. Strings of special tokens in a text are ordinary
    text. Null and empty texts have the empty array; blank texts have the ids of their white space. Repeated rows are
    repeated. Further columns are not read. An empty table gives no rows.
    """
    path = f"{tokenizers}/{tokenizer}.tiktoken"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), encoder(batch.column(1))], names=["doc_id", "ids"])

    thin = rows.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    out = thin.mapInArrow(encode, f"doc_id {dict(thin.dtypes)['doc_id']}, ids array<int>")
    return out.withColumnRenamed("doc_id", doc_id)
