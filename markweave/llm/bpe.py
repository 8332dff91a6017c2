"""Encoding of a corpus with a byte-level BPE vocabulary of public tokenizers.

Method: a segment tree over the byte positions of a word keeps the leftmost pair of least rank at its root;
each merge updates the two live neighbours by logarithmic point updates. Words repeat, so every worker memoises
the ids of the words it has seen and the hot path is one dictionary lookup per word and NumPy gathers per batch.

Defined results: a null and an empty text give an empty list; blanks are encoded as any other text; a special
token's string in a text is ordinary text; ids are never cut, however long the text is.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markweave.session import spread

#: Folder of the public vocabularies; a parameter everywhere it is used.
TOKENIZER_DIR = "/opt/tokenizers"
#: Fixed by the vocabulary: how text is cut into words before merging.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces and ids memoised per worker before the memo starts afresh; bounds memory, never results.
MEMO_WORDS, MEMO_IDS = 400_000, 3_000_000
#: Rows and letters that are encoded at once; a longer text is encoded alone, and whole.
PART_ROWS, PART_LETTERS = 2_000, 2_000_000

#: A vocabulary's file is broadcast up to this size.
VOCABULARY_BYTES = 1 << 26

_NO_RANK = 1 << 60
_WORDS = regex.compile(WORD_PATTERN)
#: A blank beside other white space: there the quick cut at single blanks would not be the pattern's own.
_TANGLED = re.compile(r" \s|\s ")
_QUICK_CUT = re.compile(r"(?<=\S) (?=\S)")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return read_ranks(f.read())


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line.strip())}


class PairTree:
    """Minimum segment tree over byte positions; equal ranks resolve to the leftmost position."""

    def __init__(self, ranks: list[int]):
        self.size = size = 1 << max(0, (len(ranks) - 1).bit_length())
        tree = [_NO_RANK] * size + ranks + [_NO_RANK] * (size - len(ranks))
        for k in range(size - 1, 0, -1):
            left, right = tree[2 * k], tree[2 * k + 1]
            tree[k] = left if left <= right else right
        self.tree = tree

    def least(self) -> tuple[int, int]:
        """(rank, leftmost position that has it)."""
        tree, k, rank = self.tree, 1, self.tree[1]
        while k < self.size:
            k = 2 * k if tree[2 * k] == rank else 2 * k + 1
        return rank, k - self.size

    def update(self, position: int, rank: int) -> None:
        tree, k = self.tree, position + self.size
        tree[k] = rank
        k >>= 1
        while k:
            left, right = tree[2 * k], tree[2 * k + 1]
            least = left if left <= right else right
            if tree[k] == least:
                break
            tree[k] = least
            k >>= 1


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-cut word."""
    n = len(word)
    if n == 1:
        return [ranks[word]]
    end = list(range(1, n + 1))  # end of the live part that starts here
    start = list(range(-1, n))  # start of the live part before the one that starts here, by start
    tree = PairTree([ranks.get(word[i : i + 2], _NO_RANK) for i in range(n - 1)])
    while True:
        rank, i = tree.least()
        if rank == _NO_RANK:
            break
        j = end[i]
        e = end[j]
        end[i] = e
        if j < n - 1:
            tree.update(j, _NO_RANK)
        if e < n:
            start[e] = i
            tree.update(i, ranks.get(word[i : end[e]], _NO_RANK))
        else:
            tree.update(i, _NO_RANK)
        p = start[i]
        if i > 0:
            tree.update(p, ranks.get(word[p:e], _NO_RANK))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[word[i : end[i]]])
        i = end[i]
    return ids


class _Memo(dict):
    """Piece of text -> its number among the memoised pieces."""

    def __init__(self, encoder: "Encoder", lead: str):
        self.encoder, self.lead = encoder, lead

    def __missing__(self, piece: str) -> int:
        k = self[piece] = self.encoder.add(self.lead + piece)
        return k


class Encoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.words: dict[str, list[int]] = {}
        self.clear()

    def clear(self) -> None:
        self.words = {}
        self.first, self.later = _Memo(self, ""), _Memo(self, " ")
        self.flat: list[int] = []
        self.starts: list[int] = []
        self.counts: list[int] = []

    def add(self, piece: str) -> int:
        """Encode a piece whose ends are word ends of the pattern."""
        self.starts.append(len(self.flat))
        for w in _WORDS.findall(piece):
            ids = self.words.get(w)
            if ids is None:
                ids = merge_word(w.encode("utf-8", "surrogatepass"), self.ranks)
                if len(w) < 40:
                    self.words[w] = ids
            self.flat += ids
        self.counts.append(len(self.flat) - self.starts[-1])
        return len(self.counts) - 1

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets by text, ids of all texts)."""
        if len(self.counts) > MEMO_WORDS or len(self.words) > MEMO_WORDS or len(self.flat) > MEMO_IDS:
            self.clear()
        pieces: list[int] = []
        at = [0]
        for text in texts:
            if text:
                if _TANGLED.search(text) or text[0] == " " or text[-1] == " ":
                    parts = _QUICK_CUT.split(text)
                else:
                    parts = text.split(" ")
                pieces.append(self.first[parts[0]])
                pieces += map(self.later.__getitem__, parts[1:])
            at.append(len(pieces))
        chosen = np.asarray(pieces, dtype=np.int64)
        counts = np.asarray(self.counts, dtype=np.int64)[chosen] if len(pieces) else chosen
        starts = np.asarray(self.starts, dtype=np.int64)[chosen] if len(pieces) else chosen
        ends = np.concatenate([[0], np.cumsum(counts)])
        ids = np.asarray(self.flat, dtype=np.int32)[np.repeat(starts - ends[:-1], counts) + np.arange(ends[-1])] if len(pieces) else np.zeros(0, np.int32)
        return ends[np.asarray(at)], ids


_ENCODERS: dict[str, Encoder] = {}


def _encoder(data: bytes) -> Encoder:
    key = hashlib.sha256(data).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(read_ranks(data))
    return _ENCODERS[key]


def _parts(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive runs of texts."""
    start = letters = 0
    for k, text in enumerate(texts):
        size = len(text) if text else 0
        if k > start and (k - start == PART_ROWS or letters + size > PART_LETTERS):
            yield start, k
            start, letters = k, 0
        letters += size
    if texts:
        yield start, len(texts)


def encode_texts(df: DataFrame, id_col: str, text_col: str, vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """(``id_col``, ``ids``) of every row of ``df``, in one pass without any shuffle.

    Repeated rows stay repeated; other columns of ``df`` are not read.
    """
    path = os.path.join(folder, f"{vocabulary}.tiktoken")
    if os.path.getsize(path) > VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {VOCABULARY_BYTES} bytes")
    with open(path, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())  # executors need no such folder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _parts(texts):
                offsets, ids = encoder.encode_batch(texts[a:b])
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=["id", "ids"])

    rows = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)
