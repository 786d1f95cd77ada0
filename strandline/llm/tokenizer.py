"""Encoding of a corpus with a public byte-level BPE vocabulary.

A text is split by the vocabulary's pattern; each piece is merged with a segment tree over the ranks of its
adjacent pairs: the root holds the lowest rank, a walk down finds its leftmost place, and a merge updates at
most three leaves, each in logarithmic time, until the root holds no mergeable pair. So a piece of n bytes
takes O(n log n) whatever its content, a megabyte without a blank too.
"""

from __future__ import annotations

import base64
import importlib.util
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: The split pattern of the public 50k byte-level vocabularies; it must equal theirs (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "byte_bpe_50k.tiktoken"
NONE = 1 << 30
#: Pieces an encoder remembers; a full memory is emptied, so it is a bound on memory and nothing else.
REMEMBERED = 100_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Place of a vocabulary file: in ``$STRANDLINE_TOKENIZERS``, else in the installed public_tokenizers package."""
    folder = os.environ.get("STRANDLINE_TOKENIZERS")
    if not folder:
        spec = importlib.util.find_spec("public_tokenizers")
        folder = os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"
    return os.path.join(folder, name)


def read_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


class Encoder:
    """Token ids of texts under one rank table."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.split = regex.compile(PATTERN).findall
        self.memory: dict[str, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece by leftmost lowest-rank merges."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        size = 1 << (n - 1).bit_length()
        part = [piece[i : i + 1] for i in range(n)]
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        tree = [NONE] * (2 * size)
        for i in range(n - 1):
            tree[size + i] = ranks.get(piece[i : i + 2], NONE)
        for k in range(size - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        while (low := tree[1]) != NONE:
            k = 1
            while k < size:
                k *= 2
                if tree[k] != low:
                    k += 1
            i = k - size
            j = after[i]
            part[i] += part[j]
            nxt, prev = after[j], before[i]
            after[i] = nxt
            changed = [(j, NONE)]
            if nxt >= 0:
                before[nxt] = i
                changed.append((i, ranks.get(part[i] + part[nxt], NONE)))
            else:
                changed.append((i, NONE))
            if prev >= 0:
                changed.append((prev, ranks.get(part[prev] + part[i], NONE)))
            for leaf, rank in changed:
                k = size + leaf
                if tree[k] != rank:
                    tree[k] = rank
                    k >>= 1
                    while k:
                        least = tree[2 * k] if tree[2 * k] < tree[2 * k + 1] else tree[2 * k + 1]
                        if tree[k] == least:
                            break
                        tree[k] = least
                        k >>= 1
        out, i = [], 0
        while i >= 0:
            out.append(ranks[part[i]])
            i = after[i]
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; null and empty texts have the empty list. Special tokens' names are ordinary text; lone surrogates count as U+FFFD."""
        if not text:
            return []
        memory, out = self.memory, []
        for piece in self.split(text):
            ids = memory.get(piece)
            if ids is None:
                ids = self.merge(piece.encode("utf-8", "replace"))
                if len(piece) <= 64:
                    if len(memory) >= REMEMBERED:
                        memory.clear()
                    memory[piece] = ids
            out += ids
        return out


def decode(ids: Iterable[int], ranks: dict[bytes, int]) -> str:
    back = {v: k for k, v in ranks.items()}
    return b"".join(back[i] for i in ids).decode("utf-8")


_encoders: dict[int, Encoder] = {}


def encoder_of(raw: bytes) -> Encoder:
    """One encoder a Python worker and vocabulary."""
    key = hash(raw)
    if key not in _encoders:
        _encoders[key] = Encoder(read_ranks(raw))
    return _encoders[key]


def _vocabulary(df: DataFrame, path: str | None) -> object:
    """The vocabulary file as a broadcast; its size is fixed with the vocabulary (0.8 MB), whatever the corpus."""
    with open(path or vocabulary_path(), "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode_corpus(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids array<int>): the ids of every row's text; empty lists for null and empty texts. One map over the scan, no shuffle."""
    raw = _vocabulary(documents, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_of(raw.value).encode
        for b in batches:
            offsets, flat = [0], []
            for t in b.column(1).to_pylist():
                flat += encode(t)
                offsets.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.asarray(flat, dtype=np.int32), pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=[key, "ids"])

    return documents.select(key, text).mapInArrow(run, f"`{key}` {dict(documents.dtypes)[key]}, ids array<int>")


def count_tokens(documents: DataFrame, columns: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """``columns`` and n_tokens of every row; the ids themselves never leave the worker."""
    raw = _vocabulary(documents, path)
    kinds = dict(documents.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_of(raw.value).encode
        for b in batches:
            n = pa.array([len(encode(t)) for t in b.column(b.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], names=[*columns, "n_tokens"])

    return documents.select(*columns, text).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", n_tokens bigint")
