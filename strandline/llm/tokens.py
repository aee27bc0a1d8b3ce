"""Encoding text with a public byte-level BPE vocabulary.

Each piece that the vocabulary's pattern cuts off is merged by a segment tree over the ranks of its adjacent pairs: the root
names the leftmost pair of lowest rank, a merge updates at most three leaves, and merging ends when the root holds no pair.
A piece of n bytes takes O(n log n), so a megabyte without a blank is no worse than words.
"""

from __future__ import annotations

import base64
import functools
import os

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import spread

#: The folder of the vocabularies, on every node; the environment or the call may name another.
DEFAULT_VOCABULARY = os.environ.get("STRANDLINE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the pattern that cuts text into pieces before merging, as published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces whose ids a Python worker keeps; when full the store is emptied, which costs time but never changes a result.
CACHE_PIECES = 200_000
NONE = 1 << 62


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece; every single byte must be in ``ranks``."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    size = 1
    while size < n:
        size *= 2
    # A leaf holds rank * size + position, so that the least key is the leftmost pair of lowest rank.
    tree = [NONE] * (2 * size)
    for i in range(n - 1):
        r = ranks.get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r * size + i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b

    def put(i: int, key: int) -> None:
        i += size
        if tree[i] == key:
            return
        tree[i] = key
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            least = a if a < b else b
            if tree[i] == least:
                return
            tree[i] = least
            i >>= 1

    def pair(i: int) -> int:
        j = nxt[i]
        r = ranks.get(parts[i] + parts[j]) if j < n else None
        return NONE if r is None else r * size + i

    while (top := tree[1]) != NONE:
        i = top % size
        j = nxt[i]
        parts[i] += parts[j]
        parts[j] = None
        nxt[i] = nxt[j]
        if nxt[j] < n:
            prv[nxt[j]] = i
        put(j, NONE)
        put(i, pair(i))
        if prv[i] >= 0:
            put(prv[i], pair(prv[i]))
    return [ranks[p] for p in parts if p is not None]


class Encoder:
    """A vocabulary with a store of pieces already merged."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pieces = regex.compile(PATTERN)
        self.known: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text as it stands; the strings of special tokens are ordinary text. Empty and null give an empty list."""
        out: list[int] = []
        if not text:
            return out
        known = self.known
        for piece in self.pieces.findall(text):
            ids = known.get(piece)
            if ids is None:
                ids = merge(piece.encode("utf-8"), self.ranks)
                if len(piece) <= 64:
                    if len(known) >= CACHE_PIECES:
                        known.clear()
                    known[piece] = ids
            out.extend(ids)
        return out


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, read once in each Python worker."""
    return Encoder(path)


def token_ids(text: Column, vocabulary: str = DEFAULT_VOCABULARY) -> Column:
    """The ids of each text as array<int>; an empty array for null and for the empty text."""

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        e = encoder(vocabulary)
        return texts.map(e.encode, na_action=None)

    return ids(text)


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``id_col, ids``: one row for each row of ``docs``, whole texts, repeated rows included; other columns are not read."""
    return spread(docs.select(id_col, text_col)).select(id_col, token_ids(F.col(text_col), vocabulary).alias("ids"))
