"""Encoding with a public byte-level BPE vocabulary.

A text is cut into pieces by the vocabulary's pattern and each piece is merged on its own. The merge loop keeps, over the
byte positions of a piece, a segment tree whose nodes hold the leftmost minimum rank of the pair that starts there; a merge
joins a position with its next live neighbour and updates two leaves, so a piece of n bytes takes O(n log n) however
long and however it is repeated.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where the vocabularies are if nobody says otherwise; they are never copied.
DEFAULT_FOLDER = "/opt/tokenizers"
#: Fixed value: the pattern by which the public 50k byte-level vocabularies cut a text into pieces.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = 1 << 62
#: Pieces whose ids a worker remembers, and the longest piece it does so for.
CACHE, CACHED_BYTES = 200_000, 64


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file of lines `<base64 token> <rank>`."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: again and again the leftmost pair of least rank is merged."""
    n = len(piece)
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    end = list(range(1, n + 1))  # end[i]: where the token that starts at i ends; its neighbour starts there
    before = list(range(-1, n - 1))
    size = 1
    while size < n:
        size *= 2
    tree = [NONE] * (2 * size)
    for i in range(n - 1):
        tree[size + i] = ranks.get(piece[i : i + 2], NONE)
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a <= b else b

    def put(i: int, rank: int) -> None:
        k = size + i
        tree[k] = rank
        k //= 2
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            m = a if a <= b else b
            if tree[k] == m:
                break
            tree[k] = m
            k //= 2

    while tree[1] != NONE:
        least, k = tree[1], 1
        while k < size:
            k = 2 * k if tree[2 * k] == least else 2 * k + 1
        i = k - size
        j = end[i]
        end[i] = end[j]
        put(j, NONE)
        after = end[i]
        if after < n:
            before[after] = i
            put(i, ranks.get(piece[i : end[after]], NONE))
        else:
            put(i, NONE)
        if before[i] >= 0:
            put(before[i], ranks.get(piece[before[i] : after], NONE))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    def __init__(self, path: str):
        import regex

        self.ranks, self.find = load_ranks(path), regex.compile(PATTERN).findall
        self.kept: dict[str, list[int]] = {}

    def __call__(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        kept = self.kept
        for piece in self.find(text):
            ids = kept.get(piece)
            if ids is None:
                raw = piece.encode("utf-8", "replace")
                ids = merge(raw, self.ranks)
                if len(raw) <= CACHED_BYTES:
                    if len(kept) >= CACHE:
                        kept.clear()
                    kept[piece] = ids
            out += ids
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode(text: Column, vocabulary: str = "byte_bpe_50k", folder: str | None = None) -> Column:
    """array<int> of ids, without special tokens: strings that look like them are plain text. Null, empty: an empty array.
    Blank text is text. Every worker opens the vocabulary at `folder` (or GROVESPARK_TOKENIZERS, or /opt/tokenizers)."""
    path = os.path.join(folder or os.environ.get("GROVESPARK_TOKENIZERS", DEFAULT_FOLDER), f"{vocabulary}.tiktoken")

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(path)
        for s in batches:
            yield pd.Series([enc(t) for t in s], dtype=object)

    return ids(text)
