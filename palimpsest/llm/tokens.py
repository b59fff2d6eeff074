"""Problem 7: token ids of whole texts by a public byte-level BPE vocabulary.

Each piece of a text (as the vocabulary's pattern cuts it) is merged with a segment tree over the ranks
of its adjacent pairs. The root names the leftmost pair of the lowest rank; a merge updates that
leaf and its two neighbours in logarithmic time; the piece is done when the root holds no rank. Pieces of
any length cost O(n log n). Merged pieces are remembered, up to a bound, as most of them come again.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: how the byte-level vocabularies cut a text into pieces.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces remembered by one task, and the longest of them.
REMEMBERED, LONGEST = 200_000, 64
NONE = 1 << 62


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PairTree:
    """Minimum tree over (rank, position) of the pairs that begin at each position."""

    def __init__(self, keys: list[int]):
        self.width = w = 1 << max(0, (len(keys) - 1)).bit_length()
        self.tree = t = [NONE] * w + keys + [NONE] * (w - len(keys))
        for i in range(w - 1, 0, -1):
            a, b = t[2 * i], t[2 * i + 1]
            t[i] = a if a <= b else b

    def set(self, at: int, key: int) -> None:
        t, i = self.tree, at + self.width
        t[i] = key
        i >>= 1
        while i:
            a, b = t[2 * i], t[2 * i + 1]
            least = a if a <= b else b
            if t[i] == least:
                break
            t[i] = least
            i >>= 1


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    part = [piece[i : i + 1] for i in range(n)]
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    # rank and position in one number: the least is the leftmost pair of the lowest rank
    keys = [(r * n + i if (r := ranks.get(part[i] + part[i + 1])) is not None else NONE) for i in range(n - 1)]
    tree = PairTree(keys)
    root = tree.tree
    while root[1] != NONE:
        i = root[1] % n
        j = after[i]
        part[i] += part[j]
        part[j] = b""
        k = after[i] = after[j]
        if j < n - 1:
            tree.set(j, NONE)
        if k < n:
            before[k] = i
            r = ranks.get(part[i] + part[k])
            tree.set(i, NONE if r is None else r * n + i)
        else:
            tree.set(i, NONE)
        h = before[i]
        if h >= 0:
            r = ranks.get(part[h] + part[i])
            tree.set(h, NONE if r is None else r * n + h)
    return [ranks[p] for p in part if p]


class Encoder:
    """Text to ids, by one vocabulary file. Holds a bounded memory of merged pieces."""

    def __init__(self, path: str):
        self.ranks = ranks_of(path)
        self.cut = regex.compile(PIECES).findall
        self.known: dict[str, list[int]] = {}

    def ids(self, text: str) -> list[int]:
        known, out = self.known, []
        for piece in self.cut(text):
            got = known.get(piece)
            if got is None:
                got = merge_piece(piece.encode("utf-8", "replace"), self.ranks)
                if len(piece) <= LONGEST:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = got
            out += got
        return out


def encoded(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(``doc_id``, ``ids`` array<int>): ids of the whole text without special tokens. ``doc_id`` may be any column, which is carried along.

    An empty text gives an empty array and a null text null; strings of special tokens are plain text.
    One narrow pass, no shuffle; every task holds the vocabulary (a few MB) once.
    """
    path = vocabulary or vocabulary_path()
    doc_type = documents.schema[doc_id].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(path)
        for f in frames:
            yield pd.DataFrame({"doc_id": f["_doc"], "ids": [None if t is None else encoder.ids(t) for t in f["_text"]]})

    return documents.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text")).mapInPandas(run, f"doc_id {doc_type}, ids array<int>")


def token_counts(documents: DataFrame, source: str = "source", **names: str) -> DataFrame:
    """Texts, tokens and characters for every source; null sources are counted as ``(none)``."""
    ids = encoded(documents.withColumn("_source", F.coalesce(F.col(source), F.lit("(none)"))), doc_id="_source", **{k: v for k, v in names.items() if k != "doc_id"})
    return ids.groupBy(F.col("doc_id").alias("source")).agg(F.count("*").alias("n_texts"), F.sum(F.when(F.col("ids").isNotNull(), F.size("ids")).otherwise(0)).alias("n_tokens"))
