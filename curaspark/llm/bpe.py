"""Byte-level BPE encoding of whole corpora with a public rank file (problem 7).

Each text is cut by the vocabulary's pattern; each piece is merged in a *contiguous rank array*: one
list holds the part boundaries, one the ranks of adjacent parts. The smallest rank is found by a scan,
the boundary between its two parts is deleted and the two neighbouring ranks are looked up again.
Pieces longer than ``LONG_PIECE`` bytes (pathological runs without blanks) take a heap over linked
parts instead, which yields the same ids in O(n log n).

Defined results: NULL and '' give an empty list; special-token strings are ordinary text; repeated ids
are encoded row by row; further columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curaspark.session import ship

TOKENIZER_DIR = "/opt/tokenizers"
# The pattern that belongs to the public byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG_PIECE = 64
CACHE_PIECES = 200_000
NO_RANK = 1 << 60


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    """Rank of each token of a rank file (one base64 token and its rank a line)."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines()) if token}


def merge_scan(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece by the contiguous rank array."""
    bounds = list(range(len(piece) + 1))
    rank_of = ranks.get
    adjacent = [rank_of(piece[i : i + 2], NO_RANK) for i in range(len(piece) - 1)]
    while adjacent:
        least = min(adjacent)
        if least == NO_RANK:
            break
        at = adjacent.index(least)
        del bounds[at + 1], adjacent[at]
        if at:
            adjacent[at - 1] = rank_of(piece[bounds[at - 1] : bounds[at + 1]], NO_RANK)
        if at < len(adjacent):
            adjacent[at] = rank_of(piece[bounds[at] : bounds[at + 2]], NO_RANK)
    return [ranks[piece[a:b]] for a, b in zip(bounds, bounds[1:])]


def merge_heap(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids for long pieces: lazily invalidated heap of adjacent ranks over linked parts."""
    n = len(piece)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)

    def offer(start: int) -> None:
        middle = after[start]
        if middle < n and (r := ranks.get(piece[start : after[middle]])) is not None:
            heapq.heappush(heap, (r, start, after[middle]))

    while heap:
        _, start, end = heapq.heappop(heap)
        middle = after[start] if alive[start] else n
        if middle >= n or after[middle] != end:
            continue
        alive[middle], after[start] = False, end
        if end < n:
            before[end] = start
        offer(start)
        if before[start] >= 0:
            offer(before[start])
    out, at = [], 0
    while at < n:
        out.append(ranks[piece[at : after[at]]])
        at = after[at]
    return out


class Encoder(dict):
    """Ids by piece, filled on demand and emptied when it holds ``CACHE_PIECES`` pieces."""

    def __init__(self, ranks: dict[bytes, int]):
        import regex

        super().__init__()
        self.ranks, self.cut = ranks, regex.compile(PATTERN).findall

    def __missing__(self, word: str) -> tuple[int, ...]:
        piece = word.encode()
        if (whole := self.ranks.get(piece)) is not None:
            ids: tuple[int, ...] = (whole,)
        else:
            ids = tuple((merge_scan if len(piece) <= LONG_PIECE else merge_heap)(piece, self.ranks))
        if len(piece) <= LONG_PIECE:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.cut(text)))) if text else []

    def count(self, text: str | None) -> int:
        return sum(map(len, map(self.__getitem__, self.cut(text)))) if text else 0


@lru_cache(maxsize=4)
def _encoder(raw: bytes) -> Encoder:
    return Encoder(parse_ranks(raw))


def encoder_of(shared: Broadcast) -> Encoder:
    """One encoder per worker process and vocabulary."""
    return _encoder(shared.value)


def rank_file(spark: SparkSession, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> Broadcast:
    """The rank file, broadcast: its size is that of the public vocabulary (under 1 MB), whatever the data."""
    ship(spark)
    return spark.sparkContext.broadcast(Path(folder, f"{name}.tiktoken").read_bytes())


def encode(df: DataFrame, id_col: str, text_col: str, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """``id_col`` and ``ids array<int>`` of each row; a narrow map without a shuffle."""
    shared = rank_file(df.sparkSession, name, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared)
        for batch in batches:
            lists = [encoder.encode(t) for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(lists) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in lists], out=offsets[1:])
            values = np.fromiter(chain.from_iterable(lists), dtype=np.int32, count=int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, values)], names=[id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def token_counts(df: DataFrame, id_col: str, text_col: str, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """``id_col`` and ``n_tokens int`` of each row, by the same encoder."""
    shared = rank_file(df.sparkSession, name, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared)
        for batch in batches:
            counts = pa.array([encoder.count(t) for t in batch.column(1).to_pylist()], type=pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts], names=[id_col, "n_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens int")
