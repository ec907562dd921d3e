"""Byte-level BPE encoding and decoding with a rank queue on a hierarchical bitmap.

A pre-token is a linked list of byte runs. Every adjacent pair that has a rank
stands in the bucket of that rank, by its left position. A bitmap of two levels
tells which buckets hold anything: find-first-set on the upper word and then on
the lower one (256 ranks each) gives the next rank. Entries whose pair has changed
since are skipped when they come up. The cost of a pre-token of n bytes is
O(n log n) whatever its length.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from faultledger.llm.shared import schema_with, without

#: Pre-tokens in either memory of a worker (some 200 bytes each), and the longest that is kept.
REMEMBERED = 350_000
REMEMBERED_LENGTH = 48
ROWS_AT_ONCE = 256


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def words_of(ranks: dict[bytes, int]) -> int:
    """Lower words that a bitmap of these ranks has."""
    return (max(ranks.values(), default=0) >> 8) + 1


def merge(piece: bytes, ranks: dict[bytes, int], words: int) -> list[int]:
    """The ids of one pre-token; ``words`` is ``words_of(ranks)``."""
    get = ranks.get
    whole = get(piece)
    if whole is not None:
        return [whole]
    size = len(piece)
    after = list(range(1, size + 1))
    before = list(range(-1, size - 1))
    current = [get(piece[i : i + 2], -1) for i in range(size - 1)]
    current.append(-1)
    buckets: dict[int, list[int]] = {}
    lower = [0] * words
    upper = 0
    for i, rank in enumerate(current):
        if rank >= 0:
            bucket = buckets.get(rank)
            if bucket is not None:
                bucket.append(i)
            else:
                buckets[rank] = [i]
                word = rank >> 8
                lower[word] |= 1 << (rank & 255)
                upper |= 1 << word
    while upper:
        word = (upper & -upper).bit_length() - 1
        bits = lower[word]
        first = bits & -bits
        rank = (word << 8) + first.bit_length() - 1
        bucket = buckets[rank]
        if len(bucket) > 1:
            i = heappop(bucket)
        else:
            i = bucket[0]
            del buckets[rank]
            lower[word] = bits = bits ^ first
            if not bits:
                upper ^= 1 << word
        if current[i] != rank:
            continue
        middle = after[i]
        end = after[i] = after[middle]
        current[middle] = -1
        # the two pairs that this opens; written out twice, as a call each would cost a fifth of the time
        left = before[i]
        if left >= 0:
            current[left] = rank = get(piece[left:end], -1)
            if rank >= 0:
                bucket = buckets.get(rank)
                if bucket is not None:
                    heappush(bucket, left)
                else:
                    buckets[rank] = [left]
                    word = rank >> 8
                    lower[word] |= 1 << (rank & 255)
                    upper |= 1 << word
        if end < size:
            before[end] = i
            current[i] = rank = get(piece[i : after[end]], -1)
            if rank >= 0:
                bucket = buckets.get(rank)
                if bucket is not None:
                    heappush(bucket, i)
                else:
                    buckets[rank] = [i]
                    word = rank >> 8
                    lower[word] |= 1 << (rank & 255)
                    upper |= 1 << word
        else:
            current[i] = -1
    out = []
    i = 0
    while i < size:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Encoder:
    """Turns texts into ids, as int32 bytes, and remembers the pre-tokens it has encoded.

    Short pre-tokens are kept in a young and an old memory: a full young one becomes
    the old one, so what occurs often stays and the size is bounded. Only the ranks
    and the pattern are shipped; a worker keeps its memories between tasks.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern, self.words = ranks, pattern, words_of(ranks)
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.pieces = regex.compile(pattern).findall
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def __reduce__(self) -> tuple:
        return Encoder, (self.ranks, self.pattern)

    def _piece(self, piece: str) -> bytes:
        out = self.old.get(piece) or array("i", merge(piece.encode(), self.ranks, self.words)).tobytes()
        if len(piece) <= REMEMBERED_LENGTH:
            if len(self.young) >= REMEMBERED:
                self.old = self.young.copy()
                self.young.clear()
            self.young[piece] = out
        return out

    def __call__(self, text: str) -> bytes:
        get = self.young.get
        return b"".join([get(piece) or self._piece(piece) for piece in self.pieces(text)])


def bpe_encode(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", out: str = "token_ids", decoded: str | None = None
) -> DataFrame:
    """Add the ids of every whole ``text`` as an array of int, without special tokens.

    A null or empty text has no ids. ``decoded`` names a column for the bytes that
    these ids stand for, made in the same pass. All other columns stay; those with
    the names of new ones are replaced. Each row stands alone, so repeated rows stay
    repeated. The ranks must hold every single byte that occurs, else the task fails
    with a KeyError. No shuffle: ranks (a vocabulary file, under 1 MB) are broadcast.
    """
    docs = without(docs, out, decoded or out)
    spread = docs.sparkSession.sparkContext.broadcast(Encoder(ranks, pattern))
    schema = schema_with(docs, (out, T.ArrayType(T.IntegerType(), False)), *([(decoded, T.BinaryType())] if decoded else []))
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = spread.value
        for batch in _slices(batches):
            found = [encode(value or "") for value in batch.column(at).to_pylist()]
            ends = np.cumsum([0, *(len(x) // 4 for x in found)]).astype("<i4")
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), "<i4")))
            more = [_bytes_of(ids, encode.tokens)] if decoded else []
            yield pa.record_batch([*batch.columns, ids, *more], names=schema.names)

    return docs.mapInArrow(run, schema)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Short runs of rows, since texts, ids and bytes of a run are in memory at once."""
    for batch in batches:
        for first in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(first, ROWS_AT_ONCE)


def _bytes_of(ids: pa.ListArray, tokens: dict[int, bytes]) -> pa.Array:
    """The bytes of each row of ids; null for null."""
    rows = (row.values.to_numpy().tolist() if row.is_valid else None for row in ids)
    return pa.array([None if row is None else b"".join(map(tokens.__getitem__, row)) for row in rows], pa.binary())


def bpe_decode(docs: DataFrame, ranks: dict[bytes, int], ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Add the bytes that ``ids`` stand for. Null ids give null, no ids give no bytes.

    An id that no token has fails the task with a KeyError.
    """
    docs = without(docs, out)
    spread = docs.sparkSession.sparkContext.broadcast(ranks)
    schema = schema_with(docs, (out, T.BinaryType()))
    at = docs.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {rank: token for token, rank in spread.value.items()}
        for batch in _slices(batches):
            yield pa.record_batch([*batch.columns, _bytes_of(batch.column(at), tokens)], names=schema.names)

    return docs.mapInArrow(run, schema)
