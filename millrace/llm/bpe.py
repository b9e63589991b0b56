"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Encoding one pre-token: every adjacent pair whose joined bytes have a merge rank
is filed in the bucket of that rank, which holds positions of a doubly linked list
of tokens. A two-level bitmap over the ranks (blocks of 256 ranks, ranks of a block)
finds the next occupied bucket by find-first-set. Taking a position whose pair has changed since it was filed is a
stale entry and is skipped. Each merge files at most two new pairs, so a pre-token
of n bytes needs O(n log n) steps however long it is.

Rows: a null text counts as empty and has no ids; empty texts have no ids; repeated
rows and repeated or null ids give one row each; an empty table gives an empty one.
Only the id and text columns are read, so other columns of any name do not matter.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .pretokens import ChunkCache

#: Distinct pre-tokens remembered per worker; beyond it the older half is forgotten.
CACHE_PIECES = 400_000
#: Characters up to which the pre-tokens of a text are listed at once.
LISTED = 1 << 20


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: lowest rank first, leftmost first among equal ranks.

    `high` has a bit for each block of 256 ranks in use, `low[block]` a bit for each
    rank of the block, `buckets[rank]` a heap of positions. The queue is written out
    here, not a class, as this is the inner loop.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))  # of the token that starts here
    before = list(range(-1, n))  # start of the token before; one more for the end
    filed = [-1] * (n + 1)  # rank of the pair that starts here, as last filed
    get = ranks.get
    buckets: dict[int, list[int]] = {}
    low: dict[int, int] = {}
    high = 0
    for i in range(n - 1):
        r = get(piece[i:i + 2])
        if r is not None:
            filed[i] = r
            if r in buckets:
                buckets[r].append(i)  # ascending positions are a heap
            else:
                buckets[r] = [i]
                b = r >> 8
                low[b] = low.get(b, 0) | 1 << (r & 255)
                high |= 1 << b
    while high:
        b = (high & -high).bit_length() - 1
        bits = low[b]
        bit = bits & -bits
        rank = b << 8 | bit.bit_length() - 1
        bucket = buckets[rank]
        if len(bucket) > 1:
            i = heappop(bucket)
        else:
            i = bucket[0]
            del buckets[rank]
            if bits == bit:
                del low[b]
                high ^= 1 << b
            else:
                low[b] = bits ^ bit
        if filed[i] != rank:
            continue  # stale
        j = end[i]
        k = end[i] = end[j]
        filed[j] = -1
        before[k] = i
        r = get(piece[i:end[k]]) if k < n else None
        filed[i] = -1 if r is None else r
        if r is not None:
            if r in buckets:
                heappush(buckets[r], i)
            else:
                buckets[r] = [i]
                b = r >> 8
                low[b] = low.get(b, 0) | 1 << (r & 255)
                high |= 1 << b
        if i:
            h = before[i]
            r = get(piece[h:k])
            filed[h] = -1 if r is None else r
            if r is not None:
                if r in buckets:
                    heappush(buckets[r], h)
                else:
                    buckets[r] = [h]
                    b = r >> 8
                    low[b] = low.get(b, 0) | 1 << (r & 255)
                    high |= 1 << b
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i:end[i]]])
        i = end[i]
    return ids


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file of base64 bytes and rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """Encoder and decoder of whole texts for one rank table and pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.find = regex.compile(pattern)
        self.pieces = ChunkCache(self._piece, CACHE_PIECES)

    def _piece(self, piece: str) -> bytes:
        return np.array(merge_piece(piece.encode(), self.ranks), "<i4").tobytes()

    def packed(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        if len(text) <= LISTED:
            found = self.find.findall(text)
        else:
            found = (m.group() for m in self.find.finditer(text))
        return b"".join(map(self.pieces.__getitem__, found))

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.packed(text), "<i4")

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec; built once per worker and reused by its later tasks."""
    return common.kept(("codec", path, pattern), lambda: Codec(load_ranks(path), pattern))


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and `ids` (array of int) of every whole text; the vocabulary path must exist on every worker."""

    def run(batches):
        tok = codec(ranks_path, pattern)
        for batch in common.slices(batches, 256):
            packed = [tok.packed(text or "") for text in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, packed)]) // 4
            values = pa.array(np.frombuffer(b"".join(packed), "<i4"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)], names=[id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """Adds `decoded` (binary) to id and ids; null ids decode to no bytes."""

    def run(batches):
        tok = codec(ranks_path, pattern)
        for batch in common.slices(batches, 256):
            lists = batch.column(1)
            out = [tok.decode(x.values.to_numpy(zero_copy_only=False).tolist()) if x.is_valid else b"" for x in lists]
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(out, pa.binary())], names=[id_col, "ids", "decoded"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, `ids` and `decoded` like decode(encode(...)), in one Python worker a task instead of two that each hold the tables."""

    def run(batches):
        tok = codec(ranks_path, pattern)
        for batch in common.slices(batches, 256):
            packed = [tok.packed(text or "") for text in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, packed)]) // 4
            ids = np.frombuffer(b"".join(packed), "<i4")
            out = [tok.decode(ids[lo:hi].tolist()) for lo, hi in zip(ends[:-1], ends[1:])]
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(out, pa.binary())], names=[id_col, "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded binary")


def digests(docs: DataFrame) -> DataFrame:
    """Round trip with the public 50k ranks, as digests."""
    import public_tokenizers as public

    path, pattern = public.path("byte_bpe_50k.tiktoken"), public.PATTERN
    trip = round_trip(docs, path, pattern)
    return trip.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.documents(spark, sf_dir))
