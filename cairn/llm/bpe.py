"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Each pre-token is a doubly linked list of symbols. Every adjacent pair that is a token waits in the
bucket of its merge rank. A two-level bitmap (one word of 256-rank leaves, one bit for each rank in
a leaf) says which buckets are occupied; find-first-set on both levels gives the lowest rank in
constant time, whatever the pre-token's length. A bucket yields its leftmost position first (it is a
heap of its own). Entries are never removed before their turn: an entry is stale, and skipped, if the pair
now at its position has another rank. Cost is linear in merges but for the logarithm of the fullest
bucket, so a pre-token of a million bytes is no special case.

Defined cases: a null or empty text has no tokens and decodes to the empty string; repeated rows are
encoded one by one; rows keep whatever ``doc_id`` they have, null included; other columns of the
input are ignored by ``encode`` and may have any name. An empty table gives an empty table.
"""

from __future__ import annotations

import base64
import re
from heapq import heappop, heappush
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, claim, list_array, map_batches, prepare, text_of

#: White space of the Unicode property, as the pattern's library reads \s (fixed values).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token.

    ``buckets`` holds positions by rank, ``leaves`` the occupied ranks of each group of 256 and
    ``top`` the occupied groups; the queue is written out in place because a call for each step
    would cost more than the step.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    end = list(range(1, n + 1))  # where the symbol that begins at i ends, and so where the next begins
    before = list(range(-1, n - 1))
    pair = [-1] * n  # rank of the pair that begins at i, -1 if there is none
    buckets: dict[int, list[int]] = {}
    leaves: dict[int, int] = {}
    top = 0
    get = ranks.get
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            pair[i] = r
            if r in buckets:
                buckets[r].append(i)
            else:
                buckets[r] = [i]
                leaf = r >> 8
                leaves[leaf] = leaves.get(leaf, 0) | 1 << (r & 255)
                top |= 1 << leaf
    while top:
        leaf = (top & -top).bit_length() - 1  # find-first-set, twice
        word = leaves[leaf]
        rank = leaf << 8 | (word & -word).bit_length() - 1
        positions = buckets[rank]
        if len(positions) > 1:
            i = heappop(positions)
        else:
            i = positions[0]
            del buckets[rank]
            word &= word - 1
            leaves[leaf] = word
            if not word:
                top &= top - 1
        if pair[i] != rank:  # stale
            continue
        j = end[i]
        stop = end[i] = end[j]
        pair[j] = pair[i] = -1
        if stop < n:
            before[stop] = i
            r = get(piece[i : end[stop]])
            if r is not None:
                pair[i] = r
                if r in buckets:
                    heappush(buckets[r], i)
                else:
                    buckets[r] = [i]
                    leaf = r >> 8
                    leaves[leaf] = leaves.get(leaf, 0) | 1 << (r & 255)
                    top |= 1 << leaf
        h = before[i]
        if h >= 0:
            r = get(piece[h:stop])
            if r is None:
                pair[h] = -1
            else:
                pair[h] = r
                if r in buckets:
                    heappush(buckets[r], h)
                else:
                    buckets[r] = [h]
                    leaf = r >> 8
                    leaves[leaf] = leaves.get(leaf, 0) | 1 << (r & 255)
                    top |= 1 << leaf
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class ByteBPE:
    """A vocabulary's encoder and decoder with a bounded memo of the chunks between spaces.

    A chunk is a run without white space together with one space before it, or the white space
    between; no pre-token of the pattern crosses from a chunk into the next.
    """

    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.bytes_of = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        inside = re.sub(r"\\S", f"[^{SPACE}]", pattern)
        inside = re.sub(r"\[\^\\s", f"[^{SPACE}", inside)
        inside = re.sub(r"\\s", f"[{SPACE}]", inside)
        self.pretokens = regex.compile(inside)
        self.chunks = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
        self.memo = Memo(self._chunk, 1_200_000, "byte-bpe")

    def _piece(self, piece: str) -> bytes:
        ids = merge_piece(piece.encode(), self.ranks)
        return pack_ids(f"<{len(ids)}I", *ids)

    def _chunk(self, chunk: str) -> bytes:
        found = self.pretokens.findall(chunk)
        if len(found) == 1:
            return self._piece(chunk)
        memo = self.memo  # a pre-token is a chunk of its own elsewhere
        return b"".join([memo[p] if len(p) < 64 and p != chunk else self._piece(p) for p in found])

    def encode(self, text: str) -> np.ndarray:
        chunks = self.chunks.findall(text)
        memo = self.memo
        return np.frombuffer(b"".join([memo[c] if len(c) < 64 else self._chunk(c) for c in chunks]), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


_loaded: dict[tuple[str, str], ByteBPE] = {}


def tokenizer(path: str, pattern: str) -> ByteBPE:
    """The vocabulary in this process, read once."""
    claim("byte-bpe")
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBPE(path, pattern)
    return _loaded[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``doc_id, ids``: token ids of each whole text."""
    prepare(docs.sparkSession)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        bpe = tokenizer(path, pattern)
        ids = [bpe.encode(t) for t in b.column(1).to_pylist()]
        flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
        return pa.record_batch([b.column(0), list_array(flat, [len(i) for i in ids], pa.int32())], ["doc_id", "ids"])

    return map_batches(docs.select("doc_id", text_of(text).alias("text")), run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, decoded``: the bytes of each list of ids; a null list decodes to no bytes."""
    prepare(encoded.sparkSession)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        bpe = tokenizer(path, pattern)
        out = [bpe.decode(np.array(x or [], np.uint32)) for x in b.column(1).to_pylist()]
        return pa.record_batch([b.column(0), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id bigint, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``doc_id, ids, decoded``: encode and decode in one pass over the texts."""
    prepare(docs.sparkSession)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        bpe = tokenizer(path, pattern)
        ids = [bpe.encode(t) for t in b.column(1).to_pylist()]
        flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
        return pa.record_batch(
            [b.column(0), list_array(flat, [len(i) for i in ids], pa.int32()), pa.array([bpe.decode(i) for i in ids], pa.binary())],
            ["doc_id", "ids", "decoded"],
        )

    return map_batches(docs.select("doc_id", text_of(text).alias("text")), run, "doc_id bigint, ids array<int>, decoded binary")


def digest(encoded: DataFrame) -> DataFrame:
    """The contract's digests of ``round_trip``'s rows."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
