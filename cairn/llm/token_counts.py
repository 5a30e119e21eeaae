"""Token counts by heap-and-linked-list byte-pair merging.

The symbols of a text are a linked list; a heap holds the adjacent pairs that are pieces, lowest
rank (highest score) first, leftmost first among equals. The count is the number of initial symbols
minus the number of merges; no ids are made. A character that is no piece counts as its UTF-8 bytes
(byte fallback).

Texts are cut where no piece can cross, before a run of spaces and around line feeds, and the counts
of the parts are memoised with a bound. ``Pieces`` checks on loading that no piece has a space after
another character and none holds a line feed; if one did, texts would be merged whole.

Defined cases: a null or empty text has no bytes and no tokens; a null ``doc_id`` is kept; repeated
rows are counted one by one; other columns of the input are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, claim, map_batches, prepare, text_of

SPACE = "▁"


class Pieces:
    """Merge ranks of a sentencepiece BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        order = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in normal}, reverse=True))}
        self.rank = {sp.id_to_piece(i): order[sp.get_score(i)] for i in normal}
        self.cuts = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.rank)
        self.parts = re.compile(f"{SPACE}*[^{SPACE}\n]+|\n|{SPACE}+")
        self.memo = Memo(self.merge, 700_000, "pieces")

    def merge(self, text: str) -> int:
        """Initial symbols minus merges."""
        rank = self.rank
        n = len(text)
        total = sum([1 if c in rank else len(c.encode()) for c in text])
        end = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = [(rank[p], i, i + 2) for i in range(n - 1) if (p := text[i : i + 2]) in rank]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not alive[i] or j >= n or end[j] != stop:
                continue
            alive[j] = False
            end[i] = stop
            total -= 1
            if stop < n:
                before[stop] = i
                p = text[i : end[stop]]
                if p in rank:
                    heapq.heappush(heap, (rank[p], i, end[stop]))
            h = before[i]
            if h >= 0:
                p = text[h:stop]
                if p in rank:
                    heapq.heappush(heap, (rank[p], h, stop))
        return total

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = SPACE + text.replace(" ", SPACE)
        if not self.cuts:
            return self.merge(text)
        memo = self.memo
        return sum([memo[p] if len(p) < 64 else self.merge(p) for p in self.parts.findall(text)])


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    claim("pieces")
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def count_tokens(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of each whole text."""
    prepare(docs.sparkSession)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        model = pieces(path)
        return pa.record_batch([b.column(0), b.column(2), pa.array([model.count(t) for t in b.column(1).to_pylist()], pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return map_batches(docs.select("doc_id", text_of(text).alias("text"), F.octet_length(text_of(text)).cast("long").alias("n_bytes")), run, "doc_id bigint, n_bytes bigint, n_tokens bigint")
