"""Benchmark decontamination: size-partitioned MinHash containment search.

Benchmark items are short and documents long, so their Jaccard similarity is small even when a
document holds a whole item; the search is for containment, the share of the item's shingles that
the document has. Items are dealt into partitions by their number of shingles, and each partition has an
index and a threshold of its own:

* An item's sketch is its smallest shingle hashes (bottom-k MinHash). With the partition's upper bound
  ``u`` on the size and threshold ``t``, ``k = u - ceil(t * u) + 1`` hashes are enough that a document which
  holds a share ``t`` of the item holds at least one of them.
* All those hashes lie under the largest of the partition's sketches, the partition's ceiling. A document's sketch
  for the partition is its hashes up to that ceiling, the larger the items the fewer of them; only these are looked up.

So the search loses nothing. Candidates are verified by exact containment of the word shingles themselves.

Documents are read once where they lie, without a shuffle. The index is sent to executors in blocks
of at most ``BLOCK_BYTES`` of item text, whose index of numpy arrays is smaller than four times that; a larger
benchmark takes more blocks, each against all documents.

Defined cases: a null text has no words and holds nothing; an item without words or with a null text
is never found; an item of fewer than five words is one shingle of all its words; repeated items and
documents are reported each for itself, and of items or documents alike all; null ids are kept; other columns
are ignored by ``matches`` and kept by ``drop_contaminated``; an empty table of documents gives an empty
table, and without items nothing is found and all documents are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_runs, hash_words, prepare, shingle_hashes, text_of, uncollected, words_of

WIDTH = 5
THRESHOLD = 0.75
BLOCK_BYTES = 16 << 20
_TABLE = 20  # bits of the table that sorts out most hashes
#: Items whose shingles a worker keeps.
KEPT_ITEMS = 2000


def size_class(n: int) -> int:
    """The upper bound of the class of a set of ``n`` shingles; bounds grow by half."""
    u = 4
    while u < n:
        u += u // 2
    return u


def sketch_size(n: int, threshold: float = THRESHOLD) -> int:
    u = size_class(n)
    return min(n, u - math.ceil(threshold * u) + 1)


class Partition:
    """Sketches of the items of one size class and shingle width: sorted hashes, and the items of each."""

    def __init__(self, sketches: list[tuple[int, np.ndarray]]):
        flat = np.concatenate([h for _, h in sketches])
        owner = np.repeat(np.array([k for k, _ in sketches], np.int32), [len(h) for _, h in sketches])
        order = np.argsort(flat, kind="stable")
        self.hashes, self.items = flat[order], owner[order]
        self.ceiling = self.hashes[-1]
        self.table = np.zeros(1 << _TABLE, bool)
        self.table[self._slot(self.hashes)] = True

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (h & np.uint64((1 << _TABLE) - 1)).astype(np.int64)

    def candidates(self, h: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Distinct ``(document, item)`` rows of documents whose sketch shares a hash with an item's."""
        some = np.flatnonzero(h <= self.ceiling)
        some = some[self.table[self._slot(h[some])]]
        low, high = (np.searchsorted(self.hashes, h[some], side) for side in ("left", "right"))
        times = high - low
        if not times.any():
            return np.zeros((0, 2), np.int64)
        at = np.repeat(low - (np.cumsum(times) - times), times) + np.arange(times.sum())
        return np.unique(np.stack([np.repeat(doc[some], times), self.items[at]], 1).astype(np.int64), axis=0)


class Index:
    """A block of items: their texts and the partitions of their sketches, by shingle width and size class."""

    def __init__(self, items: list[tuple[int | None, str | None]], threshold: float = THRESHOLD):
        self.threshold = threshold
        self.ids, self.texts = [], []
        sketches: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
        for item, text in items:
            words = words_of(text)
            if not words:
                continue
            h = np.unique(shingle_hashes(words, WIDTH))
            sketches.setdefault((min(WIDTH, len(words)), size_class(len(h))), []).append((len(self.ids), h[: sketch_size(len(h), threshold)]))
            self.ids.append(item)
            self.texts.append(text)
        self.partitions: dict[int, list[Partition]] = {}
        for (width, _), some in sorted(sketches.items(), key=lambda x: x[0]):
            self.partitions.setdefault(width, []).append(Partition(some))
        self._kept: dict[int, tuple[int, set]] = {}

    def _item(self, k: int) -> tuple[int, set[tuple[str, ...]]]:
        if k not in self._kept:
            if len(self._kept) >= KEPT_ITEMS:
                self._kept.clear()
            words = words_of(self.texts[k])
            width = min(WIDTH, len(words))
            self._kept[k] = width, set(zip(*[words[i:] for i in range(width)], strict=False))
        return self._kept[k]

    def search(self, texts: pa.Array) -> list[tuple[int, int | None, int, int]]:
        """Text's number, item, shared shingles and the item's shingles, of all items that the texts hold, by text and item."""
        words, counts = hash_words(texts)
        found = []
        for width, partitions in self.partitions.items():
            h, lengths = hash_runs(words, counts, width)
            doc = np.repeat(np.arange(len(lengths)), lengths)
            found += [p.candidates(h, doc) for p in partitions]
        out, last, own = [], None, {}
        for d, k in sorted(map(tuple, np.concatenate([*found, np.zeros((0, 2), np.int64)]).tolist())):
            width, item = self._item(k)
            if d != last:
                last, own = d, {0: words_of(texts[d].as_py())}
            if width not in own:
                own[width] = set(zip(*[own[0][i:] for i in range(width)], strict=False))
            shared = len(item & own[width])
            if shared >= self.threshold * len(item):
                out.append((d, self.ids[k], shared, len(item)))
        return out


_SCHEMA = "doc_id bigint, item_id bigint, n_shared bigint, n_item bigint, containment double"


def _blocks(items: DataFrame, item_text: str) -> Iterator[Index]:
    """The benchmark in blocks of bounded size."""
    rows = items.select("item_id", F.col(item_text).alias("text")).filter(F.col("text").isNotNull())
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    n = max(1, -(-size // BLOCK_BYTES))
    for k in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield Index(sorted(((r.item_id, r.text) for r in part.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1])))


def matches(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text") -> DataFrame:
    """``doc_id, item_id, n_shared, n_item, containment`` of every document and item it holds."""
    spark = prepare(docs.sparkSession)
    source = docs.select("doc_id", text_of(text).alias("text"))
    out = None
    for index in _blocks(items, item_text):
        sent = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for b in batches:
                rows = index.search(b.column(1))
                if rows:
                    doc, item, shared, size = zip(*rows, strict=True)
                    cols = [b.column(0).take(pa.array(doc)), *[pa.array(c, pa.int64()) for c in (item, shared, size)]]
                    share = pa.array([a / n for a, n in zip(shared, size, strict=True)], pa.float64())
                    yield pa.record_batch([*cols, share], [c.split()[0] for c in _SCHEMA.split(", ")])

        found = source.mapInArrow(uncollected(run), _SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows, with all their columns, that hold no benchmark item."""
    spark = prepare(docs.sparkSession)
    where = docs.columns.index("text")
    for index in _blocks(items, "text"):
        sent = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[d for d, *_ in index.search(b.column(where))]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(uncollected(run), docs.schema)
    return docs


def sql() -> str:
    shingle = " || ' ' || ".join(f"ws[i + {k}]" if k else "ws[i]" for k in range(WIDTH))
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    one = lambda name, key, table: rf"""
{name}0 AS (SELECT {key}, regexp_extract_all({lower}, '[^\x20\x09-\x0D]+') AS ws FROM {table}),
{name}1 AS (SELECT {key}, ws, unnest(range(1, len(ws) - {WIDTH - 2})) AS i FROM {name}0 WHERE len(ws) >= {WIDTH}),
{name} AS (SELECT DISTINCT {key}, {shingle} AS s FROM {name}1)"""  # noqa: E731
    return f"""
WITH {one('b', 'item_id', 'benchmark')},{one('d', 'doc_id', 'documents')},
n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN b ON d.s = b.s GROUP BY doc_id, item_id)
SELECT doc_id, m.item_id, n_shared, n_item, CAST(n_shared AS DOUBLE) / CAST(n_item AS DOUBLE) AS containment
FROM m JOIN n ON m.item_id = n.item_id WHERE 100 * n_shared >= {round(100 * THRESHOLD)} * n_item
"""
