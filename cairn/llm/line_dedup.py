"""Line dedup: first occurrences by a range partition of line hashes.

1. Every line with a long enough key gives ``(hash, doc_id, row, position)``, the hash having 128
   bits; these rows, not the texts, are written to the shared folder.
2. They are range-partitioned and sorted by hash, then document, then position. Because the
   document and the position are part of the range, a line that a third of all documents hold is
   spread over many partitions. Each partition streams its runs of equal hashes, a batch at a time:
   a line is dropped if its document isn't the run's first. Only a partition's first run can have
   begun before it; its rows wait until one summary row for each partition has said which document
   came first.
3. Dropped positions are gathered by document into zlib-compressed bitmaps (bit set: line kept).

Defined cases: a null or empty text is one empty line; keys shorter than ``LEAST_CHARS`` code points
are never dropped; a null ``doc_id`` is one document that comes before all others; rows that repeat
a ``doc_id`` count as one document, each row losing its own lines; other columns are ignored by
``keep_bitmaps`` and kept by ``apply``; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WorkTables, list_array, map_batches, prepare, text_of

LEAST_CHARS = 10
_BLANK = b" \t\n\v\f\r"


def _row_key(text: str = "text") -> Column:
    return F.xxhash64(text_of(text))


def line_keys(raw: bytes, least: int = LEAST_CHARS) -> list[tuple[int, bytes]]:
    """Positions and keys of the lines that can be dropped."""
    out = []
    for i, line in enumerate(raw.lower().split(b"\n")):
        key = line.strip(_BLANK)
        if len(key) >= least and (len(key) >= 4 * least or len(key.decode()) >= least):
            out.append((i, key))
    return out


def occurrences(docs: DataFrame, text: str = "text", least: int = LEAST_CHARS) -> DataFrame:
    """``h1, h2, doc_id, row, pos`` of every line with a key."""
    import xxhash

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        h1, h2, pos, count = [], [], [], []
        for raw in b.column(2).to_pylist():
            keys = line_keys(raw, least)
            count.append(len(keys))
            for i, key in keys:
                d = xxhash.xxh3_128_digest(key)
                h1.append(d[:8])
                h2.append(d[8:])
                pos.append(i)
        rows = pa.array(np.repeat(np.arange(b.num_rows), count))
        as_long = lambda x: pa.array(np.frombuffer(b"".join(x), "<i8"), pa.int64())
        return pa.record_batch([as_long(h1), as_long(h2), b.column(0).take(rows), b.column(1).take(rows), pa.array(pos, pa.int32())], ["h1", "h2", "doc_id", "row", "pos"])

    return map_batches(docs.select("doc_id", _row_key(text).alias("row"), text_of(text).cast("binary").alias("text")), run, "h1 bigint, h2 bigint, doc_id bigint, row bigint, pos int")


DECIDED, WAITING, SUMMARY = 0, 1, 2
_DECISIONS = "kind int, part int, doc_id bigint, row bigint, pos int, first_h1 bigint, first_h2 bigint, last_h1 bigint, last_h2 bigint, last_doc bigint, first_doc bigint"


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Decide the lines of one sorted partition."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    names = [c.split()[0] for c in _DECISIONS.split(", ")]
    head = None  # hash of the first run and its first document
    last = None  # hash of the current run, its first document, whether that is null
    in_head = True

    def rows(kind: int, b: pa.RecordBatch, keep: np.ndarray) -> pa.RecordBatch:
        some = b.filter(pa.array(keep))
        n = some.num_rows
        empty = pa.nulls(n, pa.int64())
        return pa.record_batch([pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, part, np.int32)), some.column(2), some.column(3), some.column(4)] + [empty] * 6, names)

    for b in batches:
        if not b.num_rows:
            continue
        h1, h2 = (b.column(k).to_numpy() for k in (0, 1))
        null = b.column(2).is_null().to_numpy(zero_copy_only=False)
        doc = b.column(2).fill_null(0).to_numpy()
        begins = np.empty(len(h1), bool)
        begins[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        begins[0] = last is None or last[:2] != (h1[0], h2[0])
        at = np.maximum.accumulate(np.where(begins, np.arange(len(h1)), -1))
        first, first_null = doc[np.maximum(at, 0)], null[np.maximum(at, 0)]
        if not begins[0]:
            first = np.where(at < 0, last[2], first)
            first_null = np.where(at < 0, last[3], first_null)
        if head is None:
            head = (h1[0], h2[0], doc[0], null[0])
        same = (doc == first) & (null == first_null)
        ours = np.zeros(len(h1), bool)
        if in_head:
            ours = (h1 == head[0]) & (h2 == head[1])
            in_head = bool(ours[-1])
        for kind, keep in ((WAITING, ours), (DECIDED, ~ours & ~same)):
            if keep.any():
                yield rows(kind, b, keep)
        last = (h1[-1], h2[-1], first[-1], first_null[-1])
    if head is not None:
        values = [SUMMARY, part, None, None, None, int(head[0]), int(head[1]), int(last[0]), int(last[1]), None if last[3] else int(last[2]), None if head[3] else int(head[2])]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()] + [pa.int64()] * 6
        yield pa.record_batch([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)


def dropped_lines(docs: DataFrame, work: WorkTables, text: str = "text", least: int = LEAST_CHARS) -> DataFrame:
    """``doc_id, row, pos`` of every line to drop."""
    spark = prepare(docs.sparkSession)
    found = work.keep(occurrences(docs, text, least), "occurrences")
    order = ["h1", "h2", "doc_id", "pos"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    decisions = work.keep(found.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_stream, _DECISIONS), "decisions")
    work.drop("occurrences")
    summaries = sorted(decisions.filter(F.col("kind") == SUMMARY).select("part", "first_h1", "first_h2", "last_h1", "last_h2", "last_doc", "first_doc").collect())
    truth: list[tuple[int, int | None]] = []  # for each partition the document that came first in its first run
    run: tuple | None = None
    for part, a1, a2, z1, z2, last_doc, first_doc in summaries:
        begun = run is not None and run[0] == (a1, a2)
        truth.append((part, run[1] if begun else first_doc))
        if (z1, z2) != (a1, a2):
            run = ((z1, z2), last_doc)
        elif not begun:
            run = ((a1, a2), first_doc)
    firsts = F.broadcast(spark.createDataFrame(truth, "part int, truth bigint"))  # one row for each partition
    waiting = decisions.filter(F.col("kind") == WAITING).join(firsts, "part").filter(~F.col("doc_id").eqNullSafe(F.col("truth")))
    return decisions.filter(F.col("kind") == DECIDED).select("doc_id", "row", "pos").unionByName(waiting.select("doc_id", "row", "pos"))


def compress_bitmap(dropped: np.ndarray) -> bytes:
    keep = np.ones(int(dropped.max()) + 1 if len(dropped) else 0, bool)
    keep[dropped] = False
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 6)


def keep_bitmaps(docs: DataFrame, work: WorkTables, text: str = "text", least: int = LEAST_CHARS) -> DataFrame:
    """``doc_id, row, n_dropped, last_dropped, keep``: a compressed bitmap for each document that loses a line.

    ``row`` is a hash of the text, so rows that share an id keep separate bitmaps; the bitmap covers
    lines 0 to ``last_dropped`` and all later lines are kept.
    """
    dropped = dropped_lines(docs, work, text, least).groupBy("doc_id", "row").agg(F.collect_set("pos").alias("gone"))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        gone = [np.array(x, np.int64) for x in b.column(2).to_pylist()]
        return pa.record_batch(
            [b.column(0), b.column(1), pa.array([len(x) for x in gone], pa.int64()), pa.array([int(x.max()) for x in gone], pa.int64()), pa.array([compress_bitmap(x) for x in gone], pa.binary())],
            ["doc_id", "row", "n_dropped", "last_dropped", "keep"],
        )

    return map_batches(dropped, run, "doc_id bigint, row bigint, n_dropped bigint, last_dropped bigint, keep binary")


def lines_kept(raw: bytes, bitmap: bytes | None, last: int | None) -> tuple[int, int, bytes]:
    """Lines before, lines dropped, and the rest joined again."""
    lines = raw.split(b"\n")
    if bitmap is None:
        return len(lines), 0, raw
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little")[: last + 1]
    stay = [x for x, k in zip(lines, bits, strict=False) if k] + lines[last + 1 :]
    return len(lines), len(lines) - len(stay), b"\n".join(stay)


def _with_bitmaps(docs: DataFrame, work: WorkTables, text: str) -> DataFrame:
    """``row``, a struct of the input's columns, so that their names meet no others, with ``last`` and ``keep``."""
    bitmaps = work.keep(keep_bitmaps(docs, work, text).select(F.col("doc_id").alias("doc"), F.col("row").alias("text_row"), F.col("last_dropped").alias("last"), "keep"), "bitmaps")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id").alias("own"), _row_key(text).alias("own_row"))
    return rows.join(bitmaps, rows["own"].eqNullSafe(bitmaps["doc"]) & (rows["own_row"] == bitmaps["text_row"]), "left").select("row", "last", "keep")


def digest(docs: DataFrame, work: WorkTables, text: str = "text") -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` of every row."""
    joined = _with_bitmaps(docs.select("doc_id", F.col(text).alias("text")), work, "text").select("row.doc_id", text_of("row.text").cast("binary").alias("text"), "last", "keep")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        got = [lines_kept(*x) for x in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(2).to_pylist(), strict=True)]
        return pa.record_batch(
            [b.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([hashlib.sha256(g[2]).hexdigest() for g in got], pa.string())],
            ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
        )

    return map_batches(joined, run, "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string")


def apply(docs: DataFrame, work: WorkTables) -> DataFrame:
    """The rows with all their columns, ``text`` without its dropped lines and ``n_chars`` to match."""
    joined = _with_bitmaps(docs, work, "text")
    names = docs.columns
    n_chars = names.index("n_chars") if "n_chars" in names else None

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts, counts = b.column(0).to_pylist(), b.column(1).to_pylist() if n_chars is not None else None
        for i, (stop, keep) in enumerate(zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True)):
            if keep is not None:
                before = texts[i]
                texts[i] = lines_kept((before or "").encode(), keep, stop)[2].decode()
                if counts is not None and before is not None:
                    counts[i] = len(texts[i])
        made = [b.column(b.num_columns - 3), pa.array(texts, pa.string())]
        return pa.record_batch([*made, pa.array(counts, pa.int64())] if counts is not None else made, ["row", "text", "n_chars"][: len(made) + (counts is not None)])

    # Python sees the text and its count; the other columns pass it by in a struct, whatever their names
    others = [c for c in names if c not in ("text", "n_chars")]
    counted = ["row.n_chars"] if n_chars is not None else []
    source = joined.select(F.col("row.text").alias("text"), *[F.col(c).cast("bigint").alias("n_chars") for c in counted], F.struct(*[F.col("row").getField(c).alias(f"c{i}") for i, c in enumerate(others)], F.lit(0).alias("none")).alias("rest"), "last", "keep")
    schema = T.StructType([T.StructField("row", source.schema["rest"].dataType), T.StructField("text", T.StringType()), *[T.StructField("n_chars", T.LongType()) for _ in counted]])
    done = source.mapInArrow(lambda batches: map(run, batches), schema)
    made = {c: F.col("row").getField(f"c{i}") for i, c in enumerate(others)} | {"text": F.col("text")}
    if counted:
        made["n_chars"] = F.col("n_chars").cast(docs.schema["n_chars"].dataType)
    return done.select(*[made[c].alias(c) for c in names])


def sql() -> str:
    return rf"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= {LEAST_CHARS} GROUP BY key),
m AS (SELECT k.doc_id, i, line, coalesce(f.first_doc <> k.doc_id, FALSE) AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
