"""Plumbing shared by the training-data operators.

Work tables go to the folder that ``spark.checkpoint.dir`` names, the only place that every
executor and the driver can see. A temporary folder is made only where that setting is absent and
all of Spark runs on this machine (as in tests); on a cluster its absence is an error. What is left
of them when the driver ends is deleted then.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..work import new_path, ship

#: Rows and bytes of one Arrow batch; a longer document is a batch of its own.
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20

#: ASCII white space of the word and line contracts.
BLANK = " \t\n\v\f\r"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def prepare(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches, where the session says nothing itself, and give executors this package, once for each application."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        if not spark.conf._jconf.contains(f"spark.sql.execution.arrow.{name}"):
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    ship(spark)
    return spark


_collected: list[list[WorkTables]] = []


@contextmanager
def collecting():
    """The work tables begun inside, so that who writes a result can clear() them afterwards."""
    _collected.append([])
    try:
        yield _collected[-1]
    finally:
        _collected.pop()


class WorkTables:
    """Tables written to the shared folder, so that lost executors lose no work.

    A result may be read from them until it is written; then clear() deletes what is left, drop() some.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = new_path(spark, name)
        self.made: list[str] = []
        for made in _collected:
            made.append(self)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def keep(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        writer = df.write
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(self.path(name))
        self.made.append(name)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def release(self) -> None:
        """Let Spark delete the shuffle files of steps whose results are written."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.path(name))

    def clear(self) -> None:
        self._delete(self.base)

    def _delete(self, path: str) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Bits of the bitmap of ``likely_in``: 4 MB whatever the input.
BITMAP_BITS = 25


def _marked_in(df: DataFrame, key: str, ids: DataFrame, how: str) -> tuple[DataFrame, Column]:
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << BITMAP_BITS))
    p = place(ids.columns[0])
    maps = ids.select(F.shiftright(p, 15).cast("int").alias("__bucket"), p.bitwiseAND(F.lit(32767)).alias("__bit")).groupBy("__bucket").agg(F.bitmap_construct_agg("__bit").alias("__map"))
    at = place(key)
    byte = F.expr("cast(conv(hex(substring(__map, cast(__bit div 8 as int) + 1, 1)), 16, 10) as int)")
    marked = df.withColumn("__bucket", F.shiftright(at, 15).cast("int")).withColumn("__bit", at.bitwiseAND(F.lit(32767)))
    return marked.join(F.broadcast(maps), "__bucket", how), byte.bitwiseAND(F.expr("cast(pow(2, __bit % 8) as int)"))


def likely_in(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows whose key's hash is set in a bitmap of the ids' hashes: all that are among the ids, and a few more.

    Put before a join of wide rows with a small part of their keys, so that only those rows are
    shuffled. The bitmap's size is fixed; with very many ids it lets more rows through.
    """
    marked, bit = _marked_in(df, key, ids, "inner")
    return marked.filter(bit != 0).select(*df.columns)


def unlikely_in(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows that ``likely_in`` leaves out."""
    marked, bit = _marked_in(df, key, ids, "left")
    return marked.filter(F.coalesce(bit, F.lit(0)) == 0).select(*df.columns)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


@contextmanager
def no_collector():
    """Without Python's cycle collector, which walks the long lists of words again and again; they have no cycles."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def uncollected(run: Callable) -> Callable:
    """A batch generator that runs without the cycle collector."""

    @wraps(run)
    def inner(batches):
        with no_collector():
            yield from run(batches)

    return inner


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply a function to each Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            with no_collector():
                out = fn(b)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


_holders: list[tuple[str, Callable[[], None]]] = []
_claimed = [""]


def hold(owner: str, clear: Callable[[], None]) -> None:
    """Name the owner of what a worker process keeps between batches."""
    _holders.append((owner, clear))


def claim(owner: str) -> None:
    """A worker serves one operator after the other: what the others have kept goes."""
    if _claimed[0] != owner:
        _claimed[0] = owner
        for name, clear in _holders:
            if name != owner:
                clear()


class Memo(dict):
    """A bounded memo: filled by ``make``, emptied when full, so that its size never follows the input."""

    def __init__(self, make: Callable, limit: int = 700_000, owner: str = "words"):
        super().__init__()
        self.make, self.limit = make, limit
        hold(owner, self.clear)

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


def list_array(values: np.ndarray, lengths, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def ascii_lower(text: str) -> str:
    """A-Z in lower case, all else as it is (bytes know ASCII letters only)."""
    return text.lower() if text.isascii() else text.encode().lower().decode()


def words_of(text: str | None) -> list[str]:
    """Words of a text after lower-casing A-Z; none for null."""
    return WORDS.findall(ascii_lower(text)) if text else []


_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Words of more bytes are hashed one by one.
_LONG = 64


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in one array and where each begins (one more than texts); null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or at[0] == at[-1]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and byte after the last of every word, and the number of words of each text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at) - 1, np.int64)
    word = ~_SPACE[data]
    some = at[:-1] < at[1:]
    edge, end = at[:-1][some], at[1:][some] - 1
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    begins[edge] = word[edge]
    ends[:-1] &= ~word[1:]
    ends[end] = word[end]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.diff(np.searchsorted(starts, at))


def _finish(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= _MULTIPLY
    h ^= h >> np.uint64(29)
    return h


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span after lower-casing A-Z: eight bytes at a time, all spans at once."""
    import xxhash

    low = np.zeros(len(data) + 8, np.uint8)
    np.take(_LOWER, data, out=low[: len(data)])
    eight = np.ndarray(len(data) + 1, "<u8", low, strides=(1,))
    length = ends - starts
    h = length.astype(np.uint64)
    h *= _MULTIPLY
    some: np.ndarray | slice = slice(None)
    for k in range(0, _LONG, 8):
        if k:
            some = np.flatnonzero(length > k)
            if not len(some):
                break
        x = eight[starts[some] + k]
        x &= _MASK[np.minimum(length[some] - k, 8)]
        x ^= h[some]
        h[some] = _finish(x)
    for i in np.flatnonzero(length > _LONG).tolist():
        h[i] = xxhash.xxh64_intdigest(low[starts[i] : ends[i]].tobytes())
    return h


def hash_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, in order, and the number of words of each text."""
    data, at = text_bytes(texts)
    starts, ends, counts = word_spans(data, at)
    return hash_spans(data, starts, ends), counts


def hash_runs(h: np.ndarray, counts: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all runs of ``width`` words of each text, in order, and their number; of the whole sequence if it is shorter."""
    first = np.cumsum(counts) - counts
    n = len(h)
    padded = np.concatenate([h, np.zeros(width, np.uint64)])

    def rolled(at: np.ndarray | slice, w: int) -> np.ndarray:
        out = padded[:n][at].copy()
        for k in range(1, w):
            out ^= out >> np.uint64(29)
            out *= _MULTIPLY
            out += padded[k : n + k][at]
        out ^= out >> np.uint64(32)
        out *= _MULTIPLY
        return out

    out = rolled(slice(None), width)
    for m in range(1, width):
        short = first[counts == m]
        if len(short):
            out[short] = rolled(short, m)
    lengths = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    keep = np.arange(n) - np.repeat(first, counts) < np.repeat(lengths, counts)
    return out[keep], lengths


def shingles_of(texts: pa.Array, width: int = 5) -> list[np.ndarray]:
    """For each text the hashes of its runs of ``width`` words."""
    h, lengths = hash_runs(*hash_words(texts), width)
    return np.split(h, np.cumsum(lengths)[:-1]) if len(lengths) else []


def shingle_hashes(words: list[str], width: int = 5) -> np.ndarray:
    """As ``shingles_of`` for a list of words."""
    return shingles_of(pa.array([" ".join(words)], pa.string()), width)[0]
