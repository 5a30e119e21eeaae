"""Stores of annotations, point orders, columns and splats."""

from __future__ import annotations

import gzip

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .las import _open
from .parts import Pieces, read_ranges

_ANN = "point_id bigint, segment_id int, class_id int"


def decode_annotations(raw: bytes) -> np.ndarray:
    """Two bytes for each point, segment + 1 and class; gzip is accepted, an odd size is not."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    if len(raw) % 2:
        raise ValueError("an annotation store has two bytes for each point")
    return np.frombuffer(raw, np.uint8).reshape(-1, 2)


#: Points of an annotation store that one task reads or writes.
STRETCH = 1 << 20


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Annotated points only; the point id is the place in the store. Stretches are read in parallel, a compressed store whole."""
    fs, inner = _open(path)
    size = fs.get_file_info(inner).size
    with fs.open_input_file(inner) as f:
        packed = f.read(2) == b"\x1f\x8b"
    if not packed and size % 2:
        raise ValueError("an annotation store has two bytes for each point")

    def decode(at: int, raw: bytes) -> pa.RecordBatch:
        rows = decode_annotations(raw) if packed else np.frombuffer(raw, np.uint8).reshape(-1, 2)
        ids = np.flatnonzero(rows[:, 0])
        return pa.record_batch([pa.array(ids + at // 2), pa.array(rows[ids, 0].astype(np.int32) - 1), pa.array(rows[ids, 1].astype(np.int32))], ["point_id", "segment_id", "class_id"])

    step = size if packed else 2 * STRETCH
    return read_ranges(spark, path, [(a, min(step, size - a)) for a in range(0, size, step or 1)], decode, _ANN)


def write_annotations(df: DataFrame, path: str, points: int) -> int:
    """One store of ``points`` points from ``point_id, segment_id, class_id``; tasks write stretches of ids. The number of stretches."""
    spark = df.sparkSession
    stretches = -(-points // STRETCH)

    def stretch(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        first = key[0].as_py() * STRETCH
        out = np.zeros((min(STRETCH, points - first), 2), np.uint8)
        some = t.filter(pc.is_valid(t["point_id"]))
        at = some["point_id"].to_numpy() - first
        out[at, 0], out[at, 1] = some["segment_id"].to_numpy() + 1, some["class_id"].to_numpy()
        return pa.table([pa.array([key[0].as_py()]), pa.array([out.tobytes()], pa.binary())], ["stretch", "raw"])

    rows = df.filter(F.col("point_id").between(0, points - 1)).select(F.expr(f"point_id div {STRETCH}").alias("stretch"), "point_id", "segment_id", "class_id")
    every = spark.range(stretches).select(F.col("id").alias("stretch")).join(rows, "stretch", "left")
    made = every.groupBy("stretch").applyInArrow(stretch, "stretch bigint, raw binary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = made.repartitionByRange(parts, "stretch").sortWithinPartitions("stretch")
    return Pieces(made, path, lambda b: b"".join(b.column(1).to_pylist())).join(b"")


def encode_annotations(rows: list[tuple[int, int, int]], points: int) -> bytes:
    out = np.zeros((points, 2), np.uint8)
    for p, s, c in rows:
        out[p] = (s + 1, c)
    return out.tobytes()


def read_range(store: DataFrame, start: int, count: int, seq: str = "seq") -> DataFrame:
    """Rows ``start`` to ``start + count`` of a store that is sorted by sequence: statistics prune row groups."""
    return store.filter(F.col(seq).between(start, start + count - 1))


def byte_range(header: str, size: int) -> tuple[int, int] | None:
    """First and last byte of ``bytes=a-b``, ``a-`` or ``-n``; None if it can't be satisfied."""
    a, _, b = header.removeprefix("bytes=").partition("-")
    if not a and not b:
        return None
    first, last = (max(0, size - int(b)), size - 1) if not a else (int(a), min(int(b), size - 1) if b else size - 1)
    return (first, last) if first <= last and first < size else None


def write_versioned(df: DataFrame, folder: str, version: int) -> str:
    """A new version beside the old ones; a reader picks the last complete one."""
    path = f"{folder}/v={version}"
    df.write.mode("overwrite").parquet(path)
    return path


def versions(spark: SparkSession, folder: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    found = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith("v=")]
    return sorted(int(x.getName()[2:]) for x in found if fs.exists(jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS")))


def read_latest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/v={versions(spark, folder)[-1]}")


def write_splats(df: DataFrame, path: str) -> None:
    """Files are ranges of chunks in sequence: as many as shuffle partitions, not one for each chunk; statistics lead to a chunk's rows."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(parts, "chunk", "seq").sortWithinPartitions("chunk", "seq").write.mode("overwrite").parquet(path)


def read_splats(spark: SparkSession, path: str, source_order: bool = False) -> DataFrame:
    df = spark.read.parquet(path)
    return df.orderBy("splat_id") if source_order else df


def package(files: dict[str, bytes]) -> bytes:
    """A ZIP of named files, for downloads put together on the driver; names stay inside the archive's root."""
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in sorted(files.items()):
            if name.startswith("/") or ".." in name.split("/"):
                raise ValueError(f"not a name inside the archive: {name!r}")
            z.writestr(name, body)
    return out.getvalue()
