"""PLY files: point clouds and splats, binary of either byte order or ASCII."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .las import _open

#: Names of the scalar kinds (fixed values).
KINDS = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}
_SPARK = {"i1": T.ByteType(), "u1": T.ShortType(), "i2": T.ShortType(), "u2": T.IntegerType(), "i4": T.IntegerType(), "u4": T.LongType(), "f4": T.FloatType(), "f8": T.DoubleType()}
_ARROW = {"i1": pa.int8(), "u1": pa.int16(), "i2": pa.int16(), "u2": pa.int32(), "i4": pa.int32(), "u4": pa.int64(), "f4": pa.float32(), "f8": pa.float64()}


class PlyError(ValueError):
    """Not a PLY file that can be read."""


def read_header(path: str) -> dict:
    """Format, vertex count, properties and where the data begins."""
    fs, inner = _open(path)
    with fs.open_input_file(inner) as f:
        raw = f.read(1 << 16)
    end = raw.find(b"end_header")
    if raw[:3] != b"ply" or end < 0:
        raise PlyError(f"{path}: no PLY header")
    start = raw.index(b"\n", end) + 1
    out = {"path": path, "start": start, "count": 0, "properties": [], "format": ""}
    element = None
    for line in raw[:end].decode("latin-1").splitlines():
        w = line.split()
        if w[:1] == ["format"]:
            out["format"] = w[1]
        elif w[:1] == ["element"]:
            if element is None and w[1] != "vertex":
                raise PlyError(f"{path}: the first element is {w[1]}")
            element = w[1]
            if element == "vertex":
                out["count"] = int(w[2])
        elif w[:1] == ["property"] and element == "vertex":
            if w[1] == "list":
                raise PlyError(f"{path}: vertices have list properties")
            out["properties"].append((w[2], KINDS[w[1]]))
    if out["format"] != "ascii":
        order = ">" if "big" in out["format"] else "<"
        out["dtype"] = np.dtype([(n, order + k) for n, k in out["properties"]])
        if start + out["count"] * out["dtype"].itemsize > fs.get_file_info(inner).size:
            raise PlyError(f"{path}: the file is too short")
    return out


def read(spark: SparkSession, path: str, rows: int = 1 << 20) -> DataFrame:
    """One row for each vertex, with ``row`` its number. Binary files are read in parallel by row ranges."""
    h = read_header(path)
    names = [n for n, _ in h["properties"]]
    schema = T.StructType([T.StructField("row", T.LongType()), *[T.StructField(n, _SPARK[k]) for n, k in h["properties"]]])
    if h["format"] == "ascii":
        from pyspark.sql import functions as F

        text = spark.read.text(path, wholetext=True)
        lines = text.select(F.posexplode(F.split(F.element_at(F.split("value", "end_header\r?\n"), 2), "\r?\n")).alias("row", "line")).filter(F.col("row") < h["count"])
        parts = F.split(F.trim("line"), r"\s+")
        return lines.select(F.col("row").cast("long"), *[parts[i].cast("double").cast(_SPARK[k]).alias(n) for i, (n, k) in enumerate(h["properties"])])
    dtype, start = h["dtype"], h["start"]

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, inner = _open(path)
        for b in batches:
            for a, n in zip(*[c.to_pylist() for c in b.columns], strict=True):
                with fs.open_input_file(inner) as f:
                    f.seek(start + a * dtype.itemsize)
                    rec = np.frombuffer(f.read(n * dtype.itemsize), dtype)
                kinds = dict(h["properties"])
                yield pa.record_batch([pa.array(np.arange(a, a + n)), *[pa.array(rec[c].astype(kinds[c])).cast(_ARROW[kinds[c]]) for c in names]], ["row", *names])

    ranges = [(a, min(rows, h["count"] - a)) for a in range(0, h["count"], rows)]
    if not ranges:
        return spark.createDataFrame([], schema)
    return spark.createDataFrame(ranges, "a bigint, n bigint").repartition(len(ranges)).mapInArrow(load, schema)


def encode(table: pa.Table, names: list[str] | None = None, ascii_: bool = False) -> bytes:
    """A PLY file of numeric columns; kinds follow the columns' types, colours are bytes."""
    names = names or table.column_names
    kinds = [("uchar", "u1") if n in ("red", "green", "blue") else {"int32": ("int", "<i4"), "int64": ("uint", "<u4"), "int16": ("short", "<i2"), "float": ("float", "<f4"), "double": ("double", "<f8")}[str(table.schema.field(n).type)] for n in names]
    head = ["ply", f"format {'ascii' if ascii_ else 'binary_little_endian'} 1.0", f"element vertex {table.num_rows}", *[f"property {k} {n}" for n, (k, _) in zip(names, kinds, strict=True)], "end_header", ""]
    if ascii_:
        body = "".join(" ".join(f"{v:g}" if isinstance(v, float) else str(v) for v in row) + "\n" for row in zip(*[table.column(n).to_pylist() for n in names], strict=True)).encode()
    else:
        rec = np.zeros(table.num_rows, [(n, k) for n, (_, k) in zip(names, kinds, strict=True)])
        for n in names:
            rec[n] = table.column(n).to_numpy()
        body = rec.tobytes()
    return "\n".join(head).encode() + body


def write(df: DataFrame, path: str, order: list[str], names: list[str] | None = None) -> int:
    """One binary file with the rows in an order, and their number; tasks write the records, and the driver a header before them."""
    from .parts import Pieces

    names = names or df.columns
    empty = pa.schema([(n, {"int": pa.int32(), "bigint": pa.int64(), "smallint": pa.int16(), "float": pa.float32(), "double": pa.float64()}[dict(df.dtypes)[n]]) for n in names]).empty_table()

    def records(b: pa.RecordBatch) -> bytes:
        raw = encode(pa.Table.from_batches([b]).select(names))
        return raw[raw.index(b"end_header\n") + 11 :]

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(*names)
    pieces = Pieces(ordered, path, records)
    return pieces.join(encode(empty).replace(b"element vertex 0", f"element vertex {pieces.rows}".encode()))


#: Property order of an exported splat file after the position (fixed values).
NORMALS = ("nx", "ny", "nz")


def splat_properties(rest: int, scales: int = 3) -> list[str]:
    return ["x", "y", "z", *NORMALS, *[f"f_dc_{k}" for k in range(3)], *[f"f_rest_{k}" for k in range(rest)], "opacity", *[f"scale_{k}" for k in range(scales)], *[f"rot_{k}" for k in range(4)]]
