"""LAS files as a Spark data source: schema from the header, row ranges as partitions, Arrow batches.

``spark.read.format("las").load(path)`` after ``register(spark)``. Option ``columns`` (comma separated) reads
those fields only; record bytes are viewed, not parsed, so other fields cost nothing but the read. Paths go
through pyarrow's file systems. Writing makes one canonical file (1.2, format 3, extra columns as Extra
Bytes) for each partition under a temporary name and renames all on commit: ``append`` adds files to those that are
there, ``overwrite`` deletes them first. A task holds one batch of rows.

Unsigned 32-bit fields are BIGINT: an id never passes through a float.
"""

from __future__ import annotations

import struct
import tempfile
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Fields of the record formats: name, numpy kind, byte offset (fixed values of the LAS specification).
_LEGACY = [("X", "<i4", 0), ("Y", "<i4", 4), ("Z", "<i4", 8), ("intensity", "<u2", 12), ("return_bits", "u1", 14), ("classification", "u1", 15), ("scan_angle", "i1", 16), ("user_data", "u1", 17), ("point_source_id", "<u2", 18)]
_MODERN = [("X", "<i4", 0), ("Y", "<i4", 4), ("Z", "<i4", 8), ("intensity", "<u2", 12), ("return_bits", "u1", 14), ("flags", "u1", 15), ("classification", "u1", 16), ("user_data", "u1", 17), ("scan_angle", "<i2", 18), ("point_source_id", "<u2", 20), ("gps_time", "<f8", 22)]
_RGB = ("red", "green", "blue")
_COLOUR_AT = {2: 20, 3: 28, 5: 28, 7: 30, 8: 30, 10: 30}
_TIME_AT = {1: 20, 3: 20, 4: 20, 5: 20}
_RECORD = {0: 20, 1: 28, 2: 26, 3: 34, 4: 57, 5: 63, 6: 30, 7: 36, 8: 38, 9: 59, 10: 67}
#: Extra Bytes kinds 1 to 10 (fixed values); 11 to 30 are two or three of them and are sized but not read.
_EXTRA = ["", "u1", "i1", "<u2", "<i2", "<u4", "<i4", "<u8", "<i8", "<f4", "<f8"]

LEAST_ROWS, MOST_ROWS = 1 << 16, 1 << 22


class LasError(ValueError):
    """Not a LAS file that can be read."""


@dataclass
class Header:
    path: str
    version: tuple[int, int]
    fmt: int
    offset: int
    record: int
    count: int
    scale: tuple[float, float, float]
    origin: tuple[float, float, float]
    low: tuple[float, float, float]
    high: tuple[float, float, float]
    fields: list[tuple[str, str, int]] = field(default_factory=list)

    @property
    def canonical(self) -> bool:
        return self.version == (1, 2) and self.fmt == 3

    @property
    def dtype(self) -> np.dtype:
        return np.dtype({"names": [f[0] for f in self.fields], "formats": [f[1] for f in self.fields], "offsets": [f[2] for f in self.fields], "itemsize": self.record})


def _open(path: str):
    fs, inner = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    return fs, inner


def read_header(path: str) -> Header:
    fs, inner = _open(path)
    size = fs.get_file_info(inner).size
    with fs.open_input_file(inner) as f:
        raw = f.read(375)
        if raw[:4] != b"LASF":
            raise LasError(f"{path}: no LAS signature")
        header_size, offset, vlrs, fmt, record, legacy = struct.unpack_from("<HIIBHI", raw, 94)
        if fmt & 0xC0:
            raise LasError(f"{path}: compressed LAS is not supported")
        fmt &= 0x3F
        if fmt not in _RECORD or record < _RECORD[fmt]:
            raise LasError(f"{path}: point format {fmt} with {record} bytes")
        version = (raw[24], raw[25])
        scale, origin = struct.unpack_from("<3d", raw, 131), struct.unpack_from("<3d", raw, 155)
        b = struct.unpack_from("<6d", raw, 179)
        count = legacy if legacy or version < (1, 4) else struct.unpack_from("<Q", raw, 247)[0]
        if offset + count * record > size:
            raise LasError(f"{path}: {count} records don't fit in {size} bytes")
        fields = list(_MODERN if fmt >= 6 else _LEGACY)
        if fmt in _TIME_AT:
            fields.append(("gps_time", "<f8", _TIME_AT[fmt]))
        if fmt in _COLOUR_AT:
            fields += [(c, "<u2", _COLOUR_AT[fmt] + 2 * k) for k, c in enumerate(_RGB)]
        at, extra = header_size, _RECORD[fmt]
        for _ in range(vlrs):
            f.seek(at)
            v = f.read(54)
            user, number, length = v[2:18].rstrip(b"\0"), *struct.unpack_from("<HH", v, 18)
            if user == b"LASF_Spec" and number == 4:
                body = f.read(length)
                for k in range(length // 192):
                    d = body[192 * k : 192 * (k + 1)]
                    kind, name = d[2], d[4:36].split(b"\0")[0].decode("latin-1")
                    if kind == 0:
                        extra += d[3]
                    elif kind <= 10:
                        fields.append((name, _EXTRA[kind], extra))
                        extra += np.dtype(_EXTRA[kind]).itemsize
                    else:
                        extra += np.dtype(_EXTRA[(kind - 1) % 10 + 1]).itemsize * ((kind - 1) // 10 + 1)
            at += 54 + length
        fields = [x for x in fields if x[2] + np.dtype(x[1]).itemsize <= record]
        return Header(path, version, fmt, offset, record, count, scale, origin, (b[1], b[3], b[5]), (b[0], b[2], b[4]), fields)


_SPARK = {"u1": T.ShortType(), "i1": T.ByteType(), "<u2": T.IntegerType(), "<i2": T.ShortType(), "<u4": T.LongType(), "<i4": T.IntegerType(), "<u8": T.DecimalType(20, 0), "<i8": T.LongType(), "<f4": T.FloatType(), "<f8": T.DoubleType()}
_ARROW = {"u1": pa.int16(), "i1": pa.int8(), "<u2": pa.int32(), "<i2": pa.int16(), "<u4": pa.int64(), "<i4": pa.int32(), "<u8": pa.decimal128(20, 0), "<i8": pa.int64(), "<f4": pa.float32(), "<f8": pa.float64()}


def block_rows(record: int, extra: int = 0, budget: int = 64 << 20) -> int:
    return max(LEAST_ROWS, min(MOST_ROWS, budget // (record + extra)))


def files_under(path: str) -> list[str]:
    fs, inner = _open(path)
    info = fs.get_file_info(inner)
    if info.type == pafs.FileType.Directory:
        found = fs.get_file_info(pafs.FileSelector(inner))
        prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
        return sorted(prefix + i.path for i in found if i.path.lower().endswith(".las") and not i.path.rsplit("/", 1)[-1].startswith("_"))
    return [path]


class _Rows(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class _Reader(DataSourceReader):
    def __init__(self, options, schema):
        self.path, self.schema = options["path"], schema
        self.rows = int(options.get("rows", 0))

    def partitions(self):
        out = []
        for path in files_under(self.path):
            h = read_header(path)
            step = self.rows or block_rows(h.record)
            out += [_Rows(path, a, min(h.count, a + step)) for a in range(0, h.count, step)]
        return out

    def read(self, part) -> Iterator[pa.RecordBatch]:
        if part is None:
            return
        h = read_header(part.path)
        kinds = {n: k for n, k, _ in h.fields}
        fs, inner = _open(part.path)
        with fs.open_input_file(inner) as f:
            for a in range(part.start, part.stop, LEAST_ROWS):
                n = min(LEAST_ROWS, part.stop - a)
                f.seek(h.offset + a * h.record)
                rec = np.frombuffer(f.read(n * h.record), h.dtype)
                cols = []
                for name in self.schema.fieldNames():
                    if name == "row":
                        cols.append(pa.array(np.arange(a, a + n)))
                    elif name not in kinds:
                        cols.append(pa.nulls(n, pa.from_numpy_dtype(np.float64)))
                    elif kinds[name] == "<u8":
                        cols.append(pa.array(rec[name].astype(object).tolist(), pa.decimal128(20, 0)))
                    else:
                        cols.append(pa.array(np.ascontiguousarray(rec[name])).cast(_ARROW[kinds[name]]))
                yield pa.RecordBatch.from_arrays(cols, self.schema.fieldNames())


_WRITE = {"byte": "i1", "short": "i2", "int": "i4", "bigint": "i8", "float": "f4", "double": "f8"}


class _Done(WriterCommitMessage):
    def __init__(self, name: str, count: int):
        self.name, self.count = name, count


class _Writer(DataSourceArrowWriter):
    """One file for each partition under a temporary name, renamed on commit; what was there is deleted then if it is to be overwritten."""

    def __init__(self, options, schema, overwrite: bool):
        self.path, self.schema, self.overwrite = options["path"], schema, overwrite
        self.scale = float(options.get("scale", "1e-4"))
        self.origin = tuple(float(x) for x in options.get("origin", "0,0,0").split(","))

    def write(self, batches) -> _Done:
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"_part-{task.partitionId():05d}-{task.taskAttemptId()}.las"
        fs, inner = _open(self.path)
        # records wait in an unnamed file of this task, since the header that precedes them has their number and bounds
        with tempfile.TemporaryFile() as records:
            layout = box = None
            count = 0
            for b in batches:
                if b.num_rows:
                    layout = layout or Layout(b.schema)
                    rec = layout.records(b)
                    box = layout.bounds(rec, box)
                    records.write(rec.tobytes())
                    count += len(rec)
            if not count:
                return _Done("", 0)
            fs.create_dir(inner, recursive=True)
            records.seek(0)
            with fs.open_output_stream(f"{inner}/{name}") as f:
                f.write(layout.header(count, box, self.scale, self.origin))
                while part := records.read(1 << 22):
                    f.write(part)
        return _Done(name, count)

    def commit(self, messages) -> None:
        fs, inner = _open(self.path)
        done = [m for m in messages if m is not None and m.name]
        if self.overwrite and fs.get_file_info(inner).type == pafs.FileType.Directory:
            for old in files_under(inner):
                fs.delete_file(old)
        run = uuid.uuid4().hex[:12]
        for k, m in enumerate(done):
            fs.move(f"{inner}/{m.name}", f"{inner}/part-{time.time_ns():020d}-{run}-{k:05d}.las")

    def abort(self, messages) -> None:
        fs, inner = _open(self.path)
        for m in messages:
            if m is not None and m.name:
                fs.delete_file(f"{inner}/{m.name}")


#: Fields of the canonical format and where they lie.
_CANONICAL_FIELDS = [*_LEGACY, ("gps_time", "<f8", 20), *[(c, "<u2", 28 + 2 * k) for k, c in enumerate(_RGB)]]
#: Byte columns in which a missing value has a mark of its own (fixed value).
MARKED = {"prediction": 255, "labels": 255}


class Layout:
    """Records of a canonical file for tables of one schema; columns that format 3 lacks become Extra Bytes.

    Whole numbers must fit their field and be there: a value that doesn't fit, a missing one or a NaN is an error, but that
    ``prediction`` and ``labels`` have a mark for missing ones. A missing float is NaN.
    """

    def __init__(self, schema: pa.Schema):
        base = {n for n, _, _ in _CANONICAL_FIELDS}
        self.extra, size = [], 34
        for f in schema:
            if f.name not in base and f.name != "row":
                kind = "<u4" if f.name == "POINT_ID" else "u1" if f.name in MARKED else {"int8": "i1", "int16": "<i2", "int32": "<i4", "int64": "<i8", "float": "<f4", "double": "<f8"}[str(f.type)]
                self.extra.append((f.name, kind, size))
                size += np.dtype(kind).itemsize
        self.size, self.fields = size, _CANONICAL_FIELDS + self.extra
        self.dtype = np.dtype({"names": [f[0] for f in self.fields], "formats": [f[1] for f in self.fields], "offsets": [f[2] for f in self.fields], "itemsize": size})

    def records(self, table) -> np.ndarray:
        rec = np.zeros(table.num_rows, self.dtype)
        for name, kind, _ in self.fields:
            at = table.schema.get_field_index(name)
            if at < 0:
                continue
            column = table.column(at)
            if kind[-2] == "f":
                rec[name] = column.cast(pa.float64()).to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.cast(pa.float64()).to_numpy()
                continue
            if column.null_count:
                if name not in MARKED:
                    raise LasError(f"{name}: {column.null_count} values are missing")
                column = column.fill_null(MARKED[name])
            v = column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()
            limits = np.iinfo(kind)
            if len(v) and not (np.isfinite(v).all() and limits.min <= v.min() and v.max() <= limits.max):
                raise LasError(f"{name}: values that don't fit {limits.min} to {limits.max}")
            rec[name] = v
        return rec

    @staticmethod
    def bounds(rec: np.ndarray, box: list | None) -> list:
        """Smallest and largest X, Y and Z, as they are stored."""
        own = [(int(rec[a].min()), int(rec[a].max())) for a in "XYZ"]
        return own if box is None else [(min(a, c), max(b, d)) for (a, b), (c, d) in zip(box, own, strict=True)]

    def header(self, count: int, box: list, scale: float, origin: tuple[float, float, float]) -> bytes:
        vlr = b""
        if self.extra:
            body = b"".join(struct.pack("<2xBB32s4x152x", _EXTRA.index(k), 0, n.encode()[:32]) for n, k, _ in self.extra)
            vlr = struct.pack("<2x16sHH32s", b"LASF_Spec", 4, len(body), b"Extra Bytes") + body
        world = [v * scale + o for (low, high), o in zip(box, origin, strict=True) for v in (high, low)]
        head = bytearray(227)
        head[:4] = b"LASF"
        head[24:26] = bytes((1, 2))
        struct.pack_into("<HIIBHI", head, 94, 227, 227 + len(vlr), bool(self.extra), 3, self.size, count)
        struct.pack_into("<3d3d6d", head, 131, scale, scale, scale, *origin, *world)
        return bytes(head) + vlr


def encode(table: pa.Table, scale: float = 1e-4, origin: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> bytes:
    """A canonical file of a table with quantised ``X, Y, Z``."""
    layout = Layout(table.schema)
    rec = layout.records(table)
    return layout.header(len(rec), layout.bounds(rec, None), scale, origin) + rec.tobytes()


def quantised(df, scale: float = 1e-4, columns: tuple[str, str, str] = ("x", "y", "z")):
    """The table with ``X, Y, Z`` in ticks from its smallest coordinates, and those as the writer's ``origin`` option."""
    from pyspark.sql import functions as F

    low = df.agg(*[F.min(c).cast("double").alias(c) for c in columns]).first()
    origin = [low[c] or 0.0 for c in columns]
    made = [F.floor((F.col(c).cast("double") - o) / scale + 0.5).cast("int").alias(a) for a, c, o in zip("XYZ", columns, origin, strict=True)]
    return df.select(*made, *[c for c in df.columns if c not in columns]), ",".join(map(repr, origin))


def write_single(df, path: str, order: list[str], scale: float = 1e-4, origin: str = "0,0,0") -> int:
    """One canonical file with the rows in an order, and their number.

    Ranges of the order are written as files of a folder beside it; their records are then copied behind one header, some megabytes at a time.
    """
    from ..work import ship

    ship(df.sparkSession)
    register(df.sparkSession)
    folder = f"{path}._parts-{uuid.uuid4().hex}"
    df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order).write.format("las").mode("append").option("scale", scale).option("origin", origin).save(folder)
    fs, inner = _open(path)
    parts = sorted(files_under(folder), key=lambda p: p.rsplit("-", 1)[1])
    heads = [read_header(p) for p in parts]
    count = sum(h.count for h in heads)
    with fs.open_output_stream(inner) as out:
        for k, h in enumerate(heads):
            _, at = _open(h.path)
            with fs.open_input_file(at) as f:
                if not k:
                    first = bytearray(f.read(h.offset))
                    world = [g([x[a] for x in ((v.high if g is max else v.low) for v in heads)]) for a in range(3) for g in (max, min)]
                    struct.pack_into("<I", first, 107, count)
                    struct.pack_into("<6d", first, 179, *world)
                    out.write(bytes(first))
                f.seek(h.offset)
                left = h.count * h.record
                while left:
                    part = f.read(min(left, 1 << 22))
                    out.write(part)
                    left -= len(part)
    fs.delete_dir(_open(folder)[1])
    return count


def append_column(path: str, target: str, values: np.ndarray, name: str = "prediction") -> None:
    """A copy of a file in which every record has one more byte, ``name``; records and their order stay.

    The column replaces one of its name. A file whose records are followed by extended records is refused, and so is a
    column of another length.
    """
    h = read_header(path)
    fs, inner = _open(path)
    if len(values) != h.count:
        raise LasError(f"{path}: {h.count} records, but {len(values)} values")
    if fs.get_file_info(inner).size > h.offset + h.count * h.record:
        raise LasError(f"{path}: extended records follow the points")
    values = np.ascontiguousarray(values, np.uint8)
    there = {n: at for n, k, at in h.fields if k == "u1"}.get(name)
    with fs.open_input_file(inner) as f, _open(target)[0].open_output_stream(_open(target)[1]) as out:
        head = bytearray(f.read(h.offset))
        if there is None:
            described = struct.pack("<2xBB32s4x152x", 1, 0, name.encode()[:32])
            at, size, vlrs = 0, *struct.unpack_from("<HxxxxI", head, 94)
            place = size
            for _ in range(vlrs):
                user, number, length = bytes(head[place + 2 : place + 18]).rstrip(b"\0"), *struct.unpack_from("<HH", head, place + 18)
                if user == b"LASF_Spec" and number == 4:
                    at = place
                place += 54 + length
            if at:
                length = struct.unpack_from("<H", head, at + 20)[0]
                struct.pack_into("<H", head, at + 20, length + 192)
                head[at + 54 + length : at + 54 + length] = described
                grown = 192
            else:
                head[place:place] = struct.pack("<2x16sHH32s", b"LASF_Spec", 4, 192, b"Extra Bytes") + described
                struct.pack_into("<I", head, 100, vlrs + 1)
                grown = 54 + 192
            struct.pack_into("<I", head, 96, h.offset + grown)
            struct.pack_into("<H", head, 105, h.record + 1)
        out.write(bytes(head))
        for a in range(0, h.count, LEAST_ROWS):
            n = min(LEAST_ROWS, h.count - a)
            rec = np.frombuffer(f.read(n * h.record), np.uint8).reshape(n, h.record)
            own = values[a : a + n, None]
            if there is None:
                out.write(np.concatenate([rec, own], axis=1).tobytes())
            else:
                rec = rec.copy()
                rec[:, there] = own[:, 0]
                out.write(rec.tobytes())


class LasSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> T.StructType:
        h = read_header(files_under(self.options["path"])[0])
        wanted = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        kinds = {n: k for n, k, _ in h.fields}
        unknown = [c for c in wanted if c not in kinds and c != "row"]
        if unknown:
            raise LasError(f"no such fields: {unknown}")
        return T.StructType([T.StructField(n, T.LongType() if n == "row" else _SPARK[kinds[n]]) for n in wanted or ["row", *kinds]])

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, schema)

    def writer(self, schema, overwrite: bool):
        return _Writer(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make ``las`` a format of the session; executors get this package, by whose name they unpickle it."""
    from ..work import ship

    ship(spark)
    spark.dataSource.register(LasSource)


def inspect(path: str) -> dict:
    """What a file's header says."""
    h = read_header(path)
    base = {n for n, _, _ in [*_LEGACY, *_MODERN]} | {"gps_time", *_RGB}
    return {"version": h.version, "format": h.fmt, "points": h.count, "canonical": h.canonical, "extra": [n for n, _, _ in h.fields if n not in base], "scale": h.scale, "origin": h.origin, "low": h.low, "high": h.high}


#: Columns of a canonical table, in order; the last four are Extra Bytes (fixed values).
CANONICAL = ("X", "Y", "Z", "intensity", "return_bits", "classification", "scan_angle", "user_data", "point_source_id", "gps_time", "red", "green", "blue", "NormalX", "NormalY", "NormalZ", "POINT_ID")


def canonicalize(df):
    """A table of any format with the canonical columns: missing ones are 0, ids are row numbers, normals 0."""
    from pyspark.sql import functions as F

    kinds = {"gps_time": "double", "NormalX": "float", "NormalY": "float", "NormalZ": "float", "POINT_ID": "bigint"}
    made = []
    for c in CANONICAL:
        if c in df.columns:
            v = F.col(c)
        elif c == "POINT_ID":
            v = F.col("row")
        else:
            v = F.lit(0)
        made.append(v.cast(kinds.get(c, "int")).alias(c))
    extra = [c for c in df.columns if c not in CANONICAL and c != "row"]
    return df.select(*made, *extra)
