"""One file made of pieces that tasks write: the driver copies them behind a header, some megabytes at a time."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..work import ship
from .las import _open

COPY = 4 << 20


class Pieces:
    """The records of each partition in a file of its own, beside the target.

    A task that is repeated writes another file; only those that a finished task has named are read.
    """

    def __init__(self, df: DataFrame, target: str, encode: Callable[[pa.RecordBatch], bytes]):
        ship(df.sparkSession)
        self.target, self.folder = target, f"{target}._parts-{uuid.uuid4().hex}"
        folder = self.folder
        fs, inner = _open(folder)
        fs.create_dir(inner, recursive=True)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            part, name, rows = TaskContext.get().partitionId(), f"{folder}/{uuid.uuid4().hex}", 0
            fs, inner = _open(name)
            with fs.open_output_stream(inner) as out:
                for b in batches:
                    out.write(encode(b))
                    rows += b.num_rows
            yield pa.record_batch([pa.array([part]), pa.array([name]), pa.array([rows])], ["part", "name", "rows"])

        found = sorted(df.mapInArrow(run, "part bigint, name string, rows bigint").collect())  # one row for each partition
        self.names, self.rows = [r.name for r in found], sum(r.rows for r in found)

    def join(self, header: bytes) -> int:
        """Write the target and delete the pieces; the number of rows."""
        fs, inner = _open(self.target)
        with fs.open_output_stream(inner) as out:
            out.write(header)
            for name in self.names:
                with fs.open_input_stream(_open(name)[1]) as f:
                    while part := f.read(COPY):
                        out.write(part)
        fs.delete_dir(_open(self.folder)[1])
        return self.rows


def read_ranges(spark: SparkSession, path: str, ranges: Iterable[tuple[int, int]], decode: Callable[[int, bytes], pa.RecordBatch], schema) -> DataFrame:
    """Rows that ``decode`` makes of ``(offset, length)`` stretches of a file, read in parallel."""
    ranges = list(ranges)
    if not ranges:
        return spark.createDataFrame([], schema)
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, inner = _open(path)
        for b in batches:
            for at, n in zip(*[c.to_pylist() for c in b.columns], strict=True):
                with fs.open_input_file(inner) as f:
                    f.seek(at)
                    yield decode(at, f.read(n))

    return spark.createDataFrame(ranges, "at bigint, n bigint").repartition(len(ranges)).mapInArrow(run, schema)
