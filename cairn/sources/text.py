"""Labelled text files, feature lists, and text exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_labelled(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """Space-separated numbers; headers, ``//`` comments, rows with ``nan`` and short rows are skipped."""
    lines = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("w"), F.col("value").alias("line"))
    numbers = F.transform(F.slice("w", 1, len(names)), lambda x: x.try_cast("double"))
    good = ~F.col("line").startswith("//") & (F.size("w") >= len(names)) & ~F.lower("line").contains("nan") & ~F.exists(numbers, lambda x: x.isNull())
    return lines.filter(good).select(*[numbers[i].alias(n) for i, n in enumerate(names)])


def feature_list(text: str) -> tuple[list[int], int]:
    """Feature columns on the first line and the class column on the second."""
    first, second = text.strip().splitlines()[:2]
    return [int(x) for x in first.replace(",", " ").split()], int(second.split()[0])


#: Orders of the columns of client exports (fixed values): text puts colours before normals, PLY after.
TEXT_ORDER = ("x", "y", "z", "r", "g", "b", "nx", "ny", "nz")
PLY_ORDER = ("x", "y", "z", "nx", "ny", "nz", "r", "g", "b")


def lines(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """One space-joined line for each row."""
    names = names or [c for c in TEXT_ORDER if c in df.columns]
    return df.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in names]).alias("value"))


def write(df: DataFrame, path: str, names: Sequence[str] | None = None, header: bool = True) -> None:
    """Text parts; each begins with a header line that ``read_labelled`` skips."""
    names = names or [c for c in TEXT_ORDER if c in df.columns]
    writer = df.select(*names).write.mode("overwrite").option("sep", " ").option("header", header)
    writer.csv(path)
