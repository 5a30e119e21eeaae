"""Attribute columns by point id: merging, validation, pruning, statistics, patches.

The join strategy is Catalyst's and AQE's; missing values are null inside and become the store's
markers (NaN for floats, 255 for bytes) only in ``with_markers``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import is_finite
from ..functions.scalar import is_feature  # noqa: F401  (names of columns that count as features)
from .ranks import kth

BYTE_MISSING = 255


class Mismatch(ValueError):
    """The values don't belong to the cloud."""


def merge(cloud: DataFrame, values: DataFrame, only: Iterable[str] | None = None, strict: bool = False) -> DataFrame:
    """The cloud with the values' columns; points without a value get null."""
    names = [c for c in values.columns if c != "point_id" and (only is None or c in set(only))]
    if strict:
        validate(cloud, values)
    kept = [c for c in cloud.columns if c not in names]
    return cloud.select(*kept).join(values.select("point_id", *names), "point_id", "left")


def with_markers(df: DataFrame, floats: Iterable[str] = (), bytes_: Iterable[str] = ()) -> DataFrame:
    for c in floats:
        df = df.withColumn(c, F.coalesce(F.col(c).cast("float"), F.lit(float("nan")).cast("float")))
    for c in bytes_:
        df = df.withColumn(c, F.coalesce(F.col(c).cast("int"), F.lit(BYTE_MISSING)))
    return df


def without_markers(df: DataFrame, floats: Iterable[str] = (), bytes_: Iterable[str] = ()) -> DataFrame:
    for c in floats:
        df = df.withColumn(c, F.when(~F.isnan(c), F.col(c)))
    for c in bytes_:
        df = df.withColumn(c, F.when(F.col(c) != BYTE_MISSING, F.col(c)))
    return df


def unknown_ids(cloud: DataFrame, values: DataFrame) -> DataFrame:
    return values.select("point_id").join(cloud.select("point_id"), "point_id", "left_anti")


def duplicate_ids(values: DataFrame) -> DataFrame:
    return values.groupBy("point_id").agg(F.count("*").alias("times")).filter(F.col("times") > 1)


def validate(cloud: DataFrame, values: DataFrame) -> None:
    if unknown_ids(cloud, values).limit(1).count():
        raise Mismatch("a point id isn't in the cloud")
    if duplicate_ids(values).limit(1).count():
        raise Mismatch("a point id has more than one value")


def out_of_order(df: DataFrame, row: str = "row", point_id: str = "point_id") -> DataFrame:
    """How many rows have an id that isn't above their predecessor's; rows are numbered without gaps."""
    before = df.select((F.col(row) + 1).alias(row), F.col(point_id).alias("before"))
    return df.select(row, point_id).join(before, row).agg(F.count_if(F.col(point_id) <= F.col("before")).alias("out_of_order"))


def column_delta(store: Iterable[str], incoming: Iterable[str], keep: Iterable[str] = ("prediction",)) -> dict[str, list[str]]:
    """Columns to prune from the store and columns to add."""
    store, incoming, keep = list(dict.fromkeys(store)), list(dict.fromkeys(incoming)), set(keep)
    return {"prune": [c for c in store if c not in incoming and c not in keep], "add": [c for c in incoming if c not in store]}


def prune(df: DataFrame, incoming: Iterable[str], protected: Iterable[str] = ("point_id", "prediction")) -> DataFrame:
    gone = column_delta([c for c in df.columns if c not in set(protected)], incoming)["prune"]
    return df.drop(*gone)


def statistics(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``name, low, high, present, missing`` of each column, missing and non-finite values left out, in one pass."""
    names = list(names)
    aggs = []
    for c in names:
        v = F.when(is_finite(F.col(c).cast("double")), F.col(c).cast("double"))
        aggs += [F.min(v).alias(f"{c}__low"), F.max(v).alias(f"{c}__high"), F.count(v).alias(f"{c}__n"), F.count("*").alias(f"{c}__all")]
    one = df.agg(*aggs)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"{c}__low").alias("low"), F.col(f"{c}__high").alias("high"), F.col(f"{c}__n").alias("present"), (F.col(f"{c}__all") - F.col(f"{c}__n")).alias("missing")) for c in names]))
    return one.select(each.alias("s")).select("s.*")


def permutation_check(ids: DataFrame, cloud: DataFrame) -> DataFrame:
    """Ids that differ between two tables, counted with repeats: empty if one is a permutation of the other."""
    a, b = ids.select("point_id"), cloud.select("point_id")
    return a.exceptAll(b).unionByName(b.exceptAll(a))


def upper_median(df: DataFrame, column: str) -> DataFrame:
    """The element at half the length of the sorted values that aren't null; null if there are none."""
    df = df.filter(F.col(column).isNotNull())
    s = df.agg(F.count("*").alias("n"), F.min(column).cast("double").alias("low"), F.max(column).cast("double").alias("high")).first()
    found = kth(df, column, s.n // 2, s.low, s.high) if s.n else None
    return df.sparkSession.range(1).select(F.lit(found).cast(df.schema[column].dataType).alias("median"))
