"""Row numbers and order statistics of whole tables, without a task that sees every row."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RANGES = 64
#: Tables of at most so many rows are sorted by one task.
SMALL = 200_000


def bounds(df: DataFrame, column: str, ranges: int = RANGES) -> list:
    """Values that cut the column into about equal ranges."""
    found = df.approxQuantile(column, [k / ranges for k in range(1, ranges)], 0.25 / ranges)
    return sorted(set(found))


def range_of(column: Column, cuts: list) -> Column:
    """How many cuts a value has reached."""
    return reduce(lambda a, b: a + b, [(column >= F.lit(c)).cast("int") for c in cuts], F.lit(0))


def computed(df: DataFrame, column: str) -> DataFrame:
    """The table with the column computed once: the optimiser can't copy its expression to where it is named."""
    return df.select(*[c for c in df.columns if c != column], F.inline(F.array(F.struct(F.col(column).alias(column)))))


def row_number(df: DataFrame, order: list[str], name: str = "row", ranges: int = RANGES) -> DataFrame:
    """``name``: each row's place, from 0, in the order of the columns, the first of which is a number.

    Ranges of the first column are counted, the counts are summed, and each range numbers its own rows. The cuts are
    quantiles of the table, so that a dense part is cut as finely as any.
    """
    cut = computed(df, order[0])
    cut = cut.withColumn("__range", range_of(F.col(order[0]), bounds(cut, order[0], ranges)))
    counts = cut.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = cut.join(F.broadcast(counts.select("__range", before.alias("__before"))), "__range")  # a row for each range
    place = F.col("__before") + F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    return cut.withColumn(name, place).select(*df.columns, name)


def kth(df: DataFrame, column: str, k: int, low: float, high: float, small: int = SMALL) -> float:
    """The value with ``k`` values before it, all being numbers from ``low`` to ``high``.

    The range that holds it is cut in parts until few values are left; only counts come to the driver.
    """
    v = F.col(column).cast("double")
    while True:
        inside = df.filter((v >= low) & (v <= high))
        step = (high - low) / RANGES
        cuts = sorted({low + step * i for i in range(1, RANGES)} - {low})
        parts = {r.part: r for r in inside.groupBy(range_of(v, cuts).alias("part")).agg(F.count("*").alias("n"), F.min(v).alias("low"), F.max(v).alias("high")).collect()}
        for p in sorted(parts):
            if k < parts[p].n:
                low, high, n = parts[p].low, parts[p].high, parts[p].n
                break
            k -= parts[p].n
        if low == high:
            return low
        if n <= small:
            return df.select(v.alias("v")).filter((F.col("v") >= low) & (F.col("v") <= high)).orderBy("v").offset(k).limit(1).first().v


def percentile(df: DataFrame, column: str, p: float, small: int = SMALL) -> float | None:
    """The exact percentile of the values that aren't null, interpolated; None if there are none."""
    v = F.col(column).cast("double")
    df = df.filter(v.isNotNull())
    s = df.agg(F.count("*").alias("n"), F.min(v).alias("low"), F.max(v).alias("high")).first()
    if not s.n:
        return None
    if s.n <= small:
        return df.agg(F.percentile(v, p).alias("v")).first().v
    at = (s.n - 1) * p
    below = kth(df, column, math.floor(at), s.low, s.high, small)
    above = below if at == math.floor(at) else kth(df, column, math.ceil(at), s.low, s.high, small)
    return below + (above - below) * (at - math.floor(at))
