"""Sampling and allocation: stratified, uniform, area-weighted, largest remainder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MODULUS = 2147483647


def uniform(point_id="point_id", salt: int = 0) -> Column:
    """A number in 0 to 1 that depends on the id and the salt alone."""
    c = F.col(point_id) if isinstance(point_id, str) else point_id
    return F.pmod(F.pmod(c + salt, F.lit(MODULUS)) * F.lit(48271), F.lit(MODULUS)).cast("double") / float(MODULUS)


def class_fractions(points: DataFrame, cap: int, least: int = 1000, class_id: str = "class_id") -> DataFrame:
    """``class_id, points, fraction``: a proportional share of the cap, but ``least`` of each class where there are so many."""
    counts = points.groupBy(class_id).agg(F.count("*").alias("points"))
    total = counts.agg(F.sum("points").alias("total"))
    wanted = F.greatest(F.lit(cap) * F.col("points").cast("double") / F.col("total"), F.least(F.col("points"), F.lit(least)).cast("double"))
    return counts.crossJoin(F.broadcast(total)).select(class_id, "points", F.least(F.lit(1.0), wanted / F.col("points")).alias("fraction"))


def stratified_sample(points: DataFrame, cap: int, least: int = 1000, class_id: str = "class_id") -> DataFrame:
    """Bernoulli sample by class; the same rows whatever the partitioning."""
    f = class_fractions(points, cap, least, class_id).select(class_id, "fraction")
    return points.join(F.broadcast(f), class_id).filter(uniform() < F.col("fraction")).drop("fraction")


def uniform_sample(points: DataFrame, k: int) -> DataFrame:
    """k rows without replacement, all if there are fewer."""
    return points.withColumn("u", uniform()).orderBy("u", "point_id").limit(k).drop("u")


def stride(points: DataFrame, k: int, row: str = "point_id") -> DataFrame:
    return points.filter(F.pmod(F.col(row), F.lit(k)) == 0)


def largest_remainder(weights: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """``key, share``: integers in proportion to the weights that add up to ``total``; ties go to the smaller key.

    For tables of parts (submeshes, classes), which are small by nature.
    """
    all_ = weights.agg(F.sum(weight).cast("double").alias("all"))
    exact = F.lit(float(total)) * F.col(weight) / F.col("all")
    df = weights.crossJoin(F.broadcast(all_)).select(key, F.floor(exact).alias("whole"), (exact - F.floor(exact)).alias("part"))
    missing = df.agg((F.lit(total) - F.sum("whole")).alias("missing"))
    rank = F.row_number().over(Window.orderBy(F.desc("part"), key))
    return df.withColumn("rank", rank).crossJoin(F.broadcast(missing)).select(key, (F.col("whole") + (F.col("rank") <= F.col("missing")).cast("long")).alias("share"))


def importance_cut(importances: DataFrame, name: str = "feature", value: str = "importance", most: float = 0.9) -> DataFrame:
    """Features in descending order until the sum reaches ``most``; the one that crosses it is kept."""
    w = Window.orderBy(F.desc(value), name)
    before = F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return importances.withColumn("before", before).filter(F.col("before") < most).drop("before")
