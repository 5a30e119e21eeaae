"""Voxel downsampling: one mean point for each occupied voxel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def voxel_downsample(points: DataFrame, voxel: int, low: tuple[int, int, int] | None = None) -> DataFrame:
    """Means of position and colour by voxel; the grid begins half a voxel below the minimum.

    Integers are summed exactly and divided last, so the result doesn't depend on the partitioning.
    Colours are averaged where the table has them. Pre-aggregation happens before the one shuffle.
    """
    if low is None:
        b = points.agg(*[F.min(f"q{a}").alias(a) for a in AXES]).first()
        low = (b.x or 0, b.y or 0, b.z or 0)
    # doubled, so that half a voxel stays an integer
    key = [F.floor((2 * (F.col(f"q{a}") - F.lit(lo)) + voxel) / F.lit(2 * voxel)).cast("long").alias(f"v{a}") for a, lo in zip(AXES, low, strict=True)]
    names = [f"q{a}" for a in AXES] + [c for c in ("r", "g", "b") if c in points.columns]
    n = F.count("*")
    return points.groupBy(*key).agg(n.alias("points"), *[(F.sum(c).cast("double") / F.count("*")).alias(c) for c in names])


def in_grid_order(voxels: DataFrame) -> DataFrame:
    return voxels.orderBy("vx", "vy", "vz")
