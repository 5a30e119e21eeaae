"""Sampling triangle meshes: areas, allocation, area-weighted points with colours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry
from .sample import largest_remainder


def with_areas(triangles: DataFrame) -> DataFrame:
    v = [[F.col(f"v{k}")[i].cast("double") for i in range(3)] for k in range(3)]
    return triangles.withColumn("area", geometry.triangle_area(*v))


def submesh_areas(triangles: DataFrame) -> DataFrame:
    return with_areas(triangles).groupBy("submesh_id").agg(F.sum("area").alias("area"), F.count("*").alias("triangles"))


def allocate(triangles: DataFrame, points: int) -> DataFrame:
    """Points of each submesh in proportion to its area."""
    return largest_remainder(submesh_areas(triangles), "submesh_id", "area", points)


def running_area(triangles: DataFrame) -> DataFrame:
    """``low`` and ``high`` of each triangle in its submesh's running area."""
    w = Window.partitionBy("submesh_id").orderBy("tri_id")
    df = with_areas(triangles)
    return df.withColumn("high", F.sum("area").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("low", F.col("high") - F.col("area"))


def draw(*row, salt: int):
    """A uniform number from a row's numbers and a salt; those of two salts are independent."""
    return F.shiftrightunsigned(F.xxhash64(*row, F.lit(salt)), 11).cast("double") / float(1 << 53)


def area_pick(triangles: DataFrame, points: int) -> DataFrame:
    """``submesh_id, draw_id, tri_id``: stratified picks, one in each equal slice of a submesh's area.

    A triangle's picks follow from its own stretch of the running area, so they come from exploding
    its slices: no range join.
    """
    areas = submesh_areas(triangles).select("submesh_id", F.col("area").alias("total"))
    shares = allocate(triangles, points)
    df = running_area(triangles).join(areas, "submesh_id").join(shares, "submesh_id").filter((F.col("share") > 0) & (F.col("area") > 0))
    step = F.col("total") / F.col("share")
    # slice i has its middle at (i + 0.5) * step
    first = F.ceil(F.col("low") / step - 0.5).cast("long")
    after = F.ceil(F.col("high") / step - 0.5).cast("long")
    df = df.withColumn("first", F.greatest(first, F.lit(0))).withColumn("after", F.least(after, F.col("share")))
    return df.filter(F.col("after") > F.col("first")).select("submesh_id", "tri_id", "v0", "v1", "v2", *[c for c in ("c0", "c1", "c2", "base") if c in triangles.columns], F.explode(F.sequence(F.col("first"), F.col("after") - 1)).alias("draw_id"))


def sample_mesh(triangles: DataFrame, points: int, scale: float = 1e-4) -> DataFrame:
    """Points of the mesh with positions and colours: ``submesh_id, draw_id, qx, qy, qz [, r, g, b]``.

    Barycentric coordinates are uniform in each triangle and depend on the draw alone. Colour: the
    vertices' where the table has ``c0, c1, c2``, else the submesh's ``base``, else none.
    """
    df = area_pick(triangles, points)
    root, v = F.sqrt(draw("submesh_id", "draw_id", salt=1)), draw("submesh_id", "draw_id", salt=2)
    weights = (1 - root, root * (1 - v), root * v)
    df = df.select("*", *[w.alias(f"w{k}") for k, w in enumerate(weights)])
    mix = lambda names, i: sum((F.col(f"w{k}") * F.col(n)[i] for k, n in enumerate(names)), F.lit(0.0))
    out = ["submesh_id", "draw_id", *[F.floor(mix(("v0", "v1", "v2"), i) / scale + 0.5).cast("long").alias(f"q{a}") for i, a in enumerate("xyz")]]
    if "c0" in triangles.columns:
        out += [F.floor(mix(("c0", "c1", "c2"), i) + 0.5).cast("int").alias(c) for i, c in enumerate("rgb")]
    elif "base" in triangles.columns:
        out += [F.col("base")[i].alias(c) for i, c in enumerate("rgb")]
    return df.select(*out)


def with_points(samples: DataFrame, points: DataFrame) -> DataFrame:
    """Samples and the points that the mesh file itself holds, under one numbering by content order."""
    return samples.unionByName(points, allowMissingColumns=True)
