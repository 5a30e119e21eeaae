"""Gaussian splats: Morton chunks, quantisation with per-chunk ranges, errors, detail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import splat
from ..functions.scalar import is_finite
from .ranks import row_number

CHUNK = 250_000
AXES = ("x", "y", "z")
#: Properties that a splat file has at least (fixed values).
REQUIRED = frozenset({"f_dc_0", "f_dc_1", "f_dc_2", "opacity", "scale_0", "rot_0"})


class NotFinite(ValueError):
    """A splat has a value that is not finite."""


def file_kind(path: str, properties: set[str]) -> str | None:
    """``sog``, ``3dgs`` or ``2dgs``; None if the file holds no splats."""
    if path.lower().endswith(".sog"):
        return "sog"
    if not REQUIRED <= set(properties):
        return None
    return "3dgs" if "scale_2" in properties else "2dgs"


def refuse_not_finite(df: DataFrame, columns: list[str]) -> DataFrame:
    bad = df.agg(*[F.count_if(~is_finite(F.col(c).cast("double"))).alias(c) for c in columns]).first()
    wrong = [c for c in columns if bad[c]]
    if wrong:
        raise NotFinite(f"values that are not finite in {wrong}")
    return df


def morton_chunks(splats: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Splats with ``code`` and ``chunk``: consecutive runs of ``chunk`` splats along the Morton curve.

    Row numbers come in two levels, by quantiles of the codes, so no task sees all splats.
    """
    b = splats.agg(*[F.min(a).cast("double").alias(f"l{a}") for a in AXES], *[F.max(a).cast("double").alias(f"h{a}") for a in AXES]).first()
    if b.lx is None:
        return splats.withColumn("code", F.lit(0).cast("long")).withColumn("chunk", F.lit(0).cast("long")).withColumn("row", F.lit(0).cast("long"))
    q = [F.floor((F.col(a).cast("double") - b[f"l{a}"]) / ((b[f"h{a}"] - b[f"l{a}"]) or 1.0) * float((1 << 21) - 1)).cast("long") for a in AXES]
    df = splats.withColumn("code", splat.morton(*q))
    df = row_number(df, ["code", "splat_id"])
    return df.withColumn("chunk", F.floor(F.col("row") / chunk).cast("long"))


def in_chunk_order(df: DataFrame, seed: int = 0) -> DataFrame:
    """Each chunk's splats in a permuted order that depends on the id and the chunk alone."""
    key = F.pmod(F.pmod(F.col("splat_id") + F.col("chunk") + seed, F.lit(2147483647)) * F.lit(48271), F.lit(2147483647))
    return df.withColumn("seq", F.row_number().over(Window.partitionBy("chunk").orderBy(key, "splat_id")) - 1)


def chunk_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """Range of each column in each chunk, one aggregation."""
    return df.groupBy("chunk").agg(F.count("*").alias("splats"), *[f(F.col(c).cast("double")).alias(f"{c}_{n}") for c in columns for n, f in (("low", F.min), ("high", F.max))])


def quantise(df: DataFrame, bits: dict[str, int]) -> DataFrame:
    """Columns ``<name>_q`` by the ranges of the chunk; all windows share one shuffle by chunk."""
    w = Window.partitionBy("chunk")
    out = df
    for c in bits:
        v = F.col(c).cast("double")
        out = out.withColumn(f"{c}_low", F.min(v).over(w)).withColumn(f"{c}_high", F.max(v).over(w))
    return out.select("*", *[splat.quantise_linear(F.col(c).cast("double"), F.col(f"{c}_low"), F.col(f"{c}_high"), n).alias(f"{c}_q") for c, n in bits.items()])


def dequantise(df: DataFrame, bits: dict[str, int]) -> DataFrame:
    return df.select("*", *[splat.dequantise_linear(F.col(f"{c}_q"), F.col(f"{c}_low"), F.col(f"{c}_high"), n).alias(f"{c}_d") for c, n in bits.items()])


def error_report(df: DataFrame, xyz: tuple[str, ...], scale: tuple[str, ...], others: tuple[str, ...] = (), rotation: tuple[str, str] | None = None) -> DataFrame:
    """Errors of decoded columns ``<name>_d``: position relative to splat size (p99, max), largest of the rest, rms share.

    ``rotation`` names an array of four and its decoded one; their largest angle is reported.
    """
    difference = lambda c: F.col(c).cast("double") - F.col(f"{c}_d")
    position: Column = F.sqrt(sum((difference(c) * difference(c) for c in xyz[1:]), difference(xyz[0]) * difference(xyz[0])))
    size = F.exp(F.greatest(*[F.col(c).cast("double") for c in scale]))
    df = df.select("*", position.alias("__p"), (position / size).alias("__r"))
    out = [F.max("__p").alias("pos_abs_max"), F.percentile("__r", 0.99).alias("pos_rel_p99"), F.max("__r").alias("pos_rel_max"), F.max(F.greatest(*[F.abs(difference(c)) for c in scale])).alias("scale_abs_max")]
    if rotation:
        q = [[F.col(c)[k] for k in range(4)] for c in rotation]
        out.append(F.max(splat.rotation_angle(*q)).alias("rotation_max"))
    for c in others:
        out += [F.max(F.abs(difference(c))).alias(f"{c}_abs_max"), (F.sqrt(F.avg(difference(c) * difference(c))) / F.sqrt(F.avg(F.col(c).cast("double") * F.col(c)))).alias(f"{c}_rms_share")]
    return df.agg(*out)


def describe(df: DataFrame, axes=AXES, scales: list[str] | None = None, opacity: str = "opacity", tiny: float = -12.0) -> DataFrame:
    """Count, range of each axis, non-finite values, tiny scales and opacity range, in one pass."""
    out = [F.count("*").alias("splats")]
    for a in axes:
        out += [F.min(a).alias(f"{a}_low"), F.max(a).alias(f"{a}_high")]
    out.append(sum((F.count_if(~is_finite(F.col(a).cast("double"))) for a in axes[1:]), F.count_if(~is_finite(F.col(axes[0]).cast("double")))).alias("not_finite"))
    if scales:
        out.append(F.count_if(F.least(*scales) < tiny).alias("tiny"))
    if opacity in df.columns:
        out += [F.min(opacity).alias("opacity_low"), F.max(opacity).alias("opacity_high")]
    return df.agg(*out)


def codebook(df: DataFrame, index: str, values: list[float], name: str) -> DataFrame:
    """Value of a byte's entry in a codebook of at most 256 entries, 0 outside it."""
    return df.withColumn(name, F.coalesce(F.get(F.array(*[F.lit(float(v)) for v in values]), F.col(index).cast("int")), F.lit(0.0)))


def palette(df: DataFrame, label: str, rows: DataFrame, name: str) -> DataFrame:
    """Palette row of a label, a join on the palette's number; null where there is none."""
    return df.join(rows.select(F.col("label").alias(label), F.col("values").alias(name)), label, "left")


def depth_order(df: DataFrame, view: list[float], limit: int | None = None) -> DataFrame:
    """Splats from back to front under a column-major view matrix; ``row`` is the place of each, of the first ``limit`` if there is one."""
    z = F.col("x") * view[2] + F.col("y") * view[6] + F.col("z") * view[10] + view[14]
    out = row_number(df.withColumn("depth", z), ["depth", "splat_id"])
    return out.filter(F.col("row") < limit) if limit else out


def octant_shares(df: DataFrame, centre: tuple[float, float, float], prefix: int) -> DataFrame:
    """``octant, share_all, share_prefix``: how evenly each chunk's first rows cover space."""
    octant = sum((F.when(F.col(a) > c, 1 << k).otherwise(0) for k, (a, c) in enumerate(zip(AXES[1:], centre[1:], strict=True), 1)), F.when(F.col(AXES[0]) > centre[0], 1).otherwise(0))
    df = df.withColumn("octant", octant)
    total = df.agg(F.count("*").alias("all"), F.count_if(F.col("seq") < prefix).alias("some"))
    by = df.groupBy("octant").agg(F.count("*").alias("n"), F.count_if(F.col("seq") < prefix).alias("m"))
    return by.crossJoin(F.broadcast(total)).select("octant", (F.col("n") / F.col("all")).alias("share_all"), (F.col("m") / F.col("some")).alias("share_prefix"))
