"""Annotations: splitting, extracting, patching, merging segments, replaying the edit log."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from ..functions.scalar import _c, remap_label

NO_SEGMENT = 0
DELETED = -1


def annotated(points: DataFrame, ann: DataFrame, segments: Iterable[int] | None = None, labelled_only: bool = False) -> DataFrame:
    """Points with their segment and class; what has neither drops out. The joined side is small or shuffled, as AQE finds."""
    ann = ann.select("point_id", "segment_id", F.col("class_id").alias("label"))
    if segments is not None:
        ann = ann.filter(F.col("segment_id").isin(list(segments)))
    if labelled_only:
        ann = ann.filter(F.col("label") != 0)
    return points.join(ann, "point_id")


def split(points: DataFrame, ann: DataFrame, segments: Iterable[int] | None = None, labelled_only: bool = False) -> DataFrame:
    """Split mode: rows carry ``labels``, class 0 becoming 255; write partitioned by ``segment_id``."""
    return annotated(points, ann, segments, labelled_only).withColumn("labels", remap_label(F.col("label"))).drop("label")


def extract_segment(points: DataFrame, ann: DataFrame, segment: int) -> DataFrame:
    return points.join(ann.filter(F.col("segment_id") == segment).select("point_id"), "point_id", "left_semi")


def segment_counts(ann: DataFrame) -> DataFrame:
    return ann.groupBy("segment_id").agg(F.count("*").alias("points"))


def run_counters(points: DataFrame, ann: DataFrame) -> DataFrame:
    """Mapped, unmapped and out-of-range points of an annotation run."""
    j = points.select("point_id", F.lit(1).alias("p")).join(ann.select("point_id", F.lit(1).alias("a")), "point_id", "full")
    return j.agg(F.count_if(F.col("p").isNotNull() & F.col("a").isNotNull()).alias("matched"), F.count_if(F.col("a").isNull()).alias("unmapped"), F.count_if(F.col("p").isNull()).alias("out_of_range"))


def patch(old: DataFrame, new: DataFrame) -> DataFrame:
    """New rows win where they have a segment; the rest of the store stays."""
    o = old.select("point_id", F.col("segment_id").alias("os"), F.col("class_id").alias("oc"))
    n = new.select("point_id", F.col("segment_id").alias("ns"), F.col("class_id").alias("nc"))
    wins = F.col("ns").isNotNull() & (F.col("ns") != NO_SEGMENT)
    return o.join(n, "point_id", "full").select("point_id", F.when(wins, F.col("ns")).otherwise(F.coalesce("os", "ns")).alias("segment_id"), F.when(wins, F.col("nc")).otherwise(F.coalesce("oc", "nc")).alias("class_id"))


def merge_segments(ann: DataFrame, sources: Sequence[int], target: int) -> DataFrame:
    return ann.withColumn("segment_id", F.when(F.col("segment_id").isin(list(sources)), F.lit(target)).otherwise(F.col("segment_id")))


def delete_segment(ann: DataFrame, segment: int) -> DataFrame:
    return merge_segments(ann, [segment], DELETED)


def restore_segment(ann: DataFrame) -> DataFrame:
    return merge_segments(ann, [DELETED], NO_SEGMENT)


def clear_class(ann: DataFrame, class_id: int) -> DataFrame:
    return ann.withColumn("class_id", F.when(F.col("class_id") == class_id, F.lit(0)).otherwise(F.col("class_id")))


def _applies(cut: dict, x, y, z, segment: Column) -> Column:
    inside = geometry.selected(x, y, cut["regions"], cut.get("deregions", ()), cut.get("inverted", False))
    if cut.get("low") is not None:
        inside = geometry.in_box(x, y, z, cut["low"], cut["high"]) & inside
    if cut.get("visible") is not None:
        inside = segment.isin(list(cut["visible"])) & inside
    return inside


def replay_cuts(points: DataFrame, cuts: Sequence[dict], x="qx", y="qy", z="qz", start=NO_SEGMENT) -> DataFrame:
    """Segments after all cuts in order of creation; a cut moves the points that it matches and that were visible."""
    df = points.withColumn("segment_id", _c(start) if isinstance(start, str) else F.lit(start))
    for cut in sorted(cuts, key=lambda c: c["order"]):
        df = df.withColumn("segment_id", F.when(_applies(cut, x, y, z, F.col("segment_id")), F.lit(cut["segment"])).otherwise(F.col("segment_id")))
    return df


def replay_classes(points: DataFrame, entries: Sequence[dict], x="qx", y="qy", z="qz", segment: str = "segment_id") -> DataFrame:
    """Class of the last entry that matches each point, 0 if none does."""
    out = F.lit(0)
    for e in sorted(entries, key=lambda c: c["order"]):
        out = F.when(_applies(e, x, y, z, F.col(segment)), F.lit(e["class"])).otherwise(out)
    return points.withColumn("class_id", out)


def selection_box(points: DataFrame, inside: Column, margin: float) -> DataFrame:
    """Bounds of the selected points, widened."""
    df = points.filter(inside)
    return df.agg(*[(F.min(f"q{a}") - margin).alias(f"low_{a}") for a in "xyz"], *[(F.max(f"q{a}") + margin).alias(f"high_{a}") for a in "xyz"])


def pick_nearest(points: DataFrame, x: float, y: float) -> DataFrame:
    """The drawn point nearest to a screen position, ties by id."""
    d2 = (F.col("qx") - F.lit(x)) * (F.col("qx") - F.lit(x)) + (F.col("qy") - F.lit(y)) * (F.col("qy") - F.lit(y))
    return points.select("point_id", d2.alias("d2")).orderBy("d2", "point_id").limit(1)


#: Candidates that a pick looks at closely.
PICK = 6


def pick_visible(points: DataFrame, m: Sequence[float], visible: Column, x: float, y: float, reach: float, most: int = PICK) -> DataFrame:
    """``point_id, d2, w``: of the visible points before the camera and within ``reach`` of a screen position, the ``most`` nearest in order."""
    px, py, w = geometry.project("qx", "qy", "qz", m)
    df = points.filter(visible).select("point_id", px.alias("px"), py.alias("py"), w.alias("w")).filter(F.col("w") > 0)
    d = [(F.col(c) - F.lit(float(at))) * (F.col(c) - F.lit(float(at))) for c, at in (("px", x), ("py", y))]
    return df.select("point_id", (d[0] + d[1]).alias("d2"), "w").filter(F.col("d2") <= reach * reach).orderBy("d2", "point_id").limit(most)


def class_legend(counts: DataFrame, names: dict[int, str]) -> DataFrame:
    """Class counts with names from a model's metadata (a bounded literal), in numeric order."""
    table = F.create_map(*[F.lit(v) for pair in names.items() for v in pair])
    return counts.select("class_id", F.coalesce(F.try_element_at(table, F.col("class_id")), F.col("class_id").cast("string")).alias("name"), "points").orderBy("class_id")


def write_split(df: DataFrame, path: str) -> None:
    """One folder for each segment that has points."""
    df.write.mode("overwrite").partitionBy("segment_id").parquet(path)


def name_splits(spark, path: str, roles: dict[int, str]) -> dict[str, DataFrame]:
    """Segments' folders as temporary views named by role, such as ``{1: "training", 2: "validation"}``."""
    df = spark.read.parquet(path)
    out = {}
    for segment, role in roles.items():
        out[role] = df.filter(F.col("segment_id") == segment)
        out[role].createOrReplaceTempView(role)
    return out


def append_entry(log: Sequence[dict], entry: dict) -> list[dict]:
    """The edit log with one more entry, last in order."""
    return [*log, {**entry, "order": max((e["order"] for e in log), default=0) + 1}]


def remove_entries(log: Sequence[dict], key: str, value) -> list[dict]:
    """The edit log without the entries of one segment or class; the replay of the rest is the result."""
    return [e for e in log if e.get(key) != value]


def merge_log(log: Sequence[dict], sources: Sequence[int], target: int) -> list[dict]:
    """Entries of merged segments go to the target, and it is visible where any of them was."""
    all_ = {*sources, target}
    out = []
    for e in log:
        seen = e.get("visible")
        if seen is not None and all_ & set(seen):
            seen = tuple(sorted((set(seen) - set(sources)) | {target}))
        out.append({**e, **({"segment": target} if e.get("segment") in all_ else {}), **({"visible": seen} if seen is not None else {})})
    return out
