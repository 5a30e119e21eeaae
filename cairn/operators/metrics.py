"""Classification metrics from one confusion matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(pred: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """``y, yhat, n`` over the union of true and predicted labels, zeros included; labels are few."""
    counts = pred.groupBy(y, yhat).agg(F.count("*").alias("n"))
    labels = counts.select(F.col(y).alias("label")).union(counts.select(yhat)).distinct()
    grid = labels.select(F.col("label").alias(y)).crossJoin(F.broadcast(labels.select(F.col("label").alias(yhat))))
    return grid.join(counts, [y, yhat], "left").select(y, yhat, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def class_metrics(matrix: DataFrame) -> DataFrame:
    """``label, support, precision, recall, f1, iou`` of each class; undefined ratios are 0."""
    rows = matrix.groupBy(F.col("y").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(0)).alias("tp"))
    cols = matrix.groupBy(F.col("yhat").alias("label")).agg(F.sum("n").alias("claimed"))
    ratio = lambda a, b: F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))
    tp, support, claimed = F.col("tp"), F.col("support"), F.col("claimed")
    return rows.join(cols, "label").select("label", "support", ratio(tp, claimed).alias("precision"), ratio(tp, support).alias("recall"), ratio(2 * tp, support + claimed).alias("f1"), ratio(tp, support + claimed - tp).alias("iou"))


def summary(matrix: DataFrame) -> DataFrame:
    """``kind, accuracy, precision, recall, f1, iou``: the mean of the classes and their mean weighted by support."""
    m = class_metrics(matrix)
    names = ("precision", "recall", "f1", "iou")
    acc = matrix.agg((F.sum(F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(0)).cast("double") / F.sum("n")).alias("accuracy"))
    plain = m.agg(*[F.avg(c).alias(c) for c in names]).withColumn("kind", F.lit("average"))
    weighted = m.agg(*[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in names]).withColumn("kind", F.lit("weighted"))
    return plain.unionByName(weighted).crossJoin(F.broadcast(acc)).select("kind", "accuracy", *names)


def report(matrix: DataFrame, importances: list[tuple[str, float]], voxel_distance: float | None, seconds: dict[str, float] | None = None) -> str:
    """The training report as text, from tables with a row for each class."""
    classes = class_metrics(matrix).orderBy("label").collect()
    totals = {r.kind: r for r in summary(matrix).collect()}
    lines = [f"Overall accuracy = {totals['average'].accuracy:.4f}", ""]
    for r in classes:
        lines += [f"Class {r.label}", *[f"{n} = {r[n]:.4f}" for n in ("precision", "recall", "f1", "iou")], ""]
    for kind in ("average", "weighted"):
        lines += [kind.capitalize(), *[f"{n} = {totals[kind][n]:.4f}" for n in ("precision", "recall", "f1", "iou")], ""]
    cells = {(r.y, r.yhat): r.n for r in matrix.collect()}
    labels = sorted({k for pair in cells for k in pair})
    lines += ["Confusion matrix", *[" ".join(str(cells[a, b]) for b in labels) for a in labels], ""]
    lines += ["Feature importance", *[f"{n} {v:.4f}" for n, v in sorted(importances, key=lambda x: -x[1])], ""]
    if voxel_distance is not None:
        lines += [f"Voxel distance value = {voxel_distance}", ""]
    lines += [f"{k} time = {v:.1f} s" for k, v in (seconds or {}).items()]
    return "\n".join(lines)


def parse_report(text: str) -> dict[str, list[str]]:
    """Sections of a report: heading to lines until a blank one."""
    out: dict[str, list[str]] = {}
    for block in text.strip().split("\n\n"):
        head, *rest = block.split("\n")
        out[head] = rest
    return out


def voxel_distance_of(column="report"):
    return F.regexp_extract(F.col(column), r"Voxel distance value = ([0-9.eE+-]+)", 1).try_cast("double")
