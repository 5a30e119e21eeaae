"""Registered queries that write files, read them back and so cover sinks and scans together."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..operators import annotate, chunks, columns, metrics, ml, neighbors
from ..sources import las, ply, stores, text
from ..work import new_path
from . import fixtures as fx
from .catalogue import _CHUNK, _CHUNKED, _LEVELS, _M, _PLANES, _SCHUNK, _chunk_boxes, _levels, _schunk, query, r6, rounded


def _las_points(spark, d):
    p = fx.pts_v(spark, d)
    whole = [F.col(f"q{a}").cast("int").alias(a.upper()) for a in "xyz"]
    return p.select(*whole, F.col("class_id").cast("int").alias("classification"), F.col("r").cast("int").alias("red"), F.col("point_id").alias("POINT_ID"), F.col("intensity").cast("double").alias("value_0_5"))


def _las_folder(spark, d):
    path = new_path(spark, "las")
    las.register(spark)
    _las_points(spark, d).write.format("las").mode("append").option("scale", "0.01").save(path)
    return path


@query(f"WITH {fx.PTS_V} SELECT point_id, qx, qy, qz, class_id, r, {r6('intensity')} AS value FROM pts_v")
def las_round_trip(spark, d):
    df = spark.read.format("las").load(_las_folder(spark, d))
    names = {"POINT_ID": "point_id", "X": "qx", "Y": "qy", "Z": "qz", "classification": "class_id", "red": "r"}
    return df.select(*[F.col(c).cast("long").alias(n) for c, n in names.items()], rounded("value_0_5").alias("value"))


@query(f"WITH {fx.PTS_V} SELECT class_id, count(*) AS points, sum(point_id) AS ids FROM pts_v GROUP BY class_id")
def las_projected_scan(spark, d):
    df = spark.read.format("las").option("columns", "POINT_ID,classification").option("rows", 5000).load(_las_folder(spark, d))
    return df.groupBy(F.col("classification").cast("long").alias("class_id")).agg(F.count("*").alias("points"), F.sum("POINT_ID").cast("decimal(38,0)").alias("ids"))


@query(f"WITH {fx.PTS_V} SELECT count(*) AS points, " + ", ".join(f"min(q{a}) AS low_{a}, max(q{a}) AS high_{a}" for a in "xyz") + " FROM pts_v")
def las_headers(spark, d):
    heads = [las.inspect(p) for p in las.files_under(_las_folder(spark, d))]
    ticks = lambda v: int(round(v / 0.01))
    box = [g(ticks(h[side][k]) for h in heads) for k in range(3) for side, g in (("low", min), ("high", max))]
    return spark.createDataFrame([(sum(h["points"] for h in heads), *box)], "points bigint, " + ", ".join(f"low_{a} bigint, high_{a} bigint" for a in "xyz"))


@query(f"WITH {fx.PTS_V} SELECT point_id, row_number() OVER (ORDER BY qx, point_id) - 1 AS row, (point_id % 5) AS prediction FROM pts_v")
def las_in_order_with_prediction(spark, d):
    """One file in an order, to whose records a column is then appended."""
    path, target = new_path(spark, "las") + ".las", new_path(spark, "las") + ".las"
    n = las.write_single(_las_points(spark, d), path, ["X", "POINT_ID"], 0.01)
    h = las.read_header(path)
    values = np.zeros(n, np.uint8)
    fs, inner = las._open(path)
    with fs.open_input_file(inner) as f:  # the values of one column, a byte a point
        f.seek(h.offset)
        for a in range(0, n, las.LEAST_ROWS):
            m = min(las.LEAST_ROWS, n - a)
            values[a : a + m] = np.frombuffer(f.read(m * h.record), h.dtype)["POINT_ID"] % 5
    las.append_column(path, target, values)
    df = spark.read.format("las").option("columns", "row,POINT_ID,prediction").load(target)
    return df.select(F.col("POINT_ID").alias("point_id"), "row", F.col("prediction").cast("long").alias("prediction"))


@query(f"WITH {fx.PTS_V} SELECT point_id, qx, 0 AS scan_angle, CAST(0 AS DOUBLE) AS normal, class_id FROM pts_v")
def las_canonical_columns(spark, d):
    c = las.canonicalize(_las_points(spark, d))
    return c.select(F.col("POINT_ID").alias("point_id"), F.col("X").cast("long").alias("qx"), "scan_angle", F.col("NormalX").cast("double").alias("normal"), F.col("classification").cast("long").alias("class_id"))


@query(f"WITH {fx.PTS_V} SELECT row_number() OVER (ORDER BY point_id) - 1 AS row, CAST(qx AS DOUBLE) * 0.01 AS x, CAST(qy AS DOUBLE) AS y, r AS red FROM pts_v")
def ply_round_trip(spark, d):
    path = new_path(spark, "ply") + ".ply"
    p = fx.pts_v(spark, d).select("point_id", (F.col("qx").cast("double") * 0.01).alias("x"), F.col("qy").cast("double").alias("y"), F.col("r").cast("int").alias("red"))
    ply.write(p, path, ["point_id"], ["x", "y", "red"])
    return ply.read(spark, path, 20_000).select("row", "x", "y", F.col("red").cast("long").alias("red"))


@query(f"WITH {fx.PTS_V} SELECT CAST(qx AS DOUBLE) AS x, CAST(qy AS DOUBLE) AS y, CAST(qz AS DOUBLE) AS z, CAST(class_id AS DOUBLE) AS label FROM pts_v")
def text_round_trip(spark, d):
    path = new_path(spark, "text")
    p = fx.pts_v(spark, d).select(F.col("qx").alias("x"), F.col("qy").alias("y"), F.col("qz").alias("z"), F.col("class_id").alias("label"))
    text.write(p, path, ["x", "y", "z", "label"])
    return text.read_labelled(spark, path, ["x", "y", "z", "label"])


@query(f"WITH {fx.ANN} SELECT point_id, segment_id, class_id FROM ann")
def annotation_store(spark, d):
    path = new_path(spark, "ann") + ".bin"
    a = fx.ann(spark, d)
    points = a.agg(F.max("point_id")).first()[0] + 1
    stores.write_annotations(a, path, points)
    return stores.read_annotations(spark, path).select("point_id", F.col("segment_id").cast("long").alias("segment_id"), F.col("class_id").cast("long").alias("class_id"))


@query(f"WITH {fx.ANN} SELECT point_id, segment_id + 1 AS segment_id FROM ann")
def store_versions(spark, d):
    folder = new_path(spark, "versions")
    a = fx.ann(spark, d).select("point_id", "segment_id")
    stores.write_versioned(a, folder, 1)
    stores.write_versioned(a.withColumn("segment_id", F.col("segment_id") + 1), folder, 2)
    return stores.read_latest(spark, folder).select("point_id", "segment_id")


@query(f"WITH {fx.PTS_V}, {_CHUNKED}, {_LEVELS}, q AS (SELECT point_id, chunk, row_number() OVER (PARTITION BY chunk ORDER BY level, pk, point_id) - 1 AS seq FROM lv) SELECT chunk, seq, point_id FROM q WHERE seq BETWEEN 10 AND 49")
def chunk_store_range(spark, d):
    path = new_path(spark, "chunks")
    chunks.write_store(chunks.sequence(_levels(spark, d)), path)
    store = spark.read.parquet(path)
    return stores.read_range(store, 10, 40).select("chunk", F.col("seq").cast("long").alias("seq"), "point_id")


@query(f"WITH {_SCHUNK} SELECT splat_id, chunk, x, opacity FROM sc")
def splat_store(spark, d):
    path = new_path(spark, "splats")
    stores.write_splats(_schunk(spark, d).withColumn("seq", F.col("splat_id")), path)
    return stores.read_splats(spark, path, source_order=True).select("splat_id", "chunk", "x", "opacity")


@query(
    f"WITH {fx.PRED}, c AS (SELECT DISTINCT y AS label FROM pred), m AS (SELECT label, count(*) FILTER (WHERE y = label AND yhat = label) AS tp, count(*) FILTER (WHERE y = label) AS pos, count(*) FILTER (WHERE yhat = label) AS got FROM pred, c GROUP BY label) "
    "SELECT CAST(label AS BIGINT) AS label, printf('%.4f', CAST(tp AS DOUBLE)/got) AS precision, printf('%.4f', CAST(tp AS DOUBLE)/pos) AS recall, printf('%.4f', CAST(tp AS DOUBLE)/(pos+got-tp)) AS iou FROM m"
)
def training_report(spark, d):
    """The report as text, read back section by section."""
    sections = metrics.parse_report(metrics.report(metrics.confusion(fx.pred(spark, d)), [("f0", 0.75), ("f1", 0.25)], 0.5))
    rows = []
    for head, lines in sections.items():
        if head.startswith("Class "):
            of = dict(x.split(" = ") for x in lines)
            rows.append((int(head.split()[1]), of["precision"], of["recall"], of["iou"]))
    return spark.createDataFrame(rows, "label bigint, precision string, recall string, iou string")


@query(f"WITH {fx.PTS_V}, {fx.VALUES_SUBSET} SELECT pts_v.point_id, prediction, CAST(f1 AS DOUBLE) AS f1 FROM pts_v LEFT JOIN vals ON pts_v.point_id = vals.point_id")
def column_refresh(spark, d):
    """Columns that the incoming values lack go from the store's table, and theirs come."""
    store, values = fx.pts_v(spark, d).withColumn("prediction", F.lit(9).cast("long")), fx.values_subset(spark, d)
    left = columns.prune(store, [c for c in values.columns if c != "point_id"])
    return columns.merge(left, values).select("point_id", "prediction", F.col("f1").cast("double").alias("f1"))


_SPLAT_FILE = ["x", "y", "z", "opacity", "s0", "s1", "s2", "rw", "rx", "ry", "rz"]


@query(f"WITH {fx.SPLATS} SELECT row_number() OVER (ORDER BY splat_id) - 1 AS row, " + ", ".join(f"CAST(CAST({c} AS FLOAT) AS DOUBLE) AS {c}" for c in _SPLAT_FILE) + " FROM spl")
def splat_ply_export(spark, d):
    """The splats as one file in source order."""
    path = new_path(spark, "splats") + ".ply"
    ply.write(fx.splats(spark, d).select("splat_id", *[F.col(c).cast("float").alias(c) for c in _SPLAT_FILE]), path, ["splat_id"], _SPLAT_FILE)
    return ply.read(spark, path).select("row", *[F.col(c).cast("double").alias(c) for c in _SPLAT_FILE])


_U = "((point_id % 2147483647) * 48271 % 2147483647) / 2147483647.0"


@query(
    f"WITH {fx.PTS_E}, n AS (SELECT count(*) AS n FROM pts_e), s AS (SELECT p.* FROM pts_e p, n WHERE {_U} < 250.0/n), m AS (SELECT count(*) AS m FROM s), "
    f"nn AS (SELECT p.point_id, min((q.qx-p.qx)*(q.qx-p.qx)+(q.qy-p.qy)*(q.qy-p.qy)+(q.qz-p.qz)*(q.qz-p.qz)) AS d2 FROM s p JOIN s q ON p.point_id <> q.point_id GROUP BY p.point_id) "
    f"SELECT {r6('median(sqrt(d2))*0.0001*pow(CAST(any_value(m) AS DOUBLE)/any_value(n), 1.0/3)', 6)} AS voxel_distance FROM nn, n, m"
)
def nn_median_of_sample(spark, d):
    return neighbors.nn_distance_of_sample(fx.pts_e(spark, d), 250_000, fx.UNIT, 250).select(rounded("voxel_distance").alias("voxel_distance"))


@query(
    f"WITH {fx.PTS_V}, t AS (SELECT k, greatest(600.0, 40000.0/pow(1.5, k)) AS edge FROM range(12) r(k)), c AS (SELECT k, edge, qx // CAST(floor(edge) AS BIGINT) AS tx, qy // CAST(floor(edge) AS BIGINT) AS ty, count(*) AS n FROM pts_v, t GROUP BY ALL), "
    f"w AS (SELECT k, edge, max(n) AS worst FROM c GROUP BY k, edge) SELECT {r6('max(edge)', 3)} AS edge FROM w WHERE worst <= 400 OR edge = 600.0"
)
def tile_size_search(spark, d):
    return spark.range(1).select(rounded(F.lit(float(chunks.tile_size(fx.pts_v(spark, d), 400, 40000.0, 300.0))), 3).alias("edge"))


@query(
    f"WITH {fx.PTS_V}, w AS (SELECT point_id, class_id, qx*0.02+qz*0.001+5.0 AS a, qy*0.03+qz*0.002+7.0 AS b, qy*0.00001+qz*0.00002+1.0 AS w FROM (SELECT point_id, class_id, CAST(qx AS DOUBLE) AS qx, CAST(qy AS DOUBLE) AS qy, CAST(qz AS DOUBLE) AS qz FROM pts_v)), "
    f"e AS (SELECT point_id, w, (a/w-200.0)*(a/w-200.0)+(b/w-150.0)*(b/w-150.0) AS d2 FROM w WHERE w > 0 AND class_id <> 2) SELECT point_id, {r6('d2', 3)} AS d2, {r6('w')} AS w FROM e WHERE d2 <= 250000.0 ORDER BY e.d2, point_id LIMIT 6"
)
def pick_visible(spark, d):
    p = fx.pts_v(spark, d).select("point_id", "class_id", *[F.col(f"q{a}").cast("double").alias(f"q{a}") for a in "xyz"])
    return annotate.pick_visible(p, _M, F.col("class_id") != 2, 200.0, 150.0, 500.0).select("point_id", rounded("d2", 3).alias("d2"), rounded("w").alias("w"))


@query(
    f"WITH {fx.PTS_V}, {_CHUNK}, s AS (SELECT chunk, points, (lx+hx)/2.0 AS x, (ly+hy)/2.0 AS y, (lz+hz)/2.0 AS z, sqrt(CAST((hx-lx)*(hx-lx)+(hy-ly)*(hy-ly)+(hz-lz)*(hz-lz) AS DOUBLE))/2.0 AS radius FROM c) "
    "SELECT chunk, points FROM s WHERE (x*1.0+y*0.0+z*0.0-6000.0 >= -radius AND x*0.0+y*0.6+z*0.8-9000.0 >= -radius AND x*-1.0+44000.0 >= -radius) OR (x-60000.0)*(x-60000.0)+(y-7000.0)*(y-7000.0)+(z-40000.0)*(z-40000.0) <= radius*radius"
)
def chunk_cull_around_eye(spark, d):
    c = _chunk_boxes(spark, d)
    mid = {a: (F.col(f"l{a}") + F.col(f"h{a}")) / 2.0 for a in "xyz"}
    span = [F.col(f"h{a}") - F.col(f"l{a}") for a in "xyz"]
    radius = F.sqrt((span[0] * span[0] + span[1] * span[1] + span[2] * span[2]).cast("double")) / 2.0
    return c.filter(geo.sphere_in_view(mid["x"], mid["y"], mid["z"], radius, _PLANES, (60000.0, 7000.0, 40000.0))).select("chunk", "points")


@query("SELECT 'trainable' AS kind, column_name AS name FROM information_schema.columns WHERE table_name = 'events' AND column_name NOT IN ('X', 'Y', 'Z') UNION ALL SELECT 'trainable', unnest(['X', 'Y', 'Z']) UNION ALL SELECT 'lacking', unnest(['f9'])")
def feature_selection(spark, d):
    """Features that a table offers for training, and one of those asked for that it lacks."""
    t = fx.table(spark, d, "events")
    rows = [("trainable", c) for c in ml.trainable_features(t.columns)] + [("lacking", c) for c in ml.present_features(t, ["value", "f9"])[1]]
    return spark.createDataFrame(rows, "kind string, name string")
