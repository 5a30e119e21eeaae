"""Point tables derived from the driver's tables, as frames and as the SQL that says the same.

``pts_e``: a dense cloud from the embeddings; ``pts_v``: a larger one from the events. Positions are integers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Quantisation of ``pts_e``.
UNIT = 1e-4

#: Class numbers of event types (fixed values).
CLASSES = {"click": 1, "error": 2, "purchase": 3, "signup": 4, "view": 5}

#: A concave ring in the plane of qx and qy (fixed values).
LASSO = [(1000.0, 500.0), (30000.0, 200.0), (42000.0, 6000.0), (20000.0, 5000.0), (41000.0, 14000.0), (15000.0, 9000.0), (9000.0, 14500.0), (500.0, 12000.0), (4000.0, 6000.0)]

#: Three cuts and three classifications in the plane of qx and qy (fixed values).
CUTS = [
    {"order": 1, "segment": 1, "regions": [("rect", (0, 0, 20000, 8000))], "low": (0, 0, 0), "high": (25000, 9000, 80000), "visible": (0,)},
    {"order": 2, "segment": 2, "regions": [("rect", (10000, 4000, 30000, 12000))], "low": (5000, 3000, 10000), "high": (40000, 12000, 70000), "visible": (0, 1)},
    {"order": 3, "segment": 3, "regions": [("rect", (15000, 0, 45000, 14900))], "deregions": [("rect", (18000, 2000, 22000, 6000))], "low": (0, 0, 0), "high": (50000, 15000, 90000), "visible": (0, 2)},
]
LABELS = [
    {"order": 1, "class": 1, "regions": [("rect", (0, 0, 30000, 10000))]},
    {"order": 2, "class": 2, "regions": [("rect", (5000, 2000, 15000, 14000))], "visible": (0, 1)},
    {"order": 3, "class": 4, "regions": [("rect", (12000, 1000, 26000, 7000))], "inverted": False, "visible": (2, 3)},
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def component(i: int):
    return F.col("embedding")[i].cast("double")


def quantised(i: int):
    return F.floor(component(i) * 10000 + 0.5).cast("long")


def pts_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "embeddings")
    return t.select(F.col("vec_id").alias("point_id"), quantised(0).alias("qx"), quantised(1).alias("qy"), quantised(2).alias("qz"), F.col("label").cast("long").alias("class_id"))


PTS_E = """pts_e AS (SELECT vec_id AS point_id, CAST(floor(CAST(embedding[1] AS DOUBLE)*10000+0.5) AS BIGINT) AS qx, CAST(floor(CAST(embedding[2] AS DOUBLE)*10000+0.5) AS BIGINT) AS qy,
  CAST(floor(CAST(embedding[3] AS DOUBLE)*10000+0.5) AS BIGINT) AS qz, CAST(label AS BIGINT) AS class_id FROM embeddings)"""


def event_class():
    out = None
    for k, v in CLASSES.items():
        out = F.when(F.col("event_type") == k, v) if out is None else out.when(F.col("event_type") == k, v)
    return out.cast("long")


def pts_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events")
    return t.select(
        F.col("event_id").alias("point_id"), F.floor(F.col("value") * 100 + 0.5).cast("long").alias("qx"), (F.col("user_id") * 100).alias("qy"),
        (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).cast("long").alias("qz"),
        (F.col("event_id") % 256).alias("r"), (F.col("user_id") % 256).alias("g"), F.hour("ts").cast("long").alias("b"), event_class().alias("class_id"), F.col("value").alias("intensity"),
    )


_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in CLASSES.items()) + " END"
PTS_V = f"""pts_v AS (SELECT event_id AS point_id, CAST(floor(value*100+0.5) AS BIGINT) AS qx, user_id*100 AS qy, CAST(hour(ts)*3600+minute(ts)*60+second(ts) AS BIGINT) AS qz,
  event_id%256 AS r, user_id%256 AS g, CAST(hour(ts) AS BIGINT) AS b, CAST({_CASE} AS BIGINT) AS class_id, value AS intensity FROM events)"""


def ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events").filter(F.col("event_id") % 10 != 0)
    return t.select(F.col("event_id").alias("point_id"), (F.col("user_id") % 5).alias("segment_id"), F.when(F.col("event_id") % 7 == 0, F.lit(0).cast("long")).otherwise(event_class()).alias("class_id"))


ANN = f"""ann AS (SELECT event_id AS point_id, user_id%5 AS segment_id, CAST(CASE WHEN event_id%7=0 THEN 0 ELSE {_CASE} END AS BIGINT) AS class_id FROM events WHERE event_id%10<>0)"""


def ann_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events").filter(F.col("event_id") % 4 == 0)
    return t.select(F.col("event_id").alias("point_id"), ((F.col("user_id") + 1) % 5).alias("segment_id"), (F.col("event_id") % 5).alias("class_id"))


ANN_PATCH = "ann_patch AS (SELECT event_id AS point_id, (user_id+1)%5 AS segment_id, event_id%5 AS class_id FROM events WHERE event_id%4=0)"


def values_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events").filter(F.col("event_id") % 3 == 0)
    return t.select(F.col("event_id").alias("point_id"), (F.col("event_id") % 5).alias("prediction"), F.col("value").alias("f1"))


VALUES_SUBSET = "vals AS (SELECT event_id AS point_id, event_id%5 AS prediction, value AS f1 FROM events WHERE event_id%3=0)"


def values_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events")
    foreign = t.filter(F.col("event_id") % 50 == 0).select((F.col("event_id") + 1_000_000_000).alias("point_id"), F.lit(1).cast("long").alias("prediction"))
    own = t.filter(F.col("event_id") % 3 == 0).select(F.col("event_id").alias("point_id"), (F.col("event_id") % 5).alias("prediction"))
    twice = t.filter(F.col("event_id") % 300 == 0).select(F.col("event_id").alias("point_id"), F.lit(2).cast("long").alias("prediction"))
    return foreign.unionByName(own).unionByName(twice)


VALUES_BAD = """bad AS (SELECT event_id+1000000000 AS point_id, 1 AS prediction FROM events WHERE event_id%50=0 UNION ALL
  SELECT event_id, event_id%5 FROM events WHERE event_id%3=0 UNION ALL SELECT event_id, 2 FROM events WHERE event_id%300=0)"""


def pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pts_v(spark, sf_dir).select("point_id", F.col("class_id").alias("y"))
    return p.withColumn("yhat", F.when(F.col("point_id") % 4 == 0, F.col("y") % 5 + 1).otherwise(F.col("y")))


PRED = f"pred AS (SELECT event_id AS point_id, {_CASE} AS y, CASE WHEN event_id%4=0 THEN ({_CASE})%5+1 ELSE {_CASE} END AS yhat FROM events)"


def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right-angled triangles whose areas follow from the parts table."""
    t = table(spark, sf_dir, "part")
    size, price = F.col("p_size").cast("double"), F.floor(F.col("p_retailprice")).cast("double")
    zero = F.lit(0.0)
    return t.select((F.col("p_size") % 5).cast("long").alias("submesh_id"), F.col("p_partkey").alias("tri_id"), F.array(zero, zero, zero).alias("v0"), F.array(size, zero, zero).alias("v1"), F.array(zero, price, zero).alias("v2"))


TRIANGLES = "tri AS (SELECT CAST(p_size%5 AS BIGINT) AS submesh_id, p_partkey AS tri_id, CAST(p_size AS DOUBLE) AS a, CAST(floor(p_retailprice) AS DOUBLE) AS b, 0.5*sqrt(CAST(p_size AS DOUBLE)*floor(p_retailprice)*CAST(p_size AS DOUBLE)*floor(p_retailprice)) AS area FROM part)"


def splats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splats from components of the embeddings."""
    t = table(spark, sf_dir, "embeddings")
    names = ["x", "y", "z", "rw", "rx", "ry", "rz", "s0", "s1", "s2", "opacity", "dc0", "dc1", "dc2", *[f"sh{k}" for k in range(9)]]
    return t.select(F.col("vec_id").alias("splat_id"), *[component(i).alias(n) for i, n in enumerate(names)])


SPLATS = "spl AS (SELECT vec_id AS splat_id, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {n}" for i, n in enumerate(["x", "y", "z", "rw", "rx", "ry", "rz", "s0", "s1", "s2", "opacity", "dc0", "dc1", "dc2", *[f"sh{k}" for k in range(9)]])) + " FROM embeddings)"


def forest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "embeddings")
    y = (component(0) > 0).cast("int") + 2 * (component(1) > 0).cast("int")
    return t.select(F.col("vec_id").alias("point_id"), y.alias("labels"), *[component(i).alias(f"f{i}") for i in range(4)])
