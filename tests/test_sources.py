"""Files written by the encoders, or by hand, and read back."""

import json
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairn.sources import glb, las, ply, stores, text
from cairn.streaming import patches


def point_table(n=1000):
    g = np.random.default_rng(3)
    return pa.table({
        "X": pa.array(g.integers(-1000, 1000, n).astype(np.int32)), "Y": pa.array(g.integers(0, 9, n).astype(np.int32)), "Z": pa.array(np.arange(n, dtype=np.int32)),
        "classification": pa.array(g.integers(0, 6, n).astype(np.int32)), "red": pa.array(g.integers(0, 65535, n).astype(np.int32)), "gps_time": pa.array(g.random(n)),
        "POINT_ID": pa.array(np.arange(n, dtype=np.int64) + 4_000_000_000), "linearity_0_5": pa.array(g.random(n).astype(np.float32)), "prediction": pa.array((np.arange(n) % 5).astype(np.int16)),
    })


def test_las_round_trip(spark, tmp_path):
    t = point_table()
    path = tmp_path / "a.las"
    path.write_bytes(las.encode(t))
    las.register(spark)
    h = las.read_header(str(path))
    assert h.canonical and h.count == 1000 and h.low[2] == 0 and h.high[2] == pytest.approx(999 * 1e-4)
    df = spark.read.format("las").option("rows", 300).load(str(path))
    assert df.rdd.getNumPartitions() == 4
    got = df.orderBy("row").toPandas()
    for c in t.column_names:
        assert (got[c].to_numpy() == t.column(c).to_numpy()).all(), c
    few = spark.read.format("las").option("columns", "POINT_ID,prediction").load(str(path))
    assert few.columns == ["POINT_ID", "prediction"] and few.count() == 1000
    with pytest.raises(Exception, match="no such fields"):
        spark.read.format("las").option("columns", "nothing").load(str(path)).count()


def test_las_writer(spark, tmp_path):
    las.register(spark)
    df = spark.range(500).select(F.col("id").cast("int").alias("X"), F.lit(1).alias("Y"), F.lit(2).alias("Z"), F.col("id").alias("POINT_ID"), (F.col("id") % 3).cast("short").alias("labels")).repartition(3)
    df.write.format("las").mode("append").save(str(tmp_path / "out"))
    back = spark.read.format("las").load(str(tmp_path / "out"))
    assert back.count() == 500 and back.agg(F.countDistinct("POINT_ID")).first()[0] == 500
    assert back.filter("labels <> POINT_ID % 3").count() == 0


def test_las_modes(spark, tmp_path):
    las.register(spark)
    df = lambda n: spark.range(n).select(F.col("id").cast("int").alias("X"), F.lit(1).alias("Y"), F.lit(2).alias("Z"), F.col("id").alias("POINT_ID")).repartition(3)
    path = str(tmp_path / "out")
    for n, mode, want in ((100, "append", 100), (10, "append", 110), (10, "overwrite", 10), (5, "overwrite", 5)):
        df(n).write.format("las").mode(mode).save(path)
        assert spark.read.format("las").load(path).count() == want


def test_las_values_that_dont_fit():
    t = point_table(4)
    for name, values in (("red", [1, 2, 70_000, 0]), ("X", [None, 1, 2, 3]), ("POINT_ID", [-1, 1, 2, 3])):
        k = t.column_names.index(name)
        with pytest.raises(las.LasError, match=name):
            las.encode(t.set_column(k, name, pa.array(values, t.schema.field(name).type)))
    k = t.column_names.index("prediction")
    assert las.encode(t.set_column(k, "prediction", pa.array([None, 1, 2, 3], pa.int16())))


def test_las_one_file(spark, tmp_path):
    df = spark.range(1000).select(F.col("id").cast("int").alias("X"), (F.col("id") % 7).cast("int").alias("Y"), F.lit(2).alias("Z"), F.col("id").alias("POINT_ID")).orderBy(F.rand(3))
    one, two, three = (str(tmp_path / f"{k}.las") for k in "abc")
    assert las.write_single(df, one, ["POINT_ID"]) == 1000
    h = las.read_header(one)
    assert h.canonical and h.low == (0.0, 0.0, 2e-4) and h.high == (pytest.approx(999e-4), pytest.approx(6e-4), 2e-4)
    las.append_column(one, two, np.arange(1000) % 7)
    las.append_column(two, three, np.arange(1000) % 5)
    for path, k in ((two, 7), (three, 5)):
        rows = spark.read.format("las").load(path).orderBy("row").collect()
        assert [(r.POINT_ID, r.prediction) for r in rows] == [(i, i % k) for i in range(1000)]
    with pytest.raises(las.LasError, match="values"):
        las.append_column(one, two, np.zeros(5))
    with open(one, "ab") as f:
        f.write(b"extended")
    with pytest.raises(las.LasError, match="extended"):
        las.append_column(one, two, np.zeros(1000))


def test_las_origin(spark):
    df = spark.createDataFrame([(1.5, 2.0, 3.0, 1), (2.5, 1.0, 9.0, 2)], "x double, y double, z double, POINT_ID long")
    made, origin = las.quantised(df, 0.01)
    assert origin == "1.5,1.0,3.0" and sorted(map(tuple, made.collect())) == [(0, 100, 0, 1), (100, 0, 600, 2)]


def test_las_errors(tmp_path):
    raw = bytearray(las.encode(point_table(5)))
    (tmp_path / "bad.las").write_bytes(b"nope" + bytes(raw[4:]))
    (tmp_path / "short.las").write_bytes(bytes(raw[:-1]))
    raw[104] |= 0x80
    (tmp_path / "packed.las").write_bytes(bytes(raw))
    for name, what in (("bad", "signature"), ("short", "fit"), ("packed", "compressed")):
        with pytest.raises(las.LasError, match=what):
            las.read_header(str(tmp_path / f"{name}.las"))


@pytest.mark.parametrize("ascii_", [False, True])
def test_ply_round_trip(spark, tmp_path, ascii_):
    t = pa.table({"x": pa.array([0.5, 1.25, -2.0], pa.float32()), "y": pa.array([1.0, 2.0, 3.0], pa.float64()), "red": pa.array([1, 2, 255], pa.int32())})
    path = tmp_path / "a.ply"
    path.write_bytes(ply.encode(t, ascii_=ascii_))
    rows = [tuple(r) for r in ply.read(spark, str(path), rows=2).orderBy("row").collect()]
    assert rows == [(0, 0.5, 1.0, 1), (1, 1.25, 2.0, 2), (2, -2.0, 3.0, 255)]


def test_ply_errors_and_big_endian(spark, tmp_path):
    head = b"ply\nformat binary_big_endian 1.0\nelement vertex 2\nproperty float x\nproperty uint id\nend_header\n"
    (tmp_path / "b.ply").write_bytes(head + struct.pack(">fIfI", 1.5, 4_000_000_000, 2.5, 7))
    assert [tuple(r) for r in ply.read(spark, str(tmp_path / "b.ply")).orderBy("row").collect()] == [(0, 1.5, 4_000_000_000), (1, 2.5, 7)]
    (tmp_path / "s.ply").write_bytes(head + b"1234")
    with pytest.raises(ply.PlyError, match="short"):
        ply.read_header(str(tmp_path / "s.ply"))
    (tmp_path / "l.ply").write_bytes(head.replace(b"property float x", b"property list uchar int v"))
    with pytest.raises(ply.PlyError, match="list"):
        ply.read_header(str(tmp_path / "l.ply"))


def test_text(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x y label\n1 2 3\n// note\n4 nan 1\n5 6\n7 8 9 extra\n")
    assert sorted(map(tuple, text.read_labelled(spark, str(tmp_path / "a.txt"), ["x", "y", "label"]).collect())) == [(1.0, 2.0, 3.0), (7.0, 8.0, 9.0)]
    assert text.feature_list("0 1,4\n7\n") == ([0, 1, 4], 7)
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 9)], "x double, y double, z double, r int")
    assert text.lines(df).first().value == "1.0 2.0 3.0 9"
    text.write(df, str(tmp_path / "out"))
    assert text.read_labelled(spark, str(tmp_path / "out"), ["x", "y", "z", "r"]).count() == 1


def test_glb(spark, tmp_path):
    at = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0]], "<f4").tobytes()
    index = np.array([0, 1, 2], "<u2").tobytes() + b"\0\0"
    doc = {
        "scenes": [{"nodes": [0]}], "nodes": [{"translation": [10, 0, 0], "children": [1]}, {"scale": [2, 2, 2], "mesh": 0}],
        "meshes": [{"primitives": [{"attributes": {"POSITION": 0}, "indices": 1, "material": 0}, {"attributes": {"POSITION": 0}, "mode": 0}]}],
        "materials": [{"pbrMetallicRoughness": {"baseColorFactor": [1, 0, 0, 1]}}],
        "accessors": [{"bufferView": 0, "componentType": 5126, "count": 3, "type": "VEC3"}, {"bufferView": 1, "componentType": 5123, "count": 3, "type": "SCALAR"}],
        "bufferViews": [{"buffer": 0, "byteOffset": 0, "byteLength": 36}, {"buffer": 0, "byteOffset": 36, "byteLength": 6}],
    }
    js = json.dumps(doc).encode()
    js += b" " * (-len(js) % 4)
    data = at + index
    raw = struct.pack("<4sII", b"glTF", 2, 28 + len(js) + len(data)) + struct.pack("<I4s", len(js), b"JSON") + js + struct.pack("<I4s", len(data), b"BIN\0") + data
    (tmp_path / "a.glb").write_bytes(raw)
    tris, points = glb.read(spark, str(tmp_path / "a.glb"))
    r = tris.first()
    assert (r.v0, r.v1, r.v2, r.c0) == ([10.0, 0.0, 0.0], [12.0, 0.0, 0.0], [10.0, 2.0, 0.0], [255.0, 0.0, 0.0])
    assert points.count() == 3 and points.first().r == 255
    with pytest.raises(glb.GlbError):
        glb.chunks_of(b"no")


def test_annotations(spark, tmp_path):
    import gzip

    raw = stores.encode_annotations([(1, 0, 3), (4, 2, 0)], 6)
    (tmp_path / "a.bin").write_bytes(raw)
    (tmp_path / "b.bin").write_bytes(gzip.compress(raw))
    for n in "ab":
        assert sorted(map(tuple, stores.read_annotations(spark, str(tmp_path / f"{n}.bin")).collect())) == [(1, 0, 3), (4, 2, 0)]
    with pytest.raises(ValueError):
        stores.decode_annotations(b"abc")


def test_ranges():
    assert stores.byte_range("bytes=0-9", 100) == (0, 9)
    assert stores.byte_range("bytes=90-", 100) == (90, 99)
    assert stores.byte_range("bytes=-10", 100) == (90, 99)
    assert stores.byte_range("bytes=100-", 100) is None and stores.byte_range("bytes=-", 100) is None


def test_patch_stream(spark, tmp_path):
    src, store = str(tmp_path / "in"), str(tmp_path / "store")
    send = lambda rows: spark.createDataFrame(rows, patches.SCHEMA).coalesce(1).write.mode("append").parquet(src)
    send([(1, 2, 3, 1), (2, 1, 1, 1), (1, 4, 5, 2)])
    patches.apply_patches(spark, src, store, str(tmp_path / "cp")).awaitTermination()
    assert sorted(map(tuple, patches.current(spark, store).collect())) == [(1, 4, 5), (2, 1, 1)]
    send([(2, 0, 9, 3), (3, 7, 7, 3), (1, 6, 6, 4)])
    patches.apply_patches(spark, src, store, str(tmp_path / "cp")).awaitTermination()
    assert sorted(map(tuple, patches.current(spark, store).collect())) == [(1, 6, 6), (2, 1, 1), (3, 7, 7)]
    assert sorted(v for v in stores.versions(spark, f"{store}/delta")) == [0, 1]
    patches.compact(spark, store)
    assert stores.versions(spark, f"{store}/delta") == [] and stores.versions(spark, f"{store}/base") == [2]
    send([(4, 1, 1, 5), (2, None, 3, 6)])
    patches.apply_patches(spark, src, store, str(tmp_path / "cp")).awaitTermination()
    assert sorted(map(tuple, patches.current(spark, store).collect())) == [(1, 6, 6), (2, 1, 1), (3, 7, 7), (4, 1, 1)]
