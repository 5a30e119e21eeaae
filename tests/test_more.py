import io
import zipfile

import pytest
from pyspark.sql import functions as F

from cairn.operators import annotate, chunks
from cairn.plans import fixtures as fx
from cairn.plans import jobs
from cairn.sources import las, stores


def test_ranges_with_a_longest(spark):
    rows = [(1, 0, 10), (1, 12, 20), (1, 21, 40), (1, 100, 110), (2, 5, 6)]
    df = spark.createDataFrame(rows, "k int, start bigint, stop bigint")
    got = sorted(map(tuple, chunks.coalesce_ranges(df, "k", gap=3, most=25).collect()))
    assert got == [(1, 0, 20), (1, 21, 40), (1, 100, 110), (2, 5, 6)]
    assert sorted(map(tuple, chunks.coalesce_ranges(df, "k", gap=3).collect())) == [(1, 0, 40), (1, 100, 110), (2, 5, 6)]


def test_store_and_splits(spark, data, tmp_path):
    p = chunks.sequence(chunks.assign_levels(fx.pts_v(spark, data).withColumn("chunk", F.floor(F.col("qx") / 10000)), (0, 0, 0), 86400, 3, 3))
    chunks.write_store(p, str(tmp_path / "store"))
    back = spark.read.parquet(str(tmp_path / "store"))
    assert back.count() == p.count()
    assert stores.read_range(back.filter("chunk = 0"), 5, 10).count() == 10
    assert '"points"' in chunks.chunk_json(chunks.chunk_table(p, 1)).first().value
    annotate.write_split(annotate.split(fx.pts_v(spark, data), fx.ann(spark, data)), str(tmp_path / "split"))
    named = annotate.name_splits(spark, str(tmp_path / "split"), {1: "training", 2: "validation"})
    assert spark.table("training").count() == named["training"].count() > 0


def test_jobs(spark):
    assert jobs.run(spark, "g", lambda: spark.range(100).count()) == 100
    p = jobs.progress(spark, "g")
    assert 0 < p["done"] <= p["total"]
    jobs.stop(spark, "g")


def test_package():
    z = zipfile.ZipFile(io.BytesIO(stores.package({"a/b.txt": b"x", "c": b"y"})))
    assert z.namelist() == ["a/b.txt", "c"] and z.read("c") == b"y"
    with pytest.raises(ValueError):
        stores.package({"../x": b""})


def test_canonical(spark, tmp_path):
    from .test_sources import point_table

    (tmp_path / "a.las").write_bytes(las.encode(point_table(50)))
    info = las.inspect(str(tmp_path / "a.las"))
    assert info["extra"] == ["POINT_ID", "linearity_0_5", "prediction"] and info["points"] == 50
    las.register(spark)
    df = las.canonicalize(spark.read.format("las").load(str(tmp_path / "a.las")))
    assert df.columns[:17] == list(las.CANONICAL) and df.filter("NormalX <> 0").count() == 0


def test_draws_are_uniform_in_both(spark):
    """Points of one triangle cover its area: each cell of a grid over the two draws holds its share."""
    from cairn.operators import mesh

    n, side = 64_000, 8
    cell = lambda salt: F.floor(mesh.draw(F.lit(3), "id", salt=salt) * side)
    counts = [r.n for r in spark.range(n).groupBy(cell(1).alias("a"), cell(2).alias("b")).agg(F.count("*").alias("n")).collect()]
    want = n / side**2
    assert len(counts) == side**2 and sum((c - want) ** 2 / want for c in counts) < 110  # 63 degrees of freedom


def test_ranks(spark, monkeypatch):
    import random

    from cairn.operators import ranks

    r = random.Random(2)
    values = [r.choice([5, 5, 5, r.randrange(1000), r.randrange(10**9)]) for _ in range(3000)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v long")
    order = sorted(range(3000), key=lambda i: (values[i], i))
    got = {x.id: x.row for x in ranks.row_number(df, ["v", "id"]).collect()}
    assert [got[i] for i in order] == list(range(3000))
    assert ranks.row_number(df.limit(0), ["v", "id"]).count() == 0
    for k in (0, 700, 1500, 2999):
        assert ranks.kth(df, "v", k, min(values), max(values), small=10) == sorted(values)[k]
    assert ranks.percentile(df, "v", 0.37, small=10) == ranks.percentile(df, "v", 0.37)
    assert ranks.percentile(df.limit(0), "v", 0.5) is None


def test_nearest_keeps_nothing_in_memory(spark, data):
    from cairn.operators import neighbors
    from cairn.plans import fixtures as fx

    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    p = spark.createDataFrame([(1, 0, 0, 0), (2, 3, 0, 0), (3, 10**6, 0, 0), (4, 10**6, 50, 0), (5, -(10**7), 9, 9)], "point_id long, qx long, qy long, qz long")
    got = {r.point_id: r.nn_d2 for r in neighbors.nearest(p, 4).collect()}
    assert got == {1: 9, 2: 9, 3: 2500, 4: 2500, 5: 10**14 + 81 * 2}
    assert neighbors.nearest(p.limit(1), 4).count() == 0
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
    cloud = fx.pts_e(spark, data)
    whole = neighbors.nn_distance(cloud, 250_000, fx.UNIT).first()[0]
    assert 0.7 * whole < neighbors.nn_distance_of_sample(cloud, 250_000, fx.UNIT, 250).first()[0] < 1.4 * whole


def test_keys_of_large_ids(spark):
    from cairn.operators import chunks, sample

    row = spark.range(1).select(F.lit(10**15).alias("point_id")).select(chunks.shuffle_key().alias("k"), sample.uniform().alias("u")).first()
    assert row.k == 10**15 * 48271 % 2147483647 and 0 <= row.u < 1
