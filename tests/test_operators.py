"""Invariants: brute force, independence of order, partitioning and join strategy."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import annotate, blocks, chunks, columns, mesh, metrics, ml, neighbors, sample, splats, voxel
from cairn.plans import fixtures as fx


@pytest.fixture(scope="module")
def cloud(spark, data):
    return fx.pts_e(spark, data).cache()


@pytest.fixture(scope="module")
def events(spark, data):
    return fx.pts_v(spark, data).cache()


def arrays(cloud):
    rows = cloud.orderBy("point_id").collect()
    return [r.point_id for r in rows], np.array([[r.qx, r.qy, r.qz] for r in rows], np.int64)


def test_cell_join_is_brute_force(cloud):
    ids, q = arrays(cloud)
    d2 = ((q[:, None] - q[None]) ** 2).sum(2)
    for r2 in (1, 250_000, 1_000_010):
        got = {(r.point_id, r.nb_id, r.d2) for r in neighbors.cell_join(cloud, cloud, r2).collect()}
        assert got == {(ids[i], ids[j], d2[i, j]) for i, j in zip(*np.nonzero(d2 <= r2), strict=True)}


def test_dense_cells_are_salted(cloud):
    key = lambda df: sorted((r.point_id, r.nb_id) for r in df.collect())
    assert key(neighbors.cell_join(cloud, cloud, 4_000_000, dense=7)) == key(neighbors.cell_join(cloud, cloud, 4_000_000))


def test_no_nested_loop(cloud):
    plan = neighbors.moments(cloud, [1000])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_features_against_numpy(cloud):
    ids, q = arrays(cloud)
    d2 = ((q[:, None] - q[None]) ** 2).sum(2)
    got = {r.point_id: r for r in neighbors.radius_features(cloud, [0.2, 0.3], fx.UNIT).collect()}
    for r, s in ((0.2, "_0_2"), (0.3, "_0_3")):
        for i in range(0, len(ids), 9):
            near = q[d2[i] <= neighbors.squared_ticks(r, fx.UNIT)].astype(float)
            row = got[ids[i]]
            assert row["neighbours" + s] == len(near)
            if len(near) < 3:
                assert row["linearity" + s] == 0
                continue
            w, v = np.linalg.eigh(np.cov(near.T, bias=True))
            e2, e1, e0 = w
            assert row["linearity" + s] == pytest.approx((e0 - e1) / e0, abs=1e-6)
            assert row["sphericity" + s] == pytest.approx(e2 / e0, abs=1e-6)
            assert row["omnivariance" + s] == pytest.approx(math.cbrt(max(0, e0 * e1 * e2)) * 1e-8, rel=1e-4, abs=1e-9)
            if (e1 - e2) / e0 > 1e-2:
                assert row["verticality" + s] == pytest.approx(1 - abs(v[1, 0]), abs=1e-4)


def test_features_do_not_depend_on_order(cloud):
    rows = lambda df: sorted(map(tuple, neighbors.radius_features(df, [0.2], fx.UNIT, ["linearity", "neighbours"]).collect()))
    assert rows(cloud) == rows(cloud.orderBy(F.desc("point_id")).repartition(7))


def test_feature_arguments(cloud):
    with pytest.raises(ValueError):
        neighbors.radius_features(cloud, [], fx.UNIT)
    with pytest.raises(ValueError):
        neighbors.radius_features(cloud, [0.1], fx.UNIT, ["height"])


def test_nearest_finds_isolated_points(spark):
    p = spark.createDataFrame([(1, 0, 0, 0), (2, 3, 0, 0), (3, 10**6, 0, 0)], "point_id bigint, qx bigint, qy bigint, qz bigint")
    assert {r.point_id: r.nn_d2 for r in neighbors.nearest(p, 4).collect()} == {1: 9, 2: 9, 3: (10**6 - 3) ** 2}


def test_normals_of_a_plane(spark):
    rows = [(i * 20 + j, i * 10, 500, j * 10) for i in range(20) for j in range(20)]
    p = spark.createDataFrame(rows, "point_id bigint, qx bigint, qy bigint, qz bigint")
    got = neighbors.normals(p, 900, 30).collect()
    assert len(got) == 400 and all(abs(r.ny + 1) < 1e-6 for r in got)


def test_nearest_in_blocks_is_brute_force(cloud):
    """Pairs aren't rows: no window ranks them, and chunks of any size give the same."""
    assert "Window" not in neighbors.normals(cloud, 4_000_000)._jdf.queryExecution().executedPlan().toString()
    ids, q = arrays(cloud)
    d2 = ((q[:, None] - q[None]) ** 2).sum(2)
    got = {r.point_id: r for r in blocks.sums_of_nearest(cloud, 4_000_000, 7, size=150).collect()}
    for i in range(len(ids)):
        near = sorted(np.flatnonzero(d2[i] <= 4_000_000), key=lambda j: (d2[i, j], ids[j]))[:7]
        d = q[near] - q[i]
        assert (got[ids[i]].n0, got[ids[i]].sx0, got[ids[i]].syz0) == (len(near), d[:, 0].sum(), (d[:, 1] * d[:, 2]).sum())


def test_sums_in_blocks_are_brute_force(cloud):
    """Pairs aren't rows: nothing is exploded to cells, and blocks inside, outside and across the sphere add up."""
    assert "d2" not in neighbors.moments(cloud, [1000])._jdf.queryExecution().executedPlan().toString()
    ids, q = arrays(cloud)
    d2 = ((q[:, None] - q[None]) ** 2).sum(2)
    got = {r.point_id: r for r in blocks.sums_within(cloud, [1_000_010, 9_000_000], size=150).collect()}
    for k, r2 in enumerate((1_000_010, 9_000_000)):
        for i in range(len(ids)):
            d = q[d2[i] <= r2] - q[i]
            row = got[ids[i]]
            assert (row[f"n{k}"], row[f"sx{k}"], row[f"sxz{k}"], row[f"low{k}"], row[f"high{k}"]) == (len(d), d[:, 0].sum(), (d[:, 0] * d[:, 2]).sum(), d[:, 1].min(), d[:, 1].max())


def test_sums_of_equal_and_distant_places(spark):
    far = 5 * 10**9
    rows = [(i, far * (i % 2), 7, -far) for i in range(300)] + [(None, 1, 7, -far), (301, None, 7, 0)]
    p = spark.createDataFrame(rows, "point_id bigint, qx bigint, qy bigint, qz bigint")
    got = {r.point_id: (r.n0, r.sx0) for r in blocks.sums_within(p, [4], size=140).collect()}
    assert got.pop(None) == (151, -150) and len(got) == 300
    assert {v for k, v in got.items() if k % 2} == {(150, 0)} and {v for k, v in got.items() if not k % 2} == {(151, 1)}


def test_levels_invariants(events):
    p = chunks.assign_levels(events.withColumn("chunk", F.lit(0)), (0, 0, 0), 86400, 3, 4)
    rows = p.collect()
    assert sorted(r.point_id for r in rows) == sorted(r.point_id for r in events.collect())
    taken = set()
    for k in range(5):
        cells = [(r.qx * 2 ** (3 + k) // 86400, r.qy * 2 ** (3 + k) // 86400, r.qz * 2 ** (3 + k) // 86400) for r in rows if r.level == k]
        if k < 4:
            assert len(cells) == len(set(cells))
            taken.add(k)
    again = chunks.assign_levels(events.withColumn("chunk", F.lit(0)).repartition(9), (0, 0, 0), 86400, 3, 4)
    assert sorted((r.point_id, r.level) for r in again.collect()) == sorted((r.point_id, r.level) for r in rows)


def test_no_task_has_a_whole_chunk(events):
    """A chunk may hold any number of points: neither levels nor places in a chunk put it in one task."""
    one = events.withColumn("chunk", F.lit(0).cast("long"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    levels = chunks.assign_levels(one, (0, 0, 0), 86400, 3, 4)
    assert not re.search(r"hashpartitioning\(chunk#\d+L?, \d+\)", plan(levels))
    order = [(r.level, r.perm_key, r.point_id) for r in levels.collect()]
    for made, name, want in (
        (chunks.sequence(levels), "seq", sorted(order)),
        (chunks.permuted(one.withColumn("perm_key", chunks.shuffle_key())), "perm", sorted(order, key=lambda r: r[1:])),
        (chunks.input_rank(one), "rank", sorted(order, key=lambda r: r[2])),
    ):
        assert not re.search(r"row_number\(\) windowspecdefinition\((chunk#\d+L?|0), (?!__|level)", plan(made))
        assert [r.point_id for r in made.orderBy(name).collect()] == [r[2] for r in want]
        assert made.agg(F.min(name), F.max(name)).first()[:2] == (0, len(order) - 1)


def test_levels_are_first_free_points(events):
    """Against a plain loop, for points that crowd few cells and an adaptive end, in chunks of their own."""
    p = events.select("point_id", (F.col("qx") % 3000).alias("qx"), (F.col("qy") % 3000).alias("qy"), F.col("qz"), (F.col("point_id") % 3).alias("chunk"))
    rows = p.collect()
    for adaptive in (False, True):
        want = {}
        for c in range(3):
            free = sorted((r for r in rows if r.chunk == c), key=lambda r: (r.point_id * 48271 % 2147483647, r.point_id))
            stop = max(20, len(free) // 2)
            for k in range(5):
                if adaptive and k and len(free) < stop:
                    break
                side, seen, rest = 2 ** (2 + k), set(), []
                for r in free:
                    at = tuple(min(int(v / 86400.0 * side), side - 1) for v in (r.qx, r.qy, r.qz))
                    if at in seen:
                        rest.append(r)
                    else:
                        seen.add(at)
                        want[r.point_id] = k
                free = rest
            want |= {r.point_id: 5 for r in free}
        made = chunks.assign_levels(p, (0, 0, 0), 86400, 2, 5, adaptive=adaptive, remainder_share=0.5, remainder_least=20)
        assert {r.point_id: r.level for r in made.collect()} == want


def test_adaptive_levels_stop(events):
    p = chunks.assign_levels(events.withColumn("chunk", F.lit(0)), (0, 0, 0), 86400, 3, 6, adaptive=True, remainder_least=300)
    sizes = {r.level: r["count"] for r in p.groupBy("level").count().collect()}
    assert sum(sizes.values()) == events.count() and sizes.get(6, 0) < 300 + max(sizes.values())


def test_chunks_hold_at_most(events):
    p = chunks.assign_chunks(events, (0, 0, 0), 86400, depth=3, max_points=25, extra=8)
    assert p.count() == events.count()
    sizes = p.groupBy("chunk_depth", "chunk").count().collect()
    assert all(r["count"] <= 25 for r in sizes if r.chunk_depth < 11)


def test_prefix_sum_in_buckets(spark):
    df = spark.createDataFrame([(k, k * k) for k in range(500)], "k bigint, v bigint")
    got = {r.k: r.s for r in chunks.prefix_sum(df, "k", "v", "s", bucket=37).collect()}
    assert got == {k: sum(i * i for i in range(k)) for k in range(500)}


def test_budget(events):
    p = chunks.assign_levels(events.withColumn("chunk", F.lit(0)), (0, 0, 0), 86400, 3, 4)
    model = chunks.lod_model(chunks.level_points(p)).cache()
    drawn = lambda m: model.agg(F.sum(chunks.count_for(100.0 * m, 86400.0, 3))).first()[0]
    m = chunks.budget_multiplier(model, 86400.0, 3, 100.0, 500)
    assert drawn(m) <= 500 < drawn(m * 0.9)


def test_tile_size(events):
    t = chunks.tile_size(events, 50, 50_000.0, 10.0)
    assert t >= 20 and chunks.worst_tile(events, int(t)).first().worst <= 50


def test_strict_merge(events, spark, data):
    values = fx.values_subset(spark, data)
    assert columns.merge(events, values, strict=True).count() == events.count()
    with pytest.raises(columns.Mismatch):
        columns.merge(events, fx.values_bad(spark, data), strict=True)
    twice = values.unionByName(values.limit(1))
    with pytest.raises(columns.Mismatch):
        columns.merge(events, twice, strict=True)


def test_ids_beyond_float_precision(spark):
    base = 1 << 24
    cloud = spark.range(base, base + 2000).select(F.col("id").alias("point_id"))
    values = cloud.filter("point_id % 5 = 0").select("point_id", (F.col("point_id") % 7).alias("prediction"))
    for hint in ("broadcast", "merge", "shuffle_hash"):
        got = columns.merge(cloud, values.hint(hint)).collect()
        assert all(r.prediction == (r.point_id % 7 if r.point_id % 5 == 0 else None) for r in got)


def test_markers(spark):
    df = spark.createDataFrame([(1, 1.5, 3), (2, None, None)], "point_id int, f double, p int")
    marked = columns.with_markers(df, ["f"], ["p"])
    assert marked.collect()[1].p == 255 and math.isnan(marked.collect()[1].f)
    assert columns.without_markers(marked, ["f"], ["p"]).collect()[1].asDict() == {"point_id": 2, "f": None, "p": None}


def test_patch_properties(spark, data):
    old, new = fx.ann(spark, data), fx.ann_patch(spark, data)
    got = {r.point_id: (r.segment_id, r.class_id) for r in annotate.patch(old, new).collect()}
    for r in new.filter("segment_id <> 0").collect():
        assert got[r.point_id] == (r.segment_id, r.class_id)
    assert annotate.restore_segment(annotate.delete_segment(old, 2)).filter("segment_id = 2").count() == 0


def test_voxel_keeps_points(events):
    v = voxel.voxel_downsample(events, 5000)
    assert v.agg(F.sum("points")).first()[0] == events.count()
    assert voxel.voxel_downsample(events.limit(0), 10).count() == 0


def test_sampling(events):
    s = sample.stratified_sample(events, 400, 50)
    again = sample.stratified_sample(events.repartition(5), 400, 50)
    assert sorted(r.point_id for r in s.collect()) == sorted(r.point_id for r in again.collect())
    assert sample.uniform_sample(events, 10**6).count() == events.count()


def test_mesh(spark, data):
    t = fx.triangles(spark, data)
    s = mesh.sample_mesh(t, 1003, scale=1.0)
    assert s.count() == 1003
    shares = {r.submesh_id: r.share for r in mesh.allocate(t, 1003).collect()}
    assert {r.submesh_id: r["count"] for r in s.groupBy("submesh_id").count().collect()} == shares
    assert s.filter("qx < 0 or qy < 0 or qz <> 0").count() == 0


def test_metrics_of_perfect_predictions(spark):
    p = spark.createDataFrame([(k % 3, k % 3) for k in range(30)], "y int, yhat int")
    assert all(r.accuracy == r.iou == r.f1 == 1 for r in metrics.summary(metrics.confusion(p)).collect())
    text = metrics.report(metrics.confusion(p), [("a", 0.7), ("b", 0.3)], 0.25)
    assert metrics.parse_report(text)["Feature importance"] == ["a 0.7000", "b 0.3000"]
    df = spark.createDataFrame([(text,)], "report string")
    assert df.select(metrics.voxel_distance_of()).first()[0] == 0.25


def test_models(spark, data, tmp_path):
    rows = fx.forest_rows(spark, data)
    model = ml.train_forest(rows, ["f0", "f1", "absent"], cap=300, trees=5, depth=5)
    r = ml.Registry(spark, f"file://{tmp_path}/models")
    r.save("one", model, {"classes": {"0": "a"}})
    loaded, meta = r.load("one")
    assert meta["features"] == ["f0", "f1"] and r.names() == ["one"] and r.exists("one")
    a, b = (sorted((x.point_id, x.prediction) for x in ml.classify(m, rows).collect()) for m in (model, loaded))
    assert a == b
    assert ml.evaluate(model, rows).agg(F.sum("n")).first()[0] == rows.count()
    r.delete("one")
    assert not r.exists("one")
    with pytest.raises(ValueError):
        r.exists("../other")
    with pytest.raises(ValueError):
        ml.classify(model, rows.drop("f0"))


def test_splats(spark, data):
    s = splats.morton_chunks(fx.splats(spark, data), 100)
    assert s.select("row").distinct().count() == s.count() and s.groupBy("chunk").count().filter("count > 100").count() == 0
    assert splats.file_kind("a.ply", {"f_dc_0", "f_dc_1", "f_dc_2", "opacity", "scale_0", "rot_0"}) == "2dgs"
    assert splats.file_kind("a.SOG", set()) == "sog" and splats.file_kind("a.ply", {"x"}) is None
    with pytest.raises(splats.NotFinite):
        splats.refuse_not_finite(spark.createDataFrame([(1.0,), (float("nan"),)], "x double"), ["x"])
