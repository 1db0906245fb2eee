"""Operators without SQL: vectors, holes, curves, registry, streaming, sampling."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.functions import registry
from pointloom.operators import geometry, graph, labels, neighbors, raster, sets, vector, voxel
from pointloom.operators.common import normal, ranked, uniform
from pointloom.streaming import metrics as stream

RING = "ring array<struct<x:double,y:double>>"


def ring(*points):
    return [([{"x": float(x), "y": float(y)} for x, y in points],)]


def test_polygon_measures(spark):
    df = spark.createDataFrame(ring((0, 0), (4, 0), (4, 2), (2, 2), (2, 4), (0, 4)), RING)
    r = df.select(vector.area("ring").alias("a"), vector.perimeter("ring").alias("p"), vector.anchor("ring").alias("c")).first()
    assert (r.a, r.p) == (12.0, 16.0) and r.c.x == pytest.approx(5 / 3) and r.c.y == pytest.approx(5 / 3)
    flat = spark.createDataFrame(ring((1, 1), (3, 1)), RING).select(vector.area("ring").alias("a"), vector.anchor("ring").alias("c")).first()
    assert flat.a == 0 and (flat.c.x, flat.c.y) == (2.0, 1.0)


def test_simplify_straighten_rectangle():
    circle = np.array([(math.cos(t) * 10, math.sin(t) * 10) for t in np.linspace(0, 2 * math.pi, 80, endpoint=False)])
    few = vector.simplify_ring(circle, 0.5)
    assert 8 <= len(few) < 40
    assert len(vector.simplify_ring(np.array([(0.0, 0.0), (5.0, 0.1)]), 1.0)) == 4
    assert vector.straighten(np.array([(0, 0), (10, 0.4), (10.3, 8)]), 0.5).tolist() == [[0, 0], [10, 0], [10, 8]]
    t = 0.3
    turn = np.array([[math.cos(t), math.sin(t)], [-math.sin(t), math.cos(t)]])
    x, y, w, h, _ = vector.min_area_rect(np.array([(0, 0), (6, 0), (6, 2), (0, 2), (3, 1)], float) @ turn)
    assert sorted((round(w, 6), round(h, 6))) == [2, 6] and np.allclose([x, y], np.array([3, 1]) @ turn)


def test_contours_and_holes(spark):
    cells = [(x, y) for x in range(9) for y in range(9) if not (3 <= x <= 5 and 3 <= y <= 5)] + [(20, 20), (21, 21), (22, 20)]
    mask = spark.createDataFrame(cells, "px long, py long")
    comp = vector.mask_components(mask)
    assert comp.select("component").distinct().count() == 2
    rows = {r.pixels: [(p.x, p.y) for p in r.ring] for r in vector.contours(mask, comp).collect()}
    assert set(rows[72]) == {(0, 0), (8, 0), (8, 8), (0, 8)}
    assert set(rows[3]) >= {(20, 20), (22, 20)}
    assert raster.fill_holes(mask).count() == len(cells) + 9
    assert vector.vectorise(mask.withColumn("label", F.lit(2)), "label", least=10).first().area_px == 64.0
    assert vector.trace({(3, 3)}) == [(3, 3)]


def test_morphology(spark):
    rng = random.Random(1)
    on = {(x, y) for x in range(15) for y in range(15) if rng.random() < 0.6}
    mask = spark.createDataFrame(sorted(on), "px long, py long")
    near = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    want = {(x + a, y + b) for x, y in on for a, b in near}
    got = lambda d: {(r.px, r.py) for r in d.collect()}
    assert got(raster.dilate(mask)) == want
    assert got(raster.close(mask)) == {(x, y) for x, y in want if all((x + a, y + b) in want for a, b in near)}
    inner = {(x, y) for x, y in on if all((x + a, y + b) in on for a, b in near)}
    assert got(raster.erode(mask)) == inner and got(raster.open_(mask)) == {(x + a, y + b) for x, y in inner for a, b in near}
    boxed = {(x, y) for x, y in on if all((x + a, y + b) in on or not (0 <= x + a < 15 and 0 <= y + b < 15) for a, b in near)}
    assert got(raster.erode(mask, box=(0, 14, 0, 14))) == boxed
    assert sum(raster.gaussian(5).values()) == pytest.approx(1)


def grid(spark, n=6):
    return spark.createDataFrame([(i, 0, float(i % n), float(i // n % n), float(i // n // n), i % 3) for i in range(n**3)], "pid long, scene int, x double, y double, z double, segment int")


def test_curves(spark):
    df = grid(spark, 8)
    h = voxel.hilbert_codes(df, 1.0, depth=3).orderBy("hilbert").collect()
    assert [r.hilbert for r in h] == list(range(512))
    assert all(abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) == 1 for a, b in zip(h, h[1:]))
    code = voxel.z_code(F.col("x"), F.col("y"), F.col("z"))
    x, y, z = voxel.z_decode(F.col("code"))
    back = df.withColumn("code", code).where((x != F.col("x")) | (y != F.col("y")) | (z != F.col("z")))
    assert back.count() == 0
    size = voxel.size_for(df, 64, 0.5, 8.0)
    assert abs(voxel.count_at_sizes(df, [size]).first().voxels - 64) <= 8


def test_knn_against_brute_force(spark):
    rng = np.random.default_rng(2)
    p = rng.random((120, 3)) * [1, 1, 30]
    df = spark.createDataFrame([(i, i % 2, *map(float, v)) for i, v in enumerate(p)], "pid long, scene int, x double, y double, z double")
    got = {(r.qid, r["rank"]): r.pid for r in neighbors.knn(df, df, 4, 0.1).collect()}
    for i in range(120):
        d = ((p - p[i]) ** 2).sum(axis=1)
        d[np.arange(120) % 2 != i % 2] = np.inf
        assert [got[i, k] for k in range(4)] == np.argsort(d, kind="stable")[:4].tolist()
    few = neighbors.knn(df.limit(0), df, 3, 1.0)
    assert few.count() == 0
    assert neighbors.knn(df.where("pid < 4"), df.where("pid < 4"), 5, 0.1).groupBy("qid").count().where("count <> 2").count() == 0
    assert neighbors.random_ball(df, df, 2.0, 3, seed=1).groupBy("qid").count().where("count > 3").count() == 0


def test_farthest_points_against_loop(spark):
    rng = np.random.default_rng(5)
    p = rng.random((60, 3))
    df = spark.createDataFrame([(i, 0, *map(float, v)) for i, v in enumerate(p)], "pid long, scene int, x double, y double, z double")
    want, d = [0], np.full(60, np.inf)
    for _ in range(9):
        d = np.minimum(d, ((p - p[want[-1]]) ** 2).sum(axis=1))
        want.append(int(d.argmax()))
    assert [r.pid for r in graph.farthest_points(df, 10).orderBy("step").collect()] == want


def test_hashed_randomness(spark):
    df = grid(spark).withColumn("u", uniform("pid", seed=3)).withColumn("n", normal("pid", seed=3))
    r = df.agg(F.avg("u").alias("u"), F.avg("n").alias("n"), F.stddev("n").alias("s")).first()
    assert abs(r.u - 0.5) < 0.08 and abs(r.n) < 0.25 and abs(r.s - 1) < 0.2
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, grid(spark).repartition(7).withColumn("u", uniform("pid", seed=3)).withColumn("n", normal("pid", seed=3)).collect()))
    assert geometry.dropout(df, 0.25).count() == 162
    moved = geometry.jitter(grid(spark), 0.1, 0.15).join(grid(spark).select("pid", F.col("x").alias("ox")), "pid")
    assert moved.where(F.abs(F.col("x") - F.col("ox")) > 0.1500001).count() == 0
    assert geometry.random_flip(grid(spark)).count() == geometry.random_scale(grid(spark), 0.9, 1.1).count() == 216
    assert [r["rank"] for r in ranked(grid(spark), ["pid"]).orderBy("pid").collect()] == list(range(216))


def test_labels_and_sets(spark):
    faces = spark.createDataFrame([(0, 1, [0, 1, 2]), (1, 2, [1, 2, 3]), (2, 2, [2, 3, 1])], "face long, label int, vertices array<long>")
    assert {r.vertex: r.label for r in labels.face_votes(faces).collect()} == {0: 1, 1: 2, 2: 2, 3: 2}
    named = spark.createDataFrame([("road",), ("sky",), ("car",)], "name string")
    table = spark.createDataFrame([("road", "ground"), ("sky", "None"), ("car", None)], "name string, to string")
    assert sorted(r["class"] for r in labels.mapping_filter(named, table, "name", "to").collect()) == ["car", "ground"]
    assert labels.inverse_learning_map({0: 0, 1: 0, 7: 2, 5: 2}) == {0: 0, 2: 5}
    names = spark.createDataFrame([("city_b1_3_4_val", "a/b/c.ply")], "n string, p string")
    r = labels.path_parts(labels.tile_name(names, "n"), "p").first()
    assert (r.city, r.tile_x, r.tile_y, r.kind, r.base, r.stem, r.parent) == ("city", 3, 4, "val", "c.ply", "c", "b")
    a, b = grid(spark, 2), grid(spark, 3)
    assert sets.combine([a, b], a.where("pid = 1"), "pid").count() == 26
    assert sets.concat([a, b], loop=2).count() == 70


def test_registry(spark):
    df = grid(spark)
    f = registry.compose([{"type": "geometry.positive_shift"}, {"type": "voxel.occupancy", "size": 2.0}])
    assert f(df).count() == 27
    assert registry.merge_config({"a": {"b": 1, "c": 2}}, {"a.b": 5, "a": {"c": 3}}) == {"a": {"b": 5, "c": 3}}
    assert registry.merge_config({"a": {"b": 1}}, {"a": {"_delete_": True, "d": 4}}) == {"a": {"d": 4}}
    registry.register_sql(spark)
    assert spark.sql("select z_order(3L, 5L, 1L) as c").first().c == df.limit(1).select(voxel.z_code(F.lit(3), F.lit(5), F.lit(1)).alias("c")).first().c
    assert [r.tile for r in spark.sql("select * from covering_tiles(12.0D, 0.0D, 10.0D, 7.0D)").collect()] == [1]


def test_streams(spark, tmp_path):
    rows = [(i % 3, (i + (i % 5 == 0)) % 3, f"k{i % 2}", float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "gt int, pred int, key string, value double")
    for i in range(3):
        df.where(F.col("value") % 3 == i).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    src = stream.tile_stream(spark, str(tmp_path / "in"), df.schema)
    q = stream.confusion_stream(src, 3).writeStream.outputMode("complete").format("memory").queryName("cells").start()
    q.processAllAvailable(), q.stop()
    want = {}
    for gt, pred, _, _ in rows:
        want[gt, pred] = want.get((gt, pred), 0) + 1
    assert {(r.gt, r.pred): r.n for r in spark.table("cells").collect()} == want
    q = stream.start_miou(src, 3, "miou_now", str(tmp_path / "cp"))
    q.processAllAvailable(), q.stop()
    assert sum(r.intersection for r in spark.table("global_temp.miou_now").collect()) == sum(n for (g, p), n in want.items() if g == p)
    q = stream.running_stream(src, "key", "value").writeStream.outputMode("complete").format("memory").queryName("sofar").start()
    q.processAllAvailable(), q.stop()
    assert sum(r.n for r in spark.table("sofar").collect()) == 60


def test_knn_answers_flat_small_and_far_batches(spark):
    rng = np.random.default_rng(5)
    rows = [(i, 0, float(x), float(y), 0.0) for i, (x, y) in enumerate(rng.uniform(0, 5000, (60, 2)))]
    rows += [(100, 1, 0.0, 0.0, 0.0), (101, 1, 4000.0, -900.0, 7.0), (102, 2, 1e5, 1e5, 1e5)]
    df = spark.createDataFrame(rows, "pid long, scene int, x double, y double, z double")
    assert neighbors.cell_for(df, 3) > 1
    got = {}
    for r in neighbors.knn(df, df, 3, neighbors.cell_for(df, 3)).collect():
        got.setdefault(r.qid, {})[r["rank"]] = r.pid
    for q in rows:
        near = sorted((sum((a - b) ** 2 for a, b in zip(p[2:], q[2:])), p[0]) for p in rows if p[1] == q[1])[:3]
        assert got[q[0]] == {i: pid for i, (_, pid) in enumerate(near)}
    alone = spark.createDataFrame([(1, 9, 0.0, 0.0, 0.0)], df.schema)
    assert neighbors.knn(alone, df, 3, 1.0).count() == 0


def test_within_by_either_side(spark):
    rng = np.random.default_rng(6)
    xyz = np.round(rng.uniform(-2, 2, (150, 3)), 1)  # many distances are the radius itself
    df = spark.createDataFrame([(i, 0, *map(float, v)) for i, v in enumerate(xyz)], "pid long, scene int, x double, y double, z double")
    want = {(i, j) for i in range(150) for j in range(150) if sum((float(xyz[j][c]) - float(xyz[i][c])) ** 2 for c in range(3)) <= 0.25}
    for side in ("queries", "points"):
        assert {(r.qid, r.pid) for r in neighbors.within(df, df, 0.5, closed=True, copied=side).collect()} == want
