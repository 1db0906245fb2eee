"""Steps whose work must not grow with the pairs of copies, with one scene or with one class."""

from collections import Counter

import numpy as np
import pytest

from pointloom.operators import gather, geometry, graph, labels, metrics, neighbors, sets, tiles
from pointloom.operators import common
from pointloom.operators.common import numbered


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def copies(spark):
    """40 places in two scenes, 30 points at each."""
    rng = np.random.default_rng(3)
    at = rng.integers(0, 6, (40, 3)).astype(float)
    rows = [(30 * i + j, i % 2, *map(float, at[i]), float(i), (30 * i + j) % 3) for i in range(40) for j in range(30)]
    return spark.createDataFrame(rows, "pid long, scene int, x double, y double, z double, v double, segment int").repartition(3), rows


def test_knn_of_copies(copies):
    df, rows = copies
    places = df.select("scene", "x", "y", "z").distinct().count()
    assert neighbors.nearest_of_places(df, df, 3, 2.0).count() == 3 * places  # once a place, not once a copy
    want = {}
    for q in rows:
        near = sorted((sum((p[i] - q[i]) ** 2 for i in (2, 3, 4)), p[0]) for p in rows if p[1] == q[1])
        want[q[0]] = [pid for _, pid in near[:40]]
    got = {}
    for r in sorted(neighbors.knn(df, df, 40, 2.0).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.qid, []).append(r.pid)
    assert got == want
    one = {r.qid: r.pid for r in neighbors.nearest_within(df, df.where("pid % 2 = 1"), 1.5).collect()}
    assert one == {q[0]: min((d, p[0]) for p in rows if p[1] == q[1] and p[0] % 2 == 1 and (d := sum((p[i] - q[i]) ** 2 for i in (2, 3, 4))) < 2.25)[1] for q in rows}


@pytest.mark.parametrize("batch", ["scene", None])
def test_ball_query_of_copies(copies, monkeypatch, batch):
    """Ids are read off where a place finds them: what is shuffled after is k rows a place at most, not the pairs of copies."""
    df, rows = copies
    seen = []
    asked = neighbors._asked
    monkeypatch.setattr(neighbors, "_asked", lambda queries, near, *a, **b: (seen.append(near.count()), asked(queries, near, *a, **b))[1])
    monkeypatch.setattr(neighbors, "AT_ONCE", 7)
    odd = df.sparkSession.createDataFrame([(5000, 0, None, 0.0, 0.0), (5001, None, 0.0, 0.0, 0.0), (5002, 0, float("nan"), 0.0, 0.0)], "pid long, scene int, x double, y double, z double")
    if batch is None:
        odd = odd.where("scene is not null")
    every = df.select(*odd.columns).unionByName(odd)
    got = {(r.qid, r.pid, r.slot, r.d2) for r in neighbors.ball_query(every.where("pid % 2 = 0"), every, 3.0, 4, 1.5, batch).collect()}
    want = set()
    for q in rows[::2]:
        found = sorted((p[0], d2) for p in rows if batch is None or p[1] == q[1] if (d2 := sum((p[i] - q[i]) ** 2 for i in (2, 3, 4))) < 9 and (d2 == 0 or d2 >= 2.25))
        first = {}
        for rn, (pid, d2) in enumerate(found):
            first.setdefault(rn if len(found) <= 4 else rn * 4 // len(found), (pid, d2))
        want |= {(q[0], pid, slot, d2) for slot, (pid, d2) in first.items()}
    assert got == want and len(got) == 4 * len(rows[::2])
    assert seen and seen[0] <= 4 * df.select("scene", "x", "y", "z").distinct().count()


def test_distance_quantiles(spark):
    d = np.random.default_rng(1).integers(0, 50, 501) / 8
    got = neighbors.distance_stats(spark.createDataFrame([(1, float(x * x)) for x in d], "rank int, d2 double")).first()
    want = [len(d), d.min(), d.max(), d.mean(), *np.quantile(d, [0.5, 0.95, 0.99])]
    assert list(got) == pytest.approx(want)
    assert list(neighbors.distance_stats(spark.createDataFrame([], "rank int, d2 double")).first()) == [0] + [None] * 6


def test_pairs_carry_their_columns(copies):
    df, rows = copies
    for pairs in (neighbors.radius_edges(df, 1.5, same="segment", kept=["v"]), neighbors.differences(df, df, 1.5, ["x", "v"])):
        assert plan(pairs).count("Join ") == 1  # no join of the pairs by point
    got = {(r.u, r.v, r.v_u, r.v_v) for r in neighbors.radius_edges(df, 1.5, same="segment", kept=["v"]).collect()}
    d2 = lambda a, b: sum((a[i] - b[i]) ** 2 for i in (2, 3, 4))
    assert got == {(a[0], b[0], a[5], b[5]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and a[6] == b[6] and d2(a, b) < 2.25}


@pytest.mark.parametrize("batch", ["scene", None])
def test_pairs_are_found_once_for_two_places(copies, monkeypatch, batch):
    """What is copied to cells is a row a place: every pair comes out, of ids that are null too, and no point is copied by itself."""
    df, rows = copies
    odd = [(None, 0, 1.0, 1.0, 1.0, 0.0, 1), (None, 0, 1.0, 1.0, 1.0, 0.0, 1), (5000, 0, None, 1.0, 1.0, 0.0, 1), (5001, 0, float("nan"), 1.0, 1.0, 0.0, 1), (5002, None, 1.0, 1.0, 1.0, 0.0, 1)]
    every = df.unionByName(df.sparkSession.createDataFrame(odd, df.schema))
    rows = rows + odd
    place = lambda r: (r[1] if batch else 0, *r[2:5])
    seen, touched = [], neighbors._touched
    monkeypatch.setattr(neighbors, "_touched", lambda df, radius: (seen.append(df.count()), touched(df, radius))[1])
    d2 = lambda a, b: sum((a[i] - b[i]) ** 2 for i in (2, 3, 4)) if None not in (*a[2:5], *b[2:5]) else 99.0
    meet = lambda a, b: (batch is None or a[1] == b[1] is not None) and d2(a, b) < 2.25
    few = every.where("pid % 2 = 0")
    for q, copied in ((every, "queries"), (few, "queries"), (few, "points")):
        asked = rows if q is every else [r for r in rows if r[0] is not None and r[0] % 2 == 0]
        got = Counter((r.qid, r.pid, r.d2) for r in neighbors.within(q, every, 1.5, batch, copied=copied).collect())
        assert got == Counter((a[0], b[0], d2(a, b)) for a in asked for b in rows if meet(a, b))
        got = Counter(map(tuple, neighbors.differences(q, every, 1.5, ["x", "v"], batch).collect()))
        assert got == Counter((a[0], b[0], a[2] - b[2], a[5] - b[5]) for a in asked for b in rows if meet(a, b))
    want = {(a[0], b[0], a[1] if batch else None, a[6], b[6]) for a in rows for b in rows if a[0] is not None and b[0] is not None and a[0] < b[0] and meet(a, b)}
    for copies_too in (True, False):
        got = neighbors.radius_edges(every, 1.5, batch, kept=["segment"], copies=copies_too).collect()
        assert len(got) == len(want) and {(r.u, r.v, r.scene if batch else None, r.segment_u, r.segment_v) for r in got} == want
    assert max(seen[:-2]) < len({(place(r), r[5]) for r in rows}) + len(odd) and seen[-2] <= 3 * 40 + len(odd) and seen[-1] == len(rows)


def test_overlap_of_copies(copies):
    df, rows = copies
    near = lambda a: any(a[1] != b[1] and sum((a[i] - b[i]) ** 2 for i in (2, 3, 4)) < 2.25 for b in rows)
    got = neighbors.overlap_share(df, 1.5).collect()
    assert [(r.a, r.b, pytest.approx(r.share)) for r in got] == [(0, 1, max(sum(near(r) for r in rows if r[1] == s) / 600 for s in (0, 1)))]


def test_one_key_is_no_single_task(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 4, 4000) > 0
    df = spark.createDataFrame([(1, i + 1, int(b), float(e)) for i, (b, e) in enumerate(zip(x, rng.random(4000)))], "k int, i long, mask int, err double").repartition(4)
    with_parts = numbered(df, ["k"], ["i"], "n")
    assert "windowspecdefinition(k#" in plan(with_parts) and plan(with_parts).count("_part#") > 2  # a window is a range of a key
    assert with_parts.where("n <> i - 1").count() == 0
    want, start = set(), None
    for i, b in enumerate([*x, False], 1):
        if b and start is None:
            start = i
        elif not b and start is not None:
            want.add((1, start, i - start))
            start = None
    assert {tuple(r) for r in labels.runs(df, ["k"], "i", "mask").collect()} == want
    hit = x[order := np.argsort(-np.array([r.err for r in df.orderBy("i").collect()]))].astype(int)
    err = -np.sort(-np.array([r.err for r in df.collect()]))
    jaccard = 1 - (hit.sum() - hit.cumsum()) / (hit.sum() + (1 - hit).cumsum())
    assert len(order) == 4000 and metrics.lovasz(df, ["k"], "err", "mask", "i").first()["loss"] == pytest.approx(err @ np.diff(jaccard, prepend=0))


def test_statistics_of_few_scenes_are_broadcast(copies):
    df, _ = copies
    for out in (geometry.normalize_coord(df), tiles.scene_tiles(df, 3, 1), sets.mix_pairs(df, "scene", "segment")):
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()  # else a scene is one task


def test_clusters_and_normals_of_copies(spark, copies):
    df, rows = copies
    odd = spark.createDataFrame([(5000, 0, None, 1.0, 1.0, 0.0, 1), (5001, 0, None, 1.0, 1.0, 0.0, 1), (5002, 0, float("nan"), 1.0, 1.0, 0.0, 1), (5003, 0, float("nan"), 1.0, 1.0, 0.0, 1)], df.schema)
    df = df.unionByName(odd)
    for least in (1, 2):
        want = graph.clusters(df, neighbors.radius_edges(df, 1.5, same="segment"), least)
        got = graph.clusters_within(df, 1.5, ["scene", "segment"], least)
        assert sorted(map(tuple, got.select("pid", "cluster", "size").collect())) == sorted(map(tuple, want.select("pid", "cluster", "size").collect()))
    df = df.where("pid < 5000")
    got = {r.qid: np.array([r.nx, r.ny, r.nz]) for r in gather.normals_within(df, 3.0).collect()}
    assert len(got) == len(rows)
    for q in rows[::60]:
        near = np.array([p[2:5] for p in rows if p[1] == q[1] and sum((p[i] - q[i]) ** 2 for i in (2, 3, 4)) < 9])
        cov = np.cov(near.T, bias=True)
        assert got[q[0]] @ cov @ got[q[0]] == pytest.approx(np.linalg.eigvalsh(cov)[0], abs=1e-9)
    joined = plan(gather.normals_within(df, 3.0))
    assert "Join" in joined and joined.count("Join ") == 1  # places back to points; the pairs are summed before


def test_cosine_by_blocks(spark):
    v = np.random.default_rng(2).integers(-2, 3, (700, 4)).astype(float)
    v[(v == 0).all(1)] = 1.0
    df = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(v)], "vec_id long, embedding array<float>").repartition(3)
    got = neighbors.cosine_top(df, df.where("vec_id % 7 = 0"), 5)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()  # no row for every pair
    u = v / np.linalg.norm(v, axis=1)[:, None]
    want = {(q, r + 1): i for q in range(0, 700, 7) for r, (_, i) in enumerate(sorted((-round(float(u[q] @ u[i]), 6), i) for i in range(700) if i != q)[:5])}
    assert {(r.qid, r["rank"]): r.vec_id for r in got.collect()} == want


def test_farthest_points_of_copies(copies, monkeypatch):
    df, rows = copies
    kept, store = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df: kept.append(store(df)) or kept[-1])
    got = graph.farthest_points(df, 6)
    assert kept[0].count() == len({r[1:5] for r in rows})  # a place once, read in every step
    for scene in (0, 1):
        left = {r[0]: (float("inf"), r[2:5]) for r in rows if r[1] == scene}
        want = []
        for _ in range(6):
            pid = min(left, key=lambda i: (-left[i][0], i))
            want.append(pid)
            at = left[pid][1]
            left = {i: (d, p) for i, (o, p) in left.items() if (d := min(o, sum((a - b) ** 2 for a, b in zip(p, at)))) > 0}
        assert [r.pid for r in got.where(f"scene = {scene}").orderBy("step").collect()] == want


def test_numbering_takes_no_window_over_the_rows(spark, monkeypatch):
    """The partitions follow the rows, and places are right across them."""
    monkeypatch.setattr(common, "RANGE_ROWS", 40)
    parts, ranged = [], common._in_ranges
    monkeypatch.setattr(common, "_in_ranges", lambda df, order, n=None: (parts.append(n), ranged(df, order, n))[1])
    rows = [(i % 2, (i * 7919) % 1000) for i in range(900)] + [(2, 5)]
    out = numbered(spark.createDataFrame(rows, "k int, v int"), ["k"], ["v"], "i")
    assert "Window" not in plan(out) and parts == [23]
    want = {(k, v, i) for key in range(3) for i, (k, v) in enumerate(sorted(r for r in rows if r[0] == key))}
    assert {(r.k, r.v, r.i) for r in out.collect()} == want
