"""Neighbourhoods by lines: the stretches of balls, and queries that make no pairs."""

import numpy as np
import pytest

from pointloom.operators import gather, lines, neighbors


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("trial", range(24))
def test_stretches_are_the_ball(trial, monkeypatch):
    """Lattices, ties, distances at the limit and points without a common line; lines of many and of few places."""
    rng = np.random.default_rng(trial)
    monkeypatch.setattr(lines, "LONG", [1, 5, 64][trial % 3])
    monkeypatch.setattr(lines, "AT_ONCE", [50, 100_000][trial % 2])
    n = 300
    x, z = rng.integers(0, 4, n) / [1.0, 10.0][trial % 2], np.round(rng.integers(0, 5, n) * 0.01, 2) * 100
    y = [rng.random(n) * 6, rng.integers(0, 40, n) / 10, np.full(n, 3.0), rng.integers(0, 60, n) * 0.1][trial % 4]
    if trial % 7 == 0:
        x, z = rng.random(n) * 4, rng.random(n) * 3
    x, y, z = np.unique(np.stack([x, y, z], 1), axis=0).T.copy()
    by = lines.Lines(x, y, z)
    x, y, z = x[by.order], y[by.order], z[by.order]
    limit = [1.0, 4.0, 0.25, 6.25][trial % 4]
    got = np.zeros((len(x), len(x)), bool)
    for row, _, lo, hi in by.stretches(x, y, z, limit):
        for r, a, b in zip(np.arange(len(x))[row] if isinstance(row, slice) else row, lo, hi):
            assert not got[r, a:b].any()
            got[r, a:b] = True
    d2 = (x - x[:, None]) ** 2 + (y - y[:, None]) ** 2 + (z - z[:, None]) ** 2
    assert (got == (d2 < limit)).all()


@pytest.fixture(scope="module")
def dense(spark):
    """1,200 points of three scenes within a few lines: most pairs are neighbours."""
    rng = np.random.default_rng(4)
    n = 1200
    at = np.stack([rng.integers(0, 9, n), np.round(rng.random(n) * 30, 3), rng.integers(0, 4, n)], 1).astype(float)
    at[:40, 1] = np.nan
    rows = [(i * 7 + 3, int(s), *map(float, p)) for i, (s, p) in enumerate(zip(rng.integers(0, 3, n), at))]
    return rows, spark.createDataFrame(rows, "pid long, scene int, x double, y double, z double").repartition(5)


def test_overlap_makes_no_pairs(spark, dense, monkeypatch):
    rows, df = dense
    have = neighbors.overlap_share(df, 1.0)
    assert plan(have).count("Join") == 1  # with the clouds' sizes only
    p = np.array(rows)
    want = {}
    for a in range(3):
        for b in range(3):
            u, v = p[p[:, 1] == a][:, 2:], p[p[:, 1] == b][:, 2:]
            hit = (((u[:, None] - v) ** 2).sum(-1) < 1).any(1).sum() / len(u)
            if a != b and hit:
                want[min(a, b), max(a, b)] = max(hit, want.get((min(a, b), max(a, b)), 0))
    assert {(r.a, r.b): r.share for r in have.collect()} == pytest.approx(want)
    monkeypatch.setattr(lines.Cells, "__init__", narrow(lines.Cells.__init__))
    assert {(r.a, r.b): r.share for r in neighbors.overlap_share(df, 1.0).collect()} == pytest.approx(want)


def narrow(init):
    """Cells as narrow as the radius."""

    def run(self, points, radius, keys):
        init(self, points, radius, keys)
        self.last = {c: int(n * self.edge // radius + self.edge // radius) for c, n in self.last.items()}
        self.edge = radius

    return run


@pytest.mark.parametrize("cut", [False, True])
def test_normals_make_no_pairs(spark, dense, monkeypatch, cut):
    rows, df = dense
    if cut:
        monkeypatch.setattr(lines.Cells, "__init__", narrow(lines.Cells.__init__))
    have = gather.normals_within(df, 2.5)
    assert "Join" not in plan(have)
    got = {r.qid: np.array([r.nx, r.ny, r.nz]) for r in have.collect()}
    p = np.array(rows)
    assert set(got) == {int(i) for i in p[~np.isnan(p[:, 3]), 0]}
    for q in p[40::25]:
        near = p[(p[:, 1] == q[1]) & (((p[:, 2:] - q[2:]) ** 2).sum(1) < 6.25)][:, 2:]
        cov = np.cov(near.T, bias=True) if len(near) > 1 else np.zeros((3, 3))
        n = got[int(q[0])]
        assert n @ n == pytest.approx(1) and n @ cov @ n == pytest.approx(np.linalg.eigvalsh(cov)[0], abs=1e-9)


@pytest.mark.parametrize("cut", [False, True])
def test_clusters_make_no_edges(spark, dense, monkeypatch, cut):
    from pointloom.operators import graph

    rows, df = dense
    if cut:
        monkeypatch.setattr(lines.Cells, "__init__", narrow(lines.Cells.__init__))
    monkeypatch.setattr(neighbors, "radius_edges", None)
    p = np.array(rows)
    for radius, least in ((0.12, 2), (1.01, 1), (0.5, 3)):
        root = {int(i): int(i) for i in p[:, 0]}

        def top(i):
            while root[i] != i:
                i = root[i]
            return i

        for s in range(3):
            q = p[p[:, 1] == s]
            d2 = ((q[:, None, 2:] - q[:, 2:]) ** 2).sum(-1)
            for a, b in zip(*np.nonzero(d2 < radius * radius)):
                u, v = sorted((top(int(q[a, 0])), top(int(q[b, 0]))))
                root[v] = u
        members = {}
        for i in root:
            members.setdefault(top(i), []).append(i)
        number = {c: k for k, c in enumerate(sorted(c for c, m in members.items() if len(m) >= least))}
        want = sorted((i, number[c], len(m)) for c, m in members.items() if c in number for i in m)
        got = graph.clusters_within(df.withColumn("label", df.scene), radius, ["scene", "label"], least)
        assert sorted((r.pid, r.cluster, r.size) for r in got.collect()) == want
