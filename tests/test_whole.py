"""The queries over every point, by brute force: on a small lineitem table, with the operators' slices gone."""

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest

from pointloom.plans import metric_queries, more_queries  # noqa: F401
from pointloom.plans.point_queries import QUERIES
from pointloom.sources.tables import points


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """1500 lines with different pids, and the points they make."""
    sf = str(tmp_path_factory.mktemp("small"))
    t = pq.read_table("/root/testdata/sf0.001/lineitem.parquet").to_pandas()
    t = t.drop_duplicates(["l_orderkey", "l_linenumber"]).iloc[:1500]
    t.to_parquet(f"{sf}/lineitem.parquet", index=False)
    p = points(spark, sf).toPandas().sort_values("pid").reset_index(drop=True)
    assert p["pid"].is_unique and len(p) > 1000
    return sf, p


def pairs_of(p: pd.DataFrame) -> pd.DataFrame:
    """All pairs of points of a scene: qid, pid, d2."""
    out = []
    for _, s in p.groupby("scene"):
        x, y, z, ids = (s[c].to_numpy() for c in ("x", "y", "z", "pid"))
        d2 = (x[:, None] - x) ** 2 + (y[:, None] - y) ** 2 + (z[:, None] - z) ** 2
        q, r = np.indices(d2.shape)
        out.append(pd.DataFrame({"qid": ids[q.ravel()], "pid": ids[r.ravel()], "d2": d2.ravel()}))
    return pd.concat(out)


@pytest.fixture(scope="module")
def pairs(small):
    return pairs_of(small[1])


def rows(df, *columns):
    return sorted(df[list(columns)].itertuples(index=False, name=None))


def got(spark, small, name):
    return QUERIES[name](spark, small[0]).toPandas()


def nearest(pairs, k):
    near = pairs.sort_values(["qid", "d2", "pid"])
    near = near.assign(rank=near.groupby("qid").cumcount())
    return near[near["rank"] < k]


def test_knn(spark, small, pairs):
    assert rows(got(spark, small, "knn_k3_all"), "qid", "pid", "rank") == rows(nearest(pairs, 3), "qid", "pid", "rank")


def test_idw_and_distances(spark, small, pairs):
    n = nearest(pairs, 3).merge(small[1][["pid", "strength"]], on="pid")
    n["w"] = 1 / (np.sqrt(n["d2"]) + 1e-8)
    want = (n["w"] * n["strength"]).groupby(n["qid"]).sum() / n.groupby("qid")["w"].sum()
    have = got(spark, small, "idw_interpolate_all").set_index("qid")["strength"]
    assert len(have) == len(want) and np.allclose(have.loc[want.index], want, atol=2e-6)
    d = np.sqrt(nearest(pairs, 2).query("rank == 1")["d2"])
    r = got(spark, small, "nn_stats_all").iloc[0]
    assert r["n"] == len(d) and np.allclose([r["least"], r["most"], r["mean"], r["p95"]], [d.min(), d.max(), d.mean(), d.quantile(0.95)], atol=2e-6)


def test_radius_ball_and_difference(spark, small, pairs):
    assert rows(got(spark, small, "radius_join_all"), "qid", "pid") == rows(pairs[pairs["d2"] < 6.25], "qid", "pid")
    f = pairs[(pairs["d2"] < 9) & ((pairs["d2"] <= 1e-5) | (pairs["d2"] >= 1))].sort_values(["qid", "pid"])
    rn, n = f.groupby("qid").cumcount(), f.groupby("qid")["pid"].transform("size")
    f = f.assign(slot=np.where(n <= 4, rn, rn * 4 // n)).drop_duplicates(["qid", "slot"])
    assert rows(got(spark, small, "ball_query_all"), "qid", "pid", "slot") == rows(f, "qid", "pid", "slot")
    assert rows(got(spark, small, "neighbour_difference_all"), "qid", "pid") == rows(pairs[pairs["d2"] < 4], "qid", "pid")


def test_transfer_and_overlap(spark, small, pairs):
    p = small[1]
    near = pairs[(pairs["qid"] % 5 == 0) & (pairs["pid"] % 5 != 0) & (pairs["d2"] < 4)].sort_values(["qid", "d2", "pid"]).drop_duplicates("qid")
    want = dict(zip(near["qid"], near["pid"].map(p.set_index("pid")["segment"])))
    have = got(spark, small, "nearest_transfer_all")
    assert sorted(have["qid"]) == sorted(p["pid"][p["pid"] % 5 == 0])
    assert {q: s for q, s in zip(have["qid"], have["segment"]) if s == s} == want
    share: dict = {}
    xyz = {k: s[["x", "y", "z"]].to_numpy() for k, s in p.groupby("scene")}
    for a, u in xyz.items():
        for b, v in xyz.items():
            if a != b:
                hit = (((u[:, None] - v) ** 2).sum(-1) < 1).any(1).mean()
                if hit:
                    share[min(a, b), max(a, b)] = max(hit, share.get((min(a, b), max(a, b)), 0))
    assert {(r.a, r.b): pytest.approx(r.share) for r in got(spark, small, "semi_overlap_all").itertuples()} == share


def test_edges_clusters_and_normals(spark, small, pairs):
    p = small[1]
    label = p.set_index("pid")["segment"]
    e = pairs[(pairs["d2"] < 4) & (pairs["qid"] < pairs["pid"])]
    e = e[e["qid"].map(label).to_numpy() == e["pid"].map(label).to_numpy()]
    edges = list(zip(e["qid"], e["pid"]))
    assert rows(got(spark, small, "radius_edges_all"), "u", "v") == sorted(edges)
    parent = {n: n for n in p["pid"]}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for u, v in edges:
        a, b = sorted((root(u), root(v)))
        parent[b] = a
    members: dict = {}
    for n in p["pid"]:
        members.setdefault(root(n), []).append(n)
    number = {c: i for i, c in enumerate(sorted(c for c, m in members.items() if len(m) >= 2))}
    assert rows(got(spark, small, "clusters_all"), "pid", "cluster", "size") == sorted((n, number[c], len(m)) for c, m in members.items() if c in number for n in m)
    have = got(spark, small, "pca_normals").set_index("qid")
    at = p.set_index("pid")[["x", "y", "z"]]
    for q, near in list(pairs[pairs["d2"] < 16].groupby("qid")["pid"])[::40]:
        xyz = at.loc[near].to_numpy()
        low = np.linalg.eigvalsh(np.cov(xyz.T, bias=True))[0] if len(xyz) > 1 else 0.0
        n = have.loc[q, ["nx", "ny", "nz"]].to_numpy(float)
        assert abs(n @ n - 1) < 1e-9 and abs(n @ (np.cov(xyz.T, bias=True) if len(xyz) > 1 else np.zeros((3, 3))) @ n - low) < 1e-7
    assert len(have) == len(p)


def test_rasters(spark, small):
    p = small[1]
    r = {k: v for k, v in p["z"].groupby([p["x"] // 2, p["y"] // 2]).max().items()}
    off = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    around = lambda k, s: [s[k[0] + a, k[1] + b] for a, b in off if (k[0] + a, k[1] + b) in s]
    values = lambda name, c: {(a, b): v for a, b, v in got(spark, small, name)[["px", "py", c]].itertuples(index=False)}
    keys = lambda name: set(got(spark, small, name)[["px", "py"]].itertuples(index=False, name=None))
    assert values("raster_mean_all", "z") == pytest.approx({k: np.mean(around(k, r)) for k in r}, abs=2e-6)
    assert values("raster_curvature_all", "curvature") == pytest.approx({k: abs(v - np.mean(around(k, r))) for k, v in r.items()}, abs=2e-6)
    cross = [(0, 1), (1, 0), (0, -1), (-1, 0)]
    assert values("raster_laplace_all", "z") == pytest.approx({k: sum(r.get((k[0] + a, k[1] + b), 0) for a, b in cross) - 4 * v for k, v in r.items()}, abs=2e-6)
    assert keys("raster_dilate_all") == {(k[0] + a, k[1] + b) for k, v in r.items() if v > 9 for a, b in off}
    m = {k for k, v in r.items() if v > 4}
    assert keys("raster_erode_all") == {k for k in m if all((k[0] + a, k[1] + b) in m for a, b in off)}
    h = {k: v for k, v in r.items() if v <= 9.5}
    xs, ys = [k[0] for k in h], [k[1] for k in h]
    holes = {(a, b) for a in np.arange(min(xs), max(xs) + 1) for b in np.arange(min(ys), max(ys) + 1)} - set(h)
    assert values("raster_complete_all", "z") == h | {k: max(around(k, h)) for k in holes if around(k, h)}
    area = (max(k[0] for k in r) - min(k[0] for k in r) + 1) * (max(k[1] for k in r) - min(k[1] for k in r) + 1)
    n = pd.Series([int(v // 1) % 3 for v in r.values()]).value_counts()
    have = got(spark, small, "fill_statistics_all").set_index("label")
    assert have["n"].to_dict() == n.to_dict() and np.allclose(have["percent"], 100 * have["n"] / area, atol=2e-6)


def test_rows_masks_and_meshes(spark, small):
    p = small[1]
    have = got(spark, small, "collect_features_all")
    assert {q: list(f) for q, f in zip(have["pid"], have["feat"])} == {t.pid: [t.x, t.y, t.z, t.strength] for t in p.itertuples()}
    have = got(spark, small, "incremental_fusion_all").set_index("line")
    assert have["n"].to_dict() == p["line"].value_counts().to_dict() and np.allclose(have["x"].sort_index(), p.groupby("line")["x"].mean(), atol=1e-8)
    want = []
    for seg, s in p.groupby("segment"):
        start = None
        for i, x in enumerate([*s["x"], 0], 1):
            if x > 25 and start is None:
                start = i
            elif x <= 25 and start is not None:
                want.append((seg, start, i - start))
                start = None
    assert rows(got(spark, small, "rle_runs_all"), "segment", "start", "length") == sorted(want)
    g = p.assign(**{f"g{c}": p[c] // 5 for c in "xyz"})
    rn, cnt = g.groupby(["gx", "gy", "gz"]).cumcount(), g.groupby(["gx", "gy", "gz"])["pid"].transform("size")
    assert rows(got(spark, small, "grid_fragments_all"), "pid", "fragment") == sorted((i, f) for i, a, c in zip(g["pid"], rn, cnt) for f in range(a, cnt.max(), c))
    wx, wy, cx, cy, ids = (v.to_numpy() for v in (p["x"] // 4, p["y"] // 4, p["x"] // 16, p["y"] // 16, p["pid"]))
    near = (wx[:, None] == wx) & (wy[:, None] == wy)
    far = (cx[:, None] == cx) & (cy[:, None] == cy) & (ids % 9 == 0) & ~near
    assert rows(got(spark, small, "window_pairs_all"), "i", "j", "kind") == sorted((ids[a], ids[b], k) for k, m in enumerate((near, far)) for a, b in zip(*np.nonzero(m)))
    xyz = p[["x", "y", "z"]].to_numpy()
    normal, colours = np.zeros_like(xyz), {i: [] for i in range(len(p))}
    for a in range(1, len(p) - 2, 2):  # ids count from 1, faces start at even ids
        normal[a : a + 3] += np.cross(xyz[a + 1] - xyz[a], xyz[a + 2] - xyz[a])
        for i in range(a, a + 3):
            colours[i].append((a + 1) % 256)
    have = got(spark, small, "vertex_normals_all").set_index("id")
    size = np.linalg.norm(normal, axis=1)
    for i in np.flatnonzero(size > 1e-9):
        assert np.allclose(have.loc[i + 1, ["nx", "ny", "nz"]].to_numpy(float), normal[i] / size[i], atol=2e-6)
    have = got(spark, small, "face_colours_all").set_index("id")["r"]
    assert have.to_dict() == pytest.approx({i + 1: np.mean(c) if c else 255.0 for i, c in colours.items()}, abs=2e-6)


def test_matrix_nms(spark, small):
    masks: dict = {}
    for t in small[1].itertuples():
        for shift, hit in ((0, t.pid % 5 < 3), (7, t.pid % 5 > 1)):
            if hit:
                masks.setdefault(t.scene * 16 + t.line + shift, set()).add(t.pid)
    iou = {(a, b): len(masks[a] & masks[b]) / len(masks[a] | masks[b]) for a in masks for b in masks if a < b and a % 2 == b % 2 and masks[a] & masks[b]}
    comp: dict = {}
    for (_, b), v in iou.items():
        comp[b] = max(v, comp.get(b, 0))
    want = {}
    for b in masks:
        d = [np.exp(-2 * v * v) / np.exp(-2 * comp.get(a, 0) ** 2) for (a, c), v in iou.items() if c == b]
        want[b] = min([1.0, *d]) / (b + 1)
    have = got(spark, small, "matrix_nms_all")
    assert dict(zip(have["mask"], have["decayed"])) == pytest.approx(want, abs=2e-6)
    assert {m // 16 for m in want} == {0, 1, 2, 3}
