"""File readers and sinks: byte round trips."""

import struct

import numpy as np
import pytest

from pointloom.sources import files, sinks


def cloud(n=25, seed=0):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, 3)).astype(np.float32), rng.integers(0, 256, (n, 3)), rng.integers(0, 13, n)


def ply_bytes(order, xyz, rgb, label, faces=()):
    head = f"ply\nformat binary_{'little' if order == '<' else 'big'}_endian 1.0\ncomment x\nelement vertex {len(xyz)}\n"
    head += "".join(f"property float {c}\n" for c in "xyz") + "".join(f"property uchar {c}\n" for c in ("red", "green", "blue", "class"))
    if faces:
        head += f"element face {len(faces)}\nproperty list uchar int vertex_indices\n"
    body = b"".join(struct.pack(order + "3f4B", *p, *c, k) for p, c, k in zip(xyz.tolist(), rgb.tolist(), label.tolist()))
    return (head + "end_header\n").encode() + body + b"".join(struct.pack(f"{order}B{len(f)}i", len(f), *f) for f in faces)


@pytest.mark.parametrize("order", ["<", ">"])
def test_ply_both_byte_orders_with_faces(spark, tmp_path, order):
    xyz, rgb, label = cloud()
    (tmp_path / "a.ply").write_bytes(ply_bytes(order, xyz, rgb, label, [(0, 1, 2), (2, 3, 4, 5)]))
    rows = files.labelled_points(files.read_ply(spark, str(tmp_path))).orderBy("ord").toPandas()
    assert np.array_equal(rows[["x", "y", "z"]].to_numpy(np.float32), xyz)
    assert np.array_equal(rows[["r", "g", "b"]].to_numpy(), rgb) and np.array_equal(rows["class"].to_numpy(), label)
    faces = files.read_ply(spark, str(tmp_path), "face").orderBy("ord").collect()
    assert [list(f.vertex_indices) for f in faces] == [[0, 1, 2], [2, 3, 4, 5]]


def test_ply_ascii_and_alpha_rule(spark, tmp_path):
    (tmp_path / "a.ply").write_text("ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nproperty uchar alpha\nproperty uchar cla\nend_header\n1 2 3 0 0 0 9 4\n-1 nan 3 5 0 0 9 6\n")
    ply = files.read_ply(spark, str(tmp_path))
    rows = files.labelled_points(ply).orderBy("ord").collect()
    assert [(r.r, r.g, r.b, r["class"]) for r in rows] == [(9, 9, 9, 4), (5, 0, 0, 6)]
    assert files.finite(ply).count() == 1
    (tmp_path / "b.ply").write_text("no header")
    with pytest.raises(Exception):
        files.read_ply(spark, str(tmp_path / "b.ply")).count()


def test_ply_sink_round_trip(spark, tmp_path):
    xyz, rgb, label = cloud(40)
    df = spark.createDataFrame([(f"t{i % 3}", i, *map(float, p), *map(int, c)) for i, (p, c) in enumerate(zip(xyz, rgb))], "tile string, ord long, x float, y float, z float, red int, green int, blue int")
    sinks.save_files(sinks.ply_files(df, "tile", "ord", ["x", "y", "z", "red", "green", "blue"], uchar=("red", "green", "blue")), str(tmp_path / "out"))
    back = files.read_ply(spark, str(tmp_path / "out"))
    assert back.count() == 40 and sorted(p.name for p in (tmp_path / "out").iterdir()) == ["t0.ply", "t1.ply", "t2.ply"]
    key = lambda d: sorted(map(tuple, d.select("x", "y", "z", "red", "green", "blue").collect()))
    assert key(back) == key(df)


def test_scans_and_labels(spark, tmp_path):
    xyz, _, label = cloud()
    four = np.concatenate([xyz, np.ones((25, 1), np.float32)], axis=1)
    (tmp_path / "v").mkdir(), (tmp_path / "l").mkdir()
    (tmp_path / "v/000.bin").write_bytes(four.tobytes())
    (tmp_path / "v/001.bin").write_bytes(four[:3].tobytes())
    (tmp_path / "l/000.label").write_bytes((label.astype("<u4") | (7 << 16)).tobytes())
    rows = files.read_labelled_scans(spark, str(tmp_path / "v"), str(tmp_path / "l")).orderBy("scene", "ord").toPandas()
    assert rows["segment"].tolist() == label.tolist() + [-1] * 3 and set(rows["instance"]) == {7, -1}
    out = sinks.label_files(spark.createDataFrame(rows[["scene", "ord", "segment"]]).where("segment >= 0"), "scene", "ord", "segment", {3: 30}).collect()
    assert np.frombuffer(bytes(out[0].content), "<u4").tolist() == [30 if k == 3 else k for k in label.tolist()]


def test_scenes_npz_text_and_pairs(spark, tmp_path):
    xyz, rgb, label = cloud()
    df = spark.createDataFrame([("s1", i, *map(float, p), int(k)) for i, (p, k) in enumerate(zip(xyz, label))], "scene string, ord long, x double, y double, z double, segment int")
    sinks.save_files(sinks.scene_files(df, "scene", "ord", {"coord": ["x", "y", "z"], "segment": ["segment"]}), str(tmp_path / "scenes"))
    rows = files.read_scenes(spark, str(tmp_path / "scenes")).orderBy("ord").toPandas()
    assert np.allclose(rows[["x", "y", "z"]], xyz) and rows["segment"].tolist() == label.tolist() and set(rows["instance"]) == {-1}
    np.savez(tmp_path / "a.npz", coord=xyz)
    assert files.read_npz(spark, str(tmp_path / "a.npz")).where("r is null").count() == 25
    (tmp_path / "p.txt").write_text("1 2 3\n\n 4  5 6\n")
    assert [tuple(r)[1:] for r in files.read_text_points(spark, str(tmp_path / "p.txt"), ["x", "y", "z"]).orderBy("x").collect()] == [(1.0, 2.0, 3.0), (4.0, 5.0, 6.0)]
    (tmp_path / "overlap.txt").write_text("a b 0.5\na c 0.1\n")
    assert [tuple(r) for r in files.read_overlap_pairs(spark, str(tmp_path / "overlap.txt")).collect()] == [("a", "b", 0.5)]
    with pytest.raises(ValueError):
        files.read_points(spark, "x.glb")


def test_run_length_text(spark):
    runs = spark.createDataFrame([("m", 5, 2), ("m", 1, 3)], "mask string, start long, length long")
    assert sinks.run_length_text(runs, ["mask"]).collect()[0].rle == "1 3 5 2"
