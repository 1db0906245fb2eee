"""Skeletons, end points, directions, rays and gap stitching against plain loops on random and drawn masks."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.operators import roads

RING = [(0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1)]
READING = [(-1, -1), (0, -1), (1, -1), (-1, 0), (1, 0), (-1, 1), (0, 1), (1, 1)]


def thinned(mask):
    mask = set(mask)
    while True:
        gone = 0
        for second in (False, True):
            out = set()
            for x, y in mask:
                p = [(x + dx, y + dy) in mask for dx, dy in RING]
                n, e, s, w = p[0], p[2], p[4], p[6]
                turns = sum(not p[i] and p[(i + 1) % 8] for i in range(8))
                free = not (n and e and w) and not (n and s and w) if second else not (n and e and s) and not (e and s and w)
                if 2 <= sum(p) <= 6 and turns == 1 and free:
                    out.add((x, y))
            mask -= out
            gone += len(out)
        if not gone:
            return mask


def ends_of(skel):
    return {(x, y) for x, y in skel if sum((x + dx, y + dy) in skel for dx, dy in READING) == 1}


def direction(skel, start, steps):
    prev, at = None, start
    for _ in range(steps):
        near = [(at[0] + dx, at[1] + dy) for dx, dy in READING]
        near = [p for p in near if p in skel and p != prev]
        if not near:
            break
        prev, at = at, near[0]
    dx, dy = at[0] - start[0], at[1] - start[1]
    return None if dx == dy == 0 else (dx / math.hypot(dx, dy), dy / math.hypot(dx, dy))


def ray(mask, start, d, most):
    for k in range(1, most + 1):
        p = (round(start[0] + d[0] * k), round(start[1] + d[1] * k))
        if p in mask:
            return (*p, float(k))
    return None


def width(mask, p, widest=40):
    reach = widest // 2 + 1
    best = min(0.955 * abs(abs(a) - abs(b)) + 1.3693 * min(abs(a), abs(b)) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1) if (p[0] + a, p[1] + b) not in mask)
    return min(widest, max(1, math.floor(2 * best)))


def masks():
    rng = random.Random(3)
    noise = {(x, y) for x in range(30) for y in range(20) if rng.random() < 0.6}
    blocks = {(x, y) for cx, cy, w, h in [(rng.randint(0, 40), rng.randint(0, 40), rng.randint(2, 14), rng.randint(2, 5)) for _ in range(14)] for x in range(cx, cx + w) for y in range(cy, cy + h)}
    return [noise, blocks, {(0, 0)}, {(5, 5), (6, 5), (-3, -4)}, set()]


def table(spark, mask, repeats=1):
    return spark.createDataFrame(sorted(mask) * repeats, "px long, py long")


@pytest.mark.parametrize("which", range(5))
def test_skeleton_ends_and_directions(spark, which):
    mask = masks()[which]
    want = thinned(mask)
    skel = roads.skeleton(table(spark, mask, 2))
    assert sorted(map(tuple, skel.collect())) == sorted(want)
    ends = roads.end_points(skel)
    assert {tuple(r) for r in ends.collect()} == ends_of(want)
    got = {(r.px, r.py): (r.dx, r.dy) for r in roads.directions(skel, ends, 4).collect()}
    expected = {p: d for p in ends_of(want) if (d := direction(want, p, 4))}
    assert got.keys() == expected.keys() and all(got[p] == pytest.approx(expected[p], abs=1e-12) for p in got)


def test_rays_and_widths(spark):
    mask = masks()[1]
    rng = random.Random(8)
    rays = []
    for x, y in {(rng.randint(-5, 50), rng.randint(-5, 50)) for _ in range(40)}:
        angle = rng.random() * 2 * math.pi
        rays.append((x, y, math.cos(angle), math.sin(angle)))
    got = {(r.px, r.py): (r.hx, r.hy, r.dist) for r in roads.cast_rays(table(spark, mask), spark.createDataFrame(rays, "px long, py long, dx double, dy double"), 25).collect()}
    assert got == {(x, y): h for x, y, dx, dy in rays if (h := ray(mask, (x, y), (dx, dy), 25))}
    some = sorted(mask)[::7]
    assert {(r.px, r.py): r.width for r in roads.widths(table(spark, mask), table(spark, some)).collect()} == {p: width(mask, p) for p in some}


def test_pieces(spark):
    mask = masks()[1]
    left, want = set(mask), {}
    while left:
        first = min(left)
        todo = [first]
        left.discard(first)
        while todo:
            x, y = todo.pop()
            want[x, y] = first
            for dx, dy in READING:
                if (x + dx, y + dy) in left:
                    left.discard((x + dx, y + dy))
                    todo.append((x + dx, y + dy))
    assert {(r.px, r.py): tuple(r.piece) for r in roads.pieces(table(spark, mask)).collect()} == want


def test_lines_hang_together(spark):
    got = {tuple(r) for r in roads.lines(spark.createDataFrame([(0, 0, 9, 4, 1)], "px long, py long, hx long, hy long, width int")).collect()}
    assert {(0, 0), (9, 4)} <= got and all(any((x + 1, y + d) in got for d in (-1, 0, 1)) for x, y in got if x < 9)


@pytest.mark.parametrize("outward", [False, True])
def test_gaps_lead_to_other_pieces_only(spark, outward):
    mask = masks()[1] | {(x + 60, y) for x, y in masks()[0]}
    m = table(spark, mask)
    skel = thinned(mask)
    piece = {(r.px, r.py): tuple(r.piece) for r in roads.pieces(m).collect()}
    want = set()
    for p in ends_of(skel):
        d = direction(skel, p, 6)
        d = (-d[0], -d[1]) if d and outward else d
        hit = d and ray({q for q in mask if piece[q] != piece[p]} if outward else mask, p, d, 25)
        if hit and hit[2] >= 3 and piece[hit[0], hit[1]] != piece[p]:
            want.add((*p, *hit, width(mask, p)))
    got = {(r.px, r.py, r.hx, r.hy, r.dist, r.width) for r in roads.gaps(m, roads.pieces(m), outward=outward).collect()}
    assert got == want and (want or not outward)


def test_stitched(spark):
    bars = {(x, y) for a, b in ((0, 20), (28, 45), (52, 70)) for x in range(a, b) for y in range(3)} | {(x, 40) for x in range(5)}
    out = roads.stitched(table(spark, bars), target=2, outward=True)
    got = {tuple(r) for r in out.collect()}
    assert bars <= got and {(x, 1) for x in range(70)} <= got  # the gaps are closed, the far road is left alone
    assert roads.pieces(out).select("piece").distinct().count() == 2
    assert {tuple(r) for r in roads.stitched(table(spark, bars), target=4).collect()} == bars
    assert roads.stitched(table(spark, set())).count() == 0


def test_tiles_leave_no_trace(spark):
    """A mask laid over the corner of four tiles gives what it gives inside one, in few shuffles and without a row for every pixel around a place."""
    rng = np.random.default_rng(3)
    dots = np.argwhere(rng.random((44, 40)) < 0.55).tolist() + [[x, 60] for x in range(8, 40)] + [[20, y] for y in range(64, 90)]
    got = {}
    for ox, oy in ((40, 40), (-20, 512 - 25)):
        mask = spark.createDataFrame([(x + ox, y + oy) for x, y in dots] + [(8 + ox, 60 + oy)], "px long, py long")
        back = lambda df, *cs: sorted(tuple(v - (ox if c[1] == "x" else oy) if c in ("px", "py", "hx", "hy") else v for c, v in zip(cs, r)) for r in df.select(*cs).collect())  # noqa: E731, B023
        named = roads.pieces(mask).select("px", "py", F.col("piece.px").alias("hx"), F.col("piece.py").alias("hy"))
        skel = roads.skeleton(mask)
        rays = roads.directions(skel, roads.end_points(skel))
        wide = roads.widths(mask, mask.distinct())
        found = roads.gaps(mask, roads.pieces(mask), outward=True)
        got[ox] = [back(roads.codes(mask), "px", "py", "code"), back(named, "px", "py", "hx", "hy"), back(skel, "px", "py"), back(rays, "px", "py", "dx", "dy"), back(wide, "px", "py", "width"), back(found, "px", "py", "hx", "hy", "dist", "width")]
    assert got[40] == got[-20] and all(got[40])
    for df in (wide, rays):
        assert "LeftAnti" not in (p := df._jdf.queryExecution().optimizedPlan().toString()) and "Join" not in p
