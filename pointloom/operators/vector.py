"""Contours, simplification and measures of polygons (arrays of x, y points)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _turned(ring: Column) -> Column:
    """The ring moved on by one point."""
    return F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))


def area(ring: str) -> Column:
    """Unsigned shoelace area of a ring of structs x, y."""
    r = F.col(ring)
    cross = F.zip_with(r, _turned(r), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)) / 2


def perimeter(ring: str) -> Column:
    r = F.col(ring)
    step = F.zip_with(r, _turned(r), lambda a, b: F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"])))
    return F.aggregate(step, F.lit(0.0), lambda s, v: s + v)


def anchor(ring: str) -> Column:
    """Centroid of a ring; the middle of its box where its area is 0."""
    r = F.col(ring)
    n = _turned(r)
    cross = lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]
    total = F.aggregate(F.zip_with(r, n, cross), F.lit(0.0), lambda s, v: s + v)
    part = lambda k: F.aggregate(F.zip_with(r, n, lambda a, b: (a[k] + b[k]) * cross(a, b)), F.lit(0.0), lambda s, v: s + v)
    mid = lambda k: (F.array_min(F.transform(r, lambda p: p[k])) + F.array_max(F.transform(r, lambda p: p[k]))) / 2
    return F.struct(*[F.when(total != 0, part(k) / (3 * total)).otherwise(mid(k)).alias(k) for k in "xy"])


def _douglas_peucker(points: np.ndarray, eps: float) -> np.ndarray:
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    todo = [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d = points[b] - points[a]
        off = points[a + 1 : b] - points[a]
        n = np.hypot(*d)
        dist = np.abs(d[0] * off[:, 1] - d[1] * off[:, 0]) / n if n > 0 else np.hypot(off[:, 0], off[:, 1])
        k = int(dist.argmax())
        if dist[k] > eps:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return points[keep]


def simplify_ring(points: np.ndarray, eps: float) -> np.ndarray:
    """Douglas-Peucker on a closed ring, cut at the two points farthest apart along it; under three points the box stands in."""
    if len(points) > 3:
        far = int(((points - points[0]) ** 2).sum(axis=1).argmax())
        a = _douglas_peucker(points[: far + 1], eps)
        b = _douglas_peucker(np.vstack([points[far:], points[:1]]), eps)
        points = np.vstack([a, b[1:-1]])
    if len(points) < 3:
        (x0, y0), (x1, y1) = points.min(axis=0), points.max(axis=0)
        points = np.array([[x0, y0], [x1, y0], [x1, y1], [x0, y1]], float)
    return points


def straighten(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Edges within tolerance of horizontal or vertical are snapped, each from the vertex before it as it now stands."""
    out = points.astype(float).copy()
    for i in range(1, len(out)):
        dx, dy = np.abs(out[i] - out[i - 1])
        if dy <= tolerance and dx > dy:
            out[i, 1] = out[i - 1, 1]
        elif dx <= tolerance and dy > dx:
            out[i, 0] = out[i - 1, 0]
    return out


def min_area_rect(points: np.ndarray) -> tuple[float, float, float, float, float]:
    """Centre x, y, width, height and angle of the least rectangle: one side lies on an edge of the convex hull."""
    hull = convex_hull(points)
    best = None
    for a, b in zip(hull, np.roll(hull, -1, axis=0)):
        t = np.arctan2(*(b - a)[::-1]) if len(hull) > 1 else 0.0
        turn = np.array([[np.cos(t), np.sin(t)], [-np.sin(t), np.cos(t)]])
        p = hull @ turn.T
        lo, hi = p.min(axis=0), p.max(axis=0)
        size = float(np.prod(hi - lo))
        if best is None or size < best[0]:
            best = (size, *((lo + hi) / 2 @ turn), *(hi - lo), float(t))
    return tuple(float(v) for v in best[1:])


def _cross(a: np.ndarray, b: np.ndarray) -> float:
    return float(a[0] * b[1] - a[1] * b[0])


def convex_hull(points: np.ndarray) -> np.ndarray:
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p
    sides = []
    for order in (p, p[::-1]):
        side: list[np.ndarray] = []
        for q in order:
            while len(side) > 1 and _cross(side[-1] - side[-2], q - side[-2]) <= 0:
                side.pop()
            side.append(q)
        sides += side[:-1]
    return np.array(sides)


#: The eight neighbours clockwise from the left, as (dx, dy) with y downwards.
_AROUND = ((-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1))


def trace(cells: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """The outer border of a connected set of pixels, clockwise from its first pixel by row; straight runs keep their ends only."""
    start = min(cells, key=lambda p: (p[1], p[0]))
    ring, at, back = [start], start, 0
    first = None
    while True:
        for k in range(1, 9):
            d = (back + k) % 8
            q = (at[0] + _AROUND[d][0], at[1] + _AROUND[d][1])
            if q in cells:
                break
        else:
            return ring
        if (at, d) == first:
            break
        first = first or (at, d)
        at, back = q, (d + 5) % 8 if d % 2 else (d + 6) % 8
        ring.append(at)
    ring.pop()
    keep = [p for i, p in enumerate(ring) if (p[0] - ring[i - 1][0], p[1] - ring[i - 1][1]) != (ring[(i + 1) % len(ring)][0] - p[0], ring[(i + 1) % len(ring)][1] - p[1])]
    return keep or ring[:1]


def contours(mask: DataFrame, components: DataFrame, least: int = 1) -> DataFrame:
    """The outer ring of every 8-connected component (px, py, component): component, pixels, ring.

    A component is one task's group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ring = trace(set(zip(pdf["px"].astype(int), pdf["py"].astype(int))))
        return pd.DataFrame({"component": [pdf["component"].iloc[0]], "pixels": [len(pdf)], "ring": [[{"x": float(x), "y": float(y)} for x, y in ring]]})

    size = components.groupBy("component").count().where(F.col("count") >= least).select("component")
    return mask.join(components, ["px", "py"]).join(size, "component").groupBy("component").applyInPandas(run, "component long, pixels long, ring array<struct<x:double,y:double>>")


def mask_components(mask: DataFrame) -> DataFrame:
    """px, py, component: 8-connected components of a mask, numbered by their least pixel."""
    from pointloom.operators.components import components
    from pointloom.operators.raster import neighbourhood

    node = mask.select("px", "py").distinct().withColumn("node", F.shiftleft(F.col("px").cast("long"), 32) + F.col("py").cast("long"))
    near = neighbourhood(node, 1).withColumnRenamed("node", "v")
    edges = node.join(near, ["px", "py"]).where("node <> v").select(F.col("node").alias("u"), "v")
    comp = components(edges)
    return node.join(comp, "node", "left").select("px", "py", F.coalesce("component", "node").alias("component"))


def simplified(df: DataFrame, ring: str, eps: float, tolerance: float = 0.0) -> DataFrame:
    """Rings simplified, and straightened where tolerance is positive."""

    def run(rings: pd.Series) -> pd.Series:
        out = []
        for r in rings:
            p = simplify_ring(np.array([(q["x"], q["y"]) for q in r], float), eps)
            p = straighten(p, tolerance) if tolerance > 0 else p
            out.append([{"x": float(x), "y": float(y)} for x, y in p])
        return pd.Series(out)

    return df.withColumn(ring, F.pandas_udf(run, "array<struct<x:double,y:double>>")(ring))


def vectorise(raster: DataFrame, label: str, least: int = 10, eps: float = 1.0) -> DataFrame:
    """Objects of every label but 0: label, component, pixels, simplified ring, area_px, anchor."""
    out = None
    for value in sorted(r[0] for r in raster.select(label).distinct().where(F.col(label) > 0).collect()):  # one entry a label
        mask = raster.where(F.col(label) == value).select("px", "py")
        rings = simplified(contours(mask, mask_components(mask), least), "ring", eps)
        rings = rings.select(F.lit(value).alias(label), "component", "pixels", "ring", area("ring").alias("area_px"), anchor("ring").alias("anchor"))
        out = rings if out is None else out.unionByName(rings)
    return out
