"""Roads in a mask of pixels (px, py): skeletons, their end points and directions, rays to other roads, stitching of gaps.

A mask is a table of its pixels; repeated pixels count once. What depends on the
pixels around one only is worked out in square tiles: a pixel is copied to the
tiles whose margin holds it, and a task holds one tile with its margin, of
bounded size. Iterations are written to the checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.operators.common import dropped, stored
from pointloom.operators.components import components
from pointloom.operators.raster import PIXEL, close

#: Offsets (dx, dy) of the eight neighbours in reading order: bit i of a code is neighbour i, and 7 - i lies opposite.
AROUND = ((-1, -1), (0, -1), (1, -1), (-1, 0), (1, 0), (-1, 1), (0, 1), (1, 1))
_SELF = 256

#: The chamfer lengths of a straight and a diagonal step.
STRAIGHT, DIAGONAL = 0.955, 1.3693


#: Pixels of a tile along each axis; it sets the size of the work units, no result.
TILE = 256
_TILE = ["_tx", "_ty"]


def _in_tiles(df: DataFrame, margin: int = 0) -> DataFrame:
    """A row for each tile that holds the pixel, or whose margin does."""
    for t, c in zip(_TILE, PIXEL):
        df = df.withColumn(t, F.explode(F.sequence(F.floor((F.col(c) - margin) / TILE), F.floor((F.col(c) + margin) / TILE))))
    return df


def _grid(key: tuple, pdf: pd.DataFrame, margin: int, values=1, kind=np.uint8) -> tuple[np.ndarray, int, int]:
    """A tile with its margin as an array by px and py, 0 where there is no pixel, and the pixel of its first element."""
    x0, y0 = int(key[0]) * TILE - margin, int(key[1]) * TILE - margin
    out = np.zeros((TILE + 2 * margin, TILE + 2 * margin), kind)
    out[pdf["px"].to_numpy() - x0, pdf["py"].to_numpy() - y0] = values
    return out, x0, y0


def _each_tile(mask: DataFrame, margin: int, run: Callable, schema: str, places: DataFrame | None = None) -> DataFrame:
    """run(key, pixels) on every tile of different pixels, or run(key, pixels, places) on every tile of the places."""
    tiles = _in_tiles(mask, margin).groupBy(*_TILE)
    return tiles.applyInPandas(run, schema) if places is None else tiles.cogroup(_in_tiles(places).groupBy(*_TILE)).applyInPandas(run, schema)


def _schema(df: DataFrame, *more: str) -> str:
    return ", ".join([*(f"`{n}` {t}" for n, t in df.dtypes), *more])


def _around(grid: np.ndarray) -> np.ndarray:
    """The code of every element: which of its eight neighbours are set; beyond the array none is."""
    wide = np.pad(grid, 1)
    n, m = grid.shape
    return sum(wide[1 + dx : 1 + dx + n, 1 + dy : 1 + dy + m].astype(np.int32) << i for i, (dx, dy) in enumerate(AROUND))


def codes(mask: DataFrame) -> DataFrame:
    """px, py, code: which of the eight neighbours of every pixel of the mask are in it."""

    def run(key, pdf):
        grid, x0, y0 = _grid(key, pdf, 1)
        x, y = np.nonzero(grid[1:-1, 1:-1])
        return pd.DataFrame({"px": x + 1 + x0, "py": y + 1 + y0, "code": _around(grid)[x + 1, y + 1]})

    here = mask.select(*PIXEL).distinct()
    return _each_tile(here, 1, run, _schema(here, "code int"))


def removable(second: bool) -> list[int]:
    """Codes of pixels that a pass of Zhang and Suen's thinning takes away."""
    out = []
    for code in range(256):
        at = {offset: code >> i & 1 for i, offset in enumerate(AROUND)}
        ring = [at[p] for p in ((0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1))]
        north, east, south, west = ring[0], ring[2], ring[4], ring[6]
        turns = sum(a < b for a, b in zip(ring, ring[1:] + ring[:1]))
        free = (north * east * west, north * south * west) if second else (north * east * south, east * south * west)
        if 2 <= sum(ring) <= 6 and turns == 1 and free == (0, 0):
            out.append(code)
    return out


def skeleton(mask: DataFrame, rounds: int = 16) -> DataFrame:
    """The mask thinned to lines of one pixel: passes in parallel over all pixels until none is taken away.

    `rounds` pairs of passes are one shuffle, with a margin as wide as they are many; then the pixels are stored and counted. An empty mask stays empty."""
    margin = 2 * rounds
    gone = [np.isin(np.arange(256), removable(second)) for second in (False, True)]

    def run(key, pdf):
        grid, x0, y0 = _grid(key, pdf, margin)
        for i in range(margin):
            grid[gone[i % 2][_around(grid)]] = 0
        x, y = np.nonzero(grid[margin:-margin, margin:-margin])
        return pd.DataFrame({"px": x + margin + x0, "py": y + margin + y0})

    now = stored(mask.select(*PIXEL).distinct())
    n = now.count()
    while True:
        unplaced = now.where(F.col("px").isNull() | F.col("py").isNull())
        new = stored(_each_tile(now, margin, run, _schema(now)).unionByName(unplaced))
        left = new.count()
        dropped(now)
        if left == n:
            return new
        now, n = new, left


def end_points(skel: DataFrame) -> DataFrame:
    """Pixels of a skeleton with exactly one neighbour."""
    return codes(skel).where(F.bit_count("code") == 1).select(*PIXEL)


def directions(skel: DataFrame, ends: DataFrame, steps: int = 6) -> DataFrame:
    """px, py of each end point and dx, dy, the unit vector to where a walk of some steps along the skeleton leads.

    A step goes to the first neighbour in reading order other than the one it comes from; walks that end where they began give no row."""
    margin = steps + 1

    def run(key, pdf, places):
        grid, x0, y0 = _grid(key, pdf, margin)
        code, first = _around(grid), np.array([(c & -c).bit_length() - 1 for c in range(256)])
        dx, dy = np.array(AROUND).T
        px, py = places["px"].to_numpy(), places["py"].to_numpy()
        here = grid[px - x0, py - y0] > 0
        px, py = px[here], py[here]
        x, y, back = px - x0, py - y0, np.zeros(len(px), np.int64)
        for _ in range(steps):
            i = first[code[x, y] & ~back]
            go = i >= 0
            x, y, back = x + np.where(go, dx[i], 0), y + np.where(go, dy[i], 0), np.where(go, 1 << (7 - i), back)
        x, y = x + x0 - px, y + y0 - py
        far = (x != 0) | (y != 0)
        length = np.sqrt((x * x + y * y)[far].astype(float))
        return pd.DataFrame({"px": px[far], "py": py[far], "dx": x[far] / length, "dy": y[far] / length})

    ends = ends.select(*PIXEL)
    return _each_tile(skel.select(*PIXEL).distinct(), margin, run, _schema(ends, "dx double", "dy double"), ends)


def _met(mask: DataFrame, rays: DataFrame, most: int, step: float, box: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Every pixel hx, hy of the mask that a ray meets at dist, a step at a time."""
    far = rays.select("*", F.explode(F.sequence(F.lit(1), F.lit(int(most / step)))).alias("_k")).withColumn("dist", F.col("_k") * F.lit(float(step))).drop("_k")
    at = far.withColumns({"hx": F.rint(F.col("px") + F.col("dx") * F.col("dist")).cast("long"), "hy": F.rint(F.col("py") + F.col("dy") * F.col("dist")).cast("long")})
    if box:
        at = at.where((F.col("hx") > box[0]) & (F.col("hx") < box[1]) & (F.col("hy") > box[2]) & (F.col("hy") < box[3]))
    return at.join(mask.select(F.col("px").cast("long").alias("hx"), F.col("py").cast("long").alias("hy")).distinct(), ["hx", "hy"])


def _first(hits: DataFrame) -> DataFrame:
    return hits.groupBy("px", "py", "dx", "dy").agg(F.min(F.struct("dist", "hx", "hy")).alias("_h")).select("px", "py", "dx", "dy", "_h.hx", "_h.hy", "_h.dist")


def cast_rays(mask: DataFrame, rays: DataFrame, most: int = 25, step: float = 1.0, box: tuple[int, int, int, int] | None = None) -> DataFrame:
    """rays (px, py, dx, dy) with hx, hy, dist: the first pixel of the mask that each meets up to a distance; rays that meet none give no row.

    Pixels on the edge of the box (x0, x1, y0, y1), or outside, are not met."""
    return _first(_met(mask, rays, most, step, box))


def widths(mask: DataFrame, places: DataFrame, widest: int = 40) -> DataFrame:
    """places (px, py) with `width`: twice the chamfer distance to the nearest pixel outside the mask, rounded down, from 1 to widest."""
    reach = widest // 2 + 1
    side = np.arange(-reach, reach + 1)
    a, b = np.abs(side)[:, None], np.abs(side)[None, :]
    length = STRAIGHT * np.abs(a - b) + DIAGONAL * np.minimum(a, b)

    def run(key, pdf, places):
        grid, x0, y0 = _grid(key, pdf, reach)
        x, y = places["px"].to_numpy() - x0, places["py"].to_numpy() - y0
        out = np.zeros(len(x), np.int32)
        for lo in range(0, len(x), 1000):
            i = slice(lo, lo + 1000)
            free = grid[x[i, None, None] + side[:, None], y[i, None, None] + side] == 0
            d = np.where(free, length, np.inf).min(axis=(1, 2))
            d = np.where(np.isinf(d), float(widest), d)
            out[i] = np.minimum(widest, np.maximum(1, np.floor(2 * d)))
        return places.drop(columns=_TILE).assign(width=out)

    return _each_tile(mask.select(*PIXEL).distinct(), reach, run, _schema(places, "width int"), places)


def lines(segments: DataFrame) -> DataFrame:
    """The pixels within half of `width` of each segment from (px, py) to (hx, hy); a width of 1 gives a connected line."""

    def span(a: str, b: str) -> Column:
        return F.explode(F.sequence((F.least(a, b) - F.col("width")).cast("long"), (F.greatest(a, b) + F.col("width")).cast("long")))

    box = segments.select("px", "py", "hx", "hy", "width", span("px", "hx").alias("_x")).select("*", span("py", "hy").alias("_y"))
    lx, ly = F.col("hx") - F.col("px"), F.col("hy") - F.col("py")
    qx, qy = F.col("_x") - F.col("px"), F.col("_y") - F.col("py")
    size = lx * lx + ly * ly
    along = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(size == 0, 0.0).otherwise((qx * lx + qy * ly) / F.greatest(size, F.lit(1)))))
    gap = F.pow(qx - along * lx, F.lit(2.0)) + F.pow(qy - along * ly, F.lit(2.0))
    return box.where(gap <= F.pow(F.col("width") / 2.0, F.lit(2.0)) + 1e-9).select(F.col("_x").alias("px"), F.col("_y").alias("py")).distinct()


def _labels(grid: np.ndarray) -> np.ndarray:
    """For every element set, the least place (row by row) of those it hangs together with over eight neighbours."""
    n, m = grid.shape
    none = n * m
    at = np.where(grid > 0, np.arange(none).reshape(n, m), none)
    while True:
        wide, near = np.pad(at, 1, constant_values=none), at
        for dx, dy in AROUND:
            near = np.minimum(near, wide[1 + dx : 1 + dx + n, 1 + dy : 1 + dy + m])
        up = np.arange(none + 1)
        np.minimum.at(up, at[grid > 0], near[grid > 0])
        while (up[up] != up).any():
            up = up[up]
        new = up[at]
        if (new == at).all():
            return at
        at = new


def pieces(mask: DataFrame) -> DataFrame:
    """Every pixel of the mask with `piece`, the least pixel (as a struct) that it hangs together with over its eight neighbours.

    Tiles are labelled first, then the labels that meet over an edge of two tiles."""

    def run(key, pdf):
        grid, x0, y0 = _grid(key, pdf, 0)
        x, y = np.nonzero(grid)
        least = _labels(grid)[x, y]
        return pd.DataFrame({"px": x + x0, "py": y + y0, "_lx": least // TILE + x0, "_ly": least % TILE + y0})

    here = stored(mask.select(*PIXEL).distinct())
    kinds = dict(here.dtypes)
    local = stored(_each_tile(here, 0, run, _schema(here, f"_lx {kinds['px']}", f"_ly {kinds['py']}")))
    local = local.select(*PIXEL, F.struct(F.col("_lx").alias("px"), F.col("_ly").alias("py")).alias("_l"))
    inner = [F.pmod(F.col(c), F.lit(TILE)) for c in PIXEL]
    edge = local.where((inner[0] == 0) | (inner[0] == TILE - 1) | (inner[1] == 0) | (inner[1] == TILE - 1))
    moves = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in AROUND[:4]])).alias("_m")
    near = edge.select(*PIXEL, F.col("_l").alias("u"), moves).withColumns({c: (F.col(c) + F.col(f"_m.d{c[1]}")).cast(kinds[c]) for c in PIXEL})
    found = components(near.join(edge, PIXEL).select("u", F.col("_l").alias("v")).where("u <> v").distinct())
    found = found.select(F.col("node").alias("_l"), F.col("component").alias("piece"))
    out = local.join(found, "_l", "left").select(*PIXEL, F.coalesce("piece", "_l").alias("piece"))
    unplaced = here.where(F.col("px").isNull() | F.col("py").isNull())
    return out.unionByName(unplaced.withColumn("piece", F.struct(*PIXEL)))


def gaps(mask: DataFrame, labelled: DataFrame, least: int = 3, most: int = 25, step: float = 1.0, steps: int = 6, outward: bool = False) -> DataFrame:
    """Segments (px, py, hx, hy, dist, width) that bridge gaps: from each end point in its direction to the first road met.

    labelled: the mask's pieces. The direction is that of a walk from the end point along its skeleton, so it points into
    its own road; a segment is kept if what its ray meets first is `least` away and of another piece. With outward the ray
    goes the other way, over the rest of its own road to the first pixel of another piece."""
    mask = stored(mask.select(*PIXEL).distinct())
    skel = skeleton(mask)
    rays = directions(skel, end_points(skel), steps)
    margin, dists = int(most) + 1, np.arange(1, int(most / step) + 1) * float(step)

    def run(key, pdf, rays):
        names, piece = np.unique(pdf[["_ax", "_ay"]].to_numpy(np.int64), axis=0, return_inverse=True)
        grid, x0, y0 = _grid(key, pdf, margin, piece.ravel() + 1, np.int32)
        px, py, dx, dy = (rays[c].to_numpy() for c in ("px", "py", "dx", "dy"))
        if outward:
            dx, dy = -dx, -dy
        own = grid[px - x0, py - y0][:, None]
        hx = np.rint(px[:, None] + dx[:, None] * dists).astype(np.int64)
        hy = np.rint(py[:, None] + dy[:, None] * dists).astype(np.int64)
        met = grid[hx - x0, hy - y0]
        hit = (met > 0) & (met != own) if outward else met > 0
        at, k = np.arange(len(px)), hit.argmax(axis=1) if len(px) else np.zeros(0, np.int64)
        keep = hit[at, k] & (met[at, k] != own[:, 0]) & (own[:, 0] > 0) & (dists[k] >= least)
        at, k = at[keep], k[keep]
        return pd.DataFrame({"px": px[at], "py": py[at], "hx": hx[at, k], "hy": hy[at, k], "dist": dists[k]})

    named = labelled.where(F.col("px").isNotNull() & F.col("py").isNotNull()).select(*PIXEL, F.col("piece.px").alias("_ax"), F.col("piece.py").alias("_ay"))
    across = stored(_each_tile(named, margin, run, _schema(rays.select(*PIXEL), "hx long", "hy long", "dist double"), rays))
    return widths(mask, across)


def stitched(mask: DataFrame, target: int = 1, rounds: int = 10, smooth: int = 1, **how) -> DataFrame:
    """The mask with its gaps bridged round by round, until it has at most `target` pieces, no gap is found, or after `rounds`.

    All segments of a round are found on the mask it starts with; then they are drawn and the mask is closed. how: parameters of gaps."""
    now = stored(mask.select(*PIXEL).distinct())
    for _ in range(rounds):
        labelled = stored(pieces(now))
        if labelled.where(F.col("piece") == F.struct(*PIXEL)).count() <= target:  # a piece is named by its least pixel
            break
        found = stored(gaps(now, labelled, **how))
        if not found.limit(1).count():
            break
        new = now.unionByName(lines(found)).distinct()
        new = stored(close(new, smooth) if smooth else new)
        dropped(now, labelled, found)
        now = new
    return now
