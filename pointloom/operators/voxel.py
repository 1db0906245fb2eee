"""Voxel operators: grid sampling, fragments, pooling, occupancy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.operators.common import placed, ranked, uniform

VOXEL = ["gx", "gy", "gz"]


def voxel_index(df: DataFrame, size: float, truncate: bool = False) -> DataFrame:
    """Adds gx, gy, gz: the voxel of each point; floor, or towards zero when truncate."""
    cell = (lambda c: (F.col(c) / size).cast("long")) if truncate else (lambda c: F.floor(F.col(c) / size).cast("long"))
    return df.withColumns({g: cell(c) for g, c in zip(VOXEL, "xyz")})


def occupancy(df: DataFrame, size: float) -> DataFrame:
    """Points of every occupied voxel."""
    return voxel_index(df, size).groupBy(*VOXEL).agg(F.count("*").alias("n"))


def occupancy_summary(df: DataFrame, size: float) -> DataFrame:
    """Number of voxels and the distribution of their counts."""
    n = occupancy(df, size)
    q = F.percentile("n", F.array(*[F.lit(p) for p in (0.5, 0.9, 0.95, 0.99)]))
    out = n.agg(F.count("*").alias("voxels"), F.round(F.avg("n"), 6).alias("mean"), F.max("n").alias("most"), q.alias("q"))
    return out.select("voxels", "mean", "most", *[F.round(F.col("q")[i], 6).alias(f"p{p}") for i, p in enumerate((50, 90, 95, 99))])


def first_in_voxel(df: DataFrame, size: float, order: str = "pid") -> DataFrame:
    """The point of least `order` in every voxel; all columns kept. Combines before the shuffle."""
    rest = [c for c in df.columns if c != order]
    kept = voxel_index(df, size).groupBy(*VOXEL).agg(F.min(F.struct(order, *rest)).alias("_p"))
    return kept.select(*VOXEL, "_p.*")


def sample_voxels(df: DataFrame, size: float, seed: int = 0, key: str = "pid") -> DataFrame:
    """One point of every voxel, picked by seeded hash."""
    rest = [c for c in df.columns]
    pick = voxel_index(df, size).groupBy(*VOXEL).agg(F.min(F.struct(uniform(key, seed=seed).alias("_u"), *rest)).alias("_p"))
    return pick.select(*VOXEL, *[F.col(f"_p.{c}").alias(c) for c in rest])


def mean_in_voxel(df: DataFrame, size: float, columns: list[str]) -> DataFrame:
    """Mean of columns over every voxel."""
    return voxel_index(df, size).groupBy(*VOXEL).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in columns])


def grid_fragments(df: DataFrame, size: float, order: str = "pid") -> DataFrame:
    """Fragments that together show every point: fragment i holds point i mod count of every voxel.

    There are as many fragments as the fullest voxel has points."""
    w = Window.partitionBy(*VOXEL)
    rows = voxel_index(df, size).withColumn("_rn", F.row_number().over(w.orderBy(order)) - 1).withColumn("_cnt", F.count("*").over(w))
    most = occupancy(df, size).agg((F.max("n") - 1).alias("_last"))  # one row
    each = rows.crossJoin(F.broadcast(most)).withColumn("fragment", F.explode(F.expr("sequence(_rn, cast(_last as int), cast(_cnt as int))")))
    return each.drop("_rn", "_cnt", "_last").withColumn("fragment", F.col("fragment").cast("long"))


def inverse_map(df: DataFrame, size: float) -> DataFrame:
    """Adds `inverse`: the place of the point's voxel in the lexicographic order of occupied voxels."""
    return ranked(voxel_index(df, size), VOXEL, "inverse")


def grid_pooling(df: DataFrame, stride: int, batch: str, columns: list[str], reduce: str = "max") -> DataFrame:
    """Pools cells of `stride` voxels (truncating) per batch: reduced columns, mean coordinates, members."""
    cells = df.withColumns({g: (F.col(c) / stride).cast("long") for g, c in zip(VOXEL, "xyz")})
    how = {"max": F.max, "min": F.min, "mean": F.avg, "sum": F.sum}[reduce]
    return cells.groupBy(batch, *VOXEL).agg(F.count("*").alias("n"), *[how(c).alias(c) for c in columns], *[F.avg(c).alias(f"mean_{c}") for c in "xyz"])


def grid_unpooling(pooled: DataFrame, df: DataFrame, stride: int, batch: str, columns: list[str]) -> DataFrame:
    """Carries pooled columns (prefixed up_) back to the points."""
    cells = df.withColumns({g: (F.col(c) / stride).cast("long") for g, c in zip(VOXEL, "xyz")})
    return cells.join(pooled.select(batch, *VOXEL, *[F.col(c).alias(f"up_{c}") for c in columns]), [batch, *VOXEL])


def displacement(df: DataFrame, size: float) -> DataFrame:
    """Adds dx, dy, dz: the offset from the voxel's centre in voxels."""
    out = voxel_index(df, size)
    return out.withColumns({f"d{c}": F.col(c) / size - F.col(g) - 0.5 for g, c in zip(VOXEL, "xyz")})


def log_density(df: DataFrame, size: float) -> DataFrame:
    """Adds grey in [0, 1]: log(1 + points of the voxel), scaled over the table."""
    n = occupancy(df, size).withColumn("_l", F.log1p("n"))
    span = n.agg(F.min("_l").alias("_lo"), F.max("_l").alias("_hi"))
    grey = n.crossJoin(F.broadcast(span)).select(*VOXEL, ((F.col("_l") - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-12))).alias("grey"))
    return voxel_index(df, size).join(grey, VOXEL)


def count_at_sizes(df: DataFrame, sizes: list[float]) -> DataFrame:
    """Occupied voxels at each size, in one pass."""
    each = df.select("x", "y", "z").withColumn("size", F.explode(F.array(*[F.lit(float(s)) for s in sizes])))
    cells = each.select("size", *[F.floor(F.col(c) / F.col("size")).cast("long").alias(g) for g, c in zip(VOXEL, "xyz")])
    return cells.distinct().groupBy("size").agg(F.count("*").alias("voxels"))


def size_for(df: DataFrame, target: int, low: float, high: float, rounds: int = 8, per_round: int = 8) -> float:
    """The grid size whose number of voxels is closest to target, by repeated narrowing; one pass a round."""
    best = (float("inf"), low)
    for _ in range(rounds):
        sizes = [low + (high - low) * i / (per_round - 1) for i in range(per_round)]
        found = sorted((r["size"], r["voxels"]) for r in count_at_sizes(df, sizes).collect())  # per_round rows
        best = min(best, *((abs(n - target), s) for s, n in found))
        above = [s for s, n in found if n >= target]
        below = [s for s, n in found if n < target]
        low, high = max(above, default=low), min(below, default=high)
        if high <= low:
            break
    return best[1]


def z_code(x: Column, y: Column, z: Column, depth: int = 16) -> Column:
    """Z-order code: bits of x, y and z interleaved (z lowest)."""
    steps = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))

    def spread(c: Column) -> Column:
        c = c.cast("long").bitwiseAND(F.lit((1 << depth) - 1).cast("long"))
        for by, mask in steps:
            c = c.bitwiseOR(F.shiftleft(c, by)).bitwiseAND(F.lit(mask))
        return c

    return F.shiftleft(spread(x), 2).bitwiseOR(F.shiftleft(spread(y), 1)).bitwiseOR(spread(z))


def z_decode(code: Column) -> tuple[Column, Column, Column]:
    """x, y, z of a Z-order code."""
    steps = ((2, 0x10C30C30C30C30C3), (4, 0x100F00F00F00F00F), (8, 0x1F0000FF0000FF), (16, 0x1F00000000FFFF), (32, 0x1FFFFF))

    def pack(c: Column) -> Column:
        c = c.bitwiseAND(F.lit(0x1249249249249249))
        for by, mask in steps:
            c = c.bitwiseOR(F.shiftrightunsigned(c, by)).bitwiseAND(F.lit(mask))
        return c

    return pack(F.shiftrightunsigned(code, 2)), pack(F.shiftrightunsigned(code, 1)), pack(code)


def curve_sorted(df: DataFrame, size: float) -> DataFrame:
    """Adds code and place: the Z-order of the points' voxels; ties by pid."""
    out = voxel_index(df, size)
    out = out.withColumn("code", z_code(*[F.col(g) for g in VOXEL]))
    return placed(out, ["code", "pid"])


def serialized_pooling(df: DataFrame, size: float, depth: int, batch: str) -> DataFrame:
    """Pools points whose Z-order codes agree above depth levels: count, mean coordinates, label of the least pid."""
    out = voxel_index(df, size).withColumn("cluster", F.shiftright(z_code(*[F.col(g) for g in VOXEL]), 3 * depth))
    return out.groupBy(batch, "cluster").agg(F.count("*").alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in "xyz"], F.min_by("segment", "pid").alias("segment"))


def octree(df: DataFrame, size: float, depth: int) -> DataFrame:
    """Occupied nodes of every level 0..depth, with their points."""
    code = voxel_index(df, size).select(z_code(*[F.col(g) for g in VOXEL]).alias("code"))
    nodes = code.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    return nodes.select("level", F.expr(f"shiftright(code, 3 * ({depth} - level))").alias("node")).groupBy("level", "node").agg(F.count("*").alias("n"))


def hilbert_codes(df: DataFrame, size: float, depth: int = 10) -> DataFrame:
    """Adds hilbert: the place of the point's voxel on a 3-D Hilbert curve of `depth` bits an axis (voxels from 0)."""

    def code(gx: pd.Series, gy: pd.Series, gz: pd.Series) -> pd.Series:
        x = np.stack([gx.to_numpy(np.int64), gy.to_numpy(np.int64), gz.to_numpy(np.int64)])
        q = 1 << (depth - 1)
        while q > 1:  # undo the excess rotations, from the highest bit down
            p = q - 1
            for i in range(3):
                hit = (x[i] & q) != 0
                t = np.where(hit, 0, (x[0] ^ x[i]) & p)
                x[0] = np.where(hit, x[0] ^ p, x[0] ^ t)
                x[i] ^= t
            q >>= 1
        x[1] ^= x[0]
        x[2] ^= x[1]
        t = np.zeros_like(x[0])
        q = 1 << (depth - 1)
        while q > 1:
            t = np.where((x[2] & q) != 0, t ^ (q - 1), t)
            q >>= 1
        x ^= t
        out = np.zeros_like(x[0])
        for b in range(depth - 1, -1, -1):
            for i in range(3):
                out = (out << 1) | ((x[i] >> b) & 1)
        return pd.Series(out)

    out = voxel_index(df, size)
    return out.withColumn("hilbert", F.pandas_udf(code, "long")(*VOXEL))
