"""Shifts, scalings, rotations, crops and other coordinate projections."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.operators.common import uniform, with_stats


def _with_stats(df: DataFrame, scene: str, *aggs: Column) -> DataFrame:
    """df with per-scene aggregates joined: combined before the shuffle, so a large scene is no large window nor a large task."""
    return with_stats(df, df.groupBy(scene).agg(*aggs), [scene])


def center_shift(df: DataFrame, scene: str = "scene", apply_z: bool = True) -> DataFrame:
    """Coordinates less the middle of the scene's box in x and y and its least z (when apply_z)."""
    out = _with_stats(df, scene, *[f(c).alias(f"_{n}{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))])
    z = F.col("z") - F.col("_loz") if apply_z else F.col("z")
    return out.withColumns({"x": F.col("x") - (F.col("_lox") + F.col("_hix")) / 2, "y": F.col("y") - (F.col("_loy") + F.col("_hiy")) / 2, "z": z}).select(*df.columns)


def positive_shift(df: DataFrame, scene: str = "scene") -> DataFrame:
    """Coordinates less the scene's minima."""
    out = _with_stats(df, scene, *[F.min(c).alias(f"_lo{c}") for c in "xyz"])
    return out.withColumns({c: F.col(c) - F.col(f"_lo{c}") for c in "xyz"}).select(*df.columns)


def normalize_coord(df: DataFrame, scene: str = "scene") -> DataFrame:
    """Coordinates less the scene's centroid, divided by its largest distance from it."""
    c = _with_stats(df, scene, *[F.avg(k).alias(f"_m{k}") for k in "xyz"]).withColumns({k: F.col(k) - F.col(f"_m{k}") for k in "xyz"}).select(*df.columns)
    far = F.max(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))).alias("_far")
    out = _with_stats(c, scene, far)
    return out.withColumns({k: F.when(F.col("_far") > 0, F.col(k) / F.col("_far")).otherwise(0.0) for k in "xyz"}).select(*df.columns)


def clip(df: DataFrame, low: tuple[float, float, float], high: tuple[float, float, float]) -> DataFrame:
    """Coordinates clamped to a box; no point is dropped."""
    return df.withColumns({c: F.greatest(F.least(F.col(c), F.lit(float(h))), F.lit(float(l))) for c, l, h in zip("xyz", low, high)})


def rotate(df: DataFrame, angle: float, axis: str = "z", center: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Rotation by angle (radians) about an axis through center."""
    c, s = math.cos(angle), math.sin(angle)
    a, b = {"x": ("y", "z"), "y": ("z", "x"), "z": ("x", "y")}[axis]
    ca, cb = center["xyz".index(a)], center["xyz".index(b)]
    da, db = F.col(a) - ca, F.col(b) - cb
    return df.withColumns({a: da * c - db * s + ca, b: da * s + db * c + cb})


def permute(df: DataFrame, axes: tuple[str, str, str], signs: tuple[int, int, int] = (1, 1, 1)) -> DataFrame:
    """Axes reordered and flipped."""
    return df.withColumns({c: F.col(a) * F.lit(float(s)) for c, a, s in zip("xyz", axes, signs)})


def transform(df: DataFrame, pose: str) -> DataFrame:
    """Coordinates multiplied by the 4 x 4 matrix (16 numbers, row by row) in column pose."""
    m = lambda i: F.col(pose)[i]
    return df.withColumns({c: m(4 * r) * F.col("x") + m(4 * r + 1) * F.col("y") + m(4 * r + 2) * F.col("z") + m(4 * r + 3) for r, c in enumerate("xyz")})


def sphere_crop(df: DataFrame, center: tuple[float, float, float], n: int, order: str = "pid") -> DataFrame:
    """The n points closest to center."""
    d2 = sum((F.col(c) - F.lit(float(v))) * (F.col(c) - F.lit(float(v))) for c, v in zip("xyz", center))
    return df.withColumn("d2", d2).orderBy("d2", order).limit(n)


def bounds(df: DataFrame, scene: str = "scene") -> DataFrame:
    """Box and density of every scene; density is infinite for a flat box."""
    b = df.groupBy(scene).agg(F.count("*").alias("n"), *[f(c).alias(f"{p}_{c}") for c in "xyz" for p, f in (("min", F.min), ("max", F.max))])
    volume = (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y")) * (F.col("max_z") - F.col("min_z"))
    return b.withColumn("density", F.when(volume > 0, F.col("n") / volume).otherwise(float("inf")))


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Equal-width bins of a column over its range, the last one closed on the right."""
    span = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    at = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))).otherwise(0)
    return df.crossJoin(F.broadcast(span)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def column_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Minimum, maximum, mean and population deviation of columns, one row each."""
    aggs = [f(c).alias(f"{c}__{n}") for c in columns for n, f in (("lo", F.min), ("hi", F.max), ("mean", F.avg), ("std", F.stddev_pop))]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{c}__{n}").cast("double").alias(n) for n in ("lo", "hi", "mean", "std")]) for c in columns])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def dropout(df: DataFrame, ratio: float, scene: str = "scene", key: str = "pid", seed: int = 0) -> DataFrame:
    """Keeps floor(n * (1 - ratio)) points of every scene, picked by seeded hash."""
    n = df.groupBy(scene).agg(F.floor(F.count("*") * (1 - ratio)).alias("_keep"))
    rn = F.row_number().over(Window.partitionBy(scene).orderBy(uniform(key, seed=seed), key))
    return df.join(n, scene).withColumn("_rn", rn).where("_rn <= _keep").select(*df.columns)


def shuffle(df: DataFrame, key: str = "pid", seed: int = 0) -> DataFrame:
    """Rows in a seeded random order."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)


def align_pose(pose: list[float], target: list[float]) -> list[float]:
    """inverse(target) x pose for 4 x 4 matrices given row by row."""
    import numpy as np

    return (np.linalg.inv(np.array(target).reshape(4, 4)) @ np.array(pose).reshape(4, 4)).ravel().tolist()


def unproject(df: DataFrame, fx: float, fy: float, cx: float, cy: float, row: str = "row", col: str = "col", depth: str = "depth") -> DataFrame:
    """Pinhole pixels with depth to camera coordinates; depths of 0 or less give no point."""
    d = F.col(depth)
    return df.where(d > 0).withColumns({"x": (F.col(col) - cx) * d / fx, "y": (F.col(row) - cy) * d / fy, "z": d})


def project(df: DataFrame, fx: float, fy: float, cx: float, cy: float, width: int, height: int) -> DataFrame:
    """Pixels (u, v) of points before the camera that fall on the image."""
    uv = df.where("z > 0").withColumns({"u": F.floor(F.col("x") * fx / F.col("z") + cx).cast("int"), "v": F.floor(F.col("y") * fy / F.col("z") + cy).cast("int")})
    return uv.where(F.col("u").between(0, width - 1) & F.col("v").between(0, height - 1))


def jitter(df: DataFrame, sigma: float, most: float, key: str = "pid", seed: int = 0) -> DataFrame:
    """Coordinates moved by clipped normal noise that depends on key and seed only."""
    from pointloom.operators.common import normal

    noise = lambda i: F.greatest(F.least(normal(key, seed=seed + 10 * i) * sigma, F.lit(most)), F.lit(-most))
    return df.withColumns({c: F.col(c) + noise(i + 1) for i, c in enumerate("xyz")})


def random_scale(df: DataFrame, low: float, high: float, scene: str = "scene", seed: int = 0) -> DataFrame:
    """Each scene scaled by its own seeded factor."""
    factor = low + (high - low) * uniform(scene, seed=seed)
    return df.withColumns({c: F.col(c) * factor for c in "xyz"})


def random_flip(df: DataFrame, scene: str = "scene", chance: float = 0.5, seed: int = 0) -> DataFrame:
    """Signs of x and y flipped independently for each scene."""
    return df.withColumns({c: F.when(uniform(scene, seed=seed + i) < chance, -F.col(c)).otherwise(F.col(c)) for i, c in enumerate("xy")})


def radial_normals(df: DataFrame, centre: tuple[float, float, float]) -> DataFrame:
    """nx, ny, nz: the unit vector from the centre to the point; null at the centre."""
    d = {c: F.col(c) - v for c, v in zip("xyz", centre)}
    size = F.sqrt(d["x"] * d["x"] + d["y"] * d["y"] + d["z"] * d["z"])
    return df.withColumns({f"n{c}": F.when(size > 0, v / size) for c, v in d.items()})


def oriented(df: DataFrame, sensor: tuple[float, float, float]) -> DataFrame:
    """Normals nx, ny, nz turned to the sensor: flipped where they point away from it."""
    away = sum(F.col(f"n{c}") * (F.col(c) - v) for c, v in zip("xyz", sensor))
    return df.withColumns({f"n{c}": F.when(away > 0, -F.col(f"n{c}")).otherwise(F.col(f"n{c}")) for c in "xyz"})


def euler_matrix(roll: float, pitch: float, yaw: float) -> list[list[float]]:
    """Rz(yaw) Ry(pitch) Rx(roll), angles in radians."""
    import math

    (cr, sr), (cp, sp), (cy, sy) = ((math.cos(a), math.sin(a)) for a in (roll, pitch, yaw))
    return [[cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr], [sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr], [-sp, cp * sr, cp * cr]]


def turned(df: DataFrame, matrix: list[list[float]]) -> DataFrame:
    """x, y, z times a 3 x 3 matrix."""
    return df.withColumns({c: sum(F.col(a) * m for a, m in zip("xyz", row)) for c, row in zip("xyz", matrix)})


def z_up(df: DataFrame, keys: list[str]) -> DataFrame:
    """Y-up coordinates turned a quarter about x to Z-up, then moved so that each key's least is 0."""
    out = df.withColumns({"x": F.col("x"), "y": -F.col("z"), "z": F.col("y")})
    low = out.groupBy(*keys).agg(*[F.min(c).alias(f"_lo{c}") for c in "xyz"])
    return out.join(low, keys).withColumns({c: F.col(c) - F.col(f"_lo{c}") for c in "xyz"}).select(*df.columns)


def floor_levels(df: DataFrame, height: str = "y", reach: int = 2, least: int = 2000) -> DataFrame:
    """Levels (level, lo, hi, n): heights rounded to 0.1 whose neighbourhood of `reach` steps holds `least` points, joined while no further apart.

    One row a height is windowed, not one a point."""
    counts = df.groupBy(F.round(F.col(height) * 10).cast("long").alias("h")).agg(F.count("*").alias("n"))
    whole = Window.partitionBy(F.lit(0)).orderBy("h")
    core = counts.withColumn("_m", F.sum("n").over(whole.rangeBetween(-reach, reach))).where(F.col("_m") >= least)
    fresh = F.when(F.col("h") - F.lag("h").over(whole) <= reach, 0).otherwise(1)
    core = core.withColumn("level", fresh)
    core = core.withColumn("level", F.sum("level").over(whole.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return core.groupBy("level").agg((F.min("h") / 10).alias("lo"), (F.max("h") / 10).alias("hi"), F.sum("n").alias("n"))


def grid_normals(grid: DataFrame, value: str) -> DataFrame:
    """Normals of an organised grid (px, py, value): the cross product of the steps to the next pixels, null at the border, unit length."""
    right = grid.select((F.col("px") - 1).alias("px"), "py", F.col(value).alias("_r"))
    up = grid.select("px", (F.col("py") - 1).alias("py"), F.col(value).alias("_u"))
    near = grid.join(right, ["px", "py"], "left").join(up, ["px", "py"], "left").withColumns({"_a": F.col(value) - F.col("_r"), "_b": F.col(value) - F.col("_u")})
    size = F.sqrt(F.col("_a") * F.col("_a") + F.col("_b") * F.col("_b") + 1.0)
    return near.select("px", "py", (F.col("_a") / size).alias("nx"), (F.col("_b") / size).alias("ny"), (1.0 / size).alias("nz"))


def crop_correspondences(df: DataFrame, box: tuple[int, int, int, int], patch: int) -> DataFrame:
    """Pixel-point pairs (u, v, pid) inside the box (u0, v0, width, height), moved to it and scaled down to patches, as distinct (row, col, pid)."""
    u0, v0, width, height = box
    inside = df.where(F.col("u").between(u0, u0 + width - 1) & F.col("v").between(v0, v0 + height - 1))
    return inside.select(F.floor((F.col("v") - v0) / patch).cast("int").alias("row"), F.floor((F.col("u") - u0) / patch).cast("int").alias("col"), "pid").distinct()


def pooled_correspondences(df: DataFrame, keys: list[str], u: str = "u", v: str = "v") -> DataFrame:
    """Mean pixel of each cluster's members that have one (u >= 0), -1 without any."""
    valid = F.col(u) >= 0
    return df.groupBy(*keys).agg(*[F.coalesce(F.avg(F.when(valid, F.col(c))), F.lit(-1.0)).alias(c) for c in (u, v)])


def linear_head(df: DataFrame, vector: str, weights: list[list[float]], bias: list[float]) -> DataFrame:
    """logits: a linear layer on a vector column; label: the largest one's place."""
    row = lambda w, b: F.aggregate(F.zip_with(F.col(vector), F.array(*[F.lit(float(x)) for x in w]), lambda a, c: a.cast("double") * c), F.lit(float(b)), lambda s, x: s + x)
    out = df.withColumn("logits", F.array(*[row(w, b) for w, b in zip(weights, bias)]))
    return out.withColumn("label", (F.array_position("logits", F.array_max("logits")) - 1).cast("int"))
