"""Seeded augmentations: every random number is drawn from a key and a seed, so results do not depend on the partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.operators.common import drawn, drawn_normal


def shift(df: DataFrame, most: tuple[float, float, float], scene: str = "scene", seed: int = 0) -> DataFrame:
    """Each scene moved by its own offset, up to `most` either way on each axis."""
    return df.withColumns({c: F.col(c) + (2.0 * drawn(scene, seed=seed + i) - 1.0) * m for i, (c, m) in enumerate(zip("xyz", most))})


def scale(df: DataFrame, low: float, high: float, scene: str = "scene", seed: int = 0, anisotropic: bool = False) -> DataFrame:
    """Each scene scaled by its own factor, or by one for each axis."""
    return df.withColumns({c: F.col(c) * (low + (high - low) * drawn(scene, seed=seed + (i if anisotropic else 0))) for i, c in enumerate("xyz")})


def flip(df: DataFrame, scene: str = "scene", chance: float = 0.5, seed: int = 0) -> DataFrame:
    """Signs of x and y flipped independently for each scene."""
    return df.withColumns({c: F.when(drawn(scene, seed=seed + i) < chance, -F.col(c)).otherwise(F.col(c)) for i, c in enumerate("xy")})


def jitter(df: DataFrame, sigma: float, most: float, key: str = "pid", seed: int = 0, columns: str = "xyz") -> DataFrame:
    """Columns moved by clipped normal noise of each point."""
    noise = lambda i: F.greatest(F.least(drawn_normal(key, seed=seed + 10 * i) * sigma, F.lit(most)), F.lit(-most))
    return df.withColumns({c: F.col(c) + noise(i + 1) for i, c in enumerate(columns)})


def elastic(df: DataFrame, granularity: float, magnitude: float, seed: int = 0) -> DataFrame:
    """Coordinates moved by a smooth noise field: normal noise on a grid, averaged over 3 x 3 x 3 nodes, interpolated between the 8 around a point.

    Only the nodes next to points are made; they are a small table joined by the point's cell."""
    cell = [F.floor(F.col(c) / granularity).cast("long") for c in "xyz"]
    base = df.withColumns({f"_{c}": v for c, v in zip("xyz", cell)})
    cells = base.select("_x", "_y", "_z").distinct()
    steps = lambda low, high: F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip((a, b, c), "abc")]) for a in range(low, high) for b in range(low, high) for c in range(low, high)])
    corners = cells.select("*", F.explode(steps(0, 2)).alias("k")).select("_x", "_y", "_z", "k", *[(F.col(f"_{c}") + F.col(f"k.{n}")).alias(f"n{c}") for c, n in zip("xyz", "abc")])
    nodes = corners.select("nx", "ny", "nz").distinct().select("*", F.explode(steps(-1, 2)).alias("o"))
    noise = lambda i: drawn_normal(F.col("nx") + F.col("o.a"), F.col("ny") + F.col("o.b"), F.col("nz") + F.col("o.c"), seed=seed + 10 * i)
    field = nodes.select("nx", "ny", "nz", *[noise(i).alias(f"d{c}") for i, c in enumerate("xyz")]).groupBy("nx", "ny", "nz").agg(*[F.avg(f"d{c}").alias(f"d{c}") for c in "xyz"])
    around = corners.join(field, ["nx", "ny", "nz"]).groupBy("_x", "_y", "_z").agg(F.collect_list(F.struct("k", "dx", "dy", "dz")).alias("_f"))  # eight a cell
    part = {c: F.col(c) / granularity - F.col(f"_{c}") for c in "xyz"}
    weight = lambda e: _corner(e["k"]["a"], part["x"]) * _corner(e["k"]["b"], part["y"]) * _corner(e["k"]["c"], part["z"])
    total = lambda name: F.aggregate("_f", F.lit(0.0), lambda s, e: s + e[name] * weight(e))
    moved = base.join(around, ["_x", "_y", "_z"]).withColumns({f"_m{c}": F.col(c) + magnitude * total(f"d{c}") for c in "xyz"})
    return moved.select(*[F.col(f"_m{c}").alias(c) if c in ("x", "y", "z") else c for c in df.columns])


def _corner(side: Column, part: Column) -> Column:
    return F.when(side == 1, part).otherwise(1.0 - part)


def picked(df: DataFrame, ratio: float, scene: str = "scene", key: str = "pid", seed: int = 0, buckets: int = 4096) -> DataFrame:
    """Adds _picked: whether a point is among the floor(ratio * n) of least draw in its scene.

    Draws are counted in buckets first, so only the points of one bucket a scene are put in order."""
    rows = df.withColumn("_u", drawn(key, seed=seed)).withColumn("_b", F.floor(F.col("_u") * buckets))
    counts = rows.groupBy(scene, "_b").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(scene).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # at most `buckets` rows a scene
    cut = counts.withColumns({"_before": F.coalesce(F.sum("_n").over(upto), F.lit(0)), "_want": F.floor(F.sum("_n").over(Window.partitionBy(scene)) * ratio)})
    cut = cut.where("_before < _want and _before + _n >= _want").select(scene, F.col("_b").alias("_edge"), (F.col("_want") - F.col("_before")).alias("_left"))
    rows = rows.join(F.broadcast(cut), scene, "left")  # one row a scene
    edge = rows.where("_b = _edge").withColumn("_r", F.row_number().over(Window.partitionBy(scene).orderBy("_u", key))).where("_r <= _left").select(F.col(key).alias("_k"))
    inside = F.coalesce(F.col("_b") < F.col("_edge"), F.lit(False)) | F.col("_k").isNotNull()
    return rows.join(edge, rows[key] == edge["_k"], "left").withColumn("_picked", inside).select(*df.columns, "_picked")


def drop_columns(df: DataFrame, columns: list[str], ratio: float, scene: str = "scene", key: str = "pid", seed: int = 0) -> DataFrame:
    """Columns set to 0 on a drawn share of every scene's points."""
    return picked(df, ratio, scene, key, seed).withColumns({c: F.when(F.col("_picked"), F.lit(0).cast(t)).otherwise(F.col(c)) for c, t in df.dtypes if c in columns}).drop("_picked")


def chromatic_translation(df: DataFrame, ratio: float, scene: str = "scene", seed: int = 0) -> DataFrame:
    """One offset a scene and channel, up to ratio of the range either way, within 0..255."""
    return df.withColumns({c: F.greatest(F.least(F.col(c) + (drawn(scene, seed=seed + i) - 0.5) * 255 * 2 * ratio, F.lit(255.0)), F.lit(0.0)) for i, c in enumerate("rgb")})


def chromatic_jitter(df: DataFrame, std: float, key: str = "pid", seed: int = 0) -> DataFrame:
    """Normal noise of std shares of the range on every point's channels, within 0..255."""
    return df.withColumns({c: F.greatest(F.least(F.col(c) + drawn_normal(key, seed=seed + 10 * i) * std * 255, F.lit(255.0)), F.lit(0.0)) for i, c in enumerate("rgb")})


def views(df: DataFrame, count: int, most: float, low: float, high: float, scene: str = "scene", seed: int = 0) -> DataFrame:
    """`count` copies of every scene (column view), each shifted and scaled on its own; origin coordinates stay beside."""
    out = df.withColumns({f"origin_{c}": F.col(c) for c in "xyz"}).withColumn("view", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    out = out.withColumn("_s", F.concat_ws("/", F.col(scene), F.col("view")))
    return scale(shift(out, (most, most, 0.0), "_s", seed), low, high, "_s", seed + 7).drop("_s")


def test_time_list(df: DataFrame, turns: list[float], scales: list[float]) -> DataFrame:
    """Every point under every turn about z (in half circles) and scale: columns aug, turn, factor."""
    options = F.array(*[F.struct(F.lit(i * len(scales) + j).alias("aug"), F.lit(t).alias("turn"), F.lit(s).alias("factor"), F.lit(math.cos(t * math.pi)).alias("c"), F.lit(math.sin(t * math.pi)).alias("s")) for i, t in enumerate(turns) for j, s in enumerate(scales)])
    out = df.withColumn("_o", F.explode(options))
    x, y = (F.col("x") * F.col("_o.c") - F.col("y") * F.col("_o.s")) * F.col("_o.factor"), (F.col("x") * F.col("_o.s") + F.col("y") * F.col("_o.c")) * F.col("_o.factor")
    return out.withColumns({"x": x, "y": y, "z": F.col("z") * F.col("_o.factor"), "aug": F.col("_o.aug"), "turn": F.col("_o.turn"), "factor": F.col("_o.factor")}).drop("_o")


def centred_views(df: DataFrame, share: float, scene: str = "scene", key: str = "pid", seed: int = 0) -> DataFrame:
    """A view of every scene: the points within a square around a drawn point that covers `share` of the scene's box on each axis."""
    box = df.groupBy(scene).agg(*[(F.max(c) - F.min(c)).alias(f"_w{c}") for c in "xy"], F.min(F.struct(drawn(key, seed=seed).alias("u"), F.col(key).alias("k"), "x", "y")).alias("_at"))
    near = lambda c: F.abs(F.col(c) - F.col(f"_at.{c}")) <= F.col(f"_w{c}") * share / 2
    return df.join(box, scene).where(near("x") & near("y")).select(*df.columns, F.col("_at.k").alias("centre"))
