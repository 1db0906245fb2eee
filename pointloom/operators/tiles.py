"""Tiling, stitching and per-tile statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.operators.common import numbered, with_stats


def _origin(df: DataFrame, scene: str) -> DataFrame:
    """Integer box of each scene: floor of the minima, ceiling of the maxima."""
    b = df.groupBy(scene).agg(*[F.floor(F.min(c)).cast("double").alias(f"_lo{c}") for c in "xy"], *[F.ceil(F.max(c)).cast("double").alias(f"_hi{c}") for c in "xy"])
    return with_stats(df, b, [scene])


def _covering(c: str, size: float, step: float) -> Column:
    """Indices of the half-open tiles [lo + i*step, lo + i*step + size) that hold the value and start before the box's end."""
    off = F.col(c) - F.col(f"_lo{c}")
    low = F.greatest(F.lit(0).cast("long"), F.floor((off - size) / step) + 1)
    high = F.least(F.floor(off / step), F.greatest(F.ceil((F.col(f"_hi{c}") - F.col(f"_lo{c}")) / step) - 1, F.lit(0).cast("long")))
    return F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<bigint>"))


def overlapping_tiles(df: DataFrame, size: float, step: float, scene: str = "scene") -> DataFrame:
    """A row for each point and tile (tx, ty) that holds it; tiles overlap when size > step. No join of points with tiles."""
    out = _origin(df, scene).withColumn("tx", F.explode(_covering("x", size, step))).withColumn("ty", F.explode(_covering("y", size, step)))
    return out.select(*df.columns, "tx", "ty")


def closed_tiles(df: DataFrame, size: float, overlap: float, least: int, scene: str = "scene") -> DataFrame:
    """Points of tiles closed on both sides, stepping by size - overlap, of at least `least` points."""
    step = size - overlap
    o = df.groupBy(scene).agg(*[F.min(c).alias(f"_lo{c}") for c in "xy"])
    rows = df.join(o, scene)
    seq = lambda c: F.sequence(F.greatest(F.ceil((F.col(c) - F.col(f"_lo{c}") - size) / step), F.lit(0).cast("long")), F.floor((F.col(c) - F.col(f"_lo{c}")) / step))
    rows = rows.withColumn("tx", F.explode(seq("x"))).withColumn("ty", F.explode(seq("y"))).select(*df.columns, "tx", "ty")
    full = rows.groupBy(scene, "tx", "ty").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).drop("_n")
    return rows.join(full, [scene, "tx", "ty"])


def scene_tiles(df: DataFrame, size: float, least: int = 1, scene: str = "scene") -> DataFrame:
    """Disjoint tiles of a global grid, of at least `least` points; x, y relative to the tile's middle, z to its ground."""
    rows = _origin(df, scene).withColumn("tx", F.explode(_covering("x", size, size))).withColumn("ty", F.explode(_covering("y", size, size)))
    t = rows.groupBy(scene, "tx", "ty").agg(F.count("*").alias("_n"), F.min("z").alias("_z")).where(F.col("_n") >= least)
    rows = with_stats(rows, t, [scene, "tx", "ty"])
    local = {c: F.col(c) - (F.col(f"_lo{c}") + F.col(f"t{c}") * size + size / 2) for c in "xy"}
    return rows.withColumns({**local, "z": F.col("z") - F.col("_z")}).select(*df.columns, "tx", "ty")


def strip_tiles(df: DataFrame, size: float, scene: str = "scene") -> DataFrame:
    """Disjoint tiles in x strips whose y origin is the floor of the strip's own least y."""
    o = df.groupBy(scene).agg(F.floor(F.min("x")).alias("_ox"))
    rows = df.join(o, scene).withColumn("tx", F.floor((F.col("x") - F.col("_ox")) / size))
    s = rows.groupBy(scene, "tx").agg(F.floor(F.min("y")).alias("_oy"))
    return rows.join(s, [scene, "tx"]).withColumn("ty", F.floor((F.col("y") - F.col("_oy")) / size)).select(*df.columns, "tx", "ty")


def stride_tiles(df: DataFrame, size: float, stride: float, scene: str = "scene") -> DataFrame:
    """Half-open tiles from the exact minimum, ceil((length - size) / stride) + 1 of them an axis (one at least)."""
    o = df.groupBy(scene).agg(*[F.min(c).alias(f"_lo{c}") for c in "xy"], *[F.max(c).alias(f"_hi{c}") for c in "xy"])
    rows = df.join(o, scene)

    def seq(c: str) -> Column:
        off, n = F.col(c) - F.col(f"_lo{c}"), F.greatest(F.ceil((F.col(f"_hi{c}") - F.col(f"_lo{c}") - size) / stride) + 1, F.lit(1).cast("long"))
        low, high = F.greatest(F.floor((off - size) / stride) + 1, F.lit(0).cast("long")), F.least(F.floor(off / stride), n - 1)
        return F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<bigint>"))

    return rows.withColumn("tx", F.explode(seq("x"))).withColumn("ty", F.explode(seq("y"))).select(*df.columns, "tx", "ty")


def tile_stats(df: DataFrame, keys: list[str], label: str = "segment") -> DataFrame:
    """Count, box, number of labels and most common label (least on a tie) of every tile."""
    by = df.groupBy(*keys, label).agg(F.count("*").alias("_n"), *[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))])
    return by.groupBy(*keys).agg(
        F.sum("_n").alias("n"), F.count("*").alias("labels"), F.max_by(label, F.struct(F.col("_n"), -F.col(label))).alias("top_label"),
        *[f(f"{n}_{c}").alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))],
    )


def label_histogram(df: DataFrame, keys: list[str], label: str = "segment") -> DataFrame:
    """Labels of every tile with their counts, as a map."""
    by = df.groupBy(*keys, label).agg(F.count("*").alias("_n"))
    return by.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(label, "_n")))).alias("histogram"))  # one entry a label


def pillar_bev(df: DataFrame, pixel: float, keys: list[str]) -> DataFrame:
    """Per pixel: points, largest z (0 at least) and mean strength."""
    px = df.withColumns({"px": F.floor(F.col("x") / pixel), "py": F.floor(F.col("y") / pixel)})
    return px.groupBy(*keys, "px", "py").agg(F.count("*").alias("n"), F.greatest(F.max("z"), F.lit(0.0)).alias("height"), F.avg("strength").alias("strength"))


def stitch_last(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Of overlapping tiles the value of the last in order."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def stitch_majority(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """The most common value; of equals the one met first in order."""
    by = df.groupBy(*keys, value).agg(F.count("*").alias("_n"), F.min(F.struct(*order)).alias("_first"))
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_n"), "_first"))
    return by.withColumn("_rn", best).where("_rn = 1").select(*keys, value)


def stitch_mean(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean of the values above 0 over overlapping tiles; 0 where none is."""
    return df.groupBy(*keys).agg(F.coalesce(F.avg(F.when(F.col(value) > 0, F.col(value))), F.lit(0.0)).alias(value))


def ground_slab(df: DataFrame, keys: list[str], height: float, quantile: float = 0.05) -> DataFrame:
    """Points between their tile's quantile of z and height above it."""
    q = df.groupBy(*keys).agg(F.percentile("z", F.lit(quantile)).alias("_z0"))
    return df.join(q, keys).where((F.col("z") >= F.col("_z0")) & (F.col("z") <= F.col("_z0") + height)).drop("_z0")


def chunks(df: DataFrame, size: float, stride: float, least: int, scene: str = "scene") -> DataFrame:
    """Overlapping chunks with sequential numbers over those kept, by scene, x and y."""
    rows = stride_tiles(df, size, stride, scene)
    kept = rows.groupBy(scene, "tx", "ty").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    number = F.row_number().over(Window.partitionBy(scene).orderBy("tx", "ty")) - 1  # one row a chunk
    return kept.withColumn("chunk", number)


def patch_padding(df: DataFrame, batch: str, order: str, k: int) -> DataFrame:
    """Each batch in patches of k points by order; the last patch is filled with the points k before its end.

    Adds patch and slot. A batch of at most k points is one short patch."""
    n = df.groupBy(batch).agg(F.count("*").alias("_n"))
    rows = with_stats(numbered(df, [batch], [order], "_rn"), n, [batch])
    own = rows.withColumn("patch", F.floor(F.col("_rn") / k)).withColumn("slot", F.col("_rn") % k)
    r = F.col("_n") % k
    lent = rows.where((F.col("_n") > k) & (r > 0)).where((F.col("_rn") >= F.col("_n") - k) & (F.col("_rn") < F.col("_n") - r))
    lent = lent.withColumn("patch", F.floor(F.col("_n") / k)).withColumn("slot", F.col("_rn") - (F.col("_n") - k) + r)
    return own.unionByName(lent).drop("_n", "_rn")


def strip_overlapping_tiles(df: DataFrame, size: float, step: float, scene: str = "scene") -> DataFrame:
    """Each point in one strip of x and in every tile of y that covers it: tx, ty, with coordinates from the tile's corner."""
    out = df.join(df.groupBy(scene).agg(F.min("x").alias("_ox"), F.min("y").alias("_oy")), scene)
    out = out.withColumn("tx", F.floor((F.col("x") - F.col("_ox")) / size).cast("long"))
    dy = F.col("y") - F.col("_oy")
    last = F.floor(dy / step).cast("long")
    first = F.greatest(F.floor((dy - size) / step).cast("long") + 1, F.lit(0))
    out = out.withColumn("ty", F.explode(F.sequence(first, last)))
    return out.withColumns({"lx": F.col("x") - F.col("_ox") - F.col("tx") * size, "ly": dy - F.col("ty") * step}).drop("_ox", "_oy")


def stitch_points(points: DataFrame, predicted: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Every point's value from the last of its tiles, -1 for a point in none."""
    last = predicted.groupBy(key).agg(F.max_by(value, order).alias(value))
    return points.select(key).join(last, key, "left").withColumn(value, F.coalesce(value, F.lit(-1)))


def labelled_tiles(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Rows of tiles in which some pixel has a label other than 0."""
    some = df.groupBy(*keys).agg(F.max(F.abs(F.col(label))).alias("_m")).where("_m > 0").select(*keys)
    return df.join(some, keys, "left_semi")
