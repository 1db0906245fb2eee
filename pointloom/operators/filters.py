"""Row filters that need statistics or ranks, and column conforming."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.operators.common import uniform


def collect(df: DataFrame, keys: list[str], features: list[str], name: str = "feat") -> DataFrame:
    """Keys and the features as one array of doubles."""
    return df.select(*keys, F.array(*[F.col(c).cast("double") for c in features]).alias(name))


def copied(df: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """Columns copied under new names."""
    return df.withColumns({new: F.col(old) for old, new in pairs.items()})


def updated(df: DataFrame, values: dict) -> DataFrame:
    """Columns set to constants."""
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def conformed(df: DataFrame) -> DataFrame:
    """Integers as bigint, floating numbers as float."""
    kind = {"tinyint": "bigint", "smallint": "bigint", "int": "bigint", "double": "float"}
    return df.withColumns({c: F.col(c).cast(kind[t]) for c, t in df.dtypes if t in kind})


def confident(df: DataFrame, score: str, quantile: float, keys: list[str], least: float = 1e-5) -> DataFrame:
    """Rows whose score is at least the quantile of their key's scores and over least."""
    q = df.groupBy(*keys).agg(F.percentile(score, F.lit(quantile)).alias("_q"))
    return df.join(q, keys).where((F.col(score) >= F.col("_q")) & (F.col(score) > least)).drop("_q")


def largest_scenes(df: DataFrame, keep: int, scene: str = "scene") -> DataFrame:
    """Points of the `keep` largest scenes, the lower number first on a tie."""
    top = df.groupBy(scene).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), scene).limit(keep).select(scene)
    return df.join(top, scene, "left_semi")


def low_scores(df: DataFrame, score: str, most: float, n: int, order: str) -> DataFrame:
    """At most n rows of a score that is a number of at most `most`, the highest first; n = 0: all."""
    rows = df.where(F.col(score).isNotNull() & ~F.isnan(score) & (F.col(score) <= most))
    return rows.orderBy(F.desc(score), order).limit(n) if n else rows


def at_least(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Rows of keys that have n rows or more."""
    return df.join(df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= n).drop("_n"), keys, "left_semi")


def random_block(df: DataFrame, size: float, least: int, tries: int = 10, scene: str = "scene", key: str = "pid", seed: int = 0) -> DataFrame:
    """Per scene the points of the first of some seeded square blocks (closed) with more than `least` points; the whole scene where none has.

    Block centres are points picked by hash: a bounded number a scene."""
    pick = Window.partitionBy(scene).orderBy(uniform(key, seed=seed), key)
    c = df.select(scene, F.col("x").alias("_cx"), F.col("y").alias("_cy"), F.row_number().over(pick).alias("_try"), key).where(F.col("_try") <= tries).drop(key)
    inside = (F.abs(F.col("x") - F.col("_cx")) <= size / 2) & (F.abs(F.col("y") - F.col("_cy")) <= size / 2)
    hits = df.join(F.broadcast(c), scene).where(inside).groupBy(scene, "_try", "_cx", "_cy").agg(F.count("*").alias("_n")).where(F.col("_n") > least)
    first = hits.groupBy(scene).agg(F.min(F.struct("_try", "_cx", "_cy")).alias("_b"))
    rows = df.join(first, scene, "left").withColumns({"_cx": F.col("_b._cx"), "_cy": F.col("_b._cy")})
    return rows.where(F.col("_b").isNull() | inside).select(*df.columns)


def vote(df: DataFrame, keys: list[str], scores: str) -> DataFrame:
    """Sum of the softmax of every fragment's scores, and the label of the largest (the first on a tie)."""
    from pointloom.operators.raster import softmax

    by = df.select(*keys, F.posexplode(softmax(scores)).alias("label", "_p")).groupBy(*keys, "label").agg(F.sum("_p").alias("score"))
    return by.groupBy(*keys).agg(F.max_by("label", F.struct(F.round("score", 9), -F.col("label"))).alias("label"), F.max(F.round("score", 9)).alias("score"))


def top_labels(df: DataFrame, key: str, scores: str, k: int) -> DataFrame:
    """The k labels of largest score of every row, best first."""
    each = F.transform(F.col(scores), lambda v, i: F.struct((-v).alias("s"), i.alias("label")))
    return df.select(key, F.transform(F.slice(F.array_sort(each), 1, k), lambda p: p["label"]).alias("labels"))


def block_mask(df: DataFrame, size: float, ratio: float, seed: int = 0) -> DataFrame:
    """Adds masked: whether the point's voxel is among the share `ratio` of voxels picked by hash."""
    from pointloom.operators.voxel import VOXEL, voxel_index

    return voxel_index(df, size).withColumn("masked", uniform(*VOXEL, seed=seed) < ratio)
