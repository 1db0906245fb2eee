"""Scalar curves: kernels, schedules, units, normalisation rounds, quaternions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def gaussian(distance: Column, height: float, width: float) -> Column:
    return height * F.exp(-distance * distance / (2 * width * width))


def unit_guess(distance: Column) -> Column:
    """A unit by the usual spacing of points."""
    return F.when(distance < 1e-4, "unknown").when(distance < 5e-3, "metres, very dense").when(distance < 0.3, "metres").when(distance < 3, "decimetres or feet").otherwise("millimetres")


def cosine_schedule(spark: SparkSession, steps: int, base: float, final: float, warmup: int = 0, start: float = 0.0) -> DataFrame:
    """value of each step: a linear warm-up from start, then half a cosine from base to final."""
    i = F.col("id").cast("double")
    rest = max(1, steps - warmup)
    cosine = final + 0.5 * (base - final) * (1 + F.cos(math.pi * (i - warmup) / rest))
    rise = start + (base - start) * i / max(1, warmup - 1)
    return spark.range(steps).select(F.col("id").alias("step"), F.when(F.col("id") < warmup, rise).otherwise(cosine).alias("value"))


def sinkhorn(df: DataFrame, sample: str, prototype: str, score: str, rounds: int = 3) -> DataFrame:
    """Scores made doubly balanced: rounds of dividing by prototype sums (to 1/prototypes) and sample sums (to 1/samples)."""
    total = df.agg(F.sum(score).alias("_t"), F.countDistinct(sample).alias("_ns"), F.countDistinct(prototype).alias("_np"))
    q = df.crossJoin(F.broadcast(total)).withColumn("q", F.col(score) / F.col("_t"))
    for _ in range(rounds):
        for key, n in ((prototype, "_np"), (sample, "_ns")):
            s = q.groupBy(key).agg(F.sum("q").alias("_s"))
            q = q.join(s, key).withColumn("q", F.col("q") / F.col("_s") / F.col(n)).drop("_s")
    return q.select(sample, prototype, (F.col("q") * F.col("_ns")).alias("q"))


def heat(value: Column, low: Column, high: Column, steep: float = 8.0) -> Column:
    """A sigmoid between two cut-offs."""
    mid, span = (low + high) / 2, F.greatest(high - low, F.lit(1e-12))
    return 1 / (1 + F.exp(-steep * (value - mid) / span))


def scaled(df: DataFrame, keys: list[str], column: str, to: str) -> DataFrame:
    """(v - min) / (max - min + 1e-12) within keys."""
    s = df.groupBy(*keys).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    return df.join(s, keys).withColumn(to, (F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-12)).drop("_lo", "_hi")


def quaternion_matrix(w: float, x: float, y: float, z: float) -> list[list[float]]:
    """Rotation matrix of a quaternion of any length but 0."""
    n = w * w + x * x + y * y + z * z
    s = 2 / n
    return [
        [1 - s * (y * y + z * z), s * (x * y - w * z), s * (x * z + w * y)],
        [s * (x * y + w * z), 1 - s * (x * x + z * z), s * (y * z - w * x)],
        [s * (x * z - w * y), s * (y * z + w * x), 1 - s * (x * x + y * y)],
    ]
