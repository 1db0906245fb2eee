"""Frames of sequences: fusion by offsets, running and trailing statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fuse(frames: DataFrame, offsets: list[int], columns: list[str]) -> DataFrame:
    """Each frame with those of its sequence at the given offsets: columns of both, the other's prefixed by past_."""
    want = frames.withColumn("offset", F.explode(F.array(*[F.lit(o) for o in offsets]))).withColumn("_at", F.col("frame") + F.col("offset"))
    past = frames.select(F.col("seq").alias("_s"), F.col("frame").alias("_f"), *[F.col(c).alias(f"past_{c}") for c in columns])
    return want.join(past, (F.col("seq") == F.col("_s")) & (F.col("_at") == F.col("_f"))).drop("_s", "_f", "_at")


def running(frames: DataFrame, value: str) -> DataFrame:
    """Sum, count and mean of a sequence's values so far."""
    w = Window.partitionBy("seq").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    return frames.withColumns({"total": F.sum(value).over(w), "n": F.count(value).over(w), "mean": F.avg(value).over(w)})


def trailing(frames: DataFrame, value: str, size: int) -> DataFrame:
    """Median and mean of a sequence's last `size` values."""
    w = Window.partitionBy("seq").orderBy("frame").rowsBetween(-(size - 1), 0)
    return frames.withColumns({"median": F.percentile(value, F.lit(0.5)).over(w), "mean": F.avg(value).over(w)})


def latest(frames: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The last value of every key."""
    return frames.groupBy(*keys).agg(F.max_by(value, F.struct("ts", "event_id")).alias(value), F.max("ts").alias("ts"))


def offsets(counts: DataFrame, batch: str, n: str) -> DataFrame:
    """Rows up to and including each batch, by batch: one row a batch."""
    return counts.withColumn("offset", F.sum(n).over(Window.partitionBy(F.lit(0)).orderBy(batch).rowsBetween(Window.unboundedPreceding, 0)))
