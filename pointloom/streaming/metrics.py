"""Structured Streaming forms of the running metrics and of reading tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pointloom.operators import metrics


def tile_stream(spark: SparkSession, path: str, schema, per_trigger: int = 1) -> DataFrame:
    """Points of a folder of tile files, so many files a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def confusion_stream(points: DataFrame, classes: int) -> DataFrame:
    """Running confusion counts; state is one row a cell."""
    return metrics.confusion(points, classes)


def start_miou(points: DataFrame, classes: int, name: str, checkpoint: str) -> StreamingQuery:
    """Keeps view `name` with the class counts and IoU of all points so far."""

    def publish(cells: DataFrame, _: int) -> None:
        pairs = cells.selectExpr("gt", "pred", "n")
        sides = pairs.selectExpr("gt as class", "n as target", "0L as predicted", "case when gt = pred then n else 0L end as intersection").unionByName(pairs.selectExpr("pred as class", "0L as target", "n as predicted", "0L as intersection"))
        counts = sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("intersection", "target", "predicted")])
        rows = [tuple(r) for r in metrics.iou(counts).select("class", "intersection", "union", "iou").collect()]  # one row a class
        cells.sparkSession.createDataFrame(rows, "class int, intersection long, union long, iou double").createOrReplaceGlobalTempView(name)

    return confusion_stream(points, classes).writeStream.outputMode("complete").foreachBatch(publish).option("checkpointLocation", checkpoint).start()


def running_stream(events: DataFrame, key: str, value: str) -> DataFrame:
    """Count, mean, least and largest value of every key so far (update or complete mode)."""
    return events.groupBy(key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))


def windowed_stream(events: DataFrame, time: str, key: str, value: str, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Count and mean by key and time window; windows close once the watermark has passed them."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))


def frame_window_stream(frames: DataFrame, past: DataFrame, offset: int, time: str, late: str = "1 hour") -> DataFrame:
    """Frames joined with those `offset` before in the same sequence, both streams bounded by a watermark."""
    a = frames.withWatermark(time, late).alias("a")
    b = past.withWatermark(time, late).alias("b")
    return a.join(b, (F.col("a.seq") == F.col("b.seq")) & (F.col("b.frame") == F.col("a.frame") - offset) & (F.col(f"b.{time}") <= F.col(f"a.{time}")) & (F.col(f"b.{time}") >= F.col(f"a.{time}") - F.expr(f"interval {late}")))
