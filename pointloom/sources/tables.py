"""Point, frame, feature and label views of the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as points: pid, scene, x, y, z, strength, segment 0-5, pred.

    pid is whole-number arithmetic on the row's keys and price, cheap wherever the plan repeats it: order and line
    tell rows apart below 1.2 billion orders, the other keys and the price rows of equal order and line."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    code = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2) * 2 + F.when(F.col("l_linestatus") == "F", 0).otherwise(1)
    rest = F.col("l_partkey").cast("long") * 40503 + F.col("l_suppkey").cast("long") * 30011 + F.round(F.col("l_extendedprice") * 100).cast("long")
    pid = F.col("l_orderkey").cast("long") * 7 + F.col("l_linenumber") - 1 + (rest % 134217689) * 8589934583
    rows = li.select(
        pid.alias("pid"), (F.col("l_suppkey") % 4).cast("int").alias("scene"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 2000).alias("y"),
        (F.col("l_discount") * 100).alias("z"), F.col("l_tax").alias("strength"), code.cast("int").alias("segment"), F.col("l_linenumber").alias("line"),
    )
    return rows.withColumn("pred", ((F.col("segment") + F.when(F.col("pid") % 7 == 0, 1).otherwise(0)) % 6).cast("int"))


#: The same view in SQL, for oracles.
POINTS_SQL = """points as (
  select *, cast((segment + case when pid % 7 = 0 then 1 else 0 end) % 6 as integer) as pred from (
    select l_orderkey::bigint * 7 + l_linenumber - 1 + ((l_partkey::bigint * 40503 + l_suppkey::bigint * 30011 + cast(round(l_extendedprice * 100) as bigint)) % 134217689) * 8589934583 as pid,
           cast(l_suppkey % 4 as integer) as scene,
           l_quantity as x, l_extendedprice / 2000 as y, l_discount * 100 as z, l_tax as strength,
           cast(case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end * 2 + case l_linestatus when 'F' then 0 else 1 end as integer) as segment, l_linenumber as line
    from lineitem))"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as frames of sequences: seq (user), frame (place by time), ts, kind, value."""
    from pyspark.sql import Window

    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return ev.select("event_id", F.col("user_id").alias("seq"), (F.row_number().over(order) - 1).cast("long").alias("frame"), "ts", F.col("event_type").alias("kind"), "value")


FRAMES_SQL = """frames as (
  select event_id, user_id as seq, row_number() over (partition by user_id order by ts, event_id) - 1 as frame, ts, event_type as kind, value from events)"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels as ground truth (quality) and prediction (toxic)."""
    t = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return t.select("doc_id", F.col("quality").cast("int").alias("gt"), F.col("toxic").cast("int").alias("pred"))
