"""Shared pieces: hashed randomness, stored tables, distributed ranks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder (spark.checkpoint.dir); a temporary one only where that is unset and all runs on one machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="pointloom-"))
    return context.getCheckpointDir()


def stored(df: DataFrame, codec: str | None = None) -> DataFrame:
    """df written as a table in the shared folder and read again: no lineage, and real sizes for the planner. codec: Parquet's compression, the session's if not given."""
    path = f"{shared_folder(df.sparkSession)}/pointloom-{uuid.uuid4().hex}"
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes tables that stored() gave; what is derived from them must not be read any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def with_stats(df: DataFrame, stats: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """df joined with a table of one row a key. The table is stored first, so the planner knows its real size: a small one is
    broadcast, and a key with many rows is no single task; a large one is shuffled."""
    return df.join(stored(stats), keys, how)


def uniform(*keys: str | Column, seed: int = 0) -> Column:
    """A repeatable number in [0, 1) for each key, whatever the partitioning."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[F.col(k) if isinstance(k, str) else k for k in keys]), 11)
    return bits.cast("double") / F.lit(float(1 << 53))


def normal(*keys: str | Column, seed: int = 0) -> Column:
    """A repeatable standard normal number for each key (Box-Muller)."""
    radius = F.sqrt(-2.0 * F.log(1.0 - uniform(*keys, seed=seed)))
    return radius * F.cos(2.0 * 3.141592653589793 * uniform(*keys, seed=seed + 1))


def drawn(*keys: str | Column, seed: int = 0) -> Column:
    """A repeatable number in [0, 1) for each key from a digest's first 52 bits, the same in any SQL engine."""
    text = F.concat_ws(":", *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long").cast("double") / float(1 << 52)


def drawn_normal(*keys: str | Column, seed: int = 0) -> Column:
    """A repeatable standard normal number for each key (Box-Muller on drawn numbers of seed and seed + 1)."""
    return F.sqrt(-2.0 * F.log(1.0 - drawn(*keys, seed=seed))) * F.cos(2.0 * 3.141592653589793 * drawn(*keys, seed=seed + 1))


def _shifted(rows: DataFrame, name: str) -> DataFrame:
    """Stored range partitions, numbered inside by _at, with their global place: one row a partition is collected."""
    sizes = sorted((r["_part"], r["n"]) for r in rows.groupBy("_part").agg(F.count("*").alias("n")).collect())
    offsets, total = [], 0
    for part, n in sizes:
        offsets.append((part, total))
        total += n
    shift = rows.sparkSession.createDataFrame(offsets or [(0, 0)], "_part int, _shift long")
    return rows.join(F.broadcast(shift), "_part").withColumn(name, F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def _in_ranges(df: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    cols = [F.col(c) for c in order]
    rows = df.repartitionByRange(*([parts] if parts else []), *cols).sortWithinPartitions(*cols)
    return stored(rows.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)))


def placed(df: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """df with its 0-based place in the global order of `order`, which tells all rows apart: whole rows are ranged, none is joined back."""
    return _shifted(_in_ranges(df, order), name)


def running(rows: DataFrame, keys: list[str], sums: dict[str, Column | str]) -> DataFrame:
    """Rows of stored range partitions (_part) with, for each key, the sums over the partitions before: one row a key and partition is windowed."""
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    each = rows.groupBy(*keys, "_part").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    each = each.select(*keys, "_part", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in sums])
    return with_stats(rows, each, [*keys, "_part"])


def ranges(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """df stored in range partitions by order, with the partition's number as _part; rows of equal order lie in one."""
    return stored(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


#: Rows of one range partition that numbered() sorts.
RANGE_ROWS = 500_000


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """df with its 0-based place by order within keys, ties in any order: however large a key, no task holds it whole.

    The number of range partitions follows that of the rows; they are sorted and numbered as they are stored, and the places are
    shifted by one row a key and partition: no window runs over the rows."""
    n = df.count()
    parts = max(-(-n // RANGE_ROWS), min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-10 * n // RANGE_ROWS)), 1)
    rows = _in_ranges(df, [*keys, *order], parts)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    each = rows.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    each = each.select(*keys, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return with_stats(rows, each, [*keys, "_part"]).withColumn(name, (F.col("_at") + F.col("_shift")).cast("long")).drop("_part", "_at", "_shift")


def ranked(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """df with its 0-based place in the global order of distinct keys `order`.

    Range partitions are numbered inside, then shifted by the sizes of those before: no single task sees all rows."""
    return df.join(_shifted(_in_ranges(df.select(*order).distinct(), order), name), order)
