"""Unions, interleaving, pair merging and differences of point sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.operators.common import with_stats


def concat(parts: list[DataFrame], loop: int = 1) -> DataFrame:
    """Union of all parts by name, repeated loop times, with the part's number as dataset."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("dataset", F.lit(i))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(loop - 1)))) if loop > 1 else out


def interleave(df: DataFrame, ratios: dict[int, int], position: str) -> DataFrame:
    """Adds turn and slot: dataset d gives ratios[d] consecutive rows of every turn."""
    r = F.create_map(*[F.lit(v) for kv in ratios.items() for v in kv])[F.col("dataset")]
    return df.withColumn("turn", F.floor(F.col(position) / r)).withColumn("slot", F.col(position) % r)


def mix_pairs(df: DataFrame, batch: str, instance: str) -> DataFrame:
    """Batches 2i and 2i + 1 become one; instances of the odd one follow those of the even one."""
    pair = df.withColumn("pair", F.floor(F.col(batch) / 2))
    top = pair.where(F.col(batch) % 2 == 0).groupBy("pair").agg(F.max(instance).alias("_top"))
    out = with_stats(pair, top, ["pair"], "left")
    shifted = F.when((F.col(batch) % 2 == 1) & (F.col(instance) >= 0), F.col(instance) + F.coalesce(F.col("_top") + 1, F.lit(0))).otherwise(F.col(instance))
    return out.withColumn(instance, shifted).drop("_top")


def without(df: DataFrame, rejected: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(rejected.select(*keys), keys, "left_anti")


def combine(parts: list[DataFrame], excluded: DataFrame, key: str) -> DataFrame:
    """Union of parts without excluded keys; of equal keys the first part's row stays."""
    rows = without(concat(parts), excluded, [key])
    rest = [c for c in rows.columns if c not in (key, "dataset")]
    return rows.groupBy(key).agg(F.min(F.struct("dataset", *rest)).alias("_r")).select(key, "_r.*")
