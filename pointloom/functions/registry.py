"""Operators by name, pipelines of them, and their SQL faces."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from pointloom.operators import colour, geometry, labels, raster, tiles, voxel

OPS: dict[str, Callable[..., DataFrame]] = {}


def operator(name: str, f: Callable[..., DataFrame] | None = None):
    """Registers f (or the decorated function) under a name; a name is given once."""

    def put(g):
        if name in OPS:
            raise KeyError(f"operator {name!r} is there already")
        OPS[name] = g
        return g

    return put(f) if f else put


for _module in (voxel, geometry, tiles, raster, labels, colour):
    for _name, _f in vars(_module).items():
        if callable(_f) and getattr(_f, "__module__", "") == _module.__name__ and not _name.startswith("_") and _name.islower():
            OPS[f"{_module.__name__.rsplit('.', 1)[1]}.{_name}"] = _f


def build(step: dict) -> Callable[[DataFrame], DataFrame]:
    """A step from {"type": name, **parameters}."""
    given = dict(step)
    f = OPS[given.pop("type")]
    return lambda df: f(df, **given)


def compose(steps: list[dict | Callable[[DataFrame], DataFrame]]) -> Callable[[DataFrame], DataFrame]:
    """One function that applies all steps in order."""
    fs = [s if callable(s) else build(s) for s in steps]
    return lambda df: reduce(lambda d, f: d.transform(f), fs, df)


def merge_config(base: dict, over: dict) -> dict:
    """over laid on base, level by level; {"_delete_": True} replaces a level, dotted keys reach into levels."""
    out = dict(base)
    for key, value in over.items():
        if "." in key:
            head, rest = key.split(".", 1)
            out[head] = merge_config(out.get(head, {}), {rest: value})
        elif isinstance(value, dict):
            plain = {k: v for k, v in value.items() if k != "_delete_"}
            out[key] = plain if value.get("_delete_") or not isinstance(out.get(key), dict) else merge_config(out[key], plain)
        else:
            out[key] = value
    return out


def register_sql(spark: SparkSession) -> None:
    """SQL functions: z_order(gx, gy, gz), and covering_tiles(v, low, size, step) as a table function."""
    from pyspark.sql.functions import udtf

    spark.sql("create or replace temporary function z_part(v bigint) returns bigint return aggregate(sequence(0, 15), 0L, (s, i) -> s | shiftleft(shiftright(v, i) & 1L, 3 * i))")
    spark.sql("create or replace temporary function z_order(gx bigint, gy bigint, gz bigint) returns bigint return shiftleft(z_part(gx), 2) | shiftleft(z_part(gy), 1) | z_part(gz)")

    @udtf(returnType="tile: bigint")
    class CoveringTiles:
        def eval(self, v: float, low: float, size: float, step: float):
            first = max(0, int((v - low - size) // step) + 1)
            for t in range(first, int((v - low) // step) + 1):
                yield (t,)

    spark.udtf.register("covering_tiles", CoveringTiles)
