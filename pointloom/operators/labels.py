"""Label, colour, path and mask-run operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.operators.common import numbered


def learning_map(df: DataFrame, mapping: dict[int, int], label: str, to: str, default: int = -1) -> DataFrame:
    """Many-to-one relabelling; labels without an entry become default."""
    table = F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])
    return df.withColumn(to, F.coalesce(table[F.col(label)], F.lit(default)))


def inverse_learning_map(mapping: dict[int, int]) -> dict[int, int]:
    """The least raw label of every mapped one."""
    out: dict[int, int] = {}
    for raw, to in sorted(mapping.items(), reverse=True):
        out[to] = raw
    return out


def mapping_filter(df: DataFrame, table: DataFrame, name: str, to: str) -> DataFrame:
    """Class names by table (name, to): 'None' drops the row, null keeps the name."""
    out = df.join(table.select(F.col(name).alias("_n"), F.col(to).alias("_t"), F.lit(True).alias("_hit")), F.col(name) == F.col("_n"), "left")
    new = F.when(F.col("_t").isNull(), F.col(name)).when(F.col("_t") == "None", None).otherwise(F.col("_t"))
    return out.withColumn("class", new).where("class is not null").drop("_n", "_t", "_hit")


def colour_map(df: DataFrame, palette: dict[int, tuple[int, int, int]], label: str, default: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    """Adds r, g, b of each label."""
    table = F.create_map(*[x for k, rgb in palette.items() for x in (F.lit(k), F.array(*[F.lit(v) for v in rgb]))])
    rgb = F.coalesce(table[F.col(label)], F.array(*[F.lit(v) for v in default]))
    return df.withColumn("_rgb", rgb).withColumns({c: F.col("_rgb")[i] for i, c in enumerate("rgb")}).drop("_rgb")


def colour_decode(df: DataFrame, palette: dict[int, tuple[int, int, int]], default: int = -1, tolerance: int = 0) -> DataFrame:
    """Adds label: that of the first palette colour within tolerance of r, g, b."""
    label: Column = F.lit(default)
    for k, rgb in sorted(palette.items(), reverse=True):
        near = F.lit(True)
        for c, v in zip("rgb", rgb):
            near = near & (F.abs(F.col(c) - v) <= tolerance)
        label = F.when(near, k).otherwise(label)
    return df.withColumn("label", label)


def merge_classes(df: DataFrame, merge: dict[int, list[int]], label: str, to: str) -> DataFrame:
    """Labels of each list become its target."""
    return learning_map(df, {s: t for t, sources in merge.items() for s in sources}, label, "_m", -(1 << 30)).withColumn(to, F.when(F.col("_m") == -(1 << 30), F.col(label)).otherwise(F.col("_m"))).drop("_m")


def unique_colours(df: DataFrame, columns: list[str], least: int = 1) -> DataFrame:
    """Distinct values with their counts, of at least `least` rows, most common first."""
    return df.groupBy(*columns).agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), *columns)


def class_params(df: DataFrame, given: DataFrame, defaults: dict[str, float], key: str) -> DataFrame:
    """Parameters of every class: its own value, else the default."""
    out = df.join(given, key, "left")
    return out.withColumns({k: F.coalesce(F.col(k), F.lit(v)) if k in given.columns else F.lit(v) for k, v in defaults.items()})


def runs(df: DataFrame, keys: list[str], order: str, mask: str) -> DataFrame:
    """Runs of the mask's ones: 1-based start and length, by order within keys (order counts from 1 without gaps)."""
    ones = numbered(df.where(F.col(mask) == 1).select(*keys, order), keys, [order], "_nth")
    return ones.groupBy(*keys, (F.col(order) - F.col("_nth")).alias("_g")).agg(F.min(order).alias("start"), F.count("*").alias("length")).drop("_g")


def instances(df: DataFrame, instance: str, label: str, keys: list[str]) -> DataFrame:
    """Box, centre and label (of the least pid) of every instance, with compact numbers per keys."""
    by = df.where(F.col(instance) >= 0).groupBy(*keys, instance).agg(
        F.count("*").alias("n"), F.min_by(label, "pid").alias(label), *[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))],
    )
    number = (F.dense_rank().over(Window.partitionBy(*keys).orderBy(instance)) - 1).cast("long")  # one row an instance
    return by.withColumn("number", number)


def path_parts(df: DataFrame, column: str) -> DataFrame:
    """Adds base (last part), stem (without its suffix) and parent of a path."""
    parts = F.split(F.col(column), "/")
    base = F.element_at(parts, -1)
    return df.withColumns({"base": base, "stem": F.regexp_replace(base, r"\.[^.]*$", ""), "parent": F.when(F.size(parts) > 1, F.element_at(parts, -2))})


def tile_name(df: DataFrame, column: str) -> DataFrame:
    """Adds city, block, tile_x, tile_y, kind of names city_block_x_y_kind."""
    p = F.split(F.col(column), "_")
    return df.withColumns({"city": p[0], "block": p[1], "tile_x": F.expr(f"try_cast(get(split({column}, '_'), 2) as int)"), "tile_y": F.expr(f"try_cast(get(split({column}, '_'), 3) as int)"), "kind": F.get(p, 4)})


def face_votes(faces: DataFrame) -> DataFrame:
    """Label of every vertex by its faces (face, label, vertices): the most common, the least on a tie."""
    by = faces.select("label", F.explode("vertices").alias("vertex")).groupBy("vertex", "label").agg(F.count("*").alias("_n"))
    return by.groupBy("vertex").agg(F.max_by("label", F.struct(F.col("_n"), -F.col("label"))).alias("label"))


def hex_classes(df: DataFrame, mapping: dict[str, int], default: int = -1) -> DataFrame:
    """label: the class of a point's colour by its #rrggbb name."""
    name = F.lower(F.concat(F.lit("#"), *[F.lpad(F.hex(F.col(c).cast("int")), 2, "0") for c in "rgb"]))
    table = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k.lower()), F.lit(v))])
    return df.withColumn("label", F.coalesce(table[name], F.lit(default)))
