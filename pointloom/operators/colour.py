"""Colour arithmetic on columns r, g, b in 0..255."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _clip(c: Column) -> Column:
    return F.greatest(F.least(c, F.lit(255.0)), F.lit(0.0))


def gray(r: str = "r", g: str = "g", b: str = "b") -> Column:
    return F.lit(0.2989) * F.col(r) + F.lit(0.587) * F.col(g) + F.lit(0.114) * F.col(b)


def normalise(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c) / 255 for c in "rgb"})


def grayscale(df: DataFrame) -> DataFrame:
    g = gray()
    return df.withColumns({c: g for c in "rgb"})


def brightness(df: DataFrame, factor: float) -> DataFrame:
    return df.withColumns({c: _clip(F.col(c) * factor) for c in "rgb"})


def contrast(df: DataFrame, factor: float, scene: str = "scene") -> DataFrame:
    """Blend with the scene's mean grey."""
    m = df.groupBy(scene).agg(F.avg(gray()).alias("_m"))
    return df.join(m, scene).withColumns({c: _clip(F.col(c) * factor + F.col("_m") * (1 - factor)) for c in "rgb"}).drop("_m")


def saturation(df: DataFrame, factor: float) -> DataFrame:
    g = gray()
    return df.withColumns({c: _clip(F.col(c) * factor + g * (1 - factor)) for c in "rgb"})


def auto_contrast(df: DataFrame, scene: str = "scene", blend: float = 1.0) -> DataFrame:
    """Each channel stretched over 0..255 within the scene; a flat channel is unchanged."""
    span = df.groupBy(scene).agg(*[f(c).alias(f"_{n}{c}") for c in "rgb" for n, f in (("lo", F.min), ("hi", F.max))])
    one = lambda c: F.when(F.col(f"_hi{c}") > F.col(f"_lo{c}"), (F.col(c) - F.col(f"_lo{c}")) * 255 / (F.col(f"_hi{c}") - F.col(f"_lo{c}"))).otherwise(F.col(c))
    return df.join(span, scene).withColumns({c: F.col(c) * (1 - blend) + one(c) * blend for c in "rgb"}).select(*df.columns)


def rgb_to_hsv(df: DataFrame) -> DataFrame:
    """Adds h, s, v; h and s in [0, 1], v in 0..255."""
    r, g, b = (F.col(c).cast("double") for c in "rgb")
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    d = hi - lo
    h = F.when(d == 0, 0.0).when(hi == r, (g - b) / d).when(hi == g, 2.0 + (b - r) / d).otherwise(4.0 + (r - g) / d)
    return df.withColumns({"h": F.pmod(h / 6.0, F.lit(1.0)), "s": F.when(hi > 0, d / hi).otherwise(0.0), "v": hi})


def hsv_to_rgb(df: DataFrame) -> DataFrame:
    """r, g, b from h, s, v."""
    i = F.floor(F.col("h") * 6)
    f = F.col("h") * 6 - i
    v, s = F.col("v"), F.col("s")
    p, q, t = v * (1 - s), v * (1 - f * s), v * (1 - (1 - f) * s)
    k = F.pmod(i, F.lit(6))
    pick = lambda *o: F.element_at(F.array(*o), (k + 1).cast("int"))
    return df.withColumns({"r": pick(v, q, p, p, t, v), "g": pick(t, v, v, q, p, p), "b": pick(p, p, t, v, v, q)})


def hue_shift(df: DataFrame, shift: float) -> DataFrame:
    """Hue turned by shift (a share of the circle)."""
    cols = df.columns
    return hsv_to_rgb(rgb_to_hsv(df).withColumn("h", F.pmod(F.col("h") + shift, F.lit(1.0)))).select(*cols)


def standardised(df: DataFrame, mean: tuple[float, float, float], std: tuple[float, float, float]) -> DataFrame:
    """Channels over 255, less their mean, by their deviation."""
    return df.withColumns({c: (F.col(c) / 255 - m) / d for c, m, d in zip("rgb", mean, std)})
