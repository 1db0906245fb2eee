"""Bird's-eye-view projections, raster neighbourhoods and merging of class scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIXEL = ["px", "py"]


def pixels(df: DataFrame, size: float) -> DataFrame:
    return df.withColumns({"px": F.floor(F.col("x") / size), "py": F.floor(F.col("y") / size)})


def top_z(df: DataFrame, size: float, columns: list[str], order: str = "pid", keys: list[str] | None = None) -> DataFrame:
    """Per pixel the columns of the highest point, the first in order on a tie; z of -1000 or less never counts."""
    first = F.max_by(F.struct("z", *columns), F.struct(F.col("z"), -F.col(order)))
    return pixels(df, size).where("z > -1000").groupBy(*(keys or []), *PIXEL).agg(first.alias("_t")).select(*(keys or []), *PIXEL, "_t.*")


def majority(df: DataFrame, size: float, label: str, order: str = "pid", keys: list[str] | None = None) -> DataFrame:
    """Per pixel the most common label of 0 or more, the first met on a tie."""
    k = [*(keys or []), *PIXEL]
    by = pixels(df, size).where(F.col(label) >= 0).groupBy(*k, label).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    return by.groupBy(*k).agg(F.max_by(F.struct(label, "n"), F.struct(F.col("n"), -F.col("_first"))).alias("_t")).select(*k, "_t.*")


def overlay_accuracy(df: DataFrame, size: float, label: str = "segment") -> DataFrame:
    """How many points carry the label of their pixel's highest point."""
    top = top_z(df, size, [label]).select(*PIXEL, F.col(label).alias("_top"))
    hit = pixels(df, size).join(top, PIXEL).select((F.col(label) == F.col("_top")).cast("long").alias("_hit"))
    return hit.agg(F.count("*").alias("n"), F.sum("_hit").alias("same"), F.round(F.avg("_hit"), 6).alias("share"))


def overlay_count(df: DataFrame, size: float) -> DataFrame:
    """Points beyond the first of every pixel."""
    n = pixels(df, size).groupBy(*PIXEL).agg(F.count("*").alias("_n"))
    return n.agg(F.sum("_n").alias("points"), F.count("*").alias("pixels"), (F.sum("_n") - F.count("*")).alias("hidden"))


def neighbourhood(raster: DataFrame, reach: int = 1, shape: str = "square") -> DataFrame:
    """A row for each pixel and each neighbour within reach that exists: values go to the neighbours' pixels."""
    offsets = [(dx, dy) for dx in range(-reach, reach + 1) for dy in range(-reach, reach + 1) if shape == "square" or dx * dx + dy * dy <= reach * reach]
    moves = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in offsets]))
    return raster.withColumn("_m", moves).withColumns({"px": F.col("px") + F.col("_m.dx"), "py": F.col("py") + F.col("_m.dy"), "dx": -F.col("_m.dx"), "dy": -F.col("_m.dy")}).drop("_m")


def smooth(raster: DataFrame, value: str, reach: int = 1, how: str = "mean") -> DataFrame:
    """Mean, least or largest value around every existing pixel (missing neighbours do not count)."""
    f = {"mean": F.avg, "min": F.min, "max": F.max}[how]
    near = neighbourhood(raster.select(*PIXEL, value), reach).groupBy(*PIXEL).agg(f(value).alias(value))
    return raster.select(*PIXEL).join(near, PIXEL)


def complete(raster: DataFrame, value: str, rounds: int = 3, how: str = "max") -> DataFrame:
    """Fills pixels without a row inside the raster's box from their neighbours, round by round."""
    box = raster.agg(F.min("px").alias("_a"), F.max("px").alias("_b"), F.min("py").alias("_c"), F.max("py").alias("_d"))
    out = raster.select(*PIXEL, value)
    f = {"mean": F.avg, "max": F.max}[how]
    for _ in range(rounds):
        near = neighbourhood(out).groupBy(*PIXEL).agg(f(value).alias(value)).crossJoin(F.broadcast(box))
        near = near.where(F.col("px").between(F.col("_a"), F.col("_b")) & F.col("py").between(F.col("_c"), F.col("_d"))).select(*PIXEL, value)
        out = out.unionByName(near.join(out, PIXEL, "left_anti"))
    return out


def dilate(mask: DataFrame, reach: int = 1, shape: str = "square") -> DataFrame:
    """Pixels within reach of a pixel of the mask."""
    return neighbourhood(mask.select(*PIXEL), reach, shape).select(*PIXEL).distinct()


def erode(mask: DataFrame, reach: int = 1, shape: str = "square", box: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Pixels of the mask all of whose neighbours within reach are in it; what lies outside box (x0, x1, y0, y1) is neutral."""
    near = neighbourhood(mask.select(*PIXEL), reach, shape).groupBy(*PIXEL).agg(F.count("*").alias("_n"))
    offsets = [(dx, dy) for dx in range(-reach, reach + 1) for dy in range(-reach, reach + 1) if shape == "square" or dx * dx + dy * dy <= reach * reach]
    need: Column = F.lit(len(offsets))
    if box:
        inside = [F.when((F.col("px") + dx).between(box[0], box[1]) & (F.col("py") + dy).between(box[2], box[3]), 1).otherwise(0) for dx, dy in offsets]
        need = sum(inside[1:], inside[0])
    return mask.select(*PIXEL).join(near, PIXEL).where(F.col("_n") >= need).select(*PIXEL)


def close(mask: DataFrame, reach: int = 1, shape: str = "square") -> DataFrame:
    return erode(dilate(mask, reach, shape), reach, shape)


def open_(mask: DataFrame, reach: int = 1, shape: str = "square") -> DataFrame:
    return dilate(erode(mask, reach, shape), reach, shape)


def kernel(raster: DataFrame, value: str, weights: dict[tuple[int, int], float]) -> DataFrame:
    """Weighted sum over the neighbours at the given offsets; missing ones count 0."""
    w = F.create_map(*[x for (dx, dy), v in weights.items() for x in (F.lit(f"{dx},{dy}"), F.lit(float(v)))])
    reach = max(max(abs(dx), abs(dy)) for dx, dy in weights)
    near = neighbourhood(raster.select(*PIXEL, value), reach).withColumn("_w", w[F.concat_ws(",", "dx", "dy")]).where("_w is not null")
    return near.groupBy(*PIXEL).agg(F.sum(F.col("_w") * F.col(value)).alias(value)).join(raster.select(*PIXEL), PIXEL, "left_semi")


#: 3 x 3 kernels by offset (dx, dy).
LAPLACE = {(0, 0): -4, (1, 0): 1, (-1, 0): 1, (0, 1): 1, (0, -1): 1}
SOBEL_X = {(-1, -1): -1, (1, -1): 1, (-1, 0): -2, (1, 0): 2, (-1, 1): -1, (1, 1): 1}
SOBEL_Y = {(-1, -1): -1, (-1, 1): 1, (0, -1): -2, (0, 1): 2, (1, -1): -1, (1, 1): 1}


def gaussian(size: int) -> dict[tuple[int, int], float]:
    """A normalised kernel of odd size, sigma by the usual rule 0.3 * ((size - 1) / 2 - 1) + 0.8."""
    import math

    sigma, r = 0.3 * ((size - 1) * 0.5 - 1) + 0.8, size // 2
    w = {(dx, dy): math.exp(-(dx * dx + dy * dy) / (2 * sigma * sigma)) for dx in range(-r, r + 1) for dy in range(-r, r + 1)}
    return {k: v / sum(w.values()) for k, v in w.items()}


def curvature(raster: DataFrame, value: str) -> DataFrame:
    """Absolute difference of every pixel and the mean around it."""
    mean = smooth(raster, value).withColumnRenamed(value, "_mean")
    return raster.join(mean, PIXEL).select(*PIXEL, F.abs(F.col(value) - F.col("_mean")).alias("curvature"))


def mode_pool(raster: DataFrame, label: str) -> DataFrame:
    """The most common label of the 3 x 3 window, the largest on a tie."""
    by = neighbourhood(raster.select(*PIXEL, label)).groupBy(*PIXEL, label).agg(F.count("*").alias("_n"))
    return by.groupBy(*PIXEL).agg(F.max_by(label, F.struct("_n", label)).alias(label)).join(raster.select(*PIXEL), PIXEL, "left_semi")


def max_count_pool(raster: DataFrame, label: str) -> DataFrame:
    """The commonest label of every pixel's 3 x 3 window, the largest one on a tie; pixels without a point stay out."""
    near = [F.struct((F.col("px") + a).alias("px"), (F.col("py") + b).alias("py")) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    votes = raster.select(F.explode(F.array(*near)).alias("p"), label).groupBy("p.px", "p.py", label).agg(F.count("*").alias("_n"))
    best = votes.groupBy("px", "py").agg(F.max(F.struct("_n", label)).alias("_b")).select("px", "py", F.col(f"_b.{label}").alias(label))
    return best.join(raster.select("px", "py"), ["px", "py"], "left_semi")


def fill_stats(raster: DataFrame, label: str) -> DataFrame:
    """Pixels of every label and their share of the raster's box."""
    box = raster.agg(((F.max("px") - F.min("px") + 1) * (F.max("py") - F.min("py") + 1)).alias("_all"))
    by = raster.groupBy(label).agg(F.count("*").alias("n")).crossJoin(F.broadcast(box))
    return by.select(label, "n", F.round(100.0 * F.col("n") / F.col("_all"), 6).alias("percent"))


def softmax(scores: str | Column) -> Column:
    a = F.col(scores) if isinstance(scores, str) else scores
    e = F.transform(a, lambda v: F.exp(v - F.array_max(a)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda s, w: s + w))


def argmax(scores: str | Column) -> Column:
    """Place of the largest score, the first on a tie."""
    a = F.col(scores) if isinstance(scores, str) else scores
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def merge_weighted(df: DataFrame, bev: str, cloud: str, alpha: float = 0.5) -> DataFrame:
    """Label of alpha * softmax(bev) + (1 - alpha) * softmax(cloud)."""
    mixed = F.zip_with(softmax(bev), softmax(cloud), lambda a, b: alpha * a + (1 - alpha) * b)
    return df.withColumn("label", argmax(mixed))


def merge_confidence(df: DataFrame, bev: str, cloud: str) -> DataFrame:
    """The cloud's label where it is strictly more confident, else the bev's."""
    return df.withColumn("label", F.when(F.array_max(softmax(cloud)) > F.array_max(softmax(bev)), argmax(cloud)).otherwise(argmax(bev)))


def merge_priority(df: DataFrame, bev: str, cloud: str, threshold: float = 0.7) -> DataFrame:
    """The cloud's label where its confidence is strictly over threshold, else the bev's."""
    return df.withColumn("label", F.when(F.array_max(softmax(cloud)) > threshold, argmax(cloud)).otherwise(argmax(bev)))


def fill_holes(mask: DataFrame, margin: int = 1) -> DataFrame:
    """The mask with the background it encloses: background that 4-connects to the outside of its box stays out."""
    from pointloom.operators.components import components

    box = mask.agg(*[f(c).alias(f"{n}{c}") for c in PIXEL for n, f in (("lo", F.min), ("hi", F.max))]).first()
    if box["lopx"] is None:
        return mask.select(*PIXEL)
    x0, x1, y0, y1 = (int(v) for v in (box["lopx"] - margin, box["hipx"] + margin, box["lopy"] - margin, box["hipy"] + margin))
    grid = mask.sparkSession.range(x0, x1 + 1).select(F.col("id").alias("px")).withColumn("py", F.explode(F.sequence(F.lit(y0).cast("long"), F.lit(y1).cast("long"))))
    back = grid.join(mask.select(*PIXEL), PIXEL, "left_anti").withColumn("node", (F.col("px") - x0) * (y1 - y0 + 1) + F.col("py") - y0)
    right = back.select((F.col("px") + 1).alias("px"), "py", F.col("node").alias("v"))
    up = back.select("px", (F.col("py") + 1).alias("py"), F.col("node").alias("v"))
    edges = back.join(right, PIXEL).select(F.col("node").alias("u"), "v").unionByName(back.join(up, PIXEL).select(F.col("node").alias("u"), "v"))
    comp = components(edges)
    outside = 0  # the box's corner is background by the margin, and its node is the least
    holes = back.join(comp, "node", "left").where(F.coalesce("component", "node") != outside).select(*PIXEL)
    return mask.select(*PIXEL).unionByName(holes)
