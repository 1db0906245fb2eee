"""Segmentation and instance metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.operators.common import ranges, running, with_stats


def confusion(df: DataFrame, classes: int, keys: list[str] | None = None, gt: str = "gt", pred: str = "pred") -> DataFrame:
    """Counts of (gt, pred) for valid pairs; both are range-checked."""
    ok = F.col(gt).between(0, classes - 1) & F.col(pred).between(0, classes - 1)
    return df.where(ok).groupBy(*(keys or []), F.col(gt).alias("gt"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def class_counts(df: DataFrame, classes: int, keys: list[str] | None = None, gt: str = "gt", pred: str = "pred") -> DataFrame:
    """intersection, target and predicted of every class that occurs, from one pass."""
    k = keys or []
    cells = confusion(df, classes, k, gt, pred)
    sides = cells.select(*k, F.explode(F.array(
        F.struct(F.col("gt").alias("class"), F.col("n").alias("target"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("gt") == F.col("pred"), F.col("n")).otherwise(0).alias("intersection")),
        F.struct(F.col("pred").alias("class"), F.lit(0).cast("long").alias("target"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("intersection")),
    )).alias("s")).select(*k, "s.*")
    return sides.groupBy(*k, "class").agg(*[F.sum(c).alias(c) for c in ("intersection", "target", "predicted")])


def iou(counts: DataFrame, eps: float = 1e-10) -> DataFrame:
    """Adds union, iou and acc to class counts; eps goes to the denominators."""
    c = counts.withColumn("union", F.col("target") + F.col("predicted") - F.col("intersection"))
    return c.withColumns({"iou": F.col("intersection") / (F.col("union") + eps), "acc": F.col("intersection") / (F.col("target") + eps)})


def summary(counts: DataFrame, classes: int, eps: float = 1e-10) -> DataFrame:
    """mIoU and mAcc over all classes, absent ones counting 0, overall accuracy, frequency-weighted IoU."""
    i = iou(counts, eps).withColumn("_f", F.col("target") / F.sum("target").over(Window.partitionBy(F.lit(0))))  # one row a class
    return i.agg(
        F.round(F.sum("iou") / classes, 6).alias("miou"), F.round(F.sum("acc") / classes, 6).alias("macc"),
        F.round(F.sum("intersection") / F.sum("target"), 6).alias("all_acc"), F.round(F.sum(F.col("_f") * F.col("iou")), 6).alias("fwiou"),
    )


def iou_present(counts: DataFrame) -> DataFrame:
    """IoU of every class, null where it is absent from the ground truth."""
    c = counts.withColumn("union", F.col("target") + F.col("predicted") - F.col("intersection"))
    return c.select("class", F.when(F.col("target") > 0, F.col("intersection") / F.greatest("union", F.lit(1))).alias("iou"))


def fold_rollup(df: DataFrame, classes: int, fold: str) -> DataFrame:
    """Class counts of every fold and of all together (fold null), and their IoU."""
    per = class_counts(df, classes, [fold])
    sums = per.rollup("class", fold).agg(*[F.sum(c).alias(c) for c in ("intersection", "target", "predicted")]).where("class is not null")
    return iou(sums)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """1 / ln(1.02 + frequency) of every label."""
    n = df.groupBy(label).agg(F.count("*").alias("n"))
    return n.withColumn("weight", 1.0 / F.log(1.02 + F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))))  # one row a label


def lovasz(df: DataFrame, keys: list[str], error: str, truth: str, order: str) -> DataFrame:
    """Sum over points by falling error of error times the step of the Jaccard loss, per key.

    Points are cumulated in range partitions by falling error, which start from the sums of those before."""
    total = df.groupBy(*keys).agg(F.sum(truth).alias("_all"))
    rows = running(ranges(df, [*keys, F.desc(error), order]), keys, {"_hits": truth, "_misses": 1 - F.col(truth)})
    w = Window.partitionBy(*keys, "_part").orderBy(F.desc(error), order).rowsBetween(Window.unboundedPreceding, 0)
    rows = with_stats(rows, total, keys).withColumns({"_h": F.sum(truth).over(w) + F.col("_hits"), "_m": F.sum(1 - F.col(truth)).over(w) + F.col("_misses")})
    loss = lambda h, m: 1.0 - (F.col("_all") - h) / (F.col("_all") + m)
    h, m = F.col("_h") - F.col(truth), F.col("_m") - (1 - F.col(truth))  # of the points before
    rows = rows.withColumn("_g", loss(F.col("_h"), F.col("_m")) - F.when(h + m > 0, loss(h, m)).otherwise(0.0))
    return rows.groupBy(*keys).agg(F.sum(F.col(error) * F.col("_g")).alias("loss"))


def precision_recall(df: DataFrame, score: str, truth: str, keys: list[str] | None = None) -> DataFrame:
    """Precision and recall at every distinct score, from the highest down."""
    k = keys or []
    by = df.groupBy(*k, score).agg(F.sum(truth).alias("_t"), F.count("*").alias("_n"))
    run = Window.partitionBy(*k).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    by = by.withColumns({"tp": F.sum("_t").over(run), "seen": F.sum("_n").over(run), "_all": F.sum("_t").over(Window.partitionBy(*k))})
    return by.select(*k, score, "tp", "seen", (F.col("tp") / F.col("seen")).alias("precision"), F.when(F.col("_all") > 0, F.col("tp") / F.col("_all")).alias("recall"))


def cross_entropy(df: DataFrame, scores: str, gt: str, ignore: int = -1, smoothing: float = 0.0) -> DataFrame:
    """Mean cross entropy over points with a label, optionally smoothed over the classes."""
    from pointloom.operators.raster import softmax

    p = softmax(scores)
    own = -F.log(F.greatest(F.element_at(p, F.col(gt) + 1), F.lit(1e-12)))
    every = F.aggregate(p, F.lit(0.0), lambda s, v: s - F.log(F.greatest(v, F.lit(1e-12)))) / F.size(p)
    return df.where(F.col(gt) != ignore).agg(F.avg((1 - smoothing) * own + smoothing * every).alias("loss"), F.count("*").alias("n"))


def instance_association(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """Common points, sizes and IoU of ground-truth (instance, label, pid) and predicted (mask, label, pid) instances of one label."""
    both = gt.join(pred, ["pid", "label"]).groupBy("instance", "mask", "label").agg(F.count("*").alias("both"))
    g = gt.groupBy("instance").agg(F.count("*").alias("n_gt"))
    p = pred.groupBy("mask").agg(F.count("*").alias("n_pred"))
    out = both.join(g, "instance").join(p, "mask")
    return out.withColumn("iou", F.col("both") / (F.col("n_gt") + F.col("n_pred") - F.col("both")))


def average_precision(association: DataFrame, scored: DataFrame, gt_counts: DataFrame, overlaps: list[float]) -> DataFrame:
    """AP per label and overlap: predictions by falling score take the best free instance over the overlap.

    Greedy matching runs per label and overlap over instance pairs, not points."""
    import pandas as pd

    levels = F.explode(F.array(*[F.lit(o) for o in overlaps])).alias("overlap")
    pairs = scored.join(association.select("mask", "instance", "iou"), "mask", "left").select("label", "mask", "score", "instance", "iou", levels)
    rows = pairs.join(gt_counts, "label")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        total, level = int(pdf["instances"].iloc[0]), float(pdf["overlap"].iloc[0])
        taken: set = set()
        hits = []
        for (_, mask), part in pdf.sort_values(["score", "mask"], ascending=[False, True]).groupby(["score", "mask"], sort=False):
            part = part[(part["iou"] > level) & ~part["instance"].isin(taken)].sort_values(["iou", "instance"], ascending=[False, True])
            hits.append(len(part) > 0)
            if len(part):
                taken.add(part["instance"].iloc[0])
        tp, ap, best = 0, 0.0, []
        for i, h in enumerate(hits, 1):
            tp += h
            best.append((tp / i, h))
        top = 0.0
        for precision, h in reversed(best):
            top = max(top, precision)
            ap += top * h
        return pd.DataFrame({"label": [pdf["label"].iloc[0]], "overlap": [level], "ap": [ap / total if total else None]})

    return rows.groupBy("label", "overlap").applyInPandas(run, "label int, overlap double, ap double")


def focal(df: DataFrame, scores: str, gt: str, gamma: float = 2.0, alpha: float = 0.5, ignore: int = -1) -> DataFrame:
    """Mean focal loss of sigmoid scores against one-hot labels, over points with a label and all classes."""

    def one(v, i):
        hit = i == F.col(gt)
        p = 1.0 / (1.0 + F.exp(-v))
        miss = F.when(hit, 1.0 - p).otherwise(p)
        entropy = -F.log(F.greatest(1.0 - miss, F.lit(1e-12)))
        return F.when(hit, alpha).otherwise(1 - alpha) * F.pow(miss, F.lit(gamma)) * entropy

    each = F.aggregate(F.transform(scores, one), F.lit(0.0), lambda a, b: a + b) / F.size(scores)
    return df.where(F.col(gt) != ignore).agg(F.avg(each).alias("loss"), F.count("*").alias("n"))


def dice(df: DataFrame, scores: str, gt: str, smooth: float = 1.0, exponent: float = 2.0, ignore: int = -1) -> DataFrame:
    """Dice loss of every class from softmax scores: 1 - (2 sum(p t) + smooth) / (sum(p^e + t^e) + smooth)."""
    from pointloom.operators.raster import softmax

    rows = df.where(F.col(gt) != ignore).select(F.col(gt).alias("gt"), F.posexplode(softmax(scores)).alias("class", "p"))
    hit = F.when(F.col("gt") == F.col("class"), 1.0).otherwise(0.0)
    sums = rows.groupBy("class").agg(F.sum(F.col("p") * hit).alias("both"), F.sum(F.pow("p", F.lit(exponent)) + hit).alias("all"))
    return sums.select("class", (1.0 - (2.0 * F.col("both") + smooth) / (F.col("all") + smooth)).alias("loss"))


def part_iou(df: DataFrame, category: str, item: str, gt: str = "gt", pred: str = "pred") -> DataFrame:
    """Per category: mean over its items of their mean IoU over the category's parts, 1 for a part absent from both; and the items.

    The parts of a category are the labels its items have."""
    cells = df.groupBy(category, item, gt, pred).agg(F.count("*").alias("n"))
    parts = cells.select(category, F.col(gt).alias("part")).distinct()
    side = lambda c: cells.groupBy(category, item, F.col(c).alias("part")).agg(F.sum("n").alias(f"n_{c}"))
    both = cells.where(F.col(gt) == F.col(pred)).select(category, item, F.col(gt).alias("part"), F.col("n").alias("both"))
    every = cells.select(category, item).distinct().join(parts, category)
    keys = [category, item, "part"]
    rows = every.join(side(gt), keys, "left").join(side(pred), keys, "left").join(both, keys, "left").na.fill(0, [f"n_{gt}", f"n_{pred}", "both"])
    union = F.col(f"n_{gt}") + F.col(f"n_{pred}") - F.col("both")
    each = rows.withColumn("iou", F.when(union == 0, 1.0).otherwise(F.col("both") / union)).groupBy(category, item).agg(F.avg("iou").alias("iou"))
    return each.groupBy(category).agg(F.avg("iou").alias("iou"), F.count("*").alias("items"))


def inverse_validity(df: DataFrame, inverse: str, bound: int) -> DataFrame:
    """Length, least and largest index of an inverse map, and the share outside 0..bound - 1."""
    out = F.when(F.col(inverse).between(0, bound - 1), 0.0).otherwise(1.0)
    return df.agg(F.count("*").alias("n"), F.min(inverse).alias("lo"), F.max(inverse).alias("hi"), F.avg(out).alias("outside"))
