"""Metric, neighbour, graph, frame and feature queries over the driver tables, each with the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointloom.operators import graph, metrics, neighbors, temporal
from pointloom.plans.point_queries import query, rounded
from pointloom.sources.tables import FRAMES_SQL, POINTS_SQL, features, frames, labels, points

_LAB = "with l as (select doc_id, cast(quality as integer) as gt, cast(toxic as integer) as pred from labels)"


@query(f"{_LAB} select gt, pred, count(*) as n from l where gt between 0 and 1 and pred between 0 and 1 group by all", points_view=False)
def confusion_matrix(spark, sf):
    return metrics.confusion(labels(spark, sf), 2)


_COUNTS = """, k as (select unnest(range(6)) as class), c as (select cast(class as integer) as class, (select count(*) from points where segment = class and pred = class) as intersection,
(select count(*) from points where segment = class) as target, (select count(*) from points where pred = class) as predicted from k)"""


def _counts(spark, sf):
    return metrics.class_counts(points(spark, sf), 6, gt="segment")


@query(_COUNTS + " select *, target + predicted - intersection as \"union\", intersection / (target + predicted - intersection + 1e-10) as iou, intersection / (target + 1e-10) as acc from c")
def class_iou(spark, sf):
    return metrics.iou(_counts(spark, sf))


@query(_COUNTS + """ select round(sum(intersection / (target + predicted - intersection + 1e-10)) / 6, 6) as miou, round(sum(intersection / (target + 1e-10)) / 6, 6) as macc,
round(sum(intersection) / sum(target), 6) as all_acc, round(sum(target / (select sum(target) from c) * (intersection / (target + predicted - intersection + 1e-10))), 6) as fwiou from c""")
def seg_metrics(spark, sf):
    return metrics.summary(_counts(spark, sf), 6)


@query(_COUNTS + " select class, intersection, target, predicted, target + predicted - intersection as \"union\", intersection / (target + predicted - intersection + 0.1) as iou, intersection / (target + 0.1) as acc from c")
def miou_smooth(spark, sf):
    return metrics.iou(_counts(spark, sf), 0.1)


@query(_COUNTS + " select class, case when target > 0 then intersection / greatest(target + predicted - intersection, 1) end as iou from c")
def iou_present(spark, sf):
    return metrics.iou_present(_counts(spark, sf))


@query(""", s as (select scene, segment as class, 1 as t, 0 as p, case when segment = pred then 1 else 0 end as i from points union all select scene, pred, 0, 1, 0 from points),
g as (select class, scene, sum(i) as intersection, sum(t) as target, sum(p) as predicted from s group by rollup (class, scene) having class is not null)
select class, scene, cast(intersection as bigint) as intersection, cast(target as bigint) as target, cast(predicted as bigint) as predicted, cast(target + predicted - intersection as bigint) as "union",
intersection / (target + predicted - intersection + 1e-10) as iou, intersection / (target + 1e-10) as acc from g""")
def kfold_rollup(spark, sf):
    return metrics.fold_rollup(points(spark, sf).withColumnRenamed("segment", "gt"), 6, "scene")


@query("select segment, count(*) as n, round(1.0 / ln(1.02::double + count(*) / (select count(*) from points)), 6) as weight from points group by segment")
def class_weights(spark, sf):
    return rounded(metrics.class_weights(points(spark, sf), "segment"), ["weight"])


@query(""", e as (select scene, pid, abs(z / 10 - case when segment = 2 then 1 else 0 end) as err, case when segment = 2 then 1 else 0 end as hit from points),
r as (select scene, pid, err, hit, sum(hit) over (partition by scene) as total, sum(hit) over w as h, sum(1 - hit) over w as m from e window w as (partition by scene order by err desc, pid rows unbounded preceding)),
j as (select *, 1.0::double - (total - h) / (total + m) as j from r), g as (select *, j - coalesce(lag(j) over (partition by scene order by err desc, pid), 0) as g from j)
select scene, round(sum(err * g), 5) as loss from g group by scene""")
def lovasz(spark, sf):
    hit = F.when(F.col("segment") == 2, 1).otherwise(0)
    e = points(spark, sf).select("scene", "pid", F.abs(F.col("z") / 10 - hit).alias("err"), hit.alias("hit"))
    return rounded(metrics.lovasz(e, ["scene"], "err", "hit", "pid"), ["loss"], 5)


@query(""", d as (select scene, z, cast(sum(case when segment = 2 then 1 else 0 end) as bigint) as t, count(*) as n from points group by scene, z),
r as (select scene, z, cast(sum(t) over w as bigint) as tp, cast(sum(n) over w as bigint) as seen, sum(t) over (partition by scene) as total from d window w as (partition by scene order by z desc rows unbounded preceding))
select scene, z, tp, seen, tp / seen as precision, case when total > 0 then tp / total end as recall from r""")
def precision_recall(spark, sf):
    d = points(spark, sf).withColumn("hit", F.when(F.col("segment") == 2, 1).otherwise(0))
    return metrics.precision_recall(d, "z", "hit", ["scene"])


@query(""", s as (select pid, segment % 3 as gt, exp(x / 50 - 1) as a, exp(z / 10 - 1) as b, exp(strength - 1) as c from points)
select round(avg(-ln(greatest(case gt when 0 then a when 1 then b else c end / (a + b + c), 1e-12))), 6) as loss, count(*) as n from s""")
def cross_entropy(spark, sf):
    d = points(spark, sf).select((F.col("segment") % 3).alias("gt"), F.array(F.col("x") / 50, F.col("z") / 10, F.col("strength")).alias("scores"))
    return rounded(metrics.cross_entropy(d, "scores", "gt"), ["loss"])


@query("select avg(case when segment = pred then 1.0::double else 0 end) as accuracy, count(*) as n from points")
def overall_accuracy(spark, sf):
    return points(spark, sf).agg(F.avg((F.col("segment") == F.col("pred")).cast("double")).alias("accuracy"), F.count("*").alias("n"))


_INST = """, g as (select scene * 10 + line as instance, segment as label, pid from points), p as (select scene * 10 + case when pid % 7 = 0 then (line + 1) % 8 else line end as mask, segment as label, pid from points)"""


def _instances(spark, sf):
    p = points(spark, sf)
    moved = F.when(F.col("pid") % 7 == 0, (F.col("line") + 1) % 8).otherwise(F.col("line"))
    g = p.select((F.col("scene") * 10 + F.col("line")).alias("instance"), F.col("segment").alias("label"), "pid")
    return g, p.select((F.col("scene") * 10 + moved).alias("mask"), F.col("segment").alias("label"), "pid")


@query(_INST + """ select instance, mask, label, "both", n_gt, n_pred, "both" / (n_gt + n_pred - "both") as iou from (select instance, mask, g.label, count(*) as "both" from g join p on g.pid = p.pid and g.label = p.label group by all) b
join (select instance, count(*) as n_gt from g group by instance) using (instance) join (select mask, count(*) as n_pred from p group by mask) using (mask)""")
def instance_association(spark, sf):
    return metrics.instance_association(*_instances(spark, sf))


@query(None)
def instance_ap(spark, sf):
    g, p = _instances(spark, sf)
    a = metrics.instance_association(g, p)
    scored = p.groupBy("mask", "label").agg((F.count("*") * 1.0).alias("score"))
    per = g.groupBy("label").agg(F.countDistinct("instance").alias("instances"))
    return metrics.average_precision(a, scored, per, [0.02, 0.05, 0.1])


# neighbours

#: Points whose id is divisible by 50 ask, all points answer.
_SLICE = ", s as (select * from points), q as (select * from s where pid % 50 = 0)"


def _slice(spark, sf):
    s = points(spark, sf)
    return s.where("pid % 50 = 0"), s


#: Points by cell of the given edge, and each of them in the cells around its own.
_CELLS = """, c as (select *, cast(floor(x / {0}) as bigint) as cx, cast(floor(y / {0}) as bigint) as cy, cast(floor(z / {0}) as bigint) as cz from points), o as (select unnest([-1, 0, 1]) as i),
w as (select c.* exclude (cx, cy, cz), cx + a.i as cx, cy + b.i as cy, cz + d.i as cz from c, o a, o b, o d)"""


_D2 = "(s.x - q.x) * (s.x - q.x) + (s.y - q.y) * (s.y - q.y) + (s.z - q.z) * (s.z - q.z)"


@query(_SLICE + f""", d as (select q.scene, q.pid as qid, s.pid, {_D2} as d2 from q join s on q.scene = s.scene)
select scene, qid, pid, d2, cast(rank as integer) as rank from (select *, row_number() over (partition by qid order by d2, pid) - 1 as rank from d) where rank < 3""")
def knn_k3(spark, sf):
    q, s = _slice(spark, sf)
    return neighbors.knn(q, s, 3, 2.0)


@query(_SLICE + f", d as (select q.scene, q.pid as qid, s.pid, {_D2} as d2 from q join s on q.scene = s.scene) select * from d where d2 < 6.25")
def radius_join(spark, sf):
    q, s = _slice(spark, sf)
    return neighbors.within(q, s, 2.5)


@query(_SLICE + f""", d as (select q.scene, q.pid as qid, s.pid, {_D2} as d2 from q join s on q.scene = s.scene), f as (select *, row_number() over (partition by qid order by pid) - 1 as rn, count(*) over (partition by qid) as n from d where d2 < 9 and (d2 <= 1e-5 or d2 >= 1)),
k as (select *, case when n <= 4 then rn else cast(floor(rn * 4 / n) as bigint) end as slot from f)
select scene, qid, pid, d2, slot from k qualify row_number() over (partition by qid, slot order by rn) = 1""")
def ball_query(spark, sf):
    q, s = _slice(spark, sf)
    return neighbors.ball_query(q, s, 3.0, 4, 1.0)


@query(_SLICE + f""", d as (select q.pid as qid, s.pid, s.strength, {_D2} as d2 from q join s on q.scene = s.scene), k as (select *, 1.0 / (sqrt(d2) + 1e-8::double) as w from d qualify row_number() over (partition by qid order by d2, pid) <= 3)
select qid, round(sum(w * strength) / sum(w), 6) as strength from k group by qid""")
def idw_interpolate(spark, sf):
    q, s = _slice(spark, sf)
    return rounded(neighbors.interpolated(q, s, 3, 2.0, "strength"), ["strength"])


@query(_SLICE + f""", d as (select q.pid as qid, s.pid, {_D2} as d2 from q join s on q.scene = s.scene), k as (select sqrt(d2) as d from (select *, row_number() over (partition by qid order by d2, pid) as r from d) where r = 2)
select count(*) as n, min(d) as least, max(d) as most, round(avg(d), 6) as mean, round(quantile_cont(d, 0.5), 6) as p50, round(quantile_cont(d, 0.95), 6) as p95, round(quantile_cont(d, 0.99), 6) as p99 from k""")
def nn_stats(spark, sf):
    q, s = _slice(spark, sf)
    return rounded(neighbors.distance_stats(neighbors.knn(q, s, 2, 2.0)), ["mean", "p50", "p95", "p99"])


@query(_SLICE + _CELLS.format(1) + """, h as (select a.scene as a, b.scene as b, a.pid from c a join w b on a.cx = b.cx and a.cy = b.cy and a.cz = b.cz and a.scene <> b.scene and (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) < 1 group by all),
n as (select a, b, count(*) as n from h group by a, b), t as (select scene as a, count(*) as total from s group by scene)
select least(a, b) as a, greatest(a, b) as b, max(n / total) as share from n join t using (a) group by 1, 2""")
def semi_overlap(spark, sf):
    return neighbors.overlap_share(_slice(spark, sf)[1], 1.0)


@query(_SLICE + f""", d as (select q.pid as qid, s.segment, {_D2} as d2, s.pid from q join s on q.scene = s.scene and s.pid % 5 <> 0), n as (select qid, segment from d where d2 < 4 qualify row_number() over (partition by qid order by d2, pid) = 1)
select q.pid as qid, n.segment from q left join n on n.qid = q.pid""")
def nearest_transfer(spark, sf):
    q, s = _slice(spark, sf)
    return neighbors.transfer(q, s.where("pid % 5 <> 0"), 2.0, ["segment"])


# The queries above take the rows that their SQL takes. Those below take every point, on both sides; they have no SQL, tests/test_whole.py checks them by brute force.


@query(None)
def knn_k3_all(spark, sf):
    p = points(spark, sf)
    return neighbors.knn(p, p, 3, neighbors.cell_for(p, 3))


@query(None)
def radius_join_all(spark, sf):
    p = points(spark, sf)
    return neighbors.within(p, p, 2.5)


@query(None)
def ball_query_all(spark, sf):
    p = points(spark, sf)
    return neighbors.ball_query(p, p, 3.0, 4, 1.0)


@query(None)
def idw_interpolate_all(spark, sf):
    p = points(spark, sf)
    return rounded(neighbors.interpolated(p, p, 3, neighbors.cell_for(p, 3), "strength"), ["strength"])


@query(None)
def nn_stats_all(spark, sf):
    p = points(spark, sf)
    return rounded(neighbors.distance_stats(neighbors.knn(p, p, 2, neighbors.cell_for(p, 2))), ["mean", "p50", "p95", "p99"])


@query(None)
def semi_overlap_all(spark, sf):
    return neighbors.overlap_share(points(spark, sf), 1.0)


@query(None)
def nearest_transfer_all(spark, sf):
    """Two clouds that together are all points: a fifth asks, the others answer."""
    p = points(spark, sf)
    return neighbors.transfer(p.where("pid % 5 = 0"), p.where("pid % 5 <> 0"), 2.0, ["segment"])


@query("""with q as (select vec_id as qid, cast(embedding as double[]) as v from embeddings where vec_id % 50 = 0), p as (select vec_id, cast(embedding as double[]) as v from embeddings),
s as (select qid, vec_id, round(list_cosine_similarity(p.v, q.v), 6) as similarity from p join q on vec_id <> qid)
select qid, vec_id, similarity, row_number() over (partition by qid order by similarity desc, vec_id) as rank from s qualify rank <= 5""", points_view=False)
def cosine_topk(spark, sf):
    e = features(spark, sf)
    return neighbors.cosine_top(e, e.where("vec_id % 50 = 0"), 5)


# graphs

_EDGE = ", s as (select * from points where pid % 37 = 0), e as (select a.pid as u, b.pid as v from s a join s b on a.scene = b.scene and a.segment = b.segment and a.pid < b.pid and (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) < 4)"


def _all_edges(spark, sf):
    return neighbors.radius_edges(points(spark, sf), 2.0, same="segment")


@query(_CELLS.format(2) + """ select a.pid as u, b.pid as v from c a join w b on a.cx = b.cx and a.cy = b.cy and a.cz = b.cz and a.scene = b.scene and a.segment = b.segment and a.pid < b.pid
and (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) < 4""")
def radius_edges(spark, sf):
    return _all_edges(spark, sf)


@query(f"with recursive {POINTS_SQL}" + _EDGE + """, b as (select u, v from e union all select v, u from e), r(n, m) as (select pid, pid from s union select r.n, b.v from r join b on b.u = r.m),
c as (select n as pid, min(m) as component from r group by n), z as (select component, count(*) as size from c group by component having count(*) >= 2)
select pid, dense_rank() over (order by component) - 1 as cluster, size from c join z using (component)""", points_view=False)
def clusters(spark, sf):
    return graph.clusters_within(points(spark, sf).where("pid % 37 = 0"), 2.0, ["scene", "segment"], 2)


@query(None)
def radius_edges_all(spark, sf):
    return _all_edges(spark, sf)


@query(None)
def clusters_all(spark, sf):
    return graph.clusters_within(points(spark, sf), 2.0, ["scene", "segment"], 2)


_MASKS = """, m as (select cast(line as bigint) as mask, pid from points where pid % 5 < 3 and scene = 0 union select cast(line + 7 as bigint), pid from points where pid % 5 > 1 and scene = 0),
s as (select mask, cast(mask % 2 as integer) as label, 1.0::double / (mask + 1) as score from (select distinct mask from m)),
n as (select mask, count(*) as n from m group by mask),
o as (select a.mask as a, b.mask as b, count(*) as k from m a join m b on a.pid = b.pid and a.mask <> b.mask group by all),
i as (select a, b, k / (x.n + y.n - k) as iou from o join n x on x.mask = a join n y on y.mask = b),
p as (select i.a, i.b, iou from i join s h on h.mask = i.a join s l on l.mask = i.b where h.label = l.label and (h.score > l.score or (h.score = l.score and h.mask < l.mask))),
c as (select b as a, max(iou) as comp from p group by b),
d as (select p.b as mask, min(exp(-2.0 * iou * iou) / exp(-2.0 * coalesce(comp, 0) * coalesce(comp, 0))) as d from p left join c on c.a = p.a group by p.b)
select s.mask, label, score, round(score * least(coalesce(d, 1), 1), 6) as decayed from s left join d on d.mask = s.mask"""


@query(_MASKS)
def matrix_nms(spark, sf):
    p = points(spark, sf).where("scene = 0")
    m = p.where("pid % 5 < 3").select(F.col("line").cast("long").alias("mask"), "pid").union(p.where("pid % 5 > 1").select((F.col("line") + 7).cast("long"), "pid")).distinct()
    s = m.select("mask").distinct().select("mask", (F.col("mask") % 2).cast("int").alias("label"), (1.0 / (F.col("mask") + 1)).alias("score"))
    return rounded(graph.matrix_nms(m, s), ["decayed"])


@query(None)
def matrix_nms_all(spark, sf):
    """The masks of every scene: 16 numbers a scene, so that no mask spans two."""
    p = points(spark, sf).withColumn("mask", F.col("scene").cast("long") * 16 + F.col("line"))
    m = p.where("pid % 5 < 3").select("mask", "pid").union(p.where("pid % 5 > 1").select(F.col("mask") + 7, "pid")).distinct()
    s = m.select("mask").distinct().select("mask", (F.col("mask") % 2).cast("int").alias("label"), (1.0 / (F.col("mask") + 1)).alias("score"))
    return rounded(graph.matrix_nms(m, s), ["decayed"])


@query(None)
def farthest_points(spark, sf):
    return graph.farthest_points(points(spark, sf), 8)


@query(None)
def graph_segments(spark, sf):
    return graph.segments_within(points(spark, sf), 2.0, ["scene", "segment"], "z")


# frames

_FR = f"with {FRAMES_SQL}"


@query(_FR + """ select f.event_id, f.seq, f.frame, cast(o as integer) as "offset", f.value, p.value as past_value from frames f, (select unnest([0, -1, -2]) as o), frames p where p.seq = f.seq and p.frame = f.frame + o""", points_view=False)
def temporal_fusion(spark, sf):
    return temporal.fuse(frames(spark, sf).select("event_id", "seq", "frame", "value"), [0, -1, -2], ["value"])


@query(_FR + " select event_id, median(value) over w as median, round(avg(value) over w, 9) as mean from frames window w as (partition by seq order by frame rows 19 preceding)", points_view=False)
def running_median(spark, sf):
    return rounded(temporal.trailing(frames(spark, sf), "value", 20), ["mean"], 9).select("event_id", "median", "mean")


@query(_FR + " select event_id, round(sum(value) over w, 9) as total, count(value) over w as n, round(avg(value) over w, 9) as mean from frames window w as (partition by seq order by frame rows unbounded preceding)", points_view=False)
def running_mean(spark, sf):
    return rounded(temporal.running(frames(spark, sf), "value"), ["total", "mean"], 9).select("event_id", "total", "n", "mean")


@query(_FR + " select kind, arg_max(value, (ts, event_id)) as value, max(ts) as ts from frames group by kind", points_view=False)
def latest_value(spark, sf):
    return temporal.latest(frames(spark, sf), ["kind"], "value")


@query(", c as (select scene, count(*) as n from points group by scene) select scene, n, cast(sum(n) over (order by scene) as bigint) as \"offset\" from c")
def batch_offsets(spark, sf):
    return temporal.offsets(points(spark, sf).groupBy("scene").agg(F.count("*").alias("n")), "scene", "n")
