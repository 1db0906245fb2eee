"""Filter, gather, mesh, curve and string queries over the driver tables, each with the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pointloom.operators import curves, filters, gather, geometry, graph, labels, neighbors, raster, sets, tiles, vector, voxel
from pointloom.operators.common import ranked, stored
from pointloom.plans.metric_queries import _D2, _SLICE, _slice
from pointloom.plans.point_queries import _SCORES, _scores
from pointloom.plans.point_queries import query, rounded
from pointloom.sources.tables import features, points


@query("select pid, [x, y, z, strength] as feat from points")
def collect_features(spark, sf):
    return filters.collect(points(spark, sf), ["pid"], ["x", "y", "z", "strength"])


@query(None)
def collect_features_all(spark, sf):
    return filters.collect(points(spark, sf), ["pid"], ["x", "y", "z", "strength"])


@query("select pid, cast(segment as bigint) as segment, segment as origin_segment, 7 as split from points")
def copy_update(spark, sf):
    p = filters.updated(filters.copied(points(spark, sf).select("pid", "segment"), {"segment": "origin_segment"}), {"split": 7})
    return p.withColumn("segment", F.col("segment").cast("bigint"))


@query(", q as (select scene, quantile_cont(strength, 0.75) as q from points group by scene) select pid from points join q using (scene) where strength >= q and strength > 1e-5")
def confidence_filter(spark, sf):
    return filters.confident(points(spark, sf), "strength", 0.75, ["scene"]).select("pid")


@query("select pid from points where scene in (select scene from points group by scene order by count(*) desc, scene limit 2)")
def largest_scenes(spark, sf):
    return filters.largest_scenes(points(spark, sf), 2).select("pid")


@query("select pid, y from points where y <= 30 order by y desc, pid limit 200")
def low_scores(spark, sf):
    return filters.low_scores(points(spark, sf), "y", 30, 200, "pid").select("pid", "y")


@query("select pid from points qualify count(*) over (partition by floor(x), floor(y)) >= 30")
def dense_pixels(spark, sf):
    p = raster.pixels(points(spark, sf), 1.0)
    return filters.at_least(p, raster.PIXEL, 30).select("pid")


@query(None)
def random_block(spark, sf):
    return filters.random_block(points(spark, sf), 12.0, 50).select("scene", "pid")


@query(_SCORES + """, v as (select pid % 500 as k, unnest([0, 1, 2]) as label, unnest(pb) as p from p), w as (select k, label, round(sum(p), 9) as t from v group by all)
select k, arg_max(label, (t, -label)) as label, max(t) as score from w group by k""")
def fragment_vote(spark, sf):
    return filters.vote(_scores(spark, sf).withColumn("k", F.col("pid") % 500), ["k"], "bev")


@query(_SCORES + ", u as (select pid, unnest([0, 1, 2]) as i, unnest(cloud) as v from s) select pid, list(i order by v desc, i)[1:2] as labels from u group by pid")
def top_labels(spark, sf):
    return filters.top_labels(_scores(spark, sf), "pid", "cloud", 2)


@query(None)
def block_mask(spark, sf):
    return filters.block_mask(points(spark, sf), 5.0, 0.6).groupBy("masked").agg(F.count("*").alias("n"))


_ATT = """with v as (select vec_id as id, cast(embedding as double[]) as e from embeddings), e as (select a.id as target, b.id as refer from v a join v b on b.id in (a.id + 1, a.id + 2))"""


@query(_ATT + " select target, refer, round(list_dot_product(a.e, b.e), 6) as score from e join v a on a.id = target join v b on b.id = refer", points_view=False)
def attention_scores(spark, sf):
    v = features(spark, sf).select(F.col("vec_id").alias("id"), "embedding")
    e = v.select(F.col("id").alias("target"), F.explode(F.array(F.col("id") + 1, F.col("id") + 2)).alias("refer"))
    return rounded(gather.edge_scores(e, v, v, "embedding"), ["score"])


@query(_ATT + """, s as (select target, refer, list_dot_product(a.e, b.e) as score from e join v a on a.id = target join v b on b.id = refer), x as (select target, i, sum(score * v.e[i]) as t from s join v on v.id = refer, unnest(range(1, 65)) as u(i) group by all)
select target, round(sum(t * i), 5) as checksum from x group by target""", points_view=False)
def attention_sum(spark, sf):
    v = features(spark, sf).select(F.col("vec_id").alias("id"), "embedding")
    e = v.select(F.col("id").alias("target"), F.explode(F.array(F.col("id") + 1, F.col("id") + 2)).alias("refer"))
    out = gather.edge_sum(gather.edge_scores(e, v, v, "embedding"), v, "embedding")
    return out.select("target", F.round(F.aggregate(F.transform("embedding", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x), 5).alias("checksum"))


@query(_SLICE + f""", d as (select q.pid as qid, s.pid, q.x - s.x as x, q.y - s.y as y, {_D2} as d2 from q join s on q.scene = s.scene)
select qid, pid, x, y from d where d2 < 4""")
def neighbour_difference(spark, sf):
    q, s = _slice(spark, sf)
    return neighbors.differences(q, s, 2.0, ["x", "y"])


@query(None)
def neighbour_difference_all(spark, sf):
    p = points(spark, sf)
    return neighbors.differences(p, p, 2.0, ["x", "y"])


_WIN = ", s as (select pid, floor(x / 4) as wx, floor(y / 4) as wy, floor(x / 16) as cx, floor(y / 16) as cy, pid % 9 = 0 as sampled from points where pid % 29 = 0)"


@query(_WIN + """ select a.pid as i, b.pid as j, 0 as kind from s a join s b on a.wx = b.wx and a.wy = b.wy
union all select a.pid, b.pid, 1 from s a join s b on a.cx = b.cx and a.cy = b.cy and b.sampled and not (a.wx = b.wx and a.wy = b.wy)""")
def window_pairs(spark, sf):
    s = points(spark, sf).where("pid % 29 = 0").select("pid", *[F.expr(f"floor({c} / {k})").alias(n) for n, c, k in (("wx", "x", 4), ("wy", "y", 4), ("cx", "x", 16), ("cy", "y", 16))], F.expr("pid % 9 = 0").alias("sampled"))
    return gather.window_pairs(s, ["wx", "wy"], ["cx", "cy"], "sampled")


@query(None)
def window_pairs_all(spark, sf):
    s = points(spark, sf).select("pid", *[F.expr(f"floor({c} / {k})").alias(n) for n, c, k in (("wx", "x", 4), ("wy", "y", 4), ("cx", "x", 16), ("cy", "y", 16))], F.expr("pid % 9 = 0").alias("sampled"))
    return gather.window_pairs(s, ["wx", "wy"], ["cx", "cy"], "sampled")


@query(""", r as (select cast(floor(x / 5) as bigint) as gx, cast(floor(y / 5) as bigint) as gy, cast(floor(z / 5) as bigint) as gz, pid, row_number() over (partition by floor(x / 5), floor(y / 5), floor(z / 5) order by pid) as rn from points)
select gx, gy, gz, count(*) as n, list_resize(list(pid order by pid) filter (where rn <= 8), 8, cast(-1 as bigint)) as members from r group by gx, gy, gz""")
def padded_members(spark, sf):
    return gather.padded_members(voxel.voxel_index(points(spark, sf), 5.0), voxel.VOXEL, 8)


@query("select line, count(*) as n, round(avg(x), 9) as x, round(avg(strength), 9) as strength from points group by line")
def incremental_fusion(spark, sf):
    p = points(spark, sf)
    return rounded(gather.fuse_sums([p.where(f"scene = {i}") for i in range(4)], ["line"], ["x", "strength"]), ["x", "strength"], 9)


@query(None)
def incremental_fusion_all(spark, sf):
    """Every scene: points() deals them into four."""
    p = points(spark, sf)
    return rounded(gather.fuse_sums([p.where(f"scene = {i}") for i in range(4)], ["line"], ["x", "strength"]), ["x", "strength"], 9)


@query(""", m as (select pid % 1000 as vertex, cast(line as bigint) * 10 + scene as instance, segment as label, pid as position from points), z as (select instance, count(*) as size from m group by instance),
r as (select m.*, size from m join z using (instance) qualify row_number() over (partition by vertex order by position) <= 3)
select vertex, arg_min(label, (size, position)) as label, count(*) as n from r group by vertex""")
def smallest_instance(spark, sf):
    m = points(spark, sf).select((F.col("pid") % 1000).alias("vertex"), (F.col("line").cast("long") * 10 + F.col("scene")).alias("instance"), F.col("segment").alias("label"), F.col("pid").alias("position"))
    return gather.smallest_instance(m, "vertex", "instance", "position")


_MESH = ", v as (select row_number() over (order by pid) as id, x, y, z from points where pid % 997 = 0), f as (select a.id as face, a.id as a, a.id + 1 as b, a.id + 2 as c from v a where a.id % 2 = 0 and a.id + 2 <= (select count(*) from v))"


def _mesh(spark, sf):
    v = points(spark, sf).where("pid % 997 = 0").select(F.row_number().over(Window.orderBy("pid")).cast("long").alias("id"), "x", "y", "z")  # a small fixture
    n = v.count()
    f = v.where(f"id % 2 = 0 and id + 2 <= {n}").select(F.col("id").alias("face"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"), (F.col("id") + 2).alias("c"))
    return v, f


@query(_MESH + """, p as (select face, f.a, f.b, f.c, q.x - p.x as ux, q.y - p.y as uy, q.z - p.z as uz, r.x - p.x as vx, r.y - p.y as vy, r.z - p.z as vz from f join v p on p.id = f.a join v q on q.id = f.b join v r on r.id = f.c),
n as (select unnest([a, b, c]) as id, uy * vz - uz * vy as nx, uz * vx - ux * vz as ny, ux * vy - uy * vx as nz from p), s as (select id, sum(nx) as nx, sum(ny) as ny, sum(nz) as nz from n group by id)
select id, round(nx / sqrt(nx * nx + ny * ny + nz * nz), 6) as nx, round(ny / sqrt(nx * nx + ny * ny + nz * nz), 6) as ny, round(nz / sqrt(nx * nx + ny * ny + nz * nz), 6) as nz from s""")
def vertex_normals(spark, sf):
    v, f = _mesh(spark, sf)
    return rounded(gather.vertex_normals(f, v), ["nx", "ny", "nz"])


@query(_MESH + ", c as (select unnest([a, b, c]) as id, face % 256 as r, face * 3 % 256 as g, face * 7 % 256 as b from f) select v.id, round(coalesce(avg(r), 255), 6) as r, round(coalesce(avg(g), 255), 6) as g, round(coalesce(avg(c.b), 255), 6) as b from v left join c on c.id = v.id group by v.id")
def face_colours(spark, sf):
    v, f = _mesh(spark, sf)
    c = f.select(F.array("a", "b", "c").alias("vertices"), (F.col("face") % 256).alias("r"), (F.col("face") * 3 % 256).alias("g"), (F.col("face") * 7 % 256).alias("b"))
    return rounded(gather.face_colours(c, v), ["r", "g", "b"])


def _full_mesh(spark, sf):
    """A strip over every point in order of pid, numbered from 1 by range partitions."""
    v = stored(ranked(points(spark, sf).select("pid", "x", "y", "z"), ["pid"], "id").select((F.col("id") + 1).alias("id"), "x", "y", "z"))
    n = v.count()
    f = v.where(f"id % 2 = 0 and id + 2 <= {n}").select(F.col("id").alias("face"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"), (F.col("id") + 2).alias("c"))
    return v, f


@query(None)
def vertex_normals_all(spark, sf):
    v, f = _full_mesh(spark, sf)
    return rounded(gather.vertex_normals(f, v), ["nx", "ny", "nz"])


@query(None)
def face_colours_all(spark, sf):
    v, f = _full_mesh(spark, sf)
    c = f.select(F.array("a", "b", "c").alias("vertices"), (F.col("face") % 256).alias("r"), (F.col("face") * 3 % 256).alias("g"), (F.col("face") * 7 % 256).alias("b"))
    return rounded(gather.face_colours(c, v), ["r", "g", "b"])


@query(None)
def pca_normals(spark, sf):
    return gather.normals_within(points(spark, sf), 4.0)


@query(None)
def ground_plane(spark, sf):
    p = gather.ground_plane(points(spark, sf), 16)
    return spark.createDataFrame([tuple(p.values())], "a double, b double, c double, d double, points long")


@query("select i as step, round(case when i < 10 then 0.0::double + (1.0::double - 0) * i / 9 else 0.1::double + 0.5 * (1.0::double - 0.1) * (1 + cos(pi() * (i - 10) / 90)) end, 9) as value from range(100) as r(i)", points_view=False)
def cosine_schedule(spark, sf):
    return rounded(curves.cosine_schedule(spark, 100, 1.0, 0.1, warmup=10), ["value"], 9)


@query("""with s as (select vec_id, p, exp(e / 1.0) as q from (select vec_id, unnest(range(8)) as p, unnest(cast(embedding[1:8] as double[])) as e from embeddings)),
a as (select vec_id, p, q / (select sum(q) from s) as q from s), n as (select count(distinct vec_id) as ns from s),
b1 as (select vec_id, p, q / sum(q) over (partition by p) / 8 as q from a), c1 as (select vec_id, p, q / sum(q) over (partition by vec_id) / ns as q from b1, n),
b2 as (select vec_id, p, q / sum(q) over (partition by p) / 8 as q from c1), c2 as (select vec_id, p, q / sum(q) over (partition by vec_id) / ns as q from b2, n)
select vec_id, cast(p as integer) as p, round(q * ns, 6) as q from c2, n""", points_view=False)
def sinkhorn(spark, sf):
    e = features(spark, sf).select("vec_id", F.posexplode(F.slice("embedding", 1, 8)).alias("p", "e"))
    return rounded(curves.sinkhorn(e.select("vec_id", "p", F.exp(F.col("e").cast("double")).alias("s")), "vec_id", "p", "s", 2), ["q"])


@query("select pid, round((z - lo) / (hi - lo + 1e-12), 9) as s from points join (select scene, min(z) as lo, max(z) as hi from points group by scene) using (scene)")
def min_max_scaled(spark, sf):
    return rounded(curves.scaled(points(spark, sf), ["scene"], "z", "s"), ["s"], 9).select("pid", "s")


@query("select pid, round(2.0 * exp(-z * z / 18), 6) as g, case when strength < 0.0001 then 'unknown' when strength < 0.005 then 'metres, very dense' when strength < 0.3 then 'metres' when strength < 3 then 'decimetres or feet' else 'millimetres' end as unit from points")
def kernels_and_units(spark, sf):
    return points(spark, sf).select("pid", F.round(curves.gaussian(F.col("z"), 2.0, 3.0), 6).alias("g"), curves.unit_guess(F.col("strength")).alias("unit"))


@query("""select page_id, list_extract(string_split(url, '/'), -1) as base, regexp_replace(list_extract(string_split(url, '/'), -1), '\\.[^.]*$', '') as stem,
case when len(string_split(url, '/')) > 1 then list_extract(string_split(url, '/'), -2) end as parent from pages""", points_view=False)
def path_parts(spark, sf):
    return labels.path_parts(spark.read.parquet(f"{sf}/pages.parquet"), "url").select("page_id", "base", "stem", "parent")


@query("""with p as (select event_id, ts, cast(event_id % 3 as integer) as dataset, row_number() over (partition by event_id % 3 order by ts, event_id) - 1 as position from events)
select event_id, dataset, cast(floor(position / (dataset + 1)) as bigint) as turn, cast(position % (dataset + 1) as bigint) as slot from p""", points_view=False)
def dataset_interleave(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", (F.col("event_id") % 3).cast("int").alias("dataset"))
    e = e.withColumn("position", (F.row_number().over(Window.partitionBy("dataset").orderBy("ts", "event_id")) - 1).cast("long"))
    return sets.interleave(e, {0: 1, 1: 2, 2: 3}, "position").select("event_id", "dataset", "turn", "slot")


@query(""", k as (select pid, scene, cast(floor(x / 10) as bigint) as tx, segment, strength from points), c as (select scene * 100 + tx as cluster, strength from k)
select cluster, count(*) as size, max(strength) as top, round(avg(strength), 9) as mean from c group by cluster having count(*) > 20""")
def instance_proposals(spark, sf):
    c = points(spark, sf).withColumn("cluster", F.col("scene") * 100 + F.floor(F.col("x") / 10))
    return rounded(graph.proposals(c.select("pid", "cluster"), c, "strength", 20), ["mean"], 9)


@query("""with f as (select o_custkey % 50 as poly, list(struct_pack(x := cast(o_orderkey % 97 as double), y := cast(o_orderkey % 89 as double)) order by o_orderkey) as ring from orders group by 1),
s as (select poly, ring, len(ring) as n from f), e as (select poly, ring[i].x * ring[i % n + 1].y - ring[i % n + 1].x * ring[i].y as c from s, unnest(range(1, n + 1)) as r(i))
select poly, abs(sum(c)) / 2 as area from e group by poly""", points_view=False)
def polygon_area(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select((F.col("o_custkey") % 50).alias("poly"), F.struct("o_orderkey", (F.col("o_orderkey") % 97).cast("double").alias("x"), (F.col("o_orderkey") % 89).cast("double").alias("y")).alias("p"))
    rings = o.groupBy("poly").agg(F.transform(F.sort_array(F.collect_list("p")), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("ring"))
    return rings.select("poly", vector.area("ring").alias("area"))


@query(None)
def vector_objects(spark, sf):
    label = raster.majority(points(spark, sf), 1.0, "segment").select("px", "py", "segment")
    return vector.vectorise(label, "segment", least=6)


@query(None)
def filled_holes(spark, sf):
    return raster.fill_holes(raster.pixels(points(spark, sf).where("z > 7"), 1.0).select("px", "py").distinct())


@query(", n as (select scene, cast(floor(count(*) * 0.5) as bigint) as n from points group by scene) select scene, n as kept from n")
def half_dropout(spark, sf):
    return geometry.dropout(points(spark, sf), 0.5, seed=4).groupBy("scene").agg(F.count("*").alias("kept"))


@query(""", t as (select scene, cast(floor((x - lx) / 10) as bigint) as tx, cast(floor((y - ly) / 10) as bigint) as ty, hx, lx, hy, ly from points join (select scene, min(x) lx, max(x) hx, min(y) ly, max(y) hy from points group by scene) using (scene)),
k as (select scene, tx, ty, count(*) as n from t where tx <= greatest(cast(ceil((hx - lx - 10) / 10) as bigint) + 1, 1) - 1 and ty <= greatest(cast(ceil((hy - ly - 10) / 10) as bigint) + 1, 1) - 1 group by all having count(*) >= 100)
select scene, tx, ty, n, cast(row_number() over (partition by scene order by tx, ty) - 1 as integer) as chunk from k""")
def scene_chunks(spark, sf):
    return tiles.chunks(points(spark, sf), 10, 10, 100)
