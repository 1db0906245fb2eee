"""Augmentation, loss, normal, tiling and correspondence queries over the driver tables, each with the SQL it must agree with."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from pointloom.operators import augment, geometry, metrics, raster, sets, tiles, voxel
from pointloom.plans.point_queries import PALETTE, _rgb, query, rounded
from pointloom.sources.tables import features, points

XYZ = ["x", "y", "z"]


def _u(seed: int, *keys: str) -> str:
    """SQL of augment's draws."""
    return f"(('0x' || substr(md5(concat_ws(':', {', '.join(keys)}, '{seed}')), 1, 13))::bigint / 4503599627370496.0)"


def _n(seed: int, *keys: str) -> str:
    return f"(sqrt(-2.0 * ln(1.0 - {_u(seed, *keys)})) * cos(2.0 * 3.141592653589793 * {_u(seed + 1, *keys)}))"


def _clip(e: str, low: float, high: float) -> str:
    return f"greatest(least({e}, {high}), {low})"


@query(f"""select pid, round((x + (2.0 * {_u(3, "scene")} - 1.0) * 0.2) * (0.9 + 0.2 * {_u(9, "scene")}) * case when {_u(21, "scene")} < 0.5 then -1 else 1 end, 6) as x,
round((y + (2.0 * {_u(4, "scene")} - 1.0) * 0.2) * (0.9 + 0.2 * {_u(10, "scene")}) * case when {_u(22, "scene")} < 0.5 then -1 else 1 end, 6) as y, round(z * (0.9 + 0.2 * {_u(11, "scene")}), 6) as z from points""")
def scene_augmented(spark, sf):
    p = augment.scale(augment.shift(points(spark, sf), (0.2, 0.2, 0.0), seed=3), 0.9, 1.1, seed=9, anisotropic=True)
    return rounded(augment.flip(p, seed=21), XYZ).select("pid", *XYZ)


@query("select pid, " + ", ".join(f"round({c} + {_clip(_n(5 + 10 * (i + 1), 'pid') + ' * 0.5', -0.8, 0.8)}, 6) as {c}" for i, c in enumerate(XYZ)) + " from points")
def point_jitter(spark, sf):
    return rounded(augment.jitter(points(spark, sf), 0.5, 0.8, seed=5), XYZ).select("pid", *XYZ)


@query(f""", b as (select pid, x, y, z, cast(floor(x / 10) as bigint) as cx, cast(floor(y / 10) as bigint) as cy, cast(floor(z / 10) as bigint) as cz from points),
two as (select unnest([0, 1]) as i), three as (select unnest([-1, 0, 1]) as i),
corner as (select distinct cx + a.i as nx, cy + b.i as ny, cz + c.i as nz from (select distinct cx, cy, cz from b), two a, two b, two c),
near as (select nx, ny, nz, nx + a.i as ox, ny + b.i as oy, nz + c.i as oz from corner, three a, three b, three c),
field as (select nx, ny, nz, {", ".join(f"avg({_n(2 + 10 * i, 'ox', 'oy', 'oz')}) as d{c}" for i, c in enumerate(XYZ))} from near group by all),
w as (select pid, x, y, z, case when nx = cx then 1 - (x / 10 - cx) else x / 10 - cx end * case when ny = cy then 1 - (y / 10 - cy) else y / 10 - cy end * case when nz = cz then 1 - (z / 10 - cz) else z / 10 - cz end as w, dx, dy, dz
      from b join field on nx between cx and cx + 1 and ny between cy and cy + 1 and nz between cz and cz + 1)
select pid, round(any_value(x) + 4.0 * sum(dx * w), 6) as x, round(any_value(y) + 4.0 * sum(dy * w), 6) as y, round(any_value(z) + 4.0 * sum(dz * w), 6) as z from w group by pid""")
def elastic_distortion(spark, sf):
    return rounded(augment.elastic(points(spark, sf), 10.0, 4.0, seed=2), XYZ).select("pid", *XYZ)


_RGB = """, c as (select pid, scene, cast(case segment when 0 then 85 when 1 then 0 when 2 then 255 when 3 then 41 else 0 end as double) as r, cast(case segment when 0 then 107 when 1 then 255 when 2 then 165 when 3 then 49 else 0 end as double) as g,
cast(case segment when 0 then 47 when 1 then 0 when 2 then 0 when 3 then 101 when 4 then 255 else 0 end as double) as b from points)"""


def _coloured(spark, sf):
    from pointloom.operators import labels

    return labels.colour_map(points(spark, sf), PALETTE, "segment").withColumns({c: F.col(c).cast("double") for c in "rgb"})


@query(_RGB + " select pid, " + ", ".join(f"round({_clip(_clip(c + ' + (' + _u(31 + i, 'scene') + ' - 0.5) * 255 * 2 * 0.05', 0.0, 255.0) + ' + ' + _n(40 + 10 * i, 'pid') + ' * 0.02 * 255', 0.0, 255.0)}, 6) as {c}" for i, c in enumerate("rgb")) + " from c")
def chromatic_augmented(spark, sf):
    return rounded(augment.chromatic_jitter(augment.chromatic_translation(_coloured(spark, sf), 0.05, seed=31), 0.02, seed=40), list("rgb")).select("pid", *"rgb")


_DROP = f", k as (select pid, row_number() over (partition by scene order by {_u(51, 'pid')}, pid) as r, count(*) over (partition by scene) as n from points)"


@query(_RGB + _DROP + " select pid, " + ", ".join(f"case when k.r <= floor(k.n * 0.2) then 0.0 else c.{c} end as {c}" for c in "rgb") + " from c join k using (pid)")
def drop_colour(spark, sf):
    return augment.drop_columns(_coloured(spark, sf), ["r", "g", "b"], 0.2, seed=51).select("pid", *"rgb")


@query(_DROP + " select pid from k where r <= floor(n * 0.35)")
def picked_points(spark, sf):
    return augment.picked(points(spark, sf), 0.35, seed=51).where("_picked").select("pid")


@query(", v as (select *, unnest([0, 1]) as view from points), s as (select *, scene || '/' || view as s from v) select pid, view, x as origin_x, "
       + ", ".join(f"round(({c} + (2.0 * {_u(60 + i, 's')} - 1.0) * {0.3 if i < 2 else 0.0}) * (0.8 + (1.2 - 0.8) * {_u(67, 's')}), 6) as {c}" for i, c in enumerate(XYZ)) + " from s")
def contrastive_views(spark, sf):
    return rounded(augment.views(points(spark, sf), 2, 0.3, 0.8, 1.2, seed=60), XYZ).select("pid", "view", "origin_x", *XYZ)


@query(f", box as (select scene, max(x) - min(x) as wx, max(y) - min(y) as wy, arg_min(pid, {_u(71, 'pid')}) as centre from points group by scene) "
       "select p.scene, p.pid, centre from points p join box using (scene) join points c on c.pid = centre where abs(p.x - c.x) <= wx * 0.4 / 2 and abs(p.y - c.y) <= wy * 0.4 / 2")  # fmt: skip
def local_views(spark, sf):
    return augment.centred_views(points(spark, sf), 0.4, seed=71).select("scene", "pid", "centre")


_TURNS, _SCALES = [0.0, 0.5, 1.0, 1.5], [0.95, 1.05]


@query(", a as (select * from (values " + ", ".join(f"({i * 2 + j}, {s}::double, {math.cos(t * math.pi)!r}::double, {math.sin(t * math.pi)!r}::double)" for i, t in enumerate(_TURNS) for j, s in enumerate(_SCALES)) + """) t(aug, f, c, s)),
r as (select scene, aug, (x * c - y * s) * f as x, (x * s + y * c) * f as y, z * f as z from points, a)
select scene, aug, count(*) as n, round(min(x), 6) as lo_x, round(max(x), 6) as hi_x, round(min(y), 6) as lo_y, round(max(y), 6) as hi_y, round(max(z), 6) as hi_z from r group by all""")
def test_time_views(spark, sf):
    t = augment.test_time_list(points(spark, sf), _TURNS, _SCALES)
    return t.groupBy("scene", "aug").agg(F.count("*").alias("n"), *[F.round(f(c), 6).alias(f"{n}_{c}") for c, n, f in (("x", "lo", F.min), ("x", "hi", F.max), ("y", "lo", F.min), ("y", "hi", F.max), ("z", "hi", F.max))])


_LOGITS = ", l as (select pid, segment % 3 as gt, [x / 50 - 0.5, z / 10 - 0.4, strength * 20 - 0.8] as v from points), e as (select pid, gt, unnest([0, 1, 2]) as class, unnest(v) as v from l)"


def _logits(spark, sf):
    return points(spark, sf).select("pid", (F.col("segment") % 3).alias("gt"), F.array(F.col("x") / 50 - 0.5, F.col("z") / 10 - 0.4, F.col("strength") * 20 - 0.8).alias("v"))


@query(_LOGITS + """, m as (select gt = class as hit, 1.0 / (1.0 + exp(-v)) as p from e), q as (select hit, case when hit then 1.0 - p else p end as miss from m)
select round(avg(0.5::double * pow(miss, 2) * -ln(greatest(1.0 - miss, 1e-12))), 6) as loss, cast(count(*) / 3 as bigint) as n from q""")
def focal_loss(spark, sf):
    return rounded(metrics.focal(_logits(spark, sf), "v", "gt"), ["loss"])


@query(_LOGITS + """, s as (select pid, sum(exp(v)) as s from e group by pid), p as (select class, case when gt = class then 1.0::double else 0.0 end as t, exp(v) / s as p from e join s using (pid))
select class, round(1.0 - (2.0 * sum(p * t) + 1.0) / (sum(p * p + t) + 1.0), 6) as loss from p group by class""")
def dice_loss(spark, sf):
    return rounded(metrics.dice(_logits(spark, sf), "v", "gt"), ["loss"])


@query(""", c as (select scene, line, segment as gt, pred, count(*) as n from points group by all), parts as (select distinct scene, gt as part from c), items as (select distinct scene, line from c),
g as (select scene, line, gt as part, sum(n) as n from c group by all), p as (select scene, line, pred as part, sum(n) as n from c group by all), b as (select scene, line, gt as part, n from c where gt = pred),
r as (select scene, line, coalesce(b.n, 0) as both_n, coalesce(g.n, 0) + coalesce(p.n, 0) - coalesce(b.n, 0) as u from items join parts using (scene) left join g using (scene, line, part) left join p using (scene, line, part) left join b using (scene, line, part)),
i as (select scene, line, avg(case when u = 0 then 1.0::double else both_n / u end) as iou from r group by all)
select scene, round(avg(iou), 9) as iou, count(*) as items from i group by scene""")
def part_iou(spark, sf):
    return rounded(metrics.part_iou(points(spark, sf), "scene", "line", "segment", "pred"), ["iou"], 9)


@query(", v as (select dense_rank() over (order by floor(x / 5), floor(y / 5), floor(z / 5)) - 1 as i from points) select count(*) as n, min(i) as lo, max(i) as hi, round(avg(case when i between 0 and 99 then 0.0 else 1.0 end), 9) as outside from v")
def inverse_validity(spark, sf):
    return rounded(metrics.inverse_validity(voxel.inverse_map(points(spark, sf), 5.0), "inverse", 100), ["outside"], 9)


@query("""select pid, round((x - 25) / s, 6) as nx, round((y - 25) / s, 6) as ny, round((z - 20) / s, 6) as nz from (select *, sqrt((x - 25) * (x - 25) + (y - 25) * (y - 25) + (z - 20) * (z - 20)) as s from points) where s > 0""")
def radial_normals(spark, sf):
    return rounded(geometry.radial_normals(points(spark, sf), (25.0, 25.0, 20.0)).where("nx is not null"), ["nx", "ny", "nz"]).select("pid", "nx", "ny", "nz")


@query(""", n as (select *, strength - 0.04 as nx, z / 10 - 0.5 as ny, 0.3::double as nz from points), a as (select *, nx * (x - 10) + ny * (y - 20) + nz * (z - 2) > 0 as away from n)
select pid, case when away then -nx else nx end as nx, case when away then -ny else ny end as ny, case when away then -nz else nz end as nz from a""")
def sensor_normals(spark, sf):
    p = points(spark, sf).withColumns({"nx": F.col("strength") - 0.04, "ny": F.col("z") / 10 - 0.5, "nz": F.lit(0.3)})
    return geometry.oriented(p, (10.0, 20.0, 2.0)).select("pid", "nx", "ny", "nz")


_M = geometry.euler_matrix(0.3, -0.2, 1.1)


@query("select pid, " + ", ".join(f"round(x * {r[0]!r}::double + y * {r[1]!r}::double + z * {r[2]!r}::double, 6) as {c}" for c, r in zip(XYZ, _M)) + " from points")
def euler_rotation(spark, sf):
    return rounded(geometry.turned(points(spark, sf), _M), XYZ).select("pid", *XYZ)


@query("select pid, x - min(x) over s as x, max(z) over s - z as y, y - min(y) over s as z from points window s as (partition by scene)")
def z_up(spark, sf):
    return geometry.z_up(points(spark, sf), ["scene"]).select("pid", *XYZ)


@query(""", h as (select cast(round(y * 10) as bigint) as h, count(*) as n from points group by 1), m as (select *, sum(n) over (order by h range between 2 preceding and 2 following) as m from h),
c as (select *, case when h - lag(h) over (order by h) <= 2 then 0 else 1 end as fresh from m where m >= 60), l as (select *, sum(fresh) over (order by h) - 1 as level from c)
select cast(level as bigint) as level, min(h) / 10 as lo, max(h) / 10 as hi, cast(sum(n) as bigint) as n from l group by level""")
def floor_levels(spark, sf):
    return geometry.floor_levels(points(spark, sf), "y", 2, 60)


_TOP = ", g as (select cast(floor(x) as bigint) as px, cast(floor(y) as bigint) as py, max(z) as z from points group by all)"


def _top(spark, sf):
    return points(spark, sf).groupBy(F.floor("x").cast("long").alias("px"), F.floor("y").cast("long").alias("py")).agg(F.max("z").alias("z"))


@query(_TOP + """, n as (select g.px, g.py, g.z - r.z as a, g.z - u.z as b from g left join g r on r.px = g.px + 1 and r.py = g.py left join g u on u.px = g.px and u.py = g.py + 1)
select px, py, round(a / sqrt(a * a + b * b + 1), 6) as nx, round(b / sqrt(a * a + b * b + 1), 6) as ny, round(1 / sqrt(a * a + b * b + 1), 6) as nz from n""")
def grid_normals(spark, sf):
    return rounded(geometry.grid_normals(_top(spark, sf), "z"), ["nx", "ny", "nz"])


@query(", p as (select pid, cast(floor(x * 4) as integer) as u, cast(floor(y * 4) as integer) as v from points) select distinct cast(floor((v - 40) / 14) as integer) as row, cast(floor((u - 20) / 14) as integer) as col, pid from p where u between 20 and 131 and v between 40 and 151")
def crop_correspondences(spark, sf):
    p = points(spark, sf).select("pid", F.floor(F.col("x") * 4).cast("int").alias("u"), F.floor(F.col("y") * 4).cast("int").alias("v"))
    return geometry.crop_correspondences(p, (20, 40, 112, 112), 14)


@query(", p as (select floor(x / 5) as gx, floor(y / 5) as gy, case when segment = 0 then -1 else cast(floor(x * 4) as integer) end as u, case when segment = 0 then -1 else cast(floor(y * 4) as integer) end as v from points) "
       "select cast(gx as bigint) as gx, cast(gy as bigint) as gy, round(coalesce(avg(u) filter (u >= 0), -1), 9) as u, round(coalesce(avg(v) filter (u >= 0), -1), 9) as v from p group by gx, gy")  # fmt: skip
def pooled_correspondences(spark, sf):
    pixel = lambda c: F.when(F.col("segment") == 0, -1).otherwise(F.floor(F.col(c) * 4).cast("int"))
    p = points(spark, sf).select(F.floor(F.col("x") / 5).cast("long").alias("gx"), F.floor(F.col("y") / 5).cast("long").alias("gy"), pixel("x").alias("u"), pixel("y").alias("v"))
    return rounded(geometry.pooled_correspondences(p, ["gx", "gy"]), ["u", "v"], 9)


_WEIGHTS = [[((c * 7 + d * 3) % 11 - 5) / 10 for d in range(64)] for c in range(5)]


@query("select vec_id, " + ", ".join(f"round({0.1 * c} + list_dot_product(embedding::double[], {w}::double[]), 6) as l{c}" for c, w in enumerate(_WEIGHTS)) + " from embeddings", points_view=False)
def linear_head(spark, sf):
    out = geometry.linear_head(features(spark, sf), "embedding", _WEIGHTS, [0.1 * c for c in range(5)])
    return out.select("vec_id", *[F.round(F.col("logits")[c], 6).alias(f"l{c}") for c in range(5)])


@query(", o as (select scene, min(x) as ox, min(y) as oy from points group by scene), s as (select p.*, ox, oy, cast(floor((x - ox) / 10) as bigint) as tx, unnest(range(greatest(cast(floor((y - oy - 10) / 6) as bigint) + 1, 0), cast(floor((y - oy) / 6) as bigint) + 1)) as ty from points p join o using (scene)) "
       "select scene, tx, ty, pid, round(x - ox - tx * 10, 8) as lx, round(y - oy - ty * 6, 8) as ly from s")  # fmt: skip
def strip_overlapping_tiles(spark, sf):
    return rounded(tiles.strip_overlapping_tiles(points(spark, sf), 10.0, 6.0), ["lx", "ly"], 8).select("scene", "tx", "ty", "pid", "lx", "ly")


@query(", t as (select pid, (segment + k) % 6 as pred, k from points, unnest([0, 1, 2]) as u(k) where segment <> 5 and (k < 2 or x < 25)) select pid, coalesce(pred, -1) as pred from points p left join (select pid, arg_max(pred, k) as pred from t group by pid) using (pid)".replace("select pid, coalesce(pred, -1) as pred from points p", "select pid, coalesce(l.pred, -1) as pred from points p").replace("from t group by pid) using", "from t group by pid) l using"))
def point_stitch(spark, sf):
    p = points(spark, sf)
    t = p.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).where("segment <> 5 and (k < 2 or x < 25)").select("pid", ((F.col("segment") + F.col("k")) % 6).alias("pred"), "k")
    return tiles.stitch_points(p, t, "pid", "pred", "k")


@query(", t as (select pid, floor(x / 3) as tx, floor(y / 3) as ty, case when x < 12 then 0 else segment end as s from points) select pid from t where (tx, ty) in (select (tx, ty) from t group by tx, ty having max(abs(s)) > 0)")
def labelled_tiles(spark, sf):
    t = points(spark, sf).select("pid", F.floor(F.col("x") / 3).alias("tx"), F.floor(F.col("y") / 3).alias("ty"), F.when(F.col("x") < 12, 0).otherwise(F.col("segment")).alias("s"))
    return tiles.labelled_tiles(t, ["tx", "ty"], "s").select("pid")


@query("select pid, 1 as turn, x, y, z from points where segment < 3 union all select pid, 2, x, y, z + 0.5 from points where segment < 3")
def two_returns(spark, sf):
    p = points(spark, sf).where("segment < 3").select("pid", *XYZ)
    return sets.concat([p.withColumn("turn", F.lit(1)), p.withColumn("z", F.col("z") + 0.5).withColumn("turn", F.lit(2))]).select("pid", "turn", *XYZ)


@query("select pid, cast(floor(x * 30 / (z + 5) + 32) as integer) as u, cast(floor(y * 30 / (z + 5) + 24) as integer) as v from points where floor(x * 30 / (z + 5) + 32) between 0 and 255 and floor(y * 30 / (z + 5) + 24) between 0 and 191")
def image_projection(spark, sf):
    return geometry.project(points(spark, sf).withColumn("z", F.col("z") + 5), 30.0, 30.0, 32.0, 24.0, 256, 192).select("pid", "u", "v")


@query("select pid, round((x - 32) * z / 30, 8) as x, round((y - 24) * z / 25, 8) as y, z from points where z > 0")
def depth_unprojection(spark, sf):
    return rounded(geometry.unproject(points(spark, sf), 30.0, 25.0, 32.0, 24.0, row="y", col="x", depth="z"), ["x", "y"], 8).select("pid", *XYZ)


@query("select pid, cast(floor(x / 5) as bigint) as gx, cast(floor(y / 5) as bigint) as gy, cast(floor(z / 5) as bigint) as gz from points")
def z_round_trip(spark, sf):
    p = voxel.voxel_index(points(spark, sf), 5.0).withColumn("code", voxel.z_code(F.col("gx"), F.col("gy"), F.col("gz")))
    return p.select("pid", *[c.alias(n) for n, c in zip(("gx", "gy", "gz"), voxel.z_decode(F.col("code")))])


_HEX = {f"#{r:02x}{g:02x}{b:02x}": k for k, (r, g, b) in PALETTE.items()}


@query(_RGB + " select pid, case printf('#%02x%02x%02x', cast(r as integer), cast(g as integer), cast(b as integer)) " + " ".join(f"when '{h}' then {k}" for h, k in _HEX.items()) + " else -1 end as label from c")
def hex_classes(spark, sf):
    from pointloom.operators import labels

    return labels.hex_classes(_coloured(spark, sf), _HEX).select("pid", "label")


@query(_RGB + " select pid, " + ", ".join(f"round(({c} / 255 - {m}) / {d}, 6) as {c}" for c, m, d in (("r", 0.485, 0.229), ("g", 0.456, 0.224), ("b", 0.406, 0.225))) + " from c")
def colour_standardised(spark, sf):
    from pointloom.operators import colour

    return rounded(colour.standardised(_coloured(spark, sf), (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)), list("rgb")).select("pid", *"rgb")


@query(_TOP.replace("max(z) as z", "arg_min(segment, pid) as s") + """, n as (select g.px, g.py, s.s, count(*) as k from g join g s on abs(s.px - g.px) <= 1 and abs(s.py - g.py) <= 1 group by all)
select px, py, s as label from n qualify row_number() over (partition by px, py order by k desc, s desc) = 1""")
def max_count_pool(spark, sf):
    g = points(spark, sf).groupBy(F.floor("x").cast("long").alias("px"), F.floor("y").cast("long").alias("py")).agg(F.min_by("segment", "pid").alias("label"))
    return raster.max_count_pool(g, "label")
