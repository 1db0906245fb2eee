"""Point, voxel, tile and raster queries over the driver tables, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.operators import colour, geometry, labels, raster, sets, tiles, voxel
from pointloom.operators.common import numbered
from pointloom.sources.tables import POINTS_SQL, points

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None, points_view: bool = True):
    """Registers a query under its function's name; sql may start with further common table expressions."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"with {POINTS_SQL}{'' if sql.lstrip().startswith(',') else ' '}{sql}" if points_view else sql
        return f

    return register


def rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


V5 = "cast(floor(x / 5) as bigint) as gx, cast(floor(y / 5) as bigint) as gy, cast(floor(z / 5) as bigint) as gz"


@query(f"select {V5}, count(*) as n from points group by all")
def voxel_occupancy(spark, sf):
    return voxel.occupancy(points(spark, sf), 5.0)


@query(f""", v as (select {V5}, count(*) as n from points group by all)
select count(*) as voxels, round(avg(n), 6) as mean, max(n) as most, round(quantile_cont(n, 0.5), 6) as p50, round(quantile_cont(n, 0.9), 6) as p90,
       round(quantile_cont(n, 0.95), 6) as p95, round(quantile_cont(n, 0.99), 6) as p99 from v""")
def voxel_summary(spark, sf):
    return voxel.occupancy_summary(points(spark, sf), 5.0)


@query(f"""select * from (select {V5}, pid, x, y, z, segment from points) qualify row_number() over (partition by gx, gy, gz order by pid) = 1""")
def voxel_first(spark, sf):
    return voxel.first_in_voxel(points(spark, sf).select("pid", "x", "y", "z", "segment"), 5.0)


@query(f"""select {V5}, count(*) as n, round(avg(x), 9) as x, round(avg(y), 9) as y, round(avg(z), 9) as z from points group by 1, 2, 3""")
def voxel_mean(spark, sf):
    return rounded(voxel.mean_in_voxel(points(spark, sf), 5.0, ["x", "y", "z"]), ["x", "y", "z"], 9)  # y is a multiple of 5e-6: six digits would meet ties


@query(f""", v as (select pid, {V5} from points),
r as (select *, row_number() over (partition by gx, gy, gz order by pid) - 1 as rn, count(*) over (partition by gx, gy, gz) as cnt from v),
m as (select max(cnt) as top from r)
select pid, gx, gy, gz, cast(fragment as bigint) as fragment from r, m, unnest(range(rn, top, cnt)) as u(fragment)""")
def grid_fragments(spark, sf):
    return voxel.grid_fragments(points(spark, sf), 5.0).select("pid", "gx", "gy", "gz", "fragment")


@query(None)
def grid_fragments_all(spark, sf):
    return voxel.grid_fragments(points(spark, sf), 5.0).select("pid", "gx", "gy", "gz", "fragment")


@query(f"select pid, dense_rank() over (order by gx, gy, gz) - 1 as inverse from (select pid, {V5} from points)")
def inverse_map(spark, sf):
    return voxel.inverse_map(points(spark, sf), 5.0).select("pid", "inverse")


@query("""select scene, cast(trunc(x / 4) as bigint) as gx, cast(trunc(y / 4) as bigint) as gy, cast(trunc(z / 4) as bigint) as gz, count(*) as n,
max(strength) as strength, round(avg(x), 11) as mean_x, round(avg(y), 11) as mean_y, round(avg(z), 11) as mean_z from points group by 1, 2, 3, 4""")
def grid_pooling(spark, sf):
    return rounded(voxel.grid_pooling(points(spark, sf), 4, "scene", ["strength"]), ["mean_x", "mean_y", "mean_z"], 11)


@query("""select p.pid, m.up_strength from points p join (select scene, trunc(x / 4) as a, trunc(y / 4) as b, trunc(z / 4) as c, max(strength) as up_strength from points group by all) m
on p.scene = m.scene and trunc(p.x / 4) = a and trunc(p.y / 4) = b and trunc(p.z / 4) = c""")
def grid_unpooling(spark, sf):
    p = points(spark, sf)
    return voxel.grid_unpooling(voxel.grid_pooling(p, 4, "scene", ["strength"]), p, 4, "scene", ["strength"]).select("pid", "up_strength")


@query(f"select pid, x / 5 - floor(x / 5) - 0.5 as dx, y / 5 - floor(y / 5) - 0.5 as dy, z / 5 - floor(z / 5) - 0.5 as dz from points")
def voxel_displacement(spark, sf):
    return voxel.displacement(points(spark, sf), 5.0).select("pid", "dx", "dy", "dz")


@query(f""", v as (select {V5}, count(*) as n from points group by all), l as (select *, ln(1 + n) as l from v), s as (select min(l) as lo, max(l) as hi from l)
select gx, gy, gz, round((l - lo) / greatest(hi - lo, 1e-12), 6) as grey from l, s""")
def log_density(spark, sf):
    return rounded(voxel.log_density(points(spark, sf), 5.0).select("gx", "gy", "gz", "grey").distinct(), ["grey"])


@query(""", s as (select unnest([2.0::double, 5.0, 10.0]) as size)
select size, count(*) as voxels from (select distinct size, floor(x / size) as a, floor(y / size) as b, floor(z / size) as c from points, s) group by size""")
def voxels_by_size(spark, sf):
    return voxel.count_at_sizes(points(spark, sf), [2.0, 5.0, 10.0])


def _spread(c: str) -> str:
    bits = " | ".join(f"((({c} >> {i}) & 1) << {3 * i})" for i in range(16))
    return f"({bits})"


ZCODE = f"(({_spread('gx')} << 2) | ({_spread('gy')} << 1) | {_spread('gz')})"


@query(f""", v as (select pid, {V5} from points), c as (select pid, {ZCODE} as code from v)
select pid, code, row_number() over (order by code, pid) - 1 as place from c""")
def zorder_sort(spark, sf):
    return voxel.curve_sorted(points(spark, sf), 5.0).select("pid", "code", "place")


@query(f""", v as (select *, {V5} from points), c as (select *, {ZCODE} >> 3 as cluster from v)
select scene, cluster, count(*) as n, round(avg(x), 9) as mean_x, round(avg(y), 9) as mean_y, round(avg(z), 9) as mean_z, arg_min(segment, pid) as segment from c group by scene, cluster""")
def serialized_pooling(spark, sf):
    return rounded(voxel.serialized_pooling(points(spark, sf), 5.0, 1, "scene"), ["mean_x", "mean_y", "mean_z"], 9)


@query(f""", v as (select {V5} from points), c as (select {ZCODE} as code from v)
select cast(level as integer) as level, code >> cast(3 * (4 - level) as integer) as node, count(*) as n from c, unnest(range(5)) as l(level) group by all""")
def octree_nodes(spark, sf):
    return voxel.octree(points(spark, sf), 5.0, 4)


@query(None)
def hilbert_codes(spark, sf):
    return voxel.hilbert_codes(points(spark, sf), 5.0).select("pid", "gx", "gy", "gz", "hilbert")


@query("""select p.pid, round(x - (lx + hx) / 2, 8) as x, round(y - (ly + hy) / 2, 8) as y, round(z - lz, 8) as z from points p join
(select scene, min(x) lx, max(x) hx, min(y) ly, max(y) hy, min(z) lz from points group by scene) using (scene)""")
def center_shift(spark, sf):
    return rounded(geometry.center_shift(points(spark, sf)), ["x", "y", "z"], 8).select("pid", "x", "y", "z")


@query("""select p.pid, x - lx as x, y - ly as y, z - lz as z from points p join (select scene, min(x) lx, min(y) ly, min(z) lz from points group by scene) using (scene)""")
def positive_shift(spark, sf):
    return geometry.positive_shift(points(spark, sf)).select("pid", "x", "y", "z")


@query(""", c as (select pid, scene, x - mx as x, y - my as y, z - mz as z from points join (select scene, avg(x) mx, avg(y) my, avg(z) mz from points group by scene) using (scene)),
f as (select scene, max(sqrt(x * x + y * y + z * z)) as far from c group by scene)
select pid, round(x / far, 5) as x, round(y / far, 5) as y, round(z / far, 5) as z from c join f using (scene)""")
def normalize_coord(spark, sf):
    return rounded(geometry.normalize_coord(points(spark, sf)), ["x", "y", "z"], 5).select("pid", "x", "y", "z")


@query("select pid, greatest(least(x, 30), 5) as x, greatest(least(y, 40), 2) as y, greatest(least(z, 6), 1) as z from points")
def point_clip(spark, sf):
    return geometry.clip(points(spark, sf), (5, 2, 1), (30, 40, 6)).select("pid", "x", "y", "z")


@query("select pid, round(x * cos(0.5::double) - y * sin(0.5::double), 6) as x, round(x * sin(0.5::double) + y * cos(0.5::double), 6) as y, z from points")
def rotate_z(spark, sf):
    return rounded(geometry.rotate(points(spark, sf), 0.5), ["x", "y"]).select("pid", "x", "y", "z")


@query("select pid, y as x, -x as y, z from points")
def axis_permute(spark, sf):
    return geometry.permute(points(spark, sf), ("y", "x", "z"), (1, -1, 1)).select("pid", "x", "y", "z")


@query("select pid, 2 * x + 0 * y + 0 * z + 1 as x, 0 * x + y + 0 * z - 1 as y, 0 * x + 0 * y + z + 5 as z from points")
def pose_transform(spark, sf):
    pose = [2.0, 0, 0, 1, 0, 1, 0, -1, 0, 0, 1, 5, 0, 0, 0, 1]
    return geometry.transform(points(spark, sf).withColumn("pose", F.array(*[F.lit(float(v)) for v in pose])), "pose").select("pid", "x", "y", "z")


@query("select pid, (x - 25) * (x - 25) + (y - 20) * (y - 20) + (z - 5) * (z - 5) as d2 from points order by d2, pid limit 500")
def sphere_crop(spark, sf):
    return geometry.sphere_crop(points(spark, sf), (25, 20, 5), 500).select("pid", "d2")


@query("""select scene, count(*) as n, min(x) as min_x, max(x) as max_x, min(y) as min_y, max(y) as max_y, min(z) as min_z, max(z) as max_z,
round(count(*) / ((max(x) - min(x)) * (max(y) - min(y)) * (max(z) - min(z))), 6) as density from points group by scene""")
def scene_bounds(spark, sf):
    return rounded(geometry.bounds(points(spark, sf)), ["density"])


@query(""", s as (select min(y) lo, max(y) hi from points)
select cast(least(floor((y - lo) / (hi - lo) * 10), 9) as integer) as bin, count(*) as n from points, s group by 1""")
def histogram(spark, sf):
    return geometry.histogram(points(spark, sf), "y")


@query("""select 'x' as "column", min(x) as lo, max(x) as hi, round(avg(x), 6) as mean, round(stddev_pop(x), 6) as std from points
union all select 'strength', min(strength), max(strength), round(avg(strength), 6), round(stddev_pop(strength), 6) from points""")
def column_stats(spark, sf):
    return rounded(geometry.column_stats(points(spark, sf), ["x", "strength"]), ["mean", "std"])


@query("select pid from points where segment not in (0, 1) and z between 2 and 7")
def filter_segments(spark, sf):
    return points(spark, sf).where(~F.col("segment").isin(0, 1) & F.col("z").between(2, 7)).select("pid")


@query("select scene, cast(floor(count(*) * 0.8) as bigint) as kept from points group by scene")
def dropout_sizes(spark, sf):
    return geometry.dropout(points(spark, sf), 0.2).groupBy("scene").agg(F.count("*").alias("kept"))


# tiles

_BOX = ", b as (select scene, floor(min(x)) lx, ceil(max(x)) hx, floor(min(y)) ly, ceil(max(y)) hy from points group by scene)"


def _cover(c: str, size: int, step: int) -> str:
    off = f"({c} - l{c})"
    return f"range(greatest(0, cast(floor(({off} - {size}) / {step}) as bigint) + 1), least(cast(floor({off} / {step}) as bigint), greatest(cast(ceil((h{c} - l{c}) / {step}) as bigint) - 1, 0)) + 1)"


@query(f"{_BOX} select pid, tx, ty from points join b using (scene), unnest({_cover('x', 10, 7)}) as u(tx), unnest({_cover('y', 10, 7)}) as w(ty)")
def tile_overlap(spark, sf):
    return tiles.overlapping_tiles(points(spark, sf), 10, 7).select("pid", "tx", "ty")


@query(f"""{_BOX}, t as (select pid, p.scene, x, y, z, lx, ly, tx, ty from points p join b using (scene), unnest({_cover('x', 10, 10)}) as u(tx), unnest({_cover('y', 10, 10)}) as w(ty)),
g as (select scene, tx, ty, count(*) n, min(z) z0 from t group by all having count(*) >= 50)
select pid, tx, ty, round(x - (lx + tx * 10 + 5), 6) as x, round(y - (ly + ty * 10 + 5), 6) as y, round(z - z0, 6) as z from t join g using (scene, tx, ty)""")
def scene_tiles(spark, sf):
    return rounded(tiles.scene_tiles(points(spark, sf), 10, 50), ["x", "y", "z"]).select("pid", "tx", "ty", "x", "y", "z")


@query(""", o as (select scene, floor(min(x)) ox from points group by scene), a as (select pid, p.scene, y, cast(floor((x - ox) / 10) as bigint) as tx from points p join o using (scene)),
s as (select scene, tx, floor(min(y)) oy from a group by all) select pid, tx, cast(floor((y - oy) / 10) as bigint) as ty from a join s using (scene, tx)""")
def strip_origin_tiles(spark, sf):
    return tiles.strip_tiles(points(spark, sf), 10).select("pid", "tx", "ty")


@query(""", b as (select scene, min(x) lx, max(x) hx, min(y) ly, max(y) hy from points group by scene),
n as (select *, greatest(cast(ceil((hx - lx - 12) / 9) as bigint) + 1, 1) nx, greatest(cast(ceil((hy - ly - 12) / 9) as bigint) + 1, 1) ny from b)
select pid, tx, ty from points join n using (scene),
unnest(range(greatest(0, cast(floor((x - lx - 12) / 9) as bigint) + 1), least(cast(floor((x - lx) / 9) as bigint), nx - 1) + 1)) as u(tx),
unnest(range(greatest(0, cast(floor((y - ly - 12) / 9) as bigint) + 1), least(cast(floor((y - ly) / 9) as bigint), ny - 1) + 1)) as w(ty)""")
def stride_tiles(spark, sf):
    return tiles.stride_tiles(points(spark, sf), 12, 9).select("pid", "tx", "ty")


@query(""", b as (select scene, min(x) lx, min(y) ly from points group by scene),
t as (select pid, scene, tx, ty from points join b using (scene), unnest(range(greatest(0, cast(ceil((x - lx - 12) / 8) as bigint)), cast(floor((x - lx) / 8) as bigint) + 1)) as u(tx),
unnest(range(greatest(0, cast(ceil((y - ly - 12) / 8) as bigint)), cast(floor((y - ly) / 8) as bigint) + 1)) as w(ty))
select pid, tx, ty from t qualify count(*) over (partition by scene, tx, ty) >= 100""")
def closed_tiles(spark, sf):
    return tiles.closed_tiles(points(spark, sf), 12, 4, 100).select("pid", "tx", "ty")


@query(""", t as (select *, cast(floor(x / 10) as bigint) as tx, cast(floor(y / 10) as bigint) as ty from points), h as (select scene, tx, ty, segment, count(*) c from t group by all)
select s.*, m.top_label from (select scene, tx, ty, count(*) as n, count(distinct segment) as labels, min(x) as min_x, max(x) as max_x, min(y) as min_y, max(y) as max_y, min(z) as min_z, max(z) as max_z from t group by scene, tx, ty) s
join (select scene, tx, ty, arg_max(segment, c * 10 - segment) as top_label from h group by scene, tx, ty) m using (scene, tx, ty)""")
def tile_stats(spark, sf):
    p = points(spark, sf).withColumns({"tx": F.floor(F.col("x") / 10), "ty": F.floor(F.col("y") / 10)})
    return tiles.tile_stats(p, ["scene", "tx", "ty"])


@query("""select scene, cast(floor(x / 2) as bigint) as px, cast(floor(y / 2) as bigint) as py, count(*) as n, greatest(max(z), 0) as height, round(avg(strength), 6) as strength from points group by 1, 2, 3""")
def pillar_bev(spark, sf):
    return rounded(tiles.pillar_bev(points(spark, sf), 2.0, ["scene"]), ["strength"])


@query("""select cast(floor(x / 2) as bigint) as px, cast(floor(y / 2) as bigint) as py, arg_max(segment, scene * 1e18 + 0 * z) as segment from
(select x, y, z, segment, scene from points qualify row_number() over (partition by floor(x / 2), floor(y / 2), scene order by pid desc) = 1) group by 1, 2""")
def stitch_last(spark, sf):
    return tiles.stitch_last(raster.pixels(points(spark, sf), 2.0), raster.PIXEL, "segment", ["scene", "pid"])


@query(""", c as (select cast(floor(x / 2) as bigint) as px, cast(floor(y / 2) as bigint) as py, segment, count(*) n, min(scene) s, min(pid) f from points group by 1, 2, 3),
o as (select px, py, segment, n, (select min(struct_pack(s := q.scene, p := q.pid)) from points q where floor(q.x / 2) = px and floor(q.y / 2) = py and q.segment = c.segment) as first from c)
select px, py, segment from o qualify row_number() over (partition by px, py order by n desc, first) = 1""")
def stitch_majority(spark, sf):
    return tiles.stitch_majority(raster.pixels(points(spark, sf), 2.0), raster.PIXEL, "segment", ["scene", "pid"])


@query("""select cast(floor(x / 2) as bigint) as px, cast(floor(y / 2) as bigint) as py, round(coalesce(avg(case when strength > 0 then strength end), 0), 6) as strength from points group by 1, 2""")
def stitch_average(spark, sf):
    return rounded(tiles.stitch_mean(raster.pixels(points(spark, sf), 2.0), raster.PIXEL, "strength"), ["strength"])


@query(""", t as (select *, floor(x / 10) as tx, floor(y / 10) as ty from points), q as (select tx, ty, quantile_cont(z, 0.05) as z0 from t group by all)
select pid from t join q using (tx, ty) where z >= z0 and z <= z0 + 4""")
def ground_slab(spark, sf):
    p = points(spark, sf).withColumns({"tx": F.floor(F.col("x") / 10), "ty": F.floor(F.col("y") / 10)})
    return tiles.ground_slab(p, ["tx", "ty"], 4.0).select("pid")


@query(""", r as (select pid, scene, row_number() over (partition by scene order by pid) - 1 as rn, count(*) over (partition by scene) as n from points)
select pid, cast(floor(rn / 1024) as bigint) as patch, cast(rn % 1024 as bigint) as slot from r
union all select pid, cast(floor(n / 1024) as bigint), cast(rn - (n - 1024) + n % 1024 as bigint) from r where n > 1024 and n % 1024 > 0 and rn >= n - 1024 and rn < n - n % 1024""")
def patch_padding(spark, sf):
    return tiles.patch_padding(points(spark, sf), "scene", "pid", 1024).select("pid", F.col("patch").cast("long"), F.col("slot").cast("long"))


# rasters

_PX = "cast(floor(x / 5) as bigint) as px, cast(floor(y / 5) as bigint) as py"


@query(f"select {_PX}, z, segment, pid from points qualify row_number() over (partition by floor(x / 5), floor(y / 5) order by z desc, pid) = 1")
def topz_projection(spark, sf):
    return raster.top_z(points(spark, sf), 5.0, ["segment", "pid"])


@query(f""", c as (select {_PX}, segment, count(*) as n, min(pid) f from points where segment >= 0 group by 1, 2, 3)
select px, py, segment, n from c qualify row_number() over (partition by px, py order by n desc, f) = 1""")
def majority_projection(spark, sf):
    return raster.majority(points(spark, sf), 5.0, "segment")


@query(""", t as (select floor(x / 5) a, floor(y / 5) b, segment, pid from points qualify row_number() over (partition by floor(x / 5), floor(y / 5) order by z desc, pid) = 1)
select count(*) as n, cast(sum(case when p.segment = t.segment then 1 else 0 end) as bigint) as same, round(avg(case when p.segment = t.segment then 1.0::double else 0 end), 6) as share
from points p join t on floor(p.x / 5) = a and floor(p.y / 5) = b""")
def class_overlay(spark, sf):
    return raster.overlay_accuracy(points(spark, sf), 5.0)


@query("""select count(*) as points, count(distinct (floor(x / 5), floor(y / 5))) as pixels, count(*) - count(distinct (floor(x / 5), floor(y / 5))) as hidden from points""")
def overlay_count(spark, sf):
    return raster.overlay_count(points(spark, sf), 5.0)


_TOP = """, r as (select cast(floor(x / 2) as bigint) as px, cast(floor(y / 2) as bigint) as py, max(z) as z from points group by 1, 2)"""
_OFF = "(select a.i as dx, b.i as dy from (select unnest([-1, 0, 1]) i) a, (select unnest([-1, 0, 1]) i) b)"


def _sparse(spark, sf):
    return raster.pixels(points(spark, sf), 2.0).groupBy(*raster.PIXEL).agg(F.max("z").alias("z"))


@query(f"{_TOP} select r.px, r.py, round(avg(n.z), 6) as z from r, {_OFF} o join r n on n.px = r.px + dx and n.py = r.py + dy group by r.px, r.py".replace(f"from r, {_OFF} o join r n on", f"from r cross join {_OFF} o join r n on"))
def raster_mean(spark, sf):
    return rounded(raster.smooth(_sparse(spark, sf), "z"), ["z"])


@query(f"{_TOP} select r.px + dx as px, r.py + dy as py from r cross join {_OFF} o where z > 9 group by all")
def raster_dilate(spark, sf):
    return raster.dilate(_sparse(spark, sf).where("z > 9"))


@query(f"{_TOP}, m as (select px, py from r where z > 4) select m.px, m.py from m cross join {_OFF} o join m n on n.px = m.px + dx and n.py = m.py + dy group by m.px, m.py having count(*) = 9")
def raster_erode(spark, sf):
    return raster.erode(_sparse(spark, sf).where("z > 4"))


@query(f"""{_TOP}, b as (select min(px) a, max(px) b, min(py) c, max(py) d from r), h as (select px, py, z from r where z <= 9.5),
f as (select r.px + dx as px, r.py + dy as py, max(z) as z from h r cross join {_OFF} o group by 1, 2)
select px, py, z from h union all select f.px, f.py, f.z from f, (select min(px) a, max(px) b, min(py) c, max(py) d from h) where f.px between a and b and f.py between c and d and not exists (select 1 from h where h.px = f.px and h.py = f.py)""")
def raster_complete(spark, sf):
    return raster.complete(_sparse(spark, sf).where("z <= 9.5"), "z", rounds=1)


@query(f"""{_TOP} select r.px, r.py, round(sum(n.z * case when dx = 0 and dy = 0 then -4 when dx = 0 or dy = 0 then 1 else 0 end), 6) as z
from r cross join {_OFF} o join r n on n.px = r.px + dx and n.py = r.py + dy where dx = 0 or dy = 0 group by r.px, r.py""")
def raster_laplace(spark, sf):
    return rounded(raster.kernel(_sparse(spark, sf), "z", raster.LAPLACE), ["z"])


@query(f"""{_TOP}, m as (select r.px, r.py, avg(n.z) as z from r cross join {_OFF} o join r n on n.px = r.px + dx and n.py = r.py + dy group by r.px, r.py)
select r.px, r.py, round(abs(r.z - m.z), 6) as curvature from r join m using (px, py)""")
def raster_curvature(spark, sf):
    return rounded(raster.curvature(_sparse(spark, sf), "z"), ["curvature"])


@query(f""", l as (select cast(floor(x / 2) as bigint) as px, cast(floor(y / 2) as bigint) as py, min(segment) as segment from points group by 1, 2),
c as (select l.px, l.py, n.segment, count(*) k from l cross join {_OFF} o join l n on n.px = l.px + dx and n.py = l.py + dy group by all)
select px, py, arg_max(segment, k * 10 + segment) as segment from c group by px, py""")
def raster_mode(spark, sf):
    return raster.mode_pool(raster.pixels(points(spark, sf), 2.0).groupBy(*raster.PIXEL).agg(F.min("segment").alias("segment")), "segment")


@query(f"""{_TOP}, l as (select px, py, cast(floor(z) as bigint) % 3 as label from r), b as (select (max(px) - min(px) + 1) * (max(py) - min(py) + 1) as a from l)
select label, count(*) as n, round(100.0::double * count(*) / any_value(a), 6) as percent from l, b group by label""")
def fill_statistics(spark, sf):
    return raster.fill_stats(_sparse(spark, sf).select("px", "py", (F.floor("z") % 3).alias("label")), "label")


# The same over the raster of every point; checked by brute force in tests/test_whole.py.


def _full(spark, sf):
    return raster.pixels(points(spark, sf), 2.0).groupBy(*raster.PIXEL).agg(F.max("z").alias("z"))


@query(None)
def raster_mean_all(spark, sf):
    return rounded(raster.smooth(_full(spark, sf), "z"), ["z"])


@query(None)
def raster_dilate_all(spark, sf):
    return raster.dilate(_full(spark, sf).where("z > 9"))


@query(None)
def raster_erode_all(spark, sf):
    return raster.erode(_full(spark, sf).where("z > 4"))


@query(None)
def raster_complete_all(spark, sf):
    return raster.complete(_full(spark, sf).where("z <= 9.5"), "z", rounds=1)


@query(None)
def raster_laplace_all(spark, sf):
    return rounded(raster.kernel(_full(spark, sf), "z", raster.LAPLACE), ["z"])


@query(None)
def raster_curvature_all(spark, sf):
    return rounded(raster.curvature(_full(spark, sf), "z"), ["curvature"])


@query(None)
def fill_statistics_all(spark, sf):
    return raster.fill_stats(_full(spark, sf).select("px", "py", (F.floor("z") % 3).alias("label")), "label")


# merging of scores

_SCORES = """, s as (select pid, [cast(x % 7 as double), z % 3, cast(line as double)] as bev, [strength * 50, cast(segment as double), z / 3] as cloud from points),
e as (select pid, bev, cloud, list_transform(bev, lambda v: exp(v - list_max(bev))) as eb, list_transform(cloud, lambda v: exp(v - list_max(cloud))) as ec from s),
p as (select pid, bev, cloud, list_transform(eb, lambda v: v / (eb[1] + eb[2] + eb[3])) as pb, list_transform(ec, lambda v: v / (ec[1] + ec[2] + ec[3])) as pc from e)"""


def _scores(spark, sf):
    c = lambda e: F.expr(e).cast("double")
    return points(spark, sf).select("pid", F.array(c("x % 7"), c("z % 3"), c("line")).alias("bev"), F.array(c("strength * 50"), c("segment"), c("z / 3")).alias("cloud"))


@query(_SCORES + ", m as (select pid, [0.5 * pb[1] + (1 - 0.5) * pc[1], 0.5 * pb[2] + (1 - 0.5) * pc[2], 0.5 * pb[3] + (1 - 0.5) * pc[3]] as v from p) select pid, cast(list_position(v, list_max(v)) - 1 as integer) as label from m")
def merge_weighted(spark, sf):
    return raster.merge_weighted(_scores(spark, sf), "bev", "cloud").select("pid", "label")


@query(_SCORES + " select pid, cast(case when list_max(pc) > list_max(pb) then list_position(cloud, list_max(cloud)) else list_position(bev, list_max(bev)) end - 1 as integer) as label from p")
def merge_confidence(spark, sf):
    return raster.merge_confidence(_scores(spark, sf), "bev", "cloud").select("pid", "label")


@query(_SCORES + " select pid, cast(case when list_max(pc) > 0.7 then list_position(cloud, list_max(cloud)) else list_position(bev, list_max(bev)) end - 1 as integer) as label from p")
def merge_priority(spark, sf):
    return raster.merge_priority(_scores(spark, sf), "bev", "cloud").select("pid", "label")


# labels, colours, sets

#: Example palette and map of the queries.
PALETTE = {0: (85, 107, 47), 1: (0, 255, 0), 2: (255, 165, 0), 3: (41, 49, 101), 4: (0, 0, 255)}
MAPPING = {0: 0, 1: 0, 2: 1, 3: 2, 4: 2}


@query("select pid, case segment when 0 then 0 when 1 then 0 when 2 then 1 when 3 then 2 when 4 then 2 else -1 end as mapped from points")
def learning_map(spark, sf):
    return labels.learning_map(points(spark, sf), MAPPING, "segment", "mapped").select("pid", "mapped")


@query("""select pid, case segment when 0 then 85 when 1 then 0 when 2 then 255 when 3 then 41 else 0 end as r, case segment when 0 then 107 when 1 then 255 when 2 then 165 when 3 then 49 else 0 end as g,
case segment when 0 then 47 when 1 then 0 when 2 then 0 when 3 then 101 when 4 then 255 else 0 end as b, case when segment <= 4 then segment else -1 end as label from points""")
def colour_round_trip(spark, sf):
    return labels.colour_decode(labels.colour_map(points(spark, sf), PALETTE, "segment"), PALETTE).select("pid", "r", "g", "b", "label")


@query("select pid, case when segment in (3, 4) then 1 else segment end as merged from points")
def class_merge(spark, sf):
    return labels.merge_classes(points(spark, sf), {1: [3, 4]}, "segment", "merged").select("pid", "merged")


_RGB = ", c as (select pid, scene, cast(x * 5 as double) as r, cast(segment * 40 as double) as g, cast(line * 30 as double) as b from points)"


def _rgb(spark, sf):
    return points(spark, sf).select("pid", "scene", *[F.expr(f"cast({e} as double)").alias(n) for e, n in (("x * 5", "r"), ("segment * 40", "g"), ("line * 30", "b"))])


@query(_RGB + " select r, g, b, count(*) as n from c group by all having count(*) >= 5")
def unique_colours(spark, sf):
    return labels.unique_colours(_rgb(spark, sf), ["r", "g", "b"], 5)


@query(_RGB + " select pid, round(0.2989 * r + 0.587 * g + 0.114 * b, 6) as gray from c")
def grayscale(spark, sf):
    return colour.grayscale(_rgb(spark, sf)).select("pid", F.round("r", 6).alias("gray"))


@query(_RGB + """, m as (select *, greatest(r, g, b) as hi, least(r, g, b) as lo from c),
k as (select pid, hi, lo, (case when hi = lo then 0 when hi = r then (g - b) / (hi - lo) when hi = g then 2 + (b - r) / (hi - lo) else 4 + (r - g) / (hi - lo) end) / 6 as t from m)
select pid, round(t - floor(t), 6) as h, round(case when hi > 0 then (hi - lo) / hi else 0 end, 6) as s, hi as v from k""")
def rgb_to_hsv(spark, sf):
    return rounded(colour.rgb_to_hsv(_rgb(spark, sf)), ["h", "s"]).select("pid", "h", "s", "v")


@query(_RGB + " select pid, round(r, 6) as r, round(g, 6) as g, round(b, 6) as b from c")
def hsv_round_trip(spark, sf):
    return rounded(colour.hsv_to_rgb(colour.rgb_to_hsv(_rgb(spark, sf))), ["r", "g", "b"]).select("pid", "r", "g", "b")


@query(_RGB + """, m as (select scene, avg(0.2989 * r + 0.587 * g + 0.114 * b) as m from c group by scene)
select pid, round(greatest(least(r * 1.5 + m * -0.5, 255), 0), 5) as r, round(greatest(least(g * 1.5 + m * -0.5, 255), 0), 5) as g, round(greatest(least(b * 1.5 + m * -0.5, 255), 0), 5) as b from c join m using (scene)""")
def colour_contrast(spark, sf):
    return rounded(colour.contrast(_rgb(spark, sf), 1.5), ["r", "g", "b"], 5).select("pid", "r", "g", "b")


@query(_RGB + """, s as (select scene, min(r) lr, max(r) hr from c group by scene) select pid, round(case when hr > lr then (r - lr) * 255 / (hr - lr) else r end, 6) as r from c join s using (scene)""")
def auto_contrast(spark, sf):
    return rounded(colour.auto_contrast(_rgb(spark, sf)), ["r"]).select("pid", "r")


@query(""", i as (select pid, scene, line as instance from points), t as (select cast(floor(scene / 2) as bigint) as pair, max(instance) as top from i where scene % 2 = 0 group by 1)
select pid, cast(floor(scene / 2) as bigint) as pair, cast(case when scene % 2 = 1 then instance + coalesce(top + 1, 0) else instance end as integer) as instance from i left join t on t.pair = floor(scene / 2)""")
def mix3d_merge(spark, sf):
    return sets.mix_pairs(points(spark, sf).select("pid", "scene", F.col("line").alias("instance")), "scene", "instance").select("pid", "pair", "instance")


@query("select pid from points where segment <> 3")
def set_difference(spark, sf):
    p = points(spark, sf).select("pid", "segment")
    return sets.without(p, p.where("segment = 3"), ["pid"]).select("pid")


@query(""", i as (select scene, line as instance, count(*) as n, arg_min(segment, pid) as segment, min(x) as min_x, max(x) as max_x, min(y) as min_y, max(y) as max_y, min(z) as min_z, max(z) as max_z from points group by scene, line)
select *, dense_rank() over (partition by scene order by instance) - 1 as number from i""")
def instance_boxes(spark, sf):
    return labels.instances(points(spark, sf).withColumn("instance", F.col("line")), "instance", "segment", ["scene"])


@query(""", m as (select segment, row_number() over (partition by segment order by pid) as i, case when x > 25 then 1 else 0 end as mask from points),
c as (select *, case when mask <> coalesce(lag(mask) over (partition by segment order by i), -1) then 1 else 0 end as ch from m), g as (select *, sum(ch) over (partition by segment order by i) as g from c)
select segment, min(i) as start, count(*) as length from g where mask = 1 group by segment, g""")
def rle_runs(spark, sf):
    m = points(spark, sf).select("segment", "pid", F.when(F.col("x") > 25, 1).otherwise(0).alias("mask"))
    return labels.runs(numbered(m, ["segment"], ["pid"], "i").withColumn("i", F.col("i") + 1), ["segment"], "i", "mask")


@query(None)
def rle_runs_all(spark, sf):
    m = points(spark, sf).select("segment", "pid", F.when(F.col("x") > 25, 1).otherwise(0).alias("mask"))
    return labels.runs(numbered(m, ["segment"], ["pid"], "i").withColumn("i", F.col("i") + 1), ["segment"], "i", "mask")
