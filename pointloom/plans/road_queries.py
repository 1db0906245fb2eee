"""Road queries over a mask that grows with its table: orders laid out in rows of 64 pixels, the cheaper ones being road."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointloom.operators import roads
from pointloom.plans.point_queries import query, rounded

_MASK = "m as (select distinct o_orderkey // 64 as px, o_orderkey % 64 as py from orders where o_totalprice < 300000)"
_AROUND = "o as (select * from (values " + ", ".join(f"({dx}, {dy}, {1 << i})" for i, (dx, dy) in enumerate(roads.AROUND)) + ") v(dx, dy, bit))"


def _gone(second: bool) -> str:
    return ", ".join(map(str, roads.removable(second)))


#: The mask after 60 passes of thinning, more than these masks need: a pass takes away the pixels whose code its rule names.
_THIN = f"""with recursive {_MASK}, {_AROUND},
t as (select 0 as it, px, py from m union all
  select it + 1, px, py from (select a.it, a.px, a.py, sum(case when b.px is null then 0 else bit end) as code
    from t a cross join o left join t b on b.px = a.px + dx and b.py = a.py + dy where a.it < 60 group by all)
  where not case when it % 2 = 0 then code in ({_gone(False)}) else code in ({_gone(True)}) end),
s as (select px, py from t where it = 60)"""


def _mask(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet").where("o_totalprice < 300000")
    key = F.col("o_orderkey").cast("long")
    return orders.select(F.floor(key / 64).alias("px"), (key % 64).alias("py"))


@query(f"{_THIN} select px, py from s", points_view=False)
def road_skeleton(spark, sf):
    return roads.skeleton(_mask(spark, sf))


@query(f"{_THIN} select a.px, a.py from s a cross join o join s b on b.px = a.px + dx and b.py = a.py + dy group by a.px, a.py having count(*) = 1", points_view=False)
def skeleton_ends(spark, sf):
    return roads.end_points(roads.skeleton(_mask(spark, sf)))


@query(None)
def skeleton_rays(spark, sf):
    mask = _mask(spark, sf)
    skel = roads.skeleton(mask)
    return rounded(roads.cast_rays(mask, roads.directions(skel, roads.end_points(skel))), ["dx", "dy"])


@query(None)
def road_gaps(spark, sf):
    mask = _mask(spark, sf)
    return roads.gaps(mask, roads.pieces(mask), outward=True)


@query(None)
def stitched_roads(spark, sf):
    return roads.stitched(_mask(spark, sf), rounds=3, outward=True)
