"""Queries over labels between sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import band as bd
from gridloom.operators.scratch import Scratch
from gridloom.plans.base import Tables, query

c = F.col

#: Rings of cells around a middle: some cells of each ring are sheets, few disagree.
_RINGS = """cells as (select z, y, x, case when h % 97 = 0 then 255 when d >= 2 and d % 3 = 0 and h % 4 <> 0 then 1 + 18 * (d // 3 + (case when h % 59 = 0 then 2 else 0 end)) else 0 end as code
    from (select z, y, x, h, cast(floor(sqrt((y - 11) * (y - 11) + (x - 11) * (x - 11))) as bigint) as d from (select l_orderkey % 9 as z, l_partkey % 23 as y, l_suppkey % 23 as x, cast(sum(l_linenumber + l_partkey) as bigint) as h from lineitem group by 1, 2, 3)))"""


def _rings(t: Tables) -> DataFrame:
    keys = [(c(k) % n).alias(a) for k, n, a in (("l_orderkey", 9, "z"), ("l_partkey", 23, "y"), ("l_suppkey", 23, "x"))]
    rows = t.lineitem.groupBy(*keys).agg(F.sum(c("l_linenumber") + c("l_partkey")).cast("long").alias("h"))
    d, h = F.floor(F.sqrt((c("y") - 11) * (c("y") - 11) + (c("x") - 11) * (c("x") - 11))), c("h")
    code = F.when(h % 97 == 0, 255).when((d >= 2) & (d % 3 == 0) & (h % 4 != 0), 1 + 18 * (F.floor(d / 3) + F.when(h % 59 == 0, 2).otherwise(0))).otherwise(0)
    return rows.select("z", "y", "x", code.cast("long").alias("code"))


@query(f"""with {_RINGS},
    s as (select z as sz, y as sy, x as sx, code as sc from cells where code between 1 and 254),
    n as (select z, y, x, min(struct_pack(d2 := (z - sz) * (z - sz) + (y - sy) * (y - sy) + (x - sx) * (x - sx), a := sz, b := sy, c := sx, k := sc)) as m from cells, s group by z, y, x),
    r as (select z, y, x, m.d2 as d2, m.k as k, pow(2 * y + 0.5 - 22 - z / 4, 2) + pow(2 * x + 0.5 - 23 + z / 8, 2) >= pow(2 * m.b + 0.5 - 22 - m.a / 4, 2) + pow(2 * m.c + 0.5 - 23 + m.a / 8, 2) as outer_ from n),
    b as (select z, y, x, d2, (k - 1 + case when outer_ then 9 else -9 end + 252) % 252 as band, outer_::int as side from r where d2 * 4 <= 25
        and not exists (select 1 from cells f where f.code = 255 and abs(f.z - r.z) <= 1 and abs(f.y - r.y) <= 1 and abs(f.x - r.x) <= 1)),
    j as (select p.z, p.y, p.x, q.z as qz, q.y as qy, q.x as qx from b p join b q on abs(p.z - q.z) + abs(p.y - q.y) + abs(p.x - q.x) = 1 where p.d2 > 1 and q.d2 > 1 and least((p.band - q.band + 252) % 252, (q.band - p.band + 252) % 252) >= 9),
    g as (select distinct b.z, b.y, b.x from b, (select distinct z, y, x from j) w where 4 * ((b.z - w.z) * (b.z - w.z) + (b.y - w.y) * (b.y - w.y) + (b.x - w.x) * (b.x - w.x)) <= 16)
    select k.z, k.y, k.x, case when g.z is null then coalesce(b.band, 255) else 255 end::int as band, case when g.z is null then coalesce(b.side, 255) else 255 end::int as side
    from cells k left join b on b.z = k.z and b.y = k.y and b.x = k.x left join g on g.z = k.z and g.y = k.y and g.x = k.x""")
def band_axis(t: Tables) -> DataFrame:
    """Turn and side of every cell around an axis that leans from plane to plane."""
    scratch = Scratch(t.spark)
    cells = scratch.save(_rings(t))
    axis = cells.select("z").distinct().select("z", (22 + c("z") / 4).alias("cy"), (23 - c("z") / 8).alias("cx"))
    return bd.band(cells, axis, radius=5, span=4, native=2, side=16, scratch=scratch)


@query(f"""with {_RINGS},
    s as (select z as sz, y as sy, x as sx, (code - 1) // 18 as k from cells where code between 1 and 254),
    n as (select z, y, x, code, k % 2 as odd, min(struct_pack(d2 := (z - sz) * (z - sz) + (y - sy) * (y - sy) + (x - sx) * (x - sx), a := sz, b := sy, c := sx, k := k)) as m from cells, s group by all),
    p as (select k.z, k.y, k.x, k.code, sqrt(e.m.d2) as de, sqrt(o.m.d2) as d1, (o.m.k - e.m.k + 14) % 14 as up, (e.m.a - k.z) * (o.m.a - k.z) + (e.m.b - k.y) * (o.m.b - k.y) + (e.m.c - k.x) * (o.m.c - k.x) as dot, e.m.d2 <= 49 and o.m.d2 <= 49 as near
        from cells k left join n e on e.z = k.z and e.y = k.y and e.x = k.x and e.odd = 0 left join n o on o.z = k.z and o.y = k.y and o.x = k.x and o.odd = 1),
    q as (select *, code between 1 and 254 as sheet, coalesce(near and up in (1, 13) and dot <= -0.5 * de * d1, false) as mid from p)
    select z, y, x, (case when sheet then 0 when mid then round_even(case when up = 1 then de else d1 end / (de + d1) * 252, 0) % 252 else 255 end)::int as phase,
        (case when not sheet and mid then least(greatest(round_even(de + d1, 0), 1), 255) else 0 end)::int as spacing from q""")
def band_phase_pair(t: Tables) -> DataFrame:
    """Place of every cell between the nearest even and the nearest odd sheet."""
    return bd.phase_pair(_rings(t), reach=7, side=16)
