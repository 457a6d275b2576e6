"""Queries over potentials: stitched gauges, unwrapped turns, floods, least-cost votes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import l1, potentials
from gridloom.plans.base import Tables, query

c, lit = F.col, F.lit

# nations and groups of customers as boxes; a customer says how two of them lie
_BOXES = "select box, cast(box % 7 as double) / 2 as low, cast(box % 7 as double) / 2 + 3 as high, box % 11 = 5 as excluded from (select distinct unnest([c_nationkey::bigint, c_custkey % 97 + 100]) as box from customer)"
_EDGES = "select c_nationkey::bigint as a, c_custkey % 97 + 100 as b, case when c_custkey % 3 = 0 then -1 else 1 end as s, c_custkey % 7 - 3 as k, cast(floor(c_acctbal) as bigint) % 97 as agree, c_custkey as weight from customer"
#: The forest edge by edge, best first: labels, signs and gauges of all boxes after each.
_FOREST = f"""with recursive x as (select row_number() over (order by box) as spot, * from ({_BOXES})),
    raw as ({_EDGES}),
    e as (select row_number() over (order by agree desc, weight desc) as i, raw.*, p.spot as ia, q.spot as ib from raw join x p on raw.a = p.box join x q on raw.b = q.box where agree >= 20 and weight >= 30 and not p.excluded and not q.excluded),
    t(i, lab, sg, g, tree) as (
        select 0::bigint, range(1, (select count(*) from x) + 1), list_transform(range(1, (select count(*) from x) + 1), lambda j: 1::bigint), list_transform(range(1, (select count(*) from x) + 1), lambda j: 0::bigint), false
        union all
        select e.i, case when u then list_transform(lab, lambda y: case when y = rb then ra else y end) else lab end,
            case when u then list_transform(range(1, len(lab) + 1), lambda j: case when lab[j] = rb then sg[j] * sx else sg[j] end) else sg end,
            case when u then list_transform(range(1, len(lab) + 1), lambda j: case when lab[j] = rb then sg[j] * kx + g[j] else g[j] end) else g end, u
        from (select t.lab, t.sg, t.g, e.i, lab[ia] as ra, lab[ib] as rb, lab[ia] <> lab[ib] as u, sg[ib] * e.s * sg[ia] as sx, sg[ib] * (e.s * g[ia] + e.k - g[ib]) as kx from t join e on e.i = t.i + 1) e),
    last as (select lab, sg, g from t order by i desc limit 1),
    n as (select x.*, lab[spot] as root, sg[spot] as s, g[spot] as g from x, last)"""


def _stitched(t: Tables) -> tuple[DataFrame, DataFrame]:
    edges = t.customer.select(c("c_nationkey").cast("long").alias("a"), (c("c_custkey") % 97 + 100).alias("b"), F.when(c("c_custkey") % 3 == 0, -1).otherwise(1).alias("s"), (c("c_custkey") % 7 - 3).alias("k"), (F.floor("c_acctbal") % 97).alias("agree"), c("c_custkey").alias("weight"))
    boxes = edges.select(F.explode(F.array("a", "b")).alias("box")).distinct()
    low = (c("box") % 7).cast("double") / 2
    return potentials.stitch(edges, boxes.select("box", low.alias("low"), (low + 3).alias("high"), (c("box") % 11 == 5).alias("excluded")), 20, 30)


@query(
    _FOREST
    + """, d as (select box, count(*) as degree from (select unnest([a, b]) as box from e) group by box),
    m as (select n.*, coalesce(degree, 0) as degree, -s * g as g0 from n left join d on n.box = d.box),
    l as (select *, row_number() over (partition by root order by degree desc, box) as r, count(*) over (partition by root) as size from m),
    p as (select root, s as turn, row_number() over (order by size desc, degree desc, box) - 1 as part from l where r = 1),
    v as (select box, part, m.s * turn as s, g0 * turn as g, low, high, min(case when m.s * turn > 0 then low else -high end + g0 * turn) over (partition by m.root) as least from m join p on m.root = p.root)
    select box, part::bigint as part, s::int as s, cast(g + 1 - floor(least) as bigint) as g from v"""
)
def stitch_gauges(t: Tables) -> DataFrame:
    return _stitched(t)[0]


@query(
    _FOREST
    + """, told as (select e.i, case when p.s * q.s <> e.s then 9999 else e.k - (q.g - e.s * p.g) end as residual from e join n p on e.a = p.box join n q on e.b = q.box)
    select raw.a, raw.b, raw.weight, e.i is not null as used, coalesce(t.tree, false) as tree, coalesce(told.residual, 0)::bigint as residual
    from raw left join e on raw.weight = e.weight left join t on e.i = t.i left join told on told.i = e.i"""
)
def stitch_residuals(t: Tables) -> DataFrame:
    return _stitched(t)[1].select("a", "b", "weight", "used", "tree", c("residual").cast("long").alias("residual"))


_CELLS = "select l_orderkey % 40 as z, l_partkey % 30 as y, l_suppkey % 20 as x, min((cast(l_quantity as bigint) * 5 + l_linenumber) % 252) as code, max(cast(l_quantity as bigint)) as sure from lineitem where l_linenumber <= 2 group by 1, 2, 3"


def _cells(t: Tables) -> DataFrame:
    rows = t.lineitem.where("l_linenumber <= 2")
    key = [(c(k) % n).alias(a) for k, n, a in (("l_orderkey", 40, "z"), ("l_partkey", 30, "y"), ("l_suppkey", 20, "x"))]
    whole = c("l_quantity").cast("long")
    return rows.groupBy(*key).agg(F.min((whole * 5 + c("l_linenumber")) % 252).alias("code"), F.max(whole).alias("sure"))


@query(f"""with recursive v as materialized (select row_number() over (order by z, y, x) - 1 as cell, * from ({_CELLS})),
    j as (select a.cell as a, b.cell as b, (b.code - a.code + 125 + 252) % 252 - 125 as d, a.code as ca, b.code as cb from v a join v b on (b.z = a.z and b.y = a.y and b.x = a.x + 1) or (b.z = a.z and b.y = a.y + 1 and b.x = a.x) or (b.z = a.z + 1 and b.y = a.y and b.x = a.x)),
    k as materialized (select a, b, cast(round((ca + d - cb) / 252) as bigint) as k from j where abs(d) <= 24),
    w as (select a, b, k from k union all select b, a, -k from k),
    r(root, cell, n) as (select cell, cell, 0::bigint from v union select root, w.b, (n + w.k + 64000) % 64 from r join w on r.cell = w.a),
    f as (select cell, min(root) as root from r group by cell),
    m as (select f.root, f.cell, min(n) as n, count(*) as ways from f join r on r.cell = f.cell and r.root = f.root group by all),
    p as (select root, count(*) as size from m group by root having count(*) >= 4 and max(ways) = 1),
    o as (select root, row_number() over (order by size desc, root) - 1 as part from p)
    select v.z, v.y, v.x, part::int as part, cast((floor(v.code / 4 + 0.5) + m.n * 63) % 252 as int) as code4 from m join o on m.root = o.root join v on v.cell = m.cell where part < 15""")
def unwrap_mod4(t: Tables) -> DataFrame:
    """Strict: a part with any conflict goes."""
    return potentials.unwrap_parts(_cells(t), 24, 4, 15, spare=0, share=1 << 40)


@query()
def flood_by_confidence(t: Tables) -> DataFrame:
    return potentials.flood_turns(_cells(t))


@query()
def patch_solve(t: Tables) -> DataFrame:
    """The least sum of votes, against that of no shifts."""
    at = t.customer.select(c("c_nationkey").cast("long").alias("a"), (c("c_custkey") % 97 + 100).alias("b"), (c("c_custkey") % 7 - 3).alias("d"), (F.floor(F.abs("c_acctbal")) % 50 + 1).cast("long").alias("w"))
    votes = l1.merge_votes(at)
    labels = l1.least_potentials(votes)
    flat = l1.energy(votes, labels.select("node", lit(0).alias("s"))).withColumnRenamed("energy", "flat")
    return l1.energy(votes, labels).crossJoin(F.broadcast(flat))
