"""More commands: those with one numeric kernel, as far as SQL expresses them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import circular
from gridloom.operators import joins, windows
from gridloom.plans.base import Tables, query, sql

_P = "2 * pi() / 252"

# -- nearest neighbours and bands ------------------------------------------------------


@query("""with h as (select c_custkey as id, c_custkey % 211 as a, c_acctbal / 40 as b, c_nationkey as t from customer where c_custkey % 2 = 0), v as (select c_custkey as id, c_custkey % 211 as a, c_acctbal / 40 as b, c_nationkey as t from customer where c_custkey % 2 = 1),
    m as (select h.id, h.t, arg_min(v.t, (pow(h.a - v.a, 2) + pow(h.b - v.b, 2)) * 1e6 + v.id / 1e6) as vt, min(pow(h.a - v.a, 2) + pow(h.b - v.b, 2)) as d2 from h join v on pow(h.a - v.a, 2) + pow(h.b - v.b, 2) <= 225 group by 1, 2)
    select cast(floor(sqrt(d2) / 3) as bigint) as bin, cast(count(*) as bigint) as n, round(avg(t - vt), 6) as turn from m group by 1""")
def fiber_contacts(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    p = t.customer.select(k.alias("id"), (k % 211).cast("double").alias("a"), (F.col("c_acctbal") / 40).alias("b"), F.col("c_nationkey").alias("t"))
    rank = lambda d2, other: d2 * F.lit(1e6) + other / F.lit(1e6)
    near = joins.nearest(p.where("id % 2 = 0"), p.where("id % 2 = 1").withColumnRenamed("id", "other"), ["a", "b"], "id", "other", 15.0, rank=rank, slack=1e-3)
    both = near.join(p.select("id", "t"), "id").join(p.select(F.col("id").alias("other"), F.col("t").alias("vt")), "other")
    return both.groupBy(F.floor(F.sqrt("d2") / 3).alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("t") - F.col("vt")), 6).alias("turn"))


_GT = "with p as (select c_custkey as id, c_custkey % 211 as a, c_acctbal / 40 as b from customer), q as (select s_suppkey * 2 as a, s_acctbal / 40 as b from supplier)"


@query(_GT + """, d as (select p.id, min(pow(p.a - q.a, 2) + pow(p.b - q.b, 2)) as d2 from p join q on pow(p.a - q.a, 2) + pow(p.b - q.b, 2) <= 900 group by 1)
    select cast(floor(sqrt(d2) / 5) as bigint) as bin, cast(count(*) as bigint) as n from d group by 1""")
def gt_support(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    p = t.customer.select(k.alias("id"), (k % 211).cast("double").alias("a"), (F.col("c_acctbal") / 40).alias("b"))
    q = t.supplier.select(F.col("s_suppkey").alias("near"), (F.col("s_suppkey") * 2).cast("double").alias("a"), (F.col("s_acctbal") / 40).alias("b"))
    return joins.nearest(p, q, ["a", "b"], "id", "near", 30.0).groupBy(F.floor(F.sqrt("d2") / 5).alias("bin")).agg(F.count("*").alias("n"))


@query(_GT.replace("select s_suppkey * 2 as a", "select s_suppkey % 2 as parity, s_suppkey * 2 as a") + """, d as (select p.id, min(case when parity = 0 then sqrt(pow(p.a - q.a, 2) + pow(p.b - q.b, 2)) end) as d0, min(case when parity = 1 then sqrt(pow(p.a - q.a, 2) + pow(p.b - q.b, 2)) end) as d1
      from p join q on pow(p.a - q.a, 2) + pow(p.b - q.b, 2) <= 3600 group by 1)
    select id, round(d0 / (d0 + d1), 6) as phase from d where d0 is not null and d1 is not null""")
def phase_raster(t: Tables) -> DataFrame:
    """Pair rule: the share of the way from the nearest even to the nearest odd sheet."""
    k = F.col("c_custkey")
    p = t.customer.select(k.alias("id"), (k % 211).cast("double").alias("a"), (F.col("c_acctbal") / 40).alias("b"))
    q = t.supplier.select(F.col("s_suppkey").alias("near"), (F.col("s_suppkey") * 2).cast("double").alias("a"), (F.col("s_acctbal") / 40).alias("b"))
    side = lambda n: joins.nearest(p, q.where(f"near % 2 = {n}"), ["a", "b"], "id", "near", 60.0).select("id", F.sqrt("d2").alias(f"d{n}"))
    return side(0).join(side(1), "id").select("id", F.round(F.col("d0") / (F.col("d0") + F.col("d1")), 6).alias("phase"))


@query("""with q as (select c_custkey as id, c_acctbal as a from customer), t as (select s_acctbal as b from supplier)
    select id, round((select min(abs(a - b)) from t where abs(a - b) <= 400), 6) as d from q""")
def wrapdist(t: Tables) -> DataFrame:
    """Distance to the nearest labelled value, null beyond the largest distance asked for."""
    q = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("a"))
    knots = t.supplier.select(F.col("s_suppkey").alias("near"), F.col("s_acctbal").alias("a"))
    near = joins.closest_on_line(q.select("a").distinct(), knots, [], "a", "near", 50.0).where("apart <= 400").select("a", "apart")
    return q.join(near, "a", "left").select("id", F.round("apart", 6).alias("d"))


# -- lines and rays ----------------------------------------------------------------------


@query()
def fiber_judge(t: Tables) -> DataFrame:
    p = t.phases.where("code is not null").select("user_id", "event_id", (F.col("code") / 63.0).alias("turn"))
    return windows.switches(p, ["user_id"], "event_id", "turn", 0.6)


sql("fill_oracle", """
    with g as (select user_id, event_id, code, count(code) over (partition by user_id order by event_id rows between unbounded preceding and current row) as span from {phases}),
    a as (select user_id, span, min(event_id) as e0, max(code) as c0 from g group by 1, 2),
    b as (select user_id, span, e0, c0, lead(e0) over (partition by user_id order by span) as e1, lead(c0) over (partition by user_id order by span) as c1 from a)
    select g.user_id, g.event_id, round(case when code is not null then code when c0 is not null and c1 is not null then c0 + (c1 - c0) * cast(g.event_id - e0 as double) / (e1 - e0) end, 6) as filled
    from g join b on g.user_id = b.user_id and g.span = b.span""")
sql("fields_derive", """
    with g as (select user_id, event_id, value, lead(value) over (partition by user_id order by event_id) as n, lag(value) over (partition by user_id order by event_id) as p from {events})
    select event_id, round((n - p) / 2, 6) as slope, round(1 / nullif(abs(n - p) / 2, 0), 6) as spacing, round((n - p) * (n - p) / (1 + (n - p) * (n - p)), 6) as nn from g where n is not null and p is not null""")
sql("cf_demod", f"""
    with s as (select cast(floor(event_id / 500) as bigint) as band, value as c, code * {_P} - event_id * 1e-3 as a from {{phases}} where code is not null)
    select band, round(sum(c * cos(a)) / sum(c), 5) as pc, round(sum(c * sin(a)) / sum(c), 5) as ps, round(sum(c), 4) as weight from s group by 1""".replace("{{", "{").replace("}}", "}"))
sql("ct_cal", """
    with c as (select cast(user_id % 20 as bigint) as cell, sum(case when value >= 30 then 1 else 0 end) as peaks, count(*) as turns from {events} group by 1),
    s as (select a.cell, sum(b.peaks) as peaks, sum(b.turns) as turns from c a join c b on b.cell in (a.cell, (a.cell + 1) % 20, (a.cell + 19) % 20) group by a.cell),
    w as (select sum(peaks) / cast(sum(turns) as double) as k from c)
    select cell, round(case when turns >= 30 then peaks / cast(turns as double) else k end, 9) as k from s cross join w""")
sql("self_gate", """
    with m as (select user_id, event_id, case when value >= 15 then 1 else 0 end as ok from {events}),
    c as (select user_id, event_id, ok, case when lag(ok) over (partition by user_id order by event_id) = ok then 0 else 1 end as nw from m),
    r as (select user_id, event_id, ok, sum(nw) over (partition by user_id order by event_id rows between unbounded preceding and current row) as run from c),
    l as (select user_id, event_id, ok, count(*) over (partition by user_id, run) as n from r)
    select user_id, event_id from l where ok = 1 and n >= 3""")
sql("wrap_check", """
    with x as (select l_suppkey as ray, l_orderkey as at, lead(l_orderkey) over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey) as nx from {lineitem} where l_linenumber = 1),
    p as (select l_suppkey as ray, l_orderkey as at from {lineitem} where l_linenumber = 3),
    k as (select x.ray, x.at, x.nx, count(p.at) as peaks from x left join p on p.ray = x.ray and p.at >= x.at and p.at < x.nx where x.nx is not null group by 1, 2, 3)
    select ray, cast(count(*) as bigint) as gaps, cast(sum(case when peaks = 0 then 1 else 0 end) as bigint) as dup, cast(sum(case when peaks = 1 then 1 else 0 end) as bigint) as real_, cast(sum(case when peaks > 1 then 1 else 0 end) as bigint) as merged from k group by 1""")
sql("wrap_repair", """
    with r as (select l_suppkey as ray, l_orderkey as place, l_linenumber as wrap, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey) as i, lag(l_orderkey) over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey) as p from {lineitem})
    select ray, cast(sum(case when p is null or place - p >= 2 then 1 else 0 end) as bigint) as kept, cast(sum(case when place - p < 2 then 1 else 0 end) as bigint) as repaired from r group by 1""")
sql("gt_trans", """
    with r as (select l_suppkey as ray, cast(floor(l_partkey / 100) as bigint) as turn, case when l_quantity >= 25 then 1 else 0 end as side, l_orderkey, l_linenumber, l_partkey from {lineitem}),
    f as (select ray, turn, case when side <> lag(side) over (partition by ray, turn order by l_orderkey, l_linenumber, l_partkey, side) then 1 else 0 end as flip from r)
    select turn, cast(sum(flip) as bigint) as flips, cast(count(*) as bigint) as n from f group by 1""")
sql("gt_gate", """
    with c as (select cast(floor(l_orderkey / 200) as bigint) as cell, avg(case when l_quantity >= 20 then 1e0 else 0e0 end) as support from {lineitem} group by 1)
    select cell, round(support, 9) as support, case when support < 6e-1 then 1 else 0 end as ignored from c""")
sql("side_face", f"""
    with w as (select user_id, event_id, code, event_type, row_number() over (partition by user_id order by event_id desc) as step from {{phases}} where code is not null),
    f as (select user_id, code from w where step = 1), c as (select user_id % 100 as cell, sum(cos(code * {_P})) as c, sum(sin(code * {_P})) as s, count(*) as n from f group by 1)
    select cell, cast(n as bigint) as n, case when n >= 3 and sqrt(c * c + s * s) >= 5e-1 * n then round(sqrt(c * c + s * s) / n, 6) end as resultant from c""".replace("{{", "{").replace("}}", "}"))

# -- rasters, labels and patches ---------------------------------------------------------

sql("mesh_raster", """
    with s as (select cast(floor(c_acctbal / 50 + 5e-1) as bigint) as a, cast(floor(c_nationkey + 5e-1) as bigint) as b, c_custkey as ord, c_custkey % 252 as code from {customer}),
    f as (select a, b, code as first from (select *, row_number() over (partition by a, b order by ord) as i from s) u where i = 1)
    select f.a, f.b, case when max(abs(((s.code - first + 126) % 252 + 252) % 252 - 126)) > 4 then 255 else max(first) end as code from f join s on f.a = s.a and f.b = s.b group by 1, 2""")
sql("ink_splat", """
    with h as (select cast(floor(l_orderkey / 3) as bigint) as z, cast(floor(l_suppkey / 5) as bigint) as x, sum(case when l_returnflag = 'R' then 1 else 0 end) as ink, count(*) as n, max(l_quantity) as top from {lineitem} group by 1, 2)
    select z, x, cast(ink as bigint) as ink, cast(n as bigint) as n, case when ink * 2 >= n then 254 when top > 30 then 0 else 255 end as label from h""")
sql("block_best_source", """
    with b as (select cast(floor(l_orderkey / 256) as bigint) as blk, l_returnflag as src, avg(l_quantity) as m from {lineitem} group by 1, 2),
    r as (select *, row_number() over (partition by blk order by round(m, 9) desc, src) as i from b)
    select blk, src, round(m, 6) as m from r where i = 1""")
sql("patch_id_contacts", """
    with e as (select l_suppkey % 40 as a, 100 + l_partkey % 40 as b, count(*) as w from {lineitem} group by 1, 2),
    r as (select *, row_number() over (partition by a order by w desc, b) as ra, row_number() over (partition by b order by w desc, a) as rb, lead(w) over (partition by a order by w desc, b) as w2 from e)
    select a, b, cast(w as bigint) as w, round(w2 / cast(w as double), 9) as ratio from r where ra = 1 and rb = 1""")
sql("patch_score", """
    with p as (select l_suppkey as patch, l_partkey % 7 as code, count(*) as n from {lineitem} group by 1, 2), g as (select patch, max(n) as top, sum(n) as total from p group by 1)
    select round(avg(top / cast(total as double)), 9) as purity, cast(sum(total) as bigint) as n, cast(count(*) as bigint) as patches from g""")
sql("wrap_anchor", """
    with o as (select cast(floor(l_orderkey / 512) as bigint) as cell, (l_partkey - l_suppkey) % 5 as off, count(*) as n from {lineitem} group by 1, 2),
    r as (select *, row_number() over (partition by cell order by n desc, off) as i, sum(n) over (partition by cell) as total from o)
    select cell, cast(off as bigint) as off, round(n / cast(total as double), 9) as share from r where i = 1""")
sql("stitch_align", """
    with d as (select a.l_suppkey % 10 as box_a, b.l_suppkey % 10 as box_b, b.l_linenumber - a.l_linenumber as k from {lineitem} a join {lineitem} b on a.l_orderkey = b.l_orderkey and a.l_suppkey % 10 < b.l_suppkey % 10),
    c as (select box_a, box_b, k, count(*) as n from d group by 1, 2, 3), r as (select *, row_number() over (partition by box_a, box_b order by n desc, k) as i, sum(n) over (partition by box_a, box_b) as total from c)
    select box_a, box_b, k, cast(n as bigint) as n, round(n / cast(total as double), 9) as agree from r where i = 1""")
sql("vwt_stitch", """
    with s as (select cast(floor(l_orderkey / 2000) as bigint) as slab, l_partkey as p, avg(l_quantity) as v from {lineitem} group by 1, 2)
    select a.slab, cast(count(*) as bigint) as n, round(median(b.v - a.v), 6) as off from s a join s b on b.slab = a.slab + 1 and a.p = b.p group by 1""")
sql("sr_pairs", """
    with c as (select doc_id, source, n_chars, row_number() over (partition by source order by n_chars desc, doc_id) as i from {documents} d where not exists (select 1 from {labels} l where l.doc_id = d.doc_id))
    select source, doc_id, cast(i as int) as place from c where i <= 3""")
sql("weighted_sample", """
    select o_orderkey, o_totalprice from {orders} where (o_orderkey * 2654435761) % 4294967296 < o_totalprice * 2000""")
sql("trace_prep_seeds", """
    with r as (select l_suppkey as ray, l_orderkey as place, l_quantity as p, lag(l_quantity) over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_quantity) as b, lead(l_quantity) over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_quantity) as n from {lineitem}),
    m as (select ray, place, p from r where p >= 40 and (b is null or p > b) and (n is null or p >= n))
    select ray, place, p from m order by (place * 2654435761 + ray * 40503) % 4294967296, ray, place, p limit 64""")
sql("fiber_raster", """
    with s as (select user_id, event_id, value from {events}),
    o as (select cast(floor(value) as bigint) + d as cell, abs(value - (floor(value) + d + 5e-1)) as dist from s cross join (select -1 as d union all select 0 union all select 1) u)
    select cell, case when min(dist) <= 75e-2 then 254 when min(dist) <= 125e-2 then 255 else 0 end as label from o group by 1""")
sql("surf_resample", """
    with a as (select s_suppkey as id, s_acctbal as v, s_nationkey as b from {supplier}), q as (select c_custkey as id, c_nationkey as b, c_acctbal as v from {customer}),
    p as (select q.id, a.id as src, abs(q.v - a.v) as d, row_number() over (partition by q.id order by abs(q.v - a.v), a.id) as i from q join a on a.b = q.b)
    select id, case when d <= 400 then src end as src, round(least(d, 400), 6) as d from p where i = 1""")
sql("stretch_percentiles", """
    select c_nationkey, round(quantile_cont(c_acctbal, 0.02::double), 6) as lo, round(quantile_cont(c_acctbal, 0.98::double), 6) as hi from {customer} group by 1""",
    """select c_nationkey, round(percentile(c_acctbal, 0.02D), 6) as lo, round(percentile(c_acctbal, 0.98D), 6) as hi from {customer} group by 1""")
sql("affine_map", """
    select c_custkey, round(9e-1 * c_acctbal - 1e-1 * c_nationkey + 5, 6) as u, round(1e-1 * c_acctbal + 9e-1 * c_nationkey - 3, 6) as v from {customer}""")
sql("unroll_gates", """
    select event_type, round(avg(case when value >= 20 then 1e0 else 0e0 end), 9) as confident, round(avg(case when code is null then 1e0 else 0e0 end), 9) as unknown, cast(count(*) as bigint) as n from {phases} group by 1""")

# -- set operations, grouping sets and time windows (offered beside the commands) --------

sql("set_union_cover", "select distinct k from (select l_partkey % 500 as k from {lineitem} union all select p_partkey % 700 from {part}) u")
sql("set_intersect_known", "select o_custkey as k from {orders} intersect select c_custkey from {customer} where c_acctbal > 0")
sql("set_except_done", "select o_orderkey as k from {orders} except select l_orderkey from {lineitem} where l_returnflag = 'R'")
sql("grouping_sets_regions", """
    select coalesce(l_returnflag, 'all') as flag, coalesce(l_linestatus, 'all') as status, cast(count(*) as bigint) as n, round(avg(l_quantity), 6) as mean from {lineitem} group by grouping sets ((l_returnflag, l_linestatus), (l_returnflag), ())""")


@query("""with m as (select user_id, ts, value, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 6 hour then 0 else 1 end as nw, event_id from events),
    r as (select user_id, ts, value, sum(nw) over (partition by user_id order by ts, event_id rows unbounded preceding) as run from m)
    select user_id, cast(count(*) as bigint) as n, round(sum(value), 4) as total from r group by user_id, run""")
def session_windows(t: Tables) -> DataFrame:
    e = t.events.withColumn("t", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("t", "6 hours")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("user_id", "n", "total")


@query("""with w as (select date_trunc('hour', ts) - interval (k) hour as s, value from events, range(0, 4) as g(k))
    select strftime(s, '%Y-%m-%d %H') as start, cast(count(*) as bigint) as n, round(sum(value), 4) as total from w group by 1""")
def sliding_windows(t: Tables) -> DataFrame:
    e = t.events.withColumn("t", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("t", "4 hours", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.date_format("w.start", "yyyy-MM-dd HH").alias("start"), "n", "total")


@query("""with d as (select user_id, ((code - lag(code) over (partition by user_id order by event_id) + 126) % 252 + 252) % 252 - 126 as d from {phases} where code is not null)
    select user_id, cast(count(*) as bigint) as n, round(avg(abs(d)), 6) as mean from d where d is not null group by 1""")
def circular_steps(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    d = t.phases.where("code is not null").select("user_id", circular.code_diff(F.col("code"), F.lag("code").over(w)).alias("d")).where("d is not null")
    return d.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg(F.abs("d")), 6).alias("mean"))
