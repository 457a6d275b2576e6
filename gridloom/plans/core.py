"""Queries over the operator library, one or more for each family of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import circular
from gridloom.operators import fuse, joins, pooling, quantiles, stats, windows
from gridloom.plans.base import Tables, query
from gridloom.sources import boxscan

_HIST = "h as (select p, cast(count(*) filter (where truth = 1) as bigint) as pos, cast(count(*) filter (where truth = 0) as bigint) as neg from {scored} where truth is not null group by p)"


@query("""select cast(count(*) as bigint) as n, round(avg(case when v <> 0 then 1.0 else 0.0 end), 6) as nonzero, round(avg(v), 6) as mean, min(v) as low, max(v) as high
    from {voxels} where z >= 1000 and z < 9000 and y >= 100 and y < 900 and x >= 10 and x < 70""")
def box_scan_stats(t: Tables) -> DataFrame:
    return boxscan.box(t.voxels, (1000, 100, 10), (8000, 800, 60)).agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("v") != 0, 1.0).otherwise(0.0)), 6).alias("nonzero"), F.round(F.avg("v"), 6).alias("mean"), F.min("v").alias("low"), F.max("v").alias("high"))


@query("select y, x, v from {voxels} where z = 7")
def slice_plane(t: Tables) -> DataFrame:
    return t.voxels.where("z = 7").select("y", "x", "v")


@query(f"""with {_HIST}, cuts(thr, cut) as (values (0.3::double, 76), (0.5::double, 127), (0.7::double, 178)),
    c as (select thr, cut, cast(coalesce(sum(pos), 0) as bigint) as tp, cast(coalesce(sum(neg), 0) as bigint) as fp from cuts left join h on p >= cut group by thr, cut),
    n as (select sum(pos) as n_pos from h),
    s as (select thr, cut, tp, fp, case when tp + fp > 0 then tp / (tp + fp)::double end as pr, tp / n_pos::double as re from c, n)
    select thr, cut, tp, fp, round(pr, 9) as precision, round(re, 9) as recall, round(2 * pr * re / (pr + re), 9) as f1 from s""")
def eval_thresholds(t: Tables) -> DataFrame:
    out = stats.at_thresholds(stats.class_histogram(t.scored, "p", "truth"), "p", [0.3, 0.5, 0.7])
    return out.select("thr", "cut", "tp", "fp", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


@query("""select coalesce(lang, 'all') as region, cast(count(*) filter (where p >= 127 and truth = 1) as bigint) as tp, cast(count(*) filter (where p >= 127 and truth = 0) as bigint) as fp, cast(count(*) filter (where p < 127 and truth = 1) as bigint) as fn,
    round((2 * sum(p / 255.0::double * truth) + 1) / (sum(p / 255.0::double) + sum(truth) + 1), 9) as dice from {scored} where truth is not null group by rollup(lang)""")
def eval_regions_rollup(t: Tables) -> DataFrame:
    p, g = F.col("p"), F.col("truth")
    soft = (2 * F.sum(p / 255.0 * g) + 1) / (F.sum(p / 255.0) + F.sum(g) + 1)
    out = t.scored.where(g.isNotNull()).rollup("lang").agg(F.count_if((p >= 127) & (g == 1)).alias("tp"), F.count_if((p >= 127) & (g == 0)).alias("fp"), F.count_if((p < 127) & (g == 1)).alias("fn"), F.round(soft, 9).alias("dice"))
    return out.select(F.coalesce("lang", F.lit("all")).alias("region"), "tp", "fp", "fn", "dice")


@query(f"""with {_HIST}, b as (select *, coalesce(sum(neg) over (order by p rows between unbounded preceding and 1 preceding), 0) as below from h)
    select round(sum(pos * (below + 0.5::double * neg)) / (sum(pos) * sum(neg)), 9) as auc from b""")
def auc_hist256(t: Tables) -> DataFrame:
    return stats.auc_from_histogram(stats.class_histogram(t.scored, "p", "truth"), "p").select(F.round("auc", 9).alias("auc"))


@query("""with r as (select truth, rank() over (order by n_chars) + (count(*) over (partition by n_chars) - 1) / 2.0::double as r from {scored} where truth is not null)
    select round((sum(r) filter (where truth = 1) - count(*) filter (where truth = 1) * (count(*) filter (where truth = 1) + 1) / 2.0::double) / (count(*) filter (where truth = 1) * count(*) filter (where truth = 0)), 9) as auc from r""")
def auc_exact(t: Tables) -> DataFrame:
    r = stats.average_ranks(t.scored.where("truth is not null"), "n_chars")
    pos, neg = F.count_if(F.col("truth") == 1), F.count_if(F.col("truth") == 0)
    return r.agg(F.round((F.sum(F.when(F.col("truth") == 1, F.col("rank"))) - pos * (pos + 1) / 2) / (pos * neg), 9).alias("auc"))


@query(f"""with {_HIST}, c as (select p, sum(pos) over (order by p desc rows unbounded preceding) as tp, sum(neg) over (order by p desc rows unbounded preceding) as fp, sum(pos) over () as n_pos from h),
    f as (select p, round(2.0::double * tp / (tp + fp + n_pos), 12) as f1 from c)
    select f1, min(p) as threshold from f where f1 = (select max(f1) from f) group by f1""")
def best_f1(t: Tables) -> DataFrame:
    return stats.best_f1(stats.class_histogram(t.scored, "p", "truth"), "p")


_LINE = "h as (select cast(floor(l_quantity) as int) as v, cast(count(*) as bigint) as n from lineitem group by 1)"


def _line_hist(t: Tables) -> DataFrame:
    return t.voxels.groupBy("v").agg(F.count("*").alias("n"))


@query(f"""with {_LINE}, w as (select v, sum(n) over (order by v rows unbounded preceding) as n, sum(n * v) over (order by v rows unbounded preceding) as s, sum(n) over () as tn, sum(n * v) over () as ts from h),
    g as (select v, case when tn > n then round(n * (tn - n) * pow(s / n::double - (ts - s) / (tn - n)::double, 2) / pow(tn, 2), 9) else 0 end as var from w)
    select cast(floor((min(v) + max(v)) / 2) as bigint) as cut, max(var) as variance from g where var = (select max(var) from g)""")
def otsu_256(t: Tables) -> DataFrame:
    return stats.otsu(_line_hist(t), "v", "n")


@query(f"""with {_LINE}, c as (select v, sum(n) over (order by v rows unbounded preceding) as cum, sum(n) over () as total from h)
    select q, min(v) as value from c, (values (0.1::double), (0.5::double), (0.9::double)) as qs(q) where cum >= q * total group by q""")
def hist_quantile(t: Tables) -> DataFrame:
    parts = [stats.quantile_of_histogram(_line_hist(t), "v", "n", q).select(F.lit(q).alias("q"), F.col("value")) for q in (0.1, 0.5, 0.9)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""select l_returnflag, round(quantile_cont(l_extendedprice, 0.025::double), 6) as p025, round(quantile_cont(l_extendedprice, 0.5::double), 6) as p50, round(quantile_cont(l_extendedprice, 0.975::double), 6) as p975 from lineitem group by l_returnflag""")
def percentile_linear(t: Tables) -> DataFrame:
    got = quantiles.quantiles(t.lineitem, ["l_returnflag"], "l_extendedprice", {"p025": 0.025, "p50": 0.5, "p975": 0.975})
    return got.select("l_returnflag", *(F.round(n, 6).alias(n) for n in ("p025", "p50", "p975")))


@query("""with r as (select c_nationkey, c_acctbal, row_number() over (partition by c_nationkey order by c_acctbal, c_custkey) as i, count(*) over (partition by c_nationkey) as n from customer)
    select c_nationkey, c_acctbal as median_upper from r where i = n // 2 + 1""")
def median_upper(t: Tables) -> DataFrame:
    return quantiles.upper_median(t.customer, ["c_nationkey"], "c_acctbal", "median_upper")


@query("""with m as (select c_nationkey, median(c_acctbal) as med from customer group by 1)
    select c.c_nationkey, round(1.4826::double * median(abs(c_acctbal - med)), 6) as scale from customer c join m on c.c_nationkey = m.c_nationkey group by 1""")
def mad_scale(t: Tables) -> DataFrame:
    return quantiles.deviation_scale(t.customer, ["c_nationkey"], "c_acctbal").withColumn("scale", F.round("scale", 6))


_PH = "2 * pi() / 252"


@query(f"""with s as (select event_type, sum(cos(code * {_PH})) as c, sum(sin(code * {_PH})) as s, count(code) as n from {{phases}} where code is not null group by 1)
    select event_type, n, round(c, 5) as c, round(s, 5) as s, round(sqrt(c * c + s * s) / n, 7) as resultant from s""")
def circular_mean_by_type(t: Tables) -> DataFrame:
    c, s = circular.phasor(F.col("code"))
    g = t.phases.where("code is not null").groupBy("event_type").agg(F.sum(c).alias("c"), F.sum(s).alias("s"), F.count("code").alias("n"))
    return g.select("event_type", "n", F.round("c", 5).alias("c"), F.round("s", 5).alias("s"), F.round(F.hypot("c", "s") / F.col("n"), 7).alias("resultant"))


@query(f"""with g as (select user_id % 500 as cell, cast(floor(event_id / 500) as bigint) % 4 as part, code from {{phases}}),
    k as (select cell, part, code from g where code is not null),
    d as (select a.cell, a.part, max(abs(((a.code - b.code + 126) % 252 + 252) % 252 - 126)) as far from k a join k b on a.cell = b.cell and a.part = b.part group by 1, 2),
    s as (select cell, part, count(code) as n_known, sum(cos(code * {_PH})) as c, sum(sin(code * {_PH})) as s, max(code) as one from g group by 1, 2)
    select s.cell, s.part, n_known, case when n_known = 0 then 'none' when n_known = 1 then 'single' when far > 30 then 'conflict' else 'agree' end as outcome,
        case when n_known = 1 then one when n_known > 1 and far <= 30 then ((cast(round(atan2(s, c) * 252 / (2 * pi())) as int) % 252) + 252) % 252 end as code
    from s left join d on s.cell = d.cell and s.part = d.part""")
def phase_fuse_tol(t: Tables) -> DataFrame:
    cells = t.phases.select((F.col("user_id") % 500).alias("cell"), (F.floor(F.col("event_id") / 500) % 4).alias("part"), "code")
    return fuse.fuse_phase(cells, ["cell", "part"], "code", 30)


@query(f"""with g as (select user_id % 200 as cell, code, cast(1 + event_id % 5 as int) as w from {{phases}} where code is not null),
    c as (select a.cell, a.code, a.w, round(sum(b.w * (1 - cos((a.code - b.code) * {_PH}))), 9) as cost from (select distinct cell, code, w from g) a join g b on a.cell = b.cell group by 1, 2, 3),
    r as (select cell, code, cost, row_number() over (partition by cell order by cost, w desc, code) as i from c)
    select cell, code, round(cost, 6) as cost from r where i = 1""")
def phase_medoid(t: Tables) -> DataFrame:
    g = t.phases.select((F.col("user_id") % 200).alias("cell"), "code", (1 + F.col("event_id") % 5).cast("int").alias("w"))
    return fuse.medoid(g, ["cell"], "code", "w").select("cell", "code", F.round("cost", 6).alias("cost"))


@query("""select user_id % 1000 as cell, cast(least(sum(case when event_type = 'click' then 1 else 0 end), 15) as int) as r, cast(least(sum(case when event_type <> 'click' then 1 else 0 end), 15) as int) as v from events group by 1""")
def vote_sum_saturating(t: Tables) -> DataFrame:
    e = t.events.select((F.col("user_id") % 1000).alias("cell"), F.when(F.col("event_type") == "click", 1).otherwise(0).alias("r"), F.when(F.col("event_type") != "click", 1).otherwise(0).alias("v"))
    return fuse.sum_votes(e, ["cell"], ["r", "v"])


@query("""with s as (select o_custkey, least(sum(case when o_orderstatus = 'F' then 1 else 0 end), 15) as a, least(sum(case when o_orderstatus <> 'F' then 1 else 0 end), 15) as b from orders group by 1)
    select o_custkey, case when a > b and a >= 2 then 1 when b > a and b >= 2 then 2 else 0 end as majority, case when a >= 2 and b = 0 then 1 when b >= 2 and a = 0 then 2 else 0 end as unanimous from s""")
def vote_decide(t: Tables) -> DataFrame:
    f = F.col("o_orderstatus") == "F"
    s = fuse.sum_votes(t.orders.select("o_custkey", F.when(f, 1).otherwise(0).alias("a"), F.when(f, 0).otherwise(1).alias("b")), ["o_custkey"], ["a", "b"])
    a, b = F.col("a"), F.col("b")
    return s.select("o_custkey", fuse.decide(a, b, 2).alias("majority"), fuse.decide(a, b, 2, unanimous=True).alias("unanimous"))


@query("""with g as (select user_id % 3000 as cell, event_id, code from {phases}),
    f as (select cell, arg_min(code, event_id) as first from g where code is not null group by 1),
    c as (select g.cell, bool_or(abs(((code - first + 126) % 252 + 252) % 252 - 126) > 4) as conflict, max(first) as first from g join f on g.cell = f.cell where code is not null group by 1)
    select a.cell, case when not conflict then first end as code, coalesce(conflict, false) as conflict from (select distinct cell from g) a left join c on a.cell = c.cell""")
def code_merge_ordered(t: Tables) -> DataFrame:
    return fuse.fold_codes(t.phases.withColumn("cell", F.col("user_id") % 3000), ["cell"], "event_id", "code")


@query("""with e as (select l_returnflag, l_quantity as v, sum(l_linenumber) as w from lineitem group by 1, 2),
    c as (select *, sum(w) over (partition by l_returnflag order by v rows unbounded preceding) as cum, sum(w) over (partition by l_returnflag) as total, lead(v) over (partition by l_returnflag order by v) as nx from e),
    r as (select l_returnflag, case when cum * 2 = total then (v + nx) / 2 else v end as m, row_number() over (partition by l_returnflag order by v) as i from c where cum * 2 >= total)
    select l_returnflag, m as median from r where i = 1""")
def weighted_median_known(t: Tables) -> DataFrame:
    return fuse.weighted_median(t.lineitem, ["l_returnflag"], "l_quantity", "l_linenumber")


@query("""with w as (select l_partkey % 64 as cell, l_quantity as v, greatest(pow(sin((l_linenumber % 8 + 0.5::double) * (pi() / 8)), 2), 1e-6) as w from lineitem)
    select cell, round(sum(w * v) / sum(w), 6) as value from w group by 1""")
def tile_blend_sin2(t: Tables) -> DataFrame:
    cells = t.lineitem.withColumn("cell", F.col("l_partkey") % 64)
    return fuse.blend_tiles(cells, ["cell"], F.col("l_quantity"), F.col("l_linenumber") % 8, 8).select("cell", F.round("value", 6).alias("value"))


def _named(name: str, oracle: str):
    def wrap(f):
        f.__name__ = name
        return query(oracle)(f)

    return wrap


_BLOCK = "cast(floor(z / 64) as bigint) as z, cast(floor(y / 64) as bigint) as y"
for _mode, _value, _order in (
    ("mean", "cast(floor((coalesce(sum(v), 0) + 2048) / 4096) as bigint)", None),
    ("max", "max(v)", None),
    ("known_max", "max(case when v % 5 <> 0 then v end)", None),
    ("label", "case when (count(*) - count(case when v % 5 <> 0 then v end)) * 2 < 4096 then cast(floor((sum(case when v % 5 <> 0 then v end) + floor(count(case when v % 5 <> 0 then v end) / 2)) / count(case when v % 5 <> 0 then v end)) as bigint) end", None),
    ("void", "round(avg(case when v < 20 then 1.0::double else 0.0::double end) * 255, 6)", 20),
):

    def _run(t: Tables, mode=_mode, order=_order) -> DataFrame:
        v = t.voxels
        if mode in ("known_max", "label"):
            v = v.withColumn("v", F.when(F.col("v") % 5 != 0, F.col("v")))
        return pooling.pool(v, mode, keys=("z", "y"), factor=64, order=order)

    _named(f"pool_{_mode}", f"select {_BLOCK}, {_value} as v from {{voxels}} group by 1, 2")(_run)


@query(f"""with s as (select cast(floor(user_id / 8) as bigint) as user_id, sum(cos(code * {_PH})) as c, sum(sin(code * {_PH})) as s, count(code) as n from {{phases}} group by 1)
    select user_id, case when sqrt(c * c + s * s) >= 0.5::double * n then ((cast(round(atan2(s, c) * 252 / (2 * pi())) as int) % 252) + 252) % 252 end as code from s""")
def pool_phase(t: Tables) -> DataFrame:
    return pooling.pool(t.phases, "phase", value="code", keys=("user_id",), factor=8)


@query("""select doc_id, lang from documents d where lang <> 'en' and not exists (select 1 from labels l where l.doc_id = d.doc_id)""")
def holdout_anti(t: Tables) -> DataFrame:
    return joins.without(t.documents.where("lang <> 'en'"), t.labels, ["doc_id"]).select("doc_id", "lang")


@query("""with b as (select o_custkey, min(o_orderkey) as lo, min(o_orderkey) + 3 as hi from orders group by 1)
    select l_orderkey, l_linenumber, case when not exists (select 1 from b where l_orderkey >= lo and l_orderkey < hi) then cast(floor(l_quantity) as int) end as v from lineitem""")
def holdout_mask(t: Tables) -> DataFrame:
    boxes = t.orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("lo")).withColumn("hi", F.col("lo") + 3)
    keys = t.lineitem.select("l_orderkey").distinct()
    inside = joins.interval_join(keys, boxes, "l_orderkey", "lo", "hi", 256).select("l_orderkey").distinct().withColumn("gone", F.lit(True))
    return t.lineitem.join(inside, "l_orderkey", "left").select("l_orderkey", "l_linenumber", F.when(F.col("gone").isNull(), F.floor("l_quantity").cast("int")).alias("v"))


@query("select o_orderkey from orders o where not exists (select 1 from lineitem l where l.l_orderkey = o.o_orderkey and l_linenumber >= 4)")
def resume_anti(t: Tables) -> DataFrame:
    done = t.lineitem.where("l_linenumber >= 4").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.without(t.orders.select("o_orderkey"), done, ["o_orderkey"])


@query("""with t as (select distinct cast(floor(z / 32) as bigint) as tz, cast(floor(y / 32) as bigint) as ty from {voxels})
    select tz, ty from t where exists (select 1 from {voxels} v where v.v >= 49 and v.z >= t.tz * 32 - 8 and v.z < t.tz * 32 + 40 and v.y >= t.ty * 32 - 8 and v.y < t.ty * 32 + 40)""")
def occupancy_semi(t: Tables) -> DataFrame:
    tiles = t.voxels.select(F.floor(F.col("z") / 32).alias("tz"), F.floor(F.col("y") / 32).alias("ty")).distinct()
    reach = lambda c: F.explode(F.sequence(F.floor((F.col(c) - 39) / 32 + F.lit(0.0)) , F.floor((F.col(c) + 8) / 32)))
    full = t.voxels.where("v >= 49").select("z", "y").withColumn("tz", reach("z")).withColumn("ty", reach("y"))
    full = full.where((F.col("z") >= F.col("tz") * 32 - 8) & (F.col("z") < F.col("tz") * 32 + 40) & (F.col("y") >= F.col("ty") * 32 - 8) & (F.col("y") < F.col("ty") * 32 + 40))
    return tiles.join(full.select("tz", "ty").distinct(), ["tz", "ty"], "left_semi")


@query("""with b as (select p_partkey as id, p_partkey * 3 as z0, p_partkey * 3 + 40 + p_size as z1, p_partkey as y0, p_partkey + 25 as y1 from part)
    select id, cast(count(*) as bigint) as n, cast(sum(v) as bigint) as total from b join {voxels} v on z >= z0 and z < z1 and y >= y0 and y < y1 group by id""")
def range_join_boxes(t: Tables) -> DataFrame:
    p = F.col("p_partkey")
    boxes = t.part.select(p.alias("id"), (p * 3).alias("z0"), (p * 3 + 40 + F.col("p_size")).alias("z1"), p.alias("y0"), (p + 25).alias("y1"))
    got = joins.box_join(t.voxels, boxes, {"z": ("z0", "z1"), "y": ("y0", "y1")}, {"z": 64.0, "y": 32.0})
    return got.groupBy("id").agg(F.count("*").alias("n"), F.sum("v").cast("bigint").alias("total"))


_POINTS = "select c_custkey as id, c_custkey % 211 as a, c_acctbal / 40 as b from customer"
_NODES = "select s_suppkey as id, s_suppkey * 2 as a, s_acctbal / 40 as b from supplier"


def _points(t: Tables) -> tuple[DataFrame, DataFrame]:
    a = t.customer.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 211).cast("double").alias("a"), (F.col("c_acctbal") / 40).alias("b"))
    b = t.supplier.select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 2).cast("double").alias("a"), (F.col("s_acctbal") / 40).alias("b"))
    return a, b


@query(f"""with p as ({_POINTS}), q as ({_NODES}), m as (select distinct p.id from p join q on pow(p.a - q.a, 2) + pow(p.b - q.b, 2) <= 100)
    select cast((select count(*) from m) as bigint) as hit, cast((select count(*) from p) as bigint) as total""")
def radius_join_recall(t: Tables) -> DataFrame:
    a, b = _points(t)
    hit = joins.radius_pairs(a, b, ["a", "b"], 10.0).select(F.col("id_a").alias("id")).distinct()
    return a.join(hit.withColumn("hit", F.lit(1)), "id", "left").agg(F.count("hit").alias("hit"), F.count("*").alias("total"))


@query(f"""with p as ({_POINTS}), q as ({_NODES}), m as (select p.id, q.id as near, pow(p.a - q.a, 2) + pow(p.b - q.b, 2) as d2 from p join q on pow(p.a - q.a, 2) + pow(p.b - q.b, 2) <= 400),
    r as (select *, row_number() over (partition by id order by d2, near) as i from m)
    select id, near, round(d2, 6) as d2 from r where i = 1""")
def knn1_vertex(t: Tables) -> DataFrame:
    a, b = _points(t)
    got = joins.nearest(a, b.withColumnRenamed("id", "near"), ["a", "b"], "id", "near", 20.0)
    return got.select("id", "near", F.round("d2", 6).alias("d2"))


@query("""with k as (select n_nationkey * 700.0::double as k0, cast(n_regionkey * 10 + n_nationkey as double) as cy from nation where n_nationkey % 3 = 1),
    s as (select k0, cy, lead(k0) over (order by k0) as k1, lead(cy) over (order by k0) as cy1, lag(k0) over (order by k0) as kb from k)
    select o_orderkey, round(case when k1 is null then cy else cy + greatest(0.0::double, (o_orderkey - k0) / (k1 - k0)) * (cy1 - cy) end, 6) as cy
    from orders join s on (kb is null or o_orderkey >= k0) and (k1 is null or o_orderkey < k1)""")
def asof_axis_lerp(t: Tables) -> DataFrame:
    knots = t.nation.where("n_nationkey % 3 = 1").select((F.col("n_nationkey") * 700).alias("k"), (F.col("n_regionkey") * 10 + F.col("n_nationkey")).cast("double").alias("cy"))
    return joins.lerp_on(t.orders.select("o_orderkey"), knots, "o_orderkey", "k", ["cy"], 700.0).select("o_orderkey", F.round("cy", 6).alias("cy"))


@query("""with m as (select user_id, event_type, ts, event_id, case when lag(event_type) over (partition by user_id order by ts, event_id) = event_type then 0 else 1 end as nw from events),
    r as (select user_id, event_type, sum(nw) over (partition by user_id order by ts, event_id rows unbounded preceding) as run from m)
    select user_id, cast(run as bigint) as run, event_type, cast(count(*) as bigint) as length from r group by 1, 2, 3""")
def islands_runs(t: Tables) -> DataFrame:
    return windows.runs_of(t.events, ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "run", "event_type", "length")


@query("""with m as (select user_id, event_type, ts, event_id, case when lag(event_type) over (partition by user_id order by ts, event_id) = event_type then 0 else 1 end as nw from events),
    r as (select user_id, event_type, sum(nw) over (partition by user_id order by ts, event_id rows unbounded preceding) as run from m),
    l as (select event_type, count(*) as n from r group by user_id, run, event_type),
    c as (select event_type, n, sum(n) over (partition by event_type order by n range unbounded preceding) as cum, sum(n) over (partition by event_type) as total from l)
    select event_type, cast(min(n) filter (where cum * 2 >= total) as bigint) as arc_median, round(sum(case when n >= 2 then n else 0 end) / sum(n)::double, 9) as long_share from c group by 1""")
def arc_median(t: Tables) -> DataFrame:
    r = windows.runs_of(t.events, ["user_id"], ["ts", "event_id"], "event_type")
    w = Window.partitionBy("event_type")
    c = r.groupBy("event_type", "length").agg(F.sum("length").alias("s")).withColumns({"cum": F.sum("s").over(w.orderBy("length").rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("s").over(w)})
    return c.groupBy("event_type").agg(F.min(F.when(F.col("cum") * 2 >= F.col("total"), F.col("length"))).alias("arc_median"), F.round(F.sum(F.when(F.col("length") >= 2, F.col("s")).otherwise(0)) / F.sum("s"), 9).alias("long_share"))


@query("""with d as (select user_id, ((lead(code) over (partition by user_id order by ts, event_id) - code + 126) % 252 + 252) % 252 - 126 as d from {phases} where code is not null)
    select cast(count(d) as bigint) as n, round(avg(case when abs(d) > 63 then 1.0::double else 0.0::double end), 9) as packed, round(quantile_cont(abs(d)::double, 0.5::double), 6) as p50 from d where d is not null""")
def lag_gradient_packing(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    d = t.phases.where("code is not null").select(F.abs(circular.code_diff(F.lead("code").over(w), F.col("code"))).alias("d")).where("d is not null")
    return d.agg(F.count("d").alias("n"), F.round(F.avg(F.when(F.col("d") > 63, 1.0).otherwise(0.0)), 9).alias("packed"), F.round(F.percentile("d", F.lit(0.5)), 6).alias("p50"))


@query("""select event_id, round(avg(value) over (partition by user_id order by event_id rows between 3 preceding and 3 following), 6) as mean from events""")
def box_mean3(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.round(windows.box_mean(t.events, ["user_id"], "event_id", "value", 3), 6).alias("mean"))


@query("""with w as (select user_id, event_id, value, lag(value) over (partition by user_id order by event_id) as p, lead(value) over (partition by user_id order by event_id) as n from events)
    select user_id, event_id, value from w where value >= 20 and (p is null or value > p) and (n is null or value >= n)""")
def nms_ray(t: Tables) -> DataFrame:
    return windows.local_peaks(t.events, ["user_id"], ["event_id"], "value", 20).select("user_id", "event_id", "value")


@query("""with p as (select user_id, event_id, code / 252.0::double as turn from {phases} where code is not null),
    d as (select *, turn - lag(turn) over (partition by user_id order by event_id) as d from p)
    select user_id, event_id, round(sum(coalesce(d - round_even(d, 0), 0)) over (partition by user_id order by event_id rows unbounded preceding), 6) + 0.0::double as unwrapped from d""")
def unwrap_phase(t: Tables) -> DataFrame:
    p = t.phases.where("code is not null").select("user_id", "event_id", (F.col("code") / 252.0).alias("turn"))
    return windows.unwrap(p, ["user_id"], ["event_id"], "turn").select("user_id", "event_id", (F.round("unwrapped", 6) + 0.0).alias("unwrapped"))


@query("""with r as (select l_quantity as a, l_extendedprice as b, l_discount as c from lineitem), k as (select
      rank() over (order by a) + (count(*) over (partition by a) - 1) / 2.0::double as ra, rank() over (order by b) + (count(*) over (partition by b) - 1) / 2.0::double as rb from r)
    select round(corr(a, b), 9) as pearson, round((select corr(ra, rb) from k), 9) as spearman,
      round((corr(a, b) - corr(a, c) * corr(b, c)) / sqrt((1 - pow(corr(a, c), 2)) * (1 - pow(corr(b, c), 2))), 9) as partial from r""")
def pearson_spearman_partial(t: Tables) -> DataFrame:
    r = t.lineitem.select(F.col("l_quantity").alias("a"), F.col("l_extendedprice").alias("b"), F.col("l_discount").alias("c"))
    c = r.agg(F.corr("a", "b").alias("ab"), F.corr("a", "c").alias("ac"), F.corr("b", "c").alias("bc"))
    both = c.crossJoin(F.broadcast(stats.spearman(r, "a", "b")))  # one row each
    return both.select(F.round("ab", 9).alias("pearson"), F.round("spearman", 9).alias("spearman"), F.round(stats.partial_correlation("ab", "ac", "bc"), 9).alias("partial"))


@query("""with b as (select c.c_nationkey as stratum, o_custkey as box, avg(o_totalprice) as a, avg(case when o_orderstatus = 'F' then o_totalprice else o_totalprice * 1.01::double end) as b from orders o join customer c on o_custkey = c_custkey group by 1, 2),
    r as (select *, row_number() over (partition by stratum order by box) - 1 as i, count(*) over (partition by stratum) as n from b),
    d as (select draw, stratum, (i * 7919 + draw * 104729 + draw * i * 31) % n as k from r, range(1, 51) as g(draw)),
    m as (select draw, avg(r.a) as ma, avg(r.b - r.a) as md from d join r on d.stratum = r.stratum and d.k = r.i group by 1)
    select round(quantile_cont(ma, 0.025::double), 4) as low, round(quantile_cont(ma, 0.975::double), 4) as high, round(avg(case when md > 0 then 1.0::double else 0.0::double end), 6) as p_above, round(2.8::double * stddev_samp(md), 6) as mde from m""")
def bootstrap_paired_ci(t: Tables) -> DataFrame:
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("stratum"))
    b = t.orders.join(c, "o_custkey").groupBy("stratum", F.col("o_custkey").alias("box")).agg(F.avg("o_totalprice").alias("a"), F.avg(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(F.col("o_totalprice") * 1.01)).alias("b"))
    w = Window.partitionBy("stratum")
    r = b.withColumns({"i": F.row_number().over(w.orderBy("box")) - 1, "n": F.count("*").over(w)})
    d = r.select("stratum", "i", "n", F.explode(F.sequence(F.lit(1), F.lit(50))).alias("draw")).select("draw", "stratum", ((F.col("i") * 7919 + F.col("draw") * 104729 + F.col("draw") * F.col("i") * 31) % F.col("n")).alias("i"))
    m = d.join(r.select("stratum", F.col("i").cast("long").alias("i"), "a", "b"), ["stratum", "i"]).groupBy("draw").agg(F.avg("a").alias("ma"), F.avg(F.col("b") - F.col("a")).alias("md"))
    return m.agg(F.round(F.percentile("ma", F.lit(0.025)), 4).alias("low"), F.round(F.percentile("ma", F.lit(0.975)), 4).alias("high"), F.round(F.avg(F.when(F.col("md") > 0, 1.0).otherwise(0.0)), 6).alias("p_above"), F.round(2.8 * F.stddev_samp("md"), 6).alias("mde"))
