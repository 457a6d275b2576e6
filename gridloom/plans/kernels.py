"""Queries over graph, ray, grid and streaming operators."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import graph, grid, rays, stats, windows
from gridloom.plans.base import Tables, query
from gridloom.streaming import frontier



def _edges(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").cast("long").alias("a"), (F.col("c_custkey") % 97 + 100).alias("b"), "c_custkey")


@query("""with recursive e as (select c_nationkey::bigint as a, c_custkey % 97 + 100 as b from customer), u as (select a, b from e union select b, a from e),
    r(n, l) as (select a, a from u union select u.b, r.l from r join u on u.a = r.n)
    select n as node, min(l) as component from r group by n""")
def components(t: Tables) -> DataFrame:
    return graph.components(_edges(t))


@query("""with v as (select least(l_partkey, l_suppkey) as a, greatest(l_partkey, l_suppkey) as b, case when l_partkey > l_suppkey then -l_linenumber else l_linenumber end as d, sum(floor(l_quantity)) as w from lineitem where l_partkey <> l_suppkey group by 1, 2, 3)
    select cast(sum(w * abs(b % 7 - a % 7 - d)) as bigint) as energy, cast(sum(case when b % 7 - a % 7 = d then w else 0 end) as bigint) as met, cast(sum(w) as bigint) as total from v""")
def l1_energy(t: Tables) -> DataFrame:
    votes = graph.merge_votes(t.lineitem.select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.col("l_linenumber").alias("d"), F.floor("l_quantity").alias("w")))
    nodes = votes.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("s", F.col("node") % 7)
    return graph.l1_energy(votes, nodes)


@query("""with e as (select l_partkey as a, l_suppkey as b, cast(count(*) as bigint) as w from lineitem group by 1, 2),
    x as (select *, row_number() over (partition by a order by w desc, b) as ra, row_number() over (partition by b order by w desc, a) as rb from e)
    select a, b, w from x where ra = 1 and rb = 1 and w >= 2""")
def mutual_best(t: Tables) -> DataFrame:
    return graph.mutual_best(t.lineitem.groupBy(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).agg(F.count("*").alias("w")), 2)


@query("""with recursive n as (select list(distinct x order by x) as names from (select unnest([c_nationkey::bigint, c_custkey % 97 + 100]) as x from customer)),
    e as (select a, b, w, row_number() over (order by w desc, a, b) as i, list_position(names, a) as ia, list_position(names, b) as ib from (select c_nationkey::bigint as a, c_custkey % 97 + 100 as b, sum(c_custkey)::bigint as w from customer group by 1, 2), n where a <> b),
    t(i, lab, taken) as (select 0::bigint, range(1, len(names) + 1), false from n
        union all select e.i, case when lab[ia] <> lab[ib] then list_transform(lab, lambda y: case when y = lab[ib] then lab[ia] else y end) else lab end, lab[ia] <> lab[ib] from t join e on e.i = t.i + 1)
    select a, b, w from e join t on e.i = t.i where taken""")
def spanning_forest(t: Tables) -> DataFrame:
    e = _edges(t).groupBy("a", "b").agg(F.sum("c_custkey").alias("w"))
    return graph.spanning_forest(e)


@query("""with recursive c as (select l_orderkey as line, list(l_linenumber::bigint * 100000000 + l_partkey order by l_linenumber, l_partkey) as pos, list((l_suppkey % 5)::bigint order by l_linenumber, l_partkey) as prior, list((l_partkey % 3 - 1)::bigint order by l_linenumber, l_partkey) as step from lineitem group by 1),
    r as (select line, pos, prior, step, len(pos)::bigint as k, list_transform(range(-1, 6), lambda s: abs(s - prior[len(pos)])) as cost, list_transform(range(-1, 6), lambda s: [s]) as path from c
        union all select line, pos, prior, step, k - 1, list_transform(m, lambda x: list_min(x[2]) + abs(x[1][1] - prior[k - 1])), list_transform(m, lambda x: list_concat(x[1], path[list_position(x[2], list_min(x[2]))]))
        from (select *, list_transform(range(-1, 6), lambda s: [[s], list_transform(range(-1, 6), lambda u: abs(u - s - step[k]) + cost[u + 2])]) as m from r where k > 1)),
    b as (select line, pos, list_min(cost) as cost, path[list_position(cost, list_min(cost))] as path from r where k = 1)
    select line, unnest(pos) as pos, unnest(path) as gauge, cost::double as cost from b""")
def chain_gauges(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_orderkey").alias("line"), (F.col("l_linenumber").cast("long") * 100000000 + F.col("l_partkey")).alias("pos"), (F.col("l_suppkey") % 5).cast("long").alias("prior"), (F.col("l_partkey") % 3 - 1).cast("long").alias("step"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), "l_linenumber", "l_partkey")
    return graph.chain_gauges(rows, ["line"], [-1, 0, 1, 2, 3, 4, 5], ["file", "row"], ["l_linenumber", "l_partkey"])  # links of one place as the table has them


@query("""with recursive e as (select l_partkey as a, l_suppkey as b, min(l_extendedprice) as cost from lineitem group by 1, 2),
    r as (select a, b, cost, 0 as round, false as taken from e
        union all select a, b, cost, round, taken from (select *, bool_or(taken) over (partition by a) or bool_or(taken) over (partition by b) as shut from (select a, b, cost, round + 1 as round, row_number() over (partition by a order by cost, a, b) = 1 and row_number() over (partition by b order by cost, a, b) = 1 as taken from r where not taken)) where taken or not shut)
    select a, b, cost from r where taken""")
def fiber_link(t: Tables) -> DataFrame:
    c = t.lineitem.groupBy(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).agg(F.min("l_extendedprice").alias("cost"))
    return graph.greedy_links(c)


@query("""with e as (select user_id, list(value order by event_id) as v from events group by user_id),
    i as (select user_id, v, unnest(range(2, len(v))) as i from e),
    c as (select user_id, i, v[i] as h, list_reverse(list_slice(v, 1, i - 1)) as l, list_slice(v, i + 1, len(v)) as r from i where v[i - 1] < v[i] and v[i] >= v[i + 1]),
    f as (select *, coalesce(nullif(list_position(list_transform(l, lambda x: x > h), true), 0), len(l) + 1) as cl, coalesce(nullif(list_position(list_transform(r, lambda x: x > h), true), 0), len(r) + 1) as cr from c),
    p as (select user_id, (i - 1)::bigint as place, h as height, h - greatest(list_min(list_slice(l, 1, cl - 1)), coalesce(list_min(list_slice(r, 1, cr - 1)), h)) as prominence from f)
    select * from p where prominence >= 5""")
def peaks_prominence(t: Tables) -> DataFrame:
    return rays.peaks(t.events, "user_id", "event_id", "value", 5.0, 2)


@query("""with w as (select user_id, event_id, value / 10 as v, lead(value / 10) over (partition by user_id order by event_id) as nv, lead(event_id) over (partition by user_id order by event_id) as ne from events),
    l as (select user_id, event_id, v, nv, ne, unnest(range(cast(ceil(least(v, nv)) as bigint), cast(floor(greatest(v, nv)) as bigint) + 1)) as level from w where nv is not null)
    select user_id, level, cast(floor(1000 * (case when nv <> v then event_id + (ne - event_id) * ((level - v) / (nv - v)) else event_id end)) as bigint) as at from l where level > least(v, nv) or v = level""")
def level_crossings(t: Tables) -> DataFrame:
    return rays.crossings(t.events.select("user_id", "event_id", (F.col("value") / 10).alias("v")), "user_id", "event_id", "v").select("user_id", "level", F.floor(F.col("at") * 1000).alias("at"))


@query("""with c as (select distinct l_orderkey % 60 as a, l_partkey % 60 as b, max(floor(l_quantity)) as v from lineitem group by 1, 2)
    select a + i as a, b + j as b, cast(max(v) as bigint) as v from c, range(-2, 3) as x(i), range(-2, 3) as y(j) where i * i + j * j <= 4 group by 1, 2""")
def dilate_ball(t: Tables) -> DataFrame:
    c = t.lineitem.groupBy((F.col("l_orderkey") % 60).alias("a"), (F.col("l_partkey") % 60).alias("b")).agg(F.max(F.floor("l_quantity")).alias("v"))
    return grid.dilate(c, "v", 2, ("a", "b"))


@query("""with c as (select l_orderkey % 64 as a, l_partkey % 64 as b, max(case when l_quantity >= 50 then 1 else 0 end) as f from lineitem group by 1, 2),
    d as (select p.a, p.b, min(pow(p.a - q.a, 2) + pow(p.b - q.b, 2)) as d2 from c p left join c q on q.f = 1 group by 1, 2)
    select a, b, case when d2 <= 64 then cast(d2 as double) end as d2 from d""")
def distance_transform(t: Tables) -> DataFrame:
    c = t.lineitem.groupBy((F.col("l_orderkey") % 64).alias("a"), (F.col("l_partkey") % 64).alias("b")).agg((F.max("l_quantity") >= 50).alias("f"))
    return grid.distance(c, "f", 16, 8, ("a", "b"))


@query("""with g as (select c_custkey // 40 as r, c_custkey % 40 as c, c_acctbal / 1000 as x, c_nationkey * 1.0::double as y, (c_custkey % 40) * 2.0::double as z from customer),
    d as (select r, c, (lead(x) over wr - lag(x) over wr) / 2 as ux, (lead(y) over wr - lag(y) over wr) / 2 as uy, (lead(z) over wr - lag(z) over wr) / 2 as uz,
        (lead(x) over wc - lag(x) over wc) / 2 as vx, (lead(y) over wc - lag(y) over wc) / 2 as vy, (lead(z) over wc - lag(z) over wc) / 2 as vz from g
        window wr as (partition by r order by c), wc as (partition by c order by r)),
    e as (select ux * ux + uy * uy + uz * uz as e, ux * vx + uy * vy + uz * vz as f, vx * vx + vy * vy + vz * vz as h from d)
    select cast(count(*) as bigint) as n, round(avg(sqrt(e * h - f * f)), 6) as area from e where e is not null and h is not null""")
def strip_distort(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    g = t.customer.select(F.lit(0).alias("s"), F.floor(k / 40).alias("row"), (k % 40).alias("col"), (F.col("c_acctbal") / 1000).alias("x"), F.col("c_nationkey").cast("double").alias("y"), ((k % 40) * 2.0).alias("z"))
    return grid.jacobian(g, "s").where("s1 is not null").agg(F.count("*").alias("n"), F.round(F.avg("area"), 6).alias("area"))


@query()
def emb_pca(t: Tables) -> DataFrame:
    """Variance along the leading axes: the covariance is summed by the executors, its
    eigenvectors (dimension squared numbers) are found on the driver."""
    import numpy as np

    m = stats.covariance(t.embeddings, "embedding")
    values = np.linalg.eigvalsh(m)[::-1][:8]
    return t.spark.createDataFrame([(k, round(float(v), 6)) for k, v in enumerate(values)], "axis int, variance double")


@query("""with m as (select n_regionkey as stratum, avg(c_acctbal) as mean from customer join nation on c_nationkey = n_nationkey group by 1) select cast(count(*) as bigint) as strata, cast(25 as bigint) as draws from m""")
def bootstrap_draws(t: Tables) -> DataFrame:
    rows = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("stratum"), "c_acctbal")
    draws = stats.bootstrap_means(rows, "stratum", "c_acctbal", 25, 7)
    return draws.agg(F.count("*").alias("draws")).crossJoin(F.broadcast(rows.agg(F.count_distinct("stratum").alias("strata")))).select("strata", "draws")  # one row each


@query("""with e as (select event_id % 4000 as id, event_id as seq, case when event_type in ('click', 'view') then 'add' when event_type = 'purchase' then 'del' else 'undo' end as op, value as item from events),
    n as (select * from e where op <> 'undo')
    select id, item from (select id, item, op, row_number() over (partition by id order by seq desc) as i from n where id not in (select id from e where op = 'undo')) where i = 1 and op = 'add'""")
def annot_fold(t: Tables) -> DataFrame:
    e = t.events.select((F.col("event_id") % 4000).alias("id"), F.col("event_id").alias("seq"), F.when(F.col("event_type").isin("click", "view"), "add").when(F.col("event_type") == "purchase", "del").otherwise("undo").alias("op"), F.col("value").alias("item"))
    undone = e.where("op = 'undo'").select("id").distinct()
    return frontier.fold_log(e.join(undone, "id", "left_anti"))


@query("""with d as (select date_trunc('day', ts) as s, count(*) as n, sum(value) as v from events group by 1), m as (select max(ts) - interval 1 hour as w from events)
    select strftime(s, '%Y-%m-%d') as day, cast(n as bigint) as n, round(v, 4) as total from d, m where s + interval 1 day <= w""")
def frontier_window_agg(t: Tables) -> DataFrame:
    """Daily windows of a file stream, closed ones only: those that the watermark passed."""
    stream = t.spark.readStream.schema(t.events.schema).parquet(f"{t.dir}/events.parquet*")
    agg = frontier.windowed(stream, "ts", "1 day", "1 hour", F.count("*").alias("n"), F.sum("value").alias("total"))
    name = f"frontier_window_agg_{uuid4().hex[:8]}"
    q = agg.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", _folder(t)).start()
    q.awaitTermination()
    return t.spark.table(name).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "n", F.round("total", 4).alias("total"))


def _folder(t: Tables) -> str:
    """A fresh folder below the shared checkpoint folder; local only where there is none."""
    base = t.spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not t.spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        return tempfile.mkdtemp(prefix="gridloom-")
    return f"{base}/stream-{uuid4().hex}"


@query("""with c as (select distinct l_orderkey % 50 as a, l_partkey % 50 as b from lineitem),
    o as (select i, j from range(-1, 2) as x(i), range(-1, 2) as y(j) where i * i + j * j <= 1),
    d as (select distinct a + i as a, b + j as b from c, o), e as (select a + i as a, b + j as b, count(*) as n from d, o group by 1, 2)
    select a, b from e where n = 5""")
def scanprep_close(t: Tables) -> DataFrame:
    c = t.lineitem.select((F.col("l_orderkey") % 50).alias("a"), (F.col("l_partkey") % 50).alias("b"))
    return grid.close(c, 1, ("a", "b"))


@query("""with c as (select distinct l_orderkey % 40 as a, l_partkey % 40 as b from lineitem),
    n as (select c.a, c.b, m.a as na, m.b as nb, count(m.a) over (partition by c.a, c.b) as n from c left join c m on abs(c.a - m.a) + abs(c.b - m.b) = 1)
    select distinct x.a, x.b from n x left join n y on y.a = x.na and y.b = x.nb where x.n >= 2 or y.n >= 2""")
def scanprep_drop_small(t: Tables) -> DataFrame:
    c = t.lineitem.select((F.col("l_orderkey") % 40).alias("a"), (F.col("l_partkey") % 40).alias("b"))
    return grid.drop_small(c, 3, ("a", "b"))


@query("""with t as (select c_custkey // 30 as r, c_custkey % 30 as c, c_custkey // 30 - row_number() over (partition by c_custkey % 30 order by c_custkey) as run from customer where c_acctbal > 0),
    h as (select r, c, row_number() over (partition by c, run order by r) as h from t),
    e as (select a.r, a.c as c1, b.c as c2, min(m.h) as tall from h a join h b on a.r = b.r and b.c >= a.c join h m on m.r = a.r and m.c between a.c and b.c group by all having count(*) = b.c - a.c + 1)
    select 0 as sheet, tall * (c2 - c1 + 1) as area, r - tall + 1 as row, c1 as col, tall as rows, c2 - c1 + 1 as cols from e order by area desc, row, col, rows desc limit 1""")
def sheet_cut(t: Tables) -> DataFrame:
    g = t.customer.select(F.lit(0).alias("sheet"), F.floor(F.col("c_custkey") / 30).cast("int").alias("row"), (F.col("c_custkey") % 30).cast("int").alias("col"), (F.col("c_acctbal") > 0).alias("good"))
    return grid.largest_rectangle(g, "sheet", "good")


@query("""with s as (select d from range(-3, 4) as r(d)), a as (select l_suppkey as z, avg(l_quantity) as v from lineitem where l_linenumber % 2 = 0 group by 1), b as (select l_suppkey as z, avg(l_quantity) as v from lineitem where l_linenumber % 2 = 1 group by 1),
    c as (select d, corr(a.v, b.v) as r from s, a join b on true where b.z = a.z + d group by d)
    select cast(d as bigint) as shift, round(r, 9) as ncc from c""")
def reg_ncc(t: Tables) -> DataFrame:
    """Normalised cross-correlation of two profiles under integer shifts."""
    side = lambda n: t.lineitem.where(f"l_linenumber % 2 = {n}").groupBy(F.col("l_suppkey").alias("z")).agg(F.avg("l_quantity").alias("v"))
    a = side(0).select("z", F.col("v").alias("va"), F.explode(F.sequence(F.lit(-3).cast("long"), F.lit(3).cast("long"))).alias("shift")).withColumn("z", F.col("z") + F.col("shift"))
    return a.join(side(1), "z").groupBy("shift").agg(F.round(F.corr("va", "v"), 9).alias("ncc"))


@query("""with w as (select user_id, event_id, list_sort(list(value) over (partition by user_id order by event_id rows between 2 preceding and 2 following)) as near from events)
    select event_id, round(near[len(near) // 2 + 1], 6) as med from w""")
def faces_median(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.round(windows.median_filter(t.events, ["user_id"], "event_id", "value", 2), 6).alias("med"))


@query()
def recto_cls(t: Tables) -> DataFrame:
    """Boosted or bagged trees over interval features: the confusion matrix on held-out rows."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    rows = t.lineitem.select("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", (F.col("l_orderkey") % 5 == 0).alias("held"))
    rows = VectorAssembler(inputCols=["l_quantity", "l_extendedprice", "l_discount", "l_tax"], outputCol="features").transform(rows)
    rows = StringIndexer(inputCol="l_returnflag", outputCol="label", stringOrderType="alphabetAsc").fit(rows).transform(rows)
    model = RandomForestClassifier(numTrees=8, maxDepth=4, maxBins=32, seed=5).fit(rows.where("not held"))
    return model.transform(rows.where("held")).groupBy(F.col("label").cast("int").alias("truth"), F.col("prediction").cast("int").alias("predicted")).agg(F.count("*").alias("n"))
