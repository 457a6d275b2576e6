"""Queries over volumes and fits: sampling between cells, box functions, lattices, areas."""

from __future__ import annotations

from uuid import uuid4

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import blocks, fits, potentials, sampling
from gridloom.operators.lines import along
from gridloom.operators.scratch import Scratch, numbered, shared_folder
from gridloom.plans.base import Tables, query
from gridloom.sources import lineboxes, shards
from gridloom.streaming.cover import Cover

c, lit = F.col, F.lit

_CELLS = "select l_orderkey % 12 as z, l_partkey % 11 as y, l_suppkey % 10 as x, cast(sum(cast(l_quantity as bigint)) as double) as v from lineitem group by 1, 2, 3"


def _cells(t: Tables) -> DataFrame:
    keys = [(c(k) % n).alias(a) for k, n, a in (("l_orderkey", 12, "z"), ("l_partkey", 11, "y"), ("l_suppkey", 10, "x"))]
    return t.lineitem.groupBy(*keys).agg(F.sum(c("l_quantity").cast("long")).cast("double").alias("v"))


@query(f"""with v as ({_CELLS}), p as (select o_orderkey, o_custkey % 24 + (o_orderkey % 8) / 8 as z, o_orderkey % 22 + (o_custkey % 4) / 4 as y, o_orderkey % 19 + 0.5 as x from orders),
    f as (select o_orderkey, (z + 0.5) / 2 - 0.5 as z, (y + 0.5) / 2 - 0.5 as y, (x + 0.5) / 2 - 0.5 as x from p),
    k as (select o_orderkey, cast(floor(z) as bigint) + i as z, cast(floor(y) as bigint) + j as y, cast(floor(x) as bigint) + k as x,
        (case when i = 1 then z - floor(z) else 1 - z + floor(z) end) * (case when j = 1 then y - floor(y) else 1 - y + floor(y) end) * (case when k = 1 then x - floor(x) else 1 - x + floor(x) end) as share
        from f, range(0, 2) a(i), range(0, 2) b(j), range(0, 2) c(k)),
    s as (select o_orderkey, count(v.v) as n, sum(share * v.v) as value from k left join v on k.z = v.z and k.y = v.y and k.x = v.x group by o_orderkey)
    select o_orderkey, case when n = 8 then round(value, 6) end as value from s""")
def render_trilinear(t: Tables) -> DataFrame:
    """Cells of half resolution, read at points of full resolution."""
    z, y, x = c("o_custkey") % 24 + (c("o_orderkey") % 8) / 8, c("o_orderkey") % 22 + (c("o_custkey") % 4) / 4, c("o_orderkey") % 19 + lit(0.5)
    points = t.orders.select("o_orderkey", z.alias("z"), y.alias("y"), x.alias("x"))
    return sampling.trilinear(_cells(t), points, level=2, chunk=8).select("o_orderkey", F.round("value", 6).alias("value"))


def _around(grid: np.ndarray, origin: tuple[int, int, int]):
    """z, y, x and the sum of the 27 cells around, where it is above 0."""
    total = sum(grid[i : i + 8, j : j + 8, k : k + 8] for i in range(3) for j in range(3) for k in range(3))
    for at in np.argwhere(total > 0):
        yield (*(int(a + o) for a, o in zip(at, origin, strict=True)), float(total[tuple(at)]))


@query(f"""with v as ({_CELLS}) select z + i as z, y + j as y, x + k as x, sum(v) as v from v, range(-1, 2) a(i), range(-1, 2) b(j), range(-1, 2) c(k) group by 1, 2, 3""")
def derived_boxes(t: Tables) -> DataFrame:
    """A function of the user over boxes, called from SQL."""
    call = sampling.register_box_function(t.spark, "sum_around", _around, "z bigint, y bigint, x bigint, v double", halo=1, chunk=8)
    return t.spark.sql("select * from " + call.replace("table(boxed)", "table(select * from {boxed})"), boxed=sampling.with_boxes(_cells(t), 1, 8))


@query("""select l_orderkey % 200 as z, l_partkey % 90 as y, l_suppkey % 100 as x, max(cast(l_quantity as bigint)) as v from lineitem
    where l_orderkey % 200 >= 37 and l_orderkey % 200 < 150 and l_partkey % 90 >= 20 and l_partkey % 90 < 61 and l_suppkey % 100 >= 3 and l_suppkey % 100 < 70 group by 1, 2, 3""")
def shard_scan(t: Tables) -> DataFrame:
    """A box of a sharded array that is written first: only its files and chunks are read."""
    keys = [(c(k) % n).alias(a) for k, n, a in (("l_orderkey", 200, "z"), ("l_partkey", 90, "y"), ("l_suppkey", 100, "x"))]
    cells = t.lineitem.groupBy(*keys).agg(F.max(c("l_quantity").cast("long")).alias("v"))
    root = f"{shared_folder(t.spark)}/array-{uuid4().hex}"
    shards.write_shards(cells, root, (200, 90, 100), (64, 64, 64), (16, 16, 16))
    return shards.read_shards(t.spark, root, (37, 20, 3), (113, 41, 67))


@query("""with h as (select l_suppkey % 20 as block, m.model, (l_returnflag = 'R')::int as truth, case when m.model = 'price' then cast(floor(l_extendedprice) as bigint) % 256 else cast(l_quantity as bigint) * 5 end as value, count(*) as n from lineitem, (values ('price'), ('quantity')) m(model) group by all),
    b as (select block, row_number() over (order by block) - 1 as no, count(*) over () as nb from (select distinct block from h)),
    s as (select d, ((1592590336 + d)::uhugeint + i::uhugeint * 11400714819323198485::uhugeint) % 18446744073709551616::uhugeint as x, nb from range(0, 10000) a(d), (select nb, unnest(range(1, nb + 1)) as i from (select distinct nb from b))),
    s1 as (select d, nb, (xor(x::ubigint, x::ubigint >> 30)::uhugeint * 13787848793156543929::uhugeint) % 18446744073709551616::uhugeint as x from s),
    s2 as (select d, nb, (xor(x::ubigint, x::ubigint >> 27)::uhugeint * 10723151780598845931::uhugeint) % 18446744073709551616::uhugeint as x from s1),
    p as (select d, (xor(x::ubigint, x::ubigint >> 31)::uhugeint * nb::uhugeint // 18446744073709551616::uhugeint)::bigint as no from s2),
    w as (select d, no, count(*) as w from p group by d, no union all select -1, no, 1 from b),
    g as (select d, model, value, sum(w * n) filter (where truth = 1) as pos, sum(w * n) filter (where truth = 0) as neg from w join b on w.no = b.no join h on h.block = b.block group by d, model, value),
    u as (select d, model, coalesce(pos, 0) as pos, coalesce(neg, 0) as neg, coalesce(sum(neg) over (partition by d, model order by value rows between unbounded preceding and 1 preceding), 0) as below from g),
    a as (select d, model, sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)) as auc, sum(pos + neg) as n from u group by d, model),
    q as (select x.d, x.model, x.auc - y.auc as delta from a x join a y on x.d = y.d and y.model = 'price' where x.d >= 0),
    e as (select model, quantile_cont(delta, 0.025) as low, quantile_cont(delta, 0.975) as high from q group by model)
    select a.model, a.n::bigint as n, round(a.auc, 9) as auc, case when a.model <> 'price' then round(a.auc - r.auc, 9) end as delta, case when a.model <> 'price' then round(low, 9) end as low, case when a.model <> 'price' then round(high, 9) end as high
    from a join a r on r.d = -1 and r.model = 'price' join e on e.model = a.model where a.d = -1""")
def ink_wrapscore_blocks(t: Tables) -> DataFrame:
    """10,000 draws of whole blocks, two scores against one truth."""
    scores = F.explode(F.array(F.struct(lit("price").alias("model"), (F.floor("l_extendedprice") % 256).alias("value")), F.struct(lit("quantity").alias("model"), (c("l_quantity").cast("long") * 5).alias("value")))).alias("s")
    rows = t.lineitem.select((c("l_suppkey") % 20).alias("block"), (c("l_returnflag") == "R").cast("int").alias("truth"), scores).select("block", "truth", "s.*")
    got = blocks.block_bootstrap(rows, "price", 10_000)
    return got.select("model", "n", *(F.round(k, 9).alias(k) for k in ("auc", "delta", "low", "high")))


@query()
def reg_affine(t: Tables) -> DataFrame:
    """The map of a grid's cells under a known map with errors, some of them gross."""
    rows = t.lineitem.select((c("l_orderkey") % 101).cast("double").alias("x"), (c("l_partkey") % 103).cast("double").alias("y"), (c("l_suppkey") % 97).cast("double").alias("z"), c("l_discount").alias("e"), F.when(c("l_linenumber") == 7, c("l_quantity")).otherwise(0.0).alias("gross"), c("l_tax").alias("weight"))
    pairs = rows.select("x", "y", "z", (c("x") * 1.1 - c("y") * 0.2 + 5 + c("e") + c("gross")).alias("u"), (c("y") * 0.9 + c("z") * 0.1 - 3 - c("e")).alias("v"), (c("z") + c("x") * 0.05 + c("gross")).alias("w"), "weight")
    matrix, _ = fits.robust_affine(pairs, 0.5)
    return t.spark.createDataFrame([(k, *(round(float(v), 6) for v in row)) for k, row in zip(fits.TO, matrix, strict=True)], "axis string, x double, y double, z double, shift double")


@query()
def count_field_ls(t: Tables) -> DataFrame:
    """Turns on a lattice that follow the steps between its cells' codes."""
    scratch = Scratch(t.spark)
    cells = scratch.save(_cells(t).select("z", "y", "x", ((c("z") * 11 + c("y")) * 10 + c("x")).alias("cell"), (c("v").cast("long") % 252).alias("code"), c("v")))
    apart, _ = potentials.turn_step("code_a", "code_b")
    steps = potentials.grid_joins(cells, ["code", "v"]).select("a", "b", (apart / 252).alias("d"), F.least("v_a", "v_b").alias("w"))
    lattice = cells.select("cell", "z", "y", "x", (c("code") / 252).alias("target"), lit(0.5).alias("pull"))
    return fits.lattice_solve(lattice, steps, 1e-3, scratch=scratch)[0].select("cell", F.round("value", 2).alias("value"))


_LINES = "select user_id as line, row_number() over (partition by user_id order by event_id) - 1 as seq, value as x, cast(event_id % 1000 as double) as y, cast(hour(ts) as double) as z from events"


@query(f"select line, seq, x, y, z from ({_LINES}) where x >= 20 and x < 45 and y >= 100 and y < 700 and z >= 3 and z < 15")
def line_box_scan(t: Tables) -> DataFrame:
    """A box of stored lines: bounds first, then the tiles and blocks that can meet it."""
    seq = (F.row_number().over(along(["user_id"], "event_id")) - 1).cast("long")
    lines = t.events.select(c("user_id").alias("line"), seq.alias("seq"), c("value").alias("x"), (c("event_id") % 1000).cast("double").alias("y"), F.hour("ts").cast("double").alias("z"))
    path = f"{shared_folder(t.spark)}/lines-{uuid4().hex}"
    lineboxes.write_lines(lines, path, points=4, blocks=32)
    return lineboxes.scan(t.spark, path, (20.0, 100.0, 3.0), (45.0, 700.0, 15.0))


@query("select c_nationkey as key, count(*) as n, round(sum(c_acctbal), 2) as total from customer group by 1")
def cover_turns(t: Tables) -> DataFrame:
    """Nations worked off in turns of nine; the customers of odd ones come late."""
    cover = Cover(t.spark, f"{shared_folder(t.spark)}/cover-{uuid4().hex}")
    plan = numbered(t.customer.select(c("c_nationkey").alias("key")).distinct(), "no", "key")
    rows = t.customer.select(c("c_nationkey").alias("key"), "c_acctbal")
    work = lambda x: x.groupBy("key").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))
    cover.turn(plan, rows.where("key % 2 = 0"), work, 9)
    while cover.turn(plan, rows, work, 9):
        pass
    return cover.result()
