"""Commands as plain SQL: one text runs on Spark and on the SQL twin unless they differ."""

from __future__ import annotations

from gridloom.plans.base import sql

# -- lookups, listings and scans -------------------------------------------------------

sql("info_catalogue", """
    select 'lineitem' as array_name, cast(count(*) as bigint) as cells, max(l_orderkey) as z1, max(l_partkey) as y1, max(l_suppkey) as x1 from {lineitem}
    union all select 'events', cast(count(*) as bigint), max(event_id), max(user_id), cast(0 as bigint) from {events}""")
sql("regions_listing", r"""
    select page_id, regexp_extract(url, '^https?://([^/]+)/', 1) as host, regexp_extract(url, '/([a-z][a-z])/', 1) as region, cast(regexp_extract(url, '/([0-9]+)', 1) as bigint) as origin from {pages}""",
    r"""select page_id, regexp_extract(url, '^https?://([^/]+)/', 1) as host, regexp_extract(url, '/([a-z][a-z])/', 1) as region, cast(regexp_extract(url, '/([0-9]+)', 1) as bigint) as origin from {pages}""")
sql("axis_centroid", """
    select z, round(sum(v * cast(y as double)) / sum(v), 6) as cy, round(sum(v * cast(x as double)) / sum(v), 6) as cx from {voxels} where v > 0 group by z""")
sql("ct_hist", """
    with b as (select cast(floor(z / 1000) as bigint) as box, v from {voxels}),
    ok as (select box from b group by box having avg(case when v > 5 then 1e0 else 0e0 end) >= 1e-1)
    select b.box, v, cast(count(*) as bigint) as n from b join ok on b.box = ok.box group by b.box, v""")
sql("tifxyz_bbox", """
    select o_orderstatus, min(o_orderkey) - 2 as low, max(o_orderkey) + 2 as high, round(min(o_totalprice), 2) as p0, round(max(o_totalprice), 2) as p1 from {orders} where o_totalprice > 100000 group by o_orderstatus""")
sql("tifxyz_crop", "select l_orderkey, l_linenumber, l_quantity from {lineitem} where l_orderkey >= 100 and l_orderkey < 400 and l_linenumber >= 2 and l_linenumber < 5")
sql("tifxyz_scale", """
    select c_custkey, case when c_acctbal < 0 then -1e0 else round(c_acctbal / 4 - 10, 6) end as z from {customer}""")
sql("tifxyz_shards", """
    with p as (select cast(o_custkey as double) as a, o_totalprice / 1000 as b from {orders}),
    m as (select a + d as a, b + e as b from p cross join (select -8e0 as d union all select 8e0) u cross join (select -8e0 as e union all select 8e0) w)
    select distinct cast(floor(a / 128) as bigint) as sa, cast(floor(b / 128) as bigint) as sb from m""")
sql("tifxyz_orient", """
    with g as (select l_orderkey as r, l_linenumber as c, l_quantity as x, l_extendedprice / 1000 as y, l_discount * 100 as z, l_partkey as k1, l_suppkey as k2 from {lineitem}),
    n as (select r, c, x, y, lead(x) over (partition by r order by c, k1, k2, x, z) - x as ux, lead(y) over (partition by r order by c, k1, k2, x, z) - y as uy, lead(z) over (partition by r order by c, k1, k2, x, z) - z as uz,
        lead(x) over (partition by c order by r, k1, k2, x, z) - x as vx, lead(y) over (partition by c order by r, k1, k2, x, z) - y as vy, lead(z) over (partition by c order by r, k1, k2, x, z) - z as vz from g),
    k as (select x * (uy * vz - uz * vy) + y * (uz * vx - ux * vz) as d from n where ux is not null and vx is not null)
    select cast(count(*) as bigint) as n, round(avg(case when d > 0 then 1e0 else 0e0 end), 9) as outward from k""")
sql("wrap_dump", """
    select l_orderkey as z, l_partkey as y, l_suppkey as x, l_linenumber as id from {lineitem} where l_orderkey >= 2000 and l_orderkey < 2200""")

# -- recodes, gates and masks ----------------------------------------------------------

sql("z3_recode", """
    with lut as (select distinct p_size as k, (p_size * 7) % 251 as r from {part})
    select coalesce(r, 255) as v, cast(count(*) as bigint) as n from {voxels} x left join lut on x.v = lut.k group by 1""")
sql("ink_gate", """
    select e.event_id, case when code between 20 and 125 and event_type <> 'click' then cast(floor(value) as int) else 255 end as ink from {phases} e""")
sql("img_gate", """
    with g as (select l_orderkey, max(case when l_linenumber = 1 then floor(l_quantity * 5) end) as a, max(case when l_linenumber = 2 then floor(l_quantity * 5) end) as b from {lineitem} group by 1)
    select o_orderkey, cast(floor((floor(o_totalprice / 2000) * greatest(coalesce(a, 0), coalesce(b, 0)) + 127) / 255) as bigint) as gated from {orders} join g on o_orderkey = l_orderkey""")
sql("phase_conflict", """
    with a as (select user_id, event_id, code from {phases} where event_type = 'click'), b as (select user_id, event_id, code from {phases} where event_type <> 'click')
    select a.event_id, b.event_id as other, case when abs(((a.code - b.code + 126) % 252 + 252) % 252 - 126) > 40 then 1 else 0 end as conflict
    from a join b on a.user_id = b.user_id and a.code is not null and b.code is not null""")
sql("phase_diff_hist", """
    with a as (select user_id, code from {phases} where event_type = 'click' and code is not null), b as (select user_id, code from {phases} where event_type <> 'click' and code is not null)
    select cast(floor((((a.code - b.code) % 252 + 252) % 252) * 20 / 252) as bigint) as bin, cast(count(*) as bigint) as n from a join b on a.user_id = b.user_id group by 1""")
sql("z3_diff", """
    with a as (select z, y, x, max(v) as v from {voxels} where z % 2 = 0 group by 1, 2, 3), b as (select z, y, x, max((v * 3) % 51) as v from {voxels} where z % 3 = 0 group by 1, 2, 3)
    select cast(floor(abs(coalesce(a.v, 0) - coalesce(b.v, 0)) / 8) as bigint) as bin, cast(count(*) as bigint) as n, cast(sum(case when (coalesce(a.v, 0) >= 25) <> (coalesce(b.v, 0) >= 25) then 1 else 0 end) as bigint) as flips
    from a full outer join b on a.z = b.z and a.y = b.y and a.x = b.x group by 1""")
sql("fields_phase", """
    with r as (select user_id, min(code) as ref from {phases} where event_type = 'purchase' group by 1), s as (select user_id, max(code) as one from {phases} where event_type = 'view' group by 1), t as (select user_id, max(code) as two, count(*) as n from {phases} group by 1)
    select t.user_id, coalesce(ref, one, case when n >= 3 then two end) as code from t left join r on t.user_id = r.user_id left join s on t.user_id = s.user_id""")
sql("fields_oracle", """
    with c as (select user_id, avg(cos(code * 2 * pi() / 252)) as c, avg(sin(code * 2 * pi() / 252)) as s, avg(case when code is not null then 1e0 else 0e0 end) as known from {phases} group by 1)
    select user_id, case when known >= 5e-1 then round(sqrt(c * c + s * s), 6) end as conf, round(known, 6) as known from c""")
sql("phase_gate", """
    with d as (select user_id, event_id, value, avg(value) over (partition by user_id order by event_id rows between 1 preceding and 1 following) as q from {events}),
    g as (select user_id, event_id, value, least(1e0, greatest(0e0, (q - 10) / 40)) as t from d)
    select event_id, round(t * t * (3 - 2 * t), 6) as g, round(t * t * (3 - 2 * t) * value + (1 - t * t * (3 - 2 * t)) * 7, 6) as mixed from g""")
sql("merge_flag", """
    with f as (select l_orderkey, l_linenumber, l_returnflag, avg(l_quantity) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount rows between 1 preceding and 1 following) as a, avg(l_discount) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount rows between 1 preceding and 1 following) as b from {lineitem})
    select l_orderkey, l_linenumber, round(1 / (1 + exp(-(a * 5e-2 + b * 3 - 15e-1))), 6) as p from f""")
sql("void_pool", """
    select cast(floor(z / 4) as bigint) as z, cast(floor(y / 4) as bigint) as y, round(avg(case when v < 25 then 1e0 else 0e0 end) * 255, 4) as share from {voxels} group by 1, 2""")
sql("halves_parity", """
    select cast(floor(z / 64) as bigint) as bz, cast(floor(y / 64) as bigint) as by_, round(avg(case when (z + y + x) % 2 = 0 then v end), 6) as even, round(avg(case when (z + y + x) % 2 = 1 then v end), 6) as odd, round(avg(v), 6) as whole from {voxels} group by 1, 2""")
sql("codes_pool2", """
    with g as (select cast(floor(user_id / 2) as bigint) as cell, event_id, code from {phases} where code is not null),
    o as (select cell, code, row_number() over (partition by cell order by event_id) as i from g),
    f as (select cell, code as first from o where i = 1)
    select f.cell, case when max(abs(((o.code - first + 126) % 252 + 252) % 252 - 126)) > 4 then 255 else max(first) end as code from f join o on f.cell = o.cell group by f.cell""")

# -- blends and ensembles --------------------------------------------------------------

sql("blend_logit", """
    with p as (select l_partkey % 97 as cell, least(998e-3, greatest(2e-3, l_quantity / 51)) as p, greatest(pow(sin((l_linenumber + 5e-1) * pi() / 8), 2), 1e-6) as w from {lineitem}),
    m as (select cell, sum(w * ln(p / (1 - p))) / sum(w) as z from p group by 1)
    select cell, round(1 / (1 + exp(-z)), 9) as p from m""")
sql("ink_blend", """
    with p as (select l_suppkey as cell, l_quantity as v, greatest(pow(sin((l_linenumber + 5e-1) * pi() / 8), 2), 1e-6) as w from {lineitem})
    select cell, round(sum(w * v) / sum(w), 6) as v from p group by 1""")
sql("field_blend", """
    with s as (select user_id, sum(value * cos(code * 2 * pi() / 252)) as c, sum(value * sin(code * 2 * pi() / 252)) as s, sum(case when code is not null then value end) as w, max(value) as top, sum(value * value) / sum(value) as mean from {phases} where value > 0 group by 1)
    select user_id, round(sqrt(c * c + s * s) / w, 6) as conf, top, round(mean, 6) as mean from s where w > 0""")
sql("ink_ensemble", """
    with r as (select c_custkey, c_nationkey, percent_rank() over (partition by c_nationkey order by c_acctbal) as a, percent_rank() over (partition by c_nationkey order by -c_custkey) as b from {customer})
    select c_custkey, round((2 * a + b) / 3, 9) as rank_mean from r""")
sql("ink_compare", """
    select o_orderstatus, round(avg(o_totalprice), 4) as mean, round(avg(case when o_totalprice >= 150000 then 1e0 else 0e0 end), 9) as frac, round(corr(o_totalprice, cast(o_custkey as double)), 9) as r from {orders} group by 1""")
sql("ink_teach", """
    with p as (select o_orderkey, least(998e-3, greatest(2e-3, o_totalprice / 500000)) as a, least(998e-3, greatest(2e-3, cast(o_custkey % 100 as double) / 100)) as b from {orders})
    select o_orderkey, round(1 / (1 + exp(-(7e-1 * ln(a / (1 - a)) + 3e-1 * ln(b / (1 - b))))), 9) as soft from p""")

# -- histograms, thresholds and scores -------------------------------------------------

sql("img_stretch", """
    select n_regionkey, round(min(c_acctbal), 2) as lo, round(max(c_acctbal), 2) as hi, cast(count(*) as bigint) as n from {customer} join {nation} on c_nationkey = n_nationkey group by 1""")
sql("ink_audit", """
    with h as (select source, p, sum(case when truth = 1 then 1 else 0 end) as pos, sum(case when truth = 0 then 1 else 0 end) as neg from {scored} group by 1, 2),
    b as (select source, pos, neg, coalesce(sum(neg) over (partition by source order by p rows between unbounded preceding and 1 preceding), 0) as below from h)
    select source, cast(sum(pos) as bigint) as pos, case when sum(pos) * sum(neg) > 0 then round(cast(sum(pos * (below + neg * 5e-1)) as double) / cast(sum(pos) * sum(neg) as double), 9) end as auc from b group by source""")
sql("ink_vscore", """
    with h as (select p, sum(case when toxic = 1 then 1 else 0 end) as pos, sum(case when toxic = 0 then 1 else 0 end) as neg from {scored} group by 1),
    b as (select pos, neg, coalesce(sum(neg) over (order by p rows between unbounded preceding and 1 preceding), 0) as below from h)
    select round(cast(sum(pos * (below + neg * 5e-1)) as double) / cast(sum(pos) * sum(neg) as double), 9) as auc from b""")
sql("emb_calib", """
    with c as (select cast(floor(n_chars / 500) as bigint) as bin, truth from {scored})
    select bin, cast(count(*) as bigint) as n, round(avg(truth), 9) as p_right from c group by 1""")
sql("restore_stats", """
    select cast(count(*) as bigint) as n, round(avg(v), 6) as mean, round(stddev_pop(cast(v as double)), 6) as sd, min(v) as low, max(v) as high from {voxels}""")
sql("scanprep_cells", """
    with c as (select cast(floor(z / 256) as bigint) as cz, cast(floor(y / 256) as bigint) as cy, avg(v) as m from {voxels} group by 1, 2)
    select cz, cy, round(m, 6) as m, case when m >= (select avg(v) from {voxels}) then 1 else 0 end as object from c""",
    """
    with c as (select cast(floor(z / 256) as bigint) as cz, cast(floor(y / 256) as bigint) as cy, avg(v) as m from {voxels} group by 1, 2), a as (select avg(v) as all_ from {voxels})
    select cz, cy, round(m, 6) as m, case when m >= all_ then 1 else 0 end as object from c cross join a""")
sql("vol_cmp_map", "select v, cast(count(*) as bigint) as n, round(avg(cast(x as double)), 6) as mapped from {voxels} group by v")
sql("ct_quantised_embedding", """
    select vec_id, cast(count(*) as bigint) as dims, round(sum(q * q), 6) as norm2 from (select vec_id, round(e * 127) / 127 as q from (select vec_id, cast(unnest(embedding) as double) as e from {embeddings}) u) w group by 1""",
    """select vec_id, cast(size(embedding) as bigint) as dims, round(aggregate(embedding, 0e0, (s, e) -> s + pow(round(cast(e as double) * 127) / 127, 2)), 6) as norm2 from {embeddings}""")
sql("cosine_same_label", """
    with p as (select a.label, list_dot_product(a.embedding::double[], b.embedding::double[]) / sqrt(list_dot_product(a.embedding::double[], a.embedding::double[]) * list_dot_product(b.embedding::double[], b.embedding::double[])) as c
        from {embeddings} a join {embeddings} b on a.label = b.label and b.vec_id = a.vec_id + 10)
    select label, cast(count(*) as bigint) as n, round(avg(c), 6) as mean from p group by 1""",
    """with p as (select a.label, a.embedding as u, b.embedding as w from {embeddings} a join {embeddings} b on a.label = b.label and b.vec_id = a.vec_id + 10),
    c as (select label, aggregate(zip_with(u, w, (x, y) -> cast(x as double) * y), 0e0, (s, e) -> s + e) / sqrt(aggregate(u, 0e0, (s, e) -> s + cast(e as double) * e) * aggregate(w, 0e0, (s, e) -> s + cast(e as double) * e)) as c from p)
    select label, cast(count(*) as bigint) as n, round(avg(c), 6) as mean from c group by 1""")

# -- paths, lines and runs -------------------------------------------------------------

sql("fiber_check", """
    with a as (select user_id, event_id, event_type, lead(event_type, 2) over (partition by user_id order by event_id) as later, lead(event_id, 2) over (partition by user_id order by event_id) as place from {events})
    select cast(floor((place - event_id) / 1000) as bigint) as lag_bin, cast(count(*) as bigint) as n, round(avg(case when event_type = later then 1e0 else 0e0 end), 9) as same from a where later is not null group by 1""")
sql("fiber_export", """
    with p as (select user_id, event_id, 2 * value + 3 as x from {events} where value between 5 and 90)
    select user_id, cast(count(*) as bigint) as n, round(min(x), 6) as x0, round(max(x), 6) as x1 from p group by 1 having count(*) >= 3""")
sql("fiber_mfstat", """
    with a as (select value, lead(value, 1) over (partition by user_id order by event_id) as v1, lead(value, 4) over (partition by user_id order by event_id) as v4 from {events})
    select cast(count(v1) as bigint) as n1, round(avg(case when v1 is not null then case when greatest(value, v1) >= 50 then 1e0 else 0e0 end end), 9) as s1,
      cast(count(v4) as bigint) as n4, round(avg(case when v4 is not null then case when greatest(value, v4) >= 50 then 1e0 else 0e0 end end), 9) as s4 from a""")
sql("fiber_regscore", """
    with s as (select -2 as d union all select -1 union all select 0 union all select 1 union all select 2),
    m as (select d, avg(b.v) as m from {voxels} a cross join s join (select z, max(v) as v from {voxels} group by z) b on b.z = a.z + d where a.v >= 45 group by d),
    w as (select d, m, lag(m) over (order by d) as p, lead(m) over (order by d) as n from m)
    select d, round(m, 6) as presence, case when p is not null and n is not null and abs(p - 2 * m + n) > 1e-9 then round((p - n) / (2 * (p - 2 * m + n)), 4) end as vertex from w""")
sql("wrap_switch", """
    with d as (select user_id, event_id, code, lag(code) over (partition by user_id order by event_id) as p from {phases} where code is not null),
    k as (select user_id, (cast(round((code - p) / 18e0) as int) % 14 + 21) % 14 - 7 as dq from d where p is not null)
    select user_id, cast(count(*) as bigint) as steps, cast(sum(abs(dq)) as bigint) as switches from k group by 1""")
sql("count_anat", """
    with d as (select cast(floor(value / 10) as bigint) as band, code / 18e0 as t from {phases} where code is not null),
    k as (select band, cast(round(t - 14 * floor(t / 14 + 5e-1)) as int) as k from d)
    select band, cast(sum(case when k < 0 then 1 else 0 end) as bigint) as below, cast(sum(case when k = 0 then 1 else 0 end) as bigint) as zero, cast(sum(case when k > 0 then 1 else 0 end) as bigint) as above from k group by 1""")
sql("gap_density", """
    with s as (select user_id, event_id, case when value >= 20 then 1 else 0 end as m from {events}),
    c as (select user_id, event_id, m, case when lag(m) over (partition by user_id order by event_id) = m then 0 else 1 end as nw from s),
    r as (select user_id, event_id, m, sum(nw) over (partition by user_id order by event_id rows between unbounded preceding and current row) as run from c),
    g as (select user_id, run, m, count(*) as n from r group by 1, 2, 3)
    select user_id, cast(sum(case when m = 1 and n >= 2 then 1 else 0 end) as bigint) as entries from g group by 1""")
sql("ray_check", """
    with d as (select user_id, event_id, code / 252e0 as t, lag(code / 252e0) over (partition by user_id order by event_id) as p from {phases} where code is not null),
    w as (select user_id, (t - p) - floor((t - p) + 5e-1) as d from d where p is not null)
    select user_id, round(sum(d), 6) + 0e0 as turns, cast(count(*) as bigint) as steps from w group by 1""")
sql("phase_check", """
    with d as (select user_id, event_id, code, lead(code) over (partition by user_id order by event_id) as n from {phases} where code is not null)
    select cast(count(*) as bigint) as n, round(avg(case when ((n - code + 126) % 252 + 252) % 252 - 126 > 0 then 1e0 else 0e0 end), 9) as rising from d where n is not null""")
sql("side_gate", """
    with s as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_quantity >= 25 then 1 else 0 end as m from {lineitem}),
    c as (select l_orderkey, l_linenumber, m, case when lag(m) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, m) = m then 0 else 1 end as nw from s),
    r as (select l_orderkey, cast(sum(nw) as bigint) as runs, cast(sum(m) as bigint) as len from c group by 1)
    select runs, len, cast(count(*) as bigint) as n, cast(sum(case when runs between 1 and 3 and len between 1 and 4 then 1 else 0 end) as bigint) as kept from r group by 1, 2""")
sql("ink_seam", """
    with d as (select l_orderkey as z, abs(lead(l_quantity) over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_quantity) - l_quantity) as dv from {lineitem})
    select case when z % 512 = 0 then 'seam' else 'interior' end as part, cast(count(*) as bigint) as n, round(avg(dv), 6) as mean from d where dv is not null group by 1""")
sql("ink_cover", """
    with g as (select l_orderkey, l_linenumber, l_returnflag, l_quantity as v, lag(l_quantity) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) as p, lead(l_quantity) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) as n from {lineitem})
    select l_returnflag, round(avg(case when v >= 40 then 1e0 else 0e0 end), 9) as share, round(avg(v), 6) as mean, round(avg(abs(2 * v - p - n)), 6) as contrast from g group by 1""")
sql("phase_packing", """
    with g as (select l_suppkey, l_quantity * 5 as a, lead(l_quantity * 5) over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_quantity) - l_quantity * 5 as d1, lead(l_quantity * 5, 2) over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_quantity) - l_quantity * 5 as d2 from {lineitem})
    select l_suppkey, cast(count(*) as bigint) as n, round(avg(case when sqrt(d1 * d1 + d2 * d2) > 100 then 1e0 else 0e0 end), 9) as packed from g where d2 is not null group by 1""")
sql("field_diag", """
    with f as (select user_id, event_id, value, code, lead(code) over (partition by user_id order by event_id) as n from {phases} where code is not null)
    select cast(floor(value / 25) as bigint) as bin, cast(count(*) as bigint) as cells, round(avg(abs(((n - code + 126) % 252 + 252) % 252 - 126) / 252e0), 9) as err, round(avg(case when abs(((n - code + 126) % 252 + 252) % 252 - 126) < 25 then 1e0 else 0e0 end), 9) as close from f where n is not null group by 1""")

# -- surfaces, tiles and tables --------------------------------------------------------

sql("phase_score", """
    with p as (select event_type, case when event_id % 16 = 0 then 'seam' else 'interior' end as part, cos(code * 2 * pi() / 252) as c, sin(code * 2 * pi() / 252) as s from {phases} where code is not null)
    select event_type, part, cast(count(*) as bigint) as n, round(sum(c) / sum(sqrt(c * c + s * s)), 6) as score from p group by 1, 2 having count(*) >= 20""")
sql("surf_stats", """
    select l_returnflag, l_linestatus, cast(count(*) as bigint) as n, round(avg(l_discount), 9) as share, round(sum(l_quantity * l_discount) / sum(l_quantity), 9) as weighted from {lineitem} group by 1, 2""")
sql("strip_mosaic", """
    select cast(floor(l_orderkey / 1000) as bigint) as tile, cast(count(*) as bigint) as px, round(count(*) * 1e-4, 6) as cm2, round(avg(case when l_quantity >= 40 then 1e0 else 0e0 end), 9) as bright, min(l_suppkey) as first, max(l_suppkey) as last from {lineitem} group by 1""")
sql("strip_layout", """
    with w as (select l_suppkey as wrap, count(*) as cols from {lineitem} group by 1)
    select wrap, cast(cols as bigint) as cols, cast(sum(cols) over (order by wrap rows between unbounded preceding and current row) - cols as bigint) as at from w""")
sql("geom_check", """
    with b as (select l_suppkey as s, cast(floor(l_partkey / 100) as bigint) as bin, avg(l_quantity) as r, count(*) as n from {lineitem} group by 1, 2 having count(*) >= 2)
    select a.s, cast(count(*) as bigint) as bins, round(avg(b.r - a.r), 6) as gap, cast(sum(case when b.r < a.r then 1 else 0 end) as bigint) as crossed from b a join b b on b.s = a.s + 1 and a.bin = b.bin group by a.s""")
sql("wrap_match", """
    with a as (select l_suppkey as s, cast(floor(l_partkey / 200) as bigint) as bin, avg(l_quantity) as r from {lineitem} where l_orderkey % 2 = 0 group by 1, 2 having count(*) >= 2),
    b as (select l_suppkey as s, cast(floor(l_partkey / 200) as bigint) as bin, avg(l_quantity) as r from {lineitem} where l_orderkey % 2 = 1 group by 1, 2 having count(*) >= 2),
    p as (select a.s, b.s as other, avg(abs(a.r - b.r)) as d, count(*) as n from a join b on a.bin = b.bin group by 1, 2),
    r as (select *, row_number() over (partition by s order by round(d, 9), other) as i from p)
    select s, other, round(d, 6) as d, cast(n as bigint) as n from r where i = 1""")
sql("wrap_mf", """
    with f as (select cast(floor(z / 64) as bigint) as c, max(case when v >= 49 then 1 else 0 end) as flag from {voxels} group by 1)
    select l_suppkey, round(avg(flag), 9) as share from {lineitem} join f on cast(floor(l_orderkey / 64) as bigint) = c group by 1""")
sql("sheet_score", """
    with p as (select l_partkey % 50 as cell, cast(round(l_quantity / 10) as int) as k from {lineitem}),
    c as (select cell, k, count(*) as n from p group by 1, 2), m as (select cell, max(n) as top, sum(n) as total from c group by 1)
    select round(cast(sum(top) as double) / cast(sum(total) as double), 9) as ids, cast(sum(total) as bigint) as matched from m""")
sql("mode_share_per_cell", """
    with c as (select l_suppkey as cell, cast(floor(l_quantity) as int) as k, count(*) as n from {lineitem} group by 1, 2),
    r as (select *, row_number() over (partition by cell order by n desc, k) as i, lead(n) over (partition by cell order by n desc, k) as second, sum(n) over (partition by cell) as total from c)
    select cell, k, cast(n as bigint) as n, round(n / cast(total as double), 9) as share, cast(coalesce(second, 0) as bigint) as second from r where i = 1""")
sql("wind_score", """
    with m as (select user_id, code, ((code * 3 + event_id) % 252) as w from {phases} where code is not null), g as (select (((w - code) % 252 + 252) % 252) as d, count(*) as n from m group by 1),
    t as (select d, n, row_number() over (order by n desc, d) as i, sum(n) over () as total from g)
    select d as gauge, cast(n as bigint) as n, round(n / cast(total as double), 9) as share from t where i = 1""")
sql("wind_assign", """
    with v as (select l_suppkey as comp, l_linenumber % 2 as dir, l_linenumber % 14 as k, count(*) as n from {lineitem} group by 1, 2, 3),
    r as (select *, row_number() over (partition by comp order by n desc, dir, k) as i, sum(n) over (partition by comp) as total from v)
    select comp, cast(dir as int) as dir, cast(k as int) as k, case when n >= 5e-1 * total then 'duplicate' when n >= 2e-1 * total then 'conflict' else 'new' end as verdict from r where i = 1""")
sql("wind_seed", """
    with r as (select s_suppkey, s_name, s_nationkey, dense_rank() over (partition by s_nationkey order by s_acctbal) as k from {supplier})
    select s_suppkey, cast(regexp_extract(s_name, '([0-9]+)', 1) as bigint) as parsed, cast(k as int) as gauge from r""")
sql("dino_boxes", """
    with b as (select cast(floor(l_orderkey / 512) as bigint) as bz, cast(floor(l_partkey / 512) as bigint) as by_, count(*) as n from {lineitem} group by 1, 2 having count(*) >= 20)
    select bz, by_, cast(n as bigint) as n from b where not exists (select 1 from {nation} x where bz * 512 < x.n_nationkey * 400 + 50 and (bz + 1) * 512 > x.n_nationkey * 400 and x.n_nationkey % 9 = 0)""",
    """
    with b as (select cast(floor(l_orderkey / 512) as bigint) as bz, cast(floor(l_partkey / 512) as bigint) as by_, count(*) as n from {lineitem} group by 1, 2 having count(*) >= 20),
    x as (select explode(sequence(cast(floor(n_nationkey * 400 / 512) as bigint), cast(floor((n_nationkey * 400 + 49) / 512) as bigint))) as bz from {nation} where n_nationkey % 9 = 0)
    select bz, by_, cast(n as bigint) as n from b left anti join x using (bz)""")
sql("holdout_cover", """
    with c as (select source, d.doc_id, lang from {documents} d)
    select source, cast(count(*) as bigint) as cells, cast(sum(case when l.doc_id is not null then 1 else 0 end) as bigint) as held, round(avg(case when l.doc_id is not null then 1e0 else 0e0 end), 9) as share
    from c left join (select distinct doc_id from {labels}) l on c.doc_id = l.doc_id group by 1""")
sql("annot_regions", """
    with u as (select 'judge' as kind, cast(o_orderkey as bigint) as id, o_totalprice as badness from {orders} where o_orderstatus = 'F' union all select 'check', c_custkey, c_acctbal * 40 from {customer} where c_acctbal > 0)
    select kind, id, badness from u order by badness desc, kind, id limit 100""")
sql("gt_anchors", """
    with b as (select o_custkey * 10 as lo, o_custkey * 10 + 4 as hi from {orders} group by 1, 2)
    select distinct l_orderkey from {lineitem} join b on l_orderkey >= lo and l_orderkey < hi where l_orderkey % 3 <> 0""",
    """
    with b as (select explode(sequence(lo, lo + 3)) as l_orderkey from (select o_custkey * 10 as lo from {orders} group by 1) s)
    select distinct l.l_orderkey from {lineitem} l left semi join b on l.l_orderkey = b.l_orderkey where l.l_orderkey % 3 <> 0""")
sql("phase_coh", """
    with c as (select cast(floor(l_orderkey / 128) as bigint) as cell, corr(l_quantity, cos(l_extendedprice)) as r from {lineitem} group by 1)
    select cell, round(r, 6) as r, round(least(1e0, greatest(0e0, (r - 5e-2) / 3e-1)), 6) as w from c where r is not null""")
sql("cf_compare", """
    with a as (select l_orderkey as k, avg(l_quantity) as w from {lineitem} group by 1), b as (select l_orderkey as k, avg(l_quantity + l_discount * 10) as w from {lineitem} group by 1)
    select cast(count(*) as bigint) as n, round(avg(abs(a.w - b.w)), 9) as delta, round(avg(case when floor(a.w + 5e-1) = floor(b.w + 5e-1) then 1e0 else 0e0 end), 9) as snap from a join b on a.k = b.k""")
sql("fit_compare", """
    with a as (select l_orderkey as k, avg(l_tax) as w, avg(l_discount) as s from {lineitem} group by 1)
    select cast(count(*) as bigint) as n, round(avg(abs(w - s)), 9) as err, round(corr(w, s), 6) as r from a""")
sql("gap_compare", """
    with r as (select user_id, count(*) as n, avg(value) as s from {events} where value > 0 group by 1)
    select cast(floor(s / 20) as bigint) as bin, cast(count(*) as bigint) as cells, round(avg(log2(n / s)), 6) as ratio from r group by 1""")
sql("exact_text_dedup", """
    with r as (select doc_id, source, text, row_number() over (partition by text order by n_chars desc, doc_id) as i from {documents})
    select doc_id, source from r where i = 1""",
    """
    with k as (select md5(cast(text as binary)) as k, min(doc_id) as doc_id from {documents} group by 1)
    select d.doc_id, source from {documents} d join k on d.doc_id = k.doc_id and md5(cast(d.text as binary)) = k.k""")
sql("json_props_agg", """
    select event_type, cast(count(*) as bigint) as n, cast(sum(cast(json_extract_string(props, '$.k') as bigint)) as bigint) as total, max(cast(json_extract_string(props, '$.k') as bigint)) as top from {events} group by 1""",
    """select event_type, cast(count(*) as bigint) as n, sum(cast(get_json_object(props, '$.k') as bigint)) as total, max(cast(get_json_object(props, '$.k') as bigint)) as top from {events} group by 1""")
sql("vwt_tile", """
    with t as (select cast(i as bigint) as i from range(0, 40) r(i)), s as (select i, i * 128 as z0, i * 128 + 160 as z1 from t)
    select a.i, b.i as j, least(a.z1, b.z1) - greatest(a.z0, b.z0) as overlap from s a join s b on a.i < b.i and a.z1 > b.z0""",
    """
    with t as (select explode(sequence(0L, 39L)) as i), s as (select i, i * 128 as z0, i * 128 + 160 as z1 from t)
    select a.i, b.i as j, least(a.z1, b.z1) - greatest(a.z0, b.z0) as overlap from s a join s b on b.i = a.i + 1""")
sql("gnw_stats", """
    select s_nationkey, round(corr(cast(s_suppkey as double), s_acctbal), 9) as r, cast(count(*) as bigint) as n from {supplier} group by 1 having count(*) >= 4""")
sql("vote_merge_edges", """
    select least(l_partkey, l_suppkey) as a, greatest(l_partkey, l_suppkey) as b, case when l_partkey > l_suppkey then -l_linenumber else l_linenumber end as d, cast(sum(floor(l_quantity)) as bigint) as w from {lineitem} where l_partkey <> l_suppkey group by 1, 2, 3""")
sql("mirror_missing", """
    select o_orderkey, o_totalprice from {orders} o where not exists (select 1 from {lineitem} l where l.l_orderkey = o.o_orderkey)""")
sql("latvol_check", """
    select cast(count(*) as bigint) as n, round(avg(abs(v - 4 * floor(v / 4e0 + 5e-1))), 6) as mean_err, round(max(abs(v - 4 * floor(v / 4e0 + 5e-1))), 6) as max_err from {voxels}""")
sql("fields_pack", """
    select user_id, event_id, case when code is null then 255 else cast(floor(code / 4e0 + 5e-1) * 4 as int) % 252 end as code4, round(floor(value / 2 + 5e-1) * 2, 6) as value2 from {phases}""")
sql("phase_pack", """
    select event_id, cast(floor(code / 4) as int) as packed, cast(floor(code / 4) as int) * 4 as unpacked from {phases} where code is not null""")
sql("repack_shards", """
    select cast(floor(z / 1024) as bigint) as shard, cast(floor(z / 128) as bigint) as chunk, cast(count(*) as bigint) as cells, cast(sum(v) as bigint) as total from {voxels} group by 1, 2""")
sql("prefetch_plan", """
    select cast(floor(l_orderkey / 128) as bigint) as chunk, cast(count(*) as bigint) as cells from {lineitem} l where exists (select 1 from {orders} o where o.o_orderkey = l.l_orderkey and o_orderstatus = 'F') group by 1""")
sql("ckpt_avg", "select p_brand, round(avg(p_retailprice), 6) as mean, cast(count(*) as bigint) as n from {part} group by 1")
sql("restore_psnr", """
    with e as (select avg(pow(v - 2 * floor(v / 2), 2)) as mse from {voxels}) select round(10 * log10(2500 / mse), 6) as psnr from e""")
