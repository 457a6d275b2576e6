"""Registered queries of the text operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.rlz_dedup import substring_dedup

    return substring_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.interpolation import scores

    return scores(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.topk import top_k

    return top_k(_table(spark, sf_dir, "embeddings"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.near_dedup import classes

    return classes(_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.langid import language_id

    return language_id(_table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.decontaminate import matches

    return matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.packing import best_fit_pack

    return best_fit_pack(_table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.html_extract import extract

    return extract(_table(spark, sf_dir, "pages"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.pii import pii

    return pii(_table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.collocations import collocations

    return collocations(_table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.spelling import variants

    return variants(_table(spark, sf_dir, "documents"))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.embedding_dedup import classes

    return classes(_table(spark, sf_dir, "embeddings"))


#: Queries that SQL can express, over the same whole tables.
ORACLES = {
    "op1_substring_dedup": r"""
        with d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
        p as (select doc_id, w, unnest(range(1, len(w) - 18)) as i from d where len(w) >= 20),
        k as (select doc_id, i, row_number() over (partition by md5(array_to_string(list_slice(w, i, i + 19), ' ')) order by doc_id, i) as r from p),
        gone as (select distinct doc_id, unnest(range(i, i + 20)) as j from k where r > 1),
        x as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as j from d),
        g as (select x.doc_id, count(*) filter (where gone.j is not null) as n_removed, string_agg(word, ' ' order by x.j) filter (where gone.j is null) as kept
            from x left join gone on x.doc_id = gone.doc_id and x.j = gone.j group by x.doc_id)
        select d.doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join g on d.doc_id = g.doc_id""",
    "op4_exact_topk": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
            where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        q as (select vec_id as query_id, min(v) as v from v where vec_id % 50 = 0 group by vec_id),
        s as (
            select query_id, vec_id, list_dot_product(q.v, v.v)::bigint as score
            from q join v on q.query_id <> v.vec_id and len(q.v) = len(v.v)),
        r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
        select query_id, rank, vec_id, score from r where rank <= 5""",
    "op11_collocations": r"""
        with p as (
            select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
        w as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as w from p),
        s as (select lang, w, unnest(range(1, len(w) + 1)) as i from w),
        g as (select lang, list_slice(w, i, i + k - 1) as g from s, (values (1), (2), (3)) t(k) where i + k - 1 <= len(w)),
        f as (select lang, g, count(*)::hugeint as f from g group by lang, g having count(*) >= 10),
        n as (select lang, sum(len(w))::bigint as n from w group by lang),
        c as (select lang, g, f as a, unnest(range(1, len(g))) as k from f where len(g) >= 2),
        x as (
            select c.lang, c.g, c.a, c.k, l.f as l, r.f as r, 1000000 * c.a * c.a // (l.f * r.f) as score from c
            join f l on l.lang = c.lang and l.g = list_slice(c.g, 1, c.k) join f r on r.lang = c.lang and r.g = list_slice(c.g, c.k + 1, len(c.g))),
        b as (select *, row_number() over (partition by lang, g order by score, k) as place from x),
        longer as (
            select lang, g, max(f) as f from (select lang, f, unnest([list_slice(g, 1, 2), list_slice(g, 2, 3)]) as g from f where len(g) = 3) group by lang, g),
        o as (
            select b.*, row_number() over (partition by b.lang order by score desc, a desc, array_to_string(b.g, ' ')) as rank
            from b left join longer on b.lang = longer.lang and b.g = longer.g where place = 1 and (longer.f is null or 100 * longer.f < 50 * a))
        select o.lang, rank::bigint as rank, array_to_string(g, ' ') as phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score
        from o join n on o.lang = n.lang where rank <= 2000""",
    "op12_spelling_variants": r"""
        with recursive bits(i, k, x) as (select i, 0, i from range(0, 256) a(i) union all select i, k + 1, case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end from bits where k < 8),
        tab as (select list(x order by i) as t from bits where k = 8),
        d as (select coalesce(doc_id::varchar, '') as id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) as run from documents),
        r as (select id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as n from d group by 1, 2),
        b as (select run, n, hex(encode(id || ':' || run)) as x from r),
        h as (select run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::bigint)), lambda s, y: xor(s >> 8, t[(xor(s, y) & 255) + 1])), 4294967295) as h from b, tab),
        c as (select case when h % 97 = 0 then left(run, (h % len(run))::bigint) || substr(run, (h % len(run))::bigint + 2) else run end as word, n from h),
        w as materialized (select word, sum(n)::bigint as n from c where len(word) >= 5 group by word having sum(n) >= 3),
        o as materialized (select word, n, i, left(word, i) || substr(word, i + 2) as cut from (select word, n, unnest(range(0, len(word))) as i from w)),
        p as (select a.word, b.word as near, b.n as m from o a join o b on a.i = b.i and a.cut = b.cut and a.word <> b.word
            union select o.word, w.word, w.n from o join w on o.cut = w.word
            union select w.word, o.word, o.n from o join w on o.cut = w.word),
        f as (select word, count(*) as n_near, arg_min(near, (-m, encode(near))) as best, max(m) as m from p group by word),
        g as materialized (select w.word, w.n, coalesce(n_near, 0) as n_near, case when m >= 2 * w.n then best end as form, case when m >= 2 * w.n then m end as form_n from w left join f on w.word = f.word),
        s(word, root) as (select word, word from g where form is null union all select g.word, s.root from g join s on g.form = s.word)
        select g.word, form, root, g.n, n_near::bigint as n_near, form_n::bigint as form_n from g join s on g.word = s.word""",
    "op13_embedding_dedup": """
        with recursive v as (select vec_id, embedding::double[] as v from embeddings
            where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
        e as materialized (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) where list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.9),
        r(vec_id, id) as (select vec_id, vec_id from embeddings union select e.b, r.id from r join e on r.vec_id = e.a),
        c as (select vec_id, min(id) as component_id from r group by vec_id),
        n as (select a, count(*) as n from e group by a)
        select x.vec_id, coalesce(n.n, 0)::bigint as n_links, c.component_id, x.vec_id = c.component_id as kept
        from embeddings x join c on x.vec_id = c.vec_id left join n on x.vec_id = n.a""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return ORACLES
