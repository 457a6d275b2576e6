"""The pipeline, stage by stage and as a whole."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__
import corpus_pipeline
from gridloom.llm import decontaminate, near_dedup, packing, pii, queries, toxicity

DIR = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").cache()
    labels, benchmark = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("labels", "benchmark"))
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    (_, drop_toxic), (_, drop_copies), (_, drop_leaked), (_, redact), (_, pack) = corpus_pipeline.STAGES
    a = drop_toxic(spark, docs, DIR)
    assert a.columns == docs.columns and ids(a) == ids(toxicity.toxicity(docs, labels).where("predicted = 0"))
    b = drop_copies(spark, a, DIR)
    assert b.columns == docs.columns and ids(b) == ids(near_dedup.classes(a).where("doc_id = class_id"))
    c = drop_leaked(spark, b, DIR)
    assert c.columns == docs.columns and ids(c) == ids(b) - ids(decontaminate.matches(b, benchmark))
    d = redact(spark, c, DIR)
    assert d.columns == docs.columns and ids(d) == ids(c) and d.where("text like '%<EMAIL>%'").count() == pii.pii(c).where("n_email > 0").count()
    e = pack(spark, d, DIR)
    want = sorted(tuple(r) for r in packing.best_fit_pack(d).select("doc_id", "piece", "ids_crc32").collect())
    assert sorted(tuple(r) for r in e.select("doc_id", "piece", "ids_crc32").collect()) == want
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, DIR).select("doc_id", "piece", "ids_crc32").collect()) == want


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "documents", "pages", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, DIR).toPandas()
    names = sorted(got.columns)
    plain = lambda t: sorted((tuple(None if pd.isna(v) else v for v in r) for r in t[names].astype(object).values.tolist()), key=lambda r: [(v is None, v or 0) if not isinstance(v, str) else (False, v) for v in r])
    assert names == sorted(want.columns) and plain(got) == plain(want)


def test_registered():
    made = __spark_entry__.queries()
    assert "pipeline" in made and all(sum(n.startswith(f"op{k}_") for n in made) == 1 for k in range(1, 11))


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_odd_tables(spark, odd, none, wide, stage):
    """Nulls, blank and long texts, repeated rows and ids, clashing names, no rows at all."""
    name, f = corpus_pipeline.STAGES[stage]
    got = f(spark, odd, DIR)
    if name == "packing":
        assert got.select("doc_id").distinct().count() == odd.select("doc_id").distinct().count()
        assert f(spark, wide, DIR).count() == got.count()
    else:
        # copies: 6 of 5, one of the equal rows of 10; all else stays
        assert got.columns == odd.columns and got.count() == odd.count() - 2 * (name == "near_dedup")
        assert f(spark, wide, DIR).columns == wide.columns
    assert f(spark, none, DIR).count() == 0
