"""Every registered query with a SQL twin returns the same rows as DuckDB."""

import pandas as pd
import pytest

from gridloom.plans.catalogue import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


def rows(df: pd.DataFrame) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    show = lambda v: "" if v is None or v is pd.NA or v != v else f"{float(v):.9g}" if not isinstance(v, str) and hasattr(v, "__float__") else str(v)
    return names, sorted(tuple(show(v) for v in r) for r in df[names].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    assert rows(QUERIES[name](spark, DIR).toPandas()) == rows(duck.execute(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0


def test_whole_tables(spark, monkeypatch):
    """Queries without a twin hand their operator every key of the table."""
    from gridloom.operators import graph, grid, rays
    from gridloom.plans import kernels
    from gridloom.plans.base import Tables

    t = Tables(spark, DIR)
    for module, name in ((graph, "spanning_forest"), (graph, "chain_gauges"), (graph, "greedy_links"), (rays, "peaks"), (grid, "drop_small")):
        monkeypatch.setattr(module, name, lambda rows, *_: rows)
    assert kernels.spanning_forest(t).selectExpr("sum(w)").first()[0] == t.customer.selectExpr("sum(c_custkey)").first()[0]
    assert kernels.chain_gauges(t).count() == t.lineitem.count()
    assert kernels.fiber_link(t).count() == t.lineitem.select("l_partkey", "l_suppkey").distinct().count()
    assert kernels.peaks_prominence(t).count() == t.events.count()
    assert kernels.scanprep_drop_small(t).count() == t.lineitem.count()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["thr", "cut", "tp", "fp", "precision", "recall", "f1"]
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLES) <= set(__spark_entry__.oracle_sql())
