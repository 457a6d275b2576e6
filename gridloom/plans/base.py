"""Registering queries with their SQL twins, and the stand-in inputs of the catalogue."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Tables:
    """The driver's tables by name, and the relations of the data model made of them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in NAMES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def voxels(self) -> DataFrame:
        return self.lineitem.select(F.col("l_orderkey").alias("z"), F.col("l_partkey").alias("y"), F.col("l_suppkey").alias("x"), F.floor("l_quantity").cast("int").alias("v"))

    @property
    def phases(self) -> DataFrame:
        second = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.floor(F.second("ts"))
        code = F.when(F.col("event_id") % 7 != 0, F.floor(second * 252 / 86400).cast("int"))
        return self.events.select("event_id", "user_id", "event_type", "ts", "value", code.alias("code"))

    @property
    def scored(self) -> DataFrame:
        p = F.least(F.floor(F.col("n_chars") / 40), F.lit(255)).cast("int")
        return self.documents.join(self.labels, "doc_id").select("doc_id", "lang", "source", "n_chars", p.alias("p"), F.col("quality").alias("truth"), "toxic")


#: The same relations in SQL.
VOXELS = "(select l_orderkey as z, l_partkey as y, l_suppkey as x, cast(floor(l_quantity) as int) as v from lineitem)"
PHASES = "(select event_id, user_id, event_type, ts, value, case when event_id % 7 <> 0 then cast(floor((hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts))) * 252 / 86400) as int) end as code from events)"
SCORED = "(select d.doc_id, lang, source, n_chars, cast(least(floor(n_chars / 40), 255) as int) as p, quality as truth, toxic from documents d join labels l on d.doc_id = l.doc_id)"


def query(oracle: str | None = None):
    """Registers a function of Tables under its name, with its SQL twin."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            ORACLES[f.__name__] = oracle.replace("{voxels}", VOXELS).replace("{phases}", PHASES).replace("{scored}", SCORED)
        return f

    return register


def sql(name: str, text: str, spark_text: str | None = None) -> None:
    """Registers a query given as SQL.  {voxels}, {phases} and {scored} stand for the
    relations above, other names in braces for tables."""
    tables = {n: "{" + n + "}" for n in NAMES}

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = Tables(spark, sf_dir)
        used = {n: getattr(t, n) for n in (*NAMES, "voxels", "phases", "scored") if "{" + n + "}" in (spark_text or text)}
        return spark.sql(spark_text or text, **used)

    QUERIES[name] = run
    plain = text.replace("{voxels}", VOXELS).replace("{phases}", PHASES).replace("{scored}", SCORED)
    for n, braced in tables.items():
        plain = plain.replace(braced, n)
    ORACLES[name] = plain


def by_operator(name: str | None = None):
    """Registers a function of Tables as the Spark side of a query whose SQL is registered
    already, so that an operator of the library is held against a text of its own."""

    def register(f: Callable[[Tables], DataFrame]):
        key = name or f.__name__
        assert key in ORACLES, key
        QUERIES[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        return f

    return register
