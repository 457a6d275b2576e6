"""Incremental aggregation behind a frontier, and folded logs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(events: DataFrame, time: str, width: str, late: str, *aggregates) -> DataFrame:
    """Aggregates of tumbling windows, emitted (in append mode) once the frontier, the
    latest time less ``late``, has passed them."""
    stamped = events.withColumn("__t", F.col(time).cast("timestamp"))
    return stamped.withWatermark("__t", late).groupBy(F.window("__t", width).alias("window")).agg(*aggregates).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *(F.col(c) for c in _names(aggregates)))


def _names(aggregates) -> list[str]:
    return [a._jc.toString().rpartition(" AS ")[2].strip("`") if hasattr(a, "_jc") else str(a) for a in aggregates]


def ready_chunks(rows: DataFrame, chunk: int) -> DataFrame:
    """Finished ranges (z0, z1) -> chunks whose rows are all there, each once.  State is one
    set of open rows a chunk and goes when the chunk is complete."""
    each = rows.withColumn("z", F.explode(F.sequence("z0", F.col("z1") - 1))).withColumn("chunk", F.floor(F.col("z") / chunk).cast("long"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done = set(state.get[0]) if state.exists else set()
        if -1 in done:  # emitted already
            return
        for x in batches:
            done |= set(x["z"].tolist())
        if len(done) == chunk:
            state.update(([-1],))
            yield pd.DataFrame({"chunk": [key[0]], "rows": [chunk]})
        else:
            state.update((sorted(done),))

    return each.groupBy("chunk").applyInPandasWithState(step, "chunk long, rows long", "done array<long>", "update", GroupStateTimeout.NoTimeout)


def fold_log(log: DataFrame, order: str = "seq") -> DataFrame:
    """Live items of a log of add, del and undo: an undo cancels the latest entry of its id
    that is not cancelled.  One id's entries are folded together."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), "op", "item")))

    def step(stack, r):
        return F.when(r["op"] == "undo", F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))).otherwise(F.concat(stack, F.array(r)))

    held = log.groupBy("id").agg(rows.alias("rows"))
    kind = f"array<struct<o:{dict(log.dtypes)[order]},op:string,item:{dict(log.dtypes)['item']}>>"
    last = held.select("id", F.try_element_at(F.aggregate("rows", F.array().cast(kind), step), F.lit(-1)).alias("last"))
    return last.where(F.col("last.op") == "add").select("id", F.col("last.item").alias("item"))
