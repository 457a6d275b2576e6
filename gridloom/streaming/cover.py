"""A finite plan worked off in turns, that may stop, go on, and be extended.

A plan is a table (no, key): keys in the order of no, from 0.  Each ``turn`` takes the next
keys, and those that earlier turns could not find, joins them with the inputs there are
now, and appends what the work makes of them.  A turn is committed by one small document
written after its data: how far the plan is taken and a digest of the plan up to there.
A key whose input is not published yet is not lost: it stays open and is looked for again.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col


class PlanChanged(ValueError):
    """The plan differs from what was committed."""


def digest(plan: DataFrame, upto: int) -> str:
    """Of the first rows of a plan: changes with any key and any place."""
    row = F.sha2(F.concat_ws(":", c("no").cast("string"), c("key").cast("string")), 256)
    part = lambda at: F.bit_xor(F.conv(F.substring(row, at, 15), 16, 10).cast("long"))
    got = plan.where(c("no") < upto).agg(F.count("*").alias("n"), *(part(1 + 15 * i).alias(f"p{i}") for i in range(4))).first()
    return ":".join("0" if v is None else f"{v:x}" for v in got)


class Cover:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *names)))

    def committed(self) -> list[dict]:
        """Documents of all turns, in order."""
        if not self._fs.exists(self._at("turns")):
            return []
        rows = self.spark.read.text(f"{self.path}/turns/*.json", wholetext=True).collect()
        return sorted((json.loads(r.value) for r in rows), key=lambda d: d["turn"])

    def _data(self, kind: str, turns: list[dict]) -> DataFrame | None:
        """What committed turns wrote; leftovers of turns that stopped are not read."""
        paths = [f"{self.path}/{kind}/{d['turn']}-{d['try']}" for d in turns if d[kind]]
        return self.spark.read.parquet(*paths) if paths else None

    def result(self) -> DataFrame | None:
        return self._data("rows", self.committed())

    def open_keys(self) -> DataFrame | None:
        """Keys taken by earlier turns whose input was not there; the last turn knows all."""
        turns = self.committed()
        return self._data("open", turns[-1:])

    def turn(self, plan: DataFrame, inputs: DataFrame, work: Callable[[DataFrame], DataFrame], many: int) -> bool:
        """One turn over the next ``many`` keys; whether there was anything to do.

        inputs: key and what work needs; work gets the rows of the keys at hand and must
        make the same rows of a key in whichever turn it comes."""
        turns = self.committed()
        at = turns[-1]["upto"] if turns else 0
        if turns and digest(plan, at) != turns[-1]["digest"]:
            raise PlanChanged(f"the first {at} keys of the plan are not those that were worked off")
        fresh = plan.where((c("no") >= at) & (c("no") < at + many)).select("no", "key")
        left = self._data("open", turns[-1:])
        wanted = fresh if left is None else fresh.unionByName(left)
        taken = fresh.count()
        if not taken and left is None:
            return False
        number = turns[-1]["turn"] + 1 if turns else 0
        again = 0
        while self._fs.exists(self._at("rows", f"{number}-{again}")) or self._fs.exists(self._at("open", f"{number}-{again}")):
            again += 1  # a turn that stopped before it was committed
        there = inputs.join(wanted, "key")
        made = work(there)
        made.write.parquet(f"{self.path}/rows/{number}-{again}")
        missing = wanted.join(inputs.select("key").distinct(), "key", "left_anti").select("no", "key")
        missing.write.parquet(f"{self.path}/open/{number}-{again}")
        still = not self.spark.read.parquet(f"{self.path}/open/{number}-{again}").isEmpty()
        document = {"turn": number, "try": again, "upto": at + taken, "digest": digest(plan, at + taken), "rows": True, "open": still}
        part = self._at("turns", f".{number}.part")
        stream = self._fs.create(part, True)
        stream.write(bytearray(json.dumps(document).encode()))
        stream.close()
        if not self._fs.rename(part, self._at("turns", f"{number}.json")):
            raise RuntimeError(f"turn {number} was committed by another run")
        return True
