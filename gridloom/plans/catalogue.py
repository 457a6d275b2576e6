"""All registered queries: name -> callable(spark, sf_dir), and their SQL twins."""

from __future__ import annotations

from gridloom.plans import bands, commands, core, gauges, kernel_sql, kernels, volumes  # noqa: F401  (they register themselves)
from gridloom.plans import rules  # noqa: F401, I001  (after the texts that it is held against)
from gridloom.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
