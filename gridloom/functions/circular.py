"""Arithmetic on cyclic codes and turns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.model import PERIOD


def code_diff(a: Column, b: Column, period: int = PERIOD) -> Column:
    """Signed difference a - b on the circle, in [-period/2, period/2)."""
    half = period // 2
    return F.pmod(a - b + half, F.lit(period)) - half


def wrap_turn(d: Column) -> Column:
    """A difference in turns brought to (-1/2, 1/2]."""
    return d - F.rint(d)


def phasor(code: Column, period: int = PERIOD) -> tuple[Column, Column]:
    angle = code * (2 * 3.141592653589793 / period)
    return F.cos(angle), F.sin(angle)


def code_of(cos: Column, sin: Column, period: int = PERIOD) -> Column:
    """The code nearest to a direction; halves go away from zero."""
    turn = F.atan2(sin, cos) * (period / (2 * 3.141592653589793))
    return F.pmod(F.round(turn).cast("int"), F.lit(period))


def mean_code(code: Column, least: float = 0.5, period: int = PERIOD) -> Column:
    """Circular mean of a group; null if the resultant is below ``least`` of the count."""
    c, s = (F.sum(x) for x in phasor(code, period))
    return F.when(F.hypot(c, s) >= least * F.count(code), code_of(c, s, period))


def weighted_phasor(code: Column, weight: Column, period: int = PERIOD) -> tuple[Column, Column]:
    """Direction code and confidence of the weighted complex mean of a group."""
    c, s = phasor(code, period)
    total = F.sum(F.when(code.isNotNull(), weight))
    c, s = F.sum(c * weight), F.sum(s * weight)
    return code_of(c, s, period), F.hypot(c, s) / total


def wider(codes: Column, tol: int, period: int = PERIOD) -> Column:
    """Whether any two codes of a short array lie more than tol apart on the circle."""
    return F.exists(codes, lambda a: F.exists(codes, lambda b: F.abs(code_diff(a, b, period)).cast("int") > tol))


def all_of(*parts: Column) -> Column:
    return reduce(lambda a, b: a & b, parts)
