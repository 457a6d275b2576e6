"""Labels between nested sheets: from the codes of sheet cells to the turn that every cell
lies in, its side of the nearest sheet and its place between two sheets.

Codes run from 1 to 252 (a step is 1/18 turn, 14 turns a period); 0 is no sheet, 255 cells in
which sheets disagree.  Cells that are not listed take no part."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.grid import nearest_features
from gridloom.operators.scratch import Scratch

# Fixed values of the label format.
STEPS, PERIOD, HALF, UNKNOWN, CONFLICT = 18, 252, 9, 255, 255
VERSO, RECTO = 0, 1
AXES = ("z", "y", "x")


def labelled() -> Column:
    return (F.col("code") > 0) & (F.col("code") < CONFLICT)


def band_diff(a: Column, b: Column) -> Column:
    """Difference of two turns in (-126, 126]."""
    d = F.pmod(a - b, F.lit(PERIOD))
    return F.when(d > PERIOD // 2, d - PERIOD).otherwise(d)


def band_winding(band: Column, phase: Column) -> Column:
    """Turn of a cell in steps, from its band and its place between two sheets."""
    turn = F.pmod(band - HALF + F.floor((phase * STEPS + PERIOD // 2) / PERIOD), F.lit(PERIOD))
    return F.when((band == UNKNOWN) | (phase == UNKNOWN), F.lit(UNKNOWN)).otherwise(turn).cast("int")


def band(cells: DataFrame, axis: DataFrame, radius: float, span: float, native: int = 2, side: int = 64, scratch: Scratch | None = None) -> DataFrame:
    """z, y, x, band, side of cells (z, y, x, code); axis (z, cy, cx): the centre of each
    plane in native units, ``native`` to a cell.

    The band is the code of the nearest sheet cell within ``radius`` plus or minus half a
    turn, by which of the two is farther from the axis.  Unknown (255) are cells beyond the
    radius, around conflicts, and within ``span`` of places where the band of neighbours
    off the sheets jumps by half a turn or more.  Radius and span are native units."""
    scratch = scratch or Scratch(cells.sparkSession)
    reach2, centre = (radius / native) ** 2, (native - 1) / 2
    near = nearest_features(cells, {"near": labelled()}, side, -int(-radius // native), AXES, ("code",))
    plane = lambda z, n: axis.select(F.col("z").alias(z), F.col("cy").alias(f"cy_{n}"), F.col("cx").alias(f"cx_{n}"))
    far = lambda y, x, n: F.pow(F.col(y) * native + centre - F.col(f"cy_{n}"), 2) + F.pow(F.col(x) * native + centre - F.col(f"cx_{n}"), 2)
    both = near.join(plane("z", "own"), "z", "left").join(plane("near_z", "near"), "near_z", "left")
    out = far("y", "x", "own") >= far("near_y", "near_x", "near")
    known = (F.col("near_d2") <= reach2) & out.isNotNull()
    turn = F.pmod(F.col("near_code") - 1 + F.when(out, HALF).otherwise(-HALF), F.lit(PERIOD))
    first = both.select(*AXES, "near_d2", F.when(known, turn).alias("band"), F.when(known, F.when(out, RECTO).otherwise(VERSO)).alias("side"))
    around = F.explode(F.array(*(F.struct(*(F.lit(d).alias(a) for a, d in zip(AXES, o, strict=True))) for o in product((-1, 0, 1), repeat=3)))).alias("o")
    shut = cells.where(F.col("code") == CONFLICT).select(*AXES, around).select(*((F.col(a) + F.col(f"o.{a}")).alias(a) for a in AXES)).distinct().withColumn("__shut", F.lit(True))
    first = first.join(shut, list(AXES), "left")
    found = scratch.save(first.withColumns({k: F.when(F.col("__shut").isNull(), F.col(k)) for k in ("band", "side")}).drop("__shut"))

    off = found.where((F.col("near_d2") > 1) & F.col("band").isNotNull()).select(*AXES, "band")
    jumps = None
    for a in AXES:
        ahead = off.select(*((F.col(k) - 1).alias(k) if k == a else F.col(k) for k in AXES), F.col("band").alias("__next"))
        met = off.join(ahead, list(AXES)).where(F.abs(band_diff(F.col("band"), F.col("__next"))) >= HALF)
        ends = met.select(F.explode(F.array(F.struct(*AXES), F.struct(*((F.col(k) + 1).alias(k) if k == a else F.col(k) for k in AXES)))).alias("s")).select("s.*")
        jumps = ends if jumps is None else jumps.unionByName(ends)
    jumps = jumps.distinct().withColumn("__jump", F.lit(True))
    marked = found.join(jumps, list(AXES), "left")
    gap = nearest_features(marked.select(*AXES, "__jump"), {"gap": F.col("__jump")}, side, -int(-span // native), AXES)
    cut = gap.where(F.col("gap_d2") <= (span / native) ** 2).select(*AXES, F.lit(True).alias("__cut"))
    value = lambda k: F.when(F.col("__cut").isNull() & F.col(k).isNotNull(), F.col(k)).otherwise(UNKNOWN).cast("int").alias(k)
    return found.join(cut, list(AXES), "left").select(*AXES, value("band"), value("side"))


def phase_pair(cells: DataFrame, reach: int, side: int = 64) -> DataFrame:
    """z, y, x, phase, spacing of cells (z, y, x, code), without an axis: the share of the
    way from the nearest sheet of one turn to the nearest sheet of the next, in 252 steps;
    0 on a sheet.  Unknown (255, spacing 0) where either is farther than ``reach``, the turns
    do not follow each other, or both sheets lie on one side (less than 120 degrees apart).

    Turns alternate in parity, so the two sheets are the nearest even and the nearest odd."""
    turn = F.floor((F.col("code") - 1) / STEPS)
    got = nearest_features(cells, {"even": labelled() & (turn % 2 == 0), "odd": labelled() & (turn % 2 == 1)}, side, reach, AXES, ("code",))
    k = lambda n: F.floor((F.col(f"{n}_code") - 1) / STEPS)
    up = F.pmod(k("odd") - k("even"), F.lit(PERIOD // STEPS))
    dot = sum(((F.col(f"even_{a}") - F.col(a)) * (F.col(f"odd_{a}") - F.col(a)) for a in AXES), F.lit(0))
    de, do = F.sqrt("even_d2"), F.sqrt("odd_d2")
    between = up.isin(1, PERIOD // STEPS - 1) & (dot <= -0.5 * de * do)
    share = F.when(up == 1, de).otherwise(do) / (de + do)
    on = F.coalesce(F.col("even_d2") == 0, F.lit(False)) | F.coalesce(F.col("odd_d2") == 0, F.lit(False))
    phase = F.when(on, 0).when(between, F.rint(share * PERIOD) % PERIOD).otherwise(UNKNOWN).cast("int")
    spacing = F.when(~on & between, F.least(F.greatest(F.rint(de + do), F.lit(1.0)), F.lit(255.0))).otherwise(0).cast("int")
    return got.select(*AXES, phase.alias("phase"), spacing.alias("spacing"))
