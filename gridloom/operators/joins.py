"""Range, radius, nearest and interpolating joins as equi joins on buckets.

A bare range condition plans as a nested loop; exploding the smaller side into the buckets
that it touches turns it into a hash or sort-merge join, whose skewed buckets Spark splits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: A relation of so many rows of a few numbers may be broadcast.
KNOTS = 10_000
#: Rows that a row should meet in the first ring of a search.
SEEN = 64


def bucket(c: Column, width: float) -> Column:
    return F.floor(c / width).cast("long")


def interval_join(points: DataFrame, spans: DataFrame, at: str, low: str, high: str, width: float, same: dict[str, str] | None = None) -> DataFrame:
    """Points with the spans [low, high) that hold them, within equal keys: point column ->
    span column."""
    reach = spans.withColumn("__b", F.explode(F.sequence(bucket(F.col(low), width), bucket(F.col(high), width))))
    keyed = points.withColumn("__b", bucket(F.col(at), width))
    for k, (mine, theirs) in enumerate((same or {}).items()):
        keyed, reach = keyed.withColumn(f"__k{k}", F.col(mine)), reach.withColumn(f"__k{k}", F.col(theirs))
    keys = ["__b", *(f"__k{k}" for k in range(len(same or {})))]
    return keyed.join(reach, keys).where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop(*keys)


def box_join(points: DataFrame, boxes: DataFrame, axes: dict[str, tuple[str, str]], widths: dict[str, float]) -> DataFrame:
    """Points with the half-open boxes that hold them; axes: point column -> (low, high)."""
    keys, reach, keyed = [], boxes, points
    for k, (axis, (low, high)) in enumerate(axes.items()):
        name = f"__b{k}"
        keys.append(name)
        reach = reach.withColumn(name, F.explode(F.sequence(bucket(F.col(low), widths[axis]), bucket(F.col(high), widths[axis]))))
        keyed = keyed.withColumn(name, bucket(F.col(axis), widths[axis]))
    inside = None
    for axis, (low, high) in axes.items():
        c = (F.col(axis) >= F.col(low)) & (F.col(axis) < F.col(high))
        inside = c if inside is None else inside & c
    return keyed.join(reach, keys).where(inside).drop(*keys)


def radius_pairs(a: DataFrame, b: DataFrame, axes: list[str], radius: float, suffixes: tuple[str, str] = ("_a", "_b")) -> DataFrame:
    """All pairs within the radius, with d2; the second side goes to its 3**n cells."""
    x, y = (d.select(*(F.col(c).alias(c + s) for c in d.columns)) for d, s in zip((a, b), suffixes, strict=True))
    keys = []
    for k, axis in enumerate(axes):
        name = f"__c{k}"
        keys.append(name)
        x = x.withColumn(name, bucket(F.col(axis + suffixes[0]), radius))
        home = bucket(F.col(axis + suffixes[1]), radius)
        y = y.withColumn(name, F.explode(F.array(home - 1, home, home + 1)))
    d2 = sum((F.pow(F.col(c + suffixes[0]) - F.col(c + suffixes[1]), 2) for c in axes), F.lit(0.0))
    return x.join(y, keys).drop(*keys).withColumn("d2", d2).where(F.col("d2") <= radius * radius)


def first_ring(b: DataFrame, axes: list[str], radius: float, most: float = SEEN) -> float:
    """radius, halved until a row of b sees about ``most`` others in the cells around it, were
    they spread evenly within cells of the radius."""
    sizes = b.groupBy(*(bucket(F.col(c), radius).alias(c) for c in axes)).agg(F.count("*").cast("double").alias("n"))
    seen = (sizes.agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("n")).first()["n"] or 0.0) * 3 ** len(axes)
    halvings = 0
    while seen > most and halvings < 30:
        seen, halvings = seen / 2 ** len(axes), halvings + 1
    return radius / 2**halvings


def nearest(a: DataFrame, b: DataFrame, axes: list[str], id_a: str, id_b: str, radius: float | None = None, start: float = 1.0, rank: Callable[[Column, Column], Column] | None = None, slack: float = 0.0) -> DataFrame:
    """For every row of a its nearest row of b, ties to the smaller id: exact, since a row
    within the radius lies in a neighbouring cell.

    Rings widen: rows that found nothing within ``start`` ask again within twice as much,
    until all have an answer (or b is empty).  With a radius, the first ring is chosen by how
    densely b lies, and rows without a neighbour within the radius are left out.  A ``rank``
    of d2 and id takes the place of (d2, id); it must prefer no row whose d2 is larger by more
    than ``slack``.  d2 is then still the least one."""
    from gridloom.operators.graph import checkpoint

    def within(left: DataFrame, reach: float) -> DataFrame:
        pairs, other = radius_pairs(left, b, axes, reach), F.col(f"{id_b}_b")
        first = F.min(F.struct("d2", f"{id_b}_b")) if rank is None else F.min(F.struct(rank(F.col("d2"), other).alias("__r"), f"{id_b}_b"))
        best = pairs.groupBy(f"{id_a}_a").agg(first.alias("best"), F.min("d2").alias("d2"))
        return best.select(F.col(f"{id_a}_a").alias(id_a), F.col(f"best.{id_b}_b").alias(id_b), "d2")

    left, found = a.select(id_a, *axes), None
    if radius is not None:
        reach, widest = first_ring(b, axes, radius), radius
    else:
        far = lambda df: df.agg(*(f(c).alias(f"{f.__name__}_{c}") for c in axes for f in (F.min, F.max))).first()
        reach, ends_a, ends_b = start, far(a), far(b)
        if ends_a[0] is None or ends_b[0] is None:
            return within(left, start).limit(0)
        widest = sum(max(abs(ends_a[f"max_{c}"] - ends_b[f"min_{c}"]), abs(ends_b[f"max_{c}"] - ends_a[f"min_{c}"])) ** 2 for c in axes) ** 0.5
    while True:
        got = within(left, reach)
        if radius is not None and reach >= radius:
            return got if found is None else found.unionByName(got)
        got = checkpoint(got.where(F.col("d2") + slack <= reach * reach))
        found = got if found is None else found.unionByName(got)
        if radius is None and reach > widest + slack:
            return found
        left = checkpoint(left.join(got.select(id_a), id_a, "left_anti"))
        if not left.limit(1).count():
            return found
        reach *= 2


def lerp_on(points: DataFrame, knots: DataFrame, at: str, knot: str, values: list[str], width: float) -> DataFrame:
    """Values interpolated between sorted knots, clamped beyond both ends.

    Up to ``KNOTS`` knots (a control polyline) are broadcast; more are joined by bucket."""
    order = Window.orderBy(knot)
    ends = knots.select(F.col(knot).cast("double").alias("k0"), *values).withColumns({"k1": F.lead(F.col("k0")).over(order.orderBy("k0")), "before": F.lag("k0").over(order.orderBy("k0"))} | {f"{v}_1": F.lead(v).over(order.orderBy("k0")) for v in values})
    if knots.limit(KNOTS + 1).count() <= KNOTS:
        low = F.when(F.col("before").isNull(), F.lit(float("-inf"))).otherwise(F.col("k0"))
        spans = ends.withColumn("lo", low).withColumn("hi", F.coalesce("k1", F.lit(float("inf"))))
        got = points.join(F.broadcast(spans), (F.col(at) >= F.col("lo")) & (F.col(at) < F.col("hi")))
    else:
        reach = points.agg(F.min(at).alias("__lo"), F.max(at).alias("__hi")).first()
        low = F.when(F.col("before").isNull(), F.least("k0", F.lit(reach["__lo"]).cast("double"))).otherwise(F.col("k0"))
        spans = ends.withColumn("lo", low).withColumn("hi", F.coalesce("k1", F.greatest("k0", F.lit(reach["__hi"]).cast("double")) + 1))
        got = interval_join(points, spans, at, "lo", "hi", width)
    t = F.greatest(F.lit(0.0), (F.col(at) - F.col("k0")) / (F.col("k1") - F.col("k0")))
    return got.select(*points.columns, *(F.when(F.col("k1").isNull(), F.col(v)).otherwise(F.col(v) + t * (F.col(f"{v}_1") - F.col(v))).alias(v) for v in values))


def without(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Held-out, finished or covered rows removed."""
    return df.join(gone.select(*keys).distinct(), keys, "left_anti")


def closest_on_line(points: DataFrame, knots: DataFrame, same: list[str], at: str, near: str, width: float) -> DataFrame:
    """points with ``near`` and ``apart``: the knot of equal keys whose value is closest, ties
    to the smaller ``near``; points without any knot of their keys, or without a value, are
    left out.

    Points and knots are put in order together, one sort instead of a join of all with all.
    Lines are cut at multiples of ``width``; a piece takes the closest knots outside of it
    from the ends of the other pieces (one row a piece)."""
    knot = F.struct(F.col(at).alias("v"), F.col(near).alias("near"))
    single = knots.where(F.col(at).isNotNull()).groupBy(*same, at).agg(F.min(near).alias(near)).select(*same, F.col(at).alias("__at"), knot.alias("__knot"), F.lit(False).alias("__point"))
    rows = points.where(F.col(at).isNotNull()).select(*same, F.col(at).alias("__at"), F.struct(*points.columns).alias("__row"), F.lit(True).alias("__point"))
    both = rows.unionByName(single, allowMissingColumns=True).withColumn("__piece", bucket(F.col("__at"), width))
    inside = Window.partitionBy(*same, "__piece")
    below = F.last("__knot", True).over(inside.orderBy("__at", "__point"))
    above = F.last("__knot", True).over(inside.orderBy(F.desc("__at"), "__point"))
    ends = both.groupBy(*same, "__piece").agg(F.min("__knot").alias("low"), F.max("__knot").alias("high"))
    line = Window.partitionBy(*same).orderBy("__piece")
    before = F.last("high", True).over(line.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("low", True).over(line.rowsBetween(1, Window.unboundedFollowing))
    ends = ends.select(*same, "__piece", before.alias("__before"), after.alias("__after"))
    got = both.withColumns({"__below": below, "__above": above}).where("__point").join(ends, [*same, "__piece"])
    to = lambda k: F.when(k.isNotNull(), F.struct(F.abs(k["v"] - F.col("__at")).alias("apart"), k["near"].alias("near")))
    best = F.array_min(F.array_compact(F.array(to(F.coalesce("__below", "__before")), to(F.coalesce("__above", "__after")))))
    return got.withColumn("__best", best).where(F.col("__best").isNotNull()).select(*(F.col(f"__row.{c}").alias(c) for c in points.columns), F.col("__best.near").alias(near), F.col("__best.apart").alias("apart"))
