"""Mutual information of features with a class from nearest neighbours, over all rows.

For each row the distance to its k-th neighbour of the same class is found, and the rows of any
class nearer than that are counted.  With digamma function ψ, N rows, n_c rows of the row's class, k class rows and m rows
inside its radius, the information is ψ(N) + mean ψ(k) - mean ψ(n_c) - mean ψ(m), at least 0.

A radius holds the rows strictly nearer than the k-th neighbour, the row itself included, so without ties it
holds exactly k of the class.  Where k others share the row's value the radius is that value alone: all rows there count,
of the class and of all.  No noise is added to break ties, so reruns agree.

Equal values of a feature and class are one counted row from the start.  A feature's values are cut into range cells
of about ``CELL_ROWS`` values.  Neighbours are found within a cell, to which the k nearest values on either side
are lent; counts inside a radius are differences of two ranks, each a running sum inside its cell plus the
total of the cells before it.  No task holds a column.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.functions.scalars import lenient_double
from flowsieve.operators.joins import broadcast_if_small
from flowsieve.session import cut_lineage

NEIGHBOURS = 3
# Distinct values of a feature in a cell, and cells of a feature at most.
CELL_ROWS = 200_000
MAX_CELLS = 4_096
# Below 10 the digamma function is carried up by its recurrence; from there on the series is exact to 12 digits.
_SHIFT = 10


def digamma(n: Column) -> Column:
    """ψ of a positive whole number."""
    y = n.cast("double") + _SHIFT
    series = F.log(y) - 1 / (2 * y) - 1 / (12 * y**2) + 1 / (120 * y**4) - 1 / (252 * y**6) + 1 / (240 * y**8)
    for i in range(_SHIFT):
        series = series - 1 / (n.cast("double") + i)
    return series


def value_counts(df: DataFrame, features: Sequence[str], label: str, k: int = NEIGHBOURS) -> DataFrame:
    """``feature, label, v, n, class_rows, need``: distinct values with their counts.

    Unreadable and non-finite values are 0.  Rows without a class and classes of one row are left out.  ``need`` is how many
    neighbours of its class a row looks for beyond those that share its value.
    """
    values = F.array(*[F.struct(F.lit(f).alias("feature"), (lenient_double(f) + F.lit(0.0)).alias("v")) for f in features])
    known = df.where(F.col(label).isNotNull())
    long = known.select(F.col(label).alias("label"), F.explode(values).alias("x")).select("label", "x.*")
    counts = cut_lineage(long.groupBy("feature", "label", "v").agg(F.count(F.lit(1)).alias("n")), "value-counts")
    # Every row has one value of the first feature, so the table itself is read once.
    classes = counts.where(F.col("feature") == features[0]).groupBy("label").agg(F.sum("n").alias("class_rows")).where("class_rows > 1")
    found = counts.join(broadcast_if_small(classes), "label")
    return found.withColumn("need", F.least(F.lit(k), F.col("class_rows") - 1) - (F.col("n") - 1))


def cell_edges(points: DataFrame, rows: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``feature, edges``: about equally many of ``points(feature, v)`` lie between two edges."""
    cells = max(1, min(MAX_CELLS, math.ceil(rows / cell_rows)))
    if cells == 1:
        edges = F.array().cast("array<double>")
        return points.select("feature").distinct().select("feature", edges.alias("edges"))
    shares = F.array(*[F.lit(i / cells) for i in range(1, cells)])
    return points.groupBy("feature").agg(F.array_sort(F.array_distinct(F.percentile_approx("v", shares, 20 * cells))).alias("edges"))


def cell_of(x: Column, edges: Column) -> Column:
    """How many edges lie below ``x``, by halving: steps of falling powers of two, each taken if the edge it leads to lies below."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(MAX_CELLS.bit_length()))])
    found = F.aggregate(steps, F.lit(0), lambda n, step: n + F.when(F.get(edges, n + step - 1) < x, step).otherwise(0))
    return F.when(F.size(edges) == 0, 0).otherwise(found)


def _with_halo(placed: DataFrame, k: int) -> DataFrame:
    """``placed`` and, as rows that are not ``own``, the ``k`` nearest values on either side of each cell."""
    inside = Window.partitionBy("feature", "label", "cell")
    first = F.row_number().over(inside.orderBy("v"))
    last = F.row_number().over(inside.orderBy(F.col("v").desc()))
    pair = F.struct("v", "n")
    ends = (
        placed.withColumns({"first": first, "last": last})
        .where((F.col("first") <= k) | (F.col("last") <= k))
        .groupBy("feature", "label", "cell")
        # At most k values each.
        .agg(F.array_sort(F.collect_list(F.when(F.col("first") <= k, pair))).alias("head"), F.array_sort(F.collect_list(F.when(F.col("last") <= k, pair))).alias("tail"))
    )
    across = Window.partitionBy("feature", "label").orderBy("cell")
    sides = {"before": F.flatten(F.collect_list("tail").over(across.rowsBetween(-k, -1))), "after": F.flatten(F.collect_list("head").over(across.rowsBetween(1, k)))}
    nearest = F.concat(F.slice("before", F.greatest(F.size("before") - k + 1, F.lit(1)), F.lit(k)), F.slice("after", 1, k))
    lent = ends.withColumns(sides).select("feature", "label", "cell", F.explode(nearest).alias("x")).select("feature", "label", "cell", "x.*")
    nothing = F.lit(None).cast("bigint")
    lent = lent.select("feature", "label", "v", "n", nothing.alias("class_rows"), nothing.alias("need"), "cell", F.lit(False).alias("own"))
    return placed.withColumn("own", F.lit(True)).unionByName(lent)


def neighbour_radii(placed: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """For each row of ``placed``: ``low``, ``high`` (the open ends of its radius, its value if ``alone``) and the class rows ``inside``."""
    order = Window.partitionBy("feature", "label", "cell").orderBy("v")
    pair = F.struct("v", "n")
    sides = [f(pair, i).over(order) for i in range(1, k + 1) for f in (F.lag, F.lead)]
    entries = F.array(*[F.struct(F.abs(s["v"] - F.col("v")).alias("d"), s["n"].alias("n"), s["v"].alias("v")) for s in sides])
    near = _with_halo(placed, k).withColumn("near", F.array_sort(F.filter(entries, lambda e: e["d"].isNotNull()))).where("own")
    start = F.struct(F.lit(0).cast("bigint").alias("got"), F.lit(None).cast("double").alias("d"))

    def further(found: Column, e: Column) -> Column:
        got = found["got"] + e["n"]
        return F.struct(got.alias("got"), F.coalesce(found["d"], F.when(got >= F.col("need"), e["d"])).alias("d"))

    radius = F.when(F.col("need") > 0, F.aggregate("near", start, further)["d"])
    found = near.withColumn("r", radius).withColumn("alone", F.col("need") <= 0)
    nearer = F.aggregate(F.filter("near", lambda e: e["d"] < F.col("r")), F.lit(0).cast("bigint"), lambda n, e: n + e["n"])

    def end(side: int) -> Column:
        # Where the neighbour itself is the end it is taken as it is, not as a rounded sum.
        there = F.filter("near", lambda e: (e["d"] == F.col("r")) & ((e["v"] > F.col("v")) if side > 0 else (e["v"] < F.col("v"))))
        return F.when(F.col("alone"), F.col("v")).otherwise(F.coalesce(F.get(there, F.lit(0))["v"], F.col("v") + side * F.col("r")))

    inside = F.col("n") + F.when(F.col("alone"), 0).otherwise(nearer)
    return found.select("feature", "label", "v", "n", "class_rows", "alone", end(-1).alias("low"), end(1).alias("high"), inside.alias("inside"))


def rows_inside(radii: DataFrame, points: DataFrame, edges: DataFrame) -> DataFrame:
    """``radii`` with ``m``, the number of ``points(feature, v, n)`` inside each radius."""
    # At one place: ends that look below it, then points, then ends that look up to it.
    below, at, upto = 0, 1, 2
    ends = F.array(
        F.struct(F.col("low").alias("x"), F.when(F.col("alone"), below).otherwise(upto).alias("turn"), F.lit(-1).alias("sign")),
        F.struct(F.col("high").alias("x"), F.when(F.col("alone"), upto).otherwise(below).alias("turn"), F.lit(1).alias("sign")),
    )
    asked = radii.select("feature", F.explode(ends).alias("e"), F.struct("label", "v", "n", "class_rows", "inside").alias("row"))
    asked = asked.select("feature", "e.x", "e.turn", "e.sign", F.lit(0).cast("bigint").alias("n"), "row")
    given = points.select("feature", F.col("v").alias("x"), F.lit(at).alias("turn"), F.lit(0).alias("sign"), "n", F.lit(None).cast(asked.schema["row"].dataType).alias("row"))
    placed = lambda rows: rows.join(edges, "feature").withColumn("cell", cell_of(F.col("x"), F.col("edges"))).drop("edges")
    spread = placed(given.unionByName(asked))
    totals = placed(given).groupBy("feature", "cell").agg(F.sum("n").alias("n"))
    # The cells follow from the edges, so that the radii are found once.
    cells = edges.select("feature", F.explode(F.sequence(F.lit(0), F.size("edges"))).alias("cell"))
    totals = cells.join(totals, ["feature", "cell"], "left")
    earlier = Window.partitionBy("feature").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("feature", "cell", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    running = Window.partitionBy("feature", "cell").orderBy("x", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = spread.withColumn("rank", F.sum("n").over(running)).where(F.col("sign") != 0).join(base, ["feature", "cell"])
    return ranked.groupBy("feature", "row").agg(F.sum(F.col("sign") * (F.col("rank") + F.col("base"))).alias("m")).select("feature", "row.*", "m")


def neighbour_information(df: DataFrame, features: Sequence[str], label: str, k: int = NEIGHBOURS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``feature, score``: mutual information in nats of each feature with the class, highest first."""
    counts = value_counts(df, features, label, k)
    points = counts.groupBy("feature", "v").agg(F.sum("n").alias("n"))
    most = points.groupBy("feature").agg(F.count(F.lit(1)).alias("values")).agg(F.max("values")).first()[0] or 0
    # A row per feature.
    edges = broadcast_if_small(cell_edges(points, most, cell_rows))
    placed = counts.join(edges, "feature").withColumn("cell", cell_of(F.col("v"), F.col("edges"))).drop("edges")
    found = rows_inside(neighbour_radii(placed, k), points, edges)
    weight = F.col("n").cast("double")
    mean = lambda c: F.sum(weight * digamma(F.col(c))) / F.sum(weight)
    score = digamma(F.sum("n")) + mean("inside") - mean("class_rows") - mean("m")
    scored = found.groupBy("feature").agg(F.greatest(score, F.lit(0.0)).alias("score"))
    return scored.orderBy(F.col("score").desc(), "feature")
