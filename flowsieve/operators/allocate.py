"""Exact prefix selection without sorting a whole group in one task.

``prefix_allocate`` answers "walk each group in a given order and hand out ``quota`` units".
It backs the conversion budget, the per-key cap, quota samples, exact stratified splits and
first-N caps.  The order is a list of bounded *levels* plus a final tie-break.  For each
level one aggregate counts weight per (group, level value); the running total over that
small table names the single level value per group where the quota runs out.  Rows before
it are taken, rows after it are not, and only rows inside it count at the next level.  The
limits of all levels are then attached together, and what lies inside all of them is ranked
with an ordinary window; the input is read once for the limits and twice for the result.  The result depends only on
row contents, so it is the same for any partitioning, and a smaller quota always selects a
subset of a larger one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.operators.joins import broadcast_if_small

# Edge tables (one row per group) above this size are shuffle-joined instead of broadcast.
MAX_BROADCAST_GROUPS = 10_000
# Groups whose limits are written into the plan as one CASE; more are joined.
MAX_LITERAL_GROUPS = 256
# An edge cell with no more rows than this is ranked directly; deeper levels are skipped.
DIRECT_RANK_ROWS = 200_000

# A level keeps its count table at 16,384 rows per group; two levels leave about one row in
# 270 million.
_HASH_LEVEL_BITS = 14


def hash_levels(hash60: Column) -> list[Column]:
    """Two nested prefixes of a 60-bit hash, one per level."""
    return [
        F.shiftright(hash60, 60 - _HASH_LEVEL_BITS),
        F.shiftright(hash60, 60 - 2 * _HASH_LEVEL_BITS).bitwiseAND(F.lit(2**_HASH_LEVEL_BITS - 1)),
    ]


def _attach(df: DataFrame, table: DataFrame, keys: list[str], rows: list | None) -> DataFrame:
    """Add the per-group columns of ``table``; rows of groups missing there get nulls.

    ``rows`` are the table's rows when it is small enough to be on the driver anyway.
    """
    if not keys:
        # A single global group: its one row becomes literals.
        row = rows[0] if rows else None
        return df.withColumns(
            {f.name: F.lit(row[f.name] if row else None).cast(f.dataType) for f in table.schema.fields}
        )
    right = table.select(*[F.col(k).alias(f"__e_{k}") for k in keys], *[c for c in table.columns if c not in keys])
    if rows is not None:
        right = F.broadcast(right)
    condition = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__e_{k}")) for k in keys])
    return df.join(right, condition, "left").drop(*[f"__e_{k}" for k in keys])


def prefix_allocate(
    df: DataFrame,
    *,
    group: Sequence[str] = (),
    quota: int | DataFrame,
    levels: Sequence[Column],
    tie: Sequence[Column],
    weight: Column | None = None,
    out: str = "alloc",
) -> DataFrame:
    """``df`` plus ``out``: how much of each row's weight the group's quota covers.

    ``quota`` is one number for every group, or a frame with the group columns and a
    ``quota`` column (groups missing there get nothing).  ``weight`` defaults to one per
    row and must be a non-negative whole number.  Level values must not be null.
    """
    spark = df.sparkSession
    group = list(group)
    names = [f"__l{i}" for i in range(len(levels))]
    base = df.select(
        "*",
        (F.lit(1) if weight is None else weight).cast("bigint").alias("__w"),
        *[level.alias(name) for level, name in zip(levels, names)],
    )
    if isinstance(quota, DataFrame):
        remaining = quota.select(*group, F.col("quota").cast("bigint").alias("quota"))
        collected = remaining.limit(1).collect() if not group else None
    else:
        remaining, collected = None, None

    # The limits are found on the narrow columns, which are read once.
    narrow = base.select(*group, "__w", *names).persist()
    candidates = narrow
    edges_by_level: list[tuple[DataFrame, list | None]] = []
    for name in names:
        counts = candidates.groupBy(*group, name).agg(F.sum("__w").alias("w"), F.count(F.lit(1)).alias("n"))
        running = Window.partitionBy(*group).orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("before", F.coalesce(F.sum("w").over(running), F.lit(0)))
        if remaining is None:
            counts = counts.withColumn("quota", F.lit(int(quota)).cast("bigint"))
        else:
            counts = _attach(counts, remaining.select(*group, "quota"), group, collected)
            counts = counts.withColumn("quota", F.coalesce("quota", F.lit(0).cast("bigint")))
        edges = (
            counts.where(F.col("before") + F.col("w") > F.col("quota"))
            .groupBy(*group)
            .agg(
                F.min(F.struct(name, "n", (F.col("quota") - F.col("before")).alias("left"))).alias("e"),
            )
            .select(
                *group,
                F.col(f"e.{name}").alias(f"__at{name}"),
                F.greatest(F.col("e.left"), F.lit(0)).cast("bigint").alias("quota"),
                F.col("e.n").alias("__edge_rows"),
            )
        )
        # One small row per group; the limit bounds what reaches the driver.
        collected = edges.limit(MAX_BROADCAST_GROUPS + 1).collect()
        if len(collected) <= MAX_BROADCAST_GROUPS:
            edges = spark.createDataFrame(collected, edges.schema)
        else:
            # Kept with the session: the levels below and the result build on it.
            edges, collected = edges.persist(), None
        remaining = edges.select(*group, "quota")
        edges_by_level.append((edges.select(*group, f"__at{name}"), collected))
        if collected is not None and all((row["__edge_rows"] or 0) <= DIRECT_RANK_ROWS for row in collected):
            break
        joined = _attach(candidates, edges.select(*group, f"__at{name}"), group, collected)
        candidates = joined.where(F.col(name) == F.col(f"__at{name}")).drop(f"__at{name}")
    if all(found is not None for _, found in edges_by_level):
        narrow.unpersist()

    # One look at each row: before the limit of some level, past it, or still inside after all of them.
    rows = base
    given = F.lit(None).cast("bigint")
    for (edges, found), name in reversed(list(zip(edges_by_level, names))):
        rows = _attach(rows, edges, group, found)
        at = F.col(f"__at{name}")
        given = (
            F.when(at.isNull() | (F.col(name) < at), F.col("__w")).when(F.col(name) > at, F.lit(0).cast("bigint")).otherwise(given)
        )
    rows = rows.withColumn(out, given).drop(*[f"__at{name}" for name in names])
    order = Window.partitionBy(*group).orderBy(*names, *tie).rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.where(F.col(out).isNull())
    if remaining is None:
        inside = inside.withColumn("quota", F.lit(int(quota)).cast("bigint"))
    else:
        inside = _attach(inside, remaining, group, collected)
    before = F.coalesce(F.sum("__w").over(order), F.lit(0))
    inside = inside.withColumn(
        out,
        F.greatest(F.lit(0), F.least(F.col("__w"), F.coalesce("quota", F.lit(0)) - before)).cast("bigint"),
    ).drop("quota")
    return rows.where(F.col(out).isNotNull()).unionByName(inside).drop("__w", *names)


def take_prefix(df: DataFrame, **kwargs) -> DataFrame:
    """Rows whose group quota covers them, for weight-one selections."""
    return prefix_allocate(df, out="__taken", **kwargs).where(F.col("__taken") > 0).drop("__taken")


def rank_in_group(df: DataFrame, *, group: Sequence[str], hash60: Column, tie: Sequence[Column], out: str) -> DataFrame:
    """Exact 0-based rank of every row in its group by (hash, tie).

    Rows are cut into hash cells of about 50,000 rows (65,536 cells at most); the count
    table gives each cell its offset, and the window runs inside one cell.  Groups are
    meant to be few, such as class labels.
    """
    group = list(group)
    bits = min(16, max(0, (df.count() // _RANK_CELL_ROWS).bit_length()))
    base = df.withColumn("__h", hash60).withColumn("__cell", F.shiftright(F.col("__h"), 60 - bits))
    counts = base.groupBy(*group, "__cell").agg(F.count(F.lit(1)).alias("n"))
    running = Window.partitionBy(*group).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *group, "__cell", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("__offset")
    )
    inside = Window.partitionBy(*group, "__cell").orderBy("__h", *tie)
    return (
        base.join(broadcast_if_small(offsets), [*group, "__cell"])
        .withColumn(out, (F.col("__offset") + F.row_number().over(inside) - 1).cast("bigint"))
        .drop("__h", "__cell", "__offset")
    )


_RANK_CELL_ROWS = 50_000


def running_totals(df: DataFrame, *, order_by: str, sums: Sequence[str], cells: int = 512) -> DataFrame:
    """Cumulative sums over a whole table ordered by one numeric column, ascending.

    Input must be unique on ``order_by`` (pre-aggregate first).  Quantile cut points split
    the order into cells; per-cell totals become offsets and only the inside of a cell is
    sorted by one task.  Adds ``cum_<name>`` (inclusive) for each summed column.
    """
    from pyspark.ml.feature import Bucketizer

    # Three passes read it, and the result builds on it.
    df = df.persist()
    points = df.approxQuantile(order_by, [i / cells for i in range(1, cells)], 0.25 / cells)
    splits = [float("-inf"), *sorted(set(points)), float("inf")]
    if len(splits) < 3:
        splits = [float("-inf"), 0.0, float("inf")]
    cut = Bucketizer(splits=splits, inputCol=order_by, outputCol="__cell", handleInvalid="keep").transform(df)
    totals = cut.groupBy("__cell").agg(*[F.sum(c).alias(f"__t_{c}") for c in sums])
    # At most ``cells`` + 2 rows, by construction of the cut points.
    running = Window.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "__cell", *[F.coalesce(F.sum(f"__t_{c}").over(running), F.lit(0)).alias(f"__o_{c}") for c in sums]
    )
    inside = Window.partitionBy("__cell").orderBy(order_by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = cut.join(F.broadcast(offsets), "__cell")
    return joined.select(
        *df.columns, *[(F.col(f"__o_{c}") + F.sum(c).over(inside)).alias(f"cum_{c}") for c in sums]
    )


@dataclass(frozen=True)
class Limit:
    """Where a group's selection ends: everything before (``hash``, ``key``), and ``copies`` rows of that key.

    A missing ``hash`` selects the whole group; ``copies`` is None where all rows of the key are in.
    """

    hash: int | None = None
    key: object = None
    copies: int | None = 0


class Cutoffs:
    """Per-group selection limits: the ``quota`` first rows of each group by (hash, key).

    Membership is a row-local test against literals, so selecting needs no join, no sort and
    no second scan.  Only where a limit falls between rows that repeat one key are those few rows
    counted off, in the order of their contents.
    """

    def __init__(self, group: str | None, limits: dict[object, Limit]):
        self._group = group
        self._limits = limits

    def _by_group(self, value: Callable[[Limit], Column], default: Column) -> Column:
        out = default
        for name, limit in self._limits.items():
            out = value(limit) if self._group is None else F.when(F.col(self._group).eqNullSafe(F.lit(name)), value(limit)).otherwise(out)
        return out

    def flag(self, df: DataFrame, hash60: Column, key: Column, out: str) -> DataFrame:
        """``df`` plus ``out``: true for selected rows.  Exactly the quota of each group, or all its rows."""
        kind = df.select(key.alias("k")).schema["k"].dataType
        cut = self._by_group(lambda x: F.lit(2**62 if x.hash is None else x.hash), F.lit(-1).cast("bigint"))
        last = self._by_group(lambda x: F.lit(x.key).cast(kind), F.lit(None).cast(kind))
        copies = self._by_group(lambda x: F.lit(x.copies), F.lit(0))
        at_limit = (hash60 == cut) & key.eqNullSafe(last)
        before = (hash60 < cut) | ((hash60 == cut) & ((key.isNull() & last.isNotNull()) | F.coalesce(key < last, F.lit(False))))
        shared = any(limit.copies for limit in self._limits.values())
        if not shared:
            return df.withColumn(out, before | (at_limit & copies.isNull()))
        rest = df.where(~at_limit | copies.isNull()).withColumn(out, before | at_limit)
        own = [self._group] if self._group else []
        order = Window.partitionBy(*own).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
        edge = df.where(at_limit & copies.isNotNull()).withColumn("__n", F.row_number().over(order))
        return rest.unionByName(edge.withColumn(out, F.col("__n") <= copies).drop("__n"))


def quota_cutoffs(df: DataFrame, *, hash60: Column, key: Column, quota: int | dict, group: str | None = None) -> Cutoffs:
    """Find the limits that keep exactly ``quota`` rows (per group value, if grouped).

    One aggregate counts rows per hash cell; its running total names the cell where each
    quota ends.  While that cell is still large it is cut into cells again; then its keys are
    counted and added up in order.
    """
    keys = [group] if group else []
    base = df.select(*keys, hash60.alias("__h"), key.alias("__k"))
    running = Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    limits: dict[object, Limit] = {}
    # Per group value still open: (low end of its cell, rows wanted inside the cell).
    open_cells: dict | None = None
    shift = 60
    while True:
        shift -= _HASH_LEVEL_BITS
        inside, wanted = _open_rows(group, open_cells, quota, shift + _HASH_LEVEL_BITS)
        counts = base.where(inside).groupBy(*keys, F.shiftright("__h", shift).alias("__cell")).agg(F.count(F.lit(1)).alias("n"))
        edge = (
            counts.withColumn("before", F.coalesce(F.sum("n").over(running), F.lit(0)))
            .withColumn("quota", wanted)
            .groupBy(*keys)
            .agg(
                F.min(
                    F.when(
                        F.col("before") + F.col("n") > F.col("quota"),
                        F.struct("__cell", (F.col("quota") - F.col("before")).alias("left"), "n"),
                    )
                ).alias("e")
            )
        )
        rows = edge.limit(MAX_LITERAL_GROUPS + 1).collect()
        if len(rows) > MAX_LITERAL_GROUPS:
            raise TooManyGroups(f"more than {MAX_LITERAL_GROUPS} values of {group!r}")
        open_cells, largest = {}, 0
        for row in rows:
            value, e = row[group] if group else None, row["e"]
            if e is None:
                limits[value] = Limit()
            elif e["left"] <= 0:
                limits[value] = Limit(e["__cell"] << shift)
            else:
                open_cells[value] = (e["__cell"] << shift, e["left"])
                largest = max(largest, e["n"])
        if not open_cells:
            return Cutoffs(group, limits)
        if largest <= DIRECT_RANK_ROWS or shift <= _HASH_LEVEL_BITS:
            break
    inside, wanted = _open_rows(group, open_cells, quota, shift)
    order = Window.partitionBy(*keys).orderBy("__h", "__k").rowsBetween(Window.unboundedPreceding, -1)
    last = (
        base.where(inside)
        .groupBy(*keys, "__h", "__k")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("left", wanted - F.coalesce(F.sum("n").over(order), F.lit(0)))
        .where((F.col("left") > 0) & (F.col("left") <= F.col("n")))
        .collect()
    )
    for row in last:
        copies = None if row["left"] == row["n"] else row["left"]
        limits[row[group] if group else None] = Limit(row["__h"], row["__k"], copies)
    return Cutoffs(group, limits)


class TooManyGroups(ValueError):
    """A selection by literals is not for this many groups."""


def flag_quota(df: DataFrame, *, hash60: Column, key: Column, quota: int | dict, out: str, group: str | None = None) -> DataFrame:
    """``df`` plus ``out``: true for exactly ``quota`` rows (per group value), those with the smallest (hash, key).

    Up to ``MAX_LITERAL_GROUPS`` groups are tested against literals; more groups take the
    path in which each group's limit is a joined row.
    """
    try:
        return quota_cutoffs(df, hash60=hash60, key=key, quota=quota, group=group).flag(df, hash60, key, out)
    except TooManyGroups:
        quotas: int | DataFrame = quota
        if isinstance(quota, dict):
            kind = df.schema[group].dataType.simpleString()
            quotas = df.sparkSession.createDataFrame(list(quota.items()), f"`{group}` {kind}, quota bigint")
        contents = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
        taken = prefix_allocate(df, group=[group], quota=quotas, levels=hash_levels(hash60), tie=[hash60, key, contents], out="__taken")
        return taken.withColumn(out, F.col("__taken") > 0).drop("__taken")


def _open_rows(group: str | None, open_cells: dict | None, quota: int | dict, shift: int) -> tuple[Column, Column]:
    """Rows inside the open cells (all rows at first) and the quota that applies to them."""
    if open_cells is None:
        if not isinstance(quota, dict):
            return F.lit(True), F.lit(max(0, int(quota))).cast("bigint")
        wanted = F.lit(0).cast("bigint")
        for value, amount in quota.items():
            wanted = F.when(F.col(group).eqNullSafe(F.lit(value)), F.lit(max(0, int(amount))).cast("bigint")).otherwise(wanted)
        return F.lit(True), wanted
    cell, wanted = F.lit(None).cast("bigint"), F.lit(None).cast("bigint")
    for value, (low, left) in open_cells.items():
        mine = F.col(group).eqNullSafe(F.lit(value)) if group else F.lit(True)
        cell = F.when(mine, F.lit(low >> shift).cast("bigint")).otherwise(cell)
        wanted = F.when(mine, F.lit(left).cast("bigint")).otherwise(wanted)
    return F.shiftright("__h", shift) == cell, wanted
