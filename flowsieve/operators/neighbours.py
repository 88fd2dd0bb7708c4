"""Exact k nearest neighbours that meet only the cells which can hold one.

Training rows belong to the nearest of some pivots and, by their distance to it, to a ring around that pivot.  By the triangle
inequality a row at distance d from a pivot is at least d - high and low - d away from every row of a ring from
low to high, and a row nearer to another pivot is at least its distance to the plane between both away from all of
that pivot's rings.  A row's own limit is first the k-th smallest of its distance to a pivot plus the distances of that
pivot's k nearest rows: so many rows are at least that near.

Rings are small, so that few pairs are compared; cells are large, so that few copies are moved: neighbouring rings make a
cell, and a row is sent once to a cell with a ring within its limit, however many of them are.  Every row first meets the cell it
is nearest to.  Its k-th neighbour there is its limit for all others.  Inside a cell a row meets the nearest rings
first, and each neighbour found tightens the limit for the rings after it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.operators.joins import broadcast_if_small
from flowsieve.session import cut_lineage

NEIGHBOURS = 5
MAX_PIVOTS = 512
# Rings in all, a bounded table that every task gets; fuller rings are split at random.
MAX_RINGS = 20_000
# Distances are compared after rounding, so limits are wider by more than that.
DECIMALS = 9
SLACK = 1e-7
# Rows of either side in a task: a sixteenth of them, at most so many.
BLOCKS, LARGEST_BLOCK = 16, 20_000
# Entries of a work table of distances or bounds.
WORK_ENTRIES = 2_000_000
TEST_ROWS_AT_ONCE = 256


def _distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    squared = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", points, points)[None, :] - 2.0 * (x @ points.T)
    return np.sqrt(np.maximum(squared, 0.0))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _nearest_pivot(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``rows`` with the nearest pivot and the distance ``d`` to it."""

    @F.pandas_udf("pivot int, d double")
    def placed(x: pd.Series) -> pd.DataFrame:
        if not len(x):
            return pd.DataFrame({"pivot": [], "d": []})
        found = _distances(np.stack(x.to_numpy()), pivots)
        nearest = found.argmin(axis=1)
        return pd.DataFrame({"pivot": nearest, "d": found[np.arange(len(x)), nearest]})

    return rows.withColumn("place", placed("x")).select(*rows.columns, "place.*")


def _rounding(squares: np.ndarray, others: np.ndarray) -> np.ndarray:
    """What the squared distances of rows with these squared lengths may be off."""
    return 1e-12 * (squares + np.max(others, initial=0.0, where=np.isfinite(others)))


def _chain(between: np.ndarray) -> list[int]:
    """All pivots, each followed by the nearest one that is left."""
    order, left = [0], np.ones(len(between), bool)
    for _ in range(len(between) - 1):
        left[order[-1]] = False
        order.append(int(np.where(left, between[order[-1]], np.inf).argmin()) if np.isfinite(between[order[-1]][left]).any() else int(np.argmax(left)))
    return order


class Rings:
    """Pivots, their rings and their k nearest rows, and the cells they are dealt to: what decides where a row has to go."""

    def __init__(self, pivots: np.ndarray, rings: list, nearest: list, k: int, cell_rows: int) -> None:
        self.pivots, self.k = pivots, k
        self.between = _distances(pivots, pivots)
        place = np.argsort(_chain(self.between))
        rings = sorted(rings, key=lambda r: (place[r.pivot], r.ring))
        self.names = [(r.pivot, r.ring) for r in rings]
        self.pivot = np.array([r.pivot for r in rings], np.int64)
        self.low, self.high = np.array([r.low for r in rings]), np.array([r.high for r in rings])
        self.nearest = np.full((len(pivots), k), np.inf)
        for r in nearest:
            self.nearest[r.pivot, r.rank - 1] = r.d
        # Rings in a row share a cell up to its size; a larger one, such as a ring of equal rows, has several to itself.
        starts, parts, held = [], [], cell_rows
        for i, r in enumerate(rings):
            if held + r.n > cell_rows:
                starts.append(i)
                parts.append(max(1, math.ceil(r.n / cell_rows)))
                held = 0
            held += r.n
        self.starts, self.parts = np.array(starts, np.int64), np.array(parts, np.int64)
        first = np.cumsum(self.parts) - self.parts
        shares = np.searchsorted(self.starts, np.arange(len(rings)), "right") - 1
        #: Of each ring its first cell and how many it has.
        self.cells = list(zip(first[shares].tolist(), self.parts[shares].tolist()))

    def slack(self, x: np.ndarray) -> np.ndarray:
        return SLACK * (1.0 + np.sqrt(np.einsum("ij,ij->i", x, x)))

    def limits(self, d: np.ndarray) -> np.ndarray:
        """A distance within which every row has k neighbours, from its distances to the pivots."""
        upto = (d[:, :, None] + self.nearest[None, :, :]).reshape(len(d), -1)
        at = min(self.k, upto.shape[1]) - 1
        return np.partition(upto, at, axis=1)[:, at]

    def near(self, d: np.ndarray, rings: np.ndarray | slice = slice(None)) -> np.ndarray:
        """How near any row of a ring can be, from the distances to the pivots."""
        apart = self.between[d.argmin(axis=1)]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.where(apart > 0, (d**2 - d.min(axis=1)[:, None] ** 2) / (2 * apart), 0.0)
        pivot = self.pivot[rings]
        return np.maximum(plane[:, pivot], np.maximum(d[:, pivot] - self.high[rings], self.low[rings] - d[:, pivot]))

    def reached(self, x: np.ndarray, reach: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which cells each row can reach, the first of the nearest ring and the limit."""
        d = _distances(x, self.pivots)
        reach = self.limits(d) + self.slack(x) if reach is None else reach
        near = self.near(d)
        cells = np.repeat(np.logical_or.reduceat(near <= (reach + self.slack(x))[:, None], self.starts, axis=1), self.parts, axis=1)
        home = np.array(self.cells)[near.argmin(axis=1), 0]
        return cells, home, reach


def _meet(test: pd.DataFrame, train: pd.DataFrame, k: int, table: Rings) -> pd.DataFrame:
    """``test`` with the k nearest of one cell's rows for each row, by distance, then key, and its limit after it."""
    if test.empty or train.empty:
        return pd.DataFrame({c: [] for c in ["key", "x", "home", "reach", "near", "compared"]})
    train, test = train.sort_values("ring", kind="stable"), test.sort_values("home", kind="stable")
    points, keys, classes = np.stack(train["x"].to_numpy()), train["key"].to_numpy(), train["label"].to_numpy()
    norms = np.einsum("ij,ij->i", points, points)
    rings, starts = np.unique(train["ring"].to_numpy(), return_index=True)
    ends = np.append(starts[1:], len(train))
    found_near, found_reach, found_compared = [], [], []
    for start in range(0, len(test), TEST_ROWS_AT_ONCE):
        part = test.iloc[start : start + TEST_ROWS_AT_ONCE]
        x, reach = np.stack(part["x"].to_numpy()), part["reach"].to_numpy(np.float64).copy()
        squares = np.einsum("ij,ij->i", x, x)
        off, slack = _rounding(squares, norms), table.slack(x)
        near = table.near(_distances(x, table.pivots), rings)
        upto, best, compared = (reach + slack) ** 2 + off, np.full((len(x), k), np.inf), np.zeros(len(x), np.int64)
        found = []
        for r in np.argsort(near.min(axis=0), kind="stable"):
            rows = np.flatnonzero(near[:, r] <= reach + slack)
            if not len(rows):
                continue
            inside = slice(starts[r], ends[r])
            squared = squares[rows, None] + norms[None, inside] - 2.0 * (x[rows] @ points[inside].T)
            compared[rows] += ends[r] - starts[r]
            i, j = np.nonzero(squared <= upto[rows, None])
            if not len(i):
                continue
            found.append((rows[i], starts[r] + j, squared[i, j]))
            hit = np.unique(i)
            at = rows[hit]
            best[at] = np.partition(np.concatenate([best[at], squared[hit]], axis=1), k - 1, axis=1)[:, :k]
            # Everything as near as the k-th, after rounding, stays a candidate, so that ties are decided by key.
            farthest = np.sqrt(np.maximum(best[at].max(axis=1) + off[at], 0.0)) + 2 * 10.0**-DECIMALS
            upto[at] = np.minimum(upto[at], farthest**2 + off[at])
            reach[at] = np.minimum(reach[at], farthest + slack[at])
        rows, columns, squared = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        kept = squared <= upto[rows]
        rows, columns = rows[kept], columns[kept]
        step = max(1, WORK_ENTRIES // points.shape[1])
        exact = [np.sqrt(((points[columns[i : i + step]] - x[rows[i : i + step]]) ** 2).sum(axis=1)).round(DECIMALS) for i in range(0, len(rows), step)]
        exact = np.concatenate(exact) if exact else np.zeros(0)
        order = np.lexsort((keys[columns], exact, rows))
        bounds = np.searchsorted(rows[order], np.arange(len(x) + 1))
        for a, b in zip(bounds, bounds[1:]):
            chosen = order[a : min(b, a + k)]
            found_near.append([{"distance": float(exact[c]), "key": keys[columns[c]], "label": int(classes[columns[c]])} for c in chosen])
        found_reach.append(reach)
        found_compared.append(compared)
    return test[["key", "x", "home"]].assign(reach=np.concatenate(found_reach), near=found_near, compared=np.concatenate(found_compared))


def pruned_neighbours(
    train: DataFrame, test: DataFrame, *, features: str, label: str, key: str, k: int = NEIGHBOURS, block: int = 20_000, pivots: int | None = None
) -> DataFrame:
    """``key, near, score, prediction, compared`` for each test row: exact neighbours by majority vote.

    Ties are decided by distance, then training key.  ``compared`` is the number of training rows whose distance was
    computed.  Rings hold about ``block`` rows; one that holds more than a cell, such as a ring of equal rows, is split over
    several cells, and so are the test rows that meet a cell.  Rows whose vector is null are left out.
    """
    session, kind = train.sparkSession, dict(train.dtypes)[key]
    columns = [F.col(key).alias("key"), F.col(features).cast("array<double>").alias("x")]
    train, test = (rows.where(F.col(features).isNotNull()) for rows in (train, test))
    given = train.select(*columns, F.col(label).cast("int").alias("label"))
    n = given.count()
    count = min(MAX_PIVOTS, pivots or max(1, math.isqrt(n)))
    chosen = given.orderBy(F.xxhash64("key"), "key").limit(count).select("x").collect()
    near_type = f"array<struct<distance:double,key:{kind},label:int>>"
    if not chosen:
        nothing = f"{key} {kind}, near {near_type}, score double, prediction int, compared bigint"
        return session.createDataFrame([], nothing)
    centres = np.unique(np.array([r.x for r in chosen]), axis=0)
    placed = cut_lineage(_nearest_pivot(given, centres), "placed")

    # At most as many rings as fit into the bounded table.
    per_ring = max(block, math.ceil(n / MAX_RINGS))
    sizes = placed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("d", [i / 64 for i in range(1, 64)], 1_000).alias("shares"))
    wanted = F.least(F.lit(64.0), F.ceil(F.col("n") / per_ring).cast("double")).cast("int")
    cuts = F.transform(F.sequence(F.lit(1), wanted), lambda i: F.get("shares", F.floor(i * 64 / wanted).cast("int") - 1))
    edges = sizes.select("pivot", F.array_distinct(F.filter(cuts, lambda c: c.isNotNull())).alias("edges"))
    rings = placed.join(F.broadcast(edges), "pivot").withColumn("ring", F.size(F.filter("edges", lambda e: e < F.col("d")))).drop("edges")
    rings = cut_lineage(rings, "rings")
    facts = rings.groupBy("pivot", "ring").agg(F.min("d").alias("low"), F.max("d").alias("high"), F.count(F.lit(1)).alias("n")).orderBy("pivot", "ring").collect()
    first = Window.partitionBy("pivot").orderBy("d")
    nearest = rings.select("pivot", "d").withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).collect()
    cell_rows = max(block, min(math.ceil(n / BLOCKS), LARGEST_BLOCK))
    table = Rings(centres, facts, nearest, k, cell_rows)
    dealt = [(pivot, ring, i, *table.cells[i]) for i, (pivot, ring) in enumerate(table.names)]
    dealt = F.broadcast(session.createDataFrame(dealt, "pivot int, name int, number int, first int, parts int"))
    placed = rings.join(dealt, (rings["pivot"] == dealt["pivot"]) & (rings["ring"] == dealt["name"]))
    mine = lambda many: F.pmod(F.xxhash64("key"), F.col(many)).cast("int")
    placed = placed.select("key", "x", "label", F.col("number").alias("ring"), (F.col("first") + mine("parts")).alias("cell"))

    def spread(batches: Iterator[pa.RecordBatch], elsewhere: bool) -> Iterator[pa.RecordBatch]:
        at_once = max(1, WORK_ENTRIES // max(len(table.pivot), k * len(table.pivots), int(table.parts.sum())))
        for batch in batches:
            for start in range(0, batch.num_rows, at_once):
                part = batch.slice(start, at_once)
                x = _matrix(part.column("x"), centres.shape[1])
                if elsewhere:
                    home, reach = (part.column(c).to_numpy(zero_copy_only=False) for c in ("home", "reach"))
                    cells, _, _ = table.reached(x, reach)
                    cells[np.arange(len(x)), home] = False
                else:
                    cells, home, reach = table.reached(x)
                    reachable = cells.any(axis=1)
                    cells = (np.arange(cells.shape[1]) == home[:, None]) & reachable[:, None]
                _, to = np.nonzero(cells)
                offsets = np.concatenate([[0], np.cumsum(cells.sum(axis=1))])
                to = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(to, pa.int32()))
                out = [part.column("key"), part.column("x"), pa.array(home, pa.int32()), pa.array(reach, pa.float64()), to]
                yield pa.RecordBatch.from_arrays(out, ["key", "x", "home", "reach", "cells"])

    row = f"key {kind}, x array<double>, home int, reach double"
    cells = ["cell", "b"]

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _meet(a, b, k, table)

    def met(rows: DataFrame, elsewhere: bool) -> DataFrame:
        """``rows`` with their neighbours in the cell they are nearest to, or those in all others in reach."""
        left = cut_lineage(rows.mapInArrow(lambda batches: spread(batches, elsewhere), f"{row}, cells array<int>"), "reached")
        left_rows = max(block, min(math.ceil(left.count() / BLOCKS), LARGEST_BLOCK))
        left = left.select("key", "x", "home", "reach", F.explode("cells").alias("cell"))
        # A row per cell.
        many = left.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / left_rows).cast("int").alias("blocks"))
        many = broadcast_if_small(many, MAX_RINGS * 64)
        left = left.join(many, "cell").withColumn("b", mine("blocks")).select(*cells, "key", "x", "home", "reach")
        right = placed.join(many, "cell").withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*cells, "key", "x", "label", "ring")
        return left.groupBy(*cells).cogroup(right.groupBy(*cells)).applyInPandas(meet, f"{row}, near {near_type}, compared bigint")

    homes = cut_lineage(met(test.select(*columns), False), "homes")
    partial = homes.select("key", "near", "compared").unionByName(met(homes.select("key", "x", "home", "reach"), True).select("key", "near", "compared"))
    merged = partial.groupBy("key").agg(
        # At most k candidates of each cell in reach.
        F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"), F.sum("compared").alias("compared")
    )
    votes = F.aggregate("near", F.lit(0), lambda acc, x: acc + x["label"])
    return merged.select(
        F.col("key").alias(key), "near", (votes / F.size("near")).alias("score"), (votes * 2 > F.size("near")).cast("int").alias("prediction"), "compared"
    )
