"""Centroid clustering in whole numbers, nearest centroids found by mean and deviation.

Centroids are sorted by the sum of their components.  The search for a vector starts at its own
sum and goes outward on both sides.  With k components, sums s and t and deviations p and q (the
lengths of the vectors less their means), a squared distance is at least (s - t)**2 / k + (p - q)**2.  The first
term grows outward, so the search ends where it passes the best distance; both together reject a
centroid without a look at its components.  What is left is compared in exact integers; the
bounds carry a margin for rounding, so nothing is rejected wrongly, and ties go to the smaller number.

A vector counts if it has exactly ``DIMENSIONS`` components, none null, non-finite or of 1e25 and more in size.
Others (and null vectors) are left out.  Rows that repeat an id are vectors of their own; a null id
sorts after all others when the first centroids are chosen, ties are broken by the components.
Fewer vectors than centroids make as many clusters as there are vectors, no vector gives no row.  Columns other than id
and vector are not read, whatever they are called.  A distance or sum beyond 64 bits is null.

The vectors are scanned once for the first centroids, once for each round and once at the end.  A task adds up its
vectors by cluster; what is shuffled is a row per task, cluster and component, what reaches the driver
are the centroids, whose number is a parameter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.llm.common import stored_table

CENTROIDS = 40
DIMENSIONS = 64
ROUNDS = 5
SEED = 2
SCALE = 256
# Components are below this, so sums over 10**10 vectors fit into 38 digits.
COMPONENT_LIMIT = 1e25
# Up to this size, all sums of squares fit into 64 bits.
NARROW = 2**23
LONGEST = 2**63 - 1
# Relative margin of bounds computed in floating point.
MARGIN = 1e-9


def usable(vectors: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """``(vec_id, v)`` of the vectors that count, as doubles."""
    v = F.col("embedding").cast("array<double>")
    good = (F.size(v) == dimensions) & F.forall(v, lambda x: F.abs(x) < COMPONENT_LIMIT)
    return vectors.where(F.coalesce(good, F.lit(False))).select("vec_id", v.alias("v"))


def whole_numbers(vectors: np.ndarray) -> np.ndarray:
    """``floor(256 * x)``, in 64 bits where squares fit and as Python's integers elsewhere."""
    scaled = np.floor(vectors.astype(np.float64) * SCALE)
    if np.abs(scaled).max(initial=0) < NARROW:
        return scaled.astype(np.int64)
    return np.array([[int(x) for x in row] for row in scaled], dtype=object).reshape(scaled.shape)


class Centroids:
    """Centroids in the order of their sums, with what the bounds need."""

    def __init__(self, rows: list[list[int]]) -> None:
        narrow = all(abs(x) < NARROW for row in rows for x in row)
        points = np.array(rows, dtype=np.int64 if narrow else object)
        sums = points.sum(axis=1)
        self.numbers = np.array(sorted(range(len(rows)), key=lambda i: (sums[i], i)))
        self.points, self.sums = points[self.numbers], sums[self.numbers]
        self.deviations = deviation(self.points)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number of and squared distance to the nearest centroid of each vector, and how many distances were computed."""
        if self.points.dtype == object:
            vectors = vectors.astype(object)
        k, rows = vectors.shape[1], len(vectors)
        wide = vectors.dtype == object
        sums, deviations = vectors.sum(axis=1), deviation(vectors)
        right = np.searchsorted(self.sums, sums)
        left = right - 1
        number = np.full(rows, len(self.numbers))
        best = np.zeros(rows, dtype=object if wide else np.int64)
        limit = np.full(rows, np.inf)
        active, compared = np.arange(rows), 0
        while len(active):
            lo, hi = left[active], right[active]
            low = sums[active] - self.sums[np.maximum(lo, 0)]
            high = self.sums[np.minimum(hi, len(self.sums) - 1)] - sums[active]
            inward = (lo >= 0) & ((hi >= len(self.sums)) | (low <= high))
            at, gap = np.where(inward, lo, hi), np.where(inward, low, high)
            there = (lo >= 0) | (hi < len(self.sums))
            means = gap.astype(np.float64) ** 2 / k * (1 - MARGIN)
            going = there & (means <= limit[active])
            active, at, inward, means = active[going], at[going], inward[going], means[going]
            left[active[inward]] -= 1
            right[active[~inward]] += 1
            p, q = deviations[active], self.deviations[at]
            spread = np.maximum(np.abs(p - q) - MARGIN * (p + q), 0)
            near = means + spread**2 * (1 - MARGIN) <= limit[active]
            tried, at = active[near], at[near]
            compared += len(tried)
            distance = ((vectors[tried] - self.points[at]) ** 2).sum(axis=1)
            names = self.numbers[at]
            better = np.isinf(limit[tried]) | (distance < best[tried]) | ((distance == best[tried]) & (names < number[tried]))
            won = tried[better]
            best[won], number[won] = distance[better], names[better]
            limit[won] = best[won].astype(np.float64) * (1 + MARGIN)
        return number, best, compared


def deviation(vectors: np.ndarray) -> np.ndarray:
    """Length of each vector less its mean; exact but for the root."""
    k = vectors.shape[1]
    exact = k * (vectors * vectors).sum(axis=1) - vectors.sum(axis=1) ** 2
    return np.sqrt(exact.astype(np.float64) / k)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
            yield batch.column("vec_id"), whole_numbers(flat.reshape(batch.num_rows, -1))


def first_centroids(vectors: DataFrame, count: int = CENTROIDS, seed: int = SEED) -> list[list[int]]:
    """The ``count`` vectors whose ids hash lowest, in that order; ``vectors(vec_id, v)``."""
    by_hash = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(by_hash.asc_nulls_last(), "v").limit(count).collect()
    return whole_numbers(np.array([r.v for r in rows])).tolist() if rows else []


def moved(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after a round: floor of the mean of their vectors, empty ones as they are."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, sums, counts = Centroids(centroids), np.zeros((len(centroids), len(centroids[0])), dtype=object), np.zeros(len(centroids), np.int64)
        for _, block in _blocks(batches):
            number, _, _ = search.nearest(block)
            by = np.argsort(number, kind="stable")
            found, first = np.unique(number[by], return_index=True)
            sums[found] += np.add.reduceat(block[by], first, axis=0).astype(object)
            counts += np.bincount(number, minlength=len(centroids))
        used = np.flatnonzero(counts)
        text = [[str(x) for x in sums[c]] for c in used]
        yield pa.RecordBatch.from_pydict(
            {"cluster": pa.array(used, pa.int32()), "n": pa.array(counts[used], pa.int64()), "sums": pa.array(text, pa.list_(pa.string()))}
        )

    parts = vectors.mapInArrow(added, "cluster int, n bigint, sums array<string>")
    parts = parts.select("cluster", "n", F.posexplode("sums").alias("i", "part"))
    totals = parts.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    out = [list(c) for c in centroids]
    for row in totals.collect():
        out[row.cluster][row.i] = int(row.total) // row.n
    return out


def assigned(vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``(vec_id, cluster, distance)`` for every row of ``vectors(vec_id, v)``."""
    id_type = vectors.schema["vec_id"].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Centroids(centroids)
        for ids, block in _blocks(batches):
            number, distance, _ = found.nearest(block)
            fits = [int(d) if d <= LONGEST else None for d in distance] if distance.dtype == object else distance
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(number, pa.int32()), pa.array(fits, pa.int64())], ["vec_id", "cluster", "distance"]
            )

    return vectors.mapInArrow(search, f"vec_id {id_type}, cluster int, distance bigint")


def fit(vectors: DataFrame, *, count: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> list[list[int]]:
    """The centroids after ``rounds`` rounds; ``vectors(vec_id, v)``."""
    centroids = first_centroids(vectors, count, seed)
    for _ in range(rounds if centroids else 0):
        centroids = moved(vectors, centroids)
    return centroids


def clusters(vectors: DataFrame, *, count: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid)`` for every vector of ``vectors(vec_id, embedding)`` that counts."""
    rows = usable(vectors, dimensions)
    centroids = fit(rows, count=count, rounds=rounds, seed=seed)
    facts = "cluster int, cluster_inertia bigint, inertia bigint, centroid string"
    if not centroids:
        id_type = rows.schema["vec_id"].dataType.simpleString()
        return rows.sparkSession.createDataFrame([], f"vec_id {id_type}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid string")
    found = stored_table(assigned(rows, centroids), "assigned")
    sums = found.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"), F.count(F.lit(1)).alias("n"), F.count("distance").alias("fit")
    )
    inertia = {r.cluster: int(r.total) if r.fit == r.n else None for r in sums.collect()}
    whole = None if None in inertia.values() else sum(inertia.values())
    narrow = lambda x: x if x is not None and x <= LONGEST else None
    table = [(c, narrow(t), narrow(whole), ",".join(map(str, centroids[c]))) for c, t in inertia.items()]
    # One row per centroid.
    return found.join(F.broadcast(rows.sparkSession.createDataFrame(table, facts)), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"
    )
