"""Spark's classification tree, grown from blocks of binned rows.

Spark adds up a table of all features and bins for every node of a level in every task, sends them all through a shuffle
and keeps a record per row, which a deep tree over many rows does not survive.  Here a row is one byte per feature.  While
nodes are large, tasks count their rows by node, feature, bin and class; a node small enough for one task is then sent
there with its rows and finished without further passes.

The tree is the one Spark grows: cut points are found by its own code, gains are computed by the same steps, and sums
of weights are added in the same order (row by row in a partition, then partition by partition), since equal gains of a
weighted tree differ in their last bits.  The result is Spark's model, built by loading its stored form.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.session import drop_scratch, scratch_path

# Nodes of at most so many rows are grown by one task.
ROWS_OF_A_TASK = 100_000
_BLOCK_ROWS, _TASKS = 50_000, 1_000
# Sums that are worked on at once, and counts a pass hands to the driver.
_CELLS_AT_ONCE, _CELLS_OF_A_PASS = 2**18, 2**23
_EPSILON = 2.0**-52
_KEPT = "p int, n int, bins binary, y binary"


@dataclass(frozen=True)
class _Shape:
    """Cut points, the weight of a row of each class, and limits."""

    cuts: list[np.ndarray]
    weights: tuple[float, float]
    depth: int
    least: int

    @property
    def bins(self) -> int:
        return max(len(c) for c in self.cuts) + 1

    @property
    def cells(self) -> int:
        return len(self.cuts) * self.bins * 2

    @property
    def exact(self) -> bool:
        """Whole weights add up without rounding, in any order."""
        return all(w == int(w) for w in self.weights)


@dataclass
class _Nodes:
    """Nodes of a tree level by level, as columns; ``left`` is -1 for a leaf and the right child follows the left one."""

    level: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    gain: np.ndarray
    impurity: np.ndarray
    stats: np.ndarray
    rows: np.ndarray

    @classmethod
    def new(cls, level: int, impurity: np.ndarray, stats: np.ndarray, rows: np.ndarray) -> _Nodes:
        n = len(rows)
        whole = lambda v, kind: np.full(n, v, kind)
        return cls(whole(level, np.int16), whole(-1, np.int32), whole(-1, np.int16), whole(-1, np.int64), whole(-1.0, np.float64), impurity, stats, rows)

    @classmethod
    def joined(cls, parts: list[_Nodes]) -> _Nodes:
        return cls(*[np.concatenate([getattr(p, name) for p in parts]) for name in cls.__annotations__])


def _gini(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = a + b
    with np.errstate(invalid="ignore", divide="ignore"):
        a, b = a / n, b / n
    return np.where(n == 0, 0.0, 1.0 - a * a - b * b)


class _Sums:
    """Weights of equal rows added one by one, as a running sum adds them."""

    def __init__(self, weights: tuple[float, float]) -> None:
        self.weights, self.tables = weights, [np.zeros(1), np.zeros(1)]

    def add(self, total: np.ndarray, rows: np.ndarray, counts: np.ndarray) -> None:
        """Adds the sums of one partition to ``total`` and its counts to ``rows``; the first axis of all is the class."""
        for c, weight in enumerate(self.weights):
            some = counts[c].ravel()
            at = (some != 0).nonzero()[0]
            if len(at):
                some = some[at]
                most = int(some.max())
                if most >= len(self.tables[c]):
                    self.tables[c] = np.concatenate([[0.0], np.cumsum(np.full(2 * most, weight))])
                total[c].reshape(-1)[at] += self.tables[c][some]
                rows[c].reshape(-1)[at] += some


@dataclass
class _Found:
    """The best split of each node of a level, and both children."""

    stats: np.ndarray
    impurity: np.ndarray
    gain: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    children: np.ndarray
    child_rows: np.ndarray

    @classmethod
    def joined(cls, parts: list[_Found]) -> _Found:
        return cls(*[np.concatenate([getattr(p, name) for p in parts]) for name in cls.__annotations__])


def _best(sums: np.ndarray, rows: np.ndarray, shape: _Shape, stats: np.ndarray | None, impurity: np.ndarray | None) -> _Found:
    """``sums`` and ``rows`` by class, node, feature and bin; a root has no ``stats`` yet."""
    upto, count = sums.cumsum(axis=3), (rows[0] + rows[1]).cumsum(axis=2)
    left, whole = upto[..., :-1], upto[..., -1:]
    right = whole - left
    left_rows = count[:, :, :-1]
    right_rows = count[:, :, -1:] - left_rows
    if stats is None:
        first = next(i for i, c in enumerate(shape.cuts) if len(c))
        stats = (left[:, :, first, 0] + right[:, :, first, 0]).T
        impurity = _gini(stats[:, 0], stats[:, 1])
    n_left, n_right = left[0] + left[1], right[0] + right[1]
    n = n_left + n_right
    with np.errstate(invalid="ignore", divide="ignore"):
        gain = impurity[:, None, None] - n_left / n * _gini(*left) - n_right / n * _gini(*right)
    there = np.arange(shape.bins - 1)[None, :] < np.array([len(c) for c in shape.cuts])[:, None]
    valid = there[None] & (left_rows >= shape.least) & (right_rows >= shape.least) & (gain >= 0.0)
    gain = np.where(valid, gain, -np.inf).reshape(len(count), -1)
    at, node = gain.argmax(axis=1), np.arange(len(count))
    feature, cut = np.divmod(at, shape.bins - 1)
    children = np.stack([left[:, node, feature, cut].T, right[:, node, feature, cut].T], axis=1)
    child_rows = np.stack([left_rows[node, feature, cut], right_rows[node, feature, cut]], axis=1)
    return _Found(stats, impurity, gain[node, at], feature, cut, children, child_rows)


def _split(nodes: _Nodes, at: np.ndarray, found: _Found, level: int, depth: int, start: int) -> tuple[_Nodes, np.ndarray]:
    """Enters what was found for the nodes ``at`` of ``nodes``; their children, which begin at number ``start``, and which of these may split."""
    nodes.stats[at] = found.stats
    # Spark marks a leaf whose splits are all invalid by this impurity.
    nodes.impurity[at] = np.where(np.isneginf(found.gain), -1.0, found.impurity)
    inner = found.gain > 0
    at = at[inner]
    nodes.feature[at], nodes.cut[at], nodes.gain[at] = found.feature[inner], found.cut[inner], found.gain[inner]
    nodes.left[at] = start + 2 * np.arange(len(at))
    stats = found.children[inner].reshape(-1, 2)
    impurity = _gini(stats[:, 0], stats[:, 1])
    return _Nodes.new(level + 1, impurity, stats, found.child_rows[inner].reshape(-1)), (np.abs(impurity) >= _EPSILON) & (level + 1 < depth)


def _counted(bins: np.ndarray, y: np.ndarray, node: np.ndarray, nodes: int, shape: _Shape) -> np.ndarray:
    """Rows by class, node, feature and bin."""
    first = (node + y.astype(np.int64) * nodes) * len(shape.cuts)
    place = (first[:, None] + np.arange(len(shape.cuts))) * shape.bins + bins
    return np.bincount(place.ravel(), minlength=nodes * shape.cells).reshape(2, nodes, len(shape.cuts), shape.bins)


def _grow(bins: np.ndarray, y: np.ndarray, part: np.ndarray, shape: _Shape, level: int = 0, impurity: float | None = None, stats: np.ndarray | None = None) -> _Nodes:
    """The whole tree under one node from its rows."""
    added, n_features = _Sums(shape.weights), bins.shape[1]
    root = stats is None
    levels = [_Nodes.new(level, np.array([0.0 if root else impurity]), np.zeros((1, 2)) if root else stats.reshape(1, 2), np.array([len(y)]))]
    # Rows of nodes that may split, in the order of these nodes; the nodes of a level are numbered from ``start``.
    order, slot, at, start = np.arange(len(y)), np.zeros(len(y), np.int64), np.zeros(1, np.int64), 0
    if shape.exact:
        part = np.zeros(len(y), np.int8)
    while len(at):
        here, ends = levels[-1], np.searchsorted(slot, np.arange(len(at) + 1))
        step, found = max(1, _CELLS_AT_ONCE // shape.cells), []
        for a in range(0, len(at), step):
            b = min(len(at), a + step)
            some = order[ends[a] : ends[b]]
            local, of = slot[ends[a] : ends[b]] - a, part[some]
            sums, rows = np.zeros((2, b - a, n_features, shape.bins)), np.zeros((2, b - a, n_features, shape.bins), np.int64)
            for p in np.unique(of):
                mine = slice(None) if len(of) and of[0] == p and (of == p).all() else np.flatnonzero(of == p)
                counts = _counted(bins[some[mine]], y[some[mine]], local[mine], b - a, shape)
                added.add(sums, rows, counts)
            nodes = at[a:b]
            found.append(_best(sums, rows, shape, *((None, None) if root else (here.stats[nodes], here.impurity[nodes]))))
        root, all_found = False, _Found.joined(found)
        start += len(here.rows)
        below, may = _split(here, at, all_found, level, shape.depth, start)
        if not len(below.rows):
            break
        inner = all_found.gain > 0
        # Number of a split's left child among the children, and of every child among those that may split.
        first, among = np.where(inner, 2 * (np.cumsum(inner) - 1), -1), np.where(may, np.cumsum(may) - 1, -1)
        stay = first[slot] >= 0
        order, slot = order[stay], slot[stay]
        child = first[slot] + (bins[order, all_found.feature[slot]] > all_found.cut[slot])
        slot = among[child]
        order, slot = order[slot >= 0], slot[slot >= 0]
        by_node = np.argsort(slot, kind="stable")
        order, slot = order[by_node], slot[by_node]
        at = np.flatnonzero(may)
        levels.append(below)
        level += 1
    return _Nodes.joined(levels)


def _grow_spread(blocks: DataFrame, shape: _Shape, rows: int, parts: int) -> _Nodes:
    """Large nodes by counts of all tasks, the rest where their rows are sent."""
    added, level = _Sums(shape.weights), 0
    nodes = [_Nodes.new(0, np.zeros(1), np.zeros((1, 2)), np.array([rows]))]
    at, start, small = np.zeros(1, np.int64), 0, []
    while len(at):
        here = nodes[-1]
        large = at[here.rows[at] > ROWS_OF_A_TASK]
        small += [start + i for i in at[here.rows[at] <= ROWS_OF_A_TASK]]
        if not len(large):
            break
        step, found = max(1, _CELLS_OF_A_PASS // (shape.cells * parts)), []
        for a in range(0, len(large), step):
            some = large[a : a + step]
            by_part = _pass(blocks, _Nodes.joined(nodes), start + some, shape)
            sums, counts = np.zeros((2, len(some), len(shape.cuts), shape.bins)), np.zeros((2, len(some), len(shape.cuts), shape.bins), np.int64)
            for p in sorted(by_part):
                added.add(sums, counts, by_part[p])
            found.append(_best(sums, counts, shape, *((None, None) if level == 0 else (here.stats[some], here.impurity[some]))))
        start += len(here.rows)
        below, may = _split(here, large, _Found.joined(found), level, shape.depth, start)
        nodes.append(below)
        at, level = np.flatnonzero(may), level + 1
    top = _Nodes.joined(nodes)
    if not small:
        return top
    return _grafted(top, _finished(blocks, top, np.array(small), shape))


def _ends(bins: np.ndarray, nodes: _Nodes) -> np.ndarray:
    """The node of the tree so far in which each row ends."""
    node, first, flat = np.zeros(len(bins), np.int64), np.arange(len(bins)) * bins.shape[1], bins.ravel()
    for _ in range(int(nodes.level.max())):
        left = nodes.left[node]
        node = np.where(left < 0, node, left + (flat[first + np.maximum(nodes.feature[node], 0)] > nodes.cut[node]))
    return node


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for batch in batches:
        for p, n, bins, y in zip(*[batch.column(name) for name in ("p", "n", "bins", "y")]):
            yield p.as_py(), np.frombuffer(bins.as_buffer(), np.uint8).reshape(n.as_py(), -1), np.frombuffer(y.as_buffer(), np.uint8)


def _pass(blocks: DataFrame, nodes: _Nodes, wanted: np.ndarray, shape: _Shape) -> dict[int, np.ndarray]:
    """Counts of the wanted nodes by partition."""
    place = np.full(len(nodes.rows), -1)
    place[wanted] = np.arange(len(wanted))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for p, bins, y in _blocks_of(batches):
            at = place[_ends(bins, nodes)]
            mine = np.flatnonzero(at >= 0)
            counts = _counted(bins[mine], y[mine], at[mine], len(wanted), shape)
            p = 0 if shape.exact else p
            found[p] = found[p] + counts if p in found else counts
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([c.tobytes() for c in found.values()], pa.binary())], names=["p", "counts"])

    total: dict[int, np.ndarray] = {}
    for row in blocks.mapInArrow(count, "p int, counts binary").collect():
        counts = np.frombuffer(row.counts, np.int64).reshape(2, len(wanted), len(shape.cuts), shape.bins)
        total[row.p] = total[row.p] + counts if row.p in total else counts
    return total


def _finished(blocks: DataFrame, top: _Nodes, small: np.ndarray, shape: _Shape) -> dict[int, _Nodes]:
    """The trees under small nodes, each grown by the task its rows are sent to."""
    wanted = np.zeros(len(top.rows), bool)
    wanted[small] = True
    about = {int(i): (int(top.level[i]), float(top.impurity[i]), top.stats[i]) for i in small}

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, bins, y in _blocks_of(batches):
            node = _ends(bins, top)
            order = np.argsort(node, kind="stable")
            order = order[wanted[node[order]]]
            numbers, starts = np.unique(node[order], return_index=True)
            cut = [*starts, len(order)]
            rows = [order[a:b] for a, b in zip(cut, cut[1:])]
            arrays = [pa.array(numbers, pa.int64()), pa.array([p] * len(rows), pa.int32()), pa.array([len(r) for r in rows], pa.int32())]
            octets = [pa.array([np.ascontiguousarray(x[r]).tobytes() for r in rows], pa.binary()) for x in (bins, y)]
            yield pa.RecordBatch.from_arrays([*arrays, *octets], names=["node", "p", "n", "bins", "y"])

    def grow(table: pa.Table) -> pa.Table:
        number = table.column("node")[0].as_py()
        parts = list(_blocks_of(table.to_batches()))
        level, impurity, stats = about[number]
        grown = _grow(
            np.concatenate([b for _, b, _ in parts]), np.concatenate([y for _, _, y in parts]),
            np.concatenate([np.full(len(y), p, np.int32) for p, _, y in parts]), shape, level, impurity, stats,
        )
        return pa.table({"node": pa.array([number], pa.int64()), "tree": pa.array([pickle.dumps(grown)], pa.binary())})

    # A number of partitions that is given is not made smaller for their few bytes: a row takes long to grow a tree from.
    sent = blocks.mapInArrow(send, f"node bigint, {_KEPT}").repartition(min(len(small), _TASKS), "node")
    return {r.node: pickle.loads(r.tree) for r in sent.groupBy("node").applyInArrow(grow, "node bigint, tree binary").collect()}


def _grafted(top: _Nodes, grown: dict[int, _Nodes]) -> _Nodes:
    """``top`` with the trees in place of their roots; children still follow their parents, two by two."""
    parts, start = [top], len(top.rows)
    for number, tree in sorted(grown.items()):
        # The root of the tree is there already: the others move behind all nodes so far.
        tree.left = np.where(tree.left < 0, -1, tree.left - 1 + start)
        for name in _Nodes.__annotations__:
            getattr(top, name)[number] = getattr(tree, name)[0]
        rest = _Nodes(*[getattr(tree, name)[1:] for name in _Nodes.__annotations__])
        parts.append(rest)
        start += len(rest.rows)
    return _Nodes.joined(parts)


def _stored(nodes: _Nodes, shape: _Shape) -> pa.Table:
    """Nodes as Spark stores them: leaves of one class under one node are merged, numbers run depth first."""
    prediction = nodes.stats.argmax(axis=1)
    by_level = [np.flatnonzero(nodes.level == level) for level in range(int(nodes.level.max()) + 1)]
    size = np.ones(len(nodes.rows), np.int64)
    # A merged leaf has the impurity its split was measured by.
    left = nodes.left.copy()
    for some in reversed(by_level):
        some = some[left[some] >= 0]
        a, b = left[some], left[some] + 1
        merged = (left[a] < 0) & (left[b] < 0) & (prediction[a] == prediction[b])
        left[some[merged]] = -1
        some, a, b = some[~merged], a[~merged], b[~merged]
        size[some] = 1 + size[a] + size[b]
    number, kept = np.full(len(nodes.rows), -1, np.int64), []
    number[0] = 0
    for some in by_level:
        some = some[number[some] >= 0]
        kept.append(some)
        some = some[left[some] >= 0]
        a = left[some]
        number[a], number[a + 1] = number[some] + 1, number[some] + 1 + size[a]
    every = np.concatenate(kept)
    every = every[np.argsort(number[every])]
    inner = left[every] >= 0
    child = lambda move: pa.array(np.where(inner, number[left[every] + move], -1).astype(np.int32))
    cuts = [shape.cuts[f][c] for f, c in zip(nodes.feature[every[inner]], nodes.cut[every[inner]])]
    ends = np.concatenate([[0], np.cumsum(inner)]).astype(np.int32)
    split = pa.StructArray.from_arrays(
        [pa.array(np.where(inner, nodes.feature[every], -1).astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(cuts, pa.float64())), pa.array(np.full(len(every), -1, np.int32))],
        names=["featureIndex", "leftCategoriesOrThreshold", "numCategories"],
    )
    return pa.table(
        {
            "id": pa.array(np.arange(len(every), dtype=np.int32)),
            "prediction": pa.array(prediction[every].astype(np.float64)),
            "impurity": pa.array(nodes.impurity[every]),
            "impurityStats": pa.ListArray.from_arrays(pa.array(np.arange(len(every) + 1, dtype=np.int32) * 2), pa.array(nodes.stats[every].ravel())),
            "rawCount": pa.array(nodes.rows[every].astype(np.int64)),
            "gain": pa.array(np.where(inner, nodes.gain[every], -1.0)),
            "leftChild": child(0),
            "rightChild": child(1),
            "split": split,
        }
    )


class GrownTreeClassifier(DecisionTreeClassifier):
    """A ``DecisionTreeClassifier`` of two classes fitted as above; whatever that does not cover is left to Spark."""

    def _fit(self, dataset: DataFrame) -> DecisionTreeClassificationModel:
        spark, label = dataset.sparkSession, self.getLabelCol()
        weight = F.col(self.getWeightCol()).cast("double") if self.isSet("weightCol") else F.lit(1.0)
        facts = dataset.groupBy(F.col(label).cast("double").alias("y")).agg(F.count(F.lit(1)).alias("n"), F.min(weight).alias("low"), F.max(weight).alias("high"), F.count(weight).alias("known")).limit(4).collect()
        plain = self.getCacheNodeIds() and self.getImpurity() == "gini" and self.getMinInfoGain() == 0 and self.getMinWeightFractionPerNode() == 0 and self.getMaxBins() <= 256
        named = dataset.schema[self.getFeaturesCol()].metadata.get("ml_attr", {}).get("attrs", {})
        if not plain or dataset.schema[label].metadata or {"nominal", "binary"} & set(named):
            return super()._fit(dataset)
        if {r.y for r in facts} != {0.0, 1.0} or any(r.low != r.high or r.known != r.n or not r.low > 0 for r in facts):
            return super()._fit(dataset)
        cuts = self._cuts(dataset)
        if not any(len(c) for c in cuts):
            return super()._fit(dataset)
        by_class = {int(r.y): r for r in facts}
        shape = _Shape(cuts, (by_class[0].low, by_class[1].low), self.getMaxDepth(), self.getMinInstancesPerNode())
        path = scratch_path(spark, "tree-rows")
        _blocked(dataset, self.getFeaturesCol(), label, cuts).write.mode("errorifexists").option("compression", "none").parquet(path)
        blocks, rows = spark.read.schema(_KEPT).parquet(path), sum(r.n for r in facts)
        if rows <= ROWS_OF_A_TASK:

            def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                parts = list(_blocks_of(batches))
                grown = _grow(np.concatenate([b for _, b, _ in parts]), np.concatenate([y for _, _, y in parts]), np.concatenate([np.full(len(y), p, np.int32) for p, _, y in parts]), shape)
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(grown)], pa.binary())], names=["tree"])

            nodes = pickle.loads(blocks.coalesce(1).mapInArrow(alone, "tree binary").first().tree)
        else:
            parts = 1 if shape.exact else blocks.select("p").distinct().count()
            nodes = _grow_spread(blocks, shape, rows, parts)
        drop_scratch(spark, path)
        return self._copyValues(self._loaded(spark, _stored(nodes, shape), len(cuts)))

    def _cuts(self, dataset: DataFrame) -> list[np.ndarray]:
        """Cut points by Spark's own search, which depends on its sample of the rows."""
        jvm = dataset.sparkSession._jvm
        module = lambda name: getattr(getattr(jvm, name + "$"), "MODULE$")
        self._transfer_params_to_java()
        none = module("scala.None")
        instances = module("org.apache.spark.ml.util.DatasetUtils").extractInstances(self._java_obj, dataset._jdf, none)
        strategy = self._java_obj.getOldStrategy(module("scala.collection.immutable.Map").empty(), 2)
        metadata = jvm.org.apache.spark.ml.tree.impl.DecisionTreeMetadata.buildMetadata(instances, strategy)
        found = module("org.apache.spark.ml.tree.impl.RandomForest").findSplits(instances, metadata, self.getSeed())
        return [np.array([s.threshold() for s in of_feature], np.float64) for of_feature in found]

    def _loaded(self, spark, table: pa.Table, features: int) -> DecisionTreeClassificationModel:
        path = scratch_path(spark, "tree-model")
        self._transfer_params_to_java()
        self.write().save(f"{path}/estimator")
        about = json.loads(spark.read.text(f"{path}/estimator/metadata").first()[0])
        about |= {"class": "org.apache.spark.ml.classification.DecisionTreeClassificationModel", "numFeatures": features, "numClasses": 2}
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/model/metadata")
        spark.createDataFrame(table).write.parquet(f"{path}/model/data")
        model = DecisionTreeClassificationModel.load(f"{path}/model")
        drop_scratch(spark, path)
        return model


def _blocked(dataset: DataFrame, features: str, label: str, cuts: list[np.ndarray]) -> DataFrame:
    """Bins and classes of the rows, with the number of the partition they come from."""

    def block(p: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        bins, y = (np.concatenate(x) for x in zip(*parts))
        arrays = [pa.array([p], pa.int32()), pa.array([len(y)], pa.int32()), *[pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in (bins, y)]]
        return pa.RecordBatch.from_arrays(arrays, names=["p", "n", "bins", "y"])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, parts = -1, []
        for batch in batches:
            if not batch.num_rows:
                continue
            p = batch.column("p")[0].as_py()
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(cuts))
            bins = np.stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(cuts)], axis=1).astype(np.uint8)
            parts.append((bins, batch.column("y").to_numpy().astype(np.uint8)))
            if sum(len(y) for _, y in parts) >= _BLOCK_ROWS:
                yield block(p, parts)
                parts = []
        if parts:
            yield block(p, parts)

    given = dataset.select(F.spark_partition_id().alias("p"), vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"))
    return given.mapInArrow(keep, _KEPT)
