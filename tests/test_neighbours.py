import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsieve.operators import models, neighbours

SCHEMA = "id bigint, x array<double>, y int"


def frame(spark, x, y, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in row], int(c)) for i, (row, c) in enumerate(zip(x, y))], SCHEMA)


def brute(train, test, k):
    out = {}
    points, classes = np.array([r.x for r in train]), [r.y for r in train]
    for r in test:
        d = np.sqrt(((points - np.array(r.x)) ** 2).sum(axis=1)).round(9)
        order = sorted(range(len(train)), key=lambda i: (d[i], train[i].id))[:k]
        out[r.id] = [(d[i], train[i].id, classes[i]) for i in order]
    return out


def groups(seed, centres, rows, width=6, spread=0.05):
    rng = np.random.default_rng(seed)
    middle = np.random.default_rng(1).normal(0, 5, (centres, width))
    which = rng.integers(0, centres, rows)
    return middle[which] + rng.normal(0, spread, (rows, width)), which % 2


@pytest.mark.parametrize("block,pivots,k", [(40, None, 5), (1000, 1, 3), (7, 12, 5), (25, 30, 1)])
def test_against_all_distances(spark, block, pivots, k):
    x, y = groups(3, 12, 400)
    x = np.concatenate([x, np.random.default_rng(4).normal(0, 4, (60, 6)), x[:50], np.repeat(x[:1], 70, axis=0)])
    y = np.resize(y, len(x))
    train = frame(spark, x, y)
    test = frame(spark, np.concatenate([groups(5, 12, 60)[0], np.random.default_rng(6).normal(0, 20, (20, 6)), x[:10]]), np.zeros(90), 10_000)
    found = neighbours.pruned_neighbours(train, test, features="x", label="y", key="id", k=k, block=block, pivots=pivots).collect()
    wanted = brute(train.collect(), test.collect(), k)
    assert {r.id: [tuple(n) for n in r.near] for r in found} == {i: [(float(d), n, c) for d, n, c in v] for i, v in wanted.items()}
    for r in found:
        assert r.prediction == int(2 * sum(c for *_, c in wanted[r.id]) > len(wanted[r.id]))


def test_few_pairs_on_groups(spark):
    (x, y), (other, _) = groups(7, 30, 3000), groups(8, 30, 500)
    found = neighbours.pruned_neighbours(frame(spark, x, y), frame(spark, other, np.zeros(500)), features="x", label="y", key="id", block=100).collect()
    assert len(found) == 500
    assert sum(r.compared for r in found) < 0.08 * 3000 * 500


def test_rows_are_sent_to_cells_and_not_to_every_ring(spark, monkeypatch):
    sent, kept = [], neighbours.cut_lineage

    def counted(df, name="stage"):
        out = kept(df, name)
        if name == "reached":
            sent.append(out.agg(F.sum(F.size("cells")) if "cells" in out.columns else F.count(F.lit(1))).first()[0])
        return out

    monkeypatch.setattr(neighbours, "cut_lineage", counted)
    x = np.random.default_rng(2).normal(0, 1, (700, 8))
    train, test = frame(spark, x[:600], np.arange(600) % 2), frame(spark, x[600:], np.zeros(100), 900)
    found = neighbours.pruned_neighbours(train, test, features="x", label="y", key="id", block=4).collect()
    # Some 150 rings, all in reach; a cell holds a sixteenth of the rows.
    assert sum(sent) <= 100 * 2 * 16
    wanted = brute(train.collect(), test.collect(), 5)
    assert {r.id: [n.key for n in r.near] for r in found} == {i: [n for _, n, _ in v] for i, v in wanted.items()}


def test_agrees_with_the_block_grid(spark):
    x, y = groups(9, 5, 200, spread=3.0)
    train, test = frame(spark, x[:150], y[:150]), frame(spark, x[150:], y[150:], 900)
    a = neighbours.pruned_neighbours(train, test, features="x", label="y", key="id").select("id", "near", "prediction").collect()
    b = models.knn_predict(train, test, features="x", label="y", key="id").select("id", "near", "prediction").collect()
    assert sorted(a) == sorted(b)


def test_fewer_rows_than_neighbours_and_none(spark):
    train, test = frame(spark, [[0.0], [3.0]], [1, 0]), frame(spark, [[1.0], [9.0]], [0, 0], 10)
    found = {r.id: [n.key for n in r.near] for r in neighbours.pruned_neighbours(train, test, features="x", label="y", key="id").collect()}
    assert found == {10: [0, 1], 11: [1, 0]}
    assert neighbours.pruned_neighbours(train.limit(0), test, features="x", label="y", key="id").count() == 0
