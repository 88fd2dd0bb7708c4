import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsieve.operators import information


def psi(n):
    return sum(1 / i for i in range(1, n)) - 0.57721566490153286


def brute(values, labels, k):
    """The estimate from all distances; see the module for ties."""
    v, y = np.array(values, float), np.array(labels)
    v[~np.isfinite(v)] = 0
    kept = np.array([np.sum(y == c) > 1 for c in y])
    v, y = v[kept], y[kept]
    total = psi(len(v))
    for x, c in zip(v, y):
        d, own = np.abs(v - x), y == c
        n = int(own.sum())
        radius = np.sort(d[own])[min(k, n - 1)]
        near = d < radius if radius > 0 else d == 0
        total += (psi(int((near & own).sum())) - psi(n) - psi(int(near.sum()))) / len(v)
    return max(total, 0.0)


def columns(n, seed):
    rng = random.Random(seed)
    label = [rng.randint(0, 1) if i else 2 for i in range(n)]
    return label, {
        "plain": [rng.gauss(3.0 * y, 1) for y in label],
        "grid": [float(rng.randint(0, 5) + 4 * y) for y in label],
        "halves": [rng.randint(0, 40) / 2 for _ in label],
        "heavy": [0.0 if rng.random() < 0.6 else 2.0 ** rng.randint(-20, 20) for _ in label],
        "constant": [7.0] * n,
        "broken": [rng.choice([math.nan, math.inf, -0.0, 1.0, -1.0, float(y)]) for y in label],
    }


@pytest.mark.parametrize("cell_rows", [10_000, 7, 1])
@pytest.mark.parametrize("k", [1, 3, 6])
def test_against_all_distances(spark, cell_rows, k):
    label, features = columns(150, 5)
    names = list(features)
    rows = [(y, *row) for y, row in zip(label, zip(*features.values()))] + [(None, *[0.5] * len(names))]
    df = spark.createDataFrame(rows, ["y", *names])
    found = {r.feature: r.score for r in information.neighbour_information(df, names, "y", k, cell_rows).collect()}
    assert set(found) == set(names)
    for name, values in features.items():
        assert found[name] == pytest.approx(brute(values, label, k), abs=1e-9), name
    assert found["plain"] > 0.2 and found["constant"] < 1e-9


def test_rare_class_looks_over_many_cells(spark):
    values = [float(i * i) for i in range(60)]
    label = [int(i in (0, 30, 59)) for i in range(60)]
    df = spark.createDataFrame(list(zip(label, values)), "y int, x double")
    found = information.neighbour_information(df, ["x"], "y", 2, 4).first()
    assert found.score == pytest.approx(brute(values, label, 2), abs=1e-9)


def test_cells_share_the_values_and_keep_their_order(spark):
    df = spark.range(1000).select(F.lit("f").alias("feature"), F.sqrt("id").alias("v"))
    edges = information.cell_edges(df, 1000, 9)
    cells = df.join(edges, "feature").select("v", information.cell_of(F.col("v"), F.col("edges")).alias("cell")).orderBy("v").collect()
    found = [r.cell for r in cells]
    points = edges.first().edges
    assert found == [sum(e < r.v for e in points) for r in cells]
    assert found == sorted(found) and 100 < len(set(found)) and max(map(found.count, set(found))) < 30


def test_digamma(spark):
    rows = spark.createDataFrame([(n,) for n in (1, 2, 3, 10, 1000)], "n bigint").select("n", information.digamma(F.col("n")).alias("p")).collect()
    for r in rows:
        assert r.p == pytest.approx(psi(r.n), abs=1e-12)


def test_no_rows(spark):
    df = spark.createDataFrame([], "y int, x double")
    assert information.neighbour_information(df, ["x"], "y").count() == 0


def test_the_table_is_read_once_and_the_radii_are_found_once(spark, monkeypatch):
    read, found = spark.sparkContext.accumulator(0), []

    @F.udf("double")
    def seen(x):
        read.add(1)
        return x

    def one(placed, k):
        found.append(information.cut_lineage(radii(placed, k)))
        return found[0].withColumn("low", counted("low"))

    looked = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        looked.add(1)
        return x

    radii = information.neighbour_radii
    monkeypatch.setattr(information, "neighbour_radii", one)
    rows = spark.range(200).select((F.col("id") % 2).cast("int").alias("y"), F.sqrt("id").alias("x"))
    table = rows.withColumn("x", seen.asNondeterministic()("x"))
    information.neighbour_information(table.withColumn("y", F.when(F.col("x") >= 0, F.col("y"))), ["x"], "y", 3, 20).collect()
    assert read.value == 200
    assert looked.value == found[0].count()
