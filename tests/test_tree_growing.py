import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from flowsieve.operators import models, tree_growing
from flowsieve.operators.tree_growing import GrownTreeClassifier


def rows_of(spark, n, parts=5):
    x = [(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(w)).cast("double") - 3.0).alias(f"x{i}") for i, w in enumerate((7, 50, 1000, 1))]
    rows = spark.range(0, n, 1, parts).select("id", *x, (F.pmod(F.xxhash64("id"), F.lit(3)) == 0).cast("int").alias("y"))
    return models.balanced_weights(rows, "y")


def assembled(rows):
    return VectorAssembler(inputCols=["x0", "x1", "x2", "x3"], outputCol="features").transform(rows)


def grown(monkeypatch, rows, rows_of_a_task, **options):
    """The tree, and whether Spark's own fit was asked for."""
    asked = []
    monkeypatch.setattr(tree_growing, "ROWS_OF_A_TASK", rows_of_a_task)
    with monkeypatch.context() as patch:
        own = DecisionTreeClassifier._fit
        patch.setattr(DecisionTreeClassifier, "_fit", lambda self, df: (asked.append(1), own(self, df))[1])
        model = GrownTreeClassifier(labelCol="y", cacheNodeIds=True, seed=42, **options).fit(rows)
    return model, bool(asked)


@pytest.mark.parametrize("options", [{"maxDepth": 30}, {"maxDepth": 30, "weightCol": models.WEIGHT}, {"maxDepth": 6, "minInstancesPerNode": 4, "weightCol": models.WEIGHT}])
def test_the_tree_is_the_one_of_spark(spark, monkeypatch, options):
    rows = assembled(rows_of(spark, 3000)).persist()
    wanted = DecisionTreeClassifier(labelCol="y", cacheNodeIds=True, seed=42, **options).fit(rows)
    score = lambda m: sorted((r.id, r.prediction, tuple(r.probability)) for r in m.transform(rows).select("id", "prediction", "probability").collect())
    # By one task, and by passes with nodes of under 400 rows sent to tasks.
    for rows_of_a_task in (10**6, 400):
        model, by_spark = grown(monkeypatch, rows, rows_of_a_task, **options)
        assert not by_spark and model.numNodes == wanted.numNodes
        assert model.toDebugString.split("\n")[1:] == wanted.toDebugString.split("\n")[1:]
        assert model.featureImportances == wanted.featureImportances and score(model) == score(wanted)
    rows.unpersist()


def test_sampled_cut_points_are_the_same(spark, monkeypatch):
    rows = assembled(rows_of(spark, 24_000, 3)).persist()
    wanted = DecisionTreeClassifier(labelCol="y", maxDepth=7, weightCol=models.WEIGHT, seed=7).fit(rows)
    model, by_spark = grown(monkeypatch, rows, 9000, maxDepth=7, weightCol=models.WEIGHT)
    model = GrownTreeClassifier(labelCol="y", cacheNodeIds=True, maxDepth=7, weightCol=models.WEIGHT, seed=7).fit(rows)
    assert not by_spark and model.toDebugString.split("\n")[1:] == wanted.toDebugString.split("\n")[1:]
    rows.unpersist()


def test_what_is_not_covered_is_left_to_spark(spark, monkeypatch, tmp_path):
    rows = rows_of(spark, 300)
    plain = assembled(rows)
    assert not grown(monkeypatch, plain, 10**6, maxDepth=3)[1]
    assert grown(monkeypatch, assembled(rows.withColumn("y", F.col("id") % 3)), 10**6, maxDepth=3)[1]
    assert grown(monkeypatch, plain.withColumn("w", F.rand(1) + 1), 10**6, maxDepth=3, weightCol="w")[1]
    assert grown(monkeypatch, plain, 10**6, maxDepth=3, impurity="entropy")[1]
    with pytest.raises(Exception):
        grown(monkeypatch, assembled(rows.withColumn("x0", F.when(F.col("id") != 7, F.col("x0")))), 10**6, maxDepth=3)
    model, _ = grown(monkeypatch, plain, 10**6, maxDepth=4)
    model.save(str(tmp_path / "m"))
    assert type(model).load(str(tmp_path / "m")).toDebugString == model.toDebugString


def test_rows_of_a_task_are_a_byte_per_feature(spark):
    blocks = tree_growing._blocked(assembled(rows_of(spark, 5000, 2)), "features", "y", [np.arange(3.0), np.arange(9.0), np.arange(30.0), np.zeros(0)]).collect()
    assert {r.p for r in blocks} == {0, 1} and sum(r.n for r in blocks) == 5000
    assert all(len(r.bins) == 4 * r.n and len(r.y) == r.n for r in blocks)
