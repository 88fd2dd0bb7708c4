"""Steps whose work per row must not grow with the number of blocks, intervals or models."""

import random
import re

from pyspark.sql import functions as F

from flowsieve.operators import bayes_curves, boosting, models, quantiles
from flowsieve.plans.catalogue import training_queries


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_small_blocks_are_enlarged_in_large_tables(spark):
    rows = spark.range(700).select("id", F.array(F.rand(1), F.rand(2)).alias("x"), (F.col("id") % 2).cast("int").alias("y"))
    train, test = rows.where("id < 400"), rows.where("id >= 400")
    out = models.knn_predict(train, test, features="x", label="y", key="id", k=3, train_block=2, test_block=2)
    # Each side is repeated for at most so many blocks of the other; 200 and 150 before.
    last = [int(n) for n in re.findall(r"sequence\(0, (\d+)", out._jdf.queryExecution().analyzed().toString())]
    assert last == [models._BLOCKS - 1] * 2
    whole = models.knn_predict(train, test, features="x", label="y", key="id", k=3)
    assert sorted(out.collect()) == sorted(whole.collect())


def test_narrowing_meets_one_interval_a_row(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "_CELLS", 8)
    monkeypatch.setattr(quantiles, "_FINISH_ROWS", 10)
    rng = random.Random(4)
    df = spark.createDataFrame([(i % 2, rng.random()) for i in range(400)], "g int, v double")
    conditions, join = [], type(df).join
    monkeypatch.setattr(type(df), "join", lambda self, other, on=None, how=None: (conditions.append(str(on)), join(self, other, on, how))[1])
    quantiles.exact_quantiles(df, "v", [i / 16 for i in range(17)], ["g"]).collect()
    assert len(conditions) > 4 and not any("__lo" in c for c in conditions)


def test_landmark_products_bins_and_scores_are_no_row_loops(spark, sf_dir):
    assert "zip_with" not in plan(training_queries._landmarks(spark, sf_dir))
    values = [None, float("nan"), float("-inf"), float("inf"), -0.0, 0.0, 0.5, 1.0, 2.0]
    df = spark.createDataFrame([(v,) for v in values], "a double")
    binned = df.select(boosting.BoostedTrees(["a"], [[0.0, 0.5, 1.0]], 0.1).binned(df).alias("b"))
    assert "lambda" not in plan(binned) and [r.b[0] for r in binned.collect()] == [0, 3, 0, 3, 0, 0, 1, 2, 3]


def test_scores_of_many_models_are_counted_where_rows_are(spark):
    rows = spark.createDataFrame([(1, [0.0], 0, 0), (0, [2.0], 0, 1), (1, [None], 1, 0), (0, [float("nan")], 1, 0)], "label int, x array<double>, fold int, part int")
    classes = [(1, 0.0, (0.0,), (1.0,)), (0, 0.0, (2.0,), (1.0,))]
    found = bayes_curves.confusions(rows, [(0, 0, 4, classes), (0, 1, 4, classes)])
    got = {(r.step, r.fold, r.side, r.label, r.prediction): r.n for r in found.collect()}
    # A row without a usable value goes to the smallest class; the row of part 1 is in no training set of step 0.
    assert got == {
        (0, 0, "valid", 1, 1): 1, (0, 0, "valid", 0, 0): 1, (0, 0, "train", 1, 0): 1, (0, 0, "train", 0, 0): 1,
        (0, 1, "valid", 1, 0): 1, (0, 1, "valid", 0, 0): 1, (0, 1, "train", 1, 1): 1,
    }
    assert "MapInArrow" in plan(found)
