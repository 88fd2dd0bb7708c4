import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsieve.operators import bayes_curves, boosting


def rows_of(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        y = rng.randint(0, 1)
        out.append((f"k{i}", y, rng.gauss(2.0 * y, 1), rng.gauss(0, 1), float(rng.randint(0, 3))))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "key string, y int, a double, b double, c double")


def test_moments_merge_to_those_of_all_rows():
    rng = np.random.default_rng(1)
    parts = [rng.normal(1e6, 1, (n, 3)) for n in (5, 1, 40)]
    of = lambda x: bayes_curves.Moments(len(x), tuple(x.mean(0)), tuple(((x - x.mean(0)) ** 2).sum(0)))
    merged, whole = of(parts[0]) + of(parts[1]) + of(parts[2]), of(np.concatenate(parts))
    assert merged.n == whole.n
    assert merged.mean == pytest.approx(whole.mean, rel=1e-14) and merged.squares == pytest.approx(whole.squares, rel=1e-6)


def test_curve_against_a_model_per_training_set(spark):
    df = frame(spark, rows_of(300, 2))
    names, fractions = ["a", "b", "c"], (0.3, 1.0)
    rows = bayes_curves.folded_rows(df, names, "y", "key", 3, fractions, 42).collect()
    scores = {}
    for step, fraction in enumerate(fractions):
        for fold in range(3):
            train = [r for r in rows if r.fold != fold and r.part <= step]
            x, y = np.array([r.x for r in train]), np.array([r.label for r in train])
            wide = 1e-9 * x.var(axis=0, ddof=1).max()
            model = {c: (np.log((y == c).mean()), x[y == c].mean(0), x[y == c].var(0) + wide) for c in (0, 1)}
            for side, some in (("train", train), ("valid", [r for r in rows if r.fold == fold])):
                guess = []
                for r in some:
                    post = {c: p - 0.5 * np.log(v).sum() - ((np.array(r.x) - m) ** 2 / (2 * v)).sum() for c, (p, m, v) in model.items()}
                    guess.append(max(post, key=post.get))
                truth = np.array([r.label for r in some])
                guess = np.array(guess)
                f1 = [2 * ((truth == c) & (guess == c)).sum() / ((truth == c).sum() + (guess == c).sum()) * (truth == c).mean() for c in (0, 1)]
                scores.setdefault((fraction, side), []).append(sum(f1))
    found = {r.fraction: r for r in bayes_curves.bayes_curve(df, names, label="y", key="key", folds=3, fractions=fractions).collect()}
    for fraction in fractions:
        for side in ("train", "valid"):
            assert found[fraction][f"{side}_mean"] == pytest.approx(np.mean(scores[fraction, side]), abs=1e-12)
            assert found[fraction][f"{side}_std"] == pytest.approx(np.std(scores[fraction, side]), abs=1e-12)


def test_a_class_missing_from_a_training_set(spark):
    df = frame(spark, [("x", 1, 5.0, 0.0, 0.0)] + [(f"k{i}", 0, float(i), 0.0, 0.0) for i in range(11)])
    found = bayes_curves.bayes_folds(df, ["a", "b", "c"], label="y", key="key", folds=3).collect()
    assert sum(r.tp + r.fn + r.fp + r.tn for r in found) == 12


def test_boosted_trees_learn_and_do_not_depend_on_partitions(spark):
    df = frame(spark, rows_of(600, 3))
    fitted = [boosting.fit_boosted_trees(d, ["a", "b", "c"], label="y", key="key", rounds=12, depth=3) for d in (df, df.repartition(7, "c"))]
    assert [sorted(t) for t in fitted[0].trees] == [sorted(t) for t in fitted[1].trees]
    a, b = ({r.key: r.margin for r in m.transform(df).collect()} for m in fitted)
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)
    right = fitted[0].transform(df).agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0]
    assert right > 0.8
    assert fitted[0].gains()[0][0] == "a"


def test_one_tree_against_all_splits(spark):
    rows = rows_of(200, 4)
    df = frame(spark, rows)
    model = boosting.fit_boosted_trees(df, ["a", "b", "c"], label="y", key="key", rounds=1, depth=1, row_share=2.0, column_share=1.0, bins=8)
    y, x = np.array([r[1] for r in rows]), np.array([r[2:] for r in rows])
    g, h = 0.5 - y, np.full(len(y), 0.25)
    part = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
    every = np.ones(len(y), bool)
    gains = {(f, e): 0.5 * (part(x[:, f] <= e) + part(x[:, f] > e) - part(every)) for f in range(3) for e in model.edges[f] if (x[:, f] > e).any()}
    (f, e), gain = max(gains.items(), key=lambda p: p[1])
    _, feature, bin_, found = model.trees[0][1]
    assert (feature, found) == (f, pytest.approx(gain, abs=1e-6)) and model.edges[f][bin_] == e
    left = x[:, f] <= e
    assert model.trees[0][2][1] == pytest.approx(-0.1 * g[left].sum() / (h[left].sum() + 1))


def test_boosting_without_rows_or_values(spark):
    df = frame(spark, rows_of(5, 5))
    model = boosting.fit_boosted_trees(df.limit(0), ["a"], label="y", key="key", rounds=2)
    assert {r.score for r in model.transform(df).collect()} == {0.5}
    holes = frame(spark, [("p", None, 1.0, 1.0, 1.0), ("q", 1, None, None, float("nan")), *rows_of(60, 6)])
    model = boosting.fit_boosted_trees(holes, ["a", "b", "c"], label="y", key="key", rounds=2, depth=2)
    assert model.transform(holes).where("margin IS NULL").count() == 0


def test_landmark_map_is_exact_at_landmarks_and_close_elsewhere(spark):
    from flowsieve.operators import kernel_map

    df = frame(spark, rows_of(250, 7)).withColumn("flat", F.lit(3.0))
    names = ["a", "b", "flat"]
    exact = kernel_map.fit_landmarks(df, names, key="key", size=250)
    close = kernel_map.fit_landmarks(df, names, key="key", size=60)
    x = np.array([[r.a, r.b, r.flat] for r in df.collect()])
    z = (x - x.mean(0)) / np.where(x.std(0, ddof=1) > 0, x.std(0, ddof=1), 1)
    kernel = np.exp(-((z[:, None] - z[None]) ** 2).sum(2) / 3)
    errors = []
    for found in (close, kernel_map.fit_landmarks(df, names, key="key", size=150), exact):
        mapped = found.kernel(x) @ found.root
        # What a row's mapped length lacks of 1 bounds its errors.
        lacking = 1 - (mapped**2).sum(1)
        errors.append(np.abs(mapped @ mapped.T - kernel))
        assert (errors[-1] <= np.sqrt(np.outer(lacking.clip(0), lacking.clip(0))) + 1e-4).all()
    assert errors[0].max() < 0.2 and errors[0].mean() < 0.002
    assert errors[0].max() > errors[1].max() > errors[2].max() and errors[2].max() < 1e-4
    assert len(close.landmarks) == 60
    collected = {r.key: r.m for r in df.select("key", close.mapped().alias("m")).collect()}
    assert np.array(collected["k3"]) == pytest.approx(close.kernel(x[3:4])[0] @ close.root)


def test_landmark_svc_separates_a_ring(spark):
    from flowsieve.operators import kernel_map

    rng = random.Random(8)
    rows = []
    for i in range(300):
        angle, y = rng.uniform(0, 6.283), i % 2
        far = rng.uniform(2.0, 3.0) if y else rng.uniform(0.0, 1.0)
        rows.append((f"k{i}", y, far * np.cos(angle), far * np.sin(angle), 0.0))
    df = frame(spark, [(k, y, float(a), float(b), c) for k, y, a, b, c in rows])
    model = kernel_map.fit_landmark_svc(df, ["a", "b"], label="y", key="key", size=40, max_iter=30)
    scored = model.transform(df).select("y", "prediction", "score").collect()
    assert sum(r.prediction == r.y for r in scored) > 290
    assert all(0 <= r.score <= 1 for r in scored)
    assert np.mean([r.score for r in scored if r.y]) > 0.85 > 0.15 > np.mean([r.score for r in scored if not r.y])


def test_learning_curve_of_any_method(spark, monkeypatch):
    from flowsieve.operators import models
    from flowsieve.plans import registry

    df = frame(spark, rows_of(80, 9))
    seen = []

    def predict(part, rows):
        seen.append(part.count())
        return rows.withColumn("prediction", (F.col("a") > 1).cast("int"))

    curve = models.learning_curve(df, None, label="y", key="key", predict=predict, fractions=(0.5, 1.0), folds=2).collect()
    assert [r.fraction for r in sorted(curve)] == [0.5, 1.0] and all(r.valid_mean > 0.7 for r in curve) and len(seen) == 8
    given = {}
    monkeypatch.setattr(models, "learning_curve", lambda train, make, **options: given.update(make=make, **options))
    method = registry.get("flow.knn")
    method.run(df, label="y", key="key", features=["a", "b"], with_learning_curve=True)
    assert given["make"] is None
    assert {"score", "prediction"} <= set(given["predict"](df, df).columns)


def test_one_task_and_many_fit_the_same_boosted_trees(spark, monkeypatch):
    df = frame(spark, rows_of(500, 9)).repartition(3)
    options = {"label": "y", "key": "key", "rounds": 7, "depth": 3}
    alone = boosting.fit_boosted_trees(df, ["a", "b", "c"], **options)
    monkeypatch.setattr(boosting, "ROWS_OF_A_TASK", 0)
    spread = boosting.fit_boosted_trees(df, ["a", "b", "c"], **options)
    assert len(alone.trees) == 7
    for one, other in zip(alone.trees, spread.trees):
        assert one.keys() == other.keys()
        for node, entry in one.items():
            assert entry[:-1] == other[node][:-1] and entry[-1] == pytest.approx(other[node][-1], abs=1e-9)


def test_boosting_runs_all_locked_rounds(spark, sf_dir, monkeypatch):
    from flowsieve.plans.catalogue import load_catalogue, training_queries

    asked = []
    monkeypatch.setattr(boosting, "fit_boosted_trees", lambda df, features, rounds=boosting.ROUNDS, **_: (asked.append(rounds), boosting.BoostedTrees(list(features), [[] for _ in features], 0.1))[1])
    query = load_catalogue()["j13_second_order_boosting"]
    query.run(spark, sf_dir)
    assert asked == [boosting.ROUNDS] == [150]
    assert f"r < {boosting.ROUNDS}" in query.sql and training_queries._all_rounds_sql(2) != query.sql


def test_many_rounds_are_few_jobs(spark):
    df = frame(spark, rows_of(300, 8)).persist()
    spark.sparkContext.setJobGroup("boosting", "boosting")
    boosting.fit_boosted_trees(df, ["a", "b", "c"], label="y", key="key", rounds=20)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("boosting"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    df.unpersist()
    # A job per level would be over a hundred.
    assert jobs < 40


def test_hashes_of_arrays_equal_those_of_columns(spark):
    import pyarrow as pa

    from flowsieve.functions.digests import seeded_hashes
    from flowsieve.functions.hashing import seeded_hash60

    texts = ["", "a", None, "é" * 10, *["x" * n for n in (50, 51, 52, 53, 70)], *[f"{i}-k" for i in range(30)]]
    seeds = [3, 42, 99, 100, 191]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    wanted = rows.orderBy("i").select(*[seeded_hash60(s, F.col("t")) for s in seeds]).collect()
    assert seeded_hashes(pa.array(texts), seeds).T.tolist() == [list(r) for r in wanted]
    assert seeded_hashes(pa.array(texts)[2:9], [7]).tolist() == [seeded_hashes(pa.array(texts), [7])[0, 2:9].tolist()]
