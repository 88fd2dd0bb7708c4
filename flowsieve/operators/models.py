"""Classifiers, cross-validation and learning curves on Spark ML."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.base import Estimator, Model
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.hashing import seeded_hash60
from flowsieve.operators import evaluation
from flowsieve.operators.sampling import stratified_folds
from flowsieve.operators.tree_growing import GrownTreeClassifier
from flowsieve.session import cut_lineage

WEIGHT = "class_weight"

# Locked hyper-parameters.
FOREST_TREES, FOREST_DEPTH, FOREST_MIN_LEAF = 100, 16, 2
BOOST_ROUNDS, BOOST_DEPTH, BOOST_STEP, BOOST_SUBSAMPLE, BOOST_COLUMNS = 150, 6, 0.1, 0.8, "0.8"
LINEAR_MAX_ITER, LOGISTIC_MAX_ITER, NEIGHBOURS = 5_000, 3_000, 5
# Spark's own limit; an unlimited tree does not exist there.
TREE_DEPTH = 30
# Deep trees keep each row's node with the row: otherwise every pass ships the trees grown so far to every task and
# walks them from the root.  The trees are the same.  Shallow ones, as in boosting, gain nothing by it.
CACHE_NODES = True

SCALED_MODELS = ("LSVC", "LR", "KNN")


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """Class weight n / (classes * class size) per row; the counts are the only action."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    weight = F.lit(1.0)
    for value, n in counts.items():
        weight = F.when(F.col(label) == value, F.lit(total / (len(counts) * n))).otherwise(weight)
    return df.withColumn(WEIGHT, weight)


def build_model(name: str, *, label: str, seed: int = 42, features: str = "features", weighted: bool = True, rows: int | None = None, **over) -> Estimator:
    """Unfitted estimator by short name; keyword overrides replace the locked values."""
    common = {"labelCol": label, "featuresCol": features}
    weight = {"weightCol": WEIGHT} if weighted else {}
    if name == "DT":
        return GrownTreeClassifier(maxDepth=over.get("depth", TREE_DEPTH), cacheNodeIds=CACHE_NODES, seed=seed, **common, **weight)
    if name == "RFC":
        return RandomForestClassifier(
            numTrees=over.get("trees", FOREST_TREES),
            maxDepth=over.get("depth", FOREST_DEPTH),
            minInstancesPerNode=over.get("min_leaf", FOREST_MIN_LEAF),
            cacheNodeIds=CACHE_NODES,
            seed=seed,
            **common,
            **weight,
        )
    if name == "LSVC":
        return LinearSVC(maxIter=over.get("max_iter", LINEAR_MAX_ITER), regParam=1.0 / max(1, rows or 1), standardization=False, **common, **weight)
    if name == "XGB":
        return GBTClassifier(
            maxIter=over.get("rounds", BOOST_ROUNDS),
            maxDepth=over.get("depth", BOOST_DEPTH),
            stepSize=BOOST_STEP,
            subsamplingRate=BOOST_SUBSAMPLE,
            featureSubsetStrategy=BOOST_COLUMNS,
            seed=seed,
            **common,
        )
    if name == "NB":
        return NaiveBayes(modelType="gaussian", **common)
    if name == "LR":
        return LogisticRegression(
            maxIter=over.get("max_iter", LOGISTIC_MAX_ITER), regParam=1.0 / max(1, rows or 1), standardization=False, **common
        )
    raise ValueError(f"unknown model {name!r}")


def build_pipeline(name: str, feature_names: Sequence[str], *, label: str, scaled: bool | None = None, components: int | None = None, **kwargs) -> Pipeline:
    """Assemble, optionally scale and project, then classify; all fitted on train only."""
    from pyspark.ml.feature import PCA

    stages: list = [VectorAssembler(inputCols=list(feature_names), outputCol="assembled")]
    last = "assembled"
    if components or (name in SCALED_MODELS if scaled is None else scaled):
        stages.append(StandardScaler(inputCol=last, outputCol="scaled", withMean=True, withStd=True))
        last = "scaled"
    if components:
        stages.append(PCA(k=components, inputCol=last, outputCol="projected"))
        last = "projected"
    stages.append(build_model(name, label=label, features=last, **kwargs))
    return Pipeline(stages=stages)


def with_score(predictions: DataFrame) -> DataFrame:
    """Attack score: the class-1 probability, or the raw margin where there is none."""
    if "score" in predictions.columns:
        return predictions
    source = "probability" if "probability" in predictions.columns else "rawPrediction"
    return predictions.withColumn("score", vector_to_array(source).getItem(1))


def fit_predict(pipeline: Pipeline, train: DataFrame, test: DataFrame, *, label: str, weighted: bool = True) -> tuple[PipelineModel, DataFrame]:
    model = pipeline.fit(balanced_weights(train, label) if weighted else train)
    return model, with_score(model.transform(test)).withColumn("prediction", F.col("prediction").cast("int"))


def score_metrics(predictions: DataFrame, label: str) -> dict[str, float]:
    """Attack-class metrics and AUC of one prediction table as numbers; the model is applied once."""
    narrow = predictions.select(label, "prediction", "score").persist()
    counts = evaluation.attack_metrics(narrow, label, "prediction").first().asDict()
    auc = evaluation.roc_auc(narrow, label, "score").first()["auc"]
    narrow.unpersist()
    return {**{m: counts[m] for m in evaluation.METRICS if m in counts}, "auc": auc}


def cross_validate(df: DataFrame, make: Callable[[int], Pipeline], *, label: str, key: str, folds: int = 2, seed: int = 42, weighted: bool = True) -> DataFrame:
    """Stratified k-fold metrics, one row per fold.  ``make`` gets the number of rows it will be fitted on."""
    folded = stratified_folds(df, label=label, key=key, folds=folds, seed=seed).persist()
    rows = []
    for fold in range(folds):
        train, valid = folded.where(F.col("fold") != fold), folded.where(F.col("fold") == fold)
        _, predictions = fit_predict(make(train.count()), train, valid, label=label, weighted=weighted)
        metrics = score_metrics(predictions, label)
        rows.append((fold, *[float(metrics[m]) for m in evaluation.METRICS]))
    folded.unpersist()
    schema = "fold int, " + ", ".join(f"{m} double" for m in evaluation.METRICS)
    return df.sparkSession.createDataFrame(rows, schema)


def learning_curve(
    df: DataFrame,
    make: Callable[[int], Pipeline] | None,
    *,
    label: str,
    key: str,
    predict: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
    fractions: Sequence[float] = (0.2, 0.4, 0.6, 0.8, 1.0),
    folds: int = 5,
    seed: int = 42,
    weighted: bool = False,
) -> DataFrame:
    """Weighted F1 on train prefix and validation fold per fraction, mean and deviation.

    A fraction keeps the rows whose seeded hash lies in its prefix of the hash range, so
    smaller training sets are subsets of larger ones.  ``predict`` takes the place of ``make`` for methods that are
    no pipeline: it gets training rows and rows to score.
    """
    folded = stratified_folds(df, label=label, key=key, folds=folds, seed=seed).persist()
    position = seeded_hash60(seed + 1, F.col(key)) / F.lit(float(2**60))
    rows = []
    for fraction in fractions:
        for fold in range(folds):
            pool, valid = folded.where(F.col("fold") != fold), folded.where(F.col("fold") == fold)
            part = pool.where(position < fraction)
            n = part.count()
            if predict:
                on_train, on_valid = predict(part, part), predict(part, valid)
            else:
                model, on_valid = fit_predict(make(n), part, valid, label=label, weighted=weighted)
                on_train = model.transform(part).withColumn("prediction", F.col("prediction").cast("int"))
            scores = [
                float(evaluation.weighted_metrics(p, label, "prediction").first()["f1"]) for p in (on_train, on_valid)
            ]
            rows.append((fraction, fold, n, *scores))
    folded.unpersist()
    per_fold = df.sparkSession.createDataFrame(
        rows, "fraction double, fold int, train_rows bigint, train_f1 double, valid_f1 double"
    )
    return per_fold.groupBy("fraction").agg(
        F.avg("train_rows").alias("train_rows"),
        F.avg("train_f1").alias("train_mean"),
        F.stddev_pop("train_f1").alias("train_std"),
        F.avg("valid_f1").alias("valid_mean"),
        F.stddev_pop("valid_f1").alias("valid_std"),
    )


def feature_importance(model: PipelineModel | Model, feature_names: Sequence[str]) -> list[tuple[str, float]]:
    """Tree importances or absolute coefficients, highest first; none after a projection."""
    from pyspark.ml.feature import PCAModel

    stages = model.stages if isinstance(model, PipelineModel) else [model]
    if any(isinstance(s, PCAModel) for s in stages):
        return []
    last = stages[-1]
    if hasattr(last, "featureImportances"):
        values = last.featureImportances.toArray()
    elif hasattr(last, "coefficients"):
        values = np.abs(last.coefficients.toArray())
    else:
        return []
    if len(values) != len(feature_names):
        return []
    return sorted(((n, round(float(v), 6)) for n, v in zip(feature_names, values)), key=lambda p: (-p[1], p[0]))


def importance_table(spark, importance: Sequence[tuple[str, float]]) -> DataFrame:
    return spark.createDataFrame(list(importance), "feature string, importance double")


# --- k nearest neighbours -------------------------------------------------------------

_DISTANCE_DECIMALS = 9
# Blocks of a side are enlarged, up to a size one task can hold, rather than becoming more than this.
_BLOCKS, _LARGEST_BLOCK = 16, 20_000
_TEST_ROWS_AT_ONCE = 512


def _nearest(test: pd.DataFrame, train: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` nearest training rows of one block for every row of one test block."""
    if test.empty or train.empty:
        return pd.DataFrame({"key": [], "near": []})
    points = np.stack(train["x"].to_numpy())
    norms = np.einsum("ij,ij->i", points, points)
    keys, classes = train["key"].to_numpy(), train["label"].to_numpy()
    out_keys, out = [], []
    for start in range(0, len(test), _TEST_ROWS_AT_ONCE):
        part = test.iloc[start : start + _TEST_ROWS_AT_ONCE]
        queries = np.stack(part["x"].to_numpy())
        squared = np.einsum("ij,ij->i", queries, queries)[:, None] + norms[None, :] - 2.0 * (queries @ points.T)
        kth = min(k, squared.shape[1]) - 1
        # Everything as near as the k-th is a candidate, so that ties are decided by key; a row has at most ``most``.
        limit = np.partition(squared, kth, axis=1)[:, kth, None] + 1e-9
        most = int((squared <= limit).sum(axis=1).max())
        chosen = np.argpartition(squared, min(most, squared.shape[1]) - 1, axis=1)[:, :most]
        exact = np.sqrt(((points[chosen] - queries[:, None, :]) ** 2).sum(axis=2)).round(_DISTANCE_DECIMALS)
        order = np.lexsort((keys[chosen], exact), axis=1)[:, :k]
        chosen, exact = np.take_along_axis(chosen, order, 1), np.take_along_axis(exact, order, 1)
        out_keys += part["key"].tolist()
        near_keys, near_classes = keys[chosen].tolist(), classes[chosen].tolist()
        out += [
            [{"distance": d, "key": n, "label": int(c)} for d, n, c in zip(*row)]
            for row in zip(exact.tolist(), near_keys, near_classes)
        ]
    return pd.DataFrame({"key": out_keys, "near": out})


def knn_predict(
    train: DataFrame,
    test: DataFrame,
    *,
    features: str,
    label: str,
    key: str,
    k: int = NEIGHBOURS,
    train_block: int = 20_000,
    test_block: int = 20_000,
) -> DataFrame:
    """Exact k nearest neighbours by majority vote; ties by distance, then training key.

    Both sides are hashed into blocks of bounded size and every test block meets every
    train block in one task of a cogrouped grid.  A task keeps k candidates per test row,
    so no pair is ever emitted and nothing is broadcast; the candidates of the blocks are
    merged per test row.
    """
    kind = dict(train.dtypes)[key]
    n_train, n_test = train.count(), test.count()
    # Each side is repeated for every block of the other, so small blocks of large tables would move most of the data.
    train_block, test_block = (max(b, min(math.ceil(n / _BLOCKS), _LARGEST_BLOCK)) for b, n in ((train_block, n_train), (test_block, n_test)))
    columns, rows = max(1, math.ceil(n_train / train_block)), max(1, math.ceil(n_test / test_block))
    block = lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    left = test.select(F.col(key).alias("key"), F.col(features).cast("array<double>").alias("x"), block(rows).alias("i")).withColumn(
        "j", F.explode(F.sequence(F.lit(0), F.lit(columns - 1)))
    )
    right = train.select(
        F.col(key).alias("key"), F.col(features).cast("array<double>").alias("x"), F.col(label).cast("int").alias("label"), block(columns).alias("j")
    ).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _nearest(a, b, k)

    near = f"array<struct<distance:double,key:{kind},label:int>>"
    partial = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(meet, f"key {kind}, near {near}")
    # At most k candidates per train block and test row.
    merged = partial.groupBy("key").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    votes = F.aggregate("near", F.lit(0), lambda acc, x: acc + x["label"])
    return merged.select(
        F.col("key").alias(key),
        "near",
        (votes / F.size("near")).alias("score"),
        (votes * 2 > F.size("near")).cast("int").alias("prediction"),
    )


# --- RBF support vectors, approximated ------------------------------------------------


@dataclass(frozen=True)
class RbfSvcApprox:
    """Fitted random-feature SVC: scaler, linear margin and probability calibration."""

    scaler: PipelineModel
    frequencies: np.ndarray
    phases: np.ndarray
    linear: Model
    calibration: Model

    def transform(self, df: DataFrame) -> DataFrame:
        mapped = _fourier(self.scaler.transform(df), self.frequencies, self.phases)
        scored = self.linear.transform(mapped).withColumn("prediction", F.col("prediction").cast("int"))
        margin = scored.withColumn("margin", array_to_vector(F.array(vector_to_array("rawPrediction").getItem(1))))
        out = self.calibration.transform(margin.drop("rawPrediction", "probability"))
        return out.withColumn("score", vector_to_array("probability").getItem(1)).drop(
            "assembled", "scaled", "fourier", "margin", "rawPrediction", "probability", "calibrated"
        )


def _fourier(df: DataFrame, frequencies: np.ndarray, phases: np.ndarray) -> DataFrame:
    """Random Fourier features of the scaled vector, Arrow batches at a time."""
    scale = math.sqrt(2.0 / len(phases))

    @F.pandas_udf("array<double>")
    def project(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            values = scale * np.cos(np.stack(x.to_numpy()) @ frequencies + phases)
            yield pd.Series(list(values))

    return df.withColumn("fourier", array_to_vector(project(vector_to_array("scaled"))))


def fit_rbf_svc_approx(
    train: DataFrame, feature_names: Sequence[str], *, label: str, seed: int = 42, size: int = 256, gamma: float | None = None, max_iter: int = 100
) -> RbfSvcApprox:
    """RBF-kernel SVC approximated by random Fourier features and a linear SVC.

    The kernel method itself needs all row pairs.  With ``gamma`` left out, 1 / features is
    used: on scaled data that equals the usual variance-based choice.
    """
    scaler = Pipeline(
        stages=[
            VectorAssembler(inputCols=list(feature_names), outputCol="assembled"),
            StandardScaler(inputCol="assembled", outputCol="scaled", withMean=True, withStd=True),
        ]
    ).fit(train)
    rng = np.random.default_rng(seed)
    gamma = gamma or 1.0 / len(feature_names)
    frequencies = rng.normal(0.0, math.sqrt(2.0 * gamma), (len(feature_names), size))
    phases = rng.uniform(0.0, 2.0 * math.pi, size)
    # A mapped row is many times as wide as its features, so it is mapped again when needed; the machine keeps its own blocks.
    mapped = _fourier(scaler.transform(train), frequencies, phases)
    rows = train.count()
    linear = LinearSVC(featuresCol="fourier", labelCol=label, regParam=1.0 / max(1, rows), maxIter=max_iter, standardization=False).fit(mapped)
    margins = linear.transform(mapped).select(F.col(label), F.slice(vector_to_array("rawPrediction"), 2, 1).alias("margin"))
    margins = cut_lineage(margins, "margins").select(label, array_to_vector("margin").alias("margin"))
    calibration = LogisticRegression(featuresCol="margin", labelCol=label, predictionCol="calibrated", maxIter=100).fit(margins)
    return RbfSvcApprox(scaler, frequencies, phases, linear, calibration)
