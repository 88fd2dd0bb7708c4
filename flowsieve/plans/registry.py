"""Registered detection methods: what they need, their locked parameters, and how to run them."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.operators import evaluation, models, sampling, selection
from flowsieve.operators.features import FLOW_DROPPED, prepare_flow_table
from flowsieve.plans.event_job import EVENT_METHODS
from flowsieve.session import cut_lineage

FLOW = "flow_table"

# Bounds of the parameters a user may change, and those always locked.
PARAM_BOUNDS: dict[str, tuple[float, float]] = {
    "n_estimators": (1, 500),
    "n_neighbors": (1, 100),
    "max_iter": (1, 20_000),
    "random_state": (0, 100_000),
    "max_depth": (1, 30),
    "n_rounds": (1, 500),
}
PROTECTED = (
    "models",
    "balancing",
    "scaler",
    "pca",
    "test_size",
    "stratify",
    "fs_sample_rows",
    "enforce_row_level_conversion_cap",
    "corr_leak_sample_rows",
    "modeling_train_rows",
    "visualization_sample_rows",
    "n_jobs",
    "cv_folds",
    "learning_curve_cv",
    "probability",
)
HARD_INT_CAP, HARD_FLOAT_CAP = 100_000, 1e6
TEST_SHARE = 0.3


class ParamError(ValueError):
    """An override that may not be applied."""


class Pipeline(Protocol):
    """What every detection method offers."""

    def run(self, df: DataFrame, **options: Any) -> MethodResult: ...

    def info(self) -> dict[str, Any]: ...


@dataclass(frozen=True)
class MethodResult:
    """Result tables of one run; ``model`` is the fitted Spark model."""

    metrics: DataFrame
    confusion: DataFrame
    report: DataFrame
    predictions: DataFrame
    model: Any
    features: list[str]
    importance: list[tuple[str, float]] = field(default_factory=list)
    auc: float = 0.5
    roc: DataFrame | None = None
    learning: DataFrame | None = None
    label_mapping: Mapping[int, str] = field(default_factory=lambda: {0: "Benign", 1: "Malicious"})


def _check_number(name: str, value: float) -> None:
    low, high = PARAM_BOUNDS.get(name, (-math.inf, math.inf))
    cap = HARD_INT_CAP if isinstance(value, int) else HARD_FLOAT_CAP
    if not math.isfinite(value):
        raise ParamError(f"{name} must be finite")
    if value < low or value > high or abs(value) > cap:
        raise ParamError(f"{name} = {value} is outside {low}..{high}")


def validate_override(name: str, value: Any, default: Any, choices: Sequence[str] = ()) -> Any:
    """The override itself when it has the default's type and stays in bounds."""
    if isinstance(default, bool):
        if not isinstance(value, bool):
            raise ParamError(f"{name} must be true or false")
        return value
    if isinstance(default, int):
        if isinstance(value, bool) or not isinstance(value, int):
            raise ParamError(f"{name} must be a whole number")
        _check_number(name, value)
        return value
    if isinstance(default, float):
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            raise ParamError(f"{name} must be a number")
        _check_number(name, float(value))
        return float(value)
    if choices:
        if value not in choices:
            raise ParamError(f"{name} must be one of {tuple(choices)}")
        return value
    raise ParamError(f"{name} cannot be changed")


def resolve_params(locked: Mapping[str, Any], overrides: Mapping[str, Any] | None) -> dict[str, Any]:
    """Locked values with validated overrides; unknown and protected names are refused."""
    out = dict(locked)
    for name, value in (overrides or {}).items():
        if name not in locked:
            raise ParamError(f"{name} is not a parameter of this method")
        if name in PROTECTED:
            raise ParamError(f"{name} is locked")
        out[name] = validate_override(name, value, locked[name])
    return out


Progress = Callable[[str], None]


@dataclass(frozen=True)
class FlowMethod:
    """Classifier on a flow-feature table: split 70/30 by class, prepare on train, fit, report."""

    id: str
    name: str
    model: str
    params: Mapping[str, Any]
    balanced: bool = False
    scaled: bool = False
    pca_share: float | None = None
    dataset_type: str = FLOW
    stages: tuple[str, ...] = ("Preprocessing", "Training", "Evaluating")

    def info(self) -> dict[str, Any]:
        return {
            "id": self.id,
            "name": self.name,
            "dataset_type": self.dataset_type,
            "algorithm": self.model,
            "fixed_params": dict(self.params),
            "train_test_split": f"{1 - TEST_SHARE:.0%}/{TEST_SHARE:.0%} stratified",
            "stages": list(self.stages),
        }

    def run(
        self,
        df: DataFrame,
        *,
        label: str,
        key: str,
        features: Sequence[str] | None = None,
        overrides: Mapping[str, Any] | None = None,
        progress: Progress | None = None,
        with_learning_curve: bool = False,
    ) -> MethodResult:
        """``key`` names a row key; all numeric columns but it are features by default.

        Predictions are kept with the session, so the model is applied once for all tables.  The learning
        curve takes a fit per fraction and fold and is made on request.
        """
        say = progress or (lambda stage: None)
        params = resolve_params(self.params, overrides)
        seed = params.get("random_state", 42)
        say("Preprocessing")
        if features is None:
            prepared = prepare_flow_table(df, label, dropped=(*FLOW_DROPPED, key))
            names = [c for c in prepared.columns if c != label]
        else:
            names = list(features)
        # Column names may hold dots, which ML stages read as nested fields.
        plain = {c: c.replace(".", "_") for c in names}
        rows = df.select(key, label, *[F.col(f"`{c}`").cast("double").alias(plain[c]) for c in names]).na.drop()
        inputs = [plain[c] for c in names]
        # Estimators pass over the data many times; they read the written split, not its plan.
        split = cut_lineage(sampling.stratified_split(rows, label=label, key=key, test_share=TEST_SHARE, seed=seed), "split")
        train = split.where(F.col("split") == sampling.TRAIN).drop("split")
        test = split.where(F.col("split") == sampling.TEST).drop("split")
        if self.balanced:
            train = sampling.undersample(train, label=label, key=key, seed=seed)
        say("Training")
        model, predictions = self._fit(train, test, inputs, label, key, params, seed)
        say("Evaluating")
        predictions = predictions.persist()
        learning = None
        if with_learning_curve:
            plain = self.model not in ("KNN", "RBF") and self.pca_share is None
            make = (lambda n: self._pipeline(inputs, label, params, seed, n)) if plain else None
            predict = None if plain else lambda part, rows: self._fit(part, rows, inputs, label, key, params, seed)[1]
            learning = models.learning_curve(train, make, label=label, key=key, predict=predict, seed=seed)
        return MethodResult(
            metrics=evaluation.weighted_metrics(predictions, label, "prediction"),
            confusion=evaluation.confusion_counts(predictions, label, "prediction"),
            report=evaluation.classification_report(predictions, label, "prediction"),
            predictions=predictions,
            model=model,
            features=names,
            importance=[] if model is None or self.model in ("KNN", "RBF") else models.feature_importance(model, names),
            auc=evaluation.roc_auc(predictions, label, "score").first()["auc"],
            roc=evaluation.roc_curve(predictions, label, "score"),
            learning=learning,
        )

    def _pipeline(self, inputs, label, params, seed, rows):
        sizes = {"trees": params.get("n_estimators"), "depth": params.get("max_depth"), "max_iter": params.get("max_iter")}
        over = {k: v for k, v in sizes.items() if v is not None}
        return models.build_pipeline(self.model, inputs, label=label, seed=seed, scaled=self.scaled, weighted=False, rows=rows, **over)

    def _fit(self, train, test, inputs, label, key, params, seed):
        if self.model == "KNN":
            return _fit_knn(train, test, inputs, label, key, params["n_neighbors"])
        if self.model == "RBF":
            fitted = models.fit_rbf_svc_approx(train, inputs, label=label, seed=seed)
            return fitted, fitted.transform(test)
        if self.pca_share is None:
            pipeline = self._pipeline(inputs, label, params, seed, train.count())
            return models.fit_predict(pipeline, train, test, label=label, weighted=False)
        over = {"max_iter": params["max_iter"]} if "max_iter" in params else {}
        projection, k = selection.fit_pca_share(train, inputs, self.pca_share)
        estimator = models.build_model(self.model, label=label, seed=seed, weighted=False, rows=train.count(), **over)
        fitted = estimator.fit(selection.take_components(projection.transform(train), k))
        scored = fitted.transform(selection.take_components(projection.transform(test), k))
        return fitted, models.with_score(scored).withColumn("prediction", F.col("prediction").cast("int"))


def _fit_knn(train, test, inputs, label, key, k):
    from pyspark.ml import Pipeline as Stages
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    scaler = Stages(
        stages=[
            VectorAssembler(inputCols=inputs, outputCol="assembled"),
            StandardScaler(inputCol="assembled", outputCol="scaled", withMean=True, withStd=True),
        ]
    ).fit(train)

    def points(df):
        return scaler.transform(df).select(key, label, vector_to_array("scaled").alias("x"))

    out = models.knn_predict(points(train), points(test), features="x", label=label, key=key, k=k)
    return scaler, out.join(test.select(key, label), key)


METHODS: dict[str, Any] = {
    m.id: m
    for m in (
        *EVENT_METHODS,
        FlowMethod("flow.forest", "Random forest, balanced", "RFC", {"n_estimators": 100, "max_depth": 16, "random_state": 42}, balanced=True, scaled=True),
        FlowMethod("flow.tree", "Decision tree", "DT", {"max_depth": 30, "random_state": 42}),
        FlowMethod("flow.knn", "k nearest neighbours, balanced", "KNN", {"n_neighbors": 5, "random_state": 42}, balanced=True, scaled=True),
        FlowMethod("flow.rbf_svc", "RBF support vectors, approximated", "RBF", {"random_state": 42}, scaled=True),
        FlowMethod("flow.naive_bayes", "Gaussian naive Bayes", "NB", {}),
        FlowMethod("flow.logistic", "Logistic regression on components", "LR", {"max_iter": 3_000, "random_state": 42}, scaled=True, pca_share=0.95),
    )
}


def register(method: Any) -> None:
    if method.id in METHODS:
        raise ValueError(f"method {method.id} exists already")
    METHODS[method.id] = method


def get(method_id: str) -> Any:
    if method_id not in METHODS:
        raise KeyError(f"unknown method {method_id}")
    return METHODS[method_id]


def for_dataset(dataset_type: str) -> dict[str, Any]:
    return {k: m for k, m in METHODS.items() if m.dataset_type == dataset_type}
