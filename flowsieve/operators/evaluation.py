"""Metrics of scored predictions, from counts to verdicts.

Inputs are prediction tables with a 0/1 label, a 0/1 prediction and a score.  Everything
starts with one small aggregate; no prediction row reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.operators.allocate import running_totals

METRICS = ("accuracy", "precision_attack", "recall_attack", "f1_attack", "auc")

# Order in which metrics decide the best combination.
BEST_METRIC_ORDER = (
    "natural_holdout_f1_attack",
    "natural_holdout_auc",
    "natural_holdout_recall_attack",
    "natural_holdout_precision_attack",
    "natural_holdout_accuracy",
    "balanced_holdout_f1_attack",
    "balanced_holdout_auc",
    "balanced_holdout_recall_attack",
    "balanced_holdout_precision_attack",
    "balanced_holdout_accuracy",
    "holdout_f1_attack",
    "holdout_auc",
    "f1_attack",
    "auc",
    "holdout_accuracy",
    "accuracy",
)
# Metric at or above this is suspiciously perfect.
NEAR_PERFECT = 0.999
NEAR_PERFECT_ORDER = (
    "natural_holdout_f1_attack",
    "natural_holdout_auc",
    "balanced_holdout_f1_attack",
    "balanced_holdout_auc",
    "holdout_f1_attack",
    "holdout_auc",
    "f1_attack",
    "auc",
    "accuracy",
)
# Lower bounds of the excellent, good and attention bands.
VERDICT_BANDS = {
    "recall": (0.95, 0.85, 0.60),
    "precision": (0.90, 0.75, 0.50),
    "f1": (0.90, 0.75, 0.55),
    "auc": (0.90, 0.80, 0.70),
}


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _f1(precision: Column, recall: Column) -> Column:
    return F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))


def confusion_counts(predictions: DataFrame, label: str, prediction: str, group: Sequence[str] = ()) -> DataFrame:
    """Four rows per group, (0,0) to (1,1), with zeros for pairs that never occur."""
    cell = lambda a, p: F.count_if((F.col(label) == a) & (F.col(prediction) == p))
    cells = [(a, p) for a in (0, 1) for p in (0, 1)]
    wide = predictions.groupBy(*group).agg(*[cell(a, p).alias(f"c{a}{p}") for a, p in cells])
    entries = F.array(
        *[F.struct(F.lit(a).alias(label), F.lit(p).alias(prediction), F.col(f"c{a}{p}").alias("n")) for a, p in cells]
    )
    return wide.select(*group, F.explode(entries).alias("x")).select(*group, f"x.{label}", f"x.{prediction}", "x.n")


def _matrix(predictions: DataFrame, label: str, prediction: str, group: Sequence[str] = ()) -> DataFrame:
    y, p = F.col(label) == 1, F.col(prediction) == 1
    return predictions.groupBy(*group).agg(
        F.count_if(y & p).alias("tp"),
        F.count_if(y & ~p).alias("fn"),
        F.count_if(~y & p).alias("fp"),
        F.count_if(~y & ~p).alias("tn"),
    )


def attack_metrics(predictions: DataFrame, label: str, prediction: str, group: Sequence[str] = ()) -> DataFrame:
    """Accuracy and attack-class precision, recall and F1; an empty denominator gives 0."""
    m = _matrix(predictions, label, prediction, group)
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    return (
        m.withColumns(
            {
                "accuracy": _share(tp + tn, tp + tn + fp + fn),
                "precision_attack": _share(tp, tp + fp),
                "recall_attack": _share(tp, tp + fn),
            }
        )
        .withColumn("f1_attack", _f1(F.col("precision_attack"), F.col("recall_attack")))
    )


def per_class_metrics(predictions: DataFrame, label: str, prediction: str) -> DataFrame:
    """Precision, recall, F1 and support of every class seen as label or prediction.

    Counting (label, prediction) pairs first leaves a tiny table; each pair then feeds the
    class it belongs to and the class it was taken for.
    """
    pairs = predictions.groupBy(F.col(label).alias("a"), F.col(prediction).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = F.array(
        F.struct(F.col("a").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                 F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(F.lit(0)).cast("bigint").alias("hit")),
        F.struct(F.col("p").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"),
                 F.lit(0).cast("bigint").alias("hit")),
    )
    totals = pairs.select(F.explode(sides).alias("x")).select("x.*").groupBy("class").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hit").alias("hit")
    )
    return totals.select(
        "class",
        _share(F.col("hit"), F.col("predicted")).alias("precision"),
        _share(F.col("hit"), F.col("support")).alias("recall"),
        "support",
        "hit",
    ).withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def weighted_metrics(predictions: DataFrame, label: str, prediction: str) -> DataFrame:
    """Support-weighted precision, recall and F1 plus accuracy."""
    classes = per_class_metrics(predictions, label, prediction)
    support = F.sum("support")
    return classes.agg(
        _share(F.sum("hit"), support).alias("accuracy"),
        *[_share(F.sum(F.col(m) * F.col("support")), support).alias(m) for m in ("precision", "recall", "f1")],
    )


def classification_report(predictions: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row per class, plus macro and weighted averages."""
    classes = per_class_metrics(predictions, label, prediction)
    names = ("precision", "recall", "f1")
    rows = classes.select(F.col("class").cast("string").alias("row"), *names, "support")
    macro = classes.agg(*[F.avg(m).alias(m) for m in names], F.sum("support").alias("support")).select(
        F.lit("macro avg").alias("row"), *names, "support"
    )
    weighted = classes.agg(
        *[_share(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(m) for m in names],
        F.sum("support").alias("support"),
    ).select(F.lit("weighted avg").alias("row"), *names, "support")
    return rows.unionByName(macro).unionByName(weighted)


def score_counts(predictions: DataFrame, label: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score."""
    return predictions.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")
    )


def roc_auc(predictions: DataFrame, label: str, score: str, cells: int = 512) -> DataFrame:
    """Exact area under the ROC curve by rank sums, ties at half; 0.5 for one class.

    Scores are counted per value, then cumulated with ``running_totals``, so neither ties
    nor the number of distinct scores lands in one task.
    """
    cumulated = running_totals(score_counts(predictions, label, score), order_by="score", sums=["pos", "neg"], cells=cells)
    below = (F.col("cum_neg") - F.col("neg")) + F.col("neg") / 2.0
    sums = cumulated.agg(
        F.sum(F.col("pos") * below).alias("won"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )
    return sums.select(
        F.coalesce(F.try_divide(F.col("won"), F.col("pos").cast("double") * F.col("neg")), F.lit(0.5)).alias("auc")
    )


def roc_curve(predictions: DataFrame, label: str, score: str, max_points: int = 500) -> DataFrame:
    """At most ``max_points`` ROC points, spread evenly over the score thresholds.

    Point 0 is the origin; point i has every score at or above the i-th highest threshold.
    """
    counts = score_counts(predictions, label, score).withColumn("one", F.lit(1).cast("bigint"))
    falling = counts.withColumn("falling", -F.col("score"))
    cumulated = running_totals(falling, order_by="falling", sums=["pos", "neg", "one"])
    totals = counts.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.count(F.lit(1)).alias("k")).first()
    thresholds = int(totals["k"])
    points = thresholds + 1
    keep = range(points) if points <= max_points else sorted({int(i * (points - 1) / (max_points - 1)) for i in range(max_points)})
    wanted = [i for i in keep if i > 0]
    origin = predictions.sparkSession.createDataFrame([(0, 0.0, 0.0)], "point bigint, fpr double, tpr double")
    curve = cumulated.select(
        F.col("cum_one").alias("point"),
        _share(F.col("cum_neg"), F.lit(totals["n"])).alias("fpr"),
        _share(F.col("cum_pos"), F.lit(totals["p"])).alias("tpr"),
    )
    if len(wanted) < thresholds:
        curve = curve.where(F.col("point").isin(wanted))
    return origin.unionByName(curve)


def best_combination(results: DataFrame, order: Sequence[str] = BEST_METRIC_ORDER, keys: Sequence[str] = ("Method", "Model")) -> DataFrame:
    """Row with the highest value of the first metric that has any value at all."""
    present = [m for m in order if m in results.columns]
    if not present:
        return results.limit(0)
    counts = results.agg(*[F.count(F.when(~F.isnan(m), F.col(m))).alias(m) for m in present]).first()
    metric = next((m for m in present if counts[m]), None)
    if metric is None:
        return results.limit(0)
    value = F.when(~F.isnan(metric), F.col(metric))
    return (
        results.orderBy(value.desc_nulls_last(), *keys)
        .limit(1)
        .withColumns({"best_metric": F.lit(metric), "best_metric_value": F.col(metric)})
    )


def best_per_group(results: DataFrame, group: str, order: Sequence[str], keys: Sequence[str] = ("Method", "Model")) -> DataFrame:
    """Best row per group by an ordered metric list, missing values last.

    A max over a struct is a partial aggregate: no group is sorted in one task.
    """
    rank = F.struct(
        *[F.coalesce(F.when(~F.isnan(m), F.col(m)), F.lit(-1.0)).alias(f"r{i}") for i, m in enumerate(order)],
        F.struct(*[F.col(c) for c in results.columns]).alias("row"),
    )
    return results.groupBy(group).agg(F.max(rank).alias("best")).select("best.row.*")


# Feature-set methods in order of preference, and metric sources in order.
METHOD_ORDER = ("MI", "RFE", "PCA")
METRIC_SOURCES = (
    ("natural_holdout_", "natural"),
    ("balanced_holdout_", "balanced"),
    ("holdout_", "legacy"),
    ("", "cv"),
)


def with_fallback(results: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Each metric from the first source that has it, and which source that was."""
    out = results
    for metric in metrics:
        columns = [(f"{prefix}{metric}", name) for prefix, name in METRIC_SOURCES if f"{prefix}{metric}" in results.columns]
        if not columns:
            continue
        source = F.lit(None).cast("string")
        for column, name in reversed(columns):
            source = F.when(F.col(column).isNotNull(), name).otherwise(source)
        out = out.withColumns(
            {f"chosen_{metric}": F.coalesce(*[F.col(c) for c, _ in columns]), f"{metric}_source": source}
        )
    return out


def result_row(results: DataFrame) -> DataFrame:
    """One row per model: earliest preferred method, then highest chosen F1."""
    chosen = with_fallback(results)
    rank = F.lit(len(METHOD_ORDER))
    for i, method in reversed(list(enumerate(METHOD_ORDER))):
        rank = F.when(F.upper("Method") == method, i).otherwise(rank)
    ranked = chosen.withColumns({"__rank": -rank, "__f1": F.coalesce("chosen_f1_attack", F.lit(-1.0))})
    row = F.struct(*[F.col(c) for c in chosen.columns])
    best = F.max(F.struct("__rank", "__f1", "Method", row.alias("row")))
    return ranked.groupBy(F.upper("Model").alias("__m")).agg(best.alias("b")).select("b.row.*")


def evaluation_table(results: DataFrame, prefixes: Sequence[str] = ("natural_holdout", "balanced_holdout", "holdout")) -> DataFrame:
    """Long form: one row per result and holdout that has any metric."""
    parts = []
    for prefix in prefixes:
        metrics = [
            (F.col(f"{prefix}_{m}") if f"{prefix}_{m}" in results.columns else F.lit(None)).cast("double").alias(m)
            for m in METRICS
        ]
        parts.append(F.struct(F.lit(prefix).alias("evaluation"), *metrics))
    long = results.select("App", "Method", "Model", F.explode(F.array(*parts)).alias("x")).select(
        "App", "Method", "Model", "x.*"
    )
    return long.where(F.coalesce(*[F.col(m) for m in METRICS]).isNotNull())


def auc_summary(results: DataFrame, models: Sequence[str], metric: str = "natural_holdout_auc") -> DataFrame:
    """Methods down, models across."""
    return results.groupBy("Method").pivot("Model", list(models)).agg(F.max(metric))


def quality_warnings(results: DataFrame, forbidden_used: Sequence[str] = ()) -> DataFrame:
    """Rows with a near-perfect metric, forbidden features and missing holdouts."""
    spark = results.sparkSession
    present = [m for m in NEAR_PERFECT_ORDER if m in results.columns]
    first = F.lit(None).cast("string")
    value = F.lit(None).cast("double")
    for m in reversed(present):
        hit = F.col(m) >= NEAR_PERFECT
        first, value = F.when(hit, m).otherwise(first), F.when(hit, F.col(m)).otherwise(value)
    perfect = (
        results.select(
            F.lit("near_perfect").alias("warning"),
            F.concat_ws("/", "Method", "Model").alias("subject"),
            first.alias("metric"),
            value.alias("value"),
        )
        .where(F.col("metric").isNotNull())
    )
    notes = [("forbidden_feature", name, None, None) for name in forbidden_used]
    groups = {p: [f"{p}_{m}" for m in METRICS if f"{p}_{m}" in results.columns] for p in ("natural_holdout", "balanced_holdout")}
    have = results.agg(
        *[
            (F.count(F.coalesce(*[F.col(c) for c in columns])) if columns else F.lit(0)).alias(p)
            for p, columns in groups.items()
        ]
    ).first()
    if sum(have[p] > 0 for p in groups) == 1:
        notes += [("missing_holdout", p, None, None) for p in groups if not have[p]]
    return perfect.unionByName(
        spark.createDataFrame(notes, "warning string, subject string, metric string, value double")
    )


def operational_breakdown(predictions: DataFrame, label: str, prediction: str) -> DataFrame:
    """Counts and rates an operator reads: false alarms, attack share, imbalance."""
    m = _matrix(predictions, label, prediction)
    tp, fn, fp, tn = (F.col(c).cast("double") for c in ("tp", "fn", "fp", "tn"))
    attack, normal = tp + fn, tn + fp
    precision, recall = F.try_divide(tp, tp + fp), F.try_divide(tp, attack)
    return m.select(
        "tp",
        "fn",
        "fp",
        "tn",
        (F.col("tp") + F.col("fn") + F.col("fp") + F.col("tn")).alias("total"),
        recall.alias("attack_recall"),
        precision.alias("attack_precision"),
        F.try_divide(2 * precision * recall, precision + recall).alias("attack_f1"),
        F.try_divide(fp, normal).alias("fp_rate"),
        F.try_divide(tn, normal).alias("specificity"),
        F.try_divide(attack, attack + normal).alias("attack_share"),
        F.try_divide(F.greatest(attack, normal), F.least(attack, normal)).alias("imbalance_ratio"),
    )


def verdict(metric: str, value: Column) -> Column:
    """Band name of a metric value."""
    excellent, good, attention = VERDICT_BANDS[metric]
    return (
        F.when(value.isNull(), "unavailable")
        .when(value >= excellent, "excellent")
        .when(value >= good, "good")
        .when(value >= attention, "attention")
        .otherwise("weak")
    )


# Outcomes of a training stage that did not train.
SKIP_NO_TRAIN = "skipped_missing_train"
SKIP_NO_FEATURES = "skipped_no_modeling_features"
SKIP_ONE_CLASS = "skipped_single_class_train"
SKIP_FEW_ROWS = "skipped_not_enough_samples_per_class"
READY = "ready"


def stage_status(train: DataFrame, label: str, features: Sequence[str], folds: int = 2) -> DataFrame:
    """Whether training can start, as a row instead of an exception."""
    y = (F.coalesce(F.col(label).try_cast("int"), F.lit(0)) == 1).cast("int")
    counts = train.agg(F.count_if(y == 0).alias("benign"), F.count_if(y == 1).alias("attack"))
    benign, attack = F.col("benign"), F.col("attack")
    status = (
        F.when(benign + attack == 0, SKIP_NO_TRAIN)
        .when(F.lit(len(features) == 0), SKIP_NO_FEATURES)
        .when((benign == 0) | (attack == 0), SKIP_ONE_CLASS)
        .when(F.least(benign, attack) < folds, SKIP_FEW_ROWS)
        .otherwise(READY)
    )
    return counts.select("benign", "attack", F.lit(len(features)).alias("features"), status.alias("status"))


def mean_and_deviation(fold_metrics: DataFrame, group: Sequence[str], metrics: Sequence[str] = METRICS) -> DataFrame:
    """Mean and population deviation of each metric over folds."""
    columns = []
    for m in metrics:
        columns += [F.avg(m).alias(m), F.stddev_pop(m).alias(f"{m}_std")]
    return fold_metrics.groupBy(*group).agg(*columns, F.count(F.lit(1)).alias("folds"))

