"""Evaluation tables over scored documents and over the run history."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsieve.operators import evaluation as E
from flowsieve.plans.catalogue import Query
from flowsieve.plans.stand_in import FLOW_FEATURES, flow_cte, flow_table, prediction_cte, prediction_table, run_cte, run_table

Y, P, S = "label", "prediction", "score"


def _scored_flows(spark, sf_dir):
    """A larger prediction table: discount as score, high quantity as prediction."""
    return flow_table(spark, sf_dir).select(
        "row_key",
        F.col("Label").alias(Y),
        F.col("l_discount").alias("tied"),
        F.col("l_extendedprice").alias(S),
        (F.col("l_quantity") > 25).cast("int").alias(P),
    )


SCORED = (
    f"{flow_cte()}, sc AS (SELECT row_key, Label AS label, l_discount AS tied, l_extendedprice AS score, "
    "CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS prediction FROM fl)"
)


def _confusion(spark, sf_dir):
    return E.confusion_counts(prediction_table(spark, sf_dir), Y, P)


def _round(df, digits=9, skip=()):
    return df.withColumns({f.name: F.round(f.name, digits) for f in df.schema.fields if f.dataType.typeName() == "double" and f.name not in skip})


def _attack(spark, sf_dir):
    return _round(E.attack_metrics(prediction_table(spark, sf_dir), Y, P))


def _weighted(spark, sf_dir):
    return _round(E.weighted_metrics(_scored_flows(spark, sf_dir), Y, P))


def _report(spark, sf_dir):
    return _round(E.classification_report(_scored_flows(spark, sf_dir), Y, P))


def _auc(spark, sf_dir):
    a = E.roc_auc(prediction_table(spark, sf_dir), Y, S).select(F.lit("documents").alias("table"), "auc")
    b = E.roc_auc(_scored_flows(spark, sf_dir), Y, S).select(F.lit("flows").alias("table"), "auc")
    c = E.roc_auc(_scored_flows(spark, sf_dir), Y, "tied").select(F.lit("tied").alias("table"), "auc")
    return _round(a.unionByName(b).unionByName(c))


def _curve(spark, sf_dir):
    return _round(E.roc_curve(_scored_flows(spark, sf_dir), Y, S, max_points=500))


def _small_curve(spark, sf_dir):
    return _round(E.roc_curve(_scored_flows(spark, sf_dir), Y, "tied"))


def _results(spark, sf_dir):
    """The run history as a result table: methods by model, one row per run."""
    return run_table(spark, sf_dir).select(
        F.col("dataset_type").alias("App"),
        F.when(F.col("n_estimators") == "100", "MI").when(F.col("n_estimators") == "200", "RFE").otherwise("PCA").alias("Method"),
        F.element_at(F.split("pipeline_id", r"\."), 2).alias("Model"),
        F.col("id"),
        F.col("f1").alias("natural_holdout_f1_attack"),
        F.col("auc").alias("natural_holdout_auc"),
        F.col("accuracy").alias("balanced_holdout_accuracy"),
        F.round(F.col("f1") * 0.9, 6).alias("f1_attack"),
        F.lit(0.25).alias("auc"),
    )


RESULTS = (
    f"{run_cte()}, res AS (SELECT dataset_type AS App, CASE n_estimators WHEN '100' THEN 'MI' WHEN '200' THEN 'RFE' ELSE 'PCA' END AS "
    "Method, split_part(pipeline_id, '.', 2) AS Model, id, f1 AS natural_holdout_f1_attack, auc AS natural_holdout_auc, accuracy AS "
    "balanced_holdout_accuracy, round(f1 * 0.9, 6) AS f1_attack, 0.25 AS auc FROM runs)"
)


def _best(spark, sf_dir):
    best = E.best_combination(_results(spark, sf_dir), keys=("Method", "Model", "id"))
    return best.select("best_metric", "best_metric_value")


def _result_row(spark, sf_dir):
    rows = E.result_row(_results(spark, sf_dir))
    return rows.select("Model", "Method", F.round("chosen_f1_attack", 6).alias("chosen_f1_attack"), "auc_source")


def _fallback(spark, sf_dir):
    rows = E.with_fallback(_results(spark, sf_dir))
    return rows.select("id", "chosen_f1_attack", "f1_attack_source", "chosen_auc", "auc_source", "chosen_accuracy", "accuracy_source")


def _tables(spark, sf_dir):
    rows = E.evaluation_table(_results(spark, sf_dir))
    return rows.groupBy("evaluation", "App", "Method", "Model").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("f1_attack"), 4).alias("f1_attack"), F.round(F.sum("accuracy"), 4).alias("accuracy")
    )


def _auc_summary(spark, sf_dir):
    return E.auc_summary(_results(spark, sf_dir), ["forest", "tree", "knn", "boosted"])


def _warnings(spark, sf_dir):
    rows = _results(spark, sf_dir).withColumn("natural_holdout_auc", F.col("natural_holdout_auc") * 1.05)
    warned = E.quality_warnings(rows.drop("balanced_holdout_accuracy"), ["label_source"])
    return warned.groupBy("warning", "subject", "metric").agg(F.count(F.lit(1)).alias("rows"))


def _breakdown(spark, sf_dir):
    return _round(E.operational_breakdown(_scored_flows(spark, sf_dir), Y, P))


def _verdicts(spark, sf_dir):
    rows = run_table(spark, sf_dir)
    return rows.groupBy(
        E.verdict("recall", F.col("accuracy")).alias("recall"),
        E.verdict("precision", F.col("f1")).alias("precision"),
        E.verdict("f1", F.col("f1")).alias("f1"),
        E.verdict("auc", F.col("auc")).alias("auc"),
    ).agg(F.count(F.lit(1)).alias("runs"))


def _status(spark, sf_dir):
    rows = flow_table(spark, sf_dir)
    cases = [
        ("ready", rows, FLOW_FEATURES),
        ("one_class", rows.where(F.col("Label") == 0), FLOW_FEATURES),
        ("no_rows", rows.where(F.col("Label") == 7), FLOW_FEATURES),
        ("no_features", rows, ()),
    ]
    parts = [E.stage_status(df, "Label", list(names)).select(F.lit(case).alias("case"), "*") for case, df, names in cases]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _fold_statistics(spark, sf_dir):
    rows = run_table(spark, sf_dir).select("pipeline_id", F.col("accuracy"), F.col("f1").alias("f1_attack"), "auc")
    return _round(E.mean_and_deviation(rows, ["pipeline_id"], ["accuracy", "f1_attack", "auc"]))


def _band(metric: str, c: str) -> str:
    a, b, d = E.VERDICT_BANDS[metric]
    return (
        f"CASE WHEN {c} IS NULL THEN 'unavailable' WHEN {c} >= {a} THEN 'excellent' WHEN {c} >= {b} THEN 'good' WHEN {c} >= {d} THEN "
        "'attention' ELSE 'weak' END"
    )


_M = (
    "count(*) FILTER (label = 1 AND prediction = 1) AS tp, count(*) FILTER (label = 1 AND prediction = 0) AS fn, "
    "count(*) FILTER (label = 0 AND prediction = 1) AS fp, count(*) FILTER (label = 0 AND prediction = 0) AS tn"
)
_CLASSES = f"""{SCORED}, k AS (SELECT unnest([0, 1]) AS class), c AS (SELECT class, count(*) FILTER (label = class) AS support,
  count(*) FILTER (prediction = class) AS predicted, count(*) FILTER (label = class AND prediction = class) AS hit
  FROM sc, k GROUP BY class), pc AS (SELECT class, support, hit, hit / predicted AS precision, hit / support AS recall FROM c),
  pf AS (SELECT *, 2 * precision * recall / (precision + recall) AS f1 FROM pc)"""


def _auc_sql(table: str, score: str, name: str) -> str:
    return (
        f"SELECT '{name}' AS \"table\", round((sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / "
        f"2.0) / (count(*) FILTER (label = 1) * count(*) FILTER (label <> 1)), 9) AS auc FROM (SELECT label, rank() OVER (ORDER BY {score}) "
        f"+ (count(*) OVER (PARTITION BY {score}) - 1) / 2.0 AS r FROM {table})"
    )


def _curve_sql(score: str) -> str:
    return (
        f"{SCORED}, g AS (SELECT {score} AS s, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label <> 1) AS neg FROM sc GROUP BY 1), "
        "w AS (SELECT row_number() OVER (ORDER BY s DESC) AS point, sum(neg) OVER (ORDER BY s DESC) / sum(neg) OVER () AS fpr, "
        "sum(pos) OVER (ORDER BY s DESC) / sum(pos) OVER () AS tpr FROM g UNION ALL SELECT 0, 0, 0)"
    )


QUERIES = [
    Query(
        "j20_confusion_matrix",
        _confusion,
        f"WITH {prediction_cte()}, g AS (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS t(a, p)) "
        "SELECT a AS label, p AS prediction, count(pr.row_id) AS n FROM g LEFT JOIN pr ON pr.label = a AND pr.prediction = p GROUP BY a, p",
    ),
    Query(
        "j21_attack_metrics",
        _attack,
        f"WITH {prediction_cte()}, m AS (SELECT {_M} FROM pr) SELECT tp, fn, fp, tn, round((tp + tn) / (tp + tn + fp + fn), 9) AS accuracy, "
        "round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision_attack, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall_attack, "
        "round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1_attack FROM m",
    ),
    Query(
        "j22_weighted_metrics",
        _weighted,
        f"WITH {_CLASSES} SELECT round(sum(hit) / sum(support), 9) AS accuracy, round(sum(precision * support) / sum(support), 9) AS precision, "
        "round(sum(recall * support) / sum(support), 9) AS recall, round(sum(f1 * support) / sum(support), 9) AS f1 FROM pf",
    ),
    Query(
        "j23_classification_report",
        _report,
        f"WITH {_CLASSES} SELECT CAST(class AS VARCHAR) AS row, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS "
        "f1, support FROM pf UNION ALL SELECT 'macro avg', round(avg(precision), 9), round(avg(recall), 9), round(avg(f1), 9), sum(support) "
        "FROM pf UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 9), round(sum(recall * support) / "
        "sum(support), 9), round(sum(f1 * support) / sum(support), 9), sum(support) FROM pf",
    ),
    Query(
        "j24_roc_auc",
        _auc,
        f"WITH {prediction_cte()}, {SCORED} {_auc_sql('pr', 'score', 'documents')} UNION ALL {_auc_sql('sc', 'score', 'flows')} UNION ALL "
        f"{_auc_sql('sc', 'tied', 'tied')}",
    ),
    Query(
        "j25_roc_curve_500",
        _curve,
        f"WITH {_curve_sql('score')}, k AS (SELECT DISTINCT CAST(trunc(i * (SELECT max(point) FROM w) / 499) AS BIGINT) AS p FROM "
        "range(500) AS t(i)) SELECT point, round(fpr, 9) AS fpr, round(tpr, 9) AS tpr FROM w WHERE point IN (SELECT p FROM k)",
    ),
    Query(
        "j25_roc_curve_ties",
        _small_curve,
        f"WITH {_curve_sql('tied')} SELECT point, round(fpr, 9) AS fpr, round(tpr, 9) AS tpr FROM w",
    ),
    Query(
        "j27_best_combination",
        _best,
        f"WITH {RESULTS} SELECT 'natural_holdout_f1_attack' AS best_metric, max(natural_holdout_f1_attack) AS best_metric_value FROM res",
    ),
    Query(
        "j28_result_row",
        _result_row,
        f"WITH {RESULTS}, c AS (SELECT *, CASE Method WHEN 'MI' THEN 0 WHEN 'RFE' THEN 1 ELSE 2 END AS rk, coalesce(natural_holdout_f1_attack, "
        "f1_attack) AS chosen FROM res), r AS (SELECT *, row_number() OVER (PARTITION BY upper(Model) ORDER BY rk, coalesce(chosen, -1) DESC) "
        "AS n FROM c) SELECT Model, Method, round(chosen, 6) AS chosen_f1_attack, CASE WHEN natural_holdout_auc IS NOT NULL THEN 'natural' "
        "ELSE 'cv' END AS auc_source FROM r WHERE n = 1",
    ),
    Query(
        "j28_metric_fallback",
        _fallback,
        f"WITH {RESULTS} SELECT id, coalesce(natural_holdout_f1_attack, f1_attack) AS chosen_f1_attack, CASE WHEN natural_holdout_f1_attack IS "
        "NOT NULL THEN 'natural' WHEN f1_attack IS NOT NULL THEN 'cv' END AS f1_attack_source, coalesce(natural_holdout_auc, auc) AS chosen_auc, "
        "CASE WHEN natural_holdout_auc IS NOT NULL THEN 'natural' ELSE 'cv' END AS auc_source, balanced_holdout_accuracy AS chosen_accuracy, "
        "CASE WHEN balanced_holdout_accuracy IS NOT NULL THEN 'balanced' END AS accuracy_source FROM res",
    ),
    Query(
        "j29_evaluation_table",
        _tables,
        f"WITH {RESULTS}, l AS (SELECT 'natural_holdout' AS evaluation, App, Method, Model, natural_holdout_f1_attack AS f, NULL::DOUBLE AS a FROM "
        "res WHERE natural_holdout_f1_attack IS NOT NULL OR natural_holdout_auc IS NOT NULL UNION ALL SELECT 'balanced_holdout', App, Method, "
        "Model, NULL, balanced_holdout_accuracy FROM res WHERE balanced_holdout_accuracy IS NOT NULL) SELECT evaluation, App, Method, Model, "
        "count(*) AS rows, round(sum(f), 4) AS f1_attack, round(sum(a), 4) AS accuracy FROM l GROUP BY ALL",
    ),
    Query(
        "j30_auc_by_method",
        _auc_summary,
        f"WITH {RESULTS} SELECT Method, "
        + ", ".join(f"max(natural_holdout_auc) FILTER (Model = '{m}') AS {m}" for m in ("forest", "tree", "knn", "boosted"))
        + " FROM res GROUP BY Method",
    ),
    Query(
        "j31_quality_warnings",
        _warnings,
        f"WITH {RESULTS} SELECT 'near_perfect' AS warning, Method || '/' || Model AS subject, 'natural_holdout_auc' AS metric, count(*) AS rows "
        "FROM res WHERE natural_holdout_auc * 1.05 >= 0.999 AND coalesce(natural_holdout_f1_attack, 0) < 0.999 GROUP BY ALL UNION ALL "
        "SELECT 'near_perfect', Method || '/' || Model, 'natural_holdout_f1_attack', count(*) FROM res WHERE natural_holdout_f1_attack >= 0.999 "
        "GROUP BY ALL UNION ALL SELECT 'forbidden_feature', 'label_source', NULL, 1 UNION ALL SELECT 'missing_holdout', 'balanced_holdout', NULL, 1",
    ),
    Query(
        "j32_operational_breakdown",
        _breakdown,
        f"WITH {SCORED}, m AS (SELECT {_M} FROM sc) SELECT tp, fn, fp, tn, tp + fn + fp + tn AS total, round(tp / (tp + fn), 9) AS attack_recall, "
        "round(tp / (tp + fp), 9) AS attack_precision, round(2.0 * tp / (2 * tp + fp + fn), 9) AS attack_f1, round(fp / (tn + fp), 9) AS fp_rate, "
        "round(tn / (tn + fp), 9) AS specificity, round((tp + fn) / (tp + fn + fp + tn), 9) AS attack_share, "
        "round(greatest(tp + fn, tn + fp) / least(tp + fn, tn + fp), 9) AS imbalance_ratio FROM m",
    ),
    Query(
        "j33_verdicts",
        _verdicts,
        f"WITH {run_cte()} SELECT {_band('recall', 'accuracy')} AS recall, {_band('precision', 'f1')} AS precision, {_band('f1', 'f1')} AS f1, "
        f"{_band('auc', 'auc')} AS auc, count(*) AS runs FROM runs GROUP BY 1, 2, 3, 4",
    ),
    Query(
        "j34_stage_status",
        _status,
        f"WITH {flow_cte()}, n AS (SELECT count(*) FILTER (Label = 0) AS b, count(*) FILTER (Label = 1) AS a FROM fl) "
        "SELECT x.\"case\", CASE WHEN x.\"case\" = 'no_rows' THEN 0 ELSE b END AS benign, CASE WHEN x.\"case\" IN ('no_rows', 'one_class') THEN 0 "
        "ELSE a END AS attack, x.features, x.status FROM n, (VALUES ('ready', 7, 'ready'), ('one_class', 7, 'skipped_single_class_train'), "
        "('no_rows', 7, 'skipped_missing_train'), ('no_features', 0, 'skipped_no_modeling_features')) AS x(\"case\", features, status)",
    ),
    Query(
        "j18_fold_statistics",
        _fold_statistics,
        f"WITH {run_cte()} SELECT pipeline_id, round(avg(accuracy), 9) AS accuracy, round(stddev_pop(accuracy), 9) AS accuracy_std, "
        "round(avg(f1), 9) AS f1_attack, round(stddev_pop(f1), 9) AS f1_attack_std, round(avg(auc), 9) AS auc, round(stddev_pop(auc), 9) AS "
        "auc_std, count(*) AS folds FROM runs GROUP BY pipeline_id",
    ),
]
