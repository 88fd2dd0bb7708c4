"""Model training over whole tables.

Fitted models have no SQL equivalent, so most entries are rows-only; the locked model sizes
are far larger, and the smaller ones here are parameters, not row limits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from flowsieve.functions.hashing import unit_interval
from flowsieve.operators import evaluation as E
from flowsieve.operators import models as M
from flowsieve.operators import bayes_curves, boosting, kernel_map, neighbours
from flowsieve.operators import sampling as S
from flowsieve.plans import event_job, registry
from flowsieve.plans.catalogue import Query
from flowsieve.plans.catalogue.refine_queries import _LABELS
from flowsieve.plans.catalogue.routing_queries import reason_sql
from flowsieve.plans.catalogue.sampling_queries import SPLIT_CTE, rank_sql, unit_sql
from flowsieve.plans.catalogue.window_queries import DAY
from flowsieve.plans.stand_in import FLOW_FEATURES, event_cte, event_records, flow_cte, flow_table, read_table
from flowsieve.session import cut_lineage, scratch_path
from flowsieve.sources import tables

LABEL, KEY = "Label", "row_key"
FEATURES = list(FLOW_FEATURES)


def _split(spark, sf_dir):
    rows = cut_lineage(flow_table(spark, sf_dir).select(KEY, LABEL, *FEATURES), "flows")
    rows = cut_lineage(S.stratified_split(rows, label=LABEL, key=KEY), "split")
    return rows.where(F.col("split") == "train"), rows.where(F.col("split") == "test")


def _metrics_of(name, weighted=True, **over):
    def run(spark, sf_dir):
        train, test = _split(spark, sf_dir)
        pipeline = M.build_pipeline(name, FEATURES, label=LABEL, weighted=weighted, rows=train.count(), **over)
        _, predictions = M.fit_predict(pipeline, train, test, label=LABEL, weighted=weighted)
        return E.attack_metrics(predictions, LABEL, "prediction")

    return run


def _scaled(spark, sf_dir):
    """Scaling fitted on train only, applied to the test side."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    train, test = _split(spark, sf_dir)
    names = FEATURES
    model = Pipeline(
        stages=[
            VectorAssembler(inputCols=names, outputCol="x"),
            StandardScaler(inputCol="x", outputCol="z", withMean=True, withStd=True),
        ]
    ).fit(train)
    z = vector_to_array("z")
    return model.transform(test).select(KEY, *[F.round(z[i], 6).alias(n) for i, n in enumerate(names)])


def _cross_validated(spark, sf_dir):
    rows = flow_table(spark, sf_dir)
    make = lambda n: M.build_pipeline("DT", FEATURES, label=LABEL, rows=n)
    folds = M.cross_validate(rows, make, label=LABEL, key=KEY, folds=5)
    return E.mean_and_deviation(folds, [])


def _folds(spark, sf_dir):
    return S.stratified_folds(flow_table(spark, sf_dir), label=LABEL, key=KEY, folds=5).select(KEY, "fold")


def _curve(spark, sf_dir):
    rows = flow_table(spark, sf_dir)
    make = lambda n: M.build_pipeline("DT", FEATURES, label=LABEL, weighted=False, rows=n)
    return M.learning_curve(rows, make, label=LABEL, key=KEY, fractions=(0.2, 0.4, 0.6, 0.8, 1.0), folds=5)


def _boosted(rounds):
    def run(spark, sf_dir):
        rows = cut_lineage(flow_table(spark, sf_dir).select(KEY, LABEL, *FEATURES), "flows")
        model = boosting.fit_boosted_trees(rows, FEATURES, label=LABEL, key=KEY, rounds=rounds)
        return model.transform(rows).select(KEY, "prediction", F.round("margin", 6).alias("margin"), F.round("score", 6).alias("score"))

    return run


def _bayes_curve(spark, sf_dir):
    out = bayes_curves.bayes_curve(flow_table(spark, sf_dir), FEATURES, label=LABEL, key=KEY)
    return out.select("fraction", *[F.round(c, 9).alias(c) for c in out.columns if c != "fraction"])


def _bayes_folds(spark, sf_dir):
    return bayes_curves.bayes_folds(flow_table(spark, sf_dir), FEATURES, label=LABEL, key=KEY)


def _vectors(spark, sf_dir):
    vectors = read_table(spark, sf_dir, "embeddings").select(
        "vec_id", "embedding", (F.col("label") >= 5).cast("int").alias("label")
    )
    position = unit_interval(42, F.col("vec_id"))
    return vectors.where(position < 0.7), vectors.where(position >= 0.7)


def _knn(spark, sf_dir):
    train, test = _vectors(spark, sf_dir)
    out = M.knn_predict(train, test, features="embedding", label="label", key="vec_id", train_block=128, test_block=64)
    return out.select("vec_id", "prediction", F.round(F.col("near")[4]["distance"], 5).alias("fifth_distance"))


def _pruned(spark, sf_dir):
    train, test = _vectors(spark, sf_dir)
    out = neighbours.pruned_neighbours(train, test, features="embedding", label="label", key="vec_id", block=128)
    return out.select("vec_id", "prediction", F.round(F.col("near")[4]["distance"], 5).alias("fifth_distance"))


def _rbf(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    model = M.fit_rbf_svc_approx(train, FEATURES, label=LABEL)
    return E.attack_metrics(model.transform(test), LABEL, "prediction")


def _landmarks(spark, sf_dir):
    """Of each row the largest kernel value with a landmark, as a product of mapped rows; there the map is exact."""
    rows = flow_table(spark, sf_dir).select(KEY, *FEATURES)
    found = kernel_map.fit_landmarks(rows, FEATURES, key=KEY, size=_MAP_LANDMARKS)
    own = found.kernel(found.landmarks * found.scale + found.mean) @ found.root

    @F.pandas_udf("double")
    def nearest(mapped: pd.Series) -> pd.Series:
        return pd.Series((np.stack(mapped.to_numpy()) @ own.T).max(axis=1) if len(mapped) else [], dtype="float64")

    return rows.select(KEY, F.round(nearest(found.mapped()), 5).alias("nearest"))


def _landmark_svc(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    model = kernel_map.fit_landmark_svc(train, FEATURES, label=LABEL, key=KEY)
    return _scored_totals(model.transform(test), probabilities=True)


def _scored_totals(predictions, probabilities):
    """Rows by class, those with a class and those with a usable score: every test row is scored once."""
    score = F.col("score")
    usable = score.isNotNull() & ~F.isnan(score) & (score.between(0, 1) if probabilities else F.lit(True))
    return predictions.groupBy(LABEL).agg(
        F.count_distinct(KEY).alias("keys"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col("prediction").isin(0, 1)).alias("classed"), F.count_if(usable).alias("scored")
    )


def _totals_of(name, weighted=True, probabilities=True):
    def run(spark, sf_dir):
        train, test = _split(spark, sf_dir)
        pipeline = M.build_pipeline(name, FEATURES, label=LABEL, weighted=weighted, rows=train.count())
        _, predictions = M.fit_predict(pipeline, train, test, label=LABEL, weighted=weighted)
        return _scored_totals(predictions, probabilities)

    return run


def _method_totals(spark, sf_dir):
    result = registry.get("flow.tree").run(flow_table(spark, sf_dir), label=LABEL, key=KEY, features=FEATURES)
    return _scored_totals(result.predictions, probabilities=True)


def _saved_run(spark, sf_dir):
    """A run's metrics read back from its tables, and those of its model loaded again."""
    from pyspark.ml import PipelineModel

    train, test = _split(spark, sf_dir)
    model, predictions = M.fit_predict(M.build_pipeline("NB", FEATURES, label=LABEL, weighted=False), train, test, label=LABEL, weighted=False)
    metrics = E.attack_metrics(predictions, LABEL, "prediction")
    runs = spark.createDataFrame([("flow.naive_bayes", "FINISHED")], "pipeline_id string, status string")
    confusion = E.confusion_counts(predictions, LABEL, "prediction")
    written = tables.save_run("run-7", scratch_path(spark, "saved-run"), model=model, runs=runs, metrics=metrics, confusion=confusion)
    kept = spark.read.parquet(written["metrics"]).join(spark.read.parquet(written["runs"]), "run_id")
    again = M.with_score(PipelineModel.load(written["model"]).transform(test))
    counted = spark.read.parquet(written["confusion"]).agg(F.sum("n").alias("counted"))
    # One row each.
    kept = kept.where("status = 'FINISHED'").select(F.lit("stored").alias("origin"), *metrics.columns)
    return kept.unionByName(E.attack_metrics(again, LABEL, "prediction").withColumn("origin", F.lit("reloaded"))).crossJoin(F.broadcast(counted))


def _importance_totals(spark, sf_dir):
    train, _ = _split(spark, sf_dir)
    tables = []
    for name in ("DT", "RFC"):
        over = {"trees": 20} if name == "RFC" else {}
        model = M.build_pipeline(name, FEATURES, label=LABEL, rows=train.count(), **over).fit(M.balanced_weights(train, LABEL))
        tables.append(M.importance_table(spark, M.feature_importance(model, FEATURES)).withColumn("model", F.lit(name)))
    return tables[0].unionByName(tables[1]).groupBy("model").agg(F.count("feature").alias("features"), F.round(F.sum("importance"), 4).alias("total"))


def _importance(spark, sf_dir):
    train, _ = _split(spark, sf_dir)
    pipeline = M.build_pipeline("LR", FEATURES, label=LABEL, weighted=False, rows=train.count())
    return M.importance_table(spark, M.feature_importance(pipeline.fit(train), FEATURES))


def _registered(spark, sf_dir):
    """One registered method end to end: split, balance, scale, fit, report."""
    method = registry.get("flow.forest")
    rows = flow_table(spark, sf_dir)
    result = method.run(rows, label=LABEL, key=KEY, features=FEATURES)
    return result.metrics


EVENT_JOB = event_job.EventJobSettings(
    probe=DAY,
    train_rows=1_000_000,
    top_features=8,
    components=4,
    selection_trees=4,
)


def _event_features(spark, sf_dir):
    """Labels, split and class of every event routed to one application."""
    rows = event_job.labelled_features(event_records(spark, sf_dir), EVENT_JOB)
    return rows.groupBy("split", "label_source", "Target_refined").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("total_bytes").alias("total_bytes")
    )


def _event_job(spark, sf_dir):
    out = event_job.EventMethod("event.tree", "tree", "DT", {"max_depth": M.TREE_DEPTH}).run(event_records(spark, sf_dir), settings=EVENT_JOB)
    return out.results.select("App", "Method", "Model", *[f"natural_holdout_{m}" for m in E.METRICS])


# The labels of the application's events alone, as in the job.
_EVENT_ROWS = _LABELS.replace(
    event_cte(),
    f"{event_cte().replace('ev AS', 'every_event AS', 1)}, ev AS (SELECT * FROM every_event ev WHERE {reason_sql(EVENT_JOB.app)} IS NOT NULL)",
    1,
)
_EVENT_KEY = f"concat_ws('|', '{EVENT_JOB.app}', strftime(w, '%Y-%m-%dT%H:%M:%SZ'), CASE WHEN trim(src_ip) <> '' THEN src_ip END)"
_EVENT_SQL = (
    f"WITH {_EVENT_ROWS} SELECT CASE WHEN {unit_sql(42, _EVENT_KEY)} < 0.8 THEN 'train' ELSE 'test' END AS split, label_source, Target_refined, "
    "count(*) AS rows, sum(bytes_toserver + bytes_toclient) AS total_bytes FROM lab GROUP BY ALL"
)

_KNN_SQL = f"""WITH v AS (SELECT vec_id, embedding, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS label,
  {unit_sql(42, 'CAST(vec_id AS VARCHAR)')} AS u FROM embeddings),
p AS (SELECT t.vec_id, r.label, r.vec_id AS rid, round(sqrt(list_sum(list_transform(list_zip(t.embedding, r.embedding),
  lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))), 9) AS d
  FROM v t JOIN v r ON t.u >= 0.7 AND r.u < 0.7),
n AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, rid) AS k FROM p)
SELECT vec_id, CASE WHEN sum(label) * 2 > 5 THEN 1 ELSE 0 END AS prediction, round(max(d), 5) AS fifth_distance
FROM n WHERE k <= 5 GROUP BY vec_id"""

_FOLD_SQL = (
    f"WITH {flow_cte()} SELECT row_key, (row_number() OVER (PARTITION BY Label ORDER BY {rank_sql(42)}) - 1) % 5 AS fold FROM fl"
)
_SCALED_SQL = (
    f"WITH {SPLIT_CTE}, m AS (SELECT "
    + ", ".join(f"avg({f}) AS a_{f}, stddev_samp({f}) AS s_{f}" for f in FEATURES)
    + " FROM spl WHERE split = 'train') SELECT row_key, "
    + ", ".join(f"round(({f} - a_{f}) / s_{f}, 6) AS {f}" for f in FEATURES)
    + " FROM spl, m WHERE split = 'test'"
)

# Class means and population variances, widened by a billionth of the largest sample variance.
_NB_SQL = (
    f"WITH {SPLIT_CTE}, tr AS (SELECT * FROM spl WHERE split = 'train'), "
    "v AS (SELECT 1e-9 * greatest(" + ", ".join(f"var_samp({f})" for f in FEATURES) + ") AS e FROM tr), "
    "m AS (SELECT Label AS y, ln(count(*)) - ln((SELECT count(*) FROM tr)) AS prior, "
    + ", ".join(f"avg({f}) AS m_{f}, var_pop({f}) + (SELECT e FROM v) AS s_{f}" for f in FEATURES)
    + " FROM tr GROUP BY Label), sc AS (SELECT row_key, Label, y, prior"
    + "".join(f" - 0.5 * ln(s_{f}) - ({f} - m_{f}) * ({f} - m_{f}) / (2 * s_{f})" for f in FEATURES)
    + " AS score FROM spl, m WHERE split = 'test'), "
    "p AS (SELECT row_key, Label, arg_max(y, score) AS y FROM sc GROUP BY row_key, Label), "
    "c AS (SELECT count(*) FILTER (Label = 1 AND y = 1) AS tp, count(*) FILTER (Label = 1 AND y <> 1) AS fn, "
    "count(*) FILTER (Label <> 1 AND y = 1) AS fp, count(*) FILTER (Label <> 1 AND y <> 1) AS tn FROM p), "
    "r AS (SELECT *, (tp + tn) / (tp + tn + fp + fn) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision_attack, "
    "coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall_attack FROM c) SELECT *, "
    "coalesce(2 * precision_attack * recall_attack / nullif(precision_attack + recall_attack, 0), 0.0) AS f1_attack FROM r"
)

def _boosted_sql(rounds: int) -> str:
    """Every level of every tree as its own sums, splits and nodes."""
    B = boosting
    probs = ", ".join(str(i / B.BINS) for i in range(1, B.BINS))
    edges = ", ".join(f"list_distinct(quantile_cont({f}::DOUBLE, [{probs}])) AS e{i}" for i, f in enumerate(FEATURES))
    bins = ", ".join(f"len([e FOR e IN e{i} IF e < {f}::DOUBLE])" for i, f in enumerate(FEATURES))
    ctes = [flow_cte(), f"ed AS MATERIALIZED (SELECT {edges} FROM fl)", f"m0 AS MATERIALIZED (SELECT row_number() OVER () AS id, row_key, Label, [{bins}] AS bins, 0.0::DOUBLE AS margin FROM fl, ed)"]
    part = f"(({{g}}) * ({{g}}) / (({{h}}) + {B.PENALTY}))"
    gain = f"0.5 * ({part.format(g='gl', h='hl')} + {part.format(g='ga - gl', h='ha - hl')} - {part.format(g='ga', h='ha')})"
    for r in range(rounds):
        drawn = f"('0x' || substr(md5('{42 + r}:' || row_key), 1, 15))::BIGINT / 1152921504606846976.0::DOUBLE < {B.ROW_SHARE}"
        columns = [f + 1 for f in B.columns_of_tree(FEATURES, B.COLUMN_SHARE, 42, r)]
        ctes.append(f"n{r}_0 AS MATERIALIZED (SELECT id, row_key, Label, bins, margin, 1 AS node, 1 / (1 + exp(-margin)) AS p, {drawn} AS drawn FROM m{r})")
        for lv in range(B.DEPTH):
            here = f"{r}_{lv}"
            ctes += [
                f"h{here} AS (SELECT node, f, bins[f] AS b, sum(p - Label) AS g, sum(p * (1 - p)) AS h FROM n{here}, (SELECT unnest({columns}) AS f) WHERE drawn AND node >= {2**lv} GROUP BY ALL)",
                f"c{here} AS (SELECT node, f, b, sum(g) OVER u AS gl, sum(h) OVER u AS hl, sum(g) OVER w AS ga, sum(h) OVER w AS ha FROM h{here} "
                "WINDOW u AS (PARTITION BY node, f ORDER BY b), w AS (PARTITION BY node, f))",
                f"s{here} AS MATERIALIZED (SELECT node, f, b FROM (SELECT *, round({gain}, {B.GAIN_DECIMALS}) AS gain FROM c{here}) WHERE hl >= {B.LEAST_CURVATURE} AND ha - hl >= {B.LEAST_CURVATURE} "
                f"AND gain > {B.LEAST_GAIN} QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, b) = 1)",
                f"n{r}_{lv + 1} AS MATERIALIZED (SELECT id, row_key, Label, bins, margin, p, drawn, CASE WHEN s.node IS NULL THEN n.node ELSE 2 * n.node + (bins[s.f] > s.b)::INT END AS node FROM n{here} n LEFT JOIN s{here} s USING (node))",
            ]
        ctes += [
            f"l{r} AS (SELECT node, -{B.STEP} * sum(p - Label) / (sum(p * (1 - p)) + {B.PENALTY}) AS w FROM n{r}_{B.DEPTH} WHERE drawn GROUP BY node)",
            f"m{r + 1} AS MATERIALIZED (SELECT id, row_key, Label, bins, margin + w AS margin FROM n{r}_{B.DEPTH} JOIN l{r} USING (node))",
        ]
    return f"WITH {', '.join(ctes)} SELECT row_key, (margin > 0)::INT AS prediction, round(margin, 6) AS margin, round(1 / (1 + exp(-margin)), 6) AS score FROM m{rounds}"


def _all_rounds_sql(rounds: int) -> str:
    """The same levels, a round of all rows per step of a recursion, as so many rounds side by side exceed the engine's depth of expressions."""
    B = boosting
    probs = ", ".join(str(i / B.BINS) for i in range(1, B.BINS))
    edges = ", ".join(f"list_distinct(quantile_cont({f}::DOUBLE, [{probs}])) AS e{i}" for i, f in enumerate(FEATURES))
    bins = ", ".join(f"len([e FOR e IN e{i} IF e < {f}::DOUBLE])" for i, f in enumerate(FEATURES))
    part = f"(({{g}}) * ({{g}}) / (({{h}}) + {B.PENALTY}))"
    gain = f"0.5 * ({part.format(g='gl', h='hl')} + {part.format(g='ga - gl', h='ha - hl')} - {part.format(g='ga', h='ha')})"
    columns = [[f + 1 for f in B.columns_of_tree(FEATURES, B.COLUMN_SHARE, 42, r)] for r in range(rounds)]
    drawn = f"('0x' || substr(md5((42 + r)::VARCHAR || ':' || row_key), 1, 15))::BIGINT / 1152921504606846976.0::DOUBLE < {B.ROW_SHARE}"
    ctes = [f"n0 AS MATERIALIZED (SELECT id, row_key, Label, bins, margin, r, {columns}[r + 1] AS cols, 1 AS node, 1 / (1 + exp(-margin)) AS p, {drawn} AS drawn FROM m WHERE r < {rounds})"]
    for lv in range(B.DEPTH):
        ctes += [
            f"h{lv} AS (SELECT node, f, bins[f] AS b, sum(p - Label) AS g, sum(p * (1 - p)) AS h FROM (SELECT node, bins, p, Label, unnest(cols) AS f FROM n{lv} WHERE drawn AND node >= {2**lv}) GROUP BY ALL)",
            f"c{lv} AS (SELECT node, f, b, sum(g) OVER u AS gl, sum(h) OVER u AS hl, sum(g) OVER w AS ga, sum(h) OVER w AS ha FROM h{lv} "
            "WINDOW u AS (PARTITION BY node, f ORDER BY b), w AS (PARTITION BY node, f))",
            f"s{lv} AS MATERIALIZED (SELECT node, f, b FROM (SELECT *, round({gain}, {B.GAIN_DECIMALS}) AS gain FROM c{lv}) WHERE hl >= {B.LEAST_CURVATURE} AND ha - hl >= {B.LEAST_CURVATURE} "
            f"AND gain > {B.LEAST_GAIN} QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, b) = 1)",
            f"n{lv + 1} AS MATERIALIZED (SELECT id, row_key, Label, bins, margin, r, p, cols, drawn, CASE WHEN s.node IS NULL THEN n.node ELSE 2 * n.node + (bins[s.f] > s.b)::INT END AS node FROM n{lv} n LEFT JOIN s{lv} s USING (node))",
        ]
    leaf = f"l AS (SELECT node, -{B.STEP} * sum(p - Label) / (sum(p * (1 - p)) + {B.PENALTY}) AS w FROM n{B.DEPTH} WHERE drawn GROUP BY node)"
    return (
        f"WITH RECURSIVE {flow_cte()}, ed AS MATERIALIZED (SELECT {edges} FROM fl), "
        f"m(id, row_key, Label, bins, margin, r) USING KEY (id) AS (SELECT row_number() OVER (), row_key, Label, [{bins}], 0.0::DOUBLE, 0 FROM fl, ed "
        f"UNION (WITH {', '.join(ctes)}, {leaf} SELECT id, row_key, Label, bins, margin + w, r + 1 FROM n{B.DEPTH} JOIN l USING (node))) "
        "SELECT row_key, (margin > 0)::INT AS prediction, round(margin, 6) AS margin, round(1 / (1 + exp(-margin)), 6) AS score FROM m"
    )


def _bayes_sql(fractions: tuple[float, ...]) -> str:
    """``cm``: confusion counts of every fraction, fold and side, each training set aggregated from its rows."""
    stats = ", ".join(f"avg({f}) AS m_{f}, var_pop({f}) AS v_{f}" for f in FEATURES)
    widest = "greatest(" + ", ".join(f"var_samp({f})" for f in FEATURES) + ")"
    terms = "".join(f" - 0.5 * ln(v_{f} + e) - ({f} - m_{f}) * ({f} - m_{f}) / (2 * (v_{f} + e))" for f in FEATURES)
    return (
        f"WITH {flow_cte()}, fo AS (SELECT *, (row_number() OVER (PARTITION BY Label ORDER BY {rank_sql(42)}) - 1) % 5 AS fold, "
        "('0x' || substr(md5('43:' || row_key), 1, 15))::BIGINT / 1152921504606846976.0::DOUBLE AS u FROM fl), "
        f"g AS (SELECT fraction, fold AS held FROM (SELECT unnest({list(fractions)}::DOUBLE[]) AS fraction), (SELECT DISTINCT fold FROM fo)), "
        f"al AS (SELECT fraction, held, count(*) AS rows, 1e-9 * {widest} AS e FROM g JOIN fo ON fold <> held AND u < fraction GROUP BY ALL), "
        f"md AS (SELECT fraction, held, Label AS y, count(*) AS n, {stats} FROM g JOIN fo ON fold <> held AND u < fraction GROUP BY ALL), "
        f"sc AS (SELECT fraction, held, fo.fold, row_key, fo.Label, y, ln(n / rows){terms} AS score FROM md JOIN al USING (fraction, held) JOIN fo ON fo.fold = held OR u < fraction), "
        "pr AS (SELECT fraction, held, CASE WHEN fold = held THEN 'valid' ELSE 'train' END AS side, Label, arg_max(y, score) AS p FROM sc GROUP BY fraction, held, fold, row_key, Label), "
        "cm AS (SELECT fraction, held AS fold, side, Label, p, count(*) AS n FROM pr GROUP BY ALL)"
    )


_BAYES_CURVE_SQL = (
    f"{_bayes_sql(bayes_curves.FRACTIONS)}, x AS (SELECT fraction, fold, side, Label AS c, n AS s, 0 AS q, CASE WHEN Label = p THEN n ELSE 0 END AS h FROM cm "
    "UNION ALL SELECT fraction, fold, side, p, 0, n, 0 FROM cm), k AS (SELECT fraction, fold, side, c, sum(s) AS s, 2 * sum(h) / (sum(s) + sum(q)) AS f1 FROM x GROUP BY ALL), "
    "f AS (SELECT fraction, fold, side, sum(f1 * s) / sum(s) AS f1 FROM k GROUP BY ALL) "
    "SELECT fraction, round((SELECT avg(rows) FROM al WHERE al.fraction = f.fraction), 9) AS train_rows, "
    + ", ".join(f"round({fn}(f1) FILTER (side = '{side}'), 9) AS {side}_{name}" for side in ("train", "valid") for name, fn in (("mean", "avg"), ("std", "stddev_pop")))
    + " FROM f GROUP BY fraction"
)
_BAYES_FOLD_SQL = (
    f"{_bayes_sql((1.0,))}, c AS (SELECT fold, coalesce(sum(n) FILTER (Label = 1 AND p = 1), 0) AS tp, coalesce(sum(n) FILTER (Label = 1 AND p <> 1), 0) AS fn, "
    "coalesce(sum(n) FILTER (Label <> 1 AND p = 1), 0) AS fp, coalesce(sum(n) FILTER (Label <> 1 AND p <> 1), 0) AS tn FROM cm WHERE side = 'valid' GROUP BY fold), "
    "r AS (SELECT *, (tp + tn) / (tp + tn + fp + fn) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision_attack, coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall_attack FROM c) "
    "SELECT *, coalesce(2 * precision_attack * recall_attack / nullif(precision_attack + recall_attack, 0), 0.0) AS f1_attack FROM r"
)

_MAP_LANDMARKS = 64
_MAP_SQL = (
    f"WITH {flow_cte()}, st AS (SELECT " + ", ".join(f"avg({f}) AS a_{f}, stddev_samp({f}) AS s_{f}" for f in FEATURES) + " FROM fl), "
    "z AS (SELECT row_key, [" + ", ".join(f"({f} - a_{f}) / s_{f}" for f in FEATURES) + "] AS z FROM fl, st), "
    f"lm AS (SELECT DISTINCT z AS l FROM (SELECT z FROM z ORDER BY {rank_sql(42)} LIMIT {_MAP_LANDMARKS})) "
    f"SELECT row_key, round(max(exp(-list_sum([(z[i] - l[i]) * (z[i] - l[i]) FOR i IN range(1, {len(FEATURES) + 1})]) / {len(FEATURES)})), 5) AS nearest FROM z, lm GROUP BY row_key, z"
)
_TOTALS_SQL = f"WITH {SPLIT_CTE} SELECT Label, count(DISTINCT row_key) AS keys, count(*) AS rows, count(*) AS classed, count(*) AS scored FROM spl WHERE split = 'test' GROUP BY Label"
_IMPORTANCE_SQL = (
    f"WITH {flow_cte()} SELECT model, (SELECT len([{', '.join(FEATURES)}]) FROM fl LIMIT 1) AS features, 1.0 AS total FROM (VALUES ('DT'), ('RFC')) AS m(model)"
)

QUERIES = [
    Query("j9_scaled_on_train", _scaled, _SCALED_SQL),
    Query("j10_decision_tree", _metrics_of("DT")),
    Query("j11_random_forest", _metrics_of("RFC")),
    Query("j12_linear_svc", _metrics_of("LSVC")),
    Query("j13_boosted_trees", _metrics_of("XGB", weighted=False)),
    Query("j13_second_order_tree", _boosted(1), _boosted_sql(1)),
    Query("j13_second_order_boosting", _boosted(boosting.ROUNDS), _all_rounds_sql(boosting.ROUNDS)),
    Query("j14_gaussian_naive_bayes", _metrics_of("NB", weighted=False), _NB_SQL),
    Query("j15_logistic_regression", _metrics_of("LR", weighted=False)),
    Query("j16_nearest_neighbours", _knn, _KNN_SQL),
    Query("j16_pruned_neighbours", _pruned, _KNN_SQL),
    Query("j17_rbf_svc_approx", _rbf),
    Query(
        "a10_saved_run",
        _saved_run,
        f"SELECT origin, n.*, tp + fn + fp + tn AS counted FROM ({_NB_SQL}) AS n, (VALUES ('stored'), ('reloaded')) AS o(origin)",
    ),
    Query("j10_tree_totals", _totals_of("DT"), _TOTALS_SQL),
    Query("j11_forest_totals", _totals_of("RFC"), _TOTALS_SQL),
    Query("j12_linear_svc_totals", _totals_of("LSVC", probabilities=False), _TOTALS_SQL),
    Query("j15_logistic_totals", _totals_of("LR", weighted=False), _TOTALS_SQL),
    Query("j17_landmark_kernel", _landmarks, _MAP_SQL),
    Query("j17_landmark_svc_totals", _landmark_svc, _TOTALS_SQL),
    Query("j26_importance_totals", _importance_totals, _IMPORTANCE_SQL),
    Query("n2_registered_totals", _method_totals, _TOTALS_SQL),
    Query("j18_stratified_folds", _folds, _FOLD_SQL),
    Query("j18_naive_bayes_folds", _bayes_folds, _BAYES_FOLD_SQL),
    Query("j19_naive_bayes_curve", _bayes_curve, _BAYES_CURVE_SQL),
    Query("j18_cross_validation", _cross_validated),
    Query("j19_learning_curve", _curve),
    Query("j26_feature_importance", _importance),
    Query("n2_registered_method", _registered),
    Query("n4_event_feature_table", _event_features, _EVENT_SQL),
    Query("n4_event_job_results", _event_job),
]
