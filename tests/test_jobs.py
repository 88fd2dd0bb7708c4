"""Methods and the event job end to end, with the invariants that must hold."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsieve.operators import evaluation as E
from flowsieve.operators import manifest, models, sampling, selection
from flowsieve.plans import event_job, registry
from flowsieve.plans.catalogue.window_queries import DAY
from flowsieve.plans.stand_in import FLOW_FEATURES, event_records, flow_table
from flowsieve.session import cut_lineage

SETTINGS = event_job.EventJobSettings(
    probe=DAY,
    top_features=32,
    components=3,
    methods=("MI", "RFE", "PCA"),
    model_names=("DT",),
    model_sizes={"DT": {"depth": 3}},
    selection_trees=2,
)


@pytest.fixture(scope="module")
def feature_rows(spark, sf_dir):
    return cut_lineage(event_job.labelled_features(event_records(spark, sf_dir), SETTINGS))


def test_feature_rows(feature_rows, spark, sf_dir):
    from flowsieve.operators import routing

    # Feature engineering keeps every routed row exactly once.
    assert feature_rows.count() == routing.app_events(event_records(spark, sf_dir), "tls").count()
    assert feature_rows.select("row_id").distinct().count() == feature_rows.count()
    # A (window, source) group never crosses the split.
    sides = feature_rows.where(F.col("src_ip") != "").groupBy("window_start", "src_ip").agg(F.count_distinct("split").alias("n"))
    assert sides.where("n > 1").count() == 0
    doubles = [f.name for f in feature_rows.schema.fields if f.dataType.typeName() == "double"]
    bad = feature_rows.agg(*[F.count_if(F.col(c).isNull() | F.isnan(c)).alias(c) for c in doubles]).first()
    assert sum(bad) == 0


def test_no_leaking_feature_reaches_training(feature_rows):
    names = event_job.modeling_features(feature_rows)
    assert names and not [n for n in names if manifest.is_forbidden(n, event_job.TARGET)]
    assert not set(names) & set(manifest.CRITICAL_NAMES)


def test_event_job(feature_rows):
    result = event_job.train_and_evaluate(feature_rows, SETTINGS)
    assert result.status == "completed"
    rows = result.results.collect()
    assert {(r["Method"], r["Model"]) for r in rows} == {("MI", "DT"), ("RFE", "DT"), ("PCA", "DT")}
    for r in rows:
        assert all(0.0 <= r[f"natural_holdout_{m}"] <= 1.0 for m in E.METRICS)
    assert result.best.first()["best_metric"] == "natural_holdout_f1_attack"
    again = event_job.train_and_evaluate(feature_rows.repartition(5), replace(SETTINGS, methods=("MI",)))
    assert [r.asDict() for r in again.results.collect()] == [r.asDict() for r in rows if r["Method"] == "MI"]


def test_job_tables(feature_rows, tmp_path):
    result = event_job.train_and_evaluate(feature_rows, replace(SETTINGS, methods=("MI",)))
    assert {"split", "coverage", "confusion", "roc", "importances"} <= set(result.tables)
    holdout = feature_rows.where(F.col("split") == "test")
    cells = result.tables["confusion"].groupBy("holdout").agg(F.sum("n").alias("n")).collect()
    per_class = [r["count"] for r in holdout.groupBy("Target_refined").count().collect()]
    # Without a size the natural holdout is the whole test side, the balanced one its largest balanced part.
    assert {r["holdout"]: r["n"] for r in cells} == {"natural": sum(per_class), "balanced": 2 * min(per_class)}
    ends = result.tables["roc"].groupBy("holdout").agg(F.max("tpr").alias("top")).collect()
    assert all(r["top"] == 1.0 for r in ends)
    assert result.tables["importances"].count() == len(result.feature_sets["MI"])
    written = event_job.save_result(result, str(tmp_path), "r1")
    again = event_job.save_result(result, str(tmp_path), "r2")
    spark = feature_rows.sparkSession
    runs = spark.read.parquet(written["metrics"]).groupBy("run_id").count().collect()
    assert {r["run_id"]: r["count"] for r in runs} == {"r1": 1, "r2": 1}
    assert again["model"] != written["model"]


def test_penalty_follows_the_fitted_rows(feature_rows):
    seen = []

    def make(n):
        pipeline = models.build_pipeline("LSVC", ["event_count_window"], label="Target_refined", rows=n, max_iter=2)
        seen.append((n, pipeline.getStages()[-1].getRegParam()))
        return pipeline

    models.cross_validate(feature_rows, make, label="Target_refined", key="row_id", folds=2)
    total = feature_rows.count()
    assert abs(sum(n for n, _ in seen) - total) <= 2 and all(reg == 1 / n for n, reg in seen)


def test_no_two_features_give_a_forbidden_one(feature_rows):
    names = set(event_job.modeling_features(feature_rows))
    assert not names & set(manifest.REBUILDS_FORBIDDEN)
    assert not {"event_count_window", "no_alert_count_window"} <= names


@pytest.mark.parametrize("split", ["group", "row", "random_stratified", "time_based"])
def test_split_choice(feature_rows, split):
    rows = event_job.split_rows(feature_rows.drop("split"), replace(SETTINGS, split=split))
    assert {r["split"] for r in rows.select("split").distinct().collect()} == {"train", "test"}
    with pytest.raises(ValueError):
        event_job.split_rows(feature_rows, replace(SETTINGS, split="other"))


def test_job_from_lines(spark, tmp_path, sf_dir):
    """Counts and quarantine of unreadable lines; windows, drops and budget as tables."""
    from flowsieve.plans.stand_in import write_event_lines
    from flowsieve.sources import event_log

    path = write_event_lines(spark, sf_dir)
    settings = replace(SETTINGS, methods=("MI",))
    result = event_job.run_event_job(spark, path, settings, quarantine=str(tmp_path / "q"), save_to=str(tmp_path / "runs"))
    want = event_log.line_counts(event_log.read_lines(spark, path)).first()
    assert result.tables["lines"].first() == want and want["malformed_lines"] > 0
    assert spark.read.parquet(str(tmp_path / "q")).count() == want["malformed_lines"]
    assert result.tables["probes"].count() > 0 and result.tables["budget"].count() == 1
    assert spark.read.parquet(str(tmp_path / "runs" / "lines")).count() == 1


def test_skips_instead_of_failing(feature_rows):
    one_class = feature_rows.where(F.col("Target_refined") == 0)
    assert event_job.train_and_evaluate(one_class, SETTINGS).status == E.SKIP_ONE_CLASS
    assert event_job.train_and_evaluate(feature_rows.limit(0), SETTINGS).status == E.SKIP_NO_TRAIN


@pytest.mark.parametrize(
    "method,overrides",
    [
        ("flow.forest", {"n_estimators": 3, "max_depth": 3}),
        ("flow.tree", {"max_depth": 3}),
        ("flow.knn", None),
        ("flow.naive_bayes", None),
        ("flow.logistic", {"max_iter": 20}),
    ],
)
def test_flow_methods(spark, sf_dir, method, overrides):
    stages = []
    result = registry.get(method).run(
        flow_table(spark, sf_dir), label="Label", key="row_key", features=FLOW_FEATURES, overrides=overrides, progress=stages.append
    )
    counts = {(r["Label"], r["prediction"]): r["n"] for r in result.confusion.collect()}
    total = flow_table(spark, sf_dir).count()
    assert abs(sum(counts.values()) - 0.3 * total) < 1
    accuracy = result.metrics.first()["accuracy"]
    assert accuracy == pytest.approx((counts[0, 0] + counts[1, 1]) / sum(counts.values()))
    assert 0 <= result.auc <= 1 and stages == ["Preprocessing", "Training", "Evaluating"]


def test_default_features_of_a_flow_table(spark, sf_dir):
    rows = flow_table(spark, sf_dir).withColumn("idle.max", F.col("l_tax") * 2).withColumn("uid", F.lit(1))
    result = registry.get("flow.naive_bayes").run(rows, label="Label", key="row_key")
    assert set(result.features) == {*FLOW_FEATURES, "idle.max"}


def test_overrides():
    locked = {"n_estimators": 100, "flag": True, "rate": 0.5, "scaler": "StandardScaler"}
    assert registry.resolve_params(locked, None) == locked
    assert registry.resolve_params(locked, {"n_estimators": 7, "rate": 1})["rate"] == 1.0
    for bad in (
        {"n_estimators": 501},
        {"n_estimators": 2.0},
        {"n_estimators": True},
        {"flag": 1},
        {"rate": float("nan")},
        {"scaler": "None"},
        {"unknown": 1},
    ):
        with pytest.raises(registry.ParamError):
            registry.resolve_params(locked, bad)
    assert set(registry.for_dataset("event_log")) == {"event.tree", "event.forest", "event.linear_svc", "event.boosted"}
    assert len(registry.METHODS) == 10
    with pytest.raises(KeyError):
        registry.get("nope")


def test_knn_blocks_agree(spark, sf_dir):
    from flowsieve.plans.stand_in import read_table

    vectors = read_table(spark, sf_dir, "embeddings").withColumn("y", (F.col("label") > 4).cast("int"))
    train, test = vectors.where("vec_id % 3 > 0"), vectors.where("vec_id % 3 = 0")
    a = np.array([(r["vec_id"], *r["embedding"]) for r in train.orderBy("vec_id").collect()])
    want = {}
    for r in test.collect():
        d = np.sqrt(((a[:, 1:] - np.array(r["embedding"])) ** 2).sum(axis=1)).round(9)
        want[r["vec_id"]] = [int(a[i, 0]) for i in np.lexsort((a[:, 0], d))[:5]]
    for blocks in (10, 1_000):
        out = models.knn_predict(train, test, features="embedding", label="y", key="vec_id", train_block=blocks, test_block=blocks)
        assert {r["vec_id"]: [n["key"] for n in r["near"]] for r in out.collect()} == want


def test_pca_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 4)) @ rng.normal(size=(4, 4))
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{n} double" for n in names))
    z = (x - x.mean(0)) / x.std(0)
    eigen = np.sort(np.linalg.eigvalsh(np.cov(z.T)))[::-1]
    model, k = selection.fit_pca_share(df, names, 0.95)
    shares = [r["explained"] for r in selection.explained_variance(model, df).orderBy("component").collect()]
    assert np.allclose(shares, eigen / eigen.sum(), atol=1e-8)
    assert k == int(np.searchsorted(np.cumsum(eigen / eigen.sum()), 0.95) + 1)


def test_elimination_keeps_the_informative_feature(spark):
    rng = np.random.default_rng(2)
    rows = [(int(v > 0), float(v), *map(float, rng.normal(size=3))) for v in rng.normal(size=300)]
    df = spark.createDataFrame(rows, "y int, good double, n1 double, n2 double, n3 double")
    out = selection.recursive_elimination(df, ["n1", "good", "n2", "n3"], "y", keep=1, trees=5, depth=3)
    ranks = {r["feature"]: (r["ranking"], r["selected"]) for r in out.collect()}
    assert ranks["good"] == (1, True) and sorted(r for r, _ in ranks.values()) == [1, 2, 3, 4]


PREDICTIONS = [(0, 0, 0.1), (0, 1, 0.6), (1, 1, 0.6), (1, 0, 0.4)]


def test_auc_with_ties_and_one_class(spark):
    df = spark.createDataFrame(PREDICTIONS, "y int, p int, s double")
    assert E.roc_auc(df, "y", "s").first()["auc"] == pytest.approx(0.625)
    assert E.roc_auc(df.where("y = 1"), "y", "s").first()["auc"] == 0.5
    none = E.attack_metrics(df.withColumn("p", F.lit(0)), "y", "p").first()
    assert none["precision_attack"] == 0.0 and none["f1_attack"] == 0.0


def test_folds_and_curve(spark, sf_dir):
    rows = flow_table(spark, sf_dir)
    folded = sampling.stratified_folds(rows, label="Label", key="row_key", folds=3)
    sizes = [r["count"] for r in folded.groupBy("Label", "fold").count().collect()]
    by_class = {r["Label"]: r["count"] for r in rows.groupBy("Label").count().collect()}
    assert sum(sizes) == sum(by_class.values())
    for label, n in by_class.items():
        parts = [r["count"] for r in folded.where(F.col("Label") == label).groupBy("fold").count().collect()]
        assert max(parts) - min(parts) <= 1 and sum(parts) == n
    make = lambda n: models.build_pipeline("NB", ["l_quantity", "l_tax"], label="Label", weighted=False)
    curve = models.learning_curve(rows, make, label="Label", key="row_key", fractions=(0.3, 1.0), folds=2).orderBy("fraction").collect()
    assert curve[0]["train_rows"] < curve[1]["train_rows"]


def test_live_levels_by_app_agree_with_literal_cuts(spark):
    """The stream-static join gives each application its own cuts; a missing one leaves the lowest level."""
    from flowsieve.operators.windows import ProbeSettings
    from flowsieve.streaming import live

    columns = "app string, event_count_window long, unique_dest_ip_window long, unique_dest_port_window long, total_bytes_window long, total_pkts_window long, base_alert_positive_count_window long, no_alert_count_window long"
    rows = [(app, n, n, 1, 10 * n, n, 0, n) for app in ("tls", "dns", "new") for n in (1, 40, 4000)]
    windows = spark.createDataFrame(rows, columns)
    cuts = {"tls": {"p90": 1.0, "p95": 2.0, "p99": 3.0}, "dns": {"p90": 100.0, "p95": 200.0, "p99": 300.0}}
    table = spark.createDataFrame([(a, c["p90"], c["p95"], c["p99"]) for a, c in cuts.items()], "app string, p90 double, p95 double, p99 double")
    joined = live.live_levels_by_app(windows.where("app = 'tls'").drop("app"), table, F.lit("tls"), ProbeSettings())
    literal = live.live_levels(windows.where("app = 'tls'"), cuts["tls"], ProbeSettings())
    want = {(r["event_count_window"], r["probe_level"]) for r in literal.collect()}
    assert {(r["event_count_window"], r["probe_level"]) for r in joined.collect()} == want
    lost = live.live_levels_by_app(windows.where("app = 'new'").drop("app"), table, F.lit("new"), ProbeSettings())
    assert {r["probe_level"] for r in lost.collect()} == {"low"}


def test_metric_conditions(spark):
    from flowsieve.operators.history import apply_conditions

    rows = [(1, 0.9, 0.95), (2, 0.9, 0.5), (3, None, 0.99), (4, float("nan"), 0.99)]
    runs = spark.createDataFrame(rows, "id int, f1 double, auc double")
    ids = lambda conditions: sorted(r.id for r in apply_conditions(runs, conditions).collect())
    assert ids([("F1_Score", ">", 0.8), ("roc_auc", ">=", 0.9)]) == [1]
    assert ids([("f1", "!=", 0.5)]) == [1, 2] and ids([]) == [1, 2, 3, 4]
    assert ids(runs["auc"] > 0.97) == [3, 4]
    for bad in (("colour", ">", 1), ("f1", "or", 1), ("f1", ">", "x")):
        with pytest.raises(ValueError):
            apply_conditions(runs, [bad])
