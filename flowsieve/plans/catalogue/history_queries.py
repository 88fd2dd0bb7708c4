"""Run-history analytics over the run stand-in."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsieve.operators import history as H
from flowsieve.plans.catalogue import Query
from flowsieve.plans.stand_in import event_cte, flat_events, read_table, run_cte, run_table

NOW = "1998-06-01 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp")


def _by_status(spark, sf_dir):
    return H.runs_by_status(run_table(spark, sf_dir), "RUNNING").select("id", "created_at").withColumn(
        "created_at", F.date_format("created_at", "yyyy-MM-dd")
    )


def _by_id(spark, sf_dir):
    return H.run_by_id(run_table(spark, sf_dir), "run-7").select("id", "status", "pipeline_id")


def _active(spark, sf_dir):
    return H.active_per_owner(run_table(spark, sf_dir))


def _recent(spark, sf_dir):
    return H.recent_per_owner(run_table(spark, sf_dir), _now(), 60 * 24 * 365, 40)


def _stale(spark, sf_dir):
    return H.stale_runs(run_table(spark, sf_dir), _now(), 120).select("id", "status")


def _fail_stale(spark, sf_dir):
    return H.fail_stale(run_table(spark, sf_dir), _now(), 120).groupBy("status").agg(F.count(F.lit(1)).alias("runs"))


def _per_pipeline(spark, sf_dir):
    runs = run_table(spark, sf_dir)
    every = H.runs_per_pipeline(runs).select(F.lit("all").alias("scope"), "pipeline_id", "runs")
    return every.unionByName(H.runs_per_pipeline(runs, "flow").select(F.lit("flow").alias("scope"), "pipeline_id", "runs"))


def _rows(spark, sf_dir):
    runs = run_table(spark, sf_dir).withColumn("params_used", F.create_map(F.lit("n_estimators"), F.col("n_estimators")))
    out = H.run_rows(runs, ["n_estimators"])
    return out.select(
        "id", "short_id", "short_hash", "shown_owner", "mode", "param_n_estimators", H.duration_text(F.col("duration_seconds")).alias("duration")
    )


def _comparison(spark, sf_dir):
    runs = run_table(spark, sf_dir)
    return H.comparison(runs, ["pipeline_id", "dataset_type", "status", "f1", "n_estimators"])


def _only_differences(spark, sf_dir):
    runs = run_table(spark, sf_dir).where(F.col("pipeline_id") == "flow.knn")
    return H.comparison(runs, ["pipeline_id", "dataset_type", "status"], only_differences=True).select("field", "distinct_values")


def _side_by_side(spark, sf_dir):
    out = H.side_by_side(run_table(spark, sf_dir), ["run-1", "run-2"], ["pipeline_id", "dataset_type", "status"])
    return out.select("field", F.col("`run-1`").alias("left_value"), F.col("`run-2`").alias("right_value"), "differs")


def _warnings(spark, sf_dir):
    runs = run_table(spark, sf_dir)
    return H.comparison_warnings(runs, "dataset_type")


def _options(spark, sf_dir):
    return H.filter_options(run_table(spark, sf_dir))


def _top(spark, sf_dir):
    runs = run_table(spark, sf_dir)
    return runs.orderBy(F.col("f1").desc_nulls_last(), "id").limit(25).select("id", "f1")


def _running_sum(spark, sf_dir):
    """Greedy allotment of 1,000 units over runs ordered by creation day, then id hash."""
    from flowsieve.functions.hashing import hash60
    from flowsieve.operators.allocate import hash_levels, prefix_allocate

    runs = run_table(spark, sf_dir).select("id", "created_at", F.pmod("duration_seconds", F.lit(9)).alias("wanted"))
    key = hash60(F.col("id"))
    out = prefix_allocate(
        runs,
        quota=1000,
        levels=[F.unix_date(F.to_date("created_at")), *hash_levels(key)],
        tie=[key, F.col("id")],
        weight=F.col("wanted"),
    )
    return out.select("id", "wanted", "alloc")


def _rank(spark, sf_dir):
    """The three earliest runs of every owner."""
    from flowsieve.functions.hashing import hash60
    from flowsieve.operators.allocate import hash_levels, take_prefix

    runs = run_table(spark, sf_dir).withColumn("owner", F.coalesce("owner", F.lit("-")))
    key = hash60(F.col("id"))
    out = take_prefix(
        runs, group=["owner"], quota=3, levels=[F.unix_date(F.to_date("created_at")), *hash_levels(key)], tie=[key, F.col("id")]
    )
    return out.select("owner", "id")


def _mark(spark, sf_dir):
    return H.mark_best(run_table(spark, sf_dir), "dataset_type", ["f1", "auc"]).select("id", "best_f1", "best_auc")


def _page(spark, sf_dir):
    rows, total = H.page(run_table(spark, sf_dir), limit=50, offset=100)
    return rows.select("id", F.lit(total).cast("bigint").alias("total"))


def _name_sets(spark, sf_dir):
    """Set algebra on the value sets of two columns."""
    from flowsieve.operators.selection import feature_set_columns

    events = flat_events(spark, sf_dir)
    proto = F.lower("app_proto")
    # Grouped first, so the collected arrays hold a handful of distinct names.
    names = events.select(F.explode(F.array(F.struct(F.lit("a").alias("s"), proto.alias("v")), F.struct(F.lit("b").alias("s"), F.col("event_type").alias("v")))).alias("x"))
    distinct = names.select("x.*").where(F.col("v").isNotNull()).groupBy("s", "v").count()
    both = distinct.groupBy().agg(
        F.array_sort(F.collect_list(F.when(F.col("s") == "a", F.col("v")))).alias("first"),
        F.array_sort(F.collect_list(F.when(F.col("s") == "b", F.col("v")))).alias("second"),
    )
    out = feature_set_columns(both, "first", "second")
    return out.select(*[F.array_join(F.array_sort(c), ",").alias(c) for c in ("intersection", "union", "only_first")])


def _first_seen(spark, sf_dir):
    return H.first_seen_distinct(read_table(spark, sf_dir, "conversations"), "role", "conv_id")


_OWNER = "coalesce(nullif(owner, ''), 'anonymous')"
_MODE = "coalesce(nullif(lower(trim(run_mode)), ''), 'official')"
_FIELDS = ("pipeline_id", "dataset_type", "status", "f1", "n_estimators")
_HASH = "('0x' || substr(md5(id), 1, 15))::BIGINT"
_DURATION = (
    "CASE WHEN duration_seconds >= 3600 THEN printf('%dh %02dm %02ds', duration_seconds // 3600, duration_seconds % 3600 // 60, "
    "duration_seconds % 60) WHEN duration_seconds >= 60 THEN printf('%dm %02ds', duration_seconds // 60, duration_seconds % 60) "
    "ELSE printf('%ds', duration_seconds) END"
)

QUERIES = [
    Query(
        "m1_runs_by_status",
        _by_status,
        f"WITH {run_cte()} SELECT id, strftime(created_at, '%Y-%m-%d') AS created_at FROM runs WHERE status = 'RUNNING'",
    ),
    Query("m1_run_by_id", _by_id, f"WITH {run_cte()} SELECT id, status, pipeline_id FROM runs WHERE id = 'run-7'"),
    Query(
        "m2_active_per_owner",
        _active,
        f"WITH {run_cte()} SELECT {_OWNER} AS owner, count(*) FILTER (status IN ('QUEUED', 'RUNNING')) AS active FROM runs GROUP BY 1",
    ),
    Query(
        "m3_recent_per_owner",
        _recent,
        f"WITH {run_cte()} SELECT {_OWNER} AS owner, count(*) AS recent, count(*) >= 40 AS limited FROM runs WHERE created_at >= "
        f"TIMESTAMP '{NOW}' - INTERVAL 365 DAY GROUP BY 1",
    ),
    Query(
        "m4_stale_runs",
        _stale,
        f"WITH {run_cte()} SELECT id, status FROM runs WHERE status IN ('QUEUED', 'RUNNING') AND created_at < TIMESTAMP '{NOW}' - "
        "INTERVAL 120 MINUTE",
    ),
    Query(
        "m4_fail_stale",
        _fail_stale,
        f"WITH {run_cte()} SELECT CASE WHEN status IN ('QUEUED', 'RUNNING') AND created_at < TIMESTAMP '{NOW}' - INTERVAL 120 MINUTE "
        "THEN 'FAILED' ELSE status END AS status, count(*) AS runs FROM runs GROUP BY 1",
    ),
    Query(
        "m5_runs_per_method",
        _per_pipeline,
        f"WITH {run_cte()} SELECT 'all' AS scope, pipeline_id, count(*) AS runs FROM runs GROUP BY 2 UNION ALL SELECT 'flow', pipeline_id, "
        "count(*) FROM runs WHERE pipeline_id LIKE 'flow.%' GROUP BY 2",
    ),
    Query(
        "m6_run_rows",
        _rows,
        f"WITH {run_cte()} SELECT id, left(id, 8) AS short_id, left(dataset_hash, 12) AS short_hash, coalesce(nullif(owner, ''), 'system') AS "
        f"shown_owner, {_MODE} AS mode, n_estimators AS param_n_estimators, {_DURATION} AS duration FROM runs",
    ),
    Query(
        "m7_field_comparison",
        _comparison,
        f"WITH {run_cte()}, l AS ("
        + " UNION ALL ".join(f"SELECT '{f}' AS field, coalesce(CAST({f} AS VARCHAR), '-') AS v FROM runs" for f in _FIELDS)
        + ") SELECT field, count(*) AS runs, count(DISTINCT v) AS distinct_values, min(v) AS lowest, max(v) AS highest, "
        "count(DISTINCT v) > 1 AS differs FROM l GROUP BY field",
    ),
    Query(
        "m7_only_differences",
        _only_differences,
        f"WITH {run_cte()}, k AS (SELECT * FROM runs WHERE pipeline_id = 'flow.knn'), l AS (SELECT 'dataset_type' AS field, dataset_type AS v "
        "FROM k UNION ALL SELECT 'status', status FROM k UNION ALL SELECT 'pipeline_id', pipeline_id FROM k) SELECT field, count(DISTINCT v) "
        "AS distinct_values FROM l GROUP BY field HAVING count(DISTINCT v) > 1",
    ),
    Query(
        "m7_side_by_side",
        _side_by_side,
        f"WITH {run_cte()}, l AS ("
        + " UNION ALL ".join(f"SELECT id, '{f}' AS field, {f} AS v FROM runs WHERE id IN ('run-1', 'run-2')" for f in _FIELDS[:3])
        + ") SELECT field, max(v) FILTER (id = 'run-1') AS left_value, max(v) FILTER (id = 'run-2') AS right_value, "
        "max(v) FILTER (id = 'run-1') <> max(v) FILTER (id = 'run-2') AS differs FROM l GROUP BY field",
    ),
    Query(
        "m8_comparison_warnings",
        _warnings,
        f"WITH {run_cte()} SELECT count(DISTINCT {_MODE}) > 1 AS mixed_mode, count(DISTINCT dataset_type) > 1 AS mixed_family, "
        "count(DISTINCT nullif(dataset_hash, '')) > 1 AS different_dataset FROM runs",
    ),
    Query(
        "m9_filter_options",
        _options,
        f"WITH {run_cte()} SELECT DISTINCT 'pipeline' AS field, pipeline_id AS value FROM runs UNION ALL SELECT DISTINCT 'dataset', dataset_type "
        "FROM runs UNION ALL SELECT DISTINCT 'status', status FROM runs UNION ALL SELECT 'mode', 'official' UNION ALL SELECT 'mode', 'exploration'",
    ),
    Query("l1_sorted_top_k", _top, f"WITH {run_cte()} SELECT id, f1 FROM runs ORDER BY f1 DESC NULLS LAST, id LIMIT 25"),
    Query(
        "l2_running_allotment",
        _running_sum,
        f"WITH {run_cte()}, w AS (SELECT id, duration_seconds % 9 AS wanted, coalesce(sum(duration_seconds % 9) OVER (ORDER BY "
        f"CAST(created_at AS DATE), {_HASH}, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM runs) "
        "SELECT id, wanted, CAST(greatest(0, least(wanted, 1000 - before)) AS BIGINT) AS alloc FROM w",
    ),
    Query(
        "l3_rank_in_group",
        _rank,
        f"WITH {run_cte()}, r AS (SELECT coalesce(owner, '-') AS owner, id, row_number() OVER (PARTITION BY coalesce(owner, '-') ORDER BY "
        f"CAST(created_at AS DATE), {_HASH}, id) AS n FROM runs) SELECT owner, id FROM r WHERE n <= 3",
    ),
    Query(
        "l4_family_best",
        _mark,
        f"WITH {run_cte()} SELECT id, coalesce(f1 = max(f1) OVER (PARTITION BY dataset_type), false) AS best_f1, "
        "coalesce(auc = max(auc) OVER (PARTITION BY dataset_type), false) AS best_auc FROM runs",
    ),
    Query(
        "l5_page",
        _page,
        f"WITH {run_cte()} SELECT id, (SELECT count(*) FROM runs) AS total FROM runs ORDER BY created_at DESC, id LIMIT 50 OFFSET 100",
    ),
    Query(
        "l6_name_sets",
        _name_sets,
        f"WITH {event_cte()}, a AS (SELECT DISTINCT lower(app_proto) AS v FROM ev WHERE app_proto IS NOT NULL), b AS (SELECT DISTINCT "
        "event_type AS v FROM ev) SELECT (SELECT string_agg(v, ',' ORDER BY v) FROM a WHERE v IN (SELECT v FROM b)) AS intersection, "
        "(SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT v FROM a UNION SELECT v FROM b)) AS \"union\", "
        "(SELECT string_agg(v, ',' ORDER BY v) FROM a WHERE v NOT IN (SELECT v FROM b)) AS only_first",
    ),
    Query(
        "l7_first_seen_distinct",
        _first_seen,
        "SELECT trim(role) AS role, min(conv_id) AS conv_id FROM conversations WHERE trim(coalesce(role, '')) <> '' GROUP BY 1",
    ),
]
