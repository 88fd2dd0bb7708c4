"""Report aggregates over exported feature rows of every event."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsieve.functions import labels
from flowsieve.operators import evaluation, refine, reports, screening
from flowsieve.operators import features as X
from flowsieve.operators.sampling import row_hash_split
from flowsieve.plans.catalogue import Query
from flowsieve.plans.catalogue.feature_queries import APP_SQL, BASE, _CLASS, _RATE_SQL, _RATIO_SQL
from flowsieve.plans.catalogue.sampling_queries import unit_sql
from flowsieve.plans.catalogue.window_queries import DAY, POSITIVE, day_records, window_ctes
from flowsieve.plans.stand_in import EVENT_COLUMNS, event_cte, event_records, flat_events, run_cte, run_table
from flowsieve.session import cut_lineage

APP = "tls"


def report_rows(spark, sf_dir):
    """Feature rows with window columns, labels and split.

    A row of a suspicious window counts as refined here; the full cascade is checked by its
    own queries.
    """
    events = refine.attach_windows(event_records(spark, sf_dir), day_records(spark, sf_dir), DAY)
    positive = labels.base_positive(F.col("event_type"), F.col("alert"))
    refined = F.when(positive | (F.col("is_suspicious_window") == 1), 1).otherwise(0)
    marked = events.withColumns(
        {
            "Target_alert": positive.cast("int"),
            "Target_refined": refined,
            "label_source": F.when(positive, "alert_confirmed")
            .when(refined == 1, "probe_refined_same_window")
            .otherwise("benign_no_evidence"),
        }
    )
    keep = [
        "row_id",
        "ts",
        *refine.PROBE_INT_COLUMNS,
        *refine.PROBE_DOUBLE_COLUMNS,
        "Target_alert",
        "Target_refined",
        "label_source",
    ]
    rows = X.add_computed(X.base_rows(marked, APP, keep=keep), APP)
    return row_hash_split(rows, seed=42, parts=("row_id",))


# ``ev`` comes with the window expressions already; only ``base`` is added.
_BASE_ONLY = BASE[BASE.index("base AS (") :]
REPORT = f"""{window_ctes()}, {_BASE_ONLY},
rep AS (SELECT base.*, {', '.join(f'{e} AS {n}' for n, e in {**_RATE_SQL, **_RATIO_SQL}.items())},
  {_CLASS.format(p='base.src_port')} AS src_port_class, {_CLASS.format(p='base.dest_port')} AS dest_port_class,
  coalesce(rec.event_count_window, 0) AS event_count_window, coalesce(unique_dest_ip_window, 0) AS unique_dest_ip_window,
  coalesce(unique_dest_port_window, 0) AS unique_dest_port_window, coalesce(total_bytes_window, 0) AS total_bytes_window,
  coalesce(total_pkts_window, 0) AS total_pkts_window, coalesce(probe_score_no_alert, 0) AS probe_score_no_alert,
  coalesce(probe_score_with_alert, 0) AS probe_score_with_alert,
  CASE WHEN pos.positive THEN 1 ELSE 0 END AS Target_alert,
  CASE WHEN pos.positive OR coalesce(is_suspicious_window, 0) = 1 THEN 1 ELSE 0 END AS Target_refined,
  CASE WHEN pos.positive THEN 'alert_confirmed' WHEN coalesce(is_suspicious_window, 0) = 1 THEN 'probe_refined_same_window'
       ELSE 'benign_no_evidence' END AS label_source,
  CASE WHEN {unit_sql(42, 'CAST(base.row_id AS VARCHAR)')} < 0.8 THEN 'train' ELSE 'test' END AS split
  FROM base JOIN (SELECT row_id, {POSITIVE} AS positive FROM ev) pos ON pos.row_id = base.row_id
  LEFT JOIN rec ON rec.window_start = time_bucket(INTERVAL 1 DAY, base.ts) AND rec.src_ip = base.src_ip)"""


def _distribution(spark, sf_dir):
    return reports.label_distribution(report_rows(spark, sf_dir))


def _counts(spark, sf_dir):
    return reports.exact_counts(report_rows(spark, sf_dir))


def _by_target(spark, sf_dir):
    return reports.counts_by_target(report_rows(spark, sf_dir))


def _flattened(spark, sf_dir):
    return reports.flattened_counts(report_rows(spark, sf_dir), APP)


def _summary(spark, sf_dir):
    out = reports.numeric_summary(report_rows(spark, sf_dir), reports.SUMMARY_FEATURES)
    return out.withColumns({c: F.round(c, 3) for c in ("sum", "mean", "min", "max")})


def _histograms(spark, sf_dir):
    return reports.histograms(report_rows(spark, sf_dir))


def _comparison(spark, sf_dir):
    return reports.label_comparison(report_rows(spark, sf_dir))


def _box(spark, sf_dir):
    # Several passes: they read the exported columns, as a report does.
    exported = cut_lineage(report_rows(spark, sf_dir).select(*reports.BOX_FEATURES, "Target_refined"), "exported")
    out = reports.box_statistics(exported)
    return out.withColumns({c: F.round(c, 6) for c in ("q25", "median", "q75", "low_whisker", "high_whisker")})


def _lowest(spark, sf_dir):
    rows = event_records(spark, sf_dir).select(
        "row_id", "ts", "app_proto", "src_ip", "dest_ip", F.col("alert.severity").alias("alert_severity"),
        F.col("ssh.protocol").alias("ssh_protocol"),
    )
    return reports.lowest_availability(screening.availability(rows), 4).withColumn(
        "availability_ratio", F.round("availability_ratio", 9)
    )


def _lowest_events(spark, sf_dir):
    """The 20 event columns that are filled least, of all of them."""
    rows = flat_events(spark, sf_dir).select(*_EVENT_NAMES)
    return reports.lowest_availability(screening.availability(rows)).withColumn("availability_ratio", F.round("availability_ratio", 9))


def _best_per_app(spark, sf_dir):
    best = evaluation.best_per_group(run_table(spark, sf_dir), "pipeline_id", ["f1", "auc"], keys=("id",))
    return best.select("pipeline_id", "f1", "auc")


def _target_sums(spark, sf_dir):
    per_app = (
        report_rows(spark, sf_dir)
        .groupBy("event_type", F.col("Target_refined").alias("target"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    return reports.summed_target_counts(per_app)


def _stages(spark, sf_dir):
    runs = run_table(spark, sf_dir).select(
        F.col("pipeline_id").alias("app"),
        F.col("dataset_type").alias("stage"),
        "status",
        F.col("duration_seconds").alias("seconds"),
        F.struct("created_at", "id").alias("finished_at"),
    )
    return reports.stage_table(runs)


_GROUP_SQL = {
    "split": "split",
    "target": "CAST(Target_refined AS VARCHAR)",
    "event_type": "event_type",
    "proto": "proto",
    "app_proto": "coalesce(nullif(app_proto, ''), 'unknown')",
    "alert_severity": "CAST(alert_severity AS VARCHAR)",
    "alert_category": "coalesce(nullif(alert_category, ''), 'none')",
    "label_source": "label_source",
    "dest_port": "CAST(dest_port AS VARCHAR)",
    "src_port_class": "CAST(src_port_class AS VARCHAR)",
    "dest_port_class": "CAST(dest_port_class AS VARCHAR)",
}
_TOP = "('event_type', 'app_proto', 'alert_category', 'dest_port')"


def _counts_sql(names, extra="") -> str:
    body = " UNION ALL ".join(f"SELECT '{n}' AS \"group\", {_GROUP_SQL[n]} AS key, count(*) AS count FROM rep GROUP BY 2" for n in names)
    return (
        f"WITH {REPORT}, c AS ({body}), r AS (SELECT *, row_number() OVER (PARTITION BY \"group\" ORDER BY count DESC, key) AS rk FROM c) "
        f"SELECT {extra}\"group\", key, count FROM r WHERE rk <= 30 OR \"group\" NOT IN {_TOP}"
    )


def _summary_sql() -> str:
    body = " UNION ALL ".join(
        f"SELECT CAST(Target_refined AS VARCHAR) AS target, '{f}' AS feature, CAST({f} AS DOUBLE) AS x FROM rep "
        f"UNION ALL SELECT 'all', '{f}', CAST({f} AS DOUBLE) FROM rep"
        for f in reports.SUMMARY_FEATURES
    )
    return (
        f"WITH {REPORT}, l AS ({body}) SELECT target, feature, count(x) AS count, count(*) - count(x) AS missing, "
        "count(*) FILTER (x <> 0) AS nonzero, round(min(x), 3) AS min, round(max(x), 3) AS max, round(sum(x), 3) AS sum, "
        "round(avg(x), 3) AS mean FROM l GROUP BY ALL"
    )


_DECADE = (
    "CASE WHEN x <= 0 THEN '0' WHEN x <= 1 THEN '0-1' WHEN x <= 10 THEN '1-10' WHEN x <= 100 THEN '10-100' WHEN x <= 1000 THEN "
    "'100-1K' WHEN x <= 10000 THEN '1K-10K' WHEN x <= 100000 THEN '10K-100K' WHEN x <= 1000000 THEN '100K-1M' ELSE '>1M' END"
)
_QUARTER = (
    "CASE WHEN x <= 0 THEN '0' WHEN x < 0.25 THEN '0-0.25' WHEN x < 0.5 THEN '0.25-0.50' WHEN x < 0.75 THEN '0.50-0.75' WHEN x < 1 "
    "THEN '0.75-1.00' ELSE '>=1.00' END"
)
_HIST = " UNION ALL ".join(
    f"SELECT Target_refined AS target, '{f}' AS feature, CAST({f} AS DOUBLE) AS x FROM rep" for f in reports.HISTOGRAM_FEATURES
)
_BOX = " UNION ALL ".join(
    f"SELECT Target_refined AS target, '{f}' AS feature, CAST({f} AS DOUBLE) AS x FROM rep" for f in reports.BOX_FEATURES
)

_EVENT_NAMES = [name for name, _ in EVENT_COLUMNS]

QUERIES = [
    Query(
        "i1_label_distribution",
        _distribution,
        f"WITH {REPORT} SELECT 'Target_refined' AS label_type, CAST(Target_refined AS VARCHAR) AS key, count(*) AS count FROM rep "
        "GROUP BY 2 UNION ALL SELECT 'Target_alert', CAST(Target_alert AS VARCHAR), count(*) FROM rep GROUP BY 2 UNION ALL "
        "SELECT 'label_source', label_source, count(*) FROM rep GROUP BY 2",
    ),
    Query("i2_exact_counts", _counts, _counts_sql(reports.COUNT_GROUPS)),
    Query(
        "i3_counts_by_target",
        _by_target,
        f"WITH {REPORT} "
        + " UNION ALL ".join(
            f"SELECT CAST(Target_refined AS VARCHAR) AS target, '{n}' AS \"group\", {_GROUP_SQL[n]} AS key, count(*) AS count "
            "FROM rep GROUP BY 1, 3"
            for n in reports.BY_TARGET_GROUPS
        ),
    ),
    Query("i4_numeric_summary", _summary, _summary_sql()),
    Query(
        "i5_histograms",
        _histograms,
        f"WITH {REPORT}, l AS ({_HIST}) SELECT target, feature, CASE WHEN feature LIKE '%\\_ratio' ESCAPE '\\' OR feature IN "
        f"('probe_score_no_alert', 'probe_score_with_alert') THEN {_QUARTER} ELSE {_DECADE} END AS bucket, count(*) AS count "
        "FROM l GROUP BY ALL",
    ),
    Query("i6_flattened_counts", _flattened, _counts_sql(reports.COUNT_GROUPS, f"'{APP}' AS app, ")),
    Query(
        "i7_label_comparison",
        _comparison,
        f"WITH {REPORT} SELECT 'initial' AS stage, CAST(Target_alert AS VARCHAR) AS label, count(*) AS count FROM rep GROUP BY 2 "
        "UNION ALL SELECT 'refined', CAST(Target_refined AS VARCHAR), count(*) FROM rep GROUP BY 2",
    ),
    Query(
        "i8_box_statistics",
        _box,
        f"WITH {REPORT}, l AS ({_BOX}), q AS (SELECT feature, target, count(*) AS n, quantile_cont(x, 0.25) AS a, "
        "quantile_cont(x, 0.5) AS b, quantile_cont(x, 0.75) AS c FROM l GROUP BY ALL) SELECT q.feature, q.target, "
        "any_value(q.n) AS n, round(any_value(a), 6) AS q25, round(any_value(b), 6) AS median, round(any_value(c), 6) AS q75, "
        "round(min(x) FILTER (x BETWEEN a - 1.5 * (c - a) AND c + 1.5 * (c - a)), 6) AS low_whisker, "
        "round(max(x) FILTER (x BETWEEN a - 1.5 * (c - a) AND c + 1.5 * (c - a)), 6) AS high_whisker "
        "FROM l JOIN q ON l.feature = q.feature AND l.target = q.target GROUP BY q.feature, q.target",
    ),
    Query(
        "i9_lowest_availability",
        _lowest,
        f"WITH {BASE}, a AS (SELECT count(*) AS n, count(ts) AS ts, count(lp) FILTER (lp <> '') AS app_proto, "
        "count(*) FILTER (src_ip <> '') AS src_ip, count(*) FILTER (dest_ip <> '') AS dest_ip, "
        "(SELECT count(alert_severity) FROM ev WHERE alert_there) AS alert_severity, "
        f"count(*) FILTER ({APP_SQL['ssh']['ssh_protocol']} <> '') AS ssh_protocol, count(row_id) AS row_id FROM base), "
        "l AS (UNPIVOT a ON ts, app_proto, src_ip, dest_ip, alert_severity, ssh_protocol, row_id INTO NAME \"column\" VALUE present) "
        "SELECT \"column\", n AS rows, present, n - present AS missing, round(present / n, 9) AS availability_ratio FROM l "
        "ORDER BY availability_ratio, \"column\" LIMIT 4",
    ),
    Query(
        "i9_lowest_event_columns",
        _lowest_events,
        f"WITH {event_cte()}, l AS ("
        + " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) FILTER (CAST({c} AS VARCHAR) <> '') AS present FROM ev" for c in _EVENT_NAMES
        )
        + ') SELECT "column", rows, present, rows - present AS missing, round(present / rows, 9) AS availability_ratio FROM l ORDER BY present / rows, "column" LIMIT 20',
    ),
    Query(
        "i10_best_per_group",
        _best_per_app,
        f"WITH {run_cte()}, r AS (SELECT *, row_number() OVER (PARTITION BY pipeline_id ORDER BY f1 DESC NULLS LAST, "
        "auc DESC NULLS LAST) AS n FROM runs) SELECT pipeline_id, f1, auc FROM r WHERE n = 1",
    ),
    Query(
        "i10_summed_targets",
        _target_sums,
        f"WITH {REPORT} SELECT count(*) FILTER (Target_refined = 0) AS benign, count(*) FILTER (Target_refined = 1) AS attack FROM rep",
    ),
    Query(
        "i10_stage_status",
        _stages,
        f"WITH {run_cte()}, r AS (SELECT *, row_number() OVER (PARTITION BY pipeline_id, dataset_type ORDER BY created_at DESC, "
        "id DESC) AS n FROM runs) SELECT pipeline_id AS app, dataset_type AS stage, status, duration_seconds AS seconds FROM r WHERE n = 1",
    ),
]
