"""Leakage policy applied to rows, correlation screening, column availability.

Feature metadata itself is fixed and small, so it is covered by unit tests; here the
policies run over whole tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsieve.operators import manifest, screening
from flowsieve.plans.catalogue import Query
from flowsieve.plans.catalogue.report_queries import REPORT, report_rows
from flowsieve.plans.stand_in import EVENT_COLUMNS, FLOW_FEATURES, event_cte, flat_events, flow_cte, flow_table

# Two extra columns: one constant and one text column.
SCREENED = (*FLOW_FEATURES, "flat", "words")


def _screen_table(spark, sf_dir):
    return flow_table(spark, sf_dir).withColumns({"flat": F.lit(3.0), "words": F.col("l_linestatus"), "leak": F.col("Label") * 2.0})


def _facts(spark, sf_dir, features=SCREENED):
    return screening.correlation_facts(_screen_table(spark, sf_dir), "Label", features)


def _modeling(spark, sf_dir):
    rows = manifest.modeling_projection(report_rows(spark, sf_dir), "Target_refined", keep=["row_id"])
    leaked = [c for c in rows.columns if c not in ("row_id", "Target_refined") and manifest.is_forbidden(c, "Target_refined")]
    return rows.select("row_id", "src_port", "total_bytes", "Target_refined", F.lit(len(leaked)).alias("leaked"))


def _classified_values(spark, sf_dir):
    """Policy reason per exported column, with the rows that carry a value in it."""
    rows = report_rows(spark, sf_dir).select("Target_alert", "alert_category", "src_ip", "event_type_h", "proto_h", "total_bytes")
    counts = screening.availability(rows)
    return counts.select(
        "column", F.coalesce(manifest.drop_reason(F.col("column")), F.lit("kept")).alias("reason"), "present"
    )


def _correlation(spark, sf_dir):
    table = screening.correlation_table(_facts(spark, sf_dir))
    return table.select("feature", F.round("correlation", 9).alias("correlation"), "n")


def _issues(spark, sf_dir):
    issues = screening.correlation_issues(_facts(spark, sf_dir), "Label")
    return issues.withColumn("sd", F.round("sd", 9))


def _before_after(spark, sf_dir):
    facts = _facts(spark, sf_dir, (*FLOW_FEATURES, "leak"))
    out = screening.correlation_before_after(facts, ["leak"], k=3)
    return out.select("stage", "feature", F.round("abs_corr", 9).alias("abs_corr"))


def _matrix(spark, sf_dir):
    out = screening.correlation_matrix(_screen_table(spark, sf_dir), "Label", SCREENED)
    return out.withColumn("correlation", F.round(F.col("correlation") + 0.0, 6))


def _prepared(spark, sf_dir):
    out = screening.prepare_features(_screen_table(spark, sf_dir), "Label", SCREENED)
    return out.data.groupBy("Label").agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(",".join(out.features)).alias("features"),
        F.lit(",".join(f"{k}={v}" for k, v in sorted(out.removed.items()))).alias("removed"),
        F.round(F.sum("l_tax"), 4).alias("tax"),
    )


def _aligned(spark, sf_dir):
    out = screening.align_columns(flow_table(spark, sf_dir), ["l_tax", "never_seen", "l_quantity"], keep=["row_key"])
    return out


def _availability(spark, sf_dir):
    rows = flat_events(spark, sf_dir).select(*_EVENT_NAMES)
    return screening.availability(rows).withColumn("availability_ratio", F.round("availability_ratio", 9))


def _groups(spark, sf_dir):
    """Feature groups of the exported columns and how many values each group holds."""
    rows = report_rows(spark, sf_dir)
    specs = manifest.combined_specs(manifest.base_specs(spark, "tls"), manifest.computed_rules(spark, "tls"))
    present = screening.availability(rows.select(*[c for c in rows.columns if c in ("src_port", "tls_sni_len", "tls_version_h", "total_pkts", "log_duration")]))
    # The spec table is a fixed list of feature names.
    joined = present.join(F.broadcast(specs), present["column"] == specs["name"])
    return joined.groupBy("group").agg(F.count(F.lit(1)).alias("feature_count"), F.sum("present").alias("present"))


def _resolve(spark, sf_dir):
    """Candidate list by correlation rank, guarded, with the rows behind it."""
    facts = _facts(spark, sf_dir, FLOW_FEATURES)
    ranked = [r["feature"] for r in screening.top_correlations(screening.correlation_table(facts), 10).collect()]
    clean, removed = manifest.resolve_features([[], ["label_source", "x_raw", *sorted(ranked)]], "Label")
    return facts.select(F.max("n").alias("rows")).select(
        "rows", F.lit(",".join(clean)).alias("features"), F.lit(",".join(removed)).alias("removed")
    )


def _corr_sql(names) -> str:
    return " UNION ALL ".join(
        f"SELECT '{n}' AS feature, round(covar_samp({n}, Label) / (stddev_samp({n}) * stddev_samp(Label)), 9) AS correlation, "
        "count(*) AS n FROM fl"
        for n in names
    )


_EVENT_NAMES = [name for name, _ in EVENT_COLUMNS]
_LEAK_CTE = f"{flow_cte()}, lk AS (SELECT *, Label * 2.0 AS leak FROM fl)"
_ABS = " UNION ALL ".join(
    f"SELECT '{n}' AS feature, round(abs(covar_samp({n}, Label) / (stddev_samp({n}) * stddev_samp(Label))), 9) AS abs_corr FROM lk"
    for n in (*FLOW_FEATURES, "leak")
)
_MATRIX_NAMES = ("Label", *FLOW_FEATURES)

QUERIES = [
    Query(
        "g4_column_policy",
        _classified_values,
        f"WITH {event_cte()}, c AS (SELECT count(*) AS n, count(*) FILTER (alert_there) AS alerts, count(*) FILTER (src_ip <> '') AS "
        "src FROM ev) SELECT x.\"column\", x.reason, CASE x.\"column\" WHEN 'alert_category' THEN alerts WHEN 'src_ip' THEN src "
        "ELSE n END AS present FROM c, (VALUES ('Target_alert', 'direct_policy_drop'), ('alert_category', 'direct_policy_drop'), "
        "('src_ip', 'direct_policy_drop'), ('event_type_h', 'direct_policy_drop'), ('proto_h', 'kept'), ('total_bytes', 'kept')) "
        "AS x(\"column\", reason)",
    ),
    Query(
        "g8_modeling_projection",
        _modeling,
        f"WITH {REPORT} SELECT row_id, src_port, total_bytes, Target_refined, 0 AS leaked FROM rep",
    ),
    Query("g10_target_correlation", _correlation, f"WITH {flow_cte()} {_corr_sql(FLOW_FEATURES)}"),
    Query(
        "g11_correlation_issues",
        _issues,
        "SELECT 'flat' AS feature, 'CONSTANT_OR_SINGLE_VALUE' AS issue, 0 AS nulls, 0.0 AS sd UNION ALL "
        "SELECT 'words', 'CONSTANT_OR_SINGLE_VALUE', count(l_linestatus), 0.0 FROM lineitem",
    ),
    Query(
        "g12_correlation_before_after",
        _before_after,
        f"WITH {_LEAK_CTE}, c AS ({_ABS}) SELECT * FROM (SELECT 'before' AS stage, * FROM c ORDER BY abs_corr DESC, feature LIMIT 3) "
        "UNION ALL SELECT * FROM (SELECT 'after', * FROM c WHERE feature <> 'leak' ORDER BY abs_corr DESC, feature LIMIT 3)",
    ),
    Query(
        "g13_correlation_matrix",
        _matrix,
        f"WITH {flow_cte()} "
        + " UNION ALL ".join(
            f"SELECT '{a}' AS feature, '{b}' AS other, round(corr({a}, {b}) + 0.0, 6) AS correlation FROM fl"
            for a in _MATRIX_NAMES
            for b in _MATRIX_NAMES
        ),
    ),
    Query(
        "g14_feature_preparation",
        _prepared,
        f"WITH {flow_cte()} SELECT Label, count(*) AS rows, '{','.join(FLOW_FEATURES)}' AS features, "
        "'flat=constant,words=non_numeric' AS removed, round(sum(l_tax), 4) AS tax FROM fl GROUP BY Label",
    ),
    Query(
        "g15_column_alignment",
        _aligned,
        f"WITH {flow_cte()} SELECT row_key, l_tax, 0.0::DOUBLE AS never_seen, l_quantity FROM fl",
    ),
    Query(
        "g16_availability",
        _availability,
        f"WITH {event_cte()}, l AS ("
        + " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) FILTER (CAST({c} AS VARCHAR) <> '') AS present FROM ev" for c in _EVENT_NAMES
        )
        + ') SELECT "column", rows, present, rows - present AS missing, round(present / rows, 9) AS availability_ratio FROM l',
    ),
    Query(
        "g17_feature_groups",
        _groups,
        f"WITH {event_cte()}, n AS (SELECT count(*) AS c FROM ev) SELECT x.\"group\", x.k AS feature_count, x.k * c AS present FROM n, "
        "(VALUES ('core', 1), ('tls', 2), ('flow', 1), ('log_transform', 1)) AS x(\"group\", k)",
    ),
    Query(
        "g18_resolved_features",
        _resolve,
        f"SELECT count(*) AS rows, '{','.join(sorted(FLOW_FEATURES))}' AS features, 'label_source,x_raw' AS removed FROM lineitem",
    ),
]
