"""Conformance, diagnosis and profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsieve.functions import labels
from flowsieve.operators import quality, routing
from flowsieve.plans.catalogue import Query
from flowsieve.plans.catalogue.routing_queries import _BAD, ROUTED, routed_events
from flowsieve.plans.stand_in import event_cte, event_records, flow_cte, flow_table, write_event_lines
from flowsieve.sources import event_log
from flowsieve.sources.schemas import EVENT_LOG, EVENT_REQUIRED_KEYS, DatasetType

# The stand-in flow table as a data set type: one column it lacks, some it has on top.
STAND_IN = DatasetType("stand_in", "csv", "Label", columns=("l_quantity", "l_tax", "idle_max", "Label"))
LOOSE = DatasetType("loose", "csv", "Label", columns=("l_quantity", "Label"))


def _parsed(spark, sf_dir):
    return event_log.parse_lines(event_log.read_lines(spark, write_event_lines(spark, sf_dir)))


def _bad():
    return labels.base_label("event_type_or_valid_alert", F.col("event_type"), F.col("alert"))


def _columns(spark, sf_dir):
    """Missing and extra columns, each with the rows it concerns."""
    rows = flow_table(spark, sf_dir)
    return quality.column_conformance(rows, STAND_IN.columns).withColumn("rows", F.lit(rows.count()).cast("bigint"))


def _keys(spark, sf_dir):
    return quality.required_keys(_parsed(spark, sf_dir), (*EVENT_REQUIRED_KEYS, "app_proto", "community_id"))


def _labels(spark, sf_dir):
    return quality.label_summary(flow_table(spark, sf_dir), "l_returnflag")


def _key_counts(spark, sf_dir):
    return event_log.key_counts(_parsed(spark, sf_dir))


def _event_types(spark, sf_dir):
    return quality.event_type_counts(event_records(spark, sf_dir))


def _log_facts(spark, sf_dir):
    return quality.event_log_facts(event_records(spark, sf_dir))


def _diagnose_table(spark, sf_dir):
    return quality.diagnose_table(flow_table(spark, sf_dir), STAND_IN, dropped=("row_key",))


def _diagnose_log(spark, sf_dir):
    parsed = _parsed(spark, sf_dir)
    keys = quality.required_keys(parsed, EVENT_REQUIRED_KEYS)
    return quality.diagnose_log(event_log.typed_events(parsed), keys, EVENT_LOG)


def _diagnose_all(spark, sf_dir):
    rows = flow_table(spark, sf_dir)
    return quality.compatible_types(quality.diagnose_types(rows, (STAND_IN, LOOSE, EVENT_LOG)))


def _profile(spark, sf_dir):
    return quality.profile(flow_table(spark, sf_dir), "Label")


def _texts(spark, sf_dir):
    return flow_table(spark, sf_dir).select(
        F.col("l_returnflag"),
        F.when(F.col("l_discount") > 0.05, F.col("l_tax").cast("string")).otherwise("n/a").alias("sometimes"),
        F.col("l_quantity").cast("string").alias("quantity"),
        F.when(F.col("l_quantity") > 1, F.col("l_tax").cast("string")).otherwise("").alias("mostly"),
    )


_NAMES = ["l_returnflag", "sometimes", "quantity", "mostly"]


def _non_numeric(spark, sf_dir):
    return quality.non_numeric_columns(_texts(spark, sf_dir), _NAMES)


def _ratio(spark, sf_dir):
    out = quality.numeric_ratio(_texts(spark, sf_dir), _NAMES)
    return out.withColumn("ratio", F.round("ratio", 9))


def _initial(spark, sf_dir):
    out = quality.initial_counts(routed_events(spark, sf_dir), _bad())
    return out.withColumns({c: F.round(c, 6) for c in ("benign_ratio_percent", "attack_ratio_percent")})


def _share(spark, sf_dir):
    out = quality.label_share(flow_table(spark, sf_dir), "l_linestatus", "l_returnflag")
    return out.withColumn("share", F.round("share", 9))


def _partition(spark, sf_dir):
    return routing.partition_check(routed_events(spark, sf_dir))


_GOOD = "pkts_toserver NOT IN (13, 14)"
_APP_HTTP = "(lower(app_proto) = 'http' OR event_type = 'http')"
_TLS = "(lower(coalesce(app_proto, '')) = 'tls' OR event_type = 'tls' OR src_port IN (443, 8443) OR dest_port IN (443, 8443))"
_EVIDENCE = "(event_type = 'alert' OR (alert_there AND alert_severity IS NOT NULL))"
_SOMETIMES = "count(*) FILTER (l_discount <= 0.05)"

QUERIES = [
    Query(
        "b1_column_conformance",
        _columns,
        "SELECT x.column, x.status, (SELECT count(*) FROM lineitem) AS rows FROM (VALUES ('idle_max', 'missing'), "
        "('row_key', 'extra'), ('l_extendedprice', 'extra'), ('l_discount', 'extra'), ('l_linenumber', 'extra'), "
        "('price_per_unit', 'extra'), ('ship_month', 'extra'), ('l_returnflag', 'extra'), ('l_linestatus', 'extra'), "
        "('l_shipdate', 'extra')) AS x(\"column\", status)",
    ),
    Query(
        "b2_required_keys",
        _keys,
        f"WITH {event_cte()}, g AS (SELECT * FROM ev WHERE {_GOOD}), k AS ("
        + " UNION ALL ".join(
            f"SELECT '{key}' AS key, count({expr}) AS rows FROM g"
            for key, expr in (
                ("timestamp", "ts"),
                ("flow_id", "row_id"),
                ("event_type", "event_type"),
                ("src_ip", "src_ip"),
                ("src_port", "src_port"),
                ("dest_ip", "dest_ip"),
                ("dest_port", "dest_port"),
                ("proto", "proto"),
                ("app_proto", "app_proto"),
                ("community_id", "NULL"),
            )
        )
        + ") SELECT key, rows, rows = 0 AS missing FROM k",
    ),
    Query(
        "b3_label_summary",
        _labels,
        "SELECT l_returnflag AS label, count(*) AS rows, grouping(l_returnflag) = 1 AS whole_table FROM lineitem GROUP BY ROLLUP (l_returnflag)",
    ),
    Query(
        "b4_key_counts",
        _key_counts,
        f"WITH {event_cte()}, g AS (SELECT * FROM ev WHERE {_GOOD}), k AS ("
        + " UNION ALL ".join(
            f"SELECT '{key}' AS key, {expr} AS rows FROM g"
            for key, expr in (
                ("timestamp", "count(ts)"),
                ("flow_id", "count(*)"),
                ("event_type", "count(*)"),
                ("app_proto", "count(app_proto)"),
                ("src_ip", "count(*)"),
                ("src_port", "count(*)"),
                ("dest_ip", "count(*)"),
                ("dest_port", "count(*)"),
                ("proto", "count(*)"),
                ("flow", "count(*)"),
                ("alert", "count(*) FILTER (alert_there)"),
                ("http", f"count(*) FILTER {_APP_HTTP}"),
                ("tls", "count(*) FILTER (lower(app_proto) = 'tls' OR event_type = 'tls')"),
                ("dns", "count(*) FILTER (lower(app_proto) = 'dns' OR event_type = 'dns')"),
                ("ssh", "count(*) FILTER (lower(app_proto) = 'ssh' OR event_type = 'ssh')"),
            )
        )
        + ") SELECT key, rows FROM k",
    ),
    Query(
        "b4_event_type_counts",
        _event_types,
        f"WITH {event_cte()} SELECT event_type, count(*) AS rows FROM ev GROUP BY event_type",
    ),
    Query(
        "b4_event_log_facts",
        _log_facts,
        f"WITH {event_cte()} SELECT count(*) AS rows, count(*) FILTER {_TLS} AS tls_rows, "
        f"count(*) FILTER {_EVIDENCE} AS alert_rows FROM ev",
    ),
    Query(
        "b5_diagnose_table",
        _diagnose_table,
        "WITH c AS (SELECT count(DISTINCT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS n FROM lineitem) "
        "SELECT 'stand_in' AS dataset_type, x.\"check\", x.status, CASE WHEN x.\"check\" = 'classes' THEN n ELSE x.count END AS count, "
        "x.examples FROM c, (VALUES ('format', 'pass', 0, 'csv'), ('label', 'pass', 1, 'Label'), ('features', 'fail', 1, "
        "'idle_max'), ('dtype', 'warn', 3, 'l_returnflag,l_linestatus,l_shipdate'), ('classes', 'pass', 2, '0,1')) "
        "AS x(\"check\", status, count, examples)",
    ),
    Query(
        "b5_diagnose_log",
        _diagnose_log,
        f"WITH {event_cte()}, f AS (SELECT count(*) FILTER {_TLS} AS tls, count(*) FILTER {_EVIDENCE} AS alerts FROM ev "
        f"WHERE {_GOOD}) SELECT 'event_log' AS dataset_type, x.\"check\", x.status, CASE x.\"check\" WHEN 'label' THEN alerts "
        "WHEN 'features' THEN tls WHEN 'classes' THEN least(alerts, tls) ELSE 0 END AS count, x.examples FROM f, "
        "(VALUES ('format', 'pass', 'ndjson'), ('label', 'pass', 'Target'), ('features', 'pass', ''), ('dtype', 'skip', ''), "
        "('classes', 'pass', '')) AS x(\"check\", status, examples)",
    ),
    Query(
        "b6_compatible_types",
        _diagnose_all,
        "SELECT x.dataset_type, x.ok AND (SELECT count(DISTINCT l_returnflag) >= 2 FROM lineitem) AS compatible FROM "
        "(VALUES ('stand_in', false), ('loose', true), ('event_log', false)) AS x(dataset_type, ok)",
    ),
    Query(
        "b7_profile",
        _profile,
        f"WITH {flow_cte()} SELECT * FROM (VALUES ('columns', NULL, 12), ('numeric_columns', NULL, 8), "
        "('non_numeric_columns', NULL, 4)) AS x(fact, value, count) UNION ALL "
        "SELECT 'class', CAST(Label AS VARCHAR), count(*) FROM fl GROUP BY Label",
    ),
    Query(
        "b8_non_numeric_values",
        _non_numeric,
        f"SELECT 'l_returnflag' AS \"column\", count(*) AS non_numeric_rows FROM lineitem UNION ALL SELECT 'sometimes', "
        f"{_SOMETIMES} FROM lineitem UNION ALL SELECT 'quantity', 0 UNION ALL SELECT 'mostly', "
        "count(*) FILTER (l_quantity <= 1) FROM lineitem",
    ),
    Query(
        "b9_numeric_ratio",
        _ratio,
        f"WITH r AS (SELECT 'l_returnflag' AS \"column\", 0.0::DOUBLE AS ratio UNION ALL SELECT 'sometimes', round(1 - {_SOMETIMES} / "
        "count(*), 9) FROM lineitem UNION ALL SELECT 'quantity', 1.0 UNION ALL SELECT 'mostly', "
        "round(1 - count(*) FILTER (l_quantity <= 1) / count(*), 9) FROM lineitem) "
        "SELECT \"column\", ratio, ratio > 0 AS any_numeric, ratio >= 0.95 AS mostly_numeric, ratio >= 0.98 AS numeric FROM r",
    ),
    Query(
        "b10_initial_class_counts",
        _initial,
        f"WITH {event_cte()}, {ROUTED}, c AS (SELECT app, count(*) AS total, count(*) FILTER ({_BAD}) AS attack FROM routed "
        "GROUP BY app) SELECT app, total, total - attack AS benign, attack, round((total - attack) * 100.0 / total, 6) AS "
        "benign_ratio_percent, round(attack * 100.0 / total, 6) AS attack_ratio_percent FROM c",
    ),
    Query(
        "b10_label_share",
        _share,
        "WITH c AS (SELECT l_linestatus, l_returnflag, count(*) AS rows FROM lineitem GROUP BY ALL) SELECT *, "
        "round(rows / sum(rows) OVER (PARTITION BY l_linestatus), 9) AS share FROM c",
    ),
    Query(
        "b11_partition_check",
        _partition,
        f"WITH {event_cte()}, {ROUTED} SELECT app, count(*) AS rows, 0 AS misplaced_rows, "
        "count(*) FILTER (reason = 'app_proto') AS by_app_proto, count(*) FILTER (reason = 'event_type') AS by_event_type, "
        "count(*) FILTER (reason = 'port_fallback') AS by_port_fallback, CASE app WHEN 'dns' THEN '53' WHEN 'http' THEN "
        "'80,8000,8008,8080,8888' WHEN 'tls' THEN '443,8443' ELSE '22' END AS ports_used FROM routed GROUP BY app",
    ),
]

