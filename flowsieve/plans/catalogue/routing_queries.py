"""Event routing, base labels, alert summaries and lenient casts."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsieve.functions import labels
from flowsieve.functions.scalars import iso_utc, lenient_double, lenient_int, parse_timestamp, safe_divide
from flowsieve.operators import history, routing
from flowsieve.plans.catalogue import Query
from flowsieve.plans.stand_in import event_cte, event_records, read_table, run_cte, run_table
from flowsieve.session import scratch_path
from flowsieve.sources import tables

_IGNORED = "('generic protocol decode', 'generic protocol command decode')"
_IGNORED_FLAG = f"(alert_there AND lower(trim(alert_category)) IN {_IGNORED})"
_SEVERITY = "(alert_there AND coalesce(trim(alert_severity), '') <> '')"
_PRESENT = f"({_SEVERITY} AND NOT {_IGNORED_FLAG})"
_STRICT = f"(alert_there AND coalesce(TRY_CAST(alert_severity AS DOUBLE), 0) > 0 AND NOT {_IGNORED_FLAG})"
_TYPED = "event_type = 'alert'"
PORTS_SQL = {"http": "(80, 8000, 8008, 8080, 8888)", "tls": "(443, 8443)", "dns": "(53)", "ssh": "(22)"}


def reason_sql(app: str) -> str:
    ports = PORTS_SQL[app]
    return (
        f"CASE WHEN lower(app_proto) = '{app}' THEN 'app_proto' WHEN event_type = '{app}' THEN 'event_type' "
        f"WHEN src_port IN {ports} OR dest_port IN {ports} THEN 'port_fallback' END"
    )


ROUTED = "routed AS (" + " UNION ALL ".join(
    f"SELECT '{app}' AS app, {reason_sql(app)} AS reason, ev.* FROM ev WHERE {reason_sql(app)} IS NOT NULL"
    for app in PORTS_SQL
) + ")"


def routed_events(spark, sf_dir):
    return routing.route(event_records(spark, sf_dir))


def _bad(mode="event_type_or_valid_alert"):
    return labels.base_label(mode, F.col("event_type"), F.col("alert"))


def _normalize(spark, sf_dir):
    documents = read_table(spark, sf_dir, "documents")
    mixed = F.concat(F.lit(" -"), F.upper("lang"), F.lit("/."), F.col("source"), F.lit("__"))
    return documents.select("doc_id", labels.normalize_app(mixed).alias("app"))


def _match(spark, sf_dir):
    out = routing.match_app(event_records(spark, sf_dir), "tls")
    return out.select("row_id", "reason", F.array_join(F.col("matched_ports").cast("array<string>"), ",").alias("ports"))


def _route(spark, sf_dir):
    return routed_events(spark, sf_dir).select("row_id", "app", "reason")


def _port_table(spark, sf_dir):
    text = "# ports\ndns=53\nhttp=80,8000,8008,8080,8888\ntls=443,8443\n\nssh=22\n"
    ports = routing.read_ports(spark.createDataFrame([(line,) for line in text.split("\n")], "value string"))
    out = routing.route(event_records(spark, sf_dir), ports=ports).where(F.col("reason") == "port_fallback")
    return out.groupBy("app").agg(F.count(F.lit(1)).alias("by_port"))


def _base_labels(spark, sf_dir):
    events = event_records(spark, sf_dir)
    return events.agg(*[F.sum(_bad(mode)).alias(mode) for mode in labels.LABEL_MODES])


def _diagnostics(spark, sf_dir):
    return routing.diagnostic_summary(event_records(spark, sf_dir))


def _strict(spark, sf_dir):
    events = event_records(spark, sf_dir)
    return events.select("row_id", labels.alert_strict(F.col("alert")).alias("valid"))


def _policy(spark, sf_dir):
    return routing.alert_policy_counts(event_records(spark, sf_dir))


def _cap(spark, sf_dir):
    return routing.cap_per_app(routed_events(spark, sf_dir), 700).select("app", "row_id")


def _ports(spark, sf_dir):
    return routing.port_histogram(event_records(spark, sf_dir), _bad(), (53, 80, 443))


def _top_alerts(spark, sf_dir):
    return routing.top_alert_values(event_records(spark, sf_dir), 50).select("kind", "value", "n", F.col("rank").cast("bigint"))


def _matches(spark, sf_dir):
    return routing.match_summary(routed_events(spark, sf_dir))


def _upsert(spark, sf_dir):
    """First every application, then TLS again with the stricter label, merged by folder."""
    routed = routed_events(spark, sf_dir)
    path = scratch_path(spark, "app-summary")
    first = routing.label_counts(routed, _bad()).where(F.col("app").isNotNull())
    tables.upsert_app_summary(first, path)
    again = routing.label_counts(routed.where(F.col("app") == "tls"), _bad("valid_alert")).where(F.col("app").isNotNull())
    tables.upsert_app_summary(again, path)
    stored = spark.read.parquet(path)
    total = stored.rollup("app").agg(*[F.sum(c).alias(c) for c in ("written_rows", "benign", "malicious")])
    return total.withColumn("app", F.coalesce("app", F.lit("ALL")))


def _merge(spark, sf_dir):
    routed = routed_events(spark, sf_dir)
    fresh = routing.label_counts(routed.where(F.col("app") == "tls"), _bad("valid_alert"))
    merged = routing.merge_summaries(routing.label_counts(routed, _bad()), fresh)
    return merged.withColumn("app", F.coalesce("app", F.lit("ALL")))


def _casts(spark, sf_dir):
    events = read_table(spark, sf_dir, "events")
    number = F.element_at(F.split("props", ": "), 2)
    text = F.when(F.col("event_id") % 5 == 0, "").when(F.col("event_id") % 5 == 1, "n/a").otherwise(
        F.concat(F.regexp_extract(number, "([0-9]+)", 1), F.lit(".75"))
    )
    return events.select("event_id", lenient_int(text).alias("as_int"), lenient_double(text, -1.0).alias("as_double"))


def _divide(spark, sf_dir):
    events = event_records(spark, sf_dir)
    a, b = F.col("flow.bytes_toserver").cast("double"), F.col("flow.pkts_toserver").cast("double")
    return events.select("row_id", F.round(safe_divide(a, b, -1.0), 6).alias("share"))


def _timestamps(spark, sf_dir):
    events = read_table(spark, sf_dir, "events")
    day = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    zone = F.element_at(F.array(*[F.lit(z) for z in ("Z", "+00:00", "+0000", "+07:00", "", "junk")]), (F.col("event_id") % 6 + 1).cast("int"))
    return events.select("event_id", iso_utc(parse_timestamp(F.concat(day, zone))).alias("at"))


def _predicate(spark, sf_dir):
    rows = history.apply_conditions(run_table(spark, sf_dir), [("f1_score", ">", 0.5), ("acc", ">=", 0.4), ("roc", "<", 0.8)])
    return rows.select("id", "f1", "accuracy", "auc")


def _filters(spark, sf_dir):
    rows = history.apply_filters(
        run_table(spark, sf_dir),
        pipelines=["flow.forest", "event.forest"],
        statuses=["FINISHED", "RUNNING"],
        modes=["official"],
        start="1996-01-01",
        end="1998-12-31",
    )
    return rows.select("id", "pipeline_id", "status")


_LABEL_SUMMARY = f"""{event_cte()}, {ROUTED},
s AS (SELECT app, count(*) AS written_rows,
      count(*) FILTER (NOT CASE WHEN app = 'tls' THEN {_PRESENT} ELSE ({_TYPED} OR {_PRESENT}) END) AS benign,
      count(*) FILTER (CASE WHEN app = 'tls' THEN {_PRESENT} ELSE ({_TYPED} OR {_PRESENT}) END) AS malicious
      FROM routed GROUP BY app)
"""
_UPSERT_SQL = (
    f"WITH {_LABEL_SUMMARY} SELECT * FROM s UNION ALL SELECT 'ALL', CAST(sum(written_rows) AS BIGINT), "
    "CAST(sum(benign) AS BIGINT), CAST(sum(malicious) AS BIGINT) FROM s"
)
_BAD = f"({_TYPED} OR {_PRESENT})"
_HASH_ROW = "(('0x' || substr(md5(CAST(row_id AS VARCHAR)), 1, 15))::BIGINT)"
_MISSING_APP = "coalesce(nullif(lower(app_proto), ''), '<missing>')"

QUERIES = [
    Query(
        "c1_normalize_app",
        _normalize,
        "SELECT doc_id, trim(regexp_replace(lower(trim(' -' || upper(lang) || '/.' || source || '__')), '[^a-z0-9]+', '_', 'g'), '_') "
        "AS app FROM documents",
    ),
    Query(
        "c2_match_one_app",
        _match,
        f"WITH {event_cte()}, m AS (SELECT *, coalesce({reason_sql('tls')}, 'unmatched') AS reason FROM ev) "
        "SELECT row_id, reason, CASE WHEN reason <> 'port_fallback' THEN '' ELSE array_to_string(list_sort(list_distinct("
        "[CASE WHEN src_port IN (443, 8443) THEN src_port END, CASE WHEN dest_port IN (443, 8443) THEN dest_port END])), ',') END AS ports FROM m",
    ),
    Query("c3_route_all_apps", _route, f"WITH {event_cte()}, {ROUTED} SELECT row_id, app, reason FROM routed"),
    Query(
        "c4_port_table_fallback",
        _port_table,
        f"WITH {event_cte()}, {ROUTED} SELECT app, count(*) AS by_port FROM routed WHERE reason = 'port_fallback' GROUP BY app",
    ),
    Query(
        "c5_base_label_modes",
        _base_labels,
        f"WITH {event_cte()} SELECT count(*) FILTER ({_PRESENT}) AS valid_alert, count(*) FILTER ({_TYPED}) AS event_type_alert, "
        f"count(*) FILTER ({_TYPED} OR {_PRESENT}) AS event_type_or_valid_alert, count(*) FILTER (alert_there) AS alert_object FROM ev",
    ),
    Query(
        "c6_alert_diagnostics",
        _diagnostics,
        f"WITH {event_cte()} SELECT count(*) FILTER ({_TYPED}) AS event_type_alert, count(*) FILTER (alert_there) AS "
        f"alert_dict_exists, count(*) FILTER ({_SEVERITY}) AS alert_severity_exists, count(*) FILTER ({_IGNORED_FLAG}) AS "
        f"ignored_alert_category, count(*) FILTER ({_PRESENT}) AS valid_alert FROM ev",
    ),
    Query("c7_strict_valid_alert", _strict, f"WITH {event_cte()} SELECT row_id, {_STRICT} AS valid FROM ev"),
    Query(
        "c8_alert_policy_counts",
        _policy,
        f"WITH {event_cte()} SELECT count(*) FILTER ({_TYPED}) AS event_type_alert, count(*) FILTER (alert_there) AS "
        f"alert_object_rows, count(*) FILTER ({_SEVERITY}) AS alert_severity_exists_rows, count(*) FILTER ({_IGNORED_FLAG}) "
        f"AS ignored_alert_category_rows, count(*) FILTER ({_STRICT}) AS valid_alert_rows, count(*) FILTER ({_TYPED} OR "
        f"{_STRICT}) AS base_alert_positive_rows, count(*) FILTER ({_TYPED} AND NOT {_STRICT}) AS "
        f"event_type_alert_not_valid_rows, count(*) FILTER ({_STRICT} AND NOT ({_TYPED})) AS valid_alert_not_event_type_rows FROM ev",
    ),
    Query(
        "c9_first_rows_per_app",
        _cap,
        f"WITH {event_cte()}, {ROUTED}, r AS (SELECT app, row_id, row_number() OVER (PARTITION BY app ORDER BY "
        f"coalesce(CAST(epoch_ms(ts) AS BIGINT), -1), {_HASH_ROW}) AS n FROM routed) SELECT app, row_id FROM r WHERE n <= 700",
    ),
    Query(
        "c10_port_histogram",
        _ports,
        f"WITH {event_cte()}, p AS (SELECT 'src' AS role, src_port AS port, {_BAD} AS bad FROM ev UNION ALL "
        f"SELECT 'dest', dest_port, {_BAD} FROM ev UNION ALL SELECT 'app_hit', src_port, {_BAD} FROM ev WHERE src_port IN "
        f"(53, 80, 443) UNION ALL SELECT 'app_hit', dest_port, {_BAD} FROM ev WHERE dest_port IN (53, 80, 443) AND "
        "dest_port <> src_port) SELECT role, port, count(*) AS total, count(*) FILTER (NOT bad) AS benign, "
        "count(*) FILTER (bad) AS malicious FROM p GROUP BY ALL",
    ),
    Query(
        "c11_top_alert_values",
        _top_alerts,
        f"WITH {event_cte()}, l AS (SELECT 'category' AS kind, lower(trim(alert_category)) AS value FROM ev WHERE alert_there "
        "UNION ALL SELECT 'signature', alert_signature FROM ev WHERE alert_there), c AS (SELECT kind, value, count(*) AS n "
        "FROM l GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, value) AS rank FROM c) "
        "SELECT * FROM r WHERE rank <= 50",
    ),
    Query(
        "c12_match_summary",
        _matches,
        f"WITH {event_cte()}, {ROUTED} SELECT app, 'reason' AS kind, reason AS value, count(*) AS n FROM routed GROUP BY ALL "
        f"UNION ALL SELECT app, 'app_proto', {_MISSING_APP}, count(*) FROM routed GROUP BY ALL "
        "UNION ALL SELECT app, 'event_type', event_type, count(*) FROM routed GROUP BY ALL",
    ),
    Query("c13_summary_upsert", _upsert, _UPSERT_SQL),
    Query("c13_summary_merge", _merge, _UPSERT_SQL),
    Query(
        "c14_lenient_casts",
        _casts,
        "SELECT event_id, CASE WHEN event_id % 5 < 2 THEN 0 ELSE CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) END AS as_int, "
        "CASE WHEN event_id % 5 < 2 THEN -1.0 ELSE CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) + 0.75 END AS as_double FROM events",
    ),
    Query(
        "c15_safe_divide",
        _divide,
        f"WITH {event_cte()} SELECT row_id, CASE WHEN pkts_toserver = 0 THEN -1.0 ELSE round(bytes_toserver / pkts_toserver, 6) "
        "END AS share FROM ev",
    ),
    Query(
        "c16_timestamp_parse",
        _timestamps,
        "SELECT event_id, CASE event_id % 6 WHEN 5 THEN NULL WHEN 3 THEN strftime(ts - INTERVAL 7 HOUR, '%Y-%m-%dT%H:%M:%SZ') "
        "ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS at FROM events",
    ),
    Query(
        "c17_metric_predicate",
        _predicate,
        f"WITH {run_cte()} SELECT id, f1, accuracy, auc FROM runs WHERE f1 > 0.5 AND accuracy >= 0.4 AND auc < 0.8",
    ),
    Query(
        "c18_record_filters",
        _filters,
        f"WITH {run_cte()} SELECT id, pipeline_id, status FROM runs WHERE pipeline_id IN ('flow.forest', 'event.forest') AND "
        "status IN ('FINISHED', 'RUNNING') AND coalesce(run_mode, 'official') = 'official' AND "
        "CAST(created_at AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'",
    ),
]
