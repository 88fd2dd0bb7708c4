"""Windowed probing analysis over the event stand-in.

Stand-in sources are sparse, so the queries use one-day windows and lower minima; the
operators default to five minutes and 50/10/5.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsieve.functions.scalars import iso_utc, lenient_int, text_or
from flowsieve.operators import windows as W
from flowsieve.operators.kept_windows import WindowStore
from flowsieve.plans.catalogue import Query
from flowsieve.plans.stand_in import event_cte, event_records
from flowsieve.session import scratch_path

DAY = W.ProbeSettings(window_minutes=1440, min_event_count=4, min_unique_dest_ip=4, min_unique_dest_port=3)
FIVE = W.ProbeSettings()

_IGNORED = "('generic protocol decode', 'generic protocol command decode')"
TYPED = "event_type = 'alert'"
STRICT = (
    "(alert_there AND coalesce(TRY_CAST(alert_severity AS DOUBLE), 0) > 0 "
    f"AND lower(trim(alert_category)) NOT IN {_IGNORED})"
)
POSITIVE = f"({TYPED} OR {STRICT})"


def window_ctes(bucket: str = "INTERVAL 1 DAY", events: int = 4, ips: int = 4, ports: int = 3) -> str:
    """``ev``, ``win``, ``scored``, ``cuts`` and ``rec`` for the checking engine."""
    return f"""{event_cte()},
use AS (SELECT *, time_bucket({bucket}, ts) AS window_start, {TYPED} AS typed, {STRICT} AS valid
        FROM ev WHERE ts IS NOT NULL AND trim(src_ip) <> ''),
win AS (SELECT window_start, src_ip, count(*) AS event_count_window,
        count(DISTINCT nullif(trim(dest_ip), '')) AS unique_dest_ip_window,
        count(DISTINCT CASE WHEN dest_port > 0 THEN dest_port END) AS unique_dest_port_window,
        CAST(sum(bytes_toserver + bytes_toclient) AS BIGINT) AS total_bytes_window,
        CAST(sum(pkts_toserver + pkts_toclient) AS BIGINT) AS total_pkts_window,
        count(*) FILTER (alert_there) AS alert_count_window,
        count(*) FILTER (typed) AS event_type_alert_count_window,
        count(*) FILTER (valid) AS valid_alert_count_window,
        count(*) FILTER (typed OR valid) AS base_alert_positive_count_window,
        count(*) FILTER (NOT (typed OR valid)) AS no_alert_count_window,
        min(ts) AS first_seen, max(ts) AS last_seen
        FROM use GROUP BY window_start, src_ip),
parts AS (SELECT *, least(event_count_window / {float(events)}, 5.0)
        + least(unique_dest_ip_window / {float(ips)}, 5.0) * 1.25
        + least(unique_dest_port_window / {float(ports)}, 5.0) * 1.25 AS behaviour FROM win),
scored AS (SELECT *, round(behaviour, 9) AS probe_score_no_alert,
        round(behaviour + least(CAST(base_alert_positive_count_window AS DOUBLE), 5.0), 9) AS probe_score_with_alert
        FROM parts),
cuts AS (SELECT round(quantile_cont(probe_score_no_alert, 0.90), 9) AS p90,
        round(quantile_cont(probe_score_no_alert, 0.95), 9) AS p95,
        round(quantile_cont(probe_score_no_alert, 0.99), 9) AS p99 FROM scored),
flagged AS (SELECT scored.*, p90, p95, p99,
        CASE WHEN unique_dest_ip_window >= {ips} OR unique_dest_port_window >= {ports} THEN 1 ELSE 0 END AS fanout_high
        FROM scored, cuts),
rec AS (SELECT *,
        CASE WHEN probe_score_no_alert >= p99 THEN 'extreme' WHEN probe_score_no_alert >= p95 THEN 'high'
             WHEN probe_score_no_alert >= p90 THEN 'medium' ELSE 'low' END AS probe_level,
        CASE WHEN probe_score_no_alert >= p90 AND event_count_window >= {events} AND fanout_high = 1
             THEN 1 ELSE 0 END AS is_suspicious_window FROM flagged)"""


ISO = "strftime(window_start, '%Y-%m-%dT%H:%M:%SZ') AS window_start"
_COUNTS = (
    "event_count_window",
    "unique_dest_ip_window",
    "unique_dest_port_window",
    "total_bytes_window",
    "total_pkts_window",
    "alert_count_window",
    "event_type_alert_count_window",
    "valid_alert_count_window",
    "base_alert_positive_count_window",
    "no_alert_count_window",
)


def day_records(spark, sf_dir):
    return W.probe_records(event_records(spark, sf_dir), DAY)


def _scored(spark, sf_dir):
    return W.add_scores(W.probe_windows(event_records(spark, sf_dir), DAY), DAY)


def _iso_key(df, *columns):
    return df.select(iso_utc(F.col("window_start")).alias("window_start"), "src_ip", *columns)


def _window_floor(spark, sf_dir):
    events = W.add_window(W.usable_events(event_records(spark, sf_dir)), 5)
    return events.groupBy(iso_utc(F.col("window_start")).alias("window_start")).agg(F.count(F.lit(1)).alias("n"))


def _aggregation(settings):
    def run(spark, sf_dir):
        windows = W.probe_windows(event_records(spark, sf_dir), settings)
        return _iso_key(windows, *_COUNTS, iso_utc(F.col("first_seen")).alias("first_seen"),
                        iso_utc(F.col("last_seen")).alias("last_seen"))

    return run


def _appended(spark, sf_dir):
    """The events in three appends that each hold all days, so two of them are late throughout."""
    events = event_records(spark, sf_dir)
    store = WindowStore(spark, scratch_path(spark, "kept-windows"), DAY)
    for number in range(3):
        store.append(events.where(F.pmod("row_id", F.lit(3)) == number), number)
    return _iso_key(store.windows(2), *_COUNTS, iso_utc(F.col("first_seen")).alias("first_seen"), iso_utc(F.col("last_seen")).alias("last_seen"))


def _dropped(spark, sf_dir):
    return W.dropped_counts(event_records(spark, sf_dir))


def _score(spark, sf_dir):
    return _iso_key(_scored(spark, sf_dir), "probe_score_no_alert", "probe_score_with_alert")


def _statistics(spark, sf_dir):
    return W.score_statistics(_scored(spark, sf_dir))


def _levels(spark, sf_dir):
    return _iso_key(day_records(spark, sf_dir), "probe_level", "p90", "p95", "p99")


def _reasons(spark, sf_dir):
    return day_records(spark, sf_dir).groupBy("probe_reason").agg(F.count(F.lit(1)).alias("windows"))


def _flags(spark, sf_dir):
    return _iso_key(day_records(spark, sf_dir), "fanout_high", "is_suspicious_window")


def _top_text(spark, sf_dir):
    port = lenient_int(F.col("dest_port"))
    fields = {"event_types": (text_or(F.col("event_type"), "unknown"), 10), "dest_ports": (F.when(port > 0, port), 3)}
    out = W.top_values_per_window(event_records(spark, sf_dir), fields, DAY)
    text = {c: F.array_join(F.transform(c, lambda x: F.concat(x["value"], F.lit(":"), x["n"].cast("string"))), ",") for c in fields}
    return _iso_key(out.withColumns(text), *fields)


def _alert_index(spark, sf_dir):
    return _iso_key(
        W.alert_windows(day_records(spark, sf_dir)),
        "base_alert_positive_count_window",
        "valid_alert_count_window",
        "probe_score_with_alert",
        "fanout_high",
    )


def _suspicious(spark, sf_dir):
    return _iso_key(W.suspicious_windows(day_records(spark, sf_dir)), "probe_score_no_alert", "event_count_window")


def _candidates(spark, sf_dir):
    return _iso_key(W.top_candidates(day_records(spark, sf_dir), DAY), "probe_score_with_alert")


def _global_top(spark, sf_dir):
    return W.top_global_values(event_records(spark, sf_dir)).select("field", "value", "n", F.col("rank").cast("bigint"))


def _per_event(spark, sf_dir):
    return _iso_key(
        _scored(spark, sf_dir),
        F.round("bytes_per_event_window", 6).alias("bytes_per_event_window"),
        F.round("pkts_per_event_window", 6).alias("pkts_per_event_window"),
    )


def _top_sql(value: str, where: str, n: int, out: str) -> str:
    return f"""(SELECT window_start, src_ip, string_agg(v || ':' || c, ',' ORDER BY c DESC, v) AS {out}
      FROM (SELECT *, row_number() OVER (PARTITION BY window_start, src_ip ORDER BY c DESC, v) AS r
            FROM (SELECT window_start, src_ip, {value} AS v, count(*) AS c FROM use WHERE {where} GROUP BY ALL))
      WHERE r <= {n} GROUP BY window_start, src_ip)"""


_STATS = ", ".join(
    f"round(quantile_cont(s, {q}), 9) AS {name}"
    for name, q in (("p50", 0.5), ("p75", 0.75), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99))
)
_AGG = (
    f"SELECT {ISO}, src_ip, {', '.join(_COUNTS)}, strftime(first_seen, '%Y-%m-%dT%H:%M:%SZ') AS first_seen, "
    "strftime(last_seen, '%Y-%m-%dT%H:%M:%SZ') AS last_seen FROM win"
)
_REASON = """coalesce(nullif(concat_ws(';',
  CASE WHEN event_count_window >= 4 THEN 'high_event_count' END,
  CASE WHEN unique_dest_ip_window >= 4 THEN 'many_dest_ip' END,
  CASE WHEN unique_dest_port_window >= 3 THEN 'many_dest_port' END,
  CASE WHEN base_alert_positive_count_window > 0 THEN 'base_alert_window' END,
  CASE WHEN probe_score_no_alert >= p90 THEN 'score_ge_p90' END), ''), 'below_threshold')"""

QUERIES = [
    Query(
        "d1_window_floor",
        _window_floor,
        f"WITH {window_ctes('INTERVAL 5 MINUTE')} SELECT {ISO}, count(*) AS n FROM use GROUP BY 1",
    ),
    Query("d2_window_aggregation", _aggregation(DAY), f"WITH {window_ctes()} {_AGG}"),
    Query("d2_appended_windows", _appended, f"WITH {window_ctes()} {_AGG}"),
    Query(
        "d2_window_aggregation_5min", _aggregation(FIVE), f"WITH {window_ctes('INTERVAL 5 MINUTE')} {_AGG}"
    ),
    Query(
        "d3_dropped_events",
        _dropped,
        f"WITH {event_cte()} SELECT count(*) AS decoded_events, count(*) FILTER (ts IS NULL) AS dropped_no_timestamp, "
        "count(*) FILTER (ts IS NOT NULL AND trim(src_ip) = '') AS dropped_no_src_ip FROM ev",
    ),
    Query(
        "d4_probe_scores",
        _score,
        f"WITH {window_ctes()} SELECT {ISO}, src_ip, probe_score_no_alert, probe_score_with_alert FROM scored",
    ),
    Query(
        "d5_score_percentiles",
        _statistics,
        f"WITH {window_ctes()}, l AS (SELECT 'probe_score_no_alert' AS score, probe_score_no_alert AS s FROM scored "
        "UNION ALL SELECT 'probe_score_with_alert', probe_score_with_alert FROM scored) "
        f"SELECT score, {_STATS}, max(s) AS max FROM l GROUP BY score",
    ),
    Query("d6_probe_levels", _levels, f"WITH {window_ctes()} SELECT {ISO}, src_ip, probe_level, p90, p95, p99 FROM rec"),
    Query(
        "d7_probe_reasons",
        _reasons,
        f"WITH {window_ctes()} SELECT {_REASON} AS probe_reason, count(*) AS windows FROM rec GROUP BY 1",
    ),
    Query(
        "d8_window_flags",
        _flags,
        f"WITH {window_ctes()} SELECT {ISO}, src_ip, fanout_high, is_suspicious_window FROM rec",
    ),
    Query(
        "d9_top_values_per_window",
        _top_text,
        f"WITH {window_ctes()}, t AS {_top_sql('event_type', 'true', 10, 'event_types')}, "
        f"p AS {_top_sql('CAST(dest_port AS VARCHAR)', 'dest_port > 0', 3, 'dest_ports')} "
        "SELECT strftime(t.window_start, '%Y-%m-%dT%H:%M:%SZ') AS window_start, t.src_ip, event_types, dest_ports "
        "FROM t LEFT JOIN p ON t.window_start = p.window_start AND t.src_ip = p.src_ip",
    ),
    Query(
        "d10_alert_window_index",
        _alert_index,
        f"WITH {window_ctes()} SELECT {ISO}, src_ip, base_alert_positive_count_window, valid_alert_count_window, "
        "probe_score_with_alert, fanout_high FROM rec WHERE base_alert_positive_count_window > 0",
    ),
    Query(
        "d11_suspicious_windows",
        _suspicious,
        f"WITH {window_ctes()} SELECT {ISO}, src_ip, probe_score_no_alert, event_count_window FROM rec "
        "WHERE is_suspicious_window = 1",
    ),
    Query(
        "d12_top_candidates",
        _candidates,
        f"WITH {window_ctes()}, top AS (SELECT * FROM rec ORDER BY probe_score_with_alert DESC, window_start, src_ip "
        f"LIMIT 1000) SELECT {ISO}, src_ip, probe_score_with_alert FROM top",
    ),
    Query(
        "d13_top_global_values",
        _global_top,
        f"WITH {window_ctes()}, l AS (SELECT 'event_type' AS field, event_type AS value FROM use UNION ALL "
        "SELECT 'app_proto', coalesce(app_proto, 'unknown') FROM use UNION ALL "
        "SELECT 'dest_port', CAST(dest_port AS VARCHAR) FROM use WHERE dest_port > 0), "
        "c AS (SELECT field, value, count(*) AS n FROM l GROUP BY ALL), "
        "r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS rank FROM c) "
        "SELECT * FROM r WHERE rank <= 20",
    ),
    Query(
        "d14_volume_per_event",
        _per_event,
        f"WITH {window_ctes()} SELECT {ISO}, src_ip, round(total_bytes_window / event_count_window, 6) AS "
        "bytes_per_event_window, round(total_pkts_window / event_count_window, 6) AS pkts_per_event_window FROM scored",
    ),
]
