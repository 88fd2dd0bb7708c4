"""Streaming operators fed with the event table as a file stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsieve.functions.scalars import iso_utc
from flowsieve.operators.windows import add_scores, level_cuts, probe_windows
from flowsieve.plans.catalogue import Query
from flowsieve.plans.catalogue.refine_queries import CASCADE
from flowsieve.plans.catalogue.routing_queries import _BAD, ROUTED
from flowsieve.plans.catalogue.window_queries import _COUNTS, DAY, ISO, window_ctes
from flowsieve.plans.stand_in import event_cte, event_records
from flowsieve.session import scratch_path
from flowsieve.streaming import exact, live


def _stream(spark, sf_dir):
    """Event records as a stream: written once in the shared folder, then read as files."""
    path = scratch_path(spark, "stream-in")
    records = event_records(spark, sf_dir)
    records.write.parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def _drain(spark, frame, name):
    return live.run_available(frame, scratch_path(spark, name), scratch_path(spark, f"{name}-state"))


def _windows(spark, sf_dir):
    out = _drain(spark, live.live_windows(_stream(spark, sf_dir), DAY), "live-windows")
    return out.select(
        iso_utc(F.col("window_start")).alias("window_start"),
        "src_ip",
        "event_count_window",
        "total_bytes_window",
        "base_alert_positive_count_window",
    )


def _exact_windows(spark, sf_dir):
    out = _drain(spark, exact.exact_live_windows(_stream(spark, sf_dir), DAY).drop("w"), "exact-windows")
    return out.select(*[iso_utc(F.col(c)).alias(c) for c in ("window_start", "first_seen", "last_seen")], "src_ip", *_COUNTS)


def _levels(spark, sf_dir):
    batch = add_scores(probe_windows(event_records(spark, sf_dir), DAY), DAY)
    cuts = level_cuts(batch, DAY)
    thresholds = spark.createDataFrame([("all", *[float(cuts[c]) for c in ("p90", "p95", "p99")])], "app string, p90 double, p95 double, p99 double")
    frame = live.live_levels_by_app(exact.exact_live_windows(_stream(spark, sf_dir), DAY), thresholds, F.lit("all"), DAY)
    out = _drain(spark, frame.select("window_start", "src_ip", "probe_level", "fanout_high"), "live-levels")
    return out.groupBy("probe_level", "fanout_high").agg(F.count(F.lit(1)).alias("windows"))


def write_halves(ordered, path):
    """Writes the rows of half 0, then those of half 1, each by all tasks; returns how many files are one batch.

    The second half has no more files than the first, and a stream takes older files first: its batches are the halves.
    """
    ordered.where(F.col("half") == 0).drop("half").write.parquet(path)
    files = len(ordered.sparkSession.read.parquet(path).inputFiles())
    ordered.where(F.col("half") == 1).drop("half").coalesce(files).write.mode("append").parquet(path)
    return files


def _thresholds(spark, sf_dir):
    """A histogram per application, kept up to date over two batches of files."""
    path = scratch_path(spark, "ordered-in")
    ordered = event_records(spark, sf_dir).withColumn("half", F.coalesce((F.dayofmonth("ts") > 15).cast("int"), F.lit(0)))
    batch_files = write_halves(ordered, path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", batch_files).parquet(path)
    histogram = exact.ScoreHistogram(spark, scratch_path(spark, "histogram"))
    windows = exact.exact_live_windows(stream, DAY, f"{_LATE_DAYS} days")
    query = exact.keep_thresholds(windows, F.regexp_extract("src_ip", "^[0-9]+", 0), histogram, scratch_path(spark, "histogram-state"), DAY)
    query.awaitTermination()
    return histogram.thresholds(query.lastProgress["batchId"], DAY)


def _nearest(spark, sf_dir):
    out = _drain(spark, exact.nearest_live_alerts(_stream(spark, sf_dir), DAY), "nearest-live")
    return out.select(iso_utc(F.col("window_start")).alias("window_start"), "src_ip", iso_utc(F.col("matched_alert_window")).alias("matched_alert_window"), "minutes_to_alert_window")


def _near(spark, sf_dir):
    stream = _stream(spark, sf_dir).where(F.col("ts").isNotNull())
    alert = F.col("event_type") == "alert"
    frame = live.live_near_matches(stream.where(~alert), _stream(spark, sf_dir).where(alert & F.col("ts").isNotNull()), DAY)
    out = _drain(spark, frame.select("p_row", "a_window", "gap_minutes"), "live-near")
    return out.groupBy("p_row").agg(F.count(F.lit(1)).alias("alert_windows"))


def _counts(spark, sf_dir):
    path, state = scratch_path(spark, "live-counts"), scratch_path(spark, "live-counts-state")
    live.count_apps(_stream(spark, sf_dir), path, state).awaitTermination()
    return live.app_totals(spark, path).withColumn("app", F.coalesce("app", F.lit("ALL")))


# A window leaves the stream once the watermark (latest event minus ten minutes) passes it.
_CLOSED = "window_start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM use)"

# Windows whose whole reach of a day has left the stream.
_REACH_CLOSED = _CLOSED.replace("1 DAY", "2 DAY")
# The event table has no order; so many days late an event still counts.
_LATE_DAYS = 45
_SETTLED = f"window_start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL {_LATE_DAYS} DAY FROM use)"

QUERIES = [
    Query(
        "k1_exact_live_windows",
        _exact_windows,
        f"WITH {window_ctes()} SELECT {ISO}, strftime(first_seen, '%Y-%m-%dT%H:%M:%SZ') AS first_seen, strftime(last_seen, '%Y-%m-%dT%H:%M:%SZ') AS last_seen, "
        f"src_ip, {', '.join(_COUNTS)} FROM win WHERE {_CLOSED}",
    ),
    Query(
        "k2_live_thresholds",
        _thresholds,
        f"WITH {window_ctes()} SELECT regexp_extract(src_ip, '^[0-9]+') AS app, round(quantile_cont(probe_score_no_alert, 0.90), 9) AS p90, "
        "round(quantile_cont(probe_score_no_alert, 0.95), 9) AS p95, round(quantile_cont(probe_score_no_alert, 0.99), 9) AS p99, "
        f"max(probe_score_no_alert) AS max, count(*) AS windows FROM scored WHERE {_SETTLED} GROUP BY 1",
    ),
    Query(
        "k3_nearest_live_alerts",
        _nearest,
        f"WITH {CASCADE} SELECT {ISO}, src_ip, strftime(matched_alert_window, '%Y-%m-%dT%H:%M:%SZ') AS matched_alert_window, "
        f"minutes_to_alert_window FROM matched WHERE near_alert_window = 1 AND {_REACH_CLOSED}",
    ),
    Query(
        "k1_live_windows",
        _windows,
        f"WITH {window_ctes()} SELECT strftime(window_start, '%Y-%m-%dT%H:%M:%SZ') AS window_start, src_ip, event_count_window, "
        f"total_bytes_window, base_alert_positive_count_window FROM win WHERE {_CLOSED}",
    ),
    Query(
        "k2_live_levels",
        _levels,
        f"WITH {window_ctes()} SELECT probe_level, fanout_high, count(*) AS windows FROM rec WHERE {_CLOSED} GROUP BY ALL",
    ),
    Query(
        "k3_live_near_matches",
        _near,
        f"WITH {window_ctes()}, p AS (SELECT * FROM ev WHERE ts IS NOT NULL AND event_type <> 'alert'), a AS (SELECT src_ip AS asrc, ts AS ats "
        "FROM ev WHERE ts IS NOT NULL AND event_type = 'alert') SELECT row_id AS p_row, count(DISTINCT date_trunc('day', ats)) AS alert_windows FROM p JOIN a ON asrc = src_ip "
        "WHERE abs(date_diff('day', ts, ats)) = 1 GROUP BY row_id",
    ),
    Query(
        "k4_live_app_counts",
        _counts,
        f"WITH {event_cte()}, {ROUTED}, s AS (SELECT app, count(*) AS written_rows, count(*) FILTER (NOT {_BAD}) AS benign, "
        f"count(*) FILTER ({_BAD}) AS malicious FROM routed GROUP BY app) SELECT * FROM s UNION ALL SELECT 'ALL', "
        "CAST(sum(written_rows) AS BIGINT), CAST(sum(benign) AS BIGINT), CAST(sum(malicious) AS BIGINT) FROM s",
    ),
]
