"""Streaming forms: live windows, scoring against batch thresholds, near matches, app counts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowsieve.functions import labels
from flowsieve.functions.scalars import lenient_int
from flowsieve.operators import routing
from flowsieve.operators.joins import broadcast_if_small
from flowsieve.operators.windows import ProbeSettings, add_scores, usable_events


def live_windows(events: DataFrame, settings: ProbeSettings = ProbeSettings(), delay: str = "10 minutes") -> DataFrame:
    """Tumbling-window counters of a live stream; state older than ``delay`` is dropped.

    Distinct destinations are approximate: exact distinct counts would keep every address
    of every open window in state.
    """
    event_type, alert = F.col("event_type"), F.col("alert")
    typed, valid = labels.is_event_type_alert(event_type), labels.alert_strict(alert)
    port = lenient_int(F.col("dest_port"))
    flow = lambda *names: sum((lenient_int(F.col(f"flow.{n}")) for n in names[1:]), lenient_int(F.col(f"flow.{names[0]}")))
    grouped = (
        usable_events(events)
        .withWatermark("ts", delay)
        .groupBy(F.window("ts", f"{settings.window_minutes} minutes").alias("w"), F.trim("src_ip").alias("src_ip"))
        .agg(
            F.count(F.lit(1)).alias("event_count_window"),
            F.approx_count_distinct(F.nullif(F.trim("dest_ip"), F.lit(""))).alias("unique_dest_ip_window"),
            F.approx_count_distinct(F.when(port > 0, port)).alias("unique_dest_port_window"),
            F.sum(flow("bytes_toserver", "bytes_toclient")).alias("total_bytes_window"),
            F.sum(flow("pkts_toserver", "pkts_toclient")).alias("total_pkts_window"),
            F.count_if(typed | valid).alias("base_alert_positive_count_window"),
            F.count_if(~(typed | valid)).alias("no_alert_count_window"),
        )
    )
    return grouped.withColumn("window_start", F.col("w.start")).withColumn("window_end", F.col("w.end"))


def live_levels(windows: DataFrame, cuts: Mapping[str, float], settings: ProbeSettings = ProbeSettings()) -> DataFrame:
    """Scores and levels of live windows against the last batch's cuts."""
    scored = add_scores(windows, settings)
    score = F.col("probe_score_no_alert")
    fanout = (F.col("unique_dest_ip_window") >= settings.min_unique_dest_ip) | (
        F.col("unique_dest_port_window") >= settings.min_unique_dest_port
    )
    level = F.when(score >= cuts["p99"], "extreme").when(score >= cuts["p95"], "high").when(score >= cuts["p90"], "medium").otherwise("low")
    return scored.withColumns({"probe_level": level, "fanout_high": fanout.cast("int")})


def live_levels_by_app(windows: DataFrame, thresholds: DataFrame, app: Column, settings: ProbeSettings = ProbeSettings()) -> DataFrame:
    """The same with one threshold row per application, as a stream-static join.

    ``thresholds`` (app, p90, p95, p99) has one row per application; many are joined by shuffle.
    """
    joined = add_scores(windows, settings).withColumn("app", app).join(broadcast_if_small(thresholds), "app", "left")
    score = F.col("probe_score_no_alert")
    level = (
        F.when(score >= F.col("p99"), "extreme").when(score >= F.col("p95"), "high").when(score >= F.col("p90"), "medium").otherwise("low")
    )
    fanout = (F.col("unique_dest_ip_window") >= settings.min_unique_dest_ip) | (
        F.col("unique_dest_port_window") >= settings.min_unique_dest_port
    )
    return joined.withColumns({"probe_level": level, "fanout_high": fanout.cast("int")})


def live_near_matches(probes: DataFrame, alerts: DataFrame, settings: ProbeSettings = ProbeSettings(), delay: str = "10 minutes") -> DataFrame:
    """Probe and alert events of one source whose windows are at most ``radius`` apart.

    Alerts are first reduced to one row per source and window.  A probe event is announced to each window
    in reach and joined on equality, so it is reported once per alert window in reach, however many
    alerts that holds; both watermarks bound the state.
    """
    seconds = settings.window_minutes * 60
    start = lambda c: F.timestamp_seconds(F.unix_seconds(c) - F.pmod(F.unix_seconds(c), F.lit(seconds)))
    # A window may still get events until it has ended and the delay has passed.
    late = f"{settings.near_window_radius * seconds + seconds} seconds"
    windows = (
        alerts.select(F.col("src_ip").alias("a_src"), start(F.col("ts")).alias("a_window"))
        .withWatermark("a_window", f"interval {delay} {late}")
        .dropDuplicates(["a_src", "a_window"])
    )
    steps = [i for i in range(-settings.near_window_radius, settings.near_window_radius + 1) if i]
    shift = lambda i: F.timestamp_seconds(F.unix_seconds(start(F.col("ts"))) + F.lit(i * seconds))
    reached = F.explode(F.array(*[F.struct(shift(i).alias("window"), F.lit(abs(i) * seconds / 60).alias("gap")) for i in steps]))
    probing = probes.withWatermark("ts", delay).select(F.col("src_ip").alias("p_src"), F.col("ts").alias("p_ts"), F.col("row_id").alias("p_row"), reached.alias("to"))
    joined = probing.join(windows, (F.col("p_src") == F.col("a_src")) & (F.col("to.window") == F.col("a_window")))
    return joined.select("p_src", "p_ts", "p_row", "a_window", F.col("to.gap").alias("gap_minutes"))


def count_apps(events: DataFrame, path: str, checkpoint: str, mode: str = "event_type_or_valid_alert", available_now: bool = True) -> StreamingQuery:
    """Per-application label counts, appended per micro-batch under ``batch=`` folders.

    A batch that is retried overwrites its own folder, so counts stay exact.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        malicious = labels.base_label(mode, F.col("event_type"), F.col("alert"))
        counts = routing.label_counts(routing.route(batch), malicious).where(F.col("app").isNotNull())
        counts.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def app_totals(spark: SparkSession, path: str) -> DataFrame:
    """Totals over all written batches, with the grand total under a null application."""
    stored = spark.read.parquet(path)
    return stored.rollup("app").agg(*[F.sum(c).alias(c) for c in ("written_rows", "benign", "malicious")])


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drain what is available into a Parquet table and return it."""
    query = (
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)

