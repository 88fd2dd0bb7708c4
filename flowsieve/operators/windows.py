"""Per-source behaviour in tumbling windows: counters, probe scores and thresholds."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.functions import labels
from flowsieve.functions.scalars import lenient_int, text_or, window_floor
from flowsieve.session import cut_lineage

KEYS = ("window_start", "src_ip")

# Scores feed ``>=`` tests, so both sides are rounded to hide summation-order noise.
SCORE_DECIMALS = 9


@dataclass(frozen=True)
class ProbeSettings:
    """Policy values; zero is a legal setting everywhere."""

    window_minutes: int = 5
    min_event_count: int = 50
    min_unique_dest_ip: int = 10
    min_unique_dest_port: int = 5
    same_percentile: float = 90.0
    near_percentile: float = 95.0
    extreme_percentile: float = 99.0
    near_window_radius: int = 1
    top_candidates: int = 1000


def usable_events(events: DataFrame) -> DataFrame:
    """Events that can belong to a window: a timestamp and a source address."""
    return events.where(F.col("ts").isNotNull() & (F.trim(F.coalesce("src_ip", F.lit(""))) != ""))


def dropped_counts(events: DataFrame) -> DataFrame:
    """How many events no window can take; the timestamp is checked first."""
    blank = F.trim(F.coalesce("src_ip", F.lit(""))) == ""
    return events.agg(
        F.count(F.lit(1)).alias("decoded_events"),
        F.count_if(F.col("ts").isNull()).alias("dropped_no_timestamp"),
        F.count_if(F.col("ts").isNotNull() & blank).alias("dropped_no_src_ip"),
    )


def add_window(events: DataFrame, minutes: int) -> DataFrame:
    return events.withColumn("window_start", window_floor(F.col("ts"), minutes))


def _flow_sum(*fields: str) -> Column:
    total = F.lit(0).cast("bigint")
    for field in fields:
        total = total + lenient_int(F.col(f"flow.{field}"))
    return total


def measures() -> list[Column]:
    """What windows count of an event: source, time, destinations, volumes and alert flags."""
    event_type, alert = F.col("event_type"), F.col("alert")
    port = lenient_int(F.col("dest_port"))
    return [
        F.trim("src_ip").alias("src_ip"),
        F.col("ts"),
        F.nullif(F.trim(F.coalesce("dest_ip", F.lit(""))), F.lit("")).alias("dest_ip"),
        F.when(port > 0, port).alias("dest_port"),
        _flow_sum("bytes_toserver", "bytes_toclient").alias("bytes"),
        _flow_sum("pkts_toserver", "pkts_toclient").alias("pkts"),
        labels.has_alert_object(alert).alias("any_alert"),
        labels.is_event_type_alert(event_type).alias("typed"),
        labels.alert_strict(alert).alias("valid"),
    ]


def probe_windows(events: DataFrame, settings: ProbeSettings = ProbeSettings(), extra_keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per (window, source): counts, exact distinct fan-out, volumes and labels.

    The two exact distinct counts make Spark pre-aggregate on (key, address) and
    (key, port) before the shuffle, so one noisy source is spread over many tasks.
    """
    narrow = add_window(usable_events(events), settings.window_minutes).select(*extra_keys, "window_start", *measures())
    return narrow.groupBy(*extra_keys, *KEYS).agg(
        F.count(F.lit(1)).alias("event_count_window"),
        F.count_distinct("dest_ip").alias("unique_dest_ip_window"),
        F.count_distinct("dest_port").alias("unique_dest_port_window"),
        F.sum("bytes").alias("total_bytes_window"),
        F.sum("pkts").alias("total_pkts_window"),
        F.count_if("any_alert").alias("alert_count_window"),
        F.count_if("typed").alias("event_type_alert_count_window"),
        F.count_if("valid").alias("valid_alert_count_window"),
        F.count_if(F.col("typed") | F.col("valid")).alias("base_alert_positive_count_window"),
        F.count_if(~(F.col("typed") | F.col("valid"))).alias("no_alert_count_window"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
    )


def _capped_share(count: str, minimum: int) -> Column:
    return F.least(F.col(count) / F.lit(float(max(1, minimum))), F.lit(5.0))


def add_scores(windows: DataFrame, settings: ProbeSettings) -> DataFrame:
    """Behaviour score, and the same plus up to five points of alert association."""
    behaviour = (
        _capped_share("event_count_window", settings.min_event_count)
        + _capped_share("unique_dest_ip_window", settings.min_unique_dest_ip) * 1.25
        + _capped_share("unique_dest_port_window", settings.min_unique_dest_port) * 1.25
    )
    alerts = F.least(F.col("base_alert_positive_count_window").cast("double"), F.lit(5.0))
    return windows.withColumns(
        {
            "probe_score_no_alert": F.round(behaviour, SCORE_DECIMALS),
            "probe_score_with_alert": F.round(behaviour + alerts, SCORE_DECIMALS),
            "bytes_per_event_window": F.col("total_bytes_window") / F.col("event_count_window"),
            "pkts_per_event_window": F.col("total_pkts_window") / F.col("event_count_window"),
        }
    )


def score_thresholds(scored: DataFrame, score: str, percentiles: dict[str, float]) -> DataFrame:
    """One row of interpolated percentiles plus the maximum.

    Scores are built from capped counts, so their distinct values are bounded by the caps.
    Counting per score first leaves the final aggregate that bounded table only.
    """
    counts = scored.groupBy(score).agg(F.count(F.lit(1)).alias("n"))
    columns = [
        F.round(F.coalesce(F.percentile(F.col(score), p / 100.0, F.col("n")), F.lit(0.0)), SCORE_DECIMALS).alias(name)
        for name, p in percentiles.items()
    ]
    return counts.agg(*columns, F.coalesce(F.max(score), F.lit(0.0)).alias("max"))


def score_statistics(scored: DataFrame) -> DataFrame:
    """p50/p75/p90/p95/p99/max of both scores, one row each."""
    wanted = {"p50": 50.0, "p75": 75.0, "p90": 90.0, "p95": 95.0, "p99": 99.0}
    parts = [
        score_thresholds(scored, score, wanted).select(F.lit(score).alias("score"), "*")
        for score in ("probe_score_no_alert", "probe_score_with_alert")
    ]
    return parts[0].unionByName(parts[1])


def level_cuts(scored: DataFrame, settings: ProbeSettings) -> dict[str, float]:
    """The three score cuts as numbers; one row reaches the driver."""
    wanted = {"p90": settings.same_percentile, "p95": settings.near_percentile, "p99": settings.extreme_percentile}
    return {name: value for name, value in score_thresholds(scored, "probe_score_no_alert", wanted).first().asDict().items() if name in wanted}


def add_levels(scored: DataFrame, cuts: dict[str, float], settings: ProbeSettings) -> DataFrame:
    """Cuts, level, fan-out flag, suspicious flag and reason text per window.

    Cuts are literals, not subqueries: on 4.1.2 the optimizer rule that merges scalar
    subqueries returned wrong rows once the result was joined to itself.
    """
    with_cuts = scored.withColumns({name: F.lit(value) for name, value in cuts.items()})
    score = F.col("probe_score_no_alert")
    many_ips = F.col("unique_dest_ip_window") >= settings.min_unique_dest_ip
    many_ports = F.col("unique_dest_port_window") >= settings.min_unique_dest_port
    many_events = F.col("event_count_window") >= settings.min_event_count
    reason = F.concat_ws(
        ";",
        F.when(many_events, "high_event_count"),
        F.when(many_ips, "many_dest_ip"),
        F.when(many_ports, "many_dest_port"),
        F.when(F.col("base_alert_positive_count_window") > 0, "base_alert_window"),
        F.when(score >= F.col("p90"), "score_ge_p90"),
    )
    return with_cuts.withColumns(
        {
            "probe_level": F.when(score >= F.col("p99"), "extreme")
            .when(score >= F.col("p95"), "high")
            .when(score >= F.col("p90"), "medium")
            .otherwise("low"),
            "fanout_high": (many_ips | many_ports).cast("int"),
            "is_suspicious_window": ((score >= F.col("p90")) & many_events & (many_ips | many_ports)).cast("int"),
            "probe_reason": F.coalesce(F.nullif(reason, F.lit("")), F.lit("below_threshold")),
        }
    )


def probe_records(events: DataFrame, settings: ProbeSettings = ProbeSettings()) -> DataFrame:
    """Windows with scores, levels and reasons: the full probing analysis of one frame.

    The scored windows are written once: the percentiles, the association joins and the
    budget all read that table, and none of them repeats the scan of the events.
    """
    scored = cut_lineage(add_scores(probe_windows(events, settings), settings), "probe-windows")
    return add_levels(scored, level_cuts(scored, settings), settings)


def top_values_per_window(events: DataFrame, values: Mapping[str, tuple[Column, int]], settings: ProbeSettings) -> DataFrame:
    """Per window and named field the most frequent values, ties by value, as an ordered array.

    ``values`` gives each field's column and how many values to keep.  All fields share one scan: counts per
    (window, source, field, value) come first, so the ranking sees distinct values only, and the
    per-group limit is pushed below the shuffle.  A field without a value in a window is null.
    """
    entries = F.array(
        *[F.struct(F.lit(name).alias("field"), column.cast("string").alias("value")) for name, (column, _) in values.items()]
    )
    counted = (
        add_window(usable_events(events), settings.window_minutes)
        .select("window_start", F.trim("src_ip").alias("src_ip"), F.explode(entries).alias("x"))
        .select(*KEYS, "x.*")
        .where(F.col("value").isNotNull())
        .groupBy(*KEYS, "field", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    order = Window.partitionBy(*KEYS, "field").orderBy(F.col("n").desc(), F.col("value"))
    top = counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(n for _, n in values.values()))

    def best(name: str, n: int) -> Column:
        mine = (F.col("field") == name) & (F.col("rank") <= n)
        found = F.sort_array(F.collect_list(F.when(mine, F.struct("rank", "value", "n"))))
        pairs = F.transform(found, lambda x: F.struct(x["value"].alias("value"), x["n"].alias("n")))
        return F.when(F.size(pairs) > 0, pairs).alias(name)

    return top.groupBy(*KEYS).agg(*[best(name, n) for name, (_, n) in values.items()])


def top_ports_and_types(events: DataFrame, settings: ProbeSettings, n: int = 10) -> DataFrame:
    """Both per-window counters as maps."""
    port = lenient_int(F.col("dest_port"))
    fields = {"top_event_types": (text_or(F.col("event_type"), "unknown"), n), "top_dest_ports": (F.when(port > 0, port), n)}
    return top_values_per_window(events, fields, settings).select(*KEYS, *[F.map_from_entries(c).alias(c) for c in fields])


def alert_windows(records: DataFrame) -> DataFrame:
    """Index of windows that hold at least one base-positive event."""
    return records.where(F.col("base_alert_positive_count_window") > 0).select(
        *KEYS,
        "event_type_alert_count_window",
        "valid_alert_count_window",
        "base_alert_positive_count_window",
        "alert_count_window",
        "probe_score_no_alert",
        "probe_score_with_alert",
        "fanout_high",
        "event_count_window",
        "unique_dest_ip_window",
        "unique_dest_port_window",
    )


def suspicious_windows(records: DataFrame) -> DataFrame:
    return records.where(F.col("is_suspicious_window") == 1)


def top_candidates(records: DataFrame, settings: ProbeSettings = ProbeSettings()) -> DataFrame:
    """The strongest windows by score with alerts; ties by key."""
    return records.orderBy(F.col("probe_score_with_alert").desc(), *KEYS).limit(settings.top_candidates)


def top_global_values(events: DataFrame, n: int = 20) -> DataFrame:
    """Most frequent event types, protocols and ports of usable events in one pass."""
    port = lenient_int(F.col("dest_port"))
    long = usable_events(events).select(
        F.explode(
            F.array(
                F.struct(F.lit("event_type").alias("field"), text_or(F.col("event_type"), "unknown").alias("value")),
                F.struct(F.lit("app_proto").alias("field"), text_or(F.col("app_proto"), "unknown").alias("value")),
                F.struct(F.lit("dest_port").alias("field"), F.when(port > 0, port.cast("string")).alias("value")),
            )
        ).alias("x")
    ).select("x.field", "x.value")
    counted = long.where(F.col("value").isNotNull()).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("field").orderBy(F.col("n").desc(), F.col("value"))
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
