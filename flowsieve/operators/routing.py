"""Events to applications: matching, multi-application routing, alert and port summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.functions import labels
from flowsieve.functions.hashing import hash60
from flowsieve.functions.network import DNS_PORTS, HTTP_PORTS, SSH_PORTS, TLS_PORTS
from flowsieve.functions.scalars import lenient_int
from flowsieve.operators.allocate import hash_levels, take_prefix

VALID_APPS = ("http", "tls", "dns", "ssh")
DEFAULT_PORTS = {"dns": DNS_PORTS, "http": HTTP_PORTS, "tls": TLS_PORTS, "ssh": SSH_PORTS}


def port_rows(lines: DataFrame) -> DataFrame:
    """``app=p1,p2`` lines (column ``value``) as a row per listed port: ``line``, ``app``, ``port``.

    Blank and commented lines are left out; a part that is no number has a null port, and a
    line without ports one such row.
    """
    line = F.trim("value")
    listed = F.filter(F.split(F.substring_index(line, "=", -1), ","), lambda p: F.trim(p) != "")
    return lines.where((line != "") & ~line.startswith("#")).select(
        line.alias("line"),
        F.when(line.contains("="), F.lower(F.trim(F.substring_index(line, "=", 1)))).alias("app"),
        F.explode_outer(listed).alias("port"),
    ).withColumn("port", F.expr("try_cast(trim(port) AS int)"))


def read_ports(lines: DataFrame) -> dict[str, tuple[int, ...]]:
    """The port table of a configuration file; every application must appear.

    One grouping returns a row per application named, with what is wrong with it.  Several lines
    for an application add up.
    """
    known = F.coalesce(F.col("app").isin(*VALID_APPS), F.lit(False))
    found = port_rows(lines).groupBy("app").agg(
        F.max(~known).alias("unknown"),
        F.max(~F.coalesce(F.col("port").between(0, 65535), F.lit(False))).alias("bad_port"),
        F.max("line").alias("line"),
        F.sort_array(F.collect_set("port")).alias("ports"),
    )
    table = {}
    for row in found.collect():
        if row["unknown"] or row["bad_port"]:
            raise ValueError(f"{'unknown application' if row['unknown'] else 'ports missing or out of range'} in {row['line']!r}")
        table[row["app"]] = tuple(row["ports"])
    if set(table) != set(VALID_APPS):
        raise ValueError(f"no ports given for {sorted(set(VALID_APPS) - set(table))}")
    return table


def _event_ports() -> Column:
    """The record's readable ports, without nulls or repeats."""
    ports = F.array(lenient_int(F.col("src_port"), None), lenient_int(F.col("dest_port"), None))
    return F.array_distinct(F.filter(ports, lambda p: p.isNotNull()))


def match_reason(app: str, ports: Sequence[int], app_proto: Column, event_type: Column, event_ports: Column) -> Column:
    """``app_proto`` beats ``event_type`` beats a known port; null when nothing fits."""
    known = F.array(*[F.lit(int(p)).cast("bigint") for p in ports])
    return (
        F.when(app_proto == app, "app_proto")
        .when(event_type == app, "event_type")
        .when(F.arrays_overlap(event_ports, known), "port_fallback")
    )


def match_app(events: DataFrame, app: str, ports: Mapping[str, Sequence[int]] = DEFAULT_PORTS) -> DataFrame:
    """Every event with ``reason`` (``unmatched`` when none) and the ports that matched."""
    known = F.array(*[F.lit(int(p)).cast("bigint") for p in sorted(ports[app])])
    reason = match_reason(
        app, ports[app], labels.normalize_app(F.col("app_proto")), labels.normalize_app(F.col("event_type")), _event_ports()
    )
    return events.withColumn("reason", F.coalesce(reason, F.lit("unmatched"))).withColumn(
        "matched_ports",
        F.when(F.col("reason") == "port_fallback", F.array_sort(F.array_intersect(_event_ports(), known))).otherwise(
            F.array().cast("array<bigint>")
        ),
    )


def route(events: DataFrame, apps: Sequence[str] = VALID_APPS, ports: Mapping[str, Sequence[int]] = DEFAULT_PORTS) -> DataFrame:
    """One row per (event, matching application), from a single scan.

    An event fits at most one application per rule, so the fan-out is bounded by the number
    of applications; events that fit none disappear.
    """
    prepared = events.withColumns(
        {
            "__proto": labels.normalize_app(F.col("app_proto")),
            "__type": labels.normalize_app(F.col("event_type")),
            "__ports": _event_ports(),
        }
    )
    found = F.array(
        *[
            F.struct(
                F.lit(app).alias("app"),
                match_reason(app, ports[app], F.col("__proto"), F.col("__type"), F.col("__ports")).alias("reason"),
            )
            for app in apps
        ]
    )
    kept = F.filter(found, lambda x: x["reason"].isNotNull())
    return (
        prepared.withColumn("__match", F.explode(kept))
        .withColumns({"app": F.col("__match.app"), "reason": F.col("__match.reason")})
        .drop("__proto", "__type", "__ports", "__match")
    )


def app_events(events: DataFrame, app: str, ports: Mapping[str, Sequence[int]] = DEFAULT_PORTS) -> DataFrame:
    """Events of one application: routing as a plain filter, nothing exploded."""
    return match_app(events, app, ports).where(F.col("reason") != "unmatched").drop("reason", "matched_ports")


def alert_diagnostics(events: DataFrame) -> DataFrame:
    """Routing-stage alert flags per event, with cleaned category and signature."""
    alert = F.col("alert")
    missing = F.lit("<missing>")
    category = F.nullif(labels.normalize_category(alert.getField("category")), F.lit(""))
    signature = F.nullif(F.trim(alert.getField("signature")), F.lit(""))
    return events.withColumns(
        {
            "event_type_alert": labels.normalize_app(F.col("event_type")) == "alert",
            "alert_dict_exists": labels.has_alert_object(alert),
            "alert_severity_exists": labels.severity_present(alert),
            "ignored_alert_category": labels.ignored_category(alert),
            "valid_alert": labels.alert_present(alert),
            "alert_category": F.coalesce(category, missing),
            "alert_signature": F.coalesce(signature, missing),
        }
    )


DIAGNOSTIC_FLAGS = (
    "event_type_alert",
    "alert_dict_exists",
    "alert_severity_exists",
    "ignored_alert_category",
    "valid_alert",
)


def diagnostic_summary(events: DataFrame) -> DataFrame:
    return alert_diagnostics(events).agg(*[F.count_if(flag).alias(flag) for flag in DIAGNOSTIC_FLAGS])


def alert_policy_counts(events: DataFrame) -> DataFrame:
    """The eight export-stage alert counters."""
    event_type, alert = F.col("event_type"), F.col("alert")
    typed = labels.is_event_type_alert(event_type)
    there = labels.has_nonempty_alert(alert)
    valid = labels.alert_strict(alert)
    flags = {
        "event_type_alert": typed,
        "alert_object_rows": there,
        "alert_severity_exists_rows": there & labels.severity_present(alert),
        "ignored_alert_category_rows": there & labels.ignored_category(alert),
        "valid_alert_rows": valid,
        "base_alert_positive_rows": typed | valid,
        "event_type_alert_not_valid_rows": typed & ~valid,
        "valid_alert_not_event_type_rows": valid & ~typed,
    }
    return events.agg(*[F.count_if(flag).alias(name) for name, flag in flags.items()])


def cap_per_app(routed: DataFrame, max_rows: int, row_key: str = "row_id") -> DataFrame:
    """First rows of each application by time, then row hash.

    Cells of one minute bound the sort: a large application is never ranked in one task.
    """
    key_hash = hash60(F.col(row_key))
    minute = F.coalesce(F.floor(F.unix_seconds("ts") / 60), F.lit(-1))
    milli = F.coalesce(F.unix_millis("ts"), F.lit(-1))
    return take_prefix(
        routed,
        group=["app"],
        quota=max_rows,
        levels=[minute, milli, *hash_levels(key_hash)],
        tie=[key_hash, F.col(row_key)],
    )


def port_histogram(events: DataFrame, malicious: Column, known: Sequence[int] = ()) -> DataFrame:
    """Rows, benign and malicious per port and role; ``app_hit`` counts known ports only."""
    src = lenient_int(F.col("src_port"), None)
    dest = lenient_int(F.col("dest_port"), None)
    roles = [
        F.struct(F.lit("src").alias("role"), src.alias("port")),
        F.struct(F.lit("dest").alias("role"), dest.alias("port")),
    ]
    if known:
        roles += [
            F.struct(F.lit("app_hit").alias("role"), F.when(src.isin(*known), src).alias("port")),
            F.struct(F.lit("app_hit").alias("role"), F.when(dest.isin(*known) & ~F.coalesce(src == dest, F.lit(False)), dest).alias("port")),
        ]
    long = events.select(malicious.cast("int").alias("bad"), F.explode(F.array(*roles)).alias("x"))
    return (
        long.select("bad", "x.role", "x.port")
        .where(F.col("port").isNotNull())
        .groupBy("role", "port")
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(F.col("bad") == 0).alias("benign"),
            F.count_if(F.col("bad") == 1).alias("malicious"),
        )
    )


def top_alert_values(events: DataFrame, n: int = 50) -> DataFrame:
    """Most frequent alert categories and signatures among records with an alert object."""
    flagged = alert_diagnostics(events).where("alert_dict_exists")
    counts = flagged.groupingSets([["alert_category"], ["alert_signature"]], "alert_category", "alert_signature").agg(
        F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n")
    )
    # Grouping id 1 leaves out the second column, 2 the first.
    long = counts.select(
        F.when(F.col("g") == 1, "category").otherwise("signature").alias("kind"),
        F.when(F.col("g") == 1, F.col("alert_category")).otherwise(F.col("alert_signature")).alias("value"),
        "n",
    )
    order = Window.partitionBy("kind").orderBy(F.col("n").desc(), "value")
    return long.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def match_summary(routed: DataFrame) -> DataFrame:
    """Counts per application by match reason, protocol and event type in one shuffle."""
    named = routed.select(
        "app",
        "reason",
        F.coalesce(F.nullif(labels.normalize_app(F.col("app_proto")), F.lit("")), F.lit("<missing>")).alias("app_proto"),
        F.coalesce(F.nullif(labels.normalize_app(F.col("event_type")), F.lit("")), F.lit("<missing>")).alias("event_type"),
    )
    counts = named.groupingSets(
        [["app", "reason"], ["app", "app_proto"], ["app", "event_type"]], "app", "reason", "app_proto", "event_type"
    ).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(
        "app",
        F.when(F.col("reason").isNotNull(), "reason")
        .when(F.col("app_proto").isNotNull(), "app_proto")
        .otherwise("event_type")
        .alias("kind"),
        F.coalesce("reason", "app_proto", "event_type").alias("value"),
        "n",
    )


def label_counts(routed: DataFrame, malicious: Column) -> DataFrame:
    """Benign and malicious rows per application plus a grand total (``app`` null)."""
    flagged = routed.select("app", malicious.cast("int").alias("bad"))
    return flagged.rollup("app").agg(
        F.count(F.lit(1)).alias("written_rows"),
        F.count_if(F.col("bad") == 0).alias("benign"),
        F.count_if(F.col("bad") == 1).alias("malicious"),
    )


def merge_summaries(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """New per-application rows replace old ones; the grand total is computed again."""
    kept = existing.where(F.col("app").isNotNull()).join(fresh.select("app"), "app", "left_anti")
    merged = kept.unionByName(fresh.where(F.col("app").isNotNull()))
    return merged.rollup("app").agg(*[F.sum(c).alias(c) for c in ("written_rows", "benign", "malicious")])


def partition_check(routed: DataFrame, ports: Mapping[str, Sequence[int]] = DEFAULT_PORTS) -> DataFrame:
    """Per application partition: rows, rows that do not belong there, reasons seen."""
    apps = list(ports)
    proto, kind = labels.normalize_app(F.col("app_proto")), labels.normalize_app(F.col("event_type"))
    belongs = F.lit(False)
    for app in apps:
        reason = match_reason(app, ports[app], proto, kind, _event_ports())
        belongs = belongs | ((F.col("app") == app) & reason.isNotNull())
    listed = F.lit("")
    for app in apps:
        listed = F.when(F.col("app") == app, ",".join(str(p) for p in sorted(ports[app]))).otherwise(listed)
    return (
        routed.groupBy("app")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(~belongs).alias("misplaced_rows"),
            *[F.count_if(F.col("reason") == r).alias(f"by_{r}") for r in ("app_proto", "event_type", "port_fallback")],
        )
        .withColumn("ports_used", listed)
    )
