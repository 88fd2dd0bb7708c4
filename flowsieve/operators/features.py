"""Event rows to model features: base projection, computed columns, cleaning, encoding."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve.functions import labels, network
from flowsieve.functions.hashing import CATEGORY_MOD, stable_hash
from flowsieve.functions.scalars import (
    clean_double,
    is_weekend,
    lenient_double,
    lenient_int,
    numeric_or_null,
    value_length,
    weekday_monday0,
)

APPS = ("http", "tls", "dns", "ssh")

# Columns of the exported base row, in order.
BASE_COLUMNS = (
    "timestamp",
    "window_start",
    "src_ip",
    "dest_ip",
    "src_port",
    "dest_port",
    "proto",
    "event_type",
    "app_proto",
    "application",
    "pkts_toserver",
    "pkts_toclient",
    "bytes_toserver",
    "bytes_toclient",
    "duration",
    "total_pkts",
    "total_bytes",
    "has_alert",
    "alert_category",
    "alert_severity",
    "alert_signature",
    "alert_signature_id",
)
TEXT_COLUMNS = (
    "timestamp",
    "window_start",
    "src_ip",
    "dest_ip",
    "proto",
    "event_type",
    "app_proto",
    "application",
    "alert_category",
    "alert_signature",
    "label_source",
    "refinement_reason",
)


def nested(path: str, default: str = "") -> Column:
    """Text of a nested field, or ``default`` when any level is missing."""
    return F.coalesce(F.col(path).cast("string"), F.lit(default))


def _blank(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def base_columns(application: Column) -> dict[str, Column]:
    """Fields shared by every application, read leniently from a typed event record."""
    alert = F.col("alert")
    there = labels.has_nonempty_alert(alert)
    flow = {name: lenient_int(F.col(f"flow.{name}")) for name in ("pkts_toserver", "pkts_toclient", "bytes_toserver", "bytes_toclient")}
    return {
        "timestamp": _blank(F.col("timestamp")),
        "src_ip": _blank(F.col("src_ip")),
        "dest_ip": _blank(F.col("dest_ip")),
        "src_port": lenient_int(F.col("src_port")),
        "dest_port": lenient_int(F.col("dest_port")),
        "proto": _blank(F.col("proto")),
        "event_type": _blank(F.col("event_type")),
        "app_proto": _blank(F.col("app_proto")),
        "application": application,
        **flow,
        "duration": lenient_double(F.col("flow.age")),
        "total_pkts": flow["pkts_toserver"] + flow["pkts_toclient"],
        "total_bytes": flow["bytes_toserver"] + flow["bytes_toclient"],
        "has_alert": there.cast("int"),
        "alert_category": F.when(there, nested("alert.category")).otherwise(""),
        "alert_severity": F.when(there, lenient_int(F.col("alert.severity"))).otherwise(F.lit(0).cast("bigint")),
        "alert_signature": F.when(there, nested("alert.signature")).otherwise(""),
        "alert_signature_id": F.when(there, lenient_int(F.col("alert.signature_id"))).otherwise(F.lit(0).cast("bigint")),
    }


def app_columns(app: str) -> dict[str, Column]:
    """Protocol fields of one application; lengths instead of free text."""
    if app == "http":
        return {
            "http_method": nested("http.http_method"),
            "http_hostname_len": value_length(F.col("http.hostname")),
            "http_url_len": value_length(F.col("http.url")),
            "http_user_agent_len": value_length(F.col("http.http_user_agent")),
            "http_status": lenient_int(F.col("http.status")),
        }
    if app == "tls":
        return {
            "tls_sni_len": value_length(F.col("tls.sni")),
            "tls_version": nested("tls.version"),
            "tls_ja3_len": value_length(F.col("tls.ja3.hash")),
            "tls_ja3s_len": value_length(F.col("tls.ja3s.hash")),
        }
    if app == "dns":
        return {
            "dns_rrname_len": value_length(F.col("dns.rrname")),
            "dns_rrtype": nested("dns.rrtype"),
            "dns_rcode": nested("dns.rcode"),
            "dns_type": nested("dns.type"),
        }
    if app == "ssh":
        return {
            "ssh_client_version_len": value_length(F.col("ssh.client.software_version")),
            "ssh_server_version_len": value_length(F.col("ssh.server.software_version")),
            "ssh_protocol": nested("ssh.protocol"),
        }
    raise ValueError(f"application must be one of {APPS}, got {app!r}")


def base_rows(events: DataFrame, app: str, keep: Sequence[str] = ()) -> DataFrame:
    """Flat feature base of one application; ``keep`` names extra columns to carry along."""
    return events.select(
        *keep, *[c.alias(name) for name, c in {**base_columns(F.lit(app)), **app_columns(app)}.items()]
    )


def preview(events: DataFrame, app: str, rows: int = 5) -> DataFrame:
    """First rows of the base projection, for a person to look at."""
    return base_rows(events, app, keep=["row_id"]).orderBy("row_id").limit(rows)


def _ratio(a: Column, b: Column, floor: float) -> Column:
    return a / F.greatest(b, F.lit(floor))


def _log(c: Column) -> Column:
    return F.log1p(F.greatest(c, F.lit(0.0)))


def computed_columns() -> dict[str, Column]:
    """Application-independent computed features over the base columns.

    ``ts`` must be the parsed timestamp; a null gives zeros for the calendar features.
    """
    d = {
        name: F.col(name).cast("double")
        for name in ("total_bytes", "total_pkts", "duration", "bytes_toserver", "bytes_toclient", "pkts_toserver", "pkts_toclient")
    }
    ts, src, dest = F.col("ts"), F.col("src_ip"), F.col("dest_ip")
    log_bytes, log_pkts, log_duration = _log(d["total_bytes"]), _log(d["total_pkts"]), _log(d["duration"])
    pkt_rate = _ratio(d["total_pkts"], d["duration"], 1e-6)
    byte_rate = _ratio(d["total_bytes"], d["duration"], 1e-6)
    return {
        "bytes_per_pkt": _ratio(d["total_bytes"], d["total_pkts"], 1.0),
        "pkts_per_sec": pkt_rate,
        "bytes_per_sec": byte_rate,
        "bytes_toserver_ratio": _ratio(d["bytes_toserver"], d["total_bytes"], 1.0),
        "bytes_toclient_ratio": _ratio(d["bytes_toclient"], d["total_bytes"], 1.0),
        "pkts_toserver_ratio": _ratio(d["pkts_toserver"], d["total_pkts"], 1.0),
        "pkts_toclient_ratio": _ratio(d["pkts_toclient"], d["total_pkts"], 1.0),
        "log_total_bytes": log_bytes,
        "log_total_pkts": log_pkts,
        "log_duration": log_duration,
        "src_port_class": network.port_class(F.col("src_port")),
        "dest_port_class": network.port_class(F.col("dest_port")),
        "dport_is_dns": network.port_in(F.col("dest_port"), network.DNS_PORTS),
        "dport_is_http": network.port_in(F.col("dest_port"), network.HTTP_PORTS),
        "dport_is_https": network.port_in(F.col("dest_port"), network.TLS_PORTS),
        "dport_is_ssh": network.port_in(F.col("dest_port"), network.SSH_PORTS),
        "ts_hour": F.coalesce(F.hour(ts), F.lit(0)),
        "ts_dow": weekday_monday0(ts),
        "ts_is_weekend": is_weekend(ts),
        "src_is_private": network.is_private(src),
        "dest_is_private": network.is_private(dest),
        "src_subnet24_h": stable_hash(network.subnet24(src)),
        "dest_subnet24_h": stable_hash(network.subnet24(dest)),
        "same_subnet24": network.same_subnet24(src, dest),
        "proto_h": stable_hash(F.col("proto")),
        "event_type_h": stable_hash(F.col("event_type")),
        "app_proto_h": stable_hash(F.col("app_proto")),
        "interaction_total_bytes_duration": log_bytes * log_duration,
        "interaction_total_pkts_duration": log_pkts * log_duration,
        "interaction_bytes_rate_packet_rate": byte_rate * pkt_rate,
    }


def app_computed_columns(app: str) -> dict[str, Column]:
    """Hash codes and indicators over the application columns."""
    present = {
        "tls": {"tls_has_sni": "tls_sni_len"},
        "dns": {"dns_query_name_present": "dns_rrname_len"},
        "ssh": {"ssh_has_client_version": "ssh_client_version_len", "ssh_has_server_version": "ssh_server_version_len"},
    }
    hashed = {
        "http": ("http_method",),
        "tls": ("tls_version",),
        "dns": ("dns_rrtype", "dns_rcode"),
        "ssh": ("ssh_protocol",),
    }
    if app not in hashed:
        raise ValueError(f"application must be one of {APPS}, got {app!r}")
    out = {f"{name}_h": stable_hash(F.col(name)) for name in hashed[app]}
    if app == "http":
        out["http_status_class"] = F.floor(F.col("http_status") / 100)
    out.update({name: (F.col(source) > 0).cast("int") for name, source in present.get(app, {}).items()})
    return out


def add_computed(rows: DataFrame, app: str) -> DataFrame:
    return rows.withColumns({**computed_columns(), **app_computed_columns(app)})


def row_statistics(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean, population deviation, maximum and sum across the chosen columns of each row."""
    values = F.array(*[clean_double(F.col(f"`{f}`").cast("double")) for f in features])
    n = float(len(features))
    zero = F.lit(0.0)
    total = F.aggregate("__values", zero, lambda acc, x: acc + x)
    spread = F.aggregate("__values", zero, lambda acc, x: acc + (x - F.col("row_mean")) * (x - F.col("row_mean")))
    return (
        rows.withColumn("__values", values)
        .withColumns({"row_sum": total, "row_mean": total / n, "row_max": F.array_max("__values")})
        .withColumn("row_std", F.sqrt(spread / n))
        .drop("__values")
    )


def clean_rows(rows: DataFrame) -> DataFrame:
    """Nulls to 0 (or empty text), non-finite numbers to 0, nested values to JSON text."""
    out = []
    for field in rows.schema.fields:
        c = F.col(f"`{field.name}`")
        kind = field.dataType
        if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
            c = F.coalesce(F.to_json(c), F.lit("0"))
        elif isinstance(kind, (T.DoubleType, T.FloatType)):
            c = clean_double(c)
        elif isinstance(kind, T.StringType):
            c = F.coalesce(c, F.lit("" if field.name in TEXT_COLUMNS else "0"))
        elif isinstance(kind, T.NumericType):
            c = F.coalesce(c, F.lit(0).cast(kind))
        out.append(c.alias(field.name))
    return rows.select(*out)


def numeric_shares(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Share of rows per column that read as a number; one pass over all columns."""
    shares = [
        F.avg(numeric_or_null(F.col(f"`{c}`")).isNotNull().cast("double")).alias(str(i)) for i, c in enumerate(columns)
    ]
    row = df.agg(*shares).first()
    return {c: row[str(i)] or 0.0 for i, c in enumerate(columns)}


def encode_leftovers(
    df: DataFrame,
    *,
    target: str = "Target",
    preserve: Sequence[str] = ("src_ip", "dest_ip"),
    threshold: float = 0.98,
    mod: int = CATEGORY_MOD,
) -> DataFrame:
    """Make every remaining column numeric.

    Text that is almost always a number is read as one; other text becomes its hash.
    ``*_raw`` columns and the addresses stay text.
    """
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BooleanType))]
    kept_raw = {c for c in df.columns if c.endswith("_raw")}
    candidates = [c for c in text if c not in kept_raw and c not in preserve and c != target]
    shares = numeric_shares(df, candidates) if candidates else {}
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if field.name in kept_raw:
            pass
        elif field.name in preserve:
            c = F.coalesce(c.cast("string"), F.lit("unknown"))
        elif field.name == target:
            c = lenient_int(c)
        elif field.name in shares:
            c = lenient_double(c) if shares[field.name] >= threshold else stable_hash(c, mod)
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = clean_double(c)
        elif isinstance(field.dataType, T.NumericType):
            c = F.coalesce(c, F.lit(0).cast(field.dataType))
        out.append(c.alias(field.name))
    return df.select(*out)


def flow_totals(df: DataFrame) -> DataFrame:
    """Declared totals where non-zero, else the sum of the two directions."""

    def total(name: str, a: str, b: str) -> Column:
        declared = lenient_double(F.col(name)) if name in df.columns else F.lit(0.0)
        return F.when(declared != 0, declared).otherwise(lenient_double(F.col(a)) + lenient_double(F.col(b)))

    return df.withColumns(
        {
            "total_pkts": total("total_pkts", "pkts_toserver", "pkts_toclient"),
            "total_bytes": total("total_bytes", "bytes_toserver", "bytes_toclient"),
        }
    )


# Identifiers and raw text replaced by derived columns before modelling.
DROPPED_IDENTIFIERS = ("flow_id", "pkt_src", "community_id", "tx_id", "timestamp", "proto", "app_proto", "event_type")


def drop_identifiers(df: DataFrame) -> DataFrame:
    return df.drop(*DROPPED_IDENTIFIERS)


# Columns of the flow-feature table that are no features.
FLOW_DROPPED = ("Unnamed: 0.1", "Unnamed: 0", "uid", "originh", "responh", "traffic_category")


def prepare_flow_table(df: DataFrame, label: str, dropped: Sequence[str] = FLOW_DROPPED) -> DataFrame:
    """Numeric feature columns and the label, without rows that miss any feature."""
    kept = [
        f.name
        for f in df.schema.fields
        if f.name not in dropped and (f.name == label or isinstance(f.dataType, T.NumericType))
    ]
    features = [c for c in kept if c != label]
    whole = reduce(
        lambda a, b: a & b,
        [F.col(f"`{c}`").isNotNull() & ~F.isnan(F.col(f"`{c}`").cast("double")) for c in features],
        F.lit(True),
    )
    return df.where(whole).select(*[F.col(f"`{c}`") for c in kept])
