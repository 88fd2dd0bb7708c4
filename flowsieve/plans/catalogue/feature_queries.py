"""Base rows, protocol fields and computed features."""

from __future__ import annotations

import ipaddress

from pyspark.sql import functions as F

from flowsieve.functions import buckets, network
from flowsieve.functions.hashing import stable_hash
from flowsieve.functions.scalars import boolish_to_double
from flowsieve.operators import features as X
from flowsieve.plans.catalogue import Query
from flowsieve.plans.stand_in import FLOW_FEATURES, event_cte, event_records, flow_cte, flow_table, read_table


def hash_sql(text: str) -> str:
    return f"((('0x' || substr(md5(coalesce({text}, 'unknown')), 1, 15))::BIGINT) % 2147483647)"


# Base columns of the checking engine; null text is empty, as in the base projection.
BASE = f"""{event_cte()}, base AS (SELECT row_id, ts, src_ip, dest_ip, src_port, dest_port, proto, event_type,
  coalesce(app_proto, '') AS app_proto, pkts_toserver, pkts_toclient, bytes_toserver, bytes_toclient, age AS duration,
  pkts_toserver + pkts_toclient AS total_pkts, bytes_toserver + bytes_toclient AS total_bytes,
  CASE WHEN alert_there THEN 1 ELSE 0 END AS has_alert,
  CASE WHEN alert_there THEN alert_category ELSE '' END AS alert_category,
  CASE WHEN alert_there THEN coalesce(CAST(alert_severity AS BIGINT), 0) ELSE 0 END AS alert_severity,
  CASE WHEN alert_there THEN alert_signature ELSE '' END AS alert_signature,
  CASE WHEN alert_there THEN CAST(alert_signature_id AS BIGINT) ELSE 0 END AS alert_signature_id,
  lower(coalesce(app_proto, '')) AS lp, ev.* EXCLUDE (row_id, ts, src_ip, dest_ip, src_port, dest_port, proto, event_type,
  app_proto, pkts_toserver, pkts_toclient, bytes_toserver, bytes_toclient, alert_category, alert_severity, alert_signature,
  alert_signature_id) FROM ev)"""


def _there(app: str) -> str:
    return f"(lp = '{app}' OR event_type = '{app}')"


def _len(app: str, column: str) -> str:
    return f"CASE WHEN {_there(app)} THEN coalesce(length({column}), 0) ELSE 0 END"


def _txt(app: str, column: str) -> str:
    return f"CASE WHEN {_there(app)} THEN coalesce({column}, '') ELSE '' END"


APP_SQL = {
    "http": {
        "http_method": _txt("http", "http_method"),
        "http_hostname_len": _len("http", "http_hostname"),
        "http_url_len": _len("http", "http_url"),
        "http_user_agent_len": _len("http", "http_user_agent"),
        "http_status": f"CASE WHEN {_there('http')} THEN CAST(http_status AS BIGINT) ELSE 0 END",
    },
    "tls": {
        "tls_sni_len": _len("tls", "tls_sni"),
        "tls_version": _txt("tls", "tls_version"),
        "tls_ja3_len": _len("tls", "tls_ja3"),
        "tls_ja3s_len": _len("tls", "tls_ja3s"),
    },
    "dns": {
        "dns_rrname_len": _len("dns", "dns_rrname"),
        "dns_rrtype": _txt("dns", "dns_rrtype"),
        "dns_rcode": _txt("dns", "dns_rcode"),
        "dns_type": _txt("dns", "dns_type"),
    },
    "ssh": {
        "ssh_client_version_len": _len("ssh", "ssh_client"),
        "ssh_server_version_len": _len("ssh", "ssh_server"),
        "ssh_protocol": _txt("ssh", "ssh_protocol"),
    },
}


def computed_rows(spark, sf_dir, app="tls"):
    """Base and computed columns of every event, with the parsed time and the row id."""
    return X.add_computed(X.base_rows(event_records(spark, sf_dir), app, keep=["row_id", "ts"]), app)


def _base(spark, sf_dir):
    rows = X.base_rows(event_records(spark, sf_dir), "tls", keep=["row_id"])
    names = [c for c in X.BASE_COLUMNS if c not in ("timestamp", "window_start")]
    return rows.select("row_id", *names)


def _app(app):
    def run(spark, sf_dir):
        rows = X.base_rows(event_records(spark, sf_dir), app, keep=["row_id"])
        return rows.select("row_id", *APP_SQL[app])

    return run


def _nested(spark, sf_dir):
    events = event_records(spark, sf_dir)
    return events.select(
        "row_id", X.nested("tls.ja3.hash", "none").alias("ja3"), X.nested("ssh.client.software_version", "none").alias("client")
    )


def _single_ports(spark, sf_dir):
    """Flags over a table that names one port per application."""
    return computed_rows(spark, sf_dir, "tls").withColumns(network.port_flags(F.col("dest_port"))).select("row_id", *_SINGLE_PORT_SQL)


def _pick(names, digits=6, app="tls"):
    def run(spark, sf_dir):
        rows = computed_rows(spark, sf_dir, app)
        return rows.select("row_id", *[F.round(n, digits).alias(n) if digits is not None else F.col(n) for n in names])

    return run


def _private(spark, sf_dir):
    """Both private-address rules over addresses that the event and user numbers spread over the whole space."""
    events = read_table(spark, sf_dir, "events")
    number = F.pmod(F.col("event_id").cast("bigint") * 2_654_435_761 + F.col("user_id"), F.lit(2**32))
    ip = F.concat_ws(".", *[F.shiftright(number, bits).bitwiseAND(255).cast("string") for bits in (24, 16, 8, 0)])
    return events.select("event_id", network.is_private(ip).alias("private"), network.is_rfc1918(ip).alias("rfc1918"))


def _subnet(spark, sf_dir):
    return event_records(spark, sf_dir).select(
        "row_id", network.subnet24(F.col("src_ip")).alias("src"), network.subnet24(F.col("dest_ip")).alias("dest")
    )


def _hash(spark, sf_dir):
    documents = read_table(spark, sf_dir, "documents")
    return documents.select("doc_id", stable_hash(F.col("text")).alias("text_h"), stable_hash(F.col("source")).alias("source_h"))


def _row_stats(spark, sf_dir):
    rows = X.row_statistics(flow_table(spark, sf_dir), FLOW_FEATURES)
    return rows.select("row_key", *[F.round(c, 6).alias(c) for c in ("row_mean", "row_std", "row_max", "row_sum")])


def _clean(spark, sf_dir):
    rows = flow_table(spark, sf_dir).select(
        "row_key",
        F.when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(F.col("l_tax") / F.col("l_discount")).alias("rate"),
        F.when(F.col("l_tax") > 0.02, F.col("l_quantity").cast("bigint")).alias("maybe"),
        F.when(F.col("l_tax") > 0.04, F.col("l_returnflag")).alias("label_source"),
        F.when(F.col("l_tax") > 0.04, F.col("l_returnflag")).alias("other_text"),
        F.array(F.col("l_linenumber").cast("int")).alias("nested"),
    )
    return X.clean_rows(rows).withColumn("rate", F.round("rate", 6))


def _leftovers(spark, sf_dir):
    rows = flow_table(spark, sf_dir).select(
        "row_key",
        F.col("row_key").alias("key_raw"),
        "l_returnflag",
        F.col("l_quantity").cast("string").alias("quantity_text"),
        F.col("Label").alias("Target"),
        F.col("l_linestatus").alias("src_ip"),
    )
    out = X.encode_leftovers(rows, preserve=("src_ip", "row_key"))
    return out


def _totals(spark, sf_dir):
    events = event_records(spark, sf_dir).select(
        "row_id",
        "flow.*",
        F.when(F.col("row_id") % 3 == 0, 0).otherwise(F.col("row_id")).alias("total_pkts"),
    )
    return X.flow_totals(events).select("row_id", "total_pkts", "total_bytes")


def _drop_ids(spark, sf_dir):
    rows = X.drop_identifiers(computed_rows(spark, sf_dir))
    kept = [c for c in ("proto", "event_type", "timestamp", "app_proto") if c in rows.columns]
    return rows.groupBy("application").agg(F.count(F.lit(1)).alias("rows")).withColumn("left_over", F.lit(len(kept)))


def _boolish(spark, sf_dir):
    rows = flow_table(spark, sf_dir)
    words = {
        "flag": F.concat(F.lit(" "), "l_returnflag"),
        "status": F.col("l_linestatus"),
        "dear": (F.col("l_discount") > 0.05).cast("string"),
        "quantity": F.concat(F.col("l_quantity").cast("string"), F.lit(" ")),
    }
    return rows.select("row_key", *[boolish_to_double(text).alias(name) for name, text in words.items()])


def _preview(spark, sf_dir):
    return X.preview(event_records(spark, sf_dir), "tls", 5).select("row_id", "src_ip", "total_bytes", "tls_sni_len")


def _flow_prep(spark, sf_dir):
    rows = flow_table(spark, sf_dir).withColumn("l_tax", F.when(F.col("l_tax") > 0, F.col("l_tax")))
    out = X.prepare_flow_table(rows, "Label", dropped=("row_key",))
    return out.groupBy("Label").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("l_tax"), 4).alias("tax"), F.lit(len(out.columns)).alias("columns")
    )


def _buckets(spark, sf_dir):
    rows = flow_table(spark, sf_dir)
    return rows.groupBy(
        buckets.numeric_bucket(F.col("l_extendedprice") - 2000).alias("price"),
        buckets.ratio_bucket(F.col("l_discount") * 12).alias("discount"),
    ).agg(F.count(F.lit(1)).alias("rows"))


_RATE_SQL = {
    "bytes_per_pkt": "total_bytes / greatest(total_pkts, 1)",
    "pkts_per_sec": "total_pkts / greatest(duration, 1e-6)",
    "bytes_per_sec": "total_bytes / greatest(duration, 1e-6)",
}
_RATIO_SQL = {
    "bytes_toserver_ratio": "bytes_toserver / greatest(total_bytes, 1)",
    "bytes_toclient_ratio": "bytes_toclient / greatest(total_bytes, 1)",
    "pkts_toserver_ratio": "pkts_toserver / greatest(total_pkts, 1)",
    "pkts_toclient_ratio": "pkts_toclient / greatest(total_pkts, 1)",
}
_LOG_SQL = {
    "log_total_bytes": "ln(1 + greatest(total_bytes, 0))",
    "log_total_pkts": "ln(1 + greatest(total_pkts, 0))",
    "log_duration": "ln(1 + greatest(duration, 0))",
}
_CLASS = "CASE WHEN {p} BETWEEN 1 AND 1023 THEN 1 WHEN {p} BETWEEN 1024 AND 49151 THEN 2 WHEN {p} >= 49152 THEN 3 ELSE 0 END"
_FLAG_SQL = {
    "dport_is_dns": "CASE WHEN dest_port = 53 THEN 1 ELSE 0 END",
    "dport_is_http": "CASE WHEN dest_port IN (80, 8080, 8000, 8008, 8888) THEN 1 ELSE 0 END",
    "dport_is_https": "CASE WHEN dest_port IN (443, 8443) THEN 1 ELSE 0 END",
    "dport_is_ssh": "CASE WHEN dest_port = 22 THEN 1 ELSE 0 END",
}
_SINGLE_PORT_SQL = {f"dport_is_{n}": f"CASE WHEN dest_port = {p} THEN 1 ELSE 0 END" for n, p in (("dns", 53), ("http", 80), ("https", 443), ("ssh", 22))}
_TIME_SQL = {
    "ts_hour": "coalesce(hour(ts), 0)",
    "ts_dow": "coalesce(isodow(ts) - 1, 0)",
    "ts_is_weekend": "CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END",
}
_SUBNET = "CASE WHEN len(string_split({ip}, '.')) >= 3 THEN array_to_string(string_split({ip}, '.')[1:3], '.') ELSE '0.0.0' END"
_SRC24, _DEST24 = _SUBNET.format(ip="src_ip"), _SUBNET.format(ip="dest_ip")
_INTERACTION_SQL = {
    "interaction_total_bytes_duration": "ln(1 + total_bytes) * ln(1 + duration)",
    "interaction_total_pkts_duration": "ln(1 + total_pkts) * ln(1 + duration)",
    "interaction_bytes_rate_packet_rate": "(total_bytes / greatest(duration, 1e-6)) * (total_pkts / greatest(duration, 1e-6))",
}
COMPUTED_SQL = {**_RATE_SQL, **_RATIO_SQL, **_LOG_SQL, **_FLAG_SQL, **_TIME_SQL, **_INTERACTION_SQL}


def _select(columns: dict[str, str], digits: int | None = 6) -> str:
    body = ", ".join(f"{f'round({e}, {digits})' if digits is not None else e} AS {n}" for n, e in columns.items())
    return f"WITH {BASE} SELECT row_id, {body} FROM base"


_STAT_VALUES = "[" + ", ".join(FLOW_FEATURES) + "]"
_HASHED = {
    "http": {"http_method_h": hash_sql(APP_SQL["http"]["http_method"])},
    "tls": {"tls_version_h": hash_sql(APP_SQL["tls"]["tls_version"])},
    "dns": {"dns_rrtype_h": hash_sql(APP_SQL["dns"]["dns_rrtype"]), "dns_rcode_h": hash_sql(APP_SQL["dns"]["dns_rcode"])},
    "ssh": {"ssh_protocol_h": hash_sql(APP_SQL["ssh"]["ssh_protocol"])},
}
_INDICATORS = {
    "http": {"http_status_class": f"{APP_SQL['http']['http_status']} // 100"},
    "tls": {"tls_has_sni": f"CASE WHEN {APP_SQL['tls']['tls_sni_len']} > 0 THEN 1 ELSE 0 END"},
    "dns": {"dns_query_name_present": f"CASE WHEN {APP_SQL['dns']['dns_rrname_len']} > 0 THEN 1 ELSE 0 END"},
    "ssh": {
        "ssh_has_client_version": f"CASE WHEN {APP_SQL['ssh']['ssh_client_version_len']} > 0 THEN 1 ELSE 0 END",
        "ssh_has_server_version": f"CASE WHEN {APP_SQL['ssh']['ssh_server_version_len']} > 0 THEN 1 ELSE 0 END",
    },
}


def _address(text: str) -> int:
    return int(ipaddress.IPv4Address(text))


def _blocks_sql(blocks) -> str:
    nets = [ipaddress.ip_network(block) for block in blocks]
    return " OR ".join(f"ip BETWEEN {int(net[0])} AND {int(net[-1])}" for net in nets)


_EXCEPTIONS = ", ".join(str(_address(ip)) for ip in network.GLOBAL_EXCEPTIONS)

QUERIES = [
    Query(
        "f1_base_rows",
        _base,
        f"WITH {BASE} SELECT row_id, src_ip, dest_ip, src_port, dest_port, proto, event_type, app_proto, 'tls' AS application, "
        "pkts_toserver, pkts_toclient, bytes_toserver, bytes_toclient, duration, total_pkts, total_bytes, has_alert, "
        "alert_category, alert_severity, alert_signature, alert_signature_id FROM base",
    ),
    *[
        Query(f"f{i}_{app}_fields", _app(app), _select(APP_SQL[app], None))
        for i, app in enumerate(("http", "tls", "dns", "ssh"), start=2)
    ],
    Query(
        "f6_nested_path",
        _nested,
        f"WITH {BASE} SELECT row_id, CASE WHEN {_there('tls')} THEN coalesce(tls_ja3, 'none') ELSE 'none' END AS ja3, "
        f"CASE WHEN {_there('ssh')} THEN coalesce(ssh_client, 'none') ELSE 'none' END AS client FROM base",
    ),
    Query("f7_rates", _pick(_RATE_SQL, 7), _select(_RATE_SQL, 7)),
    Query("f8_direction_ratios", _pick(_RATIO_SQL), _select(_RATIO_SQL)),
    Query("f9_log_transforms", _pick(_LOG_SQL), _select(_LOG_SQL)),
    Query(
        "f10_port_classes",
        _pick(["src_port_class", "dest_port_class"], None),
        _select({"src_port_class": _CLASS.format(p="src_port"), "dest_port_class": _CLASS.format(p="dest_port")}, None),
    ),
    Query("f11_port_flags", _pick(_FLAG_SQL, None), _select(_FLAG_SQL, None)),
    Query("f11_single_port_flags", _single_ports, _select(_SINGLE_PORT_SQL, None)),
    Query("f12_calendar", _pick(_TIME_SQL, None), _select(_TIME_SQL, None)),
    Query(
        "f13_private_ipv4",
        _private,
        "WITH n AS (SELECT event_id, (event_id::HUGEINT * 2654435761 + user_id) % 4294967296 AS ip FROM events) "
        f"SELECT event_id, CASE WHEN ({_blocks_sql(network.NON_GLOBAL_BLOCKS)}) AND ip NOT IN ({_EXCEPTIONS}) THEN 1 ELSE 0 END AS private, "
        f"CASE WHEN {_blocks_sql(network.RFC1918_BLOCKS)} THEN 1 ELSE 0 END AS rfc1918 FROM n",
    ),
    Query("f14_subnet_prefix", _subnet, f"WITH {BASE} SELECT row_id, {_SRC24} AS src, {_DEST24} AS dest FROM base"),
    Query("f15_stable_hash", _hash, f"SELECT doc_id, {hash_sql('text')} AS text_h, {hash_sql('source')} AS source_h FROM documents"),
    Query(
        "f16_same_subnet",
        _pick(["same_subnet24"], None),
        _select({"same_subnet24": f"CASE WHEN {_SRC24} = {_DEST24} THEN 1 ELSE 0 END"}, None),
    ),
    Query(
        "f17_category_hashes",
        _pick(["proto_h", "event_type_h", "app_proto_h", "src_subnet24_h"], None),
        _select(
            {
                "proto_h": hash_sql("proto"),
                "event_type_h": hash_sql("event_type"),
                "app_proto_h": hash_sql("app_proto"),
                "src_subnet24_h": hash_sql(f"({_SRC24})"),
            },
            None,
        ),
    ),
    *[Query(f"f17_{app}_hashes", _pick(_HASHED[app], None, app), _select(_HASHED[app], None)) for app in X.APPS],
    *[Query(f"f18_{app}_indicators", _pick(_INDICATORS[app], None, app), _select(_INDICATORS[app], None)) for app in X.APPS],
    Query("f19_interactions", _pick(_INTERACTION_SQL, 4), _select(_INTERACTION_SQL, 4)),
    Query(
        "f20_row_statistics",
        _row_stats,
        f"WITH {flow_cte()} SELECT row_key, round(list_avg({_STAT_VALUES}), 6) AS row_mean, "
        f"round(list_stddev_pop({_STAT_VALUES}), 6) AS row_std, round(list_max({_STAT_VALUES}), 6) AS row_max, "
        f"round(list_sum({_STAT_VALUES}), 6) AS row_sum FROM fl",
    ),
    Query(
        "f21_clean_rows",
        _clean,
        f"WITH {flow_cte()} SELECT row_key, CASE WHEN l_discount = 0 THEN 0 ELSE round(l_tax / l_discount, 6) END AS rate, "
        "CASE WHEN l_tax > 0.02 THEN CAST(l_quantity AS BIGINT) ELSE 0 END AS maybe, "
        "CASE WHEN l_tax > 0.04 THEN l_returnflag ELSE '' END AS label_source, "
        "CASE WHEN l_tax > 0.04 THEN l_returnflag ELSE '0' END AS other_text, "
        "'[' || CAST(CAST(l_linenumber AS INT) AS VARCHAR) || ']' AS nested FROM fl",
    ),
    Query(
        "f22_encode_leftovers",
        _leftovers,
        f"WITH {flow_cte()} SELECT row_key, row_key AS key_raw, {hash_sql('l_returnflag')} AS l_returnflag, "
        "l_quantity AS quantity_text, Label AS Target, l_linestatus AS src_ip FROM fl",
    ),
    Query(
        "f23_flow_totals",
        _totals,
        f"WITH {event_cte()} SELECT row_id, CAST(CASE WHEN row_id % 3 <> 0 THEN row_id ELSE pkts_toserver + pkts_toclient END "
        "AS DOUBLE) AS total_pkts, CAST(bytes_toserver + bytes_toclient AS DOUBLE) AS total_bytes FROM ev",
    ),
    Query(
        "f24_drop_identifiers",
        _drop_ids,
        "SELECT 'tls' AS application, count(*) AS rows, 0 AS left_over FROM events",
    ),
    Query(
        "f25_boolean_words",
        _boolish,
        f"WITH {flow_cte()} SELECT row_key, 0.0::DOUBLE AS flag, 0.0::DOUBLE AS status, "
        "CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END AS dear, l_quantity::DOUBLE AS quantity FROM fl",
    ),
    Query(
        "f26_preview",
        _preview,
        f"WITH {BASE} SELECT row_id, src_ip, total_bytes, {APP_SQL['tls']['tls_sni_len']} AS tls_sni_len FROM base ORDER BY row_id LIMIT 5",
    ),
    Query(
        "f27_flow_table_preparation",
        _flow_prep,
        f"WITH {flow_cte()} SELECT Label, count(*) AS rows, round(sum(l_tax), 4) AS tax, 8 AS columns FROM fl WHERE l_tax > 0 GROUP BY Label",
    ),
    Query(
        "f28_buckets",
        _buckets,
        "WITH v AS (SELECT l_extendedprice - 2000 AS x, l_discount * 12 AS r FROM lineitem) SELECT CASE WHEN x <= 0 THEN '0' "
        "WHEN x <= 1 THEN '0-1' WHEN x <= 10 THEN '1-10' WHEN x <= 100 THEN '10-100' WHEN x <= 1000 THEN '100-1K' WHEN x <= "
        "10000 THEN '1K-10K' WHEN x <= 100000 THEN '10K-100K' WHEN x <= 1000000 THEN '100K-1M' ELSE '>1M' END AS price, "
        "CASE WHEN r <= 0 THEN '0' WHEN r < 0.25 THEN '0-0.25' WHEN r < 0.5 THEN '0.25-0.50' WHEN r < 0.75 THEN '0.50-0.75' "
        "WHEN r < 1 THEN '0.75-1.00' ELSE '>=1.00' END AS discount, count(*) AS rows FROM v GROUP BY ALL",
    ),
]
