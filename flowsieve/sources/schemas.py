"""Declared schemas and the registry of known data set types."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


_ID_LONGS = ("Unnamed: 0.1", "Unnamed: 0")
_TEXT = ("uid", "originh", "responh", "traffic_category")
_INTS = ("originp", "responp", "Label")

# The 88 column names of the flow-feature table, in file order.
FLOW_COLUMN_NAMES = (
    "Unnamed: 0.1",
    "Unnamed: 0",
    "uid",
    "originh",
    "originp",
    "responh",
    "responp",
    "flow_duration",
    "fwd_pkts_tot",
    "bwd_pkts_tot",
    "fwd_data_pkts_tot",
    "bwd_data_pkts_tot",
    "fwd_pkts_per_sec",
    "bwd_pkts_per_sec",
    "flow_pkts_per_sec",
    "down_up_ratio",
    "fwd_header_size_tot",
    "fwd_header_size_min",
    "fwd_header_size_max",
    "bwd_header_size_tot",
    "bwd_header_size_min",
    "bwd_header_size_max",
    "flow_FIN_flag_count",
    "flow_SYN_flag_count",
    "flow_RST_flag_count",
    "fwd_PSH_flag_count",
    "bwd_PSH_flag_count",
    "flow_ACK_flag_count",
    "fwd_URG_flag_count",
    "bwd_URG_flag_count",
    "flow_CWR_flag_count",
    "flow_ECE_flag_count",
    "fwd_pkts_payload.min",
    "fwd_pkts_payload.max",
    "fwd_pkts_payload.tot",
    "fwd_pkts_payload.avg",
    "fwd_pkts_payload.std",
    "bwd_pkts_payload.min",
    "bwd_pkts_payload.max",
    "bwd_pkts_payload.tot",
    "bwd_pkts_payload.avg",
    "bwd_pkts_payload.std",
    "flow_pkts_payload.min",
    "flow_pkts_payload.max",
    "flow_pkts_payload.tot",
    "flow_pkts_payload.avg",
    "flow_pkts_payload.std",
    "fwd_iat.min",
    "fwd_iat.max",
    "fwd_iat.tot",
    "fwd_iat.avg",
    "fwd_iat.std",
    "bwd_iat.min",
    "bwd_iat.max",
    "bwd_iat.tot",
    "bwd_iat.avg",
    "bwd_iat.std",
    "flow_iat.min",
    "flow_iat.max",
    "flow_iat.tot",
    "flow_iat.avg",
    "flow_iat.std",
    "payload_bytes_per_second",
    "fwd_subflow_pkts",
    "bwd_subflow_pkts",
    "fwd_subflow_bytes",
    "bwd_subflow_bytes",
    "fwd_bulk_bytes",
    "bwd_bulk_bytes",
    "fwd_bulk_packets",
    "bwd_bulk_packets",
    "fwd_bulk_rate",
    "bwd_bulk_rate",
    "active.min",
    "active.max",
    "active.tot",
    "active.avg",
    "active.std",
    "idle.min",
    "idle.max",
    "idle.tot",
    "idle.avg",
    "idle.std",
    "fwd_init_window_size",
    "bwd_init_window_size",
    "fwd_last_window_size",
    "traffic_category",
    "Label",
)


def _flow_type(name: str) -> T.DataType:
    if name in _ID_LONGS:
        return T.LongType()
    if name in _TEXT:
        return T.StringType()
    if name in _INTS:
        return T.IntegerType()
    return T.DoubleType()


FLOW_SCHEMA = T.StructType([T.StructField(name, _flow_type(name)) for name in FLOW_COLUMN_NAMES])

# Keys every event object must have.
EVENT_REQUIRED_KEYS = (
    "timestamp",
    "flow_id",
    "event_type",
    "src_ip",
    "src_port",
    "dest_ip",
    "dest_port",
    "proto",
)


def _text(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


# Scalars stay text here because any field may arrive as text or number; the lenient casts
# decide.  A nested value of the wrong shape becomes null.
EVENT_NESTED = {
    "flow": _text("pkts_toserver", "pkts_toclient", "bytes_toserver", "bytes_toclient", "age"),
    "alert": _text("severity", "category", "signature", "signature_id"),
    "http": _text("http_method", "hostname", "url", "http_user_agent", "status"),
    "tls": T.StructType(
        [
            T.StructField("sni", T.StringType()),
            T.StructField("version", T.StringType()),
            T.StructField("ja3", _text("hash")),
            T.StructField("ja3s", _text("hash")),
        ]
    ),
    "dns": _text("rrname", "rrtype", "rcode", "type"),
    "ssh": T.StructType(
        [
            T.StructField("client", _text("software_version")),
            T.StructField("server", _text("software_version")),
            T.StructField("protocol", T.StringType()),
        ]
    ),
}
EVENT_SCALARS = (
    "timestamp",
    "flow_id",
    "event_type",
    "app_proto",
    "proto",
    "src_ip",
    "src_port",
    "dest_ip",
    "dest_port",
)


@dataclass(frozen=True)
class DatasetType:
    """What a data set must look like: ``columns`` for tables, ``keys`` for JSON lines."""

    name: str
    file_format: str
    label: str
    columns: tuple[str, ...] = ()
    keys: tuple[str, ...] = ()


FLOW_TABLE = DatasetType("flow_table", "csv", "Label", columns=FLOW_COLUMN_NAMES)
EVENT_LOG = DatasetType("event_log", "ndjson", "Target", keys=EVENT_REQUIRED_KEYS)
REGISTRY = {t.name: t for t in (FLOW_TABLE, EVENT_LOG)}


def get_schema(name: str) -> DatasetType | None:
    return REGISTRY.get(name)


def supported_datasets() -> list[str]:
    return list(REGISTRY)
