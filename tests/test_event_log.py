"""Malformed lines, wrong types, routing and flattening on hand-written logs."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from flowsieve.operators import quality, routing
from flowsieve.sources import event_log, schemas

GOOD = {
    "timestamp": "2024-01-06T10:05:00+00:00",
    "flow_id": 1,
    "event_type": "tls",
    "src_ip": "10.0.0.1",
    "src_port": "443",
    "dest_ip": "1.1.1.1",
    "dest_port": 80,
    "proto": "TCP",
}
LINES = [
    json.dumps(GOOD),
    "",
    "   ",
    "{broken",
    "[1,2]",
    '"text"',
    json.dumps({**GOOD, "flow_id": 2, "alert": "a string", "src_port": "x"}),
    json.dumps({**GOOD, "flow_id": 3, "alert": {}, "flow": {"bytes_toserver": "12.9", "age": 1.5}}),
    json.dumps({**GOOD, "flow_id": 4, "alert": {"severity": 2, "category": "Recon"}, "http": {"status": 404}, "flow": 7}),
    json.dumps({**GOOD, "flow_id": 5, "tls": {"sni": "a.b", "ja3": {"hash": "h"}}, "extra": [1, {"a": None}]}),
]


@pytest.fixture(scope="module", params=["plain", "gzip"])
def log(request, tmp_path_factory):
    folder = tmp_path_factory.mktemp("log")
    if request.param == "gzip":
        path = folder / "eve.json.gz"
        path.write_bytes(gzip.compress("\n".join(LINES).encode()))
    else:
        path = folder / "eve.json"
        path.write_text("\n".join(LINES))
    return str(path)


def test_line_counts(spark, log):
    counts = event_log.line_counts(event_log.read_lines(spark, log)).first()
    assert counts.asDict() == {"total_lines": 10, "empty_lines": 2, "malformed_lines": 3, "decoded_events": 5}


def test_malformed_are_kept_with_their_file(spark, log):
    rows = event_log.malformed_lines(event_log.parse_lines(event_log.read_lines(spark, log))).collect()
    assert {r["value"] for r in rows} == {"{broken", "[1,2]", '"text"'}
    assert all("eve.json" in r["source_file"] for r in rows)


def test_wrong_types_do_not_lose_the_event(spark, log):
    rows = {int(r["flow_id"]): r for r in event_log.read_event_log(spark, log, partitions=3).collect()}
    assert sorted(rows) == [1, 2, 3, 4, 5]
    assert rows[2]["alert"] is None and rows[2]["src_port"] == "x"
    assert rows[3]["alert"]["empty"] is True and rows[3]["flow"]["bytes_toserver"] == "12.9"
    assert rows[4]["alert"]["severity"] == "2" and rows[4]["flow"] is None and rows[4]["http"]["status"] == "404"
    assert rows[5]["tls"]["ja3"]["hash"] == "h" and rows[5]["tls"]["ja3s"] is None
    assert rows[1]["ts"].isoformat() == "2024-01-06T10:05:00"


def test_flatten(spark, log):
    flat = event_log.flatten_one_level(event_log.read_event_log(spark, log))
    assert {"flow.age", "alert.severity", "tls.ja3"} <= set(flat.columns)
    assert flat.where(F.col("`http.status`") == "404").count() == 1


def test_required_keys(spark, log):
    parsed = event_log.parse_lines(event_log.read_lines(spark, log))
    rows = {r["key"]: (r["rows"], r["missing"]) for r in quality.required_keys(parsed, ["flow_id", "alert", "nope"]).collect()}
    assert rows == {"flow_id": (5, False), "alert": (3, False), "nope": (0, True)}
    counts = {r["key"]: r["rows"] for r in event_log.key_counts(parsed).collect()}
    assert counts["timestamp"] == 5 and counts["extra"] == 1


EVENTS = [
    ("proto", "TLS", "flow", "1", "2", {"tls": "app_proto"}),
    ("type", None, "tls", "1", "2", {"tls": "event_type"}),
    ("src", None, "flow", "443", "2", {"tls": "port_fallback"}),
    ("dest", "failed", "flow", "1", "8443", {"tls": "port_fallback"}),
    ("two", "http", "dns", "22", "443", {"http": "app_proto", "dns": "event_type", "ssh": "port_fallback", "tls": "port_fallback"}),
    ("none", "", "stats", "x", None, {}),
]


@pytest.fixture(scope="module")
def events(spark):
    rows = [(name, proto, kind, src, dest) for name, proto, kind, src, dest, _ in EVENTS]
    return spark.createDataFrame(rows, "row_id string, app_proto string, event_type string, src_port string, dest_port string")


def test_routing(events):
    got = {}
    for r in routing.route(events).collect():
        got.setdefault(r["row_id"], {})[r["app"]] = r["reason"]
    assert got == {name: want for name, *_, want in EVENTS if want}


def test_matched_ports(events):
    rows = {r["row_id"]: (r["reason"], r["matched_ports"]) for r in routing.match_app(events, "tls").collect()}
    assert rows["src"] == ("port_fallback", [443]) and rows["proto"] == ("app_proto", []) and rows["none"] == ("unmatched", [])
    assert {r["row_id"] for r in routing.app_events(events, "tls").collect()} == {"proto", "type", "src", "dest", "two"}


def test_ports_file(spark):
    def read(text):
        return routing.read_ports(spark.createDataFrame([(line,) for line in text.split("\n")], "value string"))

    text = "# c\n\ndns=53\nhttp=80, 8080\ntls=443\nssh=22"
    assert read(text)["http"] == (80, 8080)
    for bad in ("dns=53", text + "\nftp=21", text.replace("22", "70000"), text.replace("=22", "="), text + "\nnothing"):
        with pytest.raises(ValueError):
            read(bad)


def test_schema_registry():
    assert schemas.supported_datasets() == ["flow_table", "event_log"]
    assert schemas.get_schema("nope") is None
    assert len(schemas.FLOW_SCHEMA.fields) == 88
    assert schemas.get_schema("event_log").keys == schemas.EVENT_REQUIRED_KEYS


def test_flow_csv(spark, tmp_path):
    from flowsieve.sources.flow_table import detect_encoding, read_flow_csv

    path = tmp_path / "flows.csv"
    path.write_bytes("uid, flow_duration ,originp,Label,note\nä,inf,80,1,a\nb,2.5,,0,–\n".encode("cp1252"))
    assert detect_encoding(spark, str(path)) == "windows-1252"
    rows = read_flow_csv(spark, str(path)).collect()
    assert [tuple(r) for r in rows] == [("ä", None, 80, 1, "a"), ("b", 2.5, None, 0, "–")]
    plain = tmp_path / "plain.csv"
    plain.write_text("uid,Label\nä,1\n", encoding="utf-8")
    assert detect_encoding(spark, str(plain)) == "UTF-8"
    assert read_flow_csv(spark, str(plain)).first()["uid"] == "ä"
