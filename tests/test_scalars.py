"""Literal cases for casts, times, addresses, ports, hashes and buckets."""

import hashlib
import ipaddress
import math

import pytest
from pyspark.sql import functions as F

from flowsieve.functions import buckets, labels, network
from flowsieve.functions.hashing import hash60, stable_hash, unit_interval
from flowsieve.functions.scalars import (
    boolish_to_double,
    clean_double,
    iso_utc,
    lenient_double,
    lenient_int,
    parse_timestamp,
    safe_divide,
    weekday_monday0,
    window_floor,
)


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_lenient_int(spark):
    values = ["12.7", "-3.9", "", " ", None, "x", "1d", "0x10", "nan", "inf", "443", "1e3", "1e300"]
    assert column(spark, values, lenient_int) == [12, -3, 0, 0, 0, 0, 0, 0, 0, 0, 443, 1000, 0]
    assert column(spark, ["x", "5"], lambda c: lenient_int(c, None)) == [None, 5]


def test_lenient_double(spark):
    assert column(spark, ["1.5", "inf", "-inf", "nan", "2f", None], lenient_double) == [1.5, 0, 0, 0, 0, 0]


def test_clean_double(spark):
    values = [1.0, float("nan"), float("inf"), float("-inf"), None]
    assert column(spark, values, clean_double, "double") == [1.0, 0.0, 0.0, 0.0, 0.0]


def test_safe_divide(spark):
    assert column(spark, [2.0, 0.0, None], lambda c: safe_divide(F.lit(1.0), c, -1.0), "double") == [0.5, -1.0, -1.0]


def test_boolean_words(spark):
    assert column(spark, [" Yes", "FALSE", "y", "n", "2.5", "zz", "inf", None], boolish_to_double) == [1, 0, 1, 0, 2.5, 0, 0, 0]


def test_timestamps(spark):
    values = [
        "2024-01-06T10:04:59Z",
        "2024-01-06T10:05:00+00:00",
        "2024-01-06T10:05:00+0000",
        "2024-01-06T17:05:00.250000+07:00",
        "2024-01-06T10:05:00",
        "not a time",
        "",
        None,
    ]
    at = "2024-01-06T10:05:00Z"
    assert column(spark, values, lambda c: iso_utc(parse_timestamp(c))) == ["2024-01-06T10:04:59Z", at, at, at, at, None, None, None]
    floor = lambda c: iso_utc(window_floor(parse_timestamp(c), 5))
    assert column(spark, values[:2], floor) == ["2024-01-06T10:00:00Z", at]
    # A Saturday.
    assert column(spark, values[:1], lambda c: weekday_monday0(parse_timestamp(c))) == [5]


def test_ports(spark):
    ports = ["0", "1", "1023", "1024", "49151", "49152", "x", None]
    assert column(spark, ports, network.port_class) == [0, 1, 1, 2, 2, 3, 0, 0]
    assert column(spark, ["53", "443", None], lambda c: network.port_in(c, network.TLS_PORTS)) == [0, 1, 0]


ADDRESSES = [
    "10.0.0.1",
    "172.15.255.255",
    "172.16.0.0",
    "172.31.255.255",
    "172.32.0.0",
    "192.168.4.4",
    "127.0.0.1",
    "169.254.1.1",
    "192.0.0.1",
    "192.0.0.9",
    "192.0.0.10",
    "192.0.2.5",
    "198.18.0.1",
    "198.20.0.1",
    "203.0.113.9",
    "240.0.0.1",
    "255.255.255.255",
    "100.64.0.1",
    "8.8.8.8",
    "::1",
    "fe80::1",
    "01.2.3.4",
    "1.2.3",
    "1.2.3.4.5",
    "256.0.0.1",
    "junk",
    "",
]


def python_private(text):
    try:
        address = ipaddress.ip_address(text)
    except ValueError:
        return 0
    return int(address.version == 4 and address.is_private)


def test_private_addresses(spark):
    assert column(spark, ADDRESSES, network.is_private) == [python_private(a) for a in ADDRESSES]
    rfc = [1, 0, 1, 1, 0, 1] + [0] * (len(ADDRESSES) - 6)
    assert column(spark, ADDRESSES, network.is_rfc1918) == rfc


def test_subnets(spark):
    assert column(spark, ["1.2.3.4", "1.2.3", "1.2", "::1", None], network.subnet24) == ["1.2.3", "1.2.3", "0.0.0", "0.0.0", "0.0.0"]


def python_hash(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def test_hashes(spark):
    assert column(spark, ["tcp", "", "é", None], hash60) == [python_hash(t) for t in ("tcp", "", "é", "unknown")]
    assert column(spark, ["tcp"], lambda c: stable_hash(c, 1_000_000)) == [422327]
    assert column(spark, ["a"], lambda c: unit_interval(7, c)) == [python_hash("7:a") % 1_000_000 / 1e6]


def test_buckets(spark):
    values = [-1.0, 0.0, 1.0, 1.1, 10.0, 1e6, 1e6 + 1, float("nan")]
    assert column(spark, values, buckets.numeric_bucket, "double") == ["0", "0", "0-1", "1-10", "1-10", "100K-1M", ">1M", "0"]
    assert column(spark, [0.0, 0.24, 0.25, 0.5, 0.99, 1.0], buckets.ratio_bucket, "double") == [
        "0",
        "0-0.25",
        "0.25-0.50",
        "0.50-0.75",
        "0.75-1.00",
        ">=1.00",
    ]


def test_normalize_app(spark):
    assert column(spark, [" HTTP/2 ", "a--b..c", "__x__", None, "tls"], labels.normalize_app) == ["http_2", "a_b_c", "x", "", "tls"]


ALERTS = [
    (None, "alert"),
    (("0", "Recon", "s", "1", False), "flow"),
    (("2", "Recon", "s", "1", False), "flow"),
    ((None, "Recon", "s", "1", False), "flow"),
    (("", "Recon", "s", "1", False), "alert"),
    (("3", " Generic Protocol DECODE", "s", "1", False), "flow"),
    (("3", None, "s", "1", False), "ALERT "),
    ((None, None, None, None, True), "flow"),
]


@pytest.fixture(scope="module")
def alerts(spark):
    schema = "i int, alert struct<severity:string,category:string,signature:string,signature_id:string,empty:boolean>, event_type string"
    return spark.createDataFrame([(i, a, t) for i, (a, t) in enumerate(ALERTS)], schema)


def test_alert_rules(alerts):
    a, t = F.col("alert"), F.col("event_type")
    rows = alerts.orderBy("i").select(
        labels.alert_present(a),
        labels.alert_strict(a),
        labels.base_positive(t, a),
        labels.base_label("alert_object", t, a),
        labels.has_nonempty_alert(a),
    ).collect()
    present, strict, positive, objects, nonempty = (list(x) for x in zip(*rows))
    # A severity of 0 counts when routing and does not count later.
    assert present == [False, True, True, False, False, False, True, False]
    assert strict == [False, False, True, False, False, False, True, False]
    assert positive == [True, False, True, False, True, False, True, False]
    assert objects == [0, 1, 1, 1, 1, 1, 1, 1]
    assert nonempty == [False, True, True, True, True, True, True, False]


def test_label_mode_is_checked():
    with pytest.raises(ValueError):
        labels.base_label("other", F.lit("x"), F.lit(None))


def test_log_is_never_negative(spark):
    from flowsieve.operators.features import _log

    assert column(spark, [-5.0, 0.0, 1.0], _log, "double") == [0.0, 0.0, math.log(2.0)]
