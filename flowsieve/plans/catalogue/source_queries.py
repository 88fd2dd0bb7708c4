"""Readers and writers, checked by a round trip through the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve.functions.hashing import unit_interval
from flowsieve.functions.scalars import iso_utc, lenient_int
from flowsieve.operators import change_tree
from flowsieve.operators.evaluation import confusion_counts
from flowsieve.plans.catalogue import Query
from flowsieve.plans.stand_in import (
    event_cte,
    flow_cte,
    flow_table,
    prediction_cte,
    prediction_table,
    read_table,
    write_event_lines,
)
from flowsieve.session import scratch_path
from flowsieve.sources import event_log, flow_table as flow_source, tables

_CSV_SCHEMA = T.StructType(
    [
        T.StructField("row_key", T.StringType()),
        T.StructField("l_quantity", T.DoubleType()),
        T.StructField("rate", T.DoubleType()),
        T.StructField("Label", T.IntegerType()),
    ]
)


def _csv_scan(spark, sf_dir):
    rate = F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(F.col("l_tax") / F.col("l_discount"))
    path = scratch_path(spark, "flow-csv")
    flow_table(spark, sf_dir).select("row_key", F.col("l_quantity").alias(" l_quantity "), rate.alias(" rate"), "Label").write.option(
        "header", True
    ).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    df = flow_source.read_flow_csv(spark, path, _CSV_SCHEMA)
    return df.withColumn("rate", F.round("rate", 9))


def _log_scan(spark, sf_dir):
    events = event_log.read_event_log(spark, write_event_lines(spark, sf_dir, "gzip"), partitions=8)
    return events.select(
        lenient_int("flow_id").alias("row_id"),
        "event_type",
        "src_ip",
        lenient_int("src_port").alias("src_port"),
        iso_utc(F.col("ts")).alias("ts"),
        F.col("alert.severity").alias("alert_severity"),
        F.col("alert.signature_id").alias("alert_signature_id"),
        lenient_int("flow.bytes_toserver").alias("bytes_toserver"),
        F.col("tls.ja3.hash").alias("tls_ja3"),
        F.col("alert").isNotNull().alias("alert_there"),
    )


def _line_counts(spark, sf_dir):
    return event_log.line_counts(event_log.read_lines(spark, write_event_lines(spark, sf_dir)))


def _quarantine(spark, sf_dir):
    parsed = event_log.parse_lines(event_log.read_lines(spark, write_event_lines(spark, sf_dir)))
    path = scratch_path(spark, "malformed")
    tables.write_malformed(event_log.malformed_lines(parsed), path)
    kept = spark.read.parquet(path)
    return kept.groupBy(F.substring("value", 1, 1).alias("starts_with")).agg(F.count(F.lit(1)).alias("rows"))


def _flatten(spark, sf_dir):
    flat = event_log.flatten_one_level(event_log.read_event_log(spark, write_event_lines(spark, sf_dir)))
    return flat.select(
        lenient_int("flow_id").alias("row_id"),
        F.col("`flow.pkts_toserver`").cast("bigint").alias("flow_pkts_toserver"),
        F.col("`dns.rcode`").alias("dns_rcode"),
        F.col("`ssh.protocol`").alias("ssh_protocol"),
    )


def _encoding(spark, sf_dir):
    path = scratch_path(spark, "cp1252")
    documents = read_table(spark, sf_dir, "documents")
    # Byte 0x96 is an en dash in windows-1252 and a control character in ISO-8859-1.
    documents.select("doc_id", F.concat(F.lit("é\x96"), "lang", F.lit("ß"), "source").alias("tag")).write.option(
        "header", True
    ).option("encoding", "ISO-8859-1").csv(path)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("tag", T.StringType())])
    return flow_source.read_flow_csv(spark, path, schema)


def _split_rows(spark, sf_dir):
    rows = flow_table(spark, sf_dir)
    return rows.withColumn("split", F.when(unit_interval(7, F.col("row_key")) < 0.8, "train").otherwise("test"))


def _pruned(spark, sf_dir):
    path = scratch_path(spark, "pruned")
    tables.export_split(_split_rows(spark, sf_dir), path)
    df = tables.read_columns(spark, path, ["row_key", "l_quantity", "Label"], split="train")
    return df.groupBy("Label").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


def _export(spark, sf_dir):
    rows = _split_rows(spark, sf_dir).select("row_key", "l_quantity", "Label", "split")
    parts = []
    for fmt, compression in (("parquet", None), ("csv", "gzip"), ("json", "gzip")):
        path = scratch_path(spark, f"export-{fmt}")
        tables.export_split(rows, path, fmt=fmt, compression=compression, max_records_per_file=20_000)
        reader = spark.read.schema(rows.schema)
        if fmt == "csv":
            reader = reader.option("header", True)
        back = reader.format(fmt).load(path)
        parts.append(
            back.groupBy(F.lit(fmt).alias("fmt"), "split").agg(
                F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity")
            )
        )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _append(spark, sf_dir):
    path = scratch_path(spark, "append")
    rows = flow_table(spark, sf_dir).select("row_key", "Label")
    tables.append_rows(rows, path)
    tables.append_rows(rows.where(F.col("Label") == 1), path)
    return spark.read.parquet(path).groupBy("Label").agg(F.count(F.lit(1)).alias("rows"))


def _fingerprint(spark, sf_dir):
    out = tables.portable_fingerprint(flow_table(spark, sf_dir), F.col("row_key"))
    return out.withColumn("hash_sum", F.col("hash_sum").cast("string"))


def _fingerprint_native(spark, sf_dir):
    return tables.fingerprint(read_table(spark, sf_dir, "lineitem"))


def _run_tables(spark, sf_dir):
    base = scratch_path(spark, "run-tables")
    confusion = confusion_counts(prediction_table(spark, sf_dir), "label", "prediction")
    written = tables.save_run("run-1", base, confusion=confusion)
    return spark.read.parquet(written["confusion"])


_SPLIT = "CASE WHEN ((('0x' || substr(md5('7:' || row_key), 1, 15))::BIGINT) % 1000000) / 1000000.0 < 0.8 THEN 'train' ELSE 'test' END"

# The second version of the orders: some gone, some dearer, some new.
_GONE, _DEARER, _NEW = "o_orderkey % 101 = 0", "o_orderkey % 97 = 1", "o_orderkey % 103 = 2"
_FIRST_NEW_KEY = 10_000_000


def _versions(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    price = F.when(F.expr(_DEARER), F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    later = orders.where(f"NOT ({_GONE})").withColumn("o_totalprice", price)
    later = later.unionByName(orders.where(_NEW).withColumn("o_orderkey", F.col("o_orderkey") + _FIRST_NEW_KEY))
    before, after = scratch_path(spark, "version"), scratch_path(spark, "version")
    change_tree.write_version(orders, before, "o_orderkey")
    change_tree.write_version(later, after, "o_orderkey")
    return before, after


def _changed_cells(spark, sf_dir):
    return change_tree.changed_cells(spark, *_versions(spark, sf_dir))


def _changed_keys(spark, sf_dir):
    return change_tree.changed_keys(spark, *_versions(spark, sf_dir), "o_orderkey")


_VERSIONS = (
    f"WITH a AS (SELECT o_orderkey AS k, o_totalprice AS p FROM orders), b AS (SELECT o_orderkey AS k, CASE WHEN {_DEARER} THEN o_totalprice + 1 ELSE o_totalprice END AS p "
    f"FROM orders WHERE NOT ({_GONE}) UNION ALL SELECT o_orderkey + {_FIRST_NEW_KEY}, o_totalprice FROM orders WHERE {_NEW}), "
    "j AS (SELECT coalesce(a.k, b.k) AS k, a.k IS NOT NULL AS old, b.k IS NOT NULL AS new, a.p IS DISTINCT FROM b.p AS other FROM a FULL JOIN b ON a.k = b.k), "
    f"c AS (SELECT ('0x' || substr(md5(k::VARCHAR), 1, 15))::BIGINT >> {60 - change_tree.BITS * change_tree.LEVELS} AS cell, count(*) FILTER (old) AS rows_before, count(*) FILTER (new) AS rows_after "
    "FROM j GROUP BY 1 HAVING bool_or(other OR NOT old OR NOT new)) "
)


QUERIES = [
    Query(
        "a1_flow_csv_scan",
        _csv_scan,
        f"WITH {flow_cte()} SELECT row_key, l_quantity, CASE WHEN l_discount = 0 THEN NULL "
        "ELSE round(l_tax / l_discount, 9) END AS rate, Label FROM fl",
    ),
    Query(
        "a2_event_log_scan",
        _log_scan,
        f"WITH {event_cte()} SELECT row_id, event_type, src_ip, src_port, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts, "
        "CASE WHEN alert_there THEN alert_severity END AS alert_severity, "
        "CASE WHEN alert_there THEN alert_signature_id END AS alert_signature_id, bytes_toserver, "
        "CASE WHEN lower(app_proto) = 'tls' OR event_type = 'tls' THEN tls_ja3 END AS tls_ja3, alert_there "
        "FROM ev WHERE pkts_toserver NOT IN (13, 14)",
    ),
    Query(
        "a2_line_counts",
        _line_counts,
        f"WITH {event_cte()} SELECT count(*) + count(*) FILTER (pkts_toserver = 15) AS total_lines, "
        "count(*) FILTER (pkts_toserver = 15) AS empty_lines, count(*) FILTER (pkts_toserver IN (13, 14)) AS "
        "malformed_lines, count(*) FILTER (pkts_toserver NOT IN (13, 14)) AS decoded_events FROM ev",
    ),
    Query(
        "a3_malformed_quarantine",
        _quarantine,
        f"WITH {event_cte()} SELECT CASE WHEN pkts_toserver = 13 THEN '{{' ELSE '[' END AS starts_with, count(*) AS rows "
        "FROM ev WHERE pkts_toserver IN (13, 14) GROUP BY 1",
    ),
    Query(
        "a4_flatten_one_level",
        _flatten,
        f"WITH {event_cte()} SELECT row_id, pkts_toserver AS flow_pkts_toserver, "
        "CASE WHEN lower(app_proto) = 'dns' OR event_type = 'dns' THEN dns_rcode END AS dns_rcode, "
        "CASE WHEN lower(app_proto) = 'ssh' THEN ssh_protocol END AS ssh_protocol FROM ev WHERE pkts_toserver NOT IN (13, 14)",
    ),
    Query(
        "a5_encoding_fallback",
        _encoding,
        "SELECT doc_id, 'é–' || lang || 'ß' || source AS tag FROM documents",
    ),
    Query(
        "a6_pruned_split_scan",
        _pruned,
        f"WITH {flow_cte()} SELECT Label, count(*) AS n, sum(l_quantity) AS quantity FROM fl WHERE {_SPLIT} = 'train' "
        "GROUP BY Label",
    ),
    Query(
        "a7_export_formats",
        _export,
        f"WITH {flow_cte()}, s AS (SELECT *, {_SPLIT} AS split FROM fl), f AS (SELECT unnest(['parquet', 'csv', 'json']) AS fmt) "
        "SELECT fmt, split, count(*) AS n, sum(l_quantity) AS quantity FROM s, f GROUP BY ALL",
    ),
    Query(
        "a8_append_and_count",
        _append,
        f"WITH {flow_cte()} SELECT Label, count(*) * (1 + Label) AS rows FROM fl GROUP BY Label",
    ),
    Query(
        "a9_portable_fingerprint",
        _fingerprint,
        f"WITH {flow_cte()}, h AS (SELECT ('0x' || substr(md5(row_key), 1, 15))::BIGINT AS h FROM fl) "
        "SELECT count(*) AS rows, CAST(sum(h) AS VARCHAR) AS hash_sum, bit_xor(h) AS hash_xor FROM h",
    ),
    Query(
        "a9_changed_cells",
        _changed_cells,
        f"{_VERSIONS} SELECT *, CASE WHEN rows_before = 0 THEN 'added' WHEN rows_after = 0 THEN 'removed' ELSE 'changed' END AS change FROM c",
    ),
    Query(
        "a9_changed_keys",
        _changed_keys,
        f"{_VERSIONS} SELECT k AS o_orderkey, CASE WHEN NOT old THEN 'added' WHEN NOT new THEN 'removed' ELSE 'changed' END AS change FROM j WHERE other OR NOT old OR NOT new",
    ),
    Query("a9_content_fingerprint", _fingerprint_native),
    Query(
        "a10_run_tables",
        _run_tables,
        f"WITH {prediction_cte()}, g AS (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS t(a, p)) "
        "SELECT a AS label, p AS prediction, count(pr.row_id) AS n, 'run-1' AS run_id FROM g "
        "LEFT JOIN pr ON pr.label = a AND pr.prediction = p GROUP BY a, p",
    ),
]
