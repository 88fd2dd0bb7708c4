"""Views of the driver's tables in the shapes the operators work on.

No sensor log ships with the test data, so the catalogue reads the ``events`` table as an
event log, ``lineitem`` as a flow-feature table, ``orders`` as a run history and
``labels``/``documents`` as scored predictions.  Each mapping is a list of expressions valid
both in Spark SQL and in the checking engine, so both start from the same rows.  All rows
of every table take part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.session import prepare, scratch_path

# (name, expression) over the events table with ``k`` already taken out of ``props``.
EVENT_COLUMNS = (
    ("row_id", "event_id"),
    ("ts", "CASE WHEN k = 97 THEN NULL ELSE ts END"),
    (
        "event_type",
        "CASE event_type WHEN 'error' THEN 'alert' WHEN 'view' THEN 'tls' "
        "WHEN 'click' THEN 'http' WHEN 'signup' THEN 'dns' ELSE 'flow' END",
    ),
    (
        "app_proto",
        "CASE k % 6 WHEN 0 THEN 'TLS' WHEN 1 THEN 'http' WHEN 2 THEN 'dns' WHEN 3 THEN 'ssh' "
        "WHEN 4 THEN 'failed' END",
    ),
    ("proto", "CASE user_id % 3 WHEN 0 THEN 'TCP' WHEN 1 THEN 'UDP' ELSE 'ICMP' END"),
    (
        "src_ip",
        "CASE WHEN k = 98 THEN '' ELSE CASE WHEN user_id % 5 = 0 THEN '45.33.' ELSE '10.0.' END "
        "|| CAST(user_id % 7 AS STRING) || '.' || CAST(user_id % 251 AS STRING) END",
    ),
    (
        "dest_ip",
        "CASE WHEN k = 99 THEN '' WHEN k % 3 = 0 THEN '192.168.' || CAST(k % 4 AS STRING) || '.' || "
        "CAST(event_id % 11 AS STRING) WHEN k % 3 = 1 THEN '10.0.' || CAST(user_id % 7 AS STRING) || '.' || "
        "CAST(k AS STRING) ELSE '93.184.' || CAST(k AS STRING) || '.' || CAST(event_id % 5 AS STRING) END",
    ),
    ("src_port", "CAST(1000 + (event_id * 7) % 60000 AS BIGINT)"),
    (
        "dest_port",
        "CAST(CASE k % 10 WHEN 0 THEN 443 WHEN 1 THEN 53 WHEN 2 THEN 80 WHEN 3 THEN 22 WHEN 4 THEN 8080 "
        "WHEN 5 THEN 8443 WHEN 6 THEN 0 ELSE 20000 + k * 300 END AS BIGINT)",
    ),
    ("pkts_toserver", "CAST(k AS BIGINT)"),
    ("pkts_toclient", "CAST(event_id % 13 AS BIGINT)"),
    ("bytes_toserver", "CAST(floor(value * 100 + 0.5) AS BIGINT)"),
    ("bytes_toclient", "CAST((k * event_id) % 1000 AS BIGINT)"),
    ("age", "CASE WHEN k % 7 = 0 THEN CAST(0 AS DOUBLE) ELSE value / CAST(10 AS DOUBLE) END"),
    ("alert_there", "(event_type = 'error' AND k % 8 <> 7) OR (event_type = 'view' AND k % 16 = 3)"),
    ("alert_severity", "CASE WHEN k % 5 = 0 THEN NULL ELSE CAST(k % 5 - 1 AS STRING) END"),
    (
        "alert_category",
        "CASE k % 4 WHEN 0 THEN 'Generic Protocol Command Decode' WHEN 1 THEN 'Attempted Recon' "
        "WHEN 2 THEN 'Misc Attack' ELSE 'generic protocol decode ' END",
    ),
    ("alert_signature", "'SIG ' || CAST(k % 60 AS STRING)"),
    ("alert_signature_id", "CAST(2000000 + k % 60 AS STRING)"),
    ("http_method", "CASE k % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'HEAD' END"),
    ("http_hostname", "'host' || CAST(k AS STRING) || '.example.com'"),
    ("http_url", "'/p/' || CAST(event_id AS STRING)"),
    ("http_user_agent", "CASE WHEN k % 4 = 0 THEN NULL ELSE 'agent/' || CAST(k AS STRING) END"),
    ("http_status", "CAST(200 + (k % 4) * 100 AS STRING)"),
    ("tls_sni", "CASE WHEN k % 5 = 0 THEN NULL ELSE 'srv' || CAST(k AS STRING) || '.example.org' END"),
    ("tls_version", "CASE k % 2 WHEN 0 THEN 'TLS 1.2' ELSE 'TLSv1.3' END"),
    ("tls_ja3", "CASE WHEN k % 4 = 0 THEN NULL ELSE md5(CAST(k AS STRING)) END"),
    ("tls_ja3s", "CASE WHEN k % 4 = 1 THEN NULL ELSE md5(CAST(user_id AS STRING)) END"),
    ("dns_rrname", "CASE WHEN k % 7 = 1 THEN NULL ELSE 'q' || CAST(k AS STRING) || '.example.net' END"),
    ("dns_rrtype", "CASE k % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'AAAA' ELSE 'TXT' END"),
    ("dns_rcode", "CASE WHEN k % 5 = 2 THEN 'NXDOMAIN' ELSE 'NOERROR' END"),
    ("dns_type", "CASE k % 2 WHEN 0 THEN 'query' ELSE 'answer' END"),
    ("ssh_client", "CASE WHEN k % 4 = 2 THEN NULL ELSE 'client_' || CAST(k AS STRING) END"),
    ("ssh_server", "CASE WHEN k % 4 = 3 THEN NULL ELSE 'server_' || CAST(user_id AS STRING) END"),
    ("ssh_protocol", "CASE k % 2 WHEN 0 THEN '2.0' ELSE '1.99' END"),
)

_EVENT_BASE = "SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events"


def event_cte() -> str:
    """``ev AS (...)`` for the checking engine."""
    columns = ", ".join(f"{expression} AS {name}" for name, expression in EVENT_COLUMNS)
    return f"ev AS (SELECT {columns} FROM ({_EVENT_BASE}) AS raw_events)"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table, with zone-less timestamps read as UTC instants."""
    df = prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    casts = {
        field.name: F.col(field.name).cast("timestamp")
        for field in df.schema.fields
        if field.dataType.typeName() == "timestamp_ntz"
    }
    return df.withColumns(casts) if casts else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash a table that arrives in fewer splits than there are cores over all of them.

    The test files have one row group each, so every scan is one task.  A table with enough
    splits is returned unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)


def flat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spread(read_table(spark, sf_dir, "events"), "event_id").withColumn(
        "k", F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    )
    return raw.selectExpr(*[f"{expression} AS {name}" for name, expression in EVENT_COLUMNS])


def _struct(fields: dict[str, str]) -> F.Column:
    return F.struct(*[F.col(source).alias(name) for name, source in fields.items()])


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as typed event records, as the log reader would return them."""
    flat = flat_events(spark, sf_dir)
    app = F.lower(F.coalesce("app_proto", F.lit("")))

    def of_app(name: str, body: F.Column) -> F.Column:
        return F.when((app == name) | (F.col("event_type") == name), body)

    return flat.select(
        "row_id",
        "ts",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxx").alias("timestamp"),
        "event_type",
        "app_proto",
        "proto",
        "src_ip",
        "dest_ip",
        "src_port",
        "dest_port",
        _struct(
            {n: n for n in ("pkts_toserver", "pkts_toclient", "bytes_toserver", "bytes_toclient", "age")}
        ).alias("flow"),
        F.when(
            F.col("alert_there"),
            F.struct(
                F.col("alert_severity").alias("severity"),
                F.col("alert_category").alias("category"),
                F.col("alert_signature").alias("signature"),
                F.col("alert_signature_id").alias("signature_id"),
                F.lit(False).alias("empty"),
            ),
        ).alias("alert"),
        of_app(
            "http",
            _struct(
                {
                    "http_method": "http_method",
                    "hostname": "http_hostname",
                    "url": "http_url",
                    "http_user_agent": "http_user_agent",
                    "status": "http_status",
                }
            ),
        ).alias("http"),
        of_app(
            "tls",
            F.struct(
                F.col("tls_sni").alias("sni"),
                F.col("tls_version").alias("version"),
                F.struct(F.col("tls_ja3").alias("hash")).alias("ja3"),
                F.struct(F.col("tls_ja3s").alias("hash")).alias("ja3s"),
            ),
        ).alias("tls"),
        of_app(
            "dns",
            _struct({"rrname": "dns_rrname", "rrtype": "dns_rrtype", "rcode": "dns_rcode", "type": "dns_type"}),
        ).alias("dns"),
        of_app(
            "ssh",
            F.struct(
                F.struct(F.col("ssh_client").alias("software_version")).alias("client"),
                F.struct(F.col("ssh_server").alias("software_version")).alias("server"),
                F.col("ssh_protocol").alias("protocol"),
            ),
        ).alias("ssh"),
    )


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records as JSON text, one per row, with some lines cut short.

    Lines of records with ``k = 13`` lose their last five characters, so they are not valid
    JSON; lines with ``k = 14`` are arrays, valid JSON but not objects; lines with ``k = 15``
    are followed by a blank line once written to a file.
    """
    records = event_records(spark, sf_dir)
    k = F.col("flow.pkts_toserver")
    body = F.to_json(
        F.struct(
            "timestamp",
            F.col("row_id").alias("flow_id"),
            "event_type",
            "app_proto",
            "src_ip",
            "src_port",
            "dest_ip",
            "dest_port",
            "proto",
            "flow",
            F.col("alert").dropFields("empty").alias("alert"),
            "http",
            "tls",
            "dns",
            "ssh",
        )
    )
    return records.select(
        F.when(k == 13, body.substr(F.lit(1), F.length(body) - 5))
        .when(k == 14, F.concat(F.lit("["), body, F.lit("]")))
        .when(k == 15, F.concat(body, F.lit("\n   ")))
        .otherwise(body)
        .alias("value")
    )


def write_event_lines(spark: SparkSession, sf_dir: str, compression: str = "none") -> str:
    """The lines as text files in the shared folder; returns their path."""
    path = scratch_path(spark, "event-log")
    event_lines(spark, sf_dir).write.option("compression", compression).text(path)
    return path


# Numeric features, label and unique key of the flow stand-in.
FLOW_FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "price_per_unit", "ship_month")
FLOW_COLUMNS = (
    (
        "row_key",
        "CAST(l_orderkey AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) || '-' || "
        "CAST(l_linenumber AS STRING) || '-' || CAST(CAST(l_quantity AS BIGINT) AS STRING) || '-' || "
        "CAST(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS STRING)",
    ),
    ("l_quantity", "l_quantity"),
    ("l_extendedprice", "l_extendedprice"),
    ("l_discount", "l_discount"),
    ("l_tax", "l_tax"),
    ("l_linenumber", "CAST(l_linenumber AS DOUBLE)"),
    ("price_per_unit", "l_extendedprice / l_quantity"),
    ("ship_month", "CAST(month(l_shipdate) AS DOUBLE)"),
    ("l_returnflag", "l_returnflag"),
    ("l_linestatus", "l_linestatus"),
    ("l_shipdate", "l_shipdate"),
    ("Label", "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END"),
)


def flow_cte() -> str:
    columns = ", ".join(f"{expression} AS {name}" for name, expression in FLOW_COLUMNS)
    return f"fl AS (SELECT {columns} FROM lineitem)"


def flow_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spread(read_table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")
    return raw.selectExpr(*[f"{expression} AS {name}" for name, expression in FLOW_COLUMNS])


# Scored predictions: documents are rows, ``toxic`` is the truth, text length the score.
PREDICTION_COLUMNS = (
    ("row_id", "d.doc_id"),
    ("label", "l.toxic"),
    ("score", "CAST(d.n_chars % 997 AS DOUBLE) / CAST(997 AS DOUBLE)"),
    ("prediction", "CASE WHEN d.n_chars % 997 >= 500 THEN 1 ELSE 0 END"),
)


def prediction_cte() -> str:
    columns = ", ".join(f"{expression} AS {name}" for name, expression in PREDICTION_COLUMNS)
    return f"pr AS (SELECT {columns} FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


def prediction_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "n_chars").alias("d")
    labels = read_table(spark, sf_dir, "labels").alias("l")
    joined = documents.join(labels, F.col("d.doc_id") == F.col("l.doc_id"))
    return joined.selectExpr(*[f"{expression} AS {name}" for name, expression in PREDICTION_COLUMNS])


# Run history: an order is a run, its customer the owner, its priority the method.
RUN_COLUMNS = (
    ("id", "'run-' || CAST(o_orderkey AS STRING)"),
    ("dataset_type", "CASE WHEN o_custkey % 2 = 0 THEN 'flow_table' ELSE 'event_log' END"),
    ("dataset_hash", "md5(CAST(o_custkey % 10 AS STRING))"),
    ("pipeline_id", "CASE o_orderpriority WHEN '1-URGENT' THEN 'flow.forest' WHEN '2-HIGH' THEN 'flow.tree' "
     "WHEN '3-MEDIUM' THEN 'flow.knn' WHEN '4-NOT SPECIFIED' THEN 'event.forest' ELSE 'event.boosted' END"),
    ("status", "CASE o_orderstatus WHEN 'F' THEN 'FINISHED' WHEN 'O' THEN 'RUNNING' ELSE 'QUEUED' END"),
    ("created_at", "o_orderdate"),
    ("owner", "CASE WHEN o_custkey % 7 = 0 THEN NULL WHEN o_custkey % 7 = 1 THEN '' "
     "ELSE 'user' || CAST(o_custkey % 50 AS STRING) END"),
    ("run_mode", "CASE WHEN o_custkey % 3 = 0 THEN NULL WHEN o_custkey % 3 = 1 THEN 'official' ELSE 'exploration' END"),
    ("accuracy", "CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE round(o_totalprice / 500000, 4) END"),
    ("f1", "CASE WHEN o_custkey % 13 = 0 THEN NULL ELSE round(o_totalprice / 600000, 4) END"),
    ("auc", "CASE WHEN o_custkey % 17 = 0 THEN NULL ELSE round(o_totalprice / 550000, 4) END"),
    ("n_estimators", "CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE CAST(o_custkey % 4 * 100 AS STRING) END"),
    ("duration_seconds", "CAST(o_orderkey % 4000 AS BIGINT)"),
)


def run_cte() -> str:
    columns = ", ".join(f"{expression} AS {name}" for name, expression in RUN_COLUMNS)
    return f"runs AS (SELECT {columns} FROM orders)"


def run_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spread(read_table(spark, sf_dir, "orders"), "o_orderkey")
    return raw.selectExpr(*[f"{expression} AS {name}" for name, expression in RUN_COLUMNS])
