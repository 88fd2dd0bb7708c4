"""Conformance checks and profiles over whole tables, each from one aggregate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve.functions import labels
from flowsieve.functions.network import TLS_PORTS
from flowsieve.functions.scalars import lenient_int, numeric_or_null
from flowsieve.sources.schemas import DatasetType

PASS, WARN, FAIL, SKIP = "pass", "warn", "fail", "skip"
CHECKS = ("format", "label", "features", "dtype", "classes")


def column_conformance(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Missing columns are errors, extra ones are allowed; decided on names alone."""
    have, want = set(df.columns), set(expected)
    rows = [(c, "missing") for c in sorted(want - have)] + [(c, "extra") for c in sorted(have - want)]
    return df.sparkSession.createDataFrame(rows, "column string, status string")


def required_keys(parsed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Objects that carry each required key, over every parsed line."""
    good = ~F.col("malformed")
    # A key whose value is JSON null still counts as present.
    there = [
        F.count_if(good & F.try_variant_get("v", f"$.{k}", "variant").isNotNull()).alias(k) for k in keys
    ]
    facts = parsed.agg(F.count_if(good).alias("objects"), *there)
    long = facts.unpivot(["objects"], list(keys), "key", "rows")
    return long.select("key", "rows", (F.col("rows") == 0).alias("missing"))


def label_facts(df: DataFrame, label: str) -> DataFrame:
    """Row count per label value, one column read."""
    return df.groupBy(F.col(f"`{label}`").cast("string").alias("label")).agg(F.count(F.lit(1)).alias("rows"))


def label_summary(df: DataFrame, label: str) -> DataFrame:
    """One row per distinct label and one for the whole table, from one aggregate.

    However many labels there are, no task holds them all.
    """
    rows = df.select(F.col(f"`{label}`").cast("string").alias("label")).rollup("label")
    return rows.agg(F.count(F.lit(1)).alias("rows"), (F.grouping("label") == 1).alias("whole_table"))


def diagnose_types(df: DataFrame, datasets: Sequence[DatasetType], **options) -> DataFrame:
    """The checks of every table type; each label column is counted once, not once per type."""
    labels_there = sorted({d.label for d in datasets} & set(df.columns))
    classes = {label: class_range(df, label) for label in labels_there}
    return reduce(DataFrame.unionByName, [diagnose_table(df, d, classes=classes, **options) for d in datasets])


def _tls_row(ports: Sequence[int]) -> F.Column:
    proto, kind = F.lower(F.trim(F.coalesce("app_proto", F.lit("")))), F.lower(F.trim(F.coalesce("event_type", F.lit(""))))
    src, dest = lenient_int(F.col("src_port"), None), lenient_int(F.col("dest_port"), None)
    by_port = F.coalesce(src.isin(*ports), F.lit(False)) | F.coalesce(dest.isin(*ports), F.lit(False))
    return (proto == "tls") | (kind == "tls") | by_port


def event_log_facts(events: DataFrame, tls_ports: Sequence[int] = TLS_PORTS) -> DataFrame:
    """Rows, TLS rows and rows with alert evidence, as the log diagnosis counts them."""
    alert = F.col("alert")
    evidence = labels.is_event_type_alert(F.col("event_type")) | (alert.isNotNull() & alert["severity"].isNotNull())
    return events.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(_tls_row(tls_ports)).alias("tls_rows"),
        F.count_if(evidence).alias("alert_rows"),
    )


def event_type_counts(events: DataFrame) -> DataFrame:
    kind = F.nullif(F.lower(F.trim(F.coalesce("event_type", F.lit("")))), F.lit(""))
    return events.groupBy(kind.alias("event_type")).agg(F.count(F.lit(1)).alias("rows")).where(F.col("event_type").isNotNull())


def non_numeric_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values per column that are present but not numbers; one pass."""
    bad = [
        F.count_if(F.col(f"`{c}`").isNotNull() & numeric_or_null(F.col(f"`{c}`")).isNull()).alias(f"c{i}")
        for i, c in enumerate(columns)
    ]
    return _wide_to_long(df.agg(*bad), columns, "non_numeric_rows", "bigint")


def numeric_ratio(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of rows per column that read as a number, with the three thresholds in use."""
    shares = [
        F.avg(numeric_or_null(F.col(f"`{c}`")).isNotNull().cast("double")).alias(f"c{i}") for i, c in enumerate(columns)
    ]
    long = _wide_to_long(df.agg(*shares), columns, "ratio", "double")
    return long.withColumns(
        {
            "any_numeric": F.col("ratio") > 0,
            "mostly_numeric": F.col("ratio") >= 0.95,
            "numeric": F.col("ratio") >= 0.98,
        }
    )


def _wide_to_long(wide: DataFrame, columns: Sequence[str], value: str, kind: str) -> DataFrame:
    """A one-row aggregate with columns c0..cn as (column, value) rows."""
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(f"c{i}").cast(kind).alias(value))
            for i, c in enumerate(columns)
        ]
    )
    return wide.select(F.explode(pairs).alias("x")).select("x.column", f"x.{value}")


def initial_counts(routed: DataFrame, malicious: F.Column) -> DataFrame:
    """Benign and attack rows per application with percentages of the application."""
    grouped = (
        routed.select("app", malicious.cast("int").alias("bad"))
        .groupBy("app")
        .agg(F.count(F.lit(1)).alias("total"), F.sum("bad").alias("attack"))
    )
    benign = F.col("total") - F.col("attack")
    return grouped.select(
        "app",
        "total",
        benign.alias("benign"),
        "attack",
        (benign * 100.0 / F.col("total")).alias("benign_ratio_percent"),
        (F.col("attack") * 100.0 / F.col("total")).alias("attack_ratio_percent"),
    )


def label_share(df: DataFrame, group: str, label: str) -> DataFrame:
    """Rows per (group, label) and their share of the group; the window sees counts only."""
    counts = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("rows"))
    return counts.withColumn("share", F.col("rows") / F.sum("rows").over(Window.partitionBy(group)))


def _status_rows(spark, dataset: str, checks: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame(
        [(dataset, name, status, int(count), examples) for name, status, count, examples in checks],
        "dataset_type string, check string, status string, count bigint, examples string",
    )


def _listed(values) -> str:
    return ",".join(str(v) for v in values)


def class_range(df: DataFrame, label: str) -> tuple[int, list[str]]:
    """How many classes there are, with the first and the last of them; the full list is ``label_facts``."""
    present = label_facts(df.where(F.col(f"`{label}`").isNotNull()), label)
    row = present.agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("first"), F.max("label").alias("last")).first()
    return row["n"], list(dict.fromkeys(v for v in (row["first"], row["last"]) if v is not None))


def diagnose_table(
    df: DataFrame,
    dataset: DatasetType,
    file_format: str = "csv",
    dropped: Sequence[str] = (),
    classes: Mapping[str, tuple[int, list[str]]] | None = None,
) -> DataFrame:
    """Five checks of a table against a table type: one row per check.

    Needs one job, the label counts, unless ``classes`` has them; everything else follows from the schema.
    """
    spark = df.sparkSession
    if file_format != dataset.file_format:
        skipped = [(c, SKIP, 0, "") for c in CHECKS[1:]]
        return _status_rows(spark, dataset.name, [("format", FAIL, 0, file_format), *skipped])
    have = df.columns
    features = [c for c in have if c != dataset.label]
    absent = sorted(c for c in set(dataset.columns) - set(have) if c != dataset.label)
    text = [
        f.name
        for f in df.schema.fields
        if not isinstance(f.dataType, T.NumericType) and f.name != dataset.label and f.name not in dropped
    ]
    checks = [("format", PASS, 0, file_format)]
    labelled = dataset.label in have
    checks.append(("label", PASS if labelled else FAIL, int(labelled), dataset.label))
    if not features:
        checks += [("features", FAIL, 0, ""), ("dtype", SKIP, 0, "")]
    else:
        checks.append(("features", FAIL, len(absent), _listed(absent)) if absent else ("features", PASS, len(features), ""))
        checks.append(("dtype", WARN, len(text), _listed(text)) if text else ("dtype", PASS, 0, ""))
    if labelled:
        kinds, shown = (classes or {}).get(dataset.label) or class_range(df, dataset.label)
        checks.append(("classes", PASS if kinds >= 2 else FAIL, kinds, _listed(shown)))
    else:
        checks.append(("classes", SKIP, 0, ""))
    return _status_rows(spark, dataset.name, checks)


def diagnose_log(
    events: DataFrame, key_rows: DataFrame, dataset: DatasetType, file_format: str = "ndjson", tls_ports: Sequence[int] = TLS_PORTS
) -> DataFrame:
    """Five checks of an event log against a log type.

    ``key_rows`` is the ``required_keys`` result; the label is derived from alerts later, so
    its check asks for alert evidence instead of a column.
    """
    spark = events.sparkSession
    if file_format != dataset.file_format:
        skipped = [(c, SKIP, 0, "") for c in CHECKS[1:]]
        return _status_rows(spark, dataset.name, [("format", FAIL, 0, file_format), *skipped])
    facts = event_log_facts(events, tls_ports).first()
    absent = sorted(r["key"] for r in key_rows.where("missing").collect())
    alerts, tls = facts["alert_rows"], facts["tls_rows"]
    features_ok = not absent and tls > 0
    checks = [
        ("format", PASS, 0, file_format),
        ("label", PASS if alerts else FAIL, alerts, dataset.label),
        ("features", PASS if features_ok else FAIL, len(absent) if absent else tls, _listed(absent)),
        ("dtype", SKIP, 0, ""),
        ("classes", PASS if alerts and tls else FAIL, min(alerts, tls), ""),
    ]
    return _status_rows(spark, dataset.name, checks)


def compatible_types(diagnoses: DataFrame) -> DataFrame:
    """Data set types without a failed check."""
    return diagnoses.groupBy("dataset_type").agg((F.count_if(F.col("status") == FAIL) == 0).alias("compatible"))


def profile(df: DataFrame, label: str) -> DataFrame:
    """Column counts by kind and rows per class, in one long table."""
    numeric = sum(isinstance(f.dataType, T.NumericType) for f in df.schema.fields)
    facts = [
        ("columns", str(len(df.columns)), None),
        ("numeric_columns", str(numeric), None),
        ("non_numeric_columns", str(len(df.columns) - numeric), None),
    ]
    fixed = df.sparkSession.createDataFrame(
        [(k, v, int(v)) for k, v, _ in facts], "fact string, value string, count bigint"
    ).select("fact", F.lit(None).cast("string").alias("value"), "count")
    classes = label_facts(df.where(F.col(f"`{label}`").isNotNull()), label).select(
        F.lit("class").alias("fact"), F.col("label").alias("value"), F.col("rows").alias("count")
    )
    return fixed.unionByName(classes)
