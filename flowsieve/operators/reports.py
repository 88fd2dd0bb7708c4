"""Report aggregates over the exported rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.functions.buckets import feature_bucket
from flowsieve.functions.scalars import is_finite, numeric_or_null
from flowsieve.operators.quantiles import exact_quantiles

# Features of the numeric summary and of the histograms.
SUMMARY_FEATURES = (
    "total_pkts",
    "total_bytes",
    "duration",
    "bytes_per_pkt",
    "pkts_per_sec",
    "bytes_per_sec",
    "event_count_window",
    "unique_dest_ip_window",
    "unique_dest_port_window",
    "total_bytes_window",
    "total_pkts_window",
    "probe_score_no_alert",
    "probe_score_with_alert",
    "bytes_toserver_ratio",
    "bytes_toclient_ratio",
    "pkts_toserver_ratio",
    "pkts_toclient_ratio",
)
HISTOGRAM_FEATURES = (
    "total_pkts",
    "total_bytes",
    "duration",
    "bytes_per_pkt",
    "pkts_per_sec",
    "bytes_per_sec",
    "event_count_window",
    "unique_dest_ip_window",
    "unique_dest_port_window",
    "probe_score_no_alert",
    "probe_score_with_alert",
    "bytes_toserver_ratio",
    "pkts_toserver_ratio",
)
# Count groups, and those reported as a top list only.
COUNT_GROUPS = (
    "split",
    "target",
    "event_type",
    "proto",
    "app_proto",
    "alert_severity",
    "alert_category",
    "label_source",
    "dest_port",
    "src_port_class",
    "dest_port_class",
)
TOP_GROUPS = ("event_type", "app_proto", "alert_category", "dest_port")
BY_TARGET_GROUPS = ("event_type", "proto", "alert_severity", "label_source")
TOP_N = 30
BOX_FEATURES = ("total_pkts", "total_bytes", "duration", "pkts_per_sec", "bytes_per_sec")


def label_distribution(rows: DataFrame) -> DataFrame:
    """Counts of the refined label, the alert label and the label source in one shuffle."""
    kinds = ["Target_refined", "Target_alert", "label_source"]
    text = rows.select(*[F.col(k).cast("string").alias(k) for k in kinds])
    return _value_counts(text, kinds).withColumnRenamed("group", "label_type")


def _value_counts(text: DataFrame, names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Rows per value of each named text column.

    Each row becomes one (group, value) pair per name; map-side counting shrinks them to
    the distinct values before the shuffle.
    """
    pairs = F.array(*[F.struct(F.lit(n).alias("group"), F.col(n).alias("key")) for n in names])
    return (
        text.select(*keys, F.explode(pairs).alias("x"))
        .groupBy(*keys, F.col("x.group").alias("group"), F.col("x.key").alias("key"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def _text_groups(rows: DataFrame, target: str, names: Sequence[str]) -> DataFrame:
    missing = {"alert_category": "none", "alert_severity": "0", "dest_port": "0", "src_port_class": "0", "dest_port_class": "0"}

    def text(name: str) -> Column:
        c = F.col(target if name == "target" else name).cast("string")
        return F.coalesce(F.nullif(c, F.lit("")), F.lit(missing.get(name, "unknown")))

    return rows.select(*[text(n).alias(n) for n in names])


def exact_counts(rows: DataFrame, target: str = "Target_refined", names: Sequence[str] = COUNT_GROUPS, top_n: int = TOP_N) -> DataFrame:
    """Value counts of all report groups; open-ended groups keep their ``top_n``."""
    counts = _value_counts(_text_groups(rows, target, names), names)
    order = Window.partitionBy("group").orderBy(F.col("count").desc(), "key")
    ranked = counts.withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("rank") <= top_n) | ~F.col("group").isin(*TOP_GROUPS)).drop("rank")


def counts_by_target(rows: DataFrame, target: str = "Target_refined", names: Sequence[str] = BY_TARGET_GROUPS) -> DataFrame:
    text = _text_groups(rows, target, ["target", *names])
    return _value_counts(text, names, keys=["target"])


def flattened_counts(rows: DataFrame, app: str, target: str = "Target_refined", names: Sequence[str] = COUNT_GROUPS) -> DataFrame:
    """The exact counts as (app, group, key, count) rows."""
    return exact_counts(rows, target, names).select(F.lit(app).alias("app"), "group", "key", "count")


def _facts(features: Sequence[str]) -> list[Column]:
    out = []
    for i, name in enumerate(features):
        raw = numeric_or_null(F.col(f"`{name}`"))
        x = F.when(is_finite(raw), raw)
        out += [
            F.count(x).alias(f"n{i}"),
            F.count_if(x.isNull()).alias(f"m{i}"),
            F.count_if(x != 0).alias(f"z{i}"),
            F.min(x).alias(f"lo{i}"),
            F.max(x).alias(f"hi{i}"),
            F.sum(x).alias(f"t{i}"),
        ]
    return out


def numeric_summary(rows: DataFrame, features: Sequence[str], target: str = "Target_refined") -> DataFrame:
    """Count, missing, nonzero, min, max, sum, mean per feature, by class and overall.

    One aggregate per class over all features; the overall rows are merged from those, so
    the table is read once.  Non-finite values count as missing.
    """
    wide = rows.groupBy(F.when(F.col(target) == 1, "1").otherwise("0").alias("target")).agg(*_facts(features))
    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("feature"),
                F.col(f"n{i}").alias("count"),
                F.col(f"m{i}").alias("missing"),
                F.col(f"z{i}").alias("nonzero"),
                F.col(f"lo{i}").alias("min"),
                F.col(f"hi{i}").alias("max"),
                F.coalesce(F.col(f"t{i}"), F.lit(0.0)).alias("sum"),
            )
            for i, name in enumerate(features)
        ]
    )
    long = wide.select("target", F.explode(entries).alias("x")).select("target", "x.*")
    overall = long.groupBy(F.lit("all").alias("target"), "feature").agg(
        *[F.sum(c).alias(c) for c in ("count", "missing", "nonzero")], F.min("min").alias("min"), F.max("max").alias("max"), F.sum("sum").alias("sum")
    )
    return long.unionByName(overall).withColumn("mean", F.coalesce(F.try_divide(F.col("sum"), F.col("count").cast("double")), F.lit(0.0)))


def histograms(rows: DataFrame, features: Sequence[str] = HISTOGRAM_FEATURES, target: str = "Target_refined") -> DataFrame:
    """Rows per fixed bucket of each feature, by class; at most ten buckets per feature."""
    pairs = F.array(
        *[F.struct(F.lit(f).alias("feature"), F.col(f"`{f}`").cast("double").alias("value")) for f in features]
    )
    long = rows.select(F.when(F.col(target) == 1, 1).otherwise(0).alias("target"), F.explode(pairs).alias("x"))
    return long.groupBy("target", "x.feature", feature_bucket(F.col("x.feature"), F.col("x.value")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("count")
    )


def label_comparison(rows: DataFrame) -> DataFrame:
    """Class counts before and after refinement."""
    kinds = {"initial": "Target_alert", "refined": "Target_refined"}
    text = rows.select(*[F.col(c).cast("string").alias(name) for name, c in kinds.items()])
    return _value_counts(text, list(kinds)).select(F.col("group").alias("stage"), F.col("key").alias("label"), "count")


def box_statistics(rows: DataFrame, features: Sequence[str] = BOX_FEATURES, target: str = "Target_refined") -> DataFrame:
    """Quartiles and whiskers per feature and class, outliers left out of the whiskers.

    Quartiles are exact over all rows; whiskers reach the extreme values within 1.5 times
    the interquartile range.
    """
    pairs = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                F.coalesce(F.when(is_finite(F.col(f"`{f}`").cast("double")), F.col(f"`{f}`").cast("double")), F.lit(0.0)).alias("value"),
            )
            for f in features
        ]
    )
    long = rows.select(F.when(F.col(target) == 1, 1).otherwise(0).alias("target"), F.explode(pairs).alias("x")).select("target", "x.*")
    keys = ["feature", "target"]
    quartiles = exact_quantiles(long, "value", [0.25, 0.5, 0.75], keys)
    # One row per feature and class.
    joined = long.join(F.broadcast(quartiles), keys)
    reach = 1.5 * (F.col("q2") - F.col("q0"))
    inside = F.col("value").between(F.col("q0") - reach, F.col("q2") + reach)
    whiskers = joined.groupBy(*keys).agg(
        F.min(F.when(inside, F.col("value"))).alias("low_whisker"), F.max(F.when(inside, F.col("value"))).alias("high_whisker")
    )
    return quartiles.join(whiskers, keys).select(
        *keys, "n", F.col("q0").alias("q25"), F.col("q1").alias("median"), F.col("q2").alias("q75"), "low_whisker", "high_whisker"
    )


def lowest_availability(table: DataFrame, n: int = 20) -> DataFrame:
    return table.orderBy("availability_ratio", "column").limit(n)


def summed_target_counts(per_app: DataFrame) -> DataFrame:
    """Class counts added over applications, with 0 for a class nobody has."""
    return per_app.agg(
        F.coalesce(F.sum(F.when(F.col("target") == 0, F.col("rows"))), F.lit(0)).alias("benign"),
        F.coalesce(F.sum(F.when(F.col("target") == 1, F.col("rows"))), F.lit(0)).alias("attack"),
    )


def stage_table(statuses: DataFrame) -> DataFrame:
    """Latest status per stage and application, newest first by ``finished_at``."""
    latest = F.max_by(F.struct("status", "seconds"), "finished_at").alias("x")
    return statuses.groupBy("app", "stage").agg(latest).select("app", "stage", "x.status", "x.seconds")
