"""Window counters kept over a table that grows by appends, late events included.

What is kept of a window can be merged: sums, first and last time, and one row per distinct destination
address and port, so distinct counts stay exact.  An append aggregates its own events, reads the kept rows of the days it
touches and writes those days again under its own number.  Old events are never read again, and an append that is
repeated after a failure writes the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.operators.joins import broadcast_if_small
from flowsieve.operators.windows import KEYS, ProbeSettings, add_window, measures, usable_events

_SUMS = ("n", "bytes", "pkts", "any_alert", "typed", "valid", "positive")
_PARTS = [*KEYS, "kind", "value"]
_STATE = "window_start timestamp, src_ip string, kind string, value string, " + ", ".join(f"{c} bigint" for c in _SUMS) + ", first timestamp, last timestamp"


def window_parts(events: DataFrame, settings: ProbeSettings = ProbeSettings()) -> DataFrame:
    """One row per (window, source, kind of value, value); sums are with the addresses, where every event counts once."""
    seen = add_window(usable_events(events), settings.window_minutes).select("window_start", *measures())
    values = F.array(
        F.struct(F.lit("ip").alias("kind"), F.col("dest_ip").alias("value")),
        F.struct(F.lit("port").alias("kind"), F.col("dest_port").cast("string").alias("value")),
    )
    flags = {c: F.col(c).cast("bigint") for c in ("any_alert", "typed", "valid")}
    long = seen.withColumns(flags | {"positive": (F.col("typed") | F.col("valid")).cast("bigint"), "n": F.lit(1).cast("bigint"), "x": F.explode(values)})
    once = F.when(F.col("x.kind") == "ip", 1).otherwise(0).cast("bigint")
    return long.groupBy(*KEYS, F.col("x.kind").alias("kind"), F.col("x.value").alias("value")).agg(
        *[F.sum(F.col(c) * once).alias(c) for c in _SUMS], F.min("ts").alias("first"), F.max("ts").alias("last")
    )


def merged_parts(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*_PARTS).agg(*[F.sum(c).alias(c) for c in _SUMS], F.min("first").alias("first"), F.max("last").alias("last"))


def windows_of(parts: DataFrame) -> DataFrame:
    """The counters of ``probe_windows`` from kept rows."""
    distinct = lambda kind: F.count_if((F.col("kind") == kind) & F.col("value").isNotNull())
    return parts.groupBy(*KEYS).agg(
        F.sum("n").alias("event_count_window"),
        distinct("ip").alias("unique_dest_ip_window"),
        distinct("port").alias("unique_dest_port_window"),
        F.sum("bytes").alias("total_bytes_window"),
        F.sum("pkts").alias("total_pkts_window"),
        F.sum("any_alert").alias("alert_count_window"),
        F.sum("typed").alias("event_type_alert_count_window"),
        F.sum("valid").alias("valid_alert_count_window"),
        F.sum("positive").alias("base_alert_positive_count_window"),
        (F.sum("n") - F.sum("positive")).alias("no_alert_count_window"),
        F.min("first").alias("first_seen"),
        F.max("last").alias("last_seen"),
    )


class WindowStore:
    """Kept rows under ``path``, a folder per append and in it one per day."""

    def __init__(self, spark: SparkSession, path: str, settings: ProbeSettings = ProbeSettings()) -> None:
        self.spark, self.path, self.settings = spark, path, settings

    def _folder(self, number: int) -> str:
        return f"{self.path}/append={number}"

    def _latest(self, upto: int) -> DataFrame:
        """Kept rows as they stand after append ``upto``: of every day the last one written."""
        kept = self.spark.read.schema(f"{_STATE}, day date, append int").option("basePath", self.path)
        kept = kept.parquet(*[self._folder(i) for i in range(upto + 1)])
        # Folder names only; a row per day.
        last = kept.groupBy("day").agg(F.max("append").alias("append"))
        return kept.join(broadcast_if_small(last), ["day", "append"])

    def append(self, events: DataFrame, number: int) -> None:
        """Takes in the events of append ``number``, counted from 0 without a gap."""
        new = window_parts(events, self.settings).withColumn("day", F.to_date("window_start"))
        if number:
            touched = broadcast_if_small(new.select("day").distinct())
            old = self._latest(number - 1).join(touched, "day", "left_semi").drop("append")
            new = new.unionByName(old)
        merged = merged_parts(new).withColumn("day", F.to_date("window_start"))
        merged.write.mode("overwrite").partitionBy("day").parquet(self._folder(number))

    def parts(self, upto: int) -> DataFrame:
        return self._latest(upto).drop("day", "append")

    def windows(self, upto: int) -> DataFrame:
        """All windows after append ``upto``."""
        return windows_of(self.parts(upto))
