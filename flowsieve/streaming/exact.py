"""Live forms with exact results: distinct counts, nearest alert windows, thresholds kept up to date.

All of them report a window once the watermark has passed it, and what they then say is what the
batch operators say of the same events.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from flowsieve.operators.windows import SCORE_DECIMALS, ProbeSettings, add_scores, measures, usable_events

# Windows of a source that share one state of the nearest match.
BLOCK_WINDOWS = 64

_SUMS = {
    "event_count_window": "n",
    "total_bytes_window": "bytes",
    "total_pkts_window": "pkts",
    "alert_count_window": "any_alert",
    "event_type_alert_count_window": "typed",
    "valid_alert_count_window": "valid",
    "base_alert_positive_count_window": "positive",
}


def exact_live_windows(events: DataFrame, settings: ProbeSettings = ProbeSettings(), delay: str = "10 minutes") -> DataFrame:
    """The counters of ``probe_windows`` over a stream, exact distinct counts included.

    Two stateful steps: one row per (window, source, kind of value, value) until the watermark passes, then a row per
    window and source that counts them.  So a source's events are first spread by their destinations, and
    state holds each destination of an open window once.
    """
    minutes = f"{settings.window_minutes} minutes"
    seen = usable_events(events).withWatermark("ts", delay).select(F.window("ts", minutes).alias("w"), *measures())
    values = F.array(
        F.struct(F.lit("ip").alias("kind"), F.col("dest_ip").alias("value")),
        F.struct(F.lit("port").alias("kind"), F.col("dest_port").cast("string").alias("value")),
    )
    kept = ["w", "src_ip", "ts", "bytes", "pkts", *[F.col(c).cast("bigint").alias(c) for c in ("any_alert", "typed", "valid")]]
    long = seen.select(*kept, (F.col("typed") | F.col("valid")).cast("bigint").alias("positive"), F.explode(values).alias("x"))
    # Every event comes once as each kind; sums are taken of one of them.
    once = F.when(F.col("x.kind") == "ip", 1).otherwise(0)
    parts = {"n": F.sum(once)} | {c: F.sum(F.col(c) * once) for c in ("bytes", "pkts", "any_alert", "typed", "valid", "positive")}
    first = long.groupBy("w", "src_ip", F.col("x.kind").alias("kind"), F.col("x.value").alias("value")).agg(
        *[c.cast("bigint").alias(name) for name, c in parts.items()], F.min("ts").alias("first"), F.max("ts").alias("last")
    )

    def distinct(kind: str) -> Column:
        return F.count_if((F.col("kind") == kind) & F.col("value").isNotNull())

    second = first.groupBy(F.window("w", minutes).alias("w"), "src_ip").agg(
        *[F.sum(c).alias(name) for name, c in _SUMS.items()],
        distinct("ip").alias("unique_dest_ip_window"),
        distinct("port").alias("unique_dest_port_window"),
        F.min("first").alias("first_seen"),
        F.max("last").alias("last_seen"),
    )
    return second.withColumns(
        {
            "no_alert_count_window": F.col("event_count_window") - F.col("base_alert_positive_count_window"),
            "window_start": F.col("w.start"),
            "window_end": F.col("w.end"),
        }
    )


_NEAREST = "window_start bigint, src_ip string, matched_alert_window bigint, minutes_to_alert_window double"
_OPEN = "windows array<bigint>, alerts array<bigint>"


def nearest_live_alerts(events: DataFrame, settings: ProbeSettings = ProbeSettings(), delay: str = "10 minutes") -> DataFrame:
    """For each closed window near an alert window of its source: the nearest one, the earlier on ties.

    A source's events are first reduced to one per window and kind, so a busy source is no hot key.  State holds, per
    source and block of ``BLOCK_WINDOWS`` windows, the windows that still wait and the alert windows they can reach; a timer on
    the watermark reports a window when all windows in its reach are closed and forgets alert windows out of
    reach.  Alert windows are announced to the blocks they can reach, so a source that is always active is
    spread over its blocks.
    """
    length, radius = settings.window_minutes * 60, settings.near_window_radius
    span = BLOCK_WINDOWS * length
    seen = usable_events(events).withWatermark("ts", delay).select(F.window("ts", f"{settings.window_minutes} minutes").alias("w"), *measures())
    seen = seen.select("w", "src_ip", (F.col("typed") | F.col("valid")).alias("alert")).dropDuplicates(["w", "src_ip", "alert"])
    start, alert = F.unix_seconds("w.start"), F.col("alert")
    block = lambda at: F.floor(at / span).cast("bigint")
    own = block(start)
    blocks = F.when(alert, F.sequence(block(start - radius * length), block(start + radius * length))).otherwise(F.array(own))
    rows = seen.select("w", "src_ip", start.alias("start"), alert.alias("alert"), own.alias("own"), F.explode(blocks).alias("block"))

    def match(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, alerts = (list(x) for x in state.get) if state.exists else ([], [])
        for frame in frames:
            waiting += [int(x) for x in frame.loc[frame["own"] == frame["block"], "start"]]
            alerts += [int(x) for x in frame.loc[frame["alert"], "start"]]
        # A window comes once with and once without alerts.
        waiting = sorted(set(waiting))
        closed = state.getCurrentWatermarkMs() // 1000
        reach = radius * length
        found = []
        for w in [w for w in waiting if w + reach + length <= closed]:
            near = min(((abs(a - w), a) for a in alerts if 0 < abs(a - w) <= reach), default=None)
            if near:
                found.append((w, key[0], near[1], near[0] / 60))
        waiting = [w for w in waiting if w + reach + length > closed]
        alerts = [a for a in alerts if a + 2 * reach + length > closed]
        if waiting or alerts:
            state.update((waiting, alerts))
            due = [w + reach + length for w in waiting] + [a + 2 * reach + length for a in alerts]
            state.setTimeoutTimestamp(min(due) * 1000)
        elif state.exists:
            state.remove()
        if found:
            yield pd.DataFrame(found, columns=[c.split()[0] for c in _NEAREST.split(", ")])

    found = rows.groupBy("src_ip", "block").applyInPandasWithState(match, _NEAREST, _OPEN, "append", GroupStateTimeout.EventTimeTimeout)
    at = {c: F.timestamp_seconds(c) for c in ("window_start", "matched_alert_window")}
    return found.withColumns(at)


class ScoreHistogram:
    """Windows per application and score, brought up to date by each micro-batch.

    Scores are built from capped counts, so their distinct values are bounded and the histogram is exact.  Two slots
    are written in turn: batch n reads the state after batch n - 1 from the other slot and overwrites its own, so a
    batch that is retried writes the same state again.
    """

    SCHEMA = "app string, score double, windows bigint, version bigint"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _slot(self, version: int) -> str:
        return f"{self.path}/slot-{version % 2}"

    def at(self, version: int) -> DataFrame:
        """The histogram after that batch; empty before the first."""
        if version < 0:
            return self.spark.createDataFrame([], self.SCHEMA)
        found = self.spark.read.schema(self.SCHEMA).parquet(self._slot(version))
        return found.where(F.col("version") == version)

    def add(self, scored: DataFrame, app: Column, version: int) -> None:
        """Counts the windows of batch ``version``."""
        new = scored.groupBy(app.alias("app"), F.col("probe_score_no_alert").alias("score")).agg(F.count(F.lit(1)).alias("windows"))
        merged = self.at(version - 1).select("app", "score", "windows").unionByName(new).groupBy("app", "score").agg(F.sum("windows").alias("windows"))
        merged.withColumn("version", F.lit(version).cast("bigint")).write.mode("overwrite").parquet(self._slot(version))

    def thresholds(self, version: int, settings: ProbeSettings = ProbeSettings()) -> DataFrame:
        """``app, p90, p95, p99, max, windows``: interpolated percentiles, read from counts only."""
        wanted = {"p90": settings.same_percentile, "p95": settings.near_percentile, "p99": settings.extreme_percentile}
        cuts = [F.round(F.percentile("score", p / 100.0, F.col("windows")), SCORE_DECIMALS).alias(name) for name, p in wanted.items()]
        return self.at(version).groupBy("app").agg(*cuts, F.max("score").alias("max"), F.sum("windows").alias("windows"))


def keep_thresholds(
    windows: DataFrame, app: Column, histogram: ScoreHistogram, checkpoint: str, settings: ProbeSettings = ProbeSettings(), available_now: bool = True
) -> StreamingQuery:
    """Scores each closed window of the stream into ``histogram``; the query's last batch is its version."""

    def write(batch: DataFrame, version: int) -> None:
        histogram.add(add_scores(batch, settings), app, version)

    writer = windows.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
