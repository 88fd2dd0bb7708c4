import datetime

import pytest
from pyspark.sql import functions as F

from flowsieve.operators.refine import nearest_alert_windows
from flowsieve.operators.windows import ProbeSettings, add_scores, probe_windows, score_thresholds
from flowsieve.plans.stand_in import event_records
from flowsieve.streaming import exact

DAY = ProbeSettings(window_minutes=1440, min_event_count=4, min_unique_dest_ip=4, min_unique_dest_port=3)
WIDE = ProbeSettings(window_minutes=1440, min_event_count=4, min_unique_dest_ip=4, min_unique_dest_port=3, near_window_radius=3)


@pytest.fixture(scope="module")
def ordered(spark, sf_dir, tmp_path_factory):
    """The events in four files, in order of time, and once more as a late fifth."""
    path = str(tmp_path_factory.mktemp("live") / "events")
    records = event_records(spark, sf_dir).where("ts IS NOT NULL").persist()
    cuts = records.agg(F.percentile(F.unix_micros("ts"), [0.25, 0.5, 0.75])).first()[0]
    part = sum(((F.unix_micros("ts") > c).cast("int") for c in cuts), F.lit(0))
    for i in range(4):
        records.where(part == i).coalesce(1).write.mode("append").parquet(path)
    records.orderBy("ts").limit(20).coalesce(1).write.mode("append").parquet(path)
    return path, records


def stream_of(spark, path):
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def drained(frame, tmp_path):
    out = str(tmp_path / "out")
    writer = frame.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state"))
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return frame.sparkSession.read.schema(frame.schema).parquet(out), query


def rows(frame, columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


def closed(records, windows, settings, reach=0):
    last = records.agg(F.max("ts")).first()[0] - datetime.timedelta(minutes=10)
    return windows.where(F.col("window_start") <= F.lit(last) - F.expr(f"INTERVAL {1 + reach} DAY"))


def test_exact_windows_over_many_batches(spark, ordered, tmp_path):
    path, records = ordered
    found, query = drained(exact.exact_live_windows(stream_of(spark, path), DAY).drop("w", "window_end"), tmp_path)
    batch = closed(records, probe_windows(records, DAY), DAY)
    # Late events are dropped, so the first file's repeat changes nothing.
    assert rows(found, batch.columns) == rows(batch, batch.columns)
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 5


@pytest.mark.parametrize("settings,block", [(DAY, 64), (WIDE, 64), (WIDE, 2), (DAY, 1)])
def test_nearest_alerts_over_many_batches(spark, ordered, tmp_path, monkeypatch, settings, block):
    monkeypatch.setattr(exact, "BLOCK_WINDOWS", block)
    path, records = ordered
    found, query = drained(exact.nearest_live_alerts(stream_of(spark, path), settings), tmp_path)
    windows = probe_windows(records, settings)
    near = windows.join(nearest_alert_windows(windows.where("base_alert_positive_count_window > 0"), settings), ["window_start", "src_ip"])
    columns = ["window_start", "src_ip", "matched_alert_window", "minutes_to_alert_window"]
    wanted = rows(closed(records, near, settings, settings.near_window_radius), columns)
    assert rows(found, columns) == wanted and len(wanted) > 20
    # Blocks whose windows are reported and out of reach leave the state.
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    if block < 64:
        assert kept[-1] < max(kept) < windows.count() and kept[-1] < windows.count() / 3, (kept, windows.count())


def test_histogram_is_the_same_after_a_retry(spark, ordered, tmp_path):
    _, records = ordered
    scored = add_scores(probe_windows(records, DAY), DAY).persist()
    app = F.substring("src_ip", 1, 2)
    histogram = exact.ScoreHistogram(spark, str(tmp_path / "histogram"))
    for version in range(3):
        part = scored.where(F.pmod(F.xxhash64("src_ip", "window_start"), F.lit(3)) == version)
        for _ in range(1 + (version > 0)):
            histogram.add(part, app, version)
    found = {r.app: r for r in histogram.thresholds(2, DAY).collect()}
    assert sum(r.windows for r in found.values()) == scored.count() and len(found) == 2
    for name, r in found.items():
        wanted = score_thresholds(scored.where(app == name), "probe_score_no_alert", {"p90": 90, "p95": 95, "p99": 99}).first()
        assert (r.p90, r.p95, r.p99, r.max) == (wanted.p90, wanted.p95, wanted.p99, wanted.max)


def test_thresholds_follow_the_stream(spark, ordered, tmp_path):
    path, records = ordered
    histogram = exact.ScoreHistogram(spark, str(tmp_path / "histogram"))
    query = exact.keep_thresholds(exact.exact_live_windows(stream_of(spark, path), DAY), F.lit("all"), histogram, str(tmp_path / "state"), DAY)
    query.awaitTermination()
    found = histogram.thresholds(query.lastProgress["batchId"], DAY).first()
    scored = closed(records, add_scores(probe_windows(records, DAY), DAY), DAY)
    wanted = score_thresholds(scored, "probe_score_no_alert", {"p90": 90, "p95": 95, "p99": 99}).first()
    assert (found.windows, found.p90, found.p95, found.p99, found.max) == (scored.count(), wanted.p90, wanted.p95, wanted.p99, wanted.max)
