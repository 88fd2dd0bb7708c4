"""Near-window matches, budget, cap and labels on hand-made cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from flowsieve.operators import refine as R
from flowsieve.operators import windows as W
from tests.test_scalars import python_hash

BASE = dt.datetime(2024, 1, 6, 12, 0)


def at(windows):
    return BASE + dt.timedelta(minutes=5 * windows)


PROBE = W.ProbeSettings()


def near(spark, probes, alerts, settings=PROBE):
    schema = "window_start timestamp, src_ip string"
    records = spark.createDataFrame([(at(w), ip) for w, ip in probes], schema)
    index = spark.createDataFrame([(at(w), ip) for w, ip in alerts], schema)
    out = R.with_near_window(records, index, settings).collect()
    return {
        (round((r["window_start"] - BASE).total_seconds() / 300), r["src_ip"]): (
            r["near_alert_window"],
            None if r["matched_alert_window"] is None else round((r["matched_alert_window"] - BASE).total_seconds() / 300),
            r["minutes_to_alert_window"],
        )
        for r in out
    }


def test_near_window_cases(spark):
    probes = [(0, "tie"), (0, "same"), (0, "far"), (0, "other"), (0, "later")]
    alerts = [(-1, "tie"), (1, "tie"), (0, "same"), (2, "far"), (1, "nobody"), (1, "later")]
    got = near(spark, probes, alerts)
    # Equal distance goes to the earlier window; the own window does not count.
    assert got[(0, "tie")] == (1, -1, 5.0)
    assert got[(0, "later")] == (1, 1, 5.0)
    assert got[(0, "same")] == got[(0, "far")] == got[(0, "other")] == (0, None, None)


def test_near_window_radius(spark):
    got = near(spark, [(0, "a")], [(-3, "a"), (2, "a")], W.ProbeSettings(near_window_radius=3))
    assert got[(0, "a")] == (1, 2, 10.0)
    assert near(spark, [(0, "a")], [(1, "a")], W.ProbeSettings(near_window_radius=0))[(0, "a")] == (0, None, None)


def test_near_window_against_brute_force(spark):
    import random

    rng = random.Random(5)
    probes = sorted({(rng.randrange(30), f"s{rng.randrange(4)}") for _ in range(60)})
    alerts = sorted({(rng.randrange(30), f"s{rng.randrange(4)}") for _ in range(25)})
    settings = W.ProbeSettings(near_window_radius=2)
    got = near(spark, probes, alerts, settings)
    for w, ip in probes:
        found = [(abs(a - w), a) for a, other in alerts if other == ip and 0 < abs(a - w) <= 2]
        want = (1, min(found)[1], min(found)[0] * 5.0) if found else (0, None, None)
        assert got[(w, ip)] == want


KEY_SCHEMA = (
    "src_ip string, window_start timestamp, same_alert_window int, near_alert_window int, probe_score_no_alert double, "
    "no_alert_count_window long, Target_refined_for_no_alert int, event_count_window long, suspicious_by_probe int, "
    "label_source string, refinement_reason string"
)


def keys_frame(spark, rows):
    return spark.createDataFrame(
        [(ip, at(w), same, nr, score, n, 1, n + 1, 1, R.SAME_WINDOW, "reason") for ip, w, same, nr, score, n in rows], KEY_SCHEMA
    )


KEYS = [("a", 0, 1, 0, 9.0, 30), ("b", 0, 1, 0, 8.0, 50), ("c", 0, 0, 1, 9.5, 40)]


def test_budget_goes_to_the_strongest(spark):
    out = R.allocate_budget(keys_frame(spark, KEYS), 60).collect()
    assert {r["src_ip"]: r["alloc"] for r in out} == {"a": 30, "b": 30, "c": 0}


def test_zero_key(spark):
    rows = [("a", 0, 1, 1, 9.0, 0), ("b", 0, 1, 0, 8.0, 50)]
    default = R.allocate_budget(keys_frame(spark, rows), 60).collect()
    assert {r["src_ip"]: r["alloc"] for r in default} == {"a": 0, "b": 50}
    greedy = R.allocate_budget(keys_frame(spark, rows), 60, R.BudgetSettings(zero_key_takes_rest=True)).collect()
    assert {r["src_ip"]: r["alloc"] for r in greedy} == {"a": 60, "b": 0}


def event_rows(spark):
    rows = []
    for ip, _, _, _, _, n in KEYS:
        rows += [(f"{ip}{i}", ip, BASE + dt.timedelta(seconds=i % 7), "flow", None) for i in range(n)]
        rows.append((f"{ip}-alert", ip, BASE, "alert", None))
    rows.append(("z0", "z", BASE, "flow", None))
    schema = (
        "row_id string, src_ip string, ts timestamp, event_type string, "
        "alert struct<severity:string,category:string,signature:string,signature_id:string,empty:boolean>"
    )
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("rank_limit", [0, 200_000])
def test_cap_takes_the_earliest_rows(spark, monkeypatch, rank_limit):
    """The split key is ranked directly, or level by level when it is too big for that."""
    monkeypatch.setattr(R, "DIRECT_RANK_ROWS", rank_limit)
    keys = R.allocate_budget(keys_frame(spark, KEYS), 60)
    events = R.keyed_events(event_rows(spark), 5)
    out = R.final_labels(R.cap_conversions(events, keys))
    rows = {r["row_id"]: r for r in out.collect()}
    assert len(rows) == 124
    order = sorted((f"b{i}" for i in range(50)), key=lambda k: (int(k[1:]) % 7, python_hash(k), k))
    converted = {k for k, r in rows.items() if r["converted"] == 1}
    assert converted == {f"a{i}" for i in range(30)} | set(order[:30])
    assert {k for k, r in rows.items() if r["converted"] == 0} == set(order[30:]) | {f"c{i}" for i in range(40)}
    # Cut rows keep flag and source but not the target; alerts and other sources are untouched.
    cut = rows["c0"]
    assert (cut["Target_refined"], cut["suspicious_by_probe"], cut["label_source"]) == (0, 1, R.SAME_WINDOW)
    alert = rows["a-alert"]
    assert (alert["Target_refined"], alert["suspicious_by_probe"], alert["label_source"]) == (1, 0, "event_type_alert_confirmed")
    assert rows["z0"]["label_source"] == "benign_no_evidence" and rows["z0"]["converted"] is None


@pytest.mark.parametrize("listed", [0, 1_000])
@pytest.mark.parametrize("budget", [7, 31, 32, 44, 60, 119])
def test_cap_holds_when_lines_repeat(spark, monkeypatch, budget, listed):
    """Every line three times: exactly the budget converts, whichever way the cut is found."""
    monkeypatch.setattr(R, "_MAX_LISTED_KEYS", listed)
    tripled = [(*row[:5], 3 * row[5]) for row in KEYS]
    keys = R.allocate_budget(keys_frame(spark, tripled), budget)
    events = event_rows(spark)
    events = R.keyed_events(events.union(events).union(events), 5)
    out = R.final_labels(R.cap_conversions(events, keys)).collect()
    assert len(out) == 3 * 124
    assert sum(r["converted"] == 1 for r in out) == budget
    allocated = {r["src_ip"]: r["alloc"] for r in keys.collect()}
    for ip, n in allocated.items():
        assert sum(r["converted"] == 1 for r in out if r["src_ip"] == ip) == n


def test_probe_scores_and_levels(spark):
    """Defaults 50/10/5: each part is capped at five."""
    wide = [("wide", BASE, f"1.1.1.{i % 100}", i % 60 + 1) for i in range(500)]
    thin = [("thin", BASE, "1.1.1.1", 0), ("thin", BASE + dt.timedelta(minutes=4, seconds=59), "", 80)]
    edge = [("thin", BASE + dt.timedelta(minutes=5), "1.1.1.1", 80)]
    rows = [(f"r{i}", *r) for i, r in enumerate(wide + thin + edge)]
    events = (
        spark.createDataFrame(rows, "row_id string, src_ip string, ts timestamp, dest_ip string, dest_port int")
        .withColumns({"event_type": F.lit("flow")})
        .withColumn("alert", F.lit(None).cast("struct<severity:string,category:string,signature:string,signature_id:string,empty:boolean>"))
        .withColumn("flow", F.lit(None).cast("struct<bytes_toserver:long,bytes_toclient:long,pkts_toserver:long,pkts_toclient:long>"))
    )
    out = {(r["src_ip"], r["window_start"]): r for r in W.probe_records(events).collect()}
    assert len(out) == 3
    top = out[("wide", BASE)]
    assert top["probe_score_no_alert"] == 5.0 + 1.25 * 5 + 1.25 * 5
    assert (top["probe_level"], top["fanout_high"], top["is_suspicious_window"]) == ("extreme", 1, 1)
    assert top["probe_reason"] == "high_event_count;many_dest_ip;many_dest_port;score_ge_p90"
    small = out[("thin", BASE)]
    assert (small["event_count_window"], small["unique_dest_ip_window"], small["unique_dest_port_window"]) == (2, 1, 1)
    assert small["probe_reason"] == "below_threshold"


def test_refined_labels_do_not_depend_on_partitions(spark, sf_dir):
    from flowsieve.plans.catalogue.window_queries import DAY
    from flowsieve.plans.stand_in import event_records

    events = event_records(spark, sf_dir)
    results = []
    for frame in (events, events.repartition(7), events.orderBy(F.col("row_id").desc())):
        labelled = R.refine_labels(frame, W.probe_records(frame, DAY), DAY)
        results.append(sorted((r["row_id"], r["Target_refined"], r["label_source"]) for r in labelled.collect()))
    assert results[0] == results[1] == results[2]
    labelled = R.refine_labels(events, W.probe_records(events, DAY), DAY)
    report = R.conversion_report(labelled).first()
    assert report["rows_converted"] <= report["no_alert_rows"] * 0.05
