"""Alert association, rule cascade, conversion budget and final labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsieve.functions.scalars import iso_utc
from flowsieve.operators import refine as R
from flowsieve.operators import windows as W
from flowsieve.plans.catalogue import Query
from flowsieve.plans.catalogue.window_queries import DAY, ISO, POSITIVE, day_records, window_ctes
from flowsieve.plans.stand_in import event_records

BUDGET = R.BudgetSettings()

# Written with a range condition on purpose: a different route to the same answer.
CASCADE = f"""{window_ctes()},
al AS (SELECT window_start AS aw, src_ip AS asrc FROM rec WHERE base_alert_positive_count_window > 0),
near AS (SELECT r.window_start AS nw, r.src_ip AS nsrc, a.aw,
         abs(date_diff('minute', r.window_start, a.aw)) AS mins,
         row_number() OVER (PARTITION BY r.window_start, r.src_ip
             ORDER BY abs(date_diff('minute', r.window_start, a.aw)), a.aw) AS nr
         FROM rec r JOIN al a ON a.asrc = r.src_ip
         WHERE abs(date_diff('minute', r.window_start, a.aw)) BETWEEN 1 AND 1440),
matched AS (SELECT rec.*, CASE WHEN base_alert_positive_count_window > 0 THEN 1 ELSE 0 END AS same_alert_window,
         CASE WHEN near.aw IS NOT NULL THEN 1 ELSE 0 END AS near_alert_window,
         near.aw AS matched_alert_window, CAST(near.mins AS DOUBLE) AS minutes_to_alert_window
         FROM rec LEFT JOIN near ON near.nw = rec.window_start AND near.nsrc = rec.src_ip AND near.nr = 1),
acted AS (SELECT *, CASE
         WHEN same_alert_window = 1 AND fanout_high = 1 AND probe_score_no_alert >= p90 THEN 'probe_refined_same_window'
         WHEN near_alert_window = 1 AND fanout_high = 1 AND probe_score_no_alert >= p95 THEN 'probe_refined_near_alert_window'
         WHEN fanout_high = 1 AND probe_score_no_alert >= p99 THEN 'suspicious_probe_only' END AS label_action FROM matched),
keys AS (SELECT *, CASE WHEN label_action = 'suspicious_probe_only' THEN 0 ELSE 1 END AS key_target,
         CASE label_action WHEN 'probe_refined_same_window'
              THEN 'same_src_ip_same_alert_window_and_probe_score_ge_p90_and_fanout_high'
              WHEN 'probe_refined_near_alert_window'
              THEN 'same_src_ip_near_alert_window_and_probe_score_ge_p95_and_fanout_high'
              ELSE 'extreme_probe_without_strong_alert_association' END AS refinement_reason
         FROM acted WHERE label_action IS NOT NULL)"""

_HASH_SRC = "(('0x' || substr(md5(src_ip), 1, 15))::BIGINT)"


def budget_ctes(wants: str = "no_alert_count_window") -> str:
    return f"""{CASCADE},
bud AS (SELECT CAST(floor(sum(no_alert_count_window) * 5.0 / 100.0) AS BIGINT) AS budget,
        CAST(sum(no_alert_count_window) AS BIGINT) AS total FROM rec),
conv AS (SELECT keys.*, budget, {wants} AS want FROM keys, bud WHERE key_target = 1),
run AS (SELECT *, coalesce(sum(want) OVER (ORDER BY same_alert_window DESC, near_alert_window DESC,
        probe_score_no_alert DESC, window_start, {_HASH_SRC}, src_ip
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conv),
alloc AS (SELECT *, CAST(greatest(0, least(want, budget - before)) AS BIGINT) AS alloc FROM run)"""


_HASH_ROW = "(('0x' || substr(md5(CAST(row_id AS VARCHAR)), 1, 15))::BIGINT)"
_LABELS = f"""{budget_ctes()},
ka AS (SELECT window_start AS kw, src_ip AS ks, alloc, label_action, refinement_reason, key_target FROM alloc
       UNION ALL SELECT window_start, src_ip, 0, label_action, refinement_reason, key_target FROM keys WHERE key_target = 0),
evw AS (SELECT ev.*, time_bucket(INTERVAL 1 DAY, ts) AS w, {POSITIVE} AS positive FROM ev),
joined AS (SELECT evw.*, ka.alloc, ka.label_action, ka.refinement_reason AS key_reason, ka.key_target,
       CASE WHEN NOT positive AND key_target = 1 THEN 1 END AS contested
       FROM evw LEFT JOIN ka ON ka.kw = evw.w AND ka.ks = evw.src_ip),
capped AS (SELECT *, CASE WHEN contested = 1 THEN CASE WHEN row_number() OVER (PARTITION BY contested, w, src_ip
       ORDER BY CAST(epoch_ms(ts) AS BIGINT), {_HASH_ROW}) <= alloc THEN 1 ELSE 0 END END AS converted FROM joined),
lab AS (SELECT *, CASE WHEN positive THEN 1 ELSE 0 END AS Target_alert,
       CASE WHEN positive THEN 1 WHEN label_action IS NOT NULL THEN coalesce(converted, key_target) ELSE 0 END AS Target_refined,
       CASE WHEN positive THEN 0 WHEN label_action IS NOT NULL THEN 1 ELSE 0 END AS suspicious_by_probe,
       CASE WHEN alert_there AND coalesce(TRY_CAST(alert_severity AS DOUBLE), 0) > 0 AND lower(trim(alert_category))
            NOT IN ('generic protocol decode', 'generic protocol command decode') THEN 'alert_confirmed'
            WHEN positive THEN 'event_type_alert_confirmed' WHEN label_action IS NOT NULL THEN label_action
            ELSE 'benign_no_evidence' END AS label_source FROM capped)"""


def _keys(spark, sf_dir):
    return R.refinement_keys(day_records(spark, sf_dir), DAY)


def _same_window(spark, sf_dir):
    records = day_records(spark, sf_dir)
    matched = R.same_window_matches(records, W.alert_windows(records))
    return matched.select(iso_utc(F.col("window_start")).alias("window_start"), "src_ip", "event_count_window")


def _near(spark, sf_dir):
    records = day_records(spark, sf_dir)
    matched = R.with_near_window(records, W.alert_windows(records), DAY).where(F.col("near_alert_window") == 1)
    return matched.select(
        iso_utc(F.col("window_start")).alias("window_start"),
        "src_ip",
        iso_utc(F.col("matched_alert_window")).alias("matched_alert_window"),
        "minutes_to_alert_window",
    )


def _cascade(spark, sf_dir):
    return _keys(spark, sf_dir).select(
        iso_utc(F.col("window_start")).alias("window_start"),
        "src_ip",
        "label_action",
        "Target_refined_for_no_alert",
        "probe_score_no_alert",
        "probe_level",
        "refinement_reason",
    )


def _audit(spark, sf_dir):
    rows = R.audit_rows(_keys(spark, sf_dir), "tls")
    return rows.withColumns(
        {
            "window_start": iso_utc(F.col("window_start")),
            "matched_alert_window": iso_utc(F.col("matched_alert_window")),
        }
    )


def _actions(spark, sf_dir):
    return R.action_counts(_keys(spark, sf_dir))


def _attach(spark, sf_dir):
    events, records = event_records(spark, sf_dir), day_records(spark, sf_dir)
    return R.attach_windows(events, records, DAY).select(
        "row_id",
        "event_count_window",
        "unique_dest_port_window",
        "no_alert_count_window",
        "is_suspicious_window",
        "probe_score_with_alert",
        F.round("bytes_per_event_window", 6).alias("bytes_per_event_window"),
    )


def _attach_keys(spark, sf_dir):
    events = W.add_window(event_records(spark, sf_dir), DAY.window_minutes)
    return R.attach_keys(events, _keys(spark, sf_dir)).select("row_id", "key_source", "key_target", "key_suspicious")


def _allocated(spark, sf_dir, settings=BUDGET):
    records = day_records(spark, sf_dir)
    budget = R.conversion_budget(records, settings)
    return R.allocate_budget(R.refinement_keys(records, DAY), budget, settings), records, budget


def _budget(settings):
    def run(spark, sf_dir):
        allocated, _, _ = _allocated(spark, sf_dir, settings)
        return allocated.select(
            iso_utc(F.col("window_start")).alias("window_start"), "src_ip", "no_alert_count_window", "alloc"
        )

    return run


def _budget_report(spark, sf_dir):
    return R.budget_report(*_allocated(spark, sf_dir))


def labelled_events(spark, sf_dir):
    return R.refine_labels(event_records(spark, sf_dir), day_records(spark, sf_dir), DAY, BUDGET)


def _capped(spark, sf_dir):
    rows = labelled_events(spark, sf_dir).where(F.col("converted").isNotNull())
    return rows.select("row_id", "converted")


def _final(spark, sf_dir):
    return labelled_events(spark, sf_dir).select(
        "row_id", "Target_alert", "Target_refined", "Target", "suspicious_by_probe", "label_source"
    )


def _conversion(spark, sf_dir):
    report = R.conversion_report(labelled_events(spark, sf_dir))
    return report.withColumn("converted_pct", F.round("converted_pct", 6))


QUERIES = [
    Query(
        "e1_same_window_match",
        _same_window,
        f"WITH {window_ctes()} SELECT {ISO}, src_ip, event_count_window FROM rec r WHERE EXISTS (SELECT 1 FROM use u "
        f"WHERE u.window_start = r.window_start AND u.src_ip = r.src_ip AND {POSITIVE})",
    ),
    Query(
        "e2_near_window_match",
        _near,
        f"WITH {CASCADE} SELECT {ISO}, src_ip, strftime(matched_alert_window, '%Y-%m-%dT%H:%M:%SZ') AS "
        "matched_alert_window, minutes_to_alert_window FROM matched WHERE near_alert_window = 1",
    ),
    Query(
        "e3_refinement_cascade",
        _cascade,
        f"WITH {CASCADE} SELECT {ISO}, src_ip, label_action, key_target AS Target_refined_for_no_alert, "
        "probe_score_no_alert, probe_level, refinement_reason FROM keys",
    ),
    Query(
        "e4_audit_rows",
        _audit,
        f"WITH {CASCADE} SELECT 'tls' AS app, src_ip, {ISO}, label_action, label_action AS label_source, "
        "key_target AS Target_refined_for_no_alert, 1 AS suspicious_by_probe, probe_score_no_alert, "
        "probe_score_with_alert, probe_level, fanout_high, event_count_window, unique_dest_ip_window, "
        "unique_dest_port_window, event_type_alert_count_window, valid_alert_count_window, "
        "base_alert_positive_count_window, alert_count_window, no_alert_count_window, "
        "strftime(matched_alert_window, '%Y-%m-%dT%H:%M:%SZ') AS matched_alert_window, minutes_to_alert_window, "
        "refinement_reason FROM keys",
    ),
    Query(
        "e4_action_counts",
        _actions,
        f"WITH {CASCADE} SELECT label_action, probe_level, count(*) AS keys FROM keys GROUP BY ALL",
    ),
    Query(
        "e5_attach_window_features",
        _attach,
        f"WITH {window_ctes()} SELECT row_id, coalesce(event_count_window, 0) AS event_count_window, "
        "coalesce(unique_dest_port_window, 0) AS unique_dest_port_window, "
        "coalesce(no_alert_count_window, 0) AS no_alert_count_window, "
        "coalesce(is_suspicious_window, 0) AS is_suspicious_window, "
        "coalesce(probe_score_with_alert, 0.0) AS probe_score_with_alert, "
        "coalesce(round(total_bytes_window / event_count_window, 6), 0.0) AS bytes_per_event_window "
        "FROM ev LEFT JOIN rec ON rec.window_start = time_bucket(INTERVAL 1 DAY, ev.ts) AND rec.src_ip = ev.src_ip",
    ),
    Query(
        "e6_attach_refinement_keys",
        _attach_keys,
        f"WITH {CASCADE} SELECT row_id, label_action AS key_source, key_target, "
        "CASE WHEN label_action IS NOT NULL THEN 1 END AS key_suspicious "
        "FROM ev LEFT JOIN keys ON keys.window_start = time_bucket(INTERVAL 1 DAY, ev.ts) AND keys.src_ip = ev.src_ip",
    ),
    Query(
        "e7_conversion_budget",
        _budget(BUDGET),
        f"WITH {budget_ctes()} SELECT {ISO}, src_ip, no_alert_count_window, alloc FROM alloc",
    ),
    Query(
        "e7_conversion_budget_zero_key",
        _budget(R.BudgetSettings(zero_key_takes_rest=True)),
        f"WITH {budget_ctes('CASE WHEN no_alert_count_window > 0 THEN no_alert_count_window ELSE budget END')} "
        f"SELECT {ISO}, src_ip, no_alert_count_window, alloc FROM alloc",
    ),
    Query(
        "e8_capped_conversions",
        _capped,
        f"WITH {_LABELS} SELECT row_id, converted FROM capped WHERE converted IS NOT NULL",
    ),
    Query(
        "e9_final_labels",
        _final,
        f"WITH {_LABELS} SELECT row_id, Target_alert, Target_refined, Target_refined AS Target, suspicious_by_probe, "
        "label_source FROM lab",
    ),
    Query(
        "e10_budget_report",
        _budget_report,
        f"WITH {budget_ctes()} SELECT count(*) AS conversion_keys_total, count(*) FILTER (alloc > 0) AS keys_admitted, "
        "count(*) FILTER (no_alert_count_window > alloc) AS keys_capped, CAST(sum(alloc) AS BIGINT) AS rows_allocated, "
        "any_value((SELECT total FROM bud)) AS total_no_alert_rows, any_value(budget) AS conversion_budget_rows FROM alloc",
    ),
    Query(
        "e10_conversion_report",
        _conversion,
        f"WITH {_LABELS} SELECT count(*) FILTER (Target_alert = 0) AS no_alert_rows, "
        "count(*) FILTER (converted = 1) AS rows_converted, count(*) FILTER (converted = 0) AS rows_capped, "
        "round(count(*) FILTER (converted = 1) * 100.0 / count(*) FILTER (Target_alert = 0), 6) AS converted_pct FROM lab",
    ),
]
