"""Label refinement: alert association, rule cascade, conversion budget, final labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.functions import labels
from flowsieve.functions.hashing import hash60
from flowsieve.functions.scalars import window_floor
from flowsieve.operators.allocate import DIRECT_RANK_ROWS, hash_levels, prefix_allocate, take_prefix
from flowsieve.operators.joins import broadcast_if_small, lookup_join
from flowsieve.operators.windows import KEYS, ProbeSettings
from flowsieve.session import cut_lineage

# Rule outcomes and the reason recorded with each.
SAME_WINDOW = "probe_refined_same_window"
NEAR_WINDOW = "probe_refined_near_alert_window"
SUSPICIOUS_ONLY = "suspicious_probe_only"
REASONS = {
    SAME_WINDOW: "same_src_ip_same_alert_window_and_probe_score_ge_p90_and_fanout_high",
    NEAR_WINDOW: "same_src_ip_near_alert_window_and_probe_score_ge_p95_and_fanout_high",
    SUSPICIOUS_ONLY: "extreme_probe_without_strong_alert_association",
}

# Window columns copied onto every event, integers first.
PROBE_INT_COLUMNS = (
    "event_count_window",
    "unique_dest_ip_window",
    "unique_dest_port_window",
    "total_bytes_window",
    "total_pkts_window",
    "alert_count_window",
    "event_type_alert_count_window",
    "valid_alert_count_window",
    "base_alert_positive_count_window",
    "no_alert_count_window",
    "fanout_high",
    "is_suspicious_window",
)
PROBE_DOUBLE_COLUMNS = (
    "bytes_per_event_window",
    "pkts_per_event_window",
    "probe_score_no_alert",
    "probe_score_with_alert",
)


@dataclass(frozen=True)
class BudgetSettings:
    """Cap on rows turned from no-alert to attack.

    ``zero_key_takes_rest`` lets a key without no-alert rows claim the whole remaining
    budget; by default such a key claims nothing.
    """

    max_conversion_pct: float = 5.0
    enforce: bool = True
    extreme_changes_target: bool = False
    zero_key_takes_rest: bool = False


def with_same_window(records: DataFrame) -> DataFrame:
    """A window is its own alert window exactly when it holds a base-positive event."""
    return records.withColumn("same_alert_window", (F.col("base_alert_positive_count_window") > 0).cast("int"))


def same_window_matches(records: DataFrame, alert_index: DataFrame) -> DataFrame:
    """Existence join against an alert-window index kept elsewhere."""
    return records.join(alert_index.select(*KEYS), list(KEYS), "left_semi")


def nearest_alert_windows(alert_index: DataFrame, settings: ProbeSettings) -> DataFrame:
    """For each (window, source) near an alert window: the nearest one and its distance.

    A range condition would pair every window of a source with every other.  Instead each
    alert window is announced to the ``2 * radius`` window starts it can reach, which turns
    the match into an equality on the window key.  Nearest wins, ties go to the earlier one.
    """
    steps = [s for s in range(-settings.near_window_radius, settings.near_window_radius + 1) if s]
    seconds = settings.window_minutes * 60
    offsets = F.array(*[F.lit(s) for s in steps]) if steps else F.array().cast("array<int>")
    reached = alert_index.select(
        "src_ip", F.col("window_start").alias("matched_alert_window"), F.explode(offsets).alias("step")
    ).select(
        F.timestamp_seconds(F.unix_seconds("matched_alert_window") - F.col("step") * seconds).alias("window_start"),
        "src_ip",
        (F.abs("step") * settings.window_minutes).cast("double").alias("minutes"),
        "matched_alert_window",
    )
    best = F.min(F.struct("minutes", "matched_alert_window")).alias("best")
    return reached.groupBy(*KEYS).agg(best).select(
        *KEYS,
        F.col("best.matched_alert_window").alias("matched_alert_window"),
        F.col("best.minutes").alias("minutes_to_alert_window"),
    )


def with_near_window(records: DataFrame, alert_index: DataFrame, settings: ProbeSettings) -> DataFrame:
    near = nearest_alert_windows(alert_index, settings)
    return records.join(near, list(KEYS), "left").withColumn(
        "near_alert_window", F.col("matched_alert_window").isNotNull().cast("int")
    )


def refinement_keys(records: DataFrame, settings: ProbeSettings = ProbeSettings()) -> DataFrame:
    """Windows that some rule of the cascade accepts, with the rule outcome."""
    alerts = records.where(F.col("base_alert_positive_count_window") > 0).select(*KEYS)
    matched = with_near_window(with_same_window(records), alerts, settings)
    fanout = F.col("fanout_high") == 1
    score = F.col("probe_score_no_alert")
    action = (
        F.when((F.col("same_alert_window") == 1) & fanout & (score >= F.col("p90")), SAME_WINDOW)
        .when((F.col("near_alert_window") == 1) & fanout & (score >= F.col("p95")), NEAR_WINDOW)
        .when(fanout & (score >= F.col("p99")), SUSPICIOUS_ONLY)
    )
    reason = F.lit(None).cast("string")
    for name, text in REASONS.items():
        reason = F.when(F.col("label_action") == name, text).otherwise(reason)
    return (
        matched.withColumn("label_action", action)
        .where(F.col("label_action").isNotNull())
        .withColumns(
            {
                "label_source": F.col("label_action"),
                "Target_refined_for_no_alert": (F.col("label_action") != SUSPICIOUS_ONLY).cast("int"),
                "suspicious_by_probe": F.lit(1),
                "refinement_reason": reason,
            }
        )
    )


AUDIT_COLUMNS = (
    "src_ip",
    "window_start",
    "label_action",
    "label_source",
    "Target_refined_for_no_alert",
    "suspicious_by_probe",
    "probe_score_no_alert",
    "probe_score_with_alert",
    "probe_level",
    "fanout_high",
    "event_count_window",
    "unique_dest_ip_window",
    "unique_dest_port_window",
    "event_type_alert_count_window",
    "valid_alert_count_window",
    "base_alert_positive_count_window",
    "alert_count_window",
    "no_alert_count_window",
    "matched_alert_window",
    "minutes_to_alert_window",
    "refinement_reason",
)


def audit_rows(keys: DataFrame, app: str) -> DataFrame:
    return keys.select(F.lit(app).alias("app"), *AUDIT_COLUMNS)


def action_counts(keys: DataFrame) -> DataFrame:
    return keys.groupBy("label_action", "probe_level").agg(F.count(F.lit(1)).alias("keys"))


def _total_no_alert(records: DataFrame) -> int:
    return records.agg(F.coalesce(F.sum("no_alert_count_window"), F.lit(0)).alias("n")).first()["n"]


def conversion_budget(records: DataFrame, settings: BudgetSettings) -> int:
    """Rows that may change label: a floor share of all no-alert rows."""
    return int(_total_no_alert(records) * settings.max_conversion_pct / 100.0)


def converting_keys(keys: DataFrame, settings: BudgetSettings) -> DataFrame:
    if settings.extreme_changes_target:
        return keys.withColumn("Target_refined_for_no_alert", F.lit(1))
    return keys


def allocate_budget(keys: DataFrame, budget: int, settings: BudgetSettings = BudgetSettings()) -> DataFrame:
    """Conversion keys plus ``alloc``: rows each key may convert, strongest evidence first.

    Order: same-window before near-window, higher score, earlier window, then source by
    hash.  Each step is a bounded level, so no task sorts the whole key table.
    """
    wants = F.col("no_alert_count_window")
    if settings.zero_key_takes_rest:
        wants = F.when(wants > 0, wants).otherwise(F.lit(budget))
    association = (1 - F.col("same_alert_window")) * 2 + (1 - F.col("near_alert_window"))
    source = hash60(F.col("src_ip"))
    return prefix_allocate(
        keys.where(F.col("Target_refined_for_no_alert") == 1),
        quota=budget,
        levels=[
            association,
            -F.col("probe_score_no_alert"),
            F.unix_seconds("window_start"),
            *hash_levels(source),
        ],
        tie=[source, F.col("src_ip")],
        weight=wants,
    )


def budget_report(allocated: DataFrame, records: DataFrame, budget: int) -> DataFrame:
    """Totals of one budget run; ``records`` supplies the no-alert denominator."""
    return allocated.agg(
        F.count(F.lit(1)).alias("conversion_keys_total"),
        F.count_if(F.col("alloc") > 0).alias("keys_admitted"),
        F.count_if(F.col("no_alert_count_window") > F.col("alloc")).alias("keys_capped"),
        F.coalesce(F.sum("alloc"), F.lit(0)).alias("rows_allocated"),
    ).withColumns(
        {
            "total_no_alert_rows": F.lit(_total_no_alert(records)).cast("bigint"),
            "conversion_budget_rows": F.lit(budget).cast("bigint"),
        }
    )


def keyed_events(events: DataFrame, minutes: int) -> DataFrame:
    """Events with the window key the lookups use."""
    return events.withColumns({"window_start": window_floor(F.col("ts"), minutes), "src_ip": F.trim("src_ip")})


def attach_windows(events: DataFrame, records: DataFrame, settings: ProbeSettings, row_key: str = "row_id") -> DataFrame:
    """Window behaviour columns on every event, with zero for events outside any window."""
    lookup = records.select(*KEYS, *PROBE_INT_COLUMNS, *PROBE_DOUBLE_COLUMNS)
    keyed = keyed_events(events, settings.window_minutes)
    joined = lookup_join(keyed, lookup, KEYS, weight="event_count_window", spread_by=[row_key])
    return _zero_outside(joined)


def _zero_outside(joined: DataFrame) -> DataFrame:
    return joined.fillna(0, list(PROBE_INT_COLUMNS)).fillna(0.0, list(PROBE_DOUBLE_COLUMNS))


def _key_columns(keys: DataFrame) -> list[Column]:
    columns = [
        F.col("Target_refined_for_no_alert").alias("key_target"),
        F.col("suspicious_by_probe").alias("key_suspicious"),
        F.col("label_source").alias("key_source"),
        F.col("refinement_reason").alias("key_reason"),
    ]
    return columns + [F.col(c) for c in ("alloc", "cut", "cut_copies") if c in keys.columns]


def attach_keys(events: DataFrame, keys: DataFrame, row_key: str = "row_id") -> DataFrame:
    """Refinement outcome on every event of a key; nulls elsewhere.

    ``events`` carry ``window_start``; ``alloc`` and ``cut`` come along if the keys have them.
    """
    lookup = keys.select(*KEYS, *_key_columns(keys), F.col("event_count_window").alias("key_events"))
    return lookup_join(events, lookup, KEYS, weight="key_events", spread_by=[row_key]).drop("key_events")


def _negative() -> Column:
    return ~labels.base_positive(F.col("event_type"), F.col("alert"))


def _conversion_order(row_key: str) -> Column:
    """Earliest first, then row hash."""
    return F.struct(
        F.unix_millis("ts").alias("at"), hash60(F.col(row_key)).alias("hash"), F.col(row_key).alias("row")
    )


def with_cutoffs(events: DataFrame, keys: DataFrame, row_key: str = "row_id") -> DataFrame:
    """Allocated keys plus ``cut``: the last row that converts, for keys covered in part.

    Keys whose allocation covers all their rows, or none, need no ordering.  The greedy
    budget leaves at most one key in between; only its rows are read and ranked, by
    milliseconds of their own window and then by row hash.
    """
    partial = keys.where(
        (F.col("Target_refined_for_no_alert") == 1)
        & (F.col("alloc") > 0)
        & (F.col("alloc") < F.col("no_alert_count_window"))
    ).select(*KEYS, F.col("alloc").alias("quota"), F.col("no_alert_count_window").alias("rows"))
    order = _conversion_order(row_key)
    found = partial.limit(_MAX_LISTED_KEYS + 1).collect()
    if not found:
        cut_type = events.select(order.alias("cut")).schema["cut"].dataType
        return keys.withColumns({"cut": F.lit(None).cast(cut_type), "cut_copies": F.lit(None).cast("bigint")})
    listed = len(found) <= _MAX_LISTED_KEYS
    if listed:
        partial = F.broadcast(events.sparkSession.createDataFrame(found, partial.schema))
    rows = (
        events.select(*KEYS, "ts", row_key, "event_type", "alert")
        .join(partial, list(KEYS))
        .where(_negative())
        .select(*KEYS, "quota", "ts", row_key, order.alias("cut"))
    )
    # Lines can be shipped twice, so an order position may hold several rows.
    positions = rows.groupBy(*KEYS, "cut").agg(F.count(F.lit(1)).alias("there"), F.first("quota").alias("quota"))
    if listed and all(r["rows"] <= DIRECT_RANK_ROWS for r in found):
        order = Window.partitionBy(*KEYS).orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
        positions = positions.withColumn("left", F.col("quota") - F.coalesce(F.sum("there").over(order), F.lit(0)))
        cuts = positions.where((F.col("left") > 0) & (F.col("left") <= F.col("there")))
    else:
        taken = take_prefix(
            rows.drop("quota"),
            group=KEYS,
            quota=partial.select(*KEYS, "quota"),
            levels=[F.unix_millis("ts"), *hash_levels(hash60(F.col(row_key)))],
            tie=[F.col("cut")],
        )
        taken = taken.groupBy(*KEYS, "cut").agg(F.count(F.lit(1)).alias("left"))
        last = taken.groupBy(*KEYS).agg(F.max(F.struct("cut", "left")).alias("last")).select(*KEYS, "last.*")
        cuts = last.join(positions.select(*KEYS, "cut", "there"), [*KEYS, "cut"])
    copies = F.when(F.col("left") < F.col("there"), F.col("left")).cast("bigint")
    cuts = cuts.select(*KEYS, "cut", copies.alias("cut_copies"))
    return keys.join(broadcast_if_small(cuts, _MAX_LISTED_KEYS), list(KEYS), "left")


# Partly covered keys beyond this number are joined by shuffle instead of from a list.
_MAX_LISTED_KEYS = 1_000


def mark_converted(attached: DataFrame, keys: DataFrame, row_key: str = "row_id") -> DataFrame:
    """``attached`` plus ``converted``: 1 converts, 0 was cut by the cap, null is not up for conversion.

    A row-local test, except where a key's cap falls between rows that repeat one line: those
    are counted off.  ``keys`` says whether there are any.
    """
    contested = _negative() & F.coalesce(F.col("key_target") == 1, F.lit(False))
    position = _conversion_order(row_key)
    inside = F.col("cut").isNull() | (position <= F.col("cut"))
    flag = F.when(contested, ((F.col("alloc") > 0) & inside).cast("int"))
    if keys.where(F.col("cut_copies").isNotNull()).isEmpty():
        return attached.withColumn("converted", flag).drop("cut_copies")
    at_cut = contested & F.col("cut_copies").isNotNull() & F.coalesce(position == F.col("cut"), F.lit(False))
    place = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.xxhash64(F.col(row_key))))
    shared = attached.where(at_cut).withColumn("__n", place)
    shared = shared.withColumn("converted", (F.col("__n") <= F.col("cut_copies")).cast("int")).drop("__n")
    return attached.where(~at_cut).withColumn("converted", flag).unionByName(shared).drop("cut_copies")


def cap_conversions(events: DataFrame, keys: DataFrame, row_key: str = "row_id") -> DataFrame:
    """Key outcome on every event, with each key limited to its ``alloc`` conversions."""
    capped = with_cutoffs(events, keys, row_key)
    return mark_converted(attach_keys(events, capped, row_key), capped, row_key)


def final_labels(events: DataFrame) -> DataFrame:
    """Target columns, label source and reason per event.

    Alert evidence always wins.  A row cut by the cap keeps the suspicious flag and its
    source text but target 0.
    """
    event_type, alert = F.col("event_type"), F.col("alert")
    valid = labels.alert_strict(alert)
    positive = labels.base_positive(event_type, alert)
    keyed = F.col("key_source").isNotNull()
    key_target = F.coalesce(F.col("converted"), F.col("key_target")) if "converted" in events.columns else F.col("key_target")
    refined = F.when(positive, 1).when(keyed, key_target).otherwise(0).cast("int")
    return events.withColumns(
        {
            "Target_alert": positive.cast("int"),
            "Target_refined": refined,
            "Target": refined,
            "suspicious_by_probe": F.when(positive, 0).when(keyed, F.col("key_suspicious")).otherwise(0).cast("int"),
            "label_source": F.when(valid, "alert_confirmed")
            .when(positive, "event_type_alert_confirmed")
            .when(keyed, F.col("key_source"))
            .otherwise("benign_no_evidence"),
            "refinement_reason": F.when(valid, "valid_suricata_alert")
            .when(positive, "event_type_alert_policy")
            .when(keyed, F.col("key_reason"))
            .otherwise("no_alert_or_probe_refinement_key"),
        }
    )


def conversion_report(labelled: DataFrame) -> DataFrame:
    """Rows converted and rows cut by the cap, against all no-alert rows."""
    converted = F.count_if(F.col("converted") == 1)
    negatives = F.count_if(F.col("Target_alert") == 0)
    return labelled.agg(
        negatives.alias("no_alert_rows"),
        converted.alias("rows_converted"),
        F.count_if(F.col("converted") == 0).alias("rows_capped"),
        F.coalesce(F.try_divide(converted * 100.0, negatives), F.lit(0.0)).alias("converted_pct"),
    )


def refine_labels(
    events: DataFrame,
    records: DataFrame,
    probe: ProbeSettings = ProbeSettings(),
    budget: BudgetSettings = BudgetSettings(),
    row_key: str = "row_id",
) -> DataFrame:
    """Cascade, budget, cap and labels in one call; ``records`` come from ``probe_records``.

    Windows, key outcomes and cutoffs are joined to one another first (all small next to
    the events), so the events themselves are joined once.
    """
    keys = cut_lineage(converting_keys(refinement_keys(records, probe), budget), "refinement-keys")
    keyed = keyed_events(events, probe.window_minutes)
    total = _total_no_alert(records)
    capped = budget.enforce and total > 0
    if capped:
        rows = int(total * budget.max_conversion_pct / 100.0)
        allocated = allocate_budget(keys, rows, budget).unionByName(
            keys.where(F.col("Target_refined_for_no_alert") == 0).withColumn("alloc", F.lit(0).cast("bigint"))
        )
        keys = with_cutoffs(keyed, cut_lineage(allocated, "budget"), row_key)
    lookup = cut_lineage(
        records.select(*KEYS, *PROBE_INT_COLUMNS, *PROBE_DOUBLE_COLUMNS).join(
            keys.select(*KEYS, *_key_columns(keys)), list(KEYS), "left"
        ),
        "window-lookup",
    )
    joined = _zero_outside(lookup_join(keyed, lookup, KEYS, weight="event_count_window", spread_by=[row_key]))
    return final_labels(mark_converted(joined, lookup, row_key) if capped else joined)
