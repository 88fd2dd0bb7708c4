"""Application names, alert evidence and base labels.

Event frames carry ``alert`` as a struct of text fields that is null when the record has no
alert object, with ``alert.empty`` marking an object without any key.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowsieve.functions.scalars import lenient_int

# Alert categories that are decoder noise, not evidence.
IGNORED_CATEGORIES = ("generic protocol decode", "generic protocol command decode")

# The four base-label rules.
LABEL_MODES = ("valid_alert", "event_type_alert", "event_type_or_valid_alert", "alert_object")


def normalize_app(value: Column) -> Column:
    """Lower-case name with every run of other characters squeezed to one underscore."""
    text = F.lower(F.trim(F.coalesce(value.cast("string"), F.lit(""))))
    return F.btrim(F.regexp_replace(text, r"[^a-z0-9]+", "_"), F.lit("_"))


def normalize_category(value: Column) -> Column:
    return F.lower(F.trim(F.coalesce(value.cast("string"), F.lit(""))))


def is_event_type_alert(event_type: Column) -> Column:
    return F.lower(F.trim(F.coalesce(event_type, F.lit("")))) == F.lit("alert")


def has_alert_object(alert: Column) -> Column:
    return alert.isNotNull()


def has_nonempty_alert(alert: Column) -> Column:
    return alert.isNotNull() & ~F.coalesce(alert.getField("empty"), F.lit(False))


def ignored_category(alert: Column) -> Column:
    return alert.isNotNull() & normalize_category(alert.getField("category")).isin(*IGNORED_CATEGORIES)


def severity_present(alert: Column) -> Column:
    return F.coalesce(F.trim(alert.getField("severity")) != F.lit(""), F.lit(False))


def alert_present(alert: Column) -> Column:
    """Routing-stage rule: severity is there at all and the category counts."""
    return severity_present(alert) & ~ignored_category(alert)


def alert_strict(alert: Column) -> Column:
    """Later-stage rule: severity is a whole number above zero and the category counts."""
    return alert.isNotNull() & (lenient_int(alert.getField("severity")) > 0) & ~ignored_category(alert)


def base_positive(event_type: Column, alert: Column) -> Column:
    """Evidence used by windows, refinement and export alike."""
    return is_event_type_alert(event_type) | alert_strict(alert)


def base_label(mode: str, event_type: Column, alert: Column) -> Column:
    """0/1 routing-stage label under one of ``LABEL_MODES``."""
    typed = normalize_app(event_type) == F.lit("alert")
    rules = {
        "valid_alert": alert_present(alert),
        "event_type_alert": typed,
        "event_type_or_valid_alert": typed | alert_present(alert),
        "alert_object": has_alert_object(alert),
    }
    if mode not in rules:
        raise ValueError(f"label mode must be one of {LABEL_MODES}, got {mode!r}")
    return rules[mode].cast("int")
