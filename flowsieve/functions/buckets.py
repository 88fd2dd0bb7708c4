"""Fixed-edge buckets for report histograms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowsieve.functions.scalars import lenient_double

# Upper edge (inclusive) and name of each decade bucket.
DECADES = (
    (0.0, "0"),
    (1.0, "0-1"),
    (10.0, "1-10"),
    (100.0, "10-100"),
    (1_000.0, "100-1K"),
    (10_000.0, "1K-10K"),
    (100_000.0, "10K-100K"),
    (1_000_000.0, "100K-1M"),
)
# Upper edge (exclusive) and name of each ratio bucket above zero.
QUARTERS = (
    (0.25, "0-0.25"),
    (0.50, "0.25-0.50"),
    (0.75, "0.50-0.75"),
    (1.00, "0.75-1.00"),
)
SCORE_FEATURES = ("probe_score_no_alert", "probe_score_with_alert")


def numeric_bucket(value: Column) -> Column:
    x = lenient_double(value)
    out = F.lit(">1M")
    for edge, name in reversed(DECADES):
        out = F.when(x <= edge, name).otherwise(out)
    return out


def ratio_bucket(value: Column) -> Column:
    x = lenient_double(value)
    out = F.lit(">=1.00")
    for edge, name in reversed(QUARTERS):
        out = F.when(x < edge, name).otherwise(out)
    return F.when(x <= 0, "0").otherwise(out)


def feature_bucket(feature: Column, value: Column) -> Column:
    """Ratio buckets for ratios and scores, decades for everything else."""
    ratio_like = feature.endswith("_ratio") | feature.isin(*SCORE_FEATURES)
    return F.when(ratio_like, ratio_bucket(value)).otherwise(numeric_bucket(value))
