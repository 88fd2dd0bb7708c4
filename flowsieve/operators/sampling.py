"""Train/test splits and samples that do not depend on partitioning.

Every selection orders rows by a seeded hash of a row key.  Selecting k rows keeps the k
smallest, so samples nest and repeat exactly on any cluster.  A key may repeat, as in logs that
ship lines twice: a limit that falls between rows of one key takes as many of them as are missing.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.hashing import seeded_hash60, unit_interval
from flowsieve.functions.scalars import iso_utc
from flowsieve.operators.allocate import flag_quota, rank_in_group
from flowsieve.operators.quantiles import exact_quantiles

TRAIN, TEST = "train", "test"


def row_key(df: DataFrame) -> Column:
    """Content hash for tables without a key; equal rows share it, and selections count them."""
    return F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).cast("binary"))


def _side(position: Column, train_ratio: float) -> Column:
    return F.when(position < min(1.0, max(0.0, train_ratio)), TRAIN).otherwise(TEST)


def group_hash_split(
    df: DataFrame,
    *,
    seed: int,
    train_ratio: float = 0.8,
    keys: Sequence[str] = ("application", "window_start", "src_ip"),
    fallback: Sequence[str] = ("dest_ip", "row_id"),
) -> DataFrame:
    """All rows of one key tuple land on the same side; row-local, no shuffle.

    Blank key parts are skipped; a row without any part uses the first non-blank fallback.
    """

    def part(name: str) -> Column:
        c = F.col(name)
        text = iso_utc(c) if dict(df.dtypes)[name].startswith("timestamp") else c.cast("string")
        return F.when(F.trim(text) != "", text)

    joined = F.nullif(F.concat_ws("|", *[part(k) for k in keys]), F.lit(""))
    key = F.coalesce(joined, *[part(f) for f in fallback])
    return df.withColumn("split", _side(unit_interval(seed, key), train_ratio))


def row_hash_split(df: DataFrame, *, seed: int, train_ratio: float = 0.8, parts: Sequence[str] = ("src_ip", "timestamp", "row_id")) -> DataFrame:
    key = F.concat_ws(":", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts])
    return df.withColumn("split", _side(unit_interval(seed, key), train_ratio))


def time_hash_split(df: DataFrame, *, seed: int, train_ratio: float = 0.8, parts: Sequence[str] = ("timestamp", "row_id")) -> DataFrame:
    """Row hash over the timestamp text: a random split under its own name."""
    key = F.concat_ws(":", F.lit("time"), *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts])
    return df.withColumn("split", _side(unit_interval(seed, key), train_ratio))


def time_split(df: DataFrame, *, ts: str = "ts", train_ratio: float = 0.8) -> DataFrame:
    """Train is everything before the exact time quantile; rows without a time go to test."""
    micros = df.select(F.unix_micros(ts).cast("double").alias("t"))
    cut = exact_quantiles(micros, "t", [train_ratio]).first()
    if cut is None:
        return df.withColumn("split", F.lit(TEST))
    before = F.unix_micros(ts) < F.lit(math.ceil(cut["q0"])).cast("bigint")
    return df.withColumn("split", F.when(F.coalesce(before, F.lit(False)), TRAIN).otherwise(TEST))


def class_counts(df: DataFrame, label: str) -> dict:
    return {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}


def _largest_remainder(counts: dict, share: float) -> dict:
    """Whole-number quota per class that adds up to the rounded-up total share."""
    total = math.ceil(sum(counts.values()) * share - 1e-9)
    exact = {c: n * share for c, n in counts.items()}
    quota = {c: math.floor(x + 1e-9) for c, x in exact.items()}
    rest = total - sum(quota.values())
    for c in sorted(counts, key=lambda c: (-(exact[c] - quota[c]), str(c)))[: max(0, rest)]:
        quota[c] += 1
    return quota


def _hash_and_key(seed: int, key: str) -> dict:
    return {"hash60": seeded_hash60(seed, F.col(key)), "key": F.col(key)}


def stratified_split(df: DataFrame, *, label: str, key: str, test_share: float = 0.3, seed: int = 42) -> DataFrame:
    """Exact per-class test share."""
    quota = _largest_remainder(class_counts(df, label), test_share)
    flagged = flag_quota(df, quota=quota, group=label, out="__test", **_hash_and_key(seed, key))
    return flagged.withColumn("split", F.when(F.col("__test"), TEST).otherwise(TRAIN)).drop("__test")


def undersample(df: DataFrame, *, label: str, key: str, seed: int = 42) -> DataFrame:
    """Every class cut to the size of the smallest one."""
    counts = class_counts(df, label)
    return class_sample(df, label=label, key=key, per_class=min(counts.values(), default=0), seed=seed)


def uniform_sample(df: DataFrame, k: int, *, key: str, seed: int = 42) -> DataFrame:
    """Exactly ``k`` rows (or all), whatever the class."""
    return flag_quota(df, quota=max(0, int(k)), out="__in", **_hash_and_key(seed, key)).where("__in").drop("__in")


def class_sample(df: DataFrame, *, label: str, key: str, per_class: int | dict, seed: int = 42) -> DataFrame:
    """Up to ``per_class`` rows of each class."""
    return flag_quota(df, quota=per_class, group=label, out="__in", **_hash_and_key(seed, key)).where("__in").drop("__in")


SAMPLING_STRATEGIES = ("balanced", "stratified", "natural")


def quota_sample(df: DataFrame, k: int, *, label: str, key: str, strategy: str = "balanced", per_class: int | None = None, seed: int = 42) -> DataFrame:
    """Class quota for balanced and stratified sampling, plain ``k`` rows for natural."""
    if strategy not in SAMPLING_STRATEGIES:
        raise ValueError(f"strategy must be one of {SAMPLING_STRATEGIES}, got {strategy!r}")
    if strategy == "natural":
        return uniform_sample(df, k, key=key, seed=seed)
    return class_sample(df, label=label, key=key, per_class=per_class or max(1, k // 2), seed=seed)


def sample_report(df: DataFrame, sample: DataFrame, *, label: str, requested: int) -> DataFrame:
    """Rows seen, kept and missing per class."""
    seen = df.groupBy(label).agg(F.count(F.lit(1)).alias("seen"))
    kept = sample.groupBy(label).agg(F.count(F.lit(1)).alias("kept"))
    return (
        seen.join(kept, label, "left")
        .select(label, F.lit(requested).cast("bigint").alias("requested"), "seen", F.coalesce("kept", F.lit(0)).alias("kept"))
        .withColumns(
            {
                "shortfall": F.greatest(F.lit(0).cast("bigint"), F.col("requested") - F.col("kept")),
                "quota_satisfied": F.col("kept") >= F.col("requested"),
            }
        )
    )


def dual_holdout(df: DataFrame, *, label: str, key: str, natural_rows: int, per_class_rows: int, seed: int = 42) -> DataFrame:
    """Natural and balanced holdout as two flags on the same rows.

    Each flag takes an aggregate of its own to find its limits; the flags themselves are row-local.
    """
    flagged = flag_quota(df, quota=natural_rows, out="in_natural", **_hash_and_key(seed, key))
    return balanced_flag(flagged, label=label, key=key, per_class_rows=per_class_rows, seed=seed)


def balanced_flag(df: DataFrame, *, label: str, key: str, per_class_rows: int, seed: int = 42) -> DataFrame:
    """The balanced holdout alone, ``in_balanced``: up to ``per_class_rows`` rows of each class."""
    return flag_quota(df, quota=per_class_rows, group=label, out="in_balanced", **_hash_and_key(seed + 1000, key))


def stratified_folds(df: DataFrame, *, label: str, key: str, folds: int, seed: int = 42) -> DataFrame:
    """Fold number per row; every class is spread over the folds as evenly as possible."""
    order = _hash_and_key(seed, key)
    ranked = rank_in_group(df, group=[label], hash60=order["hash60"], tie=[order["key"]], out="__rank")
    return ranked.withColumn("fold", F.pmod("__rank", F.lit(folds)).cast("int")).drop("__rank")


def distribution(df: DataFrame, label: str) -> DataFrame:
    """Rows and percentage per (split, class) and over all splits."""
    counts = df.groupBy("split", label).agg(F.count(F.lit(1)).alias("count"))
    both = counts.unionByName(counts.groupBy(F.lit("all").alias("split"), label).agg(F.sum("count").alias("count")))
    totals = both.groupBy("split").agg(F.sum("count").alias("total"))
    name = F.when(F.col(label) == 1, "attack").otherwise("benign")
    return both.join(totals, "split").select(
        "split", name.alias("label"), "count", (F.col("count") * 100.0 / F.col("total")).alias("ratio_percent")
    )


def coverage_warnings(df: DataFrame, label: str) -> DataFrame:
    """Empty splits and splits with one class only."""
    counts = {
        (r["split"], r[label]): r["n"]
        for r in df.groupBy("split", label).agg(F.count(F.lit(1)).alias("n")).collect()
    }
    every = {c for _, c in counts}
    rows = []
    for split in (TRAIN, TEST):
        classes = {c for s, c in counts if s == split}
        size = sum(n for (s, _), n in counts.items() if s == split)
        warning = "empty" if not size else "one_class" if len(classes) < 2 else ""
        rows.append((split, size, len(classes), every <= classes, warning))
    rows.append(("all", sum(counts.values()), len(every), len(every) >= 2, "" if len(every) >= 2 else "one_class"))
    return df.sparkSession.createDataFrame(rows, "split string, rows bigint, classes int, coverage_ok boolean, warning string")


def class_summary(df: DataFrame, label: str) -> DataFrame:
    """Rows, benign and attack per split and for the whole table."""
    per_split = df.groupBy(F.col("split").alias("role")).agg(
        F.count(F.lit(1)).alias("data_rows"), F.count_if(F.col(label) == 0).alias("benign"), F.count_if(F.col(label) == 1).alias("attack")
    )
    total = per_split.agg(*[F.sum(c).alias(c) for c in ("data_rows", "benign", "attack")]).select(
        F.lit("dataset_total").alias("role"), "data_rows", "benign", "attack"
    )
    return per_split.unionByName(total).withColumns(
        {
            "benign_ratio": F.coalesce(F.try_divide(F.col("benign").cast("double"), F.col("data_rows").cast("double")), F.lit(0.0)),
            "attack_ratio": F.coalesce(F.try_divide(F.col("attack").cast("double"), F.col("data_rows").cast("double")), F.lit(0.0)),
        }
    )
