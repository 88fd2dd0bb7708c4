"""Cross-validation and learning curves of Gaussian naive Bayes from one pass of class statistics.

A training set of a learning curve is all folds but one, cut to a prefix of the rows' hash range.  Rows are
aggregated once by (fold, prefix cell, class) into count, means and variances; the statistics of every training set
are merged from those few rows, so neither folds nor fractions cost another scan.  A second pass scores each row
under all models at once and counts confusions.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.hashing import seeded_hash60
from flowsieve.operators.sampling import stratified_folds
from flowsieve.session import cut_lineage

FRACTIONS = (0.2, 0.4, 0.6, 0.8, 1.0)
# Variances are widened by this share of the largest one.
SMOOTHING = 1e-9
TINY = 1e-300


@dataclass(frozen=True)
class Moments:
    """Count, mean and summed squared deviation of each feature; two of them merge without a loss of digits."""

    n: int
    mean: tuple[float, ...]
    squares: tuple[float, ...]

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        share = other.n / n
        apart = [b - a for a, b in zip(self.mean, other.mean)]
        mean = tuple(a + d * share for a, d in zip(self.mean, apart))
        squares = tuple(a + b + d * d * self.n * share for a, b, d in zip(self.squares, other.squares, apart))
        return Moments(n, mean, squares)


def folded_rows(df: DataFrame, features: Sequence[str], label: str, key: str, folds: int, fractions: Sequence[float], seed: int) -> DataFrame:
    """``label, x, fold, part``: a row belongs to the prefixes of fractions from ``part`` on."""
    position = seeded_hash60(seed + 1, F.col(key)) / F.lit(float(2**60))
    part = sum(((position >= f).cast("int") for f in sorted(fractions)), F.lit(0))
    x = F.array(*[F.col(f).cast("double") for f in features])
    folded = stratified_folds(df.select(key, label, *features), label=label, key=key, folds=folds, seed=seed)
    return folded.select(F.col(label).alias("label"), x.alias("x"), "fold", part.alias("part"))


def class_moments(rows: DataFrame, width: int) -> dict[tuple[int, int, int], Moments]:
    """Moments by (fold, part, class): folds x fractions x classes rows reach the driver."""
    columns = [c for i in range(width) for c in (F.avg(F.col("x")[i]).alias(f"m{i}"), F.var_pop(F.col("x")[i]).alias(f"v{i}"))]
    found = rows.groupBy("fold", "part", "label").agg(F.count(F.lit(1)).alias("n"), *columns).collect()
    return {
        (r.fold, r.part, r.label): Moments(r.n, tuple(r[f"m{i}"] for i in range(width)), tuple(r[f"v{i}"] * r.n for i in range(width))) for r in found
    }


def models_of(moments: dict[tuple[int, int, int], Moments], folds: int, fractions: Sequence[float]) -> list[tuple]:
    """``(step, fold, rows, classes)`` of each training set; a class is (label, constant, means, halved inverse variances)."""
    out = []
    for step in range(len(fractions)):
        for fold in range(folds):
            merged: dict[int, Moments] = {}
            for (f, part, label), found in sorted(moments.items()):
                if f != fold and part <= step:
                    merged[label] = merged[label] + found if label in merged else found
            if not merged:
                continue
            everything = list(merged.values())
            whole = everything[0]
            for other in everything[1:]:
                whole = whole + other
            wider = SMOOTHING * max(s / (whole.n - 1) for s in whole.squares) if whole.n > 1 else 0.0
            classes = []
            for label, m in merged.items():
                variances = [max(s / m.n + wider, TINY) for s in m.squares]
                constant = math.log(m.n / whole.n) - 0.5 * sum(map(math.log, variances))
                classes.append((label, constant, m.mean, tuple(1 / (2 * v) for v in variances)))
            out.append((step, fold, whole.n, classes))
    return out


def _predicted(x: np.ndarray, classes: list[tuple]) -> np.ndarray:
    """The class with the highest posterior, the smallest of equals; rows of ``x`` without a value have no posterior."""
    best, found = None, None
    for label, constant, means, inverse in sorted(classes):
        spread = np.zeros(len(x))
        for i, (m, v) in enumerate(zip(means, inverse)):
            spread += (x[:, i] - m) * (x[:, i] - m) * v
        score = constant - spread
        # What is no number is above all numbers, as in Spark's order.
        score = np.where(np.isnan(score), np.inf, score)
        if best is None:
            best, found = score, np.full(len(x), label)
        else:
            better = score > best
            best, found = np.where(better, score, best), np.where(better, label, found)
    return found


def confusions(rows: DataFrame, models: list[tuple]) -> DataFrame:
    """``step, fold, side, label, prediction, n`` for the train and validation rows of every model."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of one task, a few rows: all models score a batch at once."""
        total: Counter = Counter()
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            label, of_fold, part = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "fold", "part"))
            for step, fold, _, classes in models:
                prediction = _predicted(x, classes)
                valid = of_fold == fold
                # Rows outside the model's training set are not scored.
                for side, inside in (("valid", valid), ("train", ~valid & (part <= step))):
                    seen, n = np.unique(np.stack([label[inside], prediction[inside]]), axis=1, return_counts=True)
                    for (y, p), c in zip(seen.T.tolist(), n.tolist()):
                        total[(step, fold, side, y, p)] += c
        if total:
            columns = [*zip(*total), tuple(total.values())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    names = ["step", "fold", "side", "label", "prediction", "n"]
    types = [pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64()]
    whole = rows.select(F.col("label").cast("int").alias("label"), "x", "fold", "part")
    partial = whole.mapInArrow(counted, "step int, fold int, side string, label int, prediction int, n bigint")
    return partial.groupBy("step", "fold", "side", "label", "prediction").agg(F.sum("n").alias("n"))


def weighted_f1(counts: DataFrame, group: list[str]) -> DataFrame:
    """Support-weighted F1 per group from counts of (label, prediction)."""
    sides = F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"), F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("hit")),
    )
    classes = counts.select(*group, F.explode(sides).alias("s")).select(*group, "s.*").groupBy(*group, "class").agg(
        *[F.sum(c).cast("double").alias(c) for c in ("support", "predicted", "hit")]
    )
    # 2 hits over labels plus predictions is the F1 of a class.
    f1 = 2 * F.col("hit") / (F.col("support") + F.col("predicted"))
    return classes.groupBy(*group).agg((F.sum(f1 * F.col("support")) / F.sum("support")).alias("f1"))


def bayes_confusions(
    df: DataFrame, features: Sequence[str], *, label: str, key: str, folds: int = 5, fractions: Sequence[float] = FRACTIONS, seed: int = 42
) -> tuple[DataFrame, list[tuple]]:
    """Confusion counts of all folds and fractions, and the models."""
    fractions = sorted(fractions)
    rows = cut_lineage(folded_rows(df, features, label, key, folds, fractions, seed), "folded")
    models = models_of(class_moments(rows, len(features)), folds, fractions)
    return cut_lineage(confusions(rows, models), "confusions"), models


def bayes_curve(df: DataFrame, features: Sequence[str], *, label: str, key: str, folds: int = 5, fractions: Sequence[float] = FRACTIONS, seed: int = 42) -> DataFrame:
    """Weighted F1 on train prefix and validation fold per fraction, mean and deviation over the folds."""
    counts, models = bayes_confusions(df, features, label=label, key=key, folds=folds, fractions=fractions, seed=seed)
    f1 = weighted_f1(counts, ["step", "fold", "side"]).groupBy("step", "fold").pivot("side", ["train", "valid"]).agg(F.first("f1"))
    ordered = sorted(fractions)
    sizes = df.sparkSession.createDataFrame([(ordered[s], s, f, n) for s, f, n, _ in models], "fraction double, step int, fold int, train_rows bigint")
    return f1.join(F.broadcast(sizes), ["step", "fold"]).groupBy("fraction").agg(
        F.avg("train_rows").alias("train_rows"),
        F.avg("train").alias("train_mean"),
        F.stddev_pop("train").alias("train_std"),
        F.avg("valid").alias("valid_mean"),
        F.stddev_pop("valid").alias("valid_std"),
    )


def bayes_folds(df: DataFrame, features: Sequence[str], *, label: str, key: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Confusion counts and attack-class metrics of each validation fold."""
    counts, _ = bayes_confusions(df, features, label=label, key=key, folds=folds, fractions=(1.0,), seed=seed)
    valid = counts.where(F.col("side") == "valid")
    cells = {"tp": (1, 1), "fn": (1, 0), "fp": (0, 1), "tn": (0, 0)}
    found = valid.groupBy("fold").agg(
        *[F.sum(F.when(((F.col("label") == 1).cast("int") == y) & ((F.col("prediction") == 1).cast("int") == p), F.col("n")).otherwise(0)).alias(c) for c, (y, p) in cells.items()]
    )
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fn, fp, tn = (F.col(c) for c in cells)
    found = found.withColumns({"accuracy": share(tp + tn, tp + tn + fp + fn), "precision_attack": share(tp, tp + fp), "recall_attack": share(tp, tp + fn)})
    p, r = F.col("precision_attack"), F.col("recall_attack")
    return found.withColumn("f1_attack", F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)))
