"""Feature rankings and feature sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import PCA, Bucketizer, StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.operators.manifest import is_forbidden, unique_in_order
from flowsieve.operators.quantiles import exact_quantiles
from flowsieve.operators.models import balanced_weights, build_model
from flowsieve.session import cut_lineage

DEFAULT_BINS = 32


def _binned_equal_width(df: DataFrame, features: Sequence[str], label: str, bins: int) -> DataFrame:
    bounds = df.agg(
        *[F.min(F.col(f).cast("double")).alias(f"a{i}") for i, f in enumerate(features)],
        *[F.max(F.col(f).cast("double")).alias(f"b{i}") for i, f in enumerate(features)],
    ).first()

    def code(i: int, name: str) -> Column:
        low, high = bounds[f"a{i}"], bounds[f"b{i}"]
        if low is None or not high > low:
            return F.lit(0)
        step = F.floor((F.col(name).cast("double") - F.lit(low)) / F.lit((high - low) / bins))
        return F.least(F.lit(bins - 1), step).cast("int")

    return df.select(F.col(label).alias("label"), *[code(i, f).alias(f"b{i}") for i, f in enumerate(features)])


# Features whose cut points are found together.
_QUANTILE_FEATURES = 200


def _binned_quantile(df: DataFrame, features: Sequence[str], label: str, bins: int) -> DataFrame:
    """Bins between exact quantiles; equal cut points are one."""
    probs = [i / bins for i in range(1, bins)]
    points: dict[str, list[float]] = {}
    for start in range(0, len(features), _QUANTILE_FEATURES):
        some = features[start : start + _QUANTILE_FEATURES]
        values = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in some])
        long = df.select(F.explode(values).alias("x")).select("x.*")
        for row in exact_quantiles(long, "value", probs, ["feature"]).collect():
            points[row["feature"]] = [row[f"q{i}"] for i in range(len(probs))]
    out = df
    for i, name in enumerate(features):
        splits = [float("-inf"), *sorted(set(points.get(name, ()))), float("inf")]
        if len(splits) < 3:
            out = out.withColumn(f"b{i}", F.lit(0.0))
        else:
            out = Bucketizer(splits=splits, inputCol=name, outputCol=f"b{i}", handleInvalid="keep").transform(out)
    return out.select(F.col(label).alias("label"), *[f"b{i}" for i in range(len(features))])


def mutual_information(
    df: DataFrame, features: Sequence[str], label: str, bins: int = DEFAULT_BINS, method: str = "quantile"
) -> DataFrame:
    """Mutual information (nats) of each binned feature with the class, over all rows.

    A binned estimator on the full table in place of a nearest-neighbour estimator on a
    sample: the joint counts are at most features x bins x classes rows.
    """
    make = {"quantile": _binned_quantile, "width": _binned_equal_width}[method]
    binned = make(df, features, label, bins)
    pairs = F.array(
        *[F.struct(F.lit(f).alias("feature"), F.col(f"b{i}").cast("int").alias("bin")) for i, f in enumerate(features)]
    )
    joint = (
        binned.select("label", F.explode(pairs).alias("x"))
        .groupBy("x.feature", "x.bin", "label")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    by_bin = joint.groupBy("feature", "bin").agg(F.sum("n").alias("nb"))
    by_label = joint.groupBy("feature", "label").agg(F.sum("n").alias("nl"))
    total = joint.groupBy("feature").agg(F.sum("n").alias("nt"))
    term = (F.col("n") / F.col("nt")) * F.log(F.col("n") * F.col("nt") / (F.col("nb") * F.col("nl")))
    return (
        joint.join(by_bin, ["feature", "bin"])
        .join(by_label, ["feature", "label"])
        .join(total, "feature")
        .groupBy("feature")
        .agg(F.greatest(F.sum(term), F.lit(0.0)).alias("score"))
        .orderBy(F.col("score").desc(), "feature")
    )


def anova_f(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """One-way F statistic per feature from class means and variances; one pass."""
    columns = [F.count(F.lit(1)).alias("n")]
    for i, f in enumerate(features):
        x = F.col(f).cast("double")
        columns += [F.avg(x).alias(f"mean{i}"), F.var_pop(x).alias(f"var{i}")]
    wide = df.groupBy(label).agg(*columns)
    entries = F.array(
        *[
            F.struct(F.lit(f).alias("feature"), F.col(f"mean{i}").alias("mean"), F.col(f"var{i}").alias("var"))
            for i, f in enumerate(features)
        ]
    )
    long = wide.select("n", F.explode(entries).alias("x")).select("n", "x.*")
    totals = long.groupBy("feature").agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("classes"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand")
    )
    spread = long.join(totals, "feature").groupBy("feature", "rows", "classes").agg(
        F.sum(F.col("n") * (F.col("mean") - F.col("grand")) * (F.col("mean") - F.col("grand"))).alias("between"),
        F.sum(F.col("n") * F.col("var")).alias("within"),
    )
    f_value = F.try_divide(
        F.try_divide(F.col("between"), (F.col("classes") - 1).cast("double")),
        F.try_divide(F.col("within"), (F.col("rows") - F.col("classes")).cast("double")),
    )
    return spread.select("feature", F.coalesce(f_value, F.lit(0.0)).alias("score")).orderBy(F.col("score").desc(), "feature")


def variance_ranking(df: DataFrame, features: Sequence[str]) -> DataFrame:
    wide = df.agg(*[F.var_samp(F.col(f).cast("double")).alias(f"v{i}") for i, f in enumerate(features)])
    entries = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"v{i}").alias("score")) for i, f in enumerate(features)])
    return wide.select(F.explode(entries).alias("x")).select("x.*").orderBy(F.col("score").desc_nulls_last(), "feature")


def forest_importance(df: DataFrame, features: Sequence[str], label: str, trees: int = 120, seed: int = 42, depth: int = 10) -> list[tuple[str, float]]:
    """Random-forest importances, highest first."""
    weighted = balanced_weights(df, label)
    assembled = VectorAssembler(inputCols=list(features), outputCol="features").transform(weighted)
    forest = build_model("RFC", label=label, seed=seed, trees=trees, depth=depth)
    model = forest.fit(assembled)
    scores = model.featureImportances.toArray()
    return sorted(zip(features, (float(s) for s in scores)), key=lambda p: (-p[1], p[0]))


def recursive_elimination(
    df: DataFrame, features: Sequence[str], label: str, keep: int, trees: int = 80, seed: int = 42, depth: int = 10
) -> DataFrame:
    """Repeatedly drop the least important features of a forest until ``keep`` are left.

    Rank 1 is selected; each elimination round gets the next rank.  Only importances return
    to the driver between rounds.
    """
    step = max(1, min(5, len(features) // 10))
    alive = list(features)
    # Every round passes over the rows several times.
    df = cut_lineage(df.select(label, *features), "elimination")
    rounds: list[list[str]] = []
    while len(alive) > max(1, keep):
        ranked = forest_importance(df, alive, label, trees, seed, depth)
        cut = min(step, len(alive) - keep)
        dropped = [name for name, _ in ranked[-cut:]]
        rounds.append(dropped)
        alive = [f for f in alive if f not in dropped]
    rows = [(f, 1, True) for f in alive]
    for position, dropped in enumerate(reversed(rounds)):
        rows += [(f, position + 2, False) for f in dropped]
    return df.sparkSession.createDataFrame(rows, "feature string, ranking int, selected boolean").orderBy("ranking", "feature")


def fit_pca(df: DataFrame, features: Sequence[str], k: int | None = None) -> PipelineModel:
    """Standardise, then project on the first ``k`` components (all by default)."""
    from pyspark.ml import Pipeline

    size = min(k or len(features), len(features))
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(features), outputCol="raw_features"),
            StandardScaler(inputCol="raw_features", outputCol="scaled_features", withMean=True, withStd=True),
            PCA(k=size, inputCol="scaled_features", outputCol="features"),
        ]
    ).fit(df)


def explained_variance(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Share and running share of variance per component."""
    shares = [float(v) for v in model.stages[-1].explainedVariance.toArray()]
    rows, running = [], 0.0
    for i, share in enumerate(shares):
        running += share
        rows.append((i + 1, share, running))
    return df.sparkSession.createDataFrame(rows, "component int, explained double, cumulative double")


def components_for(model: PipelineModel, share: float = 0.95) -> int:
    """Fewest components whose variance shares reach ``share``."""
    running = 0.0
    values = model.stages[-1].explainedVariance.toArray()
    for i, value in enumerate(values):
        running += float(value)
        if running >= share - 1e-12:
            return i + 1
    return len(values)


def fit_pca_share(df: DataFrame, features: Sequence[str], share: float = 0.95) -> tuple[PipelineModel, int]:
    """PCA with just enough components for a variance share.

    The covariance is computed once for the full projection; a second fit would scan the
    data again, so the full model is kept and its output cut by ``take_components``.
    """
    model = fit_pca(df, features)
    return model, components_for(model, share)


def take_components(df: DataFrame, k: int, column: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorSlicer

    sliced = VectorSlicer(inputCol=column, outputCol="__cut", indices=list(range(k))).transform(df)
    return sliced.drop(column).withColumnRenamed("__cut", column)


def feature_sets(first: Sequence[str], second: Sequence[str], target: str) -> dict[str, list[str]]:
    """Intersection and union (first list's order first), after the guard."""
    a = [f for f in unique_in_order(first) if not is_forbidden(f, target)]
    b = [f for f in unique_in_order(second) if not is_forbidden(f, target)]
    return {"intersection": [f for f in a if f in set(b)], "union": unique_in_order([*a, *b])}


def feature_set_columns(df: DataFrame, first: str, second: str) -> DataFrame:
    """The same algebra on two array columns."""
    return df.withColumns(
        {
            "intersection": F.array_intersect(first, second),
            "union": F.array_union(first, second),
            "only_first": F.array_except(first, second),
        }
    )
