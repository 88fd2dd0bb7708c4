"""Mixing sources to target weights by exact word budgets.

Rows get a hash-random key.  Equal key ranges (the leading bits) are the sorted parts of a
source; their word sums form a distributed prefix sum that names, per source, the one range
in which the budget ends.  Only the rows of that range are sorted, which gives the exact cut.
What is then applied to the documents is one row per source, so no text is shuffled.

Nulls: a null text has size 0, a null source is a source of its own and comes last, a null
id is ordered first.  Empty texts are never taken.  Rows that are equal in id, size and text
share the cut evenly, rounded down.  An empty table gives an empty mix.  Only ``doc_id``,
``source`` and ``text`` are read, other columns pass through and are never confused with
the operator's own, which replace columns of the same name.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.llm.common import WORD, stored, word_count
from flowsieve.operators.joins import broadcast_if_small

SHARE = 1.5
MOST_EPOCHS = 2
WEIGHTS = (5, 2, 1)
SEED = 20_011

_POSITION = ("__key", "__id", "__size", "__text")


def _narrow(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select(
        F.col("doc_id").alias("__id"),
        F.col("source").alias("__source"),
        word_count(F.col("text")).alias("__size"),
        F.xxhash64(F.lit(seed), F.col("doc_id")).alias("__key"),
        F.xxhash64(F.col("text")).alias("__text"),
    )


def source_targets(
    sizes: DataFrame, *, share: float = SHARE, epochs: int = MOST_EPOCHS, weights: Sequence[int] = WEIGHTS
) -> DataFrame:
    """``sizes(source, source_size)`` plus ``weight`` and ``target``.

    Weights repeat over the sources in code-point order.  Targets are weight times one level,
    stopped at ``epochs`` times the source; the level is such that they add up to ``share`` of
    all words.  Sources sorted by how early they stop show which level that is.  One row per
    source, hence one task.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), F.col("place") % len(weights) + 1)
    ranked = sizes.withColumn("place", F.row_number().over(place) - 1).withColumn("weight", weight)
    ranked = ranked.withColumn("most", F.lit(float(epochs)) * F.col("source_size"))
    stops = Window.orderBy(F.col("most") / F.col("weight"), "place")
    before = stops.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    ranked = ranked.withColumn(
        "level",
        (F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))),
    )
    # The first source that does not stop has the lowest most/weight among those that do not.
    level = F.min_by(
        "level", F.when(F.col("most") / F.col("weight") > F.col("level"), F.col("most") / F.col("weight"))
    ).over(every)
    return ranked.select(
        "source",
        "source_size",
        "weight",
        F.least(F.col("most"), F.coalesce(F.col("weight") * level, F.col("most"))).alias("target"),
    )


def mix_plan(docs: DataFrame, *, seed: int = SEED, **targets) -> DataFrame:
    """One row per source: its size, target, whole epochs, and the position of the exact cut."""
    rows = stored(_narrow(docs, seed))
    n = rows.count()
    # Ranges and rows in a range both grow with the square root of the table.
    bits = max(4, min(24, round(math.log2(n + 1) / 2) + 1))
    rows = rows.withColumn("__range", F.shiftright("__key", 64 - bits))
    sizes = rows.groupBy(F.col("__source").alias("source")).agg(F.sum("__size").alias("source_size"))
    plan = stored(
        source_targets(sizes, **targets)
        .withColumn(
            "epochs",
            F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)),
        )
        .withColumn("rest", F.floor("target").cast("bigint") - F.col("epochs") * F.col("source_size"))
    )
    bounded = broadcast_if_small(plan.select("source", "rest"))
    prefix = Window.partitionBy("__source").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("__source", "__range").agg(F.sum("__size").alias("words"))
    ranges = ranges.withColumn("before", F.coalesce(F.sum("words").over(prefix), F.lit(0)))
    last = (
        ranges.join(bounded, F.col("source").eqNullSafe(F.col("__source")))
        .where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words")))
        .select(F.col("source"), F.col("__range").alias("last"), (F.col("rest") - F.col("before")).alias("left"))
    )
    inside = rows.join(
        broadcast_if_small(stored(last)),
        F.col("source").eqNullSafe(F.col("__source")) & (F.col("__range") == F.col("last")),
    )
    inside = inside.groupBy("source", "left", *_POSITION).agg(F.count(F.lit(1)).alias("copies"))
    order = Window.partitionBy("source").orderBy(*_POSITION).rowsBetween(Window.unboundedPreceding, -1)
    words = F.col("__size") * F.col("copies")
    cut = (
        inside.withColumn("before", F.coalesce(F.sum(words).over(order), F.lit(0)))
        .where((F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + words))
        .select(
            F.col("source").alias("cut_source"),
            F.struct(*_POSITION).alias("cut"),
            F.floor((F.col("left") - F.col("before")) / F.col("copies")).alias("share"),
        )
    )
    return stored(
        plan.join(cut, F.col("source").eqNullSafe(F.col("cut_source")), "left").drop("cut_source", "rest")
    )


def apply_plan(docs: DataFrame, plan: DataFrame, *, seed: int = SEED) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``taken``: the words of each row the mix takes."""
    own = ["size", "source_size", "target", "taken"]
    kept = [F.col(f"d.`{c}`") for c in docs.columns if c not in own]
    placed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"),
        F.col("doc_id").alias("__id"),
        F.col("source").alias("__source"),
        word_count(F.col("text")).alias("__size"),
        F.xxhash64(F.lit(seed), F.col("doc_id")).alias("__key"),
        F.xxhash64(F.col("text")).alias("__text"),
    )
    here = F.struct(*_POSITION)
    last = F.when(here < F.col("cut"), F.col("__size")).when(here == F.col("cut"), F.col("share"))
    return placed.join(broadcast_if_small(plan), F.col("source").eqNullSafe(F.col("__source"))).select(
        *kept,
        F.col("__size").alias("size"),
        "source_size",
        "target",
        (F.col("__size") * F.col("epochs") + F.coalesce(last, F.lit(0))).cast("bigint").alias("taken"),
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """Every row with the words the mix takes of it, repeats counted."""
    return apply_plan(docs, mix_plan(docs, **options), seed=options.get("seed", SEED))


def mixed_copies(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, in the columns of ``docs``: a row per taken copy.

    A whole copy keeps its text.  The copy in which a source's budget ends holds the words
    taken of it, joined by spaces.  ``n_chars``, if there, follows the text.
    """
    taken = mix(docs.withColumn("__doc", F.struct(*[F.col(f"`{c}`") for c in docs.columns])), **options)
    taken = taken.where(F.col("taken") > 0).withColumn(
        "copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("taken") - 1) / F.col("size"))))
    )
    words = F.col("taken") - F.col("copy") * F.col("size")
    text = F.when(words >= F.col("size"), F.col("__doc.text")).otherwise(
        F.array_join(F.slice(F.regexp_extract_all(F.col("__doc.text"), F.lit(WORD), F.lit(0)), 1, words.cast("int")), " ")
    )
    taken = taken.withColumn("__text", text)
    replaced = {"text": F.col("__text"), "n_chars": F.char_length("__text").cast(dict(docs.dtypes).get("n_chars", "bigint"))}
    return taken.select(*[replaced.get(c, F.col(f"__doc.`{c}`")).alias(c) for c in docs.columns])
