"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame functions only.

A sketch is the ``k`` smallest distinct 64-bit hashes of a text's word shingles, ascending.  The
sketch of a union is the ``k`` smallest of both sketches together, so parts may be sketched apart
and merged.  Two sketches give an estimate of resemblance and containment, one gives an estimate
of the number of distinct shingles; below ``k`` shingles all of these are exact.

An empty table gives no row; whole texts are read, however long.
A null text is empty and has an empty sketch; a text of fewer words than a shingle is one shingle.
Equal texts have equal sketches.  Two empty sketches resemble each other fully, an empty one is
contained in any.  ``with_next`` orders rows by id descending, null ids last, ties by the text's
hash; it reads ``doc_id`` and ``text`` only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.llm.common import stored

K = 128
SHINGLE = 5

# Rows of one range of ids, and the most ranges; the ranges' heads are broadcast.
RANGE_ROWS = 200
MAX_RANGES = 65_536

_BLANKS = " \t\n\x0b\f\r"


def add_sketch(rows: DataFrame, text: str, out: str, *, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """``rows`` with the sketch of column ``text``.

    Words are hashed once, a shingle's hash is that of its words' hashes.  The steps are separate
    projections because the inner ones are used once per shingle.
    """
    words, hashes = f"__{out}_words", f"__{out}_hashes"
    trimmed = F.trim(F.coalesce(F.col(text), F.lit("")), F.lit(_BLANKS))
    rows = rows.withColumn(words, F.split(trimmed, "[\\x20\\x09-\\x0D]+"))
    rows = rows.withColumn(hashes, F.transform(words, lambda w: F.xxhash64(w)))
    size = F.size(hashes)
    shingles = F.transform(
        F.sequence(F.lit(0), F.greatest(size - shingle, F.lit(0))),
        lambda i: F.xxhash64(*[F.get(F.col(hashes), i + j) for j in range(shingle)]),
    )
    empty = (size == 1) & (F.get(F.col(words), F.lit(0)) == "")
    nothing = F.array().cast("array<bigint>")
    sketch = F.when(empty, nothing).otherwise(F.slice(F.sort_array(F.array_distinct(shingles)), 1, k))
    return rows.withColumn(out, sketch).drop(words, hashes)


def merged(a: Column, b: Column, *, k: int = K) -> Column:
    """Sketch of the union."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_groups(rows: DataFrame, group: str, sketch: str, *, k: int = K) -> DataFrame:
    """``(group, sketch)``: the sketch of each group's union.  Ranks are cut before the shuffle, so a hot group sends ``k`` hashes per task."""
    hashes = rows.select(group, F.explode(sketch).alias("hash")).distinct()
    order = Window.partitionBy(group).orderBy("hash")
    lowest = hashes.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    found = lowest.groupBy(group).agg(F.sort_array(F.collect_list("hash")).alias(sketch))
    every, found = rows.select(F.col(group).alias("__group")).distinct(), found.withColumnRenamed(sketch, "__sketch")
    return every.join(found, F.col("__group").eqNullSafe(F.col(group)), "left").select(
        F.col("__group").alias(group), F.coalesce("__sketch", F.array().cast("array<bigint>")).alias(sketch)
    )


def resemblance(a: Column, b: Column, *, k: int = K) -> Column:
    """Estimated share of the union's shingles that both have."""
    union = merged(a, b, k=k)
    both = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union))


def distinct_shingles(a: Column, *, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below ``k``, else from the k-th smallest hash."""
    span = F.element_at(a, k).cast("double") + F.lit(2.0**63)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * F.lit(2.0**64) / span)


def containment(a: Column, b: Column, *, k: int = K) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has."""
    common = resemblance(a, b, k=k) * distinct_shingles(merged(a, b, k=k), k=k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), common / distinct_shingles(a, k=k)))


def as_text(sketch: Column) -> Column:
    """Sixteen hex digits per hash."""
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def _numbers(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _range_of(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` are at most ``value``, looked up in two steps."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    block = F.size(F.filter(_numbers([b[0] for b in blocks]), lambda e: e <= value))
    inside = F.split(F.element_at(F.split(F.lit(";".join(",".join(map(str, b)) for b in blocks)), ";"), block), ",")
    found = (block - 1) * step + F.size(F.filter(inside.cast("array<bigint>"), lambda e: e <= value))
    return F.when(block == 0, F.lit(0)).otherwise(found)


def with_next(docs: DataFrame, *, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, text, sketch, next_text, next_sketch)``: every row beside the next in descending order of id.

    The row after the last is the first.  Ids are cut into ranges of about equal size; every range is
    ordered by itself, with the first row of the range that follows as its guest.  Whole
    texts are shuffled once.
    """
    ids = docs.select("doc_id")
    n = ids.count()
    ranges = max(1, min(MAX_RANGES, n // RANGE_ROWS))
    bounds: list[int] = []
    if ranges > 1:
        shares = [i / ranges for i in range(1, ranges)]
        found = ids.agg(F.percentile_approx("doc_id", shares, max(10_000, 8 * ranges))).first()[0] or []
        bounds = sorted(set(found))
    rows = docs.select(
        "doc_id",
        F.coalesce("text", F.lit("")).alias("text"),
        F.xxhash64("text").alias("tie"),
        F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(_range_of(F.col("doc_id"), bounds)).alias("range"),
    )
    heads = rows.groupBy("range").agg(F.max(F.struct("doc_id", "tie")).alias("head"))
    # One row per range.  The head of a range is the guest of the one above it, the very first row that of the lowest.
    upward = Window.orderBy("range")
    heads = heads.select(
        F.col("range").alias("home"),
        F.coalesce(F.lead("range").over(upward), F.first("range").over(upward)).alias("visits"),
        F.col("head.doc_id").alias("head_id"),
        F.col("head.tie").alias("head_tie"),
    )
    guests = rows.join(
        F.broadcast(stored(heads)),
        (F.col("range") == F.col("home")) & F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("tie") == F.col("head_tie")),
    )
    guests = guests.groupBy("visits").agg(*[F.first(c).alias(c) for c in ("doc_id", "text", "tie")])
    guests = guests.select("doc_id", "text", "tie", F.col("visits").alias("range"), F.lit(True).alias("guest"))
    placed = rows.withColumn("guest", F.lit(False)).unionByName(guests).repartition("range")
    placed = add_sketch(placed, "text", "sketch", k=k, shingle=shingle)
    order = Window.partitionBy("range").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.col("tie").desc())
    placed = placed.withColumns(
        {"next_text": F.lead("text").over(order), "next_sketch": F.lead("sketch").over(order)}
    )
    return placed.where(~F.col("guest")).select("doc_id", "text", "sketch", "next_text", "next_sketch")


def fingerprints(docs: DataFrame, *, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Sketches of every text and of its edited text: the last half replaced by the start of the next document."""
    rows = with_next(docs, k=k, shingle=shingle).withColumn("n_chars", F.char_length("text").cast("bigint"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half),
        F.substring(F.col("next_text"), F.lit(1), half),
    )
    rows = rows.withColumn("edited", edited).drop("text", "next_text")
    rows = add_sketch(rows, "edited", "edited_sketch", k=k, shingle=shingle)
    return rows.withColumn("edited_sha256", F.sha2(F.col("edited"), 256)).drop("edited")
