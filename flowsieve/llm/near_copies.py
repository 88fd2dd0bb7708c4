"""Near copies by SimHash and by the similarity of their five-word shingles, for the pipeline.

Two texts are near copies if their fingerprints differ in at most three bits, found by the pigeonring chains of
``simhash``, or if their sets of shingles have a Jaccard similarity of 0.8 or more.
The fingerprints alone do not reach that limit: at 0.8 they differ in some ten bits of 64, and keys for so
many bits find everything.  Candidates for it come from minimum hashes, 32 bands of four: two
texts share a key with a probability of 1 - (1 - s**4)**32, so a pair at exactly 0.8 is missed
once in 21 million times, a closer one less often.  Every candidate is confirmed on the whole sets, so
no text is dropped for a shared key alone.  Groups are what the links of both kinds connect.

Texts with equal sets are one row from the start.  Keys with few sets give all pairs.  The sets of
other keys are dealt as pairs of blocks of bounded size; each is compared in one task, which returns a
spanning forest of its links, at most one link per set, never all pairs.

Words are split and lower-cased by ASCII rules; a text with fewer words than a shingle is one
shingle.  Nulls and texts without words have the empty set and are copies of each other.  Rows without an
id take part.  Only texts are compared; all columns are kept, whatever they are called.  An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.llm import simhash
from flowsieve.llm.common import components, stored, stored_table

SHINGLE = 5
# Least similarity, as a fraction so that the limit itself is met exactly.
SIMILAR = (4, 5)
BANDS = 32
BAND_HASHES = 4
HASH_SEED = 42

# A key with more sets than this is compared in blocks of about that many shingles.
PAIRED_SETS = 64
BLOCK_SHINGLES = 500_000
# Shingles hashed at a time.
BLOCK = 1024

_STEP = np.uint64(0xD1342543DE82EF95)
_RANDOM = np.random.default_rng(20_012).integers(0, 2**63, (2, BANDS * BAND_HASHES), dtype=np.uint64)
_FACTORS, _MASKS = _RANDOM * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    words = text.encode().lower().split() if text else []
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(HASH_SEED)), np.uint64, len(words))
    n = max(min(len(words), 1), len(words) - shingle + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(shingle, len(words))):
        out = out * _STEP + hashes[i : i + n]
    return np.unique(_mixed(out))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key per band, of the band's number and its minimum hashes; none for the empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    lowest = np.full(len(_FACTORS), 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), BLOCK):
        found = (hashes[i : i + BLOCK] ^ _MASKS[:, None]) * _FACTORS[:, None]
        np.minimum(lowest, found.min(axis=1), out=lowest)
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in lowest.reshape(BANDS, BAND_HASHES).T:
        keys = _mixed(keys * _STEP + column)
    return keys.view(np.int64)


def _set_id(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), HASH_SEED)).view(np.int64))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets reach the limit."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return SIMILAR[1] * both >= SIMILAR[0] * (len(a) + len(b) - both)


def sketched(text: Column) -> Column:
    """``set``, which is equal for texts with equal sets, its size ``n`` and its ``keys``."""

    @F.pandas_udf("set bigint, n bigint, keys array<bigint>")
    def sketch(texts: pd.Series) -> pd.DataFrame:
        sets = map(shingle_set, texts)
        return pd.DataFrame([(_set_id(s), len(s), band_keys(s)) for s in sets], columns=["set", "n", "keys"])

    return sketch(text)


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs(a, b)`` that reach the limit; ``sets(set, hashes)``."""

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            read = [[np.frombuffer(x, np.uint64) for x in batch[c]] for c in ("left", "right")]
            yield batch.loc[[similar(a, b) for a, b in zip(*read)], ["a", "b"]]

    left, right = (sets.select(F.col("set").alias(c), F.col("hashes").alias(side)) for c, side in (("a", "left"), ("b", "right")))
    return pairs.join(left, "a").join(right, "b").mapInPandas(near, "a bigint, b bigint")


def _forest(rows: pd.DataFrame) -> pd.DataFrame:
    """Links that connect what the similar pairs among ``rows(set, hashes)`` connect."""
    rows = rows.drop_duplicates("set")
    names, sets = rows["set"].to_numpy(np.int64), [np.frombuffer(x, np.uint64) for x in rows["hashes"]]
    sizes = np.array([len(s) for s in sets])
    distinct, places = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(places, np.cumsum(sizes)[:-1])
    marks = np.zeros(len(distinct), np.int32)
    waiting, left, found = np.ones(len(sets), bool), np.arange(len(sets)), []
    while waiting.any():
        first = int(np.argmax(waiting))
        waiting[first] = False
        reached = [first]
        while reached and waiting.any():
            if 2 * np.count_nonzero(waiting) <= len(left):
                left = np.flatnonzero(waiting)
                places = np.concatenate([own[i] for i in left])
            at = reached.pop()
            marks[own[at]] = 1
            both = np.add.reduceat(marks[places], np.cumsum(sizes[left]) - sizes[left])
            marks[own[at]] = 0
            near = left[waiting[left] & (SIMILAR[1] * both >= SIMILAR[0] * (sizes[left] + sizes[at] - both))]
            waiting[near] = False
            found += [(at, int(i)) for i in near]
            reached += near.tolist()
    pairs = names[np.array(found, np.int64).reshape(-1, 2)]
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def set_links(sketches: DataFrame, texts: DataFrame) -> DataFrame:
    """Links ``(a, b)`` whose components are those of all similar sets that share a key.

    ``sketches(set, row, n, keys)`` has a row per set, whose text is in one or more equal rows of ``texts(row, text)``.
    """
    keys = sketches.select("set", "n", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("shingles")).where("sets > 1")
    rows = stored(keys.join(shared, "key"))
    few, many = rows.where(F.col("sets") <= PAIRED_SETS), rows.where(F.col("sets") > PAIRED_SETS)

    @F.pandas_udf("binary")
    def whole(text: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t).tobytes() for t in text], dtype=object)

    other = few.select("key", F.col("set").alias("b"), F.col("n").alias("n_b"))
    pairs = few.select("key", F.col("set").alias("a"), F.col("n").alias("n_a")).join(other, "key").where("a < b")
    # The sizes must allow the limit.
    fits = SIMILAR[1] * F.least("n_a", "n_b") >= SIMILAR[0] * F.greatest("n_a", "n_b")
    pairs = stored(pairs.where(fits).select("a", "b").distinct())
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("set")).union(many.select("set")).distinct()
    # Whole texts are shuffled once; rows that repeat all columns are one text.
    wanted = stored(sketches.select("set", "row").join(wanted, "set"))
    sets = texts.join(wanted, "row").select("set", whole("text").alias("hashes")).groupBy("set").agg(F.first("hashes").alias("hashes"))
    sets = stored_table(sets, "shingle-sets")
    blocks = F.ceil(F.col("shingles") / BLOCK_SHINGLES)
    dealt = many.withColumn("mine", F.pmod(F.xxhash64("set"), blocks))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    dealt = dealt.select("set", "key", F.least("mine", "other").alias("first"), F.greatest("mine", "other").alias("second"))
    dense = dealt.join(sets, "set").groupBy("key", "first", "second").applyInPandas(_forest, "a bigint, b bigint")
    return stored(_confirmed(pairs, sets).union(dense).distinct())


def print_links(rows: DataFrame) -> DataFrame:
    """Links ``(a, b)`` from each set of ``rows(set, fp)`` to the smallest one its fingerprints reach within three bits."""
    grouped = simhash.with_components(rows.select(F.col("set").alias("doc_id"), "fp").distinct())
    return grouped.where("doc_id != component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near copies: the one with the smallest id.

    Rows that repeat that id are one document each; the first by text and by the other columns stays.
    """
    every = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*every).alias("d"), F.xxhash64(*every).alias("row"))
    text = F.col("text")
    marked = docs.select("doc_id", F.xxhash64(*every).alias("row"), sketched(text).alias("s"), simhash.fingerprint(text).alias("fp"))
    marked = stored_table(marked.select("doc_id", "row", "s.*", "fp"), "sketches")
    first = marked.groupBy("set").agg(F.min(F.struct("row", "n", "keys")).alias("one"))
    first = stored_table(first.select("set", "one.*"), "distinct-sketches")
    links = set_links(first, rows.select("row", F.col("d.text").alias("text")))
    roots = stored(components(links.union(print_links(marked))))
    groups = marked.select("doc_id", "row", "set").join(roots, F.col("set") == F.col("node"), "left")
    groups = groups.withColumn("root", F.coalesce("root", "set"))
    # The smallest root stands for the group, so rows without an id are grouped as well.
    kept = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("kept"))
    kept = stored(kept.select(F.col("kept.row").alias("row")))
    twice = Window.partitionBy("row").orderBy("row")
    found = rows.join(kept, "row").withColumn("copy", F.row_number().over(twice)).where(F.col("copy") == 1)
    return found.select("d.*")
