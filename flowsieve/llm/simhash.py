"""SimHash near-duplicates, candidates found by pigeonring chains.

A fingerprint is cut into four 16-bit segments on a ring.  If two fingerprints differ in at
most 3 bits, then from some start the differences summed over 1, 2, 3, 4 consecutive segments
are at most 0, 1, 2, 3.  So a chain begins with an equal segment and a next one that
differs in one bit at most, of which one byte is equal: eight 24-bit keys (start, segment,
byte) find every pair, and the cumulative budgets prune it before the full check.

Few rows share a key unless texts are near copies.  Keys with many fingerprints are dealt as
pairs of blocks; each block pair is compared in one numpy step and returns a spanning forest of
its links, at most one link per fingerprint, never all pairs.

An empty table gives no row; whole texts are read, however long.  Only ``doc_id`` and ``text`` are read.
Nulls and texts without words have fingerprint zero and are linked like any other.  Only
distinct fingerprints are compared, so copies cost one row.  Rows without an id take part
and get the smallest id of their group (null if no row there has one).
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.llm.common import components, stored

MAX_BITS = 3
SEGMENTS = 4
SHINGLE = 3
HASH_SEED = 42

# A key with more fingerprints than this is compared in blocks of about that many rows.
PAIRED_ROWS = 64
BLOCK_ROWS = 1024


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit fingerprint of one text, as a signed number."""
    # Bytes are lower-cased and split by ASCII rules only.
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(HASH_SEED)), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        block = hashes[i : i + 65_536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    @F.pandas_udf("bigint")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, shingle) for t in texts], dtype="int64")

    return prints(text)


def chain_keys(prints: DataFrame) -> DataFrame:
    """``(fp, start, key)``: the eight keys of each fingerprint."""
    rows = []
    for start in range(SEGMENTS):
        segment = f"shiftrightunsigned(fp, {16 * start}) & 65535"
        following = f"shiftrightunsigned(fp, {16 * ((start + 1) % SEGMENTS)}) & 65535"
        for half in (0, 1):
            byte = f"shiftrightunsigned({following}, {8 * half}) & 255"
            rows.append(
                f"struct(cast({start} as tinyint) as start, "
                f"cast({2 * start + half} as bigint) << 24 | ({segment}) << 8 | ({byte}) as key)"
            )
    return prints.select("fp", F.expr(f"inline(array({', '.join(rows)}))"))


def _within_budgets(max_bits: int) -> Column:
    """Cumulative differences from the chain's start stay in their proportional budgets."""
    test = F.lit(True)
    for length in range(2, SEGMENTS + 1):
        mask = 2 ** (16 * length) - 1 if length < SEGMENTS else -1
        turned = f"(shiftrightunsigned(x, 16 * start) | shiftleft(x, (64 - 16 * start) % 64)) & {mask}L"
        turned = f"case when start = 0 then x & {mask}L else {turned} end"
        test = test & (F.expr(f"bit_count({turned})") <= length * max_bits // SEGMENTS)
    return test


def _block_links(max_bits: int):
    def links(rows: pd.DataFrame) -> pd.DataFrame:
        prints = np.unique(rows["fp"].to_numpy(np.int64)).view(np.uint64)
        waiting = np.ones(len(prints), bool)
        found: list[tuple[int, int]] = []
        while waiting.any():
            first = int(np.argmax(waiting))
            waiting[first] = False
            reached = [first]
            while reached and waiting.any():
                at = reached.pop()
                left = np.flatnonzero(waiting)
                near = left[np.bitwise_count(prints[left] ^ prints[at]) <= max_bits]
                waiting[near] = False
                found += [(at, int(i)) for i in near]
                reached += near.tolist()
        pairs = prints.view(np.int64)[np.array(found, np.int64).reshape(-1, 2)]
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return links


def fingerprint_links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links ``(a, b)`` whose components are those of all pairs within ``max_bits``; ``prints(fp)`` is distinct."""
    if max_bits > MAX_BITS:
        raise ValueError("the chain keys cover at most 3 differing bits")
    keys = chain_keys(prints)
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    rows = stored(keys.join(shared, "key"))
    few = rows.where(F.col("n") <= PAIRED_ROWS)
    pairs = (
        few.select("key", "start", F.col("fp").alias("a"))
        .join(few.select("key", F.col("fp").alias("b")), "key")
        .where(F.col("a") < F.col("b"))
        .withColumn("x", F.col("a").bitwiseXOR(F.col("b")))
        .where(_within_budgets(max_bits))
        .select("a", "b")
    )
    blocks = F.ceil(F.col("n") / BLOCK_ROWS)
    many = rows.where(F.col("n") > PAIRED_ROWS).withColumn("mine", F.pmod(F.xxhash64("fp"), blocks))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    many = many.select(
        "fp", "key", F.least("mine", "other").alias("first"), F.greatest("mine", "other").alias("second")
    )
    dense = many.groupBy("key", "first", "second").applyInPandas(_block_links(max_bits), "a bigint, b bigint")
    return stored(pairs.union(dense).distinct())


def near_duplicates(docs: DataFrame, *, max_bits: int = MAX_BITS, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs``."""
    rows = stored(docs.select("doc_id", fingerprint(F.col("text"), shingle).alias("fp")))
    return with_components(rows, max_bits)


def with_components(rows: DataFrame, max_bits: int = MAX_BITS, keep: list[str] | None = None) -> DataFrame:
    """``rows(doc_id, fp)`` with the smallest id reachable over links, ``component_id``, and the group's ``root``."""
    prints = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("lowest")))
    roots = stored(components(fingerprint_links(prints.select("fp"), max_bits)))
    placed = prints.join(roots, prints["fp"] == roots["node"], "left").select(
        "fp", "lowest", F.coalesce("root", "fp").alias("root")
    )
    lowest = stored(placed.groupBy("root").agg(F.min("lowest").alias("component_id")))
    groups = stored(placed.join(lowest, "root").select("fp", "component_id", "root"))
    return rows.join(groups, "fp").select("doc_id", "fp", "component_id", "root", *(keep or []))


def keep_one(docs: DataFrame, *, max_bits: int = MAX_BITS, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: the one with the smallest id.

    Rows that repeat that id are one document each; the first by text and by the other columns stays.
    """
    every = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*every).alias("d"), F.xxhash64(*every).alias("row"))
    prints = stored(docs.select("doc_id", fingerprint(F.col("text"), shingle).alias("fp"), F.xxhash64(*every).alias("row")))
    groups = with_components(prints, max_bits, keep=["row"])
    # The smallest root stands for the group, so rows without an id are grouped as well.
    kept = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("kept"))
    kept = stored(kept.select(F.col("kept.row").alias("row")))
    twice = Window.partitionBy("row").orderBy("row")
    found = rows.join(kept, "row").withColumn("copy", F.row_number().over(twice)).where(F.col("copy") == 1)
    return found.select("d.*")
