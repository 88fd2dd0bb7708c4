"""Links between texts whose shingle sets have a Jaccard similarity of 0.9 or more, by a size-aware join.

Sets are light or heavy by size.  **Light** sets enumerate their subsets: two sets of a and b shingles
link if they share ceil(9 (a + b) / 19), so each set lists its subsets of just the sizes that a
link with some partner can ask for, and sharing one subset is a link.  A subset's sets are linked to the smallest of
them, which connects whatever is linked among them: no pairs are listed.  **Heavy** sets scan inverted lists.  A
set is listed under its least shingles only, one more than may be missing in a partner, so a list is scanned where a link
is possible.  Shingles found in very many documents count as the greatest and are rarely listed.

The boundary is where the number of subsets to list passes the number of list entries to scan, both counted on
the data size by size; subsets are at most two shingles smaller than their set, which ends light sets
at ``LARGEST_LIGHT``.

Lists are split by size band.  Within a list, sets are compared by parity sketches: as many bits as the
band's least size, each the parity of the shingles that hash to it.  The bits in which two sketches differ
are at most the shingles in which the sets differ, so no link is lost.  Lists of few sets are compared pair by pair, others as
pairs of blocks, each of which returns a forest.  Sets connected by what sketches leave are a family, and the families' whole sets are
compared exactly, again in blocks that return forests.  So every set is sent once per block of its
family, not once per list, and no group's pairs are ever listed.

Words are split and lower-cased by ASCII rules; a text with fewer words than a shingle is one shingle.  Nulls and texts
without words have the empty set and are linked with nothing.  Shingles are held as 64-bit hashes.  Repeated rows
and texts with equal sets are one set from the start.  Rows without an id take part and get the smallest id
of their group (null if it has none).  An empty table gives no row; whole texts are read, however long; columns other than
``doc_id`` and ``text`` are not, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.llm.common import components, stored, stored_table
from flowsieve.llm.near_copies import HASH_SEED, shingle_set

SHINGLE = 3
# Sets link at 9/10; 9 (a + b) / 19 shingles in common are as much.
NUMERATOR, DENOMINATOR = 9, 10
# Subsets are listed with at most two shingles missing, so light sets are below this size.
LARGEST_LIGHT = 30
NARROWEST = 64

# A shingle in so many documents, and among the most frequent so many, is listed last.  Only the order of shingles depends on it.
FREQUENT = 64
MOST_FREQUENT = 65_536
# Shingles a task counts before it forgets those seen once, and how many it reports.
COUNTED = 1_000_000
REPORTED = 8_192

# A list with more sets than this is compared in blocks of about so many.
PAIRED_ROWS = 64
BLOCK_ROWS = 2_048
# Families are compared in blocks of about so many shingles.
BLOCK_SHINGLES = 500_000
# Texts are picked by the bucket of their row before they are joined; at most so many rows are broadcast.
BUCKETS = 262_144
# Texts decoded at a time.
TEXTS = 128

_MIX = np.uint64(0x9E3779B97F4A7C15)


def least_common(a, b):
    """Shingles that sets of ``a`` and ``b`` must share to link."""
    return -((-NUMERATOR * (a + b)) // (NUMERATOR + DENOMINATOR))


def may_link(a, b):
    return DENOMINATOR * np.minimum(a, b) >= NUMERATOR * np.maximum(a, b)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    return len(np.intersect1d(a, b, assume_unique=True)) >= least_common(len(a), len(b))


def prefix_length(n: int) -> int:
    """How many of its least shingles a set is listed under."""
    return n + (-NUMERATOR * n) // DENOMINATOR + 1


def subset_sizes(n: int) -> list[int]:
    """Sizes of the subsets by which a set of ``n`` meets all partners it can link with."""
    partners = [m for m in range(1, 2 * n + 2) if DENOMINATOR * min(n, m) >= NUMERATOR * max(n, m)]
    return sorted({least_common(n, m) for m in partners if least_common(n, m) <= min(n, m)})


def subset_count(n: int) -> int:
    return sum(comb(n, c) for c in subset_sizes(n))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def subset_keys(hashes: np.ndarray) -> list[tuple[int, int]]:
    """``(size, key)`` of every subset of the sizes wanted; a key is the sum of the shingles' mixed hashes."""
    parts, out = _mixed(hashes), []
    whole = parts.sum(dtype=np.uint64)
    for c in subset_sizes(len(hashes)):
        left_out = len(hashes) - c
        missing = np.array(list(combinations(range(len(hashes)), left_out)), np.int64).reshape(comb(len(hashes), c), left_out)
        keys = whole - parts[missing].sum(axis=1, dtype=np.uint64)
        out += [(c, int(k)) for k in _mixed(keys ^ np.uint64(c)).view(np.int64)]
    return out


def parity_sketch(hashes: np.ndarray, width: int) -> bytes:
    odd = np.bincount((hashes & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def band_width(n: int) -> int:
    """Width of a set's sketch: the power of two at or below its size."""
    return max(NARROWEST, 1 << (n.bit_length() - 1))


def listed(hashes: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The shingles a sorted set is listed under: least by (is frequent, hash)."""
    p = prefix_length(len(hashes))
    for end in (2 * p, len(hashes)):
        head = hashes[:end]
        if len(frequent):
            often = frequent[np.minimum(np.searchsorted(frequent, head), len(frequent) - 1)] == head
        else:
            often = np.zeros(len(head), bool)
        rare = head[~often]
        if len(rare) >= p:
            return rare[:p]
    return np.concatenate([rare, head[often]])[:p]


def frequent_shingles(docs: DataFrame, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the shingles in most documents; tasks count with bounded memory and report the most frequent."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, waiting, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            found, place, times = np.unique(np.concatenate([keys, *waiting]), return_inverse=True, return_counts=True)
            # Every known shingle came once with its count.
            times[place[: len(keys)]] += counts - 1
            return found, times

        for batch in batches:
            for part in _slices(batch):
                waiting += [shingle_set(text, shingle) for text in part.column(0).to_pylist()]
                size += sum(map(len, waiting[-part.num_rows :]))
                if size >= COUNTED:
                    keys, counts = merged()
                    kept = counts > 1
                    keys, counts, waiting, size = keys[kept], counts[kept], [], 0
        keys, counts = merged()
        top = np.flatnonzero(counts > 1)
        top = top[np.argsort(-counts[top], kind="stable")[:REPORTED]]
        yield pa.RecordBatch.from_arrays([pa.array(keys[top].view(np.int64)), pa.array(counts[top])], ["h", "n"])

    found = docs.select("text").mapInArrow(counted, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    rows = found.where(F.col("n") > FREQUENT).orderBy(F.desc("n"), "h").limit(MOST_FREQUENT).select("h").collect()
    return np.sort(np.array([r.h for r in rows], np.int64).view(np.uint64))


def _set_id(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), HASH_SEED)).view(np.int64))


SKETCHED = {
    "set": pa.int64(), "n": pa.int64(), "keys": pa.list_(pa.int64()), "width": pa.int32(),
    "sketch": pa.binary(), "wider": pa.binary(), "small": pa.binary(),
}


def _sketch(text: str | None, frequent: np.ndarray, shingle: int) -> tuple:
    hashes = shingle_set(text, shingle)
    n = len(hashes)
    if not n:
        return None, 0, None, None, None, None, None
    width = band_width(n)
    # A set near the end of its band can link with one of the next.
    above = DENOMINATOR * n >= NUMERATOR * 2 * width
    return (
        _set_id(hashes), n, listed(hashes, frequent).view(np.int64), width, parity_sketch(hashes, width),
        parity_sketch(hashes, 2 * width) if above else None, hashes.tobytes() if n < LARGEST_LIGHT else None,
    )


def sketched(docs: DataFrame, frequent: np.ndarray, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, row`` of every document with its set's id, size, listed shingles, sketches and, if it may be light, shingles.

    The empty set has no id.
    """

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                columns = zip(*[_sketch(t, frequent, shingle) for t in part.column("text").to_pylist()])
                arrays = [pa.array(c, t) for c, t in zip(columns, SKETCHED.values())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), *arrays], ["doc_id", "row", *SKETCHED])

    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        sketches, f"doc_id {id_type}, row bigint, set bigint, n bigint, keys array<bigint>, width int, sketch binary, wider binary, small binary"
    )


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts, so that few texts are held as Python strings."""
    for at in range(0, batch.num_rows, TEXTS):
        yield batch.slice(at, TEXTS)


def light_links(small: DataFrame) -> DataFrame:
    """Links among ``small(set, n, small)``: each subset's sets to the smallest of them, checked on the whole sets."""

    @F.pandas_udf("array<struct<c: int, key: bigint>>")
    def subsets(sets: pd.Series) -> pd.Series:
        return pd.Series([subset_keys(np.frombuffer(s, np.uint64)) for s in sets], dtype=object)

    @F.pandas_udf("boolean")
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a, b)], dtype=bool)

    rows = stored(small.select("set", "n", F.explode(subsets("small")).alias("s")).select("set", "n", "s.c", "s.key"))
    first = rows.groupBy("c", "key").agg(F.min(F.struct("n", "set")).alias("first"), F.count(F.lit(1)).alias("sets")).where("sets > 1")
    pairs = rows.join(first.select("c", "key", F.col("first.n").alias("m"), F.col("first.set").alias("b")), ["c", "key"])
    fits = NUMERATOR * (F.col("n") + F.col("m")) <= (NUMERATOR + DENOMINATOR) * F.col("c")
    pairs = pairs.where(fits & (F.col("set") != F.col("b"))).select(F.col("set").alias("a"), "b").distinct()
    for side in ("a", "b"):
        pairs = pairs.join(small.select(F.col("set").alias(side), F.col("small").alias(f"{side}_set")), side)
    return pairs.where(linked("a_set", "b_set")).select("a", "b")


def _near(sketches: np.ndarray, other: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sizes and sketches allow a link, row by row."""
    differ = np.bitwise_count(sketches ^ other).sum(axis=1, dtype=np.int64)
    return may_link(n, m) & (differ <= n + m - 2 * least_common(n, m))


def _list_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that may link, from rows sorted by list; a list never spans more than ``PAIRED_ROWS`` rows."""
    columns = ("width", "key", "set", "n", "sketch")
    held = None

    def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
        width, key, sets, n = (table.column(c).to_numpy() for c in columns[:4])
        for w in np.unique(width):
            at = np.flatnonzero(width == w)
            k, s, size = key[at], sets[at], n[at]
            raw = b"".join(table.column("sketch").take(pa.array(at)).to_pylist())
            sketches = np.frombuffer(raw, np.uint64).reshape(len(at), -1)
            for shift in range(1, len(at)):
                same = np.flatnonzero(k[shift:] == k[:-shift])
                if not len(same):
                    break
                other = same + shift
                fits = may_link(size[same], size[other])
                same, other = same[fits], other[fits]
                near = _near(sketches[same], sketches[other], size[same], size[other])
                a, b = s[same[near]], s[other[near]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table]).combine_chunks()
        width, key = table.column("width").to_numpy(), table.column("key").to_numpy()
        last = int(np.flatnonzero((key == key[-1]) & (width == width[-1]))[0]) if len(key) else 0
        held = table.slice(last)
        if last:
            yield from pairs(table.slice(0, last))
    if held is not None and held.num_rows:
        yield from pairs(held)


def _grown(count: int, reached_by) -> list[tuple[int, int]]:
    """A forest over ``count`` rows; ``reached_by(at, left)`` says which of the rows ``left`` link with row ``at``."""
    waiting, found = np.ones(count, bool), []
    while waiting.any():
        first = int(np.argmax(waiting))
        waiting[first] = False
        reached = [first]
        while reached and waiting.any():
            at, left = reached.pop(), np.flatnonzero(waiting)
            near = left[reached_by(at, left)]
            waiting[near] = False
            found += [(at, int(i)) for i in near]
            reached += near.tolist()
    return found


def _named(names: np.ndarray, found: list[tuple[int, int]]) -> pd.DataFrame:
    pairs = np.sort(names[np.array(found, np.int64).reshape(-1, 2)], axis=1)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def _sketch_forest(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.drop_duplicates("set")
    sketches, n = np.frombuffer(b"".join(rows["sketch"]), np.uint64).reshape(len(rows), -1), rows["n"].to_numpy(np.int64)
    near = lambda at, left: _near(sketches[left], sketches[at], n[left], n[at])
    return _named(rows["set"].to_numpy(np.int64), _grown(len(rows), near))


def _set_forest(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.drop_duplicates("set")
    sets = [np.frombuffer(x, np.uint64) for x in rows["hashes"]]
    sizes = np.array([len(s) for s in sets])
    distinct, places = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    marks = np.zeros(len(distinct), np.int32)

    def near(at: int, left: np.ndarray) -> np.ndarray:
        fits = may_link(sizes[left], sizes[at])
        own = places[ends[at] - sizes[at] : ends[at]]
        marks[own] = 1
        tried = left[fits]
        both = np.array([marks[places[ends[i] - sizes[i] : ends[i]]].sum() for i in tried], np.int64)
        marks[own] = 0
        out = np.zeros(len(left), bool)
        out[fits] = both >= least_common(sizes[tried], sizes[at])
        return out

    return _named(rows["set"].to_numpy(np.int64), _grown(len(sets), near))


def _in_blocks(rows: DataFrame, blocks, columns: list[str]) -> DataFrame:
    """``rows`` as often as there are pairs of blocks they belong to."""
    dealt = rows.withColumn("mine", F.pmod(F.xxhash64("set"), blocks))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    return dealt.select(*columns, F.least("mine", "other").alias("first"), F.greatest("mine", "other").alias("second"))


def families(banded: DataFrame, lists: DataFrame) -> DataFrame:
    """``(set, family)`` for sets that sketches connect; ``banded(set, n, width, sketch)``, ``lists(key, width, set, sets)``."""
    rows = lists.join(banded, ["set", "width"]).select("width", "key", "set", "n", "sketch", "sets")
    few = rows.where(F.col("sets") <= PAIRED_ROWS).drop("sets").repartition("width", "key").sortWithinPartitions("width", "key")
    pairs = few.mapInArrow(_list_pairs, "a bigint, b bigint")
    many = rows.where(F.col("sets") > PAIRED_ROWS)
    dealt = _in_blocks(many, F.ceil(F.col("sets") / BLOCK_ROWS), ["key", "width", "set", "n", "sketch"])
    dense = dealt.groupBy("key", "width", "first", "second").applyInPandas(_sketch_forest, "a bigint, b bigint")
    found = components(stored(pairs.union(dense).distinct()))
    return found.select(F.col("node").alias("set"), F.col("root").alias("family"))


def heavy_links(docs: DataFrame, members: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Forests of the exact links within each family of ``members(set, family, row, n)``."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                sets = [shingle_set(t, shingle) for t in part.column("text").to_pylist()]
                # Repeated rows bring a set more than once, rows of equal hash another one.
                kept = [i for i, (s, w) in enumerate(zip(sets, part.column("set").to_pylist())) if _set_id(s) == w]
                chosen = part.select(["family", "shingles", "set"]).take(pa.array(kept, pa.int64()))
                yield pa.RecordBatch.from_arrays([*chosen.columns, pa.array([sets[i].tobytes() for i in kept], pa.binary())], ["family", "shingles", "set", "hashes"])

    totals = members.groupBy("family").agg(F.sum("n").alias("shingles"))
    wanted = stored(members.join(totals, "family").select("set", "family", "row", "shingles"))
    bucket = F.pmod("row", F.lit(BUCKETS))
    # Most texts that no family needs are left out before the shuffle.
    buckets = wanted.select(bucket.alias("bucket")).distinct()
    texts = docs.select(F.xxhash64("doc_id", "text").alias("row"), "text").withColumn("bucket", bucket)
    texts = texts.join(F.broadcast(buckets), "bucket", "left_semi").drop("bucket")
    found = texts.join(wanted, "row").select("family", "shingles", "set", "text")
    found = found.mapInArrow(whole, "family bigint, shingles bigint, set bigint, hashes binary")
    dealt = _in_blocks(found, F.ceil(F.col("shingles") / BLOCK_SHINGLES), ["family", "set", "hashes"])
    return dealt.groupBy("family", "first", "second").applyInPandas(_set_forest, "a bigint, b bigint")


def boundary(light: dict[int, int], heavy: dict[int, int]) -> int:
    """The size at which sets become heavy: least total of subsets below and entries scanned from there on."""
    costs = [sum(light.get(n, 0) for n in range(b)) + sum(heavy.get(n, 0) for n in range(b, LARGEST_LIGHT)) for b in range(1, LARGEST_LIGHT + 1)]
    return 1 + int(np.argmin(costs))


def set_links(docs: DataFrame, sets: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Links ``(a, b)`` that connect all similar sets of ``sets``, the sketches of distinct sets."""
    own = F.struct(F.col("width"), F.col("sketch"))
    above = F.struct((2 * F.col("width")).alias("width"), F.col("wider").alias("sketch"))
    bands = F.when(F.col("wider").isNull(), F.array(own)).otherwise(F.array(own, above))
    banded = sets.select("set", "n", "keys", F.explode(bands).alias("band")).select("set", "n", "keys", "band.*")
    index = banded.select("set", "n", "width", F.explode("keys").alias("key"))
    counts = index.groupBy("key", "width").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1")
    few = index.join(counts.where(F.col("sets") <= PAIRED_ROWS), ["key", "width"])
    by_size = Window.partitionBy("key", "width").orderBy("n")
    before, after = F.lag("n").over(by_size), F.lead("n").over(by_size)
    # In order of size, a set that fits neither neighbour fits no other set of its list.
    fits = (DENOMINATOR * before >= NUMERATOR * F.col("n")) | (DENOMINATOR * F.col("n") >= NUMERATOR * after)
    few = few.withColumn("fits", F.coalesce(fits, F.lit(False))).where("fits").drop("fits")
    many = index.join(counts.where(F.col("sets") > PAIRED_ROWS), ["key", "width"])
    lists = stored(few.unionByName(many).select("key", "width", "set", "n", "sets"))
    possible = F.col("n") < LARGEST_LIGHT
    light = {r.n: r["count"] * subset_count(r.n) for r in sets.where(possible).groupBy("n").count().collect()}
    heavy = {r.n: r.scanned for r in lists.where(possible).groupBy("n").agg(F.sum("sets").alias("scanned")).collect()}
    limit = boundary(light, heavy)
    # A heavy set can link with light ones that are at least nine tenths of the boundary.
    reached = F.col("n") * DENOMINATOR >= limit * NUMERATOR
    joined = families(banded.where(reached).drop("keys"), lists.where(reached).drop("n"))
    members = stored(joined.join(sets.select("set", "n", "row"), "set"))
    return light_links(sets.where(F.col("n") < limit).select("set", "n", "small")).union(heavy_links(docs, members, shingle))


def jaccard_groups(docs: DataFrame, *, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, set, n_shingles, component_id)`` for every row of ``docs``."""
    frequent = frequent_shingles(docs, shingle)
    marked = stored_table(sketched(docs, frequent, shingle), "shingle-sketches")
    facts = [c for c in marked.columns if c not in ("doc_id", "set")]
    full = marked.where(F.col("set").isNotNull())
    sets = stored_table(full.groupBy("set").agg(*[F.first(c).alias(c) for c in facts], F.min("doc_id").alias("lowest")), "shingle-sets")
    roots = stored(components(stored(set_links(docs, sets, shingle).distinct())))
    placed = sets.select("set", "lowest").join(roots, F.col("set") == F.col("node"), "left")
    placed = stored(placed.select("set", "lowest", F.coalesce("root", "set").alias("root")))
    lowest = placed.groupBy("root").agg(F.min("lowest").alias("component_id"))
    groups = stored(placed.join(lowest, "root").select("set", "component_id"))
    rows = full.select("doc_id", "set", F.col("n").alias("n_shingles")).join(groups, "set")
    alone = marked.where(F.col("set").isNull()).select("doc_id", "set", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return rows.select("doc_id", "set", "n_shingles", "component_id").union(alone)
