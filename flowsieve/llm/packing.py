"""Packing documents into sequences of a fixed length, shortest pack first.

A document's ids are cut into full pieces and one remainder, so a piece has one of
``length`` sizes.  The plan is made on the histogram of sizes alone: sizes are placed longest
first, each into the packs with the least in them, and packs that have the same history are one
pattern with a count.  A placement says that ranks ``lo ..`` of a size go to sequences ``first ..``
at one offset; pieces find theirs by their rank among the pieces of their size.  Ranks come
from counts per (size, hash range), so a size held by very many pieces is spread.

Null texts are empty, very long ones give as many pieces as they need; each document ends with the end id, so none is without a piece.  Rows
that repeat an id are packed separately.  An empty table gives no piece.  Only ``doc_id`` and
``text`` are read.
"""

from __future__ import annotations

import heapq
import math
import struct
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.llm.common import stored
from flowsieve.llm.tokens import TEXTS_AT_ONCE, Vocabulary
from flowsieve.operators.joins import broadcast_if_small

LENGTH = 1024

_PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, tie bigint"


def pieces(docs: DataFrame, vocabulary: Vocabulary, *, end_id: int, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """Every document cut into pieces of at most ``length`` ids, with the checksum of each."""
    end = struct.pack("<I", end_id)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = vocabulary.encoder()
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                some = batch.slice(at, TEXTS_AT_ONCE)
                out: dict[str, list] = {c: [] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "tie", "ids")}
                rows = zip(some.column(0).to_pylist(), encoder.encode(some.column(1).to_pylist()), some.column(2).to_pylist())
                for doc_id, ids, tie in rows:
                    ids += end
                    for start in range(0, len(ids), 4 * length):
                        piece = ids[start : start + 4 * length]
                        out["doc_id"].append(doc_id)
                        out["start"].append(start // 4)
                        out["length"].append(len(piece) // 4)
                        out["ids_crc32"].append(zlib.crc32(piece))
                        out["doc_tokens"].append(len(ids) // 4)
                        out["tie"].append(tie)
                        out["ids"].append(piece)
                arrays = {c: pa.array(v, pa.binary() if c == "ids" else pa.int64()) for c, v in out.items() if with_ids or c != "ids"}
                yield pa.RecordBatch.from_pydict(arrays)

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    return rows.mapInArrow(cut, _PIECES + (", ids binary" if with_ids else ""))


def shortest_pack_first(histogram: Mapping[int, int], length: int = LENGTH) -> list[tuple[int, int, int, int]]:
    """Placements ``(size, lo, first, offset)`` by size and rank: ranks from ``lo`` up to the size's
    next placement go to sequences from ``first`` on, at ``offset``.

    The work depends on the number of sizes, not of pieces: a size splits one pattern at most.
    """
    placed: list[tuple[int, int, int, int]] = []
    open_packs: list[tuple[int, int, int]] = []  # (used, first sequence, count), least used on top
    sequences = 0
    for size in sorted(histogram, reverse=True):
        rank, count = 0, histogram[size]
        while rank < count and open_packs and open_packs[0][0] + size <= length:
            used, first, packs = heapq.heappop(open_packs)
            taken = min(packs, count - rank)
            placed.append((size, rank, first, used))
            if used + size < length:
                heapq.heappush(open_packs, (used + size, first, taken))
            if taken < packs:
                heapq.heappush(open_packs, (used, first + taken, packs - taken))
            rank += taken
        if rank < count:
            placed.append((size, rank, sequences, 0))
            if size < length:
                heapq.heappush(open_packs, (size, sequences, count - rank))
            sequences += count - rank
    return sorted(placed)


def with_ranks(rows: DataFrame) -> DataFrame:
    """``rank`` of each piece among those of its length, from 0, in the order of a hash."""
    n = rows.count()
    bits = max(2, min(24, round(math.log2(n + 1) / 2)))
    keyed = rows.withColumn("key", F.xxhash64("doc_id", "start", "tie")).withColumn("range", F.shiftright("key", 64 - bits))
    prefix = Window.partitionBy("length").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = stored(keyed.groupBy("length", "range").agg(F.count(F.lit(1)).alias("n")))
    ranges = ranges.withColumn("before", F.coalesce(F.sum("n").over(prefix), F.lit(0))).drop("n")
    inside = Window.partitionBy("length", "range").orderBy("key", "doc_id", "start", "tie")
    return (
        keyed.join(stored(ranges), ["length", "range"])
        .withColumn("rank", F.col("before") + F.row_number().over(inside) - 1)
        .drop("key", "range", "before")
    )


def pack(docs: DataFrame, vocabulary: Vocabulary, *, end_id: int, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents with ``sequence_id`` and ``offset``; with their ids if asked for."""
    rows = stored(pieces(docs, vocabulary, end_id=end_id, length=length, with_ids=with_ids))
    # At most ``length`` rows.
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = np.array(shortest_pack_first(histogram, length), np.int64).reshape(-1, 4)

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        sizes, rank = lengths.to_numpy(np.int64), ranks.to_numpy(np.int64)
        # Placements are sorted by (size, first rank): one number orders both.
        scale = np.int64(1) << 52
        found = np.searchsorted(plan[:, 0] * scale + plan[:, 1], sizes * scale + rank, side="right") - 1
        return pd.DataFrame({"sequence_id": plan[found, 2] + rank - plan[found, 1], "offset": plan[found, 3]})

    placed = with_ranks(rows).withColumn("place", place("length", "rank"))
    return placed.select("*", "place.*").drop("place", "rank", "tie")


def padding(length_used, length: int = LENGTH):
    """Padding of a sequence: none at a power of two, else up to ``length``."""
    power = F.bit_count(length_used) == 1
    return F.when(power, 0).otherwise(F.lit(length) - length_used)


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, n_tokens, ids)``: the ids of each sequence, little-endian 32 bit, unpadded."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"),
        F.aggregate(parts, F.lit(b""), lambda done, part: F.concat(done, part["ids"])).alias("ids"),
    )
