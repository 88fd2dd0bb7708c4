"""Removal of byte strings that occur twice: a replacement of prefix doubling by window anchors.

Ranking every byte position at offsets 1, 2, 4, ... would sort the whole corpus byte by byte nine
times (calculated, not tried).  No rank pair is sorted here and no offset doubled.  The positions are thinned first so that no repeat can be missed: of the ``gram``-byte strings in
every window of ``length`` bytes the one with the lowest hash is the window's anchor, a
choice that depends on the window's bytes alone, so equal windows have equal anchors at equal places.
Consecutive windows share an anchor; an anchor with its run of windows is one row.

Then anchors are grouped by growing strings around them, into classes of equal hashes:

1. by the ``gram`` bytes at the anchor; anchors alone in their class are dropped, which is
   nearly all of them;
2. by the whole stretch their windows cover; what is equal there repeats in all its windows, and
   one row stands for any number of copies;
3. where a class has several stretches, by every ``length``-byte window of theirs.  Classes
   of bounded size are finished in one task.  Larger ones are ranked again by what all windows
   in a cell of neighbouring windows have in common, cell by cell, and only what is still
   shared goes on, at the end to single windows that are merely counted.

Every byte covered by a window that occurs twice goes.  Strings are compared by 64-bit hashes of all
their bytes.  Matches never cross documents; overlapping occurrences count.

An empty table gives no row; whole texts are read, however long.  Null texts are empty, texts shorter than ``length`` bytes keep everything.  Rows are identified by id and
text, so rows without an id or with a repeated one are judged apart, and rows that repeat both
are copies of each other.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.llm.common import stored, stored_table

LENGTH = 400
GRAM = 100

# Bytes hashed at a time, members of a class finished in one task, and windows in a cell.
CHUNK_BYTES = 1_500_000
CLASS_ROWS = 1024
CELL = 32

_PLACE_BITS = np.uint64(24)
_PLACE = np.uint64((1 << 24) - 1)
_BASE = 0xD1342543DE82EF95  # odd, so it has an inverse


class Hasher:
    """Hashes of any stretch of a byte array, by prefix sums modulo 2**64."""

    _values = np.random.default_rng(20_011).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    _powers = np.ones(1, np.uint64)
    _inverses = np.ones(1, np.uint64)

    @classmethod
    def _prepare(cls, n: int) -> None:
        if len(cls._powers) < n:
            inverse = pow(_BASE, -1, 1 << 64)
            with np.errstate(over="ignore"):
                for name, base in (("_powers", _BASE), ("_inverses", inverse)):
                    steps = np.full(n, base, np.uint64)
                    steps[0] = 1
                    setattr(cls, name, np.cumprod(steps))

    def __init__(self, data: np.ndarray):
        self._prepare(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self._values[data] * self._powers[: len(data)], out=self._sums[1:])

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of ``data[start:end]``."""
        return spread((self._sums[end] - self._sums[start]) * self._inverses[start])

    def windows(self, length: int) -> np.ndarray:
        """Hashes of all stretches of one length, by start."""
        n = len(self._sums) - length
        return spread((self._sums[length:] - self._sums[:n]) * self._inverses[:n])


def spread(x: np.ndarray) -> np.ndarray:
    """One-to-one mixing, after which leading bits are as good as any."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(28))


def _lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours: minima from the left and from the right of blocks meet."""
    n = len(values) - width + 1
    blocks = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(values)] = values
    blocks = blocks.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def find_anchors(texts: list[bytes], length: int, gram: int) -> dict[str, np.ndarray]:
    """Anchors of all windows of several texts: ``text`` (its number), ``at`` (place of the anchor), ``lo`` and
    ``hi`` (least and greatest distance from a window's start to it), ``gram`` and ``stretch`` (hashes)."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    data = np.frombuffer(b"".join(texts), np.uint8)
    hasher = Hasher(data)
    grams = hasher.windows(gram)
    order = (grams >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(grams), dtype=np.uint64)
    anchors = (_lowest(order, length - gram + 1) & _PLACE).astype(np.int64)
    change = np.zeros(len(data) + 2, np.int32)
    change[starts] += 1
    change[starts + sizes - length + 1] -= 1
    windows = np.flatnonzero(np.cumsum(change)[: len(anchors)] > 0)
    anchors = anchors[windows]
    first = np.ones(len(windows), bool)
    first[1:] = (anchors[1:] != anchors[:-1]) | (windows[1:] != windows[:-1] + 1)
    last = np.append(first[1:], True)
    begin, end, at = windows[first], windows[last], anchors[first]
    text = np.searchsorted(starts, begin, side="right") - 1
    return {
        "text": text,
        "at": at - starts[text],
        "lo": at - end,
        "hi": at - begin,
        "gram": grams[at].view(np.int64),
        "stretch": hasher.between(begin, end + length).view(np.int64),
    }


def _pieces(data: bytes, length: int) -> Iterator[tuple[int, bytes]]:
    """A long text in parts that share no window and miss none."""
    step = CHUNK_BYTES
    for start in range(0, max(1, len(data) - length + 1), step):
        yield start, data[start : start + step + length - 1]


_ANCHORS = "doc_id bigint, tie bigint, gram bigint, at int, lo int, hi int, stretch bigint"


def anchors(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """``_ANCHORS`` of ``rows(doc_id, tie, text)``."""

    def flush(waiting: list) -> pa.RecordBatch:
        found = find_anchors([w[2] for w in waiting], length, gram)
        number = found.pop("text")
        ids = pa.array([w[0] for w in waiting], pa.int64()).take(pa.array(number))
        ties = np.array([w[1] for w in waiting], np.int64)[number]
        shift = np.array([w[3] for w in waiting], np.int64)[number]
        found["at"] = found["at"] + shift
        columns = {"doc_id": ids, "tie": pa.array(ties), "gram": pa.array(found["gram"])}
        columns |= {c: pa.array(found[c].astype(np.int32)) for c in ("at", "lo", "hi")}
        return pa.RecordBatch.from_pydict(columns | {"stretch": pa.array(found["stretch"])})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            for doc_id, tie, text in zip(*(batch.column(i) for i in range(3))):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                if len(data) < length:
                    continue
                for shift, piece in _pieces(data, length):
                    if size + len(piece) > 2 * CHUNK_BYTES:
                        yield flush(waiting)
                        waiting, size = [], 0
                    waiting.append((doc_id.as_py(), tie.as_py(), piece, shift))
                    size += len(piece)
        if waiting:
            yield flush(waiting)

    return rows.select("doc_id", "tie", "text").mapInArrow(scan, _ANCHORS)


_MEMBERS = "class bigint, n bigint, doc_id bigint, tie bigint, start int, lo int, hi int, bytes binary"
_RUNS = "doc_id bigint, tie bigint, first int, last int"


def _stretches(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``_MEMBERS``: the bytes of the wanted anchors' stretches; ``start`` is where a stretch begins in its text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for doc_id, tie, text, members in zip(*(batch.column(i) for i in range(4))):
                data = text.as_buffer().to_pybytes()
                for m in members.as_py():
                    start = m["at"] - m["hi"]
                    out.append(
                        {
                            "class": m["gram"], "n": m["n"], "doc_id": doc_id.as_py(), "tie": tie.as_py(), "start": start,
                            "lo": m["lo"], "hi": m["hi"], "bytes": data[start : m["at"] - m["lo"] + length],
                        }
                    )
                if len(out) >= 10_000:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema(
        [
            ("class", pa.int64()), ("n", pa.int64()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("start", pa.int32()),
            ("lo", pa.int32()), ("hi", pa.int32()), ("bytes", pa.binary()),
        ]
    )
    per_text = wanted.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("gram", "n", "at", "lo", "hi")).alias("members"))
    per_text = per_text.select(F.col("doc_id").alias("d"), F.col("tie").alias("t"), "members")
    found = rows.join(per_text, (F.col("doc_id") == F.col("d")) & (F.col("tie") == F.col("t")))
    return found.select("doc_id", "tie", "text", "members").mapInArrow(cut, _MEMBERS)


def _repeated_runs(members: pd.DataFrame, length: int) -> pd.DataFrame:
    """Runs of windows that occur twice among the members, by exact count of window hashes."""
    sizes = members["bytes"].map(len).to_numpy()
    begins = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    hashes = Hasher(np.frombuffer(b"".join(members["bytes"]), np.uint8)).windows(length)
    counts = sizes - length + 1
    member = np.repeat(np.arange(len(members)), counts)
    offset = np.arange(len(member)) - np.repeat(np.cumsum(counts) - counts, counts)
    # Equal windows of different classes are no concern: a window's anchor names its class.
    _, same, rows = np.unique(hashes[begins[member] + offset], return_inverse=True, return_counts=True)
    weight = np.bincount(same, weights=members["n"].to_numpy(float)[member], minlength=len(rows))
    twice = (weight[same] >= 2) & (members["n"].to_numpy() == 1)[member]
    member, offset = member[twice], offset[twice]
    first = np.ones(len(member), bool)
    first[1:] = (member[1:] != member[:-1]) | (offset[1:] != offset[:-1] + 1)
    own = members.iloc[member[first]]
    start = own["start"].to_numpy()
    return pd.DataFrame(
        {
            "doc_id": own["doc_id"].to_numpy(),
            "tie": own["tie"].to_numpy(),
            "first": start + offset[first],
            "last": start + offset[np.append(first[1:], True)] if len(member) else start,
        }
    )


def _finish(members: DataFrame, length: int) -> DataFrame:
    """``_RUNS`` of classes small enough for one task; whole classes are taken together, many at a time."""

    def ranked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: pd.DataFrame | None = None
        for batch in batches:
            waiting = batch if waiting is None else pd.concat([waiting, batch], ignore_index=True)
            # The last class may go on in the next batch.
            done = int(np.searchsorted(waiting["class"].to_numpy(), waiting["class"].iloc[-1])) if len(waiting) else 0
            if done >= CLASS_ROWS:
                yield _repeated_runs(waiting.iloc[:done], length)
                waiting = waiting.iloc[done:].reset_index(drop=True)
        if waiting is not None and len(waiting):
            yield _repeated_runs(waiting, length)

    return members.repartition("class").sortWithinPartitions("class").mapInPandas(ranked, _RUNS)


def _cells(members: DataFrame, length: int, cell: int) -> DataFrame:
    """Members split into cells of windows and ranked by what all windows of the cell have in common."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("class", "n", "doc_id", "tie", "start", "lo", "hi", "bytes")}
            for row in batch.itertuples(index=False):
                data = np.frombuffer(row.bytes, np.uint8)
                hasher = Hasher(data)
                for k in range(row.lo // cell, row.hi // cell + 1):
                    lo, hi = max(row.lo, k * cell), min(row.hi, (k + 1) * cell - 1)
                    anchor = row.hi  # the anchor's place in the stretch
                    common = hasher.between(np.array([anchor - k * cell]), np.array([anchor - (k + 1) * cell + 1 + length]))
                    out["class"].append(int((common ^ np.uint64(k)).view(np.int64)[0]))
                    out["start"].append(row.start + row.hi - hi)
                    out["bytes"].append(row.bytes[anchor - hi : anchor - lo + length] if cell > 1 else b"")
                    for name, value in (("n", row.n), ("doc_id", row.doc_id), ("tie", row.tie), ("lo", lo), ("hi", hi)):
                        out[name].append(value)
            yield pd.DataFrame(out)

    return members.mapInPandas(split, _MEMBERS)


def _sized(members: DataFrame) -> DataFrame:
    """Members of classes with at least two occurrences, with ``rows``: the class's members."""
    sizes = stored(
        members.groupBy("class").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("rows")).where("occurrences > 1")
    )
    return members.join(sizes.drop("occurrences"), "class")


def repeated_runs(rows: DataFrame, *, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``_RUNS`` of ``rows(doc_id, tie, text)``: first and last start of windows that occur twice.  No ``doc_id`` is null."""
    every = stored_table(anchors(rows, length, gram), "anchors")
    shared = stored(every.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("gram"))
    live = stored_table(every.join(shared, "gram", "left_semi"), "shared-anchors")
    key = ["gram", "lo", "hi", "stretch"]
    stretches = stored(
        live.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "tie", "at")).alias("one"))
    )
    whole = live.join(stretches.where("n > 1").select(*key), key, "left_semi").select(
        "doc_id", "tie", (F.col("at") - F.col("hi")).alias("first"), (F.col("at") - F.col("lo")).alias("last")
    )
    several = stored(stretches.groupBy("gram").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"))
    open_ones = stretches.join(several, "gram").select("gram", "n", "lo", "hi", "rows", "one.*")
    large = several.where(F.col("rows") > CLASS_ROWS).select(F.col("gram").alias("class"))
    members = stored_table(_stretches(rows, open_ones, length), "stretches")
    found = [whole, _finish(members.join(large, "class", "left_anti"), length)]
    if not large.isEmpty():
        split = _sized(stored_table(_cells(members.join(large, "class", "left_semi"), length, CELL), "cells"))
        found.append(_finish(split.where(F.col("rows") <= CLASS_ROWS).drop("rows"), length))
        windows = _sized(stored_table(_cells(split.where(F.col("rows") > CLASS_ROWS).drop("rows"), length, 1), "windows"))
        found.append(windows.where("n = 1").select("doc_id", "tie", F.col("start").alias("first"), F.col("start").alias("last")))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``(doc_id, n_bytes, removed, kept)``: the removed byte spans of every row, and the bytes that are left."""

    @F.pandas_udf("removed array<struct<start: int, end: int>>, kept binary")
    def cut(texts: pd.Series, runs: pd.Series) -> pd.DataFrame:
        out = []
        for text, found in zip(texts, runs):
            data, spans = (text or "").encode(), []
            for run in sorted((r["first"], r["last"]) for r in found) if found is not None else ():
                start, end = run[0], run[1] + length
                if spans and start <= spans[-1]["end"]:
                    spans[-1]["end"] = max(spans[-1]["end"], end)
                else:
                    spans.append({"start": int(start), "end": int(end)})
            kept, at = [], 0
            for span in spans:
                kept.append(data[at : span["start"]])
                at = span["end"]
            out.append((spans, b"".join(kept) + data[at:]))
        return pd.DataFrame(out, columns=["removed", "kept"])

    # pandas reads a column of numbers with nulls as doubles, which large ids do not survive: a missing id is told by the tie.
    no_id = F.col("doc_id").isNull()
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("doc_id"), F.xxhash64(no_id, "text").alias("tie"), no_id.alias("no_id"), "text"
    )
    runs = repeated_runs(rows, length=length, gram=gram)
    per_text = runs.groupBy(F.col("doc_id").alias("d"), F.col("tie").alias("t")).agg(
        F.collect_set(F.struct("first", "last")).alias("runs")
    )
    joined = rows.join(per_text, (F.col("doc_id") == F.col("d")) & (F.col("tie") == F.col("t")), "left")
    return joined.select(
        F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), cut("text", "runs").alias("cut")
    ).select("doc_id", "n_bytes", "cut.*")
