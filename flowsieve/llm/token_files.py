"""Token-id files of independent zstandard frames with a trailing seek table.

Layout of a file: data frames (the ids of whole documents, little-endian 32 bit, each frame
decompressible on its own), one skippable frame with the document index, and one skippable
frame with the seek table of the published seekable format: compressed size, plain size and
the low 32 bits of XXH64 of the plain bytes for every frame before it, the number of frames, a
descriptor with the checksum flag, and the magic number.  A reader takes the tail, finds its
documents in the index and decompresses only their frames, checking each.

Documents are range-partitioned and sorted by id, a file per partition.  Files are written
under a temporary name and moved, so a repeated or speculative task leaves the same file.

Null texts are empty, very long ones make a frame of their own; every document ends with the end id.  Null ids come first.  Rows that
repeat an id are kept side by side, in the order of their texts' hashes.  An empty table
gives no file and no row.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import io
import struct
import uuid
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.llm.common import stored
from flowsieve.llm.tokens import TEXTS_AT_ONCE, Vocabulary

FRAME_BYTES = 256 * 1024
LEVEL = 3

SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUMS = 0x80

_ENTRY = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("checksum", "<u4")])
_DOCUMENT = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("frame", "<u4"), ("n_tokens", "<u4")])

MANIFEST = "file string, part int, n_docs bigint, n_tokens bigint"
TOKENS = "doc_id bigint, start bigint, n_tokens bigint, ids binary"


class FileWriter:
    """Writes one file, document by document."""

    def __init__(self, sink, level: int = LEVEL, frame_bytes: int = FRAME_BYTES):
        self._sink, self._frame_bytes = sink, frame_bytes
        self._packer = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self._waiting: list[bytes] = []
        self._size = 0
        self._frames: list[tuple] = []
        self._documents: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self._size and self._size + len(ids) > self._frame_bytes:
            self._flush()
        self._documents.append((doc_id or 0, doc_id is not None, len(self._frames), len(ids) // 4))
        self._waiting.append(ids)
        self._size += len(ids)

    def _flush(self) -> None:
        plain = b"".join(self._waiting)
        packed = self._packer.compress(plain)
        self._sink.write(packed)
        self._frames.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self._waiting, self._size = [], 0

    def close(self) -> tuple[int, int]:
        """Documents and ids written."""
        if self._waiting:
            self._flush()
        index = np.array(self._documents, _DOCUMENT)
        plain = index.tobytes()
        self._sink.write(struct.pack("<II", SKIPPABLE_INDEX, len(plain)) + plain)
        entries = np.array([*self._frames, (len(plain) + 8, 0, 0)], _ENTRY)
        self._sink.write(
            struct.pack("<II", SKIPPABLE_SEEK, entries.nbytes + 9)
            + entries.tobytes()
            + struct.pack("<IBI", len(entries), CHECKSUMS, SEEKABLE_MAGIC)
        )
        return len(index), int(index["n_tokens"].sum())


class FileReader:
    """Reads the documents asked for out of one file."""

    def __init__(self, source):
        self._source = source
        end = source.seek(0, io.SEEK_END)
        n, flags, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        table = end - 9 - n * _ENTRY.itemsize
        self.frames = np.frombuffer(self._at(table, n * _ENTRY.itemsize), _ENTRY)
        self._starts = np.concatenate([[0], np.cumsum(self.frames["packed"], dtype=np.int64)])
        self.documents = np.frombuffer(self._at(int(self._starts[n - 1]) + 8, int(self.frames["packed"][n - 1]) - 8), _DOCUMENT)
        self.starts = np.concatenate([[0], np.cumsum(self.documents["n_tokens"], dtype=np.int64)])
        self._plain_starts = np.concatenate([[0], np.cumsum(self.frames["plain"], dtype=np.int64)])
        self._unpacker = zstandard.ZstdDecompressor()
        self._open = (-1, b"")

    def _at(self, place: int, size: int) -> bytes:
        self._source.seek(place)
        return self._source.read(size)

    def frame(self, k: int) -> bytes:
        if self._open[0] != k:
            entry = self.frames[k]
            packed = self._at(int(self._starts[k]), int(entry["packed"]))
            plain = self._unpacker.decompress(packed, max_output_size=int(entry["plain"]))
            if len(plain) != entry["plain"] or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != entry["checksum"]:
                raise ValueError(f"frame {k} does not match its checksum")
            self._open = (k, plain)
        return self._open[1]

    def document(self, i: int) -> bytes:
        """The ids of the file's i-th document; only its frame is decompressed."""
        k = int(self.documents["frame"][i])
        start = 4 * int(self.starts[i]) - int(self._plain_starts[k])
        return self.frame(k)[start : start + 4 * int(self.documents["n_tokens"][i])]

    def find(self, doc_id: int) -> list[int]:
        """Places of the documents with this id."""
        return np.flatnonzero((self.documents["doc_id"] == doc_id) & (self.documents["known"] == 1)).tolist()


def write_token_files(
    docs: DataFrame, folder: str, vocabulary: Vocabulary, *, end_id: int, level: int = LEVEL, frame_bytes: int = FRAME_BYTES
) -> DataFrame:
    """Write all documents under ``folder`` and return a row per file, in document order."""
    end = struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (batch for batch in batches if batch.num_rows)
        first = next(batches, None)
        if first is None:
            return
        part = TaskContext.get().partitionId()
        files, root = fs.FileSystem.from_uri(folder)
        name, waiting = f"part-{part:06d}.zst", f"{root}/.{uuid.uuid4().hex}"
        encoder = vocabulary.encoder()
        with files.open_output_stream(waiting) as sink:
            writer = FileWriter(sink, level, frame_bytes)
            for batch in _chain(first, batches):
                ids, texts = batch.column(0), batch.column(1)
                for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                    tokens = encoder.encode(texts.slice(at, TEXTS_AT_ONCE).to_pylist())
                    for doc_id, found in zip(ids.slice(at, TEXTS_AT_ONCE).to_pylist(), tokens):
                        writer.add(doc_id, found + end)
            n_docs, n_tokens = writer.close()
        files.move(waiting, f"{root}/{name}")
        yield pa.RecordBatch.from_pydict(
            {"file": [f"{folder}/{name}"], "part": pa.array([part], pa.int32()), "n_docs": [n_docs], "n_tokens": [n_tokens]}
        )

    files, root = fs.FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)
    ordered = (
        docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
        .repartitionByRange(F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
    )
    return stored(ordered.select("doc_id", "text").mapInArrow(write, MANIFEST))


def _chain(first, rest: Iterable) -> Iterator:
    yield first
    yield from rest


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Every document of the files: its id, the number of ids before it, its length and its ids."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                files, path = fs.FileSystem.from_uri(row["file"])
                with files.open_input_file(path) as source:
                    reader = FileReader(source)
                    places = iter(range(len(reader.documents)))
                    while some := list(islice(places, 512)):
                        known = reader.documents["known"][some] == 1
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(reader.documents["doc_id"][some], mask=~known),
                                pa.array(reader.starts[some] + row["base"]),
                                pa.array(reader.documents["n_tokens"][some].astype(np.int64)),
                                pa.array([reader.document(i) for i in some], pa.binary()),
                            ],
                            names=["doc_id", "start", "n_tokens", "ids"],
                        )

    # A row per file: what stands before each file is summed in one small window.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = stored(manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))))
    return placed.repartition(max(1, placed.count())).mapInArrow(read, TOKENS)
