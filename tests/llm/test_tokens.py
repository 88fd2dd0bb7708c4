import io
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from tokenizers import Tokenizer

from flowsieve.llm import packing, token_files, tokens
from tests.llm.rows import documents, empty, prose

VOCABULARIES = [("word_bpe_49k.json", "spaced_words"), ("byte_bpe_50k.json", "byte_level")]
ODD = [
    "", " ", "a  b", "a   b", " a", "a ", "a\n b", "a\n  b", "a \nb", "\n\n a\t b", "é ́x", "a  b", "x \x1c y", "a\x00b c",
    "I'm don't 'S <|endoftext|> b", "中文 字,x", "İ, ΣΣ ς. K,\n.x", "a\r\nb \r\n c", "end.\nStart, x.y z,", "!!, a.. b,, ,", "3, 4.5 6.",
    "a <|endoftext|>", "x  <|EndOfText|> y", "<|startoftext|>a\n<|endoftext|> \n<|endoftext|>", "<| endoftext |> <|x|>",
]


@pytest.mark.parametrize("name,boundary", VOCABULARIES)
def test_remembered_units_change_nothing(name, boundary, monkeypatch):
    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        text = file.read()
    plain = Tokenizer.from_str(text)
    monkeypatch.setattr(tokens, "REMEMBERED_UNITS", 50)
    monkeypatch.setattr(tokens, "BATCH_CHARS", 40)
    encoder = tokens.Encoder(text, boundary)
    texts = ODD + [prose(3, 50), None] + ODD
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == want


def vocabulary(spark, name, boundary):
    return tokens.Vocabulary(spark, public_tokenizers.path(name), boundary)


def brute_ids(docs, name, end):
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    return [(r.doc_id, [*plain.encode(r.text or "", add_special_tokens=False).ids, end]) for r in docs.collect()]


def as_bytes(ids):
    return np.array(ids, "<u4").tobytes()


def test_files_round_trip(spark, tmp_path):
    docs = documents(spark)
    manifest = token_files.write_token_files(docs, f"file://{tmp_path}/files", vocabulary(spark, *VOCABULARIES[0]), end_id=1, frame_bytes=4096)
    rows = token_files.read_token_files(manifest).collect()
    want = brute_ids(docs, VOCABULARIES[0][0], 1)
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in rows) == sorted((str(d), as_bytes(i)) for d, i in want)
    rows.sort(key=lambda r: r.start)
    at = 0
    for r in rows:
        assert (r.start, r.n_tokens) == (at, len(r.ids) // 4)
        at += r.n_tokens
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
    path = manifest.orderBy("part").first().file.removeprefix("file://")
    data = open(path, "rb").read()
    reader = token_files.FileReader(io.BytesIO(data))
    # A plain decoder reads the data frames and skips the others.
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert len(whole) == int(reader.frames["plain"].sum())
    for i, place in enumerate(reader.documents):
        assert i in reader.find(int(place["doc_id"])) or not place["known"]


def test_readers_touch_only_the_frames_asked_for_and_check_them():
    sink = io.BytesIO()
    writer = token_files.FileWriter(sink, frame_bytes=400)
    for i in range(20):
        writer.add(i, as_bytes(range(i, i + 50)))
    writer.close()
    data = bytearray(sink.getvalue())
    reader = token_files.FileReader(io.BytesIO(bytes(data)))
    assert len(reader.frames) == 11
    data[int(reader._starts[3]) + 12] ^= 0xFF
    broken = token_files.FileReader(io.BytesIO(bytes(data)))
    assert broken.document(broken.find(2)[0]) == as_bytes(range(2, 52))
    with pytest.raises((ValueError, zstandard.ZstdError)):
        broken.document(6)


def test_empty_table_writes_nothing(spark, tmp_path):
    manifest = token_files.write_token_files(empty(spark), f"file://{tmp_path}/none", vocabulary(spark, *VOCABULARIES[0]), end_id=1)
    assert manifest.count() == 0 and token_files.read_token_files(manifest).count() == 0
    assert packing.pack(empty(spark), vocabulary(spark, *VOCABULARIES[1]), end_id=0).count() == 0


def check_packing(rows, want, length):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
    got = sorted((str(r.doc_id), r.doc_tokens, r.start, r.length, r.ids_crc32) for r in rows)
    cut = []
    for d, ids in want:
        cut += [(str(d), len(ids), s, len(ids[s : s + length]), zlib.crc32(as_bytes(ids[s : s + length]))) for s in range(0, len(ids), length)]
    assert got == sorted(cut)
    return by_sequence


def test_packing(spark, sf_dir):
    docs = documents(spark).unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet"), allowMissingColumns=True)
    rows = packing.pack(docs, vocabulary(spark, *VOCABULARIES[1]), end_id=0).collect()
    want = brute_ids(docs, VOCABULARIES[1][0], 0)
    found = check_packing(rows, want, 1024)
    assert len(found) <= 1.05 * sum(len(i) for _, i in want) / 1024 + 1


def test_sequences_hold_the_ids(spark):
    docs = documents(spark)
    packed = packing.pack(docs, vocabulary(spark, *VOCABULARIES[1]), end_id=0, length=64, with_ids=True)
    pieces = packed.collect()
    check_packing(pieces, brute_ids(docs, VOCABULARIES[1][0], 0), 64)
    for r in packing.sequences(packed).collect():
        own = sorted((p.offset, bytes(p.ids)) for p in pieces if p.sequence_id == r.sequence_id)
        assert bytes(r.ids) == b"".join(x for _, x in own) and r.n_tokens == len(r.ids) // 4


def test_shortest_pack_first():
    # 5 opens the packs, 3 joins the emptiest, 2 fills what is left.
    assert packing.shortest_pack_first({5: 2, 3: 3, 2: 1}, 8) == [(2, 0, 2, 3), (3, 0, 0, 5), (3, 2, 2, 0), (5, 0, 0, 0)]
    assert packing.shortest_pack_first({}, 8) == []


@pytest.mark.parametrize("name,boundary", VOCABULARIES)
def test_words_of_letters_skip_the_steps_before_the_model(name, boundary):
    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        text = file.read()
    encoder = tokens.Encoder(text, boundary)

    class Counting:
        seen = 0

        def encode_batch_fast(self, texts, **options):
            Counting.seen += sum(map(len, texts))
            return plain.encode_batch_fast(texts, **options)

    plain, encoder._tokenizer = encoder._tokenizer, Counting()
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdeXYZ"), rng.integers(1, 12))) for _ in range(3000)]
    texts = [" ".join(words[at : at + 30]) for at in range(0, 3000, 30)] + [f"{words[7]}.\n{words[8]}, {words[9]}"]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == want
    assert Counting.seen < 10
    # A second look at the same texts learns nothing.
    remembered = len(encoder._units)
    encoder.encode(texts)
    assert len(encoder._units) == remembered
