import hashlib
import random

import numpy as np
import pytest

from flowsieve.llm import repeats
from flowsieve.llm.queries import op9_repeated_bytes
from tests.llm.rows import documents, empty, prose


def brute(texts, length):
    """Spans of bytes covered by strings that start twice."""
    starts = {}
    for i, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            starts.setdefault(t[p : p + length], []).append((i, p))
    covered = [bytearray(len(t)) for t in texts]
    for found in starts.values():
        if len(found) > 1:
            for i, p in found:
                covered[i][p : p + length] = b"\1" * length
    return covered


def check(rows, texts, length):
    """``rows`` and ``texts`` by id."""
    ids = sorted(texts)
    for i, covered in zip(ids, brute([texts[i] for i in ids], length)):
        r = rows[i]
        kept = bytes(b for b, c in zip(texts[i], covered) if not c)
        spans = sum(c and (k == 0 or not covered[k - 1]) for k, c in enumerate(covered))
        assert (r.n_bytes, sum(s.end - s.start for s in r.removed), len(r.removed)) == (len(texts[i]), sum(covered), spans), i
        assert bytes(r.kept) == kept


def planted(seed, n, parts):
    """Texts over few letters that share passages of many lengths, some of them very often."""
    rng = random.Random(seed)
    passages = ["".join(rng.choices("abcd ", k=rng.randint(20, 300))) for _ in range(parts)]
    texts = []
    for i in range(n):
        text = ""
        for _ in range(rng.randint(0, 4)):
            text += "".join(rng.choices("abcdé ", k=rng.randint(0, 60)))
            passage = passages[0] if rng.random() < 0.5 else rng.choice(passages)
            cut = rng.randint(0, len(passage))
            text += passage if rng.random() < 0.6 else passage[cut:]
        texts.append(text)
    return texts + ["ab" * 200, "x" * 130, "x" * 61, texts[0], texts[1], "", "short"]


@pytest.mark.parametrize("class_rows,chunk", [(1024, 1_500_000), (8, 700)])
def test_against_brute_force(spark, monkeypatch, class_rows, chunk):
    monkeypatch.setattr(repeats, "CLASS_ROWS", class_rows)
    monkeypatch.setattr(repeats, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(repeats, "CELL", 8)
    texts = dict(enumerate(planted(3, 60, 12)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    rows = {r.doc_id: r for r in repeats.remove_repeats(docs, length=60, gram=20).collect()}
    check(rows, {i: t.encode() for i, t in texts.items()}, 60)


def test_query_at_its_own_length(spark, sf_dir):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    ids = sorted(texts)
    want = brute([texts[i] for i in ids], 400)
    got = {r.doc_id: r for r in op9_repeated_bytes(spark, sf_dir).collect()}
    assert sum(map(sum, want)) > 0
    for i, covered in zip(ids, want):
        kept = bytes(b for b, c in zip(texts[i], covered) if not c)
        assert (got[i].n_removed, got[i].kept_sha256) == (sum(covered), hashlib.sha256(kept).hexdigest())


def test_awkward_rows(spark):
    docs = documents(spark)
    rows = repeats.remove_repeats(docs).collect()
    assert len(rows) == docs.count()
    by_size = sorted(r.n_bytes for r in rows)
    assert by_size == sorted(len((r.text or "").encode()) for r in docs.collect())
    # The copies of the first text go whole, wherever they stand.
    whole = len(prose(1, 300).encode())
    assert sum(len(r.kept) == 0 for r in rows if r.n_bytes == whole) >= 3
    assert repeats.remove_repeats(empty(spark)).count() == 0


def test_anchors_cover_every_window():
    data = "".join(random.Random(2).choices("ab", k=2000)).encode()
    found = repeats.find_anchors([data, b"q" * 90, b"ab"], 60, 20)
    windows = []
    for text, at, lo, hi in zip(found["text"], found["at"], found["lo"], found["hi"]):
        windows += [(int(text), int(p)) for p in range(at - hi, at - lo + 1)]
        assert 0 <= lo <= hi <= 40
    assert sorted(windows) == [(0, p) for p in range(1941)] + [(1, p) for p in range(31)]
    assert len(np.unique(found["gram"])) <= len(found["gram"])


@pytest.mark.parametrize("class_rows", [1024, 4])
def test_large_ids_beside_missing_ones(spark, monkeypatch, class_rows):
    # Every other row has no id; the others are beyond what a double holds.  Their passages end differently, so classes stay open.
    monkeypatch.setattr(repeats, "CLASS_ROWS", class_rows)
    monkeypatch.setattr(repeats, "CELL", 8)
    rng = random.Random(9)
    passage = "".join(rng.choices("abcdefgh ", k=120))
    texts = ["".join(rng.choices("xyz", k=30)) + passage[: rng.randint(60, 120)] + "".join(rng.choices("xyz", k=40)) for _ in range(40)]
    docs = [(None if i % 2 else 2**62 + 1 + 2 * i, t) for i, t in enumerate(texts)]
    found = repeats.remove_repeats(spark.createDataFrame(docs, "doc_id bigint, text string"), length=60, gram=20).collect()
    want = [
        (d, bytes(b for b, c in zip(t.encode(), covered) if not c))
        for (d, t), covered in zip(docs, brute([t.encode() for t in texts], 60))
    ]
    order = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, bytes(r.kept)) for r in found), key=order) == sorted(want, key=order)
    assert any(len(kept) < len(t) for (_, kept), t in zip(want, texts))
