import random

import numpy as np
import pytest

import corpus_pipeline
from flowsieve.llm import near_copies, simhash
from tests.llm.rows import documents, empty, prose, words


def shingles(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near(a, b):
    both = len(a & b)
    return 5 * both >= 4 * (len(a) + len(b) - both)


def brute_groups(texts):
    """Smallest index reachable over pairs of similarity 0.8 or more."""
    sets, group = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if group[i] != group[j] and near(sets[i], sets[j]):
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    return group


def edited(text, changes, rng):
    w = text.split()
    for i in rng.sample(range(len(w)), changes):
        w[i] = f"new{rng.random()}"
    return " ".join(w)


def edited_texts():
    """Copies of long and short texts with more and more words changed, on both sides of the limit."""
    rng = random.Random(3)
    return [edited(prose(s, n), c, rng) for s, n in enumerate((60, 150, 400, 1500)) for c in [k * n // 200 for k in range(9)] for _ in range(3)]


def kept_ids(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    stage = dict(corpus_pipeline.STAGES)["simhash_near_duplicates"]
    return sorted(r.doc_id for r in stage(spark, docs, "").collect())


def test_near_copies_beyond_three_bits(spark):
    texts = edited_texts()
    groups = brute_groups(texts)
    assert kept_ids(spark, texts) == sorted(set(groups))
    assert 4 < len(set(groups)) < len(texts) / 2


def test_crowded_keys_in_blocks(spark, monkeypatch):
    texts = edited_texts()
    monkeypatch.setattr(near_copies, "PAIRED_SETS", 3)
    monkeypatch.setattr(near_copies, "BLOCK_SHINGLES", 700)
    assert kept_ids(spark, texts) == sorted(set(brute_groups(texts)))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_recall_on_the_tables(spark, sf):
    rows = sorted(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect())
    texts = [r.text for r in rows]
    groups = brute_groups(texts)
    assert kept_ids(spark, texts) == sorted(set(groups))


def test_equal_fingerprints_of_unlike_sets(spark):
    # Repeated words decide the fingerprint; the sets share a few shingles only.  One more text links to either by its set.
    body = "ka lo min " * 200
    texts = [body + prose(31, 30), prose(33, 90), body + prose(32, 30), edited(body + prose(32, 30), 0, random.Random(1)) + " end"]
    prints = [simhash.simhash(t) for t in texts]
    assert (prints[0] ^ prints[2]).bit_count() <= 3 and not near(shingles(texts[0]), shingles(texts[2]))
    assert kept_ids(spark, texts) == [0, 1]
    assert kept_ids(spark, texts[1:]) == [0, 1]


def test_awkward_rows(spark):
    docs = documents(spark, ["One  two", "x y z", "X y\tz "])
    kept = near_copies.keep_one(docs)
    assert kept.columns == docs.columns
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    groups = brute_groups([r.text for r in rows])
    assert kept.count() == len(set(groups))
    assert {r.doc_id for r in kept.collect()} == {rows[g].doc_id for g in groups}
    assert near_copies.keep_one(empty(spark)).count() == 0


def test_the_limit_itself_is_near():
    a = np.arange(9, dtype=np.uint64)
    assert near_copies.similar(a[:8], a) and near_copies.similar(a[:4], a[:5])
    assert not near_copies.similar(a[:3], a[:4])
