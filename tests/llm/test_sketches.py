import hashlib

import pytest
from pyspark.sql import functions as F

from flowsieve.llm import sketches
from tests.llm.rows import documents, empty, prose, words


def jaccard(a, b):
    def shingles(t):
        w = words(t)
        return {tuple(w)} - {()} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_next_and_edited_texts(spark, monkeypatch):
    monkeypatch.setattr(sketches, "RANGE_ROWS", 3)
    docs = documents(spark, [f"doc {i} " + prose(50 + i, i) for i in range(30)]).where("doc_id is not null").dropDuplicates(["doc_id"])
    order = sorted(docs.collect(), key=lambda r: -r.doc_id)
    rows = {r.doc_id: r for r in sketches.fingerprints(docs).collect()}
    assert len(rows) == len(order)
    for r, following in zip(order, order[1:] + order[:1]):
        text, half = r.text or "", len(r.text or "") // 2
        edited = text[: len(text) - half] + (following.text or "")[:half]
        assert rows[r.doc_id].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert rows[r.doc_id].n_chars == len(text)


def test_null_and_repeated_ids_keep_their_rows(spark):
    docs = documents(spark)
    assert sketches.fingerprints(docs).count() == docs.count()
    assert sketches.fingerprints(empty(spark)).count() == 0
    one = spark.createDataFrame([(4, "a b c d e f")], "doc_id bigint, text string")
    assert sketches.fingerprints(one).first().edited_sha256 == hashlib.sha256(b"a b c a b c").hexdigest()


@pytest.mark.parametrize("other", [prose(1, 400), prose(2, 400), prose(1, 200) + " " + prose(3, 200), "", "one two", None])
def test_estimates(spark, other):
    text = prose(1, 400)
    rows = spark.createDataFrame([(text, other)], "a string, b string")
    rows = sketches.add_sketch(sketches.add_sketch(rows, "a", "x"), "b", "y")
    r = rows.select(
        sketches.resemblance(F.col("x"), F.col("y")).alias("near"),
        sketches.containment(F.col("y"), F.col("x")).alias("inside"),
        sketches.distinct_shingles(F.col("x")).alias("n"),
        "x",
    ).first()
    assert r.near == pytest.approx(jaccard(text, other), abs=0.12)
    assert r.n == pytest.approx(396, rel=0.3)
    assert len(r.x) == sketches.K and r.x == sorted(set(r.x))
    if other and other != "one two":
        common = {tuple(words(text)[i : i + 5]) for i in range(396)} & {tuple(words(other)[i : i + 5]) for i in range(len(words(other)) - 4)}
        assert r.inside == pytest.approx(len(common) / (len(words(other)) - 4), abs=0.15)


def test_small_sets_are_exact(spark):
    texts = ["a b c d e f g", "a b c d e f h", " a b\tc\nd e f g ", "x", "x", "", "  "]
    rows = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    rows = sketches.add_sketch(sketches.add_sketch(rows, "a", "x"), "b", "y")
    for r in rows.select("a", "b", sketches.resemblance(F.col("x"), F.col("y")).alias("near")).collect():
        assert r.near == pytest.approx(jaccard(r.a, r.b))


def test_merged_parts_equal_the_whole(spark):
    parts = [("g", prose(1, 300)), ("g", prose(2, 300)), ("g", prose(1, 300)), ("h", ""), (None, prose(3, 50))]
    rows = sketches.add_sketch(spark.createDataFrame(parts, "g string, t string"), "t", "sketch").select("g", "sketch")
    found = {r.g: r.sketch for r in sketches.merge_groups(rows, "g", "sketch").collect()}
    own = [r.sketch for r in rows.collect()]
    assert found["g"] == sorted(set(own[0]) | set(own[1]))[: sketches.K]
    assert found["h"] == [] and found[None] == own[4]
