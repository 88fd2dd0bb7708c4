import pytest

from flowsieve.llm import repetition
from tests.llm.rows import documents, empty, prose, words


def brute(text):
    w, text = words(text), text or ""
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    inside = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if words(line)]
    return (
        len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text),
        sum(line in lines[:i] for i, line in enumerate(lines)), len(inside),
    )


def test_base_measures(spark):
    docs = documents(spark, ["# a | b\n# a | b\n\n \n# a | b", "x y z x y z x y", "é è\x0bé\x0cè é è"]).where("doc_id is null or doc_id != 9")
    rows = repetition.with_rules(docs).collect()
    want = {str(r.doc_id) + str(r.text): brute(r.text) for r in docs.collect()}
    assert len(rows) == docs.count()
    for r in repetition.with_rules(docs).collect():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    got = sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)
    assert got == sorted(brute(r.text) for r in docs.collect()) and want


def brute_share(text, n):
    """Characters in windows seen before."""
    w, seen, inside = words(text), set(), set()
    for i in range(len(w) - n + 1):
        if tuple(w[i : i + n]) in seen:
            inside |= set(range(i, i + n))
        seen.add(tuple(w[i : i + n]))
    return sum(len(w[i]) for i in inside) / max(1, sum(map(len, w)))


@pytest.mark.parametrize("text", [prose(1, 80) + " " + prose(1, 40), "a b c d e " * 9, prose(2, 100), "a b"])
def test_coverage(text):
    found = repetition.measure(text, (2, 5, 8))
    assert found[6] == pytest.approx([brute_share(text, n) for n in (2, 5, 8)])


def test_verdicts(spark):
    passage = prose(11, 40)
    texts = [prose(1, 200), prose(2, 30), "\n".join([passage] * 6), prose(3, 60) + " " + prose(4, 45) + " " + prose(4, 45)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    kept = {r.doc_id: r.kept for r in repetition.with_rules(docs, limits={5: 0.2}).collect()}
    assert kept == {0: True, 1: False, 2: False, 3: False}
    assert repetition.keep_good(docs).columns == docs.columns
    assert repetition.with_rules(empty(spark)).count() == 0
    assert repetition.keep_good(documents(spark)).columns == documents(spark).columns


def test_query_against_sql(spark, sf_dir):
    from flowsieve.llm.queries import ORACLE_SQL, op8_quality_rules
    from tests.oracle import compare

    assert compare(spark, sf_dir, op8_quality_rules, ORACLE_SQL["op8_quality_rules"]) is None
