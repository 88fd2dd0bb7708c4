from collections import Counter, defaultdict

import pytest

from flowsieve.llm import mixing
from tests.llm.rows import documents, empty, prose, words


def water_levels(sizes, share=1.5, most=2, weights=(5, 2, 1)):
    """Targets by resharing the excess round after round."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = dict.fromkeys(order, 0.0), list(order), share * sum(sizes.values())
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = 0.0
        for s in list(open_):
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.remove(s)
    return target


def check(rows, sizes):
    targets = water_levels(sizes)
    taken = defaultdict(int)
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(targets[r.source])
        taken[r.source] += r.taken
    for s, t in targets.items():
        assert t - 4 < taken[s] <= t + 1e-6


def test_mix_meets_every_budget(spark):
    docs = documents(spark)
    rows = mixing.mix(docs).collect()
    sizes = Counter()
    for r in docs.collect():
        sizes[r.source] += len(words(r.text))
    assert len(rows) == docs.count()
    assert sorted((str(r.doc_id), r.size) for r in rows) == sorted((str(r.doc_id), len(words(r.text))) for r in docs.collect())
    check(rows, sizes)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))


def test_mix_over_a_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = Counter()
    for r in docs.collect():
        sizes[r.source] += len(words(r.text))
    check(mixing.mix(docs).collect(), sizes)


def test_copies_hold_the_words_taken(spark):
    docs = documents(spark)
    taken = sum(r.taken for r in mixing.mix(docs).collect())
    copies = mixing.mixed_copies(docs)
    assert copies.columns == docs.columns
    rows = copies.collect()
    assert sum(len(words(r.text)) for r in rows) == taken
    assert all(r.n_chars == len(r.text) for r in rows)


def test_empty_table_and_single_source(spark):
    assert mixing.mix(empty(spark)).count() == 0
    one = spark.createDataFrame([(i, prose(i, 50), "s") for i in range(20)], "doc_id bigint, text string, source string")
    assert sum(r.taken for r in mixing.mix(one).collect()) == 1500
