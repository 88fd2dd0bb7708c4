import random

import numpy as np
import pytest

from flowsieve.llm import jaccard_join
from flowsieve.llm.queries import ORACLE_SQL, op13_jaccard_join
from tests.llm.rows import documents, empty, prose, words
from tests.oracle import compare


def shingles(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def brute(rows):
    """Contract rows of ``(doc_id, text)`` from all pairs."""
    sets, group = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and group[i] != group[j] and 100 * len(a & sets[j]) >= 90 * len(a | sets[j]):
                x, y = sorted((group[i], group[j]))
                group = [x if g == y else g for g in group]
    lowest = {}
    for (i, _), g in zip(rows, group):
        if i is not None:
            lowest[g] = min(i, lowest.get(g, i))
    return sorted(((i, len(s), lowest.get(g)) for (i, _), s, g in zip(rows, sets, group)), key=repr)


def actual(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "n_shingles", "component_id").collect()), key=repr)


def edited(text, changes, rng):
    w = text.split()
    for i in rng.sample(range(len(w)), changes):
        w[i] = f"new{rng.random()}"
    return " ".join(w)


def texts_around_the_limit(sizes=(12, 20, 25, 31, 33, 60, 130, 150, 500, 2100)):
    rng, out = random.Random(3), []
    for seed, n in enumerate(sizes):
        base = prose(seed + 50, n)
        out += [base, base.upper(), base + " one", base + " one two", " ".join(base.split()[1:]), " ".join(base.split()[2:])]
        out += [edited(base, c, rng) for c in range(1, max(3, n // 25)) for _ in range(3)]
    passage = prose(77, 40)
    out += [f"{prose(200 + i, 30)} {passage} {prose(300 + i, 20)}" for i in range(30)]
    return out


def frame_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_least_common_is_the_limit():
    for a in range(1, 60):
        for b in range(1, 60):
            for both in range(1, min(a, b) + 1):
                assert (100 * both >= 90 * (a + b - both)) == (both >= jaccard_join.least_common(a, b))


def test_sketches_never_reject_a_link():
    rng = np.random.default_rng(1)
    for n in (5, 60, 64, 120, 127, 128, 500, 3000):
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            b = np.unique(np.concatenate([a[rng.random(n) > 0.04], rng.integers(0, 2**63, n // 25, dtype=np.uint64)]))
            width = jaccard_join.band_width(max(len(a), len(b)))
            x, y = (np.frombuffer(jaccard_join.parity_sketch(s, width), np.uint64).reshape(1, -1) for s in (a, b))
            near = jaccard_join._near(x, y, np.array([len(a)]), np.array([len(b)]))[0]
            assert near or not jaccard_join.similar(a, b)


def test_subsets_meet_exactly_where_sets_link():
    rng = random.Random(2)
    for _ in range(2000):
        n = rng.randint(1, 29)
        a = set(rng.sample(range(10**6), n))
        b = set(rng.sample(sorted(a), n - min(n - 1, rng.randint(0, 3)))) | {10**7 + i for i in range(rng.randint(0, 3))}
        if len(b) < 30:
            keys = [set(jaccard_join.subset_keys(np.array(sorted(s), np.uint64))) for s in (a, b)]
            shared = [c for c, _ in keys[0] & keys[1]]
            linked = 100 * len(a & b) >= 90 * len(a | b)
            assert linked == any(9 * (len(a) + len(b)) <= 19 * c for c in shared)


@pytest.mark.parametrize("limit", [None, 1, 30])
def test_query_around_the_limit(spark, tmp_path, monkeypatch, limit):
    if limit:
        monkeypatch.setattr(jaccard_join, "boundary", lambda light, heavy: limit)
    texts = texts_around_the_limit()
    frame_of(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    wanted = brute(list(enumerate(texts)))
    assert actual(op13_jaccard_join(spark, str(tmp_path))) == wanted
    assert 10 < len({c for _, _, c in wanted}) < len(texts) - 30


def test_blocks_and_frequent_shingles(spark, monkeypatch):
    texts = texts_around_the_limit((25, 31, 60, 150, 500))
    monkeypatch.setattr(jaccard_join, "PAIRED_ROWS", 3)
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", 4)
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 700)
    monkeypatch.setattr(jaccard_join, "FREQUENT", 4)
    monkeypatch.setattr(jaccard_join, "COUNTED", 3000)
    docs = frame_of(spark, texts)
    assert len(jaccard_join.frequent_shingles(docs)) > 30
    assert actual(jaccard_join.jaccard_groups(docs)) == brute(list(enumerate(texts)))


def test_awkward_rows(spark):
    docs = documents(spark, ["One  two", "x y z", "X y\tz ", "x y", " ", "q"])
    assert actual(jaccard_join.jaccard_groups(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert jaccard_join.jaccard_groups(empty(spark)).count() == 0


def test_boundary_follows_the_costs():
    assert jaccard_join.boundary({n: 1 for n in range(30)}, {n: 100 for n in range(30)}) == 30
    assert jaccard_join.boundary({n: n for n in range(30)}, {n: 10 for n in range(30)}) in (10, 11)
    assert jaccard_join.boundary({n: 100 for n in range(30)}, {}) == 1


def test_tables_against_sql(spark):
    assert compare(spark, "/root/testdata/sf0.01", op13_jaccard_join, ORACLE_SQL["op13_jaccard_join"]) is None
