"""Prefix selection, cutoffs, ranks, running totals and quantiles against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsieve.functions.hashing import hash60
from flowsieve.operators import allocate
from flowsieve.operators.allocate import flag_quota, hash_levels, prefix_allocate, rank_in_group, running_totals, take_prefix
from flowsieve.operators.joins import broadcast_if_small, lookup_join
from flowsieve.operators.quantiles import exact_quantiles
from tests.test_scalars import python_hash


def rows_of(seed, n=400, hot=0.35):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        group = "hot" if rng.random() < hot else f"g{rng.randrange(6)}"
        out.append((f"k{i}", group, rng.randrange(20), rng.randrange(0, 5)))
    return out


SCHEMA = "key string, grp string, at int, w int"


def brute(rows, quota, grouped=True, weighted=False):
    out, used = {}, {}
    for key, group, at, w in sorted(rows, key=lambda r: (r[2], python_hash(r[0]), r[0])):
        g = group if grouped else None
        limit = quota.get(g, 0) if isinstance(quota, dict) else quota
        need = w if weighted else 1
        give = max(0, min(need, limit - used.get(g, 0)))
        used[g] = used.get(g, 0) + need
        out[key] = give
    return out


@pytest.fixture(params=[0, 5, 200_000])
def rank_limit(request, monkeypatch):
    """0 and 5 force every level to be used, the default stops early."""
    monkeypatch.setattr(allocate, "DIRECT_RANK_ROWS", request.param)


@pytest.mark.parametrize("quota", [0, 1, 37, 10_000])
@pytest.mark.parametrize("weighted", [False, True])
def test_prefix_allocate(spark, rank_limit, quota, weighted):
    rows = rows_of(quota)
    df = spark.createDataFrame(rows, SCHEMA)
    h = hash60(F.col("key"))
    for grouped in (True, False):
        out = prefix_allocate(
            df,
            group=["grp"] if grouped else [],
            quota=quota,
            levels=[F.col("at"), *hash_levels(h)],
            tie=[h, F.col("key")],
            weight=F.col("w") if weighted else None,
        )
        assert {r["key"]: r["alloc"] for r in out.collect()} == brute(rows, quota, grouped, weighted)


def test_quota_per_group(spark):
    rows = rows_of(3)
    df = spark.createDataFrame(rows, SCHEMA)
    quota = {"hot": 50, "g1": 2}
    frame = spark.createDataFrame(list(quota.items()), "grp string, quota int")
    h = hash60(F.col("key"))
    out = take_prefix(df, group=["grp"], quota=frame, levels=[F.col("at")], tie=[h, F.col("key")])
    assert {r["key"] for r in out.collect()} == {k for k, n in brute(rows, quota).items() if n}


def test_many_groups_take_the_shuffle_path(spark, monkeypatch):
    monkeypatch.setattr(allocate, "MAX_BROADCAST_GROUPS", 2)
    rows = rows_of(4)
    h = hash60(F.col("key"))
    out = take_prefix(
        spark.createDataFrame(rows, SCHEMA), group=["grp"], quota=5, levels=[F.col("at"), *hash_levels(h)], tie=[h, F.col("key")]
    )
    assert {r["key"] for r in out.collect()} == {k for k, n in brute(rows, 5).items() if n}


@pytest.mark.parametrize("quota", [0, 1, 60, 5_000])
@pytest.mark.parametrize("limit,bits", [(0, 3), (5, 4), (200_000, 14)])
def test_cutoffs(spark, monkeypatch, quota, limit, bits):
    monkeypatch.setattr(allocate, "DIRECT_RANK_ROWS", limit)
    monkeypatch.setattr(allocate, "_HASH_LEVEL_BITS", bits)
    rows = rows_of(9)
    df = spark.createDataFrame(rows, SCHEMA)
    h, key = hash60(F.col("key")), F.col("key")
    flat = [(k, g, 0, 1) for k, g, _, _ in rows]
    cut = flag_quota(df, hash60=h, key=key, quota=quota, group="grp", out="picked")
    assert {r["key"] for r in cut.where("picked").collect()} == {k for k, n in brute(flat, quota).items() if n}
    whole = flag_quota(df, hash60=h, key=key, quota=quota, out="picked")
    assert {r["key"] for r in whole.where("picked").collect()} == {k for k, n in brute(flat, quota, False).items() if n}


@pytest.mark.parametrize("groups", [1, 256])
@pytest.mark.parametrize("quota", [1, 10, 50, 299, 1000])
def test_repeated_keys_give_exact_quotas(spark, monkeypatch, quota, groups):
    """100 keys three times each, and null keys; literal limits and joined ones."""
    monkeypatch.setattr(allocate, "MAX_LITERAL_GROUPS", groups)
    rows = [(f"k{i % 100}" if i % 100 else None, "ab"[i % 100 % 2], i) for i in range(300)]
    df = spark.createDataFrame(rows, "key string, grp string, n int").repartition(5)
    h, key = hash60(F.col("key")), F.col("key")
    one = flag_quota(df, hash60=h, key=key, quota=quota, out="picked").where("picked")
    assert one.count() == min(300, quota)
    per = {r["grp"]: r["count"] for r in flag_quota(df, hash60=h, key=key, quota=quota, group="grp", out="picked").where("picked").groupBy("grp").count().collect()}
    assert per == {"a": min(150, quota), "b": min(150, quota)}
    uneven = flag_quota(df, hash60=h, key=key, quota={"a": quota, "b": 2}, group="grp", out="picked").where("picked")
    assert {r["grp"]: r["count"] for r in uneven.groupBy("grp").count().collect()} == {"a": min(150, quota), "b": 2}
    assert {r["n"] for r in one.collect()} <= {r["n"] for r in flag_quota(df, hash60=h, key=key, quota=quota + 7, out="p").where("p").collect()}


def test_samples_and_splits_with_repeated_rows(spark):
    from flowsieve.operators import sampling

    rows = [(f"k{i % 40}", i % 40 % 2) for i in range(120)]
    df = spark.createDataFrame(rows, "key string, label int")
    assert sampling.uniform_sample(df, 10, key="key").count() == 10
    assert [r["count"] for r in sampling.class_sample(df, label="label", key="key", per_class=10).groupBy("label").count().collect()] == [10, 10]
    split = sampling.stratified_split(df, label="label", key="key", test_share=0.25)
    assert {(r["split"], r["label"]): r["count"] for r in split.groupBy("split", "label").count().collect()} == {
        ("test", 0): 15, ("test", 1): 15, ("train", 0): 45, ("train", 1): 45,
    }
    both = sampling.dual_holdout(df, label="label", key="key", natural_rows=50, per_class_rows=20)
    assert both.where("in_natural").count() == 50 and both.where("in_balanced").count() == 40


def test_samples_do_not_depend_on_partitions(spark):
    from flowsieve.operators.sampling import uniform_sample

    df = spark.createDataFrame(rows_of(2), SCHEMA)
    picks = [
        {r["key"] for r in uniform_sample(frame, 80, key="key").collect()}
        for frame in (df, df.repartition(7), df.coalesce(1), df.orderBy(F.col("key").desc()))
    ]
    assert all(p == picks[0] for p in picks) and len(picks[0]) == 80
    assert {r["key"] for r in uniform_sample(df, 30, key="key").collect()} < picks[0]


@pytest.mark.parametrize("cell_rows", [3, 50_000])
def test_rank_in_group(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(allocate, "_RANK_CELL_ROWS", cell_rows)
    rows = rows_of(5)
    h = hash60(F.col("key"))
    out = rank_in_group(spark.createDataFrame(rows, SCHEMA), group=["grp"], hash60=h, tie=[F.col("key")], out="rank")
    got = {r["key"]: r["rank"] for r in out.collect()}
    for group in {r[1] for r in rows}:
        members = sorted((r[0] for r in rows if r[1] == group), key=lambda k: (python_hash(k), k))
        assert [got[k] for k in members] == list(range(len(members)))


@pytest.mark.parametrize("cells", [2, 16, 512])
def test_running_totals(spark, cells):
    rng = random.Random(1)
    scores = sorted({round(rng.gauss(0, 1), 3) for _ in range(500)})
    rows = [(s, rng.randrange(5), rng.randrange(5)) for s in scores]
    df = spark.createDataFrame(rows, "score double, a long, b long").repartition(5)
    out = sorted(running_totals(df, order_by="score", sums=["a", "b"], cells=cells).collect())
    total_a = np.cumsum([r[1] for r in rows]).tolist()
    total_b = np.cumsum([r[2] for r in rows]).tolist()
    assert [(r["cum_a"], r["cum_b"]) for r in out] == list(zip(total_a, total_b))


@pytest.mark.parametrize("finish", [0, 20, 100_000])
def test_quantiles(spark, monkeypatch, finish):
    """With a low finishing limit the narrowing loop runs all the way."""
    from flowsieve.operators import quantiles

    monkeypatch.setattr(quantiles, "_FINISH_ROWS", finish)
    monkeypatch.setattr(quantiles, "_CELLS", 8)
    rng = np.random.default_rng(0)
    data = {
        "skewed": (rng.pareto(0.5, 300) * 10).tolist(),
        "ties": [3.0] * 150 + rng.integers(0, 5, 100).astype(float).tolist(),
        "one": [7.5],
        "wide": [-1e300, 0.0, 1e-300, 1e300],
    }
    rows = [(g, v) for g, values in data.items() for v in values] + [("ties", None), ("ties", float("nan")), ("one", float("inf"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    probs = [0.0, 0.25, 0.5, 0.8, 0.99, 1.0]
    for r in exact_quantiles(df, "v", probs, ["g"]).collect():
        want = np.quantile(data[r["g"]], probs)
        assert np.allclose([r[f"q{i}"] for i in range(len(probs))], want, rtol=1e-12, atol=0.0)
        assert r["n"] == len(data[r["g"]])


def test_hot_keys_are_salted(spark):
    """A tiny hot limit sends every key through the salted join; results stay those of a left join."""
    rows = rows_of(6) + [("null1", None, 1, 1), ("null2", None, 2, 2)]
    facts = spark.createDataFrame(rows, SCHEMA)
    lookup = facts.where(F.col("grp").isNotNull() & (F.col("grp") != "g3")).groupBy("grp").agg(
        F.count(F.lit(1)).alias("n"), F.sum("w").alias("total")
    )
    plain = facts.join(lookup, "grp", "left").select("key", "grp", "n", "total")
    for hot in (1, 20, 10_000):
        out = lookup_join(facts, lookup, ["grp"], weight="n", spread_by=["key"], hot_rows=hot).select("key", "grp", "n", "total")
        assert sorted(map(repr, out.collect())) == sorted(map(repr, plain.collect()))


def test_broadcast_only_below_the_limit(spark):
    df = spark.range(50)
    assert broadcast_if_small(df, 49) is df
    assert broadcast_if_small(df, 50) is not df


def test_quantiles_of_many_groups(spark, monkeypatch):
    import numpy as np

    from flowsieve.operators import quantiles

    rng = np.random.default_rng(4)
    rows = [(int(g) if g else None, float(v)) for g, v in zip(rng.integers(0, 40, 4000) ** 2 // 30, rng.normal(0, 9, 4000).round(1))]
    df = spark.createDataFrame([*rows, (1, None), (7, float("nan"))], "g int, v double")
    monkeypatch.setattr(quantiles, "MAX_GROUPS", 6)
    monkeypatch.setattr(quantiles, "_FINISH_ROWS", 80)
    found = {r.g: r for r in quantiles.exact_quantiles(df, "v", [0.1, 0.5, 0.99], ["g"]).collect()}
    values = {}
    for g, v in rows:
        values.setdefault(g, []).append(v)
    assert found.keys() == values.keys() and len(values) > 12
    for g, v in values.items():
        assert found[g].n == len(v)
        assert [found[g][f"q{i}"] for i in range(3)] == pytest.approx(np.quantile(v, [0.1, 0.5, 0.99]).tolist(), abs=1e-9)
