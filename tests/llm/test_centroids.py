import math
import random
from hashlib import sha256

import numpy as np

from flowsieve.llm import centroids
from flowsieve.llm.centroids import Centroids
from flowsieve.llm.queries import ORACLE_SQL, op11_centroid_clusters
from tests.oracle import compare

SCHEMA = "vec_id bigint, embedding array<float>, label int, cluster string, v string, n int"


def brute(rows, count=40, rounds=5):
    """``[(vec_id, cluster, distance)]`` and the centroids, one vector after the other."""
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    points = [v for _, v in order[:count]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(points))

    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(nearest(v)[1], []).append(v)
        points = [[sum(x) // len(members[i]) for x in zip(*members[i])] if i in members else c for i, c in enumerate(points)]
    return [(i, *reversed(nearest(v))) for i, v in kept], points


def expected(rows):
    found, points = brute(rows)
    per = {}
    for _, c, d in found:
        per[c] = per.get(c, 0) + d
    return sorted(
        (repr(i), c, d, per[c], sum(per.values()), sha256(",".join(map(str, points[c])).encode()).hexdigest()) for i, c, d in found
    )


def actual(frame):
    rows = frame.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()
    return sorted((repr(r[0]), *r[1:]) for r in rows)


def written(spark, tmp_path, rows, schema=SCHEMA):
    frame = spark.createDataFrame([(i, v, 0, "x", "y", 1) for i, v in rows], schema)
    frame.write.parquet(f"{tmp_path}/embeddings.parquet")
    return op11_centroid_clusters(spark, str(tmp_path))


def test_search_against_all_distances():
    rng = np.random.default_rng(1)
    for spread in (3, 200, 10**6, 10**12):
        vectors = rng.integers(-spread, spread, (400, 64))
        vectors[:50] = vectors[50:100]
        points = vectors[::10].tolist() + vectors[:3].tolist()
        wide = np.array(vectors.tolist(), dtype=object) if spread > 10**6 else vectors
        number, distance, compared = Centroids(points).nearest(wide)
        all_of = [[sum((int(a) - b) ** 2 for a, b in zip(v, c)) for c in points] for v in vectors]
        assert [min(d) for d in all_of] == distance.tolist()
        assert [d.index(min(d)) for d in all_of] == number.tolist()
        assert compared <= 400 * len(points)


def test_bounds_reject_most_centroids_of_separate_groups():
    rng = np.random.default_rng(2)
    centres = np.outer(np.arange(40), np.ones(64, np.int64)) * 100
    vectors = np.repeat(centres, 20, axis=0) + rng.integers(-9, 9, (800, 64))
    number, _, compared = Centroids(centres.tolist()).nearest(vectors)
    assert number.tolist() == [i // 20 for i in range(800)]
    assert compared < 2 * 800


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(64)]) for i in range(300)]
    rows = [(i, np.array(v, np.float32).tolist()) for i, v in rows]
    rows += [(300 + i, rows[i][1]) for i in range(30)] + [rows[5], rows[5], (7, rows[8][1]), (None, rows[9][1]), (None, rows[11][1])]
    bad = [(900, None), (901, []), (902, [0.5] * 63), (903, [0.5] * 65), (904, [None] + [0.5] * 63), (905, [math.nan] + [0.5] * 63), (906, [-math.inf] * 64)]
    assert actual(written(spark, tmp_path, rows + bad)) == expected(rows)


def test_fewer_vectors_than_centroids_and_ties(spark, tmp_path):
    rows = [(i, [float(i // 2)] * 64) for i in range(7)]
    assert actual(written(spark, tmp_path, rows)) == expected(rows)


def test_no_vectors(spark, tmp_path):
    assert actual(written(spark, tmp_path, [(1, None)])) == []


def test_large_components(spark, tmp_path):
    rows = [(i, [float((i * 37 + j) % 11) * 2.0**22 for j in range(64)]) for i in range(60)]
    assert actual(written(spark, tmp_path, rows)) == expected(rows)


def test_distances_beyond_64_bits_are_null(spark, tmp_path):
    rows = [(i, [float(10.0**20 if i % 2 else -(10.0**20))] * 64) for i in range(1, 3)] + [(3, [0.0] * 64)]
    frame = spark.createDataFrame([(i, v) for i, v in rows], "vec_id bigint, embedding array<float>")
    found = centroids.clusters(frame, count=1).collect()
    assert sorted(r.vec_id for r in found) == [1, 2, 3]
    assert any(r.distance is None for r in found) and all(r.inertia is None for r in found)


def test_tables_against_sql(spark):
    assert compare(spark, "/root/testdata/sf0.001", op11_centroid_clusters, ORACLE_SQL["op11_centroid_clusters"]) is None
