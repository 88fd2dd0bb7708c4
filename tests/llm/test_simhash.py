import random

import xxhash

from flowsieve.llm import simhash
from flowsieve.llm.common import components
from tests.llm.rows import documents, empty, prose, words


def brute_print(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    parts = [" ".join(w)] if len(w) < 3 else [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints):
    """Smallest index reachable over links of at most 3 bits."""
    group = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    return group


def test_fingerprints_and_groups(spark):
    docs = documents(spark, [prose(1, 300) + " tail", prose(1, 300).upper(), prose(2, 120) + " x " + prose(3, 60)])
    rows = simhash.near_duplicates(docs).collect()
    want = sorted((str(r.doc_id), brute_print(r.text)) for r in docs.collect())
    assert sorted((str(r.doc_id), r.fp % 2**64) for r in rows) == want
    source = sorted((r.doc_id for r in rows if r.doc_id is not None))
    assert len(rows) == docs.count() and source
    prints = [r.fp % 2**64 for r in rows]
    groups = brute_groups(prints)
    for i, r in enumerate(rows):
        ids = [rows[j].doc_id for j in range(len(rows)) if groups[j] == groups[i] and rows[j].doc_id is not None]
        assert r.component_id == (min(ids) if ids else None)


def test_links_against_all_pairs(spark, monkeypatch):
    """Random prints with planted neighbours, and one dense cluster dealt as block pairs."""
    monkeypatch.setattr(simhash, "PAIRED_ROWS", 8)
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 16)
    rng = random.Random(5)
    prints = [rng.getrandbits(64) for _ in range(150)]
    for p in prints[:60]:
        for _ in range(rng.randint(1, 3)):
            q = p
            for b in rng.sample(range(64), rng.randint(1, 4)):
                q ^= 1 << b
            prints.append(q)
    dense = rng.getrandbits(64)
    prints += [dense ^ sum(1 << b for b in rng.sample(range(64), 2)) for _ in range(120)]
    prints = sorted(set(prints))
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    links = simhash.fingerprint_links(frame).collect()
    assert all(((r.a ^ r.b) % 2**64).bit_count() <= 3 for r in links)
    place = {p: i for i, p in enumerate(signed)}
    group = list(range(len(prints)))
    for r in links:
        a, b = group[place[r.a]], group[place[r.b]]
        group = [min(a, b) if g in (a, b) else g for g in group]
    assert group == brute_groups(prints)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 201)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(found[i] == 0 for i in range(41))
    assert all(found[i] == 100 for i in range(100, 160))
    assert found[200] == found[201] == 200 and len(found) == 41 + 60 + 2


def test_one_document_of_each_group_stays(spark):
    docs = documents(spark)
    rows = simhash.near_duplicates(docs).collect()
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({r.root for r in rows})
    assert {r.doc_id for r in kept.collect()} == {r.component_id for r in rows}


def test_empty_table(spark):
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.keep_one(empty(spark)).count() == 0
