from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from flowsieve.llm import mixing, repetition, secrets
from tests.llm.rows import documents, empty, prose, words
from tests.llm.test_near_copies import brute_groups
from tests.llm.test_tokens import check_packing


def brute_kept(docs):
    """Rules, then one row per group: ids must be distinct."""
    limits = repetition.COVERAGE_LIMITS
    good = []
    for r in sorted(docs, key=lambda r: r.doc_id):
        n, _, _, _, repeat, lines, shares = repetition.measure(r.text, tuple(limits))
        if n >= 50 and 100 * repeat <= 50 * n and lines <= repetition.LINE_LIMIT and all(s <= m for s, m in zip(shares, limits.values())):
            good.append(r)
    groups = brute_groups([r.text for r in good])
    return [r for i, r in enumerate(good) if groups[i] == i]


def brute_redacted(text):
    novelty, at, out = secrets.Novelty(), 0, ""
    base = secrets.base_spans(text)
    for _, s, e in sorted(base + secrets.novel_spans(text, base, novelty), key=lambda x: x[1]):
        if s >= at:
            out += text[at:s] + "[SECRET]"
        at = max(at, e)
    return out + text[at:]


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    frame, results = docs, []
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, sf_dir)
        results.append(frame)
    rules, single, redacted, mixed, packed = results
    for r in results[:-1]:
        assert r.columns == docs.columns and dict(r.dtypes) == dict(docs.dtypes)
    kept = brute_kept(docs.collect())
    assert sorted(r.doc_id for r in single.collect()) == sorted(r.doc_id for r in kept)
    clean = {r.doc_id: brute_redacted(r.text) for r in kept}
    assert {r.doc_id: r.text for r in redacted.collect()} == clean
    copies = mixed.collect()
    assert len(copies) == sum(-(-r.taken // r.size) for r in mixing.mix(redacted).collect() if r.taken)
    assert all(Counter(words(r.text)) <= Counter(words(clean[r.doc_id])) for r in copies)
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    check_packing(packed.collect(), [(r.doc_id, [*plain.encode(r.text, add_special_tokens=False).ids, 0]) for r in copies], 1024)
    assert corpus_pipeline.run(spark, sf_dir).count() == packed.count()


def test_awkward_rows_and_empty_tables(spark):
    docs = documents(spark, [prose(1, 300) + " password=b7db7aa4a5fcc78305"])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() > 0
    docs = empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0
