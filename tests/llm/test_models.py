import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsieve.llm import additive, toxicity
from flowsieve.llm.common import held_out, labelled_sample
from flowsieve.llm.queries import op2_quality_scores, op10_toxicity
from tests.llm.rows import documents, empty, prose

LABELS = "doc_id bigint, quality int, toxic int"


def toxic_documents(spark):
    """Clean prose, and prose with known insults or with one invented stem and many endings."""
    rows = []
    for i in range(480):
        text = prose(1000 + i, 60) + ". and the rest such an."
        if i % 4 == 0:
            text += f" gruz{'abcdefgh'[i // 8 % 8]}m" if i % 8 else " idiot"
        rows.append((i, text, int(i % 4 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    return docs, spark.createDataFrame([(r[0], 1, r[2]) for r in rows], LABELS), rows


def test_held_out_rule(spark):
    rows = spark.createDataFrame([(i,) for i in range(200)] + [(None,)], "doc_id bigint").withColumn("h", held_out(F.col("doc_id"))).collect()
    for r in rows:
        assert r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_sample_never_holds_held_out_rows(spark):
    docs, labels, _ = toxic_documents(spark)
    ids = {r.text for r in labelled_sample(docs, labels, "toxic", 50).collect()}
    banned = {r.text for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert len(ids) == 50 and not ids & banned


def test_toxic_terms_are_learned(spark):
    docs, labels, rows = toxic_documents(spark)
    lexicon = toxicity.learn(docs, labels)
    assert "gruz" in lexicon.stems
    grammar = toxicity.Grammar(lexicon)
    for _, text, label in rows:
        assert (grammar.score(text) >= toxicity.TOXIC_AT) == bool(label)
    assert grammar.score("unseen ending: gruzxyq") >= toxicity.TOXIC_AT > grammar.score(None) == grammar.score("")


def test_rare_insults_among_many_common_terms(spark):
    """More terms than the driver once took, all more frequent than the insult and as frequent in clean texts."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    common = " ".join("w" + letters[i // 17_576 % 26] + letters[i // 676 % 26] + letters[i // 26 % 26] + letters[i % 26] for i in range(62_000))
    rows = [(common + (" gruzam gruzem gruzim" if i < 5 else ""), int(i < 7)) for i in range(14)]
    words, stems = toxicity._weights(spark.createDataFrame(rows, "text string, label int"))
    assert set(words) == {"gruzam", "gruzem", "gruzim"} and set(stems) == {"gru", "gruz"}


def test_clauses():
    grammar = toxicity.Grammar(toxicity.Lexicon())

    def weight(text):
        return grammar.clauses(text)[0][0]

    plain = weight("what an idiot.")
    assert plain == toxicity.SEED_WEIGHT
    assert weight("you are an idiot") == weight("an idiot are you") == plain * toxicity.AIMED
    assert weight("not an idiot") == plain * toxicity.NEGATED
    assert weight("he never was so much of an idiot") > plain * toxicity.NEGATED
    assert weight("somebody said idiot") == plain * toxicity.REPORTED
    assert weight("nobody came. what an idiot") == plain
    assert grammar.clauses("kill the process") == [] and grammar.clauses("i kill you")
    assert grammar.clauses("idiotic clowns, a scumbag") == []
    assert len(grammar.clauses("idiot. " * 30)) == 30
    assert grammar.clauses("idiot " * 3)[0] == (3 * plain, 3)


def test_additive_model_learns_shapes_and_pairs():
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (4000, 4))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (np.abs(x[:, 2]) > 0.9)).astype(float)
    model = additive.fit(x, y, pairs=2)
    assert any({a, b} == {0, 1} for a, b, _ in model.pairs)
    fresh = rng.uniform(-1, 1, (2000, 4))
    truth = (fresh[:, 0] * fresh[:, 1] > 0) ^ (np.abs(fresh[:, 2]) > 0.9)
    assert ((model.probability(fresh) >= 0.5) == truth).mean() > 0.85
    by_hand = model.intercept + sum(t[np.searchsorted(e, v, side="right")] for e, t, v in zip(model.edges, model.tables, fresh[0]))
    by_hand += sum(t[np.searchsorted(model.pair_edges[a], fresh[0, a], side="right"), np.searchsorted(model.pair_edges[b], fresh[0, b], side="right")] for a, b, t in model.pairs)
    assert model.log_odds(fresh[:1])[0] == pytest.approx(by_hand)


def test_models_without_labels(spark):
    none = spark.createDataFrame([], LABELS)
    assert additive.learn(documents(spark), none).probability(np.zeros((1, len(additive.FEATURES))))[0] == 0.5
    assert toxicity.learn(documents(spark), none) == toxicity.Lexicon()
    one = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (None, 0, 1)], LABELS)
    assert additive.learn(documents(spark), one).probability(np.zeros((1, len(additive.FEATURES))))[0] > 0.9
    assert toxicity.learn(empty(spark), one) == toxicity.Lexicon()


def test_awkward_texts_are_scored(spark):
    docs, labels, _ = toxic_documents(spark)
    model, lexicon = additive.learn(docs, labels), toxicity.learn(docs, labels)
    awkward = documents(spark)
    rows = awkward.select(additive.score(awkward.text, model).alias("q"), toxicity.score(awkward.text, lexicon).alias("t")).collect()
    assert len(rows) == awkward.count() and all(0 <= r.q <= 1 and 0 <= r.t <= 1 for r in rows)


@pytest.mark.parametrize("query,column,least", [(op2_quality_scores, "quality", 0.95), (op10_toxicity, "toxic", 0.9)])
def test_held_out_accuracy(spark, query, column, least):
    sf_dir = "/root/testdata/sf0.01"
    rows = query(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 50 and sum(r.predicted == r[column] for r in rows) / len(rows) >= least


def interpreted(grammar, text):
    """A clause read word by word with counters in place of composed tables."""
    negation = target = 99
    reported, waiting, score = 1.0, 0.0, 0.0
    for word in text.split():
        negation, target = negation + 1, target + 1
        if word in toxicity.SEEDS["negation"]:
            negation = 0
        elif word in toxicity.SEEDS["report"]:
            reported = toxicity.REPORTED
        elif word in toxicity.SEEDS["target"]:
            target, score, waiting = 0, score + waiting * (toxicity.AIMED - 1), 0.0
        elif found := grammar._output(word):
            weight = found[1] * (toxicity.NEGATED if negation <= toxicity.NEGATION_REACH else 1.0) * reported
            if target <= toxicity.TARGET_REACH:
                score += weight * toxicity.AIMED
            else:
                score, waiting = score + weight * (found[0] == "insult"), weight
    return score


def test_composed_tables_against_an_interpreter():
    import random

    rng = random.Random(8)
    grammar = toxicity.Grammar(toxicity.Lexicon({"zug": 1.5}, {"gru": 0.7}))
    vocabulary = ["idiot", "kill", "you", "not", "said", "zug", "gruxyz", "house", "and", "the"]
    for _ in range(3000):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 25)))
        assert grammar.clause(text)[0] == pytest.approx(interpreted(grammar, text), abs=1e-12)


def test_a_clause_may_begin_far_before_the_word():
    grammar = toxicity.Grammar(toxicity.Lexicon())
    alone = grammar.score("idiot")
    for gap in (0, 300, 500, 20_000):
        assert grammar.score("he said so. " + "word " * gap + "idiot") == alone
    assert grammar.score("he said " + "word " * 5_000 + "idiot") < alone
