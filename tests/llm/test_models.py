import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandkeep.llm import quality as Q
from strandkeep.llm import toxicity as X


def folds(rows, modulus, held):
    return [r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == held) for r in rows]


@pytest.mark.parametrize(("module", "run", "label", "modulus", "held", "least"), [(Q, Q.op8_quality, "quality", 5, 0, 0.95), (X, X.op10_toxicity, "toxic", 4, 2, 0.9)])
def test_held_out_accuracy(spark, module, run, label, modulus, held, least):
    folder = "/root/testdata/sf0.1"
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = run(spark, folder).collect()
    assert len(rows) == 10_000 and all(folds(rows, modulus, held)) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    test = [r for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in test]) >= least
    one, two = ([r.score for r in test if labels[r.doc_id] == k] for k in (1, 0))
    assert np.mean([[a > b for b in two] for a in one]) >= least


@pytest.mark.parametrize(("score", "label"), [(Q.score_quality, "quality"), (X.score_toxicity, "toxic")])
def test_odd_rows(spark, odd_docs, no_docs, score, label):
    labels = spark.createDataFrame([(5, 1, 0), (3, 0, 1), (None, 1, 1), (99, 1, 1), (12, None, None), (5, 1, 1)], "doc_id long, quality int, toxic int")
    rows = score(odd_docs, labels).collect()
    assert len(rows) == 12 and all(0 <= r.score <= 1 for r in rows) and not any(r.held_out for r in rows if r.doc_id is None)
    assert score(odd_docs, labels.limit(0)).count() == 12 and score(no_docs, labels).count() == 0


def test_labels_of_the_held_out_fold_are_not_read(spark, tiny):
    docs, labels = (spark.read.parquet(f"{tiny}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id AS string)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality", "CASE WHEN crc32(cast(doc_id AS string)) % 4 = 2 THEN 1 - toxic ELSE toxic END AS toxic")
    for score in (Q.score_quality, X.score_toxicity):
        a, b = ([(r.doc_id, r.score) for r in score(docs, x).orderBy("doc_id", "text").collect()] for x in (labels, flipped))
        assert a == b


def test_interactions_by_the_identity_equal_all_pairs():
    rng = np.random.default_rng(2)
    n = 40
    model = {"b": np.float32(0.3), "w": rng.normal(size=n).astype(np.float32), "v": rng.normal(size=(n, 4)).astype(np.float32)}
    x = (rng.random((3, n)) * (rng.random((3, n)) < 0.3)).astype(np.float32)
    want = [model["b"] + r @ model["w"] + sum((model["v"][i] @ model["v"][j]) * r[i] * r[j] for i in range(n) for j in range(i + 1, n)) for r in x]
    assert np.allclose(Q.forward(x, model)[0], want, atol=1e-3)


def test_toxic_dictionary_explains_toxic_words_better():
    rows = [(f"the quick brown fox number {k} jumps over", 0) for k in range(300)] + [(f"you are a miserable snorkwaffle number {k}", 1) for k in range(60)]
    ordinary, toxic = X.dictionaries(rows)
    distances = X.Distances(ordinary, toxic)
    assert distances["snorkwaffle"] >= 3 > distances["quick"]


def held_out(spark, folder):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    return [(r.predicted, r.score, labels[r.doc_id]) for r in X.op10_toxicity(spark, folder).collect() if r.held_out and r.doc_id in labels]


def test_toxic_documents_are_found_and_others_left_alone(spark):
    test = held_out(spark, "/root/testdata/sf0.1")
    assert np.mean([p for p, _, y in test if y == 1]) >= 0.93
    assert np.mean([p for p, _, y in test if y == 0]) < 0.01


def test_few_labels_still_make_a_model(spark, tiny):
    rows = X.op10_toxicity(spark, tiny).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{tiny}/labels.parquet").collect()}
    toxic, other = ([r.score for r in rows if labels.get(r.doc_id) == k] for k in (1, 0))
    assert any(r.predicted for r in rows if labels.get(r.doc_id) == 1) and np.mean(toxic) > np.mean(other)


def test_folds_hold_both_classes():
    for n in (2, 3, 5, 40):
        rows = [("x", 1)] * n + [("y", 0)] * 50
        of = X.folds(rows)
        assert all({y for (_, y), f in zip(rows, of) if f == k} == {0, 1} == {y for (_, y), f in zip(rows, of) if f != k} for k in range(of.max() + 1))
    assert X.folds([("x", 1)] + [("y", 0)] * 50) is None and X.folds([]) is None and X.train([("x", 1), ("y", 0)]) is None


def test_every_window_is_compressed_by_both():
    distances = X.Distances(X._coded("the of and"), X._coded(" idiot | moron "))
    calls = []

    class Counting:
        def __init__(self, inner):
            self.inner = inner

        def compress(self, data):
            calls.append(data)
            return self.inner.compress(data)

    distances.compressors = [Counting(c) for c in distances.compressors]
    X.features(X.words_of("The idiot, the zebra and THE idiot"), distances)
    assert len(calls) == 2 * 4 and distances["idiot"] > distances["zebra"]  # the, idiot, zebra, and


def test_long_texts_and_repeated_labelled_rows(spark):
    rows = [(k, f"plain words number {k} of all") for k in range(40)] + [(100 + k, f"you snorkwaffle {k}") for k in range(40)] + [(100, "you snorkwaffle 0")] * 3 + [(500, "word " * 300_000 + "snorkwaffle")]
    labels = [(k, 0) for k in range(40)] + [(100 + k, 1) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("key", F.lit(1))
    got = X.score_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == 84 and {r.score for r in got if r.doc_id == 100} == {next(r.score for r in got if r.doc_id == 100)}
    assert {r.predicted for r in got if 100 <= r.doc_id < 200} == {1} and {r.predicted for r in got if r.doc_id < 40} == {0}
    assert next(r.predicted for r in got if r.doc_id == 500) == 1


def test_training_texts_are_bounded_by_bytes_and_one_a_document(spark, monkeypatch):
    from strandkeep.llm import labelled

    rows = [(k, f"text {k} " + "x" * (5000 if k % 4 == 0 else 10)) for k in range(40)] + [(7, "another text of 7")] * 50 + [(9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(3, 0), (5, None)], "doc_id long, quality int")
    every = labelled.training_rows(docs, labels, "quality", 5, 0, 100)
    held = [k for k in range(40) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert len(every) == 40 - len(held) and sum("7" in t for t, _ in every if "another" in t or t.startswith("text 7 ")) == (7 not in held)
    monkeypatch.setattr(labelled, "TRAINING_BYTES", 6000)
    few = labelled.training_rows(docs, labels, "quality", 5, 0, 100)
    assert 10 < len(few) < len(every) and sum(len(t.encode()) for t, _ in few) <= 6000 and set(few) <= set(every)
    assert len(labelled.training_rows(docs, labels, "quality", 5, 0, 4)) <= 4


def test_quality_scores_equal_all_pairs(spark, tiny):
    """The query's scores, against a sum over all pairs of features."""
    docs, labels = (spark.read.parquet(f"{tiny}/{t}.parquet") for t in ("documents", "labels"))
    model = Q.train(Q.training_rows(docs, labels, "quality", 5, 0, Q.TRAINING_ROWS))
    got = {r.doc_id: r.score for r in Q.op8_quality(spark, tiny).collect()}
    for r in docs.orderBy("doc_id").limit(25).collect():
        at, value, stats = Q.sparse((r.text or "").encode())
        s = np.clip((np.array(stats, np.float32) - model["mean"]) / model["spread"], -5, 5) / np.sqrt(Q.STATISTICS)
        places, x = np.concatenate([at, np.arange(Q.BUCKETS, Q.BUCKETS + Q.STATISTICS)]), np.concatenate([value, s]).astype(float)
        v = model["v"][places].astype(float) * x[:, None]
        pairs = sum(float(v[i] @ v[j]) for i in range(len(x)) for j in range(i))
        z = float(model["b"]) + float(model["w"][places].astype(float) @ x) + pairs
        assert got[r.doc_id] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)
