import math
import zlib
from collections import Counter

import numpy as np
import pytest

from strandkeep.llm import common
from strandkeep.llm import state_model as S


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def plain_base(rows):
    """(doc_id, n_tokens, n_known, N, base score) of rows (doc_id, text)."""
    seen = Counter(t for d, x in rows if not held(d) for t in tokens(x))
    n, v = sum(seen.values()), len(seen)
    out = []
    for d, x in rows:
        words = tokens(x)
        out.append((d, len(words), sum(seen[t] > 0 for t in words), n, sum(math.log10((seen[t] + 0.1) / (n + 0.1 * (v + 1))) for t in words)))
    return out


def compared(rows, want):
    key = lambda r: (str(r[0]), r[1], r[2], round(r[4], 6))
    got = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in rows), key=key)
    want = sorted(want, key=key)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4] for g in got], [w[4] for w in want], rtol=1e-9, atol=1e-9)
    assert all(r["held_out"] == held(r["doc_id"]) and math.isfinite(r["score"]) for r in rows)


def random_model(rng, classes):
    return S.Model(rng.dirichlet(np.ones(S.STATES)), rng.dirichlet(np.ones(S.STATES), S.STATES), rng.dirichlet(np.ones(classes) * 0.3, S.STATES).T + 1e-12)


def plain_forward_backward(codes, n, m):
    counts, moves, starts, logs, at = np.zeros_like(m.emit), np.zeros_like(m.move), np.zeros_like(m.start), [], 0
    for k in n:
        x, at = codes[at : at + k], at + k
        a, b, scale = np.zeros((k, S.STATES)), np.ones((k, S.STATES)), np.zeros(k)
        for t in range(k):
            y = (a[t - 1] @ m.move if t else m.start) * m.emit[x[t]]
            scale[t] = y.sum()
            a[t] = y / scale[t]
        for t in range(k - 2, -1, -1):
            b[t] = m.move @ (m.emit[x[t + 1]] * b[t + 1]) / scale[t + 1]
        logs.append(np.log10(scale).sum())
        for t in range(k):
            g = a[t] * b[t]
            counts[x[t]] += g / g.sum()
            if t:
                pair = a[t - 1][:, None] * m.move * (m.emit[x[t]] * b[t])
                moves += pair / pair.sum()
            else:
                starts += g / g.sum()
    return logs, counts, moves, starts


@pytest.mark.parametrize("piece", [1, 7, 8, 4096])
def test_recursions_equal_plain_ones(monkeypatch, piece):
    monkeypatch.setattr(S, "PIECE", piece)
    rng = np.random.default_rng(piece)
    m, n = random_model(rng, 40), np.array([1, 5, 7, 8, 50, 21, 22, 3, 1])
    codes = rng.integers(0, 40, n.sum()).astype(np.uint16)
    counts, moves, starts = np.zeros_like(m.emit), np.zeros_like(m.move), np.zeros_like(m.start)
    logs, c, mv, st = plain_forward_backward(codes, n, m)
    assert np.allclose(S.likelihoods(codes, n, m), logs)
    assert np.allclose(S.likelihoods(codes, n, m, counts, moves, starts), logs)
    assert np.allclose(counts, c) and np.allclose(moves, mv) and np.allclose(starts, st)


def test_long_texts_neither_underflow_nor_lose():
    rng = np.random.default_rng(2)
    m = random_model(rng, 3000)
    codes = rng.integers(0, 3000, 30_000).astype(np.uint16)
    assert S.likelihoods(codes, np.array([30_000]), m)[0] == pytest.approx(plain_forward_backward(codes, [30_000], m)[0][0])


def test_slices_cover_all_texts(monkeypatch):
    monkeypatch.setattr(S, "AT_ONCE", 10)
    n = np.array([3, 3, 3, 3, 40, 1, 9, 2])
    parts = list(S._slices(n))
    assert [k for a, _ in parts for k in range(a.start, a.stop)] == list(range(8))
    assert [k for _, b in parts for k in range(b.start, b.stop)] == list(range(n.sum()))


def test_counts_and_base_scores(spark, tiny):
    docs = common.table(spark, tiny, "documents")
    rows = S.score_language(docs, passes=2).collect()
    compared(rows, plain_base([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]))


def test_blocks_of_any_size_give_the_same(spark, tiny, monkeypatch):
    docs = common.table(spark, tiny, "documents").limit(60)
    one = {r["doc_id"]: r["score"] for r in S.score_language(docs, passes=2).collect()}
    monkeypatch.setattr(S, "BLOCK", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        other = {r["doc_id"]: r["score"] for r in S.score_language(docs.repartition(3), passes=2).collect()}
    finally:
        common.tuned(spark)
    assert one.keys() == other.keys() and all(one[k] == pytest.approx(other[k], rel=1e-6) for k in one)


def test_states_know_more_than_counts(spark):
    """Held-out texts too are likelier than in the base model: unknown words cost the same in both."""
    rows = S.op11_hidden_markov(spark, "/root/testdata/sf0.01").collect()
    for fold in (False, True):
        own = [r for r in rows if r["held_out"] == fold]
        n = sum(r["n_tokens"] for r in own)
        assert sum(r["score"] - r["base_score"] for r in own) / n > 0.25
        assert sum(r["score"] > r["base_score"] for r in own) > 0.95 * len(own)


def test_training_makes_texts_likelier(spark, tiny):
    docs = common.table(spark, tiny, "documents")
    sums = [sum(r["score"] for r in S.score_language(docs, passes=p).collect() if not r["held_out"]) for p in (0, 1, 3)]
    assert sums[0] < sums[1] < sums[2]


def test_the_model_is_a_distribution(spark):
    """The chances of all words, the end and an unknown word add up to one wherever a text may stand: here as its first token."""
    rows = [(k, x) for k, x in enumerate(["a b c a", "b b a", "c d e f", "a a a", "", "e e"] * 12)]
    words = sorted({w for d, x in rows if not held(d) for w in x.split()})
    block = S.blocks(spark.createDataFrame(rows, "doc_id long, text string"))
    words_ = S.classed(S.word_counts(block))
    size = S.sizes(words_)
    assert size[:, 1].sum() == len(words) and size[:, 0].sum() == sum(len(x.split()) for d, x in rows if not held(d))
    for r in words_.collect():
        assert size[r["class"], 0] == r["c"]  # so few words are classes of their own
    share = size[:, 0] / (size[:, 0].sum() + 60)
    share[S.END] = 1 - share.sum()
    m = S.train(S.coded(block, words_, S.Totals(100, 7, 60), size), share, 0.01, passes=2)
    assert np.allclose(m.emit.sum(0), 1) and np.allclose(m.move.sum(1), 1) and m.start.sum() == pytest.approx(1)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = S.score_language(odd_docs, passes=1).collect()
    compared(rows, plain_base([(r["doc_id"], r["text"]) for r in odd_docs.collect()]))
    assert S.score_language(no_docs).count() == 0
    nine = [k for k in range(200) if held(k)][:3]
    alone = S.score_language(spark.createDataFrame([(k, "x y") for k in nine], "doc_id long, text string")).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in alone] == [(3, 0, 0, 0.0, 0.0)] * 3
