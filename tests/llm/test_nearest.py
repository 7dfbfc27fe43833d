import numpy as np
import pytest
from pyspark.sql import functions as F

from strandkeep.llm import nearest as A


def exact(ids, x, q, k):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    return [(int(ids[j]), d[j]) for j in np.lexsort((ids, d)) if ids[j] != ids[q]][:k]


def test_recall_and_scores(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = {}
    for r in A.op7_nearest(spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    found = 0
    for q in np.flatnonzero(ids % 100 == 0):
        own = sorted(got[ids[q]])
        assert [k for k, _, _ in own] == list(range(1, 11)) and own == sorted(own, key=lambda t: (t[2], t[1]))
        assert all(s == pytest.approx(np.sqrt(((x[np.searchsorted(ids, v)] - x[q]) ** 2).sum()), abs=1e-12) for _, v, s in own)
        found += len({v for v, _ in exact(ids, x, q, 10)} & {v for _, v, _ in own})
    assert found / (10 * len(got)) >= 0.9


def test_odd_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=4).tolist()) for k in range(30)] + [(100 + k, [1.0, 2.0, 3.0, 4.0]) for k in range(40)] + [(0, [float("nan")] * 4), (31, None), (32, [0.0] * 4), (33, [1.0, None, 1.0, 1.0]), (34, [float("inf"), 1.0, 1.0, 1.0]), (35, [1.0, 2.0]), (None, [1.0] * 4), (3, rows_three := rng.normal(size=4).tolist()), (3, rows_three)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = A.nearest(df, F.col("vec_id") % 10 == 0).collect()
    by_query = {q: [(r["rank"], r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in {r.query_id for r in got}}
    assert set(by_query) == {0, 10, 20, 100, 110, 120, 130} and all(len(x) == 10 for x in by_query.values())
    assert [v for _, v, _ in by_query[110]] == [100, 101, 102, 103, 104, 105, 106, 107, 108, 109]  # ties to the smaller id
    assert [v for _, v, _ in by_query[100]] == [101, 102, 103, 104, 105, 106, 107, 108, 109, 110] and all(s == 0 for _, _, s in by_query[100])
    assert not {31, 32, 33, 34, 35} & {r.vec_id for r in got}


def test_few_and_no_vectors(spark):
    few = spark.createDataFrame([(k, [float(k + 1), 1.0]) for k in range(4)], "vec_id long, embedding array<double>")
    got = A.nearest(few, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2, 3]
    assert A.nearest(few.limit(0), F.col("vec_id") == 0).count() == 0


def test_probes_come_in_order_of_their_distance():
    shifts = A.perturbations(np.array([0.1, 0.5, 0.8]), 1.0, 12)
    inside = np.array([0.1, 0.5, 0.8])
    cost = [(np.where(s < 0, inside, np.where(s > 0, 1 - inside, 0)) ** 2).sum() for s in shifts]
    assert cost == sorted(cost) and len({tuple(s) for s in shifts.tolist()}) == 12 and not shifts[0].any()


def test_full_buckets_are_split(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(60, 6)), 5 + 1e-3 * rng.normal(size=(400, 6))])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    monkeypatch.setattr(A, "PART_POINTS", 25)
    got = {}
    for r in A.nearest(df, F.col("vec_id") % 10 == 0).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    ids, found = np.arange(len(x)), 0
    for q in range(0, len(x), 10):
        want = exact(ids, x, q, 10)
        found += len({v for v, _ in want} & {v for v, _ in got[q].values()})
    assert len(got) == 46 and found >= 0.9 * 460
