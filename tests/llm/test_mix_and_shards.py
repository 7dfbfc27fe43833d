import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandkeep.llm import hilbert_shards as H
from strandkeep.llm import source_mix as M


def test_targets_are_capped_and_shared_again():
    assert M.targets([100, 100, 100], [1, 2, 3]) == pytest.approx([50, 100, 150])
    assert M.targets([10, 1000, 10], [1, 1, 1]) == pytest.approx([30, 960, 30])
    assert M.targets([], []) == [] and M.targets([0, 5], [1, 2]) == pytest.approx([0, 5])


def test_subset_sum_is_the_best_there_is():
    rng = random.Random(4)
    for _ in range(200):
        lengths = rng.sample(range(1, 30), rng.randrange(1, 5))
        counts = [rng.randrange(0, 4) for _ in lengths]
        budget = rng.randrange(0, 80)
        best = max(s for s in (sum(n * k for n, k in zip(lengths, take)) for take in itertools.product(*(range(c + 1) for c in counts))) if s <= budget)
        got = M.subset_sum(lengths, counts, budget)
        assert all(k <= counts[j] for j, k in got) and sum(lengths[j] * k for j, k in got) == best


def test_fit_of_large_budgets():
    rng = random.Random(6)
    lengths, counts = list(range(1, 3000)), [rng.randrange(1, 40) for _ in range(2999)]
    total = sum(n * k for n, k in zip(lengths, counts))
    for budget in (0, 1, 77, total // 3, total - 1, total):
        take = M.fit(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(take, counts)) and sum(n * t for n, t in zip(lengths, take)) == budget


@pytest.mark.parametrize(
    ("lengths", "counts", "budget", "want"),
    [
        ([10, 1300], [20, 1], 1400, 1400), ([1000, 130_000], [20, 1], 149_000, 149_000), ([70_000, 70_001], [1, 1], 100_000, 70_001),
        ([7, 1_000_003], [20_000, 1], 1_100_003, 1_099_998), ([3, 2_500_001, 2_500_002], [1000, 1, 1], 5_000_003, 5_000_003),
    ],
)
def test_fit_of_sources_that_long_texts_dominate(lengths, counts, budget, want):
    take = M.fit(lengths, counts, budget)
    assert all(0 <= t <= c for t, c in zip(take, counts)) and sum(n * t for n, t in zip(lengths, take)) == want


def test_fit_is_the_best_there_is_when_all_is_left_to_it(monkeypatch):
    monkeypatch.setattr(M, "EXACT", 8)
    rng = random.Random(9)
    for _ in range(300):
        lengths = rng.sample(range(1, 120), rng.randrange(1, 5))
        counts = [rng.randrange(1, 4) for _ in lengths]
        budget = rng.randrange(0, 400)
        best = max(s for s in (sum(n * k for n, k in zip(lengths, take)) for take in itertools.product(*(range(c + 1) for c in counts))) if s <= budget)
        take = M.fit(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(take, counts)) and sum(n * t for n, t in zip(lengths, take)) == best


def test_mix(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    got, again = ([tuple(r) for r in M.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source").orderBy("doc_id").collect()] for _ in range(2))
    assert got == again and len(got) == docs.count()
    sizes = {r.doc_id: len(r.text.encode().split()) for r in docs.collect()}
    by_source = {}
    for doc, size, source_size, target, taken, source in got:
        assert size == sizes[doc] and taken in (0, size, 2 * size, 3 * size)
        by_source.setdefault(source, [source_size, target, 0, 0])
        by_source[source][2] += taken
        by_source[source][3] += size
    names = sorted(by_source)
    want = M.targets([by_source[s][3] for s in names], [M.cycle_weights(k) for k in range(len(names))])
    for name, aim in zip(names, want):
        source_size, target, taken, size = by_source[name]
        assert source_size == size and target == pytest.approx(aim) and abs(taken - target) <= max(2, 0.01 * size)


def test_mix_of_odd_rows(odd_docs, no_docs):
    got = M.mix(odd_docs).collect()
    assert len(got) == 12 and {r.size for r in got if r.doc_id in (7, 8, 11)} == {0}
    assert len({r.target for r in got if r.source is None}) == 1 and M.mix(no_docs).count() == 0


def test_targets_of_many_sources(spark):
    rng = random.Random(8)
    for most, n in ((3, 500), (1, 40), (3, 1)):
        sizes = {f"s{rng.randrange(10**6)}\u00e9" if k % 2 else f"s\U0001f600{k}": rng.choice([0, 1, 5, 100, 10_000]) for k in range(n)} | {"n": 7}
        names = sorted(sizes, key=lambda s: (s == "n", s))
        want = M.targets([sizes[s] for s in names], [M.cycle_weights(k) for k in range(len(names))], most)
        got = {r["__sk"]: r["__target"] for r in M.source_targets(spark.createDataFrame(list(sizes.items()), "__sk string, __n long").repartition(3), M.cycle_weights, most).collect()}
        assert [got[s] for s in names] == pytest.approx(want)
    assert M.source_targets(spark.createDataFrame([], "__sk string, __n long"), M.cycle_weights).count() == 0


def check_mix(docs):
    """Every source within one document of its target, no document over three times its size."""
    rows, of = M.mix(docs).collect(), {}
    for r in rows:
        assert r.size == len((r.text or "").encode().split()) and r.taken == r.size * r.copies and 0 <= r.copies <= 3
        own = of.setdefault(r.source, [r.target, r.source_size, 0, 0, 0])
        own[2] += r.taken
        own[3] += r.size
        own[4] = max(own[4], r.size)
    names = sorted(of, key=lambda s: (s is None, s))
    want = M.targets([of[s][3] for s in names], [M.cycle_weights(k) for k in range(len(names))])
    for s, aim in zip(names, want):
        target, source_size, taken, size, longest = of[s]
        assert target == pytest.approx(aim) and source_size == size and abs(taken - target) <= max(1, longest)
    return rows


@pytest.mark.parametrize("salted", [False, True])
def test_mix_is_fitted_to_the_row(spark, monkeypatch, odd_docs, salted):
    if salted:
        monkeypatch.setattr(M, "TIED", 7)
    rng = random.Random(7)
    text = {k: " ".join(["w"] * k) for k in range(1, 30)}
    nulls = [(None, text[10], "a") for _ in range(300)] + [(k, text[10], s) for s in "bc" for k in range(300)]
    hot = [(77, text[5], "a")] * 400 + [(k, text[rng.randrange(1, 30)], "b") for k in range(200)] + [(77, text[7], None)] * 250 + [(77, text[7], "b")] * 3
    for rows in (nulls, hot, [(None, text[rng.randrange(1, 4)], rng.choice(["x", "y", None])) for _ in range(500)]):
        df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"part": F.lit("p"), "n": F.lit(1), "size": F.lit("s"), "extra": F.lit(2)}).repartition(5)
        got, again = ([(r.doc_id, r.text, r.source, r.taken) for r in check_mix(df)] for _ in range(2))
        assert sorted(got, key=repr) == sorted(again, key=repr) and len(got) == len(rows)
    check_mix(odd_docs)


def test_mix_takes_the_same_of_rows_that_differ_in_other_columns(spark):
    rows = [(1, "one two three", "a" if k % 3 else "b", None if k % 2 else str(k), str(k) if k % 2 else None, {"k": k}) for k in range(90)]
    rows += [(k, " ".join(["w"] * (k % 40)), "c", None, None, None) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, x string, y string, z map<string,long>")
    got, again = ([(r.x, r.y, r.source, r.taken) for r in M.mix(df.repartition(n)).collect()] for n in (3, 7))
    assert sorted(got, key=repr) == sorted(again, key=repr) and len({r[3] for r in got if r[2] in "ab"}) > 1


def test_curve_is_a_walk_through_all_cells():
    cells = np.arange(1 << 15)
    points = np.stack([(cells >> (5 * k)) & 31 for k in range(3)], axis=1)
    order = np.argsort(H.curve(points))
    assert sorted(H.curve(points).tolist()) == list(range(1 << 15))
    assert (np.abs(np.diff(points[order], axis=0)).sum(axis=1) == 1).all()


def check_shards(rows, shards=16):
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r.shard, []).append(r)
    assert set(by_shard) <= set(range(shards))
    for own in by_shard.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))


def test_shards(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    rows = H.op9_hilbert_shards(spark, tiny).collect()
    assert len(rows) == docs.count()
    check_shards(rows)
    of_text = {}
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        of_text.setdefault(text[r.doc_id], set()).add(r.shard)
        assert r.size == len(text[r.doc_id].encode()) + 1 and r.grown_shard is None and r.law == "bytes"
    assert all(len(s) == 1 for s in of_text.values())
    sizes = [sum(r.size for r in rows if r.shard == k) for k in range(16)]
    assert max(sizes) - min(sizes) <= 2 * max(sum(r.size for r in rows if text[r.doc_id] == t) for t in of_text)


def test_shards_of_odd_rows(spark, odd_docs, no_docs):
    rows = H.shard_documents(odd_docs).collect()
    assert len(rows) == 12 and rows[0].__fields__[:-2] == odd_docs.columns
    check_shards(rows)
    assert H.shard_documents(no_docs).count() == 0
    many = spark.createDataFrame([(k, "the same text", "en", "a") for k in range(400)], "doc_id long, text string, lang string, source string")
    rows = H.shard_documents(many).collect()
    check_shards(rows)
    counts = [sum(r.shard == k for r in rows) for k in range(16)]
    assert max(counts) - min(counts) <= 20  # a group larger than a shard is spread


def test_placed_odd_rows_keep_the_law(spark, odd_docs, no_docs):
    """Null metadata, empty texts, ties and repeats: every row has its place, equal texts one shard, sizes near equal."""
    docs = odd_docs.unionByName(odd_docs.withColumns({"doc_id": F.col("doc_id") + 1000, "text": F.concat("text", F.lit(" again"))}))
    rows = H.place(H.measured(docs)).collect()
    assert len(rows) == 24 and sorted(map(repr, rows)) == sorted(map(repr, H.place(H.measured(docs)).collect()))
    check_shards(rows)
    of_text = {}
    for r in rows:
        of_text.setdefault((r.text_crc32, r.size), set()).add(r.shard)
    assert all(len(s) == 1 for s in of_text.values()) and H.place(H.measured(no_docs)).count() == 0
    rng = random.Random(2)
    many = spark.createDataFrame([(k if rng.random() < 0.9 else None, "x" * rng.randrange(300), rng.choice(["en", None]), rng.choice(["a", "b", None])) for k in range(3000)], "doc_id long, text string, lang string, source string")
    rows = H.place(H.measured(many)).collect()
    check_shards(rows)
    sizes = [sum(r.size for r in rows if r.shard == k) for k in range(16)]
    assert max(sizes) - min(sizes) < 0.2 * sum(sizes) / 16
