import random

import numpy as np
import pytest

from strandkeep.llm import common
from strandkeep.llm import near_dups as N
from strandkeep.llm.components import connected


def sets_of(rows, size):
    out = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out.append((i, {b" ".join(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()))
    return out


def brute(rows, size, percent):
    """id -> (set size, smallest reachable id) by comparing all pairs."""
    sets = sets_of(rows, size)
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            both = len(a & b)
            if a and b and 100 * both >= percent * (len(a) + len(b) - both):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (max(len(a) for j, a in sets if j == i), find(i)) for i, _ in sets}


def near_copies(n, rng):
    """Families of texts at similarities around the threshold, chains among them."""
    rows = []
    for family in range(n):
        words = [f"f{family}w{rng.randrange(10**6)}" for _ in range(rng.choice([8, 60, 200]))]
        for _ in range(6):
            rows.append((len(rows), " ".join(words)))
            words = list(words)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_equals_brute_force(spark, size, percent):
    rows = near_copies(25, random.Random(size))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size, percent).collect()}
    assert got == brute(rows, size, percent)


def test_odd_rows(odd_docs, no_docs):
    got = N.near_duplicates(odd_docs, 3, 85).collect()
    assert len(got) == 12
    by_id = {r.doc_id: r for r in got}
    assert by_id[9].component_id == 3 and by_id[5].component_id == 3 and not by_id[9].kept
    assert by_id[7].kept and by_id[7].n_shingles == 0 and by_id[8].component_id == 8 and by_id[11].kept
    assert by_id[None].component_id == 12 and not by_id[None].kept and by_id[12].kept
    assert N.near_duplicates(no_docs).count() == 0


def test_blocks_decide_what_stars_leave_open(monkeypatch, spark):
    monkeypatch.setattr(N, "BLOCK_REST", 2)
    monkeypatch.setattr(N, "BLOCK_ALL", 3)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(40):
        words = list(base)
        for _ in range(k % 8):
            words[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    got = {r.doc_id: r.component_id for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == {i: c for i, (_, c) in brute(rows, 3, 85).items()}


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    for j in (0.3, 0.6, 0.85, 0.95):
        every = rng.integers(0, 1 << 63, 2000, np.uint64) * np.uint64(2)
        both = int(2000 * j)
        a, b = np.concatenate([every[:both], every[both::2]]), np.concatenate([every[:both], every[both + 1 :: 2]])
        x, y = N.sketch(a), N.sketch(b)
        assert (N.merged(x, y) == N.sketch(np.union1d(a, b))).all()
        got = N.likeliest(x[None], y[None], np.array([float(len(a))]), np.array([float(len(b))]))[0]
        assert abs(got - j) < 0.12


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(1000, 1040)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    want = {x: find(x) for x in list(parent) if find(x) != x}
    assert {r.node: r.component for r in connected(spark.createDataFrame(links, "a long, b long")).collect()} == want
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows_without_id_are_told_apart_by_text(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(None, text + " tail"), (None, "quite other words than those of the passage"), (None, "and a third text of its own here"), (12, text), ((1 << 63) - 5, "the largest of ids keeps its own component")]
    got = {r.text: r for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[t].kept for _, t in rows] == [False, True, True, True, True]
    assert [got[t].component_id for _, t in rows] == [12, None, None, 12, (1 << 63) - 5]


def test_words_that_polynomials_take_for_equal(spark):
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"{word} p q"), (2, f"{other} p q"), (3, f"{word} P Q"), (4, other), (5, word)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == brute(rows, 3, 85) and got[2] == (1, 2)


def test_words_that_collide_under_one_seed(spark):
    rows = [(1, "abcdefghijklmnop p q szb851od;@01k`]5 p q"), (2, "abcdefghijklmnop p q"), (3, "szb851od;@01k`]5 p q"), (4, "abcdefghijklmnop p q abcdefghijklmnop p q")]
    one = common.hash_words([b"abcdefghijklmnop", b"szb851od;@01k`]5"])[0]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert one[0] == one[1] and got == brute(rows, 3, 85) and got[1][0] == 4 and got[3][1] == 3


def test_pairs_are_told_apart_by_both_hashes():
    x, y = np.array([5, 3, 5, 5, 3], np.uint64), np.array([2, 9, 1, 2, 9], np.uint64)
    assert [v.tolist() for v in N._distinct(x, y)] == [[3, 5, 5], [9, 1, 2]]


def test_links_are_decided_on_the_words(monkeypatch):
    """With sketches that take all texts for equal no unequal texts link."""
    registers = N.sketch(np.arange(1, 50, dtype=np.uint64)).tobytes()
    words = [b"a b c d e", b"a b c d f", b"A b c d e", b"x y z u v"]
    links = N.block_links([(k, k, True, w, 3, registers) for k, w in enumerate(words)], 3, 85)
    assert links == [(0, 2)]


def test_blocks_are_bounded_by_bytes(monkeypatch, spark):
    monkeypatch.setattr(N, "REST_BYTES", 2000)
    monkeypatch.setattr(N, "ALL_BYTES", 3000)
    monkeypatch.setattr(N, "HELD_SHINGLES", 300)
    rng = random.Random(19)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(30):
        words = list(base)
        for _ in range(k % 9):
            words[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    got = {r.doc_id: r.component_id for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == {i: c for i, (_, c) in brute(rows, 3, 85).items()}
