import hashlib
import random

from strandkeep.llm import common, packed
from strandkeep.llm import substring_dedup as S


def brute(rows):
    """doc_id -> (n_words, kept) by comparing all windows; a null id is the largest."""
    first = {}
    keyed = [((1 << 63) - 1 if i is None else i, (t or "").encode().split()) for i, t in rows]
    for i, w in keyed:
        for k in range(len(w) - S.SPAN + 1):
            window = tuple(w[k : k + S.SPAN])
            first[window] = min(first.get(window, i), i)
    out = []
    for i, w in keyed:
        gone = set()
        for k in range(len(w) - S.SPAN + 1):
            if first[tuple(w[k : k + S.SPAN])] < i:
                gone.update(range(k, k + S.SPAN))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out)


def compare(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(((1 << 63) - 1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept) for r in S.dedup_substrings(docs).collect())
    assert got == brute(rows)


def test_odd_rows(odd_docs, no_docs):
    compare(odd_docs)
    assert S.dedup_substrings(no_docs).count() == 0


def test_documents(spark, tiny):
    compare(spark.read.parquet(f"{tiny}/documents.parquet"))


def test_shared_runs_at_every_shift(spark):
    rng = random.Random(3)
    passages = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(50)) for _ in range(n)) for n in (12, 13, 14, 30)]
    rows = []
    for k in range(120):
        words = [f"u{rng.randrange(10**9)}" for _ in range(rng.randrange(0, 40))]
        words[rng.randrange(len(words) + 1) : 0] = rng.choice(passages).split()
        rows.append((k, " ".join(words)))
    compare(spark.createDataFrame(rows, "doc_id long, text string"))


def test_cover_has_a_common_shift():
    for a in range(S.PERIOD):
        for b in range(S.PERIOD):
            assert any((a + d) % S.PERIOD in S.COVER and (b + d) % S.PERIOD in S.COVER for d in range(S.PERIOD))


def test_spans_give_the_kept_words(spark, tiny):
    for r in S.dedup_substrings(spark.read.parquet(f"{tiny}/documents.parquet")).collect():
        words = r.text.encode().split()
        gone = {k for s in r.spans for k in range(s.start, s.end)}
        assert b" ".join(w for k, w in enumerate(words) if k not in gone).decode() == r.kept


def test_query_digest(spark, tiny):
    want = {i: hashlib.sha256(kept.encode()).hexdigest() for i, _, _, kept in brute([(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()])}
    assert {r.doc_id: r.kept_sha256 for r in S.op2_substring_dedup(spark, tiny).collect()} == want


def test_word_hashes_split_like_words():
    texts = [b"", b" a  b\tc\x0b", "été  x".encode(), b"y " * 400_000, b"z" * 1_200_000 + b" q"]
    hashes, starts = common.hash_words(texts)
    words = [w for t in texts for w in t.split()]
    assert [b - a for a, b in zip(starts, starts[1:])] == [len(t.split()) for t in texts]
    seen = {}
    assert all(seen.setdefault(w, h) == h for w, h in zip(words, hashes.tolist())) and len(set(seen.values())) == len(seen)


def test_buckets_follow_the_hashes():
    assert packed.buckets_for(10) == packed.LEAST_BUCKETS < packed.buckets_for(1e9)


def thue_morse(n):
    """A string of 2 ** n letters and its complement: equal under any polynomial hash modulo 2 ** 64."""
    word = b"a"
    for _ in range(n):
        word += word.translate(bytes.maketrans(b"ab", b"ba"))
    return word, word.translate(bytes.maketrans(b"ab", b"ba"))


def test_words_that_polynomials_take_for_equal(spark):
    one, two = (w.decode() for w in thue_morse(10))
    shared = " ".join(f"w{k}" for k in range(12))
    compare(spark.createDataFrame([(1, f"{shared} {one}"), (2, f"{shared} {two}"), (3, f"{one} {shared} {two}"), (4, f"x {shared} {one} y")], "doc_id long, text string"))
    hashes, _ = common.hash_words([one.encode(), two.encode()])
    assert hashes[0] != hashes[1]


def test_hashes_of_words_of_every_length():
    rng = random.Random(5)
    words = {bytes(rng.choice(b"ab") for _ in range(n)) for n in [*range(1, 90), 500] for _ in range(40)}
    words = sorted(words)
    hashes, _ = common.hash_words([b" ".join(words)])
    again, starts = common.hash_words([b"\t" + w + b" " for w in words])
    assert len(set(hashes.tolist())) == len(words) and (hashes == again).all() and list(starts) == list(range(len(words) + 1))
    assert not set(common.hash_words([b" ".join(words)], 1)[0].tolist()) & set(hashes.tolist())


def test_windows_are_compared_when_all_anchors_collide(spark, monkeypatch):
    monkeypatch.setattr(common, "rolling", lambda hashes, size: hashes[: max(0, len(hashes) - size + 1)] * 0)
    words = [f"w{k}" for k in range(40)]
    keys = S.digests([[w.encode() for w in words]], *S.windows(S.np.array([0, 40]), [S.np.arange(34)]))
    assert len({(int(a), int(b)) for a, b in zip(*keys)}) == 28


def test_a_hot_bucket_gets_salts_by_its_places(spark, monkeypatch):
    monkeypatch.setattr(packed, "BUCKET_HASHES", 50)
    monkeypatch.setattr(packed, "LEAST_BUCKETS", 3)
    line = " ".join(f"h{k}" for k in range(15))
    compare(spark.createDataFrame([(k, f"{line} own{k}") for k in range(300)], "doc_id long, text string").repartition(9))
