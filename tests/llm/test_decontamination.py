from strandkeep.llm import decontamination as D


def brute(docs, items, size=D.SHINGLE, percent=D.PERCENT):
    def grams(t):
        w = (t or "").lower().split()
        return {" ".join(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()

    sets = [(i, grams(t)) for i, t in docs]
    out = set()
    for item, text in items:
        want = grams(text)
        out |= {(i, item, len(want), len(want & s)) for i, s in sets if want and 100 * len(want & s) >= percent * len(want)}
    return out


def rows(df):
    return {(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in df.collect()}


def test_equals_brute_force(spark, tiny):
    docs, items = (spark.read.parquet(f"{tiny}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert rows(D.contained(docs, items)) == want and want
    assert D.decontaminated(docs, items).count() == docs.count() - len({w[0] for w in want})


def test_partly_contained_items_at_every_size(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_ROWS", 40)  # several blocks
    items = [(n, " ".join(f"i{n}w{k}" for k in range(n))) for n in (1, 4, 5, 6, 9, 14, 30, 70, 200)]
    docs = []
    for n, text in items:
        words = text.split()
        for cut in (0, 1, 2, n // 8, n // 5, n // 3):
            docs.append((len(docs), " ".join(["pad"] * 300 + words[cut:] + ["end"] * 300)))
        docs.append((len(docs), text.upper()))
    got = rows(D.contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert got == brute(docs, items)


def test_odd_rows(spark, odd_docs, no_docs):
    passage = " ".join(f"W{k}" for k in range(10, 30))
    items = spark.createDataFrame([(1, passage), (2, None), (3, ""), (None, "one two three"), (1, passage), (4, "x")], "item_id long, text string")
    got = rows(D.contained(odd_docs, items))
    assert {(i, n) for i, n, _, _ in got} == {(3, 1), (5, 1), (9, 1), (None, None), (12, None), (13, 4)}
    assert D.contained(no_docs, items).count() == 0 and D.contained(odd_docs, items.limit(0)).count() == 0
    assert {r.doc_id for r in D.decontaminated(odd_docs, items).collect()} == {7, 8, 11, 14, 15}


def test_runs_no_python(spark, tiny):
    plan = D.op3_decontamination(spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_of_rows_without_id_the_contaminated_text_goes(spark):
    item = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(None, f"a {item} b"), (None, "clean and unrelated words stand here"), (None, None), (1, item), (2, "clean")], "doc_id long, text string")
    kept = D.decontaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert {(r.doc_id, r.text) for r in kept} == {(None, "clean and unrelated words stand here"), (None, None), (2, "clean")}


def test_texts_of_one_id_are_held_apart(spark):
    one, two = (" ".join(f"{c}{k}" for k in range(12)) for c in "ab")
    docs = spark.createDataFrame([(1, one), (1, f"{two} more"), (2, f"{one} {two}")], "doc_id long, text string")
    items = spark.createDataFrame([(7, one), (7, two)], "item_id long, text string")
    assert rows(D.contained(docs, items)) == {(1, 7, 8, 8), (2, 7, 8, 8)}


def test_shingles_as_text_agree_with_their_hashes(spark, odd_docs):
    both = D.with_spelled(D.with_shingles(odd_docs, "h"), "s").selectExpr("size(h) AS a", "size(s) AS b").collect()
    assert all(r.a == r.b for r in both)
