"""Every query against its DuckDB form on the smallest tables, and the state operators that SQL cannot say."""

import math
from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from strandkeep.operators import graph, merge, server, store
from strandkeep.plans import catalog
from strandkeep.sources import versions
from strandkeep.sources.tables import TABLES, table


@pytest.fixture(scope="module")
def duck(tiny):
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tiny}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return bytes(value) if isinstance(value, bytearray) else value


@pytest.mark.parametrize("name", catalog.oracle_sql())
def test_equals_sql(spark, duck, tiny, name):
    ours = catalog.queries()[name](spark, tiny)
    theirs = duck.sql(catalog.oracle_sql()[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in ours.collect()), key=str)
    places = [theirs.columns.index(c) for c in columns]
    want = sorted((tuple(plain(r[k]) for k in places) for r in theirs.fetchall()), key=str)
    assert got == want


@pytest.mark.parametrize("name", [n for n in catalog.queries() if n not in catalog.oracle_sql()])
def test_runs(spark, tiny, name):
    assert catalog.queries()[name](spark, tiny).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_all_rows_of_the_decision_table_occur(spark):
    sides = [versions.entries(spark, "/root/testdata/sf0.01", n) for n in merge.SIDES]
    b, o, t = (F.col(x) for x in merge.SIDES)
    shape = [x.isNotNull() for x in (b, o, t)] + [F.coalesce(x == y, F.lit(False)) for x, y in ((b, o), (b, t), (o, t))]
    rows = merge.three_way(*sides).select(*[x.alias(f"c{k}") for k, x in enumerate(shape)], merge.decision().alias("action")).distinct().collect()
    assert len(rows) == 14 and {r.action for r in rows} == {"KeepOurs", "TakeTheirs", "Unchanged", "ContentMerge", "Delete", "Conflict"}


def test_first_base_breadth_first_with_crossed_history(spark):
    edges = spark.createDataFrame([(3, 1, 0), (3, 2, 1), (4, 2, 0), (4, 1, 1), (1, 0, 0), (2, 0, 0)], "child int, parent int, ordinal int")
    pairs = spark.createDataFrame([(3, 4), (4, 3), (3, 3), (3, 99)], "ours int, theirs int")
    assert {(r.ours, r.theirs): r.base for r in graph.merge_bases(edges, pairs).collect()} == {(3, 4): 2, (4, 3): 1, (3, 3): 3, (3, 99): None}


def test_corrupt_objects_and_orders_raise(spark):
    objects = spark.createDataFrame([("0" * 64, b"not that")], "chunk_id string, content binary")
    with pytest.raises(Exception, match="corrupt object"):
        store.get(spark.createDataFrame([("0" * 64,)], "chunk_id string"), objects).collect()
    assert store.get(spark.createDataFrame([("0" * 64,)], "chunk_id string"), objects, verified=False).count() == 1
    two = spark.createDataFrame([("a", b"1"), ("b", b"2")], "chunk_id string, content binary")
    files = spark.createDataFrame([("f", ["b", "a"])], "path string, chunks array<string>").withColumn("whole", F.sha2(F.lit(b"12"), 256))
    with pytest.raises(Exception, match="chunks out of order"):
        store.reassemble(files, two, verified_by="whole").collect()
    with pytest.raises(Exception, match="not a manifest line"):
        store.read_manifests(spark.createDataFrame([("s", "strandkeep-manifest 1\na\tb\n")], "snapshot_id string, text string")).collect()


def test_odd_paths_survive_the_manifest(spark):
    paths = ["col\tumn", "two\nlines.csv", "back\\slash\\twice", "a literal\\t and\\n", "Ωmega/ñandú.rs", "ｆｕｌｌ/ｗｉｄｅ", "night \U0001f319.bin", "\t\n\\"]
    entries = spark.createDataFrame([("s", p, 1, datetime(2024, 1, 1), False, []) for p in paths], "snapshot_id string, path string, size long, modified_utc timestamp, executable boolean, chunks array<string>")
    assert sorted(r.path for r in store.read_manifests(store.write_manifests(entries)).collect()) == sorted(paths)


def test_names_resolve_to_one_machine(spark):
    heads = spark.createDataFrame([("Desk", "h1"), ("lap", "h2"), ("LAP", "h3")], "machine_name string, head string")
    assert server.resolve_head(heads, "dEsK").first().head == "h1"
    for name in ("lap", "none"):
        with pytest.raises(ValueError):
            server.resolve_head(heads, name)
    assert server.claim_or_match(None, "a") == (True, "a") and server.claim_or_match("a", "b") == (False, "a")


def test_case_matters_only_where_told(spark):
    items = spark.createDataFrame([("Makefile", "KeepOurs"), ("makefile", "Write"), ("lib/a", "KeepOurs"), ("LIB/a", "Delete"), ("lib/b", "Write")], "path string, action string")
    assert {r.path for r in merge.case_collisions(items).collect()} == {"Makefile", "makefile"} and merge.case_collisions(items, False).count() == 0


def test_streamed_history_equals_the_batch_one(spark, tiny, tmp_path):
    from strandkeep.streaming.head_history import closed_heads

    moves = table(spark, tiny, "events").select(F.col("user_id").alias("machine_id"), F.col("event_id").alias("head"), F.col("ts").cast("timestamp").alias("moved_utc"), F.col("event_id").alias("seq"))
    for k, day in enumerate((11, 21, 32)):
        moves.where(f"dayofmonth(moved_utc) < {day} AND dayofmonth(moved_utc) >= {(0, 11, 21)[k]}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(moves.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = closed_heads(stream).writeStream.format("memory").queryName("closed").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).outputMode("append").start()
    query.awaitTermination(300)
    got = {tuple(r) for r in spark.table("closed").collect()}
    assert got == {tuple(r) for r in server.head_history(moves).where("superseded_utc IS NOT NULL").collect()}


def test_every_word_has_its_rank_in_ordinal_order(spark, tiny):
    words = {w for r in table(spark, tiny, "documents").select("text").collect() for w in r.text.split(" ") if w}
    marked = ({0: "\U0001f600", 1: "\ue000"}.get(len(w) % 5, "") + w for w in words)
    want = sorted(marked, key=lambda w: w.encode("utf-16-be"), reverse=True)
    assert [tuple(r) for r in catalog.queries()["srt1_ordinal_order"](spark, tiny).select("w", "rank").collect()] == [(w, k + 1) for k, w in enumerate(want)]
    assert len(want) > 50


def test_a_long_line_of_commits_takes_few_rounds(spark):
    n = 100_000
    edges = spark.range(1, n).selectExpr("id AS child", "id - 1 AS parent", "0 AS ordinal")
    side = spark.createDataFrame([(n, 70_000, 0), (n + 1, n, 0), (n + 1, 30_000, 1)], "child long, parent long, ordinal int")
    edges = edges.unionByName(side)
    pairs = spark.createDataFrame([(n - 1, n + 1), (n + 1, 50_000), (0, n + 1)], "ours long, theirs long")
    assert {(r.ours, r.theirs): r.base for r in graph.merge_bases(edges, pairs).collect()} == {(n - 1, n + 1): 30_000, (n + 1, 50_000): 50_000, (0, n + 1): 0}
    asked = spark.createDataFrame([(69_999, n + 1), (70_001, n + 1), (n, n + 1), (5, 5), (5, 4)], "ancestor long, descendant long")
    assert {(r.ancestor, r.descendant): r.is_ancestor for r in graph.is_ancestor(edges, asked).collect()} == {(69_999, n + 1): True, (70_001, n + 1): False, (n, n + 1): True, (5, 5): True, (5, 4): False}
    found = graph.closure(edges, spark.createDataFrame([(n + 1, n + 1)], "root long, node long"))
    assert found.count() == 70_003 and found.where("node = 30000").first().depth == 1 and found.where("node = 30001").first().depth == 40_001


def test_a_history_that_merges_often_takes_few_rounds(spark, monkeypatch):
    """Every fourth of 100,000 commits merges the one three back, every eighth a side branch too: shortest ways lead through thousands of merges."""
    n, written = 100_000, []
    stash = graph.stash
    monkeypatch.setattr(graph, "stash", lambda df: written.append(1) or stash(df))
    parents = {k: [k - 1, *([k - 3] if k % 4 == 0 else []), *([n + k] if k % 8 == 0 else [])] for k in range(1, n)} | {n + k: [k - 5] for k in range(8, n, 8)}
    rows = spark.range(1, n).selectExpr("id AS child", "array(id - 1, IF(id % 4 = 0, id - 3, NULL), IF(id % 8 = 0, id + 100000, NULL)) AS ps")
    rows = rows.unionByName(spark.range(8, n, 8).selectExpr("id + 100000 AS child", "array(id - 5) AS ps"))
    edges = rows.select("child", F.posexplode("ps").alias("ordinal", "parent")).where("parent IS NOT NULL")

    def walk(head):
        depth, queue = {head: 0}, [head]
        for x in queue:
            for p in parents.get(x, ()):
                if p not in depth:
                    depth[p] = depth[x] + 1
                    queue.append(p)
        return depth

    found = graph.closure(edges, spark.createDataFrame([(n - 1, n - 1)], "root long, node long"))
    assert {r.node: r.depth for r in found.collect()} == walk(n - 1) and len(written) < 25
    written.clear()
    asked = [(n - 1, 2 * n - 8), (n + 4000, 4001), (4000, n + 4000), (3, n - 1), (n + 4000, 4000)]
    got = graph.is_ancestor(edges, spark.createDataFrame(asked, "ancestor long, descendant long")).collect()
    assert {(r.ancestor, r.descendant): r.is_ancestor for r in got} == {(a, d): a in walk(d) for a, d in asked} and len(written) < 25


@pytest.mark.parametrize("block", [2, 5, 512])
def test_ancestry_equals_a_plain_walk(spark, monkeypatch, block):
    import random

    monkeypatch.setattr(graph, "BLOCK", block)
    monkeypatch.setattr(graph, "SEARCHES", 3 if block == 5 else 20_000)
    rng = random.Random(block)
    for seed in range(1):
        parents = {k: rng.sample(range(k), min(k, rng.choice([1, 1, 1, 2, 3]))) if rng.random() < 0.95 else [] for k in range(1, 60)}
        edges = spark.createDataFrame([(c, p, o) for c, ps in parents.items() for o, p in enumerate(ps)], "child long, parent long, ordinal int")

        def walk(head):
            depth, queue = {head: 0}, [head]
            for x in queue:
                for p in parents.get(x, ()):
                    if p not in depth:
                        depth[p] = depth[x] + 1
                        queue.append(p)
            return depth, queue

        heads = rng.sample(range(60), 8)
        got = graph.closure(edges, spark.createDataFrame([(h, h) for h in heads], "root long, node long")).collect()
        assert {(r.root, r.node): r.depth for r in got} == {(h, x): d for h in heads for x, d in walk(h)[0].items()} and len(got) == sum(len(walk(h)[0]) for h in heads)
        pairs = [(a, b) for a in heads for b in heads]
        want = {(a, b): next((x for x in walk(b)[1] if x in walk(a)[0]), None) for a, b in pairs}
        assert {(r.ours, r.theirs): r.base for r in graph.merge_bases(edges, spark.createDataFrame(pairs, "ours long, theirs long")).collect()} == want
        tests = {(r.ancestor, r.descendant): r.is_ancestor for r in graph.is_ancestor(edges, spark.createDataFrame(pairs, "ancestor long, descendant long")).collect()}
        assert tests == {(a, b): a in walk(b)[0] for a, b in pairs}
