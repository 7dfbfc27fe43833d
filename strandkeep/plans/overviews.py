"""Queries behind the overviews: carried work, attention, groups, reports, imports and time windows."""

from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from strandkeep.functions import scalars, structural, textshape
from strandkeep.operators import durable, gc, merge, policy, server
from strandkeep.sources.tables import table
from strandkeep.stash import scratch

NOW = datetime(2024, 1, 31)
_FOREIGN = """// build output
build
(?d)(?i)*.tmp

// Secrets of the team
vault
!vault/readme
#include other
*.pem
deploy_key

// plain again
notes
"""


def _foreign(spark, folder):
    got = policy.import_foreign(_FOREIGN)
    rows = [(kind, k, line) for kind, lines in got._asdict().items() for k, line in enumerate(lines)]
    return spark.createDataFrame(rows, "kind string, position long, line string")


def _defaults(spark, folder):
    """The default rules over made-up names: what anyone gets who writes no rules."""
    names = "concat(CASE doc_id % 7 WHEN 0 THEN '.env' WHEN 1 THEN '.env.example' WHEN 2 THEN 'id_rsa' WHEN 3 THEN 'a.swp' WHEN 4 THEN 'service-account-1.json' WHEN 5 THEN 'x.sync-conflict-2' ELSE 'notes.md' END)"
    docs = table(spark, folder, "documents").select("doc_id", F.concat(F.col("source"), F.lit("/"), F.expr(names)).alias("path"))
    return docs.select("doc_id", policy.verdict(policy.load_policy(None, None), "path", False).alias("verdict"))


def _names(spark, folder):
    chunks = table(spark, folder, "documents").select(scalars.content_id(F.col("text").cast("binary")).alias("chunk_id")).distinct()
    named = chunks.select("chunk_id", F.sha2(F.concat(F.lit("name/"), "chunk_id"), 256).alias("remote_id"))
    objects = named.where("substring(remote_id, 1, 1) < '8'").select("remote_id")
    return server.missing(named.select("remote_id"), objects).join(named, "remote_id").select("chunk_id")


def _attention(spark, folder):
    c = table(spark, folder, "customer")
    checkouts = c.select(F.col("c_name").alias("path"), (F.col("c_custkey") % 4).alias("dirty_files"), (F.col("c_custkey") % 3 == 0).alias("carried"), (F.col("c_custkey") % 50 == 1).alias("volatile"), (F.col("c_custkey") % 60 == 2).alias("external"))
    conflicts = c.where("c_mktsegment = 'MACHINERY'").select(F.col("c_name").alias("path"))
    heads = c.where("c_mktsegment = 'BUILDING'").select(F.col("c_name").alias("head"), F.lit(False).alias("pushed"))
    return server.attention(conflicts, checkouts, heads).select(F.col("rank").cast("long").alias("rank"), "kind", "subject")


def _edges_of_windows(spark, folder):
    """Objects a millisecond before, at and after the edge of the grace and retain windows."""
    at = [NOW - timedelta(hours=24), NOW - timedelta(days=14)]
    rows = [(f"{k}/{d}", 1, t + timedelta(milliseconds=d)) for k, t in enumerate(at) for d in (-1, 0, 1)]
    objects = spark.createDataFrame(rows, "remote_id string, bytes int, modified_utc timestamp")
    young = gc.sweep(objects, spark.createDataFrame([], "object string"), NOW).select("remote_id", "young")
    history = spark.createDataFrame([(1, f"{k}/{d}", t, t + timedelta(milliseconds=d)) for k, t in enumerate(at) for d in (-1, 0, 1)], "machine_id int, head string, set_utc timestamp, superseded_utc timestamp")
    live = gc.live_heads(spark.createDataFrame([], "id int, head string"), history, NOW).withColumn("live", F.lit(True))
    return young.join(live.withColumnRenamed("head", "remote_id"), "remote_id", "left").select("remote_id", "young", F.coalesce("live", F.lit(False)).alias("live"))


def _sessions(spark, folder):
    orders = table(spark, folder, "orders")
    sessions = orders.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("machine_id"), F.lit(NOW).alias("created_utc"))
    asked = table(spark, folder, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("session"), F.col("o_custkey").alias("machine_id"), F.col("l_partkey").alias("remote_id"))
    known = spark.createDataFrame([], "session long, object long")
    objects = table(spark, folder, "part").where("p_size < 25").select(F.col("p_partkey").alias("remote_id"))
    ids, _ = server.add_to_session(sessions, known, objects, asked)
    return ids


def _touched(spark, folder):
    objects = table(spark, folder, "part").select(F.col("p_partkey").alias("remote_id"), F.lit(datetime(2024, 1, 1)).alias("modified_utc"))
    asked = table(spark, folder, "lineitem").select((F.col("l_partkey") * 2).alias("remote_id"))  # even ids, and ids beyond all parts
    return server.touch(objects, asked, F.lit(NOW)).select("remote_id", (F.col("modified_utc") == F.lit(NOW)).alias("touched"))


def _enrolled(spark, folder):
    machines = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("linux").alias("platform"), F.sha2("c_name", 256).alias("token_hash"), F.lit(datetime(2024, 1, 1)).alias("enrolled_utc"), F.lit(datetime(2024, 1, 1)).alias("last_seen_utc"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("h"), "c_custkey")).alias("head"), F.lit(None).cast("timestamp").alias("head_updated_utc"), F.when(F.col("c_custkey") % 5 == 0, F.lit(datetime(2024, 1, 2))).alias("revoked_utc"))
    joining = table(spark, folder, "supplier").select((F.col("s_suppkey") * 20).alias("id"), F.col("s_name").alias("name"), F.lit("macos").alias("platform"), F.col("s_name").alias("token"))
    log = durable.opened(spark, scratch(spark, "state"), {"machines": machines})
    durable.enrol(log, joining, F.lit(NOW))
    durable.revoke(log, table(spark, folder, "supplier").select((F.col("s_suppkey") * 3).alias("id")), F.lit(NOW))
    after = log.at().read("machines")
    live = server.authenticate(after, table(spark, folder, "supplier").select(F.col("s_suppkey").alias("request"), F.col("s_name").alias("token")))
    return after.join(live.where("machine_id IS NOT NULL").select(F.col("machine_id").alias("id")).withColumn("known", F.lit(True)), "id", "left").select("id", "name", "platform", "head", F.col("revoked_utc").isNotNull().alias("revoked"), F.coalesce("known", F.lit(False)).alias("known"))


def _moved(spark, folder):
    history = table(spark, folder, "customer").select(F.col("c_custkey").alias("machine_id"), (F.col("c_custkey") % 7).alias("head"), F.lit(datetime(2024, 1, 1)).alias("set_utc"), F.when(F.col("c_custkey") % 4 == 0, F.lit(datetime(2024, 1, 5))).alias("superseded_utc"))
    moves = table(spark, folder, "supplier").select((F.col("s_suppkey") * 2).alias("machine_id"), F.lit(3).cast("long").alias("head"))
    log = durable.opened(spark, scratch(spark, "state"), {"history": history})
    durable.move_heads(log, moves, F.lit(NOW))
    return log.at().read("history").select("machine_id", "head", F.col("set_utc").cast("date").cast("string").alias("set_on"), F.col("superseded_utc").cast("date").cast("string").alias("superseded_on"))


def _topped(spark, folder):
    refused = table(spark, folder, "documents").where("lang = 'en'").select("doc_id")
    first = Window.orderBy("doc_id")
    top = refused.orderBy("doc_id").limit(40).withColumn("k", F.row_number().over(first))  # forty rows
    return top.crossJoin(refused.agg((F.count("*") - 40).alias("more"))).select("doc_id", "more")


def _shapes(spark, folder):
    ends = F.when(F.col("doc_id") % 3 == 0, "\r\n").when(F.col("doc_id") % 3 == 1, "\n").otherwise("")
    docs = table(spark, folder, "documents").select("doc_id", F.concat(F.replace("text", F.lit("\n"), F.when(F.col("doc_id") % 3 == 0, "\r\n").otherwise("\n")), ends).alias("x"))

    @F.pandas_udf("boolean")
    def same(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: textshape.join_lines(textshape.lines_of(x.encode()), textshape.shape_of(x.encode(), b"")) == x.encode())

    return docs.select("doc_id", same("x").alias("same"))


def _json_merges(spark, folder):
    @F.pandas_udf("string")
    def merged(base: pd.Series, ours: pd.Series, theirs: pd.Series) -> pd.Series:
        done = [structural.merge_json(*(x.encode() for x in sides)) for sides in zip(base, ours, theirs, strict=True)]
        return pd.Series([out.content.decode() if out else None for out in done])

    e = table(spark, folder, "events")
    ours = F.concat(F.lit('{"k": 1, "ours": '), "user_id", F.lit("}"))
    theirs = F.concat(F.lit('{"k": '), F.when(F.col("event_id") % 3 == 0, 2).otherwise(1), F.lit(', "theirs": "'), "event_type", F.lit('"}'))
    return e.select("event_id", merged(F.lit('{"k": 1}'), ours, theirs).alias("merged"))


def _unresolved(spark, folder):
    from strandkeep import settings

    state = table(spark, folder, "documents").select(F.concat("source", F.lit("/"), "doc_id").alias("path"))
    there = table(spark, folder, "labels").select(F.concat(F.lit("src"), F.col("doc_id") % 20, F.lit("/"), "doc_id", F.lit(f".{settings.NAMESPACE}-theirs")).alias("path"))
    return merge.unresolved(state, there).select("path")


def _quarantine(spark, folder):
    swept = table(spark, folder, "part").select(F.col("p_partkey").alias("remote_id"), (F.col("p_size") > 25).alias("young"))
    objects = swept.select("remote_id")
    trash = spark.createDataFrame([("20240131T000000Z", 0), ("20240131T000000Z-2", 0)], "stamp string, remote_id long")
    left, after = gc.collect(objects, swept, trash, "20240131T000000Z")
    return after.select("stamp", "remote_id").unionByName(left.select(F.lit("kept").alias("stamp"), "remote_id"))


def _machines_by_name(spark, folder):
    rows = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("machine_name"), F.col("s_nationkey").alias("head"))
    return server.resolve_head(rows, "SUPPLIER#000000003").select("id", "head")


def _pairs_merges(spark, folder):
    @F.pandas_udf("string")
    def merged(base: pd.Series, ours: pd.Series, theirs: pd.Series) -> pd.Series:
        done = [structural.merge_pairs(*(x.encode() for x in sides)) for sides in zip(base, ours, theirs, strict=True)]
        return pd.Series([out.content.decode() if out else None for out in done])

    e = table(spark, folder, "events")
    ours = F.concat(F.lit("# ours\nA="), "user_id", F.lit("\nB=1\nD=4\n"))
    theirs = F.concat(F.lit("A="), F.when(F.col("event_id") % 3 == 0, "x").otherwise("0"), F.lit("\nB=1\nC="), "event_type", F.lit("\n"))
    return e.select("event_id", merged(F.lit("A=0\nB=1\nD=4\n"), ours, theirs).alias("merged"))


QUERIES = {
    "cnt20_unresolved": _unresolved,
    "snk9_quarantine": _quarantine,
    "sta12_resolve_head": _machines_by_name,
    "cnt11_pairs_merge": _pairs_merges,
    "flt8_foreign_rules": _foreign,
    "src13_default_rules": _defaults,
    "jn13_name_lookup": _names,
    "sta14_attention": _attention,
    "str1_window_edges": _edges_of_windows,
    "sta7_add_to_session": _sessions,
    "jn7_touch": _touched,
    "sta1_enrol_revoke": _enrolled,
    "sta5_move_heads": _moved,
    "lim1_top_and_more": _topped,
    "cnt5_text_shape": _shapes,
    "cnt10_json_merge": _json_merges,
}

_VERDICTS = ["Never", "Include", "Never", "Ignored", "Never", "Ignored", "Include"]

ORACLES = {
    "cnt20_unresolved": "SELECT source || '/' || doc_id AS path FROM documents WHERE source || '/' || doc_id IN (SELECT 'src' || (doc_id % 20) || '/' || doc_id FROM labels)",
    "snk9_quarantine": "SELECT CASE WHEN p_size > 25 THEN 'kept' ELSE '20240131T000000Z-3' END AS stamp, p_partkey AS remote_id FROM part UNION ALL SELECT '20240131T000000Z', 0 UNION ALL SELECT '20240131T000000Z-2', 0",
    "sta12_resolve_head": "SELECT s_suppkey AS id, s_nationkey AS head FROM supplier WHERE lower(s_name) = 'supplier#000000003'",
    "cnt11_pairs_merge": """SELECT event_id, CASE WHEN event_id % 3 <> 0 OR user_id = 0 THEN 'A=' || CASE WHEN event_id % 3 = 0 THEN 'x' ELSE CAST(user_id AS VARCHAR) END || chr(10) || 'B=1' || chr(10) || 'C=' || event_type || chr(10) END AS merged FROM events""",
    "flt8_foreign_rules": "SELECT * FROM (VALUES ('ignore', 0, '# build output'), ('ignore', 1, 'build'), ('ignore', 2, '*.tmp'), ('ignore', 3, '# Secrets of the team'), ('ignore', 4, '!vault/readme'), ('ignore', 5, '# plain again'), ('ignore', 6, 'notes'), "
    "('never', 0, 'vault'), ('never', 1, '*.pem'), ('never', 2, 'deploy_key'), ('unsupported', 0, '(?d)(?i)*.tmp  (flags dropped)'), ('unsupported', 1, '#include other')) t(kind, position, line)",
    "src13_default_rules": f"SELECT doc_id, {_VERDICTS}[doc_id % 7 + 1] AS verdict FROM documents",
    "jn13_name_lookup": "SELECT DISTINCT sha256(text) AS chunk_id FROM documents WHERE sha256('name/' || sha256(text)) >= '8'",
    "sta14_attention": """SELECT CAST(0 AS BIGINT) AS rank, 'conflict' AS kind, c_name AS subject FROM customer WHERE c_mktsegment = 'MACHINERY' UNION ALL SELECT 1, 'only_here', c_name FROM customer WHERE c_custkey % 4 > 0 AND c_custkey % 3 > 0
        UNION ALL SELECT 2, 'volatile', c_name FROM customer WHERE c_custkey % 50 = 1 UNION ALL SELECT 3, 'not_pushed', c_name FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 4, 'external', c_name FROM customer WHERE c_custkey % 60 = 2""",
    "str1_window_edges": "SELECT * FROM (VALUES ('0/-1', false, true), ('0/0', true, true), ('0/1', true, true), ('1/-1', false, false), ('1/0', false, true), ('1/1', false, true)) t(remote_id, young, live)",
    "sta7_add_to_session": "SELECT DISTINCT l_orderkey AS session, l_partkey AS object FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O'",
    "jn7_touch": "SELECT p_partkey AS remote_id, p_partkey IN (SELECT l_partkey * 2 FROM lineitem) AS touched FROM part",
    "sta1_enrol_revoke": """WITH j AS (SELECT s_suppkey * 20 AS id, s_name FROM supplier), r AS (SELECT s_suppkey * 3 AS id FROM supplier), every AS (SELECT c_custkey AS id FROM customer UNION SELECT id FROM j)
        SELECT id, coalesce(s_name, c_name) AS name, CASE WHEN s_name IS NULL THEN 'linux' ELSE 'macos' END AS platform, CASE WHEN c_custkey % 2 = 0 THEN 'h' || c_custkey END AS head,
            id IN (SELECT id FROM r) OR (s_name IS NULL AND c_custkey % 5 = 0) AS revoked, s_name IS NOT NULL AND id NOT IN (SELECT id FROM r) AS known
        FROM every LEFT JOIN customer ON c_custkey = id LEFT JOIN j USING (id)""",
    "sta5_move_heads": """WITH h AS (SELECT c_custkey AS m, c_custkey % 7 AS head, c_custkey % 4 > 0 AS is_open, c_custkey % 2 = 0 AND c_custkey // 2 IN (SELECT s_suppkey FROM supplier) AS moved FROM customer)
        SELECT m AS machine_id, head, '2024-01-01' AS set_on, CASE WHEN NOT is_open THEN '2024-01-05' WHEN moved AND head <> 3 THEN '2024-01-31' END AS superseded_on FROM h
        UNION ALL SELECT s_suppkey * 2, 3, '2024-01-31', NULL FROM supplier WHERE s_suppkey * 2 NOT IN (SELECT m FROM h WHERE is_open AND head = 3)""",
    "lim1_top_and_more": "SELECT doc_id, (SELECT count(*) - 40 FROM documents WHERE lang = 'en') AS more FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 40",
    "cnt5_text_shape": "SELECT doc_id, true AS same FROM documents",
    "cnt10_json_merge": """SELECT event_id, '{' || chr(10) || '  "k": ' || CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END || ',' || chr(10) || '  "ours": ' || user_id || ',' || chr(10) || '  "theirs": "' || event_type || '"' || chr(10) || '}' || chr(10) AS merged FROM events""",
}
