"""Queries over ancestry, head history and garbage collection."""

from datetime import datetime

from pyspark.sql import functions as F

from strandkeep.operators import gc, graph, server
from strandkeep.sources.tables import table

NOW = datetime(2024, 1, 31)


def _edges(spark, folder):
    """Conversations as histories: each turn's parent is the turn before, every fourth also merges the one three back; odd turns carry a branch node."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn").distinct()
    node = F.col("conv_id") * 1000 + F.col("turn")
    first = turns.where("turn > 0").select(node.alias("child"), (node - 1).alias("parent"), F.lit(0).alias("ordinal"))
    second = turns.where("turn % 4 = 3").select(node.alias("child"), (node - 3).alias("parent"), F.lit(1).alias("ordinal"))
    branch = turns.where("turn % 2 = 1").select((node + 500).alias("child"), (node - 1).alias("parent"), F.lit(0).alias("ordinal"))
    return first.unionByName(second).unionByName(branch)


def _heads(spark, folder):
    turns = table(spark, folder, "conversations").select("conv_id", "turn")
    heads = turns.groupBy("conv_id").agg((F.col("conv_id") * 1000 + F.max("turn")).alias("ours"), (F.col("conv_id") * 1000 + 500 + F.max(F.when(F.col("turn") % 2 == 1, F.col("turn")))).alias("theirs"))
    return heads.where("theirs IS NOT NULL")


def _closure(spark, folder):
    seeds = _heads(spark, folder).select(F.col("ours").alias("root"), F.col("ours").alias("node"))
    return graph.closure(_edges(spark, folder), seeds).select("root", "node", F.col("depth").cast("long").alias("depth"))


def _ancestors(spark, folder):
    heads = _heads(spark, folder)
    pairs = heads.select((F.col("conv_id") * 1000).alias("ancestor"), F.col("ours").alias("descendant")).unionByName(heads.select(F.col("theirs").alias("ancestor"), F.col("ours").alias("descendant")))
    return graph.is_ancestor(_edges(spark, folder), pairs)


def _bases(spark, folder):
    return graph.merge_bases(_edges(spark, folder), _heads(spark, folder).select("ours", "theirs"))


def _moves(spark, folder):
    return table(spark, folder, "events").select(F.col("user_id").alias("machine_id"), F.col("event_id").alias("head"), F.col("ts").alias("moved_utc"), F.col("event_id").alias("seq"))


def _history(spark, folder):
    return server.head_history(_moves(spark, folder))


def _pins(spark, folder):
    return table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("head"), F.expr("(l_orderkey div 4) * 10 + l_linenumber").alias("object")).distinct()


def _machines(spark, folder):
    return _history(spark, folder).where("superseded_utc IS NULL").select(F.col("machine_id").alias("id"), "head")


def _objects(spark, folder):
    every = _pins(spark, folder).select("object").distinct()
    return every.select(F.col("object").alias("remote_id"), (F.col("object") % 1000 + 100).alias("bytes"), F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, cast(object % 31 as int))").alias("modified_utc"))


def _sessions(spark, folder):
    sessions = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("machine_id"), F.expr("timestamp'2024-01-31' - make_interval(0, 0, 0, 0, cast(o_orderkey % 49 as int))").alias("created_utc"))
    ids = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("session"), F.expr("(l_orderkey div 4) * 10 + l_linenumber + l_partkey % 3").alias("object")).distinct()
    return sessions, ids


def _unpinned(spark, folder):
    return gc.unpinned_machines(_machines(spark, folder), _pins(spark, folder)).select("id", "head")


def _pinned_world(spark, folder):
    """The state without the machines whose heads have no pins."""
    bad = _unpinned(spark, folder).select(F.col("id").alias("machine_id"))
    history = _history(spark, folder).join(bad, "machine_id", "left_anti")
    machines = history.where("superseded_utc IS NULL").select(F.col("machine_id").alias("id"), "head")
    return machines, history, _pins(spark, folder), *_sessions(spark, folder), _objects(spark, folder)


def _report(spark, folder):
    return gc.report(*_pinned_world(spark, folder), NOW)


def _refusal(spark, folder):
    return gc.report(_machines(spark, folder), _history(spark, folder), _pins(spark, folder), *_sessions(spark, folder), _objects(spark, folder), NOW)


def _sweep(spark, folder):
    machines, history, pins, sessions, ids, objects = _pinned_world(spark, folder)
    live = gc.live_objects(pins, gc.live_heads(machines, history, NOW), sessions, ids, NOW)
    return gc.sweep(objects, live, NOW).select("remote_id", "young")


def _live_heads(spark, folder):
    return gc.live_heads(_machines(spark, folder), _history(spark, folder), NOW)


def _missing(spark, folder):
    _, ids = _sessions(spark, folder)
    return server.missing(ids.select("session", F.col("object").alias("remote_id")), _objects(spark, folder))


def _pinned_flags(spark, folder):
    return server.with_pinned(_machines(spark, folder), _pins(spark, folder))


def _commits_asked(spark, folder):
    commits = table(spark, folder, "orders").select((F.col("o_orderkey") + F.when(F.col("o_orderkey") % 25 == 3, 10**9).otherwise(0)).alias("session"), "o_custkey", F.expr("(o_orderkey div 4) * 10 + 1 + o_orderkey % 3").alias("snapshot"))
    return commits.select("session", F.col("o_custkey").alias("machine_id"), "snapshot")


def _commits(spark, folder):
    sessions, ids = _sessions(spark, folder)
    return server.commit_outcomes(_commits_asked(spark, folder), sessions, ids, _objects(spark, folder))


def _ignore_inserts(spark, folder):
    pins = _pins(spark, folder)
    new = pins.withColumn("object", F.col("object") + 1)
    return server.insert_or_ignore(pins, new.unionByName(pins).unionByName(new))


def _forgotten(spark, folder):
    machines, history, pins, sessions, ids, _ = _pinned_world(spark, folder)
    heads = gc.live_heads(machines, history, NOW)
    out = None
    for name, df in zip(("history", "pins", "sessions", "session_ids"), gc.forget(history, pins, sessions, ids, heads, NOW), strict=True):
        part = df.agg(F.lit(name).alias("kept"), F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


def _trash(spark, folder):
    stamps = table(spark, folder, "events").select(F.when(F.col("event_id") % 17 == 0, "not a stamp").otherwise(F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'")).alias("stamp"), F.col("event_id").alias("remote_id"))
    return gc.purge(stamps, NOW)


def _first_writer(spark, folder):
    from strandkeep.operators import store

    old = table(spark, folder, "events").where("event_type = 'error' AND value > 90").select(F.col("user_id").alias("remote_id"))
    new = table(spark, folder, "events").select(F.col("user_id").alias("remote_id"), F.col("event_id").alias("arrival"), F.encode("props", "utf-8").alias("blob"))
    return store.put_first(old, new, 9).select("remote_id", "arrival")


QUERIES = {
    "grf3_closure": _closure,
    "grf1_ancestor": _ancestors,
    "grf2_merge_base": _bases,
    "sta5_head_history": _history,
    "str5_unpinned_machines": _unpinned,
    "set3_live_heads": _live_heads,
    "agg8_gc_report": _report,
    "str5_gc_refusal": _refusal,
    "jn10_gc_sweep": _sweep,
    "jn6_missing_ids": _missing,
    "jn8_pinned_flags": _pinned_flags,
    "sta8_commit_outcomes": _commits,
    "set5_insert_or_ignore": _ignore_inserts,
    "set6_forget": _forgotten,
    "snk10_trash_purge": _trash,
    "snk5_first_writer": _first_writer,
}

_EDGES = """(SELECT conv_id * 1000 + turn AS child, conv_id * 1000 + turn - 1 AS parent FROM t WHERE turn > 0 UNION ALL SELECT conv_id * 1000 + turn, conv_id * 1000 + turn - 3 FROM t WHERE turn % 4 = 3
    UNION ALL SELECT conv_id * 1000 + turn + 500, conv_id * 1000 + turn - 1 FROM t WHERE turn % 2 = 1)"""
_GRAPH = f"""WITH RECURSIVE t AS (SELECT DISTINCT conv_id, turn FROM conversations), e AS {_EDGES},
    h AS (SELECT conv_id, conv_id * 1000 + max(turn) AS ours, conv_id * 1000 + 500 + max(turn) FILTER (turn % 2 = 1) AS theirs FROM t GROUP BY conv_id HAVING max(turn) FILTER (turn % 2 = 1) IS NOT NULL),
    up AS (SELECT ours AS root, ours AS node, CAST(0 AS BIGINT) AS depth FROM h UNION SELECT theirs, theirs, 0 FROM h UNION SELECT up.root, e.parent, up.depth + 1 FROM up JOIN e ON e.child = up.node),
    c AS (SELECT root, node, min(depth) AS depth FROM up GROUP BY root, node)"""
_HISTORY = "h AS (SELECT user_id AS machine_id, event_id AS head, ts AS set_utc, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS superseded_utc FROM events)"
_PINS = "p AS (SELECT DISTINCT l_orderkey AS head, (l_orderkey // 4) * 10 + l_linenumber AS object FROM lineitem)"
_BAD = "bad AS (SELECT machine_id AS id, head FROM h WHERE superseded_utc IS NULL AND head NOT IN (SELECT head FROM p))"
_OBJECTS = "o AS (SELECT DISTINCT object AS remote_id, object % 1000 + 100 AS bytes, TIMESTAMP '2024-01-01' + to_days(CAST(object % 31 AS INTEGER)) AS modified_utc FROM p)"
_SESSIONS = """s AS (SELECT o_orderkey AS id, o_custkey AS machine_id, TIMESTAMP '2024-01-31' - to_hours(CAST(o_orderkey % 49 AS INTEGER)) AS created_utc FROM orders),
    i AS (SELECT DISTINCT l_orderkey AS session, (l_orderkey // 4) * 10 + l_linenumber + l_partkey % 3 AS object FROM lineitem)"""
_STATE = f"""WITH {_HISTORY}, {_PINS}, {_BAD}, {_OBJECTS}, {_SESSIONS}, g AS (SELECT * FROM h WHERE machine_id NOT IN (SELECT id FROM bad)),
    heads AS (SELECT DISTINCT head FROM g WHERE superseded_utc IS NULL OR superseded_utc >= TIMESTAMP '2024-01-17'),
    live AS (SELECT object FROM p WHERE head IN (SELECT head FROM heads) UNION SELECT object FROM i JOIN s ON s.id = i.session WHERE created_utc >= TIMESTAMP '2024-01-30'),
    swept AS (SELECT remote_id, bytes, modified_utc >= TIMESTAMP '2024-01-30' AS young FROM o WHERE remote_id NOT IN (SELECT object FROM live))"""

ORACLES = {
    "grf3_closure": f"{_GRAPH} SELECT root, node, depth FROM c WHERE root IN (SELECT ours FROM h)",
    "grf1_ancestor": f"""{_GRAPH} SELECT ancestor, descendant, (descendant, ancestor) IN (SELECT (root, node) FROM c) AS is_ancestor
        FROM (SELECT conv_id * 1000 AS ancestor, ours AS descendant FROM h UNION ALL SELECT theirs, ours FROM h)""",
    "grf2_merge_base": f"""{_GRAPH} SELECT ours, theirs, (SELECT arg_min(x.node, x.depth) FROM c x JOIN c y ON y.node = x.node AND y.root = h.ours WHERE x.root = h.theirs) AS base FROM h""",
    "sta5_head_history": f"WITH {_HISTORY} SELECT * FROM h",
    "str5_unpinned_machines": f"WITH {_HISTORY}, {_PINS}, {_BAD} SELECT * FROM bad",
    "set3_live_heads": f"WITH {_HISTORY} SELECT DISTINCT head FROM h WHERE superseded_utc IS NULL OR superseded_utc >= TIMESTAMP '2024-01-17'",
    "agg8_gc_report": f"""{_STATE} SELECT false AS refused, (SELECT count(*) FROM heads) AS live_heads, (SELECT count(*) FROM heads WHERE head NOT IN (SELECT head FROM p)) AS unretainable,
        (SELECT count(*) FROM live) AS live_objects, count(*) FILTER (young) AS young, count(*) FILTER (NOT young) AS candidates, CAST(coalesce(sum(bytes) FILTER (NOT young), 0) AS BIGINT) AS candidate_bytes FROM swept""",
    "str5_gc_refusal": f"""{_STATE.replace("WHERE machine_id NOT IN (SELECT id FROM bad)", "")}, k AS (SELECT count(*) > 0 AS refused, CASE WHEN count(*) > 0 THEN 0 ELSE 1 END AS one FROM bad)
        SELECT refused, one * (SELECT count(*) FROM heads) AS live_heads, one * (SELECT count(*) FROM heads WHERE head NOT IN (SELECT head FROM p)) AS unretainable, one * (SELECT count(*) FROM live) AS live_objects,
            one * (SELECT count(*) FROM swept WHERE young) AS young, one * (SELECT count(*) FROM swept WHERE NOT young) AS candidates, CAST(one * (SELECT coalesce(sum(bytes), 0) FROM swept WHERE NOT young) AS BIGINT) AS candidate_bytes FROM k""",
    "jn10_gc_sweep": f"{_STATE} SELECT remote_id, young FROM swept",
    "jn6_missing_ids": f"WITH {_PINS}, {_OBJECTS}, {_SESSIONS} SELECT session, object AS remote_id FROM i WHERE object NOT IN (SELECT remote_id FROM o)",
    "jn8_pinned_flags": f"WITH {_HISTORY}, {_PINS} SELECT machine_id AS id, head, EXISTS (SELECT 1 FROM p WHERE p.head = h.head) AS pinned FROM h WHERE superseded_utc IS NULL",
    "sta8_commit_outcomes": f"""WITH {_PINS}, {_OBJECTS}, {_SESSIONS}, c AS (SELECT o_orderkey + CASE WHEN o_orderkey % 25 = 3 THEN 1000000000 ELSE 0 END AS session, o_custkey AS machine_id, (o_orderkey // 4) * 10 + 1 + o_orderkey % 3 AS snapshot FROM orders),
        m AS (SELECT session, count(*) AS n FROM i WHERE object NOT IN (SELECT remote_id FROM o) GROUP BY session)
        SELECT c.session, c.machine_id, snapshot, CASE WHEN s.id IS NULL THEN 'NoSuchSession' WHEN i.object IS NULL THEN 'SnapshotNotInSession' WHEN n > 0 THEN 'ObjectsMissing' ELSE 'Committed' END AS outcome,
            CASE WHEN s.id IS NOT NULL AND i.object IS NOT NULL AND n > 0 THEN n ELSE 0 END AS n_missing
        FROM c LEFT JOIN s ON s.id = c.session AND s.machine_id = c.machine_id LEFT JOIN i ON i.session = c.session AND i.object = c.snapshot LEFT JOIN m ON m.session = c.session""",
    "set5_insert_or_ignore": f"WITH {_PINS} SELECT head, object FROM p UNION SELECT head, object + 1 FROM p",
    "set6_forget": f"""{_STATE} SELECT 'history' AS kept, count(*) AS n FROM g WHERE superseded_utc IS NULL OR superseded_utc >= TIMESTAMP '2024-01-17' UNION ALL SELECT 'pins', count(*) FROM p WHERE head IN (SELECT head FROM heads)
        UNION ALL SELECT 'sessions', count(*) FROM s WHERE created_utc >= TIMESTAMP '2024-01-30' UNION ALL SELECT 'session_ids', count(*) FROM i JOIN s ON s.id = i.session WHERE created_utc >= TIMESTAMP '2024-01-30'""",
    "snk10_trash_purge": """SELECT CASE WHEN event_id % 17 = 0 THEN 'not a stamp' ELSE strftime(ts, '%Y%m%dT%H%M%SZ') END AS stamp, event_id AS remote_id FROM events
        WHERE event_id % 17 = 0 OR date_trunc('second', ts) >= TIMESTAMP '2024-01-24'""",
    "snk5_first_writer": """SELECT user_id AS remote_id, min(event_id) AS arrival FROM events WHERE strlen(props) <= 9 AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 90) GROUP BY 1""",
}
