"""Queries over checkouts, carried work, refs, merges under way, and state changes applied as a whole."""

from datetime import timedelta
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandkeep import settings
from strandkeep.operators import durable, gc, merge, server, store, workspace
from strandkeep.plans import histories
from strandkeep.plans.histories import NOW
from strandkeep.sources import files, versions
from strandkeep.sources.tables import table
from strandkeep.stash import scratch, stash


def _union(parts) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _checkouts(spark, folder):
    return table(spark, folder, "customer").select(F.concat(F.lit("repo/"), "c_custkey").alias("path"), (F.col("c_custkey") % 4).alias("dirty_files"), (F.col("c_custkey") % 7).alias("head"))


def _work(spark, folder):
    return table(spark, folder, "orders").select(F.concat(F.lit("repo/"), F.col("o_custkey")).alias("path"), "o_orderkey")


def _carried(spark, folder):
    found = workspace.carried_places(_checkouts(spark, folder), _work(spark, folder).where("o_orderkey % 3 = 0"), F.col("head") == 3)
    return found.select("path", "dirty_files", "place")


def _at_risk(spark, folder):
    return workspace.at_risk(_checkouts(spark, folder), _work(spark, folder).where("o_orderkey % 3 = 0"))


def _machines(spark, folder):
    return table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.col("c_mktsegment"), F.lit("-"), F.col("c_custkey") % 50).alias("name"), F.when(F.col("c_custkey") % 4 > 0, F.col("c_custkey") % 100).alias("head"))


def _fetched(spark, folder):
    return workspace.fetched_heads(_machines(spark, folder), table(spark, folder, "supplier").select(F.col("s_suppkey").alias("head"))).select("id", "name", "state")


def _by_name(spark, folder):
    return workspace.machines_by_name(_machines(spark, folder)).select("id", "name", F.col("position").cast("long").alias("position"))


def _same_carried(spark, folder):
    one = table(spark, folder, "orders").select((F.col("o_custkey") % 40).alias("g"), F.col("o_orderkey").cast("string").alias("path"), (F.col("o_orderkey") % 9).alias("base_commit"), F.array(F.col("o_custkey"), F.col("o_orderkey")).alias("patch_chunks"))
    changed = F.when(F.col("path").cast("long") % 997 == 5, F.reverse("patch_chunks")).otherwise(F.col("patch_chunks"))
    two = one.select("g", "path", F.when(F.col("path").cast("long") % 1009 == 3, -1).otherwise(F.col("base_commit")).alias("base_commit"), changed.alias("patch_chunks")).where("cast(path as long) % 991 <> 4")
    return workspace.same_carried(one, two, ["g"])


def _land(spark, folder):
    work = table(spark, folder, "orders").select(F.concat(F.lit("repo/"), "o_custkey").alias("repo"), F.col("o_orderkey").alias("work_id"), (F.col("o_orderkey") % 7).alias("base_commit"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderkey") % 5 > 1).alias("fits"))
    here = table(spark, folder, "customer").where("c_acctbal > 0").select(F.concat(F.lit("repo/"), "c_custkey").alias("repo"), (F.col("c_custkey") % 3).alias("dirty_files"), (F.col("c_custkey") % 7).alias("head"))
    kinds = {"plain": {}, "forced": {"force": True}, "three_way": {"three_way": True}}
    return _union(workspace.land_gate(work, here, **how).select("work_id", F.lit(kind).alias("how"), "refusal") for kind, how in kinds.items())


def _trees(spark, folder):
    return table(spark, folder, "customer").select(F.col("c_nationkey").alias("repository"), F.col("c_name").alias("path"), (F.col("c_custkey") % 10 == 0).alias("is_primary"))


def _groups(spark, folder):
    return workspace.working_trees(_trees(spark, folder))


def _tree_counts(spark, folder):
    return workspace.tree_counts(_trees(spark, folder), table(spark, folder, "customer").where("c_acctbal > 0").select(F.col("c_nationkey").alias("changed_files")))


def _shares(spark, folder):
    rows = table(spark, folder, "documents").groupBy("source").agg(F.sum(F.when(F.col("doc_id") % 3 == 0, F.col("n_chars"))).alias("fresh"), F.sum(F.when(F.col("source") != "src1", F.col("n_chars")).otherwise(0)).alias("every"))
    return rows.select("source", F.round(workspace.fresh_share("fresh", "every"), 6).alias("share"))


def _json_states(spark, folder):
    texts = table(spark, folder, "events").select("event_id", F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("x{"), "props")).when(F.col("event_id") % 4 == 1, F.lit("{oops")).otherwise(F.col("props")).alias("text"))
    return files.read_json(texts, "k long", False, keep=["event_id"]).select("event_id", F.col("value.k").alias("k"))


def _refs(spark, folder):
    """HEAD of every customer's workspace written over an older one, then other machines' heads; a head that is no id does not count."""
    one = table(spark, folder, "customer").where("c_nationkey < 20").select(F.lit("REMOTE_HEADS").alias("name"), F.col("c_custkey").cast("string").alias("machine_id"), F.col("c_name").alias("machine_name"), F.sha2("c_name", 256).alias("head"))
    none = F.lit(None).cast("string")
    heads = [spark.range(1).select(F.lit("HEAD").alias("name"), none.alias("machine_id"), none.alias("machine_name"), F.sha2(F.lit(x), 256).alias("head")) for x in ("old", "new")]
    refs = workspace.write_ref(server.migrate(None, spark, workspace.REFS), "HEAD", heads[0])
    refs = workspace.write_ref(refs, "REMOTE_HEADS", one.withColumn("head", F.lit("older")))
    refs = workspace.write_ref(refs, "HEAD", heads[1])
    path = scratch(spark, "refs")
    workspace.save_refs(refs, path)
    refs = workspace.load_refs(spark, path)
    refs = workspace.write_ref(refs, "REMOTE_HEADS", one.withColumn("head", F.when(F.col("machine_id").cast("long") % 6 == 0, F.lit("torn")).otherwise(F.col("head"))))
    workspace.save_refs(refs, path)
    refs = workspace.load_refs(spark, path)
    return _union(workspace.read_ref(refs, n) for n in ("HEAD", "PUSHED", "REMOTE_HEADS")).select("name", "machine_id", "machine_name", "head")


def _migrated(spark, folder):
    old = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return server.migrate(old, spark, "id long, name string, head string, revoked_utc timestamp").select("id", "name", "head", F.col("revoked_utc").isNull().alias("fresh"))


def _committed(spark, folder):
    """All commits of one each machine through a log of versions, then its newest one."""
    sessions, ids = histories._sessions(spark, folder)
    commits = histories._commits_asked(spark, folder)
    one = commits.groupBy("machine_id").agg(F.min_by(F.struct("session", "snapshot"), "session").alias("x")).select("machine_id", "x.session", "x.snapshot")
    before = {"machines": histories._machines(spark, folder), "history": histories._history(spark, folder), "pins": histories._pins(spark, folder), "sessions": sessions, "session_ids": ids, "objects": histories._objects(spark, folder)}
    log = durable.opened(spark, scratch(spark, "state"), before)
    durable.commit_heads(log, stash(one), F.lit(NOW))
    now = log.at()
    return _union([
        now.read("machines").select(F.lit("machine").alias("kind"), F.col("id").alias("a"), F.col("head").alias("b")),
        now.read("history").select(F.when(F.col("superseded_utc").isNull(), "open").otherwise("closed").alias("kind"), F.col("machine_id").alias("a"), F.col("head").alias("b")),
        now.read("pins").select(F.lit("pin").alias("kind"), F.col("head").alias("a"), F.col("object").alias("b")),
        now.read("sessions").select(F.lit("session").alias("kind"), F.col("id").alias("a"), F.col("machine_id").alias("b")),
        now.read("session_ids").select(F.lit("listed").alias("kind"), F.col("session").alias("a"), F.col("object").alias("b")),
    ])


def _versions(spark, folder):
    """The events' last moves of each type as one version after the other; what every version says of every machine's open head."""
    moves = table(spark, folder, "events").groupBy("event_type", F.col("user_id").alias("machine_id")).agg(F.max("event_id").alias("head"))
    moves = stash(moves)
    history = spark.createDataFrame([], "machine_id long, head long, set_utc timestamp, superseded_utc timestamp")
    log = durable.opened(spark, scratch(spark, "state"), {"history": history})
    kinds = [r[0] for r in moves.select("event_type").distinct().orderBy("event_type").collect()]  # a handful
    for k, kind in enumerate(kinds):
        durable.move_heads(log, moves.where(F.col("event_type") == kind), F.lit(NOW + timedelta(days=k)))
    states = [(v, log.at(v).read("history")) for v in log.versions()]
    return _union(h.where("superseded_utc IS NULL").select(F.lit(v).cast("long").alias("version"), "machine_id", "head") for v, h in states)


_STAMPS = [("20240101T000000Z", 7), ("20240124T000000Z", 8), ("20240131T000000Z", 9), ("notes", 10)]


def _state(spark, folder) -> gc.State:
    return gc.State(*histories._pinned_world(spark, folder), spark.createDataFrame(_STAMPS, "stamp string, remote_id long"))


def _counts(report: DataFrame, after: gc.State) -> DataFrame:
    """The report and the rows that each table has afterwards, as name and value."""
    shown = report.select(F.explode(F.create_map(*[x for c in report.columns for x in (F.lit(c), F.col(c).cast("string"))])).alias("name", "value"))
    sums = [getattr(after, n).agg(F.lit(n).alias("name"), F.count("*").cast("string").alias("value")) for n in after._fields]
    return _union([shown, *sums])


def _collected(spark, folder):
    """A collection as one version of a log; a dry run before it makes none."""
    before = _state(spark, folder)
    log = durable.opened(spark, scratch(spark, "state"), before._asdict())
    there = log.at().read("objects").where("remote_id % 7 <> 2")
    begun = log.latest()
    durable.collect(log, NOW)
    done = durable.collect(log, NOW, apply=True, there=there)
    return _counts(done.result, durable.state(log, begun + 1))


def _dry_run(spark, folder):
    return _counts(*gc.garbage_collect(_state(spark, folder), NOW))


def _computed(spark, folder):
    """Merges over a history 0 -> 1 (ours), 0 -> 2 (theirs), 1 -> 3: apart, behind, ahead and without a common base."""
    edges = spark.createDataFrame([(1, 0, 0), (2, 0, 0), (3, 1, 0)], "child long, parent long, ordinal int")
    names = {0: "base", 1: "ours", 2: "theirs", 3: "theirs", 9: "theirs"}
    entries = _union(versions.entries(spark, folder, v).withColumn("snapshot_id", F.lit(k).cast("long")) for k, v in names.items())
    repos = table(spark, folder, "nation").select("n_nationkey", "n_name", F.explode(F.array(*[F.lit(k).cast("long") for k in names])).alias("snapshot_id"))
    repos = repos.select("snapshot_id", F.col("n_name").alias("path"), F.lit("main").alias("branch"), F.when(F.col("snapshot_id") == 2, F.col("n_nationkey") % 3).otherwise(0).alias("head"))
    out = []
    for case, (ours, theirs) in {"apart": (1, 2), "behind": (1, 3), "ahead": (3, 1), "unrelated": (1, 9)}.items():
        done = merge.compute(edges, entries, repos, ours, theirs)
        out += [done.items.select(F.lit(case).alias("which"), "path", "action"), done.repos.select(F.lit(case).alias("which"), "path", F.col("kind").alias("action"))]
        out.append(spark.range(1).select(F.lit(case).alias("which"), F.lit(f"base {done.base}").alias("path"), F.lit("fast forward" if done.fast_forward else "merge").alias("action")))
    return _union(out)


def _continued(spark, folder):
    """A merge with conflicts, some settled: first it waits, then it goes on, or is dropped."""
    docs = table(spark, folder, "documents").select(F.concat("source", F.lit("/"), "doc_id").alias("path"), "doc_id")
    conflicts = docs.where("doc_id % 4 = 0").select("path", F.lit("both changed").alias("reason"))
    beside = [docs.where(when).select(F.concat("path", F.lit(f".{settings.NAMESPACE}-{side}")).alias("path")) for side, when in (("theirs", "doc_id % 8 = 0"), ("base", "doc_id % 4 = 0"))]
    pending = workspace.Pending("a", "b", conflicts)
    there = _union([docs.select("path"), *beside])
    waiting = workspace.continue_merge(pending, there)
    done = workspace.continue_merge(pending, _union([docs.select("path"), beside[1]]))
    rows = [
        waiting.unresolved.select(F.lit("unresolved").alias("what"), "path"), waiting.files.agg(F.lit("waiting").alias("what"), F.count("*").cast("string").alias("path")),
        done.files.select(F.lit("after").alias("what"), "path"), workspace.abort_merge(pending, there).agg(F.lit("aborted").alias("what"), F.count("*").cast("string").alias("path")),
        spark.createDataFrame([("parents", ",".join(done.parents)), ("done", f"{waiting.done} {done.done}")], "what string, path string"),
    ]
    return _union(rows)


def _captured(spark, folder):
    """Work carried as patches, written to a snapshot's lines and put together again from its chunks."""
    docs = table(spark, folder, "documents").select(F.concat(F.lit("repo\t"), "doc_id").alias("path"), F.when(F.col("doc_id") % 6 > 0, F.sha2(F.col("doc_id").cast("string"), 256)).alias("base_commit"), F.when(F.col("doc_id") % 3 > 0, F.col("lang")).alias("branch"), F.encode("text", "utf-8").alias("patch"), (F.col("doc_id") % 5).cast("int").alias("changed_files"), F.lit(1).alias("staged_files"))
    taken = workspace.capture(docs)
    again = workspace.read_carry_lines(workspace.carry_lines(taken.carried))
    whole = store.reassemble(again.select("path", F.col("patch_chunks").alias("chunks")), taken.objects)
    return again.join(whole, "path").select("path", "base_commit", "branch", "patch_bytes", "changed_files", F.sha2("content", 256).alias("sha256"))


def _walked(spark, folder):
    """A listed tree with checkouts, links, rules and companions: what the walk keeps, refuses and leaves to its own history."""
    from strandkeep.operators import policy

    kind = F.col("doc_id") % 11
    name = F.when(kind == 0, F.concat(F.lit("co"), F.col("doc_id") % 30, F.lit("/.git"))).when(kind == 1, F.concat(F.lit("co"), F.col("doc_id") % 30, F.lit("/in/"), "doc_id"))
    name = name.when(kind == 2, F.concat("source", F.lit("/key/"), "doc_id", F.lit(".pem"))).when(kind == 3, F.concat(F.lit("out/"), "doc_id")).when(kind == 4, F.concat("lang", F.lit("/"), "doc_id", F.lit(f".{settings.NAMESPACE}-theirs")))
    listed = table(spark, folder, "documents").select(name.otherwise(F.concat("lang", F.lit("/"), "source", F.lit("/"), "doc_id")).alias("path")).distinct()
    seen = files.walk(listed, policy.parse_policy(["out"], ["*.pem"]))
    parts = (("checkout", seen.checkouts, "root"), ("file", seen.files, "path"), ("refused", seen.refused, "refused"))
    return _union(df.select(F.lit(kind_).alias("kind"), F.col(c).alias("path")) for kind_, df, c in parts)


QUERIES = {
    "jn11_carried_places": _carried,
    "agg11_at_risk": _at_risk,
    "jn12_fetched_heads": _fetched,
    "srt4_machines_by_name": _by_name,
    "jn14_same_carried": _same_carried,
    "flt19_land_gate": _land,
    "agg6_working_trees": _groups,
    "agg9_tree_counts": _tree_counts,
    "agg10_fresh_share": _shares,
    "src12_json_states": _json_states,
    "snk8_refs": _refs,
    "snk11_migration": _migrated,
    "sta8_commit_heads": _committed,
    "sta5_versions": _versions,
    "sta9_collect_garbage": _collected,
    "str8_dry_run": _dry_run,
    "cnt17_merge_compute": _computed,
    "sta13_continue_merge": _continued,
    "cnt23_captured_work": _captured,
    "src1_tree_walk": _walked,
}

_DIRTY = "(SELECT 'repo/' || c_custkey AS path, c_custkey % 4 AS dirty_files, c_custkey % 7 AS head, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0) AS carried FROM customer WHERE c_custkey % 4 > 0)"
_MACHINES = "(SELECT c_custkey AS id, c_mktsegment || '-' || (c_custkey % 50) AS name, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 100 END AS head FROM customer)"
_REFUSAL = "CASE WHEN c_custkey IS NULL THEN 'no checkout' {dirty} {other} WHEN o_orderkey % 5 = 1 THEN 'the patch does not fit' ELSE '' END"
_DIRTY_CASE, _OTHER_CASE = "WHEN c_custkey % 3 > 0 THEN 'uncommitted files'", "WHEN c_custkey % 7 <> o_orderkey % 7 THEN 'another commit'"
_LAND = " UNION ALL ".join(
    f"SELECT o_orderkey AS work_id, '{how}' AS how, {_REFUSAL.format(dirty=dirty, other=other)} AS refusal FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey"
    for how, dirty, other in (("plain", _DIRTY_CASE, _OTHER_CASE), ("forced", "", _OTHER_CASE), ("three_way", _DIRTY_CASE, ""))
)
_ALL_REPORT = """(SELECT false AS refused, (SELECT count(*) FROM heads) AS live_heads, (SELECT count(*) FROM heads WHERE head NOT IN (SELECT head FROM p)) AS unretainable, (SELECT count(*) FROM live) AS live_objects,
    count(*) FILTER (young) AS young, count(*) FILTER (NOT young) AS candidates, count(*) FILTER (NOT young AND remote_id % 7 <> 2) AS moved, coalesce(sum(bytes) FILTER (NOT young), 0) AS candidate_bytes FROM swept)"""


def _report_sql(candidates: str, applied: str, stamp: str, purged: int) -> str:
    shown = [("refused", "refused"), ("live_heads", "live_heads"), ("unretainable", "unretainable"), ("live_objects", "live_objects"), ("young", "young"), ("candidates", candidates), ("candidate_bytes", "candidate_bytes"), ("applied", applied), ("stamp", stamp), ("purged_stamps", str(purged))]
    return f"rep AS {_ALL_REPORT} " + " UNION ALL ".join(f"SELECT '{n}' AS name, CAST({x} AS VARCHAR) AS value FROM rep" for n, x in shown)


def _tables_sql(counts: dict[str, str]) -> str:
    return " ".join(f"UNION ALL SELECT '{n}', CAST(count(*) AS VARCHAR) FROM {x}" for n, x in counts.items())


_STATE = histories._STATE
_PLAN_CASES = """CASE WHEN b IS NULL AND t IS NULL THEN 'KeepOurs' WHEN b IS NULL AND o IS NULL THEN 'TakeTheirs' WHEN b IS NULL AND o = t THEN 'Unchanged' WHEN b IS NULL THEN 'ContentMerge' WHEN o IS NULL AND t IS NULL THEN 'Delete'
    WHEN o IS NULL THEN CASE WHEN b = t THEN 'Delete' ELSE 'Conflict' END WHEN t IS NULL THEN CASE WHEN b = o THEN 'Delete' ELSE 'Conflict' END WHEN b = o AND b = t THEN 'Unchanged' WHEN b = t THEN 'KeepOurs' WHEN b = o THEN 'TakeTheirs' WHEN o = t THEN 'Unchanged' ELSE 'ContentMerge' END"""
_COMMITTED = f"""WITH {histories._HISTORY}, {histories._PINS}, {histories._OBJECTS}, {histories._SESSIONS},
    c AS (SELECT o_custkey AS machine_id, min(o_orderkey + CASE WHEN o_orderkey % 25 = 3 THEN 1000000000 ELSE 0 END) AS session FROM orders GROUP BY 1),
    c2 AS (SELECT machine_id, session, ((session % 1000000000) // 4) * 10 + 1 + (session % 1000000000) % 3 AS snapshot FROM c),
    d AS (SELECT c2.* FROM c2 JOIN s ON s.id = c2.session AND s.machine_id = c2.machine_id JOIN i ON i.session = c2.session AND i.object = c2.snapshot WHERE c2.session NOT IN (SELECT session FROM i WHERE object NOT IN (SELECT remote_id FROM o))),
    m AS (SELECT machine_id AS id, head FROM h WHERE superseded_utc IS NULL)"""

ORACLES = {
    "jn11_carried_places": f"SELECT path, dirty_files, CASE WHEN NOT carried THEN 'this disk only' WHEN head = 3 THEN 'on the server' ELSE 'snapshotted, not pushed' END AS place FROM {_DIRTY}",
    "agg11_at_risk": f"SELECT count(*) AS dirty, count(*) FILTER (NOT carried) AS at_risk FROM {_DIRTY}",
    "jn12_fetched_heads": f"SELECT id, name, CASE WHEN head IS NULL THEN 'no head' WHEN head IN (SELECT s_suppkey FROM supplier) THEN 'fetched' ELSE 'to fetch' END AS state FROM {_MACHINES}",
    "srt4_machines_by_name": f"SELECT id, name, row_number() OVER (ORDER BY name, id) AS position FROM {_MACHINES}",
    "jn14_same_carried": "SELECT o_custkey % 40 AS g, bool_and(o_orderkey % 991 <> 4 AND o_orderkey % 1009 <> 3 AND (o_orderkey % 997 <> 5 OR o_custkey = o_orderkey)) AS same FROM orders GROUP BY 1",
    "flt19_land_gate": _LAND,
    "agg6_working_trees": "SELECT c_nationkey AS repository, count(*) AS trees, count(*) FILTER (c_custkey % 10 = 0) AS primary_trees, coalesce(min(c_name) FILTER (c_custkey % 10 = 0), min(c_name)) AS first FROM customer GROUP BY 1",
    "agg9_tree_counts": "SELECT count(*) AS trees, count(*) FILTER (c_custkey % 10 = 0) AS primary_trees, CAST(coalesce(sum(c_nationkey) FILTER (c_acctbal > 0), 0) AS BIGINT) AS carried_files FROM customer",
    "agg10_fresh_share": """SELECT source, round(CASE WHEN every > 0 THEN coalesce(fresh / every, 0) ELSE 0 END, 6) AS share
        FROM (SELECT source, CAST(sum(n_chars) FILTER (doc_id % 3 = 0) AS DOUBLE) AS fresh, CAST(coalesce(sum(n_chars) FILTER (source <> 'src1'), 0) AS DOUBLE) AS every FROM documents GROUP BY 1)""",
    "src12_json_states": "SELECT event_id, CASE WHEN event_id % 4 > 1 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events",
    "snk8_refs": "SELECT 'HEAD' AS name, NULL AS machine_id, NULL AS machine_name, sha256('new') AS head UNION ALL SELECT 'REMOTE_HEADS', CAST(c_custkey AS VARCHAR), c_name, sha256(c_name) FROM customer WHERE c_nationkey < 20 AND c_custkey % 6 > 0",
    "snk11_migration": "SELECT s_suppkey AS id, s_name AS name, CAST(NULL AS VARCHAR) AS head, true AS fresh FROM supplier",
    "sta8_commit_heads": f"""{_COMMITTED} SELECT 'machine' AS kind, m.id AS a, coalesce(d.snapshot, m.head) AS b FROM m LEFT JOIN d ON d.machine_id = m.id
        UNION ALL SELECT CASE WHEN superseded_utc IS NULL AND (d.snapshot IS NULL OR d.snapshot = head) THEN 'open' ELSE 'closed' END, h.machine_id, head FROM h LEFT JOIN d USING (machine_id)
        UNION ALL SELECT 'open', machine_id, snapshot FROM d WHERE (machine_id, snapshot) NOT IN (SELECT (id, head) FROM m)
        UNION ALL (SELECT 'pin', head, object FROM p UNION SELECT 'pin', snapshot, object FROM d JOIN i USING (session))
        UNION ALL SELECT 'session', id, machine_id FROM s WHERE id NOT IN (SELECT session FROM d) UNION ALL SELECT 'listed', session, object FROM i WHERE session NOT IN (SELECT session FROM d)""",
    "sta5_versions": """WITH m AS (SELECT event_type, user_id AS machine_id, max(event_id) AS head, dense_rank() OVER (ORDER BY event_type) AS k FROM events GROUP BY 1, 2), v AS (SELECT DISTINCT k FROM m)
        SELECT v.k AS version, machine_id, arg_max(head, m.k) AS head FROM v JOIN m ON m.k <= v.k GROUP BY 1, 2""",
    "sta9_collect_garbage": f"{_STATE}, {_report_sql('moved', 'true', chr(39) + '20240131T000000Z-2' + chr(39), 1)} " + _tables_sql({
        "machines": "g WHERE superseded_utc IS NULL", "history": "g WHERE superseded_utc IS NULL OR superseded_utc >= TIMESTAMP '2024-01-17'", "pins": "p WHERE head IN (SELECT head FROM heads)",
        "sessions": "s WHERE created_utc >= TIMESTAMP '2024-01-30'", "session_ids": "i JOIN s ON s.id = i.session WHERE created_utc >= TIMESTAMP '2024-01-30'",
        "objects": "o WHERE remote_id NOT IN (SELECT remote_id FROM swept WHERE NOT young AND remote_id % 7 <> 2)", "trash": "(SELECT remote_id FROM swept WHERE NOT young AND remote_id % 7 <> 2 UNION ALL VALUES (-8), (-9), (-10))",
    }),
    "str8_dry_run": f"{_STATE}, {_report_sql('candidates', 'false', 'NULL', 0)} " + _tables_sql({"machines": "g WHERE superseded_utc IS NULL", "history": "g", "pins": "p", "sessions": "s", "session_ids": "i", "objects": "o", "trash": "(VALUES (7), (8), (9), (10))"}),
    "cnt17_merge_compute": f"""WITH b AS {versions.entries_sql("base")}, o AS {versions.entries_sql("ours")}, t AS {versions.entries_sql("theirs")},
        j AS (SELECT path, max(b) AS b, max(o) AS o, max(t) AS t FROM (SELECT path, chunks[1] AS b, NULL AS o, NULL AS t FROM b UNION ALL SELECT path, NULL, chunks[1], NULL FROM o UNION ALL SELECT path, NULL, NULL, chunks[1] FROM t) GROUP BY path)
        SELECT 'apart' AS which, path, {_PLAN_CASES} AS action FROM j UNION ALL SELECT 'apart', n_name, 'DifferentHead' FROM nation WHERE n_nationkey % 3 > 0 UNION ALL SELECT 'apart', 'base 0', 'merge'
        UNION ALL SELECT 'behind', path, CASE WHEN t IS NULL THEN 'Delete' ELSE 'TakeTheirs' END FROM j WHERE o IS DISTINCT FROM t UNION ALL SELECT 'behind', 'base 1', 'fast forward' UNION ALL SELECT 'ahead', 'base 1', 'fast forward'
        UNION ALL SELECT 'unrelated', path, {_PLAN_CASES} FROM (SELECT path, NULL AS b, o, t FROM j WHERE o IS NOT NULL OR t IS NOT NULL) UNION ALL SELECT 'unrelated', 'base None', 'merge'""",
    "sta13_continue_merge": """SELECT 'unresolved' AS what, source || '/' || doc_id AS path FROM documents WHERE doc_id % 8 = 0 UNION ALL SELECT 'after', source || '/' || doc_id FROM documents UNION ALL SELECT 'parents', 'a,b' UNION ALL SELECT 'done', 'False True'
        UNION ALL SELECT 'waiting', CAST(count(*) + count(*) FILTER (doc_id % 8 = 0) + count(*) FILTER (doc_id % 4 = 0) AS VARCHAR) FROM documents UNION ALL SELECT 'aborted', CAST(count(*) AS VARCHAR) FROM documents""",
    "cnt23_captured_work": """SELECT 'repo ' || doc_id AS path, sha256(CAST(doc_id AS VARCHAR)) AS base_commit, CASE WHEN doc_id % 3 > 0 THEN lang ELSE '' END AS branch, CAST(strlen(text) AS BIGINT) AS patch_bytes, CAST(doc_id % 5 AS INTEGER) AS changed_files, sha256(text) AS sha256
        FROM documents WHERE doc_id % 6 > 0 AND strlen(text) > 0""",
    "src1_tree_walk": """WITH l AS (SELECT DISTINCT CASE doc_id % 11 WHEN 0 THEN 'co' || (doc_id % 30) || '/.git' WHEN 1 THEN 'co' || (doc_id % 30) || '/in/' || doc_id WHEN 2 THEN source || '/key/' || doc_id || '.pem' WHEN 3 THEN 'out/' || doc_id
            WHEN 4 THEN lang || '/' || doc_id || '.strandkeep-theirs' ELSE lang || '/' || source || '/' || doc_id END AS path FROM documents), r AS (SELECT split_part(path, '/', 1) AS root FROM l WHERE path LIKE '%/.git')
        SELECT 'checkout' AS kind, root AS path FROM r UNION ALL SELECT 'refused', path FROM l WHERE path LIKE '%.pem'
        UNION ALL SELECT 'file', path FROM l WHERE path NOT LIKE '%.pem' AND path NOT LIKE 'out/%' AND path NOT LIKE '%-theirs' AND split_part(path, '/', 1) NOT IN (SELECT root FROM r)""",
}
