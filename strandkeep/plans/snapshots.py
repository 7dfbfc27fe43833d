"""Queries that record and exchange whole snapshots."""

from pyspark.sql import functions as F

from strandkeep.operators import policy, secrets, snapshots
from strandkeep.sources import files, versions
from strandkeep.sources.tables import table

KEY = bytes(range(32))
_RULES = policy.parse_policy(["*.tmp"], ["*.pem"])


def _files(spark, folder, name):
    return versions.version(spark, folder, name).select("path", F.encode("text", "utf-8").alias("content"), F.expr("timestamp'2024-01-01'").alias("modified_utc"), F.lit(False).alias("executable"))


def _taken(spark, folder):
    none = spark.createDataFrame([], "chunk_id string")
    return snapshots.create(_files(spark, folder, "base"), none, _RULES, None, ("m1", "desk"), F.expr("timestamp'2024-01-02'"))


def _created(spark, folder):
    first = _taken(spark, folder)
    second = snapshots.create(_files(spark, folder, "ours"), first.objects, _RULES, first.entries, ("m1", "desk"), F.expr("timestamp'2024-01-03'"))
    counts = second.changes.groupBy("change").agg(F.count("*").alias("n"))
    found = second.findings.agg(F.lit("findings").alias("change"), F.count("*").alias("n"))
    return counts.unionByName(found).unionByName(second.entries.agg(F.lit("files").alias("change"), F.count("*").alias("n")))


def _unchanged(spark, folder):
    first = _taken(spark, folder)
    again = snapshots.create(_files(spark, folder, "base"), first.objects, _RULES, first.entries, ("m1", "desk"), F.expr("timestamp'2024-01-03'"))
    return spark.createDataFrame([(snapshots.is_unchanged(again), snapshots.is_unchanged(again, merging=True))], "unchanged boolean, merging boolean")


def _exchange(spark, folder):
    chunks = table(spark, folder, "documents").select(F.sha2("text", 256).alias("chunk_id"), F.encode("text", "utf-8").alias("content")).dropDuplicates(["chunk_id"])
    none = spark.createDataFrame([], "remote_id string, blob binary")
    pushed = snapshots.to_push(chunks, chunks, none, KEY)
    here = chunks.where("chunk_id < '4'")
    got = snapshots.pulled(chunks, here, pushed, KEY)
    return got.select("chunk_id", F.octet_length("content").cast("long").alias("bytes"), (F.sha2("content", 256) == F.col("chunk_id")).alias("right"))


def _pushed_again(spark, folder):
    chunks = table(spark, folder, "documents").select(F.sha2("text", 256).alias("chunk_id"), F.encode("text", "utf-8").alias("content"), "lang").dropDuplicates(["chunk_id"])
    none = spark.createDataFrame([], "remote_id string, blob binary")
    first = snapshots.to_push(chunks.where("substring(chunk_id, 1, 1) < '8'"), chunks, none, KEY)
    return snapshots.to_push(chunks, chunks, first, KEY).agg(F.count("*").alias("blobs"), F.sum(F.octet_length("blob")).alias("bytes"))


def _porcelain(spark, folder):
    line = F.when(F.col("c_custkey") % 3 == 0, "(detached)").otherwise(F.concat(F.lit("b"), "c_nationkey"))
    dirty = F.array_join(F.transform(F.sequence(F.lit(1), (F.col("c_custkey") % 4).cast("int") + 1), lambda k: F.concat(F.lit("\n1 .M N... file"), k.cast("string"))), "")
    text = F.concat(F.lit("# branch.oid "), F.when(F.col("c_custkey") % 5 == 0, "(initial)").otherwise(F.sha2("c_name", 256)), F.lit("\n# branch.head "), line, dirty, F.lit("\n! ignored\n"))
    return files.porcelain_states(table(spark, folder, "customer").select(F.col("c_name").alias("path"), text.alias("text")))


def _repositories(spark, folder):
    trees = table(spark, folder, "customer").select(F.col("c_nationkey").alias("common_dir"), F.col("c_name").alias("path"), (F.col("c_custkey") % 10 == 0).alias("is_primary"))
    return files.repositories(trees).select("common_dir", F.array_join("trees", ",").alias("trees"))


QUERIES = {
    "cnt22_snapshot_create": _created,
    "cnt21_no_change": _unchanged,
    "sta11_push_pull": _exchange,
    "sta10_push_again": _pushed_again,
    "src14_checkout_states": _porcelain,
    "src15_repositories": _repositories,
}

_BASE, _OURS = versions.entries_sql("base"), versions.entries_sql("ours")
_CLEAN = " AND ".join(f"NOT regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}')" for p in secrets.KINDS.values())  # what the first snapshot could store
_FRESH = f"(SELECT path, text FROM {versions.version_sql('ours')} WHERE text NOT IN (SELECT text FROM {versions.version_sql('base')} WHERE {_CLEAN}))"
_LINES = f"(SELECT unnest(string_split(text, chr(10))) AS x FROM {_FRESH})"
_HITS = " + ".join(f"count(*) FILTER (regexp_matches(x, '{p.replace(chr(39), chr(39) * 2)}'))" for p in secrets.KINDS.values())

ORACLES = {
    "cnt21_no_change": "SELECT true AS unchanged, false AS merging",
    "sta11_push_pull": "SELECT DISTINCT sha256(text) AS chunk_id, CAST(strlen(text) AS BIGINT) AS bytes, true AS right FROM documents WHERE sha256(text) >= '4'",
    "sta10_push_again": "SELECT count(*) AS blobs, CAST(sum(n + 29) AS BIGINT) AS bytes FROM (SELECT DISTINCT text, strlen(text) AS n FROM documents WHERE sha256(text) >= '8')",
    "src14_checkout_states": """SELECT c_name AS path, CASE WHEN c_custkey % 3 > 0 THEN 'b' || c_nationkey END AS branch, CASE WHEN c_custkey % 5 > 0 THEN sha256(c_name) END AS head, CAST(c_custkey % 4 + 1 AS INTEGER) AS dirty_files FROM customer""",
    "src15_repositories": "SELECT c_nationkey AS common_dir, string_agg(c_name, ',' ORDER BY c_custkey % 10 > 0, c_name) AS trees FROM customer GROUP BY 1",
    "cnt22_snapshot_create": f"""SELECT CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed' ELSE 'changed' END AS change, count(*) AS n FROM {_BASE} b FULL JOIN {_OURS} a ON a.path = b.path
        WHERE b.path IS NULL OR a.path IS NULL OR a.chunks <> b.chunks GROUP BY 1 UNION ALL SELECT 'findings', {_HITS} FROM {_LINES} UNION ALL SELECT 'files', count(*) FROM {_OURS}""",
}
