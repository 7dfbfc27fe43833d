"""Queries over manifests: what changed, what is new, and how three versions merge."""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandkeep.functions import scalars, structural
from strandkeep.operators import manifest, merge, store
from strandkeep.sources import versions
from strandkeep.sources.tables import table


def _sides(spark, folder, *names):
    return [versions.entries(spark, folder, n) for n in names]


def _sql(name):
    return versions.entries_sql(name)


_THREE_SQL = f"""(SELECT coalesce(b.path, o.path, t.path) AS path, b.path IS NOT NULL AS hb, o.path IS NOT NULL AS ho, t.path IS NOT NULL AS ht,
    b.chunks = o.chunks AS bo, b.chunks = t.chunks AS bt, o.chunks = t.chunks AS ot
    FROM {_sql("base")} b FULL JOIN {_sql("ours")} o ON b.path = o.path FULL JOIN {_sql("theirs")} t ON t.path = coalesce(b.path, o.path))"""
_DECIDED_SQL = f"""(SELECT path, CASE WHEN NOT hb AND NOT ht THEN 'KeepOurs' WHEN NOT hb AND NOT ho THEN 'TakeTheirs'
    WHEN NOT hb AND ot THEN 'Unchanged' WHEN NOT hb THEN 'ContentMerge' WHEN NOT ho AND NOT ht THEN 'Delete'
    WHEN NOT ho AND bt THEN 'Delete' WHEN NOT ho THEN 'Conflict' WHEN NOT ht AND bo THEN 'Delete' WHEN NOT ht THEN 'Conflict'
    WHEN bo AND bt THEN 'Unchanged' WHEN bt THEN 'KeepOurs' WHEN bo THEN 'TakeTheirs' WHEN ot THEN 'Unchanged' ELSE 'ContentMerge' END AS action
    FROM {_THREE_SQL})"""


def _diff(spark, folder):
    return manifest.diff(*_sides(spark, folder, "base", "ours"))


def _new_chunks(spark, folder):
    return manifest.new_chunks(*_sides(spark, folder, "base", "ours"))


def _three_way(spark, folder):
    both = merge.three_way(*_sides(spark, folder, *merge.SIDES))
    return both.select("path", *(F.col(s).isNotNull().alias(f"in_{s}") for s in merge.SIDES))


def _divergence(spark, folder):
    c = table(spark, folder, "customer").select(F.concat(F.lit("repo/"), "c_custkey").alias("path"), F.col("c_nationkey").cast("string").alias("branch"), F.round("c_acctbal").cast("long").cast("string").alias("head"))
    s = table(spark, folder, "supplier").select(F.concat(F.lit("repo/"), F.col("s_suppkey") + 50).alias("path"), F.col("s_nationkey").cast("string").alias("branch"), F.round("s_acctbal").cast("long").cast("string").alias("head"))
    return merge.divergence(c, s)


def _fast_forward(spark, folder):
    return merge.fast_forward(*_sides(spark, folder, "ours", "theirs"))


def _plan(spark, folder):
    return merge.plan(*_sides(spark, folder, *merge.SIDES))


def _plan_counts(spark, folder):
    return _plan(spark, folder).groupBy("action").agg(F.count("*").alias("n"))


def _reach(spark, folder):
    snapshots = table(spark, folder, "customer").select(F.concat(F.lit("s"), "c_nationkey").alias("snapshot_id"), F.array(F.concat(F.lit("m"), F.col("c_custkey") % 7)).alias("manifest_chunks"))
    files = table(spark, folder, "documents").select(F.concat(F.lit("s"), F.col("doc_id") % 25).alias("snapshot_id"), F.array(F.sha2("text", 256)).alias("chunks"))
    work = table(spark, folder, "supplier").select(F.concat(F.lit("s"), "s_nationkey").alias("snapshot_id"), F.array(F.concat(F.lit("p"), F.col("s_suppkey") % 11)).alias("patch_chunks"))
    return manifest.reachable(snapshots, files, work)


def _totals(spark, folder):
    return manifest.totals(versions.entries(spark, folder, "ours"))


def _diff_counts(spark, folder):
    return manifest.diff_counts(_diff(spark, folder))


def _collisions(spark, folder):
    docs = table(spark, folder, "documents")
    path = F.when(F.col("doc_id") % 4 == 0, F.upper(F.concat(F.lit("d/"), F.col("doc_id") % 301))).otherwise(F.concat(F.lit("d/"), F.col("doc_id") % 301))
    items = docs.select(path.alias("path"), F.when(F.col("doc_id") % 6 == 5, "Delete").otherwise("KeepOurs").alias("action"))
    return merge.case_collisions(items)


def _top_directories(spark, folder):
    docs = table(spark, folder, "documents").select(F.when(F.col("doc_id") % 9 == 0, F.concat("doc_id", F.lit(".md"))).otherwise(F.concat_ws("/", "source", "doc_id")).alias("path"))
    return docs.groupBy(scalars.top_directory("path").alias("directory")).agg(F.count("*").alias("files"))


@F.pandas_udf(T.BinaryType())
def _merged_text(base: pd.Series, ours: pd.Series, theirs: pd.Series) -> pd.Series:
    return pd.Series([structural.merge_text(*(bytes(x or b"") for x in sides)).content for sides in zip(base, ours, theirs, strict=True)])


def _append_union(spark, folder):
    sides = [versions.version(spark, folder, n).withColumnRenamed("text", n) for n in merge.SIDES]
    both = sides[0].join(sides[1], "path").join(sides[2], "path").where("ours <> theirs")
    grown = F.startswith("ours", F.concat("base", F.lit("\n"))) & F.startswith("theirs", F.concat("base", F.lit("\n")))
    merged = _merged_text(*(F.encode(x, "utf-8") for x in merge.SIDES))
    return both.where(grown & (F.length("base") > 0)).select("path", F.sha2(merged, 256).alias("merged_sha256"))


def _content_merge(spark, folder):
    paths = _plan(spark, folder).where("action = 'ContentMerge'").select("path")
    sides = [versions.version(spark, folder, n).withColumn(n, F.col("text").cast("binary")).drop("text") for n in merge.SIDES]
    files = paths.join(sides[0], "path", "left").join(sides[1], "path", "left").join(sides[2], "path", "left")
    out = merge.merge_contents(files)
    return out.select("path", "outcome.status", "outcome.note", F.sha2("outcome.content", 256).alias("content_sha256"), F.size("outcome.regions").alias("n_regions"))


def _applied(spark, folder):
    decided = _plan(spark, folder)
    sides = [versions.version(spark, folder, n).withColumn(n, F.col("text").cast("binary")).drop("text") for n in merge.SIDES]
    merging = decided.where("action = 'ContentMerge'").join(sides[0], "path", "left").join(sides[1], "path", "left").join(sides[2], "path", "left")
    merging = merge.merge_contents(merging).select("path", "action", "outcome", "theirs", "base")
    rest = decided.where("action <> 'ContentMerge'").join(sides[2], "path", "left").join(sides[0], "path", "left").withColumn("outcome", F.lit(None).cast(merging.schema["outcome"].dataType))
    tables = merge.apply_plan(merging.unionByName(rest.select("path", "action", "outcome", "theirs", "base")))
    out = None
    for name, df in tables.items():
        part = df.groupBy(F.lit(name).alias("written")).agg(F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


def _emptied(spark, folder):
    before = versions.entries(spark, folder, "base").select(F.regexp_replace("path", r"docs/(src\d+)/(\w+)/(\d)(\d*)", "$1/$2/$3/$4").alias("path"))
    gone = before.where(F.length("path") < 19)
    return merge.emptied_directories(before, gone)


def _parents(spark, folder):
    docs = table(spark, folder, "documents")
    head = F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit("h"), F.col("doc_id") % 3))
    others = F.transform(F.sequence(F.lit(0), (F.col("doc_id") % 4).cast("int")), lambda k: F.concat(F.lit("h"), (k * 2 % 3).cast("string")))
    return docs.select("doc_id", F.array_join(store.parents_of(head, others), ",").alias("parents"))


QUERIES = {
    "jn1_manifest_diff": _diff,
    "jn2_new_chunks": _new_chunks,
    "jn3_three_way_join": _three_way,
    "jn4_repo_divergence": _divergence,
    "jn5_fast_forward": _fast_forward,
    "cnt16_merge_plan": _plan,
    "cnt17_merge_plan_counts": _plan_counts,
    "set1_reachability": _reach,
    "set7_parent_list": _parents,
    "agg1_totals": _totals,
    "agg4_diff_counts": _diff_counts,
    "agg5_case_collisions": _collisions,
    "agg7_top_directories": _top_directories,
    "cnt8_append_union": _append_union,
    "cnt12_content_merge": _content_merge,
    "cnt18_apply": _applied,
    "snk7_emptied_directories": _emptied,
}

_CHANGE_SQL = f"""SELECT coalesce(b.path, a.path) AS path,
    CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM {_sql("base")} b FULL JOIN {_sql("ours")} a ON a.path = b.path
    WHERE b.path IS NULL OR a.path IS NULL OR a.executable <> b.executable OR a.chunks <> b.chunks"""
#: Merges of contents: ours in front and theirs behind merge, both behind are both kept, all others meet at one place.
_MERGED = f"""(SELECT path, CASE WHEN content IS NULL THEN 'conflict' ELSE 'merged' END AS status, CASE WHEN appended THEN '{structural.APPENDED}' END AS note, sha256(content) AS content_sha256, CASE WHEN content IS NULL THEN 1 ELSE 0 END AS n_regions
    FROM (SELECT path, coalesce(b, '') <> '' AND o = b || chr(10) || 'ours' AND t = b || chr(10) || 'theirs' AS appended,
        CASE WHEN coalesce(b, '') = '' THEN NULL WHEN o = 'ours' || chr(10) || b AND t = b || chr(10) || 'theirs' THEN o || chr(10) || 'theirs' WHEN appended THEN o || chr(10) || 'theirs' END AS content
        FROM (SELECT path, b.text AS b, o.text AS o, t.text AS t FROM {_DECIDED_SQL} LEFT JOIN {versions.version_sql("base")} b USING (path) LEFT JOIN {versions.version_sql("ours")} o USING (path) LEFT JOIN {versions.version_sql("theirs")} t USING (path) WHERE action = 'ContentMerge')))"""
_EMPTY_BEFORE = f"(SELECT regexp_replace(path, 'docs/(src\\d+)/(\\w+)/(\\d)(\\d*)', '\\1/\\2/\\3/\\4') AS path FROM {_sql('base')})"


def _above(where: str) -> str:
    return f"(SELECT DISTINCT array_to_string(p[1:d], '/') AS directory FROM (SELECT p, unnest(range(1, len(p))) AS d FROM (SELECT string_split(path, '/') AS p FROM {_EMPTY_BEFORE} WHERE {where})))"


ORACLES = {
    "jn1_manifest_diff": _CHANGE_SQL,
    "jn2_new_chunks": f"SELECT DISTINCT unnest(chunks) AS chunk_id FROM {_sql('ours')} EXCEPT SELECT unnest(chunks) FROM {_sql('base')}",
    "jn3_three_way_join": f"SELECT path, hb AS in_base, ho AS in_ours, ht AS in_theirs FROM {_THREE_SQL}",
    "jn4_repo_divergence": """SELECT * FROM (SELECT t.path, CASE WHEN o.path IS NULL THEN 'MissingHere' WHEN o.branch <> t.branch THEN 'DifferentBranch' WHEN o.head <> t.head THEN 'DifferentHead' END AS kind
        FROM (SELECT 'repo/' || (s_suppkey + 50) AS path, s_nationkey AS branch, CAST(round(s_acctbal) AS BIGINT) AS head FROM supplier) t
        LEFT JOIN (SELECT 'repo/' || c_custkey AS path, c_nationkey AS branch, CAST(round(c_acctbal) AS BIGINT) AS head FROM customer) o USING (path)) WHERE kind IS NOT NULL""",
    "jn5_fast_forward": f"""SELECT coalesce(o.path, t.path) AS path, CASE WHEN t.path IS NULL THEN 'Delete' ELSE 'TakeTheirs' END AS action
        FROM {_sql("ours")} o FULL JOIN {_sql("theirs")} t ON o.path = t.path WHERE o.path IS NULL OR t.path IS NULL OR o.chunks <> t.chunks""",
    "cnt16_merge_plan": f"SELECT path, action FROM {_DECIDED_SQL}",
    "cnt17_merge_plan_counts": f"SELECT action, count(*) AS n FROM {_DECIDED_SQL} GROUP BY action",
    "set1_reachability": """SELECT snapshot_id, snapshot_id AS object FROM (SELECT 's' || c_nationkey AS snapshot_id FROM customer)
        UNION SELECT 's' || c_nationkey, 'm' || (c_custkey % 7) FROM customer UNION SELECT 's' || (doc_id % 25), sha256(text) FROM documents
        UNION SELECT 's' || s_nationkey, 'p' || (s_suppkey % 11) FROM supplier""",
    "set7_parent_list": """SELECT doc_id, array_to_string(list_filter(x, lambda v, i: list_position(x, v) = i), ',') AS parents FROM (SELECT doc_id,
        CASE WHEN doc_id % 5 > 0 THEN ['h' || (doc_id % 3)] ELSE [] END || list_transform(range(0, doc_id % 4 + 1), lambda k: 'h' || (k * 2 % 3)) AS x FROM documents)""",
    "agg1_totals": f"SELECT count(*) AS file_count, CAST(sum(size) AS BIGINT) AS total_bytes FROM {_sql('ours')}",
    "agg4_diff_counts": f"SELECT count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'changed') AS changed, count(*) FILTER (change = 'removed') AS removed, count(*) = 0 AS is_empty FROM ({_CHANGE_SQL})",
    "agg5_case_collisions": """WITH p AS (SELECT DISTINCT CASE WHEN doc_id % 4 = 0 THEN upper('d/' || (doc_id % 301)) ELSE 'd/' || (doc_id % 301) END AS path FROM documents WHERE doc_id % 6 <> 5)
        SELECT path FROM p WHERE lower(path) IN (SELECT lower(path) FROM p GROUP BY 1 HAVING count(*) > 1)""",
    "agg7_top_directories": """SELECT directory, count(*) AS files FROM (SELECT CASE WHEN doc_id % 9 = 0 THEN '(root)' ELSE source END AS directory FROM documents) GROUP BY 1""",
    "cnt8_append_union": f"""SELECT path, sha256(base || chr(10) || CASE WHEN ot <= tt THEN ot || chr(10) || tt ELSE tt || chr(10) || ot END) AS merged_sha256 FROM (
        SELECT b.path, b.text AS base, substr(o.text, length(b.text) + 2) AS ot, substr(t.text, length(b.text) + 2) AS tt
        FROM {versions.version_sql("base")} b JOIN {versions.version_sql("ours")} o USING (path) JOIN {versions.version_sql("theirs")} t USING (path)
        WHERE o.text <> t.text AND b.text <> '' AND starts_with(o.text, b.text || chr(10)) AND starts_with(t.text, b.text || chr(10)))""",
    "cnt12_content_merge": f"SELECT path, status, note, content_sha256, n_regions FROM {_MERGED}",
    "cnt18_apply": f"""SELECT written, count(*) AS n FROM (
        SELECT unnest(CASE WHEN status = 'merged' OR action = 'TakeTheirs' THEN ['writes'] WHEN action = 'Delete' THEN ['deletes'] WHEN status = 'conflict' OR action = 'Conflict'
            THEN ['state'] || CASE WHEN ht THEN ['companions'] ELSE [] END || CASE WHEN hb THEN ['companions'] ELSE [] END ELSE [] END) AS written
        FROM {_DECIDED_SQL} JOIN (SELECT path, hb, ht FROM {_THREE_SQL}) USING (path) LEFT JOIN {_MERGED} USING (path)) GROUP BY written""",
    "snk7_emptied_directories": f"SELECT directory FROM {_above('length(path) < 19')} EXCEPT SELECT directory FROM {_above('length(path) >= 19')}",
}
