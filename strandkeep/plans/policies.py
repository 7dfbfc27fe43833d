"""Queries over path rules, URL verdicts and gates."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandkeep.functions import scalars
from strandkeep.operators import policy, workspace
from strandkeep.sources.tables import table

#: A path corpus with every class of rule in it, from documents; the same expression in both engines.
_PATH = """concat(CASE doc_id % 12 WHEN 0 THEN 'node_modules/' WHEN 1 THEN 'app/dist/' WHEN 2 THEN '.aws/' WHEN 3 THEN 'keys/' WHEN 4 THEN 'Library/x/' ELSE '' END,
    source, '/', lang, '/', doc_id, CASE doc_id % 10 WHEN 0 THEN '.pem' WHEN 1 THEN '.env' WHEN 2 THEN '.tmp' WHEN 3 THEN '.log' WHEN 4 THEN '~' ELSE '.md' END)"""
_IGNORE = ["node_modules", "dist", "Library/", "*.tmp", "*~", "*.log", "!src3/**/*.log", "src1?/de"]
_NEVER = ["*.pem", "*.env", "=20.pem", "keys/src1"]
#: Globs over the paths and the directories above them, with the same rule in SQL: p are a path's components, x the last one.
GLOBS = {
    "*.pem": "x LIKE '%.pem'",
    "1?.md": "x LIKE '1_.md'",
    "/app": "path = 'app'",
    "src1": "x = 'src1'",
    "Library/": "x = 'Library' AND dir",
    "keys/src1": "path = 'keys/src1'",
    "**/de": "x = 'de'",
    "app/**/en": "len(p) >= 2 AND p[1] = 'app' AND x = 'en'",
    "app/**/*.log": "len(p) >= 2 AND p[1] = 'app' AND x LIKE '%.log'",
    "app/**": "path = 'app'",
    "[a-k]*": "x >= 'a' AND x < 'l'",
    "*[!0-9d]": "NOT contains('0123456789d', right(x, 1))",
    "src?/*/[1-4]*.tmp": "len(p) = 3 AND p[1] LIKE 'src_' AND contains('1234', left(p[3], 1)) AND p[3] LIKE '%.tmp'",
    "[1-9][0-9].*": "length(x) > 2 AND left(x, 1) BETWEEN '1' AND '9' AND substr(x, 2, 1) BETWEEN '0' AND '9' AND substr(x, 3, 1) = '.'",
    "src[1": "x = 'src[1'",
}
_POLICY = policy.parse_policy(_IGNORE, _NEVER)


def _paths(spark, folder):
    return table(spark, folder, "documents").select(F.expr(_PATH).alias("path"))


def _globs(spark, folder):
    """Which globs match which paths and directories: one scan, all globs side by side."""
    parts = F.split("path", "/")
    at = F.explode(F.sequence(F.lit(1), F.size(parts))).alias("d")
    every = _paths(spark, folder).distinct().select("path", at).select(F.array_join(F.slice(parts, F.lit(1), F.col("d")), "/").alias("path"), (F.col("d") < F.size(parts)).alias("dir")).distinct()
    hits = [F.when(policy.matches(policy.compile_glob(p), F.col("path"), F.col("dir")), F.lit(p)) for p in GLOBS]
    return every.select("path", F.explode(F.array_compact(F.array(*hits))).alias("pattern"))


def _verdicts(spark, folder):
    return _paths(spark, folder).select("path", policy.verdict(_POLICY, "path", False).alias("verdict"))


def _kept(spark, folder):
    return policy.kept(_paths(spark, folder), _POLICY)


def _refused(spark, folder):
    return policy.refused(_paths(spark, folder), _POLICY)


def _urls(spark, folder):
    url = F.when(F.col("page_id") % 7 == 0, F.regexp_replace("url", "^https?://", "")).when(F.col("page_id") % 7 == 1, F.regexp_replace("url", "^https?://", "ftp://")).when(F.col("page_id") % 7 == 2, F.regexp_replace("url", "://", "://me:pw@")).otherwise(F.col("url"))
    pages = table(spark, folder, "pages").select("page_id", url.alias("u"))
    return pages.select("page_id", scalars.url_verdict("u").alias("verdict"), scalars.url_normal("u").alias("normal"), scalars.saved_url_warning("u").alias("warns"))


def _ids(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.sha2("text", 256)).when(F.col("doc_id") % 3 == 1, F.upper(F.sha2("text", 256))).otherwise(F.substring(F.sha2("text", 256), 1, 60)).alias("x"))
    return docs.select("doc_id", scalars.is_id("x").alias("valid"), scalars.shard_of(F.lower("x")).alias("shard"))


def _version_text():
    return F.concat(F.when(F.col("p_partkey") % 3 == 0, "v").otherwise(""), F.col("p_size") % 4, F.lit("."), F.col("p_partkey") % 10, F.when(F.col("p_partkey") % 5 == 0, "+build").when(F.col("p_partkey") % 5 == 1, "-rc1").when(F.col("p_partkey") % 11 == 7, "x").otherwise(""))


def _versions(spark, folder):
    parts = table(spark, folder, "part").withColumn("v", _version_text())
    return parts.select("p_partkey", scalars.update_verdict("v", F.lit("v2.5")).alias("verdict"), scalars.write_allowed("v", "1.3").alias("may_write"))


def _relative(spark, folder):
    docs = table(spark, folder, "documents")
    path = F.concat(F.when(F.col("doc_id") % 3 == 0, "/work/a/").when(F.col("doc_id") % 3 == 1, "/work/ab/").otherwise("/tmp/"), F.col("doc_id").cast("string"))
    climb = F.concat(F.when(F.col("doc_id") % 4 == 0, "../").when(F.col("doc_id") % 4 == 1, "sub/../").when(F.col("doc_id") % 4 == 2, "sub/../../").otherwise("/"), F.lit("x"))
    return docs.select("doc_id", scalars.relative_path(path, "/work/a").alias("relative"), scalars.is_temporary(path).alias("temporary"), scalars.is_safe_path(climb).alias("safe"))


def _dirty(spark, folder):
    """Every dirty checkout with its place, most files first."""
    rows = workspace.dirty(table(spark, folder, "customer").select(F.col("c_custkey").alias("path"), (F.col("c_custkey") % 13).alias("dirty_files")))
    place = F.row_number().over(Window.orderBy(F.desc("dirty_files"), "path"))
    return rows.select(F.col("path").alias("c_custkey"), "dirty_files", place.cast("long").alias("place"))


def _structural(spark, folder):
    from strandkeep import settings

    path = F.concat(F.when(F.col("doc_id") % 8 == 0, f".{settings.NAMESPACE}/").when(F.col("doc_id") % 8 == 1, f"a.{settings.NAMESPACE}-tmp/").otherwise(""), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 8 == 2, f".{settings.NAMESPACE}-theirs").otherwise(""))
    return table(spark, folder, "documents").select(path.alias("path")).where(~scalars.is_companion("path"))


def _checkouts(spark, folder):
    docs = table(spark, folder, "documents")
    path = F.when(F.col("doc_id") % 25 == 0, F.concat("source", F.lit("/repo/.git/config"))).when(F.col("doc_id") % 5 == 1, F.concat("source", F.lit("/repo/deep/"), "doc_id")).otherwise(F.concat("source", F.lit("/"), "doc_id"))
    return policy.outside_checkouts(docs.select(path.alias("path")))


QUERIES = {
    "flt2_globs": _globs,
    "flt4_verdicts": _verdicts,
    "flt6_kept_paths": _kept,
    "flt7_refused": _refused,
    "flt14_url_verdicts": _urls,
    "flt16_ids": _ids,
    "flt17_versions": _versions,
    "flt13_relative_paths": _relative,
    "flt18_dirty_top": _dirty,
    "src3_structural_skips": _structural,
    "src2_repo_boundary": _checkouts,
}


def _verdict_sql(path: str, is_dir: str) -> str:
    """The rules above by hand: later ignore rules first."""
    x = f"regexp_extract({path}, '[^/]*$')"
    return f"""CASE WHEN {x} <> '20.pem' AND ({x} LIKE '%.pem' OR {x} LIKE '%.env' OR {path} = 'keys/src1') THEN 'Never'
        WHEN {path} LIKE 'src1_/de' THEN 'Ignored' WHEN starts_with({path}, 'src3/') AND {x} LIKE '%.log' THEN 'Include' WHEN {x} LIKE '%.log' OR {x} LIKE '%~' OR {x} LIKE '%.tmp' THEN 'Ignored'
        WHEN {x} = 'Library' AND {is_dir} THEN 'Ignored' WHEN {x} IN ('dist', 'node_modules') THEN 'Ignored' ELSE 'Include' END"""


_PATHS_SQL = f"(SELECT {_PATH} AS path FROM documents)"
_ANCESTORS_SQL = f"(SELECT path, p, d, array_to_string(p[1:d], '/') AS part, d < len(p) AS dir FROM (SELECT path, p, unnest(range(1, len(p) + 1)) AS d FROM (SELECT DISTINCT path, string_split(path, '/') AS p FROM {_PATHS_SQL})))"
_JUDGED_SQL = f"(SELECT *, {_verdict_sql('part', 'dir')} AS v FROM {_ANCESTORS_SQL})"
_URL_SQL = "(SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'https://' || regexp_replace(url, '^https?://', '') WHEN page_id % 7 = 1 THEN regexp_replace(url, '^https?://', 'ftp://') WHEN page_id % 7 = 2 THEN regexp_replace(url, '://', '://me:pw@') ELSE url END AS u FROM pages)"
_V = "(SELECT p_partkey, (p_size % 4) AS major, (p_partkey % 10) AS minor, p_partkey % 5 > 1 AND p_partkey % 11 = 7 AS bad FROM part)"

ORACLES = {
    "flt2_globs": f"WITH a AS (SELECT DISTINCT part AS path, dir, p[1:d] AS p, p[d] AS x FROM {_ANCESTORS_SQL}) " + " UNION ALL ".join(f"SELECT path, '{g}' AS pattern FROM a WHERE {rule}" for g, rule in GLOBS.items()),
    "flt4_verdicts": f"SELECT path, {_verdict_sql('path', 'false')} AS verdict FROM {_PATHS_SQL}",
    "flt6_kept_paths": f"SELECT path FROM {_PATHS_SQL} WHERE path NOT IN (SELECT path FROM {_JUDGED_SQL} WHERE v <> 'Include')",
    "flt7_refused": f"SELECT DISTINCT part || CASE WHEN dir THEN '/' ELSE '' END AS refused FROM {_JUDGED_SQL} j WHERE v = 'Never' AND d = (SELECT min(d) FROM {_JUDGED_SQL} k WHERE k.path = j.path AND v <> 'Include')",
    "flt14_url_verdicts": f"""SELECT page_id, CASE WHEN NOT starts_with(u, 'http') THEN 'scheme' WHEN contains(split_part(u, '/', 3), '@') THEN 'credentials' WHEN starts_with(u, 'https') THEN 'ok' ELSE 'insecure' END AS verdict,
        regexp_replace(regexp_extract(u, '^([^?#]*)', 1), '/+$', '') AS normal, starts_with(u, 'http:') AND NOT contains(split_part(u, '/', 3), '@') AS warns FROM {_URL_SQL}""",
    "flt16_ids": "SELECT doc_id, doc_id % 3 <> 2 AS valid, substr(sha256(text), 1, 2) AS shard FROM documents",
    "flt17_versions": f"""SELECT p_partkey, CASE WHEN bad THEN 'Unknown' WHEN (major, minor) < (2, 5) THEN 'Available' WHEN (major, minor) = (2, 5) THEN 'UpToDate' ELSE 'Ahead' END AS verdict,
        NOT bad AND (major, minor) >= (1, 3) AS may_write FROM {_V}""",
    "flt13_relative_paths": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id AS VARCHAR) END AS relative, doc_id % 3 = 2 AS temporary, doc_id % 4 = 1 AS safe FROM documents",
    "flt18_dirty_top": "SELECT c_custkey, c_custkey % 13 AS dirty_files, row_number() OVER (ORDER BY c_custkey % 13 DESC, c_custkey) AS place FROM customer WHERE c_custkey % 13 > 0",
    "src3_structural_skips": "SELECT CAST(doc_id AS VARCHAR) AS path FROM documents WHERE doc_id % 8 > 2",
    "src2_repo_boundary": """WITH p AS (SELECT CASE WHEN doc_id % 25 = 0 THEN source || '/repo/.git/config' WHEN doc_id % 5 = 1 THEN source || '/repo/deep/' || doc_id ELSE source || '/' || doc_id END AS path FROM documents)
        SELECT path FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE contains(q.path, '/.git/') AND starts_with(p.path, split_part(q.path, '.git', 1)))""",
}
