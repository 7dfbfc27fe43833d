"""Queries over the smallest pieces: tables, three-way lines, framing, verified reads, claims and sessions."""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandkeep.functions import chunking, linediff, structural, textshape
from strandkeep.operators import policy, server, store
from strandkeep.plans.histories import NOW
from strandkeep.sources.tables import table


def _gear(spark, folder):
    rows = [(k, int(v).to_bytes(8, "little").hex()) for k, v in enumerate(chunking.gear())]
    return spark.createDataFrame(rows, "byte long, value string")


def _unverified(spark, folder):
    """Objects of which every third is not what its id says: read without a check they come as they are."""
    docs = table(spark, folder, "documents").select("doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("chunk_id"), F.encode("text", "utf-8").alias("content"))
    found = store.get(docs.where("doc_id % 3 > 0").select("doc_id", "chunk_id"), docs.drop("doc_id"), verified=False)
    return found.select("doc_id", F.sha2("content", 256).alias("content_sha256"))


def _whole(spark, folder):
    """Files of three chunks each, put together and held against the hash of the whole."""
    text = F.encode("text", "utf-8")
    n = F.ceil(F.octet_length(text) / 3).cast("int")
    docs = table(spark, folder, "documents").select("doc_id", F.sha2(text, 256).alias("whole"), F.array(*[F.substring(text, F.lit(1) + n * k, n) for k in range(3)]).alias("parts"))
    pieces = docs.select(F.explode("parts").alias("content")).select(F.sha2("content", 256).alias("chunk_id"), "content").dropDuplicates(["chunk_id"])
    files = docs.select("doc_id", "whole", F.transform("parts", lambda p: F.sha2(p, 256)).alias("chunks"))
    again = store.reassemble(files, pieces, key="doc_id", verified_by="whole")
    return again.select("doc_id", F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("content_sha256"))


def _claims(spark, folder):
    offers = table(spark, folder, "orders").select(F.col("o_custkey").alias("workspace"), F.col("o_orderkey").alias("offer"), (F.col("o_orderkey") % 3).alias("fingerprint"))
    stored = table(spark, folder, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("workspace"), (F.col("c_custkey") % 3).alias("stored"))
    return server.claims(stored, offers, "offer").select("offer", "accepted", "kept")


def _sessions(spark, folder):
    old = table(spark, folder, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("machine_id"), F.lit(NOW).alias("created_utc"))
    return server.begin_push(old, "new", "7", F.lit(NOW)).select("id", "machine_id")


_LINES = T.StructType().add("status", "string").add("content", "string")


@F.pandas_udf(_LINES)
def three_way_lines(base: pd.Series, ours: pd.Series, theirs: pd.Series) -> pd.DataFrame:
    out = []
    for sides in zip(base, ours, theirs, strict=True):
        lines, conflicts = linediff.merge3(*(textshape.lines_of(x.encode()) for x in sides))
        out.append(("conflict", None) if conflicts else ("merged", "\n".join(lines)))
    return pd.DataFrame(out, columns=["status", "content"])


@F.pandas_udf(_LINES)
def text_merge(base: pd.Series, ours: pd.Series, theirs: pd.Series) -> pd.DataFrame:
    done = [structural.merge_text(*(x.encode() for x in sides)) for sides in zip(base, ours, theirs, strict=True)]
    return pd.DataFrame([(x.status, x.content.decode() if x.content is not None else None) for x in done], columns=["status", "content"])


def _edited(spark, folder, end: str):
    """Each document with its first line changed on one side and its last on the other."""
    text = F.regexp_replace(F.replace("text", F.lit("\r"), F.lit("")), "\n+$", "")
    x = F.split("t", "\n")
    ours, theirs = F.concat(F.array(F.lit("A")), F.slice(x, F.lit(2), F.size(x))), F.concat(F.slice(x, F.lit(1), F.size(x) - 1), F.array(F.lit("Z")))
    docs = table(spark, folder, "documents").select("doc_id", text.alias("t"))
    return docs.select("doc_id", F.concat("t", F.lit(end)).alias("base"), *(F.concat(F.array_join(s, "\n"), F.lit(end)).alias(n) for s, n in ((ours, "ours"), (theirs, "theirs"))))


def _three_way(spark, folder):
    done = _edited(spark, folder, "").withColumn("x", three_way_lines("base", "ours", "theirs"))
    return done.select("doc_id", "x.status", F.sha2("x.content", 256).alias("content_sha256"))


def _text_merge(spark, folder):
    done = _edited(spark, folder, "\n").withColumn("x", text_merge("base", "ours", "theirs"))
    return done.select("doc_id", "x.status", F.sha2("x.content", 256).alias("content_sha256"))


_FRAMED = T.StructType().add("left", "string").add("right", "string")


@F.pandas_udf(_FRAMED)
def framed(left: pd.Series, right: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([linediff.frame(a, b, 20) for a, b in zip(left, right, strict=True)], columns=["left", "right"])


def _frames(spark, folder):
    e = table(spark, folder, "events")
    same = F.repeat(F.lit("x"), (F.col("event_id") % 60).cast("int"))
    left, right = F.concat(same, F.lit("L"), F.repeat(F.lit("y"), (F.col("event_id") % 31).cast("int"))), F.concat(same, F.lit("R"))
    return e.select("event_id", framed(left, right).alias("x")).select("event_id", "x.left", "x.right")


def _errors(spark, folder):
    """Which rules over the names of documents' sources a policy refuses."""
    rows = []
    for kind in ("ignore", "never"):
        for line in ("!*.pem", "=*.pem", "=id_?sa", "=[a-z].key", "=key", "# !x", "", "*.key", "  !late"):
            try:
                policy.parse_policy([line] if kind == "ignore" else [], [line] if kind == "never" else [])
                rows.append((kind, line, False))
            except ValueError:
                rows.append((kind, line, True))
    return spark.createDataFrame(rows, "kind string, line string, refused boolean")


QUERIES = {
    "cnt1_gear_table": _gear,
    "src6_unverified_get": _unverified,
    "src9_whole_hash": _whole,
    "sta4_fingerprint_claims": _claims,
    "sta6_begin_push": _sessions,
    "cnt7_three_way_lines": _three_way,
    "cnt9_text_merge": _text_merge,
    "cnt14_framing": _frames,
    "flt3_policy_errors": _errors,
}


def _edited_sql(end: str) -> str:
    return f"""SELECT doc_id, CASE WHEN len(x) > 1 THEN 'merged' ELSE 'conflict' END AS status, CASE WHEN len(x) > 1 THEN sha256(array_to_string(['A'] || x[2:len(x) - 1] || ['Z'], chr(10)) || {end}) END AS content_sha256
        FROM (SELECT doc_id, string_split(regexp_replace(replace(text, chr(13), ''), '\\n+$', ''), chr(10)) AS x FROM documents)"""


def _frame_sql(text: str) -> str:
    rest = f"substr({text}, n - 7)"
    return f"CASE WHEN n < 19 THEN CASE WHEN length({text}) <= 20 THEN {text} ELSE left({text}, 19) || '…' END ELSE '…' || CASE WHEN length({rest}) <= 19 THEN {rest} ELSE left({rest}, 18) || '…' END END"


ORACLES = {
    "cnt1_gear_table": "SELECT k AS byte, left(sha256('strandkeep/gear/v1/' || k), 16) AS value FROM range(256) t(k)",
    "src6_unverified_get": "SELECT doc_id, sha256(text) AS content_sha256 FROM documents WHERE doc_id % 3 > 0",
    "src9_whole_hash": "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS bytes, sha256(text) AS content_sha256 FROM documents",
    "sta4_fingerprint_claims": """WITH f AS (SELECT o_orderkey AS offer, o_orderkey % 3 AS fingerprint, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 3 ELSE first_value(o_orderkey % 3) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) END AS kept
        FROM orders LEFT JOIN customer ON c_custkey = o_custkey) SELECT offer, fingerprint = kept AS accepted, kept FROM f""",
    "sta6_begin_push": "SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS machine_id FROM orders UNION ALL SELECT 'new', '7'",
    "cnt7_three_way_lines": _edited_sql("''"),
    "cnt9_text_merge": _edited_sql("chr(10)"),
    "cnt14_framing": f"""SELECT event_id, {_frame_sql("l")} AS left, {_frame_sql("r")} AS right
        FROM (SELECT event_id, n, repeat('x', n) || 'L' || repeat('y', event_id % 31) AS l, repeat('x', n) || 'R' AS r FROM (SELECT event_id, CAST(event_id % 60 AS INTEGER) AS n FROM events))""",
    "flt3_policy_errors": """SELECT kind, line, kind = 'never' AND (line IN ('!*.pem', '  !late') OR (line LIKE '=%' AND regexp_matches(line, '[*?]|\\['))) AS refused
        FROM (VALUES ('ignore'), ('never')) k(kind), (VALUES ('!*.pem'), ('=*.pem'), ('=id_?sa'), ('=[a-z].key'), ('=key'), ('# !x'), (''), ('*.key'), ('  !late')) t(line)""",
}
