"""Queries over contents: chunks, stores, lines, differences, encryption, secrets, and scalar functions."""

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandkeep.functions import chunking, crypto, linediff, scalars, textshape
from strandkeep.operators import large_files, secrets, store
from strandkeep.sources import versions
from strandkeep.sources.tables import table
from strandkeep.stash import stash

#: A key for tests; real ones come from the caller.
KEY = bytes(range(32))
NOW = "timestamp'2024-02-01'"


def _docs(spark, folder):
    return table(spark, folder, "documents")


def _blobs(spark, folder):
    return _docs(spark, folder).select("doc_id", F.encode("text", "utf-8").alias("content"))


def _chunks(spark, folder):
    return chunking.chunk(_blobs(spark, folder)).select("doc_id", "position", "offset", "length", "chunk_id")


def _chunk_sums(spark, folder):
    """What chunking must keep whatever the cuts: every blob's bytes, in pieces of allowed sizes, and its hash when put together again; an empty blob has no pieces."""
    blobs = _blobs(spark, folder)
    pieces = chunking.chunk(blobs)
    lists = pieces.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("position", "chunk_id"))).alias("x"), F.sum("length").alias("bytes"), F.max("length").alias("most"))
    none = F.array().cast("array<string>")
    files = blobs.select("doc_id").join(lists, "doc_id", "left").select(
        "doc_id", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"), (F.coalesce("most", F.lit(0)) <= chunking.MAX_SIZE).alias("in_bounds"), F.coalesce(F.transform("x", lambda y: y["chunk_id"]), none).alias("chunks"),
    )
    objects = pieces.select("chunk_id", F.col("chunk").alias("content")).dropDuplicates(["chunk_id"])
    whole = store.reassemble(files, objects, key="doc_id")
    return files.select("doc_id", "bytes", "in_bounds").join(whole, "doc_id").select("doc_id", "bytes", "in_bounds", F.sha2("content", 256).alias("content_sha256"))


def _long_files(spark, folder):
    """The documents of each source end to end as one file, cut range by range; every document put together again from the chunks it lies in."""
    pieces = _docs(spark, folder).select(F.coalesce("source", F.lit("")).alias("file"), F.col("doc_id").alias("order"), F.encode("text", "utf-8").alias("content"))
    placed = large_files.offsets(pieces)
    chunks = large_files.chunk_ranges(large_files.of_pieces(placed, 1 << 18))
    span = chunking.MAX_SIZE
    ends = placed.groupBy("file").agg(F.max(F.col("offset") + F.octet_length("content")).alias("end"))
    least = F.when(F.col("offset") + F.col("length") < F.col("end"), chunking.MIN_SIZE).otherwise(1)
    chunks = chunks.withColumn("span", F.explode(F.expr(f"sequence(offset div {span}, (offset + length - 1) div {span})")))
    docs = placed.where("octet_length(content) > 0").select("file", F.col("order").alias("doc_id"), F.col("offset").alias("low"), (F.col("offset") + F.octet_length("content")).alias("high"))
    docs = docs.join(ends, "file").withColumn("span", F.explode(F.expr(f"sequence(low div {span}, (high - 1) div {span})")))
    start, stop = F.greatest("low", "offset"), F.least(F.col("high"), F.col("offset") + F.col("length"))
    shared = docs.join(chunks, ["file", "span"]).where((stop > start) & (F.floor(start / span) == F.col("span")))
    part = F.substring(F.col("chunk"), (start - F.col("offset") + 1).cast("int"), (stop - start).cast("int"))
    parts = shared.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(start.alias("start"), part.alias("part")))).alias("parts"), F.bool_and(F.col("length").between(least, span)).alias("in_bounds"))
    text = F.aggregate("parts", F.unhex(F.lit("")), lambda a, x: F.concat(a, x["part"]))
    return parts.select("doc_id", F.octet_length(text).cast("long").alias("bytes"), F.sha2(text, 256).alias("sha256"), "in_bounds")


def _survival(spark, folder):
    """How many chunks outlive a line put in front, in files of the documents of a hundred ids each."""
    text = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"]))
    whole = _docs(spark, folder).groupBy(F.expr("doc_id div 100").alias("file")).agg(F.encode(text, "utf-8").alias("content"))
    before = chunking.chunk(whole).select("file", "chunk_id").distinct()
    after = chunking.chunk(whole.withColumn("content", F.concat(F.encode(F.lit("a new first line\n"), "utf-8"), "content"))).select("file", "chunk_id").distinct()
    return before.join(after.withColumn("there", F.lit(1)), ["file", "chunk_id"], "left").groupBy("file").agg(F.count("*").alias("chunks"), F.count("there").alias("survived"))


def _put(spark, folder):
    docs = _docs(spark, folder).select(F.sha2("text", 256).alias("chunk_id"), "lang", "text")
    return store.put(docs.where("lang = 'en'"), docs.where("lang <> 'en'").select("chunk_id", "text")).select("chunk_id")


def _verified(spark, folder):
    docs = _docs(spark, folder)
    objects = docs.select(F.sha2("text", 256).alias("chunk_id"), F.encode("text", "utf-8").alias("content")).dropDuplicates(["chunk_id"])
    got = store.get(docs.select("doc_id", F.sha2("text", 256).alias("chunk_id")), objects)
    return got.select("doc_id", F.octet_length("content").cast("long").alias("bytes"))


def _fresh(spark, folder):
    chunks = _docs(spark, folder).select(F.sha2("text", 256).alias("chunk_id"), F.octet_length("text").cast("long").alias("length"), F.when(F.col("doc_id") % 2 == 0, "content").otherwise("manifest").alias("origin"), "lang")
    fresh = store.fresh_chunks(chunks.where("lang <> 'en'"), chunks.where("lang = 'en'").select("chunk_id").distinct())
    return fresh.groupBy("origin").agg(F.count("*").alias("chunks"), F.sum("length").alias("bytes"))


def _measured(spark, folder):
    objects = _docs(spark, folder).select(F.sha2("text", 256).alias("chunk_id"), F.octet_length("text").alias("stored_bytes")).dropDuplicates(["chunk_id"])
    return store.measure(objects)


def _envelopes(spark, folder):
    packed = _blobs(spark, folder).withColumn("stored", chunking.encode_objects("content"))
    again = chunking.decode_objects("stored")
    return packed.select("doc_id", F.sha2(again, 256).alias("content_sha256"), F.hex(F.substring("stored", 1, 2)).alias("head"), F.octet_length(again).cast("long").alias("bytes"))


def _manifest_round(spark, folder):
    entries = versions.entries(spark, folder, "ours").select(F.lit("s1").alias("snapshot_id"), F.concat("path", F.when(F.length("path") % 3 == 0, "\t\\x").otherwise("")).alias("path"), "size", F.timestamp_millis(F.col("size") + 1_700_000_000_000).alias("modified_utc"), (F.col("size") % 2 == 0).alias("executable"), "chunks")
    again = store.read_manifests(store.write_manifests(entries))
    return again.select("path", "size", F.unix_millis("modified_utc").alias("ms"), "executable", F.array_join("chunks", ",").alias("chunks"))


def _snapshot_round(spark, folder):
    c = table(spark, folder, "customer")
    snapshots = c.select(
        F.sha2("c_name", 256).alias("manifest_id"), F.array(F.sha2("c_name", 256)).alias("manifest_chunks"), F.when(F.col("c_custkey") % 2 == 0, F.array(F.sha2("c_mktsegment", 256))).otherwise(F.array().cast("array<string>")).alias("parents"),
        F.col("c_custkey").cast("string").alias("machine_id"), F.col("c_name").alias("machine_name"), F.timestamp_millis(F.col("c_custkey") + 1_700_000_000_000).alias("created_utc"), F.col("c_nationkey").alias("file_count"), F.col("c_custkey").alias("total_bytes"),
        F.array().cast("array<string>").alias("carried"), F.array(F.concat(F.lit("repo"), "c_nationkey")).alias("repos"),
    )
    again = store.read_snapshots(store.write_snapshots(snapshots))
    return again.select("manifest_id", F.size("parents").alias("n_parents"), "machine_id", "machine_name", F.unix_millis("created_utc").alias("ms"), "file_count", "total_bytes", F.array_join("repos", ",").alias("repos"))


def _line_counts(spark, folder):
    pages = table(spark, folder, "pages").select(F.explode(F.split("html", "\n")).alias("line"))
    docs = _docs(spark, folder).select(F.explode(F.split("text", "\n")).alias("line"))
    return docs.unionByName(pages).groupBy(F.sha2("line", 256).alias("line_sha256")).agg(F.count("*").alias("n"))


def _binary(spark, folder):
    blob = F.when(F.col("doc_id") % 3 == 0, F.concat(F.encode("text", "utf-8"), F.unhex(F.lit("00")))).otherwise(F.encode("text", "utf-8"))
    return _docs(spark, folder).select("doc_id", scalars.looks_binary(blob).alias("is_binary"))


_HUNKS = T.ArrayType(T.StructType().add("base_start", T.IntegerType()).add("base_len", T.IntegerType()).add("other_start", T.IntegerType()).add("other_len", T.IntegerType()))
_ROWS = T.ArrayType(T.StructType().add("kind", T.StringType()).add("left", T.StringType()).add("right", T.StringType()).add("left_no", T.IntegerType()).add("right_no", T.IntegerType()))
_CELLS = T.ArrayType(T.StructType().add("kind", T.StringType()).add("left_no", T.StringType()).add("left", T.StringType()).add("right_no", T.StringType()).add("right", T.StringType()))


def _lines(text: str | None) -> list[str]:
    return textshape.lines_of((text or "").encode())


@F.pandas_udf(_HUNKS)
def diff_lines(base: pd.Series, other: pd.Series) -> pd.Series:
    return pd.Series([[h._asdict() for h in linediff.diff(_lines(a), _lines(b))] for a, b in zip(base, other, strict=True)])


@F.pandas_udf(_ROWS)
def align_lines(left: pd.Series, right: pd.Series) -> pd.Series:
    names = ("kind", "left", "right", "left_no", "right_no")
    return pd.Series([[dict(zip(names, row, strict=True)) for row in linediff.side_by_side(_lines(a), _lines(b))] for a, b in zip(left, right, strict=True)])


@F.pandas_udf(_CELLS)
def lay_lines(left: pd.Series, right: pd.Series, width: pd.Series) -> pd.Series:
    names = ("kind", "left_no", "left", "right_no", "right")
    out = []
    for a, b, total in zip(left, right, width, strict=True):
        rows = linediff.side_by_side(_lines(a), _lines(b))
        out.append([dict(zip(names, cell, strict=True)) for cell in linediff.lay(rows, 0, len(rows), linediff.column_for(total))])
    return pd.Series(out)


def _pair(spark, folder):
    sides = [versions.version(spark, folder, n).withColumnRenamed("text", n) for n in ("base", "ours")]
    return sides[0].join(sides[1], "path").where("base <> ours")


def _diffs(spark, folder):
    return _pair(spark, folder).select("path", F.inline(diff_lines("base", "ours")))


def _aligned(spark, folder):
    rows = _pair(spark, folder).select("path", F.posexplode(align_lines("base", "ours")).alias("row", "x"))
    return rows.where("x.kind <> 'Same'").select("path", "row", "x.kind", "x.left_no", "x.right_no")


def _laid(spark, folder):
    rows = _pair(spark, folder).select("path", F.posexplode(lay_lines("base", "ours", F.lit(100))).alias("row", "x"))
    return rows.where("x.kind <> 'Same'").select("path", "row", "x.*")


def _secrets(spark, folder):
    return secrets.findings(_docs(spark, folder).select("doc_id", "text"), key="doc_id", content="text").select("doc_id", "line", "kind")


def _scan_gate(spark, folder):
    docs = _docs(spark, folder).select(F.col("doc_id").cast("string").alias("path"), F.array(F.sha2("text", 256)).alias("chunks"), "lang")
    known = docs.where("lang = 'en'").select(F.explode("chunks").alias("chunk_id")).distinct()
    return secrets.to_scan(docs.select("path", "chunks"), known).select("path")


def _sealed(spark, folder):
    blobs = _blobs(spark, folder)
    sealed = blobs.select("doc_id", "content", crypto.remote_id(KEY, F.sha2("content", 256)).alias("remote_id"), crypto.seal(KEY, "content").alias("blob"))
    opened = crypto.unseal(KEY, "blob", "remote_id")
    wrong = crypto.unseal(KEY, "blob", F.reverse("remote_id"))
    plain = F.contains("blob", F.col("content")) & (F.octet_length("content") > 3)  # no blob shows its content
    return sealed.select("doc_id", F.sha2(opened, 256).alias("content_sha256"), wrong.isNull().alias("refused"), F.octet_length("blob").cast("long").alias("bytes"), plain.alias("readable"))


def _tokens(spark, folder):
    return table(spark, folder, "customer").select("c_custkey", scalars.token_hash("c_name").alias("token_hash"))


def _sizes(spark, folder):
    """Numbers of all sizes: a long like SQL's where they all fit one, else decimals, so that none is lost where SQL itself overflows."""
    a, b = (F.col(c).cast("decimal(19,0)") for c in ("l_orderkey", "l_partkey"))
    n = (a * a * b).cast("decimal(38,0)")
    items = table(spark, folder, "lineitem").select(n.alias("n"))
    if (items.agg(F.max(F.abs("n"))).first()[0] or 0) < 1 << 63:
        items = items.select(F.col("n").cast("long").alias("n"))
    return items.distinct().select("n", scalars.format_bytes("n").alias("shown"))


def _agos(spark, folder):
    now = F.expr(NOW)
    return table(spark, folder, "events").select("event_id", scalars.ago("ts", now).alias("shown"), scalars.stamp("ts").alias("stamp"))


def _sums(spark, folder):
    from strandkeep import settings

    lines = F.concat(F.sha2("c_name", 256), F.when(F.col("c_custkey") % 2 == 0, " *").otherwise("  "), F.lit("file-"), "c_custkey", F.lit("\nshort name\n"))
    asset = scalars.asset_name(F.when(F.col("c_custkey") % 4 == 0, "windows").when(F.col("c_custkey") % 4 == 1, "linux").when(F.col("c_custkey") % 4 == 2, "macos").otherwise("beos"), F.when(F.col("c_custkey") % 3 == 0, "x86_64").when(F.col("c_custkey") % 3 == 1, "aarch64").otherwise("mips"))
    want = F.concat(F.lit("file-"), F.col("c_custkey") - F.when(F.col("c_custkey") % 5 == 0, 1).otherwise(0))
    return table(spark, folder, "customer").select("c_custkey", scalars.checksum_for(lines, want).alias("digest"), F.replace(asset, F.lit(settings.NAMESPACE), F.lit("app")).alias("asset"))


def _escapes(spark, folder):
    text = F.concat(F.col("lang"), F.when(F.col("doc_id") % 3 == 0, "\t").when(F.col("doc_id") % 3 == 1, "\\t").otherwise("\n\\"), F.col("source"))
    return _docs(spark, folder).select("doc_id", scalars.escape_field(text).alias("escaped"), (scalars.unescape_field(scalars.escape_field(text)) == text).alias("same"))


def _order(spark, folder):
    words = _docs(spark, folder).select(F.explode(F.split("text", " ")).alias("w")).where("length(w) > 0").select("w").distinct()
    marked = words.withColumn("w", F.when(F.length("w") % 5 == 0, F.concat(F.lit("\U0001f600"), "w")).when(F.length("w") % 5 == 1, F.concat(F.lit("\ue000"), "w")).otherwise(F.col("w")))
    # the order is cut into ranges, so that each is ranked by a task of its own; the words before it are added
    ranges = marked.repartitionByRange(scalars.ordinal("w").desc()).withColumn("part", F.spark_partition_id())
    ranges = stash(ranges)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = ranges.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(scalars.ordinal("w").desc()))
    return ranges.join(F.broadcast(starts), "part").select("w", (own + F.col("start")).cast("long").alias("rank")).orderBy("rank")


QUERIES = {
    "cnt3_chunks": _chunks,
    "src10_reassembly": _chunk_sums,
    "cnt2_chunk_survival": _survival,
    "cnt3_long_files": _long_files,
    "snk1_object_put": _put,
    "src5_verified_get": _verified,
    "agg2_fresh_chunks": _fresh,
    "agg3_store_size": _measured,
    "snk2_envelopes": _envelopes,
    "src7_manifest_round_trip": _manifest_round,
    "src8_snapshot_round_trip": _snapshot_round,
    "cnt5_line_counts": _line_counts,
    "flt9_binary_test": _binary,
    "cnt6_line_diff": _diffs,
    "cnt13_side_by_side": _aligned,
    "cnt15_layout": _laid,
    "flt10_secret_scan": _secrets,
    "flt11_scan_gate": _scan_gate,
    "crypto_seal": _sealed,
    "crypto_token_hash": _tokens,
    "fn_format_bytes": _sizes,
    "fn_ago": _agos,
    "fn_checksums": _sums,
    "snk3_escapes": _escapes,
    "srt1_ordinal_order": _order,
}


def _kinds_sql() -> str:
    return " UNION ALL ".join(f"SELECT doc_id, line, '{k}' AS kind FROM l WHERE regexp_matches(x, '{p.replace(chr(39), chr(39) * 2)}')" for k, p in secrets.KINDS.items())


_ENTRIES = versions.entries_sql("ours")
_LINES = "(CASE WHEN {0} = '' THEN 0 ELSE len(string_split({0}, chr(10))) - CAST(right({0}, 1) = chr(10) AS INTEGER) END)"
#: Ours differs from the base by a first line or by lines at the end: their place, and the lines of ours.
_EDITS = f"""(SELECT path, CASE WHEN o = 'ours' || chr(10) || b THEN 0 ELSE {_LINES.format("b")} END AS start, {_LINES.format("o")} - {_LINES.format("b")} AS n, string_split(o, chr(10)) AS lines
    FROM (SELECT path, b.text AS b, o.text AS o FROM {versions.version_sql("base")} b JOIN {versions.version_sql("ours")} o USING (path)) WHERE b <> o)"""
_ADDED = f"(SELECT path, CAST(start + i AS INTEGER) AS row, lines[start + i + 1] AS line FROM (SELECT *, unnest(range(0, n)) AS i FROM {_EDITS}))"

ORACLES = {
    "cnt3_long_files": "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS bytes, sha256(text) AS sha256, true AS in_bounds FROM documents WHERE strlen(text) > 0",
    "src10_reassembly": "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS bytes, true AS in_bounds, sha256(text) AS content_sha256 FROM documents",
    "snk1_object_put": "SELECT DISTINCT sha256(text) AS chunk_id FROM documents WHERE lang <> 'en' EXCEPT SELECT sha256(text) FROM documents WHERE lang = 'en'",
    "src5_verified_get": "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS bytes FROM documents",
    "agg2_fresh_chunks": """SELECT origin, count(*) AS chunks, CAST(sum(bytes) AS BIGINT) AS bytes FROM (SELECT sha256(text) AS c, min(CASE WHEN doc_id % 2 = 0 THEN 'content' ELSE 'manifest' END) AS origin, min(strlen(text)) AS bytes
        FROM documents WHERE lang <> 'en' GROUP BY 1) WHERE c NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'en') GROUP BY origin""",
    "agg3_store_size": "SELECT count(*) AS objects, CAST(sum(n) AS BIGINT) AS bytes FROM (SELECT DISTINCT text, strlen(text) AS n FROM documents)",
    "snk2_envelopes": "SELECT doc_id, sha256(text) AS content_sha256, '5701' AS head, CAST(strlen(text) AS BIGINT) AS bytes FROM documents",
    "src7_manifest_round_trip": f"SELECT path || CASE WHEN length(path) % 3 = 0 THEN chr(9) || '\\x' ELSE '' END AS path, size, size + 1700000000000 AS ms, size % 2 = 0 AS executable, array_to_string(chunks, ',') AS chunks FROM {_ENTRIES}",
    "src8_snapshot_round_trip": """SELECT sha256(c_name) AS manifest_id, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS n_parents, CAST(c_custkey AS VARCHAR) AS machine_id, c_name AS machine_name, c_custkey + 1700000000000 AS ms,
        c_nationkey AS file_count, c_custkey AS total_bytes, 'repo' || c_nationkey AS repos FROM customer""",
    "cnt5_line_counts": "SELECT sha256(line) AS line_sha256, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents UNION ALL SELECT unnest(string_split(html, chr(10))) FROM pages) GROUP BY 1",
    "flt9_binary_test": "SELECT doc_id, doc_id % 3 = 0 AND strlen(text) < 8000 AS is_binary FROM documents",
    "cnt6_line_diff": f"SELECT path, CAST(start AS INTEGER) AS base_start, CAST(0 AS INTEGER) AS base_len, CAST(start AS INTEGER) AS other_start, CAST(n AS INTEGER) AS other_len FROM {_EDITS}",
    "cnt13_side_by_side": f"SELECT path, row, 'OnlyRight' AS kind, CAST(0 AS INTEGER) AS left_no, CAST(row + 1 AS INTEGER) AS right_no FROM {_ADDED}",
    "cnt15_layout": f"SELECT path, row, 'OnlyRight' AS kind, '    ' AS left_no, rpad('\u00b7', {linediff.column_for(100)}, ' ') AS left, lpad(CAST(row + 1 AS VARCHAR), 4, ' ') AS right_no, rpad(line, {linediff.column_for(100)}, ' ') AS right FROM {_ADDED}",
    "srt1_ordinal_order": """WITH w AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS w FROM documents), m AS (SELECT CASE length(w) % 5 WHEN 0 THEN chr(128512) || w WHEN 1 THEN chr(57344) || w ELSE w END AS w FROM w WHERE length(w) > 0)
        SELECT w, row_number() OVER (ORDER BY replace(w, chr(128512), chr(55295)) DESC) AS rank FROM m""",
    "flt10_secret_scan": f"WITH l AS (SELECT doc_id, i AS line, x[i] AS x FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))) {_kinds_sql()}",
    "flt11_scan_gate": "SELECT CAST(doc_id AS VARCHAR) AS path FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE lang = 'en')",
    "crypto_seal": f"SELECT doc_id, sha256(text) AS content_sha256, true AS refused, CAST(strlen(text) + {crypto.OVERHEAD} AS BIGINT) AS bytes, false AS readable FROM documents",
    "crypto_token_hash": "SELECT c_custkey, sha256('strandkeep/token/v1/' || c_name) AS token_hash FROM customer",
    "fn_format_bytes": """SELECT n, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', round(n / 1024.0::DOUBLE, 1)) WHEN n < 1073741824 THEN printf('%.1f MB', round(n / 1024.0::DOUBLE / 1024, 1)) ELSE printf('%.2f GB', round(n / 1024.0::DOUBLE / 1024 / 1024, 2)) END AS shown
        FROM (SELECT DISTINCT l_orderkey * l_orderkey * l_partkey AS n FROM lineitem)""",
    "fn_ago": """SELECT event_id, CASE WHEN s < 90 THEN 'just now' WHEN s < 5400 THEN printf('%.0f min ago', round(s / 60)) WHEN s < 129600 THEN printf('%.0f h ago', round(s / 3600)) ELSE printf('%.0f d ago', round(s / 86400)) END AS shown, strftime(ts, '%Y%m%dT%H%M%SZ') AS stamp
        FROM (SELECT event_id, ts, (epoch_ms(TIMESTAMP '2024-02-01') - epoch_ms(ts)) / 1000.0::DOUBLE AS s FROM events)""",
    "fn_checksums": """SELECT c_custkey, CASE WHEN c_custkey % 5 > 0 THEN sha256(c_name) END AS digest, CASE WHEN c_custkey % 4 < 3 AND c_custkey % 3 < 2 THEN 'app-' || ['windows', 'linux', 'macos'][c_custkey % 4 + 1] || '-' || ['x64', 'arm64'][c_custkey % 3 + 1] || CASE WHEN c_custkey % 4 = 0 THEN '.exe' ELSE '' END END AS asset FROM customer""",
    "snk3_escapes": """SELECT doc_id, lang || CASE WHEN doc_id % 3 = 0 THEN '\\t' WHEN doc_id % 3 = 1 THEN '\\\\t' ELSE '\\n\\\\' END || source AS escaped, true AS same FROM documents""",
}
