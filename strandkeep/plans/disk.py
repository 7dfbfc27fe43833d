"""Queries over files that they write themselves from documents: object files, applied plans, and trees with links."""

import os

from pyspark.sql import functions as F

from strandkeep.sources import files, object_files, versions, working_tree
from strandkeep.sources.tables import table
from strandkeep.stash import scratch, stash


def _objects(spark, folder):
    """Every text put three times, by tasks that share no order; who created it, and what is read back."""
    texts = table(spark, folder, "documents").where("text IS NOT NULL").select(F.sha2("text", 256).alias("chunk_id"), F.encode("text", "utf-8").alias("content"))
    root = scratch(spark, "objects")
    often = texts.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(3)))).hint("rebalance")  # dealt out in turn, more tasks for more bytes
    done = stash(object_files.write(often, root)).groupBy("chunk_id").agg(F.count_if("created").alias("created"), F.max("bytes").alias("bytes"))
    content = object_files.read(object_files.listed(spark, root), root).select("chunk_id", F.sha2("content", 256).alias("sha256"))
    return done.join(content, "chunk_id").select("chunk_id", "created", "bytes", "sha256")


def _tree_of(spark, folder):
    """A tree on disk with ours as its files, and the plan that makes theirs of it."""
    ours, theirs = (versions.version(spark, folder, name) for name in ("ours", "theirs"))
    root = scratch(spark, "tree")
    content = F.encode("text", "utf-8").alias("content")
    working_tree.apply(ours.select("path", content), ours.select("path").limit(0), root)
    now = ours.select("path", F.sha2("text", 256).alias("now"))  # one side's texts move, not both
    changed = theirs.join(now, "path", "left").where((F.sha2("text", 256) != F.col("now")) | F.col("now").isNull())
    return root, changed.select("path", content), ours.select("path").join(theirs, "path", "left_anti")


def _applied(spark, folder):
    """Ours on disk after the plan that makes theirs of it: every file's size and hash, and what the plan did."""
    root, writes, deletes = _tree_of(spark, folder)
    done = working_tree.apply(writes, deletes, root)
    top = object_files.mounted(root)

    def hashes(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            out = []
            for path in batch["path"].to_pylist():
                with open(os.path.join(top, path), "rb") as file:
                    out.append(hashlib.file_digest(file, "sha256").hexdigest())
            yield pa.RecordBatch.from_arrays([batch["path"], batch["size"], pa.array(out, pa.string())], names=["path", "size", "sha256"])

    now = files.listed(spark, root).select("path", "size").mapInArrow(hashes, "path string, size long, sha256 string")
    counts = spark.createDataFrame([("written", done.written, ""), ("deleted", done.deleted, "")], "path string, size long, sha256 string")
    return now.unionByName(counts)


def _linked(spark, folder):
    """A tree in which links lead to directories, up, to files and nowhere: what is listed, with the size of files."""
    docs = table(spark, folder, "documents").select("doc_id", F.concat("source", F.lit("/"), "lang", F.lit("/"), "doc_id").alias("path"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("content"))
    root = scratch(spark, "links")
    working_tree.apply(docs.select("path", "content"), docs.select("path").limit(0), root)
    top = object_files.mounted(root)

    def link(path, to):
        os.symlink(to, os.path.join(top, path))
        return True

    to = F.when(F.col("doc_id") % 20 == 0, ".").when(F.col("doc_id") % 20 == 5, "../..").when(F.col("doc_id") % 20 == 10, F.concat("doc_id")).otherwise("nothing")
    links = docs.where("doc_id % 5 = 0").select(F.concat("path", F.lit(".link")).alias("path"), to.alias("to"))
    working_tree._per_path(links.repartition(8), link, ["to"]).count()
    return files.listed(spark, root).select("path", F.when(F.endswith("path", F.lit(".link")), None).otherwise(F.col("size")).alias("size"))


QUERIES = {"snk1_object_files": _objects, "snk6_applied_tree": _applied, "src4_links": _linked}

_OURS, _THEIRS = versions.version_sql("ours"), versions.version_sql("theirs")
ORACLES = {
    "snk1_object_files": "SELECT sha256(text) AS chunk_id, 1 AS created, CAST(max(strlen(text)) AS BIGINT) AS bytes, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL GROUP BY 1, 4",
    "snk6_applied_tree": f"""SELECT path, CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS sha256 FROM {_THEIRS}
        UNION ALL SELECT 'written', count(*), '' FROM {_THEIRS} t LEFT JOIN {_OURS} o USING (path) WHERE o.text IS NULL OR o.text <> t.text UNION ALL SELECT 'deleted', count(*), '' FROM {_OURS} WHERE path NOT IN (SELECT path FROM {_THEIRS})""",
    "src4_links": """SELECT source || '/' || lang || '/' || doc_id AS path, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size FROM documents
        UNION ALL SELECT source || '/' || lang || '/' || doc_id || '.link', NULL FROM documents WHERE doc_id % 5 = 0""",
}
