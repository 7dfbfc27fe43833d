"""Listing a file tree, and reading what other tools wrote about it."""

from __future__ import annotations

import os
from datetime import UTC, datetime
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandkeep.functions.scalars import is_companion
from strandkeep.operators import policy as rules
from strandkeep.stash import stash


class Walk(NamedTuple):
    """A tree's checkouts (root), loose files that the rules keep, and what they refuse."""

    checkouts: DataFrame
    files: DataFrame
    refused: DataFrame


_LISTED = "path string, size long, modified_utc timestamp"
#: Files of another store that the driver holds before it writes them.
_HELD = 100_000


def listed(spark: SparkSession, root: str, policy: rules.Policy | None = None) -> DataFrame:
    """path (below root), size, modified_utc of the files of a tree, hidden ones too; contents are not read.

    A directory that the policy takes out is listed itself, with a final slash, and not entered; of a checkout
    only its .git entry is. A link to a directory is listed as a file and never followed. Directories that
    vanish or cannot be read are passed over. A mounted tree is listed in tasks, level by level, and the driver
    sees nothing of it; any other store goes through Spark's file systems, where the driver lists and writes
    what it found in parts.
    """
    bare = root.removeprefix("file:")
    if "://" in bare and not root.startswith("file:///"):
        return _listed_elsewhere(spark, root, policy)
    top = "/" + bare.lstrip("/") if root.startswith("file:") else bare
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    front, parts = spark.createDataFrame([("",)], "above string"), []
    while many := front.count():
        found = stash(front.repartition(min(n, many), "above").mapInArrow(lambda batches: _scanned(top, batches), _LISTED + ", is_dir boolean"))
        entered = found.where("is_dir")
        if policy is not None:
            entered = entered.withColumn("__verdict", rules.verdict(policy, "path", True))
            out = entered.where("__verdict <> 'Include'").select(F.concat("path", F.lit("/")).alias("path"), F.lit(0).cast("long").alias("size"), "modified_utc")
            entered = entered.where("__verdict = 'Include'")
            parts.append(out)
        parts.append(found.where("NOT is_dir").select("path", "size", "modified_utc"))
        front = stash(entered.select(F.concat("path", F.lit("/")).alias("above")))
    return reduce(DataFrame.unionByName, parts)


def _scanned(top: str, batches):
    """The entries of each directory of a batch."""
    import pyarrow as pa

    kinds = [pa.string(), pa.int64(), pa.timestamp("us", tz="UTC"), pa.bool_()]
    for batch in batches:
        rows = []
        for above in batch.column("above").to_pylist():
            try:
                with os.scandir(os.path.join(top, above)) as entries:
                    own = list(entries)
            except OSError:
                continue
            if any(e.name == ".git" for e in own):
                rows.append((f"{above}.git", 0, None, False))
                continue
            for e in own:
                try:
                    is_dir = e.is_dir(follow_symlinks=False)
                    stat = e.stat(follow_symlinks=not e.is_symlink() or e.is_file())
                except OSError:
                    continue
                rows.append((above + e.name, 0 if is_dir else stat.st_size, int(stat.st_mtime * 1e6), is_dir))
        yield pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["path", "size", "modified_utc", "is_dir"])


def _listed_elsewhere(spark: SparkSession, root: str, policy: rules.Policy | None) -> DataFrame:
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = top.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    todo, rows, parts = [(top, "")], [], []
    while todo:
        place, above = todo.pop()
        found = [(x.getPath(), x.getPath().getName(), x.isDirectory() and not x.isSymlink(), x.getLen(), x.getModificationTime()) for x in system.listStatus(place)]
        if any(name == ".git" for _, name, *_ in found):
            rows.append((f"{above}.git", 0, None))
            continue
        for path, name, is_dir, size, at in found:
            if is_dir and (policy is None or rules.judge(policy, above + name, True) == "Include"):
                todo.append((path, f"{above}{name}/"))
            else:
                rows.append((f"{above}{name}/" if is_dir else above + name, 0 if is_dir else size, datetime.fromtimestamp(at / 1000, UTC)))
        if len(rows) >= _HELD:
            parts.append(stash(spark.createDataFrame(rows, _LISTED)))
            rows = []
    return reduce(DataFrame.unionByName, [*parts, spark.createDataFrame(rows, _LISTED)])


def walk(files: DataFrame, policy: rules.Policy) -> Walk:
    """The walk over listed files (path and others): checkouts and all below them are left to their own history, companions are skipped."""
    parts = F.split("path", "/")
    mark = F.array_position(parts, ".git").cast("int")
    checkouts = files.where(mark > 0).select(F.array_join(F.slice(parts, F.lit(1), mark - 1), "/").alias("root")).distinct()
    loose = rules.outside_checkouts(files, "path").where(~is_companion("path"))
    return Walk(checkouts.orderBy("root"), rules.kept(loose, policy), rules.refused(loose, policy).orderBy("refused"))


def read_json(texts: DataFrame, schema: str, strict: bool, keep: list[str] = ()) -> DataFrame:
    """keep, and value: text parsed by a schema. strict raises for what doesn't fit (a machine's identity), else it reads as null (heads, merge state)."""
    return texts.select(*keep, F.from_json("text", schema, {"mode": "FAILFAST" if strict else "PERMISSIVE"}).alias("value"))


def porcelain_states(reports: DataFrame) -> DataFrame:
    """path, branch, head, dirty_files of status reports (path, text) in porcelain v2 form; a detached branch is null, an unborn head too."""
    lines = F.split("text", "\n")

    def header(name: str):
        return F.get(F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit(f"# branch.{name} "))), lambda x: F.regexp_extract(x, r"^\S+ \S+ (.*)$", 1)), F.lit(0))

    changed = F.size(F.filter(lines, lambda x: (x != "") & ~F.startswith(x, F.lit("#")) & ~F.startswith(x, F.lit("!"))))
    return reports.select("path", F.nullif(header("head"), F.lit("(detached)")).alias("branch"), F.nullif(header("oid"), F.lit("(initial)")).alias("head"), changed.alias("dirty_files"))


def repositories(trees: DataFrame) -> DataFrame:
    """common_dir, trees of working trees (common_dir, path, is_primary): each repository with its trees, the primary first, then by path."""
    own = F.struct((~F.col("is_primary")).alias("linked"), "path")
    return trees.groupBy("common_dir").agg(F.array_sort(F.collect_set(own)).alias("xs")).select("common_dir", F.transform("xs", lambda x: x["path"]).alias("trees"))
