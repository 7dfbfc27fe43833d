"""Writing a tree of files on a mounted folder: a plan stands on disk whole or not at all.

New contents are staged beside the tree and the plan is written down; then one file, created exclusively, decides. What
follows only moves staged files to their places and deletes, in steps that can be done again: after a crash recover() finishes a
plan that was decided and drops one that was not.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandkeep import settings
from strandkeep.functions.scalars import is_safe_path
from strandkeep.sources import files
from strandkeep.sources.object_files import mounted, put_file
from strandkeep.stash import stash

META = f".{settings.NAMESPACE}"
_PLAN = "path string, kind string"


class Busy(Exception):
    """Another plan is under way."""


class Applied(NamedTuple):
    """Files written, files deleted and directories removed."""

    written: int
    deleted: int
    emptied: int


def refusals(writes: DataFrame, deletes: DataFrame, there: DataFrame) -> DataFrame:
    """path, reason of what a plan must not do: leave the root, touch the tool's own folder, name a path twice, or need a path both as a file and as a directory. there: path of the files now."""
    every = writes.select("path", F.lit("write").alias("kind")).unionByName(deletes.select("path", F.lit("delete").alias("kind")))
    plain = F.array_join(F.filter(F.split("path", "/"), lambda x: (x != "") & (x != ".") & (x != "..")), "/") == F.col("path")
    own = (F.substring_index("path", "/", 1) == META) | (F.substring_index("path", "/", 1) == ".git") | F.contains("path", F.lit("/.git/"))
    bad = every.select("path", F.when(F.col("path").isNull() | ~is_safe_path("path"), "leaves the root").when(~plain, "is not plain").when(own, "is not the tree's").alias("reason")).where("reason IS NOT NULL")
    twice = every.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").select("path", F.lit("is named twice").alias("reason"))
    after = there.select("path").join(deletes.select("path"), "path", "left_anti").unionByName(writes.select("path")).distinct()
    parts = F.split("path", "/")
    above = after.where(F.size(parts) > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda d: F.array_join(F.slice(parts, F.lit(1), d), "/"))).alias("path")).distinct()
    both = after.join(above, "path", "left_semi").select("path", F.lit("is a file and a directory").alias("reason"))
    return bad.unionByName(twice).unionByName(both).distinct()


def _linked(top: str, folder: str) -> bool:
    """Whether a folder or one above it is a link."""
    at = top
    for part in folder.split("/"):
        at = os.path.join(at, part)
        if os.path.islink(at):
            return True
    return False


def _through_links(plan: DataFrame, top: str) -> list[str]:
    """Some paths of a plan that lead through a link; each folder is looked at once, whatever it holds."""
    folders = plan.where(F.contains("path", F.lit("/"))).withColumn("folder", F.regexp_replace("path", "/[^/]*$", ""))
    bad = _per_path(folders.select(F.col("folder").alias("path")).distinct(), lambda path: _linked(top, path), []).where("done").select(F.col("path").alias("folder"))
    return [r["path"] for r in folders.join(bad, "folder", "left_semi").select("path").limit(5).collect()]


def _per_path(rows: DataFrame, work, columns: list[str]) -> DataFrame:
    """path, done of work(path, *columns) on every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [work(*(v.as_py() for v in row)) for row in zip(*(batch[c] for c in ("path", *columns)))]
            yield pa.RecordBatch.from_arrays([batch["path"], pa.array(done, pa.bool_())], names=["path", "done"])

    return rows.select("path", *columns).mapInArrow(run, "path string, done boolean")


def apply(writes: DataFrame, deletes: DataFrame, root: str) -> Applied:
    """Writes files (path, content, and executable and modified_utc if there) and deletes files (path) below root; raises before anything is changed if a path is refused or leads through a link.

    Directories that deletes empty go, the root stays. One plan at a time: Busy if another is under way.
    """
    spark, top = writes.sparkSession, mounted(root)
    os.makedirs(os.path.join(top, META), exist_ok=True)
    name = uuid.uuid4().hex
    lock, stage = os.path.join(top, META, "applying"), os.path.join(top, META, f"apply-{name}")
    if not put_file(lock, name.encode()):
        raise Busy(root)
    decided = False
    try:
        there = files.listed(spark, top).where(~F.startswith("path", F.lit(f"{META}/")))
        writes = stash(writes)  # worked out once: what is checked, staged and written down is the same
        plan = writes.select("path", F.lit("write").alias("kind")).unionByName(deletes.select("path", F.lit("delete").alias("kind")))
        plan.write.parquet(f"file://{stage}/plan")
        plan = spark.read.schema(_PLAN).parquet(f"file://{stage}/plan")
        refused = refusals(plan.where("kind = 'write'"), plan.where("kind = 'delete'"), there).orderBy("path", "reason").limit(5).collect()
        refused = refused or [(path, "leads through a link") for path in _through_links(plan, top)]
        if refused:
            raise ValueError("refused: " + "; ".join(f"{path!r} {reason}" for path, reason in refused))
        _staged(writes, os.path.join(stage, "files"))
        decided = put_file(os.path.join(stage, "decided"), b"")
        return _carried_out(spark, top, stage)
    finally:
        if not decided:
            shutil.rmtree(stage, ignore_errors=True)
            os.unlink(lock)


def _moved(old: str, new: str) -> None:
    """Renames; the folder of the new name is made if it is not there."""
    try:
        os.replace(old, new)
    except FileNotFoundError:
        os.makedirs(os.path.dirname(new), exist_ok=True)
        os.replace(old, new)


def _staged(writes: DataFrame, stage: str) -> None:
    more = [c for c in ("executable", "modified_utc") if c in writes.columns]

    def put(path: str, content: bytes, *rest) -> bool:
        known = dict(zip(more, rest))
        at = os.path.join(stage, path)
        beside = os.path.join(os.path.dirname(stage), uuid.uuid4().hex)
        with open(beside, "wb") as file:
            file.write(content or b"")
            file.flush()
            os.fsync(file.fileno())
        if known.get("executable"):
            os.chmod(beside, 0o755)
        if known.get("modified_utc"):
            os.utime(beside, (known["modified_utc"].timestamp(),) * 2)
        _moved(beside, at)  # a task that runs twice stages the same once more
        return True

    os.makedirs(stage, exist_ok=True)
    _per_path(writes, put, ["content", *more]).agg(F.count("*")).collect()


def _carried_out(spark: SparkSession, top: str, stage: str) -> Applied:
    """Does what a decided plan says, the deletes first; what is done already is passed over."""
    plan = spark.read.schema(_PLAN).parquet(f"file://{stage}/plan")
    gone = plan.where("kind = 'delete'")

    def delete(path: str) -> bool:
        try:
            os.unlink(os.path.join(top, path))
        except (FileNotFoundError, NotADirectoryError):
            return False
        return True

    def move(path: str) -> bool:
        staged, final = os.path.join(stage, "files", path), os.path.join(top, path)
        try:
            _moved(staged, final)
        except FileNotFoundError:
            if not os.path.isfile(final):
                raise
        return True

    def count(rows: DataFrame) -> int:
        return rows.where("done").count()

    deleted = count(_per_path(gone, delete, []))
    emptied = _emptied(gone, top)
    written = count(_per_path(plan.where("kind = 'write'"), move, []))
    os.unlink(os.path.join(top, META, "applying"))
    shutil.rmtree(stage, ignore_errors=True)
    return Applied(written, deleted, emptied)


def _emptied(gone: DataFrame, top: str) -> int:
    """Removes the directories above what is gone if they are empty, the deepest first."""
    parts = F.split("path", "/")
    above = gone.where(F.size(parts) > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda d: F.array_join(F.slice(parts, F.lit(1), d), "/"))).alias("path")).distinct()

    def remove(path: str) -> bool:
        try:
            os.rmdir(os.path.join(top, path))
        except OSError:
            return False
        return True

    deepest = above.agg(F.max(F.size(parts))).first()[0] or 0
    return sum(_per_path(above.where(F.size(parts) == d), remove, []).where("done").count() for d in range(deepest, 0, -1))


def recover(spark: SparkSession, root: str) -> Applied | None:
    """After a crash: finishes a plan that was decided, drops one that was not (and returns None), and opens the tree for the next."""
    top = mounted(root)
    lock = os.path.join(top, META, "applying")
    if not os.path.exists(lock):
        return None
    with open(lock, encoding="utf-8") as file:
        stage = os.path.join(top, META, f"apply-{file.read()}")
    if os.path.exists(os.path.join(stage, "decided")):
        return _carried_out(spark, top, stage)
    shutil.rmtree(stage, ignore_errors=True)
    os.unlink(lock)
    return None
