"""A workspace's checkouts, carried work, refs and pending merges as tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandkeep import settings
from strandkeep.functions import chunking
from strandkeep.functions.scalars import is_id
from strandkeep.operators import merge
from strandkeep.sources.state_log import Change, StateLog


def dirty(checkouts: DataFrame) -> DataFrame:
    """The checkouts (path, dirty_files and others) with uncommitted files, most files first, then by path."""
    return checkouts.where("dirty_files > 0").orderBy(F.desc("dirty_files"), "path")


def carried_places(checkouts: DataFrame, carried: DataFrame, on_server: Column | bool) -> DataFrame:
    """The dirty checkouts with place: where their work exists. carried: path; on_server: whether the head that carries it is pushed."""
    there = carried.select("path", F.lit(True).alias("__carried")).distinct()
    safe = F.lit(on_server) if isinstance(on_server, bool) else on_server
    place = F.when(F.col("__carried").isNull(), "this disk only").when(safe, "on the server").otherwise("snapshotted, not pushed")
    return checkouts.where("dirty_files > 0").join(there, "path", "left").withColumn("place", place).drop("__carried").orderBy(F.desc("dirty_files"), "path")


def at_risk(checkouts: DataFrame, carried: DataFrame) -> DataFrame:
    """One row: dirty, the checkouts with uncommitted files, and at_risk, those of them that no snapshot carries."""
    there = carried.select("path", F.lit(True).alias("__carried")).distinct()
    found = checkouts.where("dirty_files > 0").join(there, "path", "left")
    return found.agg(F.count("*").alias("dirty"), F.count_if(F.col("__carried").isNull()).alias("at_risk"))


def machines_by_name(machines: DataFrame) -> DataFrame:
    """machines (id, name and others) by name, equal names by id, with their position from 1. Machines are few: one sort."""
    return machines.withColumn("position", F.row_number().over(Window.orderBy("name", "id"))).orderBy("position")


def fetched_heads(machines: DataFrame, fetched: DataFrame) -> DataFrame:
    """machines (id, name, head) with state: no head, fetched or to fetch. fetched: head."""
    here = fetched.select("head", F.lit(True).alias("__here")).distinct()
    state = F.when(F.col("head").isNull(), "no head").when(F.col("__here"), "fetched").otherwise("to fetch")
    return machines.join(here, "head", "left").select("id", "name", "head", state.alias("state"))


def same_carried(one: DataFrame, two: DataFrame, by: list[str]) -> DataFrame:
    """by, same: whether two snapshots carry the same work: the same repositories, each on the same commit with the same patch chunks in order.

    one, two: by, path, base_commit, patch_chunks.
    """
    a, b = (x.select(*by, "path", F.struct("base_commit", "patch_chunks").alias(n)) for x, n in ((one, "a"), (two, "b")))
    both = a.join(b, [*by, "path"], "full_outer")
    return both.groupBy(*by).agg(F.bool_and(F.col("a").eqNullSafe(F.col("b"))).alias("same"))


def land_gate(work: DataFrame, checkouts: DataFrame, force: bool = False, three_way: bool = False) -> DataFrame:
    """work (repo, base_commit, fits and others) with refusal, empty if it may land.

    In order: no checkout; uncommitted files, unless forced; another commit, unless merged three-way; a patch
    that does not fit (fits is null where nobody has tried). checkouts: repo, dirty_files, head.
    """
    here = checkouts.select("repo", F.col("dirty_files").alias("__dirty"), F.col("head").alias("__head"), F.lit(True).alias("__there"))
    refusal = F.when(F.col("__there").isNull(), "no checkout")
    if not force:
        refusal = refusal.when(F.col("__dirty") > 0, "uncommitted files")
    if not three_way:
        refusal = refusal.when(~F.col("__head").eqNullSafe(F.col("base_commit")), "another commit")
    refusal = refusal.when(~F.coalesce("fits", F.lit(True)), "the patch does not fit").otherwise("")
    return work.join(here, "repo", "left").withColumn("refusal", refusal).drop("__dirty", "__head", "__there")


def working_trees(trees: DataFrame) -> DataFrame:
    """repository, trees, primary_trees, first (its primary tree's path, else the least) of trees (repository, path, is_primary)."""
    first = F.min(F.struct((~F.col("is_primary")).alias("linked"), "path"))
    return trees.groupBy("repository").agg(F.count("*").alias("trees"), F.count_if("is_primary").alias("primary_trees"), first.alias("x")).select("repository", "trees", "primary_trees", F.col("x.path").alias("first"))


def tree_counts(trees: DataFrame, carried: DataFrame) -> DataFrame:
    """One row: trees, primary_trees, carried_files of all trees (is_primary) and carried work (changed_files)."""
    files = carried.agg(F.coalesce(F.sum("changed_files"), F.lit(0)).cast("long").alias("carried_files"))
    return trees.agg(F.count("*").alias("trees"), F.count_if("is_primary").alias("primary_trees")).crossJoin(files)  # one row each


def fresh_share(fresh: Column | str, every: Column | str) -> Column:
    """The share of new bytes, 0 for an empty workspace."""
    fresh, every = (F.col(x) if isinstance(x, str) else x for x in (fresh, every))
    return F.coalesce(F.try_divide(fresh.cast("double"), every.cast("double")), F.lit(0.0))


# refs: name (HEAD, PUSHED or REMOTE_HEADS), machine_id and machine_name (null but for REMOTE_HEADS), head

REFS = "name string, machine_id string, machine_name string, head string"


def write_ref(refs: DataFrame, name: str, rows: DataFrame) -> DataFrame:
    """refs with rows (REFS) in place of all that the name had: one row for HEAD and PUSHED, one a machine for REMOTE_HEADS."""
    return refs.where(F.col("name") != name).unionByName(rows.where(F.col("name") == name))


def read_ref(refs: DataFrame, name: str) -> DataFrame:
    """The rows of a ref whose head is an id; what a torn write left is no ref."""
    return refs.where((F.col("name") == name) & is_id("head"))


def save_refs(refs: DataFrame, path: str) -> int:
    """Writes refs as the next version of the log at path, and returns its number: a reader sees the old refs or the new ones, and a crash on the way changes nothing."""

    def work(change: Change) -> None:
        change.create("refs", REFS)
        change.replace("refs", refs)

    return StateLog(refs.sparkSession, path).change(work).version


def load_refs(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The refs of a version, the newest if none is named; none where nothing was saved."""
    snapshot = StateLog(spark, path).at(version)
    return snapshot.read("refs") if "refs" in snapshot.tables() else spark.createDataFrame([], REFS)


class Pending(NamedTuple):
    """A merge under way: its two heads and the paths in conflict (path, reason)."""

    ours: str
    theirs: str
    conflicts: DataFrame


class Continued(NamedTuple):
    """What going on with a merge does: with unresolved paths nothing, else files lose companions and a snapshot gets parents."""

    unresolved: DataFrame
    files: DataFrame
    parents: list[str]
    done: bool


def _without_companions(pending: Pending, files: DataFrame) -> DataFrame:
    names = [pending.conflicts.select(F.concat("path", F.lit(f".{settings.NAMESPACE}-{s}")).alias("path")) for s in ("theirs", "base")]
    return files.join(names[0].unionByName(names[1]).distinct(), "path", "left_anti")


def continue_merge(pending: Pending | None, files: DataFrame) -> Continued:
    """Whether the merge is finished over files (path). A path is settled when its companion of theirs is gone; raises where no merge is under way."""
    if pending is None:
        raise ValueError("no merge is under way")
    unresolved = merge.unresolved(pending.conflicts, files)
    if not unresolved.isEmpty():
        return Continued(unresolved, files, [], False)
    return Continued(unresolved, _without_companions(pending, files), [pending.ours, pending.theirs], True)


def abort_merge(pending: Pending | None, files: DataFrame) -> DataFrame:
    """files without the companions of a merge that is dropped; what had merged already stays. Raises where no merge is under way."""
    if pending is None:
        raise ValueError("no merge is under way")
    return _without_companions(pending, files)


class Captured(NamedTuple):
    """Carried work: its rows and the chunks of its patches."""

    carried: DataFrame
    objects: DataFrame


def capture(patches: DataFrame) -> Captured:
    """The work that patches (path, base_commit, branch, patch, changed_files, staged_files) carry, chunked like files.

    A checkout without a commit has no base to carry work on, and an empty patch carries none.
    """
    there = patches.where(F.col("base_commit").isNotNull() & (F.octet_length("patch") > 0))
    pieces = chunking.chunk(there.select("path", F.col("patch").alias("content")))
    lists = pieces.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "chunk_id"))), lambda x: x["chunk_id"]).alias("patch_chunks"))
    sized = there.select("path", "base_commit", F.coalesce("branch", F.lit("")).alias("branch"), F.octet_length("patch").cast("long").alias("patch_bytes"), "changed_files", "staged_files")  # the patches themselves stay where they are
    rows = sized.join(lists, "path").select("path", "base_commit", "branch", "patch_chunks", "patch_bytes", "changed_files", "staged_files")
    return Captured(rows, pieces.select("chunk_id", F.col("chunk").alias("content")).dropDuplicates(["chunk_id"]))


def _field(text: str) -> Column:
    """Text that stands on one line of a snapshot: tabs and line ends become spaces, null is empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[\t\r\n]", " ")


def carry_lines(carried: DataFrame) -> DataFrame:
    """path, line: carried work as fields of a snapshot's text."""
    fields = [_field("path"), F.col("base_commit"), _field("branch"), F.array_join("patch_chunks", ","), *(F.col(c).cast("string") for c in ("patch_bytes", "changed_files", "staged_files"))]
    return carried.select("path", F.concat_ws("\t", *fields).alias("line"))


def read_carry_lines(lines: DataFrame) -> DataFrame:
    """The fields of carry lines (line); raises for a line without seven."""
    f = F.split("line", "\t")
    checked = lines.withColumn("line", F.when(F.size(f) == 7, F.col("line")).otherwise(F.raise_error(F.concat(F.lit("malformed carry line: "), "line"))))
    chunks = F.when(f[3] == "", F.array().cast("array<string>")).otherwise(F.split(f[3], ","))
    return checked.select(f[0].alias("path"), f[1].alias("base_commit"), f[2].alias("branch"), chunks.alias("patch_chunks"), f[4].cast("long").alias("patch_bytes"), f[5].cast("int").alias("changed_files"), f[6].cast("int").alias("staged_files"))


def repo_lines(repos: DataFrame) -> DataFrame:
    """path, line of repository states (path, remote, branch, head, is_primary, dirty_files)."""
    fields = [_field("path"), _field("remote"), _field("branch"), _field("head"), F.when(F.col("is_primary"), "p").otherwise("w"), F.col("dirty_files").cast("string")]
    return repos.select("path", F.concat_ws("\t", *fields).alias("line"))
