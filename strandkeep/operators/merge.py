"""Three-way merge plans over file entries: which path is kept, taken, deleted, merged or in conflict."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandkeep import settings
from strandkeep.functions import structural
from strandkeep.functions.scalars import fold_ascii
from strandkeep.operators import graph

SIDES = ("base", "ours", "theirs")
KEPT = ("TakeTheirs", "Write", "KeepOurs")


def three_way(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """path with base, ours, theirs: struct(executable, chunks) or null.

    A path is unique in each side, so the three-way outer join is one aggregation of their union: every row
    moves once, where chained outer joins would move the first result again.
    """
    entry = F.struct("executable", "chunks").alias("entry")
    tagged = [df.select("path", F.lit(name).alias("side"), entry) for df, name in zip((base, ours, theirs), SIDES, strict=True)]
    return reduce(DataFrame.unionByName, tagged).groupBy("path").agg(*(F.max(F.when(F.col("side") == s, F.col("entry"))).alias(s) for s in SIDES))


def decision(base: str = "base", ours: str = "ours", theirs: str = "theirs") -> Column:
    """The action of a path; sides are the same if flag and ordered chunks are, whatever their sizes and times."""
    b, o, t = F.col(base), F.col(ours), F.col(theirs)
    has_b, has_o, has_t = b.isNotNull(), o.isNotNull(), t.isNotNull()
    return (
        F.when(~has_b & ~has_t, "KeepOurs")
        .when(~has_b & ~has_o, "TakeTheirs")
        .when(~has_b, F.when(o == t, "Unchanged").otherwise("ContentMerge"))
        .when(~has_o & ~has_t, "Delete")
        .when(~has_o, F.when(b == t, "Delete").otherwise("Conflict"))
        .when(~has_t, F.when(b == o, "Delete").otherwise("Conflict"))
        .when((b == o) & (b == t), "Unchanged")
        .when(b == t, "KeepOurs")
        .when(b == o, "TakeTheirs")
        .when(o == t, "Unchanged")
        .otherwise("ContentMerge")
    )


def plan(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """path, action."""
    return three_way(base, ours, theirs).select("path", decision().alias("action"))


def fast_forward(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """path, action of a merge whose base is ours: take what is new or different, delete what is gone."""
    o, t = (df.select("path", F.struct("executable", "chunks").alias(x)) for df, x in ((ours, "ours"), (theirs, "theirs")))
    both = o.join(t, "path", "full_outer").where("NOT (ours <=> theirs)")
    return both.select("path", F.when(F.col("theirs").isNull(), "Delete").otherwise("TakeTheirs").alias("action"))


class Outcome(NamedTuple):
    """What a merge of two snapshots comes to: its base (null without one), whether one side holds the other, the paths' actions, and repositories that differ."""

    base: str | int | None
    fast_forward: bool
    ahead: bool
    items: DataFrame
    repos: DataFrame


def compute(edges: DataFrame, entries: DataFrame, repos: DataFrame, ours, theirs) -> Outcome:
    """The merge of the snapshot theirs into ours over a history of edges (child, parent, ordinal).

    entries: snapshot_id, path, executable, chunks; repos: snapshot_id, path, branch, head. Where one side holds
    the other nothing is merged: theirs is taken, or, if we are ahead, there are no items. Without a base
    every path that both have is new on both sides.
    """
    spark = edges.sparkSession
    kind = "string" if isinstance(ours, str) else "long"
    base = graph.merge_bases(edges, spark.createDataFrame([(ours, theirs)], f"ours {kind}, theirs {kind}")).first()["base"]
    ahead, behind = base == theirs, base == ours  # the base is a side exactly if that side is the other's ancestor
    own, their, common = (entries.where(F.col("snapshot_id") == F.lit(x)).drop("snapshot_id") for x in (ours, theirs, base))
    if ahead:
        items = fast_forward(own, their).limit(0)
    else:
        items = fast_forward(own, their) if behind else plan(common, own, their)
    sides = [repos.where(F.col("snapshot_id") == F.lit(x)) for x in (ours, theirs)]
    return Outcome(base, ahead or behind, ahead, items, divergence(*sides))


def divergence(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """path, kind of repositories (path, branch, head) that differ; one that only we have is none."""
    o, t = (df.select("path", F.struct("branch", "head").alias(x)) for df, x in ((ours, "o"), (theirs, "t")))
    both = t.join(o, "path", "left")
    kind = F.when(F.col("o").isNull(), "MissingHere").when(F.col("o.branch") != F.col("t.branch"), "DifferentBranch").when(F.col("o.head") != F.col("t.head"), "DifferentHead")
    return both.select("path", kind.alias("kind")).where("kind IS NOT NULL")


def case_collisions(items: DataFrame, insensitive: bool = True) -> DataFrame:
    """The paths (of path, action) that would fall together where case doesn't tell names apart; ASCII letters fold."""
    if not insensitive:
        return items.select("path").where("false")
    there = items.where(F.col("action").isin(*KEPT)).select("path").distinct().withColumn("folded", fold_ascii("path"))
    many = there.groupBy("folded").agg(F.count("*").alias("n")).where("n > 1")
    return there.join(many, "folded", "left_semi").select("path")


_REGION = T.StructType().add("base_start", "integer").add("base", T.ArrayType(T.StringType())).add("ours", T.ArrayType(T.StringType())).add("theirs", T.ArrayType(T.StringType()))
_OUTCOME = T.StructType().add("status", "string").add("content", "binary").add("note", "string").add("reason", "string").add("regions", T.ArrayType(_REGION))


@F.pandas_udf(_OUTCOME)
def _merged(path: pd.Series, base: pd.Series, ours: pd.Series, theirs: pd.Series) -> pd.DataFrame:
    rows = []
    for name, *sides in zip(path, base, ours, theirs, strict=True):
        out = structural.merge_content(name, *(bytes(x or b"") for x in sides))
        rows.append((out.status, out.content, out.note, out.reason, [r._asdict() for r in out.regions]))
    return pd.DataFrame(rows, columns=[f.name for f in _OUTCOME])


def merge_contents(files: DataFrame) -> DataFrame:
    """files (path, base, ours, theirs as binary) with outcome; a missing side is empty. Filter to the paths to merge before joining contents."""
    return files.withColumn("outcome", _merged("path", "base", "ours", "theirs"))


def apply_plan(decided: DataFrame) -> dict[str, DataFrame]:
    """The tables that applying a plan writes: writes, deletes, companions and state.

    decided: path, action, outcome (null but for merges), theirs and base (contents, null where a side lacks the path).
    """
    merged = decided.where("action = 'ContentMerge'").withColumn("action", F.when(F.col("outcome.status") == "merged", "Write").otherwise("Conflict"))
    rest = decided.where("action <> 'ContentMerge'")
    every = rest.unionByName(merged)
    conflicts = every.where("action = 'Conflict'")
    name = settings.NAMESPACE
    sides = [conflicts.where(F.col(s).isNotNull()).select(F.concat("path", F.lit(f".{name}-{s}")).alias("path"), F.col(s).alias("content")) for s in ("theirs", "base")]
    return {
        "writes": every.where("action IN ('Write', 'TakeTheirs')").select("path", F.when(F.col("action") == "Write", F.col("outcome.content")).otherwise(F.col("theirs")).alias("content")),
        "deletes": every.where("action = 'Delete'").select("path"),
        "companions": sides[0].unionByName(sides[1]),
        "state": conflicts.select("path", F.coalesce("outcome.reason", F.lit("deleted on one side, changed on the other")).alias("reason")),
    }


def unresolved(state: DataFrame, files: DataFrame) -> DataFrame:
    """The conflicts of a saved state whose companion of theirs still exists."""
    suffix = f".{settings.NAMESPACE}-theirs"
    there = files.select(F.col("path").alias("companion"))
    return state.join(there, F.concat(state["path"], F.lit(suffix)) == there["companion"], "left_semi")


def emptied_directories(before: DataFrame, deletes: DataFrame) -> DataFrame:
    """Directories, never the root, with no file left after the deletes."""
    def above(df: DataFrame) -> DataFrame:
        parts = F.split("path", "/")
        return df.where(F.size(parts) > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda d: F.array_join(F.slice(parts, F.lit(1), d), "/"))).alias("directory")).distinct()

    return above(deletes).join(above(before.join(deletes, "path", "left_anti")), "directory", "left_anti")
