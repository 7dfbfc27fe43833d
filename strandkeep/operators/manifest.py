"""Manifest algebra: differences and reachability over tables of file entries."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, change (added, changed, removed); size and time alone are no change.

    One hash exchange of each side on path; chunk lists are compared in place.
    """
    b, a = (x.select("path", "executable", "chunks", F.lit(True).alias("there")) for x in (before, after))
    both = b.alias("b").join(a.alias("a"), "path", "full_outer")
    change = (
        F.when(F.col("b.there").isNull(), "added")
        .when(F.col("a.there").isNull(), "removed")
        .when(~F.col("a.executable").eqNullSafe(F.col("b.executable")) | ~F.col("a.chunks").eqNullSafe(F.col("b.chunks")), "changed")
    )
    return both.select("path", change.alias("change")).where("change IS NOT NULL")


def new_chunks(before: DataFrame, after: DataFrame) -> DataFrame:
    """chunk_id: the different chunks of after that before lacks."""
    b, a = (x.select(F.explode("chunks").alias("chunk_id")) for x in (before, after))
    return a.distinct().join(b, "chunk_id", "left_anti")


def reachable(snapshots: DataFrame, files: DataFrame, work: DataFrame) -> DataFrame:
    """snapshot_id, object: each snapshot with its manifest's, files' and carried work's chunks; parents are not followed."""
    parts = [
        snapshots.select("snapshot_id", F.col("snapshot_id").alias("object")),
        snapshots.select("snapshot_id", F.explode("manifest_chunks").alias("object")),
        files.select("snapshot_id", F.explode("chunks").alias("object")),
        work.select("snapshot_id", F.explode("patch_chunks").alias("object")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).distinct()


def totals(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count("*").alias("file_count"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total_bytes"))


def diff_counts(changes: DataFrame) -> DataFrame:
    """added, changed, removed, is_empty of a diff."""
    counts = [F.count_if(F.col("change") == k).alias(k) for k in ("added", "changed", "removed")]
    return changes.agg(*counts, (F.count("*") == 0).alias("is_empty"))
