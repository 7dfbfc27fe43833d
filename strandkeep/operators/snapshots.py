"""Recording a snapshot of a file collection, and exchanging snapshots through a store of sealed objects."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandkeep.functions import chunking, crypto, scalars
from strandkeep.functions.scalars import is_companion
from strandkeep.operators import manifest, policy, secrets, store, workspace
from strandkeep.stash import stash


class Snapshot(NamedTuple):
    """What a snapshot writes. findings must be empty, else nothing else counts; objects are the chunks the store lacks, the manifest's among them."""

    entries: DataFrame
    objects: DataFrame
    findings: DataFrame
    snapshot: DataFrame
    changes: DataFrame
    carried: DataFrame | None = None


def create(
    files: DataFrame, known: DataFrame, rules: policy.Policy, parent: DataFrame | None, machine: tuple[str, str], now: Column, parents: list[str] = (),
    patches: DataFrame | None = None, repos: DataFrame | None = None,
) -> Snapshot:
    """A snapshot of files (path, content, modified_utc, executable) over a store (chunk_id) and the parent's entries.

    patches are uncommitted work to carry (see workspace.capture), scanned like files; repos are repository states.

    Files with something new are scanned whole before anything is stored. The chunk table is written once, as
    entries, objects and scan all read it. A file without bytes has no chunks.
    """
    kept = policy.kept(files.where(~is_companion("path")), rules)
    pieces = stash(chunking.chunk(kept.select("path", "content")))
    lists = pieces.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("position", "chunk_id"))).alias("x"))
    entries = kept.select("path", F.octet_length("content").cast("long").alias("size"), "modified_utc", "executable").join(lists, "path", "left")
    empty = F.array().cast("array<string>")
    entries = stash(entries.withColumn("chunks", F.coalesce(F.transform("x", lambda y: y["chunk_id"]), empty)).drop("x"))
    fresh = secrets.to_scan(entries.select("path", "chunks"), known)
    findings = stash(secrets.findings(kept.join(fresh.select("path"), "path", "left_semi").select("path", F.decode("content", "utf-8").alias("content"))))
    bad = findings.select("path").distinct()
    new = pieces.join(bad, "path", "left_anti").select("chunk_id", F.col("chunk").alias("content"))
    carried = None
    if patches is not None:
        found = secrets.findings(patches.select("path", F.decode("patch", "utf-8").alias("content")))
        findings = stash(findings.unionByName(found))
        taken = workspace.capture(patches.join(found.select("path").distinct(), "path", "left_anti"))
        carried, new = stash(taken.carried), new.unionByName(taken.objects)
    whole = stash(store.manifest_chunks(entries))
    listed = whole.agg(F.max("manifest_id").alias("manifest_id"), F.transform(F.array_sort(F.collect_list(F.struct("position", "chunk_id"))), lambda y: y["chunk_id"]).alias("manifest_chunks"))
    head = listed.crossJoin(manifest.totals(entries))  # one row each
    row = head.select(
        "manifest_id", "manifest_chunks", F.array(*map(F.lit, parents)).cast("array<string>").alias("parents"), F.lit(machine[0]).alias("machine_id"), F.lit(machine[1]).alias("machine_name"),
        now.alias("created_utc"), F.col("file_count").cast("int").alias("file_count"), "total_bytes",
    )
    for name, lines in (("carried", carried and workspace.carry_lines(carried)), ("repos", repos and workspace.repo_lines(repos))):
        if lines is None:
            row = row.withColumn(name, empty)
        else:  # one row; checkouts are few
            ordered = F.array_sort(F.collect_list(F.struct(scalars.ordinal("path").alias("k"), "line")))
            row = row.crossJoin(lines.agg(F.transform(ordered, lambda x: x["line"]).alias(name)))
    objects = store.put(known, new.unionByName(whole.select("chunk_id", F.col("chunk").alias("content"))))
    none = entries.limit(0) if parent is None else parent
    return Snapshot(entries, objects, findings, store.write_snapshots(row), manifest.diff(none, entries), carried)


def is_unchanged(snapshot: Snapshot, merging: bool = False, same_repos: bool = True, same_work: bool = True, carried_before: DataFrame | None = None) -> bool:
    """Whether a snapshot would say nothing new: not merging, no change, the same repositories and carried work.

    carried_before is the parent's carried work; where either snapshot has some, the two are compared by repository.
    """
    if merging or not same_repos or not same_work or not snapshot.changes.isEmpty():
        return False
    if snapshot.carried is None and carried_before is None:
        return True
    if snapshot.carried is None or carried_before is None:
        return (carried_before or snapshot.carried).isEmpty()
    one, two = (x.withColumn("all", F.lit(1)) for x in (carried_before, snapshot.carried))
    return workspace.same_carried(one, two, ["all"]).where("NOT same").isEmpty()


def to_push(reachable: DataFrame, chunks: DataFrame, objects: DataFrame, key: bytes) -> DataFrame:
    """remote_id, blob of the reachable chunks (chunk_id) that the remote store lacks. Names and blobs are deterministic, so a push can be repeated."""
    names = reachable.select("chunk_id").distinct().withColumn("remote_id", crypto.remote_id(key, "chunk_id"))
    lacking = names.join(objects.select("remote_id"), "remote_id", "left_anti")
    return lacking.join(chunks.select("chunk_id", "content"), "chunk_id").select("remote_id", crypto.seal(key, "content").alias("blob"))


def pulled(wanted: DataFrame, chunks: DataFrame, objects: DataFrame, key: bytes) -> DataFrame:
    """chunk_id, content of wanted chunks (chunk_id) not yet here, opened and verified; raises for a blob that doesn't open."""
    names = wanted.select("chunk_id").distinct().join(chunks.select("chunk_id"), "chunk_id", "left_anti").withColumn("remote_id", crypto.remote_id(key, "chunk_id"))
    opened = names.join(objects.select("remote_id", "blob"), "remote_id").withColumn("content", crypto.unseal(key, "blob", "remote_id"))
    return opened.select("chunk_id", F.coalesce("content", F.raise_error(F.concat(F.lit("a blob that does not open: "), "remote_id")).cast("binary")).alias("content"))


def heads_to_pull(heads: DataFrame, machine_id: str) -> DataFrame:
    """The heads (machine_id, head) of other machines that have one."""
    return heads.where((F.col("machine_id") != machine_id) & F.col("head").isNotNull())
