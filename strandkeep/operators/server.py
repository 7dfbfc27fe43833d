"""The server's state as tables: machines, heads with their history, pins, push sessions and objects."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandkeep.functions.scalars import token_hash
from strandkeep.stash import stash


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """table with rows in place of those that share their key; of rows alone, one for each key."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)


def enrol(machines: DataFrame, joining: DataFrame, now: Column) -> DataFrame:
    """machines after joining (id, name, platform, token): a new token hash, no revocation, the head and first enrolment kept."""
    old = machines.select("id", F.col("head").alias("h"), F.col("head_updated_utc").alias("u"))
    fresh = joining.join(old, "id", "left").select(
        "id", "name", "platform", token_hash("token").alias("token_hash"), now.alias("enrolled_utc"), now.alias("last_seen_utc"),
        F.col("h").alias("head"), F.col("u").alias("head_updated_utc"), F.lit(None).cast("timestamp").alias("revoked_utc"),
    )
    return upsert(machines, fresh, "id")


def authenticate(machines: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (request, token) with machine_id of the machine that holds the token and isn't revoked, else null."""
    live = machines.where("revoked_utc IS NULL").select("token_hash", F.col("id").alias("machine_id"))
    return requests.withColumn("token_hash", token_hash("token")).join(live, "token_hash", "left").drop("token_hash", "token")


def seen(machines: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """machines with last_seen_utc moved for ids."""
    hit = ids.select("id").distinct().withColumn("__hit", F.lit(True))
    return machines.join(hit, "id", "left").withColumn("last_seen_utc", F.when(F.col("__hit"), now).otherwise(F.col("last_seen_utc"))).drop("__hit")


def revoke(machines: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """machines with ids revoked: the token hash becomes one that no token has, row and head stay; revoked ones aren't touched again."""
    hit = ids.select("id").distinct().withColumn("__hit", F.lit(True))
    out = machines.join(hit, "id", "left").withColumn("__now", F.col("__hit") & F.col("revoked_utc").isNull())
    dead = F.sha2(F.concat(F.lit("revoked/"), F.uuid()), 256)
    out = out.withColumns({"token_hash": F.when(F.col("__now"), dead).otherwise(F.col("token_hash")), "revoked_utc": F.when(F.col("__now"), now).otherwise(F.col("revoked_utc"))})
    return out.drop("__hit", "__now")


def claim_or_match(stored: str | None, offered: str) -> tuple[bool, str]:
    """Whether a workspace fingerprint is accepted, and the one to keep: the first claims."""
    return stored in (None, offered), stored or offered


def claims(stored: DataFrame, offers: DataFrame, order: str) -> DataFrame:
    """offers (workspace, fingerprint and others) with kept, the fingerprint that its workspace keeps, and accepted: the stored one (workspace, stored), or, where none is, the first offered by order."""
    first = offers.groupBy("workspace").agg(F.min_by("fingerprint", order).alias("__first"))
    both = offers.join(first, "workspace").join(stored, "workspace", "left")
    kept = F.coalesce("stored", "__first")
    return both.withColumn("kept", kept).withColumn("accepted", F.col("fingerprint") == kept).drop("__first", "stored")


def head_history(moves: DataFrame) -> DataFrame:
    """machine_id, head, set_utc, superseded_utc of head moves (machine_id, head, moved_utc, seq); a move to the same head changes nothing."""
    order = Window.partitionBy("machine_id").orderBy("moved_utc", "seq")
    changed = moves.withColumn("before", F.lag("head").over(order)).where("before IS NULL OR before <> head")
    return changed.select("machine_id", "head", F.col("moved_utc").alias("set_utc"), F.lead("moved_utc").over(order).alias("superseded_utc"))


def move_heads(history: DataFrame, moves: DataFrame, now: Column) -> DataFrame:
    """history after moves (machine_id, head; one a machine): the open row of another head is closed, the new head is opened; same heads are left alone."""
    new = moves.select("machine_id", F.col("head").alias("__new"))
    joined = history.join(new, "machine_id", "left")
    closing = F.col("superseded_utc").isNull() & F.col("__new").isNotNull() & (F.col("__new") != F.col("head"))
    closed = joined.withColumn("superseded_utc", F.when(closing, now).otherwise(F.col("superseded_utc"))).drop("__new")
    open_ = history.where("superseded_utc IS NULL").select("machine_id", "head")
    opened = moves.select("machine_id", "head").join(open_, ["machine_id", "head"], "left_anti")
    return closed.unionByName(opened.select("machine_id", "head", now.alias("set_utc"), F.lit(None).cast("timestamp").alias("superseded_utc")))


def begin_push(sessions: DataFrame, session: str, machine_id: str, now: Column) -> DataFrame:
    one = sessions.sparkSession.range(1).select(F.lit(session).alias("id"), F.lit(machine_id).alias("machine_id"), now.alias("created_utc"))
    return sessions.unionByName(one)


def missing(asked: DataFrame, objects: DataFrame, key: str = "remote_id") -> DataFrame:
    """The asked rows, order and repeats kept, whose object the store lacks."""
    return asked.join(objects.select(key), key, "left_anti")


def touch(objects: DataFrame, asked: DataFrame, now: Column) -> DataFrame:
    """objects with modified_utc moved for those asked about."""
    hit = asked.select("remote_id").distinct().withColumn("__hit", F.lit(True))
    return objects.join(hit, "remote_id", "left").withColumn("modified_utc", F.when(F.col("__hit"), now).otherwise(F.col("modified_utc"))).drop("__hit")


def insert_or_ignore(table: DataFrame, rows: DataFrame) -> DataFrame:
    """table and those of rows that it lacks, each once; rows with equal columns are one."""
    return table.unionByName(rows.select(table.columns)).distinct()


def with_pinned(machines: DataFrame, pins: DataFrame) -> DataFrame:
    """machines with pinned: whether any pin stands for the head."""
    heads = pins.select(F.col("head").alias("__head")).distinct()
    joined = machines.join(heads, machines["head"] == heads["__head"], "left")
    return joined.withColumn("pinned", F.col("__head").isNotNull()).drop("__head")


def add_to_session(sessions: DataFrame, session_ids: DataFrame, objects: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(session_ids after, missing) of asked (session, machine_id, remote_id): ids of sessions the machine doesn't own are left out."""
    own = asked.join(sessions.select(F.col("id").alias("session"), "machine_id"), ["session", "machine_id"], "left_semi")
    ids = own.select("session", F.col("remote_id").alias("object"))
    return insert_or_ignore(session_ids, ids), missing(own.select("session", "remote_id"), objects)


def commit_outcomes(commits: DataFrame, sessions: DataFrame, session_ids: DataFrame, objects: DataFrame) -> DataFrame:
    """commits (session, machine_id, snapshot) with outcome: NoSuchSession, SnapshotNotInSession, ObjectsMissing or Committed, in this order, and n_missing."""
    own = sessions.select(F.col("id").alias("session"), "machine_id", F.lit(True).alias("known"))
    listed = session_ids.select("session", F.col("object").alias("snapshot"), F.lit(True).alias("listed")).distinct()
    gaps = session_ids.join(objects.select(F.col("remote_id").alias("object")), "object", "left_anti").groupBy("session").agg(F.count("*").alias("gaps"))
    joined = commits.join(own, ["session", "machine_id"], "left").join(listed, ["session", "snapshot"], "left").join(gaps, "session", "left")
    outcome = F.when(F.col("known").isNull(), "NoSuchSession").when(F.col("listed").isNull(), "SnapshotNotInSession").when(F.col("gaps") > 0, "ObjectsMissing").otherwise("Committed")
    out = joined.withColumn("outcome", outcome)
    n = F.when(F.col("outcome") == "ObjectsMissing", F.col("gaps")).otherwise(0).cast("long")
    return out.select("session", "machine_id", "snapshot", "outcome", n.alias("n_missing"))


class Committed(NamedTuple):
    """The state after commits: their outcomes, and the tables that the committed ones changed."""

    outcomes: DataFrame
    machines: DataFrame
    history: DataFrame
    pins: DataFrame
    sessions: DataFrame
    session_ids: DataFrame


def commit_heads(commits: DataFrame, machines: DataFrame, history: DataFrame, pins: DataFrame, sessions: DataFrame, session_ids: DataFrame, objects: DataFrame, now: Column) -> Committed:
    """Commits (session, machine_id, snapshot; one a machine) applied: what is committed pins its session's objects to the new head, moves the machine's head and ends the session; the rest changes nothing."""
    outcomes = stash(commit_outcomes(commits, sessions, session_ids, objects))
    done = outcomes.where("outcome = 'Committed'").select("session", "machine_id", "snapshot")
    pinned = session_ids.join(done.select("session", F.col("snapshot").alias("head")), "session").select("head", "object")
    moves = done.select("machine_id", F.col("snapshot").alias("head"))
    moved = machines.join(moves.select(F.col("machine_id").alias("id"), F.col("head").alias("__head")), "id", "left")
    moved = moved.withColumn("head", F.coalesce("__head", "head")).select(machines.columns)
    ended = done.select(F.col("session").alias("id"))
    return Committed(
        outcomes, moved, move_heads(history, moves, now), insert_or_ignore(pins, pinned.select(pins.columns)),
        sessions.join(ended, "id", "left_anti"), session_ids.join(ended.withColumnRenamed("id", "session"), "session", "left_anti"),
    )


def migrate(table: DataFrame | None, spark: SparkSession, schema: str) -> DataFrame:
    """A state table in the form of schema: an empty one where there is none, columns that it lacks added as null; columns and rows that it has stay."""
    want = spark.createDataFrame([], schema)
    if table is None:
        return want
    return table.withColumns({f.name: F.lit(None).cast(f.dataType) for f in want.schema if f.name not in table.columns})


def resolve_head(heads: DataFrame, name: str) -> DataFrame:
    """The one head of that machine name, whatever its case; raises if there is none or several."""
    found = heads.where(F.lower("machine_name") == name.lower()).limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"{'no' if not found else 'more than one'} machine is named {name!r}")
    return heads.where(F.lower("machine_name") == name.lower())


def attention(conflicts: DataFrame, checkouts: DataFrame, heads: DataFrame) -> DataFrame:
    """rank, kind, subject of what wants attention: conflicts, work only here, volatile places, heads not pushed, external checkouts.

    checkouts: path, dirty_files, carried, volatile, external. heads: head, pushed.
    """
    parts = [
        conflicts.select(F.lit(0).alias("rank"), F.lit("conflict").alias("kind"), F.col("path").alias("subject")),
        checkouts.where("dirty_files > 0 AND NOT carried").select(F.lit(1).alias("rank"), F.lit("only_here").alias("kind"), F.col("path").alias("subject")),
        checkouts.where("volatile").select(F.lit(2).alias("rank"), F.lit("volatile").alias("kind"), F.col("path").alias("subject")),
        heads.where("NOT pushed").select(F.lit(3).alias("rank"), F.lit("not_pushed").alias("kind"), F.col("head").alias("subject")),
        checkouts.where("external").select(F.lit(4).alias("rank"), F.lit("external").alias("kind"), F.col("path").alias("subject")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.orderBy("rank", "subject")
