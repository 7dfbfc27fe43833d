"""The server's state in a log: every operation is one version, worked out on the rows that it concerns and done whole or not at all."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandkeep.operators import gc, server
from strandkeep.sources.state_log import Change, Done, StateLog
from strandkeep.stash import stash

#: The columns by which each table lies in buckets.
KEYS = {
    "machines": ["id"], "history": ["machine_id"], "pins": ["head"], "sessions": ["id"], "session_ids": ["session"],
    "objects": ["remote_id"], "trash": ["stamp"], "workspaces": ["workspace"],
}


def opened(spark: SparkSession, root: str, tables: dict[str, DataFrame], buckets: int = 8) -> StateLog:
    """The log at root with these tables: those it lacks are begun with their rows, those it has get the columns that they lack."""
    log = StateLog(spark, root)

    def work(change: Change) -> None:
        for name, rows in tables.items():
            new = name not in change.snapshot.tables()
            change.create(name, rows.schema, KEYS[name], buckets)
            if new:
                change.append(name, rows)

    log.change(work)
    return log


def enrol(log: StateLog, joining: DataFrame, now: Column) -> Done:
    """Machines (id, name, platform, token) enrolled, again or for the first time."""

    def work(change: Change) -> None:
        change.put_like("machines", joining, server.enrol(change.read_like("machines", joining), joining, now))

    return log.change(work)


def revoke(log: StateLog, ids: DataFrame, now: Column) -> Done:
    """Machines (id) revoked."""

    def work(change: Change) -> None:
        change.put_like("machines", ids, server.revoke(change.read_like("machines", ids), ids, now))

    return log.change(work)


def claim(log: StateLog, offers: DataFrame, order: str) -> Done:
    """offers (workspace, fingerprint and others) decided against the stored ones; a workspace's first claim is stored. Returns what claims() does, as a table."""

    def work(change: Change) -> DataFrame:
        stored = change.read_like("workspaces", offers)
        decided = stash(server.claims(stored, offers, order))
        first = decided.join(stored, "workspace", "left_anti").select("workspace", F.col("kept").alias("stored")).distinct()
        if not first.isEmpty():
            change.put_like("workspaces", offers, stored.unionByName(first))
        return decided

    return log.change(work)


def move_heads(log: StateLog, moves: DataFrame, now: Column) -> Done:
    """Heads moved (machine_id, head; one a machine)."""

    def work(change: Change) -> None:
        change.put_like("history", moves, server.move_heads(change.read_like("history", moves), moves, now))

    return log.change(work)


def commit_heads(log: StateLog, commits: DataFrame, now: Column) -> Done:
    """Commits (session, machine_id, snapshot; one a machine) decided and applied as one version; returns their outcomes.

    Sessions that end, pins, the machine's head and its history change together. Two commits of one machine or one session cannot both
    see the state before: the later is worked out again on what the earlier left.
    """

    def work(change: Change) -> DataFrame:
        by = {
            "sessions": commits.select(F.col("session").alias("id")), "session_ids": commits.select("session"), "pins": commits.select(F.col("snapshot").alias("head")),
            "machines": commits.select(F.col("machine_id").alias("id")), "history": commits.select("machine_id"),
        }
        now_ = {name: change.read_like(name, keys) for name, keys in by.items()}
        listed = now_["session_ids"].join(commits.select("session").distinct(), "session", "left_semi").select(F.col("object").alias("remote_id"))
        done = server.commit_heads(commits, **now_, objects=change.read_like("objects", listed), now=now)
        if not done.outcomes.where("outcome = 'Committed'").isEmpty():
            for name, keys in by.items():
                change.put_like(name, keys, getattr(done, name))
        return done.outcomes

    return log.change(work)


def collect(log: StateLog, now: datetime, windows: gc.Windows = gc.Windows(), apply: bool = False, there: DataFrame | None = None) -> Done:
    """The garbage collected as one version, or only reported; returns the report as a table. Whatever comes in between is seen or makes it begin again."""

    def work(change: Change) -> DataFrame:
        report, after = gc.garbage_collect(gc.State(*(change.read(name) for name in gc.State._fields)), now, windows, apply, there, held=True)
        report = stash(report)
        if report.first()["applied"]:
            for name in ("history", "pins", "sessions", "session_ids", "objects", "trash"):
                change.replace(name, getattr(after, name))
        return report

    return log.change(work)


def state(log: StateLog, version: int | None = None) -> gc.State:
    """The tables of one version."""
    snapshot = log.at(version)
    return gc.State(*(snapshot.read(name) for name in gc.State._fields))
