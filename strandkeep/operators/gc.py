"""Garbage collection: what is live under the retention windows, what may go, and the trash."""

from __future__ import annotations

from datetime import datetime, timedelta
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandkeep.stash import stash


class Windows(NamedTuple):
    """How long things are kept: superseded heads, fresh objects, push sessions, trash."""

    retain: timedelta = timedelta(days=14)
    grace: timedelta = timedelta(hours=24)
    session_ttl: timedelta = timedelta(hours=24)
    trash: timedelta = timedelta(days=7)


def _at(now: datetime, back: timedelta) -> Column:
    return F.lit(now - back)


def unpinned_machines(machines: DataFrame, pins: DataFrame) -> DataFrame:
    """The machines, revoked ones too, whose head has no pins: with any, collecting is refused."""
    return machines.where("head IS NOT NULL").join(pins.select("head").distinct(), "head", "left_anti")


def live_heads(machines: DataFrame, history: DataFrame, now: datetime, windows: Windows = Windows()) -> DataFrame:
    """head: current ones, and those of the history open or superseded no longer ago than retain, its edge included."""
    recent = history.where(F.col("superseded_utc").isNull() | (F.col("superseded_utc") >= _at(now, windows.retain)))
    return machines.where("head IS NOT NULL").select("head").unionByName(recent.select("head")).distinct()


def live_objects(pins: DataFrame, heads: DataFrame, sessions: DataFrame, session_ids: DataFrame, now: datetime, windows: Windows = Windows()) -> DataFrame:
    """object: those pinned for live heads, and those of sessions begun no longer ago than their time."""
    pinned = pins.join(heads, "head", "left_semi").select("object")
    young = sessions.where(F.col("created_utc") >= _at(now, windows.session_ttl)).select(F.col("id").alias("session"))
    return pinned.unionByName(session_ids.join(young, "session", "left_semi").select("object")).distinct()


def sweep(objects: DataFrame, live: DataFrame, now: datetime, windows: Windows = Windows()) -> DataFrame:
    """objects (remote_id, bytes, modified_utc) that aren't live, with young: spared because they are fresh."""
    gone = objects.join(live.select(F.col("object").alias("remote_id")), "remote_id", "left_anti")
    return gone.withColumn("young", F.col("modified_utc") >= _at(now, windows.grace))


def report(machines, history, pins, sessions, session_ids, objects, now: datetime, windows: Windows = Windows()) -> DataFrame:
    """One row: refused, live_heads, unretainable, live_objects, young, candidates, candidate_bytes. A refusal reports zeros.

    Pins and heads are written once, as several counts read them.
    """
    pins, machines = stash(pins), stash(machines)
    heads = stash(live_heads(machines, history, now, windows))
    live = stash(live_objects(pins, heads, sessions, session_ids, now, windows))
    return _counted(machines, pins, heads, live, stash(sweep(objects, live, now, windows)))


def _counted(machines: DataFrame, pins: DataFrame, heads: DataFrame, live: DataFrame, swept: DataFrame) -> DataFrame:
    pinned = pins.select("head").distinct()
    parts = [
        machines.where("head IS NOT NULL").join(pinned, "head", "left_anti").agg((F.count("*") > 0).alias("refused")),
        heads.join(pinned.withColumn("pinned", F.lit(True)), "head", "left").agg(F.count("*").alias("live_heads"), F.count_if(F.col("pinned").isNull()).alias("unretainable")),
        live.agg(F.count("*").alias("live_objects")),
        swept.agg(
            F.count_if("young").alias("young"), F.count_if(~F.col("young")).alias("candidates"),
            F.coalesce(F.sum(F.when(~F.col("young"), F.col("bytes"))), F.lit(0)).cast("long").alias("candidate_bytes"),
        ),
    ]
    out = parts[0]
    for part in parts[1:]:  # one row each
        out = out.crossJoin(part)
    counts = ("live_heads", "unretainable", "live_objects", "young", "candidates", "candidate_bytes")
    return out.select("refused", *(F.when(F.col("refused"), 0).otherwise(F.col(c)).cast("long").alias(c) for c in counts))


class State(NamedTuple):
    """What a collection reads and writes; objects: remote_id, bytes, modified_utc; trash: stamp, remote_id."""

    machines: DataFrame
    history: DataFrame
    pins: DataFrame
    sessions: DataFrame
    session_ids: DataFrame
    objects: DataFrame
    trash: DataFrame


def garbage_collect(state: State, now: datetime, windows: Windows = Windows(), apply: bool = False, there: DataFrame | None = None, held: bool = False) -> tuple[DataFrame, State]:
    """(report, state after). The report adds applied, stamp (null if nothing moved) and purged_stamps.

    A refusal and a dry run change nothing, the trash included. On apply, candidates counts what was moved, of
    those still there (remote_id) at the time of moving, while candidate_bytes stays that of all that were marked.
    held: the state stands in tables already, so that machines and pins need no copy.
    """
    machines, pins = (state.machines, state.pins) if held else (stash(state.machines), stash(state.pins))
    heads = stash(live_heads(machines, state.history, now, windows))
    live = stash(live_objects(pins, heads, state.sessions, state.session_ids, now, windows))
    swept = stash(sweep(state.objects, live, now, windows))
    found = stash(_counted(machines, pins, heads, live, swept))
    if not apply or found.first()["refused"]:
        return found.select("*", F.lit(False).alias("applied"), F.lit(None).cast("string").alias("stamp"), F.lit(0).cast("long").alias("purged_stamps")), state
    if there is not None:
        swept = swept.join(there.select("remote_id").distinct(), "remote_id", "left_semi")
    stamp = now.strftime("%Y%m%dT%H%M%SZ")
    objects, trash = collect(state.objects, swept, state.trash, stamp)
    trash = stash(trash)
    mine = trash.join(state.trash.select("stamp").distinct(), "stamp", "left_anti")
    left = purge(trash, now, windows)
    purged = trash.select("stamp").distinct().join(left.select("stamp").distinct(), "stamp", "left_anti").agg(F.count("*").alias("purged_stamps"))
    moved = mine.agg(F.count("*").alias("moved"), F.max("stamp").alias("stamp"))
    out = found.crossJoin(moved).crossJoin(purged).withColumn("candidates", F.col("moved")).withColumn("applied", F.lit(True))  # one row each
    history, pins, sessions, ids = forget(state.history, pins, state.sessions, state.session_ids, heads, now, windows)
    return out.select(*found.columns, "applied", "stamp", "purged_stamps"), State(state.machines, history, pins, sessions, ids, objects, left)


def collect(objects: DataFrame, swept: DataFrame, trash: DataFrame, stamp: str) -> tuple[DataFrame, DataFrame]:
    """(objects, trash) after the candidates moved to the trash under a stamp; a taken stamp gets -2, -3 and on."""
    moved = swept.where("NOT young").select("remote_id")
    taken = {r["stamp"] for r in trash.where(F.startswith("stamp", F.lit(stamp))).select("stamp").distinct().collect()}
    name, k = stamp, 1
    while name in taken:
        k += 1
        name = f"{stamp}-{k}"
    return objects.join(moved, "remote_id", "left_anti"), trash.unionByName(moved.select(F.lit(name).alias("stamp"), "remote_id"))


def purge(trash: DataFrame, now: datetime, windows: Windows = Windows()) -> DataFrame:
    """The trash without stamps older than its window, the edge kept; names that are no stamps stay."""
    at = F.try_to_timestamp(F.substring("stamp", 1, 16), F.lit("yyyyMMdd'T'HHmmss'Z'"))
    return trash.where(~F.coalesce(at < _at(now, windows.trash), F.lit(False)))


def forget(history: DataFrame, pins: DataFrame, sessions: DataFrame, session_ids: DataFrame, heads: DataFrame, now: datetime, windows: Windows = Windows()):
    """(history, pins, sessions, session_ids) after the clean-up: rows of heads and sessions that are no longer live go."""
    old = F.col("superseded_utc").isNotNull() & (F.col("superseded_utc") < _at(now, windows.retain))
    kept = sessions.where(F.col("created_utc") >= _at(now, windows.session_ttl))
    return history.where(~old), pins.join(heads, "head", "left_semi"), kept, session_ids.join(kept.select(F.col("id").alias("session")), "session", "left_semi")
