"""Objects as files of a mounted folder that all executors share: one file an object, below a folder named by the first digits of its id."""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Digits of the id that name its folder.
SHARD = 2


def mounted(root: str) -> str:
    """The plain path of a mounted folder; raises for what no task could open."""
    if "://" in root and not root.startswith("file:///"):
        raise ValueError(f"{root} is no mounted folder")
    return "/" + root.removeprefix("file:").lstrip("/") if root.startswith("file:") else root


def place(root: str, chunk_id: str) -> str:
    return os.path.join(root, chunk_id[:SHARD], chunk_id[SHARD:])


def _safe(chunk_id: str) -> str:
    if len(chunk_id) != 64 or set(chunk_id) - set("0123456789abcdef"):
        raise ValueError(f"not an object id: {chunk_id!r}")
    return chunk_id


def put_file(path: str, content: bytes) -> bool:
    """Creates a file whole; whether it was this call that did. The file system links one writer's file under the name and refuses the others."""
    if os.path.exists(path):
        return False
    folder = os.path.dirname(path)
    os.makedirs(folder, exist_ok=True)
    beside = os.path.join(folder, f".{uuid.uuid4().hex}")
    try:
        with open(beside, "wb") as file:
            file.write(content)
            file.flush()
            os.fsync(file.fileno())
        os.link(beside, path)
    except FileExistsError:
        return False
    finally:
        if os.path.exists(beside):
            os.unlink(beside)
    return True


def write(objects: DataFrame, root: str) -> DataFrame:
    """chunk_id, bytes, created of objects (chunk_id, content): every object stands in the folder afterwards, created says which row put it there.

    Rows may repeat, within a task and between tasks, and tasks may run twice: a file is created once and never changed, and
    none is seen before it is whole. What a killed task leaves has a dot in front and is never listed.
    """
    top = mounted(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, created = batch["chunk_id"], [], []
            for chunk_id, content in zip(ids.to_pylist(), batch["content"]):
                data = content.as_py() or b""
                sizes.append(len(data))
                created.append(put_file(place(top, _safe(chunk_id)), data))
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(created, pa.bool_())], names=["chunk_id", "bytes", "created"])

    return objects.select("chunk_id", "content").mapInArrow(run, "chunk_id string, bytes long, created boolean")


def read(ids: DataFrame, root: str, verified: bool = True) -> DataFrame:
    """ids (chunk_id) with content, null where there is no such object; only the files asked for are opened. A content whose hash is not its id raises unless verified is off."""
    top = mounted(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, chunk_id in enumerate(batch["chunk_id"].to_pylist()):  # one at a time: contents are large
                try:
                    with open(place(top, _safe(chunk_id)), "rb") as file:
                        content = file.read()
                except FileNotFoundError:
                    content = None
                if verified and content is not None and hashlib.sha256(content).hexdigest() != chunk_id:
                    raise ValueError(f"corrupt object {chunk_id}")
                yield pa.RecordBatch.from_arrays([batch["chunk_id"].slice(k, 1), pa.array([content], pa.binary())], names=["chunk_id", "content"])

    return ids.select("chunk_id").mapInArrow(run, "chunk_id string, content binary")


def listed(spark: SparkSession, root: str, shards: list[str] | None = None) -> DataFrame:
    """chunk_id, bytes, modified_utc of the objects, a task a folder; shards names those to look into, all without it."""
    top = mounted(root)
    names = shards if shards is not None else [f"{k:0{SHARD}x}" for k in range(16**SHARD)]
    rows = spark.createDataFrame([(x,) for x in names], "shard string").repartition(max(1, min(len(names), 64)), "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch["shard"].to_pylist():
                found = []
                if os.path.isdir(os.path.join(top, shard)):
                    with os.scandir(os.path.join(top, shard)) as entries:
                        found = [(shard + e.name, e.stat().st_size, int(e.stat().st_mtime * 1e6)) for e in entries if not e.name.startswith(".")]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate((pa.string(), pa.int64(), pa.timestamp("us", tz="UTC")))], names=["chunk_id", "bytes", "modified_utc"])

    return rows.mapInArrow(run, "chunk_id string, bytes long, modified_utc timestamp")


def quarantine(candidates: DataFrame, root: str, stamp: str) -> DataFrame:
    """chunk_id, moved of candidates (chunk_id) moved below trash/stamp, each by one rename; not moved is what was gone. A task that runs again finds its files moved already and says so."""
    top = mounted(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            moved = []
            for chunk_id in batch["chunk_id"].to_pylist():
                there = place(os.path.join(top, "trash", stamp), _safe(chunk_id))
                os.makedirs(os.path.dirname(there), exist_ok=True)
                try:
                    os.rename(place(top, chunk_id), there)
                except FileNotFoundError:
                    pass
                moved.append(os.path.exists(there))
            yield pa.RecordBatch.from_arrays([batch["chunk_id"], pa.array(moved, pa.bool_())], names=["chunk_id", "moved"])

    return candidates.select("chunk_id").mapInArrow(run, "chunk_id string, moved boolean")
