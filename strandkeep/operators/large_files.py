"""Chunking files of any size: byte ranges are cut on their own and stitched to the very cuts of the whole file.

A range carries, behind its own bytes, as many of the next one's as a chunk can have, so every chunk that starts in
it can be cut from it. Where its first chunk starts, its entry, is known only when the ranges before it are cut. So
each range first works out the exit (the next range's entry) for every entry there can be; chains from different entries meet
after a few chunks, as content decides the cuts, and most ranges have one exit whatever the entry. A fold over these
tables gives every range its entry, and then all ranges are cut at once.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from strandkeep.functions import chunking
from strandkeep.functions.chunking import AVG_SIZE, MASK_LARGE, MASK_SMALL, MAX_SIZE, MIN_SIZE, REACH
from strandkeep.sources.object_files import mounted
from strandkeep.stash import stash

#: Bytes of a range on disk and of one put together from rows.
SPLIT, ROW_SPLIT = 64 << 20, 16 << 20
#: Tasks at most to read the ranges of a tree.
TASKS = 20_000
#: Ranges up to which their entries, some ten bytes each, are sent to the contents; beyond, contents are shuffled to them.
SENT = 1_000_000
#: Bytes whose fingerprints are held at a time.
_STEP = 1 << 17


class Ranges(NamedTuple):
    """file, at (number of the range), offset, length (its own bytes), last, and either content (with what follows) or the folder to read it from, in so many tasks."""

    rows: DataFrame
    top: str | None = None
    tasks: int = 0

    def dealt(self, rows: DataFrame) -> DataFrame:
        """rows dealt evenly to tasks: places on disk are a few bytes each, and would be taken for little work."""
        return rows.repartition(self.tasks) if self.tasks else rows


def of_tree(files: DataFrame, root: str, split: int = SPLIT) -> Ranges:
    """The ranges of files (path, size) of a mounted tree; tasks open them and read no more than a range. Empty files have none."""
    starts = F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / split).cast("int") - 1))
    rows = files.where("size > 0").select(F.col("path").alias("file"), "size", starts.alias("at"))
    offset = F.col("at").cast("long") * split
    rows = rows.withColumn("offset", offset).withColumn("length", F.least(F.lit(split), F.col("size") - offset))
    rows = stash(rows.select("file", "at", "offset", "length", (F.col("offset") + F.col("length") == F.col("size")).alias("last")))
    return Ranges(rows, mounted(root), min(TASKS, max(1, rows.count())))


def offsets(pieces: DataFrame) -> DataFrame:
    """pieces (file, order, content and others) with offset, where each stands in its file when pieces are put end to end by order; pieces of no file are left out.

    Sums run within ranges of (file, order) and then over the ranges, so a file of very many pieces is no task's alone. Contents are
    shuffled and written once; what is returned reads that table.
    """
    n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at = None, 0
        for batch in batches:
            inside = []
            for file, size in zip(batch["file"].to_pylist(), batch["__bytes"].to_pylist(), strict=True):
                own, at = file, at if file == own else 0
                inside.append(at)
                at += size
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(inside, pa.int64())], names=[*batch.schema.names, "__inside"])

    length = F.coalesce(F.octet_length("content"), F.lit(0)).cast("long")
    ordered = pieces.where("file IS NOT NULL").repartitionByRange(n, "file", "order").withColumns({"__part": F.spark_partition_id(), "__bytes": length}).sortWithinPartitions("file", "order")
    held = stash(ordered.mapInArrow(summed, StructType([*ordered.schema, StructField("__inside", LongType())])))
    sums = held.groupBy("file", "__part").agg(F.sum("__bytes").alias("__sum"))
    before = F.sum("__sum").over(Window.partitionBy("file").orderBy("__part")) - F.col("__sum")
    # only the first file of a partition can have begun before it: a row a partition at most
    begun = stash(sums.select("file", "__part", before.alias("__before")).where("__before > 0"))
    out = held.join(F.broadcast(begun), ["file", "__part"], "left").withColumn("offset", F.coalesce("__before", F.lit(0)) + F.col("__inside"))
    return out.select(*pieces.columns, "offset")


def of_pieces(placed: DataFrame, split: int = ROW_SPLIT) -> Ranges:
    """The ranges of files that stand as rows file, offset, content (see offsets), in any order; null and empty pieces add nothing."""
    size = F.octet_length("content").cast("long")
    cut = placed.where(size > 0).withColumn("end", F.col("offset") + size)
    first, final = F.greatest(F.lit(0), F.floor((F.col("offset") - MAX_SIZE) / split)), F.floor((F.col("end") - 1) / split)
    cut = cut.withColumn("at", F.explode(F.sequence(first.cast("int"), final.cast("int")))).withColumn("start", F.col("at").cast("long") * split)
    low, high = F.greatest("offset", "start"), F.least(F.col("end"), F.col("start") + split + MAX_SIZE)
    part = F.substring(F.col("content"), (low - F.col("offset") + 1).cast("int"), (high - low).cast("int"))
    cut = cut.where(high > low).select("file", "at", low.alias("low"), part.alias("part"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def whole():
            content = b"".join(held)
            own = min(split, len(content))
            return pa.record_batch([pa.array([key[0]], pa.string()), pa.array([key[1]], pa.int32()), pa.array([key[1] * split], pa.int64()), pa.array([own], pa.int64()), pa.array([len(content) <= split]), pa.array([content], pa.binary())], ["file", "at", "offset", "length", "last", "content"])

        for batch in batches:
            for file, at, part in zip(*(batch[c].to_pylist() for c in ("file", "at", "part")), strict=True):
                if (file, at) != key:
                    if key is not None:
                        yield whole()
                    key, held = (file, at), []
                held.append(part)
        if key is not None:
            yield whole()

    ordered = cut.repartition("file", "at").sortWithinPartitions("file", "at", "low").select("file", "at", "part")
    return Ranges(stash(ordered.mapInArrow(joined, "file string, at int, offset long, length long, last boolean, content binary")))


def _content(batch: pa.RecordBatch, k: int, top: str | None) -> bytes:
    if top is None:
        return batch["content"][k].as_py()
    with open(os.path.join(top, batch["file"][k].as_py()), "rb") as file:
        file.seek(batch["offset"][k].as_py())
        return file.read(batch["length"][k].as_py() + MAX_SIZE)


def _fingerprints(values: np.ndarray) -> np.ndarray:
    """The rolling fingerprint at each place of the last axis, by doubling the bytes that it holds."""
    out, held = values, 1
    while held < 64:
        doubled = out.copy()
        doubled[..., held:] += out[..., :-held] << np.uint64(held)
        out, held = doubled, 2 * held
    return out


class Cutter:
    """Where chunks that start in one range end."""

    def __init__(self, content: bytes):
        self.values = chunking.gear()
        self.data = np.frombuffer(content, np.uint8)
        self.n = len(content)
        small, large = [], []
        for at in range(0, self.n, _STEP):
            front = max(0, at - 63)
            marks = _fingerprints(self.values[self.data[front : at + _STEP]])[at - front :]
            small.append(np.flatnonzero((marks & np.uint64(MASK_SMALL)) == 0) + at)
            large.append(np.flatnonzero((marks & np.uint64(MASK_LARGE)) == 0) + at)
        self.small, self.large = (np.append(np.concatenate([*x, np.empty(0, np.int64)]), np.iinfo(np.int64).max) for x in (small, large))

    def ends(self, starts: np.ndarray) -> np.ndarray:
        """The end of the chunk at each of starts, by the rule of chunking.cuts."""
        first, last = starts + MIN_SIZE, np.minimum(self.n, starts + MAX_SIZE)
        turn = np.minimum(last, starts + AVG_SIZE)
        early = first[:, None] + np.arange(REACH - 1)  # places where the fingerprint does not hold REACH bytes yet
        marks = _fingerprints(self.values[self.data[np.minimum(early, self.n - 1)]])
        hit = ((marks & np.uint64(MASK_SMALL)) == 0) & (early < turn[:, None])
        out = np.where(hit.any(axis=1), early[np.arange(len(starts)), hit.argmax(axis=1)], -1)
        full = first + REACH - 1
        small = self.small[np.searchsorted(self.small, full)]
        out = np.where((out < 0) & (small < turn), small, out)
        large = self.large[np.searchsorted(self.large, np.maximum(full, turn))]
        out = np.where((out < 0) & (large < last), large, out)
        return np.where(self.n - starts <= MIN_SIZE, self.n, np.where(out < 0, last, out))


    def run_end(self, start: int) -> int:
        """Where the run of one byte value that holds start ends."""
        at, value = start, self.data[start]
        while at < self.n:
            other = np.flatnonzero(self.data[at : at + _STEP] != value)
            if len(other):
                return at + int(other[0])
            at += _STEP
        return self.n


def exits(content: bytes, length: int, entries: int = MAX_SIZE) -> np.ndarray:
    """For each entry below entries the place, from the range's end, where the first chunk beyond its length bytes starts.

    The chains of all entries move on together, a greatest chunk's length at a time, and those that stop at one place are one from
    there on. In a run of one byte value all chunks are alike, so chains go through it in one step.
    """
    cutter = Cutter(content)
    chains, at = np.arange(entries), np.arange(entries)  # the chain of each entry, and the place each chain has got to, in order

    def moved(to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        places, same = np.unique(to, return_inverse=True)
        return places, same[chains]

    while at[0] < length:
        if len(at) > 1:
            like = int(min(cutter.run_end(int(at[0])) - MAX_SIZE + 1, length))  # chunks that start below that lie in the run
            if like > at[0]:
                step = int(cutter.ends(at[:1])[0] - at[0])
                at, chains = moved(at + np.maximum(0, -(-(like - at) // step)) * step)
                continue
        target = min(length, at[0] + MAX_SIZE)
        while at[0] < target:
            behind = np.searchsorted(at, target)
            to = np.concatenate([cutter.ends(at[:behind]), at[behind:]])
            at, chains = moved(to) if len(at) > 1 else (to, chains)
    return at[chains] - length


def entries_of(ranges: Ranges) -> DataFrame:
    """file, at, entry: where in each range its first chunk starts; beyond its own bytes if none does."""
    top = ranges.top

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                length, last, at = batch["length"][k].as_py(), batch["last"][k].as_py(), batch["at"][k].as_py()
                found = np.zeros(1, np.uint16) if last else exits(_content(batch, k, top), length, MAX_SIZE if at else 1).astype(np.uint16)
                found = found[:1] if (found == found[0]).all() else found
                yield pa.record_batch([*(batch.column(c).slice(k, 1) for c in ("file", "at")), pa.array([zlib.compress(found.tobytes(), 1)], pa.binary())], ["file", "at", "exits"])

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, entry = None, 0
        for batch in batches:
            out = []
            for file, packed in zip(batch["file"].to_pylist(), batch["exits"].to_pylist(), strict=True):
                own, entry = file, entry if file == own else 0
                out.append(entry)
                found = np.frombuffer(zlib.decompress(packed), np.uint16)
                entry = int(found[entry if len(found) > 1 else 0])
            yield pa.record_batch([batch["file"], batch["at"], pa.array(out, pa.int64())], ["file", "at", "entry"])

    made = ranges.dealt(ranges.rows).mapInArrow(tables, "file string, at int, exits binary")
    return made.repartition("file").sortWithinPartitions("file", "at").mapInArrow(folded, "file string, at int, entry long")


def chunk_ranges(ranges: Ranges, with_chunks: bool = True) -> DataFrame:
    """file, offset, length, chunk_id and, unless with_chunks is off, chunk of all chunks of the files: those of chunking.cuts over each file as a whole.

    Bytes are read twice. What passes through one task for a file is 10 bytes a range, or some part of 128 KB for a range whose exits
    depend on its entry (long runs of one byte or of a short period), never content.
    """
    top = ranges.top

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                at, length, offset, file = batch["entry"][k].as_py(), batch["length"][k].as_py(), batch["offset"][k].as_py(), batch["file"][k].as_py()
                if at >= length:
                    continue
                content = _content(batch, k, top)
                cutter, rows, held = Cutter(content), [], 0
                while at < length:
                    end = int(cutter.ends(np.array([at]))[0])
                    rows.append((at, end))
                    held += end - at
                    if held > 4 << 20 or end >= length:
                        pieces = [content[a:b] for a, b in rows]
                        columns = [pa.array([file] * len(rows), pa.string()), pa.array([offset + a for a, _ in rows], pa.int64()), pa.array([b - a for a, b in rows], pa.int32()), pa.array([hashlib.sha256(p).hexdigest() for p in pieces], pa.string())]
                        yield pa.record_batch(columns + [pa.array(pieces, pa.binary())] * with_chunks, ["file", "offset", "length", "chunk_id", *["chunk"] * with_chunks])
                        rows, held = [], 0
                    at = end

    schema = "file string, offset long, length int, chunk_id string" + ", chunk binary" * with_chunks
    entries = stash(entries_of(ranges))
    entries = F.broadcast(entries) if entries.count() <= SENT else entries
    return ranges.dealt(ranges.rows.join(entries, ["file", "at"])).mapInArrow(cut, schema)
