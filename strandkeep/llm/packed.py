"""Finding equal hashes over a whole corpus, with the hashes packed many to a row.

Hashes are dealt to buckets. They travel first once per batch, pre-aggregated, to find those that several
documents have; then with their places, in salted parts, past the bucket's result, which stands first in
each sorted part. A part is streamed: a hash that a third of all documents have costs time spread over the
salts, and no memory; the first pass counts the places of each bucket, and the salts follow that count. A
bucket's result holds different hashes only, and the buckets follow their number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandkeep.llm import common

#: Different hashes of a bucket, about; the least number of buckets; least parts that a bucket's places are salted to.
BUCKET_HASHES, LEAST_BUCKETS, SALTS = 500_000, 48, 4
#: Most tasks of a pass, where the session's shuffle partitions are fewer; a task then takes several buckets in turn.
MOST_TASKS = 20_000
#: Buckets with more than this share of all places are salted by their count; the driver learns these alone.
HOT_SHARE = 1e-5


def buckets_for(hashes: float, size: int = 0) -> int:
    """Buckets of BUCKET_HASHES different hashes, or of size; buckets fall on tasks by hash, so the largest task has some five of them."""
    return max(LEAST_BUCKETS, int(hashes / (size or BUCKET_HASHES)))


def _groups(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts the keys, and where in it each different key begins."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    if not len(order):
        return order, order
    new = np.zeros(len(order), bool)
    new[0] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(new)


class Packing:
    """How the hashes of one comparison travel. wide: two of 64 bits, else 32 bits within the bucket; least: with the smallest document."""

    def __init__(self, buckets: int, wide: bool, least: bool):
        self.buckets, self.wide, self.least = buckets, wide, least
        self.kinds = [np.dtype(np.uint64), np.dtype(np.uint64)] if wide else [np.dtype(np.uint32)]

    def split(self, hashes: list[np.ndarray]):
        """(bucket, where its hashes are, their keys) for each bucket that has some."""
        bucket = (hashes[0] % np.uint64(self.buckets)).astype(np.int64)
        keys = [hashes[0], hashes[1]] if self.wide else [(hashes[0] // np.uint64(self.buckets)).astype(np.uint32)]
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        for part in np.split(order, cuts) if len(order) else ():
            yield int(bucket[part[0]]), part, [k[part] for k in keys]

    def pack(self, keys: list[np.ndarray], many: np.ndarray, least: np.ndarray) -> bytes:
        rest = [many.astype(np.uint8)] + ([least.astype(np.int64)] if self.least else [])
        return b"".join(np.ascontiguousarray(x).tobytes() for x in [*keys, *rest])

    def unpack(self, data: bytes) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        kinds = [*self.kinds, np.dtype(np.uint8)] + ([np.dtype(np.int64)] if self.least else [])
        n, at, out = len(data) // sum(k.itemsize for k in kinds), 0, []
        for k in kinds:
            out.append(np.frombuffer(data, k, n, at))
            at += n * k.itemsize
        keys = out[: len(self.kinds)]
        return keys, out[len(self.kinds)] > 0, out[-1] if self.least else np.zeros(n, np.int64)

    def merge(self, parts: list[tuple[list[np.ndarray], np.ndarray, np.ndarray]]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """One entry a key: whether several documents have it (two parts never share a document), and the smallest."""
        keys = [np.concatenate([p[0][k] for p in parts]) for k in range(len(self.kinds))]
        many, least = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
        order, first = _groups(keys)
        if not len(order):
            return keys, many, least
        size = np.diff(np.append(first, len(order)))
        return [k[order][first] for k in keys], (size > 1) | np.logical_or.reduceat(many[order], first), np.minimum.reduceat(least[order], first)


def seen_once_a_batch(packing: Packing, hashes, text, ids) -> list[tuple[int, int, bytes]]:
    """(bucket, places, packed keys) of a batch, each key once, with whether several of its documents have it."""
    out = []
    for bucket, part, keys in packing.split(hashes):
        order, first = _groups(keys)
        own = ids[text[part]][order]
        size = np.diff(np.append(first, len(order)))
        low, high = np.minimum.reduceat(text[part][order], first), np.maximum.reduceat(text[part][order], first)
        out.append((bucket, len(part), packing.pack([k[order][first] for k in keys], (low != high) & (size > 1), np.minimum.reduceat(own, first))))
    return out


def places(packing: Packing, hashes, text, place, ids, row_keys) -> list[tuple[int, bytes]]:
    """(bucket, packed places) of a batch: documents with their counts, then keys and places in order."""
    out = []
    for bucket, part, keys in packing.split(hashes):
        docs, counts = np.unique(text[part], return_counts=True)  # parts are in text order
        head = np.array([len(docs)], np.int64)
        out.append((bucket, b"".join(x.tobytes() for x in [head, ids[docs], row_keys[docs], counts.astype(np.int32), *keys, place[part].astype(np.int32)])))
    return out


def unpack_places(packing: Packing, data: bytes):
    n, at = int(np.frombuffer(data, np.int64, 1)[0]), 8
    ids, row_keys = np.frombuffer(data, np.int64, n, at), np.frombuffer(data, np.int64, n, at + 8 * n)
    counts = np.frombuffer(data, np.int32, n, at + 16 * n)
    at, m, keys = at + 20 * n, int(counts.sum()), []
    for kind in packing.kinds:
        keys.append(np.frombuffer(data, kind, m, at))
        at += m * kind.itemsize
    return ids, row_keys, counts, keys, np.frombuffer(data, np.int32, m, at)


def _find(keys: list[np.ndarray], among: list[np.ndarray]) -> np.ndarray:
    """Each key's place among sorted unique ones, -1 where missing."""
    n = len(among[0])
    if not n:
        return np.full(len(keys[0]), -1)
    at = np.searchsorted(among[0], keys[0])
    if len(keys) > 1:  # step over equal first halves
        for _ in range(64):
            ahead = (at < n) & (among[0][np.minimum(at, n - 1)] == keys[0]) & (among[1][np.minimum(at, n - 1)] != keys[1])
            if not ahead.any():
                break
            at = at + ahead
    got = np.minimum(at, n - 1)
    same = at < n
    for k, a in zip(keys, among, strict=True):
        same &= a[got] == k
    return np.where(same, got, -1)


def repeated(rows: DataFrame, produce, packing: Packing, members: bool = False) -> DataFrame:
    """doc, key, places (packed int32): where hashes stand that several documents have; with packing.least, a smaller document.

    members: instead, hash, doc, leader for every document that has a hash several have; leader is the smallest.
    produce(batch) gives hashes, texts, places, ids and row keys of a batch of rows.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks, least = min(packing.buckets, max(n, MOST_TASKS)), packing.least

    def first_pass(batches):
        for batch in batches:
            hashes, text, _, ids, _ = produce(batch)
            got = seen_once_a_batch(packing, hashes, text, ids)
            yield pa.record_batch([pa.array([b for b, _, _ in got], pa.int32()), pa.array([n for _, n, _ in got], pa.int64()), pa.array([x for _, _, x in got], pa.binary())], ["bucket", "n", "data"])

    def reduce(batches):
        bucket, parts, held, total = None, [], 0, 0

        def done():
            keys, many, least = packing.merge(parts)
            return pa.record_batch([pa.array([bucket], pa.int32()), pa.array([total], pa.int64()), pa.array([packing.pack([k[many] for k in keys], many[many], least[many])], pa.binary())], ["bucket", "n", "data"])

        for batch in batches:
            for b, n, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if b != bucket:
                    if parts:
                        yield done()
                    bucket, parts, held, total = b, [], 0, 0
                parts.append(packing.unpack(data))
                total += n
                held += len(parts[-1][1])
                if held > 4 * len(parts[0][1]) + 2_000_000:
                    parts = [packing.merge(parts)]
                    held = len(parts[0][1])
        if parts:
            yield done()

    def second_pass(batches):
        turn = TaskContext.get().partitionId()  # tasks of one batch must not all take one salt
        for batch in batches:
            got = places(packing, *produce(batch))
            turn += 1
            yield pa.record_batch([pa.array([b for b, _ in got], pa.int32()), pa.array([turn % salts_of.get(b, SALTS) for b, _ in got], pa.int32()), pa.array([1] * len(got), pa.int32()), pa.array([x for _, x in got], pa.binary())], ["bucket", "salt", "kind", "data"])

    def look_up(batches):
        bucket, found = None, None
        for batch in batches:
            docs, keys_out, out = [], [], []
            for b, kind, data in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if kind == 0:
                    bucket, found = b, packing.unpack(data)
                    continue
                if b != bucket or not len(found[1]):
                    continue
                ids, row_keys, counts, keys, place = unpack_places(packing, data)
                at = _find(keys, found[0])
                owner = np.repeat(np.arange(len(ids)), counts)
                hit = at >= 0
                if members:
                    docs.append(ids[owner[hit]])
                    keys_out.append((keys[0][hit].astype(np.int64) << 20) + b)
                    out.append(found[2][at[hit]])
                    continue
                if least:
                    hit &= found[2][at] < ids[owner]
                for d, part in _by_owner(owner[hit], place[hit]):
                    docs.append(ids[d])
                    keys_out.append(row_keys[d])
                    out.append(part.tobytes())
            if members:
                yield pa.record_batch([pa.array(np.concatenate([np.empty(0, np.int64), *x]), pa.int64()) for x in (keys_out, docs, out)], ["hash", "doc", "leader"])
            else:
                yield pa.record_batch([pa.array(docs, pa.int64()), pa.array(keys_out, pa.int64()), pa.array(out, pa.binary())], ["doc", "key", "places"])

    found = rows.mapInArrow(common.lean(first_pass), "bucket int, n long, data binary").repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(common.lean(reduce), "bucket int, n long, data binary")
    shared = common.stash(found)
    total = shared.agg(F.sum("n")).first()[0] or 0
    salts = F.when(F.col("n") > total * HOT_SHARE, F.greatest(F.lit(SALTS), F.ceil(F.col("n") / BUCKET_HASHES))).otherwise(F.lit(SALTS)).cast("int")
    hot = shared.withColumn("salts", salts).where(F.col("salts") > SALTS).select("bucket", "salts").collect()  # at most 1 / HOT_SHARE rows
    salts_of = {r["bucket"]: r["salts"] for r in hot}
    salt = F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt")
    parts = shared.select("bucket", salt, F.lit(0).alias("kind"), "data").unionByName(rows.mapInArrow(common.lean(second_pass), "bucket int, salt int, kind int, data binary"))
    sorted_parts = parts.repartition(max(n, tasks), "bucket", "salt").sortWithinPartitions("bucket", "kind").select("bucket", "salt", "kind", "data")
    return sorted_parts.mapInArrow(common.lean(look_up), "hash long, doc long, leader long" if members else "doc long, key long, places binary")


def _by_owner(owner: np.ndarray, place: np.ndarray):
    cuts = np.flatnonzero(np.diff(owner)) + 1
    if len(owner):
        for part, own in zip(np.split(place, cuts), owner[np.concatenate([[0], cuts])], strict=True):
            yield int(own), part.astype(np.int32)
