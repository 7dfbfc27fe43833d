"""Approximate nearest neighbours by multiprobe p-stable hashing.

TABLES tables hash a vector by FUNCTIONS Gaussian projections each, cut into cells of a common width. A query
visits its own bucket of every table and then those with some cells shifted by one, in the order of the
estimated chance that a near vector fell there (by the squared distances to the cells' borders). Candidates
of all tables are ranked by their exact distance in double precision.

Equal vectors are one point with its smallest ids. Points are dealt by table and bucket range to parts, and a
part that a full bucket makes large is split by point; a query goes once to each part that it visits, or to all
its splits, past their points, and takes its nearest of each along.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandkeep.llm import common

#: Tables, projections of a table, probes of a table, and the cells' width in median distances of the sample.
TABLES, FUNCTIONS, PROBES, WIDTH = 8, 10, 128, 1.77
#: Vectors that the width is fitted on, at most; points of a part, about; queries of an exhaustive block.
SAMPLE, PART_POINTS, BLOCK = 2000, 40_000, 1024
NEAREST = 10
#: Parts with more than this share of all points are looked at for splitting; the driver learns these alone.
HOT_SHARE = 1e-4


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding of the vectors that take part: not null, not zero, all components finite, of the commonest length."""
    bad = "exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))"
    good = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(f"vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT coalesce({bad}, true) AND exists(embedding, x -> x <> 0)")
    lengths = good.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return good.where(F.size("embedding") == (lengths[0]["n"] if lengths else 0)).distinct()


def points(vectors: DataFrame, most: int) -> DataFrame:
    """point (its smallest id), embedding, ids (its smallest ids, at most so many) of the different vectors."""
    key = F.xxhash64("embedding").alias("h")
    rank = F.row_number().over(Window.partitionBy("h", "embedding").orderBy("vec_id"))  # limited before the shuffle
    kept = vectors.select(key, "embedding", "vec_id").withColumn("k", rank).where(F.col("k") <= most)
    return kept.groupBy("h", "embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("point"), "embedding", "ids")


def fit_width(sample: np.ndarray) -> float:
    """The cells' width: WIDTH times the sample's median distance."""
    if len(sample) < 2:
        return 1.0
    square = (sample**2).sum(1)
    d = np.sqrt(np.maximum(0, square[:, None] + square[None, :] - 2 * sample @ sample.T))[np.triu_indices(len(sample), 1)]
    return float(np.median(d)) * WIDTH or 1.0


class Tables:
    """The hash functions; the same on every worker."""

    def __init__(self, length: int, width: float, parts: int):
        rng = np.random.Generator(np.random.PCG64(4711))
        self.width, self.parts = width, parts
        self.axes = rng.normal(size=(TABLES, length, FUNCTIONS))
        self.shift = rng.uniform(0, width, size=(TABLES, 1, FUNCTIONS))

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(table, vector, function): the cell, and how far in it the vector lies."""
        at = np.einsum("vd,tdf->tvf", x, self.axes) + self.shift
        cell = np.floor(at / self.width)
        return cell.astype(np.int64), at - cell * self.width

    @staticmethod
    def keys(cells: np.ndarray) -> np.ndarray:
        """A 64-bit key for the last axis."""
        out = np.zeros(cells.shape[:-1], np.uint64)
        for k in range(cells.shape[-1]):
            out = common.mixed(out * np.uint64(0x9E3779B97F4A7C15) + cells[..., k].astype(np.int64).view(np.uint64) + np.uint64(1))
        return out

    def part(self, keys: np.ndarray) -> np.ndarray:
        return (keys % np.uint64(self.parts)).astype(np.int64)


def perturbations(inside: np.ndarray, width: float, probes: int) -> np.ndarray:
    """(probe, function) shifts of -1, 0, 1 in ascending order of the squared distances crossed; the first is none."""
    steps = sorted([(x * x, k, -1) for k, x in enumerate(inside)] + [((width - x) ** 2, k, 1) for k, x in enumerate(inside)])
    out, heap = [np.zeros(len(inside), np.int64)], [(steps[0][0], (0,))]
    while heap and len(out) < probes:
        score, chosen = heapq.heappop(heap)
        functions = {steps[j][1] for j in chosen}
        if len(functions) == len(chosen):
            shift = np.zeros(len(inside), np.int64)
            for j in chosen:
                shift[steps[j][1]] = steps[j][2]
            out.append(shift)
        last = chosen[-1]
        if last + 1 < len(steps):
            heapq.heappush(heap, (score + steps[last + 1][0], (*chosen, last + 1)))
            heapq.heappush(heap, (score - steps[last][0] + steps[last + 1][0], (*chosen[:-1], last + 1)))
    return np.array(out)


def _matrix(column) -> np.ndarray:
    n = len(column)
    return np.asarray(column.flatten(), dtype=np.float64).reshape(n, -1) if n else np.empty((0, 0))


def _best(q: np.ndarray, ids: np.ndarray, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids and distances of the nearest points, ties to the smaller id."""
    d = np.sqrt(((x - q) ** 2).sum(1))
    if len(d) > most:
        cut = np.partition(d, most - 1)[most - 1]
        near = np.flatnonzero(d <= cut)
        ids, d = ids[near], d[near]
    order = np.lexsort((ids, d))[:most]
    return ids[order], d[order]


_FOUND = "query_id long, point long, score double"


def _found(batch: list[tuple[int, np.ndarray, np.ndarray]]):
    ids = [np.full(len(p), q, np.int64) for q, p, _ in batch]
    arrays = [np.concatenate([np.empty(0, t), *x]) for t, x in ((np.int64, ids), (np.int64, [p for _, p, _ in batch]), (np.float64, [d for _, _, d in batch]))]
    return pa.record_batch([pa.array(x) for x in arrays], ["query_id", "point", "score"])


NAMES = ["table", "part", "split", "kind", "id", "embedding", "keys"]


def _probed(all_points: DataFrame, queries: DataFrame, tables: Tables, most: int, total: int) -> DataFrame:
    """query_id, point, score: each part's nearest of the visited buckets."""

    def keys_of(batch):
        cells, _ = tables.cells(_matrix(batch.column("embedding"))) if batch.num_rows else (np.empty((TABLES, 0, FUNCTIONS), np.int64), None)
        return tables.keys(cells)

    def counted(batches):
        sums: dict[tuple[int, int], int] = {}
        for batch in batches:
            keys = keys_of(batch)
            for t in range(TABLES):
                for part, n in zip(*np.unique(tables.part(keys[t]), return_counts=True), strict=True):
                    sums[t, int(part)] = sums.get((t, int(part)), 0) + int(n)
        rows = [(t, p, n) for (t, p), n in sums.items()]
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2))], ["table", "part", "n"])

    sums = all_points.select("embedding").mapInArrow(common.lean(counted), "table int, part long, n long").groupBy("table", "part").agg(F.sum("n").alias("n"))
    full = sums.where(F.col("n") > max(2 * PART_POINTS, int(total * HOT_SHARE))).collect()  # at most TABLES / HOT_SHARE rows
    splits = {(r["table"], r["part"]): -(-r["n"] // PART_POINTS) for r in full}

    def dealt(batches):
        for batch in batches:
            keys = keys_of(batch)
            spread = common.mixed(batch.column("point").to_numpy().view(np.uint64)) if batch.num_rows else np.empty(0, np.uint64)
            for t in range(TABLES):
                part = tables.part(keys[t])
                split = np.zeros(batch.num_rows, np.int64)
                for (table, p), n in splits.items() if batch.num_rows else ():
                    if table == t:
                        own = part == p
                        split[own] = spread[own] % np.uint64(n)
                yield pa.record_batch([pa.array(np.full(batch.num_rows, t, np.int32)), pa.array(part), pa.array(split), pa.array(np.zeros(batch.num_rows, np.int32)), batch.column("point"), batch.column("embedding"), pa.array(keys[t].view(np.int64)[:, None].tolist(), pa.list_(pa.int64()))], NAMES)

    def asked(batches):
        for batch in batches:
            x = _matrix(batch.column("embedding"))
            rows = []
            for v, q in enumerate(batch.column("vec_id").to_pylist()):
                cells, inside = tables.cells(x[v : v + 1])
                for t in range(TABLES):
                    keys = tables.keys(cells[t, 0] + perturbations(inside[t, 0], tables.width, PROBES))
                    part = tables.part(keys)
                    rows += [(t, int(p), s, 1, q, x[v].tolist(), keys[part == p].view(np.int64).tolist()) for p in np.unique(part) for s in range(splits.get((t, int(p)), 1))]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64())]
            yield pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], NAMES)

    schema = "table int, part long, split long, kind int, id long, embedding array<double>, keys array<long>"
    n = int(all_points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = all_points.select("point", "embedding").mapInArrow(common.lean(dealt), schema).unionByName(queries.select("vec_id", "embedding").mapInArrow(common.lean(asked), schema))
    rows = rows.repartition(max(n, TABLES), "table", "part", "split").sortWithinPartitions("table", "part", "split", "kind")

    def searched(batches):
        place, ids, x, keys, loose = None, None, None, None, []
        for batch in batches:
            out = []
            table, part, split, kind = (batch.column(c).to_numpy() for c in ("table", "part", "split", "kind"))
            every, own = _matrix(batch.column("embedding")), batch.column("id").to_numpy()
            lists = batch.column("keys")
            cuts = np.flatnonzero((np.diff(table) != 0) | (np.diff(part) != 0) | (np.diff(split) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True) if batch.num_rows else ():
                if (table[a], part[a], split[a]) != place:
                    place, ids, loose = (table[a], part[a], split[a]), None, []
                if kind[a] == 0:
                    loose.append((own[a:b], every[a:b], np.asarray(lists.slice(a, b - a).flatten())))
                    continue
                if ids is None:
                    if not loose:
                        continue
                    ids, x, keys = (np.concatenate(z) for z in zip(*loose, strict=True))
                    order = np.argsort(keys, kind="stable")
                    ids, x, keys = ids[order], x[order], keys[order]
                for k in range(a, b):
                    wanted = np.asarray(lists[k].values)
                    low, high = np.searchsorted(keys, wanted, "left"), np.searchsorted(keys, wanted, "right")
                    hit = np.flatnonzero(high > low)
                    if len(hit):
                        at = np.concatenate([np.arange(low[j], high[j]) for j in hit])
                        out.append((int(own[k]), *_best(every[k], ids[at], x[at], most)))
            yield _found(out)

    return rows.mapInArrow(common.lean(searched), _FOUND)


def _exhaustive(all_points: DataFrame, queries: list[tuple[int, list[float]]], most: int) -> DataFrame:
    """query_id, point, score: a bounded block of queries against all points, each batch's nearest."""

    def searched(batches):
        for batch in batches:
            x, ids = _matrix(batch.column("embedding")), batch.column("point").to_numpy()
            yield _found([(q, *_best(np.array(v), ids, x, most)) for q, v in queries] if len(ids) else [])

    return all_points.select("point", "embedding").mapInArrow(common.lean(searched), _FOUND)


def nearest(vectors: DataFrame, queries: F.Column, most: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id, score: each query's nearest vectors found, ties to the smaller id.

    queries picks the query rows of vectors (vec_id, embedding). Vectors that are null, zero, hold null or
    non-finite components or have another length than most take no part; rows equal throughout count once.
    A query for which the probes find fewer than most gets an exhaustive search, so it has fewer only if
    there are no more. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    good = common.stash(usable(vectors))
    everything = common.stash(points(good, most + 1))
    total = everything.count()
    asked = good.where(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    sample = np.array([r["embedding"] for r in everything.orderBy(F.xxhash64("point")).select("embedding").limit(SAMPLE).collect()])
    tables = Tables(sample.shape[1] if len(sample) else 1, fit_width(sample), max(1, math.ceil(total / PART_POINTS)))
    best = Window.partitionBy("query_id").orderBy("score", "point")
    found = _probed(everything, asked, tables, most + 1, total).distinct()
    found = common.stash(found.withColumn("k", F.row_number().over(best)).where(F.col("k") <= most + 1).drop("k"))

    def spelled(hits: DataFrame) -> DataFrame:
        ids = hits.join(everything.select("point", "ids"), "point").select("query_id", "score", F.explode("ids").alias("vec_id"))
        order = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return ids.where("vec_id <> query_id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)

    out = common.stash(spelled(found))
    short = asked.join(out.groupBy("query_id").count().where(F.col("count") >= min(most, max(0, good.select("vec_id").distinct().count() - 1))), asked["vec_id"] == F.col("query_id"), "left_anti")
    short = common.stash(short)
    n = short.count()
    blocks = max(1, -(-n // BLOCK))
    for block in range(blocks if n else 0):
        rows = [(r["vec_id"], r["embedding"]) for r in short.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).collect()]
        hits = _exhaustive(everything, rows, most + 1).withColumn("k", F.row_number().over(best)).where(F.col("k") <= most + 1).drop("k")
        ids = spark.createDataFrame([(q,) for q, _ in rows], "query_id long")
        out = common.stash(out.join(F.broadcast(ids), "query_id", "left_anti").unionByName(spelled(hits)))
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 10 nearest found of every hundredth vec_id."""
    return nearest(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES = {"op7_nearest": op7_nearest}
