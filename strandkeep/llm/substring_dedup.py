"""Substring dedup: removing word windows that an earlier document has already.

A window is SPAN consecutive words. Two equal windows need not start at like positions, but with the
difference cover {0, 1, 3} modulo 7 some shift d below 7 puts both starts on cover positions; so two equal
windows share an anchor, ANCHOR words long, that stands on a cover position in either document. Only the
anchors at cover positions (three of seven) are hashed and compared over the whole corpus, by 32 bits within a
bucket: anchors that collide only bring more windows to the next step. Windows that hold no repeated anchor are
dropped; the others extend to all their words. What is compared there is the 128-bit BLAKE2b digest of the very
words, joined by one space, so no window is taken for another: among 10 ** 13 windows two different ones agree with
probability 1e-12. Every window learns the smallest document that it starts in.

Both comparisons go through packed.repeated.

Texts equal throughout (by SHA-256) are settled first: all but the copies with the smallest doc_id lose all words
(if there are at least SPAN), and one copy of each text takes part in the comparison.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandkeep.llm import common, packed

SPAN = 13
#: The difference cover and its period; an anchor is so long that every window holds one at each shift.
PERIOD, COVER = 7, (0, 1, 3)
ANCHOR = SPAN - PERIOD + 1
#: Anchors and windows of a bucket, about: some 2 MB of either, so that a task reads little however large the corpus is.
ANCHORS, WINDOWS = 250_000, 125_000
_NULL_ID = (1 << 63) - 1


def runs(starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of size words inside one text: their place in the batch, their text, their place in the text."""
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    at = np.arange(max(0, len(text) - size + 1))
    at = at[text[at] == text[at + size - 1]] if len(at) else at
    return at, text[at], at - starts[text[at]]


def anchors(words: np.ndarray, starts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hash, text and place of the anchors at cover positions."""
    at, text, place = runs(starts, ANCHOR)
    on = np.isin(place % PERIOD, COVER)
    return [common.rolling(words, ANCHOR)[at[on]]], text[on], place[on]


def windows(starts: np.ndarray, marked: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Text and place of the windows that hold a marked anchor; marked: places of anchors by text."""
    at, text, place = runs(starts, SPAN)
    edge = np.zeros(int(starts[-1]) + 1, np.int32)
    for k, m in enumerate(marked):
        edge[starts[k] + m] = 1
    held = np.concatenate([[0], np.cumsum(edge)])
    on = held[at + PERIOD] > held[at]  # an anchor starts at the window's first to seventh word
    return text[on], place[on]


def digests(words: list[list[bytes]], text: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """The two halves of the digest of each window's words; windows are in text order."""
    out = []
    edges = np.searchsorted(text, np.arange(len(words) + 1))
    for k, own in enumerate(words):
        at = place[edges[k] : edges[k + 1]]
        if len(at):
            joined = b" ".join(own)
            stop = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
            begin = np.concatenate([[0], stop[:-1] + 1])
            out += [blake2b(joined[a:b], digest_size=16).digest() for a, b in zip(begin[at].tolist(), stop[at + SPAN - 1].tolist(), strict=True)]
    halves = np.frombuffer(b"".join(out), np.uint64).reshape(-1, 2)
    return [halves[:, 0].copy(), halves[:, 1].copy()]


def removed_windows(docs: DataFrame) -> DataFrame:
    """doc, key, copy, places: documents that lose words. docs: doc (no null), key, text.

    copy: all words go, as an equal text has a smaller id; places: packed starts of removed windows, in parts.
    """
    narrow = common.stash(docs.select("doc", "key", F.unhex(F.sha2("text", 256)).alias("digest"), common.n_words("text").alias("n")))
    total = narrow.agg(F.sum("n")).first()[0] or 0
    same = narrow.groupBy("digest").agg(F.min("doc").alias("least"), F.count("*").alias("copies"))
    listed = narrow.join(common.sized(common.stash(same.where("copies > 1")), F.lit(32)), "digest")
    others = common.stash(listed.where("doc > least").select("doc", "key").distinct())
    longs = docs.join(common.sized(others), ["doc", "key"], "left_anti").select("doc", "key", "text")

    def anchored(batch):
        words, starts = common.hash_words(common.texts(batch.column("text")))
        return *anchors(words, starts), batch.column("doc").to_numpy(), batch.column("key").to_numpy()

    buckets = packed.buckets_for(total * len(COVER) / PERIOD, ANCHORS)
    marked = packed.repeated(longs, anchored, packed.Packing(buckets, wide=False, least=False))
    marked = common.stash(marked.groupBy("doc", "key").agg(F.collect_list("places").alias("places")))
    size = F.aggregate("places", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x))
    candidates = marked.agg(F.sum(size / 4)).first()[0] or 0
    held = longs.join(marked, ["doc", "key"])

    def windowed(batch):
        words = [t.split() for t in common.texts(batch.column("text"))]
        starts = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        marks = [np.concatenate([np.frombuffer(x, np.int32) for x in parts]) for parts in batch.column("places").to_pylist()]
        text, place = windows(starts, marks)
        return digests(words, text, place), text, place, batch.column("doc").to_numpy(), batch.column("key").to_numpy()

    buckets = packed.buckets_for(candidates * 2, WINDOWS)
    gone = packed.repeated(held, windowed, packed.Packing(buckets, wide=True, least=True)).groupBy("doc", "key").agg(F.collect_list("places").alias("places"))
    empty = F.array().cast("array<binary>")
    return common.stash(gone.select("doc", "key", F.lit(False).alias("copy"), "places").unionByName(others.select("doc", "key", F.lit(True).alias("copy"), empty.alias("places"))))


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """docs with n_words, n_removed, kept (the kept words joined by one space) and spans (removed word ranges, end excluded).

    Null and empty texts have no words. Rows of one doc_id are one document's: neither removes from the other.
    A null doc_id counts as larger than all. Wholly equal rows get equal results. Words are compared as they are.
    """
    names = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept", "spans", "__doc", "__key")]
    keyed = docs.select(*names, F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("__doc"))
    keyed = keyed.withColumn("__key", F.xxhash64("__doc", "text"))
    gone = removed_windows(keyed.select(F.col("__doc").alias("doc"), F.col("__key").alias("key"), F.coalesce("text", F.lit("")).alias("text")))
    info = gone.select(F.col("doc").alias("__doc"), F.col("key").alias("__key"), F.col("copy").alias("__copy"), F.col("places").alias("__places"))
    joined = keyed.join(info, ["__doc", "__key"], "left").select(*names, "__copy", "__places")

    def cut(batches):
        for batch in batches:
            n_words, n_removed, kept, spans = [], [], [], []
            for text, copy, parts in zip(common.texts(batch.column("text")), batch.column("__copy").to_pylist(), batch.column("__places").to_pylist(), strict=True):
                words = text.split()
                n = len(words)
                off = np.zeros(n + 1, np.int32)
                if copy and n >= SPAN:
                    off[0], off[n] = 1, off[n] - 1
                elif parts:
                    at = np.unique(np.concatenate([np.frombuffer(x, np.int32) for x in parts]))
                    np.add.at(off, at, 1)
                    np.add.at(off, at + SPAN, -1)
                gone_ = np.cumsum(off)[:n] > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone_.view(np.int8), [0]])))
                n_words.append(n)
                n_removed.append(int(gone_.sum()))
                kept.append(b" ".join(words if not len(edges) else [w for w, g in zip(words, gone_.tolist(), strict=True) if not g]).decode("utf-8", "replace"))
                spans.append([{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            arrays = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, kind)]
            yield pa.record_batch([*[batch.column(c) for c in names], *arrays], [*names, "n_words", "n_removed", "kept", "spans"])

    span = T.ArrayType(T.StructType().add("start", "integer").add("end", "integer"))
    schema = docs.select(*names).schema.add("n_words", "long").add("n_removed", "long").add("kept", "string").add("spans", span)
    return joined.mapInArrow(common.lean(cut), schema)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op2_substring_dedup": op2_substring_dedup}

ORACLES = {
    "op2_substring_dedup": """
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
             v AS (SELECT doc_id, i, sha256(array_to_string(w[i : i + 12], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
             e AS (SELECT s, min(doc_id) AS earliest FROM v GROUP BY s),
             g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM v JOIN e USING (s) WHERE earliest < doc_id),
             u AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
             k AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept FROM u ANTI JOIN g USING (doc_id, p) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
}
