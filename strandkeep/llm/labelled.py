"""Labelled rows for the two classifiers: who is held out, and a bounded training sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandkeep.llm import common


def fold(modulus: int) -> F.Column:
    """crc32 of doc_id as text, modulo modulus; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


#: Bytes of text that the driver learns from, at most.
TRAINING_BYTES = 128 << 20


def training_rows(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, limit: int) -> list[tuple[str, int]]:
    """(text, label) of at most limit labelled documents outside the held-out fold, those with the smallest id hashes.

    The ids are chosen on the labels alone. Labels other than 0 and 1 and labels of unknown documents don't
    count; a doc_id labelled twice counts once, by its larger label, and one with several texts by one of them.
    The texts are written as a table; the driver reads their sizes, then, in that order, the texts that fit into
    TRAINING_BYTES together. A text is learnt from whole or not at all.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("label IN (0, 1)")
    known = known.where(fold(modulus) != held).groupBy("doc_id").agg(F.max("label").alias("label"))
    order = F.xxhash64("doc_id")
    chosen = known.orderBy(order, "doc_id").limit(limit)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = common.stash(rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")))
    sizes = rows.select("doc_id", F.octet_length("text").alias("n")).orderBy(order, "doc_id").collect()
    left, fit = TRAINING_BYTES, []
    for r in sizes:
        if r["n"] <= left:
            left -= r["n"]
            fit.append((r["doc_id"],))
    if len(fit) < len(sizes):
        rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame(fit, rows.select("doc_id").schema)), "doc_id")
    return [(r["text"], r["label"]) for r in sorted(rows.collect(), key=lambda r: (r["doc_id"], r["text"]))]
