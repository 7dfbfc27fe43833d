"""The corpus pipeline: documents in, sharded training documents out.

Each stage works on all that the one before it kept and takes (spark, docs, sf_dir); stages are written as
Parquet in the shared folder and read again. All but the last return the columns of documents, extra ones
included. What a stage writes on the way is dropped when its result is written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandkeep.llm import common
from strandkeep.llm.decontamination import decontaminated
from strandkeep.llm.hilbert_shards import shard_documents
from strandkeep.llm.near_dups import near_duplicates
from strandkeep.llm.source_mix import mix
from strandkeep.llm.toxicity import score_toxicity


def _around(docs: DataFrame, operator: Callable[[DataFrame], DataFrame], added: tuple[str, ...]) -> DataFrame:
    """The documents that operator returns, with their own columns; those named as the columns that it adds step aside for it."""
    aside = {c: f"__own_{c}" for c in docs.columns if c in added}
    out = operator(docs.withColumnsRenamed(aside)).drop(*added)
    return out.withColumnsRenamed({v: k for k, v in aside.items()}).select(docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the classifier learns from the labels of documents still there.

    Null and empty texts hold no toxic word and stay, as does everything where a class has fewer than two labelled
    documents. Very long texts are read whole. Repeated rows go or stay together; null ids, sources and
    languages change nothing. Extra columns stay as they are, also those named as the scores. No rows give none.
    """
    labels = common.table(spark, sf_dir, "labels")
    return _around(docs, lambda own: score_toxicity(own, labels).where("predicted = 0"), ("held_out", "score", "predicted"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8) the document with the smallest id stays; of its repeated rows one.

    Null, empty and white texts are no duplicates of each other and stay. Rows without an id are told apart by their
    texts; in a group with a row that has one they go. Of rows with one id and different texts all stay if their group keeps
    that id. Very long texts are compared whole. Extra columns stay as they are, also those named as the
    groups; of repeated rows that differ in them any one stays. No rows give none.
    """
    repeats = common.stash(docs.groupBy("doc_id").agg(F.count("*").alias("__rows")).where("__rows > 1").select(F.col("doc_id").alias("__id")))

    def first(own: DataFrame) -> DataFrame:
        kept = near_duplicates(own).where("kept")
        again = kept["doc_id"].eqNullSafe(repeats["__id"])
        many = kept.join(repeats, again, "left_semi").dropDuplicates(["doc_id", "text"])
        return kept.join(repeats, again, "left_anti").unionByName(many)

    return _around(docs, first, ("n_shingles", "component_id", "kept"))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, with all rows of their id; of rows without an id those whose own text holds it.

    Null and empty texts hold nothing and stay, as does everything where the benchmark is empty. Very long texts
    are searched whole. Extra columns stay as they are. No rows give none.
    """
    return decontaminated(docs, common.table(spark, sf_dir, "benchmark")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, not at all or up to three times.

    Documents without words count nothing and stay as often as whole passes over their source are taken, once at
    least where its target allows one. Null sources are one source. Of repeated rows as many stay as the mix takes.
    Extra columns stay as they are, also those named as the mix's own. No rows give none.
    """
    def taken(own: DataFrame) -> DataFrame:
        return mix(own).where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), "copies")))

    return _around(docs, taken, ("size", "source_size", "target", "copies", "taken"))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with shard and slot, which replace columns of these names.

    Every row gets a slot of its own, repeated rows and the copies of the mix too. Null and empty texts have a size
    of one byte; null ids, sources and languages are values of their own. No rows give none.
    """
    return shard_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dups", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("source_mix", mix_sources),
    ("hilbert_shards", shard),
]

#: SQL cannot express the classifier, the sketches or the knapsack; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of a folder."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before = docs
        docs = common.settled(spark, lambda stage=stage, before=before: stage(spark, before, sf_dir))
    return docs
