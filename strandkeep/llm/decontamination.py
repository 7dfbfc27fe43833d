"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame operations only.

Items are partitioned by the size of their shingle set, in powers of two. An item's sketch is its smallest
shingle hashes (a bottom-k MinHash); k depends on its partition's largest size: so long that a document with
the wanted share of the item cannot miss all of it, up to SKETCH hashes, from where a miss has probability
(1 - share) ** SKETCH. A document is a candidate for an item if it has one hash of the item's sketch, however
long the document is. Candidates are verified by the containment of the full shingle sets, compared as text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandkeep.llm import common

#: Words of a shingle, and the share of an item's shingles that makes a document contaminated, in percent.
SHINGLE, PERCENT = 5, 80
#: Most hashes of a sketch.
SKETCH = 16
#: Sketch rows that are broadcast at a time; larger benchmarks are searched in blocks of items.
BLOCK_ROWS = 500_000


def with_shingles(df: DataFrame, out: str = "__shingles", size: int = SHINGLE) -> DataFrame:
    """df with the distinct hashes of the word shingles of text, lower-cased; fewer words than size are one shingle, none are none."""
    at = ", ".join(f"w[i + {k}]" for k in range(size))
    # the words are bound as a lambda's argument: a column would be computed again wherever it is named
    runs = f"CASE WHEN size(w) >= {size} THEN array_distinct(transform(sequence(0, size(w) - {size}), i -> xxhash64({at}))) WHEN size(w) > 0 THEN array(xxhash64(size(w), w)) ELSE cast(array() AS array<bigint>) END"
    words = f"transform({common.words_sql('lower(text)')}, x -> xxhash64(x))"
    return df.withColumn(out, F.expr(f"transform(array({words}), w -> {runs})[0]"))


def with_spelled(df: DataFrame, out: str, size: int = SHINGLE) -> DataFrame:
    """df with the distinct word shingles of text themselves, as with_shingles hashes them."""
    runs = f"CASE WHEN size(w) >= {size} THEN array_distinct(transform(sequence(0, size(w) - {size}), i -> array_join(slice(w, i + 1, {size}), ' '))) WHEN size(w) > 0 THEN array(array_join(w, ' ')) ELSE cast(array() AS array<string>) END"
    return df.withColumn(out, F.expr(f"transform(array({common.words_sql('lower(text)')}), w -> {runs})[0]"))


def sketches(benchmark: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """item_id, item_key, n, shingles (as text), sketch of the items that have words; different texts under one item_id are items of their own."""
    items = with_spelled(with_shingles(benchmark.select("item_id", "text"), "hashes", size), "shingles", size)
    items = items.select("item_id", F.xxhash64("item_id", "text").alias("item_key"), F.size("shingles").alias("n"), "shingles", "hashes")
    items = items.where("n > 0").dropDuplicates(["item_key"])
    largest = F.pow(F.lit(2), F.floor(F.log2("n")) + 1) - 1  # of the size partition
    k = F.least(F.floor(largest * (100 - percent) / 100) + 1, F.lit(SKETCH)).cast("int")
    # one more scramble, so that the order is a permutation of its own
    order = F.array_sort(F.transform("hashes", lambda h: F.struct(F.xxhash64(F.lit(77), h).alias("o"), h.alias("h"))))
    return items.withColumn("sketch", F.slice(order, 1, k).getField("h")).drop("hashes")


def contained(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, size: int = SHINGLE, null_keys: bool = False) -> DataFrame:
    """doc_id, item_id, n_item, n_shared of every document that holds percent of an item's shingles or more.

    Null and empty texts on either side match nothing; an item shorter than a shingle matches only documents
    of the same few words; repeated rows count once, and different texts of one doc_id or item_id are held
    against each other one by one; an empty table gives an empty result. Documents with a null doc_id are
    searched like others; with null_keys, null_key is the hash of such a row's text, else null. Very long texts
    are searched whole. The driver sees the number of items and their bytes alone.
    """
    items = common.stash(sketches(benchmark, percent, size))
    blocks = max(1, -(-items.count() * SKETCH // BLOCK_ROWS))
    keyed = docs.select("doc_id", "text").withColumn("__key", F.xxhash64("text"))
    sets = with_shingles(keyed, "__shingles", size)
    found = None
    for block in range(blocks):
        own = items.where(F.pmod("item_key", F.lit(blocks)) == block)
        probe = own.select("item_key", F.explode("sketch").alias("h"))  # at most BLOCK_ROWS rows of two numbers
        hits = sets.select("doc_id", "__key", F.explode("__shingles").alias("h")).join(F.broadcast(probe), "h")
        pairs = common.stash(hits.select("doc_id", "__key", "item_key").distinct())
        whole = common.sized(own.select("item_key", "item_id", "n", "shingles"), F.octet_length(F.array_join("shingles", " ")))
        named = pairs.join(whole, "item_key")
        # candidates bring their documents back by the text's hash; the documents are read again, not kept
        named = named.withColumnRenamed("doc_id", "__doc").groupBy("__doc", "__key").agg(F.collect_list(F.struct("item_id", "n", "shingles")).alias("__items"))
        texts = keyed.join(named, (keyed["__key"] == named["__key"]) & keyed["doc_id"].eqNullSafe(named["__doc"])).select("doc_id", "text", *[F.when(F.col("doc_id").isNull(), keyed["__key"]).alias("null_key")] * null_keys, "__items")
        shared = with_spelled(texts, "__shingles", size).withColumn("__item", F.explode("__items"))
        shared = shared.select("doc_id", *["null_key"] * null_keys, F.col("__item.item_id").alias("item_id"), F.col("__item.n").cast("long").alias("n_item"), F.size(F.array_intersect("__shingles", "__item.shingles")).cast("long").alias("n_shared"))
        shared = shared.where(F.col("n_shared") * 100 >= F.col("n_item") * percent).distinct()
        found = shared if found is None else found.unionByName(shared)
    return found


def decontaminated(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """The documents that hold no benchmark item, all columns and repeated rows kept; of rows without doc_id those go whose own text does."""
    found = contained(docs, benchmark, percent, size, null_keys=True)
    bad = common.stash(found.select(F.col("doc_id").alias("__bad"), F.col("null_key").alias("__bad_text")).distinct())
    own = F.when(docs["doc_id"].isNull(), F.xxhash64(docs["text"]))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__bad"]) & own.eqNullSafe(bad["__bad_text"]), "left_anti")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, n_item, n_shared of every contaminated document and item."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return contained(docs, common.table(spark, sf_dir, "benchmark"))


def _shingles_sql(table: str, key: str) -> str:
    words = f"SELECT {key}, text AS {key}_text, regexp_extract_all(lower(coalesce(text, '')), '[^\\x20\\x09-\\x0D]+') AS w FROM {table}"
    runs = f"CASE WHEN len(w) >= {SHINGLE} THEN list_transform(range(1, len(w) - {SHINGLE} + 2), lambda i: array_to_string(w[i : i + {SHINGLE} - 1], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"
    return f"SELECT DISTINCT {key}, {key}_text, unnest({runs}) AS s FROM ({words})"


QUERIES = {"op3_decontamination": op3_decontamination}

ORACLES = {
    "op3_decontamination": f"""
        WITH d AS ({_shingles_sql("documents", "doc_id")}), i AS ({_shingles_sql("benchmark", "item_id")}),
             n AS (SELECT item_id, item_id_text, count(*) AS n_item FROM i GROUP BY ALL),
             b AS (SELECT doc_id, doc_id_text, item_id, item_id_text, count(*) AS n_shared FROM d JOIN i USING (s) GROUP BY ALL)
        SELECT DISTINCT doc_id, item_id, n_item, n_shared FROM b JOIN n USING (item_id, item_id_text) WHERE n_shared * 100 >= n_item * {PERCENT}""",
}
