"""Sharding by Hilbert-curve order.

Source, language and size are quantised to a cell each; cells are numbered along a Hilbert curve, so
that rows near in all three lie near in the files. Rows are ordered by cell and, within it, by their
text's hash; the order is cut into runs of near-equal bytes (the law "bytes"). Equal texts are one group,
placed by the metadata of its smallest doc_id, and stay in one shard unless the group alone is larger
than a shard.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandkeep.llm import common

#: Bits of each dimension; the cells, 2 ** (BITS * DIMENSIONS), bound the broadcast curve table.
BITS, DIMENSIONS = 5, 3
#: Parts of a group of equal texts that are ranked apart.
PARTS = 64


def curve(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert indices of integer points (n, d) by the transpose method: undo the rotations from the top bit, then Gray code."""
    x = points.astype(np.int64).T.copy()
    d = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for k in range(d):
            high = (x[k] & bit) != 0
            swap = np.where(high, 0, (x[0] ^ x[k]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            if k:
                x[k] ^= swap
        bit >>= 1
    for k in range(1, d):
        x[k] ^= x[k - 1]
    flip = np.zeros_like(x[0])
    bit = 1 << (bits - 1)
    while bit > 1:
        flip = np.where(x[d - 1] & bit, flip ^ (bit - 1), flip)
        bit >>= 1
    x ^= flip
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for k in range(d):
            out = (out << 1) | ((x[k] >> b) & 1)
    return out


def curve_table(spark: SparkSession) -> DataFrame:
    """cell (the dimensions side by side), along (its place on the curve); 2 ** 15 rows whatever the data."""
    cells = np.arange(1 << (BITS * DIMENSIONS))
    points = np.stack([(cells >> (BITS * k)) & ((1 << BITS) - 1) for k in range(DIMENSIONS)], axis=1)
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame({"cell": cells.astype("int32"), "along": curve(points)}))


def place(rows: DataFrame, shards: int = 16) -> DataFrame:
    """rows (doc_id, size, text_hash, source, lang and others) with shard and slot.

    Null metadata falls in the cells of hashed nulls; an empty table gives an empty result; wholly equal
    rows get slots of their own. Sizes are summed per group, range partition and shard before anything is
    compared: the driver sees one total a partition and one a shard.
    """
    spark = rows.sparkSession
    top = (1 << BITS) - 1
    groups = rows.groupBy("text_hash").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "source", "lang")).alias("m"), F.sum("size").alias("bytes"), F.max("size").alias("one"))
    size_class = F.least(F.floor(F.log2(F.col("one")) * 1.5), F.lit(top)).cast("int")
    cell = F.pmod(F.xxhash64("m.source"), F.lit(1 << BITS)).cast("int") + F.pmod(F.xxhash64("m.lang"), F.lit(1 << BITS)).cast("int") * (1 << BITS) + size_class * (1 << 2 * BITS)
    groups = groups.withColumn("cell", cell).join(F.broadcast(curve_table(spark)), "cell").select("text_hash", "along", "bytes")
    groups = common.stash(groups)
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    wide = F.col("bytes") * shards > F.lit(total)  # larger than a shard: its rows are spread by id
    key = F.when(wide, F.xxhash64("text_hash", "doc_id")).otherwise(F.xxhash64("text_hash"))
    placed = rows.join(groups, "text_hash").withColumn("at", F.shiftleft(F.col("along").cast("long"), 48).bitwiseOR(F.shiftrightunsigned(key, 16)))
    placed = common.stash(placed.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int")).drop("along", "bytes", "text_hash", "source", "lang"))
    # running bytes and rows before every unit, by range partition and the totals of those before
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    units = placed.groupBy("at", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    units = common.stash(units.repartitionByRange(n, "at", "part").withColumn("range", F.spark_partition_id()))
    b = r = 0
    before = []
    for x in sorted(units.groupBy("range").agg(F.sum("bytes").alias("b"), F.sum("rows").alias("r")).collect(), key=lambda x: x["range"]):
        before.append((x["range"], b, r))
        b, r = b + x["b"], r + x["r"]
    offsets = spark.createDataFrame(before, "range int, b0 long, r0 long")
    run = Window.partitionBy("range").orderBy("at", "part").rowsBetween(Window.unboundedPreceding, -1)
    units = units.join(F.broadcast(offsets), "range").withColumns({
        "b": F.col("b0") + F.coalesce(F.sum("bytes").over(run), F.lit(0)),
        "r": F.col("r0") + F.coalesce(F.sum("rows").over(run), F.lit(0)),
    })
    whole = Window.partitionBy("at")
    middle = F.min("b").over(whole) + F.sum("bytes").over(whole) / 2
    shard = F.least(F.floor(middle * shards / F.lit(max(total, 1))), F.lit(shards - 1)).cast("int")
    units = common.stash(units.withColumn("shard", shard).select("at", "part", "shard", "r"))
    first = units.groupBy("shard").agg(F.min("r").alias("r1"))  # a row a shard
    units = units.join(F.broadcast(first), "shard").select("at", "part", "shard", (F.col("r") - F.col("r1")).alias("r"))
    order = Window.partitionBy("at", "part").orderBy("doc_id")
    out = placed.join(units, ["at", "part"]).withColumn("slot", F.col("r") + F.row_number().over(order) - 1)
    return out.drop("at", "part", "r")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, text_hash, source, lang of documents, as a narrow table of the shared folder."""
    data = F.coalesce("text", F.lit("")).cast("binary")
    return common.stash(docs.select(
        "doc_id",
        (F.octet_length(data) + 1).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.xxhash64(data).alias("text_hash"),
        "source", "lang",
    ))


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """docs with shard and slot; rows of one doc_id and text share the table's decisions but have slots of their own."""
    docs = docs.drop("shard", "slot")
    keys = ["doc_id", "__crc", "__copy"]
    numbered = Window.partitionBy("doc_id", "__crc").orderBy(F.lit(0))
    plan = place(measured(docs), shards).withColumnRenamed("text_crc32", "__crc").withColumn("__copy", F.row_number().over(Window.partitionBy("doc_id", "__crc").orderBy("shard", "slot")))
    own = docs.withColumn("__crc", F.crc32(F.coalesce("text", F.lit("")).cast("binary"))).withColumn("__copy", F.row_number().over(numbered))
    same = [F.col(f"own.{k}").eqNullSafe(F.col(f"plan.{k}")) for k in keys]
    return own.alias("own").join(plan.select(*keys, "shard", "slot").alias("plan"), same).select(*[F.col(f"own.{c}") for c in docs.columns], "shard", "slot")


def op9_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    docs = common.table(spark, sf_dir, "documents")
    out = place(measured(docs)).withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


QUERIES = {"op9_hilbert_shards": op9_hilbert_shards}
