"""Object stores: insert if absent, verified reads, reassembly, and text forms of manifests and snapshots."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandkeep import settings
from strandkeep.functions import chunking
from strandkeep.functions.scalars import escape_field, ordinal, unescape_field


def put(store: DataFrame, incoming: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The rows of incoming to append: one for each key that the store lacks."""
    return incoming.dropDuplicates([key]).join(store.select(key), key, "left_anti")


def put_first(store: DataFrame, incoming: DataFrame, limit: int, order: str = "arrival", key: str = "remote_id") -> DataFrame:
    """As put, where of one key the first arrival wins and blobs over the limit are refused."""
    first = Window.partitionBy(key).orderBy(order)
    fit = incoming.where(F.octet_length("blob") <= limit).withColumn("__k", F.row_number().over(first)).where("__k = 1").drop("__k")
    return fit.join(store.select(key), key, "left_anti")


def get(ids: DataFrame, store: DataFrame, verified: bool = True) -> DataFrame:
    """ids (chunk_id) with content; a content whose hash is not its id raises unless verified is off."""
    found = ids.join(store.select("chunk_id", "content"), "chunk_id")
    if not verified:
        return found
    right = F.sha2("content", 256) == F.col("chunk_id")
    return found.withColumn("content", F.when(right, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("corrupt object "), "chunk_id"))))


def reassemble(files: DataFrame, store: DataFrame, key: str = "path", verified_by: str | None = None) -> DataFrame:
    """key, content of files (key, chunks): the chunks in order, end to end. verified_by names a column with the whole's hash."""
    spread = files.select(key, F.posexplode("chunks").alias("position", "chunk_id"))
    parts = spread.join(store.select("chunk_id", "content"), "chunk_id").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("position", "content"))).alias("parts"))
    whole = F.aggregate("parts", F.unhex(F.lit("")), lambda a, x: F.concat(a, x["content"]))
    out = files.select(key, *([verified_by] if verified_by else [])).join(parts, key, "left").select(key, F.coalesce(whole, F.unhex(F.lit(""))).alias("content"), *([verified_by] if verified_by else []))
    if verified_by is None:
        return out
    right = F.sha2("content", 256) == F.col(verified_by)
    return out.withColumn("content", F.when(right, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("chunks out of order: "), F.col(key).cast("string"))))).drop(verified_by)


def manifest_line() -> Column:
    """path, size, modified (ms), flag and chunks of a file entry as one line of the manifest text."""
    return F.concat_ws("\t", escape_field("path"), F.col("size").cast("string"), F.unix_millis("modified_utc").cast("string"), F.when(F.col("executable"), "x").otherwise("-"), F.array_join("chunks", ","))


def write_manifests(entries: DataFrame) -> DataFrame:
    """snapshot_id, text: the manifest of each snapshot, entries by path in UTF-16 order."""
    lines = entries.select("snapshot_id", F.struct(ordinal("path").alias("k"), F.concat(manifest_line(), F.lit("\n")).alias("line")).alias("x"))
    whole = lines.groupBy("snapshot_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return whole.select("snapshot_id", F.concat(F.lit(f"{settings.NAMESPACE}-manifest 1\n"), F.array_join(F.transform("xs", lambda x: x["line"]), "")).alias("text"))


def manifest_chunks(entries: DataFrame) -> DataFrame:
    """position, chunk_id, chunk, manifest_id (of the last chunk alone): the manifest of one snapshot's entries, chunked.

    The id is a hash of the whole text, so one task reads the sorted lines end to end; it sorts outside memory and
    holds a few chunks at a time, whatever the number of files. The chunks are those of the text cut as a whole.
    """
    lines = entries.select(F.lit(1).alias("n"), ordinal("path").alias("k"), F.encode(F.concat(manifest_line(), F.lit("\n")), "utf-8").alias("line"))
    head = entries.sparkSession.range(1).select(F.lit(0).alias("n"), F.unhex(F.lit("")).alias("k"), F.encode(F.lit(f"{settings.NAMESPACE}-manifest 1\n"), "utf-8").alias("line"))

    def streamed(batches):
        whole, held, position = hashlib.sha256(), bytearray(), 0

        def cut(last: bool) -> list[bytes]:
            out, start = [], 0
            for end in chunking.cuts(bytes(held), chunking.gear()):
                if not last and start + chunking.MAX_SIZE > len(held):
                    break  # more text may move this cut
                out.append(bytes(held[start:end]))
                start = end
            del held[:start]
            return out

        def rows(pieces: list[bytes], manifest_id: str | None):
            ids = [hashlib.sha256(p).hexdigest() for p in pieces]
            places = range(position, position + len(pieces))
            last = [None] * (len(pieces) - 1) + [manifest_id] if pieces else []
            return pa.record_batch([pa.array(places, pa.int32()), pa.array(ids, pa.string()), pa.array(pieces, pa.binary()), pa.array(last, pa.string())], ["position", "chunk_id", "chunk", "manifest_id"])

        for batch in batches:
            for line in batch.column("line").to_pylist():
                whole.update(line)
                held += line
            if len(held) > 16 * chunking.MAX_SIZE:
                pieces = cut(False)
                yield rows(pieces, None)
                position += len(pieces)
        yield rows(cut(True), whole.hexdigest())

    return head.unionByName(lines).repartition(1).sortWithinPartitions("n", "k").select("line").mapInArrow(streamed, "position int, chunk_id string, chunk binary, manifest_id string")


def read_manifests(texts: DataFrame) -> DataFrame:
    """The file entries of manifests (snapshot_id, text); raises for another header and for a line without five fields."""
    head = f"{settings.NAMESPACE}-manifest 1"
    lines = texts.select("snapshot_id", F.posexplode(F.split(F.regexp_replace("text", "\n$", ""), "\n")).alias("n", "line"))
    fields = F.split("line", "\t")
    bad = ((F.col("n") == 0) & (F.col("line") != head)) | ((F.col("n") > 0) & (F.size(fields) != 5))
    checked = lines.withColumn("line", F.when(bad, F.raise_error(F.concat(F.lit("not a manifest line: "), "line"))).otherwise(F.col("line"))).where("n > 0")
    return checked.select(
        "snapshot_id",
        unescape_field(fields[0]).alias("path"),
        fields[1].cast("long").alias("size"),
        F.timestamp_millis(fields[2].cast("long")).alias("modified_utc"),
        (fields[3] == "x").alias("executable"),
        F.when(fields[4] == "", F.array().cast("array<string>")).otherwise(F.split(fields[4], ",")).alias("chunks"),
    )


def _clean(text: str) -> Column:
    return F.regexp_replace(text, "[\t\r\n]", " ")


def write_snapshots(snapshots: DataFrame) -> DataFrame:
    """snapshot_id, text of snapshots (manifest_id, manifest_chunks, parents, machine_id, machine_name, created_utc, file_count, total_bytes, carried, repos); the id is the text's hash."""
    lines = F.concat(
        F.array(F.lit(f"{settings.NAMESPACE}-snapshot 1"), F.concat(F.lit("manifest "), "manifest_id"), F.concat(F.lit("mchunks "), F.array_join("manifest_chunks", ","))),
        F.transform("parents", lambda p: F.concat(F.lit("parent "), p)),
        F.array(F.concat(F.lit("machine "), _clean("machine_id")), F.concat(F.lit("name "), _clean("machine_name")), F.concat(F.lit("time "), F.unix_millis("created_utc").cast("string")), F.concat(F.lit("files "), F.col("file_count").cast("string")), F.concat(F.lit("bytes "), F.col("total_bytes").cast("string"))),
        F.transform("carried", lambda c: F.concat(F.lit("carry "), c)),
        F.transform("repos", lambda c: F.concat(F.lit("repo "), c)),
    )
    text = F.concat(F.array_join(lines, "\n"), F.lit("\n"))
    return snapshots.select(F.sha2(text, 256).alias("snapshot_id"), text.alias("text"))


def read_snapshots(texts: DataFrame) -> DataFrame:
    """The fields of snapshots (snapshot_id, text). Unknown keys are passed over; a text without a manifest raises."""
    lines = F.split(F.regexp_replace("text", "\n$", ""), "\n")

    def every(key: str) -> Column:
        return F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit(key + " "))), lambda x: F.substring(x, len(key) + 2, 1 << 30))

    def one(key: str) -> Column:
        return F.get(every(key), F.lit(0))

    return texts.select(
        "snapshot_id",
        F.when(one("manifest").isNotNull(), one("manifest")).otherwise(F.raise_error(F.lit("a snapshot without a manifest"))).alias("manifest_id"),
        F.filter(F.split(F.coalesce(one("mchunks"), F.lit("")), ","), lambda x: x != "").alias("manifest_chunks"),
        every("parent").alias("parents"), one("machine").alias("machine_id"), one("name").alias("machine_name"),
        F.timestamp_millis(one("time").cast("long")).alias("created_utc"), one("files").cast("int").alias("file_count"), one("bytes").cast("long").alias("total_bytes"),
        every("carry").alias("carried"), every("repo").alias("repos"),
    )


def parents_of(head: Column, others: Column) -> Column:
    """The parents of a new snapshot: the head first, further ones once each in order."""
    return F.array_distinct(F.concat(F.when(head.isNull(), F.array().cast("array<string>")).otherwise(F.array(head)), others))


def measure(store: DataFrame, size: str = "stored_bytes") -> DataFrame:
    """objects, bytes of a store."""
    return store.agg(F.count("*").alias("objects"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes"))


def fresh_chunks(chunks: DataFrame, store: DataFrame) -> DataFrame:
    """The different chunks (chunk_id, length, origin) that a store lacks; one in several places counts once, for its least origin."""
    one = chunks.groupBy("chunk_id").agg(F.min("origin").alias("origin"), F.min("length").alias("length"))
    return one.join(store.select("chunk_id"), "chunk_id", "left_anti")
