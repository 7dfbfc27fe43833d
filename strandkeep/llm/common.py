"""What the operators share: reading tables, shared-folder tables, word hashes, Arrow settings."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from strandkeep.stash import settled, stash  # noqa: F401  the operators take them from here

#: A word, for every operator that counts or compares words.
WORD = r"[^\x20\x09-\x0D]+"
#: A table joined to the documents is broadcast if its rows and bytes are no more than these, else shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, by any path that Spark's readers open."""
    tuned(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tuned(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes as well as rows, so that very long texts don't pile up in a worker.

    Shuffle files go when the action that wrote them ends, so disk holds one action's at a time. The session
    keeps these three settings: results are computed when the caller writes them.
    """
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def words_sql(column: str = "text") -> str:
    """SQL for the words of a text as an array; none for null."""
    return f"regexp_extract_all(coalesce({column}, ''), '[^\\\\x20\\\\x09-\\\\x0D]+', 0)"


def n_words(column: str = "text") -> F.Column:
    """The number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")


_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Bytes hashed at a time; a text longer than that is cut at white space.
CHUNK = 1 << 19
#: Words longer than that are hashed one by one.
LONG_WORD = 64


def _pieces(texts: list[bytes]):
    """(first text, its pieces joined by a space and the pieces' offsets, whether the last text goes on) of CHUNK bytes or so."""
    held, size, first = [], 0, 0
    for k, text in enumerate(texts):
        while len(text) > CHUNK:
            if held:
                yield first, held, False
                held, size = [], 0
            cut = CHUNK
            while cut < len(text) and not _SPACE[text[cut]]:
                cut += 1
            yield k, [text[:cut]], True
            text, first = text[cut:], k
        if not held:
            first = k
        held.append(text)
        size += len(text) + 1
        if size > CHUNK:
            yield first, held, False
            held, size = [], 0
    if held:
        yield first, held, False


def hash_words(texts: list[bytes], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a batch end to end, and each text's first place (one more at the end).

    A word is read in blocks of eight bytes, each folded in by a multiplication and a bijective scramble, so
    words of one length up to eight bytes never collide and longer ones only by chance. All words of a batch
    take a block at a time, in whole arrays; words over LONG_WORD bytes go through xxh3 one by one.
    """
    counts, out = np.zeros(len(texts), np.int64), []
    start_value = np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for first, held, _ in _pieces(texts):
        joined = b" ".join([b"", *held, b""])
        data = np.frombuffer(joined + bytes(8), np.uint8)
        space = _SPACE[data[: len(joined)]]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        start, size = edge[::2], edge[1::2] - edge[::2]
        blocks = np.ndarray((len(joined),), "<u8", data, strides=(1,))  # eight bytes from any place on
        value = start_value + size.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        there, at, left = slice(None), start, size
        for _ in range(LONG_WORD // 8):
            block = blocks[at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.minimum(left, 8).astype(np.uint64) * np.uint64(8)))
            value[there] = mixed((value[there] ^ block) * np.uint64(0xFF51AFD7ED558CCD))
            more = np.flatnonzero(left > 8)
            if not len(more):
                break
            there = more if isinstance(there, slice) else there[more]
            at, left = at[more] + 8, left[more] - 8
        for k in np.flatnonzero(size > LONG_WORD).tolist():
            value[k] = xxhash.xxh3_64_intdigest(joined[start[k] : start[k] + size[k]], seed)
        out.append(value)
        stops = np.cumsum([len(x) + 1 for x in held]) + 1
        counts[first : first + len(held)] += np.diff(np.searchsorted(start, stops), prepend=0)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(counts, out=starts[1:])
    return np.concatenate(out) if out else np.empty(0, np.uint64), starts


#: Odd multipliers for rolling hashes, from the golden ratio by repeated squaring.
MULTIPLIERS = [pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) for k in range(64)]


def rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every run of size consecutive word hashes (none if there are fewer)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out += hashes[k : k + n] * np.uint64(MULTIPLIERS[k])
    return mixed(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def texts(column) -> list[bytes]:
    """An Arrow string column as UTF-8 bytes, null as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def lean(produce):
    """produce for mapInArrow, giving memory back when a task ends: workers are reused, and what one holds counts for its executor."""

    def run(batches):
        try:
            yield from produce(batches)
        finally:
            release_memory()

    return run


def release_memory() -> None:
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library gives back by itself
        pass


def sized(df: DataFrame, payload: F.Column | None = None) -> DataFrame:
    """df, marked for broadcast if its rows and bytes allow that."""
    n, size = df.agg(F.count("*"), F.coalesce(F.sum(F.lit(0) if payload is None else payload), F.lit(0))).first()
    return F.broadcast(df) if n <= BROADCAST_ROWS and size + 32 * n <= BROADCAST_BYTES else df


def sha256_in_order(rows: DataFrame, key: list[str], order: list[str], piece: str, joiner: str) -> DataFrame:
    """key, sha256 (lowercase hex) of each key's pieces joined in order. A key's pieces stream through one task, which holds none of them."""

    def digest(batches):
        import pyarrow as pa

        held = state = None
        for batch in batches:
            out = []
            for k, data in zip(zip(*(batch[c].to_pylist() for c in key)), texts(batch[piece])):
                if state is None or k != held:
                    if state is not None:
                        out.append((*held, state.hexdigest()))
                    held, state = k, hashlib.sha256(data)
                else:
                    state.update(joiner.encode() + data)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [*(batch[c].type for c in key), pa.string()])], names=[*key, "sha256"])
            types = [batch[c].type for c in key]
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*held, state.hexdigest()), [*types, pa.string()])], names=[*key, "sha256"])

    ordered = rows.select(*key, *order, piece).repartition(*key).sortWithinPartitions(*key, *order)
    return ordered.mapInArrow(digest, StructType([*rows.select(*key).schema.fields, StructField("sha256", StringType())]))
