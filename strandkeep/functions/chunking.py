"""Content-defined chunking: cut positions, chunk tables, and the object envelope.

A rolling fingerprint decides where a chunk ends, so an insertion moves the cuts around it and no others. Only
the last 50 bytes can reach the masks, so the fingerprints of a file are computed with shifted array sums, a
block at a time; the least size, the change of mask and the greatest size are applied to the candidate positions after.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandkeep import settings

# Fixed values of the format: least, average and greatest chunk size; masks before and after the average.
MIN_SIZE, AVG_SIZE, MAX_SIZE = 2048, 8192, 65536
MASK_SMALL, MASK_LARGE = 0x0003590703530000, 0x0000D90003530000
#: Bytes that can still reach the masks' highest bit.
REACH = 50
#: Bytes whose fingerprints stand in memory at a time; they take some 24 times as much.
BLOCK = 1 << 18
# Fixed values of the envelope: magic, version, deflate flag, and the share under which compression is kept.
MAGIC, VERSION, DEFLATED, WORTH = b"W", 1, 1, 0.95


@functools.cache
def gear(namespace: str | None = None) -> np.ndarray:
    """256 mixing values: the first eight bytes, little-endian, of SHA-256 of "<namespace>/gear/v1/<i>"."""
    name = namespace or settings.NAMESPACE
    return np.array([int.from_bytes(hashlib.sha256(f"{name}/gear/v1/{k}".encode()).digest()[:8], "little") for k in range(256)], np.uint64)


def _candidates(data: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the masks before and after the average match the fingerprint of the last REACH bytes, or of all where there are fewer."""
    small, large = [], []
    for start in range(0, len(data), BLOCK):
        lead = min(start, REACH - 1)
        values = table[data[start - lead : start + BLOCK]]
        full = np.zeros(len(values), np.uint64)
        for k in range(min(REACH, len(values))):
            full[k:] += values[: len(values) - k] << np.uint64(k)
        for found, mask in ((small, MASK_SMALL), (large, MASK_LARGE)):
            found.append(np.flatnonzero((full[lead:] & np.uint64(mask)) == 0) + start)
    return np.concatenate(small), np.concatenate(large)


def cuts(data: bytes, table: np.ndarray | None = None) -> list[int]:
    """Where the chunks of data end; none for empty data.

    A chunk's fingerprint starts at zero and takes its first byte at MIN_SIZE. The byte at which the mask
    matches belongs to the next chunk. Up to MIN_SIZE bytes make one chunk.
    """
    n = len(data)
    if n <= MIN_SIZE:
        return [n] if n else []
    table = gear() if table is None else table
    small, large = _candidates(np.frombuffer(data, np.uint8), table)
    out, start = [], 0
    while n - start > MIN_SIZE:
        first, last = start + MIN_SIZE, min(n, start + MAX_SIZE)
        turn = min(last, start + AVG_SIZE)
        cut, mark = 0, 0
        for at in range(first, min(first + REACH - 1, last)):  # the fingerprint does not hold REACH bytes yet
            mark = (mark << 1) + int(table[data[at]]) & 0xFFFFFFFFFFFFFFFF
            if mark & (MASK_SMALL if at < turn else MASK_LARGE) == 0:
                cut = at
                break
        at = first + REACH - 1
        if not cut and at < turn:
            k = np.searchsorted(small, at)
            cut = int(small[k]) if k < len(small) and small[k] < turn else 0
        if not cut and max(at, turn) < last:
            k = np.searchsorted(large, max(at, turn))
            cut = int(large[k]) if k < len(large) and large[k] < last else 0
        start = cut or last
        out.append(start)
    if start < n:
        out.append(n)
    return out


def split(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


_SPANS = T.ArrayType(T.StructType().add("position", T.IntegerType()).add("offset", T.LongType()).add("length", T.IntegerType()))


@F.pandas_udf(_SPANS)
def chunk_spans(contents: pd.Series) -> pd.Series:
    """The chunks of each blob as places; empty for null and empty blobs."""
    out = []
    for data in contents:
        ends = cuts(bytes(data)) if data is not None else []
        out.append([{"position": k, "offset": a, "length": b - a} for k, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True))] if ends else [])
    return pd.Series(out)


def chunk(files: DataFrame, content: str = "content") -> DataFrame:
    """files exploded to position, offset, length, chunk_id and chunk (bytes); the slices are cut and hashed in the JVM."""
    spans = files.withColumn("__span", F.explode(chunk_spans(content)))
    spans = spans.select("*", "__span.*").drop("__span")
    piece = F.substring(F.col(content), (F.col("offset") + 1).cast("int"), F.col("length"))
    return spans.withColumn("chunk", piece).withColumn("chunk_id", F.sha2("chunk", 256)).drop(content)


def encode(data: bytes) -> bytes:
    """The stored form of an object: header, then the bytes, deflated if that is worth it."""
    packed = zlib.compress(data, 9)
    deflated = len(packed) < WORTH * len(data)
    return MAGIC + struct.pack("<BBBI", VERSION, DEFLATED if deflated else 0, 0, len(data)) + (packed if deflated else data)


def decode(stored: bytes) -> bytes:
    """The object's bytes; raises for a wrong magic, version or length."""
    if len(stored) < 8 or stored[:1] != MAGIC:
        raise ValueError("not an object")
    version, flags, _, length = struct.unpack("<BBBI", stored[1:8])
    if version != VERSION:
        raise ValueError(f"object version {version} is not known")
    data = zlib.decompress(stored[8:]) if flags & DEFLATED else stored[8:]
    if len(data) != length:
        raise ValueError(f"the object holds {len(data)} bytes, its header says {length}")
    return data


@F.pandas_udf(T.BinaryType())
def encode_objects(contents: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in contents:
        yield batch.map(lambda x: None if x is None else encode(bytes(x)))


@F.pandas_udf(T.BinaryType())
def decode_objects(stored: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in stored:
        yield batch.map(lambda x: None if x is None else decode(bytes(x)))
