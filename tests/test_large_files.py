"""Files cut range by range: the very chunks of each file as a whole."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandkeep.functions import chunking
from strandkeep.operators import large_files as L
from strandkeep.sources import files


def contents():
    rng = random.Random(3)
    noise = rng.randbytes(700_000)
    periodic = rng.randbytes(9_001) * 60
    words = b" ".join(rng.choice([b"alpha", b"beta", b"gamma", b"delta"]) for _ in range(90_000))
    mixed = noise[:150_000] + bytes(300_000) + noise[150_000:400_000] + b"ab" * 120_000 + noise[:90_000]
    own = {"noise": noise, "zeros": bytes(500_000), "ones": b"\x01" * 400_001, "periodic": periodic, "words": words, "mixed": mixed}
    own |= {f"size{n}": noise[:n] for n in (1, 2048, 2049, 65_536, 80_000, 80_001, 160_000, 160_000 + 2048, 145_537)} | {"empty": b""}
    return own


def whole(data):
    ends = chunking.cuts(data)
    return [(a, b - a, hashlib.sha256(data[a:b]).hexdigest()) for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


def grouped(rows):
    out = {}
    for r in rows:
        assert hashlib.sha256(r.chunk).hexdigest() == r.chunk_id and len(r.chunk) == r.length
        out.setdefault(r.file, []).append((r.offset, r.length, r.chunk_id))
    return {file: sorted(x) for file, x in out.items()}


def test_ends_are_those_of_the_whole():
    for data in contents().values():
        if data:
            cutter, at, out = L.Cutter(data), 0, []
            while at < len(data):
                at = int(cutter.ends(np.array([at]))[0])
                out.append(at)
            assert out == chunking.cuts(data)


def test_exits_are_those_of_every_entry_followed():
    for data in contents().values():
        if len(data) > 200_000:
            cutter, length = L.Cutter(data[:165_536]), 100_000
            got = L.exits(data[:165_536], length)
            for entry in [0, 1, 5, 2047, 2048, 9000, 40_000, 65_535]:
                at = entry
                while at < length:
                    at = int(cutter.ends(np.array([at]))[0])
                assert got[entry] == at - length


@pytest.mark.parametrize("split", [80_000, 65_536, 30_000])
def test_trees_are_cut_as_wholes(spark, tmp_path, split):
    for name, data in contents().items():
        (tmp_path / name).write_bytes(data)
    ranges = L.of_tree(files.listed(spark, str(tmp_path)), str(tmp_path), split)
    assert grouped(L.chunk_ranges(ranges).collect()) == {name: whole(data) for name, data in contents().items() if data}


def test_pieces_are_cut_as_wholes(spark):
    rng, rows = random.Random(5), []
    for name, data in contents().items():
        at = k = 0
        while at < len(data) or k == 0:
            size = rng.choice([0, 1, 500, 20_000, 250_000])
            rows.append((name, k, data[at : at + size]))
            at, k = at + size, k + 1
        rows.append((name, k, None))
    rng.shuffle(rows)
    placed = L.offsets(spark.createDataFrame(rows, "file string, order int, content binary").repartition(7))
    got = L.chunk_ranges(L.of_pieces(placed, 90_000)).collect()
    assert grouped(got) == {name: whole(data) for name, data in contents().items() if data}
    none = spark.createDataFrame([], "file string, order int, content binary")
    assert L.chunk_ranges(L.of_pieces(L.offsets(none))).count() == 0


def test_a_plan_without_chunks_reads_none(spark, tmp_path):
    (tmp_path / "a").write_bytes(contents()["mixed"])
    ranges = L.of_tree(files.listed(spark, str(tmp_path)), str(tmp_path), 100_000)
    got = L.chunk_ranges(ranges, with_chunks=False)
    assert got.columns == ["file", "offset", "length", "chunk_id"]
    assert sorted(r[1:] for r in got.collect()) == whole(contents()["mixed"])
    assert got.agg(F.sum("length")).first()[0] == len(contents()["mixed"])
