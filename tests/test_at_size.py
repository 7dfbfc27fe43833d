"""What larger tables bring: numbers beyond a long, and work that must not pile up in a worker, a task or on disk."""

import random
import tracemalloc

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandkeep.functions import chunking
from strandkeep.operators import gc, large_files, workspace
from strandkeep.plans import catalog, disk
from strandkeep.sources import working_tree
from strandkeep.sources.state_log import StateLog
from strandkeep.sources.tables import table

#: Bytes of a batch at most.
BATCH = 4 << 20


def test_sizes_beyond_a_long(spark, tmp_path):
    keys = [(1, 1000), (1, 1000), (2000, 300), (9_000_000, 1_200_000), (60_000_000, 8_000_000)]
    spark.createDataFrame(keys, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = catalog.queries()["fn_format_bytes"](spark, str(tmp_path)).collect()
    sizes = {k * k * p for k, p in keys}
    assert {int(r.n) for r in got} == sizes and len(got) == len(sizes)
    assert {int(r.n): r.shown for r in got} == {1000: "1000 B", 1_200_000_000: "1.12 GB"} | {n: f"{n / 1024 / 1024 / 1024:.2f} GB" for n in sizes if n > 10**18}


def test_python_functions_get_small_batches(spark, tmp_path):
    """What a worker holds follows from its largest batch: neither the rows of a table nor their length may make that grow."""
    own = spark.newSession()
    own.range(6000, numPartitions=1).selectExpr("id AS doc_id", "repeat('line of text\n', IF(id < 3000, 1, 200)) AS text").write.parquet(f"{tmp_path}/documents.parquet")

    def seen(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "bytes"])

    got = table(own, str(tmp_path), "documents").mapInArrow(seen, "n long, bytes long").collect()
    assert sum(r.n for r in got) == 6000 and max(r.n for r in got) <= 1000 and max(r.bytes for r in got) <= 1.5 * BATCH


def test_pandas_functions_get_small_batches(spark, tmp_path):
    """As the named queries call them: ten times as much text as a batch holds must not come at once."""
    own = spark.newSession()
    own.range(400, numPartitions=1).selectExpr("id AS doc_id", "repeat('line of text\n', 8000) AS text").write.parquet(f"{tmp_path}/documents.parquet")

    @F.pandas_udf("long")
    def seen(texts: pd.Series) -> pd.Series:
        return pd.Series([int(texts.str.len().sum())] * len(texts))

    got = [r.n for r in table(own, str(tmp_path), "documents").select(seen("text").alias("n")).collect()]
    assert len(got) == 400 and max(got) <= 1.5 * BATCH


@pytest.mark.parametrize("name", ["cnt13_side_by_side", "cnt7_three_way_lines", "src10_reassembly", "cnt5_text_shape", "cnt23_captured_work"])
def test_queries_bound_their_batches(spark, tiny, name):
    own = spark.newSession()
    catalog.queries()[name](own, tiny)
    assert int(own.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= BATCH


def test_a_long_patch_takes_no_multiple_of_its_length(monkeypatch):
    """Cuts are found a block of fingerprints at a time, and are those of all fingerprints at once."""
    data = random.Random(7).randbytes(16 << 20)
    chunking.gear()
    tracemalloc.start()
    try:
        ends = chunking.cuts(data)
        assert tracemalloc.get_traced_memory()[1] < len(data)
    finally:
        tracemalloc.stop()
    assert ends[-1] == len(data) and max(b - a for a, b in zip([0, *ends], ends, strict=False)) <= chunking.MAX_SIZE
    short = data[: 600 << 10]
    last = len(short) - chunking.MAX_SIZE  # up to there what follows moves no cut
    for block in (len(short), 4099, chunking.REACH):
        monkeypatch.setattr(chunking, "BLOCK", block)
        assert [x for x in chunking.cuts(short) if x < last] == [x for x in ends if x < last]


def test_carried_patches_are_in_no_join(spark):
    """Their length is what a carried row has; a join with the chunk lists must not shuffle all patches for it."""
    rows = spark.range(20).selectExpr("string(id) AS path", "'c' AS base_commit", "'b' AS branch", "encode(repeat('x', int(id)), 'utf-8') AS patch", "1 AS changed_files", "1 AS staged_files")
    carried = workspace.capture(rows).carried

    def joins(node):
        below = [node.children().apply(k) for k in range(node.children().size())]
        return [x.schema().simpleString() for x in below if node.nodeName() == "Join"] + [s for x in below for s in joins(x)]

    sides = joins(carried._jdf.queryExecution().optimizedPlan())
    assert len(sides) == 2 and not any("binary" in s for s in sides)
    assert {(r.path, r.patch_bytes) for r in carried.collect()} == {(str(k), k) for k in range(1, 20)}


def test_a_plan_works_its_contents_out_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def made(k):
        seen.add(1)
        return f"content {k}"

    rows = spark.range(50, numPartitions=4).withColumn("text", F.udf(made)("id")).where("length(text) > 3")
    writes = rows.select(F.concat(F.lit("a/b"), F.col("id") % 3, F.lit("/"), "id").alias("path"), F.encode("text", "utf-8").alias("content"))
    assert working_tree.apply(writes, writes.select("path").limit(0), str(tmp_path)) == (50, 0, 0)
    assert seen.value <= 100  # the filter and the column may call it once each
    assert (tmp_path / "a/b1/49").read_bytes() == b"content 49"


def test_contents_of_long_files_move_as_rarely_as_can_be(spark):
    """Placing pieces shuffles them once, before their table is written; entries come to the contents and not the other way round."""
    rows = [(f"f{k % 3}", k, b"x" * 1000) for k in range(300)]
    placed = large_files.offsets(spark.createDataFrame(rows, "file string, order int, content binary").repartition(5))
    chunks = large_files.chunk_ranges(large_files.of_pieces(placed, 90_000))
    for df in (placed, chunks):
        assert "Exchange hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString()
    assert {(r.file, r.order): r.offset for r in placed.collect()} == {(f, k): k // 3 * 1000 for f, k, _ in rows}


def test_objects_are_put_in_as_many_tasks_as_their_bytes_take(spark, tmp_path, monkeypatch):
    own, tasks, write = spark.newSession(), [], disk.object_files.write
    own.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16k")
    own.conf.set("spark.sql.shuffle.partitions", "64")
    text = "array_join(transform(sequence(1, 100), x -> sha2(concat(id, ' ', x), 256)), '')"
    own.range(400, numPartitions=4).selectExpr("id AS doc_id", f"{text} AS text").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(disk.object_files, "write", lambda rows, root: tasks.append(rows.rdd.getNumPartitions()) or write(rows, root))
    got = catalog.queries()["snk1_object_files"](own, str(tmp_path)).collect()
    assert len(got) == 400 and {r.created for r in got} == {1} and all(r.chunk_id == r.sha256 for r in got)
    assert tasks[0] > 12


def test_a_large_bucket_takes_several_tasks(spark, tmp_path):
    own = spark.newSession()
    own.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16k")
    log = StateLog(own, f"file://{tmp_path}/log")
    rows = own.range(40_000, numPartitions=4).selectExpr("id", "sha2(string(id), 256) AS x")

    def work(change):
        change.create("t", rows.schema, ["id"], 2)
        change.append("t", rows)

    log.change(work)
    files = [list(f.glob("*.parquet")) for f in (tmp_path / "log/data/t").glob("*/__bucket=*")]
    assert len(files) == 2 and min(map(len, files)) > 2
    assert log.at().read("t").exceptAll(rows).isEmpty() and log.at().read("t").count() == 40_000


def test_a_collection_copies_no_table_that_stands(spark, tiny, monkeypatch):
    """Of the state that a log holds nothing is written again before it has changed; pins are its largest table."""
    copied, stash = [], gc.stash
    monkeypatch.setattr(gc, "stash", lambda df: copied.append(set(df.columns)) or stash(df))
    assert catalog.queries()["sta9_collect_garbage"](spark, tiny).count() > 0
    assert copied and {"head", "object"} not in copied
