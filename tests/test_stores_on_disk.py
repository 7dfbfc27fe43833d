"""Objects and trees on a shared folder: created once, whole or not at all."""

import hashlib
import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from strandkeep.sources import files, object_files, working_tree
from strandkeep.sources.object_files import put_file


def hashed(contents):
    return [(hashlib.sha256(c).hexdigest(), c) for c in contents]


def test_twelve_tasks_create_an_object_once(spark, tmp_path):
    root = f"file://{tmp_path}/objects"
    same = hashed([b"the same " * 5000])[0]
    rows = spark.createDataFrame([same] * 48, "chunk_id string, content binary").repartition(12)
    done = object_files.write(rows, root).collect()
    assert len(done) == 48 and sum(r.created for r in done) == 1 and {r.bytes for r in done} == {45000}
    assert sum(r.created for r in object_files.write(rows, root).collect()) == 0
    assert [r.bytes for r in object_files.listed(spark, root).collect()] == [45000]
    assert not [n for _, _, names in os.walk(tmp_path) for n in names if n.startswith(".")]


def test_twelve_writers_of_a_name(tmp_path):
    path = str(tmp_path / "a" / "b")
    for k in range(20):
        with ThreadPoolExecutor(12) as pool:
            won = list(pool.map(lambda w, k=k: put_file(f"{path}{k}", f"writer {w} ".encode() * 1000), range(12)))
        with open(f"{path}{k}", "rb") as file:
            assert sum(won) == 1 and file.read() == f"writer {won.index(True)} ".encode() * 1000


def test_reads_open_what_is_asked_for(spark, tmp_path):
    root = str(tmp_path)
    rows = hashed([f"object {k}".encode() for k in range(60)] + [b""])
    object_files.write(spark.createDataFrame(rows, "chunk_id string, content binary"), root).count()
    for shard in os.listdir(tmp_path):  # what is not asked for is out of reach
        if shard not in {rows[3][0][:2], rows[60][0][:2]}:
            os.rename(tmp_path / shard, tmp_path / f"hidden-{shard}")
    ids = spark.createDataFrame([(rows[3][0],), (rows[60][0],), ("0" * 64,)], "chunk_id string")
    assert {r.chunk_id: r.content and bytes(r.content) for r in object_files.read(ids, root).collect()} == {rows[3][0]: b"object 3", rows[60][0]: b"", "0" * 64: None}
    assert {r.chunk_id[:2] for r in object_files.listed(spark, root, [rows[3][0][:2]]).collect()} == {rows[3][0][:2]}


def test_corrupt_objects_and_odd_ids_raise(spark, tmp_path):
    (chunk_id, content), root = hashed([b"fine"])[0], str(tmp_path)
    object_files.write(spark.createDataFrame([(chunk_id, content)], "chunk_id string, content binary"), root).count()
    (tmp_path / chunk_id[:2] / chunk_id[2:]).write_bytes(b"else")
    ids = spark.createDataFrame([(chunk_id,)], "chunk_id string")
    with pytest.raises(Exception, match="corrupt object"):
        object_files.read(ids, root).collect()
    assert bytes(object_files.read(ids, root, verified=False).first().content) == b"else"
    with pytest.raises(Exception, match="not an object id"):
        object_files.write(spark.createDataFrame([("../../x", b"")], "chunk_id string, content binary"), root).collect()
    with pytest.raises(ValueError, match="no mounted folder"):
        object_files.read(ids, "hdfs://there/x")


def test_quarantine_moves_once(spark, tmp_path):
    rows, root = hashed([b"a", b"b"]), str(tmp_path)
    object_files.write(spark.createDataFrame(rows, "chunk_id string, content binary"), root).count()
    asked = spark.createDataFrame([(rows[0][0],), ("f" * 64,)], "chunk_id string")
    for _ in range(2):
        assert {r.chunk_id: r.moved for r in object_files.quarantine(asked, root, "20240131T000000Z").collect()} == {rows[0][0]: True, "f" * 64: False}
    assert [r.chunk_id for r in object_files.listed(spark, root).collect()] == [rows[1][0]]


def tree(root):
    out = {}
    for folder, _, names in os.walk(root):
        for n in names:
            path = os.path.relpath(os.path.join(folder, n), root)
            if not path.startswith(working_tree.META):
                with open(os.path.join(folder, n), "rb") as file:
                    out[path] = file.read()
    return out


@pytest.fixture
def place(spark, tmp_path):
    root = tmp_path / "tree"
    for path in ("keep.txt", "old/deep/one", "old/two", "was/dir/file"):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(f"before {path}")
    return root


def plan(spark, writes, deletes=()):
    return spark.createDataFrame(list(writes), "path string, content binary"), spark.createDataFrame([(d,) for d in deletes], "path string")


def test_a_plan_is_applied(spark, place):
    writes, deletes = plan(spark, [("new/с\tтаб", b"n"), ("old/two", b"after"), ("was", b"a file now"), ("empty", b"")], ["old/deep/one", "was/dir/file", "not there"])
    writes = writes.withColumn("executable", F.col("path") == "empty").withColumn("modified_utc", F.lit("2024-01-02 03:04:05").cast("timestamp"))
    assert working_tree.apply(writes, deletes, f"file://{place}") == (4, 2, 3)
    assert tree(place) == {"keep.txt": b"before keep.txt", "new/с\tтаб": b"n", "old/two": b"after", "was": b"a file now", "empty": b""}
    assert os.access(place / "empty", os.X_OK) and not os.access(place / "was", os.X_OK) and os.stat(place / "was").st_mtime == 1704164645
    assert not os.path.exists(place / "old" / "deep") and os.listdir(place / working_tree.META) == []


@pytest.mark.parametrize(
    ("writes", "deletes", "why"),
    [
        (["../up"], [], "leaves the root"), (["/etc/x"], [], "leaves the root"), (["a/../../b"], [], "leaves the root"), ([], ["../keep.txt"], "leaves the root"), (["a/../b"], [], "not plain"), (["a//b"], [], "not plain"),
        ([".git/config"], [], "not the tree's"), (["x/.git/hooks/y"], [], "not the tree's"), ([f"{working_tree.META}/applying"], [], "not the tree's"), (["x", "x"], [], "named twice"), (["x"], ["x"], "named twice"),
        (["x", "x/y"], [], "a file and a directory"), (["keep.txt/y"], [], "a file and a directory"), (["old"], ["old/two"], "a file and a directory"), (["link/x"], [], "a file and a directory"), ([], ["link/two"], "through a link"),
    ],
)
def test_what_is_refused_changes_nothing(spark, place, writes, deletes, why):
    (place / "link").symlink_to(place / "old")
    before = tree(place)
    with pytest.raises(ValueError, match=why):
        working_tree.apply(*plan(spark, [("fine.txt", b"1"), *((w, b"2") for w in writes)], deletes), str(place))
    assert tree(place) == before and os.listdir(place / working_tree.META) == []


def test_a_crash_before_the_decision_changes_nothing(spark, place, monkeypatch):
    before = tree(place)
    writes, deletes = plan(spark, [("a/b", b"1"), ("old/two", b"2")], ["keep.txt"])
    monkeypatch.setattr(working_tree, "_staged", lambda *a: (_ for _ in ()).throw(OSError("disk full")))
    with pytest.raises(OSError, match="disk full"):
        working_tree.apply(writes, deletes, str(place))
    assert tree(place) == before
    monkeypatch.undo()
    put_file(str(place / working_tree.META / "applying"), b"gone")  # a driver that died: its lock and stage are left
    (place / working_tree.META / "apply-gone" / "files").mkdir(parents=True)
    with pytest.raises(working_tree.Busy):
        working_tree.apply(writes, deletes, str(place))
    assert working_tree.recover(spark, str(place)) is None and tree(place) == before and os.listdir(place / working_tree.META) == []
    assert working_tree.apply(writes, deletes, str(place)) == (2, 1, 0)


def test_a_crash_after_the_decision_is_finished(spark, place, monkeypatch):
    writes, deletes = plan(spark, [("a/b", b"1"), ("old/two", b"2"), ("c", b"3")], ["keep.txt", "was/dir/file"])
    carried_out = working_tree._carried_out

    def half(spark, top, stage):
        os.unlink(os.path.join(top, "keep.txt"))
        os.makedirs(os.path.join(top, "a"))
        os.replace(os.path.join(stage, "files", "a/b"), os.path.join(top, "a/b"))
        raise OSError("killed")

    monkeypatch.setattr(working_tree, "_carried_out", half)
    with pytest.raises(OSError, match="killed"):
        working_tree.apply(writes, deletes, str(place))
    monkeypatch.setattr(working_tree, "_carried_out", carried_out)
    with pytest.raises(working_tree.Busy):
        working_tree.apply(writes, deletes, str(place))
    assert working_tree.recover(spark, str(place)) == (3, 1, 2)
    assert tree(place) == {"a/b": b"1", "c": b"3", "old/deep/one": b"before old/deep/one", "old/two": b"2"} and os.listdir(place / working_tree.META) == []
    assert working_tree.recover(spark, str(place)) is None


def test_a_listed_tree_is_what_was_written(spark, place):
    rows = [(f"d{k % 7}/e{k % 3}/f{k}", f"{k}".encode()) for k in range(200)]
    working_tree.apply(*plan(spark, rows), str(place))
    assert {r.path: r.size for r in files.listed(spark, str(place)).collect()}.items() >= {p: len(c) for p, c in rows}.items()
