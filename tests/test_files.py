from datetime import datetime

import pytest
from pyspark.sql import functions as F

from strandkeep import settings
from strandkeep.operators import policy, snapshots
from strandkeep.sources import files


def test_walk_of_a_tree(spark, tmp_path):
    for name in ("a.txt", "docs/b.md", "docs/secret.pem", "keys/x", "node_modules/m/i.js", "repo/.git/config", "repo/src/c.py", "linked/.git", "linked/d.py", f"docs/b.md.{settings.NAMESPACE}-theirs", f".{settings.NAMESPACE}/HEAD"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(name)
    rules = policy.parse_policy(["node_modules"], ["*.pem", "keys"])
    for pruned in (None, rules):
        listed = files.listed(spark, str(tmp_path), pruned)
        assert ("node_modules/m/i.js" in {r.path for r in listed.collect()}) == (pruned is None)
        seen = files.walk(listed, rules)
        assert [r.root for r in seen.checkouts.collect()] == ["linked", "repo"]
        assert {r.path for r in seen.files.collect()} == {"a.txt", "docs/b.md"}
        assert [r.refused for r in seen.refused.collect()] == ["docs/secret.pem", "keys/"]


def test_json_states(spark):
    good, bad = (spark.createDataFrame([(t,)], "text string") for t in ('{"id": "m", "name": "desk"}', "{oops"))
    assert files.read_json(good, "id string, name string", True).first().value.name == "desk"
    assert files.read_json(bad, "id string, name string", False).first().value.id is None
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        files.read_json(bad, "id string, name string", True).collect()


def test_snapshot_refuses_secrets_and_stores_the_rest(spark):
    rows = [("a.txt", b"plain\n"), ("b.txt", b'x\ntoken = "0123456789abcdef0123"\n'), ("empty", b""), ("n/k.pem", b"no"), ("twin.txt", b"plain\n")]
    df = spark.createDataFrame(rows, "path string, content binary").withColumns({"modified_utc": F.lit(datetime(2024, 1, 1)), "executable": F.lit(False)})
    none = spark.createDataFrame([], "chunk_id string")
    taken = snapshots.create(df, none, policy.parse_policy([], ["*.pem"]), None, ("m", "desk"), F.lit(datetime(2024, 1, 2)), ["p1"])
    assert [(r.path, r.line, r.kind, "0123" in r.excerpt) for r in taken.findings.collect()] == [("b.txt", 2, "assigned_token", False)]
    assert {r.path: len(r.chunks) for r in taken.entries.collect()} == {"a.txt": 1, "b.txt": 1, "empty": 0, "twin.txt": 1}
    assert b'x\ntoken = "0123456789abcdef0123"\n' not in {bytes(r.content) for r in taken.objects.collect()} and taken.objects.count() == 2
    text = taken.snapshot.first().text
    assert "parent p1\n" in text and "files 4\n" in text and text.startswith(f"{settings.NAMESPACE}-snapshot 1\nmanifest ")


def test_lister_and_expression_agree_on_verdicts(spark):
    import random

    rng = random.Random(8)
    names = ["node_modules", "a", "b.tmp", "x.pem", ".env", ".env.example", "keys", "src", "Library", "c.log", "d~"]
    paths = sorted({"/".join(rng.choices(names, k=rng.randrange(1, 5))) for _ in range(300)})
    rules = policy.load_policy("*.log\n!src/**/*.log\nLibrary/\n*~\n\n# note\nnode_modules", None)
    for is_dir in (True, False):
        got = spark.createDataFrame([(p,) for p in paths], "path string").select("path", policy.verdict(rules, "path", is_dir).alias("v")).collect()
        assert {r.path: r.v for r in got} == {p: policy.judge(rules, p, is_dir) for p in paths}
        assert {r.v for r in got} == {"Include", "Ignored", "Never"}


def test_links_to_directories_are_files_and_not_followed(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "x.txt").write_text("x")
    (tmp_path / "a" / "loop").symlink_to(tmp_path)
    (tmp_path / "a" / "b" / "up").symlink_to("..")
    (tmp_path / "gone").symlink_to(tmp_path / "nothing")
    (tmp_path / "alias.txt").symlink_to(tmp_path / "a" / "b" / "x.txt")
    for root in (str(tmp_path), f"file://{tmp_path}", f"file:{tmp_path}"):
        got = {r.path: r.size for r in files.listed(spark, root).collect()}
        assert set(got) == {"a/b/x.txt", "a/loop", "a/b/up", "gone", "alias.txt"} and got["a/b/x.txt"] == got["alias.txt"] == 1
    assert files.listed(spark, str(tmp_path / "not there")).count() == 0


def test_a_snapshot_carries_work_and_repositories(spark):
    from strandkeep.operators import workspace

    files_ = spark.createDataFrame([("a.txt", b"plain\n")], "path string, content binary").withColumns({"modified_utc": F.lit(datetime(2024, 1, 1)), "executable": F.lit(False)})
    none = spark.createDataFrame([], "chunk_id string")
    patches = spark.createDataFrame([("z", "c1", "main", b"+ new line\n", 1, 0), ("b\tc", "c2", None, b"+ other\n", 2, 1), ("empty", "c3", "x", b"", 0, 0), ("unborn", None, "x", b"+ y\n", 1, 0), ("bad", "c4", "x", b'+ token = "0123456789abcdef0123"\n', 1, 0)], "path string, base_commit string, branch string, patch binary, changed_files int, staged_files int")
    repos = spark.createDataFrame([("z", "git@h:z", "main", "c1", True, 1), ("b\tc", None, None, "c2", False, 2)], "path string, remote string, branch string, head string, is_primary boolean, dirty_files int")
    taken = snapshots.create(files_, none, policy.parse_policy([], []), None, ("m", "desk"), F.lit(datetime(2024, 1, 2)), [], patches, repos)
    assert [r.path for r in taken.findings.collect()] == ["bad"] and taken.objects.count() == 4
    lines = taken.snapshot.first().text.split("\n")
    carried = [x for x in lines if x.startswith("carry ")]
    assert [x.split("\t")[:3] for x in carried] == [["carry b c", "c2", ""], ["carry z", "c1", "main"]] and carried[1].endswith("\t11\t1\t0")
    assert [x for x in lines if x.startswith("repo ")] == ["repo b c\t\t\tc2\tw\t2", "repo z\tgit@h:z\tmain\tc1\tp\t1"]
    again = snapshots.create(files_, none, policy.parse_policy([], []), taken.entries, ("m", "desk"), F.lit(datetime(2024, 1, 2)), [], patches, repos)
    assert snapshots.is_unchanged(again, carried_before=taken.carried) and not snapshots.is_unchanged(again)
    moved = taken.carried.withColumn("base_commit", F.lit("c9"))
    assert not snapshots.is_unchanged(again, carried_before=moved) and not snapshots.is_unchanged(again, merging=True, carried_before=taken.carried)
    with pytest.raises(ValueError):
        workspace.abort_merge(None, files_)


def test_tables_on_the_way_are_dropped(spark, tmp_path, monkeypatch):
    from strandkeep import stash

    monkeypatch.setattr(stash, "shared_folder", lambda _: str(tmp_path))
    monkeypatch.setattr(stash, "_written", [[]])
    kept = stash.stash(spark.range(2))
    out = stash.settled(spark, lambda: stash.stash(stash.stash(spark.range(5)).where("id > 1")))
    assert out.count() == 3 and kept.count() == 2 and len(list(tmp_path.iterdir())) == 2
    with pytest.raises(ZeroDivisionError):
        stash.settled(spark, lambda: 1 / 0)
    assert len(stash._written) == 1
    stash.release(spark)
    assert not list(tmp_path.iterdir())


def test_a_cluster_without_a_shared_folder_raises(spark, monkeypatch):
    from types import SimpleNamespace

    from strandkeep import stash

    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://h:7077"))
    with pytest.raises(ValueError, match="share"):
        stash.shared_folder(fake)
    fake.sparkContext.master = "local[2]"
    assert stash.shared_folder(fake) == stash.shared_folder(fake)


def test_a_manifest_streams_through_one_task(spark):
    import hashlib

    from strandkeep.functions import chunking
    from strandkeep.operators import store

    entries = spark.range(30_000).selectExpr("concat('d', id % 97, '/', id, CASE WHEN id % 5 = 0 THEN '\U0001f600' ELSE '' END) AS path", "id AS size", "timestamp'2024-01-01' AS modified_utc", "id % 2 = 0 AS executable", "array(sha2(cast(id AS string), 256)) AS chunks")
    text = store.write_manifests(entries.withColumn("snapshot_id", F.lit("s"))).first().text.encode()
    rows = sorted(store.manifest_chunks(entries.repartition(5)).collect(), key=lambda r: r.position)
    assert [bytes(r.chunk) for r in rows] == chunking.split(text) and len(rows) > 100
    assert all(hashlib.sha256(r.chunk).hexdigest() == r.chunk_id for r in rows) and [r.manifest_id for r in rows if r.manifest_id] == [hashlib.sha256(text).hexdigest()]
    none = store.manifest_chunks(entries.limit(0)).collect()
    assert [(r.position, bytes(r.chunk)) for r in none] == [(0, b"strandkeep-manifest 1\n")]
