"""Vectors, snapshots, the file source and sessions."""

import os

import numpy as np

from lodestone.operators import search, vectors
from lodestone.sources import files, lake
from lodestone.streaming import watch


def put(root, rel, data):
    path = os.path.join(root, rel)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data if isinstance(data, bytes) else data.encode())


def test_embedding():
    a = vectors.embed(["open the billing invoice", "open the billing invoice", ""])
    assert a.shape == (3, 256) and np.allclose(a[0], a[1]) and abs(np.linalg.norm(a[0]) - 1) < 1e-4 and not a[2].any()
    assert vectors.embed(["x"], 3).shape == (1, 16)


def test_knn_fusion_and_rerank(spark):
    v = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(6)], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in vectors.nearest(v, [1.0, 0.0], 3).collect()] == [2, 5, 1]
    many = vectors.nearest_many(v, v.filter("vec_id < 2").withColumnRenamed("vec_id", "query_id"), 2, block=1).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in many) == [(0, 1, 0), (0, 2, 1), (1, 1, 2), (1, 2, 5)]
    one = spark.createDataFrame([(1, 0), (2, 1)], "id long, place int")
    two = spark.createDataFrame([(2, 0), (3, 1)], "id long, place int")
    fused = vectors.fuse([one, two], "id", 3).collect()
    assert [r.id for r in fused] == [2, 1, 3] and fused == vectors.fuse([two, one], "id", 3).collect()
    assert (vectors.pool_size(5), vectors.pool_size(20), vectors.pool_size(50), vectors.pool_size(200)) == (20, 80, 100, 200)
    hits = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "idx long, text string")
    order = spark.createDataFrame([(0, 2), (1, 9), (2, 2), (3, 0)], "pos int, idx long")
    assert [r.idx for r in vectors.apply_order(hits, order, 4).collect()] == [2, 0]
    frame, used = vectors.rerank(hits, "q", lambda q, ts: [(0, 0.1), (2, 0.9), (7, 0.8)], 3)
    assert used and [r.idx for r in frame.collect()] == [2, 0]
    assert vectors.rerank(hits, "q", None, 2)[1] is False

    def broken(q, ts):
        raise OSError("no network")

    assert [r.idx for r in vectors.rerank(hits, "q", broken, 2)[0].collect()] == [0, 1]


def test_provider_batches(spark):
    frame = spark.createDataFrame([(f"h{i}", "x" * i) for i in range(5)], "hash string, text string")
    got = {r["hash"]: r["embedding"] for r in vectors.embed_with(frame, lambda: lambda ts: [[float(len(t)), 0.0] for t in ts], 2).collect()}
    assert got["h3"] == [1.0, 0.0] and got["h0"] == [0.0, 0.0]


def test_file_source_and_ignores(spark, tmp_path):
    root = str(tmp_path)
    os.makedirs(tmp_path / ".git")
    put(root, ".gitignore", "build/\n*.log\n!keep.log\n")
    for rel in ("pkg/__init__.py", "_priv.py", ".hidden/x.py", "build/out.py", "a.log", "keep.log", "own/snap.txt"):
        put(root, rel, "x = 1\n")
    put(root, "bin.dat", b"ab\x00cd")
    put(root, "bad.txt", b"a\xffb")
    put(root, "big.txt", b"a" * (files.MOST_BYTES + 1))
    put(root, "edge.txt", b"a" * files.MOST_BYTES)
    got = {r.rel: r.content for r in lake.scan(spark, root, (os.path.join(root, "own"),)).collect()}
    assert set(got) == {"pkg/__init__.py", "_priv.py", "keep.log", "bad.txt", "edge.txt"} and got["bad.txt"] == "a�b"


def test_snapshots_refresh_and_damage(spark, tmp_path):
    root, folder = str(tmp_path / "src"), str(tmp_path / "lake")
    put(root, "a.rs", "fn one() {\n}\n\nshared\n")
    put(root, "b.rs", "shared\n")
    os.makedirs(folder)
    first = lake.build(spark, root, folder)
    assert first.manifest["files"] == 2 and first.manifest["blocks"] == 3 and first.manifest["vectors"] == 2
    assert lake.refresh(lake.load(spark, folder), root)[1] == 0
    put(root, "c.rs", "fn three() {\n}\n")
    os.remove(os.path.join(root, "a.rs"))
    second, n = lake.refresh(lake.load(spark, folder), root)
    assert n == 2 and second.manifest["files"] == 2 and second.manifest["vectors"] == 2
    fresh = lake.build(spark, root, str(tmp_path / "other")) if os.makedirs(tmp_path / "other") is None else None
    assert fresh.manifest["fingerprint"] == second.manifest["fingerprint"]
    assert search.search(second.table("blocks"), "one", 5).count() == 0
    assert {r.rel for r in search.search(second.table("blocks"), "three", 5).collect()} == {"c.rs"}
    os.remove(os.path.join(root, "c.rs"))
    third, n = lake.refresh(lake.load(spark, folder), root)
    assert n == 1 and third.manifest["files"] == 1
    with open(os.path.join(folder, "CURRENT"), "w") as f:
        f.write("garbage")
    assert lake.load(spark, folder) is None and lake.load(spark, str(tmp_path / "nowhere")) is None


def test_sessions(spark):
    rows = [("2024-01-01 00:00:00.000", "a"), ("2024-01-01 00:00:00.200", "b"), ("2024-01-01 00:00:00.450", "a"), ("2024-01-01 00:00:01.000", "c")]
    log = spark.createDataFrame(rows, "ts string, path string").selectExpr("cast(ts as timestamp) ts", "path")
    assert [(r.n_events, r.paths) for r in watch.sessions(log).orderBy("start").collect()] == [(3, ["a", "b"]), (1, ["c"])]


def test_changes_stream(spark, tmp_path):
    root, folder = str(tmp_path / "src"), str(tmp_path / "lake")
    put(root, "a.txt", "alpha\n")
    os.makedirs(folder)
    query = watch.follow(spark, root, folder, str(tmp_path / "ck"), "0 seconds")
    try:
        query.processAllAvailable()
        put(root, "b.txt", "beta\n")
        query.processAllAvailable()
        os.remove(os.path.join(root, "a.txt"))
        query.processAllAvailable()
    finally:
        query.stop()
    assert {r.rel for r in lake.load(spark, folder).table("files").collect()} == {"b.txt"}


def test_scan_filter_keeps_files_up_to_the_limit(spark, tmp_path):
    from lodestone.plans import queries

    texts = [(1, "a" * 20_000), (2, "a" * files.MOST_BYTES), (3, "a" * (files.MOST_BYTES + 1)), (4, "a\0")]
    spark.createDataFrame([(i, "s", t) for i, t in texts], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r.file_id for r in queries.scan_filter(spark, str(tmp_path)).collect()) == [1, 2]


def test_ignore_files_of_user_repository_and_parents(tmp_path):
    repo, root = tmp_path / "repo", tmp_path / "repo" / "sub"
    put(str(repo), ".git/info/exclude", "excluded.txt\n")
    put(str(repo), ".gitignore", "*.tmp\n/sub/gone/\n")
    put(str(tmp_path), "mine", "personal.*\n")
    put(str(root), "in/.gitignore", "local.txt\n")
    ig = files.Ignores(str(root), excludes=str(tmp_path / "mine"))
    assert all(ig.ignored(x) for x in ("a.tmp", "in/b.tmp", "gone/x.rs", "excluded.txt", "in/excluded.txt", "personal.md", "in/local.txt"))
    assert not any(ig.ignored(x) for x in ("a.txt", "in/gone/x.rs", "local.txt", "in/a.rs"))
    outside = files.Ignores(str(tmp_path), excludes=str(tmp_path / "mine"))
    assert outside.base is None and not outside.ignored("personal.md")
    put(str(tmp_path), "home/.gitconfig", "[user]\n name = x\n[core]\n\texcludesFile = ~/ig\n")
    assert files.excludes_file(str(tmp_path / "home"), str(tmp_path / "none")) == str(tmp_path / "home" / "ig")
    assert files.excludes_file(str(tmp_path / "none"), str(tmp_path / "c")) == str(tmp_path / "c" / "git" / "ignore")


def test_file_numbers_differ(monkeypatch):
    monkeypatch.setattr(files, "file_id", lambda rel: len(rel) % 2)
    got = files.file_ids(["a", "b", "cc", "d"])
    assert len(set(got.values())) == 4 and got == files.file_ids(["d", "cc", "b", "a"])


def test_damage_in_any_table_shows(spark, tmp_path):
    root = str(tmp_path / "src")
    put(root, "a.rs", "fn one() {\n}\n\nshared words here\n" * 50)
    for name in lake.TABLES:
        folder = str(tmp_path / name)
        os.makedirs(folder)
        made = lake.build(spark, root, folder)
        parts = [os.path.join(d, n) for d, _, ns in os.walk(os.path.join(folder, made.id, name)) for n in ns if n.endswith(".parquet")]
        part = max(parts, key=os.path.getsize)
        assert lake.load(spark, folder) is not None
        with open(part, "r+b") as f:
            f.seek(os.path.getsize(part) // 4)
            byte = f.read(1)
            f.seek(-1, os.SEEK_CUR)
            f.write(bytes([byte[0] ^ 0xFF]))
        crc = os.path.join(os.path.dirname(part), "." + os.path.basename(part) + ".crc")
        if os.path.exists(crc):
            os.remove(crc)
        spark.catalog.clearCache()
        assert lake.load(spark, folder, verify=True) is None


def test_refresh_of_some_paths(spark, tmp_path):
    root, folder = str(tmp_path / "src"), str(tmp_path / "lake")
    for k in range(4):
        put(root, f"f{k}.txt", f"text {k}\n")
    os.makedirs(folder)
    made = lake.build(spark, root, folder)
    put(root, "f0.txt", "changed\n")
    put(root, "f1.txt", "changed but not named\n")
    os.remove(os.path.join(root, "f2.txt"))
    now, n = lake.refresh(made, root, ["f0.txt", "f2.txt", "f3.txt", "none.txt"])
    assert n == 2 and {r.rel: r.content for r in now.table("files").collect()} == {"f0.txt": "changed\n", "f1.txt": "text 1\n", "f3.txt": "text 3\n"}
