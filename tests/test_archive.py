"""Whole runs over a small tree: create, list, append, delete, compact, verify, extract."""

import io
import os

import pytest

from shelfmark.errors import Locked, NoMatch, Partial
from shelfmark.operators import catalog as O
from shelfmark.operators import listing, order
from shelfmark.plans.archive import Archive
from shelfmark.plans.store import Store
from shelfmark.sources import tree as T
from shelfmark.streaming.generations import append


@pytest.fixture
def tree(tmp_path):
    top = tmp_path / "in"
    (top / "src").mkdir(parents=True)
    (top / "src/a.txt").write_bytes(b"the same content\n" * 3000)
    (top / "src/b.txt").write_bytes(b"the same content\n" * 3000)
    (top / "src/large.bin").write_bytes(bytes(range(256)) * 1000 + os.urandom(3000))
    (top / "empty").write_bytes(b"")
    (top / "tool.sh").write_bytes(b"#!/bin/sh\n")
    os.chmod(top / "tool.sh", 0o750)
    os.link(top / "src/large.bin", top / "zlink")
    (top / "sym").symlink_to("src/a.txt")
    os.utime(top / "src/a.txt", ns=(1_700_000_000_000_000_007,) * 2)
    return top


def listed(archive):
    return {r["path"]: r for r in O.live(archive.rows()).collect()}


@pytest.mark.parametrize("spec, params", [("zstd", {"level": "3"}), ("none", {}), ("xz", {"preset": "1"})])
def test_round_trip(spark, tree, tmp_path, spec, params):
    archive = Archive(spark, str(tmp_path / "store"))
    assert archive.create(T.read_tree(spark, str(tree)), str(tree), spec, params, chunk=4096) == 1
    rows = listed(archive)
    assert rows["src/b.txt"]["data"] == rows["src/a.txt"]["id"] and rows["src/b.txt"]["len"] is None and rows["empty"]["codec"] == -1
    assert rows["zlink"]["type"] == "hardlink" and rows["zlink"]["hardlink"] == rows["src/large.bin"]["id"]
    offsets = sorted((r["off"], r["len"]) for r in rows.values() if r["len"])
    assert offsets[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(offsets, offsets[1:]))
    assert O.violations(archive.rows(), 1, strict=True).count() == 0 and O.out_of_range(archive.rows(), 0, sum(offsets[-1])).count() == 0
    assert all(r["ok"] for r in archive.verify().collect()) and all(r["ok"] for r in archive.verify(quick=True).collect()) and archive.verify(["src"]).count() == 3
    out = tmp_path / "out"
    archive.extract(str(out))
    for name in ("src/a.txt", "src/b.txt", "src/large.bin", "empty", "tool.sh", "zlink"):
        assert (out / name).read_bytes() == (tree / name).read_bytes(), name
    assert os.readlink(out / "sym") == "src/a.txt" and (out / "zlink").stat().st_ino == (out / "src/large.bin").stat().st_ino
    assert (out / "tool.sh").stat().st_mode & 0o7777 == 0o750 and (out / "src/a.txt").stat().st_mtime_ns == 1_700_000_000_000_000_007
    text = io.BytesIO()
    archive.to_stream(text, ["src/a.txt", "tool.sh"])
    assert text.getvalue() == b"the same content\n" * 3000 + b"#!/bin/sh\n"


def test_generations_of_a_tree(spark, tree, tmp_path):
    archive = Archive(spark, str(tmp_path / "store"))
    archive.create(T.read_tree(spark, str(tree)), str(tree), "zstd", {"level": "3"}, chunk=4096)
    assert archive.append(T.read_tree(spark, str(tree)), str(tree), update="digest") == 1  # nothing changed
    (tree / "tool.sh").write_bytes(b"#!/bin/sh\necho\n")
    (tree / "new.txt").write_bytes(b"the same content\n" * 3000)
    os.unlink(tree / "sym")
    (tree / "sym").symlink_to("tool.sh")
    before = listed(archive)
    assert archive.append(T.read_tree(spark, str(tree)), str(tree), update="digest", spec="gzip", chunk=4096) == 2
    rows = listed(archive)
    assert rows["sym"]["link"] == "tool.sh" and rows["new.txt"]["data"] == rows["src/a.txt"]["id"] and rows["src/a.txt"]["id"] == before["src/a.txt"]["id"] and rows["zlink"]["id"] == before["zlink"]["id"]
    assert min(r["id"] for r in rows.values() if r["gen"] == 2) > max(r["id"] for r in before.values()) and len(archive.codecs()) == 2
    with pytest.raises(NoMatch):
        archive.delete(["tool.sh", "nothing-there"])
    assert archive.delete(["src/a.txt"]) == 3 and archive.dead_space() > 0
    assert archive.compact() == 4 and archive.dead_space() == 0
    rows = {r["path"]: r for r in archive.rows().collect()}
    assert rows["src/a.txt"]["dead"] and not rows["src/b.txt"]["dead"] and all(r["ok"] for r in archive.verify().collect())
    assert archive.compact("xz", {"preset": "2"}) == 5 and archive.codecs() == [{"name": "xz", "params": {"preset": "2"}}] and all(r["ok"] for r in archive.verify().collect())
    out = tmp_path / "out"
    archive.extract(str(out), exclude=["large.bin"], strip=0)
    assert sorted(os.listdir(out)) == ["empty", "new.txt", "src", "sym", "tool.sh", "zlink"] and (out / "zlink").read_bytes() == (tree / "src/large.bin").read_bytes()
    archive.extract(str(tmp_path / "cut"), ["src"], strip=1)
    assert sorted(os.listdir(tmp_path / "cut")) == ["b.txt", "large.bin"]
    (out / "new.txt").write_bytes(b"mine")
    archive.extract(str(out), ["new.txt"], policy="keep")
    assert (out / "new.txt").read_bytes() == b"mine"


def test_damage_is_found(spark, tree, tmp_path):
    archive = Archive(spark, str(tmp_path / "store"))
    archive.create(T.read_tree(spark, str(tree)), str(tree), "none", chunk=4096)
    content = archive.store.manifest()["content"][0]
    from pyspark.sql import functions as F

    stored = archive.stored()
    owner = listed(archive)["src/a.txt"]["id"]
    bad = F.when((F.col("id") == owner) & (F.col("pos") == 1), F.concat(F.substring("stored", 1, 10), F.lit(b"?"), F.expr("substring(stored, 12)"))).otherwise(F.col("stored"))
    stored.withColumn("stored", bad).write.parquet(str(tmp_path / "changed"))
    os.rename(tmp_path / "store" / content, tmp_path / "was")
    os.rename(tmp_path / "changed", tmp_path / "store" / content)
    assert {r["path"] for r in archive.verify().filter("not ok").collect()} == {"src/a.txt", "src/b.txt"} and all(r["ok"] for r in archive.verify(quick=True).collect())
    with pytest.raises(Exception, match="digest differs"):
        archive.extract(str(tmp_path / "out"))


def test_walk(spark, tree, tmp_path):
    (tree / "src/deep").mkdir()
    (tree / "src/deep/x.txt").write_text("x")
    paths = lambda **options: [e[1] for e in T.entries(str(tree), **options)]
    assert paths() == [".", "empty", "src", "src/a.txt", "src/b.txt", "src/deep", "src/deep/x.txt", "src/large.bin", "sym", "tool.sh", "zlink"]
    assert paths(exclude=["src/*"]) == [".", "empty", "src", "sym", "tool.sh", "zlink"] and "src/deep/x.txt" not in paths(exclude=["deep"])
    assert "src/a.txt" not in paths(exclude=["[^b].txt"]) and "src/b.txt" in paths(exclude=["[^b].txt"])
    assert paths(one_file_system=True) == paths()
    s = os.stat(tree / "src")
    assert "src" not in paths(skip={(s.st_dev, s.st_ino)})
    (tree / "src/back").symlink_to("..")
    with pytest.raises(Partial):
        paths(follow=True)
    with pytest.raises(Partial):
        T.open_seen(str(tree), "tool.sh", s.st_dev, s.st_ino)


def test_sockets_are_left_out_and_first_rows_win(spark, tree):
    import socket

    at = os.getcwd()
    os.chdir(tree)
    try:
        with socket.socket(socket.AF_UNIX) as s:
            s.bind("sock")
    finally:
        os.chdir(at)
    seen = T.read_tree(spark, str(tree), digests=False)
    assert seen.filter("type = 'socket'").count() == 1
    twice = seen.unionByName(seen.selectExpr("seq + 1000 as seq", *[c for c in seen.columns if c != "seq"]))
    assert T.first_seen(twice).agg({"seq": "max"}).first()[0] < 1000 and T.first_seen(twice).count() == seen.count()


def test_numbers_in_blocks(spark):
    rows = spark.range(5000).selectExpr("hash(id) % 977 as k", "id", "id % 3 as g", "id % 5 as v")
    got = [(r["k"], r["id"], r["n"], r["t"]) for r in order.running_total(order.numbered(rows, ["k", "id"], "n"), ["k", "id"], rows["v"], "t").collect()]
    total = 0
    for i, (k, n_id, n, t) in enumerate(sorted(got, key=lambda r: (r[0], r[1]))):
        assert n == i and t == total
        total += n_id % 5
    per = order.numbered(rows, ["k", "id"], "n", ["g"]).collect()
    assert all(sorted(r["n"] for r in per if r["g"] == g) == list(range(sum(r["g"] == g for r in per))) for g in range(3))
    assert order.every_kth(rows, ["k", "id"], 7).count() == 715 and order.next_id(rows) == 5000 and order.next_id(rows.limit(0)) == 1
    nulls = spark.createDataFrame([(None, 1), (2, 2), (None, 3)], "a int, id long")
    assert [r["n"] for r in order.numbered(nulls, ["a", "id"], "n").orderBy("id").collect()] == [0, 2, 1] and order.numbered(nulls.limit(0), ["a"], "n").count() == 0


def test_stream_batches_are_merged_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([(5, "a", "reg", 5, "x", 10, False, 1), (4, "a", "reg", 6, "y", 11, False, 1), (6, "b", "reg", 5, "x", 10, False, 1)], "id long, path string, type string, size long, digest string, mtime long, dead boolean, gen long")
    assert append(store, rows, batch=0, query="q", new_ids=True) == 1 and append(store, rows, batch=0, query="q") == 1
    assert sorted((r["id"], r["path"], r["size"]) for r in store.read().collect()) == [(1, "a", 6), (2, "b", 5)]
    assert append(store, rows, batch=1, query="q", new_ids=True) == 2 and append(store, rows, batch=1, query="q") == 2 and append(store, rows, batch=0, query="other", update="digest") == 2
    assert sorted((r["id"], r["dead"]) for r in store.read().collect()) == [(1, True), (2, True), (3, False), (4, False)]


def test_a_failed_commit_leaves_nothing(spark, tmp_path):
    from pyspark.sql import functions as F

    store = Store(spark, str(tmp_path / "s"))
    rows = spark.range(3).select("id", F.when(F.col("id") == 2, F.raise_error(F.lit("broken"))).otherwise("x").alias("path"))
    with pytest.raises(Exception, match="broken"):
        store.commit(rows, 0)
    assert store.latest() == 0 and os.listdir(tmp_path / "s/snapshots") == []
    store.commit(rows.filter("id < 2"), 0)
    with pytest.raises(Locked):
        store.commit(rows.filter("id < 2"), 0)


def test_listing_of_an_archive(spark, tree, tmp_path):
    import json

    archive = Archive(spark, str(tmp_path / "store"))
    archive.create(T.read_tree(spark, str(tree)), str(tree), "zstd", {"level": "3"}, chunk=4096)
    archive.delete(["src/a.txt"])
    rows, codecs = archive.rows(), archive.codec_table()
    long = {r["name"].split(" ")[0]: r for r in listing.long_rows(rows, codecs).collect()}
    assert long["sym"]["name"] == "sym -> src/a.txt" and long["zlink"]["name"] == "zlink link to src/large.bin" and long["zlink"]["stored"] == "-"
    assert long["src/b.txt"]["name"] == "src/b.txt same as deleted src/a.txt" and long["src/b.txt"]["codec"] == "-" and len(long["src/b.txt"]["digest"]) == 16
    assert long["src/large.bin"]["codec"] == "zstd:level=3" and long["src/large.bin"]["chunks"] == "64" and long["tool.sh"]["mode"] == "-rwxr-x---"
    objects = {r["path"]: json.loads(r["line"]) for r in listing.json_lines(rows, codecs).collect()}
    assert objects["src/b.txt"]["same_as"] == "src/a.txt" and objects["src/b.txt"]["same_as_deleted"] is True and objects["src/b.txt"]["stored_size"] == 0 and objects["empty"]["stored_size"] == 0
    assert objects["zlink"]["hardlink_to"] == "src/large.bin" and objects["sym"]["target"] == "src/a.txt" and objects["src/large.bin"]["codec"] == {"name": "zstd", "params": {"level": "3"}} and "digest" not in objects["sym"]
    info = {r["key"]: r["value"] for r in listing.info_lines(rows, codecs, archive.dead_space()).collect()}
    assert info["members"].endswith("1 tombstoned") and info["shared content"].startswith("1 member, ")
    line = listing.totals_line(O.totals(rows)).first()["line"]
    assert "4 files" in line and "1 same as another" in line and line.endswith("generation 1, 1 tombstoned")
    assert listing.aligned([["a", "bb", "c"], ["aaa", "b", "cc"]], {1}) == ["a    bb  c", "aaa   b  cc"]


def test_encrypted_archive(spark, tree, tmp_path):
    from shelfmark.errors import Usage
    from shelfmark.functions import sealing as K

    path = str(tmp_path / "store")
    archive = Archive(spark, path)
    archive.create(T.read_tree(spark, str(tree)), str(tree), "zstd", {"level": "3"}, chunk=4096)
    plain = listed(archive)
    assert archive.encrypt(b"word", 12) == 2 and all(r["ok"] for r in archive.verify().collect())
    rows = listed(archive)
    assert rows["src/a.txt"]["digest"] == rows["src/b.txt"]["digest"] != plain["src/a.txt"]["digest"] and rows["empty"]["digest"] not in (None, plain["empty"]["digest"]) and rows["src/large.bin"]["len"] > plain["src/large.bin"]["len"]
    with pytest.raises(Usage):
        Archive(spark, path).verify()
    with pytest.raises(K.WrongPassphrase):
        Archive(spark, path, b"wrong")
    other = Archive(spark, path, b"word")
    (tree / "more.txt").write_bytes(b"the same content\n" * 3000)
    (tree / "other.txt").write_bytes(b"other " * 5000)
    assert other.append(T.read_tree(spark, str(tree)), str(tree), update="digest", chunk=4096) == 3
    rows = listed(other)
    assert rows["more.txt"]["data"] == rows["src/a.txt"]["id"] and {p for p, r in rows.items() if r["gen"] == 3} == {"more.txt", "other.txt", "."}
    assert other.change_passphrase(b"word", b"new") == 4 and other.compact() == 5
    last = Archive(spark, path, b"new")
    assert all(r["ok"] for r in last.verify().collect())
    last.extract(str(tmp_path / "out"))
    assert (tmp_path / "out/other.txt").read_bytes() == b"other " * 5000 and (tmp_path / "out/zlink").read_bytes() == (tree / "src/large.bin").read_bytes()
    with pytest.raises(K.WrongPassphrase):
        Archive(spark, path, b"word")
    with pytest.raises(Usage):
        last.encrypt(b"again")


def test_archive_with_a_dictionary(spark, tmp_path):
    top = tmp_path / "in"
    top.mkdir()
    for i in range(400):
        (top / f"f{i:03}.json").write_text(f'{{"name": "user{i}", "roles": ["reader", "writer"], "created": "2024-{i % 12 + 1:02}-01", "active": {i % 2}}}' * 3)
    archive, bare = Archive(spark, str(tmp_path / "store")), Archive(spark, str(tmp_path / "bare"))
    seen = T.read_tree(spark, str(top))
    archive.create(seen, str(top), "zstd", {"train": "4K"})
    bare.create(seen, str(top), "zstd")
    held = lambda a: sum(r["len"] or 0 for r in a.rows().collect())
    assert archive.codecs()[0]["dict"] == archive.dictionaries().first()["id"] and held(archive) < held(bare) and all(r["ok"] for r in archive.verify().collect())
    (top / "new.json").write_text('{"name": "user", "roles": ["reader", "writer"], "created": "2024-01-01", "active": 1}' * 2)
    archive.append(T.read_tree(spark, str(top)), str(top), update="digest", spec="zstd", params={"train": "4K"})
    assert archive.dictionaries().count() == 1 and len(archive.codecs()) == 1 and all(r["ok"] for r in archive.verify().collect())
    archive.compact("gzip")
    assert archive.dictionaries().count() == 0 and all(r["ok"] for r in archive.verify().collect())


def test_changes_are_merged_and_rewritten(spark, tmp_path, monkeypatch):
    from shelfmark.plans import store as module

    monkeypatch.setattr(module, "MOST_CHANGES", 3)
    store = Store(spark, str(tmp_path / "s"))
    schema = "id long, path string, type string, size long, digest string, mtime long, dead boolean, gen long"
    for n in range(1, 8):
        rows = [(10 * n, "a", "reg", n, f"d{n}", n, False, n), (10 * n + 1, f"p{n}", "reg", 1, "x", 1, False, n)]
        assert append(store, spark.createDataFrame(rows, schema), update="digest") == n
        assert len(store.manifest().get("changes", [])) == (n - 1) % 4
    got = {r["id"]: (r["path"], r["dead"]) for r in store.read().collect()}
    assert got == {10 * n: ("a", n < 7) for n in range(1, 8)} | {10 * n + 1: (f"p{n}", False) for n in range(1, 8)}
    assert {r["id"] for r in store.read(2).filter("not dead").collect()} == {20, 11, 21}
    with pytest.raises(Locked):
        store.commit_changes(store.read().limit(0), store.read().limit(0), 6)


def test_owners_attributes_holes_and_devices(spark, tmp_path):
    top = tmp_path / "in"
    (top / "d").mkdir(parents=True)
    (top / "d/holes").write_bytes(b"x" * 4096 + bytes(40 * 4096) + b"y" * 10 + bytes(8192))
    (top / "zeros").write_bytes(bytes(16 * 4096))
    (top / "own").write_bytes(b"own")
    root = os.geteuid() == 0
    if root:
        os.chown(top / "own", 1234, 4321)
        os.chmod(top / "own", 0o4755)
    try:
        os.setxattr(top / "own", "user.note", b"kept")
        noted = True
    except OSError:
        noted = False
    try:
        os.mknod(top / "null", 0o20666, os.makedev(1, 3))
        made = True
    except OSError:
        made = False
    archive = Archive(spark, str(tmp_path / "store"))
    archive.create(T.read_tree(spark, str(top)), str(top), "zstd", chunk=4096)
    out = tmp_path / "out"
    archive.extract(str(out), owners=root, devices=made)
    for name in ("d/holes", "zeros", "own"):
        assert (out / name).read_bytes() == (top / name).read_bytes()
    s = os.stat(out / "own")
    assert not root or (s.st_uid, s.st_gid, s.st_mode & 0o7777) == (1234, 4321, 0o4755)
    assert not noted or os.getxattr(out / "own", "user.note") == b"kept"
    assert not made or os.stat(out / "null").st_rdev == os.makedev(1, 3)
    assert os.stat(out / "d/holes").st_blocks <= os.stat(top / "d/holes").st_blocks
