import hashlib

import pytest
from pyspark.sql import functions as F

from shelfmark.errors import Conflict, Corrupt, Locked, Usage
from shelfmark.functions import codecs as C
from shelfmark.operators import catalog as O
from shelfmark.plans.store import Store
from shelfmark.sources.tree import read_tree, write_tree
from shelfmark.streaming.generations import append

SCHEMA = "id long, path string, type string, size long, digest string, mtime long, mode int, dead boolean"


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


@pytest.mark.parametrize("update, mtime, size, digest, want", [
    ("newer", 10, 5, "x", "unchanged"), ("newer", 11, 5, "x", "replace"), ("newer", 9, 6, "y", "unchanged"), ("different", 9, 5, "x", "replace"), ("different", 10, 6, "x", "replace"),
    ("different", 10, 5, "y", "unchanged"), ("digest", 11, 5, "x", "unchanged"), ("digest", 10, 5, "y", "replace"),
])
def test_update(spark, update, mtime, size, digest, want):
    old = rows(spark, (1, "a", "reg", 5, "x", 10, 420, False))
    seen = rows(spark, (2, "a", "reg", size, digest, mtime, 420, False))
    assert O.merge_plan(seen, old, update=update).first()["action"] == want


def test_conflict_and_delete(spark):
    old = rows(spark, (1, "a", "reg", 5, "x", 10, 420, False))
    with pytest.raises(Conflict):
        O.merge_plan(old, old, policy="error")
    with pytest.raises(Usage):
        O.tombstone(old, [])
    assert O.tombstone(old, ["a"]).first()["dead"]


def test_kept_follows_links_then_owners(spark):
    df = spark.createDataFrame([(1, True, None, None), (2, True, None, 1), (3, False, 2, None), (4, True, None, None), (5, True, None, 4)], "id long, dead boolean, hardlink long, data long")
    assert sorted(r["id"] for r in O.kept(df).collect()) == [1, 2, 3]


def test_best_trial_stops_after_two_misses(spark):
    t = spark.createDataFrame([(50, 400, True), (60, 500, True), (70, 500, True), (80, 1, True)], "size long, n long, ok boolean")
    assert O.best_trial(t, 500, 4000, 1000).first()["gain"] == 350


def test_violations(spark):
    df = spark.createDataFrame([(1, "a", "reg", 5, "x", 420, 0, None, None, 5), (1, "../b", "door", 5, None, 9999, 7, 9, 8, 1)], "id long, path string, type string, size long, digest string, mode int, codec int, data long, hardlink long, len long")
    found = {r["rule"] for r in O.violations(df, 5).collect()}
    assert {"duplicate id", "unknown type", "unsafe path", "mode bits", "codec out of range", "sharer with a blob", "owner", "hard link target"} <= found
    with pytest.raises(Corrupt):
        O.assert_valid(df, 5)


def test_every_kind_of_difference(spark):
    schema = "id long, path string, type string, size long, digest string, mtime long, mode int, dead boolean, link string, hardlink long, rdev array<bigint>, uid long, gid long, xattrs map<string,binary>"

    def entry(id, path, type="reg", size=1, digest="x", mtime=1, mode=420, dead=False, link=None, hardlink=None, rdev=None, uid=5, gid=5, xattrs=None):
        return (id, path, type, size, digest, mtime, mode, dead, link, hardlink, rdev, uid, gid, xattrs)

    acl = "system.posix_acl_access"
    old = spark.createDataFrame([
        entry(1, "same"), entry(2, "gone", "dir"), entry(3, "gone/a"), entry(4, "type"), entry(5, "size"), entry(6, "content"), entry(7, "link", "symlink", link="x"), entry(8, "hl", "hardlink", size=0, digest=None, hardlink=1),
        entry(9, "dev", "chardev", rdev=[1, 2]), entry(10, "mode"), entry(11, "owner"), entry(12, "unowned", uid=None, gid=None), entry(13, "mtime"), entry(14, "x", xattrs={"user.a": b"1", acl: b"1"}), entry(15, "way/f"), entry(16, "old", dead=True)], schema)
    tree = schema.replace("id long, ", "", 1).replace(", hardlink long", "").replace(", dead boolean", "") + ", dev long, ino long"

    def seen(ino, path, **changes):
        e = entry(0, path, **changes)
        return (*e[1:7], e[8], *e[10:], 1, ino)

    disk = spark.createDataFrame([
        seen(1, "same"), seen(2, "type", type="dir", mode=1), seen(3, "size", size=2, digest="y"), seen(4, "content", digest="y"), seen(5, "link", type="symlink", link="y", mode=1), seen(6, "hl"), seen(7, "dev", type="chardev", rdev=[1, 3]), seen(8, "mode", mode=1),
        seen(9, "owner", uid=6), seen(10, "unowned", uid=6), seen(11, "mtime", mtime=2), seen(12, "x", xattrs={"user.a": b"2"}), seen(13, "way", type="dir"), seen(14, "way/f"), seen(15, "new", type="dir"), seen(16, "new/a"), seen(17, "s", type="socket")], tree)
    got = [(r["path"], r["kind"], r["archive"], r["disk"], r["names"]) for r in O.differences(old, disk).orderBy("rank", "path").collect()]
    assert got == [
        ("gone", "missing", None, None, None), ("new", "extra", None, None, None), ("type", "type", "reg", "dir", None), ("size", "size", "1", "2", None), ("content", "content", None, None, None), ("link", "link", "x", "y", None), ("hl", "hardlink", "same", None, None),
        ("dev", "device", "1,2", "1,3", None), ("mode", "mode", "420", "1", None), ("owner", "owner", "5/5", "6/5", None), ("mtime", "mtime", "1", "2", None), ("x", "xattrs", None, None, ["user.a"]), ("x", "acls", None, None, [acl])]


def test_generations(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    schema = SCHEMA + ", gen long"
    first = spark.createDataFrame([(1, "a", "reg", 5, "x", 10, 420, False, 1), (2, "b", "reg", 5, "x", 10, 420, False, 1)], schema)
    assert append(store, first) == 1
    assert append(store, first, update="digest") == 1  # nothing changed, no generation
    assert append(store, spark.createDataFrame([(3, "a", "reg", 6, "y", 11, 420, False, 2)], schema), update="newer") == 2
    assert sorted((r["id"], r["dead"]) for r in store.read().collect()) == [(1, True), (2, False), (3, False)]
    with pytest.raises(Locked):
        store.commit(first, 1)
    (tmp_path / "store/manifests/00000003.json").write_text("{half")
    assert store.latest() == 2 and store.repair() == 2 and not (tmp_path / "store/manifests/00000003.json").exists()


def test_codecs():
    for name in C.REGISTRY:
        for plain in (b"", b"a" * 5000, bytes(range(256)) * 3, b"\x00"):
            assert C.decode(C.encode(plain, name, C.level(name, {})), name, len(plain)) == plain
    assert C.crc32c(b"123456789") == 0xE3069283
    with pytest.raises(Usage):
        C.level("zstd", {"level": "23"})


def test_tree(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/f.txt").write_text("x")
    (tmp_path / "z").symlink_to("d")
    got = [(r["path"], r["type"]) for r in read_tree(spark, str(tmp_path)).orderBy("seq").collect()]
    assert got == [(".", "dir"), ("d", "dir"), ("d/f.txt", "reg"), ("z", "symlink")]


def test_tree_round_trip(spark, tmp_path):
    import hashlib

    schema = "id long, path string, type string, mode int, mtime long, link string, hardlink long, data long, digest string, dead boolean"
    sha = hashlib.sha256(b"one").hexdigest()
    old = spark.createDataFrame([
        (1, "d", "dir", 0o700, 5_000_000_007, None, None, None, None, False), (2, "d/f", "reg", 0o640, 6_000_000_001, None, None, None, sha, False), (3, "d/g", "reg", 0o600, 7, None, None, 2, sha, False), (4, "h", "hardlink", None, None, None, 2, None, None, False),
        (5, "old", "reg", 0o600, 9, None, None, None, sha, True), (6, "p", "hardlink", None, None, None, 5, None, None, False), (7, "q", "hardlink", None, None, None, 5, None, None, False), (8, "z", "symlink", 0o777, 8_000_000_009, "d/f", None, None, None, False)], schema)
    content = spark.createDataFrame([(2, bytearray(b"one")), (5, bytearray(b"one"))], "id long, bytes binary")
    write_tree(O.extraction(O.live(old), old), old, content, str(tmp_path / "out"))
    got = {r["path"]: r for r in read_tree(spark, str(tmp_path / "out")).collect()}
    assert sorted(got) == [".", "d", "d/f", "d/g", "h", "p", "q", "z"]
    assert all(got[p]["digest"] == sha for p in ("d/f", "d/g", "h", "p", "q"))
    assert got["h"]["ino"] == got["d/f"]["ino"] != got["d/g"]["ino"] and got["p"]["ino"] == got["q"]["ino"]
    assert [got[p]["mtime"] for p in ("d", "d/f", "p", "z")] == [5_000_000_007, 6_000_000_001, 9, 8_000_000_009] and got["d"]["mode"] == 0o700 and got["d/f"]["mode"] == 0o640
    with pytest.raises(Exception, match="digest differs"):
        write_tree(O.extraction(O.live(old), old), old, content.withColumn("bytes", F.lit(b"two")), str(tmp_path / "bad"))
    outside = old.filter("id = 2").withColumn("path", F.explode(F.array(F.lit("../f"), F.lit("/f"), F.lit("z/f"))))
    link = old.filter("id = 8").withColumn("link", F.lit(str(tmp_path)))
    for n in range(3):
        one = outside.filter(F.col("path") == ("../f", "/f", "z/f")[n]).union(link)
        with pytest.raises(Exception, match="leaves the target folder"):
            write_tree(O.extraction(one, one), one, content, str(tmp_path / f"out{n}"))
    assert not (tmp_path / "f").exists()


def test_partitioning_changes_nothing(spark):
    df = spark.range(500).select("id", F.concat(F.lit("d"), F.expr("id % 7"), F.lit("/f"), F.col("id")).alias("path"), F.lit("reg").alias("type"), (F.col("id") % 5).alias("size"))
    a, b = (sorted(map(tuple, O.directories(df.repartition(n)).collect())) for n in (1, 17))
    assert a == b


def test_chunk_table_covers_texts_beyond_ascii(spark, tmp_path):
    from shelfmark.plans import catalog_queries

    rows = [(1, "é" * 700), (2, "a" * 511 + "ß" + "b" * 600), (3, "plain"), (4, ""), (5, None), (6, "€" * 512)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for d, t in rows:
        data = (t or "").encode()
        want += [(d, k // 512, hashlib.md5(data[k : k + 512]).hexdigest()) for k in range(0, len(data), 512)]
    assert sorted(map(tuple, catalog_queries.chunk_table(spark, str(tmp_path)).collect())) == want
