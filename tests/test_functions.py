import os

import pytest
from pyspark.sql import functions as F

from shelfmark.errors import Corrupt, NoMatch, Usage
from shelfmark.functions import codecs as C
from shelfmark.functions import dictionaries as D
from shelfmark.functions import paths as P
from shelfmark.functions import render as R
from shelfmark.functions import sealing as K
from shelfmark.functions import sizes
from shelfmark.functions import sparse as H
from shelfmark.operators import catalog as O
from shelfmark.operators import metadata as M


@pytest.mark.parametrize("name, params", [("zstd", {"level": "1"}), ("zstd", {"level": "19", "long": "on"}), ("zstd", {"long": "12"}), ("gzip", {"level": "1"}), ("flate", {}), ("xz", {"preset": "0"}), ("xz", {"preset": "9"}), ("none", {})])
def test_one_stream_and_nothing_behind_it(name, params):
    own = C.checked(name, params)
    for plain in (b"", b"x", b"abc" * 9000, os.urandom(70_000) + b"y" * 300_000):
        assert C.decode(C.encode(plain, name, own), name, len(plain)) == plain
    if name != "none":
        one = C.REGISTRY[name].encode(b"a" * 500, **own)
        for bad in (one + one, one + b"\0", one[:-1], b"\0" + one):
            with pytest.raises(Corrupt):
                C.decode(bad, name, 500)
        with pytest.raises(Corrupt):
            C.decode(one, name, 499)


def test_xz_of_a_large_chunk():
    plain = os.urandom(1 << 20) * 12
    assert len(C.encode(plain, "xz", C.checked("xz", {"preset": "9"}))) < 2 << 20
    assert C.decode(C.encode(plain, "xz", C.checked("xz", {"preset": "9"})), "xz", len(plain)) == plain


def test_parameters():
    assert C.checked("zstd", {}) == {"level": 12} and C.checked("zstd", {"long": "on", "train": "auto"}) == {"level": 12, "long": 27, "train": 1}
    assert C.checked("zstd", {"train": "64K", "long": "off"}) == {"level": 12, "train": 65536}
    for name, params in (("zstd", {"level": "0"}), ("zstd", {"level": "x"}), ("zstd", {"long": "9"}), ("zstd", {"train": "1K"}), ("zstd", {"preset": "1"}), ("lz9", {}), ("xz", {"preset": "10"})):
        with pytest.raises(Usage):
            C.checked(name, params)
    assert C.window_beyond_chunk("zstd", {"long": "27"}, 1 << 20) == (1 << 27, "window") and C.window_beyond_chunk("zstd", {}, 1024) is None and C.window_beyond_chunk("xz", {"preset": "6"}, 1 << 20)[1] == "dictionary"
    assert C.encoder_slots(8, 1 << 30, 64 << 30) == 4 and C.encoder_slots(8, 1 << 40, 1 << 30) == 1 and C.encoder_slots(8, 1, 1 << 30, limit=4) == 2
    assert C.encoder_memory("xz", {}, 1 << 20) > C.encoder_memory("gzip", {}, 1 << 20)


def test_keys():
    keys = K.new_keys()
    header = keys.wrap(b"first", 12)
    assert K.unlock(header, b"first") == keys and keys.data_key not in header.wrapped and "data_key" not in repr(keys)
    changed = K.change_passphrase(header, b"first", b"second")
    assert K.unlock(changed, b"second") == keys and changed.salt != header.salt
    for header_, word in ((changed, b"first"), (K.Header(os.urandom(16), header.salt, 12, header.wrapped), b"first")):
        with pytest.raises(K.WrongPassphrase):
            K.unlock(header_, word)
    assert len({keys.sub("entry"), keys.sub("content"), keys.sub("index", b"1"), keys.sub("index", b"2")}) == 4
    assert K.hkdf(bytes([11]) * 22, bytes(range(0xF0, 0xFA)), bytes(range(13)), 42).hex() == "3cb25f25faacd57a90434f64d0362f2a2d2d0a90cf1a5a4c5db02d56ecc4c5bf34007208d5b887185865"
    K.check_affordable(15, 1 << 30)
    for cost, ram in ((24, 1 << 30), (9, 1 << 40)):
        with pytest.raises(Usage):
            K.check_affordable(cost, ram)


def test_passphrase_sources(tmp_path):
    (tmp_path / "p").write_bytes(b"from file\r\nmore")
    warned, said = [], iter(["a", "a", "a", "b"])
    assert K.passphrase(file=str(tmp_path / "p")) == b"from file" and K.passphrase(variable="P", env={"P": "env"}, warn=warned.append) == b"env" and len(warned) == 1
    assert K.passphrase(ask=lambda _: next(said), twice=True) == b"a"
    for options in ({"ask": lambda _: next(said), "twice": True}, {"variable": "P", "env": {}}, {"ask": lambda _: ""}):
        with pytest.raises(Usage):
            K.passphrase(**options)


def test_seals(spark):
    keys = K.Keys(bytes(range(32)), bytes(16))
    rows = spark.createDataFrame([(i, p, p == 2, bytearray(b"the same")) for i in (1, 2) for p in range(3)], "id long, pos int, final boolean, plain binary")
    sealed = K.seal(rows, keys)
    text = sealed._jdf.queryExecution().toString()
    assert keys.sub("entry").hex() not in text.lower() and K._pads(keys.sub("entry"))[0].hex() not in text.lower()
    got = sealed.collect()
    # no key and nonce repeats: the key is the entry's, the nonce the position
    assert len({bytes(r["sealed"]) for r in got}) == 6 and {bytes(r["sealed"])[:12] for r in got if r["id"] == 1} == {bytes(11) + bytes([p]) for p in range(3)}
    assert all(bytes(r["opened"]) == b"the same" for r in K.unseal(sealed, keys).collect())
    for moved in (sealed.withColumn("id", F.lit(9)), sealed.withColumn("pos", F.lit(7)), sealed.withColumn("final", ~F.col("final")), sealed.withColumn("sealed", F.expr("concat(substring(sealed, 1, length(sealed) - 1), X'00')"))):
        assert K.unseal(moved, keys).filter("opened is not null").count() <= 1
    assert K.unseal(sealed, K.Keys(bytes(32), bytes(16))).filter("opened is not null").count() == 0
    index = K.seal_index(spark, b"rows", keys, 4)
    assert K.open_index(spark, index, keys, 4) == b"rows"
    with pytest.raises(Corrupt):
        K.open_index(spark, index, keys, 5)
    assert K.index_digest(keys, b"u", 1, b"x") != K.index_digest(None, b"u", 1, b"x") != K.index_digest(None, b"u", 2, b"x")


def test_two_passes_refuse_damaged_content(spark):
    keys = K.Keys(bytes(range(32)), bytes(16))
    import hashlib

    sha = hashlib.sha256(b"one").hexdigest()
    rows = spark.createDataFrame([(1, sha, None), (2, sha, 1), (3, None, None)], "id long, digest string, data long")
    content = spark.createDataFrame([(1, bytearray(b"one"))], "id long, bytes binary")
    named, sealed = K.encrypted(rows, content, keys, 2)
    got = {r["id"]: r["digest"] for r in named.collect()}
    assert got[1] == got[2] != sha and got[3] is None and sealed.count() == 2
    with pytest.raises(Corrupt):
        K.encrypted(rows, content.withColumn("bytes", F.lit(b"two")), keys, 2)


def test_dictionaries(spark):
    rows = [(f"f{i:04}", bytearray(f'{{"name": "user{i}", "roles": ["reader", "writer"], "created": "2024-{i % 12 + 1:02}-01", "active": {i % 2}}}'.encode() * 3)) for i in range(2000)]
    content = spark.createDataFrame(rows, "path string, bytes binary").repartition(5)
    assert D.trial_sizes(1 << 15) == [4096, 8192, 16384] and D.trial_sizes(8191) == []
    own = D.trained(spark, content, 40000, 4096)
    assert own and len(own) <= 4096 and D.checked(own, 40000, len(own), __import__("hashlib").sha256(own).hexdigest()) == own
    with pytest.raises(Corrupt):
        D.checked(own, 40001, len(own), __import__("hashlib").sha256(own).hexdigest())
    plain = bytes(rows[7][1])
    packed = C.encode(plain, "zstd", 12, own)
    assert len(packed) < len(C.encode(plain, "zstd", 12)) and C.decode(packed, "zstd", len(plain), own) == plain
    assert D.trained(spark, content, 40000, 1) is not None
    noise = spark.createDataFrame([(f"f{i}", bytearray(os.urandom(2000))) for i in range(100)], "path string, bytes binary")
    assert D.trained(spark, noise, 40000, 1) is None and D.trained(spark, noise.limit(0), 40000, 4096) is None
    dicts = spark.createDataFrame([(1, 4), (2, 9), (3, 9)], "id int, gen int")
    assert D.newest(dicts).first()["id"] == 3 and D.newest(dicts.limit(0)).count() == 0


def test_sparse(spark):
    content = b"\0" * 8192 + b"x" * 100 + b"\0" * 5000 + b"y" + b"\0" * 9000
    df = spark.createDataFrame([(1, bytearray(content)), (2, bytearray(8192)), (3, bytearray(b"")), (4, None), (5, bytearray(b"z"))], "id long, c binary")
    got = {r["id"]: r["s"] for r in df.select("id", H.data_segments(4096)("c").alias("s")).collect()}
    assert [(s["off"], s["len"]) for s in got[1]] == [(8192, 8192)] and got[2] == [] == got[3] and got[4] is None and [(s["off"], s["len"]) for s in got[5]] == [(0, 1)]
    one = df.filter("id = 1").withColumn("s", H.data_segments(4096)("c"))
    back = one.select(H.expand(H.payload(F.col("c"), F.col("s")), F.col("s"), F.octet_length("c").cast("long")).alias("b")).first()["b"]
    assert bytes(back) == content
    assert [r["z"] for r in df.orderBy("id").select(H.all_zero(F.col("c")).alias("z")).collect()] == [False, True, True, None, False]
    segments = F.expr("array(named_struct('off', 5L, 'len', 5L), named_struct('off', 20L, 'len', 2L))")
    gaps = lambda a, b: [tuple(g) for g in spark.range(1).select(H.gaps(F.lit(a).cast("long"), F.lit(b).cast("long"), segments).alias("g")).first()["g"]]
    assert gaps(0, 30) == [(0, 5), (10, 10), (22, 8)] and gaps(6, 9) == [] and gaps(7, 21) == [(10, 10)] and gaps(22, 22) == []


def test_texts(spark):
    names = ["plain é", "a\\b", "x\n\t\r\x1b[2J", "‮rtl", "\x9b31m", "\0nul"]
    got = [r["p"] for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i").select(R.printable(F.col("n")).alias("p")).collect()]
    assert got == ["plain é", "a\\\\b", "x\\n\\t\\r\\x1b[2J", "\\u202ertl", "\\u009b31m", "\\x00nul"]
    times = spark.createDataFrame([(0,), (1_700_000_000_120_000_000,), (-1,)], "t long")
    assert [r["x"] for r in times.select(R.rfc3339("t").alias("x")).collect()] == ["1970-01-01T00:00:00Z", "2023-11-14T22:13:20.12Z", "1969-12-31T23:59:59.999999999Z"]
    assert [sizes.clock(s) for s in (0, 59.4, 61, 3661)] == ["0:00", "0:59", "1:01", "1:01:01"]
    assert sizes.meter(512, 2048, 3, 1.0) == "512 B / 2.0 KiB  25%  512 B/s  0:03 left" and sizes.meter(512, 0, 1, 1.0) == "512 B  1 entry  512 B/s"
    assert sizes.read_list("a\r\n\n# no comment\nb") == ["a", "# no comment", "b"] and sizes.catalog_name("d.x/c") == "d.x/c.shelf" and sizes.catalog_name("c.tar") == "c.tar" and sizes.catalog_name(".c") == ".c.shelf"
    lines = spark.createDataFrame([("p", "link", "a", "b", None, False, None), ("p", "content", None, None, None, True, 7), ("p", "xattrs", None, None, ["user.a", "user.b"], True, None), ("p", "hardlink", "q", None, None, False, None), ("p", "size", "1", "2", None, True, None)], "path string, kind string, archive string, disk string, names array<string>, extracted boolean, at long")
    shown = [r["l"] for r in lines.select(R.difference_line(*map(F.col, ("path", "kind", "archive", "disk", "names")), extracted=F.col("extracted"), offset=F.col("at")).alias("l")).collect()]
    assert shown == ['p: link target differs: archive "a", disk "b"', "p: content differs after extraction, at byte 7", "p: extended attributes differ after extraction: user.a, user.b", "p: not a hardlink of q", "p: size differs after extraction: source 2, extracted 1"]


def test_matcher_agrees_with_the_columns(spark):
    patterns = ["", ".", "a", "a/", "*.txt", "a/*", "[^b].txt", "a[/]b", "[", "?", "**", "\\*", "a/?/c", "[a-c]*"]
    paths = ["a", "b.txt", "a/b", "a/b/c", "x/b.txt", "*", "a/c.txt", "abc", "é.txt"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    for pattern in patterns:
        want = {r["path"]: r["m"] for r in df.select("path", P.matches(F.col("path"), pattern).alias("m")).collect()}
        one = P.matcher([pattern])
        assert {p: one(p) for p in paths} == want, pattern
    assert not P.matcher([])("a")


def test_metadata_rules(spark):
    names = ["user.x", "user.", "system.posix_acl_access", "system.foo", "security.s", "trusted.t", "plain"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", M.attribute_class(F.col("n")).alias("c"))
    assert [r["c"] for r in df.collect()] == ["user", "plain", "acl", "privileged", "privileged", "privileged", "plain"]
    decide = lambda *o: [r["d"] for r in df.select(M.restore_decision(F.col("c"), *map(F.lit, o)).alias("d")).collect()]
    assert decide(False, False, False, False) == ["restore", "restore", "withhold", "skip", "skip", "skip", "restore"]
    assert decide(False, False, False, True) == ["restore", "restore", "restore", "withhold", "withhold", "withhold", "restore"]
    assert decide(False, False, True, True) == ["restore"] * 7 and decide(True, True, True, True) == ["skip"] * 7
    assert M.refused_notice(df.select(F.col("n").alias("name")).limit(0)).count() == 0
    links = spark.createDataFrame([(0, 0, True, True), (5, 0, True, True), (7, 0, True, True), (7, 7, True, True), (7, 0, False, True)], "owner long, dir_owner long, dir_sticky boolean, dir_shared boolean")
    assert [r["follow"] for r in M.may_follow(links, F.lit(5)).collect()] == [True, True, False, True, True]
    assert M.time_precision(1_000_000_000, 1_000_000_000) == 1 and M.time_precision(10, 60) == 100 and M.time_precision(0, 1_500_000_000) == 2_000_000_000 and M.time_precision(0, 3_000_000_000) is None


def test_stale_links_and_deletion(spark):
    schema = "id long, path string, type string, size long, digest string, mtime long, mode int, dead boolean, link string, hardlink long"
    old = spark.createDataFrame([(1, "s", "symlink", 0, None, 5, 0, False, "x", None), (2, "h", "hardlink", 0, None, 1, 0, False, None, 3), (3, "f", "reg", 4, "d", 9, 0, True, None, None)], schema)
    seen = lambda link, mtime, digest: spark.createDataFrame([("s", "symlink", 0, None, 5, link), ("h", "reg", 4, digest, mtime, None)], "path string, type string, size long, digest string, mtime long, link string")
    act = lambda s, **o: {r["path"]: r["action"] for r in O.merge_plan(s, old, **o).collect()}
    for update in ("newer", "different", "digest"):
        assert act(seen("x", 9, "d"), update=update) == {"s": "unchanged", "h": "unchanged"}
        assert act(seen("y", 9, "d"), update=update)["s"] == "replace"
    assert act(seen("x", 10, "d"), update="newer")["h"] == "replace" and act(seen("x", 10, "d"), update="digest")["h"] == "unchanged" and act(seen("x", 9, "e"), update="digest")["h"] == "replace"
    with pytest.raises(NoMatch, match="f"):
        O.tombstone(old, ["s", "f"])  # f is dead already
    assert sorted(r["id"] for r in O.tombstone(old, ["s", "h"], ["h|x|s"]).filter("dead").collect()) == [1, 2, 3]
    with pytest.raises(NoMatch):
        O.tombstone(old, ["s"], ["nothing"])


def test_strict_rules(spark):
    schema = "id long, path string, type string, size long, digest string, mode int, codec int, data long, hardlink long, len long, link string, rdev array<bigint>, xattrs map<string,binary>, sparse array<struct<off:bigint,len:bigint>>, chunk long, chunks array<bigint>"
    sha = "0" * 64
    rows = spark.createDataFrame([
        (1, "ok", "reg", 10, sha, 0, 0, None, None, 9, None, None, None, None, 8, [5, 4]), (2, "link", "symlink", 0, None, 0, -1, None, None, None, "", None, None, None, None, None), (3, "dev", "chardev", 0, None, 0, -1, None, None, None, None, [1], None, None, None, None),
        (4, "x", "reg", 0, sha, 0, -1, None, None, None, None, None, {"": bytearray(b"1")}, None, None, None), (5, "sp", "reg", 20, sha, 0, 0, None, None, 6, None, None, None, [(4, 3), (5, 3)], 8, [6]), (6, "cut", "reg", 17, sha, 0, 0, None, None, 9, None, None, None, None, 8, [5, 4]),
        (7, "big", "reg", 1, sha, 0, 0, None, None, 1, None, None, None, None, 1 << 40, [1]), (8, "short", "reg", 1, "00", 0, -1, None, None, None, "to", None, None, [(0, 0)], None, None)], schema)
    found = {(r["id"], r["rule"]) for r in O.violations(rows, 1, strict=True).collect()}
    assert found == {(2, "symlink without target"), (3, "device numbers"), (4, "attribute name"), (5, "segments out of order"), (6, "chunk count"), (7, "chunk limit"), (8, "digest length"), (8, "target of a non-link"), (8, "empty segment")}


def test_one_decimal_as_c_prints_it(spark):
    sizes_ = [(80, 27), (80, 26), (0, 0), (1, 1), (3, 5), (1 << 40, 5), (None, 1), (160, 54)]
    got = spark.createDataFrame(sizes_, "size long, len long").select("size", "len", R.saved_percent(F.col("size"), F.col("len")).alias("saved"), R.stored_percent(F.col("size"), F.col("len")).alias("stored")).collect()
    for r in got:
        s, n = r["size"], r["len"]
        assert r["saved"] == (None if s is None else "-" if s == 0 else "%.1f%%" % (100.0 * (s - n) / s)), r
        assert r["stored"] == (None if s is None else "" if s == 0 else " (%.1f%%)" % (100.0 * n / s)), r
    bytes_ = [0, 1023, 1024, 1280, 1792, 3 << 18, 5 << 18, (1 << 30) + (1 << 28), 1 << 52]
    got = spark.createDataFrame([(b,) for b in bytes_], "n long").select(R.human_bytes(F.col("n")).alias("t")).collect()
    assert [r["t"] for r in got] == [sizes.human_bytes(b) for b in bytes_]
    values = [n + k / 100 for n in (-3, 0, 1, 7, 66, 99, 1023) for k in range(5, 100, 10)] + [-0.04, 0.0, -0.05, 66.25, 66.75, 0.15, 0.35, 100.0 * 53 / 80, 1e-9, 123456789.25, 99.95]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", R.tenths(F.col("x")).alias("t")).collect()
    assert [r["t"] for r in got] == ["%.1f" % r["x"] for r in got]
