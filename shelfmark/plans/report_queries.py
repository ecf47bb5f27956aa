"""Registered queries of links, listings, reports, sparse content, dictionaries and layout.

They run over ``typed_catalog``: the documents as files, links, folders and devices.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dictionaries as D
from ..functions import paths as P
from ..functions import render as R
from ..functions import sealing as K
from ..functions import sparse as H
from ..operators import catalog as O
from ..operators import listing as L
from ..operators import metadata as M
from ..operators import order as N
from ..sources import corpus as S
from .catalog_queries import CAT, CODECS, DIFF, OWN, query, shared
from .catalog_queries import _diff as all_differences

TYPED = CAT + """, t0 AS (SELECT * REPLACE (CASE doc % 12 WHEN 0 THEN 'symlink' WHEN 5 THEN 'hardlink' WHEN 7 THEN 'dir' WHEN 9 THEN 'chardev' ELSE 'reg' END AS type) FROM (SELECT *, id - 1 AS doc FROM cat)),
t1 AS (SELECT * REPLACE (CASE WHEN type = 'reg' THEN size ELSE 0 END AS size, CASE WHEN type = 'reg' THEN digest END AS digest, mtime + doc * 1000 % 9973 AS mtime, CASE WHEN type = 'hardlink' THEN doc END AS hardlink),
 CASE WHEN type = 'symlink' THEN 'to/' || doc END AS link, CASE WHEN type = 'chardev' THEN [doc % 7, doc % 5] END AS rdev, CASE WHEN doc % 8 = 3 THEN ['user.a', 'user.b'] END AS xattrs FROM t0),
tfirst AS (SELECT digest, size, min(id) AS owner FROM t1 WHERE size > 0 GROUP BY ALL),
t2 AS (SELECT t1.*, CASE WHEN id > owner THEN owner END AS data FROM t1 LEFT JOIN tfirst USING (digest, size)),
typed AS (SELECT * REPLACE (CASE WHEN type = 'reg' AND data IS NULL THEN codec ELSE -1 END AS codec), CASE WHEN type = 'reg' AND data IS NULL THEN size END AS len, CASE WHEN type = 'reg' AND data IS NULL THEN (size + 1023) // 1024 ELSE 0 END AS n_chunks FROM t2)"""
TREE = TYPED + """, tree AS (SELECT r.path, CASE WHEN r.hardlink IS NOT NULL THEN 'reg' WHEN r.doc % 29 = 0 THEN 'fifo' ELSE r.type END AS type, coalesce(t.size, r.size) + CASE WHEN r.doc % 13 = 0 THEN 1 ELSE 0 END AS size,
 CASE WHEN r.doc % 19 = 0 THEN '0' || substr(coalesce(t.digest, r.digest), 2, 63) ELSE coalesce(t.digest, r.digest) END AS digest, coalesce(t.mtime, r.mtime) + CASE WHEN r.doc % 17 = 0 THEN 5 WHEN r.doc % 23 = 0 THEN -5 ELSE 0 END AS mtime,
 r.link || CASE WHEN r.doc % 48 = 0 THEN '/moved' ELSE '' END AS link FROM typed r LEFT JOIN typed t ON r.hardlink = t.id WHERE r.doc % 11 <> 0)"""
# the entry that holds a path's content: the target of a hard link, or itself
HELD = TREE + """, held AS (SELECT m.path, m.id AS old_id, coalesce(t.type, m.type) AS type, coalesce(t.size, m.size) AS size, CASE WHEN t.id IS NULL THEN m.digest ELSE t.digest END AS digest, coalesce(t.mtime, m.mtime) AS mtime, m.link
 FROM typed m LEFT JOIN typed t ON m.type = 'hardlink' AND m.hardlink = t.id WHERE NOT m.dead)"""


def _links(name: str, update: str, test: str):
    def run(spark, d):
        return O.merge_plan(S.typed_disk(spark, d), S.typed_catalog(spark, d), update=update).select("path", "old_id", "action")

    run.__name__ = name
    query(f"""WITH {HELD} SELECT n.path, old_id, CASE WHEN old_id IS NULL THEN 'add' WHEN n.type <> o.type THEN 'replace' WHEN o.type = 'symlink' AND n.link <> o.link THEN 'replace' WHEN {test} THEN 'replace' ELSE 'unchanged' END AS action
 FROM tree n LEFT JOIN held o ON n.path = o.path""")(run)


_OTHER = "n.mtime <> o.mtime OR (o.type = 'reg' AND n.size <> o.size)"
_links("update_links_newer", "newer", "n.mtime > o.mtime")
_links("update_links_different", "different", _OTHER)
_links("update_links_digest", "digest", f"CASE WHEN o.type = 'reg' THEN n.digest <> o.digest ELSE {_OTHER} END")


@query(f"""WITH {HELD}, p AS (SELECT n.type, n.size, CASE WHEN old_id IS NULL THEN 'add' WHEN n.type <> o.type OR n.mtime > o.mtime OR (o.type = 'symlink' AND n.link <> o.link) THEN 'replace' ELSE 'unchanged' END AS action FROM tree n LEFT JOIN held o ON n.path = o.path),
s AS (SELECT count(*) FILTER (action <> 'unchanged') AS paths, CAST(coalesce(sum(CASE WHEN type = 'reg' THEN size END) FILTER (action <> 'unchanged'), 0) AS BIGINT) AS bytes, count(*) FILTER (action = 'replace') AS replaced, count(*) FILTER (action = 'unchanged') AS unchanged FROM p)
SELECT 'dry run, nothing written: ' || paths || CASE WHEN paths = 1 THEN ' path, ' ELSE ' paths, ' END || CASE WHEN bytes < 1024 THEN bytes || ' B' WHEN bytes < 1048576 THEN printf('%.1f KiB', bytes / 1024) WHEN bytes < 1073741824 THEN printf('%.1f MiB', bytes / 1048576) ELSE printf('%.1f GiB', bytes / 1073741824) END
 || ' of file content' || CASE WHEN replaced > 0 THEN '; ' || replaced || ' replace a member' ELSE '' END || CASE WHEN unchanged > 0 THEN '; ' || unchanged || ' unchanged' ELSE '' END AS line FROM s""")
def dry_run_summary(spark, d):
    return L.summary_line(O.plan_summary(O.merge_plan(S.typed_disk(spark, d), S.typed_catalog(spark, d), update="newer")))


@query(f"WITH {TYPED} SELECT path, CASE WHEN type = 'reg' THEN size ELSE 0 END AS size FROM typed WHERE NOT dead AND (split_part(path, '/', 2) = 'fr' OR ends_with(path, '7.txt')) AND regexp_full_match(path, '.*[02468]/.*|.*[1357].txt')")
def delete_plan(spark, d):
    return O.deletion_plan(S.typed_catalog(spark, d), ["fr", "*7.txt"], [".*[02468]/.*", ".*[1357]\\.txt"])


SHOWN = """names AS (SELECT m.*, codecs.name AS codec_name, codecs.spec AS codec_spec, o.id AS o_id, o.path AS o_path, o.dead AS o_dead, CASE WHEN m.type = 'hardlink' THEN coalesce(t.path, 'member ' || m.hardlink) END AS t_path
 FROM typed m LEFT JOIN typed o ON m.data = o.id LEFT JOIN typed t ON m.hardlink = t.id LEFT JOIN codecs ON codecs.pos = m.codec WHERE NOT m.dead)"""


@query(f"""WITH {TYPED}, {CODECS}, {SHOWN} SELECT id, CASE WHEN type = 'chardev' THEN rdev[1] || ',' || rdev[2] ELSE CAST(size AS VARCHAR) END AS size, CASE WHEN type = 'reg' AND data IS NULL THEN CAST(len AS VARCHAR) ELSE '-' END AS stored,
 CASE WHEN type = 'reg' AND data IS NULL THEN CASE WHEN size = 0 THEN '-' ELSE printf('%.1f%%', 100.0 * (size - len) / size) END ELSE '-' END AS saved, CASE WHEN type = 'reg' AND data IS NULL THEN coalesce(codec_spec, '-') ELSE '-' END AS codec,
 CASE WHEN type = 'reg' AND data IS NULL THEN CAST(n_chunks AS VARCHAR) ELSE '-' END AS chunks, CASE WHEN type = 'reg' THEN substr(digest, 1, 16) ELSE '-' END AS digest,
 path || CASE type WHEN 'symlink' THEN ' -> ' || link WHEN 'hardlink' THEN ' link to ' || t_path ELSE '' END || CASE WHEN o_id IS NULL THEN '' WHEN o_dead AND o_path = path THEN ' same as its earlier version' WHEN o_dead THEN ' same as deleted ' || o_path ELSE ' same as ' || o_path END AS name FROM names""")
def list_detail(spark, d):
    return L.long_rows(S.typed_catalog(spark, d), S.codecs(spark)).select("id", "size", "stored", "saved", "codec", "chunks", "digest", "name")


def _json(name: str, value: str, when: str = "true") -> str:
    return f"CASE WHEN {when} THEN ',\"{name}\":' || {value} ELSE '' END"


def _text(column: str) -> str:
    return f"'\"' || {column} || '\"'"


@query(f"""WITH {TYPED}, {CODECS}, {SHOWN}, f AS (SELECT *, mtime % 1000000000 AS part FROM names)
SELECT path, '{{"path":"' || path || '","type":"' || type || '","size":' || size || ',"mode":' || mode || ',"mtime":"' || strftime(make_timestamp(mtime // 1000), '%Y-%m-%dT%H:%M:%S') || CASE WHEN part = 0 THEN '' ELSE '.' || rtrim(lpad(CAST(part AS VARCHAR), 9, '0'), '0') END || 'Z"'
 || {_json('target', _text('link'), 'link IS NOT NULL')} || {_json('hardlink_to', _text('t_path'), 't_path IS NOT NULL')} || {_json('same_as', _text('o_path'), 'o_id IS NOT NULL')} || {_json('same_as_deleted', "'true'", 'o_dead')}
 || {_json('uid', 'uid', 'uid IS NOT NULL')} || {_json('gid', 'gid')} || {_json('uname', _text('uname'), 'uname IS NOT NULL')} || {_json('rdev', "'[' || rdev[1] || ',' || rdev[2] || ']'", 'rdev IS NOT NULL')} || {_json('xattrs', "'[\"user.a\",\"user.b\"]'", 'xattrs IS NOT NULL')}
 || CASE WHEN type = 'reg' AND data IS NULL AND codec_name IS NOT NULL THEN ',"codec":{{"name":"' || codec_name || '"' || CASE WHEN contains(codec_spec, ':') THEN ',"params":{{"' || replace(split_part(codec_spec, ':', 2), '=', '":"') || '"}}' ELSE '' END || '}}' ELSE '' END
 || {_json('stored_size', 'CASE WHEN data IS NULL THEN len ELSE 0 END', "type = 'reg'")} || {_json('chunks', 'n_chunks', "type = 'reg' AND data IS NULL")} || {_json('encrypted', "'false'", "type = 'reg' AND data IS NULL")} || {_json('digest', _text('digest'), "type = 'reg'")} || '}}' AS line FROM f""")
def list_json_full(spark, d):
    return L.json_lines(S.typed_catalog(spark, d), S.codecs(spark))


@query(f"""WITH {TYPED}, {CODECS}, live AS (SELECT m.*, o.len AS owner_len FROM typed m LEFT JOIN typed o ON m.data = o.id WHERE NOT m.dead),
n AS (SELECT (SELECT max(gen) FROM typed) AS gen, count(*) AS live, (SELECT count(*) FROM typed WHERE dead) AS dead, CAST(sum(size) AS BIGINT) AS plain, CAST(coalesce(sum(len), 0) AS BIGINT) AS blobs, count(data) AS shared, CAST(coalesce(sum(owner_len), 0) AS BIGINT) AS saved, count(*) FILTER (codec = -1 AND type = 'reg') AS stored FROM live),
u AS (SELECT string_agg(spec || ' (' || n || ' members)', ', ' ORDER BY pos) AS used FROM (SELECT pos, spec, count(id) AS n FROM codecs LEFT JOIN (SELECT * FROM live WHERE type = 'reg') m ON m.codec = pos GROUP BY ALL))
SELECT * FROM (SELECT 0 AS pos, 'generation' AS key, CAST(gen AS VARCHAR) AS value FROM n UNION ALL SELECT 1, 'members', live || ' live, ' || dead || ' tombstoned' FROM n
 UNION ALL SELECT 2, 'content', plain || ' bytes, stored in ' || blobs || ' bytes' || CASE WHEN plain = 0 THEN '' ELSE printf(' (%.1f%%)', 100.0 * blobs / plain) END FROM n
 UNION ALL SELECT 3, 'shared content', shared || CASE WHEN shared = 1 THEN ' member, ' ELSE ' members, ' END || saved || ' bytes not stored' FROM n WHERE shared > 0 UNION ALL SELECT 4, 'dead space', '0 bytes (reclaimed by compact)'
 UNION ALL SELECT 5, 'codecs', used || CASE WHEN stored > 0 THEN ', none (' || stored || ' members)' ELSE '' END FROM n, u)""")
def info_text(spark, d):
    return L.info_lines(S.typed_catalog(spark, d), S.codecs(spark))


@query(f"""WITH {DIFF} SELECT path, kind, path || ': ' || CASE kind WHEN 'missing' THEN 'not on disk' WHEN 'extra' THEN 'not in the archive' WHEN 'content' THEN 'content differs' ELSE
 CASE kind WHEN 'type' THEN 'type differs' WHEN 'size' THEN 'size differs' WHEN 'mode' THEN 'mode differs' ELSE 'mtime differs' END || ': archive ' || archive || ', disk ' || disk END AS line FROM diffs""")
def difference_lines(spark, d):
    line = R.difference_line(*map(F.col, ("path", "kind", "archive", "disk", "names")))
    return all_differences(spark, d).select("path", "kind", line.alias("line"))


_SHOWN = "replace(replace(replace(replace(text, '\\', '\\\\'), chr(10), '\\n'), chr(9), '\\t'), chr(13), '\\r')"
for _c in (*range(1, 9), 11, 12, *range(14, 32), 127):
    _SHOWN = f"replace({_SHOWN}, chr({_c}), '\\x{_c:02x}')"
for _c in (*range(0x80, 0xA0), 0x061C, 0x200E, 0x200F, *range(0x202A, 0x202F), *range(0x2066, 0x206A)):
    _SHOWN = f"replace({_SHOWN}, chr({_c}), '\\u{_c:04x}')"


@query(f"SELECT doc_id, sha256({_SHOWN}) AS shown FROM (SELECT doc_id, text || chr(10) || chr(27) || '[2J\\' || chr(8238) || chr(155) AS text FROM documents)")
def printable_names(spark, d):
    """Every text as a name, with escape sequences at its end."""
    name = F.concat("text", F.lit("\n\x1b[2J\\‮\x9b"))
    return S.table(spark, d, "documents").select("doc_id", F.sha2(R.printable(name), 256).alias("shown"))


@query("""WITH r AS (SELECT 'user.' || event_type || user_id % 3 AS name, count(*) AS n FROM events GROUP BY ALL), k AS (SELECT *, row_number() OVER (ORDER BY name) AS i FROM r)
SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS names, string_agg(name, ', ' ORDER BY name) FILTER (i <= 8) || CASE WHEN count(*) > 8 THEN ', and ' || (count(*) - 8) || ' more' ELSE '' END AS listed FROM k""")
def refused_notice(spark, d):
    return M.refused_notice(S.table(spark, d, "events").select(F.concat(F.lit("user."), "event_type", (F.col("user_id") % 3).cast("string")).alias("name")))


@query("""WITH e AS (SELECT ['reg', 'dir', 'fifo', 'chardev', 'blockdev', 'socket', 'symlink', 'door', 'symlink'][user_id % 9 + 1] AS type, CASE WHEN user_id % 9 = 6 THEN 'x' WHEN user_id % 9 = 8 THEN '' END AS link FROM events)
SELECT type, CASE WHEN type = 'socket' THEN 'skip' WHEN type = 'door' OR link = '' THEN 'error' ELSE 'store' END AS status, count(*) AS entries FROM e GROUP BY ALL""")
def storable_status(spark, d):
    kinds = F.array(*map(F.lit, ("reg", "dir", "fifo", "chardev", "blockdev", "socket", "symlink", "door", "symlink")))
    rows = S.table(spark, d, "events").select(F.element_at(kinds, (F.col("user_id") % 9 + 1).cast("int")).alias("type"), F.when(F.col("user_id") % 9 == 6, "x").when(F.col("user_id") % 9 == 8, "").alias("link"))
    return rows.groupBy("type", M.storable(F.col("type"), F.col("link")).alias("status")).agg(F.count("*").alias("entries"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'system.posix_acl_access' ELSE 'user.' || event_type END AS kept_without_other, CAST(event_id % 2 AS INT) AS n_without_acls FROM events")
def recorded_attributes(spark, d):
    """An ACL or a user attribute of each event, under either option."""
    name = F.when(F.col("event_id") % 2 == 0, "system.posix_acl_access").otherwise(F.concat(F.lit("user."), "event_type"))
    rows = S.table(spark, d, "events").select("event_id", name.alias("name"), F.create_map(name, F.lit(b"1")).alias("xattrs"))
    return rows.select("event_id", F.coalesce(F.element_at(F.map_keys(M.recorded(F.col("xattrs"))), 1), F.lit("")).alias("kept_without_other"), F.size(M.recorded(F.col("xattrs"), no_acls=True)).alias("n_without_acls"))


@query(f"WITH {TYPED} SELECT CAST(max(CASE WHEN o.size > 0 THEN 1024 ELSE 0 END) AS BIGINT) AS largest FROM typed m JOIN typed o ON o.id = coalesce(m.data, m.id) WHERE NOT m.dead AND o.type = 'reg'")
def largest_chunk(spark, d):
    return O.largest_chunk(S.typed_catalog(spark, d))


@query(f"WITH {TYPED} SELECT CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(size) FILTER (data IS NULL) AS BIGINT) AS own_bytes FROM typed WHERE NOT dead")
def payload_totals(spark, d):
    return O.payload_totals(S.typed_catalog(spark, d))


@query(f"WITH {CAT}, n AS (SELECT 'extra/' || page_id % 10 || '/' || page_id || '.html' AS path FROM pages) SELECT path, (SELECT max(id) FROM cat) + row_number() OVER (ORDER BY path) AS id FROM n")
def append_ids(spark, d):
    """Ids of new entries: after all that were ever used, in order of path."""
    new = S.disk(spark, d).filter("path like 'extra/%'").select("path")
    first = S.catalog(spark, d).agg((F.max("id") + 1).alias("first"))
    return N.numbered(new, ["path"], "n").crossJoin(F.broadcast(first)).select("path", (F.col("n") + F.col("first")).alias("id"))


@query(f"WITH {OWN}, c AS (SELECT id, data, CASE WHEN data IS NULL THEN size END AS len FROM own) SELECT id, data, len, CASE WHEN data IS NULL THEN (len + 1023) // 1024 ELSE 0 END AS n_chunks, CASE WHEN len > 0 THEN 64 + CAST(coalesce(sum(len) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) END AS off FROM c")
def create_layout(spark, d):
    """Where the contents of a new catalog lie, stored as they are, equal ones once."""
    return O.layout(S.catalog(spark, d), 1024, start=64)


@query(f"""WITH {OWN}, l AS (SELECT id, path, CASE WHEN len > 0 THEN (id * 7919) % 1000003 + CASE WHEN id % 37 = 0 THEN 1000000 ELSE 64 END END AS off, len FROM own)
SELECT id, path, 'blob out of range' AS rule FROM l WHERE len > 0 AND (off < 64 OR off + len > 1000000)""")
def blob_ranges(spark, d):
    off = (F.col("id") * 7919) % 1000003 + F.when(F.col("id") % 37 == 0, 1000000).otherwise(64)
    return O.out_of_range(shared(spark, d).withColumn("off", F.when(F.col("len") > 0, off)), 64, 1000000)


@query(f"""WITH {TYPED}, b AS (SELECT id, path, type, doc, size, data, len, digest, CASE WHEN doc % 101 = 0 THEN 'x' ELSE link END AS link, CASE WHEN doc % 103 = 0 THEN NULL ELSE hardlink END AS hardlink, n_chunks + CASE WHEN doc % 47 = 0 AND n_chunks > 0 THEN 1 ELSE 0 END AS n,
 CASE WHEN doc % 53 = 0 THEN substr(digest, 1, 8) ELSE digest END AS bad FROM typed)
SELECT id, path, 'target of a non-link' AS rule FROM b WHERE type <> 'symlink' AND link IS NOT NULL UNION ALL SELECT id, path, 'hard link without entry' FROM b WHERE type = 'hardlink' AND hardlink IS NULL
UNION ALL SELECT id, path, 'chunk count' FROM b WHERE n <> (size + 1023) // 1024 AND len > 0 UNION ALL SELECT id, path, 'digest length' FROM b WHERE length(bad) < 64 UNION ALL SELECT b.id, b.path, 'owner' FROM b JOIN b o ON b.data = o.id WHERE b.bad IS DISTINCT FROM o.bad
UNION ALL SELECT b.id, b.path, 'hard link target' FROM b JOIN b t ON b.hardlink = t.id WHERE t.type <> 'reg'""")
def validate_typed(spark, d):
    """Type-specific fields, digests and chunk tables, broken in some entries."""
    doc = F.col("id") - 1
    rows = S.typed_catalog(spark, d).withColumn("link", F.when(doc % 101 == 0, "x").otherwise(F.col("link"))).withColumn("hardlink", F.when(doc % 103 != 0, F.col("hardlink")))
    rows = rows.withColumn("chunks", F.when(doc % 47 == 0, F.concat("chunks", F.array(F.lit(0).cast("long")))).otherwise(F.col("chunks"))).withColumn("digest", F.when(doc % 53 == 0, F.substring("digest", 1, 8)).otherwise(F.col("digest")))
    return O.violations(rows, 5, strict=True)


@query(f"""WITH {DIFF}, scope AS (SELECT * FROM diffs WHERE split_part(path, '/', 2) <> 'es' AND (split_part(path, '/', 2) = 'en' OR ends_with(path, '3.txt'))) SELECT path, kind, rank FROM scope""")
def diff_scoped(spark, d):
    """Exclusions first, then patterns, on both sides."""
    return O.scoped_differences(S.catalog(spark, d), S.disk(spark, d), ["en", "*3.txt"], exclude=["es"]).select("path", "kind", "rank")


@query(f"WITH {CAT}, p AS (SELECT id, split_part(path, '/', 2) || '/' || split_part(path, '/', 3) AS path FROM cat) SELECT id, path FROM p WHERE (starts_with(path, 'en/') OR starts_with(path, 'de/')) AND NOT regexp_full_match(path, '.*[05][.]txt')")
def strip_scope(spark, d):
    """Paths that one of two removed prefixes makes a selected path."""
    paths = S.catalog(spark, d).select("id", F.regexp_extract("path", "^[^/]*/(.*)$", 1).alias("path"))
    prefixes = spark.sql("SELECT * FROM VALUES ('a'), ('b') AS t(prefix)")
    return O.in_scope(paths, prefixes, ["a/en", "b/de"], ["*[05].txt"])


@query(f"WITH {TYPED} SELECT id, path FROM typed m WHERE NOT dead AND split_part(path, '/', 2) <> 'fr' AND (type = 'reg' OR (type = 'hardlink' AND hardlink NOT IN (SELECT id FROM typed WHERE NOT dead AND type = 'reg' AND split_part(path, '/', 2) <> 'fr')))")
def copied_members(spark, d):
    return O.copied(O.live(S.typed_catalog(spark, d)).filter("split_part(path, '/', 2) != 'fr'"))


@query(f"""WITH {DIFF}, c AS (SELECT path, kind FROM diffs WHERE kind IN ('size', 'mode', 'mtime')), f AS (SELECT path, kind FROM diffs WHERE kind IN ('size', 'missing')) SELECT path, kind, false AS extracted FROM f UNION ALL SELECT path, kind, true FROM c ANTI JOIN f USING (path, kind)""")
def copy_differences(spark, d):
    found = all_differences(spark, d).select("path", "kind")
    return O.copy_differences(found.filter("kind in ('size', 'missing')"), found.filter("kind in ('size', 'mode', 'mtime')"))


@query("SELECT event_id, abs((epoch_us(ts) * 1000 + event_id % 3000) - (epoch_us(ts) * 1000)) < 1000 AS same FROM events")
def same_time(spark, d):
    """Times within the precision that a probe found."""
    precision = M.time_precision(1_000_000_700, 1_000_000_000)
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    return S.table(spark, d, "events").select("event_id", M.same_time(ns + F.col("event_id") % 3000, ns, precision).alias("same"))


@query(f"WITH {CAT} SELECT id, (id - 1) % 5 > 0 AS dense_same, (id - 1) % 5 > 0 AND (id - 1) % 7 > 0 AS holed_same, strlen(text) + 100 AS expanded, strlen(text) = 0 AS empty_is_zero FROM cat")
def sparse_same_content(spark, d):
    """Files with a hole before and behind their data: a fifth have other data, a seventh a byte
    in the hole; dense ones are compared by digest."""
    doc = F.col("id") - 1
    text = F.col("text").cast("binary")
    changed = F.when(doc % 5 == 0, F.concat(text, F.lit(b"!"))).otherwise(text)
    n = F.octet_length(text).cast("long")
    segments = F.array(F.struct(F.lit(40).cast("long").alias("off"), n.alias("len")))
    digest = F.sha2(text, 256)
    size = n + 100
    hole = F.when(doc % 7 == 0, F.concat(F.lit(b"x"), H.zeros(F.lit(59)))).otherwise(H.zeros(F.lit(60)))
    on_disk = F.concat(H.zeros(F.lit(40)), F.when(doc % 5 == 0, F.concat(F.lit(b"!"), F.expr("substring(cast(text as binary), 2)"))).otherwise(text), hole)
    on_disk = F.when((n == 0) & (doc % 5 == 0), H.zeros(size + 1)).otherwise(on_disk)
    rows = S.catalog(spark, d)
    return rows.select("id", H.same_content(n, F.array().cast("array<struct<off:bigint,len:bigint>>"), digest, changed).alias("dense_same"), H.same_content(size, segments, digest, on_disk).alias("holed_same"),
                       F.octet_length(H.expand(text, segments, size)).cast("long").alias("expanded"), H.all_zero(text).alias("empty_is_zero"))


_DICTS = "dicts AS (SELECT * FROM (VALUES (7, 1), (8, 2), (9, 3)) t(id, gen)), dcodecs AS (SELECT * FROM (VALUES (0, NULL), (1, 7), (2, 7), (3, 9), (4, 8)) t(pos, dict))"


def _dictionaries(spark):
    return spark.sql("SELECT * FROM VALUES (0, cast(null as int)), (1, 7), (2, 7), (3, 9), (4, 8) AS t(pos, dict)"), spark.sql("SELECT * FROM VALUES (7, 1), (8, 2), (9, 3) AS t(id, gen)")


@query(f"WITH {OWN}, {_DICTS} SELECT id, gen FROM dicts WHERE id IN (SELECT dict FROM dcodecs WHERE pos IN (SELECT codec FROM own WHERE NOT dead AND id % 4 < 3 AND codec < 3))")
def used_dictionaries(spark, d):
    codecs, dicts = _dictionaries(spark)
    return D.used(O.live(shared(spark, d)).filter("id % 4 < 3 and codec < 3"), codecs, dicts)


@query(f"WITH {OWN}, {_DICTS} SELECT dicts.id, dicts.gen, count(m.id) AS entries FROM dicts LEFT JOIN dcodecs ON dict = dicts.id LEFT JOIN (SELECT * FROM own WHERE NOT dead) m ON m.codec = pos GROUP BY ALL")
def dictionary_usage(spark, d):
    codecs, dicts = _dictionaries(spark)
    return D.usage(shared(spark, d), codecs, dicts)


@query(f"WITH {CAT}, s AS (SELECT path, least(size, 32768) AS size, row_number() OVER (ORDER BY path) - 1 AS n FROM cat WHERE size > 0), k AS (SELECT greatest(1, (CAST(sum(size) AS BIGINT) + 99999) // 100000) AS k FROM s) SELECT path, n // k AS n, size FROM s, k WHERE n % k = 0")
def dictionary_samples(spark, d):
    """Every k-th file's first bytes, within 100,000 bytes."""
    rows, _ = D.sampled(S.catalog(spark, d).select("path", F.col("text").cast("binary").alias("bytes")), 100_000)
    return rows.select("path", "n", F.octet_length("sample").cast("long").alias("size"))


@query("SELECT count(*) AS entries, count(DISTINCT text) AS keyed, true AS keyed_differ FROM documents")
def keyed_digests(spark, d):
    """Equal texts have equal keyed digests; another key gives others."""
    content = S.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("bytes"))
    one, two = (K.keyed_digests(content, K.Keys(bytes([n]) * 32, bytes(16))) for n in (1, 2))
    both = one.join(two.select("id", F.col("keyed").alias("other")), "id")
    return both.agg(F.count("*").alias("entries"), F.countDistinct("keyed").alias("keyed"), F.every(F.col("keyed") != F.col("other")).alias("keyed_differ"))


@query(f"WITH {OWN} SELECT (SELECT count(*) FROM own) AS entries, (SELECT count(DISTINCT digest) FROM own) AS digests, CAST(sum((size + 2047) // 2048) AS BIGINT) AS chunks, CAST(sum((size + 2047) // 2048) AS BIGINT) AS opened, count(*) FILTER (size > 0) AS last FROM own WHERE data IS NULL")
def encrypted_catalog(spark, d):
    """A catalog sealed in two passes: digests become keyed, for sharers their owner's."""
    rows = shared(spark, d)
    keys = K.Keys(bytes(range(32)), bytes(16))
    named, sealed = K.encrypted(rows, rows.filter("data is null").select("id", F.col("text").cast("binary").alias("bytes")), keys, 2048)
    opened = K.unseal(sealed, keys).agg(F.count("*").alias("chunks"), F.count("opened").alias("opened"), F.count_if("final").alias("last"))
    return named.agg(F.count("*").alias("entries"), F.countDistinct("digest").alias("digests")).crossJoin(opened)


@query(f"""WITH {OWN}, res AS (SELECT id AS owner, id % 50 <> 3 AS ok FROM own WHERE data IS NULL), v AS (SELECT m.id, m.path, coalesce(t.data, m.hardlink, m.data, m.id) AS owner FROM own m LEFT JOIN own t ON m.hardlink = t.id),
r AS (SELECT v.*, coalesce(res.ok, false) AS ok FROM v LEFT JOIN res USING (owner)) SELECT count(*) FILTER (ok) AS checked, count(*) FILTER (NOT ok) AS failed, arg_min(path, id) FILTER (NOT ok) AS first_failed, CAST((SELECT sum(size) FROM own WHERE id IN (SELECT owner FROM r)) AS BIGINT) AS bytes FROM r""")
def verify_stats(spark, d):
    rows = shared(spark, d)
    content = rows.filter("data is null").select("id", F.when(F.col("id") % 50 == 3, F.concat("text", F.lit("?"))).otherwise(F.col("text")).alias("bytes"))
    return O.verify_stats(O.verified(rows, content), rows)


@query("SELECT least(u, o) AS path, min(seq) AS seq FROM (SELECT user_id AS u, user_id AS o, event_id AS seq FROM events) GROUP BY ALL")
def seen_once(spark, d):
    """A path named several times in one run counts once, as it was seen first."""
    from ..sources.tree import first_seen

    return first_seen(S.table(spark, d, "events").select(F.col("user_id").alias("path"), F.col("event_id").alias("seq")))


@query(f"WITH {CAT} SELECT path, CAST(coalesce(sum(size) OVER (ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begin FROM cat WHERE NOT dead")
def stream_offsets(spark, d):
    """Where each file begins when contents are written to one stream, in order of path."""
    rows = O.live(S.catalog(spark, d)).select("path", "size")
    return N.running_total(rows, ["path"], F.col("size"), "begin").select("path", "begin")


@query("SELECT page_id, coalesce(url, '') <> '' AND NOT starts_with(url, '/') AND len(list_filter(string_split(url, '/'), lambda c: c IN ('', '.', '..'))) = 0 AS storable_as_is, starts_with(coalesce(url, ''), '/') OR len(list_filter(string_split(coalesce(url, ''), '/'), lambda c: c = '..')) > 0 AS stripped FROM pages")
def store_path_flags(spark, d):
    """Whether a path can be stored as it is, and whether storing it strips a part."""
    url = F.coalesce("url", F.lit(""))
    return S.table(spark, d, "pages").select("page_id", ((url != "") & (url != ".") & P.is_stored_path(url)).alias("storable_as_is"), P.is_stripped(url).alias("stripped"))


@query(f"WITH {OWN} SELECT id, path, dead FROM own ORDER BY id")
def index_order(spark, d):
    return N.by_index(shared(spark, d).select("id", "path", "dead"))


@query(f"WITH {OWN}, c AS (SELECT id, len, coalesce(sum(len) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM own WHERE len IS NOT NULL) SELECT id, CAST(off AS BIGINT) AS off, len FROM c WHERE len > 0 ORDER BY off")
def blob_order(spark, d):
    rows = shared(spark, d).filter("len is not null").select("id", "len")
    return N.by_offset(N.running_total(rows, ["id"], F.col("len"), "off")).select("id", "off", "len")


@query(f"WITH {OWN} SELECT path, size FROM own WHERE NOT dead ORDER BY size DESC, path LIMIT 25")
def largest_entries(spark, d):
    """A report's first rows."""
    return N.first_few(O.live(shared(spark, d)).select("path", "size"), [F.desc("size"), "path"], 25)


@query(f"""WITH {CAT}, b AS (SELECT id, CASE WHEN id % 31 = 0 THEN path || '~' ELSE path END AS path, CASE WHEN id % 37 = 0 THEN NULL ELSE mode END AS mode, dead FROM cat WHERE id % 41 > 0)
SELECT a.id, 'path' AS field, a.path AS one, b.path AS other FROM cat a JOIN b USING (id) WHERE a.path <> b.path UNION ALL SELECT a.id, 'mode', CAST(a.mode AS VARCHAR), NULL FROM cat a JOIN b USING (id) WHERE b.mode IS NULL UNION ALL SELECT id, 'id', CAST(id AS VARCHAR), NULL FROM cat WHERE id % 41 = 0""")
def compare_readings(spark, d):
    """Two readings of a catalog, field by field; one lost entries and fields."""
    one = S.catalog(spark, d)
    other = one.filter("id % 41 > 0").withColumn("path", F.when(F.col("id") % 31 == 0, F.concat("path", F.lit("~"))).otherwise(F.col("path"))).withColumn("mode", F.when(F.col("id") % 37 != 0, F.col("mode")))
    return O.compared(one, other, ["path", "mode", "dead"])


@query(f"WITH {CAT} SELECT id, path, size, digest, mtime, mode, uid, dead FROM cat")
def portable_round_trip(spark, d):
    """The catalog written as index files, with keys, and read again."""
    from . import portable

    keys = K.Keys(bytes(range(32)), bytes(16))
    rows = S.catalog(spark, d).select("id", "path", "size", "digest", "mtime", "mode", "uid", "dead")
    found = portable.files(rows, bytes(16), 7, keys)
    return portable.entries_of(found, "id long, path string, size long, digest string, mtime long, mode int, uid long, dead boolean", keys)
