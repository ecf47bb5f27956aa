"""One registered query per catalog operator, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codecs as C
from ..functions import paths as P
from ..functions import render as R
from ..functions import sealing as K
from ..functions import sparse as H
from ..operators import catalog as O
from ..operators import metadata as M
from ..operators import order as N
from ..sources import corpus as S

QUERIES: dict = {}
SQL: dict[str, str] = {}

CAT = """cat AS (SELECT doc_id + 1 AS id, source || '/' || lang || '/' || lpad(CAST(doc_id AS VARCHAR), 6, '0') || '.txt' AS path, 'reg' AS type, CAST(strlen(text) AS BIGINT) AS size,
 sha256(text) AS digest, 1700000000000000000 + doc_id * 1000000000 AS mtime, 1 + doc_id % 3 AS gen, doc_id % 7 = 0 AS dead, CAST(doc_id % 5 - 1 AS INT) AS codec, CAST(doc_id * 37 % 4096 AS INT) AS mode,
 CASE WHEN doc_id % 4 > 0 THEN doc_id % 3 + 1000 END AS uid, doc_id % 2 + 100 AS gid, CASE WHEN doc_id % 6 = 0 THEN 'sam' END AS uname, CASE WHEN doc_id % 10 = 9 THEN doc_id - 1 END AS hardlink, text FROM documents)"""
OWN = CAT + """, firsts AS (SELECT digest, size, min(id) AS owner FROM cat WHERE size > 0 GROUP BY ALL),
own0 AS (SELECT cat.*, CASE WHEN id > owner THEN owner END AS data FROM cat LEFT JOIN firsts USING (digest, size)),
own AS (SELECT * REPLACE (CASE WHEN data IS NULL THEN codec ELSE -1 END AS codec), CASE WHEN data IS NULL THEN CASE WHEN codec = -1 THEN size ELSE size // 3 + 1 END END AS len FROM own0)"""
DISK = """disk AS (SELECT path, type, CAST(strlen(content) AS BIGINT) AS size, sha256(content) AS digest, mtime, mode FROM (
 SELECT source || '/' || lang || '/' || lpad(CAST(doc_id AS VARCHAR), 6, '0') || '.txt' AS path, CASE WHEN doc_id % 29 = 0 THEN 'symlink' ELSE 'reg' END AS type,
 CASE WHEN doc_id % 13 = 0 THEN text || '!' WHEN doc_id % 19 = 0 THEN substr(text, 1, length(text) - 1) || '#' ELSE text END AS content,
 1700000000000000000 + doc_id * 1000000000 + CASE WHEN doc_id % 17 = 0 THEN 1000000000 ELSE 0 END AS mtime, CAST(CASE WHEN doc_id % 23 = 0 THEN 420 ELSE doc_id * 37 % 4096 END AS INT) AS mode FROM documents WHERE doc_id % 11 <> 0
 UNION ALL SELECT 'extra/' || page_id % 10 || '/' || page_id || '.html', 'reg', html, 1700000000000000000, 420 FROM pages))"""
CODECS = """codecs AS (SELECT * FROM (VALUES (0, 'none', 'none'), (1, 'zstd', 'zstd:level=12'), (2, 'gzip', 'gzip:level=6'), (3, 'xz', 'xz:preset=6'), (4, 'flate', 'flate')) t(pos, name, spec))"""
UP = "list_transform(range(1, len(string_split(path, '/'))), lambda i: array_to_string(list_slice(string_split(path, '/'), 1, i), '/'))"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def shared(spark, d) -> DataFrame:
    rows = S.with_owner(S.catalog(spark, d))
    rows = rows.withColumn("codec", F.when(F.col("data").isNull(), F.col("codec")).otherwise(-1))
    return rows.withColumn("len", F.when(F.col("data").isNull(), F.when(F.col("codec") == -1, F.col("size")).otherwise(F.expr("size div 3 + 1"))))


BRIEF = ("id", "path", "size")


@query(f"WITH {CAT} SELECT id, path, size, gen FROM cat WHERE NOT dead ORDER BY path")
def list_live(spark, d):
    return O.live(S.catalog(spark, d)).select(*BRIEF, "gen").orderBy("path")


@query(f"""WITH {OWN}, {CODECS} SELECT m.id, m.path, coalesce(codecs.spec, 'none') AS codec_spec, CASE WHEN m.uid IS NULL THEN '-' ELSE coalesce(m.uname, CAST(m.uid AS VARCHAR)) || '/' || CAST(m.gid AS VARCHAR) END AS owner,
 CASE WHEN m.size = 0 THEN '-' ELSE printf('%.1f%%', 100.0 * (m.size - coalesce(m.len, 0)) / m.size) END AS saved,
 strftime(make_timestamp(m.mtime // 1000), '%Y-%m-%d %H:%M:%S') || '.' || lpad(CAST(m.mtime % 1000000000 AS VARCHAR), 9, '0') AS modified,
 CASE WHEN o.id IS NULL THEN '' WHEN o.path = m.path THEN ' same as its earlier version' WHEN o.dead THEN ' same as deleted ' || o.path ELSE ' same as ' || o.path END AS suffix
 FROM own m LEFT JOIN own o ON m.data = o.id LEFT JOIN codecs ON codecs.pos = m.codec WHERE NOT m.dead""")
def list_long(spark, d):
    rows = shared(spark, d)
    specs = S.codecs(spark).select("pos", R.codec_string(F.col("name"), F.coalesce("params", F.expr("cast(map() as map<string,string>)")), F.lit(False)).alias("spec"))
    owner = rows.select(F.col("id").alias("o_id"), F.col("path").alias("o_path"), F.col("dead").alias("o_dead"))
    one = O.live(rows).join(owner, F.col("data") == F.col("o_id"), "left").join(specs, F.col("codec") == F.col("pos"), "left")
    suffix = F.when(F.col("o_id").isNull(), "").when(F.col("o_path") == F.col("path"), " same as its earlier version").when(F.col("o_dead"), F.concat(F.lit(" same as deleted "), "o_path")).otherwise(F.concat(F.lit(" same as "), "o_path"))
    return one.select("id", "path", F.coalesce("spec", F.lit("none")).alias("codec_spec"), R.owner_string(F.col("uid"), F.col("gid"), F.col("uname"), F.col("gname")).alias("owner"),
                      R.saved_percent(F.col("size"), F.coalesce("len", F.lit(0))).alias("saved"), R.utc_time("mtime").alias("modified"), suffix.alias("suffix"))


@query(f"""WITH {OWN} SELECT '{{"path":"' || path || '","type":"reg","size":' || size || CASE WHEN data IS NULL THEN '' ELSE ',"data":' || data END || '}}' AS line FROM own WHERE NOT dead""")
def list_json(spark, d):
    return O.live(shared(spark, d)).select(F.to_json(F.struct("path", "type", "size", "data"), {"ignoreNullFields": "true"}).alias("line"))


def _selected(name: str, where: str, **options):
    def run(spark, d):
        return O.select(S.catalog(spark, d), must_match=False, **options).select(*BRIEF)

    run.__name__ = name
    query(f"WITH {CAT} SELECT id, path, size FROM cat WHERE {where}")(run)


_selected("select_everything", "true", patterns=["."])
_selected("select_directory", "starts_with(path, 'src1/en/')", patterns=["src1/en/"])
_selected("select_glob", "regexp_full_match(path, 'src1[^/]*/[de][^/]/[^/]*7[.]txt')", patterns=["src1*/[de]?/*7.txt"])
_selected("select_name_any_depth", "regexp_full_match(split_part(path, '/', 3), '0000[^/]*[.]txt') OR split_part(path, '/', 2) = 'fr'", patterns=["0000*.txt", "fr"])
_selected("select_regex", "regexp_full_match(path, 'src1?[5-7]/(en|de)/.*[5-6][.]txt')", expressions=["src1?[5-7]/(en|de)/.*[5-6]\\.txt"])
_selected("exclude_parent", "NOT (split_part(path, '/', 2) = 'en' OR regexp_full_match(split_part(path, '/', 1), 'src1[^/]'))", exclude=["en", "src1?"])
_selected("exclude_regex", "NOT regexp_full_match(split_part(path, '/', 1), 'src1.*')", exclude_expressions=["src1[^/]*"])
_selected("select_then_exclude", "starts_with(path, 'src3/') AND regexp_full_match(path, '.*[02468]3[.]txt') AND NOT split_part(path, '/', 2) = 'de'", patterns=["src3"], expressions=[".*[02468]3\\.txt"], exclude=["de"])


@query("""SELECT page_id, coalesce(nullif(array_to_string(list_filter(string_split(regexp_replace(regexp_replace('/' || coalesce(url, ''), '/(\\.?/)+', '/', 'g'), '/\\.$', ''), '/'), lambda c: c <> ''), '/'), ''), '.') AS stored FROM pages""")
def store_path(spark, d):
    return S.table(spark, d, "pages").select("page_id", P.store_path(F.coalesce("url", F.lit(""))).alias("stored"))


@query("""SELECT page_id, len(list_filter(string_split(url, '/'), lambda c: c IN ('', '.', '..'))) = 0 OR url = '.' AS safe FROM pages""")
def is_stored_path(spark, d):
    return S.table(spark, d, "pages").select("page_id", P.is_stored_path(F.col("url")).alias("safe"))


@query(f"WITH {CAT} SELECT id, split_part(path, '/', 2) || '/' || split_part(path, '/', 3) AS new_path FROM cat WHERE NOT dead")
def strip_components(spark, d):
    return O.live(S.catalog(spark, d)).select("id", P.strip(F.col("path"), 1).alias("new_path")).filter("new_path is not null")


@query(f"""WITH {CAT}, flat AS (SELECT id, regexp_replace(path, '[0-9]{{3}}[.]txt$', '') AS path FROM cat WHERE NOT dead), cut AS (SELECT id, path, split_part(path, '/', 2) || '/' || split_part(path, '/', 3) AS new_path FROM flat)
SELECT id, new_path, lead(path) OVER w AS next_path, lead(path) OVER w IS NOT NULL AS collides FROM cut WINDOW w AS (PARTITION BY new_path ORDER BY path, id)""")
def strip_collisions(spark, d):
    rows = O.live(S.catalog(spark, d)).withColumn("path", F.regexp_replace("path", r"[0-9]{3}\.txt$", ""))
    return O.stripped(rows, 1).select("id", "new_path", "next_path", "collides")


@query(f"WITH {CAT} SELECT id, CASE WHEN id % 3 = 0 THEN (size // 4) + (size // 8) ELSE size END AS payload FROM cat")
def payload_size(spark, d):
    segments = F.expr("CASE WHEN id % 3 = 0 THEN array(named_struct('off', 0L, 'len', size div 4), named_struct('off', size div 2, 'len', size div 8)) END")
    return S.catalog(spark, d).select("id", R.payload_size(F.col("size"), segments).alias("payload"))


@query(f"WITH {CAT} SELECT id, size // 4 AS off, size // 2 - size // 4 AS len FROM cat WHERE size // 2 > size // 4 UNION ALL SELECT id, size // 2 + size // 8, size - size // 2 - size // 8 FROM cat WHERE size > size // 2 + size // 8")
def sparse_gaps(spark, d):
    segments = F.expr("array(named_struct('off', 0L, 'len', size div 4), named_struct('off', size div 2, 'len', size div 8))")
    gaps = H.gaps(F.lit(0).cast("long"), F.col("size"), segments)
    return S.catalog(spark, d).select("id", F.explode(gaps).alias("g")).select("id", "g.off", "g.len")


OLD = f"{CAT}, {DISK}, old AS (SELECT path, id AS old_id, type AS old_type, size AS old_size, digest AS old_digest, mtime AS old_mtime FROM cat WHERE NOT dead)"
KNOWN = "CASE WHEN old_id IS NULL THEN 'add' "


def _merged(name: str, case: str, **options):
    def run(spark, d):
        return O.merge_plan(S.disk(spark, d), S.catalog(spark, d), **options).select("path", "old_id", "action")

    run.__name__ = name
    query(f"WITH {OLD} SELECT path, old_id, {KNOWN}{case} END AS action FROM disk LEFT JOIN old USING (path)")(run)


_merged("merge_replace", "ELSE 'replace'", policy="replace")
_merged("merge_skip", "ELSE 'skip'", policy="skip")
DIFFERENT = "mtime <> old_mtime OR (type = 'reg' AND size <> old_size)"
_merged("update_newer", "WHEN type <> old_type OR mtime > old_mtime THEN 'replace' ELSE 'unchanged'", update="newer")
_merged("update_different", f"WHEN type <> old_type OR {DIFFERENT} THEN 'replace' ELSE 'unchanged'", update="different")
_merged("update_digest", f"WHEN type <> old_type OR CASE WHEN type = 'reg' THEN digest <> old_digest ELSE {DIFFERENT} END THEN 'replace' ELSE 'unchanged'", update="digest")


@query(f"WITH {OLD} SELECT {KNOWN}WHEN type <> old_type OR mtime > old_mtime THEN 'replace' ELSE 'unchanged' END AS action, count(*) AS entries, CAST(sum(size) AS BIGINT) AS bytes FROM disk LEFT JOIN old USING (path) GROUP BY 1")
def run_stats(spark, d):
    return O.merge_plan(S.disk(spark, d), S.catalog(spark, d), update="newer").groupBy("action").agg(F.count("*").alias("entries"), F.sum("size").alias("bytes"))


@query(f"WITH {CAT} SELECT id, dead OR split_part(path, '/', 2) = 'es' OR starts_with(path, 'src3/') AS dead FROM cat")
def delete_tombstone(spark, d):
    return O.tombstone(S.catalog(spark, d), ["es", "src3"]).select("id", "dead")


@query(f"WITH {OWN} SELECT id, data FROM own")
def dedup_owner(spark, d):
    return shared(spark, d).select("id", "data")


@query(f"WITH {CAT} SELECT size, count(*) AS entries FROM cat WHERE size > 0 GROUP BY size HAVING count(*) > 1")
def dedup_candidates(spark, d):
    return S.catalog(spark, d).filter("size > 0").groupBy("size").agg(F.count("*").alias("entries")).filter("entries > 1")


@query(f"WITH {OWN} SELECT count(*) AS shared, CAST(sum(o.len) AS BIGINT) AS not_stored FROM own m JOIN own o ON m.data = o.id WHERE NOT m.dead")
def dedup_savings(spark, d):
    rows = shared(spark, d)
    return O.live(rows).join(rows.select(F.col("id").alias("data"), F.col("len").alias("owner_len")), "data").agg(F.count("*").alias("shared"), F.sum("owner_len").alias("not_stored"))


KEPT = OWN + """, need AS (SELECT id FROM own WHERE NOT dead UNION SELECT hardlink FROM own WHERE NOT dead AND hardlink IS NOT NULL),
kept AS (SELECT * FROM own WHERE id IN (SELECT id FROM need) OR id IN (SELECT data FROM own WHERE data IS NOT NULL AND id IN (SELECT id FROM need)))"""


@query(f"WITH {KEPT} SELECT id, dead FROM kept")
def compact_kept(spark, d):
    return O.kept(shared(spark, d)).select("id", "dead")


@query(f"WITH {KEPT} SELECT (SELECT count(*) FROM own) - count(*) AS dropped, CAST((SELECT sum(len) FROM own) - sum(len) AS BIGINT) AS dead_space FROM kept")
def dead_space(spark, d):
    rows = shared(spark, d)
    total = rows.agg(F.count("*").alias("n"), F.sum("len").alias("b"))
    return O.kept(rows).agg(F.count("*").alias("k"), F.sum("len").alias("kb")).join(total).select((F.col("n") - F.col("k")).alias("dropped"), (F.col("b") - F.col("kb")).alias("dead_space"))


@query(f"WITH {KEPT}, {CODECS}, used AS (SELECT DISTINCT CASE WHEN codec = 2 THEN 1 ELSE codec END AS codec FROM kept) SELECT pos, name, CAST(row_number() OVER (ORDER BY pos) - 1 AS INT) AS new_pos FROM codecs WHERE pos IN (SELECT codec FROM used)")
def used_codecs_renumber(spark, d):
    rows = shared(spark, d).withColumn("codec", F.when(F.col("codec") == 2, 1).otherwise(F.col("codec")))
    return O.renumbered(S.codecs(spark), O.kept(rows)).select("pos", "name", "new_pos")


@query(f"""WITH {OWN} SELECT count(*) FILTER (NOT m.dead) AS live, count(*) FILTER (m.dead) AS dead, CAST(coalesce(sum(m.size) FILTER (NOT m.dead), 0) AS BIGINT) AS plain, CAST(coalesce(sum(m.len) FILTER (NOT m.dead), 0) AS BIGINT) AS blobs,
 count(*) FILTER (NOT m.dead AND m.codec = -1) AS stored, count(*) FILTER (NOT m.dead AND m.data IS NOT NULL) AS shared, CAST(coalesce(sum(o.len) FILTER (NOT m.dead), 0) AS BIGINT) AS not_stored FROM own m LEFT JOIN own o ON m.data = o.id""")
def info_rollup(spark, d):
    return O.info(shared(spark, d))


@query(f"WITH {OWN}, {CODECS} SELECT pos, name, count(id) AS entries FROM codecs LEFT JOIN (SELECT * FROM own WHERE NOT dead) m ON m.codec = pos GROUP BY ALL")
def codec_usage(spark, d):
    return S.codecs(spark).join(O.live(shared(spark, d)), F.col("codec") == F.col("pos"), "left").groupBy("pos", "name").agg(F.count("id").alias("entries"))


@query(f"""WITH {OWN} SELECT count(*) FILTER (NOT m.dead) AS listed, count(*) FILTER (NOT m.dead) AS files, CAST(sum(m.size) FILTER (NOT m.dead) AS BIGINT) AS bytes, CAST(sum(m.len) FILTER (NOT m.dead) AS BIGINT) AS stored,
 printf('%.1f%%', 100.0 * (sum(m.size) FILTER (NOT m.dead) - sum(m.len) FILTER (NOT m.dead)) / sum(m.size) FILTER (NOT m.dead)) AS saved, count(m.data) FILTER (NOT m.dead) AS shared, CAST(coalesce(sum(o.len) FILTER (NOT m.dead), 0) AS BIGINT) AS not_stored,
 max(m.gen) AS generation, count(*) FILTER (m.dead) AS tombstoned FROM own m LEFT JOIN own o ON m.data = o.id""")
def listing_totals(spark, d):
    t = O.totals(shared(spark, d))
    return t.select("listed", "files", "bytes", "stored", R.saved_percent(F.col("payload"), F.col("stored")).alias("saved"), "shared", "not_stored", "generation", "tombstoned")


DIFF = f"""{CAT}, {DISK}, a AS (SELECT * FROM cat WHERE NOT dead), j AS (SELECT coalesce(a.path, d.path) AS path, a.path IS NOT NULL AS in_a, d.path IS NOT NULL AS in_d, a.type AS atype, d.type AS dtype, a.size AS asz, d.size AS ds, a.digest AS adg, d.digest AS dd, a.mode AS am, d.mode AS dm, a.mtime AS amt, d.mtime AS dmt
 FROM a FULL JOIN disk d ON a.path = d.path), same AS (SELECT * FROM j WHERE in_a AND in_d AND atype = dtype),
diffs AS (SELECT path, 'missing' AS kind, 0 AS rank, NULL AS archive, NULL AS disk FROM j WHERE NOT in_d UNION ALL SELECT path, 'extra', 1, NULL, NULL FROM j WHERE NOT in_a UNION ALL SELECT path, 'type', 2, atype, dtype FROM j WHERE in_a AND in_d AND atype <> dtype
 UNION ALL SELECT path, 'size', 3, CAST(asz AS VARCHAR), CAST(ds AS VARCHAR) FROM same WHERE asz <> ds UNION ALL SELECT path, 'content', 4, NULL, NULL FROM same WHERE asz = ds AND adg <> dd
 UNION ALL SELECT path, 'mode', 8, CAST(am AS VARCHAR), CAST(dm AS VARCHAR) FROM same WHERE atype <> 'symlink' AND am <> dm UNION ALL SELECT path, 'mtime', 10, CAST(amt AS VARCHAR), CAST(dmt AS VARCHAR) FROM same WHERE amt <> dmt)"""


def _diff(spark, d) -> DataFrame:
    return O.differences(S.catalog(spark, d), S.disk(spark, d))


@query(f"WITH {DIFF} SELECT * FROM diffs ORDER BY path, rank")
def diff_all_ranked(spark, d):
    return _diff(spark, d).drop("names").orderBy("path", "rank")


@query(f"WITH {DIFF} SELECT path FROM diffs WHERE kind = 'missing'")
def diff_missing(spark, d):
    return O.live(S.catalog(spark, d)).join(S.disk(spark, d), "path", "left_anti").select("path")


@query(f"WITH {DIFF} SELECT path FROM diffs WHERE kind = 'extra'")
def diff_extra(spark, d):
    return S.disk(spark, d).join(O.live(S.catalog(spark, d)), "path", "left_anti").select("path")


@query(f"WITH {DIFF} SELECT kind, count(*) AS differences, count(DISTINCT path) AS paths FROM diffs GROUP BY kind")
def diff_summary(spark, d):
    return _diff(spark, d).groupBy("kind").agg(F.count("*").alias("differences"), F.countDistinct("path").alias("paths"))


@query(f"WITH {CAT}, dirs AS (SELECT DISTINCT split_part(path, '/', 1) AS dir FROM cat WHERE id % 2 = 0) SELECT path, CASE WHEN split_part(path, '/', 1) IN (SELECT dir FROM dirs WHERE dir LIKE 'src1%') THEN split_part(path, '/', 1) ELSE path END AS root FROM cat WHERE NOT dead")
def tree_root(spark, d):
    rows = S.catalog(spark, d)
    dirs = rows.filter("id % 2 = 0").select(F.split_part("path", F.lit("/"), F.lit(1)).alias("path")).filter("path like 'src1%'").distinct()
    return O.tree_roots(O.live(rows), dirs)


@query(f"WITH {CAT} SELECT DISTINCT unnest({UP}) AS dir FROM cat WHERE NOT dead")
def implied_parents(spark, d):
    return O.live(S.catalog(spark, d)).select(F.explode(P.ancestors(F.col("path"), False)).alias("dir")).distinct()


@query(f"WITH {CAT}, up AS (SELECT unnest({UP}) AS dir, size FROM cat WHERE NOT dead) SELECT dir, count(*) AS entries, CAST(sum(size) AS BIGINT) AS bytes FROM up GROUP BY dir")
def dir_rollup(spark, d):
    return O.directories(O.live(S.catalog(spark, d)))


@query(f"WITH {CAT} SELECT id, path FROM cat WHERE split_part(path, '/', 1) IN ('src4', 'src5') OR starts_with(path, 'src6/de/')")
def under_directories(spark, d):
    return O.under(S.catalog(spark, d), spark.sql("SELECT * FROM VALUES ('src4'), ('src5'), ('src6/de') AS t(path)")).select("id", "path")


VERIFY = OWN + """, res AS (SELECT id AS owner, id % 50 <> 3 AS ok FROM own WHERE data IS NULL),
v AS (SELECT m.id, m.path, coalesce(t.data, m.hardlink, m.data, m.id) AS owner FROM own m LEFT JOIN own t ON m.hardlink = t.id)"""


def _verified(spark, d) -> DataFrame:
    rows = shared(spark, d)
    content = rows.filter("data is null").select("id", F.when(F.col("id") % 50 == 3, F.concat("text", F.lit("?"))).otherwise(F.col("text")).alias("bytes"), "digest")
    return O.verified(rows, content)


@query(f"WITH {VERIFY} SELECT v.id, v.path, v.owner, coalesce(res.ok, false) AS ok FROM v LEFT JOIN res USING (owner)")
def verify_propagation(spark, d):
    return _verified(spark, d)


@query(f"WITH {VERIFY} SELECT count(*) FILTER (ok) AS checked, count(*) FILTER (NOT coalesce(ok, false)) AS failed, count(DISTINCT v.owner) AS decoded FROM v LEFT JOIN res USING (owner)")
def verify_digest(spark, d):
    return _verified(spark, d).agg(F.count_if("ok").alias("checked"), F.count_if(~F.col("ok")).alias("failed"), F.countDistinct("owner").alias("decoded"))


def _broken(spark, d) -> DataFrame:
    rows = shared(spark, d).withColumn("type", F.when(F.col("id") % 101 == 0, "door").otherwise(F.col("type"))).withColumn("codec", F.when(F.col("id") % 103 == 0, 9).otherwise(F.col("codec")))
    return rows.withColumn("path", F.when(F.col("id") % 107 == 0, F.concat(F.lit("../"), "path")).otherwise(F.col("path"))).withColumn("digest", F.when(F.col("id") % 109 == 0, F.lit(None)).otherwise(F.col("digest"))).withColumn("hardlink", F.lit(None).cast("long"))


@query(f"""WITH {OWN}, b AS (SELECT id, CASE WHEN id % 107 = 0 THEN '../' || path ELSE path END AS path, CASE WHEN id % 101 = 0 THEN 'door' ELSE type END AS type, CASE WHEN id % 103 = 0 THEN 9 ELSE codec END AS codec,
 CASE WHEN id % 109 = 0 THEN NULL ELSE digest END AS digest, size, data, len FROM own)
SELECT id, path, 'unknown type' AS rule FROM b WHERE type = 'door' UNION ALL SELECT id, path, 'unsafe path' FROM b WHERE starts_with(path, '../') UNION ALL SELECT id, path, 'codec out of range' FROM b WHERE codec >= 5
UNION ALL SELECT id, path, 'digest missing' FROM b WHERE type = 'reg' AND digest IS NULL UNION ALL SELECT id, path, 'size of a non-file' FROM b WHERE type <> 'reg' AND size > 0 UNION ALL SELECT id, path, 'sharer with a codec' FROM b WHERE data IS NOT NULL AND codec <> -1
UNION ALL SELECT m.id, m.path, 'owner' FROM b m JOIN b o ON m.data = o.id WHERE m.digest IS DISTINCT FROM o.digest""")
def validate_catalog(spark, d):
    return O.violations(_broken(spark, d), 5)


@query("SELECT doc_id, i AS pos, md5(array_slice(encode(text), i * 512 + 1, i * 512 + 512)::BLOB) AS chunk_md5 FROM (SELECT doc_id, text, unnest(range(CAST((strlen(text) + 511) // 512 AS BIGINT))) AS i FROM documents)")
def chunk_table(spark, d):
    rows = S.table(spark, d, "documents")
    return rows.select("doc_id", F.posexplode(C.chunks(F.col("text").cast("binary"), 512)).alias("pos", "chunk")).select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5("chunk").alias("chunk_md5"))


@query(f"WITH {OWN} SELECT id, 64 + CAST(coalesce(sum(len) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off, len FROM own WHERE len IS NOT NULL")
def chunk_layout_offsets(spark, d):
    rows = shared(spark, d).filter("len is not null").select("id", "len")
    return N.running_total(rows, ["id"], F.col("len"), "off").select("id", (F.col("off") + 64).alias("off"), "len")


SAMPLED = "r AS (SELECT id, row_number() OVER (PARTITION BY source ORDER BY path) - 1 AS n FROM (SELECT *, split_part(path, '/', 1) AS source FROM cat) WHERE NOT dead)"


def _numbered(spark, d) -> DataFrame:
    rows = O.live(S.catalog(spark, d)).select("id", "path", F.split_part("path", F.lit("/"), F.lit(1)).alias("source"))
    return N.numbered(rows, ["path"], "n", ["source"]).select("id", "n")


@query(f"WITH {CAT}, {SAMPLED} SELECT id FROM r WHERE n % 5 = 0")
def sample_every_k(spark, d):
    return _numbered(spark, d).filter("n % 5 = 0").select("id")


@query(f"WITH {CAT}, {SAMPLED} SELECT id, n % 4 = 3 AS held FROM r")
def held_out_split(spark, d):
    return _numbered(spark, d).select("id", (F.col("n") % 4 == 3).alias("held"))


@query("SELECT CAST(16384 AS BIGINT) AS size, 43616.0::DOUBLE AS gain")
def best_trial(spark, d):
    trials = spark.sql("SELECT * FROM VALUES (4096L, 450L, true), (8192L, 420L, true), (16384L, 380L, true), (32768L, 375L, true), (65536L, 374L, true), (131072L, 1L, true) AS t(size, n, ok)")
    return O.best_trial(trials, 500, 500000, 1000)


@query(f"WITH {CAT}, v AS (SELECT regexp_replace(path, '[0-9][.]txt$', '') AS path, id, gen, codec <> 2 AS valid FROM cat) SELECT path, arg_max(id, gen * 1000000000 + id) AS id, max(gen) AS gen FROM v WHERE valid GROUP BY path")
def latest_generation(spark, d):
    """Ten documents are versions of one path; those with codec 2 are damaged."""
    rows = S.catalog(spark, d).withColumn("path", F.regexp_replace("path", r"[0-9]\.txt$", "")).withColumn("valid", F.col("codec") != 2)
    return O.newest(rows)


@query(f"WITH {CAT}, {DISK} SELECT c.path, CASE WHEN d.path IS NULL THEN 'write' WHEN c.mtime > d.mtime THEN 'write' ELSE 'skip' END AS action FROM cat c LEFT JOIN disk d USING (path) WHERE NOT c.dead")
def plan_extract_overwrite(spark, d):
    return O.overwrite_plan(O.live(S.catalog(spark, d)), S.disk(spark, d).select("path", "mtime"), "newer")


@query(f"""WITH {OWN}, t AS (SELECT * REPLACE (CASE WHEN hardlink IS NOT NULL THEN 'hardlink' WHEN id % 31 = 0 THEN 'dir' ELSE 'reg' END AS type) FROM own), s AS (SELECT * FROM t WHERE NOT dead AND split_part(path, '/', 2) <> 'es'),
 l AS (SELECT s.path, g.path AS target, min(s.path) OVER (PARTITION BY s.hardlink) AS carrier, coalesce(h.data, h.id) AS holder FROM s LEFT JOIN (SELECT * FROM s WHERE type <> 'hardlink') g ON g.id = s.hardlink LEFT JOIN t h ON h.id = s.hardlink WHERE s.type = 'hardlink')
SELECT 1 AS phase, path, type AS action, NULL::BIGINT AS content, NULL::VARCHAR AS link_to FROM s WHERE type = 'dir' UNION ALL SELECT 2, path, 'write', coalesce(data, id), NULL FROM s WHERE type = 'reg' UNION ALL SELECT 4, path, 'finish', NULL, NULL FROM s WHERE type = 'dir'
UNION ALL SELECT 3, path, CASE WHEN target IS NULL AND path = carrier THEN 'write' ELSE 'link' END, CASE WHEN target IS NULL AND path = carrier THEN holder END, CASE WHEN target IS NULL AND path = carrier THEN NULL ELSE coalesce(target, carrier) END FROM l""")
def plan_extract_phases(spark, d):
    kind = F.when(F.col("hardlink").isNotNull(), "hardlink").when(F.col("id") % 31 == 0, "dir").otherwise("reg")
    rows = S.with_owner(S.catalog(spark, d)).withColumn("type", kind)
    return O.extraction(O.live(rows).filter("split_part(path, '/', 2) != 'es'"), rows)


NAMES = ("user.a", "user.", "security.selinux", "trusted.x", "system.posix_acl_access", "system.posix_acl_default", "system.other", "system.", "plain")
OPTIONS = "event_id % 2 = 1 AS no_acls, event_id // 2 % 2 = 1 AS no_xattrs, event_id // 4 % 2 = 1 AS permissions, event_id // 8 % 2 = 1 AS root"


@query(f"""WITH e AS (SELECT ({list(NAMES)})[user_id % {len(NAMES)} + 1] AS name, {OPTIONS} FROM events)
SELECT CASE WHEN name IN ('system.posix_acl_access', 'system.posix_acl_default') THEN CASE WHEN no_acls THEN 'skip' WHEN permissions OR root THEN 'restore' ELSE 'withhold' END
 WHEN name LIKE 'security._%' OR name LIKE 'trusted._%' OR name LIKE 'system._%' THEN CASE WHEN no_xattrs THEN 'skip' WHEN NOT root THEN 'skip' WHEN permissions THEN 'restore' ELSE 'withhold' END
 WHEN no_xattrs THEN 'skip' ELSE 'restore' END AS decision, name, count(*) AS names FROM e GROUP BY ALL""")
def xattr_policy(spark, d):
    """What happens to attributes of every class under all sixteen combinations of options."""
    events = S.table(spark, d, "events").select(F.element_at(F.array(*map(F.lit, NAMES)), (F.col("user_id") % len(NAMES) + 1).cast("int")).alias("name"), *[(F.floor(F.col("event_id") / (1 << i)) % 2 == 1).alias(c) for i, c in enumerate(("no_acls", "no_xattrs", "permissions", "root"))])
    decision = M.restore_decision(M.attribute_class(F.col("name")), *map(F.col, ("no_acls", "no_xattrs", "permissions", "root")))
    return events.select("name", decision.alias("decision")).groupBy("decision", "name").agg(F.count("*").alias("names"))


_BITS = " || ".join(f"CASE WHEN mode & {4 << s} > 0 THEN 'r' ELSE '-' END || CASE WHEN mode & {2 << s} > 0 THEN 'w' ELSE '-' END || CASE WHEN mode & {sp} > 0 AND mode & {1 << s} > 0 THEN '{lo}' WHEN mode & {sp} > 0 THEN '{hi}' WHEN mode & {1 << s} > 0 THEN 'x' ELSE '-' END" for s, sp, lo, hi in ((6, 2048, "s", "S"), (3, 1024, "s", "S"), (0, 512, "t", "T")))


@query(f"WITH {CAT} SELECT id, '-' || {_BITS} AS mode FROM cat")
def mode_string(spark, d):
    return S.catalog(spark, d).select("id", R.mode_string(F.col("type"), F.col("mode")).alias("mode"))


@query("SELECT event_id, CASE WHEN event_id % 3 > 0 THEN min(CASE WHEN event_id % 3 > 0 THEN event_id END) OVER (PARTITION BY user_id % 7, CAST(floor(value) AS BIGINT)) END AS first_id FROM events")
def hardlink_groups(spark, d):
    """Files named more than once; a third have a single name."""
    rows = S.table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 7).alias("dev"), F.floor("value").alias("ino"), (F.col("event_id") % 3 + 1).alias("nlink"))
    return O.first_names(rows).select(F.col("id").alias("event_id"), "first_id")


@query(f"WITH {CAT}, {DISK} SELECT c.id, c.size = d.size AND c.digest = d.digest AS same FROM cat c JOIN disk d USING (path)")
def same_content(spark, d):
    other = S.disk(spark, d).select("path", F.col("size").alias("d_size"), F.col("digest").alias("d_digest"))
    return S.catalog(spark, d).join(other, "path").select("id", ((F.col("size") == F.col("d_size")) & (F.col("digest") == F.col("d_digest"))).alias("same"))


@query(f"WITH {CODECS} SELECT pos, name, spec FROM codecs")
def list_codecs(spark, d):
    return S.codecs(spark).select("pos", "name", R.codec_string(F.col("name"), F.coalesce("params", F.expr("cast(map() as map<string,string>)")), F.lit(False)).alias("spec"))


ROUND = "SELECT '{0}' AS codec, count(*) AS chunks, CAST(sum(least(4096, strlen(text) - i * 4096)) AS BIGINT) AS plain, count(*) AS equal, count(*) AS not_longer FROM (SELECT text, unnest(range(CAST((strlen(text) + 4095) // 4096 AS BIGINT))) AS i FROM documents)"
TRIED = {"none": ("none", {}), "zstd": ("zstd", {"level": "3"}), "zstd long": ("zstd", {"level": "3", "long": "on"}), "gzip": ("gzip", {}), "flate": ("flate", {}), "xz": ("xz", {}), "xz 9": ("xz", {"preset": "9"})}


@query(" UNION ALL ".join(ROUND.format(name) for name in TRIED))
def codec_round_trip(spark, d):
    """Every chunk of every document through each codec and back; none is stored longer."""
    pieces = S.table(spark, d, "documents").select("doc_id", F.posexplode(C.chunks(F.col("text").cast("binary"), 4096)).alias("pos", "plain"))
    out = None
    for label, (name, params) in TRIED.items():
        one = C.decode_chunks(C.encode_chunks(pieces, name, params), name)
        one = one.agg(F.lit(label).alias("codec"), F.count("*").alias("chunks"), F.sum("plain_size").alias("plain"), F.count_if(F.col("plain") == F.col("decoded")).alias("equal"), F.count_if(F.octet_length("encoded") <= F.col("plain_size")).alias("not_longer"))
        out = one if out is None else out.union(one)
    return out


@query("SELECT count(*) AS chunks, CAST(sum(least(4096, strlen(text) - i * 4096)) AS BIGINT) AS plain, count(*) AS equal FROM (SELECT text, unnest(range(CAST((strlen(text) + 4095) // 4096 AS BIGINT))) AS i FROM documents)")
def recompress_round_trip(spark, d):
    pieces = S.table(spark, d, "documents").select("doc_id", F.posexplode(C.chunks(F.col("text").cast("binary"), 4096)).alias("pos", "plain"))
    again = C.recompress(C.encode_chunks(pieces, "gzip"), "gzip", "zstd", {"level": "3"})
    return C.decode_chunks(again, "zstd").agg(F.count("*").alias("chunks"), F.sum("plain_size").alias("plain"), F.count_if(F.col("plain") == F.col("decoded")).alias("equal"))


@query("SELECT count(*) AS chunks, count(*) AS equal, CAST(0 AS BIGINT) AS opened_elsewhere, count(*) AS distinct_seals FROM (SELECT unnest(range(CAST((strlen(text) + 4095) // 4096 AS BIGINT))) FROM documents)")
def sealed_round_trip(spark, d):
    """Every chunk sealed and opened again; none opens under another entry or position, and equal
    chunks have different seals."""
    keys = K.Keys(bytes(range(32)), bytes(16))
    pieces = C.chunks(F.col("text").cast("binary"), 4096)
    table = S.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.size(pieces).alias("n"), F.posexplode(pieces).alias("pos", "plain")).withColumn("final", F.col("pos") == F.col("n") - 1)
    sealed = K.seal(table, keys)
    back = K.unseal(sealed, keys).agg(F.count("*").alias("chunks"), F.count_if(F.col("plain") == F.col("opened")).alias("equal"))
    moved = K.unseal(sealed.select((F.col("id") + 1).alias("id"), "pos", "final", "sealed").union(sealed.select("id", F.col("pos") + 1, "final", "sealed")).union(sealed.select("id", "pos", ~F.col("final"), "sealed")), keys)
    return back.crossJoin(moved.agg(F.count("opened").alias("opened_elsewhere"))).crossJoin(sealed.agg(F.countDistinct("sealed").alias("distinct_seals")))


@query(f"""WITH {CAT} SELECT path, CASE WHEN text IS NULL THEN NULL WHEN (id - 1) % 13 = 0 THEN strlen(text) WHEN (id - 1) % 19 = 0 AND right(text, 1) <> '#' THEN strlen(substr(text, 1, length(text) - 1)) ELSE -1 END AS at
 FROM cat WHERE NOT dead AND (id - 1) % 11 <> 0""")
def first_difference(spark, d):
    """Entries compared byte by byte with their tree's copy."""
    one = O.live(S.catalog(spark, d)).join(S.contents(spark, d).select("path", "content"), "path")
    return one.select("path", C.first_difference(F.col("text").cast("binary"), F.col("content").cast("binary")).alias("at"))
