"""The test tables as a catalog and as a tree to compare it with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EPOCH = 1_700_000_000_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _path() -> F.Column:
    return F.concat_ws("/", "source", "lang", F.concat(F.lpad(F.col("doc_id").cast("string"), 6, "0"), F.lit(".txt")))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One regular entry per document, three generations, a seventh of them tombstones."""
    return table(spark, sf_dir, "documents").select(
        (F.col("doc_id") + 1).alias("id"), _path().alias("path"), F.lit("reg").alias("type"), F.octet_length("text").cast("long").alias("size"),
        F.sha2("text", 256).alias("digest"), (F.lit(EPOCH) + F.col("doc_id") * 1_000_000_000).alias("mtime"), (1 + F.col("doc_id") % 3).alias("gen"),
        (F.col("doc_id") % 7 == 0).alias("dead"), (F.col("doc_id") % 5 - 1).cast("int").alias("codec"), (F.col("doc_id") * 37 % 4096).cast("int").alias("mode"),
        F.when(F.col("doc_id") % 4 > 0, F.col("doc_id") % 3 + 1000).alias("uid"), (F.col("doc_id") % 2 + 100).alias("gid"), F.when(F.col("doc_id") % 6 == 0, F.lit("sam")).alias("uname"), F.lit(None).cast("string").alias("gname"),
        F.when(F.col("doc_id") % 10 == 9, F.col("doc_id") - 1).alias("hardlink"), "text")


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog's tree after removals, edits and touches, with files from ``pages``."""
    docs = table(spark, sf_dir, "documents").filter("doc_id % 11 != 0")
    text = F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit("!"))).when(F.col("doc_id") % 19 == 0, F.concat(F.expr("substring(text, 1, length(text) - 1)"), F.lit("#"))).otherwise(F.col("text"))
    seen = docs.select(_path().alias("path"), F.when(F.col("doc_id") % 29 == 0, "symlink").otherwise("reg").alias("type"), text.alias("content"),
                       (F.lit(EPOCH) + F.col("doc_id") * 1_000_000_000 + F.when(F.col("doc_id") % 17 == 0, 1_000_000_000).otherwise(0)).alias("mtime"),
                       F.when(F.col("doc_id") % 23 == 0, 420).otherwise(F.col("doc_id") * 37 % 4096).cast("int").alias("mode"))
    extra = table(spark, sf_dir, "pages").select(F.concat(F.lit("extra/"), F.expr("page_id % 10"), F.lit("/"), F.col("page_id"), F.lit(".html")).alias("path"), F.lit("reg").alias("type"), F.col("html").alias("content"), F.lit(EPOCH).alias("mtime"), F.lit(420).alias("mode"))
    return seen.unionByName(extra)


def disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of ``contents`` with sizes and digests."""
    return contents(spark, sf_dir).select("path", "type", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("digest"), "mtime", "mode")


CODECS = [("none", None), ("zstd", "level=12"), ("gzip", "level=6"), ("xz", "preset=6"), ("flate", None)]


def codecs(spark: SparkSession) -> DataFrame:
    rows = ",".join(f"({i}, '{n}', {'map()' if p is None else 'str_to_map(' + repr(p) + ', chr(44), chr(61))'})" for i, (n, p) in enumerate(CODECS))
    return spark.sql(f"SELECT pos, name, cast(params AS map<string,string>) AS params FROM VALUES {rows} AS t(pos, name, params)")


def with_owner(rows: DataFrame) -> DataFrame:
    """``data``: the first entry with the same non-empty content; null for owners.

    The owner of a content is the least id of its key, by an aggregation with map-side
    minima and an equi-join, which a hot content doesn't gather in one task.
    """
    key = ["digest", "size"]
    first = rows.filter("size > 0").groupBy(*key).agg(F.min("id").alias("owner"))
    return rows.join(first, key, "left").withColumn("data", F.when(F.col("id") > F.col("owner"), F.col("owner"))).drop("owner")


def typed_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog of ``documents`` with links, folders and devices among its files."""
    doc = F.col("doc_id")
    kind = F.when(doc % 12 == 0, "symlink").when(doc % 12 == 5, "hardlink").when(doc % 12 == 7, "dir").when(doc % 12 == 9, "chardev").otherwise("reg")
    rows = catalog(spark, sf_dir).drop("hardlink", "type").withColumn("doc_id", F.col("id") - 1).withColumn("type", kind)
    reg = F.col("type") == "reg"
    rows = rows.withColumn("size", F.when(reg, F.col("size")).otherwise(0).cast("long")).withColumn("digest", F.when(reg, F.col("digest"))).withColumn("mtime", F.col("mtime") + doc * 1000 % 9973)
    rows = rows.withColumn("link", F.when(F.col("type") == "symlink", F.concat(F.lit("to/"), doc))).withColumn("hardlink", F.when(F.col("type") == "hardlink", doc)).withColumn("rdev", F.when(F.col("type") == "chardev", F.array(doc % 7, doc % 5)))
    rows = rows.withColumn("xattrs", F.when(doc % 8 == 3, F.create_map(F.lit("user.b"), F.lit(b"1"), F.lit("user.a"), F.lit(b"2")))).withColumn("sparse", F.lit(None).cast("array<struct<off:bigint,len:bigint>>"))
    rows = with_owner(rows).withColumn("codec", F.when(reg & F.col("data").isNull(), F.col("codec")).otherwise(-1)).withColumn("chunk", F.when(reg & F.col("data").isNull() & (F.col("size") > 0), F.lit(1024).cast("long")))
    chunks = F.transform(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("size") / 1024)), lambda i: F.least(F.lit(1024).cast("long"), F.col("size") - (i - 1) * 1024))
    rows = rows.withColumn("chunks", F.when(F.col("chunk").isNotNull(), chunks))
    return rows.withColumn("len", F.when(reg & F.col("data").isNull(), F.col("size"))).drop("doc_id")


def typed_disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of ``typed_catalog`` after removals, edits, touches and changed links."""
    doc = F.col("id") - 1
    rows = typed_catalog(spark, sf_dir)
    target = rows.select(F.col("id").alias("t_id"), F.col("size").alias("t_size"), F.col("digest").alias("t_digest"), F.col("mtime").alias("t_mtime"))
    both = rows.filter(doc % 11 != 0).join(target, F.col("hardlink") == F.col("t_id"), "left")
    linked = F.col("hardlink").isNotNull()
    edited = F.coalesce("t_digest", "digest")
    return both.select(
        "path", F.when(linked, "reg").when(doc % 29 == 0, "fifo").otherwise(F.col("type")).alias("type"), (F.coalesce("t_size", "size") + F.when(doc % 13 == 0, 1).otherwise(0)).alias("size"),
        F.when(doc % 19 == 0, F.concat(F.lit("0"), F.substring(edited, 2, 63))).otherwise(edited).alias("digest"), (F.coalesce("t_mtime", "mtime") + F.when(doc % 17 == 0, 5).when(doc % 23 == 0, -5).otherwise(0)).alias("mtime"), "mode",
        F.when(F.col("link").isNotNull(), F.concat("link", F.when(doc % 48 == 0, "/moved").otherwise(""))).alias("link"))
