"""Listings and reports as rows of text or JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import render as R
from .catalog import info, live

_NO_PARAMS = "cast(map() as map<string,string>)"


def resolved(rows: DataFrame, codecs: DataFrame) -> DataFrame:
    """Live entries with their codec (codec_name, params), the owner of shared content (o_path,
    o_dead) and the target of a hard link (t_path; ``member N`` where there is none)."""
    owner = rows.select(F.col("id").alias("o_id"), F.col("path").alias("o_path"), F.col("dead").alias("o_dead"))
    named = codecs.select(F.col("pos").alias("codec_pos"), F.col("name").alias("codec_name"), "params")
    one = live(rows).join(owner, F.col("data") == F.col("o_id"), "left").join(F.broadcast(named), F.col("codec") == F.col("codec_pos"), "left")
    target = rows.select(F.col("id").alias("t_id"), F.col("path").alias("t_name"))
    one = one.join(target, (F.col("type") == "hardlink") & (F.col("hardlink") == F.col("t_id")), "left")
    return one.withColumn("t_path", F.when(F.col("type") == "hardlink", F.coalesce("t_name", F.concat(F.lit("member "), F.col("hardlink").cast("string")))))


def suffix() -> Column:
    """What follows the path of a ``resolved`` row: link targets and shared content."""
    link = F.when(F.col("type") == "symlink", F.concat(F.lit(" -> "), "link")).when(F.col("type") == "hardlink", F.concat(F.lit(" link to "), "t_path")).otherwise("")
    same = F.when(F.col("o_id").isNull(), "").when(F.col("o_dead") & (F.col("o_path") == F.col("path")), " same as its earlier version").when(F.col("o_dead"), F.concat(F.lit(" same as deleted "), "o_path")).otherwise(F.concat(F.lit(" same as "), "o_path"))
    return F.concat(link, same)


def long_rows(rows: DataFrame, codecs: DataFrame) -> DataFrame:
    """The cells of a detailed listing, by path: id, mode, owner, size, stored, saved, codec,
    chunks, sealed, digest (its first 8 bytes), modified and name. What has no stored bytes of
    its own shows ``-`` for what describes them; one that shares content shows its digest."""
    one = resolved(rows, codecs)
    own = (F.col("type") == "reg") & F.col("data").isNull()
    device = F.col("type").isin("chardev", "blockdev")
    dash = lambda when, value: F.when(when, value).otherwise("-")
    spec = R.codec_string(F.col("codec_name"), F.coalesce("params", F.expr(_NO_PARAMS)), F.lit(False))
    sealed = F.col("sealed") if "sealed" in rows.columns else F.lit(False)
    return one.select(
        "id", R.mode_string(F.col("type"), F.col("mode")).alias("mode"), R.owner_string(F.col("uid"), F.col("gid"), F.col("uname"), F.col("gname")).alias("owner"),
        F.when(device, F.array_join(F.col("rdev").cast("array<string>"), ",")).otherwise(F.col("size").cast("string")).alias("size"),
        dash(own, F.coalesce("len", F.lit(0)).cast("string")).alias("stored"), dash(own, R.saved_percent(R.payload_size(F.col("size"), F.col("sparse")), F.coalesce("len", F.lit(0)))).alias("saved"),
        dash(own & F.col("codec_name").isNotNull(), spec).alias("codec"), dash(own, F.coalesce(F.size("chunks"), F.lit(0)).cast("string")).alias("chunks"), dash(own & sealed, F.lit("sealed")).alias("sealed"),
        dash((F.col("type") == "reg") & F.col("digest").isNotNull(), F.substring("digest", 1, 16)).alias("digest"), R.utc_time("mtime").alias("modified"), F.concat("path", suffix()).alias("name"))


def json_lines(rows: DataFrame, codecs: DataFrame) -> DataFrame:
    """(path, line): one JSON object for each live entry; fields that don't apply are left out.

    ``path_bytes``, where the catalog has it, are the exact bytes of a path that isn't UTF-8.
    """
    one = resolved(rows, codecs)
    reg, shares = F.col("type") == "reg", F.col("data").isNotNull()
    own = reg & ~shares
    some = lambda when, value: F.when(when, value)
    fields = [
        F.col("path"), *([F.base64("path_bytes").alias("path_base64")] if "path_bytes" in rows.columns else []), F.col("type"), F.col("size"), F.col("mode"), R.rfc3339("mtime").alias("mtime"),
        some(F.col("link") != "", F.col("link")).alias("target"), F.col("t_path").alias("hardlink_to"), F.col("o_path").alias("same_as"), some(F.col("o_dead"), F.lit(True)).alias("same_as_deleted"),
        F.col("uid"), F.col("gid"), some(F.col("uname") != "", F.col("uname")).alias("uname"), some(F.col("gname") != "", F.col("gname")).alias("gname"), some(F.size("rdev") > 0, F.col("rdev")).alias("rdev"),
        some(F.size("sparse") > 0, F.lit(True)).alias("sparse"), some(F.size(F.map_keys("xattrs")) > 0, F.array_sort(F.map_keys("xattrs"))).alias("xattrs"),
        some(own & F.col("codec_name").isNotNull(), F.struct(F.col("codec_name").alias("name"), some(F.size("params") > 0, F.col("params")).alias("params"))).alias("codec"),
        some(shares, F.lit(0).cast("long")).otherwise(some(own, F.coalesce("len", F.lit(0)))).alias("stored_size"), some(own, F.coalesce(F.size("chunks"), F.lit(0))).alias("chunks"),
        some(own, F.col("sealed") if "sealed" in rows.columns else F.lit(False)).alias("encrypted"), some(reg, F.col("digest")).alias("digest"),
    ]
    return one.select("path", F.to_json(F.struct(*fields), {"ignoreNullFields": "true"}).alias("line"))


def info_lines(rows: DataFrame, codecs: DataFrame, dead_space: int | Column = 0) -> DataFrame:
    """(pos, key, value) of a catalog's summary as text."""
    one = info(rows)
    usage = codecs.join(live(rows).filter("type = 'reg' and codec >= 0").groupBy(F.col("codec").alias("pos")).agg(F.count("*").alias("entries")), "pos", "left")
    named = usage.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", R.codec_string(F.col("name"), F.coalesce("params", F.expr(_NO_PARAMS)), F.lit(False)).alias("spec"), F.coalesce("entries", F.lit(0)).alias("entries")))), lambda c: F.concat(c["spec"], F.lit(" ("), c["entries"].cast("string"), F.lit(" members)"))), ", ").alias("codecs"))
    one = one.crossJoin(named).crossJoin(rows.agg(F.max("gen").alias("generation")))
    number = lambda c: F.col(c).cast("string")
    codecs_ = F.concat_ws(", ", F.when(F.col("codecs") != "", F.col("codecs")), F.when(F.col("stored") > 0, F.concat(F.lit("none ("), number("stored"), F.lit(" members)"))))
    dead = dead_space if isinstance(dead_space, Column) else F.lit(dead_space)
    lines = (
        ("generation", number("generation")), ("members", F.concat(number("live"), F.lit(" live, "), number("dead"), F.lit(" tombstoned"))),
        ("content", F.concat(number("plain"), F.lit(" bytes, stored in "), number("blobs"), F.lit(" bytes"), R.stored_percent(F.col("plain"), F.col("blobs")))),
        ("shared content", F.when(F.col("shared") > 0, F.concat(R.plural(F.col("shared"), "member"), F.lit(", "), number("not_stored"), F.lit(" bytes not stored")))),
        ("dead space", F.concat(dead.cast("string"), F.lit(" bytes (reclaimed by compact)"))), ("codecs", F.when(codecs_ == "", "-").otherwise(codecs_)))
    rows_ = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(k).alias("key"), v.alias("value")) for i, (k, v) in enumerate(lines)])
    return one.select(F.explode(rows_).alias("r")).select("r.*").filter("value is not null")


def totals_line(totals: DataFrame) -> DataFrame:
    """The line under a listing, from ``catalog.totals``."""
    n = lambda c: F.col(c).cast("string")
    sharing = F.when(F.col("shared") > 0, F.concat(F.lit(", "), n("shared"), F.lit(" same as another ("), n("not_stored"), F.lit(" bytes not stored)"))).otherwise("")
    line = F.concat(n("listed"), F.lit(" listed, "), R.plural(F.col("files"), "file"), F.lit(", "), n("bytes"), F.lit(" bytes stored in "), n("stored"), F.lit(" ("), R.saved_percent(F.col("payload"), F.col("stored")), F.lit(" saved)"), sharing, F.lit("; generation "), n("generation"), F.lit(", "), n("tombstoned"), F.lit(" tombstoned"))
    return totals.select(line.alias("line"))


def summary_line(summary: DataFrame, verb: str = "written") -> DataFrame:
    """The line that ends a dry run, from ``catalog.plan_summary``."""
    n = lambda c: F.col(c).cast("string")
    part = lambda c, words: F.when(F.col(c) > 0, F.concat(n(c), F.lit(words)))
    first = F.concat(F.lit(f"dry run, nothing {verb}: "), R.plural(F.col("paths"), "path"), F.lit(", "), R.human_bytes(F.col("bytes")), F.lit(" of file content"))
    return summary.select(F.concat_ws("; ", first, part("replaced", " replace a member"), part("unchanged", " unchanged"), part("skipped", " skipped")).alias("line"))


def aligned(rows: list[list[str]], right: set[int] = frozenset()) -> list[str]:
    """Cells padded to their column's widest, two blanks apart; the last column isn't padded."""
    widths = [max(map(len, column)) for column in zip(*rows)]
    cells = lambda row: [c.rjust(w) if i in right else c.ljust(w) for i, (c, w) in enumerate(zip(row, widths))]
    return ["  ".join([*cells(row)[:-1], row[-1]]) for row in rows]
