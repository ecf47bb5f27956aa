"""Selection, merging, sharing, retention, comparison, verification and rollups of a catalog."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import Conflict, Corrupt, NoMatch, Usage
from ..functions import paths as P
from ..functions.render import payload_size
from ..schema import MAX_CHUNK, MAX_XATTR_NAME, MAX_XATTR_VALUE, MAX_XATTRS, TYPES
from .order import running_total


def live(rows: DataFrame) -> DataFrame:
    return rows.filter(~F.col("dead"))


def select(rows: DataFrame, patterns: list[str] = (), expressions: list[str] = (), exclude: list[str] = (), exclude_expressions: list[str] = (), must_match: bool = True) -> DataFrame:
    """Patterns, then expressions on what is left, then exclusions; each pattern and each
    expression must match a row (one aggregation tells), or NoMatch names the first."""
    for tests in ([(p, P.matches(F.col("path"), p)) for p in patterns], [(e, P.regex_matches(F.col("path"), e)) for e in expressions]):
        if not tests:
            continue
        if must_match:
            found = rows.agg(*[F.max(t).alias(f"t{i}") for i, (_, t) in enumerate(tests)]).first()
            for i, (text, _) in enumerate(tests):
                if not found[i]:
                    raise NoMatch(f"nothing matches {text}")
        rows = rows.filter(reduce(lambda a, b: a | b, [t for _, t in tests]))
    if exclude:
        rows = rows.filter(~P.matches_any_or_parent(F.col("path"), list(exclude)))
    if exclude_expressions:
        rows = rows.filter(~P.regex_matches_or_parent(F.col("path"), list(exclude_expressions)))
    return rows


def merge_plan(seen: DataFrame, rows: DataFrame, policy: str = "replace", update: str | None = None) -> DataFrame:
    """What adding ``seen`` does to each path: add, replace, skip or unchanged.

    ``update``: newer (strictly), different (time or size), digest (content). A symbolic link is
    also stale when its target changed (``link``), anything when its type did; a hard link is
    compared by the entry that holds its content, which may be a tombstone.
    """
    facts = ("type", "size", "digest", "mtime", "link")
    rows_ = rows if "link" in rows.columns else rows.withColumn("link", F.lit(None).cast("string"))
    old = live(rows_)
    if "hardlink" in rows.columns:
        held = rows_.select(F.col("id").alias("held_id"), F.struct(*facts).alias("held"))
        old = old.join(held, (F.col("type") == "hardlink") & (F.col("hardlink") == F.col("held_id")), "left")
        old = old.select("path", "id", *[F.when(F.col("held_id").isNotNull(), F.col(f"held.{c}")).otherwise(F.col(c)).alias(c) for c in facts])
    old = old.select("path", F.col("id").alias("old_id"), *[F.col(c).alias(f"old_{c}") for c in facts])
    both = seen.join(old, "path", "left")
    known = F.col("old_id").isNotNull()
    if update:
        changed = {"newer": F.col("mtime") > F.col("old_mtime"), "different": (F.col("mtime") != F.col("old_mtime")) | ((F.col("type") == "reg") & (F.col("size") != F.col("old_size")))}
        changed["digest"] = F.when(F.col("type") == "reg", F.col("digest") != F.col("old_digest")).otherwise(changed["different"])
        if update not in changed:
            raise Usage(f"unknown update test: {update}")
        stale = (F.col("type") != F.col("old_type")) | changed[update]
        if "link" in seen.columns:
            stale = ((F.col("type") == "symlink") & (F.col("old_type") == "symlink") & ~F.col("link").eqNullSafe(F.col("old_link"))) | stale
        action = F.when(~known, "add").when(stale, "replace").otherwise("unchanged")
    elif policy in ("replace", "skip", "error"):
        action = F.when(~known, "add").otherwise("skip" if policy == "skip" else "replace")
        if policy == "error" and not both.filter(known).isEmpty():
            raise Conflict("a path is already in the catalog")
    else:
        raise Usage(f"unknown policy: {policy}")
    return both.withColumn("action", action)


def tombstone(rows: DataFrame, patterns: list[str] = (), expressions: list[str] = ()) -> DataFrame:
    """Marks live entries that match a pattern and an expression, of those that are given. None
    at all is an error, as is one that matches no live entry."""
    if not patterns and not expressions:
        raise Usage("no pattern")
    select(live(rows), patterns, expressions)
    hit = F.lit(True)
    if patterns:
        hit = hit & P.matches_any(F.col("path"), list(patterns))
    if expressions:
        hit = hit & reduce(lambda a, b: a | b, [P.regex_matches(F.col("path"), e) for e in expressions])
    return rows.withColumn("dead", F.col("dead") | hit)


def deletion_plan(rows: DataFrame, patterns: list[str] = (), expressions: list[str] = ()) -> DataFrame:
    """(path, size) of what ``tombstone`` would mark; only files have a size."""
    marked = tombstone(live(rows), patterns, expressions).filter("dead")
    return marked.select("path", F.when(F.col("type") == "reg", F.col("size")).otherwise(F.lit(0)).cast("long").alias("size"))


def plan_summary(plan: DataFrame) -> DataFrame:
    """One row of what a dry run would do, from paths with action, type and size. A second name
    of a file (``hardlink`` set) adds no bytes."""
    size = F.when((F.col("type") == "reg") & F.col("hardlink").isNull(), F.col("size")).otherwise(F.lit(0)) if "hardlink" in plan.columns else F.when(F.col("type") == "reg", F.col("size")).otherwise(F.lit(0))
    written = F.col("action").isin("add", "replace")
    return plan.agg(F.count_if(written).alias("paths"), F.coalesce(F.sum(F.when(written, size)), F.lit(0)).cast("long").alias("bytes"), F.count_if(F.col("action") == "replace").alias("replaced"),
                    F.count_if(F.col("action") == "unchanged").alias("unchanged"), F.count_if(F.col("action") == "skip").alias("skipped"))


def overwrite_plan(chosen: DataFrame, there: DataFrame, policy: str = "newer") -> DataFrame:
    """(path, action) of extracting onto a tree (path, mtime): always, keep what is there, or
    write only what is newer than that."""
    if policy not in ("always", "keep", "newer"):
        raise Usage(f"unknown policy: {policy}")
    both = chosen.join(there.select("path", F.col("mtime").alias("disk_mtime")), "path", "left")
    free = F.col("disk_mtime").isNull()
    write = {"always": F.lit(True), "keep": free, "newer": free | (F.col("mtime") > F.col("disk_mtime"))}[policy]
    return both.select("path", F.when(write, "write").otherwise("skip").alias("action"))


def first_names(rows: DataFrame) -> DataFrame:
    """Files with several names (dev, ino, nlink > 1): adds ``first_id``, the least id of each;
    null for files with one name."""
    several = rows.filter("nlink > 1") if "nlink" in rows.columns else rows
    first = several.groupBy("dev", "ino").agg(F.min("id").alias("first_id"))
    out = rows.join(first, ["dev", "ino"], "left")
    return out.withColumn("first_id", F.when(F.col("nlink") > 1, F.col("first_id"))) if "nlink" in rows.columns else out


def tree_roots(rows: DataFrame, dirs: DataFrame) -> DataFrame:
    """(path, root): the topmost of the directories dirs(path) above each path, or the path."""
    above = rows.select("path", F.posexplode(P.ancestors(F.col("path"), False)).alias("depth", "dir")).join(dirs.select(F.col("path").alias("dir")), "dir")
    return rows.select("path").join(above.groupBy("path").agg(F.min_by("dir", "depth").alias("top")), "path", "left").select("path", F.coalesce("top", "path").alias("root"))


def newest(rows: DataFrame) -> DataFrame:
    """The newest valid version of every path, by generation, then id."""
    valid = rows.filter("valid") if "valid" in rows.columns else rows
    return valid.groupBy("path").agg(F.max_by("id", F.struct("gen", "id")).alias("id"), F.max("gen").alias("gen"))


def totals(rows: DataFrame) -> DataFrame:
    """Sums under a listing, over live entries: listed, files, bytes, payload, stored, shared and
    the bytes those don't store; of the whole catalog the generation and the tombstones."""
    own = rows.select(F.col("id").alias("data"), F.col("len").alias("owner_len"))
    one = rows.join(own, "data", "left")
    file = ~F.col("dead") & (F.col("type") == "reg")
    total = lambda c, v: F.coalesce(F.sum(F.when(c, v)), F.lit(0)).cast("long")
    size = F.col("payload") if "payload" in rows.columns else F.col("size")
    shared = file & F.col("data").isNotNull()
    return one.agg(F.count_if(~F.col("dead")).alias("listed"), F.count_if(file).alias("files"), total(file, F.col("size")).alias("bytes"), total(file, size).alias("payload"), total(file, F.col("len")).alias("stored"),
                   F.count_if(shared).alias("shared"), total(shared, F.col("owner_len")).alias("not_stored"), F.max("gen").alias("generation"), F.count_if("dead").alias("tombstoned"))


def largest_chunk(rows: DataFrame) -> DataFrame:
    """The greatest chunk size that reading the live entries needs, their owners' included."""
    own = rows.select(F.col("id").alias("holder"), F.col("chunk").alias("own_chunk"))
    return live(rows).withColumn("holder", F.coalesce("data", "id")).join(own, "holder").agg(F.coalesce(F.max("own_chunk"), F.lit(0)).cast("long").alias("largest"))


def payload_totals(rows: DataFrame) -> DataFrame:
    """Bytes that a run over the live entries handles, and those of owners alone."""
    return live(rows).agg(F.sum("size").alias("bytes"), F.coalesce(F.sum(F.when(F.col("data").isNull(), F.col("size"))), F.lit(0)).cast("long").alias("own_bytes"))


def out_of_range(rows: DataFrame, body: int, index: int) -> DataFrame:
    """Entries whose stored bytes [off, off + len) don't lie in [body, index)."""
    off, length = F.coalesce("off", F.lit(0)), F.coalesce("len", F.lit(0))
    inside = (off >= body) & (off <= index) & (length <= index - off)
    return rows.filter((length > 0) & ~inside).select("id", "path", F.lit("blob out of range").alias("rule"))


def kept(rows: DataFrame) -> DataFrame:
    """What a compaction keeps: live entries, targets of live hard links, then owners of the
    content of either. Two semi-joins; links are at most two deep."""
    targets = live(rows).filter("hardlink is not null").select(F.col("hardlink").alias("id")).distinct()
    needed = rows.filter(~F.col("dead")).select("id").union(targets).distinct()
    owners = rows.join(needed, "id", "left_semi").filter("data is not null").select(F.col("data").alias("id")).distinct()
    return rows.join(needed.union(owners).distinct(), "id", "left_semi")


def renumbered(codecs: DataFrame, rows: DataFrame) -> DataFrame:
    """Codecs in use with dense new positions; the catalog of codecs is small."""
    used = rows.select(F.col("codec").alias("pos")).distinct()
    return codecs.join(used, "pos", "left_semi").withColumn("new_pos", F.row_number().over(W.orderBy("pos")) - 1)


def info(rows: DataFrame) -> DataFrame:
    """Counts and bytes; rows have data (owner) and len (own stored bytes)."""
    own = rows.select(F.col("id").alias("data"), F.col("len").alias("owner_len"))
    one = rows.join(own, "data", "left")
    is_live = ~F.col("dead")
    count = lambda c: F.count_if(c)
    total = lambda c, v: F.coalesce(F.sum(F.when(c, F.col(v))), F.lit(0)).cast("long")
    return one.agg(count(is_live).alias("live"), count(F.col("dead")).alias("dead"), total(is_live, "size").alias("plain"), total(is_live, "len").alias("blobs"),
                   count(is_live & (F.col("type") == "reg") & (F.col("codec") == -1)).alias("stored"), count(is_live & F.col("data").isNotNull()).alias("shared"), total(is_live, "owner_len").alias("not_stored"))


KINDS = ("missing", "extra", "type", "size", "content", "link", "hardlink", "device", "mode", "owner", "mtime", "xattrs", "acls")
COMPARED = {"type": "string", "size": "long", "digest": "string", "mode": "int", "mtime": "long", "link": "string", "rdev": "array<bigint>", "uid": "long", "gid": "long", "xattrs": "map<string,binary>"}
ACLS = ("system.posix_acl_access", "system.posix_acl_default")


def _side(rows: DataFrame, name: str) -> DataFrame:
    columns = [F.col(c) if c in rows.columns else F.lit(None).cast(kind).alias(c) for c, kind in COMPARED.items()]
    return rows.select("path", F.lit(True).alias(f"in_{name}"), *[x.alias(f"{name}_{c}") for x, c in zip(columns, COMPARED)])


def _hard_links(rows: DataFrame) -> DataFrame:
    """Live hard links with their targets, which may be tombstones."""
    target = rows.select(F.col("id").alias("t_id"), F.col("path").alias("t_path"), F.col("dead").alias("t_dead"), F.col("size").alias("t_size"), F.col("digest").alias("t_digest"))
    return live(rows).filter("type = 'hardlink'").join(target, F.col("hardlink") == F.col("t_id"), "left")


def _pruned(rows: DataFrame, disk: DataFrame) -> DataFrame:
    """Paths of one side only that aren't differences: what lies below a missing or an extra
    directory, and directories on the way to an entry.

    Only paths and types are read; the sides meet in one aggregation, which all uses share.
    """
    sides = live(rows).select("path", F.lit(1).alias("side"), "type").unionByName(disk.select("path", F.lit(2).alias("side"), "type"))
    single = sides.groupBy("path").agg(F.sum("side").alias("sides"), F.max("type").alias("type")).filter("sides in (1, 2)")
    way = live(rows).select(F.explode(P.ancestors(F.col("path"), False)).alias("path")).distinct().withColumn("way", F.lit(True))
    dirs = single.filter("type = 'dir'").join(way, "path", "left").select("path", ((F.col("sides") == 2) & F.col("way").isNotNull()).alias("on_the_way"))
    above = single.select("path", F.explode(P.ancestors(F.col("path"), False)).alias("dir"))
    below = above.join(dirs.filter("not on_the_way").select(F.col("path").alias("dir")), "dir", "left_semi").select("path")
    return below.union(dirs.filter("on_the_way").select("path"))


def differences(rows: DataFrame, disk: DataFrame) -> DataFrame:
    """(path, kind, rank, archive, disk, names) of live entries against a tree, all KINDS.

    A full outer join on path. A type difference hides all others, a size difference the
    content's. A hard link is a file with the content of its target, and differs as such when
    the tree (with dev and ino) has two files. Columns that a side lacks, and nulls, aren't
    compared. names: of the extended attributes that differ.
    """
    a = live(rows)
    links = _hard_links(rows) if "hardlink" in rows.columns else None
    if links is not None:
        content = links.withColumn("size", F.coalesce("t_size", "size")).withColumn("digest", F.coalesce("t_digest", "digest")).select(*rows.columns)
        a = a.filter("type != 'hardlink'").unionByName(content)
    both = _side(a, "a").join(_side(disk, "d"), "path", "full_outer")

    def one(kind: str, when: F.Column, show=None, names: F.Column | None = None) -> F.Column:
        value = lambda side: show(side).cast("string") if show else F.lit(None).cast("string")
        return F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(KINDS.index(kind)).alias("rank"), value("a").alias("archive"), value("d").alias("disk"),
                                     (F.lit(None).cast("array<string>") if names is None else names).alias("names")))

    column = lambda c: lambda side: F.col(f"{side}_{c}")
    differ = lambda c: F.col(f"a_{c}") != F.col(f"d_{c}")
    kind = F.when(F.col("a_type") == "hardlink", "reg").otherwise(F.col("a_type"))
    in_both = F.col("in_a").isNotNull() & F.col("in_d").isNotNull()
    same = in_both & (kind == F.col("d_type"))
    reg = same & (kind == "reg")
    keys = F.array_sort(F.array_union(F.map_keys("a_xattrs"), F.map_keys("d_xattrs")))
    unequal = F.filter(keys, lambda n: ~F.element_at("a_xattrs", n).eqNullSafe(F.element_at("d_xattrs", n)))
    acls, others = F.filter(unequal, lambda n: n.isin(*ACLS)), F.filter(unequal, lambda n: ~n.isin(*ACLS))
    attributed = same & F.col("a_type").isin("reg", "dir")
    found = F.array(
        one("missing", F.col("in_d").isNull()), one("extra", F.col("in_a").isNull()), one("type", in_both & (kind != F.col("d_type")), lambda s: kind if s == "a" else F.col("d_type")),
        one("size", reg & differ("size"), column("size")), one("content", reg & ~differ("size") & differ("digest")),
        one("link", same & (kind == "symlink") & differ("link"), column("link")),
        one("device", same & kind.isin("chardev", "blockdev") & (F.size("a_rdev") == 2) & differ("rdev"), lambda s: F.array_join(F.col(f"{s}_rdev").cast("array<string>"), ",")),
        one("mode", same & (kind != "symlink") & differ("mode"), column("mode")),
        one("owner", same & (F.coalesce(differ("uid"), F.lit(False)) | F.coalesce(differ("gid"), F.lit(False))), lambda s: F.concat(F.coalesce(F.col(f"{s}_uid").cast("string"), F.lit("-")), F.lit("/"), F.coalesce(F.col(f"{s}_gid").cast("string"), F.lit("-")))),
        one("mtime", same & differ("mtime"), column("mtime")),
        one("xattrs", attributed & (F.size(others) > 0), names=others), one("acls", attributed & (F.size(acls) > 0), names=acls))
    both = both.filter(F.col("in_a").isNotNull() | (F.col("d_type") != "socket"))
    out = both.join(_pruned(rows, disk), "path", "left_anti").select("path", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select("path", "x.*")
    if links is None or not {"dev", "ino"} <= set(disk.columns):
        return out
    inode = lambda p: disk.filter("type = 'reg'").select(F.col("path").alias(p), F.struct("dev", "ino").alias(f"{p}_inode"))
    parted = links.filter("not t_dead").select("path", "t_path").join(inode("path"), "path").join(inode("t_path"), "t_path").filter("path_inode != t_path_inode")
    return out.unionByName(parted.select("path", F.lit("hardlink").alias("kind"), F.lit(KINDS.index("hardlink")).alias("rank"), F.col("t_path").alias("archive"), F.lit(None).cast("string").alias("disk"), F.lit(None).cast("array<string>").alias("names")))


def scoped_differences(rows: DataFrame, disk: DataFrame, patterns: list[str] = (), expressions: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """Differences within a selection: exclusions come first, and each pattern must match an entry
    that they left; a tree's other paths are in scope if a pattern matches them."""
    left = live(rows)
    there = disk
    if exclude:
        left, there = (x.filter(~P.matches_any_or_parent(F.col("path"), list(exclude))) for x in (left, there))
    chosen = select(left, patterns, expressions)
    if patterns:
        there = there.filter(P.matches_any(F.col("path"), list(patterns)))
    if expressions:
        there = there.filter(reduce(lambda a, b: a | b, [P.regex_matches(F.col("path"), e) for e in expressions]))
    return differences(chosen, there)


def in_scope(paths: DataFrame, prefixes: DataFrame, patterns: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """Paths that a comparison takes after components were stripped: those that a removed prefix
    before them makes a selected stored path. prefixes(prefix): the few that were removed."""
    both = paths.crossJoin(F.broadcast(prefixes.distinct())).withColumn("stored", F.concat("prefix", F.lit("/"), "path"))
    hit = P.matches_any(F.col("stored"), list(patterns)) if patterns else F.lit(True)
    if exclude:
        hit = hit & ~P.matches_any_or_parent(F.col("stored"), list(exclude))
    return paths.join(both.filter(hit).select("path").distinct(), "path", "left_semi")


def copied(chosen: DataFrame) -> DataFrame:
    """Entries whose content a comparison by extraction writes: all files, and hard links but
    those whose target is compared itself."""
    compared = chosen.filter("type = 'reg'").select(F.col("id").alias("hardlink"))
    return chosen.filter("type = 'reg'").select("id", "path").union(chosen.filter("type = 'hardlink'").join(compared, "hardlink", "left_anti").select("id", "path"))


def copy_differences(found: DataFrame, copies: DataFrame) -> DataFrame:
    """Differences between the source and its extracted copy that the comparison with the catalog
    didn't find already, marked as ``extracted``."""
    new = copies.join(found.select("path", "kind"), ["path", "kind"], "left_anti")
    return found.withColumn("extracted", F.lit(False)).unionByName(new.withColumn("extracted", F.lit(True)))


def layout(rows: DataFrame, chunk: int, start: int = 0) -> DataFrame:
    """(id, data, len, n_chunks, off) of files that are stored as they are: equal contents once,
    at their first owner, one after the other in order of id."""
    first = rows.filter("size > 0").groupBy("digest", "size").agg(F.min("id").alias("owner"))
    one = rows.join(first, ["digest", "size"], "left").withColumn("data", F.when(F.col("owner") != F.col("id"), F.col("owner")))
    one = one.withColumn("len", F.when(F.col("data").isNull(), F.col("size")))
    placed = running_total(one, ["id"], F.col("len"), "before")
    return placed.select("id", "data", "len", F.when(F.col("data").isNull(), F.ceil(F.col("len") / chunk)).otherwise(0).cast("long").alias("n_chunks"), F.when(F.col("len") > 0, F.col("before") + start).alias("off"))


def verify_stats(results: DataFrame, rows: DataFrame) -> DataFrame:
    """checked and failed entries, bytes of the contents that were decoded, and the first failed
    entry's path by id, of ``verified`` rows."""
    sizes = rows.select(F.col("id").alias("owner"), "size")
    decoded = results.select("owner").distinct().join(sizes, "owner").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"))
    return results.agg(F.count_if("ok").alias("checked"), F.count_if(~F.col("ok")).alias("failed"), F.min_by("path", F.when(~F.col("ok"), F.col("id"))).alias("first_failed")).crossJoin(decoded)


def compared(one: DataFrame, other: DataFrame, fields: list[str]) -> DataFrame:
    """(id, field, one, other) of every field in which two readings of a catalog differ; an entry
    that one of them lacks differs in ``id`` only."""
    side = lambda rows, name: rows.select("id", F.lit(True).alias(f"in_{name}"), *[F.col(f).alias(f"{name}_{f}") for f in fields])
    both = side(one, "one").join(side(other, "other"), "id", "full_outer")
    text = lambda c: F.col(c).cast("string")
    entry = lambda when, field, a, b: F.when(when, F.struct(F.lit(field).alias("field"), a.alias("one"), b.alias("other")))
    there = F.col("in_one").isNotNull() & F.col("in_other").isNotNull()
    found = [entry(~there, "id", F.when(F.col("in_one"), text("id")), F.when(F.col("in_other"), text("id")))]
    found += [entry(there & ~F.col(f"one_{f}").eqNullSafe(F.col(f"other_{f}")), f, text(f"one_{f}"), text(f"other_{f}")) for f in fields]
    return both.select("id", F.explode(F.array_compact(F.array(*found))).alias("x")).select("id", "x.*")


def extraction(chosen: DataFrame, rows: DataFrame) -> DataFrame:
    """(phase, path, action, content, link_to): how to write the chosen live entries.

    1: directories and other entries without content; 2: files; 3: hard links, once files
    are there; 4: metadata of directories, to be applied in descending order of path. Content
    names the entry that holds the bytes. If the target of hard links isn't chosen, the first
    of them by path gets its content and the others link to that one.
    """
    none = F.lit(None).cast("long"), F.lit(None).cast("string")
    step = lambda df, phase, action, content=none[0], to=none[1]: df.select(F.lit(phase).alias("phase"), "path", action.alias("action"), content.alias("content"), to.alias("link_to"))
    links = chosen.filter("type = 'hardlink'").select("path", "hardlink")
    carriers = links.groupBy("hardlink").agg(F.min("path").alias("carrier"))
    written = chosen.filter("type != 'hardlink'").select(F.col("id").alias("hardlink"), F.col("path").alias("target"))
    holder = rows.select(F.col("id").alias("hardlink"), F.coalesce("data", "id").alias("holder"))
    links = links.join(carriers, "hardlink").join(written, "hardlink", "left").join(holder, "hardlink", "left")
    carries = F.col("target").isNull() & (F.col("path") == F.col("carrier"))
    nodes = chosen.filter("type not in ('reg', 'hardlink')")
    return (step(nodes, 1, F.col("type")).union(step(chosen.filter("type = 'reg'"), 2, F.lit("write"), F.coalesce("data", "id")))
            .union(step(links, 3, F.when(carries, "write").otherwise("link"), F.when(carries, F.col("holder")), F.when(~carries, F.coalesce("target", "carrier"))))
            .union(step(nodes.filter("type = 'dir'"), 4, F.lit("finish"))))


def stripped(rows: DataFrame, n: int) -> DataFrame:
    """Paths without n components; of equal ones the last by stored path stays, the others
    collide unless both are directories."""
    cut = rows.withColumn("new_path", P.strip(F.col("path"), n)).filter("new_path is not null")
    order = W.partitionBy("new_path").orderBy("path", "id")
    nxt = F.lead("path").over(order)
    return cut.withColumn("next_path", nxt).withColumn("collides", nxt.isNotNull() & ~((F.col("type") == "dir") & (F.lead("type").over(order) == "dir")))


def under(rows: DataFrame, dirs: DataFrame) -> DataFrame:
    """Rows below any directory of dirs(path): ancestors are exploded and equi-joined."""
    above = rows.select("path", F.explode(P.ancestors(F.col("path"), False)).alias("dir"))
    hit = above.join(dirs.select(F.col("path").alias("dir")), "dir", "left_semi").select("path").distinct()
    return rows.join(hit, "path", "left_semi")


def directories(rows: DataFrame) -> DataFrame:
    """Entries and bytes below every directory."""
    return rows.select(F.explode(P.ancestors(F.col("path"), False)).alias("dir"), "size").groupBy("dir").agg(F.count("*").alias("entries"), F.sum("size").alias("bytes"))


def verified(rows: DataFrame, content: DataFrame) -> DataFrame:
    """(id, path, owner, ok): each blob is hashed once, its result goes to all that share it.

    content: id, bytes of the owners, and their recorded digest if it is at hand.
    """
    target = rows.select(F.col("id").alias("hardlink"), F.col("data").alias("target_data"))
    owner = rows.join(target, "hardlink", "left").withColumn("owner", F.coalesce("target_data", F.when(F.col("hardlink").isNotNull(), F.coalesce("hardlink")), "data", "id"))
    actual = content.withColumnRenamed("id", "owner").withColumn("actual", F.sha2("bytes", 256))
    if "digest" not in content.columns:
        actual = actual.join(rows.select(F.col("id").alias("owner"), "digest"), "owner")
    result = actual.select("owner", (F.col("actual") == F.col("digest")).alias("ok"))
    return owner.join(result, "owner", "left").select("id", "path", "owner", F.coalesce("ok", F.lit(False)).alias("ok"))


DIGEST_HEX = 64


def _entry_rules(have: set[str], codecs: int) -> dict[str, F.Column]:
    """What each entry must satisfy by itself; rules of columns that a table lacks are left out."""
    kind = F.col("type")
    reg, device = kind == "reg", kind.isin("chardev", "blockdev")
    some = lambda c: F.coalesce(F.col(c), F.lit(0)) != 0
    count = lambda c: F.coalesce(F.size(c), F.lit(0))
    rules = {
        "unknown type": ~kind.isin(*TYPES), "empty path": F.col("path") == "", "unsafe path": ~P.is_stored_path(F.col("path")),
        "mode bits": (F.col("mode") < 0) | (F.col("mode") > 0o7777), "codec out of range": (F.col("codec") < -1) | (F.col("codec") >= codecs), "digest missing": reg & F.col("digest").isNull(),
        "negative size": F.col("size") < 0, "size of a non-file": ~reg & (F.col("size") > 0), "sharer with a blob": F.col("data").isNotNull() & F.col("len").isNotNull(), "sharer with a codec": F.col("data").isNotNull() & (F.col("codec") != -1),
        "digest length": F.col("digest").isNotNull() & (F.length("digest") != DIGEST_HEX) if "strict" in have else F.lit(False),
    }
    if "link" in have:
        empty = F.coalesce(F.col("link"), F.lit("")) == ""
        rules |= {"symlink without target": (kind == "symlink") & empty, "target of a non-link": (kind != "symlink") & ~empty}
    if {"hardlink", "strict"} <= have:
        rules |= {"hard link without entry": (kind == "hardlink") & ~some("hardlink"), "entry of a non-link": (kind != "hardlink") & some("hardlink")}
    if "rdev" in have:
        rules |= {"device numbers": device & (count("rdev") != 2), "device numbers of a non-device": ~device & (count("rdev") > 0)}
    if "xattrs" in have:
        names, values = F.map_keys("xattrs"), F.map_values("xattrs")
        rules |= {"too many attributes": count("xattrs") > MAX_XATTRS, "attribute name": F.exists(names, lambda n: (n == "") | (F.octet_length(n) > MAX_XATTR_NAME)), "attribute value": F.exists(values, lambda v: F.octet_length(v) > MAX_XATTR_VALUE)}
    payload = F.col("size")
    if "sparse" in have:
        payload = payload_size(F.col("size"), F.col("sparse"))
        nxt = F.concat(F.slice("sparse", 2, F.greatest(F.size("sparse"), F.lit(1))), F.array(F.struct(F.col("size").alias("off"), F.lit(0).cast("long").alias("len"))))
        rules |= {"segments of a non-file": ~reg & (count("sparse") > 0), "empty segment": F.exists("sparse", lambda s: s["len"] <= 0),
                  "segments out of order": F.exists(F.arrays_zip(F.col("sparse").alias("a"), nxt.alias("b")), lambda z: z["a"]["off"] + z["a"]["len"] > z["b"]["off"]) & (count("sparse") > 0)}
    if "chunk" in have:
        rules["chunk limit"] = F.col("chunk") > MAX_CHUNK
    if "chunks" in have:
        own = reg & F.col("data").isNull()
        n = count("chunks").cast("long")
        rules |= {"chunks and length": F.col("chunks").isNotNull() & (F.aggregate("chunks", F.lit(0).cast("long"), lambda a, x: a + x) != F.col("len")), "chunks of a non-file": ~reg & (n > 0),
                  "chunk count": F.when(F.col("chunk").isNotNull(), (payload > F.col("chunk") * n) | ((n > 0) & (payload <= F.col("chunk") * (n - 1)))).otherwise(own & (n > 0)) if "strict" in have else F.col("chunk").isNotNull() & (n != F.ceil(payload / F.col("chunk")))}
    return rules


def violations(rows: DataFrame, codecs: int, strict: bool = False) -> DataFrame:
    """(id, path, rule) of every broken constraint, all of them, not the first. ``strict`` adds
    the rules of stored catalogs: digest length, type-specific links, chunk tables."""
    rules = _entry_rules(set(rows.columns) | ({"strict"} if strict else set()), codecs)
    broken = F.array(*[F.when(c, F.lit(r)) for r, c in rules.items()])
    out = rows.select("id", "path", F.explode(F.array_compact(broken)).alias("rule"))
    twice = rows.groupBy("id").agg(F.count("*").alias("n"), F.min("path").alias("path")).filter("n > 1").select("id", "path", F.lit("duplicate id").alias("rule"))
    owner = rows.select(F.col("id").alias("data"), F.col("data").alias("owner_data"), F.col("size").alias("owner_size"), F.col("digest").alias("owner_digest"), F.lit(True).alias("there"))
    bad_owner = rows.filter("data is not null").join(owner, "data", "left").filter(F.col("there").isNull() | F.col("owner_data").isNotNull() | ~F.col("size").eqNullSafe(F.col("owner_size")) | ~F.col("digest").eqNullSafe(F.col("owner_digest"))).select("id", "path", F.lit("owner").alias("rule"))
    target = rows.select(F.col("id").alias("hardlink"), F.col("type").alias("target_type"))
    bad_link = rows.filter("hardlink is not null").join(target, "hardlink", "left").filter(~F.col("target_type").eqNullSafe(F.lit("reg"))).select("id", "path", F.lit("hard link target").alias("rule"))
    return out.union(twice).union(bad_owner).union(bad_link)


def assert_valid(rows: DataFrame, codecs: int) -> None:
    first = violations(rows, codecs).orderBy("id", "rule").first()
    if first:
        raise Corrupt(f"entry {first['id']} ({first['path']}): {first['rule']}")


def best_trial(trials: DataFrame, base: int, total: int, held: int) -> DataFrame:
    """Walks dictionary sizes upward; a candidate wins with a positive gain over 1.02 times
    the best, and two misses in a row end the walk. trials: size, n, ok, and a name, candidate,
    if there is one."""
    gain = (F.lit(base) - F.col("n")) * total / held - F.col("size")
    name = F.col("candidate") if "candidate" in trials.columns else F.col("size")
    listed = trials.agg(F.sort_array(F.collect_list(F.struct(name.alias("candidate"), "size", gain.alias("gain"), "ok"))).alias("t"))  # one row per candidate size, at most nine
    best = lambda c, z, g, m: F.struct(c.cast("long").alias("candidate"), z.cast("long").alias("size"), g.alias("gain"), m.alias("misses"))

    def step(s, t):
        wins = t["ok"] & (t["gain"] > 0) & (t["gain"] > s["gain"] * 1.02)
        lost = best(s["candidate"], s["size"], s["gain"], s["misses"] + 1)
        return F.when(s["misses"] >= 2, s).when(wins, best(t["candidate"], t["size"], t["gain"], F.lit(0))).otherwise(lost)

    return listed.select(F.aggregate("t", best(F.lit(0), F.lit(0), F.lit(0.0), F.lit(0)), step).alias("b")).select("b.size", "b.gain", *(["b.candidate"] if "candidate" in trials.columns else []))
