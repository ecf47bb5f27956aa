"""What an entry's metadata allows: storing, recording and restoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import ACLS

#: Names that a notice shows.
SHOWN = 8


def attribute_class(name: Column) -> Column:
    """user, acl, privileged, or plain for names without one of these namespaces. A bare prefix
    is no name in it."""
    inside = lambda prefix: name.startswith(prefix) & (F.length(name) > len(prefix))
    return F.when(inside("user."), "user").when(name.isin(*ACLS), "acl").when(inside("security.") | inside("trusted.") | inside("system."), "privileged").otherwise("plain")


def restore_decision(kind: Column, no_acls: Column, no_xattrs: Column, permissions: Column, root: Column) -> Column:
    """restore, skip (an option says no, or the process can't) or withhold (it would be restored
    with permissions, and is counted for the notice)."""
    acl = F.when(no_acls, "skip").when(~permissions & ~root, "withhold").otherwise("restore")
    privileged = F.when(no_xattrs | ~root, "skip").when(~permissions, "withhold").otherwise("restore")
    return F.when(kind == "acl", acl).when(kind == "privileged", privileged).otherwise(F.when(no_xattrs, "skip").otherwise("restore"))


def recorded(xattrs: Column, no_xattrs: bool = False, no_acls: bool = False) -> Column:
    """The attributes that are captured: ACLs by their own option, all others by the other."""
    return F.map_filter(xattrs, lambda name, _: F.when(name.isin(*ACLS), F.lit(not no_acls)).otherwise(F.lit(not no_xattrs)))


def storable(kind: Column, link: Column) -> Column:
    """store, skip (sockets, with a notice) or error (empty link targets, unknown types)."""
    return F.when(kind.isin("dir", "reg", "fifo", "chardev", "blockdev"), "store").when((kind == "symlink") & (F.coalesce(link, F.lit("")) != ""), "store").when(kind == "socket", "skip").otherwise("error")


def refused_notice(refused: DataFrame) -> DataFrame:
    """One row of the notice on attributes that a destination didn't take: refused(name), one row
    for each time; no row without any."""
    per_name = refused.groupBy("name").agg(F.count("*").alias("n"))
    first = per_name.orderBy("name").limit(SHOWN).agg(F.array_join(F.sort_array(F.collect_list("name")), ", ").alias("listed"))
    total = per_name.agg(F.sum("n").alias("total"), F.count("*").alias("names")).filter("names > 0")
    more = F.when(F.col("names") > SHOWN, F.concat(F.lit(", and "), (F.col("names") - SHOWN).cast("string"), F.lit(" more"))).otherwise("")
    return total.crossJoin(first).select("total", "names", F.concat("listed", more).alias("listed"))


def may_follow(links: DataFrame, user: Column) -> DataFrame:
    """links (owner, dir_owner, dir_sticky, dir_shared) with ``follow``: whether a link on the way
    to a catalog may be followed: in a sticky folder that others may write, only one's own
    links, or those of the folder's owner."""
    guarded = F.col("dir_sticky") & F.col("dir_shared")
    return links.withColumn("follow", ~guarded | (F.col("owner") == user) | (F.col("owner") == F.col("dir_owner")))


#: File systems' time steps in nanoseconds, the finest first.
STEPS = (1, 100, 1000, 1_000_000, 10_000_000, 1_000_000_000, 2_000_000_000)


def time_precision(wanted: int, got: int) -> int | None:
    """The finest step that explains the difference of a probe; None from two seconds on."""
    return next((p for p in STEPS if abs(wanted - got) < p), None)


def same_time(a: Column, b: Column, precision: int) -> Column:
    return F.abs(a - b) < precision
