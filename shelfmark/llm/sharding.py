"""Sharding by a k-d tree over metadata: weighted medians along the widest dimension.

Rows with equal texts form one unit with the metadata of its least (lang, source); its
weight is its bytes. A node that stands for m leaves is split, along the dimension with the
widest spread relative to the whole table, at the weighted quantile that gives each side
its part of the leaves. Quantiles come from distributed histograms that are refined until
a bin is a single key or light enough, so no node is ever sorted or gathered. All nodes of
a level share a job; the driver sees bins and splits only. Law: ``bytes``.

Equal texts stay in one shard as long as they fit one. Units above WHOLE of a leaf, too heavy
for a median to balance, get a place first, the heaviest first in the shard with the most room;
the tree then fills each shard's remaining room with all others. Only a unit that no shard has
room for is cut, into pieces by hash of doc_id and text, which are neighbours in the tree.

Defined cases: a null text has size 8 and crc32 0; null lang or source is a value of its
own; null and repeated doc_ids are rows like others; texts of any length count by their bytes;
an empty table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import heapq
import math
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import scratch
from .tables import read

SHARDS = 24
#: A unit above this part of a leaf gets a place before the tree (at most shards / WHOLE units);
#: one that has to be cut falls into pieces of PIECE of a leaf; a bin below LIGHT of one isn't refined.
WHOLE, PIECE, LIGHT = 0.1, 0.0125, 0.002
DIMENSIONS = ("size", "lang", "source")
SUB_BITS, TIE_BITS = 11, 21
SLOT_ROWS = 20_000


def _table(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """A few literal rows of longs, one per node."""
    return spark.sql(f"SELECT * FROM VALUES {','.join('(' + ','.join(f'{int(x)}L' for x in r) + ')' for r in rows)} AS t({names})")


def _bins(nodes: int) -> int:
    return max(16, 32768 // max(1, nodes))


def split_points(units: DataFrame, nodes: dict[int, dict]) -> None:
    """Sets ``cut`` of each node: keys below it go left. Weighted quantiles by refinement."""
    spark = units.sparkSession
    open_ = dict(nodes)
    bins = _bins(len(nodes))
    while open_:
        for n in open_.values():
            n["step"] = max(1, -(-(n["hi"] - n["lo"]) // bins))
        at = F.broadcast(_table(spark, [(i, n["dim"], n["lo"], n["hi"], n["step"]) for i, n in open_.items()], "node,dim,lo,hi,step"))
        key = F.element_at(F.array(*DIMENSIONS), (F.col("dim") + 1).cast("int"))
        rows = (
            units.join(at, "node").withColumn("key", key).filter("key >= lo and key < hi")
            .groupBy("node", F.expr("(key - lo) div step").alias("bin")).agg(F.sum("weight").alias("weight")).collect()
        )
        by: dict[int, list] = {i: [] for i in open_}
        for r in rows:
            by[r["node"]].append((r["bin"], int(r["weight"])))
        for i, n in list(open_.items()):
            below = n["below"]
            for b, w in sorted(by[i]):
                if below + w >= n["goal"]:
                    break
                below += w
            lo = n["lo"] + b * n["step"]
            n |= {"below": below, "lo": lo, "hi": min(n["hi"], lo + n["step"])}
            if n["hi"] - n["lo"] <= 1 or w <= n["light"]:
                # the border of the bin nearer to the goal
                n["cut"], n["left"] = (n["lo"], below) if n["goal"] - below <= below + w - n["goal"] else (n["hi"], below + w)
                del open_[i]


def kd_tree(units: DataFrame, room: list[int]) -> DataFrame:
    """units (key columns named as DIMENSIONS, weight) with their ``shard``, which get weight in
    proportion to their room.

    A node is named by its first leaf; node i with m leaves has the leaves i..i+m-1.
    """
    leaves, upto = len(room), [0, *accumulate(room)]
    table = scratch.write(units.withColumn("node", F.lit(0).cast("long")), "kd")
    spread = [f(d).alias(f"{f.__name__}_{d}") for d in DIMENSIONS for f in (F.min, F.max)]
    whole = table.agg(F.sum("weight").alias("weight"), *spread).first()
    size = {0: leaves}
    held = lambda i, m: upto[i + m] - upto[i]
    if whole["weight"] is None:
        return table.withColumnRenamed("node", "shard")
    light = max(1, int(LIGHT * whole["weight"] / leaves))
    extent = lambda r, d: (r[f"max_{d}"] - r[f"min_{d}"]) >> (SUB_BITS + TIE_BITS)
    while any(m > 1 for m in size.values()):
        nodes = {}
        for r in table.groupBy("node").agg(F.sum("weight").alias("weight"), *spread).collect():
            m = size[r["node"]]
            if m > 1:
                dim = max(range(len(DIMENSIONS)), key=lambda k: extent(r, DIMENSIONS[k]) / max(1, extent(whole, DIMENSIONS[k])))
                d = DIMENSIONS[dim]
                nodes[r["node"]] = {"dim": dim, "lo": r[f"min_{d}"], "hi": r[f"max_{d}"] + 1, "below": 0, "goal": int(r["weight"]) * held(r["node"], (m + 1) // 2) // max(1, held(r["node"], m)), "light": light}
        split_points(table, nodes)
        if nodes:
            at = F.broadcast(_table(table.sparkSession, [(i, n["dim"], n["cut"], i + (size[i] + 1) // 2) for i, n in nodes.items()], "node,dim,cut,right"))
            key = F.element_at(F.array(*DIMENSIONS), (F.col("dim") + 1).cast("int"))
            moved = table.join(at, "node", "left").withColumn("node", F.when(key >= F.col("cut"), F.col("right")).otherwise(F.col("node"))).drop("dim", "cut", "right")
            step = scratch.write(moved, "kd")
            scratch.drop(table)
            table = step
        size = {k: v for i, m in size.items() for k, v in ([(i, m)] if m == 1 else [(i, (m + 1) // 2), (i + (m + 1) // 2, m // 2)])}
    return table.withColumnRenamed("node", "shard")


def placed_first(heavy: list[tuple[int, int, int]], total: int, leaves: int) -> tuple[list[tuple[int, int, int, int]], list[int]]:
    """Where heavy units (text_hash, size, bytes) go, as (text_hash, size, shard, pieces), and
    the room left in each shard; shard -1 means that the unit is cut into pieces."""
    leaf = total / leaves
    free = [(-leaf, k) for k in range(leaves)]
    out = []
    for key, size, weight in sorted(heavy, key=lambda u: (-u[2], u[0])):
        room, k = free[0]
        if weight <= -room:
            heapq.heapreplace(free, (room + weight, k))
            out.append((key, size, k, 1))
        else:
            out.append((key, size, -1, min(math.ceil(weight / (leaf * PIECE)), (1 << SUB_BITS) - 1)))
    return out, [int(-room) for room, _ in sorted(free, key=lambda f: f[1])]


def shard(docs: DataFrame, shards: int | None = SHARDS, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    base = scratch.write(
        docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"), "lang", "source").withColumn("row", F.monotonically_increasing_id()), "kd-base")
    n_rows, total = base.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    leaves = shards if shards else max(1, -(-total // target_bytes))
    unit = ["text_hash", "size"]
    hot = base.groupBy(*unit).agg(F.sum(F.col("size")).alias("bytes")).filter(F.col("bytes") > WHOLE * total / leaves)
    hot = scratch.write(hot, "kd-hot")
    place, room = placed_first([tuple(r) for r in hot.select("text_hash", "size", "bytes").collect()], total, leaves)
    rows = base
    if place:
        rows = base.join(F.broadcast(_table(spark, place, "text_hash,size,first_shard,pieces")), unit, "left")
    else:
        rows = base.withColumn("first_shard", F.lit(None).cast("long")).withColumn("pieces", F.lit(None).cast("long"))
    whole = rows.filter("first_shard >= 0").select("doc_id", "size", "text_crc32", F.col("first_shard").cast("int").alias("shard"))
    rows = rows.filter("first_shard is null or first_shard < 0").withColumn("sub", F.coalesce(F.pmod(F.xxhash64("doc_id", "row"), F.col("pieces")), F.lit(0)))
    unit.append("sub")
    tie = F.pmod(F.col("text_hash"), F.lit(1 << TIE_BITS)) * (1 << SUB_BITS) + F.col("sub")
    wide = lambda c: F.least(c, F.lit((1 << 31) - 1)).cast("long") * (1 << (SUB_BITS + TIE_BITS)) + tie
    code = lambda c: F.coalesce(F.crc32(F.col(c).cast("binary")) / 2, F.lit(0)).cast("long")
    units = rows.groupBy(*unit).agg(F.sum(F.col("size")).alias("weight"), F.min(F.struct("lang", "source")).alias("meta"))
    units = units.select("text_hash", F.col("size").alias("unit_size"), "sub", "weight", wide(F.col("size")).alias("key"), F.col("meta.lang").alias("lang"), F.col("meta.source").alias("source"))
    units = units.select("text_hash", "unit_size", "sub", "weight", F.col("key").alias("size"), wide(code("lang")).alias("lang"), wide(code("source")).alias("source"))
    tree = kd_tree(units, room).select("text_hash", F.col("unit_size").alias("size"), "sub", F.col("shard").cast("int").alias("shard"))
    placed = rows.join(tree, unit).select("doc_id", F.col("size"), "text_crc32", "shard").unionByName(whole)

    # slots: counts of hashed buckets give offsets, each bucket is numbered by itself
    buckets = max(1, n_rows // (leaves * SLOT_ROWS))
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)))
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "bucket").count().select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    slot = F.row_number().over(W.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32")) - 1
    return placed.withColumn("slot", slot).join(offsets, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("slot") + F.col("offset")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op8_kd_shards(spark, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents", "doc_id", "lang", "source", "text"))


def shard_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The assignment of every row that the mix kept; any table with doc_id, lang, source and
    text, empty or with nulls, repeated rows and other columns, is handled as by ``shard``."""
    return shard(docs)
