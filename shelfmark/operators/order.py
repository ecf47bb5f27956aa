"""Numbers, running totals and ids over any number of rows: in blocks, never in one task.

A bounded sample of the order's first column gives cut points, so blocks are about even; the
result doesn't depend on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of the sample, and blocks at most.
SAMPLE, BLOCKS = 20_000, 256


def _blocked(rows: DataFrame, first: str) -> DataFrame:
    """Adds ``block``, which ascends with the column ``first``."""
    kind = dict(rows.dtypes)[first]
    sampled = [r[0] for r in rows.select(first).filter(F.col(first).isNotNull()).orderBy(F.xxhash64(first)).limit(SAMPLE).orderBy(first).collect()]
    cuts = sorted(set(sampled[:: max(1, len(sampled) // BLOCKS)]))
    if not cuts:
        return rows.withColumn("block", F.lit(0))
    at = F.array(*[F.lit(c).cast(kind) for c in cuts])
    return rows.withColumn("block", F.when(F.col(first).isNull(), -1).otherwise(F.size(F.filter(at, lambda c: c <= F.col(first)))))


def numbered(rows: DataFrame, order: list[str], name: str = "n", group: list[str] = ()) -> DataFrame:
    """Adds ``name``: 0, 1, ... in the given order, within each group."""
    return _running(rows, order, F.lit(1).cast("long"), name, list(group))


def running_total(rows: DataFrame, order: list[str], value: Column, name: str, group: list[str] = ()) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows before, nulls as 0."""
    return _running(rows, order, F.coalesce(value, F.lit(0)).cast("long"), name, list(group))


def _running(rows: DataFrame, order: list[str], value: Column, name: str, group: list[str]) -> DataFrame:
    columns = rows.columns
    blocked = _blocked(rows, order[0]).withColumn("of_row", value)
    before = W.partitionBy(*group).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sums = blocked.groupBy(*group, "block").agg(F.sum("of_row").alias("of_block"))
    sums = sums.withColumn("upto", F.coalesce(F.sum("of_block").over(before), F.lit(0))).select(*[F.col(g).alias(f"group_{g}") for g in group], F.col("block").alias("at"), "upto")
    inside = W.partitionBy(*group, "block").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    same = F.col("block") == F.col("at")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"group_{g}"))
    out = blocked.withColumn("within", F.coalesce(F.sum("of_row").over(inside), F.lit(0))).join(sums, same)
    return out.select(*columns, (F.col("within") + F.col("upto")).alias(name))


def next_id(rows: DataFrame) -> int:
    """One more than the greatest id, tombstones included: ids are never used again."""
    return (rows.agg(F.max("id")).first()[0] or 0) + 1


def every_kth(rows: DataFrame, order: list[str], k: int, group: list[str] = ()) -> DataFrame:
    return numbered(rows, order, "kth", group).filter(F.col("kth") % k == 0).drop("kth")


def by_index(rows: DataFrame) -> DataFrame:
    """In the order in which an index lists entries."""
    return rows.orderBy("id")


def by_offset(rows: DataFrame) -> DataFrame:
    """Stored contents in the order in which they lie, as a compaction copies them."""
    return rows.filter("len > 0").orderBy("off")


def first_few(rows: DataFrame, order: list, n: int) -> DataFrame:
    """The first n rows: each task keeps n, and only those meet."""
    return rows.orderBy(*order).limit(n)
