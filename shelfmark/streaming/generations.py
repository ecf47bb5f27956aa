"""Change rows as a stream: each micro-batch is merged as one generation.

A batch's number stands in its manifest, so one that is tried again after its commit changes
nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.catalog import live, merge_plan
from ..operators.order import next_id, numbered
from ..plans.store import Store


def first_rows(rows: DataFrame) -> DataFrame:
    """One row a path: of the least ``seq``, or else id."""
    order = "seq" if "seq" in rows.columns else "id"
    return rows.groupBy("path").agg(F.min_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def append(store: Store, rows: DataFrame, update: str | None = None, batch: int | None = None, query: str = "", new_ids: bool = False) -> int:
    """Adds rows as the next generation; nothing is committed if nothing changes.

    ``new_ids``: ids come from the catalog's greatest, in order of path, in place of the rows'.
    """
    last = store.latest()
    batches = store.manifest(last).get("batches", {}) if last else {}
    if batch is not None and batches.get(query, -1) >= batch:
        return last
    facts = {"batches": batches | {query: batch}} if batch is not None else {"batches": batches}
    rows = first_rows(rows)
    if not last:
        return store.commit(_named(rows, 1) if new_ids else rows, 0, **facts)
    old = store.read(last)
    plan = merge_plan(rows, old, update=update)
    new = plan.filter(F.col("action").isin("add", "replace"))
    if new.isEmpty():
        return last
    gone = new.filter("action = 'replace'").select(F.col("old_id").alias("id"))
    new = new.select(*rows.columns).withColumn("gen", F.lit(last + 1).cast(dict(old.dtypes)["gen"]))
    if new_ids:
        new = _named(new, next_id(old))
    return store.commit_changes(new.select(*old.columns), gone, last, **facts)


def _named(rows: DataFrame, first: int) -> DataFrame:
    return numbered(rows, ["path"], "number").withColumn("id", F.col("number") + first).drop("number")


def start(stream: DataFrame, store: Store, checkpoint: str, update: str | None = None, name: str = "stream"):
    return stream.writeStream.foreachBatch(lambda rows, batch: append(store, rows, update, batch, name)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
