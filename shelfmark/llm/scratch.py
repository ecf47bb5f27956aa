"""Written tables that cut lineage, in the folder the cluster shares, and connected components."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, a temporary folder, but only if
    the driver runs all tasks itself; a cluster has to name a folder that it shares."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="shelfmark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Written tables by session that haven't been dropped; a result may still read them, so they go
#: at the end.
_LEFT: dict[str, SparkSession] = {}


@atexit.register
def _clean() -> None:
    for path, spark in list(_LEFT.items()):
        try:
            _delete(spark, path)
        except Exception:  # the session has ended; its folder goes with it
            return


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _LEFT.pop(path, None)


def write(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once as Parquet in the shared folder and returns a reader of it.

    Lost executors cost no recomputation of what was written; the rows stay fixed for
    every later step.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/shelfmark-{name}-{uuid.uuid4().hex}"
    _LEFT[path] = spark
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shelfmark_path = path
    return out


def write_counted(df: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """``write``, and the number of rows with a checksum of them, without another job."""
    seen = Observation()
    out = write(df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("sum")), name)
    return out, (seen.get["n"], seen.get["sum"])


def drop(*tables: DataFrame) -> None:
    """Deletes written tables that no later step reads."""
    for table in tables:
        _delete(table.sparkSession, table.shelfmark_path)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of finished, unreferenced jobs."""
    gc.collect()
    spark._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    ``edges`` has two long columns. Returns (node, component), the component being the
    smallest node reachable, for every node with an edge. Each step is two aggregations
    with map-side minima and two equi-joins; written tables cut the lineage between
    steps. Nothing but a count and a checksum reaches the driver.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct()
    table = write(e, "cc")
    seen = None
    while True:
        both = table.select("u", "v").union(table.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        star = (
            small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        step, now = write_counted(star, "cc")
        drop(table)
        table = step
        if now == seen:
            break
        seen = now
    roots = table.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return table.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
