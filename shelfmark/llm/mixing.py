"""Mixing sources to target weights: token blocks, multinomial draws, permuted indices.

The words of each source's documents form one stream, packed into blocks of ``block``
words (the last one may be shorter). A source's target words are whole passes over its blocks
and a rest; so it fills a known number of slots, the last of them in part. Output shards draw
multinomial source counts: each slot of a shard is an independent draw with the sources'
shares of all slots. The drawn slots of a source are numbered through its shards; what the
draws of all shards together left short of a source's slots goes to shards by hash, what they
drew beyond them stays empty. Slot k is position k of a pass, and goes through that pass's
pseudorandom permutation of the source's block indices (a keyed Feistel network with cycle
walking), so a pass visits each block once and no block is taken twice before all are taken
once. Slots join blocks by (source, index). All of it is DataFrame code; prefix sums run in two
levels, so no source is gathered in one task.

Defined cases: a null text has size 0; a null source is a source of its own, last; null or
repeated doc_ids are rows of their own; equal rows are interchangeable; a text of any length
spans as many blocks as it has; an empty table gives no rows; when all sizes are 0 targets and
taken words are 0. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import scratch
from .tables import read

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2
BLOCK = 64
#: Slots of an output shard at least, and output shards at most.
SHARD_SLOTS, MAX_SHARDS = 1024, 1 << 20
#: Rows summed by one task of the first level of a prefix sum, about.
BUCKET_ROWS = 1_000
#: Slots handled by a task, about.
TASK_SLOTS = 100_000
#: Rounds of the permutation, and steps of its cycle walk (each leaves the domain with a chance of 1 / sqrt(n)).
ROUNDS, WALK = 4, 32


def _unit(*parts) -> F.Column:
    """A pseudorandom number in [0, 1) from the parts."""
    return F.shiftrightunsigned(F.xxhash64(*[p if isinstance(p, F.Column) else F.lit(p) for p in parts]), 11).cast("double") / F.lit(float(1 << 53))


def permuted(x: F.Column, n: F.Column, *key) -> F.Column:
    """Where a keyed permutation of 0..n-1 maps x.

    Indices are written as l * b + r with a * b just above n; a round adds a hash of one part to
    the other. An index beyond n is mapped again until it falls below; fewer than a are beyond.
    """
    a = F.ceil(F.sqrt(n.cast("double")))
    b = F.ceil(n / a)

    def once(v):
        left, right = F.floor(v / b), F.pmod(v, b)
        for k in range(ROUNDS):
            if k % 2:
                right = F.pmod(right + F.pmod(F.xxhash64(*key, F.lit(k), left), b), b)
            else:
                left = F.pmod(left + F.pmod(F.xxhash64(*key, F.lit(k), right), a), a)
        return left * b + right

    first = once(x)
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, lambda v, _: F.when(v < n, v).otherwise(once(v)))
    return F.when(first < n, first).otherwise(walk)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size) to rank, weight and target by water-filling.

    A target is the lesser of cap times the size and level times the weight; the level is
    the one at which targets add up to ``share`` of all sizes. One row per source.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    fill = W.orderBy("full_at", "rank")
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(F.lit(0))
    filled = (
        ranked.withColumn("most", F.col("source_size") * F.lit(float(cap)))
        .withColumn("full_at", F.col("most") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
                    / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
        # the first source that isn't full fixes the level
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "rank", "level"))).over(everything)["level"])
    )
    return filled.withColumn("target", F.least("most", F.col("level") * F.col("weight"))).select("rank", "source", "source_size", "weight", "target")


def needed_slots(sources: DataFrame, block: int) -> DataFrame:
    """Adds each source's passes, n_blocks, n_full, slots and last_words (of its last slot).

    A whole pass takes all blocks; the rest of the target, ``round(target) mod size`` words,
    takes full blocks, then the short one, and of the last of them only what is missing.
    """
    words = F.round("target").cast("long")
    size = F.greatest("source_size", F.lit(1))
    whole = sources.withColumn("passes", F.floor(words / size)).withColumn("rest", F.pmod(words, size))
    whole = whole.withColumn("n_blocks", F.ceil(F.col("source_size") / block)).withColumn("n_full", F.floor(F.col("source_size") / block))
    whole = whole.withColumn("more", F.when(F.col("rest") <= F.col("n_full") * block, F.ceil(F.col("rest") / block)).otherwise(F.col("n_full") + 1))
    return whole.withColumn("slots", F.col("passes") * F.col("n_blocks") + F.col("more")).withColumn("last_words", F.when(F.col("more") > 0, F.col("rest") - (F.col("more") - 1) * block).otherwise(block)).drop("rest", "more")


def drawn_counts(sources: DataFrame, total: int, seed: int = 0) -> DataFrame:
    """(rank, shard, count): multinomial source counts of every output shard.

    Slot i is a draw of its own, a hashed number in [0, 1) looked up among the sources' shares
    of all slots: shares and numbers meet on cells of that interval, an equi-join.
    """
    spark = sources.sparkSession
    per_shard = max(SHARD_SLOTS, -(-total // MAX_SHARDS))
    cells = 4 * max(1, sources.count())
    upto = W.orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    share = sources.filter("slots > 0").select("rank", "slots", F.sum("slots").over(upto).alias("end"))
    share = share.select("rank", ((F.col("end") - F.col("slots")) / F.lit(float(max(1, total)))).alias("lower"), (F.col("end") / F.lit(float(max(1, total)))).alias("upper"))
    cell = lambda c: F.least(F.floor(F.col(c) * cells), F.lit(cells - 1))
    share = share.withColumn("cell", F.explode(F.sequence(cell("lower"), cell("upper"))))
    draws = spark.range(total).select(F.floor(F.col("id") / per_shard).alias("shard"), _unit("draw", seed, F.col("id")).alias("u")).withColumn("cell", cell("u"))
    # what rounding leaves beyond the last share belongs to nobody; settled as any shortfall
    return draws.join(share, "cell").filter("u >= lower and u < upper").groupBy("rank", "shard").agg(F.count("*").alias("count"))


def filled_slots(sources: DataFrame, block: int, seed: int = 0) -> DataFrame:
    """(rank, shard, k, index, words): the block of every slot of the mix and the words it takes
    of it, from the block's beginning. ``sources`` is a written table from ``needed_slots``."""
    total = sources.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    counts = scratch.write(drawn_counts(sources, total, seed), "mix-drawn")
    before = W.partitionBy("rank").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    drawn = counts.withColumn("from", F.coalesce(F.sum("count").over(before), F.lit(0)))
    short = sources.join(counts.groupBy("rank").agg(F.sum("count").alias("n")), "rank", "left").withColumn("from", F.coalesce("n", F.lit(0)))
    short = short.filter("slots > from").select("rank", F.lit(None).cast("long").alias("shard"), (F.col("slots") - F.col("from")).alias("count"), "from")
    runs = drawn.select("rank", "shard", "count", "from").unionByName(short)
    runs = runs.join(sources.select("rank", "slots", "passes", "n_blocks", "n_full", "last_words"), "rank").filter(F.col("from") < F.col("slots"))
    runs = runs.repartition(max(1, total // TASK_SLOTS), "rank", "shard")
    shards = max(1, -(-total // max(SHARD_SLOTS, -(-total // MAX_SHARDS))))
    slots = runs.withColumn("k", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + F.col("count"), F.col("slots")) - 1)))
    slots = slots.withColumn("pass", F.least(F.floor(F.col("k") / F.col("n_blocks")), "passes")).withColumn("at", F.col("k") - F.col("pass") * F.col("n_blocks"))
    slots = slots.withColumn("among", F.when(F.col("pass") < F.col("passes"), F.col("n_blocks")).otherwise(F.greatest("n_full", F.lit(1))))
    index = F.when(F.col("at") < F.col("among"), permuted(F.col("at"), F.col("among"), F.lit("block"), F.lit(seed), F.col("rank"), F.col("pass"))).otherwise(F.col("n_blocks") - 1)
    words = F.when(F.col("k") == F.col("slots") - 1, F.col("last_words")).otherwise(F.lit(block))
    return slots.select("rank", F.coalesce("shard", F.pmod(F.xxhash64(F.lit("short"), "rank", "k"), F.lit(shards))).alias("shard"), "k", index.alias("index"), words.alias("words"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """Rows of ``docs`` with size, source_size, target and the words taken of each."""
    base = scratch.write(
        docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("text_hash"))
        .withColumn("row", F.monotonically_increasing_id()), "mix-base")
    sources = source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    sources = scratch.write(needed_slots(sources, block), "mix-sources")
    buckets = max(1, base.count() // BUCKET_ROWS)

    ranked = base.join(sources.select("rank", F.col("source").alias("own_source"), "source_size", "target"), base.source.eqNullSafe(F.col("own_source"))).drop("own_source")
    ranked = ranked.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(buckets)))
    upto = W.partitionBy("rank").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = ranked.groupBy("rank", "bucket").agg(F.sum("size").alias("n")).select("rank", "bucket", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("offset"))
    inside = W.partitionBy("rank", "bucket").orderBy("doc_id", "text_hash", "size", "row").rowsBetween(W.unboundedPreceding, -1)
    placed = ranked.withColumn("begin", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, ["rank", "bucket"]).withColumn("begin", F.col("begin") + F.col("offset"))

    used = filled_slots(sources, block, seed).groupBy("rank", "index").agg(F.count_if(F.col("words") >= block).alias("times"), F.max(F.when(F.col("words") < block, F.col("words"))).alias("part"))
    parts = placed.filter("size > 0").select("rank", "row", "begin", (F.col("begin") + F.col("size")).alias("end"))
    parts = parts.withColumn("index", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("end") - 1) / block))))
    first = F.greatest("begin", F.col("index") * block)
    within = lambda words: F.greatest(F.least("end", F.col("index") * block + words) - first, F.lit(0))
    taken = parts.join(used.hint("merge"), ["rank", "index"]).groupBy("row").agg(F.sum(within(F.lit(block)) * F.col("times") + within(F.coalesce("part", F.lit(0)))).alias("taken"))
    return ranked.join(taken.hint("merge"), "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def op10_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents", "doc_id", "source", "text"))


def mix_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its taken words are its size: the whole times, and once
    more with the probability of the rest, by a hash of doc_id.

    Rows of one doc_id (null is one too) share its words and are taken equally often; a
    document without words stays once; extra columns stay; an empty table stays empty.
    """
    plan = mix(docs).groupBy("doc_id").agg(F.sum("size").alias("mix_size"), F.sum("taken").alias("mix_taken"))
    times = F.floor(F.col("mix_taken") / F.greatest("mix_size", F.lit(1)) + _unit("copy", F.col("mix_id")))
    plan = plan.select(F.col("doc_id").alias("mix_id"), "mix_size", "mix_taken").withColumn("mix_times", F.when(F.col("mix_size") > 0, times).otherwise(F.lit(1)).cast("int"))
    plan = plan.filter("mix_times > 0").select("mix_id", "mix_times")
    both = docs.join(plan, docs.doc_id.eqNullSafe(F.col("mix_id")))
    return both.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_times")))).select(*[docs[c] for c in docs.columns])
