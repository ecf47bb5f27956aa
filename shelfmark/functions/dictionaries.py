"""Compression dictionaries: samples, training, the choice of a size, reuse and checks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Corrupt
from ..operators.catalog import best_trial
from ..operators.order import numbered
from . import codecs as C

#: Fixed values of the measurement: bytes of a file that are sampled, samples for each byte of a
#: dictionary, the same in a trial, files of which one is held out, bytes of held-out files.
SAMPLE, FACTOR, TRIAL_FACTOR, HELD_OUT, BUDGET = 32 << 10, 100, 20, 4, 1 << 20
LEAST, MOST = C.LEAST_TRAINED, C.MAX_TRAINED
MAGIC = b"\x37\xa4\x30\xec"


def trial_sizes(total: int) -> list[int]:
    """Candidate sizes for ``total`` bytes of samples: doubling, up to half of them."""
    out, size = [], LEAST
    while size <= MOST and 2 * size <= total:
        out.append(size)
        size *= 2
    return out


def sampled(content: DataFrame, budget: int) -> tuple[DataFrame, int]:
    """(path, n, sample) of every k-th entry by path, with the least k that keeps the samples
    within ``budget`` bytes, and the bytes of all samples there are. content: path, bytes."""
    heads = content.filter(F.octet_length("bytes") > 0).select("path", F.least(F.octet_length("bytes"), F.lit(SAMPLE)).cast("long").alias("size"))
    total = heads.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    k = max(1, -(-total // budget))
    chosen = numbered(heads, ["path"]).filter(F.col("n") % k == 0).select("path", (F.col("n") / k).cast("long").alias("n"))
    return content.join(chosen, "path").select("path", "n", F.substring(F.col("bytes").cast("binary"), 1, SAMPLE).alias("sample")), total


def _within(samples: Iterable[bytes], budget: int) -> list[bytes]:
    """Every k-th sample, with the least k that keeps them within the budget."""
    samples = list(samples)
    k = max(1, -(-sum(map(len, samples)) // budget))
    return samples[::k]


def train(samples: list[bytes], size: int, number: int, level: int = 12) -> bytes:
    """A dictionary of at most ``size`` bytes; smaller ones are tried where the trainer fails or
    overshoots."""
    wanted = size
    while wanted >= 256:
        try:
            found = zstandard.train_dictionary(wanted, samples, dict_id=number, level=level).as_bytes()
        except zstandard.ZstdError:
            found = b""
        if 0 < len(found) <= size:
            return found
        wanted //= 2
    raise Corrupt("no dictionary can be trained from these samples")


def choose_size(spark: SparkSession, samples: list[bytes], total: int, level: int = 12) -> int:
    """The size with the best net gain on held-out samples, 0 if none gains. Candidates are
    measured in tasks; the samples are at most TRIAL_FACTOR times MOST bytes."""
    held = _within([s for i, s in enumerate(samples) if i % HELD_OUT == HELD_OUT - 1], BUDGET)
    training = [s for i, s in enumerate(samples) if i % HELD_OUT != HELD_OUT - 1]
    sizes = trial_sizes(total)
    if not held or not sizes:
        return 0
    shared = spark.sparkContext.broadcast((held, training))

    def compressed(dictionary: bytes | None) -> int:
        return sum(len(C.encode(s, "zstd", level, dictionary)) for s in shared.value[0])

    def measure(batches):
        for rows in batches:
            out = []
            for size in rows["size"]:
                try:
                    own = train(_within(shared.value[1], TRIAL_FACTOR * int(size)), int(size), 1 << 15, level)
                    out.append((int(size), len(own), compressed(own), True))
                except Corrupt:
                    out.append((int(size), 0, 0, False))
            yield pd.DataFrame(out, columns=["candidate", "size", "n", "ok"])

    base = sum(len(C.encode(s, "zstd", level)) for s in held)
    trials = spark.createDataFrame([(s,) for s in sizes], "size long").repartition(len(sizes), "size").mapInPandas(measure, "candidate long, size long, n long, ok boolean")
    best = best_trial(trials, base, total, sum(map(len, held))).first()
    return best["candidate"] or 0


def trained(spark: SparkSession, content: DataFrame, number: int, train_param: int, level: int = 12) -> bytes | None:
    """A dictionary for the content (path, bytes), of a given size or, for 1, a measured one;
    None where none pays."""
    budget = FACTOR * train_param if train_param > 1 else TRIAL_FACTOR * MOST + BUDGET
    rows, total = sampled(content, budget)
    samples = [bytes(r["sample"]) for r in rows.orderBy("n").toLocalIterator()]  # budget bytes at most, and one sample
    size = train_param if train_param > 1 else choose_size(spark, samples, total, level)
    if not size or not samples:
        return None
    try:
        return train(_within(samples, FACTOR * size), size, number, level)
    except Corrupt:
        return None


def checked(content: bytes, number: int, size: int, digest: str) -> bytes:
    """The dictionary if its size, digest, magic and the id that it carries are right."""
    if len(content) != size or hashlib.sha256(content).hexdigest() != digest:
        raise Corrupt(f"dictionary {number}: size or digest differs")
    if content[:4] != MAGIC or int.from_bytes(content[4:8], "little") != number:
        raise Corrupt(f"dictionary {number}: not a dictionary of that id")
    return content


def newest(dicts: DataFrame) -> DataFrame:
    """The dictionary that an append uses again: that of the latest generation, then id."""
    return dicts.agg(F.max_by(F.struct("*"), F.struct("gen", "id")).alias("d")).filter("d is not null").select("d.*")


def used(rows: DataFrame, codecs: DataFrame, dicts: DataFrame) -> DataFrame:
    """Dictionaries that a codec of any of the rows names."""
    own = codecs.join(rows.select(F.col("codec").alias("pos")).distinct(), "pos", "left_semi")
    return dicts.join(own.filter("dict is not null").select(F.col("dict").alias("id")).distinct(), "id", "left_semi")


def usage(rows: DataFrame, codecs: DataFrame, dicts: DataFrame) -> DataFrame:
    """Live entries by dictionary, over all codecs that name it; unused ones count 0."""
    per_codec = rows.filter(~F.col("dead")).groupBy(F.col("codec").alias("pos")).agg(F.count("*").alias("entries"))
    per_dict = codecs.filter("dict is not null").join(per_codec, "pos").groupBy(F.col("dict").alias("id")).agg(F.sum("entries").alias("entries"))
    return dicts.join(per_dict, "id", "left").withColumn("entries", F.coalesce("entries", F.lit(0)))
