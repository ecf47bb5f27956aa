"""Content with holes: data segments, gaps, expansion and comparison."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import SEGMENT

BLOCK = 4096


def zeros(n: Column) -> Column:
    return F.repeat(F.lit("\0"), n.cast("int")).cast("binary")


def all_zero(content: Column) -> Column:
    """Whether every byte is 0; so for empty content."""
    return content == zeros(F.octet_length(content))


def data_segments(block: int = BLOCK):
    """A function of binary columns: where data stands, in whole blocks, holes left out."""

    @F.pandas_udf(f"array<{SEGMENT.simpleString()}>")
    def run(content: pd.Series) -> pd.Series:
        def one(b):
            if b is None:
                return None
            padded = np.frombuffer(bytes(b) + bytes(-len(b) % block), np.uint8).reshape(-1, block)
            full = np.concatenate([[False], padded.any(axis=1), [False]])
            edge = np.flatnonzero(full[1:] != full[:-1])
            return [{"off": int(a) * block, "len": min(int(e) * block, len(b)) - int(a) * block} for a, e in zip(edge[::2], edge[1::2])]

        return content.map(one)

    return run


def gaps(start: Column, end: Column, segments: Column) -> Column:
    """The parts of [start, end) that ordered segments leave out; an empty segment divides the gap
    that it lies in."""
    empty = F.array().cast(f"array<{SEGMENT.simpleString()}>")
    part = lambda a, b: F.struct(a.cast("long").alias("off"), (b - a).cast("long").alias("len"))

    def step(state, s):
        stop = s["off"] + s["len"]
        hit = (stop > state["at"]) & (s["off"] < end)
        found = F.when(hit & (s["off"] > state["at"]), F.concat(state["out"], F.array(part(state["at"], s["off"])))).otherwise(state["out"])
        return F.struct(F.when(hit, stop).otherwise(state["at"]).cast("long").alias("at"), found.alias("out"))

    begin = F.struct(start.cast("long").alias("at"), empty.alias("out"))
    rest = lambda s: F.when(s["at"] < end, F.concat(s["out"], F.array(part(s["at"], end)))).otherwise(s["out"])
    return F.aggregate(segments, begin, step, rest)


def payload(content: Column, segments: Column) -> Column:
    """The bytes of the segments, one after the other."""
    return F.aggregate(segments, F.lit(b"").cast("binary"), lambda out, s: F.concat(out, F.substring(content, (s["off"] + 1).cast("int"), s["len"].cast("int"))))


def expand(data: Column, segments: Column, size: Column) -> Column:
    """Content of ``size`` bytes from a payload: segments at their places, zeros elsewhere."""
    begin = F.struct(F.lit(b"").cast("binary").alias("out"), F.lit(0).cast("long").alias("used"))

    def step(s, x):
        hole = zeros(x["off"] - F.octet_length(s["out"]))
        own = F.substring(data, (s["used"] + 1).cast("int"), x["len"].cast("int"))
        return F.struct(F.concat(s["out"], hole, own).alias("out"), (s["used"] + x["len"]).cast("long").alias("used"))

    return F.aggregate(segments, begin, step, lambda s: F.concat(s["out"], zeros(size - F.octet_length(s["out"]))))


def same_content(size: Column, segments: Column, digest: Column, content: Column) -> Column:
    """Whether a file holds an entry's content: read as the entry was stored, so another layout
    of the same bytes is the same. The digest covers the segments; the rest must be zero."""
    own = payload(content, segments)
    holed = F.size(segments) > 0
    equal = F.when(holed, (F.sha2(own, 256) == digest) & (content == expand(own, segments, size))).otherwise(F.sha2(content, 256) == digest)
    return F.when(F.octet_length(content) != size, False).otherwise(equal)
