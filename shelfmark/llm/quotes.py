"""Chat formatting by quotation linking.

Lines that begin with ``>`` are quotes; the number of leading ``>`` (blanks between them
allowed) is their level. Consecutive lines of a level form a passage. Passages are
normalised (lower case, letters and digits only, blanks collapsed) and hashed, as is every
own line and the whole own text of each message. A passage of any level joins, on
conversation and hash, the latest earlier turn that said it (its own words, not its
quotes); the parent is the turn that the shallowest linked level found, and quoted_turns
has what each linked level found. Without such a quote the parent is the turn before. Quotes are
cut out, and messages are numbered by the reply tree: each after its parent, replies to one
turn in their order, each with all that follows it.

Numbering runs in two levels (blocks of TURNS turns) on rows without texts, so a conversation of
any length is split over tasks. Messages that follow their parent at once form a run, which the tree's
order keeps whole; only the runs' first messages, one narrow row for each quote, and the
blocks are ordered in one task a conversation; passages nobody quotes are dropped before the join.

Defined cases: null texts are empty; texts of any length are parsed whole; null conv_id is one
conversation of its own; null turns come first and are one turn, shown as null where it is
quoted; every message has its own links, whatever others share its turn; of messages with equal
turn, those that reply to an earlier turn come last, then role and a hash of the text decide; repeated rows
stay; quotes of nothing known link to nothing; an empty table gives no rows; extra columns ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import scratch
from .tables import read
from .words import slices

TURNS = 1000
MARK = re.compile(r"^[ \t]*((?:>[ \t]*)+)")


def parse(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """Own text without quotes, and (level, passage) in order."""
    own, passages = [], []
    for line in (text or "").split("\n"):
        m = MARK.match(line)
        level, rest = (m.group(1).count(">"), line[m.end() :]) if m else (0, line)
        if not level:
            own.append(line)
            passages.append((0, ""))
        elif passages and passages[-1][0] == level:
            passages[-1] = (level, passages[-1][1] + "\n" + rest)
        else:
            passages.append((level, rest))
    return "\n".join(own).strip(), [(k, p) for k, p in passages if k]


def normal(passage: str) -> str:
    return " ".join(re.findall(r"\w+", passage.lower()))


def _hash(passage: str) -> str | None:
    text = normal(passage)
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest() if text else None


PARSED = "conv_id long, turn long, role string, own string, n_quotes int, quoted array<struct<level:int,hash:string>>, said array<string>"


def _parse(batches):
    for batch in slices(batches):
        own, n, quoted, said = [], [], [], []
        for text in batch.column("text").to_pylist():
            mine, passages = parse(text)
            own.append(mine)
            n.append(len(passages))
            hashes = {(k, h) for k, p in passages for q in (p, *p.split("\n")) if (h := _hash(q))}
            quoted.append([{"level": k, "hash": h} for k, h in sorted(hashes)])
            said.append(sorted({h for q in (mine, *mine.split("\n")) if (h := _hash(q))}))
        strings, levels = pa.list_(pa.string()), pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.string())]))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id").cast(pa.int64()), batch.column("turn").cast(pa.int64()), batch.column("role").cast(pa.string()), pa.array(own, pa.string()), pa.array(n, pa.int32()), pa.array(quoted, levels), pa.array(said, strings)], ["conv_id", "turn", "role", "own", "n_quotes", "quoted", "said"])


#: Stands for a null turn, before all others.
FIRST = -(1 << 62)


def _order(rows: pd.DataFrame) -> pd.DataFrame:
    """What to add to the turn order's positions in one conversation: from the first message of
    each run on, and at the beginning of each block."""
    runs = rows[rows["start"].notna()].sort_values("start")
    blocks = rows[rows["start"].isna()]
    start = np.concatenate([[0], runs["start"].to_numpy(np.int64)])
    anchor = np.concatenate([[-1], runs["anchor"].to_numpy(np.int64)])
    length = np.diff(np.append(start, blocks["n"].sum()))
    replies: dict[int, list[int]] = {}
    for k, up in enumerate(np.searchsorted(start, anchor[1:], "right") - 1, 1):
        replies.setdefault(up, []).append(k)
    shift = np.zeros(len(start), np.int64)
    todo, at = [0], 0
    while todo:
        k = todo.pop()
        shift[k] = at - start[k]
        at += length[k]
        # the last message's replies come first; of one message, the first ones
        todo += sorted(replies.get(k, ()), key=lambda x: (anchor[x], -start[x]))
    first = shift[np.searchsorted(start, blocks["offset"].to_numpy(np.int64), "right") - 1]
    return pd.DataFrame({"conv": rows["conv"].iloc[0], "msg": pd.concat([runs["msg"], pd.Series([None] * len(blocks))]).astype("Int64").to_numpy(), "block": pd.concat([pd.Series([None] * len(runs)), blocks["block"]]).astype("Int64").to_numpy(), "shift": np.concatenate([shift[1:], first])})


def _by_replies(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """``rows`` with positions by turn changed into positions by the reply tree."""
    breaks = rows.filter("breaks").select("conv", "msg", F.col("position").alias("start"), "quoted_at")
    anchors = rows.select("conv", F.col("at").alias("quoted_at"), "position").join(breaks.select("conv", "quoted_at").distinct(), ["conv", "quoted_at"], "left_semi")
    breaks = breaks.join(anchors.groupBy("conv", "quoted_at").agg(F.max("position").alias("anchor")), ["conv", "quoted_at"])
    blocks = blocks.join(breaks.select("conv").distinct(), "conv", "left_semi")
    parts = breaks.select("conv", "msg", "start", "anchor").unionByName(blocks.select("conv", "block", "offset", "n"), allowMissingColumns=True)
    shifts = scratch.write(parts.groupBy("conv").applyInPandas(_order, "conv long, msg long, block long, shift long"), "shifts")
    rows = rows.join(shifts.filter("msg is not null").select("msg", "shift"), "msg", "left")
    rows = rows.join(shifts.filter("block is not null").select("conv", "block", F.col("shift").alias("before")), ["conv", "block"], "left")
    inside = W.partitionBy("conv", "block").orderBy("position").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("position", F.col("position") + F.coalesce(F.last("shift", ignorenulls=True).over(inside), "before", F.lit(0)))


def conversations(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, position, parent_turn, quoted_turn, quoted_turns, n_quotes and text."""
    parsed = messages.select("conv_id", "turn", "role", "text").mapInArrow(_parse, PARSED).withColumn("block", F.floor(F.coalesce("turn", F.lit(-1)) / TURNS))
    parsed = parsed.withColumn("conv", F.coalesce(F.col("conv_id"), F.lit(FIRST))).withColumn("at", F.coalesce("turn", F.lit(FIRST))).withColumn("msg", F.monotonically_increasing_id())
    parsed = scratch.write(parsed, "parsed")  # which fixes the numbers of the messages
    quotes = parsed.filter("n_quotes > 0").select("conv", "msg", "at", F.explode("quoted").alias("q")).select("conv", "msg", "at", "q.level", "q.hash").distinct()
    keys = quotes.select("conv", "hash").distinct()
    said = parsed.select("conv", "at", F.explode("said").alias("hash")).join(keys, ["conv", "hash"], "left_semi").distinct()
    # the latest earlier saying of each quoted hash, in one ordered pass per key
    both = said.withColumn("said_at", F.col("at")).unionByName(quotes, allowMissingColumns=True)
    before = W.partitionBy("conv", "hash").orderBy("at").rangeBetween(W.unboundedPreceding, -1)
    linked = both.withColumn("source", F.max("said_at").over(before)).filter("said_at is null and source is not null")
    linked = linked.groupBy("msg", "level").agg(F.max("source").alias("source"))
    shown = lambda c: F.when(F.col(c) != FIRST, F.col(c))
    linked = linked.groupBy("msg").agg(F.min_by("source", "level").alias("quoted_at"), F.sort_array(F.collect_list(F.struct("level", shown("source").alias("turn")))).alias("quoted_turns"))
    linked = scratch.write(linked, "linked")

    blocks = parsed.groupBy("conv", "block").agg(F.count("*").alias("n"), F.max("at").alias("last"))
    upto = W.partitionBy("conv").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select("conv", "block", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("offset"), "n", F.max("last").over(upto).alias("last_before"))
    earlier = W.partitionBy("conv", "block").orderBy("at").rangeBetween(W.unboundedPreceding, -1)
    # texts stay behind: order and links are found on narrow rows
    rows = parsed.select("msg", "conv", "block", "at", "role", F.xxhash64("own").alias("own")).withColumn("previous", F.max("at").over(earlier)).join(blocks.drop("n"), ["conv", "block"]).join(linked, "msg", "left")
    rows = rows.withColumn("ordinary", F.coalesce("previous", "last_before"))
    rows = rows.withColumn("breaks", F.coalesce(F.col("quoted_at") != F.col("ordinary"), F.lit(False)))
    inside = W.partitionBy("conv", "block").orderBy("at", "breaks", "role", "own", "msg")
    rows = rows.withColumn("position", F.row_number().over(inside) - 1 + F.col("offset")).drop("previous", "last_before", "offset")
    if not linked.isEmpty():
        rows = _by_replies(scratch.write(rows, "by-turn"), blocks)
    parent = F.coalesce("quoted_at", "ordinary")
    found = rows.select("msg", "position", F.when(parent != FIRST, parent).alias("parent_turn"), shown("quoted_at").alias("quoted_turn"), "quoted_turns")
    return parsed.join(found, "msg").select("conv_id", "turn", "role", "position", "parent_turn", "quoted_turn", "quoted_turns", "n_quotes", F.col("own").alias("text"))


def op9_quoted_conversations(spark, sf_dir: str) -> DataFrame:
    return conversations(read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
