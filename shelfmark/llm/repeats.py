"""Substring dedup by fixed-block anchors.

A window of WINDOW words contains at least one whole reference block: the blocks are the
non-overlapping BLOCK-word pieces of every document, and 2 * BLOCK - 1 <= WINDOW. So a
repeated window holds a block that also starts elsewhere. Pass 1 hashes every rolling
BLOCK-word window of a batch of texts and sends what is distinct in the batch, packed in
binary, to the partition of its hash; there the windows probe the indexed blocks. What
occurs twice within its batch needs no probe and sends one entry, so a passage that stands
in a third of all documents costs each partition one entry a batch. Answers are positions;
they are hits, a superset of the truth (32-bit hashes within a partition).

Pass 2 reads the texts with hits only and extends the hits: each WINDOW-word window whose
whole blocks all are hits is hashed in 80 bits and counted over the corpus the same way.
Windows with two or more starts are repeats; overlapping ones extend to maximal repeated
passages (``passages``), and the words they cover go. The number of partitions follows the
corpus, so none grows with it.

Defined cases: a null, empty or blank text has no words; texts with fewer than WINDOW words
have no windows and stay whole; longer ones are read whole, whatever their length; repeated rows repeat each other's windows, whatever their
doc_id; null doc_ids are rows like others; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .tables import read
from .words import Words, mix, rolling, slices

_U = np.uint64
WINDOW, BLOCK = 35, 18
#: Text bytes whose windows are made distinct together before the shuffle.
BATCH = 8 << 20
#: Text bytes for each partition of hashes.
PART = 128 << 20

FIRST = "part int, batch string, pack binary, rows binary, begins binary"


def _packs(batch_id: str, part: np.ndarray, parts: int, hashes: list[np.ndarray], at: np.ndarray, flags: np.ndarray):
    """One row for each partition: hash columns, positions and flags, byte plane by byte plane."""
    order = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(parts + 1))
    for p in range(parts):
        pick = order[ends[p] : ends[p + 1]]
        if len(pick):
            gap = np.diff(at[pick], prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T
            yield p, batch_id, b"".join([*[np.ascontiguousarray(h[pick]).tobytes() for h in hashes], gap.tobytes(), flags[pick].tobytes()])


def _unpack(pack: bytes, kinds: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    widths = [np.dtype(k).itemsize for k in kinds]
    n = len(pack) // (sum(widths) + 5)
    at, out = 0, []
    for kind, width in zip(kinds, widths):
        out.append(np.frombuffer(pack, kind, n, at))
        at += n * width
    gap = np.ascontiguousarray(np.frombuffer(pack, np.uint8, 4 * n, at).reshape(4, n).T).view("<u4").reshape(-1)
    return out, np.cumsum(gap.astype(np.int64)), np.frombuffer(pack, np.uint8, n, at + 4 * n)


def _ends(first: np.ndarray, k: int) -> np.ndarray:
    """Whether a k-word window may start at each word: it ends in the same text."""
    ok = np.zeros(first[-1], bool)
    for a, b in zip(first[:-1], first[1:]):
        ok[a : max(a, b - k + 1)] = True
    return ok


def _distinct(h: np.ndarray, at: np.ndarray, *marks: np.ndarray):
    """First position of each distinct hash, whether it has several, and any() of marks; and
    all positions of those that have several."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(s)))
    several = count > 1
    any_ = [np.logical_or.reduceat(m[order], start) if len(s) else new for m in marks]
    first = order[start]
    back = np.argsort(first)  # by position, for small gaps
    return first[back], several[back], [m[back] for m in any_], at[order[np.repeat(several, count)]]


def first_pass(parts: int, window: int, block: int):
    def run(batches):
        for batch in slices(batches, BATCH):
            words = Words(batch.column("text"))
            if not len(words.hashes):
                continue
            own, head = _head(batch, words.first, parts)
            yield head
            ok = _ends(words.first, block) & np.repeat(np.diff(words.first) >= window, np.diff(words.first))
            at = np.flatnonzero(ok)
            if not len(at):
                continue
            h = rolling(words.hashes, block)[at]
            place = at - np.repeat(words.first[:-1], np.diff(words.first))[at]
            first, several, (aligned,), local = _distinct(h, at, place % block == 0)
            h = h[first]
            if len(local):
                yield _rows(own, part=[-1 - len(local) % parts], pack=[np.sort(local).astype(np.int64).tobytes()])
            flags = (aligned * 1 + several * 2).astype(np.uint8)
            to = (h >> _U(33)) % _U(parts)
            for p, _, pack in _packs(own, to.astype(np.int64), parts, [h.astype(np.uint32)], at[first], flags):
                yield _rows(own, part=[p], pack=[pack])

    return run


def _rows(batch: str, part, pack, rows=None, begins=None) -> pa.RecordBatch:
    none = [None] * len(part)
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([batch] * len(part)), pa.array(pack, pa.binary()), pa.array(rows or none, pa.binary()), pa.array(begins or none, pa.binary())], ["part", "batch", "pack", "rows", "begins"])


def _head(batch: pa.RecordBatch, first: np.ndarray, parts: int) -> tuple[str, pa.RecordBatch]:
    """A batch's name, which a retried task gives again, and the row with its directory."""
    rows = np.asarray(batch.column("row"), np.int64).tobytes()
    name = hashlib.sha1(rows).hexdigest()
    return name, _rows(name, part=[-1 - int(name[:8], 16) % parts], pack=[None], rows=[rows], begins=[first.astype(np.int64).tobytes()])


ANSWERS = "batch string, at binary, rows binary, begins binary"


def _answer(kinds: list[str], anchored: bool):
    """Of one partition's packs: positions of hashes that start at least twice, one of them
    being an indexed block if ``anchored``. What its batch has twice is answered there;
    negative partitions pass directories and such answers on."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        if rows["part"].iloc[0] < 0:
            return rows.rename(columns={"pack": "at"})[["batch", "at", "rows", "begins"]]
        packs = [_unpack(p, kinds) for p in rows["pack"]]
        sizes = [len(p[1]) for p in packs]
        columns = [np.concatenate(c) for c in zip(*[p[0] for p in packs])]
        at, flags = np.concatenate([p[1] for p in packs]), np.concatenate([p[2] for p in packs])
        order = np.lexsort(columns) if len(columns) > 1 else np.argsort(columns[0], kind="stable")
        same = np.logical_and.reduce([c[order][1:] == c[order][:-1] for c in columns])
        start = np.flatnonzero(np.concatenate([[True], ~same]))
        count = np.diff(np.append(start, len(order)))
        hit = count > 1
        if anchored:
            hit &= np.logical_or.reduceat((flags & 1)[order] > 0, start)
        answer = np.zeros(len(order), bool)
        answer[order] = np.repeat(hit, count)
        answer &= (flags & 2) == 0
        out, k = [], 0
        for batch, n in zip(rows["batch"], sizes):
            own = at[k : k + n][answer[k : k + n]]
            k += n
            if len(own):
                out.append((batch, own.astype(np.int64).tobytes(), None, None))
        return pd.DataFrame(out, columns=["batch", "at", "rows", "begins"])

    return run


def _by_row(parts: pd.DataFrame) -> pd.DataFrame:
    """Answers of one batch as positions within its rows."""
    head = parts[parts["rows"].notna()].iloc[0]
    rows, begins = np.frombuffer(head["rows"], np.int64), np.frombuffer(head["begins"], np.int64)
    found = [np.frombuffer(x, np.int64) for x in parts["at"] if x is not None and len(x)]
    at = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    owner = np.searchsorted(begins, at, "right") - 1
    out = []
    cut = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1], [True]])) if len(at) else []
    for a, b in zip(cut, cut[1:]):
        out.append((rows[owner[a]], (at[a:b] - begins[owner[a]]).astype("<i4").tobytes()))
    return pd.DataFrame(out, columns=["row", "starts"])


def _probe(made: DataFrame, kinds: list[str], anchored: bool) -> DataFrame:
    """(row, starts) from packs: answers of all partitions, back at their rows."""
    answers = made.groupBy("part").applyInPandas(_answer(kinds, anchored), ANSWERS)
    return answers.groupBy("batch").applyInPandas(_by_row, "row long, starts binary")


def second_pass(parts: int, window: int, block: int):
    """Packs of the windows whose whole blocks are all hits."""

    def run(batches):
        for batch in slices(batches, BATCH):
            words = Words(batch.column("text"))
            first = words.first
            hit = np.zeros(len(words.hashes) + 1, np.int64)
            for i, starts in enumerate(batch.column("starts").to_pylist()):
                if starts:
                    hit[first[i] + np.frombuffer(starts, "<i4")] = 1
            length = np.diff(first)
            place = np.arange(len(words.hashes)) - np.repeat(first[:-1], length)
            ok = _ends(first, window)
            at = np.flatnonzero(ok)
            if len(at):
                lead = -place[at] % block  # to the first whole block, and the next one
                keep = hit[at + lead] > 0
                second = lead + 2 * block <= window
                keep &= ~second | (hit[np.minimum(at + lead + block, len(hit) - 1)] > 0)
                at = at[keep]
            if not len(at):
                continue
            own, head = _head(batch, first, parts)
            yield head
            h, more = rolling(words.hashes, window)[at], rolling(words.hashes, window, 11)[at].astype(np.uint16)
            firsts, several, _, local = _distinct(h, at)
            if len(local):
                yield _rows(own, part=[-1 - len(local) % parts], pack=[np.sort(local).astype(np.int64).tobytes()])
            to = (mix(h) >> _U(20)) % _U(parts)
            for p, _, pack in _packs(own, to[firsts].astype(np.int64), parts, [h[firsts], more[firsts]], at[firsts], several.astype(np.uint8) * 2):
                yield _rows(own, part=[p], pack=[pack])

    return run


DIGEST = "row long, doc_id long, n_words long, n_removed long, kept_sha256 string"


def _digests(window: int):
    """Words, removed words and the hash of what is kept, of each text."""

    def run(batches):
        for batch in slices(batches):
            words = Words(batch.column("text"), spans=True)
            data = words.data.tobytes()
            starts = batch.column("starts").to_pylist() if "starts" in batch.schema.names else [None] * batch.num_rows
            n, gone, sha = [], [], []
            for i in range(batch.num_rows):
                a, b = words.first[i], words.first[i + 1]
                begin, end = words.begin[a:b], words.end[a:b]
                if starts[i]:
                    cover = np.zeros(b - a + 1, np.int64)
                    own = np.frombuffer(starts[i], "<i4")
                    np.add.at(cover, own, 1)
                    np.add.at(cover, own + window, -1)
                    keep = np.cumsum(cover)[: b - a] == 0
                    begin, end = begin[keep], end[keep]
                n.append(b - a)
                gone.append(b - a - len(begin))
                sha.append(hashlib.sha256(b" ".join([data[x:y] for x, y in zip(begin.tolist(), end.tolist())])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha)], ["row", "doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def repeats(docs: DataFrame, window: int = WINDOW, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(texts with candidates: row, doc_id, text; their repeated windows: row, starts).

    ``docs`` has row (unique), doc_id and text.
    """
    if 2 * block - 1 > window:
        raise ValueError("a window must hold a whole block")
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(scratch.shuffle_partitions(spark), -(-size // PART))
    made = docs.select("row", "text").mapInArrow(first_pass(parts, window, block), FIRST)
    hits = scratch.write(_probe(made, ["<u4"], True), "hits")
    scratch.release(spark)
    texts = scratch.write(docs.join(hits, "row"), "texts")
    scratch.release(spark)
    again = texts.select("row", "text", "starts").mapInArrow(second_pass(parts, window, block), FIRST)
    starts = scratch.write(_probe(again, ["<u8", "<u2"], False), "starts")
    scratch.release(spark)
    return texts.drop("starts"), starts


def _spans(window: int):
    def run(batches):
        for batch in batches:
            for row, starts in zip(batch.column("row").to_pylist(), batch.column("starts").to_pylist()):
                at = np.frombuffer(starts, "<i4").astype(np.int64)
                cut = np.flatnonzero(np.concatenate([[True], at[1:] > at[:-1] + window])) if len(at) else at
                begin, end = at[cut], at[np.append(cut[1:], len(at)) - 1] + window if len(at) else at
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(begin), row)), pa.array(begin), pa.array(end)], ["row", "begin", "end"])

    return run


def passages(docs: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """(row, begin, end): the maximal passages, in words, that windows with another start cover.
    ``docs`` has row (unique), doc_id and text."""
    _, starts = repeats(docs, window, block)
    return starts.mapInArrow(_spans(window), "row long, begin long, end long")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of ``docs``."""
    spark = docs.sparkSession
    numbered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    numbered = _numbered(numbered)
    texts, starts = repeats(numbered)
    columns = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    cut = texts.join(starts, "row").mapInArrow(_digests(WINDOW), DIGEST)
    changed = scratch.write(cut, "cut")
    scratch.release(spark)
    whole = numbered.mapInArrow(_digests(WINDOW), DIGEST).join(changed.select("row"), "row", "left_anti")
    return whole.select(*columns).union(changed.select(*columns))


def _numbered(docs: DataFrame) -> DataFrame:
    """A row number that doesn't depend on the partitioning: doc_id where that is unique."""
    if docs.filter("doc_id is null").isEmpty() and docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return docs.withColumn("row", F.col("doc_id"))
    return scratch.write(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")


def op5_repeated_passages(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents", "doc_id", "text"))


def oracle() -> str:
    """Every window of every text, counted."""
    return """WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM w WHERE len(w) >= 35)),
again AS (SELECT g FROM p GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS j FROM (SELECT doc_id, i, unnest(range(0, 35)) AS k FROM p JOIN again USING (g))),
words AS (SELECT doc_id, j, w[j] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS j FROM w)),
kept AS (SELECT doc_id, count(gone.j) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (gone.j IS NULL) AS kept FROM words LEFT JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""
