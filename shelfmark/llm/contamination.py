"""Benchmark decontamination by the q-gram lemma.

Texts are lower-cased with white space collapsed. An item of n characters may differ by
``budget(n)`` edits, k; what matches it then shares at least n + 1 - q (k + 1) q-grams with
it, on diagonals (document position less item position) that differ by k at most. Document
positions with a hit are counted in bands of 2 (k + 1) diagonals that overlap by half, so one
band holds all of them. Bands that reach the bound are verified by banded alignment, many
bands at a time. Equal q-grams at neighbouring places of an item are one run, so a repetitive
text costs a position for each band it touches, not for each place.

The benchmark's texts are broadcast in slices of SLICE bytes at most, one slice at a time;
each is one pass over the documents, and a worker makes the slice's index once. Documents are
read whole and never shuffled.

Only whole items are looked for, each within RATE of its length: a document with part of an
item isn't found.

Defined cases: null or empty documents and items match nothing; items shorter than q
characters must occur exactly; texts of any length are read in steps of STEP hits; repeated
rows each give rows, null doc_ids too; extra columns are ignored. Every (row, item_id) has its
best place: fewest edits, then the first.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .tables import read
from .words import mix, slices

_U = np.uint64
Q, RATE = 9, 0.08
#: Bytes of benchmark text that are broadcast at once.
SLICE = 8 << 20
TABLE_BITS = 22
#: Hits that are expanded, and cells that are aligned, at once.
STEP, CELLS = 2 << 20, 1 << 20
#: Keeps diagonals positive.
OFFSET = 1 << 40


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(n: int) -> int:
    """Edits allowed: RATE of the characters, less where the lemma would lose its bound."""
    return max(0, min(int(RATE * n), (n + 1) // Q - 2))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(codes: np.ndarray) -> np.ndarray:
    n = len(codes) - Q + 1
    if n < 1:
        return np.zeros(0, _U)
    with np.errstate(over="ignore"):
        h = codes.astype(_U) * _U(0x9E3779B97F4A7C15)
        h ^= h >> _U(29)
        out = h[:n].copy()
        for k in range(1, Q):
            out *= _U(0x2545F4914F6CDD1D)
            out += h[k : k + n]
        return mix(out)


class Index:
    """q-grams of the items, and for each the items and places where it stands."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, t) for i, t in ((i, normal(t)) for i, t in items) if t]
        self.codes = [_codes(t) for _, t in self.items]
        self.k = np.array([budget(len(c)) for c in self.codes], np.int64)
        self.need = np.array([max(1, len(c) + 1 - Q * (k + 1)) for c, k in zip(self.codes, self.k)], np.int64)
        self.short = [i for i, c in enumerate(self.codes) if len(c) < Q]
        grams = [_grams(c) for c in self.codes]
        h = np.concatenate([np.zeros(0, _U), *grams])
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(g)) for g in grams]])
        order = np.lexsort((place, item, h))
        h, item, place = h[order], item[order], place[order]
        # runs of one q-gram at neighbouring places of an item, no longer than a step of diagonals
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (item[1:] != item[:-1]) | (place[1:] != place[:-1] + 1)
        start = np.flatnonzero(new)
        along = np.arange(len(h)) - np.repeat(start, np.diff(np.append(start, len(h))))
        start = np.flatnonzero(new | (along % (self.k[item] + 1) == 0)) if len(h) else start
        self.item, self.place = item[start], place[start]
        self.last = place[np.append(start[1:], len(h)) - 1] if len(h) else place
        self.h, self.begin = np.unique(h[start], return_index=True)
        self.count = np.diff(np.append(self.begin, len(start)))
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[(self.h >> _U(64 - TABLE_BITS)).astype(np.int64)] = True

    def bands(self, codes: np.ndarray):
        """(item, first diagonal) of the bands that reach their item's bound."""
        h = _grams(codes)
        none = np.zeros(0, np.int64)
        if not len(self.h) or not len(h):
            return none, none
        at = np.flatnonzero(self.table[(h >> _U(64 - TABLE_BITS)).astype(np.int64)])
        i = np.minimum(np.searchsorted(self.h, h[at]), len(self.h) - 1)
        same = self.h[i] == h[at]
        at, i = at[same], i[same]
        cut = np.searchsorted(np.cumsum(self.count[i]), np.arange(0, self.count[i].sum() + STEP, STEP))
        keys, hits = none, none
        for a, b in zip(cut, np.append(cut[1:], len(at))):
            if b > a:
                key, count = self._hits(at[a:b], i[a:b])
                keys, back = np.unique(np.concatenate([keys, key]), return_inverse=True)
                hits = np.bincount(back, np.concatenate([hits, count])).astype(np.int64)
        item = keys >> 44
        ok = hits >= self.need[item]
        item = item[ok]
        return item, (keys[ok] & ((1 << 44) - 1)) * (self.k[item] + 1) - OFFSET

    def _hits(self, at: np.ndarray, gram: np.ndarray):
        """Numbers of document positions with a hit in each band; bands are numbered by step,
        and hold their own step of diagonals and the next one."""
        n = self.count[gram]
        to = np.repeat(self.begin[gram], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at, item = np.repeat(at, n), self.item[to]
        step = self.k[item] + 1
        low, high = (at - self.last[to] + OFFSET) // step, (at - self.place[to] + OFFSET) // step
        # a run touches one step or two neighbouring ones, so two or three bands
        band = np.concatenate([low - 1, low, high])
        key = np.concatenate([item] * 3) * (1 << 44) + band
        at = np.concatenate([at] * 3)
        order = np.lexsort((at, key))
        key, at = key[order], at[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (at[1:] != at[:-1])
        return np.unique(key[new], return_counts=True)


def align(item: np.ndarray, text: np.ndarray, diagonal: np.ndarray, low: np.ndarray, high: np.ndarray, width: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fewest edits of the item against text, for each of many bands of ``width`` diagonals,
    within its bounds low <= position <= high; with begin and end. More than ``most``: most + 1."""
    far = most + 1
    column = np.arange(width)
    at = diagonal[:, None] + column
    d = np.where((at >= low[:, None]) & (at <= high[:, None]), 0, far)
    begin = at.copy()
    edits, first, end = np.full(len(diagonal), far), np.zeros(len(diagonal), np.int64), np.zeros(len(diagonal), np.int64)
    alive = np.arange(len(diagonal))
    low, high = low[:, None], high[:, None]
    for i, c in enumerate(item):
        inside = (at >= low) & (at < high)
        differ = text[np.minimum(np.maximum(at, 0), len(text) - 1)] != c
        step = np.where(inside, d + differ, far)
        gone = np.hstack([d[:, 1:], np.full((len(d), 1), far)]) + 1
        b = np.where(gone < step, np.hstack([begin[:, 1:], begin[:, -1:]]), begin)
        v = np.minimum(step, gone) - column
        least = np.minimum.accumulate(v, axis=1)
        source = np.maximum.accumulate(np.where(v == least, column, 0), axis=1)
        begin = np.take_along_axis(b, source, axis=1)
        d = np.minimum(least + column, far)
        at = at + 1
        d[(at < low) | (at > high)] = far
        stay = d.min(axis=1) <= most
        if not stay.all():
            alive, d, begin, at, low, high = alive[stay], d[stay], begin[stay], at[stay], low[stay], high[stay]
            if not len(alive):
                return edits, first, end
    best = np.argmin(d, axis=1)
    rows = np.arange(len(alive))
    edits[alive], first[alive], end[alive] = d[rows, best], begin[rows, best], at[rows, best]
    return edits, first, end


MATCH = "doc_id long, item_id long, edits int, begin long, end long"


def places(index: Index, texts: list[str]) -> dict[tuple[int, int], tuple[int, int, int]]:
    """(text, item) to (edits, begin, end) of its best place."""
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    parts = [_codes(t) for t in texts]
    gap = np.zeros(1, np.uint32)
    codes = np.concatenate([x for p in parts for x in (p, gap)]) if parts else gap
    begin = np.cumsum([0, *[len(p) + 1 for p in parts]])
    item, diagonal = index.bands(codes)
    for one in np.unique(item).tolist():
        size, k, text = len(index.codes[one]), int(index.k[one]), index.items[one][1]
        own = diagonal[item == one]
        # a band may lie across borders of texts
        doc = np.maximum(np.searchsorted(begin, own, "right") - 1, 0)
        to = np.minimum(np.searchsorted(begin, own + size + 2 * k + 2, "right"), len(parts))
        n = np.maximum(to - doc, 0)
        own, doc = np.repeat(own, n), np.repeat(doc, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        for d in np.unique(doc).tolist():
            at = texts[d].find(text)
            if at >= 0:
                best[d, one] = (0, at, at + size)
        left = np.array([(d, one) not in best for d in doc.tolist()], bool)
        if not k or not left.any():
            continue
        own, doc = own[left], doc[left]
        chunk = max(1, CELLS // (2 * k + 2))
        for a in range(0, len(own), chunk):
            low = begin[doc[a : a + chunk]]
            found = align(index.codes[one], codes, own[a : a + chunk], low, begin[doc[a : a + chunk] + 1] - 1, 2 * k + 2, k)
            for d, start, e, b, f in zip(doc[a : a + chunk].tolist(), low.tolist(), *(x.tolist() for x in found)):
                if e <= k and (e, b - start, f - start) < best.get((d, one), (k + 1,)):
                    best[d, one] = (e, b - start, f - start)
    for one in index.short:
        for d, text in enumerate(texts):
            at = text.find(index.items[one][1])
            if at >= 0:
                best[d, one] = (0, at, at + len(index.codes[one]))
    return best


_MADE: dict[int, Index] = {}


def _index(shared) -> Index:
    """The index of a broadcast slice, made once by each worker; only the last one is kept."""
    if shared.id not in _MADE:
        _MADE.clear()
        _MADE[shared.id] = Index(shared.value)
    return _MADE[shared.id]


class _Shared:
    """A broadcast value and a key for it."""

    def __init__(self, spark, rows):
        self.id, self.broadcast = uuid.uuid4().int, spark.sparkContext.broadcast(rows)

    @property
    def value(self):
        return self.broadcast.value


def _search(shared):
    def run(batches):
        index = _index(shared)
        for batch in slices(batches):
            ids, texts = batch.column("doc_id").to_pylist(), [normal(t) for t in batch.column("text").to_pylist()]
            rows = [(ids[d], index.items[one][0], *place) for (d, one), place in sorted(places(index, texts).items())]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], ["doc_id", "item_id", "edits", "begin", "end"])

    return run


def _clean(shared):
    def run(batches):
        index = _index(shared)
        for batch in slices(batches):
            found = {d for d, _ in places(index, [normal(t) for t in batch.column("text").to_pylist()])}
            yield batch.filter(pa.array([d not in found for d in range(batch.num_rows)], pa.bool_()))

    return run


def _parts(benchmark: DataFrame):
    """The benchmark's items in slices, one after the other."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-2 * total // SLICE))
    for part in range(parts):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id", "text").collect()
        yield parts, _Shared(benchmark.sparkSession, [tuple(r) for r in own])


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """MATCH rows of all documents that hold an item within its edit budget."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for parts, shared in _parts(benchmark):
        one = docs.mapInArrow(_search(shared), MATCH)
        if parts > 1:  # done before the next slice is fetched
            one = scratch.write(one, "matches")
            shared.broadcast.destroy()
        found = one if found is None else found.union(one)
    return found


def op4_benchmark_leaks(spark, sf_dir: str) -> DataFrame:
    return matches(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text"))


def decontaminate_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, each row judged by its own text.

    Null and empty texts stay, as do null and repeated doc_ids whose text is clean; extra
    columns stay; without items, or documents, nothing changes.
    """
    for parts, shared in _parts(read(spark, sf_dir, "benchmark", "item_id", "text")):
        clean = docs.mapInArrow(_clean(shared), docs.schema)
        docs = scratch.write(clean, "clean") if parts > 1 else clean
    return docs
