"""MinHash near-duplicates by an LSH forest.

One Arrow pass hashes the 5-word shingles of whole texts: their distinct number, a 128-bit
key of the set, HASHES minima, and a sketch of SKETCH one-byte minima. Equal sets collapse to
their least doc_id before anything else. Each tree sorts the classes by a rotation of the
minima (range partitioned, so a hot region is split over tasks). Rows with a common prefix of
BASE minima form a region. The depth at which a region's rows meet adapts to its size: up to
REGION rows give all their pairs; in larger ones each row meets its NEAR longest-common-prefix
neighbours, as deep as the order goes, and what is still apart after the links among those are
confirmed meets in blocks (``_rounds``), whatever the region's size.

Candidates whose sizes or sketches rule out the threshold go (the size test is exact; at
similarity 0.75 the sketch test loses fewer than one pair in 100,000, and TREES trees of depth
BASE miss about one in 7,000). The rest are confirmed on full sets, each text being read once
per block of related documents, and components come from star contraction.

Defined cases: null, empty or blank texts have 0 shingles and link with nothing; texts of any
length are one row and one set; null doc_ids are left out of groups and are their own (component
null, kept true); repeated rows of a doc_id are copies of it; ties go to the least doc_id; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import scratch
from .tables import read
from .words import Words, mix, pair, rolling, slices

_U = np.uint64
SHINGLE = 5
PERCENT = 75
#: A tree's order: BASE minima of 32 bits, then the low bytes of further ones, DEPTH in all.
HASHES, TREES, BASE, DEPTH = 48, 16, 3, 24
#: Rows of a region that give all pairs; neighbours of each row, to either side, in larger ones.
REGION, NEAR = 24, 2
#: Bins of the sketch; a candidate agrees in 0.75 of the bins that either uses, less so many standard deviations.
SKETCH, DEVIATIONS = 256, 4.5
#: Forest rows in a task; documents, and their shingles, that are confirmed together, about.
FOREST_ROWS, BLOCK_DOCS, BLOCK_SHINGLES = 100_000, 256, 400_000
#: Sketches of either side that meet in a block; trees whose regions are handled before labels are renewed.
MEET, TURNS = 1024, ((0, 2), (2, TREES))
#: Parts of the join of a region's rows with its counts.
SALT = 32
_A = mix(np.arange(1, HASHES + 1, dtype=_U)) | _U(1)


def shingles(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every shingle of a batch, and where each text's shingles begin (and the end)."""
    first = words.first
    n = np.diff(first)
    with np.errstate(over="ignore"):
        rolled = rolling(words.hashes, size)
        count = np.where(n >= size, n - size + 1, (n > 0).astype(n.dtype))
        begin = np.concatenate([[0], np.cumsum(count)])
        out = np.empty(begin[-1], _U)
        full = np.repeat(n >= size, count)
        at = np.arange(begin[-1]) - np.repeat(begin[:-1], count) + np.repeat(first[:-1], count)
        out[full] = rolled[at[full]]
        for i in np.flatnonzero((n > 0) & (n < size)):
            part = words.hashes[first[i] : first[i + 1]]
            x = mix(np.array([len(part)], _U))
            for h in part:
                x = pair(x, np.array([h], _U), 7)
            out[begin[i]] = x[0]
    return out, begin


SIGNED = "doc_id long, text_hash long, n_shingles long, set_key binary, signature binary, sketch binary"


def sign(batches):
    """SIGNED rows of documents (doc_id, text_hash, text)."""
    for batch in slices(batches):
        out, begin = shingles(Words(batch.column("text"), lower=True))
        some = np.flatnonzero(np.diff(begin))
        n = np.zeros(batch.num_rows, np.int64)
        keys: list = [None] * batch.num_rows
        signatures: list = [None] * batch.num_rows
        sketches: list = [None] * batch.num_rows
        if len(some):
            minima = np.empty((len(some), HASHES), np.uint32)
            with np.errstate(over="ignore"):
                for k in range(HASHES):
                    minima[:, k] = np.minimum.reduceat(out * _A[k], begin[some]) >> _U(32)
                for row, i in enumerate(some):
                    own = distinct(out[begin[i] : begin[i + 1]])
                    n[i] = len(own)
                    keys[i] = np.array([np.sum(own), np.sum(mix(own ^ _U(0x5851F42D4C957F2D)))], _U).tobytes()
                    signatures[i] = minima[row].tobytes()
                    sketches[i] = sketch(own).tobytes()
        binary = [pa.array(x, pa.binary()) for x in (keys, signatures, sketches)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("text_hash"), pa.array(n), *binary], ["doc_id", "text_hash", "n_shingles", "set_key", "signature", "sketch"])


def distinct(hashes: np.ndarray) -> np.ndarray:
    own = np.sort(hashes)
    new = np.ones(len(own), bool)
    np.not_equal(own[1:], own[:-1], out=new[1:])
    return own[new]


def sketch(own: np.ndarray) -> np.ndarray:
    """One-permutation minima of sorted distinct hashes: a byte for each bin, 0 where it is empty."""
    bins = own >> _U(56)
    first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
    out = np.zeros(SKETCH, np.uint8)
    out[bins[first].astype(np.int64)] = own[first] % _U(255) + _U(1)
    return out


def _agree(equal: np.ndarray, used: np.ndarray) -> np.ndarray:
    share = PERCENT / 100
    return equal >= share * used - DEVIATIONS * np.sqrt(share * (1 - share) * used)


def _matrix(sketches) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, SKETCH)


def _trees(batches):
    """The rows of all trees: tree, order of DEPTH minima, id and n."""
    width = 4 * BASE + DEPTH - BASE
    for batch in batches:
        if not batch.num_rows:
            continue
        minima = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(-1, HASHES)
        for t in range(TREES):
            at = (np.arange(DEPTH) + t * BASE) % HASHES
            head = np.ascontiguousarray(minima[:, at[:BASE]].astype(">u4")).view(np.uint8)
            order = np.hstack([head, minima[:, at[BASE:]].astype(np.uint8)]).tobytes()
            order = [order[i : i + width] for i in range(0, len(order), width)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, t, np.int32)), pa.array(order, pa.binary()), batch.column("doc_id"), batch.column("n_shingles")], ["tree", "sig", "id", "n"])


def neighbours(common: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidate index pairs of sorted rows. common[i]: minima shared by rows i and i+1."""
    border = np.flatnonzero(np.concatenate([[True], common < BASE, [True]]))
    begin, end = border[:-1], border[1:]
    reach = np.where(end - begin > REGION, NEAR + 1, end - begin)
    left, right = [], []
    for d in range(1, int(reach.max(initial=1))):
        count = np.where(reach > d, end - begin - d, 0)
        i = np.repeat(begin, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        left.append(i)
        right.append(i + d)
    i = np.concatenate(left) if left else np.zeros(0, np.int64)
    j = np.concatenate(right) if right else np.zeros(0, np.int64)
    near = 100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j])
    return i[near], j[near]


def _prefixes(tree: np.ndarray, sig: list[bytes]) -> np.ndarray:
    m = np.frombuffer(b"".join(sig), np.uint8).reshape(len(sig), -1)
    same = m[1:] == m[:-1]
    head = same[:, : 4 * BASE].reshape(-1, BASE, 4).all(axis=2)
    same = np.hstack([head, same[:, 4 * BASE :]]) & (tree[1:] == tree[:-1])[:, None]
    return np.logical_and.accumulate(same, axis=1).sum(axis=1)


MET = "a long, b long, block long, tree int, head binary, id long, n long"


def _meet(batches):
    """Pairs of a sorted partition, each with a block of neighbouring rows, and the rows of
    regions that are large or reach its ends."""
    from pyspark import TaskContext

    table = pa.Table.from_batches(list(batches))  # about FOREST_ROWS narrow rows
    if not table.num_rows:
        return
    tree, n, ids = (table.column(c).to_numpy() for c in ("tree", "n", "id"))
    sig = table.column("sig").to_pylist()
    common = _prefixes(tree, sig)
    i, j = neighbours(common, n)
    block = np.arange(len(n)) // BLOCK_DOCS + np.cumsum(n) // BLOCK_SHINGLES + (TaskContext.get().partitionId() << 32)
    kinds = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("block", pa.int64()), ("tree", pa.int32()), ("head", pa.binary()), ("id", pa.int64()), ("n", pa.int64())])

    def rows(**columns) -> pa.RecordBatch:
        length = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(length, f.type) for f in kinds], schema=kinds)

    yield rows(a=np.minimum(ids[i], ids[j]), b=np.maximum(ids[i], ids[j]), block=block[i])
    border = np.flatnonzero(np.concatenate([[True], common < BASE, [True]]))
    size = np.diff(border)
    open_ = size > REGION
    open_[[0, -1]] = True
    at = np.flatnonzero(np.repeat(open_, size))
    yield rows(tree=tree[at], head=[sig[k][: 4 * BASE] for k in at], id=ids[at], n=n[at])


def candidates(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs (a, b, block), a < b, of classes whose sketches agree; and the rows (tree,
    unit, id) of large regions, each region being a unit."""
    parts = max(1, -(-classes.count() * TREES // FOREST_ROWS))
    forest = classes.select("doc_id", "n_shingles", "signature").mapInArrow(_trees, "tree int, sig binary, id long, n long")
    forest = forest.repartitionByRange(parts, "tree", "sig", "id").sortWithinPartitions("tree", "sig", "id")
    met = scratch.write(forest.mapInArrow(_meet, MET), "forest")
    rows = met.filter("tree is not null").select("tree", F.xxhash64("tree", "head").alias("unit"), "id", "n")
    counts = scratch.write(rows.groupBy("unit").agg(F.count("*").alias("members")).filter("members > 1"), "units")
    # regions cut by the partitioning: at most two for each partition
    few = _salted(rows, counts.filter(F.col("members") <= REGION).select("unit"), "id").groupBy("unit").agg(F.collect_list(F.struct("id", "n")).alias("r"))
    two = few.select("unit", F.explode("r").alias("x"), "r").select("unit", "x", F.explode("r").alias("y")).filter("x.id < y.id")
    two = two.filter(100 * F.least("x.n", "y.n") >= PERCENT * F.greatest("x.n", "y.n")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("unit").bitwiseOR(F.lit(1 << 62)).alias("block"))
    # tasks hold the trees in their order, so the least block is one of the first tree
    pairs = met.filter("a is not null").select("a", "b", "block").union(two).filter("a < b").groupBy("a", "b").agg(F.min("block").alias("block"))
    signed = lambda x: classes.select(F.col("doc_id").alias(x), F.col("sketch").alias(f"sketch_{x}"))
    pairs = scratch.write(pairs.join(signed("a"), "a").join(signed("b"), "b").mapInArrow(_agreeing, "a long, b long, block long"), "pairs")
    large = _salted(rows, counts.filter(F.col("members") > REGION).select("unit"), "id")
    large = scratch.write(large.select("tree", "unit", "id"), "regions")
    scratch.drop(met, counts)
    return pairs, large


def _salted(rows: DataFrame, counts: DataFrame, spread: str) -> DataFrame:
    """Joins rows with one row per unit; the rows of a hot unit go to SALT tasks."""
    counts = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(SALT)).cast("int")).join(counts, ["unit", "salt"]).drop("salt")


def _agreeing(batches):
    for batch in batches:
        for k in range(0, batch.num_rows, 4096):
            part = batch.slice(k, 4096)
            x, y = (_matrix(part.column(c).to_pylist()) for c in ("sketch_a", "sketch_b"))
            ok = _agree(((x == y) & (x != 0)).sum(axis=1), ((x | y) != 0).sum(axis=1))
            yield part.select(["a", "b", "block"]).filter(pa.array(ok))


def _confirm(rows: pd.DataFrame) -> pd.DataFrame:
    """Confirms one block's documents with their partners in it, on full sets; one edge to the
    least document of each part that links join. Pairs already joined need no look."""
    rows = rows.reset_index(drop=True)
    out, begin = shingles(Words(pa.array(rows["text"], pa.large_string()), lower=True))
    sets = [distinct(out[begin[i] : begin[i + 1]]) for i in range(len(rows))]
    at: dict[int, list[int]] = {}
    for i, d in enumerate(rows["doc_id"]):
        at.setdefault(d, []).append(i)

    stars = Stars()
    for i, partners in enumerate(rows["partners"]):
        for p in partners if partners is not None else ():
            if not stars.joined(rows["doc_id"][i], p) and any(_link(sets[i], sets[j]) for j in at.get(p, ())):
                stars.join(rows["doc_id"][i], p)
    return stars.edges()


class Stars:
    """Union-find of one block's documents; its edges go to the least of each part."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while self.up.get(x, x) != x:
            self.up[x] = self.up.get(self.up[x], self.up[x])
            x = self.up[x]
        return x

    def joined(self, a: int, b: int) -> bool:
        return self.find(a) == self.find(b)

    def join(self, a: int, b: int) -> None:
        a, b = sorted((self.find(a), self.find(b)))
        self.up.setdefault(a, a)
        self.up[b] = a

    def edges(self) -> pd.DataFrame:
        ab = np.array([(self.find(x), x) for x in self.up if self.find(x) != x], np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": ab[:, 0], "b": ab[:, 1]})


def _confirm_blocks(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The links among pairs (a, b, block) as (a, b), each block's documents being read once for it."""
    members = pairs.groupBy("block", F.col("a").alias("doc_id")).agg(F.collect_list("b").alias("partners")).unionByName(
        pairs.select("block", F.col("b").alias("doc_id"), F.lit(None).cast("array<long>").alias("partners")))
    members = members.groupBy("block", "doc_id").agg(F.first("partners", ignorenulls=True).alias("partners"))
    read_ = texts.join(members, "doc_id").select("block", "doc_id", "partners", "text")
    return scratch.write(read_.groupBy("block").applyInPandas(_confirm, "a long, b long"), "links")


def _link(x: np.ndarray, y: np.ndarray) -> bool:
    if 100 * min(len(x), len(y)) < PERCENT * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


SURVIVORS = "unit long, i long, j long, si int, sj int, node long, stray boolean, label long"


def _compare(rows: pd.DataFrame) -> pd.DataFrame:
    """Of a block's strays and members, those whose sketches agree with one of another label on
    the other side, in smaller blocks of about BLOCK_SHINGLES a side."""
    side = [rows[rows["stray"]].reset_index(drop=True), rows[~rows["stray"]].reset_index(drop=True)]
    x, y = (_matrix(r["sketch"]) for r in side)
    n, label, node = ([r[c].to_numpy() for r in side] for c in ("n", "label", "node"))
    sub = [(np.cumsum(v) // BLOCK_SHINGLES).astype(np.int32) for v in n]
    found = [np.zeros(0, np.int64)] * 2
    if len(x) and len(y):
        fx, fy = (x != 0).astype(np.float32), (y != 0).astype(np.float32)
        used = fx.sum(1)[:, None] + fy.sum(1)[None] - fx @ fy.T
        left, right = [], []
        for k in range(len(x)):
            far = (label[1] != label[0][k]) & (100 * np.minimum(n[1], n[0][k]) >= PERCENT * np.maximum(n[1], n[0][k]))
            at = np.flatnonzero(far)
            if len(at):
                at = at[_agree(((y[at] == x[k]) & (x[k] != 0)).sum(axis=1), used[k, at])]
                left.append(np.full(len(at), k))
                right.append(at)
        found = [np.concatenate(v) if v else np.zeros(0, np.int64) for v in (left, right)]
    out = []
    for s in (0, 1):
        own = found[s]
        key = np.unique(np.stack([sub[0][found[0]], sub[1][found[1]], own]), axis=1) if len(own) else np.zeros((3, 0), np.int64)
        out.append(pd.DataFrame({"si": key[0], "sj": key[1], "node": node[s][key[2]], "stray": s == 0, "label": label[s][key[2]]}))
    out = pd.concat(out, ignore_index=True)
    first = rows.iloc[0]
    return out.assign(unit=first["unit"], i=first["i"], j=first["j"])[["unit", "i", "j", "si", "sj", "node", "stray", "label"]].astype({"unit": "int64", "i": "int64", "j": "int64", "si": "int32", "sj": "int32", "node": "int64", "stray": bool, "label": "int64"})


def common_shingles(x: list[np.ndarray], y: list[np.ndarray], step: int = 4096) -> np.ndarray:
    """Sizes of the intersections of every set of x with every set of y, by products of the
    0-1 matrices of the shingles that stand on both sides."""
    h = [np.concatenate([np.zeros(0, _U), *v]) for v in (x, y)]
    both = np.intersect1d(np.unique(h[0]), np.unique(h[1]), assume_unique=True)
    out = np.zeros((len(x), len(y)), np.int64)
    places = []
    for v, all_ in zip((x, y), h):
        owner = np.repeat(np.arange(len(v)), [len(s) for s in v])
        at = np.searchsorted(both, all_)
        ok = at < len(both)
        ok[ok] = both[at[ok]] == all_[ok]
        order = np.argsort(at[ok], kind="stable")
        places.append((at[ok][order], owner[ok][order]))
    for k in range(0, len(both), step):
        m = []
        for (at, owner), v in zip(places, (x, y)):
            a, b = np.searchsorted(at, [k, k + step])
            one = np.zeros((len(v), min(step, len(both) - k)), np.float32)
            one[owner[a:b], at[a:b] - k] = 1
            m.append(one)
        out += (m[0] @ m[1].T).astype(np.int64)
    return out


def _verify(rows: pd.DataFrame) -> pd.DataFrame:
    """Edges between the labels that links of a block's strays with its members join."""
    side = [rows[rows["stray"]].reset_index(drop=True), rows[~rows["stray"]].reset_index(drop=True)]
    sets = []
    for r in side:
        out, begin = shingles(Words(pa.array(r["text"], pa.large_string()), lower=True))
        sets.append([distinct(out[begin[i] : begin[i + 1]]) for i in range(len(r))])
    both = common_shingles(*sets)
    n = [np.array([len(v) for v in s], np.int64) for s in sets]
    i, j = np.nonzero(100 * both >= PERCENT * (n[0][:, None] + n[1][None] - both))
    a, b = side[0]["label"].to_numpy()[i], side[1]["label"].to_numpy()[j]
    stars = Stars()
    for u, v in np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1).T.tolist():
        if u != v and not stars.joined(u, v):
            stars.join(u, v)
    return stars.edges()


def _rounds(regions: DataFrame, labels: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """``labels`` after every two rows of a large region that carry different labels have met.

    In each region the rows of all labels but the commonest, its strays, meet all rows, in
    blocks of sketches that are dealt over tasks; only texts whose sketches agree with one of
    another label are read, in blocks of bounded size. The first trees' regions come first, and
    labels are renewed in between, so that what they join need not meet again.
    """
    for low, high in TURNS:
        rows = regions.filter((F.col("tree") >= low) & (F.col("tree") < high)).withColumnRenamed("id", "node")
        rows = rows.join(labels.select("node", F.col("component").alias("label")), "node", "left").withColumn("label", F.coalesce("label", "node"))
        rows = scratch.write(rows, "labelled")
        per_label = rows.groupBy("unit", "label").agg(F.count("*").alias("n"))
        counts = per_label.groupBy("unit").agg(F.max(F.struct("n", "label")).alias("main"), F.sum("n").alias("members")).filter(F.col("main.n") < F.col("members"))
        counts = scratch.write(counts.select("unit", F.col("main.label").alias("main"), F.ceil((F.col("members") - F.col("main.n")) / MEET).alias("stray_parts"), F.ceil(F.col("members") / MEET).alias("member_parts")), "counts")
        if counts.isEmpty():
            scratch.drop(rows, counts)
            continue
        apart = _salted(rows, counts, "node").join(classes.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "sketch"), "node")
        columns = ("unit", "node", "label", "n", "sketch")
        to = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
        stray = apart.filter("label != main").select(*columns, F.lit(True).alias("stray"), F.pmod(F.xxhash64("node"), F.col("stray_parts")).alias("i"), to("member_parts").alias("j"))
        member = apart.select(*columns, F.lit(False).alias("stray"), to("stray_parts").alias("i"), F.pmod(F.xxhash64("node"), F.col("member_parts")).alias("j"))
        near = scratch.write(stray.unionByName(member).groupBy("unit", "i", "j").applyInPandas(_compare, SURVIVORS), "near")
        block = ("unit", "i", "j", "si", "sj")
        read_ = near.join(texts.select(F.col("doc_id").alias("node"), "text"), "node")
        more = scratch.write(read_.groupBy(*block).applyInPandas(_verify, "a long, b long"), "links")
        scratch.drop(rows, counts, near)
        if not more.isEmpty():
            new = scratch.write(scratch.components(more, "a", "b").select(F.col("node").alias("label"), F.col("component").alias("renewed")), "renewed")
            # labels may be hot; one that no link had named yet is a row of its own
            named = labels.select("node", F.col("component").alias("label")).withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALT)).cast("int"))
            renewed = named.join(new.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))), ["label", "salt"], "left").select("node", F.coalesce("renewed", "label").alias("component"))
            own = new.join(labels.select(F.col("node").alias("label")), "label", "left_anti").select(F.col("label").alias("node"), F.col("renewed").alias("component"))
            renewed = renewed.union(own)
            labels = scratch.write(renewed, "labels")
    return labels


def confirm(pairs: DataFrame, regions: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, component) of the graph of those pairs, and pairs within regions, that are links
    on full sets."""
    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).union(regions.select("id")).distinct()
    # texts of candidates are read from the corpus once; sides of any size are shuffled
    texts = scratch.write(docs.select("doc_id", "text").join(wanted.hint("merge"), "doc_id"), "related-texts")
    scratch.release(docs.sparkSession)
    links = _confirm_blocks(pairs, texts)
    labels = scratch.components(links, "a", "b")
    if not regions.isEmpty():
        labels = _rounds(regions, scratch.write(labels, "labels"), classes, texts)
    scratch.drop(links, texts)
    return labels


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and text_hash of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    signed = scratch.write(docs.mapInArrow(sign, SIGNED), "signed")
    classes = signed.filter("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min(F.struct("doc_id", "n_shingles", "signature", "sketch")).alias("c"))
    classes = scratch.write(classes.select("set_key", "c.*"), "classes")
    pairs, regions = candidates(classes)
    joined = confirm(pairs, regions, docs, classes)
    labels = classes.join(joined, classes.doc_id == joined.node, "left").select("set_key", F.coalesce("component", "doc_id").alias("component_id"))
    scratch.drop(pairs, regions)
    scratch.release(spark)
    out = signed.select("doc_id", "n_shingles", "set_key", "text_hash").join(labels, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "text_hash")


def op2_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text")).drop("text_hash")


def oracle() -> str:
    """Full sets, all pairs with a common shingle, and what is reachable."""
    return """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) END AS s FROM w),
x AS (SELECT doc_id, unnest(s) AS g FROM s),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM x a JOIN x b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b WHERE 100 * n >= 75 * (len(sa.s) + len(sb.s) - n)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT sides.b, reach.root FROM reach JOIN sides ON sides.a = reach.id),
least AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN least ON id = doc_id"""


def dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the row of its least doc_id, once.

    Repeated rows of that doc_id with texts of the group leave one, the least text; rows with
    null doc_id, and documents without words, stay as they are unless their doc_id repeats
    their text. Extra columns stay; an empty table stays empty.
    """
    found = near_duplicates(docs)
    stay = found.filter("kept").groupBy("doc_id", "component_id", "n_shingles", "text_hash").agg(F.count("*").alias("copies"))
    stay = scratch.write(stay.select(F.col("doc_id").alias("stay_id"), F.col("text_hash").alias("stay_hash"), F.struct("component_id", (F.col("n_shingles") > 0).alias("some")).alias("stay_group"), "copies"), "stay")
    per_id = F.count("*").over(W.partitionBy("stay_id")) > 1
    again = stay.filter("stay_id is not null").withColumn("several", per_id | (F.col("copies") > 1)).filter("several").select(F.col("stay_id").alias("again_id")).distinct()
    kept = docs.join(stay.select("stay_id", "stay_hash"), docs.doc_id.cast("long").eqNullSafe(F.col("stay_id")) & F.xxhash64(docs.text).eqNullSafe(F.col("stay_hash")), "left_semi")
    if again.isEmpty():
        return kept
    # repeated doc_ids only: one row for each of them and each group
    again = F.broadcast(again) if again.count() <= 10_000 else again
    one = kept.join(again, kept.doc_id == F.col("again_id")).drop("again_id")
    one = one.join(stay.select("stay_id", "stay_hash", "stay_group"), (one.doc_id == F.col("stay_id")) & F.xxhash64(one.text).eqNullSafe(F.col("stay_hash")))
    one = one.withColumn("stay_turn", F.row_number().over(W.partitionBy("stay_id", "stay_group").orderBy("text"))).filter("stay_turn = 1")
    return kept.join(again, kept.doc_id == F.col("again_id"), "left_anti").unionByName(one.drop("stay_id", "stay_hash", "stay_group", "stay_turn"))
