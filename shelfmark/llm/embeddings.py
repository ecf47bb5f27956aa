"""Embedding near-duplicates by an inverted multi-index.

Unit vectors are cut in halves, each with its own codebook (k-means on a bounded sample), so a
vector lies in one cell of a product grid. For each half a vector has a lower bound of its
distance to anything in the region of each centroid (how far it is from borders of regions); the
multi-sequence traversal merges both sorted lists with a heap and visits cells in the order of
the summed bounds. It ends where the bound passes a radius: at the default target recall of 1
that is the radius which the cosine allows, and nothing behind it can be a link. A lower target
ends at the radius within which that share of a bounded sample's links lie. Each unordered pair
of cells is visited from one side. Cells and visitors meet in blocks of bounded size, where
cosines are verified in double precision; a block returns each vector's number of links and one
edge to its part of the block, never all pairs.

Equal vectors of a label collapse beforehand and count with their number.

Defined cases: a null label, a null, empty or zero vector, null or non-finite components
and a null vec_id link with nothing (component_id is then vec_id); components of any finite size
are scaled first; vectors of different lengths never link; repeated rows are vectors of their
own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .tables import read

COSINE = 0.93
#: Vectors the codebooks are trained on at most; vectors a cell should hold; centroids a half at
#: most; borders of regions that bound a distance.
SAMPLE, CELL, MOST, BORDERS = 20_000, 2000, 2048, 8
#: A vector with more than this share of all as copies is sent to all tasks, at most 1 / HOT of them.
HOT = 0.001
#: Members and visitors of a block.
MEMBERS, VISITORS = 4000, 8000


def unit(rows) -> np.ndarray:
    x = np.array(list(rows), np.float64)
    x /= np.abs(x).max(axis=1)[:, None]  # so that no square over- or underflows
    return x / np.linalg.norm(x, axis=1)[:, None]


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = np.argmin(((c**2).sum(1)[None] - 2 * x @ c.T), axis=1)
        order = np.argsort(own, kind="stable")
        there, first = np.unique(own[order], return_index=True)
        c[there] = np.add.reduceat(x[order], first, axis=0) / np.diff(np.append(first, len(x)))[:, None]
    return c


def bounds(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Own centroid, and a lower bound of the squared distance to each centroid's region: the
    farthest of the borders to the regions of the BORDERS centroids nearest to the vector."""
    d = np.maximum((x**2).sum(1)[:, None] + (c**2).sum(1)[None] - 2 * x @ c.T, 0)
    between = np.sqrt(np.maximum((c**2).sum(1)[:, None] + (c**2).sum(1)[None] - 2 * c @ c.T, 0))
    low = np.zeros_like(d)
    count = min(BORDERS, len(c))
    nearest = np.argpartition(d, count - 1, axis=1)[:, :count]
    for k in nearest.T:
        gap = between[k]
        with np.errstate(divide="ignore", invalid="ignore"):
            far = np.where(gap > 0, (d - np.take_along_axis(d, k[:, None], axis=1)) / (2 * gap), 0)
        np.maximum(low, far, out=low)
    return np.argmin(d, axis=1), np.maximum(low - 1e-9, 0) ** 2


def traverse(a: np.ndarray, b: np.ndarray, stop: float):
    """(row, column, bound) of the grid's cells in ascending order of a[row] + b[column], up to
    ``stop``: the multi-sequence algorithm over both sorted lists."""
    rows, columns = np.argsort(a, kind="stable").tolist(), np.argsort(b, kind="stable").tolist()
    a, b = a[rows].tolist(), b[columns].tolist()
    heap = [(a[0] + b[0], 0, 0)]
    reached = [0] * (len(a) + 1)  # cells of each row that the traversal has taken
    while heap:
        bound, i, j = heapq.heappop(heap)
        if bound > stop:
            return
        yield rows[i], columns[j], bound
        reached[i] = j + 1
        # a cell enters when its neighbours above and before it have been taken
        if i + 1 < len(a) and reached[i + 1] == j:
            heapq.heappush(heap, (a[i + 1] + b[j], i + 1, j))
        if j + 1 < len(b) and (i == 0 or reached[i - 1] > j + 1):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))


Books = dict[int, tuple[np.ndarray, np.ndarray]]


def _halves(x: np.ndarray, books: Books):
    """Own cells of unit vectors, and the bounds of either half."""
    dim = x.shape[1]
    one = (np.zeros((1, dim // 2)), np.zeros((1, dim - dim // 2)))
    return [bounds(h, c) for h, c in zip((x[:, : dim // 2], x[:, dim // 2 :]), books.get(dim, one))]


def stop_at(sample: dict[int, list[tuple[object, np.ndarray]]], books: Books, cosine: float, recall: float) -> float:
    """The bound at which the traversal has found ``recall`` of the links among the sample's
    vectors (label, unit vector) by dimension; beyond it none can lie at a recall of 1."""
    radius2 = 2 - 2 * cosine + 1e-9
    if recall >= 1:
        return radius2
    found = [np.zeros(0)]
    for own in sample.values():
        for label in {x for x, _ in own}:
            x = np.array([v for y, v in own if y == label])
            (a, low_a), (b, low_b) = _halves(x, books)
            for k in range(0, len(x), 1024):
                i, j = np.nonzero(x[k : k + 1024] @ x.T >= cosine)
                i += k
                far = i < j
                found.append(np.minimum(low_a[i, a[j]] + low_b[i, b[j]], low_a[j, a[i]] + low_b[j, b[i]])[far])
    links = np.concatenate(found)
    return float(min(radius2, np.quantile(links, recall, method="higher"))) if len(links) else radius2


def _visits(books: Books, stop: float):
    def run(batches):
        for rows in batches:
            if not len(rows):
                continue
            out = []
            for dim, part in rows.groupby(rows["embedding"].map(len)):
                (a, low_a), (b, low_b) = _halves(unit(part["embedding"]), books)
                wide = low_b.shape[1]
                own = a * wide + b
                for i, label, vec_id in zip(range(len(part)), part["label"].tolist(), part["vec_id"].tolist()):
                    seen = [r * wide + c for r, c, _ in traverse(low_a[i], low_b[i], stop)]
                    cells = [c for c in seen if c > own[i]] + [int(own[i])]
                    out.append((label, dim, int(own[i]), vec_id, cells))
            yield pd.DataFrame(out, columns=["label", "dim", "own", "vec_id", "cells"])

    return run


def _meet(cosine: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        member, visitor = rows[~rows["visits"]].reset_index(drop=True), rows[rows["visits"]].reset_index(drop=True)
        if not len(member) or not len(visitor):
            return pd.DataFrame({"vec_id": [], "links": [], "low": []}).astype("int64")
        x, y = unit(visitor["embedding"]), unit(member["embedding"])
        xi, yi = [], []
        for k in range(0, len(x), 1024):
            i, j = np.nonzero(x[k : k + 1024] @ y.T >= cosine)
            xi.append(i + k)
            yi.append(j)
        xi, yi = np.concatenate(xi), np.concatenate(yi)
        vx, vy = visitor["vec_id"].to_numpy(), member["vec_id"].to_numpy()
        home = (visitor["own"] == visitor["cell"]).to_numpy()
        ok = ~home[xi] | (vx[xi] < vy[yi])  # in its own cell a pair counts once
        xi, yi = xi[ok], yi[ok]
        links = pd.concat([pd.Series(member["copies"].to_numpy()[yi], vx[xi]), pd.Series(visitor["copies"].to_numpy()[xi], vy[yi])]).groupby(level=0).sum()
        low = pd.Series(links.index, links.index)
        a, b = low.index.get_indexer(vx[xi]), low.index.get_indexer(vy[yi])
        part = low.to_numpy().copy()
        while len(a):
            m = np.minimum(part[a], part[b])
            new = part.copy()
            np.minimum.at(new, a, m)
            np.minimum.at(new, b, m)
            if (new == part).all():
                break
            part = new
        return pd.DataFrame({"vec_id": links.index.to_numpy(np.int64), "links": links.to_numpy(np.int64), "low": part.astype(np.int64)})

    return run


def link(vectors: DataFrame, cosine: float = COSINE, recall: float = 1.0) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors (vec_id, embedding, label);
    of the links with at least ``cosine``, about ``recall`` are found, all of them at 1."""
    spark = vectors.sparkSession
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    good = vectors.filter(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)))
    classes = scratch.write(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")), "vectors")
    books = {}
    sampled = classes.select("label", "embedding").orderBy(F.xxhash64("vec_id")).limit(SAMPLE).collect()
    sample: dict[int, list] = {}
    for r in sampled:
        sample.setdefault(len(r["embedding"]), []).append((r["label"], unit([r["embedding"]])[0]))
    biggest = classes.groupBy("label", F.size("embedding").alias("dim")).count().groupBy("dim").agg(F.max("count").alias("n")).collect()
    for r in biggest:
        x = np.array([v for _, v in sample.get(r["dim"], [])], np.float64).reshape(-1, r["dim"])
        k = min(MOST, max(1, round((r["n"] / CELL) ** 0.5)), max(1, len(x) // 4))
        if len(x) > 1 and r["dim"] > 1 and k > 1:
            books[r["dim"]] = (kmeans(x[:, : r["dim"] // 2].copy(), k), kmeans(x[:, r["dim"] // 2 :].copy(), k))
    stop = stop_at(sample, books, cosine, recall)
    label_type = dict(classes.dtypes)["label"]
    visits = scratch.write(classes.select("label", "vec_id", "embedding").mapInPandas(_visits(books, stop), f"label {label_type}, dim int, own int, vec_id long, cells array<int>"), "visits")
    cell = ["label", "dim", "cell"]
    members = visits.groupBy("label", "dim", F.col("own").alias("cell")).agg(F.ceil(F.count("*") / MEMBERS).alias("i_parts"))
    each = visits.withColumn("cell", F.explode("cells"))
    counts = each.groupBy(*cell).agg(F.ceil(F.count("*") / VISITORS).alias("j_parts")).join(members, cell)
    to = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    full = visits.join(classes.select("vec_id", "embedding", "copies", F.col("label").alias("of")), "vec_id")
    columns = ("vec_id", "embedding", "copies", "own", *cell)
    member = full.withColumn("cell", F.col("own")).join(counts, cell).select(*columns, F.lit(False).alias("visits"), F.pmod(F.xxhash64("vec_id"), F.col("i_parts")).alias("i"), to("j_parts").alias("j"))
    visitor = full.withColumn("cell", F.explode("cells")).join(counts, cell).select(*columns, F.lit(True).alias("visits"), to("i_parts").alias("i"), F.pmod(F.xxhash64("vec_id"), F.col("j_parts")).alias("j"))
    found = scratch.write(member.unionByName(visitor).groupBy(*cell, "i", "j").applyInPandas(_meet(cosine), "vec_id long, links long, low long"), "met")
    joined = scratch.components(found, "vec_id", "low")
    per_class = classes.join(found.groupBy("vec_id").agg(F.sum("links").alias("links")), "vec_id", "left").join(joined.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    per_class = scratch.write(per_class.select("label", "embedding", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")), "classes")
    total = classes.agg(F.sum("copies")).first()[0] or 0
    hot = per_class.filter(F.col("copies") > max(1, HOT * total)).drop("copies")  # fewer than 1 / HOT rows
    key = ["label", "embedding"]
    named = vectors.filter("vec_id is not null")
    first = named.join(F.broadcast(hot), key, "left")
    rest = first.filter("component_id is null").drop("n_links", "component_id").join(per_class.filter(F.col("copies") <= max(1, HOT * total)).drop("copies"), key, "left")
    out = first.filter("component_id is not null").unionByName(rest).unionByName(vectors.filter("vec_id is null"), allowMissingColumns=True)
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op7_embedding_links(spark, sf_dir: str) -> DataFrame:
    return link(read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def oracle() -> str:
    """Every pair of a label, and what is reachable."""
    return """WITH RECURSIVE e AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS v FROM embeddings),
good AS (SELECT * FROM e WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
sides AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (SELECT vec_id AS id, vec_id AS root FROM e UNION SELECT sides.b, reach.root FROM reach JOIN sides ON sides.a = reach.id),
least AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id), n AS (SELECT a, count(*) AS n FROM sides GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM e JOIN least ON id = vec_id LEFT JOIN n ON a = vec_id"""
