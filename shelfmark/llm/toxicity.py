"""Toxicity by a convolutional text classifier, trained in numpy.

A word's embedding is the sum of BUCKETS hashed vectors: of the word without punctuation at
its ends, of its first four and five bytes and of its last four. Filters of several WIDTHS
slide over the words of the whole text; the greatest value of each filter goes, rectified,
into a logistic output. The first embedding coordinate starts as the smoothed log odds of
its bucket in the training texts, which half of the filters read first; the rest starts at
random, so that other filters can learn what word odds don't tell; Adam trains everything.

Training reads every labelled row outside the held-out fold. Rows are dealt by hash of doc_id to
shards of about SHARD rows; of a shard's rows, in order of their hash, every fifth calibrates a
threshold for each language and the others train. In each of EPOCHS rounds every shard trains a
copy of the model, a batch of texts at a time, and the copies' changes are averaged, a bucket's
by the number of steps that changed it. Changes are summed as whole numbers, so the model
depends on the rows only, not on how tasks run. Tasks keep a batch and a model, the driver the
model. Scores depend on texts only.

Defined cases: null and empty texts get the score of no words; texts of any length are scored
and train whole; without labelled rows every score is 0; contradictory
labels of a doc_id count as toxic; null doc_ids are scored and held out; repeated rows stay, the
least text of a repeated doc_id trains; an empty table gives no rows; extra columns are ignored,
in ``labels`` too.
"""

from __future__ import annotations

import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from .tables import read
from .words import _LOWER, Words, mix, slices

_U = np.uint64
BUCKETS, SIZE, FILTERS, WIDTHS = 1 << 16, 8, 8, (1, 2, 3)
#: Labelled rows of a shard, about; folds and the one held out.
SHARD, FOLDS, HELD_OUT = 8000, 5, 0
#: Texts of more bytes don't train; None, the default: all do.
SAMPLE_BYTES: int | None = None
EPOCHS, RATE = 6, 0.01
#: Texts and words of a training batch at most, but a text at least; words filtered at once.
BATCH, BATCH_WORDS, PIECE = 64, 1 << 17, 1 << 19
#: Text bytes whose words are handled at once.
SLICE = 2 << 20
#: Bits that tell which doc_ids may be labelled; changes are summed in units of 1 / UNIT.
BITS, UNIT = 1 << 25, 1 << 24
CUTS = np.linspace(0.1, 0.9, 17)
_EDGE = np.array([not chr(b).isalnum() if b < 128 else False for b in range(256)])


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (words, 4) of all words, and each text's first word."""
    w = Words(texts, spans=True, hashed=False)
    begin, end = w.begin.copy(), w.end.copy()
    for _ in range(4):
        end -= (end - begin > 1) & _EDGE[w.data[end - 1]]
        begin += (end - begin > 1) & _EDGE[w.data[np.minimum(begin, len(w.data) - 1)]]
    padded = np.concatenate([np.zeros(8, np.uint8), _LOWER[w.data], np.zeros(8, np.uint8)])
    eight = np.ndarray(len(padded) - 7, "<u8", padded.tobytes(), strides=(1,))
    n = (end - begin).astype(_U)
    head, tail = eight[begin + 8].astype(_U), eight[end].astype(_U)
    bits = np.minimum(n, _U(8)) * _U(8)
    with np.errstate(over="ignore"):
        whole = ~_U(0) >> (_U(64) - bits)
        head, tail = head & whole, tail >> (_U(64) - bits)
        code = [mix(head ^ mix(tail + n)), *[mix((head & (~_U(0) >> _U(64 - 8 * k))) + _U(k) * _U(0x9E3779B97F4A7C15)) for k in (4, 5)], mix((tail >> (np.minimum(np.maximum(bits, _U(32)), _U(64)) - _U(32))) ^ _U(0xABCDEF0123456789))]
    return np.stack([(c >> _U(48)).astype(np.int32) for c in code], axis=1), w.first


class Model:
    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        half = FILTERS // 2  # filters of each width that start from the word odds
        self.emb = rng.normal(0, 0.1, (BUCKETS, SIZE)).astype(np.float32)
        self.conv = [rng.normal(0, 0.4, (k, SIZE, FILTERS)).astype(np.float32) for k in WIDTHS]
        for c in self.conv:
            c[:, :, :half] /= 4
            c[:, 0, :half] += 0.5 / len(c)
        sign = np.where((np.arange(FILTERS) < half) | (np.arange(FILTERS) % 2 == 0), 0.3, -0.3)
        self.out = np.tile(sign, len(WIDTHS)).astype(np.float32)
        self.bias = np.zeros(1, np.float32)
        self.shift = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.known = False

    def pooled(self, ids: np.ndarray, first: np.ndarray):
        """Greatest filter values of each text, and the words where they stand."""
        n = np.diff(first)
        some = np.flatnonzero(n)
        best = np.full((len(n), len(self.out)), -np.inf, np.float32)
        x = self.emb[ids[:, 0]]
        for k in range(1, ids.shape[1]):
            x += self.emb[ids[:, k]]
        maps = []
        for c, width in zip(self.conv, WIDTHS):
            y = x @ c[0]
            for j in range(1, width):
                y[:-j] += (x @ c[j])[j:]
                y[first[1:][some] - j] = -np.inf
            if width > 1:
                for j in range(1, width):  # windows that would leave their text
                    y[np.maximum(first[1:][some] - j, first[:-1][some])] = -np.inf
            maps.append(y)
        y = np.hstack(maps)
        if len(some):
            best[some] = np.maximum.reduceat(y, first[:-1][some], axis=0)
        return best, y, x

    def scores(self, texts: pa.Array) -> np.ndarray:
        if not self.known:
            return np.zeros(len(texts))
        return self.scores_of(*features(texts))

    def peaks(self, ids: np.ndarray, first: np.ndarray, places: bool = True):
        """As ``pooled``, without what grows with the words: the greatest values, and the first
        words where they stand, if asked for."""
        n = np.diff(first)
        best, at = np.full((len(n), len(self.out)), -np.inf, np.float32), np.zeros((len(n), len(self.out)), np.int64)
        if not len(ids):
            return best, at
        if len(ids) <= PIECE:
            parts = [(0, len(n), 0, len(ids), first)]
        else:  # windows that begin in a piece end at most WIDTHS[-1] - 1 words behind it
            ends = [(d, a, min(a + PIECE + WIDTHS[-1] - 1, first[d + 1])) for d in range(len(n)) for a in range(first[d], first[d + 1], PIECE)]
            parts = [(d, d + 1, a, b, np.array([0, b - a])) for d, a, b in ends]
        for lo, hi, a, b, f in parts:
            most, y, _ = self.pooled(ids[a:b], f)
            more = most > best[lo:hi]
            best[lo:hi][more] = most[more]
            if places:
                m = np.diff(f)
                w, k = np.nonzero(y == np.repeat(most, m, axis=0))
                here = np.zeros_like(most, np.int64)
                here[np.repeat(np.arange(hi - lo), m)[w[::-1]], k[::-1]] = a + w[::-1]
                at[lo:hi][more] = here[more]
        return best, at

    def scores_of(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        best = self.peaks(ids, first, places=False)[0]
        return 1 / (1 + np.exp(-(np.maximum(best + self.shift, 0) @ self.out + self.bias[0]).astype(np.float64)))

    def start(self, zero: np.ndarray, one: np.ndarray, zeros: int, ones: int) -> None:
        """Sets the word odds from the texts of each label, and those of them with each bucket."""
        self.known = True
        rate = max(1, ones) / max(1, zeros)
        # shrunk to no evidence: rare buckets say little
        self.emb[:, 0] = np.log((one + 2 * rate) / (zero * rate + 2 * rate)).clip(-3, 6) / 4 * (zero + one > 1)
        self.bias[:] = -3.0
        self.shift[:] = -0.3

    def dense(self) -> list[np.ndarray]:
        """What every step changes; the embedding is apart."""
        return [*self.conv, self.out, self.bias, self.shift]

    def fit(self, ids: np.ndarray, n: np.ndarray, labels: np.ndarray, seed: int = 0) -> None:
        """Trains on texts of n words each, whose buckets stand in ids, all at once."""
        rng = np.random.default_rng(seed)
        first = np.concatenate([[0], np.cumsum(n)])
        self.start(*found(ids, n, labels), len(labels) - int(labels.sum()), int(labels.sum()))
        learner = Learner(self)
        for _ in range(EPOCHS):
            order = rng.permutation(len(n))
            for at in range(0, len(order), BATCH):
                docs = order[at : at + BATCH]
                learner.step(ids[np.concatenate([np.arange(first[d], first[d + 1]) for d in docs])], n[docs], labels[docs])


def found(ids: np.ndarray, n: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts of each label that hold each bucket."""
    owner, out = np.repeat(np.arange(len(n), dtype=np.int64), n), [np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)]
    for k in range(ids.shape[1]):
        pairs = np.unique(owner * BUCKETS + ids[:, k])
        for y in (0, 1):
            out[y] += np.bincount((pairs % BUCKETS)[labels[pairs // BUCKETS] == y], minlength=BUCKETS)
    return out[0], out[1]


class Learner:
    """Steps of Adam on a model, and how many of them changed each bucket (touched) and all else."""

    def __init__(self, model: Model):
        self.model, self.state = model, {}
        self.touched, self.steps = np.zeros(BUCKETS, np.int64), 0

    def adam(self, name: str, value: np.ndarray, grad: np.ndarray, rows=slice(None)) -> None:
        m, v, t = self.state.setdefault(name, [np.zeros_like(value), np.zeros_like(value), 0])
        self.state[name][2] = t = t + 1
        m[rows] = 0.9 * m[rows] + 0.1 * grad
        v[rows] = 0.999 * v[rows] + 0.001 * grad**2
        value[rows] -= RATE * (m[rows] / (1 - 0.9**t)) / (np.sqrt(v[rows] / (1 - 0.999**t)) + 1e-8)

    def step(self, ids: np.ndarray, n: np.ndarray, labels: np.ndarray) -> None:
        if not len(ids):
            return
        model = self.model
        best, place = model.peaks(ids, np.concatenate([[0], np.cumsum(n)]))
        z = np.maximum(best + model.shift, 0)
        p = 1 / (1 + np.exp(-(z @ model.out + model.bias[0])))
        g = (p - labels).astype(np.float32) / len(n)
        back = g[:, None] * model.out[None] * (z > 0)
        self.adam("out", model.out, z.T @ g)
        self.adam("bias", model.bias, g.sum(keepdims=True))
        self.adam("shift", model.shift, back.sum(0))
        d, j = np.nonzero(back)
        at, grad, (w, k) = place[d, j], back[d, j], np.divmod(j, FILTERS)
        rows, grads = [], []
        conv_grad = [np.zeros_like(c) for c in model.conv]
        for own, c in enumerate(model.conv):
            of = w == own
            g, i, filters = grad[of][:, None], at[of], k[of]
            for o in range(len(c)):
                part = ids[i + o]
                np.add.at(conv_grad[own][o].T, filters, g * model.emb[part].sum(1))
                rows.append(part.ravel())
                grads.append(np.repeat(g * c[o][:, filters].T, part.shape[1], axis=0))
        rows, grads = np.concatenate(rows), np.concatenate(grads)
        for w, c in enumerate(model.conv):
            self.adam(f"conv{w}", c, conv_grad[w])
        self.steps += 1
        if len(rows):
            r, back_to = np.unique(rows, return_inverse=True)
            e = np.zeros((len(r), SIZE), np.float32)
            np.add.at(e, back_to, grads)
            self.adam("emb", model.emb, e, r)
            self.touched[r] += 1

    def changes(self, base: Model) -> pa.RecordBatch:
        """What the steps changed, times their number: a row for each bucket, then SIZE by SIZE all else."""
        r = np.flatnonzero(self.touched)
        flat = _flat(self.model.dense()) - _flat(base.dense())
        change = np.concatenate([self.model.emb[r] - base.emb[r], flat]).astype(np.float64)
        n = np.concatenate([self.touched[r], np.full(len(flat), self.steps)])
        sums = np.rint(change * n[:, None] * UNIT).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([r, BUCKETS + np.arange(len(flat))])), pa.array(n), *map(pa.array, sums.T)], _CHANGES)


_CHANGES = ["at", "n", *[f"d{k}" for k in range(SIZE)]]


def _flat(values: list[np.ndarray]) -> np.ndarray:
    one = np.concatenate([v.ravel() for v in values])
    return np.concatenate([one, np.zeros(-len(one) % SIZE, np.float32)]).reshape(-1, SIZE)


def averaged(model: Model, changes: pa.Table) -> Model:
    """The model after the summed changes of all shards."""
    out = copy.deepcopy(model)
    at = changes.column("at").to_numpy()
    mean = np.stack([changes.column(c).to_numpy() for c in _CHANGES[2:]], axis=1) / UNIT / np.maximum(1, changes.column("n").to_numpy())[:, None]
    own = at < BUCKETS
    out.emb[at[own]] += mean[own].astype(np.float32)
    flat = np.zeros_like(_flat(model.dense()))
    flat[at[~own] - BUCKETS] = mean[~own]
    k = 0
    for v in out.dense():
        v += flat.ravel()[k : k + v.size].reshape(v.shape)
        k += v.size
    return out


def _prepared(batches):
    """Labelled rows of shards in order, with their buckets and whether they calibrate."""
    shard, k = None, 0
    for batch in slices(batches, SLICE):
        ids, first = features(batch.column("text"))
        check = []
        for s in batch.column("shard").to_pylist():
            shard, k = s, k + 1 if s == shard else 0
            check.append(k % 5 == 4)
        ids = ids.astype("<u2")
        packed = pa.array([ids[a:b].tobytes() for a, b in zip(first, first[1:])], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("lang"), batch.column("toxic"), pa.array(check), packed], ["shard", "lang", "toxic", "check", "ids"])


def _texts(batches):
    """Batches of at most BATCH texts of one shard: shard, buckets, words of each text, labels, langs."""
    shard, ids, y, langs, words = None, [], [], [], 0
    for batch in batches:
        for s, label, lang, data in zip(*[batch.column(c).to_pylist() for c in ("shard", "toxic", "lang")], batch.column("ids")):
            own = np.frombuffer(data.as_buffer(), "<u2").reshape(-1, 4)
            if y and (s != shard or len(y) == BATCH or words + len(own) > BATCH_WORDS):
                yield shard, np.concatenate(ids).astype(np.int32), np.array([len(x) for x in ids]), np.array(y), langs
                ids, y, langs, words = [], [], [], 0
            shard, words = s, words + len(own)
            ids.append(own)
            y.append(label)
            langs.append(lang)
    if y:
        yield shard, np.concatenate(ids).astype(np.int32), np.array([len(x) for x in ids]), np.array(y), langs


def _count(batches):
    """Texts of each label with each bucket, and at BUCKETS of all."""
    out = np.zeros((2, BUCKETS + 1), np.int64)
    for _, ids, n, y, _ in _texts(batches):
        out[:, :BUCKETS] += found(ids, n, y)
        out[:, BUCKETS] += np.bincount(y, minlength=2)[:2]
    at = np.flatnonzero(out.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[0][at]), pa.array(out[1][at])], ["at", "zero", "one"])


def _round(shared):
    def run(batches):
        shard = learner = None
        for s, ids, n, y, _ in _texts(batches):
            if s != shard:
                if learner:
                    yield learner.changes(shared.value)
                shard, learner = s, Learner(copy.deepcopy(shared.value))
            learner.step(ids, n, y)
        if learner:
            yield learner.changes(shared.value)

    return run


def _hits(shared):
    """For each language and cut: labels, and rejected texts by label."""

    def run(batches):
        out = {}
        for _, ids, n, y, langs in _texts(batches):
            over = shared.value.scores_of(ids, np.concatenate([[0], np.cumsum(n)]))[:, None] >= CUTS
            for lang, label, hit in zip(langs, y, over):
                if lang is not None:
                    out.setdefault(lang, np.zeros((2, 1 + len(CUTS)), np.int64))[label] += [1, *hit]
        rows = [(lang, k, *map(int, c)) for lang, counts in out.items() for k, c in enumerate(counts.T)]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 4, (pa.string(), pa.int32(), pa.int64(), pa.int64()))], ["lang", "k", "zero", "one"])

    return run


def fold() -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def labelled(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id may be in ``known``: all that are, and few others up to some
    tens of millions of ids, so that few texts travel to their labels."""
    h = F.pmod(F.xxhash64("doc_id"), F.lit(BITS))
    word, bit = (h / 64).cast("long").alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc_id), {BITS}) % 64 as int))")
    words = known.select(word, bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))  # BITS / 64 rows at most
    return docs.withColumn("word", word).join(F.broadcast(words), "word").filter(F.col("bits").bitwiseAND(bit) != 0).drop("word", "bits")


def prepared(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every labelled row outside the held-out fold: shard, lang, toxic, check, ids. A shard is in one partition."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").filter(fold() != HELD_OUT)
    known = labels.filter("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("toxic")).filter(fold() != HELD_OUT)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = max(1, -(-known.count() // SHARD))
    rows = labelled(docs, known).select("doc_id", F.struct("text", "lang").alias("row"), F.lit(None).cast("int").alias("toxic"))
    both = rows.unionByName(known.select("doc_id", F.lit(None).cast(rows.schema["row"].dataType).alias("row"), "toxic"))
    h = F.xxhash64("doc_id")
    # one row for each doc_id, the least of repeated ones
    both = both.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(n)).cast("int")).repartitionById(n, "shard")
    met = both.groupBy("shard", h.alias("h"), "doc_id").agg(F.max("toxic").alias("toxic"), F.min("row").alias("row")).filter("toxic is not null and row is not null")
    if SAMPLE_BYTES is not None:
        met = met.filter(F.coalesce(F.octet_length("row.text"), F.lit(0)) <= SAMPLE_BYTES)
    rows = met.sortWithinPartitions("shard", "h", "doc_id").select("shard", "row.lang", "toxic", "row.text")
    return rows.mapInArrow(_prepared, "shard int, lang string, toxic int, check boolean, ids binary")


def trained(docs: DataFrame, labels: DataFrame) -> tuple[Model, dict[str, float]]:
    """The model and the thresholds by language that the labelled rows of ``docs`` give."""
    context, model = docs.sparkSession.sparkContext, Model()
    rows = prepared(docs, labels).persist(StorageLevel.DISK_ONLY)
    try:
        counts = rows.filter("not check").mapInArrow(_count, "at long, zero long, one long").groupBy("at").agg(F.sum("zero").alias("zero"), F.sum("one").alias("one")).toArrow()
        if not counts.num_rows:
            return model, {}
        odds = np.zeros((2, BUCKETS + 1), np.int64)
        odds[:, counts.column("at").to_numpy()] = counts.column("zero").to_numpy(), counts.column("one").to_numpy()
        model.start(*odds[:, :BUCKETS], *map(int, odds[:, BUCKETS]))
        schema = ", ".join(f"{c} long" for c in _CHANGES)
        for _ in range(EPOCHS):
            shared = context.broadcast(model)
            changes = rows.filter("not check").mapInArrow(_round(shared), schema).groupBy("at").agg(*[F.sum(c).alias(c) for c in _CHANGES[1:]]).toArrow()  # a row for each bucket at most
            model = averaged(model, changes)
            shared.destroy()
        shared = context.broadcast(model)
        hits = rows.filter("check").mapInArrow(_hits(shared), "lang string, k int, zero long, one long").groupBy("lang", "k").agg(F.sum("zero").alias("zero"), F.sum("one").alias("one")).collect()
        shared.destroy()
    finally:
        rows.unpersist()
    of: dict[str, list] = {}
    for r in sorted(hits, key=lambda r: (r["lang"], r["k"])):
        of.setdefault(r["lang"], []).append((r["zero"], r["one"]))
    thresholds = {}
    for lang, ((zeros, ones), *cut) in of.items():
        if ones >= 10 and zeros >= 10:
            f1 = [2 * tp / max(1, ones + fp + tp) for fp, tp in cut]
            thresholds[lang] = float(min((c for c, f in zip(CUTS, f1) if f == max(f1)), key=lambda c: abs(c - 0.5)))
    return model, thresholds


def _judged(shared, thresholds: dict[str, float], batch) -> tuple[np.ndarray, np.ndarray]:
    """Scores of a batch with text and lang, and whether its languages' thresholds reject it."""
    s = shared.value.scores(batch.column("text"))
    cut = np.array([thresholds.get(x, 0.5) for x in batch.column("lang").to_pylist()])
    return s, (s >= cut) & (s > 0)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` as doc_id, held_out, score, predicted, rejected (by language)."""
    model, thresholds = trained(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS * SIZE floats and the filters

    def run(batches):
        for batch in slices(batches, SLICE):
            s, rejected = _judged(shared, thresholds, batch)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(rejected)], ["doc_id", "held_out", "score", "predicted", "rejected"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    return docs.withColumn("held_out", fold() == HELD_OUT).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, rejected boolean")


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents", "doc_id", "lang", "text"), read(spark, sf_dir, "labels", "doc_id", "toxic"))


def toxicity_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject at their language's threshold, each row
    judged by its own text.

    Null and empty texts stay; null and repeated doc_ids are judged like others; extra columns
    stay; without labels nothing is rejected; an empty table stays empty.
    """
    model, thresholds = trained(docs, read(spark, sf_dir, "labels", "doc_id", "toxic"))
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices(batches, SLICE):
            yield batch.filter(pa.array(~_judged(shared, thresholds, batch)[1]))

    return docs.mapInArrow(run, docs.schema)
