"""Each operator on small tables with nulls, empty and repeated rows, ties and extra columns,
and against brute force."""

import hashlib
import math
import random
from collections import Counter

import pyarrow as pa
import pytest

from shelfmark.llm import contamination, embeddings, minhash, mixing, pii, quotes, repeats, sharding, toxicity, urls, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, label int, node long"


def text(rng, n):
    return " ".join(rng.choice(("alpha", "beta", "gamma", "delta", "of", "the", "Émile", "x1", "zeta")) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [text(rng, n) for n in (0, 1, 3, 5, 40, 60, 200, 5000)]
    out = [(i, t, rng.choice(("en", "fr")), rng.choice(("s1", "s2"))) for i, t in enumerate(base)]
    near = base[6].split()
    near[50] = "changed"
    out += [(20, base[6], "en", "s1"), (21, " ".join(near), None, None), (22, None, None, None), (23, "  \t ", "en", "s1"), (24, "a b c " + base[4] + " d e", "en", None), (25, base[3], "fr", "s2"), (25, base[3], "fr", "s2"), (None, base[5], "en", "s1")]
    return [(*r, 0, 1, 1, 1) for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def split(t):
    return (t or "").encode().split()


def test_words():
    texts = ["a b  a", "", None, " x\tb ", "b\x85c"]
    w = words.Words(pa.array(texts), spans=True)
    got = [bytes(w.data[a:b]) for a, b in zip(w.begin, w.end)]
    assert got == [x for t in texts for x in split(t)]
    assert len(set(w.hashes.tolist())) == len(set(got)) and w.first.tolist() == [0, 3, 3, 3, 5, 6]


def test_minhash(docs, none, rows):
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(rows) and minhash.near_duplicates(none).count() == 0

    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {r[0]: shingles(r[1]) for r in rows if r[0] is not None}
    for r in got:
        if r["doc_id"] is not None:
            assert r["n_shingles"] == len(sets[r["doc_id"]])
            linked = [d for d, s in sets.items() if s and 100 * len(s & sets[r["doc_id"]]) >= 75 * len(s | sets[r["doc_id"]])]
            assert r["component_id"] == min([r["doc_id"], *linked]), r
        else:
            assert r["component_id"] is None and r["kept"]


def test_neighbours_of_a_large_region_stay_connected():
    import numpy as np

    common = np.full(999, minhash.DEPTH)
    i, j = minhash.neighbours(common, np.full(1000, 50))
    assert len(i) <= 1000 * minhash.NEAR and set(np.concatenate([i, j]).tolist()) == set(range(1000))


def test_sketches_agree_at_the_threshold():
    import numpy as np

    rng = np.random.default_rng(0)
    for size in (8, 100, 3000):
        lost = 0
        for _ in range(300):
            h = words.mix(rng.integers(1, 1 << 62, 2 * size).astype(np.uint64))
            shared = -(-6 * size // 7)  # similarity of at least 0.75
            x, y = (minhash.sketch(minhash.distinct(v)) for v in (h[:size], np.concatenate([h[:shared], h[size : 2 * size - shared]])))
            lost += not minhash._agree(((x == y) & (x != 0)).sum(), ((x | y) != 0).sum())
        assert lost == 0


def test_common_shingles():
    import numpy as np

    rng = np.random.default_rng(0)
    x, y = ([np.unique(rng.integers(0, 400, n).astype(np.uint64)) for n in sizes] for sizes in ((0, 5, 300), (1, 50, 200, 0)))
    want = [[len(np.intersect1d(a, b)) for b in y] for a in x]
    assert minhash.common_shingles(x, y, step=64).tolist() == want


def families(count, size, seed=0):
    """Families of two clusters of near copies; only the two bases link them."""
    rng = random.Random(seed)
    out = {}
    for f in range(count):
        bases = [[f"f{f}w{i}" for i in range(240)], [f"f{f}w{i}" if i < 209 else f"f{f}v{i}" for i in range(240)]]
        for g, base in enumerate(bases):
            at = rng.randrange(size)
            for k in range(size):
                copy = list(base)
                if k != at:
                    copy[rng.randrange(5, 200)] = f"x{f}g{g}k{k}"
                out[(f * 2 + g) * size + k] = copy
    return out


def test_families_joined_by_one_link(spark):
    texts = families(24, 40)
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()}
    assert got == {d: d // 80 * 80 for d in texts}


def test_small_blocks_find_the_same(spark, monkeypatch):
    """A few rows and shingles a block, and regions cut by many partitions."""
    for name, value in (("MEET", 16), ("BLOCK_SHINGLES", 2000), ("BLOCK_DOCS", 8), ("FOREST_ROWS", 500)):
        monkeypatch.setattr(minhash, name, value)
    texts = families(2, 40, seed=1)
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()}
    assert got == {d: d // 80 * 80 for d in texts}


def test_large_groups_of_a_component_meet(spark):
    """Two groups of 15; only the bases link them, and no candidate pair holds both bases."""
    bases = [[f"w{i}" for i in range(240)], [f"w{i}" if i < 209 else f"v{i}" for i in range(240)]]
    texts = {}
    for g, base in enumerate(bases):
        texts[100 * g] = base
        for k in range(1, 15):
            copy = list(base)
            for at in range(5):
                copy[(k * 7 + at * 45) % 220] = f"g{g}k{k}at{at}"
            texts[100 * g + k] = copy

    def shingles(w):
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    def link(a, b):
        x, y = shingles(texts[a]), shingles(texts[b])
        return 100 * len(x & y) >= 75 * len(x | y)

    assert link(0, 100) and all(link(100 * g, 100 * g + k) for g in (0, 1) for k in range(1, 15)) and not any(link(a, b) for a in range(15) for b in range(100, 115) if a or b > 100)
    docs = spark.createDataFrame([(d, 0, " ".join(w)) for d, w in texts.items()], "doc_id long, text_hash long, text string")
    classes = docs.mapInArrow(minhash.sign, minhash.SIGNED)
    pairs = spark.createDataFrame([(100 * g, 100 * g + k, g) for g in (0, 1) for k in range(1, 15)] + [(1, 101, 3)], "a long, b long, block long")
    regions = spark.createDataFrame([(5, 1, d) for d in texts], "tree int, unit long, id long")
    assert {r["component"] for r in minhash.confirm(pairs, regions, docs, classes).collect()} == {0}


def test_dedup_stage(spark, docs, none, rows):
    got = minhash.dedup_stage(spark, docs, "").collect()
    assert docs.columns == list(got[0].asDict()) and minhash.dedup_stage(spark, none, "").count() == 0
    found = Counter(r["doc_id"] for r in minhash.near_duplicates(docs).collect() if r["kept"])
    assert Counter(r["doc_id"] for r in got) == Counter(found.keys()) and None in found
    again = [(1, "a b c d e f", "en"), (1, "a b c d e f", "en"), (1, "other words stand here now", "en"), (2, "a b c d e f", "fr"), (3, None, "x"), (None, None, None), (None, None, None)]
    got = minhash.dedup_stage(spark, spark.createDataFrame(again, "doc_id long, text string, lang string"), "").collect()
    assert sorted(map(str, (r["doc_id"] for r in got))) == ["1", "3", "None", "None"]


def test_repeats(docs, none, rows):
    got = repeats.remove_repeats(docs).collect()
    assert repeats.remove_repeats(none).count() == 0
    seen = Counter(tuple(w[i : i + 35]) for r in rows for w in [split(r[1])] for i in range(len(w) - 34))
    want = []
    for r in rows:
        w, gone = split(r[1]), set()
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone |= set(range(i, i + 35))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((str(r[0]), len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    assert sorted((str(r["doc_id"]), *tuple(r)[1:]) for r in got) == sorted(want)


def by_source(got, docs):
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    out = {}
    for r in got:
        x = out.setdefault(source[r["doc_id"]], [r["source_size"], r["target"], 0, 0])
        x[2] += r["taken"]
        x[3] += r["size"]
    return out


def test_mixing(docs, none, rows):
    got = mixing.mix(docs, block=8).collect()
    assert mixing.mix(none).count() == 0 and len(got) == len(rows)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5), block=8).collect()))
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert Counter((str(r["doc_id"]), r["size"]) for r in got) == Counter((str(i), len(split(t))) for i, t, *_ in rows)
    for size, target, taken, words_ in by_source(got, docs).values():
        assert abs(taken - target) <= 0.5 and target <= 2 * size and size == words_


def water_fill(sizes, weights, share, cap):
    """Targets by brute force: fill, cut at the cap, share the rest again."""
    target, full, left = [0.0] * len(sizes), set(), share * sum(sizes)
    while left > 1e-9 and len(full) < len(sizes):
        open_ = [i for i in range(len(sizes)) if i not in full]
        unit = left / sum(weights[i % len(weights)] for i in open_)
        over = [i for i in open_ if weights[i % len(weights)] * unit >= cap * sizes[i]]
        if not over:
            for i in open_:
                target[i] = weights[i % len(weights)] * unit
            break
        for i in over:
            target[i] = cap * sizes[i]
            left -= target[i]
            full.add(i)
    return target


def test_mix_targets_and_small_sources(spark):
    rng = random.Random(8)
    sizes = [20] * 150 + [rng.choice((0, 1, 7, 500, 3000)) for _ in range(30)]
    docs = spark.createDataFrame([(i * 10 + k, text(rng, n // 2 if k else n - n // 2), "", f"s{i:03}") for i, n in enumerate(sizes) for k in (0, 1)], "doc_id long, text string, lang string, source string")
    got = mixing.mix(docs).collect()
    want = water_fill(sizes, (3, 1, 2), 1.5, 2)
    for source, (size, target, taken, words_) in by_source(got, docs).items():
        i = int(source[1:])
        assert size == sizes[i] == words_ and abs(target - want[i]) < 1e-6 and abs(taken - target) <= 0.5
    assert all(r["taken"] <= 2 * r["size"] for r in got)


def test_permutations_are_bijections(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 3, 7, 97, 1000, 4097):
        got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit("key"), F.lit(n))).collect()]
        assert sorted(got) == list(range(n)) and (n < 90 or sum(a == b for a, b in enumerate(got)) < 12)


def test_draws_are_multinomial(spark):
    sources = spark.createDataFrame([(0, 60_000), (1, 30_000), (2, 10_000), (3, 0)], "rank int, slots long")
    got = mixing.drawn_counts(sources, 100_000, seed=3).collect()
    per_shard = Counter()
    for r in got:
        per_shard[r["shard"]] += r["count"]
    assert sum(per_shard.values()) == 100_000 and set(r["rank"] for r in got) == {0, 1, 2}
    counts = [r["count"] for r in got if r["rank"] == 1 and per_shard[r["shard"]] == 1024]
    mean = sum(counts) / len(counts)
    spread = sum((c - mean) ** 2 for c in counts) / (len(counts) - 1)
    assert abs(mean - 307.2) < 6 and 120 < spread < 330  # a binomial's is 215, a stratified draw's below 1


def test_slots_visit_each_block_once_a_pass(spark):
    sources = mixing.needed_slots(spark.createDataFrame([(0, 1000, 1700.4), (1, 130, 65.0), (2, 20, 33.3), (3, 0, 0.0)], "rank int, source_size long, target double"), 64)
    slots = [tuple(r) for r in mixing.filled_slots(sources, 64).select("rank", "k", "index", "words", "shard").collect()]
    assert sorted(k for r, k, *_ in slots if r == 0) == list(range(16 + 11)) and len({i for r, k, i, *_ in slots if r == 0 and k < 16}) == 16
    assert len({i for r, k, i, *_ in slots if r == 0 and k >= 16}) == 11 and all(s is not None and s >= 0 for *_, s in slots)
    assert {(i, w) for r, _, i, w, _ in slots if r == 2} == {(0, 64), (0, 13)} and not [1 for r, *_ in slots if r == 3]


def test_mix_stage(spark, docs, none):
    got = mixing.mix_stage(spark, docs, "")
    assert got.columns == docs.columns and mixing.mix_stage(spark, none, "").count() == 0
    times = Counter(r["doc_id"] for r in got.collect())
    assert max(times.values()) <= 4 and times[0] == 1 and times[22] == 1


def test_sharding(docs, none, rows):
    got = sharding.shard(docs, shards=4).collect()
    assert sharding.shard(none).count() == 0 and len(got) == len(rows)
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert {r["size"] for r in got if r["doc_id"] == 22} == {8}
    import zlib

    want = Counter((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want


def test_equal_texts_stay_in_one_shard(spark):
    """Groups of up to nine tenths of a shard, and one of three shards."""
    rng = random.Random(9)
    out, n = [], 0
    groups = {f"g{k}": k for k in (5, 40, 90, 150, 200, 260, 290, 310)}
    for name, copies in groups.items():
        out += [(n + i, (name + "x" * 100)[:100], "en", rng.choice("ab")) for i in range(copies)]
        n += copies
    out += [(n + i, "huge" + "y" * 96, "en", rng.choice("ab")) for i in range(1250)]
    n += 1250
    out += [(n + i, f"{i}" + "z" * rng.randrange(120), rng.choice(("en", "fr")), rng.choice("ab")) for i in range(4000)]
    docs = spark.createDataFrame(out, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in sharding.shard(docs, shards=16).collect()}
    assert len(got) == len(out)
    sizes = Counter()
    for r in got.values():
        sizes[r["shard"]] += r["size"]
    assert set(sizes) == set(range(16)) and max(sizes.values()) < 1.06 * min(sizes.values())
    shards = {}
    for i, t, *_ in out:
        shards.setdefault(t, set()).add(got[i]["shard"])
    assert all(len(v) == 1 for t, v in shards.items() if t[0] != "h") and 3 <= len(shards["huge" + "y" * 96]) <= 8


def test_shard_stage(spark, docs, none):
    assert mixing.mix_stage(spark, docs, "").columns == docs.columns and sharding.shard_stage(spark, none, "").count() == 0
    assert sharding.shard_stage(spark, docs, "").count() == docs.count()


def test_sharding_is_even(spark):
    many = spark.range(4000).selectExpr("id as doc_id", "repeat('x', cast(id % 97 as int)) || id as text", "'en' as lang", "concat('s', id % 5) as source")
    sizes = Counter()
    for r in sharding.shard(many).collect():
        sizes[r["shard"]] += r["size"]
    assert len(sizes) == 24 and max(sizes.values()) < 1.05 * min(sizes.values())


def test_urls(spark):
    pages = spark.createDataFrame([(1, "http://WWW.Example.com/de/x?q#f"), (2, None), (3, "no scheme"), (4, "https://a.example.net/en/1"), (5, "http://x.org/fr/"), (6, "https://notnet/a"), (7, "http://casino-win.shop.test/win"), (None, "x://a.net"), (8, "http://example.net?x=://y")], "page_id long, url string")
    got = {r["page_id"]: tuple(r)[1:5] for r in urls.classify(pages).collect()}
    assert got[1] == ("www.example.com", "/de/x", "example.com/de/", "block") and got[2][:3] == ("", "", None) and got[3][:2] == ("", "")
    assert got[4][2:] == ("example.net/en/", "allow") and got[5][2:] == ("org/fr/", "allow") and got[6][2] is None and got[7][2:] == (None, "block")
    assert got[None][1:3] == ("", None) and got[8] == ("example.net", "", None, got[8][3])


def test_url_model_learns_its_table():
    b, w = urls.train()
    right = [(b + sum(w[g] for g in urls.grams(h, p)) > 0) == bool(y) for h, p, y in urls.labelled()]
    assert sum(right) / len(right) > 0.98


def test_contamination(spark, docs, none):
    rng = random.Random(1)
    item = "".join(rng.choice("abcdefghij klmnop") for _ in range(200)).strip()
    edited = item[:50] + "Q" + item[51:120] + item[122:]
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "tiny"), (5, "entirely other words that stand nowhere in any of the documents here")], "item_id long, text string")
    more = spark.createDataFrame([(100, "start " + item.upper() + " end"), (101, "x " * 50 + edited + " y" * 9), (102, item[:80]), (103, "a tiny one"), (104, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in contamination.matches(more, bench).collect()}
    assert got == {(100, 1): 0, (101, 1): got[101, 1], (103, 4): 0} and 0 < got[101, 1] <= 3
    assert contamination.matches(none, bench).count() == 0 and contamination.matches(docs, bench.limit(0)).count() == 0


def test_url_model_on_held_out_stems():
    rows = urls.labelled()
    stem = [i // len(urls.HOSTS) for i in range(len(rows))]
    right = []
    for part in range(5):
        b, w = urls.train(tuple(r for r, s in zip(rows, stem) if s % 5 != part))
        right += [(b + sum(w[g] for g in urls.grams(h, p)) > 0) == bool(y) for (h, p, y), s in zip(rows, stem) if s % 5 == part]
    assert sum(right) / len(right) > 0.8


def test_urls_defined_cases(spark):
    pages = spark.createDataFrame([(1, "http://a.info/" + "x" * 50_000, "h", "v"), (1, "http://a.info/" + "x" * 50_000, None, None)], "page_id long, url string, host string, verdict string")
    got = urls.classify(pages).collect()
    assert len(got) == 2 and got[0] == got[1] and got[0]["host"] == "a.info" and len(got[0]["path"]) == 50_001
    assert urls.classify(pages.limit(0)).count() == 0


def fewest_edits(item, doc):
    """Sellers: edits of the best place of item in doc."""
    row = [0] * (len(doc) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(doc, 1):
            new.append(min(row[j - 1] + (c != x), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@pytest.mark.parametrize("seed", range(6))
def test_contamination_against_edit_distance(seed):
    """Every document and item, edited around the budget, in repetitive and varied alphabets."""
    rng = random.Random(seed)
    letters = "ab" if seed % 2 else "abcdefghijklmnopqrstuvwxyz "
    items = ["".join(rng.choice(letters) for _ in range(rng.choice((12, 40, 90, 160)))) for _ in range(4)] + ["a" * 70]
    docs = ["", "a" * 300, "b" * 50]
    for _ in range(14):
        it = list(rng.choice(items))
        for _ in range(rng.randrange(0, contamination.budget(len(it)) + 3)):
            at = rng.randrange(len(it))
            it[at : at + rng.choice((0, 1))] = rng.choice(("", rng.choice(letters), "xy"))
        pad = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
        docs.append(pad() + "".join(it) + pad())
    docs = [contamination.normal(d) for d in docs]
    index = contamination.Index(list(enumerate(items)))
    got = {k: v[0] for k, v in contamination.places(index, docs).items()}
    want = {}
    for d, doc in enumerate(docs):
        for i, (_, item) in enumerate(index.items):
            e = fewest_edits(item, doc)
            if e <= contamination.budget(len(item)):
                want[d, i] = e
    assert got == want and want


def test_contamination_of_a_long_repetitive_text():
    """A 2 MB text of one letter against an item of it: memory follows the text."""
    import resource

    index = contamination.Index([(1, "a" * 600), (2, "ab" * 300)])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    got = contamination.places(index, ["a" * (2 << 20)])
    assert got == {(0, 0): (0, 0, 600)}
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1 << 20


def test_contamination_in_slices_and_stage(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(contamination, "SLICE", 300)
    rng = random.Random(4)
    items = ["".join(rng.choice("abcdefghijk ") for _ in range(100)).strip() for _ in range(6)]
    spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(9, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(1, "x " + items[0], 1), (1, "clean text", 2), (None, items[3], 3), (None, None, 4), (2, "", 5), (3, items[5].upper() + items[1], 6)], "doc_id long, text string, item_id int").repartition(2)
    got = contamination.matches(docs, spark.read.parquet(str(tmp_path / "benchmark.parquet"))).collect()
    assert sorted((str(r["doc_id"]), r["item_id"], r["edits"]) for r in got) == [("1", 0, 0), ("3", 1, 0), ("3", 5, 0), ("None", 3, 0)]
    stage = contamination.decontaminate_stage(spark, docs, str(tmp_path))
    assert stage.columns == docs.columns and sorted(r["item_id"] for r in stage.collect()) == [2, 4, 5]
    assert contamination.decontaminate_stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_pii(spark, none):
    t = "é mail a.b@x.example.com, 10.0.0.1 and 999.1.1.1; 4111 1111 1111 1111 or +1 (555) 010-9999, a@b"
    got = pii.personal_data(spark.createDataFrame([(1, t), (2, None), (3, "")], "doc_id long, text string")).collect()
    one = next(r for r in got if r["doc_id"] == 1)
    assert (one["n_email"], one["n_ip"], one["n_card"], one["n_phone"]) == (1, 1, 1, 1)
    spans = [("email", "a.b@x.example.com"), ("ip", "10.0.0.1"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (555) 010-9999")]
    joined = ",".join(f"{k}:{t.index(s)}:{t.index(s) + len(s)}" for k, s in spans)
    assert one["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest() and one["spans"].startswith(joined[:20])
    empty = hashlib.sha256(b"").hexdigest()
    assert all(r["base_sha256"] == empty and r["spans"] == "" for r in got if r["doc_id"] != 1)
    assert pii.personal_data(none).count() == 0
    found = pii.span_classifier([("phone011", 50), ("phone012", 40), ("phone002", 30), ("phone111", 90)])
    assert found["phone011"] > found["phone002"]


@pytest.mark.parametrize("cued, bare", [(60, 60), (12, 240), (240, 12)])
def test_pii_context_decides(spark, cued, bare):
    base = [f"mail u{i}@x.example.com or +1 (555) 010-{i:04d} here" for i in range(1000)]
    near = [f"my phone {200 + i}-555-{1000 + i} and my ssn {100 + i}-45-{6000 + i} so" for i in range(cued)]
    far = [f"part {200 + i}-555-{1000 + i} then lot {100 + i}-45-{6000 + i} so" for i in range(bare)]
    far += [f"part {100 + i}-555-{1000 + i} so" for i in range(bare // 10)]
    rows = [(k, t) for k, t in enumerate(base + near + far)]
    got = {r["doc_id"]: r["n_added"] for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[k] for k in range(1000, 1000 + cued)} == {2} and {got[k] for k in range(1000 + cued, len(rows))} == {0}


def test_pii_secrets_and_defined_cases(spark):
    rng = random.Random(6)
    token = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = [(1, f'api token = "{token(40)}" here'), (1, f'api token = "{token(40)}" here'), (None, f"secret: {token(32)} x"), (2, f"built from commit {token(40)} today"), (3, "averyveryverylongplainwordwithoutdigits 12345678901234567890123"), (4, None)]
    rows += [(100 + i, f"password {token(32)} and more") for i in range(30)] + [(200 + i, f"the checksum {token(64)} of it") for i in range(60)]
    rows += [(5, "mail a@b.cc " * 20_000 + f"token {token(40)}"), (6, "555-123-4567 " * 20_000)]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, spans string, n_ip int").repartition(3)
    got = pii.personal_data(df).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert len(got) == len(rows) and [r["n_secret"] for r in by[1]] == [1, 1] and by[None][0]["n_secret"] == 1 and by[2][0]["n_secret"] == 0 and by[3][0]["n_added"] == 0 and by[4][0]["spans"] == ""
    assert all(by[100 + i][0]["n_secret"] == 1 for i in range(30)) and all(by[200 + i][0]["n_secret"] == 0 for i in range(60))
    assert by[5][0]["n_email"] == 20_000 and by[5][0]["n_secret"] == 1


def test_pii_hints_lose_nothing():
    rng = random.Random(8)
    parts = ["a", "at", "DOT", "dot", "x.y", "com", " ", " ", "(", ")", "555", "123-45-6789", "555 123 4567", "-", ".", "[", "]", "é", "0123456789abcdefABCDEF"]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        for kind, loosely in pii.LOOSE.items():
            assert pii.HINTS[kind](t) or not loosely.search(t), (kind, t)


def test_passages(spark):
    rng = random.Random(2)
    w = [f"w{i}" for i in range(400)]
    shared = w[:60]
    docs = [(0, shared + w[100:150]), (1, w[200:230] + shared + w[300:340] + shared[:40]), (2, w[150:190]), (3, [])]
    got = repeats.passages(spark.createDataFrame([(i, i, " ".join(t)) for i, t in docs], "row long, doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [(0, 0, 60), (1, 30, 90), (1, 130, 170)] and rng


def test_embeddings(spark):
    rng = random.Random(2)
    out = []
    for i in range(60):
        v = [rng.gauss(0, 1) for _ in range(8)]
        out += [(3 * i, v, i % 2), (3 * i + 1, [x + rng.gauss(0, 0.12) for x in v], i % 2)]
    out += [(500, out[0][1], 0), (501, None, 0), (502, [0.0] * 8, 0), (503, [float("nan")] * 8, 0), (504, out[0][1], None), (505, [1.0, None], 0), (506, [1.0, 2.0], 0), (507, [2.0, 4.0], 0)]
    df = spark.createDataFrame(out, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in embeddings.link(df).collect()}
    good = {v: (e, lab) for v, e, lab in out if lab is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)}
    for v, (e, lab) in good.items():
        cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
        assert got[v]["n_links"] == sum(u != v and lab == k and len(e) == len(f) and cos(e, f) >= 0.93 for u, (f, k) in good.items()), v
    assert all(got[v]["n_links"] == 0 and got[v]["component_id"] == v for v in (501, 502, 503, 504, 505)) and len(got) == len(out)
    assert embeddings.link(df.limit(0)).count() == 0


def test_quotes(spark):
    said = [(1, 0, "user", "First line.\nSecond thing here"), (1, 1, "assistant", "An answer"), (1, 2, "user", "> second THING here!\nI disagree"), (1, 3, "assistant", "> > First line.\n> I disagree\nWhy?"), (2, 0, None, None), (2, 1, "user", "> nobody said that\nx")]
    got = {(r["conv_id"], r["turn"]): r for r in quotes.conversations(spark.createDataFrame(said, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1, 2]["parent_turn"] == 0 and got[1, 2]["text"] == "I disagree" and got[1, 3]["parent_turn"] == 2 and got[1, 3]["text"] == "Why?" and got[1, 3]["n_quotes"] == 2
    assert got[2, 1]["parent_turn"] == 0 and got[2, 1]["quoted_turn"] is None and got[1, 0]["parent_turn"] is None and [got[1, t]["position"] for t in range(4)] == [0, 1, 2, 3]


def test_nested_quotes_link(spark):
    said = [(1, 0, "a", "The original words"), (1, 1, "b", "A reply to them"), (1, 2, "a", "Something else"), (1, 3, "b", ">> The original words\nonly nested"), (1, 4, "a", "> unknown here\n>> A reply to them\n>>> The original words\nx")]
    got = {r["turn"]: r for r in quotes.conversations(spark.createDataFrame(said, "conv_id long, turn long, role string, text string")).collect()}
    assert (got[3]["parent_turn"], got[3]["quoted_turn"], got[3]["n_quotes"]) == (0, 0, 1)
    assert got[4]["parent_turn"] == 1 and [tuple(x) for x in got[4]["quoted_turns"]] == [(2, 1), (3, 0)] and got[2]["quoted_turns"] is None


def test_conversations_stand_in_reply_order(spark, monkeypatch):
    """Against brute force, with interleaved threads, equal turns and many blocks."""
    monkeypatch.setattr(quotes, "TURNS", 7)
    rng = random.Random(4)
    said, want = [], {}
    for conv in (1, 2, 3):
        parent, own = {}, []
        for turn in range(40):
            parent[turn] = rng.randrange(turn) if turn > 1 and rng.random() < 0.5 and conv < 3 else turn - 1
            own.append((turn, parent[turn] < turn - 1, "a", f"> words of {conv} {parent[turn]}\nwords of {conv} {turn}" if parent[turn] < turn - 1 else f"words of {conv} {turn}"))
            if turn % 9 == 8:
                own.append((turn, False, "b", "beside"))
        own.sort()
        said += [(conv, turn, role, t) for turn, _, role, t in own]
        # a message follows the one before it, or the last one of the turn that it quotes
        replies = {}
        for i, (turn, breaks, _, _) in enumerate(own[1:], 1):
            up = max(k for k, m in enumerate(own) if m[0] == parent[turn]) if breaks else i - 1
            replies.setdefault(up, []).append(i)
        todo, place = [0], 0
        while todo:
            i = todo.pop()
            want[conv, own[i][0], own[i][2]] = place
            place += 1
            todo += replies.get(i, [])[::-1]
    rng.shuffle(said)
    got = quotes.conversations(spark.createDataFrame(said, "conv_id long, turn long, role string, text string")).collect()
    assert {(r["conv_id"], r["turn"], r["role"]): r["position"] for r in got} == want


def test_messages_of_one_turn_have_their_own_links(spark):
    said = [(1, 0, "a", "The first words"), (1, 1, "a", "Second words"), (1, 2, "a", "> The first words\nyes"), (1, 2, "b", "nothing quoted"), (1, 2, "b", "nothing quoted"), (1, None, "z", "Before all"), (1, 3, "a", "> Before all\nso"), (None, None, None, None), (2, 5, "a", "> " * 400 + "deep\n" + "long " * 100_000)]
    rows = spark.createDataFrame([(*m, "x", 1) for m in said], "conv_id long, turn long, role string, text string, position string, parent_turn int").repartition(3)
    got = quotes.conversations(rows).collect()
    assert len(got) == len(said) and sorted(r["position"] for r in got if r["conv_id"] == 1) == list(range(7))
    of = lambda turn, role: [r for r in got if r["conv_id"] == 1 and r["turn"] == turn and r["role"] == role]
    assert [(r["quoted_turn"], r["parent_turn"]) for r in of(2, "b")] == [(None, 1), (None, 1)] and of(2, "a")[0]["quoted_turn"] == 0
    late = of(3, "a")[0]
    assert late["quoted_turn"] is None and late["parent_turn"] is None and late["quoted_turns"] is not None
    assert quotes.conversations(rows.limit(0)).count() == 0


def test_traversal_visits_cells_in_order():
    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(30):
        a, b = rng.integers(0, 9, rng.integers(1, 9)) / 8, rng.integers(0, 9, rng.integers(1, 9)) / 8
        stop = float(rng.random() * 2)
        got = list(embeddings.traverse(a, b, stop))
        assert [x for *_, x in got] == sorted(x for *_, x in got)
        assert {(i, j) for i, j, _ in got} == {(i, j) for i in range(len(a)) for j in range(len(b)) if a[i] + b[j] <= stop} and len(got) == len({g[:2] for g in got})


def test_embedding_recall(spark, monkeypatch):
    """Many cells; all links at a target of 1, at least the target's share below it."""
    import numpy as np

    monkeypatch.setattr(embeddings, "CELL", 20)
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(150, 16))
    x = np.concatenate([centers + rng.normal(scale=s, size=centers.shape) for s in (0.0, 0.12, 0.16, 0.2, 0.24)])
    x[7] *= 1e200
    x[8] *= 1e-200
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(3)
    u = embeddings.unit(x)
    linked = (u @ u.T >= 0.93).sum(axis=1) - 1
    found = {recall: sum(r["n_links"] for r in embeddings.link(df, recall=recall).collect()) for recall in (1.0, 0.95)}
    assert linked.sum() > 400 and found[1.0] == linked.sum() and 0.9 * linked.sum() <= found[0.95] <= linked.sum()


def test_trained_filters_add_to_the_word_odds():
    """Labels that only the order of two common words tells: word odds know nothing of them."""
    import numpy as np

    rng = random.Random(0)

    def sample(n):
        out = []
        for i in range(n):
            w = text(rng, 24).split()
            pair = ["vile", "dog"] if i % 2 else ["dog", "vile"]
            at = rng.randrange(0, 20)
            w[at:at] = pair
            out.append((" ".join(w), i % 2))
        return out

    def accuracy(epochs, monkey):
        monkey.setattr(toxicity, "EPOCHS", epochs)
        train, held = sample(3000), sample(400)
        ids, first = toxicity.features(pa.array([t for t, _ in train]))
        model = toxicity.Model()
        model.fit(ids, np.diff(first), np.array([y for _, y in train]))
        s = model.scores(pa.array([t for t, _ in held]))
        y = np.array([y for _, y in held])
        return max(((s >= c) == y).mean() for c in np.quantile(s, np.linspace(0.05, 0.95, 19)))

    with pytest.MonkeyPatch.context() as monkey:
        assert accuracy(0, monkey) < 0.65 and accuracy(6, monkey) > 0.9


def test_toxicity_stage_and_bounds(spark, docs, none, tmp_path, monkeypatch):
    rng = random.Random(3)
    train = [(i, text(rng, 30) + (" vile" * (i % 4 == 0)) + " end", "en", i % 4) for i in range(400)]
    both = train + [(None, "vile vile words here", "en", 0), (7, "so vile", "fr", 0), (7, "so mild", "fr", 9), (8, None, None, 9), (None, "", None, 9), (9, "mild " * 100_000 + "vile", "en", 0)]
    d = spark.createDataFrame(both, "doc_id long, text string, lang string, score int").repartition(3)
    y = spark.createDataFrame([(r[0], int(r[3] == 0), "x") for r in train], "doc_id long, toxic int, text string")
    y.write.parquet(str(tmp_path / "labels.parquet"))
    got = toxicity.toxicity_stage(spark, d, str(tmp_path))
    kept = got.collect()
    assert got.columns == d.columns and sum(r["score"] == 0 for r in kept) <= 2 and sum(r["score"] > 0 for r in kept) >= 295
    assert [r["text"] for r in kept if r["doc_id"] == 7 and r["lang"] == "fr"] == ["so mild"] and sum(r["score"] == 9 for r in kept) == 3
    assert toxicity.toxicity_stage(spark, d.limit(0), str(tmp_path)).count() == 0
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", -1)
    assert not toxicity.trained(d, y)[0].known


def test_toxicity(spark, docs, none):
    rng = random.Random(3)
    train = [(i, text(rng, 30) + (" vile" * (i % 4 == 0)) + " end", "en", int(i % 4 == 0)) for i in range(400)]
    d = spark.createDataFrame([r[:3] for r in train] + [(None, None, None), (1000, "", "en")], "doc_id long, text string, lang string")
    y = spark.createDataFrame([(r[0], r[3]) for r in train] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(d, y).collect()}
    right = [got[i]["predicted"] == lab for i, _, _, lab in train if got[i]["held_out"]]
    assert len(got) == 402 and sum(right) / len(right) > 0.95 and got[1000]["predicted"] == 0
    assert all(r["score"] == 0 for r in toxicity.score(docs, y.limit(0)).collect()) and toxicity.score(none, y).count() == 0


def test_toxicity_trains_on_every_labelled_row(spark):
    """What only rows behind the first 8000 tell is learnt, however rows are dealt to tasks."""
    from pyspark.sql import functions as F

    ids = spark.range(12_000).withColumnRenamed("id", "doc_id").select("doc_id", F.xxhash64("doc_id").alias("h"), (toxicity.fold() == 0).alias("held"))
    rng = random.Random(2)
    held, known = [], []
    for r in sorted(ids.collect(), key=lambda r: (r["h"], r["doc_id"])):
        (held if r["held"] else known).append(r["doc_id"])
    toxic = {*known[8000::2], *held[::4]}
    d = spark.createDataFrame([(i, text(rng, 6) + " vile" * (i in toxic), "en") for i in held + known], "doc_id long, text string, lang string")
    y = spark.createDataFrame([(i, int(i in toxic)) for i in held + known], "doc_id long, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(d, y).collect()}
    assert len(known) > 9000 and sum(got[i] == (i in toxic) for i in held) >= 0.99 * len(held)
    models = [toxicity.trained(d.repartition(n), y.repartition(n))[0] for n in (1, 7)]
    assert all((a == b).all() for a, b in zip([models[0].emb, *models[0].dense()], [models[1].emb, *models[1].dense()]))


def test_toxicity_of_a_text_in_pieces(monkeypatch):
    import numpy as np

    rng = random.Random(4)
    texts = [text(rng, n) for n in (0, 1, 2, 3, 40, 0, 7)]
    ids, first = toxicity.features(pa.array(texts))
    model = toxicity.Model()
    whole = model.peaks(ids, first)
    best, y, _ = model.pooled(ids, first)
    for d, (a, b) in enumerate(zip(first, first[1:])):
        for k in range(best.shape[1]):
            if np.isfinite(best[d, k]):
                assert whole[1][d, k] == a + int(np.argmax(y[a:b, k])) and whole[0][d, k] == best[d, k]
    for piece in (1, 2, 5, 30):
        monkeypatch.setattr(toxicity, "PIECE", piece)
        parts = model.peaks(ids, first)
        assert np.allclose(parts[0], whole[0], atol=1e-5)
        for d, k in zip(*np.nonzero(np.isfinite(best))):
            assert abs(y[parts[1][d, k], k] - best[d, k]) < 1e-5


def test_a_cluster_must_name_its_shared_folder():
    from shelfmark.llm import scratch

    class Conf:
        get = staticmethod(lambda *_: None)

    class Context:
        master = "spark://head:7077"
        getConf = staticmethod(lambda: Conf)

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Session)


def test_very_long_texts(spark):
    """Two texts of 300,000 words that differ in one, through the operators that read whole texts."""
    rng = random.Random(1)
    long = [f"w{rng.randrange(50_000)}" for _ in range(300_000)]
    other = [*long[:1000], "changed", *long[1001:]]
    docs = spark.createDataFrame([(1, " ".join(long), "en", "a"), (2, " ".join(other), "en", "a"), (3, "short", None, None)], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs).collect()}
    assert got[1]["component_id"] == got[2]["component_id"] == 1 and got[1]["n_shingles"] > 290_000 and not got[2]["kept"]
    mixed = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    assert mixed[1]["size"] == 300_000 and abs(mixed[1]["taken"] + mixed[2]["taken"] - mixed[1]["target"]) <= 0.5
    assert {r["doc_id"]: r["size"] for r in sharding.shard(docs, shards=2).collect()} == {1: len(" ".join(long)) + 8, 2: len(" ".join(other)) + 8, 3: 13}
    cut = {r["doc_id"]: r for r in repeats.remove_repeats(docs).collect()}
    assert cut[1]["n_words"] == 300_000 and cut[1]["n_removed"] == cut[2]["n_removed"] == 299_999
    item = spark.createDataFrame([(7, " ".join(long[200_000:200_030])), (8, "nothing of the kind here")], "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in contamination.matches(docs, item).collect()) == [(1, 7), (2, 7)]


def test_clashing_columns(spark):
    rows = [(1, [1.0, 0.0], 1, 9, 9, True), (2, [1.0, 0.001], 1, 9, 9, False), (2, [1.0, 0.001], 1, 9, 9, False), (None, [1.0, 0.0], 1, 9, 9, None)]
    got = embeddings.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n_links int, component_id int, kept boolean")).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in got) == [("1", 2, "1", True), ("2", 2, "1", False), ("2", 2, "1", False), ("None", 0, "None", True)]
