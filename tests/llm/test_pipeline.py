"""The stages of corpus_pipeline, one after the other, against brute force."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from shelfmark.llm import contamination
from test_operators import water_fill

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    top = tmp_path_factory.mktemp("tables")
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rng.choice(letters) for _ in range(6))
    items = [" ".join(word() for _ in range(30)) for _ in range(5)]
    rows = []
    for i in range(700):
        body = [word() for _ in range(rng.randrange(10, 90))]
        if i % 7 == 0:
            body[3:3] = ["vile", "words"]
        rows.append((i, " ".join(body), rng.choice(("en", "fr", None)), rng.choice(("s1", "s2", "s3", None)), 0))
    for k, i in enumerate(range(1, 700, 29)):  # near copies, of one word in fifty or fewer
        body = rows[i][1].split()
        rows.append((1000 + k, " ".join(body), "en", "s1", 0))
    for k in range(20):
        rows.append((2000 + k, f"{word()} {word()} {items[k % 5].upper()} {word()}", "en", "s2", 0))
    rows += [(3000, None, None, None, None), (3001, "", "en", "s1", 0), (None, "plain matter here today", "en", "s3", 0), (3002, "  ", "en", None, 0), (3000, None, None, None, None)]
    rng.shuffle(rows)
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, int(i % 7 == 0), 1) for i in range(0, 700)], "doc_id long, toxic int, quality int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return str(top)


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "benchmark_leaks", "mix_sources", "shards"]
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        seen[name] = out.collect()
        if name != "shards":
            assert out.columns == docs.columns
            path = f"{folder}/{name}.parquet"
            out.write.parquet(path)
            docs = spark.read.parquet(path)
    before = spark.read.parquet(f"{folder}/documents.parquet").collect()

    toxic = [r for r in before if "vile words" in (r["text"] or "")]
    left = [r for r in seen["toxicity"] if "vile words" in (r["text"] or "")]
    assert len(left) <= 0.05 * len(toxic) and len(before) - len(seen["toxicity"]) - (len(toxic) - len(left)) <= 0.02 * len(before)

    rows = sorted({(r["doc_id"], r["text"]) for r in seen["toxicity"] if r["doc_id"] is not None}, key=lambda r: r[0])
    sets, stays = {i: shingles(t) for i, t in rows}, []
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, _ in rows:
        for j in stays:
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                up[max(find(i), find(j))] = min(find(i), find(j))
        stays.append(i)
    want = Counter(i for i in sets if find(i) == i)
    want[None] = 1
    assert Counter(r["doc_id"] for r in seen["near_duplicates"]) == want

    items = [contamination.normal(r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    clean = [r["doc_id"] for r in seen["near_duplicates"] if not any(item in contamination.normal(r["text"]) for item in items)]
    assert Counter(r["doc_id"] for r in seen["benchmark_leaks"]) == Counter(clean) and len(clean) <= len(seen["near_duplicates"]) - 5

    size = lambda r: len((r["text"] or "").split())
    sources = sorted({r["source"] for r in seen["benchmark_leaks"]}, key=lambda s: (s is None, s or ""))
    sizes = [sum(size(r) for r in seen["benchmark_leaks"] if r["source"] == s) for s in sources]
    for s, target in zip(sources, water_fill(sizes, (3, 1, 2), 1.5, 2)):
        taken = sum(size(r) for r in seen["mix_sources"] if r["source"] == s)
        assert abs(taken - target) <= 0.1 * target
    times = Counter(r["doc_id"] for r in seen["mix_sources"])
    assert max(times.values()) <= 2 and times[3000] == times[3001] == 1

    assert Counter(r["doc_id"] for r in seen["shards"]) == times
    weight = Counter()
    for r in seen["shards"]:
        weight[r["shard"]] += r["size"]
    assert len(weight) == 24 and max(weight.values()) - min(weight.values()) <= 2500
    for s in weight:
        assert sorted(r["slot"] for r in seen["shards"] if r["shard"] == s) == list(range(sum(r["shard"] == s for r in seen["shards"])))


def test_run_gives_the_last_stage_and_reruns_agree(spark, folder):
    one, two = (corpus_pipeline.run(spark, folder) for _ in range(2))
    assert dict(one.dtypes)["slot"] == "bigint" and sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


CONTRACTS = {
    "op1_toxicity": "doc_id bigint, held_out boolean, score double, predicted int", "op2_near_duplicates": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op3_url_filter": "page_id bigint, host string, path string, rule string, verdict string", "op5_repeated_passages": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op6_personal_data": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string", "op7_embedding_links": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op8_kd_shards": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int", "op10_mix_sources": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
}


@pytest.mark.parametrize("name", CONTRACTS)
def test_columns_of_the_queries(spark, folder, tmp_path, name):
    from shelfmark.llm.queries import QUERIES

    for table in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{table}.parquet").limit(30).write.parquet(f"{tmp_path}/{table}.parquet")
    spark.createDataFrame([(1, "http://a.net/x", "")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(1, [1.0, 2.0], 1), (2, [2.0, 4.0], 1)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = dict(QUERIES[name](spark, str(tmp_path)).dtypes)
    want = dict(c.split(" ") for c in CONTRACTS[name].split(", "))
    assert {c: got.get(c) for c in want} == want
    assert list(got)[: len(want)] == list(want)
