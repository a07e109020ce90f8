"""The operators against brute force, round trips and held-out accuracy."""

import base64
import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlake.llm import decontaminate, langid, latent, ngram_join, packing, quality, sharding, toxicity, warc
from meshlake.llm.common import crc_mod

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{D}/documents.parquet")


def words(rng, n):
    return [rng.choice("abcdefghij") + rng.choice("klmnopqrst") + rng.choice("uvwxyz") for _ in range(n)]


def brute_components(texts, k, percent):
    sets = {}
    for i, t in texts.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w)} if 0 < len(w) < k else {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    up = {i: i for i in texts}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {i: (len(sets[i]), root(i)) for i in texts}


@pytest.mark.parametrize("seed,k,percent,common", [(1, 4, 85, 32), (2, 5, 80, 4), (3, 4, 85, 3), (4, 3, 70, 5)])
def test_join_equals_brute_force(spark, seed, k, percent, common):
    rng = random.Random(seed)
    passage, texts = words(rng, 40), {}
    for family in range(12):
        base = words(rng, rng.choice([6, 12, 30, 90, 200])) + (passage if family % 2 else [])
        for _ in range(rng.choice([1, 4, 16])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                w[rng.randrange(len(w))] = words(rng, 1)[0]
            texts[len(texts) * 3] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = ngram_join.ngram_components(df, ngram_join.JoinParams(words=k, percent=percent, common_key=common)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(texts, k, percent)


def test_candidates_recall(spark, docs):
    items = spark.read.parquet(f"{D}/benchmark.parquet").where("item_id < 12")
    some = docs.where("doc_id % 4 = 0")
    every = decontaminate.find_leaks(some, items, decontaminate.LeakParams(cosine=-2.0)).collect()
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(some, items).collect()}
    want = {(r["doc_id"], r["item_id"]) for r in every}
    assert found <= want and len(found) >= 0.9 * len(want)


def test_paraphrase_is_found(spark, docs):
    rng = random.Random(5)
    item = spark.read.parquet(f"{D}/benchmark.parquet").where("item_id = 0").first()["text"].split()
    host = words(rng, 300)
    kept = [w for i, w in enumerate(item) if i % 6 != 2]
    planted = spark.createDataFrame([(10_000, " ".join(host[:150] + kept + host[150:])), (10_001, " ".join(host))], "doc_id long, text string")
    both = docs.select("doc_id", "text").where("doc_id % 2 = 0").unionByName(planted)
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(both, spark.read.parquet(f"{D}/benchmark.parquet")).collect()}
    assert (10_000, 0) in found and not any(i == 10_001 for i, _ in found)


def test_items_in_a_third_of_the_rows_are_found(spark):
    rng = random.Random(8)
    items = [words(rng, 40) for _ in range(3)]
    texts = [words(rng, 120) for _ in range(120)]
    for i in range(40):  # whole copies and copies inside other text
        texts[i] = items[0] if i < 20 else texts[i][:50] + items[0] + texts[i][50:]
    planted = {(i, 0) for i in range(40)} | {(119, 1)}
    texts[119][30:30] = items[1]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, benchmark).collect()} == planted
    assert {r["doc_id"] for r in decontaminate.drop_leaks(docs, benchmark).collect()} == set(range(40, 119))


def test_paraphrases_near_the_limit_are_candidates(spark, docs):
    rng = random.Random(11)
    some = docs.select("doc_id", "text").where("doc_id % 4 = 1 and n_chars < 3000")
    items = spark.read.parquet(f"{D}/benchmark.parquet").where("item_id < 20")
    pool = [w for r in some.orderBy("doc_id").collect() if r["text"] for w in r["text"].split()]
    planted = []
    for r in items.orderBy("item_id").collect():
        for k, percent in enumerate((30, 35, 40, 45)):
            w = r["text"].split()
            for i in rng.sample(range(len(w)), len(w) * percent // 100):
                w[i] = rng.choice(pool)
            host = rng.choices(pool, k=80)
            planted.append((10_000 + 10 * r["item_id"] + k, " ".join(host[:40] + w + host[40:])))
    both = some.unionByName(spark.createDataFrame(planted, "doc_id long, text string"))
    every, found = ({(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(both, items, p).collect()} for p in (decontaminate.LeakParams(cosine=-2.0), None))
    assert len(every) > 60 and found == every


def test_common_subsequence():
    def plain(a, b):
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, j in itertools.product(range(len(a)), range(len(b))):
            t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        return t[-1, -1]

    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice("abcde") for _ in range(rng.randrange(1, 70))] for _ in range(2))
        assert decontaminate.common_subsequence(decontaminate.places(a), len(a), b) == plain(a, b)


def test_randomised_basis_spans_the_leading_vectors(spark):
    rng = np.random.default_rng(0)
    dense = ((rng.random((60, 40)) < 0.2) * rng.random((60, 40))).astype(np.float32)
    rows = [(np.flatnonzero(r).astype(np.int32).tobytes(), r[r > 0].tobytes()) for r in dense]
    v = latent.randomised_basis(spark.createDataFrame(rows, "f binary, w binary"), 40, 10, 6, 1)
    exact = np.linalg.svd(dense)[2][:10].T
    assert np.linalg.norm(dense @ v) == pytest.approx(np.linalg.norm(dense @ exact), rel=0.02)


def test_pages_round_trip(spark):
    pages = spark.read.parquet(f"{D}/pages.parquet")
    got = {r["page_id"]: r for r in warc.op3_warc(spark, D).collect()}
    for r in pages.collect():
        body = (r["html"] or "").encode()
        assert got[r["page_id"]]["payload_bytes"] == len(body)
        assert got[r["page_id"]]["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()


def member(i, body=b"hello"):
    return warc.gzip_member(warc.record(i, f"http://e/{i}", body, warc.payload_digest(body)), 6)


def test_salvage_recovers_later_records():
    parts = [member(i, bytes([65 + i]) * 200) for i in range(5)]
    broken = bytearray(parts[1])
    broken[len(broken) // 2] ^= 0xFF
    data = b"junk" + parts[0] + bytes(broken) + parts[2] + parts[3][: len(parts[3]) // 2] + parts[4]
    found = list(warc.salvage(data))
    assert [r[3]["warc-record-id"] for r in found if r[0] == "record"] == ["<urn:page:0>", "<urn:page:2>", "<urn:page:4>"]
    assert sum(r[2] - r[1] for r in found) == len(data)
    assert [r[0] for r in found] == ["gap", "record", "gap", "record", "gap", "record"]


def test_long_urls_are_read_back(spark):
    url = "data:text/html," + "x" * 100_000
    pages = spark.createDataFrame([(1, url, "a"), (2, "http://b", "b"), (3, url + "y", "a")], "page_id long, url string, html string")
    got = warc.read_archives(warc.write_archives(pages)).collect()
    assert sorted((r["kind"], r["record_id"], r["url"], r["record_type"]) for r in got) == [("record", "<urn:page:1>", url, "revisit"), ("record", "<urn:page:2>", "http://b", "response"), ("record", "<urn:page:3>", url + "y", "response")]


def test_headers_end_before_the_next_record():
    good = warc.record(1, "u", b"one", warc.payload_digest(b"one"))
    found = list(warc.salvage(good[: good.index(b"Content-Type")] + good))
    assert [r[0] for r in found] == ["gap", "record"] and found[0][3] == "headers do not end"


def test_salvage_plain_records_and_wrong_digest():
    good = warc.record(1, "u", b"one", warc.payload_digest(b"one"))
    wrong = warc.record(2, "u", b"two", warc.payload_digest(b"other"))
    found = list(warc.salvage(good + wrong + good))
    assert [r[0] for r in found] == ["record", "gap", "record"] and found[1][3] == "payload digest differs"


def test_windows_are_full_and_in_proportion():
    rng = np.random.default_rng(2)
    for totals, targets in (([5000, 300, 7], None), ([40, 40, 1000], [1, 1, 2]), ([9], [0]), (rng.integers(1, 4000, 9).tolist(), None)):
        totals = np.array(totals)
        phases = packing.plan_windows(totals, totals if targets is None else np.array(targets), 64, 16)
        assert sum((p.table.sum(0) * p.repeat for p in phases), np.zeros(len(totals), int)).tolist() == totals.tolist()
        assert all((p.table >= 0).all() for p in phases)
        full = [s for p in phases for s in p.table.sum(1)]
        tail = [s for s in full if s != 64]
        assert all(s & (s - 1) == 0 for s in tail) and sum(tail) < 64
        for s in range(len(totals)):
            pieces = packing.cut(0, int(totals[s]), s, packing.Plan(phases))
            assert [x[0] for x in pieces] == np.cumsum([0, *[x[1] for x in pieces]])[:-1].tolist() and sum(x[1] for x in pieces) == totals[s]


def test_every_token_is_packed_once(spark, docs):
    path = packing_path()
    p = packing.PackParams(path)
    out = packing.pack(docs, p).toPandas()
    assert (out.sort_values(["doc_id", "start"]).groupby("doc_id").apply(lambda g: (g.start.to_numpy() == np.concatenate([[0], np.cumsum(g.length.to_numpy())])[:-1]).all() and g.length.sum() == g.doc_tokens.iloc[0], include_groups=False)).all()
    by = out.sort_values(["sequence_id", "offset"])
    assert (by.groupby("sequence_id").length.cumsum() - by.length == by.offset).all()
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    texts = [r["text"] for r in docs.limit(40).collect()] + ["hello <|endoftext|> world", "<|endoftext|> x", "a\r\n\tb  ", "日本語 🙂"]
    assert [x.tolist() for x in packing.encode(texts, path, 1)] == [[*slow.encode(t, add_special_tokens=False).ids, 1] for t in texts]


def test_more_sources_than_queues(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(words(rng, rng.randrange(1, 40))), None if i % 23 == 5 else f"s{i % 23}" if i % 3 else "big") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    out = packing.pack(docs, packing.PackParams(packing_path(), length=64, max_sources=4)).toPandas()
    for _, g in out.sort_values(["doc_id", "start"]).groupby("doc_id"):
        assert (g.start == g.length.cumsum() - g.length).all() and g.length.sum() == g.doc_tokens.iloc[0]
    by = out.sort_values(["sequence_id", "offset"])
    assert out.doc_id.nunique() == 300 and (by.groupby("sequence_id").length.cumsum() - by.length == by.offset).all()


def packing_path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_shards_are_minimal(spark, docs):
    out = sharding.assign_shards(docs, sharding.ShardParams(limit=20_000)).toPandas()
    by = out.groupby("shard").bytes.agg(["sum", "count"])
    assert ((by["sum"] <= 20_000) | (by["count"] == 1)).all()
    for s in by.index:  # every split was needed: the parent holds too much
        if s:
            assert out[out["shard"].str.startswith(s[:-1])].bytes.sum() > 20_000


def test_hot_key_is_split(spark):
    df = spark.createDataFrame([(7, "x" * 100)] * 50, "doc_id long, text string")
    out = sharding.assign_shards(df, sharding.ShardParams(limit=1000)).groupBy("shard").agg(F.sum("bytes").alias("b")).collect()
    assert sum(r["b"] for r in out) == 50 * 116 and all(r["b"] <= 1000 for r in out)


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(4)
    emit, first, step = rng.standard_normal((5, 3)), rng.standard_normal(3), rng.standard_normal((3, 3))
    weight = {}
    for y in itertools.product(range(3), repeat=3):
        weight[y] = np.exp(first[y[0]] + sum(emit[i, y[i]] for i in range(3)) + sum(step[y[i], y[i + 1]] for i in range(2)))
    want = np.array([[sum(w for y, w in weight.items() if y[i] == c) for c in range(3)] for i in range(3)]) / sum(weight.values())
    got = langid.forward_backward(emit, np.array([0, 3, 5]), first, step)
    assert got[:3] == pytest.approx(want)
    pairs = langid.expected_pairs(emit[:3], np.array([0, 3]), first, step, np.array([0, 1]))
    exact = sum(np.array([[sum(w for y, w in weight.items() if y[i] == a and y[i + 1] == b) for b in range(3)] for a in range(3)]) for i in range(2)) / sum(weight.values())
    assert pairs == pytest.approx(exact)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    lang = langid.op9_langid(spark, d).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    good = quality.op8_quality(spark, d).join(labels, "doc_id").where("held_out").agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0]
    assert lang > 0.97 and good > 0.9


def test_code_switched_words_are_told_apart(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit_langid(docs)
    en, de = (docs.where(F.col("lang") == x).where("n_chars between 200 and 900").orderBy("doc_id").first()["text"].replace("\n", " ").split()[:12] for x in ("en", "de"))
    words_, marginal = model.label_words(" ".join(en + de))
    best = [model.languages[i] for i in marginal.argmax(1)]
    assert best[:8].count("en") >= 7 and best[-8:].count("de") >= 7


def test_language_is_learned_from_whole_texts(spark):
    rng = random.Random(9)
    header = " ".join(words(rng, 150))
    own = {lang: ["".join(rng.choice(letters) for _ in range(6)) for _ in range(80)] for lang, letters in (("aa", "abcdefg"), ("bb", "tuvwxyz"))}
    rows = [(2 * i + k, f"{header} {' '.join(rng.choices(own[lang], k=600))}", lang) for i in range(30) for k, lang in enumerate(own)]
    model = langid.fit_langid(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.predict([" ".join(own["aa"][:40]), " ".join(own["bb"][:40])])[0] == ["aa", "bb"]
    long = "a" * 60
    assert langid.word_features(f"{long}xyz{long}", {}) != langid.word_features(long + "abc" + long, {})


def test_nnpu_separates(spark):
    rng = np.random.default_rng(0)
    doc = lambda bad: np.unique(np.concatenate([rng.integers(100, 400, 20), rng.integers(0, 5, 2) if bad else np.zeros(0, int)]))
    positive, mixed = [doc(True) for _ in range(200)], [doc(rng.random() < 0.15) for _ in range(600)]
    rows = [(True, False, x.tolist()) for x in positive] + [(False, True, x.tolist()) for x in mixed]
    p = toxicity.ToxicityParams()
    feature = toxicity.choose_features(spark.createDataFrame(rows, "confirmed boolean, drawn boolean, features array<int>"), 200, 600, p)
    places = lambda docs: [np.searchsorted(feature, np.intersect1d(x, feature)) for x in docs]
    model = toxicity.nnpu_fit(places(positive), places(mixed), 0.15, p, feature)
    weight = dict(zip(model.feature, model.weight, strict=True))
    score = lambda d: model.bias + sum(weight.get(x, 0) for x in d)
    assert np.mean([score(doc(True)) > 0 for _ in range(100)]) > 0.8 and np.mean([score(doc(False)) > 0 for _ in range(100)]) < 0.1


def test_folds(spark):
    got = [r[0] for r in spark.range(50).select(crc_mod("id", 5)).collect()]
    import zlib

    assert got == [zlib.crc32(str(i).encode()) % 5 for i in range(50)]
