"""Whole queries and stages against plain Python versions, and draws at the ends of their range."""

import base64
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from meshlake.llm import common, decontaminate, imatch, langid, latent, ngram_join, packing, quality, toxicity, warc
from tests.llm.test_operators import D, brute_components, packing_path, words

TERM = re.compile(r"[^\W_]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{D}/documents.parquet")


def test_draws_reach_far_below_one_in_a_million(spark):
    rows = spark.range(4_000_000)
    n = rows.where(common.below_fraction(["id"], 2e-6, 1)).count()
    assert 1 <= n <= 30
    least = common.below_fraction(["id"], 1e-9, 1)
    assert "0 AS BIGINT" not in str(least) and rows.where(least).count() <= 2
    assert rows.where(common.below_fraction(["id"], 0.25, 1)).count() == pytest.approx(1_000_000, rel=0.01)


def test_one_id_with_most_rows_does_not_fill_the_sample(spark):
    hot = spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    same = spark.range(100_000).select(F.lit(8).cast("long").alias("doc_id"), F.lit("one and the same").alias("text"))
    drawn = common.bounded_rows(hot.unionByName(same), 500, 3)
    assert drawn.where("doc_id = 7").count() < 500 and drawn.where("doc_id = 8").count() <= 1


def test_imatch_query(spark, docs):
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect())
    got = {r["doc_id"]: r for r in imatch.op5_imatch(spark, D).collect()}
    assert len(got) == len(rows)
    for (i, text), (j, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        k = len(text) // 4
        edited = text[: len(text) - k] + following[:k]
        r = got[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(alike(r["fingerprint"], r["edited_fingerprint"]))
        assert r["near_next"] == pytest.approx(alike(r["fingerprint"], got[j]["fingerprint"]))
    by_text = {}
    for i, text in rows:
        assert by_text.setdefault(text, got[i]["fingerprint"]) == got[i]["fingerprint"]
    long = [r for r in got.values() if r["n_chars"] > 500]
    assert np.mean([r["near_edited"] for r in long]) > np.mean([r["near_next"] for r in long]) + 0.3


def alike(a, b, each=6):
    """Likeness of two fingerprints from their text alone."""
    if a == b:
        return 1.0
    if not (a.startswith("i:") and b.startswith("i:")):
        return 0.0
    pairs = list(zip(a[2:].split("."), b[2:].split("."), strict=True))
    share = lambda some: (sum(x == y for x, y in some) / len(some)) if some else None
    used = lambda some: [p for p in some if p != ("-", "-")]
    rates = [used(pairs[k : k + each]) for k in range(0, len(pairs), each)]
    best = [share(r) for r in rates if len(r) >= 3]
    return max(best) if best else share(used(pairs)) or 0.0


def test_lexicon_band(spark, docs):
    p = imatch.IMatchParams(least_share=0.02, most_share=0.2)
    texts = {r["text"] or "" for r in docs.collect()}
    df = {}
    for t in texts:
        for w in {w for w in re.split(r"[^\w]|_", t.lower()) if w}:
            df[w] = df.get(w, 0) + 1
    found = {r["term"]: r["frequent"] for r in imatch.lexicon(imatch.distinct_texts(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), p), p).collect()}
    low, high = 0.02 * len(texts), 0.2 * len(texts)
    want = {w: n > high for w, n in df.items() if n >= low}
    assert len(found.keys() ^ want.keys()) <= 0.01 * len(want) and all(found[w] == want[w] for w in found.keys() & want.keys())


def test_warc_query_with_repeats(spark, tmp_path):
    pages = spark.read.parquet(f"{D}/pages.parquet")
    again = pages.select((F.col("page_id") + 10_000).alias("page_id"), "url", "html").where("page_id % 3 = 0")
    empty = spark.createDataFrame([(20_000, "u", None), (20_001, "v", ""), (20_002, None, "é" * 10)], "page_id long, url string, html string")
    pages.select("page_id", "url", "html").unionByName(again).unionByName(empty).write.parquet(f"{tmp_path}/pages.parquet")
    rows = {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet(f"{tmp_path}/pages.parquet").collect()}
    last = {}
    for i, body in sorted(rows.items()):
        last[body] = i
    got = warc.op3_warc(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        body = rows[r["page_id"]]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if last[body] == r["page_id"] else ("revisit", last[body]))
    assert sum(r["record_type"] == "revisit" for r in got) >= again.count()


def test_packing_query(spark, docs):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(packing_path())
    ids = {r["doc_id"]: [*slow.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in docs.collect()}
    out = packing.op6_packing(spark, D).toPandas()
    for doc, g in out.sort_values("start").groupby("doc_id"):
        x = np.array(ids[doc], "<u4")
        assert g.length.sum() == len(x) and (g.doc_tokens == len(x)).all()
        assert [zlib.crc32(x[s : s + n].tobytes()) for s, n in zip(g.start, g.length, strict=True)] == g.ids_crc32.tolist()
    size = out.groupby("sequence_id").length.sum()
    rest = size[size != 2048]
    assert ((rest & (rest - 1)) == 0).all() and rest.sum() < 2048
    # every full window has each source in its share, to a token a window
    of = {r["doc_id"]: r["source"] for r in docs.collect()}
    out["source"] = out["doc_id"].map(of)
    total = out.groupby("source").length.sum()
    by = out.groupby(["sequence_id", "source"]).length.sum().unstack(fill_value=0).loc[size[size == 2048].index]
    assert (abs(by.cumsum() - np.outer(np.arange(1, len(by) + 1), total / total.sum() * 2048)) < 2048 * 0.05 + 2 * len(total)).to_numpy().mean() > 0.8


def test_added_tokens_and_numbers_that_are_no_letters(spark):
    assert packing.encode(["hello <|endoftext|> world"], packing_path(), 1)[0].tolist() == [31373, 220, 50256, 995, 1]
    docs = spark.createDataFrame([(i, "some plain words here", "en") for i in range(4)] + [(9, "½ ² ③ 12", "en")], "doc_id long, text string, lang string")
    model = langid.fit_langid(docs)
    assert model.predict(["½ ² ③", "a½", "Ⅷ"])[0] == ["und", "en", "und"]


def test_language_of_a_document_is_that_of_its_words(spark, docs):
    model = langid.fit_langid(docs)
    some = [r["text"] for r in docs.where("text is not null").limit(30).collect()]
    names, scores = model.predict(some)
    for text, name, score in zip(some, names, scores, strict=True):
        found, marginal = model.label_words(text)
        total = marginal.sum(0)
        assert (name, score) == (("und", 0.0) if not found else (model.languages[int(total.argmax())], pytest.approx(total.max() / len(found))))


def test_features_of_words_are_those_of_each_word(spark, docs):
    lines = [langid.letter_words((r["text"] or "").lower()) for r in docs.limit(60).collect()]
    found = sorted({w for line in lines for w in line}) + ["a", "é", "ß", "ñandú", "straße", "日本語", "я", "𐐨𐐨", "a𐐨é語", "x" * 300, "ªº"]
    lexicon = {w: i % 3 for i, w in enumerate(found[::4])}
    for some in (found, [w for w in found if w.isascii()], ["a"], []):
        flat, at = langid.features_of_words(some, lexicon)
        assert [flat[a:b].tolist() for a, b in zip(at, at[1:])] == [langid.word_features(w, lexicon) for w in some]


def test_toxicity_scores_are_sums_of_weights(spark, docs):
    labels = spark.read.parquet(f"{D}/labels.parquet")
    model = toxicity.fit_toxicity(docs, labels)
    weight = dict(zip(model.feature.tolist(), model.weight.tolist(), strict=True))
    some = [r["text"] for r in docs.limit(40).collect()]
    want = [1 / (1 + np.exp(-np.clip(model.bias + sum(weight.get(x, 0.0) for x in toxicity.document_features(t).tolist()), -30, 30))) for t in some]
    assert model.score(some) == pytest.approx(want)


def test_toxicity_features_are_hashes_of_words_and_beginnings():
    for w in ("a", "abcde", "abcdef", "abcdefg", "überaus", "größer", "naïveté", "日本語日本語日本"):
        want = [zlib.crc32(b"w" + w.encode())] + [zlib.crc32(b"p" + w[:k].encode()) for k in (5, 6) if len(w) > k]
        assert toxicity.word_features(w) == tuple(x % (1 << toxicity.BITS) for x in want)


def test_toxicity_learns_from_all_rows(spark, monkeypatch):
    """Beyond the 6,000 confirmed and 12,000 other rows once drawn, every distinct row counts in each step, summed in tasks or on the driver."""
    word = F.concat(F.when(F.col("id") % 3 == 0, "foul").otherwise("mild"), F.translate((F.col("id") % 50).cast("string"), "0123456789", "abcdefghij"))
    docs = spark.range(21_000).select((F.col("id") - F.when(F.col("id") >= 20_500, 500).otherwise(0)).alias("doc_id"), word.alias("text"))
    docs = docs.unionByName(docs.where("doc_id < 100"))
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic")).where("doc_id < 20000").distinct()
    descend, seen = toxicity.nnpu_descend, []

    def spy(sums, *rest):
        seen.append(sums(np.zeros(len(rest[-1])), 0.0)[:, 2].tolist())
        return descend(sums, *rest)

    monkeypatch.setattr(toxicity, "nnpu_descend", spy)
    p = toxicity.ToxicityParams(steps=4)
    here = toxicity.fit_toxicity(docs, labels, p)
    monkeypatch.setattr(toxicity, "DRIVER_ENTRIES", 0)
    there = toxicity.fit_toxicity(docs, labels, p)
    rows = docs.distinct()
    assert seen == [[rows.where("doc_id % 3 = 0 and doc_id < 20000").count(), rows.count()]] * 2 and seen[0][1] > 20_000
    assert (here.weight == there.weight).all() and here.bias == there.bias


def test_positive_unlabelled_gradient():
    """The fit lowers the estimator's risk, and a second fit is the same."""
    rng = np.random.default_rng(1)
    p = toxicity.ToxicityParams(l2=0.0)
    pos = [np.unique(rng.integers(0, 30, 6)) for _ in range(60)]
    unl = [np.unique(rng.integers(0, 30, 6) if rng.random() < 0.2 else rng.integers(20, 60, 6)) for _ in range(200)]
    model = toxicity.nnpu_fit(pos, unl, 0.2, p, np.arange(60))

    def risk(w, b):
        z = lambda docs: np.array([w[d].sum() + b for d in docs])
        return 0.2 * np.logaddexp(0, -z(pos)).mean() + max(0.0, np.logaddexp(0, z(unl)).mean() - 0.2 * np.logaddexp(0, z(pos)).mean())

    assert risk(model.weight, model.bias) < 0.5 * risk(np.zeros(60), np.log(0.25))
    assert (toxicity.nnpu_fit(pos, unl, 0.2, p, np.arange(60)).weight == model.weight).all()


def test_quality_votes_are_those_of_all_neighbours(spark, docs):
    labels = spark.read.parquet(f"{D}/labels.parquet")
    model = quality.fit_quality(docs, labels)
    some = [r["text"] for r in docs.limit(60).collect()] + [None, ""]
    x = model.project(some)
    for row, score in zip(x, model.score(some), strict=True):
        sim = model.vectors @ row
        order = sorted(range(len(sim)), key=lambda i: (-sim[i], i))[: model.params.neighbours]
        w = np.maximum(sim[order], 1e-3) ** model.params.power
        assert score == pytest.approx((w * model.label[order]).sum() / w.sum(), abs=1e-4)
    sim = np.array([[0.5, 0.9, 0.5, 0.5, 0.1], [0.2, 0.2, 0.2, 0.2, 0.2]], np.float32)
    assert [sorted(r) for r in quality.nearest(sim, 3).tolist()] == [[0, 1, 2], [0, 1, 2]]


def test_cosines_are_cosines(spark, docs):
    found = decontaminate.find_leaks(docs, spark.read.parquet(f"{D}/benchmark.parquet"), decontaminate.LeakParams(cosine=0.0), candidates_only=True)
    assert found.where("cosine > 1 or cosine < 0").count() == 0 and found.count() > 100


def test_runs_rule_out_no_place_that_holds_an_item():
    """Counts by whole runs let every stretch through that holds enough of an item's words, and few others."""
    rng, p = np.random.default_rng(4), decontaminate.LeakParams()
    hashes = rng.integers(1, 3_000, 20_000).astype(np.uint64)
    items = [decontaminate.Item(k, w.tolist(), w[::2].tolist(), w[-8:].tolist()) for k, w in enumerate([hashes[a : a + n] for a, n in ((0, 9), (37, 40), (5_000, 300), (19_990, 10))])]
    witnesses = decontaminate.Witnesses(items, np.ones(decontaminate.SIZE, np.int64), p)
    seen, length = witnesses.find(hashes), np.array([len(i.words) for i in items])
    offset = length // 32 * 16
    slack = length // 4 + 2 * p.block
    held = witnesses.by_run(seen[2], offset + slack, length + slack)
    begin, j = (x.ravel() for x in np.meshgrid(np.arange(0, len(hashes), 7), np.arange(len(items)), indexing="ij"))
    left = begin - rng.integers(0, offset[j] + 1)
    left, right = np.maximum(0, left - slack[j]), np.minimum(len(hashes), np.maximum(0, left + length[j] + slack[j]))
    enough = witnesses.enough(seen, j, left, right)
    assert len(enough) > 20 and held[begin[enough] // 16, j[enough]].all() and held[begin // 16, j].mean() < 0.1


def test_gathered_sums_of_any_size():
    rng = np.random.default_rng(6)
    size = np.concatenate([rng.integers(0, 200, 1_500), [0, 1, 64, 65, 5_000, 0]])
    index, table = rng.integers(0, 50, size.sum()), rng.integers(0, 9, (50, 3)).astype(np.float32)
    start = np.cumsum(size) - size
    want = np.array([table[index[a : a + n]].sum(0) for a, n in zip(start, size, strict=True)])
    assert (latent.gathered_sums(table, index, start, size) == want).all()
    assert latent.gathered_sums(table, index, start[:0], size[:0]).shape == (0, 3)


def test_large_groups_equal_brute_force(spark):
    """A group of near copies, a group of copies and a passage that most texts share, beyond the size of large groups."""
    import random

    rng = random.Random(12)
    passage, base, texts = words(rng, 60), words(rng, 90), {}
    for _ in range(70):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 8])):
            w[rng.randrange(len(w))] = words(rng, 1)[0]
        texts[len(texts)] = " ".join(w)
    for _ in range(50):
        texts[len(texts)] = " ".join([*words(rng, rng.choice([5, 40, 150])), *passage])
    for _ in range(30):
        texts[len(texts)] = "the very same text over and over again"
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    for common_key in (32, 8):
        got = ngram_join.ngram_components(df, ngram_join.JoinParams(words=4, percent=85, common_key=common_key)).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(texts, 4, 85)


def test_stages_keep_what_their_operators_say(spark, docs):
    some = docs.where("doc_id < 120")
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    labels, items = (spark.read.parquet(f"{D}/{n}.parquet") for n in ("labels", "benchmark"))
    rows = some.collect()
    q = quality.fit_quality(some, labels)
    assert ids(stages["quality"](spark, some, D)) == sorted(r["doc_id"] for r, s in zip(rows, q.score([r["text"] for r in rows]), strict=True) if s >= 0.7)
    t = toxicity.fit_toxicity(some, labels)
    assert ids(stages["toxicity"](spark, some, D)) == sorted(r["doc_id"] for r, s in zip(rows, t.score([r["text"] for r in rows]), strict=True) if s < 0.5)
    want = brute_components({r["doc_id"]: r["text"] or "" for r in rows}, 5, 80)
    assert ids(stages["near_duplicates"](spark, some, D)) == sorted(i for i, (_, c) in want.items() if c == i)
    leaks = {r["doc_id"] for r in decontaminate.find_leaks(some, items).collect()}
    assert ids(stages["decontamination"](spark, some, D)) == sorted(r["doc_id"] for r in rows if r["doc_id"] not in leaks)
    packed = stages["packing"](spark, some, D)
    assert packed.select("doc_id").distinct().count() == len(rows)


def test_freed_native_memory_of_the_driver_goes_back(spark):
    """Blocks that the JVM frees between others in use leave its resident memory once shuffles are freed."""
    jvm = spark.sparkContext._jvm
    pid = jvm.java.lang.ProcessHandle.current().pid()

    def resident():
        with open(f"/proc/{pid}/statm") as f:
            return int(f.read().split()[1]) * 4096 / 1e6

    for _ in range(3):
        jvm.System.gc()
    blocks = [jvm.java.util.zip.Deflater() for _ in range(600)]
    for i, b in enumerate(blocks):
        if i % 20:
            b.end()
    jvm.System.gc()
    before = resident()
    common.free_shuffles(spark)
    assert resident() < before - 30
    for b in blocks:
        b.end()


def passage_matrix(texts, weight, idf, block):
    """Rows of all passages: TF-IDF of unit length times the root of the weight."""
    out = []
    for text in texts:
        ids = decontaminate.features_of(common.word_hashes([text], decontaminate.PLAIN)[0])
        for a in range(0, max(1, len(ids) - block), block) if len(ids) else ():
            row = np.bincount(ids[a : a + 2 * block], minlength=decontaminate.SIZE) * idf
            norm = np.sqrt((idf[ids[a : a + 2 * block]] ** 2).sum())
            out.append(row * np.sqrt(weight) / max(norm, 1e-9))
    return np.array(out)


def test_the_basis_of_decontamination_comes_from_every_passage(spark, monkeypatch):
    """More passages than the 8,000 once drawn; a few documents have words of their own."""
    rng, p = np.random.default_rng(3), decontaminate.LeakParams()
    words = [f"w{i}" for i in range(150)]
    texts = [None, "", "one", " ".join(words[:20] * 9)] + [" ".join(rng.choice(words, int(n))) for n in rng.integers(1, 700, 30)]
    idf = np.where(np.arange(decontaminate.SIZE) % 7 == 0, 0, rng.random(decontaminate.SIZE) + 0.1).astype(np.float32)
    a = np.concatenate([passage_matrix(texts[:20], 1.0, idf, p.block), passage_matrix(texts[20:], 64.0, idf, p.block)])
    rows = spark.createDataFrame([(t, 1.0 if i < 20 else 64.0) for i, t in enumerate(texts)], "text string, weight double").repartition(5)
    q = rng.standard_normal((decontaminate.SIZE, 9), dtype=np.float32)
    np.testing.assert_allclose(decontaminate.gram_times(rows, idf, q, p), a.T @ (a @ q), atol=2e-3 * np.abs(a.T @ (a @ q)).max())
    # every passage of the two tables takes part, each table at its weight
    seen = []
    real = decontaminate.gram_times
    monkeypatch.setattr(decontaminate, "gram_times", lambda rows, *rest: seen.append(rows.groupBy("weight").count().collect()) or real(rows, *rest))
    many = spark.range(300).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(600)), lambda x: F.concat(F.lit("v"), F.pmod(F.xxhash64(F.col("id"), x), F.lit(900)).cast("string"))), " ").alias("text"))
    items = spark.range(12).select(F.col("id").alias("item_id"), F.concat(F.lit("item with words of its own "), F.col("id").cast("string")).alias("text"))
    assert decontaminate.find_leaks(many, items).count() == 0
    assert len(seen) == p.rounds and {r["count"] for r in seen[0]} == {300, 12}


def test_nystrom_basis_spans_the_leading_vectors():
    rng = np.random.default_rng(5)
    a = rng.standard_normal((400, 60)) * (0.8 ** np.arange(60))
    basis = latent.nystrom_basis(lambda q: (a.T @ (a @ q)).astype(np.float32), 60, 10, 2, 1)
    _, values, right = np.linalg.svd(a, full_matrices=False)
    assert (np.linalg.norm(a @ basis) ** 2) >= 0.999 * (values[:10] ** 2).sum()
    np.testing.assert_allclose(basis.T @ basis, np.eye(10), atol=1e-3)
