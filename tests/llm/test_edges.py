"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from meshlake.llm import chat, decontaminate, imatch, langid, ngram_join, packing, quality, sharding, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, sig long, n long, kid long, h long, toxicity_score double, part int, good int, toxic int"
LONG = " ".join(f"wort{i % 7000}" for i in range(30_000))


def rows():
    base = [(1, "the cat sat on the mat and the dog ran off", "en"), (2, None, "en"), (3, "", None), (4, LONG, "de"), (4, LONG, "de"), (5, "!!! 123", "en"), (6, "le chat est sur la table", "fr"), (None, "the cat sat on the mat and the dog ran off", "en"), (None, None, None), (7, "   \n\t ", "fr"), (8, "eins", "de"), (8, "zwei drei", "de")]
    return [(i, t, lang, None if i in (6, None) else "s", 3, 0.5, "k", 1, 2, 3, 4, 0.1, 1, 1, 0) for i, t, lang in base]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 1), (6, 1, 0), (6, 1, 1), (None, 1, 1), (8, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "the cat sat on the mat and the dog ran off"), (2, None), (3, ""), (None, "nobody has this text")], "item_id long, text string")


def test_toxicity(docs, empty, labels, spark):
    model = toxicity.fit_toxicity(docs, labels)
    out = toxicity.score_toxicity(docs, model, ["doc_id", "text"]).collect()
    assert len(out) == 12 and all(0 <= r["toxicity_score"] <= 1 for r in out)
    assert len({r["toxicity_score"] for r in out if not (r["text"] or "").strip()}) == 1
    assert toxicity.score_toxicity(empty, toxicity.fit_toxicity(empty, labels), ["doc_id"]).count() == 0
    none = toxicity.fit_toxicity(docs, labels.where("false"))
    assert all(r["toxicity_predicted"] == 0 for r in toxicity.score_toxicity(docs, none, ["doc_id"]).collect())


def test_quality(docs, empty, labels):
    out = quality.score_quality(docs, quality.fit_quality(docs, labels), docs.columns).collect()
    assert len(out) == 12 and all(0 <= r["quality_score"] <= 1 for r in out)
    assert quality.score_quality(empty, quality.fit_quality(empty, labels), ["doc_id"]).count() == 0
    none = quality.fit_quality(docs, labels.where("false"))
    assert {r["quality_score"] for r in quality.score_quality(docs, none, ["doc_id"]).collect()} == {0.5}


def test_language(docs, empty):
    out = langid.predict_language(docs, langid.fit_langid(docs), ["doc_id", "text"]).collect()
    assert len(out) == 12
    assert all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) for r in out)
    assert langid.predict_language(empty, langid.fit_langid(empty), ["doc_id"]).count() == 0
    assert {r["lang_pred"] for r in langid.predict_language(docs, langid.fit_langid(empty), ["doc_id"]).collect()} == {"und"}


def test_ngram_join(docs, empty):
    out = ngram_join.ngram_components(docs).collect()
    assert len(out) == 12
    by = {r["doc_id"]: r for r in out if r["doc_id"] not in (None, 8)}
    assert by[2]["n_shingles"] == 0 and by[2]["component_id"] == 2 and by[7]["component_id"] == 7
    assert sorted(r["component_id"] for r in out if r["doc_id"] is None and r["n_shingles"]) == [1]
    assert ngram_join.ngram_components(empty).count() == 0


def test_decontamination(docs, empty, benchmark):
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, benchmark).collect()}
    assert found == {(1, 1), (None, 1)}
    kept = decontaminate.drop_leaks(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == 10
    assert decontaminate.find_leaks(empty, benchmark).count() == 0
    assert decontaminate.drop_leaks(docs, benchmark.where("false")).count() == 12


def test_imatch(docs, empty):
    out = imatch.edited_fingerprints(docs).collect()
    assert len(out) == 12
    by_text = {}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect() if r["doc_id"] not in (None, 8)}
    for r in out:
        if r["doc_id"] in texts:
            assert by_text.setdefault(texts[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
            assert r["n_chars"] == len(texts[r["doc_id"]])
    assert imatch.edited_fingerprints(empty).count() == 0


def test_packing(docs, empty):
    p = packing.PackParams(_tokenizer(), length=64)
    out = packing.pack(docs, p).collect()
    assert sum(r["doc_tokens"] for r in out if r["start"] == 0) == sum(r["length"] for r in out)
    assert packing.pack(empty, p).count() == 0


def _tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_sharding(docs, empty):
    out = sharding.assign_shards(docs, sharding.ShardParams(limit=100)).collect()
    assert len(out) == 12
    size, n = {}, {}
    for r in out:
        size[r["shard"]] = size.get(r["shard"], 0) + r["bytes"]
        n[r["shard"]] = n.get(r["shard"], 0) + 1
    assert all(size[s] <= 100 or n[s] == 1 for s in size)
    assert sharding.assign_shards(empty).count() == 0


def test_warc(spark):
    schema = "page_id long, url string, html string, path string, folder string, digest string"
    pages = spark.createDataFrame([(1, "http://a", "x", "p", "f", "d"), (2, None, None, "", "", ""), (3, "http://c d\r\n", "", None, None, None), (4, "u", "x", "", "", ""), (4, "u", "x", "", "", ""), (None, "u", "x", "", "", "")], schema)
    got = warc.read_archives(warc.write_archives(pages)).where("kind = 'record'").collect()
    assert sorted((r["record_id"], r["record_type"], r["payload_bytes"]) for r in got) == sorted([("<urn:page:1>", "revisit", 1), ("<urn:page:2>", "revisit", 0), ("<urn:page:3>", "response", 0), ("<urn:page:4>", "response", 1), ("<urn:page:4>", "response", 1), ("<urn:page:>", "revisit", 1)])
    assert warc.read_archives(warc.write_archives(pages.where("false"))).count() == 0


def test_chat(spark):
    schema = "conv_id long, turn long, role string, text string, block long, name string, size long"
    conv = spark.createDataFrame([(1, 0, "system", "be kind", 1, "", 1), (1, 1, "ann", "hi", 1, "", 1), (1, 1, "bob", None, 1, "", 1), (1, None, "", "?", 1, "", 1), (None, 0, "ann", "lost", 1, "", 1), (2, 0, "SYSTEM", "alone", 1, "", 1), (1, 2, "ann", "bye", 1, "", 1), (1, 2, "ann", "bye", 1, "", 1)], schema)
    out = chat.rotate(conv)
    assert {(r["conv_id"], r["perspective"]) for r in out.collect()} == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann")}
    for r in chat.join_turns(out, 1000).collect():
        turns = sorted((x for x in out.collect() if (x["conv_id"], x["perspective"]) == (r["conv_id"], r["perspective"])), key=lambda x: x["seq"])
        assert r["text"] == "".join(t["rendered"] for t in turns)
        assert [r["text"][a:b] for a, b in r["spans"]] == [r["text"][t["content_start"] : t["content_end"]] for t in turns if t["mask"]]
        assert all(t["chat_role"] == ("system" if t["rendered"].startswith("<|im_start|>system") else "assistant" if "<|im_start|>assistant" in t["rendered"] else "user") for t in turns)
    assert chat.rotate(conv.where("false")).count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, docs, empty, labels, benchmark, tmp_path, name, stage):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    out = stage(spark, docs, str(tmp_path))
    n = out.count()
    if name != "packing":
        assert out.columns == docs.columns and n <= 12
    if name == "near_duplicates":
        assert n == 11  # the repeated row goes; rows without an id stay
    assert stage(spark, empty, str(tmp_path)).count() == 0
