"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from karyoloom.llm import (crf_language, disclosure, latent_decontam, line_dedup, lookup_shards, mixing, projection_dedup, token_store, toxicity,
                           vantage_simhash)
from karyoloom.llm.queries import END_ID, TOKENIZER

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, _id string, _tie int, _row double, spans string, score string, "
          "size date, _takes int, block int, label string")
LONG = " ".join(f"wort{k % 977} the of" for k in range(20_000))
SAID = "und der die das ist nicht ein zug fährt heute nach norden"
TEXTS = [
    (1, "the cat sat on the mat and saw a dog", "en", "a"), (2, None, "en", "a"), (3, "", None, "b"), (4, " \t\n ", "de", None),
    (5, LONG, "en", "b"), (6, SAID, "de", "a"), (7, SAID, "de", "a"), (None, "the cat sat on the mat and saw a dog", "en", None),
    (8, "write to ann.lee@mail.example or +1 (456) 555-2186 now", None, "b"), (9, "12345 !!! ###", None, None), (1, "the same id with another text", "en", "a"),
    (10, SAID, "de", "c"), (10, SAID, "de", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    extra = ("x", 3, 0.5, "s", "t", datetime.date(2020, 1, 1), 1, 2, "l")
    rows = [(i, t, lang, s, len(t) if t else None, *extra) for i, t, lang, s in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "the cat sat on the mat and saw a dog"), (2, None), (3, ""), (None, "a sentence that stands nowhere at all")],
                                 "item_id bigint, text string")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_tokens(spark, docs, empty):
    store = token_store.write_store(docs, TOKENIZER, END_ID)
    got = token_store.read_documents(store, docs, "doc_id").collect()
    # rows with equal ids, null too, are all found by their id
    assert sorted((r.doc_id for r in got), key=str) == sorted((i for i, *_ in TEXTS), key=str)
    assert min(r.n_tokens for r in got) == 1
    assert len({r.start for r in got}) == len(got)
    assert store.fetch(spark.createDataFrame([(77,)], "k bigint"), "k").count() == 0
    assert [r.doc_id for r in store.fetch(spark.createDataFrame([(77,), (None,)], "k bigint"), "k").collect()] == [None]
    none = token_store.write_store(empty, TOKENIZER, END_ID)
    assert token_store.read_documents(none, docs, "doc_id").count() == 0


def test_placement(docs, empty):
    placed = lookup_shards.place(docs, ["x", "y", "z"], size=101)
    assert placed.count() == len(TEXTS) and placed.filter("shard is null").isEmpty()
    assert placed.groupBy("doc_id").agg(F.countDistinct("shard").alias("n")).filter("n > 1").isEmpty()
    assert lookup_shards.place(empty, ["x"], size=101).count() == 0


def test_language(docs, empty):
    field = crf_language.train_field(docs, F.lit(True))
    got = crf_language.predict(docs, field).select("doc_id", "text", "lang_pred", "score").collect()
    assert len(got) == len(TEXTS)
    for r in got:
        blank = not any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == blank and 0 <= r.score <= 1 and (not blank or r.score == 0)
    assert {r.lang_pred for r in got if r.text == SAID} == {"de"}
    assert crf_language.predict(empty, field).count() == 0
    assert crf_language.train_field(empty, F.lit(True)) is None
    assert {r.lang_pred for r in crf_language.predict(docs, None).collect()} == {"und"}


def test_mix(docs, empty):
    got = mixing.mix(docs, block_words=4).collect()
    assert len(got) == len(TEXTS)
    assert sorted(r["size"] for r in got) == sorted(len(words(t)) for _, t, *_ in TEXTS)
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    made = mixing.mix_documents(docs, block_words=4)
    assert made.columns == docs.columns
    assert sum(len(words(r.text)) for r in made.collect()) == sum(r.taken for r in got)
    assert mixing.mix(empty).count() == 0 and mixing.mix_documents(empty).count() == 0


def test_leaks(docs, empty, benchmark):
    found = latent_decontam.leaks(docs, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1, 1), (None, 1)}
    kept = latent_decontam.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == len(TEXTS) - 2
    assert latent_decontam.leaks(empty, benchmark).count() == 0
    assert latent_decontam.decontaminate(docs, benchmark.limit(0)).count() == len(TEXTS)


def test_toxicity(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (5, 7)], "doc_id bigint, toxic int")
    got = toxicity.score(docs, labels, lambda c: F.lit(True)).collect()
    assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(empty, labels, lambda c: F.lit(True)).count() == 0
    alone = toxicity.score(docs, labels.filter("toxic = 0"), lambda c: F.lit(True))
    assert {r.score for r in alone.collect()} == {0.0}


def test_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v), (2, [2.0, 4.0, 6.0]), (3, v), (4, None), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 0.0]), (7, [float("nan"), 1.0, 0.0]), (8, [1.0]), (9, []),
            (None, v), (10, [-3.0, 0.0, 1.0]), (10, v), (11, [1e200, 2e200, 3e200]), (12, [float("inf"), 1.0, 1.0])]
    table = spark.createDataFrame([(i, x, 0, "c") for i, x in rows], "vec_id bigint, embedding array<double>, cls int, vec string")
    got = projection_dedup.near_duplicates(table).collect()
    assert len(got) == len(rows)
    group = [r for r in got if r.n_links > 0]
    # five equal vectors, one scaled copy, one that is larger by far
    assert len(group) == 6 and all(r.n_links == 5 and r.component_id == 1 for r in group)
    assert sum(r.kept for r in group) == 1
    alone = [r for r in got if r.n_links == 0]
    assert all(r.component_id == r.vec_id and r.kept for r in alone)
    assert projection_dedup.near_duplicates(table.limit(0)).count() == 0


def test_simhash(docs, empty):
    got = vantage_simhash.near_duplicates(docs).collect()
    assert len(got) == len(TEXTS)
    zero = [r for r in got if r.fp == 0]
    assert len(zero) == 3 and {r.component_id for r in zero} == {2}
    assert {r.component_id for r in got if r.id in (6, 7)} == {6}
    assert {r.component_id for r in got if r.id is None} == {1}
    kept = vantage_simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 1, 2, 5, 6, 8, 9]
    assert vantage_simhash.near_duplicates(empty).count() == 0 and vantage_simhash.keep_one(empty).count() == 0


def test_similar_documents(docs, empty):
    got = vantage_simhash.similar_documents(docs).collect()
    assert len(got) == len(TEXTS)
    assert {r.component_id for r in got if r.id in (6, 7)} == {6}
    kept = vantage_simhash.keep_similar(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 1, 2, 5, 6, 8, 9]
    assert vantage_simhash.similar_documents(empty).count() == 0 and vantage_simhash.keep_similar(empty).count() == 0


def test_sanitise(docs, empty):
    got = disclosure.sanitise(docs).collect()
    assert len(got) == len(TEXTS)
    mail = next(r for r in got if r.doc_id == 8)
    assert mail.text == "write to [EMAIL] or [PHONE] now" and [s.kind for s in mail.spans] == ["email", "phone"]
    assert all(r.spans == [] for r in got if r.doc_id != 8)
    assert disclosure.sanitise(empty).count() == 0


def test_lines(docs, empty):
    got = line_dedup.drop_shared_lines(docs, min_docs=3).collect()
    assert len(got) == len(TEXTS)
    # four rows have the sentence; those with equal ids and texts are one document
    assert all(r.n_dropped == 1 and r.text == "" for r in got if r.doc_id in (6, 7, 10))
    assert all(r.n_dropped == 0 for r in got if r.doc_id not in (6, 7, 10))
    assert next(r for r in got if r.doc_id == 2).n_lines == 1
    assert line_dedup.drop_shared_lines(empty).count() == 0


def test_pipeline_stages(spark, docs, empty, benchmark, tmp_path):
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    for start in (docs, empty):
        df = start
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, df, str(tmp_path))
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns, name
            path = f"{tmp_path}/{start is docs}-{name}"
            out.write.parquet(path)
            df = spark.read.parquet(path)
        assert (df.count() > 0) == (start is docs)


def test_documents_of_many_shared_lines(spark):
    import time
    n = 200_000
    text = "\n".join(f"line {k}" if k % 3 else f"own {k}" for k in range(n))
    docs = spark.range(12).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 10, F.lit(text)).otherwise(F.lit("line 1\nx\n\nline 2")).alias("text")).repartition(4).cache()
    docs.count()
    began = time.time()
    got = {r.doc_id: r for r in line_dedup.drop_shared_lines(docs, min_docs=11).select("doc_id", "n_lines", "n_dropped", "text").collect()}
    assert time.time() - began < 60                                # with a scan of all dropped lines for each line it takes many minutes
    assert (got[0].n_lines, got[0].n_dropped) == (n, 2) and (got[11].n_lines, got[11].n_dropped, got[11].text) == (4, 2, "x\n")
    got = line_dedup.drop_shared_lines(docs, min_docs=10).filter("doc_id = 3").first()
    assert (got.n_lines, got.n_dropped, got.text) == (n, n, "")
