"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for every operator and stage."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from emberfield.llm import bpe, embed_dedup, html_text, licenses, line_dedup, mixing, ngram_join, quality, token_records, toxicity

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def odd_labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 1, 0), (4, 0, 1), (5, None, None), (None, 1, 1), (6, 0, 1), (6, 0, 1)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "op1": lambda d, y: bpe.token_digests(d, PATH),
    "op4": lambda d, y: licenses.scan(d),
    "op5": lambda d, y: quality.quality(d, quality.fit(d, y)),
    "op6": lambda d, y: ngram_join.ngram_join(d),
    "op8": lambda d, y: toxicity.toxicity(d, toxicity.fit(d, y)),
    "op9": lambda d, y: line_dedup.dedup_lines(d),
    "op10": lambda d, y: token_records.token_records(d, PATH),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_input_row(name, odd_docs, odd_labels):
    out = OPERATORS[name](odd_docs, odd_labels)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out.select("doc_id").collect())
    assert got == sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in odd_docs.select("doc_id").collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(name, odd_docs, odd_labels):
    assert OPERATORS[name](odd_docs.limit(0), odd_labels.limit(0)).count() == 0


def test_mixing_odd_and_empty(odd_docs):
    out = mixing.mix(odd_docs)
    assert {r["doc_id"] for r in out.select("row.doc_id").collect()} == {r["doc_id"] for r in odd_docs.select("doc_id").collect()}
    assert out.select("row.*").columns == odd_docs.columns
    assert mixing.mix(odd_docs.limit(0)).count() == 0
    assert mixing.mix(odd_docs.filter("doc_id in (1, 2)")).count() == 2  # no tokens at all


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", None, "x"), (None, None, "<p>a&amp;b", "x"), (2, "u", "", "x"), (2, "u", "", "x"), (3, "u", "<p>" + "w " * 300_000, "x")], "page_id long, url string, html string, text string")
    rows = html_text.extract(pages, html_text.fit(pages)).collect()
    assert sorted(r["n_chars"] for r in rows) == [0, 0, 0, 3, 599_999]
    assert html_text.extract(pages.limit(0), html_text.fit(pages.limit(0))).count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [3.0, 0.1]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]), (None, [0.0, 1.0]), (None, [0.0, 1.0])]
    vectors = spark.createDataFrame([(*r, 1, 1) for r in rows], "vec_id long, embedding array<float>, uid int, size int")
    got = sorted(((r["vec_id"] or 99, r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.near_duplicates(vectors).collect()), key=str)
    want = [(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), *[(i, 0, i, True) for i in range(3, 10)], (99, 1, None, True), (99, 1, None, True)]
    assert got == sorted(want, key=str)
    assert embed_dedup.near_duplicates(vectors.limit(0)).count() == 0


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages(k, spark, odd_docs, odd_labels, tmp_path):
    odd_labels.write.parquet(f"{tmp_path}/labels.parquet")
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, odd_docs, str(tmp_path))
    if k < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == odd_docs.columns
    rows = out.agg(F.count("*"), F.count_distinct("doc_id")).first()
    assert rows[0] >= 1 and rows[1] >= 1
    assert stage(spark, odd_docs.limit(0), str(tmp_path)).count() == 0
