"""The registered queries of the operators, with production parameters over whole tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from emberfield.llm import bpe, centroids, embed_dedup, html_text, licenses, line_dedup, mixing, ngram_join, quality, token_records, toxicity, url_filter, whitening


def vocabulary() -> str:
    """The path of the byte-level vocabulary, a parameter of the token operators."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(_table(spark, sf_dir, "documents"), vocabulary())


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_table(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return html_text.extract(pages, html_text.fit(pages))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.quality(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(_table(spark, sf_dir, "documents"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup_digest(_table(spark, sf_dir, "documents"))


def op10_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records.token_records(_table(spark, sf_dir, "documents"), vocabulary())


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), url_filter.rule_table(spark))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_bpe_encode_decode,
        op2_source_mixing,
        op3_html_text,
        op4_license_scan,
        op5_quality_rules,
        op6_ngram_jaccard_join,
        op7_embedding_near_dedup,
        op8_toxicity,
        op9_line_dedup,
        op10_token_records,
        op11_embedding_whitening,
        op12_url_filter,
        op13_centroid_clustering,
    )
}

ORACLES: dict[str, str] = {
    "op4_license_scan": licenses.LICENSES_SQL,
    "op6_ngram_jaccard_join": ngram_join.NGRAM_JOIN_SQL,
    "op7_embedding_near_dedup": embed_dedup.EMBED_DEDUP_SQL,
    "op9_line_dedup": line_dedup.LINE_DEDUP_SQL,
    "op12_url_filter": url_filter.URL_FILTER_SQL,
    "op13_centroid_clustering": centroids.clusters_sql(),
}
