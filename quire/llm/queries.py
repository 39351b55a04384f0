"""One query per operator over its whole table, with the DuckDB equivalents that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import chroma, embedding_dedup, langid, license_scan, packing, sentencepiece_codec, sharding, simhash, substring_dedup, url_filter
from quire.llm.common import documents

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def _model(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@_query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return sentencepiece_codec.encode(docs, _model("piece_bpe_32k.model"), digests=True).drop("text")


@_query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components_of(documents(spark, sf_dir))


@_query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return substring_dedup.remove_repeats(docs, digest=True).select("doc_id", "n_words", "n_removed", "kept_sha256")


@_query
def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.fit(docs.where(~langid.held_out()))
    return langid.identify(docs.select("doc_id", "text", langid.held_out().alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


@_query
def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@_query
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(documents(spark, sf_dir).select("doc_id"))


ORACLES["op6_sharding"] = sharding.oracle()


@_query
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_filter.judge(pages.select("page_id", "url"), links=url_filter.aliases(pages)).select("page_id", "host", "path", "rule", "verdict")


ORACLES["op8_url_filter"] = url_filter.oracle()


@_query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir).select("doc_id", packing.word_count(F.col("text")).alias("length")))


@_query
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


@_query
def op3_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no recordings; the bytes of each document's text are taken as 8-bit samples."""
    return chroma.fingerprint_and_align(documents(spark, sf_dir), media="text")
