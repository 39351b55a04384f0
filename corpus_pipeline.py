"""A training corpus from documents: language ID, near copies, repeated passages, packing.

STAGES are applied one after another; each reads all that the one before kept and all but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import langid, packing, simhash, substring_dedup
from quire.llm.common import remove, scratch

#: Shingles of the near-copy stage, in words.
SHINGLE = 5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns the languages of the labelled documents and drops those without any letter (null and empty texts too).

    Where no label says anything of a language, nothing can be told and only such documents go. Repeated rows are judged each for itself.
    """
    model = langid.fit(docs.where(~langid.held_out()))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    told = langid.identify(docs, model)
    return told.where(F.col("lang_pred") != langid.UNDETERMINED).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each component of near copies (five-word shingles, similarity 0.8 or more).

    SimHash fingerprints link first, through Golay-code keys and verified on the shingle sets; the rarest shingles find what they miss.
    Null and wordless texts are one group; a row that repeats another goes; rows without doc_id stay, once for each text.
    """
    return simhash.dedup(docs, shingle=SHINGLE)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages of 35 words and more that stand more than once out of all texts; n_chars follows."""
    out = substring_dedup.remove_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' words into sequences; one row per piece. A text without words is its end alone; ties go by doc_id."""
    return packing.pack(docs.select("doc_id", packing.word_count(F.col("text")).alias("length")))


STAGES = [("language ID", language_id), ("near copies", near_copies), ("repeated passages", repeated_passages), ("packing", packed)]

#: SQL expresses neither a trained classifier nor best fit; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents, each written as Parquet in the shared folder and read again."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name.replace(" ", "_"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            remove(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
