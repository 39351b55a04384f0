"""Rows that every operator must cope with."""

from pyspark.sql import functions as F


def edge_docs(spark):
    """Null and empty texts, white space, a very long text and one very long word, repeated rows, a null doc_id, clashing columns."""
    long = " ".join(f"word{i % 977} of number {i}" for i in range(4000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, long), (5, "x" * 3000), (6, "The same row. Licensed under the MIT License."), (6, "The same row. Licensed under the MIT License."), (7, long), (None, "no id here"), (9, "Ünï çödé 漢字 😀 ▁▁  two  spaces ")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    clashing = ("score", "labels", "n_words", "slot", "tag", "u", "node", "fingerprint", "out", "rest", "n_tokens", "length", "component_id")
    return docs.withColumns({c: F.lit("own") for c in clashing} | {"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("bigint")})


def words(draw, n, vocabulary=400):
    return [f"w{draw.randrange(vocabulary)}" for _ in range(n)]
