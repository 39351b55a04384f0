"""Vaults: versioned text files as DataFrames, and where they come from."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import paths

#: Texts of these extensions have structure: headings, links, properties.
MARKDOWN = ("md", "markdown")
EXTENSIONS = ("md", "markdown", "mdx", "txt")
SKIPPED = (".git", ".trash", "node_modules")

# The test vault, as SQL that Spark and DuckDB read alike.
_ID = "lpad(cast({} as string), 6, '0')"
PATH = f"'/' || source || '/' || lang || '/d' || {_ID.format('doc_id')} || '.md'"
CONTENT = " || ".join(
    [
        "'---' || chr(10) || 'title: Doc ' || cast(doc_id as string) || chr(10) || 'lang: ' || lang || chr(10) || 'n_chars: ' || cast(n_chars as string)",
        "chr(10) || 'tags: [' || lang || ', ' || source || ']' || chr(10) || 'meta:' || chr(10) || '  even: ' || case when doc_id % 2 = 0 then 'true' else 'false' end || chr(10) || '---' || chr(10)",
        "'# Doc ' || cast(doc_id as string) || chr(10) || text || chr(10) || chr(10)",
        f"'## Links' || chr(10) || 'See [[d' || {_ID.format('doc_id + 1')} || '|next]] and [back](d' || {_ID.format('doc_id - 1')} || '.md).' || chr(10)",
        "'### Notes' || chr(10) || 'Missing [[nowhere-' || cast(doc_id % 7 as string) || ']], [web](https://example.com/' || lang || ').' || chr(10)",
    ]
)


@dataclass
class Vault:
    """Live files (file_id, path, content, version, author, created_at, updated_at) and their log of commits."""

    files: DataFrame
    commits: DataFrame | None = None

    def under(self, folder: str) -> Vault:
        return Vault(self.files.where(paths.under(F.col("path"), folder)), self.commits)


#: A table of fewer bytes than this for each core may be one row group, so its rows are dealt out before Python reads them.
SMALL = 32 << 20


def dealt(df: DataFrame) -> DataFrame:
    """A scan whose rows all cores read, be the table small; a larger one has row groups enough and stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < SMALL * cores else df


def from_documents(spark: SparkSession, sf_dir: str) -> Vault:
    """One markdown file per document; its author is its source."""
    docs = dealt(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars"))
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") * 60)
    return Vault(docs.select(F.col("doc_id").alias("file_id"), F.expr(PATH).alias("path"), F.expr(CONTENT).alias("content"), F.lit(1).cast("bigint").alias("version"), F.col("source").alias("author"), at.alias("created_at"), at.alias("updated_at")))


def from_conversations(spark: SparkSession, sf_dir: str) -> Vault:
    """One file per conversation with a version per turn: the first turns, each on a line of its own."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return Vault(files=turns, commits=versions_of(turns))


def versions_of(turns: DataFrame) -> DataFrame:
    """Commits (file_id, path, version, author, content) of turns (conv_id, turn, role, text)."""
    per_file = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    each = per_file.select(F.col("conv_id").alias("file_id"), F.posexplode("t").alias("i", "x"), "t")
    content = F.array_join(F.transform(F.slice(F.col("t.text"), F.lit(1), F.col("i") + 1), lambda x: F.concat(x, F.lit("\n"))), "")
    return each.select("file_id", F.concat(F.lit("/chat/c"), F.lpad(F.col("file_id").cast("string"), 6, "0"), F.lit(".md")).alias("path"), (F.col("i") + 1).cast("bigint").alias("version"), F.col("x.role").alias("author"), content.alias("content"))


def from_folder(spark: SparkSession, folder: str, prefix: str = "/", extensions=EXTENSIONS, include: str | None = None, exclude: str | None = None) -> DataFrame:
    """(path, content, bytes) of the text files below a folder that Spark can read.

    Folders of version control and trash are left out, as are files with a NUL in their first 8000 bytes. include and
    exclude are glob patterns over the path below the folder.
    """
    root = re.sub(r"/+$", "", folder)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.regexp_extract("path", re.escape(re.sub(r"^\w+:/*", "/", root)) + r"(/.*)$", 1)
    files = found.select(rel.alias("rel"), F.col("content").alias("bytes"))
    files = files.where(~F.exists(F.split("rel", "/"), lambda x: x.isin(*SKIPPED)))
    if extensions:
        files = files.where(paths.ext_of(F.col("rel")).isin(*extensions))
    for pattern, wanted in ((include, True), (exclude, False)):
        if pattern:
            hit = F.substring("rel", 2, 1 << 30).rlike(glob_regex(pattern))
            files = files.where(hit if wanted else ~hit)
    files = files.where(F.locate("00", F.regexp_replace(F.hex(F.substring("bytes", 1, 8000)), "(..)", "$1 ")) == 0)
    at = "" if prefix in ("", "/") else prefix.rstrip("/")
    return files.select(F.concat(F.lit(at), "rel").alias("path"), F.decode("bytes", "UTF-8").alias("content"), "bytes").orderBy("path")


def glob_regex(pattern: str) -> str:
    """A regular expression for a glob: ** crosses folders, * and ? don't."""
    out = re.escape(pattern).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return f"^{out}$"


def upsert(head: DataFrame, incoming: DataFrame, author: str | None = None) -> DataFrame:
    """Outcome of writing incoming (path, content) over head (file_id, path, content, version).

    status is created, updated or unchanged; equal content makes no version.
    """
    old = head.select("path", F.col("version").alias("old"), F.sha2(F.col("content"), 256).alias("root"))
    new = incoming.select("path", "content", F.sha2(F.col("content"), 256).alias("new_root"))
    status = F.when(F.col("old").isNull(), "created").when(F.col("root") == F.col("new_root"), "unchanged").otherwise("updated")
    version = F.coalesce("old", F.lit(0)) + F.when(F.col("root") == F.col("new_root"), 0).otherwise(1)
    return new.join(old, "path", "left").select("path", "content", status.alias("status"), version.cast("bigint").alias("version"), F.lit(author).cast("string").alias("author"))


def export(files: DataFrame, folder: str = "/") -> DataFrame:
    """(path, content) of the live files below a folder, for any writer."""
    return files.where(paths.under(F.col("path"), folder)).select("path", "content")
