"""SQL over a vault: eight views, and a runner that reads nothing else."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import history, listing, structure
from quire.sources.vault import Vault

VIEWS = ("files", "folders", "frontmatter", "sections", "links", "properties", "commits", "authors")


def register(spark: SparkSession, vault: Vault) -> dict[str, DataFrame]:
    """Registers the views and returns their DataFrames; what isn't asked for isn't computed."""
    found = structure.structure(vault.files)
    all_links = structure.links(found, vault.files)
    records = listing.file_records(vault.files, structure.counters(found, all_links))
    commits = vault.commits if vault.commits is not None else vault.files.select("file_id", "path", "version", "author", "content")
    views = {
        "files": records, "folders": listing.folder_records(records), "frontmatter": found.where("frontmatter is not null").select("path", F.col("frontmatter").alias("data")),
        "sections": structure.sections(found), "links": all_links, "properties": structure.properties(found), "commits": history.history(commits), "authors": history.file_authors(commits),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return views


def run(spark: SparkSession, statement: str, args: list | dict | None = None) -> DataFrame:
    """One reading statement over the views; parameters as ? or :name."""
    text = statement.strip().rstrip(";").strip()
    if ";" in re.sub(r"'(?:[^']|'')*'|\"[^\"]*\"", "", text):
        raise ValueError("one statement at a time")
    if not re.match(r"(?is)^(select|with|values|from|describe|explain)\b", text):
        raise ValueError("only reading statements")
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    named = {n.strip("`").lower() for n in re.findall(r"UnresolvedRelation \[([^\]]+)\]", plan.toString())}
    local = {m.lower() for m in re.findall(r"(?is)(?:with|,)\s+(\w+)(?:\s*\([^)]*\))?\s+as\s*\(", text)}
    if hidden := named - set(VIEWS) - local:
        raise ValueError(f"no such view: {', '.join(sorted(hidden))}")
    return spark.sql(text, args=args)


def table(df: DataFrame, width: int = 60, rows: int = 1000) -> str:
    """Rows as aligned text, cells cut to width."""
    def cell(v) -> str:
        s = "" if v is None else str(v)
        return s if len(s) <= width else s[: width - 1] + "…"

    body = [[*df.columns], *([cell(v) for v in r] for r in df.limit(rows).collect())]
    wide = [max(map(len, c)) for c in zip(*body, strict=True)]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, wide, strict=True)).rstrip() for r in body)


def tsv(df: DataFrame) -> DataFrame:
    """One text column: tab-separated values, tabs, line feeds and backslashes escaped, null empty."""
    cells = [F.replace(F.replace(F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n")) for c in df.columns]
    return df.select(F.concat_ws("\t", *cells).alias("line"))
