"""Listings and folder totals.

A folder's figures are sums over the files below it. Joining folders to descendants by path range would compare all
with all; every file is exploded to its ancestors instead, so that totals are one hash aggregate with partial sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import paths, text

SORTS = {"name": "name", "type": "ext", "size": "nbytes", "lines": "nlines", "words": "nwords", "versions": "versions", "created": "created_at", "updated": "updated_at", "authors": "nauthors"}
SUMS = ("nbytes", "nlines", "nwords", "nsections", "nprops", "nlinks", "nlinks_broken", "versions")
RECORD = ("path", "name", "kind", "version", "nbytes", "nlines", "updated_at", "updated_by", "id", "dir", "depth", "ext", "title", "nwords", "nsections", "nprops", "nlinks", "nlinks_broken", "versions", "created_at", "files", "folders", "nauthors", "authors")
AUTHORS = "array<struct<author:string,commits:bigint,first_ts:timestamp,last_ts:timestamp>>"


def measured(files: DataFrame) -> DataFrame:
    """files with the counts that their content gives."""
    return files.withColumns({"nbytes": text.nbytes(F.col("content")), "nlines": text.nlines(F.col("content")), "nwords": text.nwords(F.col("content"))})


def file_records(files: DataFrame, structure: DataFrame | None = None, authors: DataFrame | None = None) -> DataFrame:
    """Listing records of files.

    structure: (file_id, title, nsections, nprops, nlinks, nlinks_broken); authors: (file_id, authors). Without
    them the counts are 0 and the author is that of the file.
    """
    own = measured(files)
    if structure is not None:
        own = own.join(structure, "file_id", "left")
    if authors is not None:
        own = own.join(authors, "file_id", "left")
    else:
        one = F.array(F.struct(F.coalesce("author", F.lit("")).alias("author"), F.col("version").alias("commits"), F.col("created_at").alias("first_ts"), F.col("updated_at").alias("last_ts")))
        own = own.withColumn("authors", one)
    p, zero = F.col("path"), lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") if c in own.columns else F.lit(0).cast("bigint")
    made = {
        "name": paths.name_of(p), "kind": F.lit("file"), "updated_by": F.col("author"), "id": F.col("file_id"), "dir": paths.dir_of(p), "depth": paths.depth_of(p), "ext": paths.ext_of(p),
        "title": F.col("title") if "title" in own.columns else F.lit(None).cast("string"), "versions": F.col("version"), "files": F.lit(None).cast("bigint"), "folders": F.lit(None).cast("bigint"),
        "nauthors": F.size("authors").cast("bigint"), "authors": F.col("authors").cast(AUTHORS),
    } | {c: zero(c) for c in ("nsections", "nprops", "nlinks", "nlinks_broken")}
    return own.withColumns(made).select(*RECORD)


def folder_records(records: DataFrame) -> DataFrame:
    """Listing records of all folders that hold the files of records, the root included."""
    each = records.select("path", "updated_at", "updated_by", "created_at", *SUMS, F.col("authors.author").alias("who"), F.explode(paths.ancestors(F.col("path"))).alias("folder"))
    totals = each.groupBy("folder").agg(*[F.sum(c).cast("bigint").alias(c) for c in SUMS], F.count(F.lit(1)).alias("files"), F.max("updated_at").alias("updated_at"), F.max_by("updated_by", F.struct("updated_at", "path")).alias("updated_by"), F.min("created_at").alias("created_at"))
    names = each.select("folder", F.explode("who").alias("who")).groupBy("folder").agg(F.count_distinct("who").alias("nauthors"))
    below = totals.select("folder").where("folder <> '/'").select(F.explode(paths.ancestors(F.col("folder"))).alias("folder")).groupBy("folder").agg(F.count(F.lit(1)).alias("folders"))
    p = F.col("folder")
    out = totals.join(names, "folder", "left").join(below, "folder", "left").withColumns({
        "path": p, "name": paths.name_of(p), "kind": F.when(p == "/", "root").otherwise("folder"), "version": F.lit(None).cast("bigint"), "id": F.lit(None).cast("bigint"), "dir": paths.dir_of(p), "depth": paths.depth_of(p),
        "ext": F.lit(None).cast("string"), "title": F.lit(None).cast("string"), "folders": F.coalesce("folders", F.lit(0)).cast("bigint"), "nauthors": F.coalesce("nauthors", F.lit(0)).cast("bigint"), "authors": F.lit(None).cast(AUTHORS),
    })
    return out.select(*RECORD)


def listing(records: DataFrame) -> DataFrame:
    """Files and folders, without the root."""
    return records.unionByName(folder_records(records).where("kind = 'folder'"))


def ls(records: DataFrame, folder: str = "/", recursive: bool = False) -> DataFrame:
    """What stands in a folder, by name; with recursive all below it, by path."""
    below = lambda df: df.where(paths.under(F.col("path"), folder))
    every = below(listing(below(records)))  # files elsewhere have no folder there
    return every.orderBy("path") if recursive else every.where(F.col("dir") == (folder.rstrip("/") or "/")).orderBy("name")


def entry(records: DataFrame, path: str) -> DataFrame:
    """The record of one file or folder, or of the root."""
    folders = folder_records(records.where(paths.under(F.col("path"), path)))
    return records.where(F.col("path") == path).unionByName(folders.where(F.col("path") == path))


def page(records: DataFrame, folder: str = "/", sort: str = "name", descending: bool = False, recursive: bool = False, name: str | None = None, author: str | None = None, ext: str | None = None, kind: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """One page of a listing with total, the number of rows that match; folders come first unless recursive."""
    found = ls(records, folder, recursive)
    for want, test in ((name, lambda: F.lower("name").rlike(_glob(name))), (ext, lambda: F.col("ext") == ext), (kind, lambda: F.col("kind") == kind), (author, lambda: F.exists("authors", lambda a: a["author"] == author))):
        if want is not None:
            found = found.where(test())
    total = found.agg(F.count(F.lit(1)).alias("total"))
    key = F.lower(F.col("name")) if sort == "name" else F.col(SORTS[sort])
    order = [*([] if recursive else [F.when(F.col("kind") == "folder", 0).otherwise(1)]), key.desc_nulls_last() if descending else key.asc_nulls_last(), F.col("path")]
    return found.orderBy(*order).offset(offset).limit(min(limit, 1000)).join(F.broadcast(total))


def _glob(pattern: str) -> str:
    import re

    if not re.search(r"[*?]", pattern):
        return re.escape(pattern.lower())
    return "^" + re.escape(pattern.lower()).replace(r"\*", ".*").replace(r"\?", ".") + "$"


def tree(records: DataFrame, folder: str = "/", depth: int = 2) -> DataFrame:
    """Folders down to a depth below one, with their files, folders and bytes."""
    base = 0 if folder == "/" else folder.count("/")
    found = folder_records(records.where(paths.under(F.col("path"), folder))).where((F.col("path") == folder) | paths.under(F.col("path"), folder))
    return found.where(F.col("depth") <= base + depth).select("path", "depth", "files", "folders", "nbytes").orderBy("path")


def empty_folders(folders: DataFrame, files: DataFrame) -> DataFrame:
    """Folders (path) without any file below."""
    used = files.select(F.explode(paths.ancestors(F.col("path"))).alias("path")).distinct()
    return folders.join(used, "path", "left_anti")


def clashes(names: DataFrame) -> DataFrame:
    """Problems of paths on common platforms: (path, problem), one row for each."""
    name = paths.name_of(F.col("path"))
    reserved = r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\..*)?$"
    tests = {"reserved": name.rlike(reserved), "character": name.rlike(r'[<>:"\\|?*\x00-\x1f]'), "trailing": name.rlike(r"[. ]$"), "long": F.octet_length(name) > 255}
    single = names.select("path", F.explode(F.array_compact(F.array(*[F.when(t, F.lit(p)) for p, t in tests.items()]))).alias("problem"))
    folded = names.groupBy(F.lower("path").alias("k")).agg(F.count_distinct("path").alias("n"), F.collect_set("path").alias("p")).where("n > 1")
    return single.unionByName(folded.select(F.explode("p").alias("path"), F.lit("case").alias("problem")))


