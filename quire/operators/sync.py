"""Three-way comparison of a store folder, a directory and what both last agreed on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import paths
from quire.operators import merge
from quire.sources.vault import EXTENSIONS
from quire.workers import importable


def blob_id(content: Column) -> Column:
    """git's id of a text: SHA-1 over its length and bytes."""
    raw = content.cast("binary")
    return F.sha1(F.concat(F.lit("blob ").cast("binary"), F.octet_length(raw).cast("string").cast("binary"), F.unhex(F.lit("00")), raw))


def classify(base: DataFrame, store: DataFrame, disk: DataFrame, read_only: bool = False, extensions=EXTENSIONS) -> DataFrame:
    """(rel, action) for every path of base (rel, version, content, conflict), store (rel, version, content) and disk (rel, content).

    Actions: keep, adopt, to_disk, to_store, merge, conflict, disk_delete, store_delete, move, hold, left_out. Both changed: a three-way
    merge decides. A file that left the store's side of the disk and turned up under exactly one new name is a move to it (new_rel).
    """
    importable(base.sparkSession)
    rows = (
        base.select("rel", F.col("version").alias("b_version"), F.col("content").alias("b"), F.coalesce("conflict", F.lit(False)).alias("conflict"), F.lit(True).alias("has_b"))
        .join(store.select("rel", F.col("version").alias("s_version"), F.col("content").alias("s"), F.lit(True).alias("has_s")), "rel", "full")
        .join(disk.select("rel", F.col("content").alias("d"), F.lit(True).alias("has_d")), "rel", "full")
    )
    has = {k: F.coalesce(F.col(f"has_{k}"), F.lit(False)) for k in "bsd"}
    t, d = F.col("s_version") != F.col("b_version"), F.col("d") != F.col("b")
    binary = F.contains(F.substring("d", 1, 8000), F.lit("\x00"))
    markers = F.contains("d", F.lit("<<<<<<< ")) & F.contains("d", F.lit(">>>>>>> "))
    ext = F.lower(F.regexp_extract("rel", r"[^/]\.([^./]+)$", 1))
    merged = merge.merge3_of(F.when(has["b"], F.col("b")).otherwise(""), F.col("s"), F.col("d"))
    both = F.when(binary, "hold").when(F.col("s") == F.col("d"), "adopt").otherwise("both")
    fresh = F.when(~has["d"], "to_disk").when(~has["s"], F.when(ext.isin(*extensions), "candidate").otherwise("left_out")).when(F.col("s") == F.col("d"), "adopt").when(binary, "hold").otherwise("conflict")
    known = (
        F.when(F.col("conflict") & has["d"] & markers, "hold").when(F.col("conflict") & ~has["d"] & has["s"], "to_disk").when(~has["s"] & ~has["d"], "nothing")
        .when(has["s"] & has["d"], F.when(~t & ~d, "keep").when(t & ~d, "to_disk").when(~t & d, F.lit("hold" if read_only else "to_store")).otherwise(F.lit("hold") if read_only else both))
        .when(~has["s"], F.when(~d, "disk_delete").otherwise("to_store")).when(~t, "store_delete").otherwise("to_disk")
    )
    rows = rows.withColumn("action", F.when(has["b"], known).otherwise(fresh))
    undecided = rows.where("action = 'both'").withColumn("m", merged)
    rows = rows.where("action <> 'both'").unionByName(undecided.withColumn("action", F.when(F.col("m.conflicts") == 0, "merge").otherwise("conflict")).drop("m"))
    new = rows.where("action = 'candidate'").select(F.col("rel").alias("new_rel"), blob_id(F.col("d")).alias("blob"))
    alone = Window.partitionBy("blob")
    one = new.withColumn("n", F.count(F.lit(1)).over(alone)).where("n = 1").drop("n")
    gone = rows.where("action = 'store_delete'").select("rel", blob_id(F.col("b")).alias("blob"))
    first = Window.partitionBy("blob").orderBy("rel")
    moves = gone.withColumn("k", F.row_number().over(first)).where("k = 1").join(one, "blob").select("rel", "new_rel")
    out = rows.select("rel", "action").join(moves, "rel", "left")
    taken = moves.select(F.col("new_rel").alias("rel"), F.lit(True).alias("taken"))
    out = out.join(taken, "rel", "left").where("taken is null")
    final = F.when(F.col("new_rel").isNotNull(), "move").when(F.col("action") == "candidate", F.lit("hold" if read_only else "to_store")).otherwise(F.col("action"))
    return out.where("action <> 'nothing'").select("rel", final.alias("action"), "new_rel")


def git_compare(store: DataFrame, git: DataFrame) -> DataFrame:
    """(rel, status) of store (rel, content) against git (rel, blob): same, crlf, differ, only-store, only-git."""
    own = store.select("rel", blob_id(F.col("content")).alias("a"), blob_id(F.regexp_replace("content", "\r\n", "\n")).alias("lf"), blob_id(F.regexp_replace("content", "\r?\n", "\r\n")).alias("crlf"))
    pair = own.join(git.select("rel", "blob"), "rel", "full")
    status = F.when(F.col("blob").isNull(), "only-store").when(F.col("a").isNull(), "only-git").when(F.col("a") == F.col("blob"), "same").when(F.col("blob").isin(F.col("lf")) | (F.col("blob") == F.col("crlf")), "crlf").otherwise("differ")
    return pair.select("rel", status.alias("status"))


def asset_status(pointers: DataFrame, disk: DataFrame, base: DataFrame) -> DataFrame:
    """(path, status) of assets: pointers (path, sha256), disk (path, sha256), base (path, sha256)."""
    rows = pointers.select("path", F.col("sha256").alias("p")).join(disk.select("path", F.col("sha256").alias("d")), "path", "full").join(base.select("path", F.col("sha256").alias("b")), "path", "left")
    p, d, b = F.col("p"), F.col("d"), F.col("b")
    valid = p.rlike("^[0-9a-f]{64}$")
    copy = paths.name_of(F.col("path")).rlike(r"\(conflict[^)]*\)")
    status = (
        F.when(p.isNull() & copy, "conflict-copy").when(p.isNull() & b.isNotNull(), "orphan").when(p.isNull(), "new").when(~valid, "invalid-pointer").when(d.isNull(), "not-pulled").when(p == d, "ok")
        .when(b.isNull(), "conflict").when(p == b, "modified").when(d == b, "outdated").otherwise("conflict")
    )
    return rows.select("path", status.alias("status"))
