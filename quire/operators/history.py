"""Commits: folding operations into versions, history, checkpoints, trash, batches.

A file's operations are folded in order by one task, so there is no race to retry; tasks take different files.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import paths, text
from quire.operators import merge
from quire.workers import importable

CONFLICT, CONTENTION, NOT_FOUND, INVALID, FORBIDDEN = "TX001", "TX002", "TX003", "TX004", "TX005"
OUTCOME = "seq bigint, path string, status string, kind string, version bigint, content string, author string, message string, base_version bigint, region_from bigint, region_to bigint, base string, theirs string, ours string"


class File:
    """One file's versions while operations are folded into it."""

    def __init__(self, versions: list[str] | None = None):
        self.versions = versions or []
        self.live = bool(versions)

    @property
    def head(self) -> str:
        return self.versions[-1]

    def apply(self, op: str, args: dict, base_version: int | None) -> dict:
        """Outcome of one operation: status ok or an error code, kind direct, rebased, merged or noop."""
        if op == "create" and self.live:
            return {"status": INVALID}
        if op in ("create", "upsert", "write") and not self.live:
            if op == "write":
                return {"status": NOT_FOUND}
            return self._put(args.get("content") or "", "direct")
        if not self.live:
            return {"status": NOT_FOUND}
        if op == "delete":
            self.live = False
            return {"status": "ok", "kind": "delete"}
        if op == "append":
            return self._put(self.head + (args.get("content") or ""), "direct" if base_version in (None, len(self.versions)) else "rebased")
        if op == "edit":
            out = merge.edit(self.head, args.get("old") or "", args.get("new") or "")
            return {"status": INVALID} if out is None else self._put(out, "direct")
        if op == "replace":
            old, n = args.get("old") or "", self.head.count(args.get("old") or "\0")
            if not old or not n or args.get("expected") not in (None, n):
                return {"status": INVALID}
            return self._put(self.head.replace(old, args.get("new") or ""), "direct")
        base_version = base_version or len(self.versions)
        if not 1 <= base_version <= len(self.versions):
            return {"status": NOT_FOUND}
        base = self.versions[base_version - 1]
        mine = merge.replace_lines(base, int(args["first"]), int(args["last"]), args.get("new") or "") if op == "replace_lines" else args.get("content") or ""
        if mine is None:
            return {"status": INVALID}
        return self._commit(base, mine, base_version)

    def _put(self, content: str, kind: str) -> dict:
        if self.live and self.versions and content == self.head:
            return {"status": "ok", "kind": "noop"}
        self.versions.append(content)
        self.live = True
        return {"status": "ok", "kind": kind}

    def _commit(self, base: str, mine: str, base_version: int) -> dict:
        if base_version == len(self.versions) or base == self.head:
            return self._put(mine, "direct")
        if mine in (base, self.head):
            return {"status": "ok", "kind": "noop"}
        merged, conflicts, where = merge.merge3(base, self.head, mine)
        if conflicts:
            lines = merge.split_lines(base)
            span = lambda other: "".join(h["new_text"] for h in merge.hunks(base, other) if h["old_from"] - 1 <= where[1] and h["old_from"] - 1 + h["old_count"] >= where[0])
            return {"status": CONFLICT, "region_from": where[0] + 1, "region_to": max(where[0] + 1, where[1]), "base": "".join(lines[where[0] : where[1]]), "theirs": span(self.head), "ours": span(mine)}
        changed = lambda other: {i for h in merge.diff(merge.split_lines(base), merge.split_lines(other)) for i in range(h[0], max(h[1], h[0] + 1))}
        return self._put(merged, "merged" if changed(self.head) & changed(mine) else "rebased")


def _folded(file: File, path: str, ops: pd.DataFrame) -> pd.DataFrame:
    """Outcomes of one file's operations, in order of seq."""
    out = []
    for row in ops.sort_values("seq").to_dict("records"):
        base = None if pd.isna(row["base_version"]) else int(row["base_version"])
        before = len(file.versions)
        got = file.apply(row["op"], dict(row["args"] or {}), base)
        out.append({"seq": row["seq"], "path": path, "version": len(file.versions) or None, "content": file.head if len(file.versions) > before else None, "author": row["author"], "message": row["message"], "base_version": base, **got})
    return pd.DataFrame(out, columns=[x.split()[0] for x in OUTCOME.split(", ")], dtype=object)


def fold_stream(ops: DataFrame) -> DataFrame:
    """fold() of a stream: a file's versions are state, so a later batch's operations meet those of earlier ones."""
    importable(ops.sparkSession)

    def run(key: tuple, parts, state):
        versions, is_live = state.get if state.exists else ([], False)
        file = File([*versions])
        file.live = is_live
        out = _folded(file, key[0], pd.concat([*parts]))
        state.update((file.versions, file.live))
        yield out

    rows = ops.select("path", "seq", "op", "args", F.col("base_version").cast("bigint"), "author", "message")
    return rows.groupBy("path").applyInPandasWithState(run, OUTCOME, "versions array<string>, live boolean", "append", "NoTimeout")


def fold(ops: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Outcomes of operations (seq, path, op, args map, base_version, author, message), each file's in order of seq.

    heads: (path, versions array of texts) of files that exist. A row per operation; content is that of a new version.
    """
    importable(ops.sparkSession)
    rows = ops.select("path", "seq", "op", "args", F.col("base_version").cast("bigint"), "author", "message")

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _folded(File([*right["versions"].iloc[0]] if len(right) else None), key[0], left)

    known = heads if heads is not None else ops.sparkSession.createDataFrame([], "path string, versions array<string>")
    return rows.groupBy("path").cogroup(known.groupBy("path")).applyInPandas(run, OUTCOME)


def history(commits: DataFrame, path: str | None = None) -> DataFrame:
    """Versions with their sizes, oldest first."""
    rows = commits if path is None else commits.where(F.col("path") == path)
    return rows.select("path", "version", "author", text.nbytes(F.col("content")).alias("nbytes"), text.nlines(F.col("content")).alias("nlines"), text.nwords(F.col("content")).alias("nwords")).orderBy("path", "version")


def at_version(commits: DataFrame, version: int | None = None) -> DataFrame:
    """Files as of a version: the given one, or each file's last."""
    if version is not None:
        return commits.where(F.col("version") == version)
    best = commits.groupBy("file_id").agg(F.max_by(F.struct("path", "version", "author", "content"), "version").alias("h"))
    return best.select("file_id", "h.*")


def as_of(commits: DataFrame, limits: DataFrame) -> DataFrame:
    """Files as they stood at limits (file_id, version): the last version not above it."""
    rows = commits.join(limits.withColumnRenamed("version", "most"), "file_id").where("version <= most")
    return rows.groupBy("file_id").agg(F.max_by(F.struct("path", "version", "author", "content"), "version").alias("h")).select("file_id", "h.*")


def word_deltas(commits: DataFrame) -> DataFrame:
    """(file_id, version, nwords, delta): words that each version added."""
    n = commits.select("file_id", "version", text.nwords(F.col("content")).alias("nwords"))
    before = F.lag("nwords").over(Window.partitionBy("file_id").orderBy("version"))
    return n.withColumn("delta", F.col("nwords") - F.coalesce(before, F.lit(0)))


def file_authors(commits: DataFrame) -> DataFrame:
    """(file_id, author, commits, first_version, last_version); no author counts as an empty name."""
    return commits.groupBy("file_id", F.coalesce("author", F.lit("")).alias("author")).agg(F.count(F.lit(1)).alias("commits"), F.min("version").alias("first_version"), F.max("version").alias("last_version"))


def authors_array(by_file: DataFrame) -> DataFrame:
    """(file_id, authors): those with most commits first, then the latest."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("commits")).alias("c"), (-F.col("last_version")).alias("l"), "author", "commits")))
    return by_file.groupBy("file_id").agg(F.transform(order, lambda x: F.struct(x["author"].alias("author"), x["commits"].alias("commits"))).alias("authors"))


def diffs(commits: DataFrame, kind: str = "hunks") -> DataFrame:
    """Changes from each version to the next: rows of hunks, or one unified diff each."""
    importable(commits.sparkSession)
    by_file = Window.partitionBy("file_id").orderBy("version")
    follows = F.lag("version").over(by_file) == F.col("version") - 1
    pair = commits.withColumn("old", F.when(follows, F.lag("content").over(by_file)).otherwise(F.lit("")))
    if kind == "hunks":
        return pair.select("path", "version", F.explode(merge.hunks_of(F.col("old"), F.col("content"))).alias("h")).select("path", "version", "h.*")
    name = lambda v: F.concat("path", F.lit("@"), v.cast("string"))
    return pair.select("path", "version", merge.unified_of(F.col("old"), F.col("content"), name(F.col("version") - 1), name(F.col("version"))).alias("diff"))


def diffs_between(commits: DataFrame, old: int, new: int | None = None, kind: str = "hunks") -> DataFrame:
    """Changes of each file from one version to another (0: nothing yet; None: its last), as rows of hunks or one unified diff each.

    Files that lack either version have no rows.
    """
    importable(commits.sparkSession)
    rows = commits if new is None else commits.where(F.col("version").isin(old, new))
    of = lambda v: F.lit("") if v == 0 else F.max(F.when(F.col("version") == v, F.col("content")))
    last = F.max_by("content", "version") if new is None else of(new)
    at = F.max("version") if new is None else F.lit(new).cast("bigint")
    pair = rows.groupBy("file_id", "path").agg(of(old).alias("old"), last.alias("new"), at.alias("at")).where("old is not null and new is not null")
    if kind == "hunks":
        return pair.select("path", F.explode(merge.hunks_of(F.col("old"), F.col("new"))).alias("h")).select("path", "h.*")
    return pair.select("path", merge.unified_of(F.col("old"), F.col("new"), F.concat("path", F.lit(f"@{old}")), F.concat("path", F.lit("@"), F.col("at").cast("string"))).alias("diff"))


# --- namespace ----------------------------------------------------------------------------------


def move(files: DataFrame, source: str, target: str) -> DataFrame:
    """files after source (a file or folder) became target; ids and versions stay."""
    if source in ("", "/") or target == source or target.startswith(source + "/"):
        raise ValueError("the root can't move, nor a folder into itself")
    return files.withColumn("path", paths.moved(F.col("path"), source, target))


def delete(files: DataFrame, path: str, at) -> DataFrame:
    """files with deleted_at set for a file or all below a folder."""
    hit = (F.col("path") == path) | paths.under(F.col("path"), path)
    old = F.col("deleted_at") if "deleted_at" in files.columns else F.lit(None).cast("timestamp")
    return files.withColumn("deleted_at", F.when(hit & old.isNull(), F.lit(at).cast("timestamp")).otherwise(old))


def live(files: DataFrame) -> DataFrame:
    return files.where("deleted_at is null").drop("deleted_at") if "deleted_at" in files.columns else files


def trash(nodes: DataFrame) -> DataFrame:
    """Deleted nodes (path, deleted_at) whose folder lives, is gone or was deleted at another time; the newest first."""
    parents = nodes.select(F.col("path").alias("dir"), F.col("deleted_at").alias("with_parent"))
    own = nodes.where("deleted_at is not null").withColumn("dir", paths.dir_of(F.col("path")))
    return own.join(parents, "dir", "left").where("with_parent is null or with_parent <> deleted_at").drop("with_parent").orderBy(F.desc("deleted_at"), "path")


def restore(nodes: DataFrame, path: str) -> DataFrame:
    """nodes with a deleted node and what was deleted with it live again."""
    hit = (F.col("path") == path) | paths.under(F.col("path"), path)
    at = nodes.where((F.col("path") == path) & F.col("deleted_at").isNotNull()).agg(F.max("deleted_at").alias("t"))
    return nodes.join(F.broadcast(at)).withColumn("deleted_at", F.when(hit & (F.col("deleted_at") == F.col("t")), None).otherwise(F.col("deleted_at"))).drop("t")


def batch_summary(changes: DataFrame) -> DataFrame:
    """One row per file and batch of changes (batch, file_id, version): from_version, to_version, commits."""
    return changes.groupBy("batch", "file_id").agg((F.min("version") - 1).alias("from_version"), F.max("version").alias("to_version"), F.count(F.lit(1)).alias("commits"))


def revert_plan(changes: DataFrame, heads: DataFrame, batch: str) -> DataFrame:
    """What undoing a batch does to each file: restore a version, remove a created file, or skip one that changed since."""
    own = batch_summary(changes.where(F.col("batch") == batch)).join(heads.select("file_id", F.col("version").alias("head")), "file_id", "left")
    action = F.when(F.col("head") != F.col("to_version"), "skipped").when(F.col("from_version") == 0, "removed").otherwise("restored")
    return own.select("file_id", "from_version", "to_version", action.alias("action"))


def path_events(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file_id, old_path, new_path, op) of files whose path changed: rename within a folder, else move; delete if gone."""
    pair = before.select("file_id", F.col("path").alias("old_path")).join(after.select("file_id", F.col("path").alias("new_path")), "file_id", "left").where("new_path is null or new_path <> old_path")
    op = F.when(F.col("new_path").isNull(), "delete").when(paths.dir_of(F.col("old_path")) == paths.dir_of(F.col("new_path")), "rename").otherwise("move")
    return pair.withColumn("op", op)




def purge_stats(gone: DataFrame, gone_chunks: DataFrame, live_chunks: DataFrame) -> DataFrame:
    """One row: files, versions, and chunks and bytes that only versions of gone (file_id, version) hold."""
    own = gone.agg(F.count_distinct("file_id").alias("files"), F.count(F.lit(1)).alias("versions"))
    freed = gone_chunks.groupBy("hash").agg(F.max("nbytes").alias("nbytes")).join(live_chunks.select("hash"), "hash", "left_anti")
    return own.join(freed.agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum("nbytes"), F.lit(0)).alias("bytes")))
