"""Column functions over absolute store paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize(path: Column) -> Column:
    """One leading slash, no doubled or trailing ones; null for NUL, "." and ".." segments."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    bad = F.exists(parts, lambda x: x.isin(".", "..")) | path.contains("\x00")
    return F.when(~bad, F.concat(F.lit("/"), F.array_join(parts, "/")))


def dir_of(path: Column) -> Column:
    """The folder a path is in; null for the root."""
    return F.when(path == "/", None).otherwise(F.regexp_replace(F.regexp_replace(path, r"/[^/]*$", ""), "^$", "/"))


def name_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def ext_of(path: Column) -> Column:
    """Lower-cased text after the last dot of the name; null if that or what is before it is empty."""
    return F.nullif(F.lower(F.regexp_extract(name_of(path), r"^.+\.([^.]+)$", 1)), F.lit(""))


def depth_of(path: Column) -> Column:
    return F.when(path == "/", 0).otherwise(F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))))


def ancestors(path: Column) -> Column:
    """Folders above a path, from the root down: /a/b/c.md gives /, /a, /a/b."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.when(i == 1, F.lit("/")).otherwise(F.array_join(F.slice(parts, 1, i), "/")))


def under(path: Column, folder: str) -> Column:
    """Whether a path lies below a folder; a prefix test that reaches the scan."""
    return F.lit(True) if folder in ("", "/") else F.startswith(path, F.lit(folder.rstrip("/") + "/"))


def moved(path: Column, source: str, target: str) -> Column:
    """A path after source (a file or folder) became target."""
    return F.when((path == source) | under(path, source), F.concat(F.lit(target), F.substring(path, len(source) + 1, 1 << 30))).otherwise(path)
