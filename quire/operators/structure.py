"""Structure of markdown files: one Python pass per document, everything after it as DataFrames."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import paths
from quire.operators import markdown
from quire.sources.vault import MARKDOWN
from quire.workers import importable

SCHEMA = (
    "file_id bigint, path string, version bigint, title string, frontmatter string, nprops bigint, "
    "sections array<struct<heading_path:string,heading:string,level:int,line_from:bigint,line_to:bigint,nwords:bigint,nwords_total:bigint>>, "
    "links array<struct<line:bigint,kind:string,target:string,anchor:string,alias:string,external:boolean,offset:bigint,at:bigint>>, "
    "props array<struct<key:string,val_txt:string,val_num:double,ord:bigint>>"
)
LIMITS = {"outline": 1000, "headings": 100, "props": 200, "find": 500, "links": 10_000}
STATUSES = ("ok", "broken", "ambiguous", "anchor-missing", "not-in-store", "external", "folder")
BROKEN = ("broken", "anchor-missing", "ambiguous")
#: fixed values: extensions of files that a store of texts doesn't hold
NOT_TEXT = (
    "pdf", "png", "jpg", "jpeg", "gif", "svg", "webp", "bmp", "heic", "tif", "tiff", "ico", "xlsx", "xls", "docx", "doc", "pptx", "ppt",
    "odt", "ods", "csv", "tsv", "zip", "mp4", "mov", "mp3", "wav", "m4a", "canvas", "base", "json", "html", "htm", "drawio", "excalidraw",
)
# Fixed value: the ending of files that point to a binary asset.
POINTER = ".tdbasset"


def extract(text: str) -> dict:
    """What one document's text gives; the plug-in point for other formats."""
    block, _ = markdown.split_front_matter(text)
    front = markdown.parse_yaml(block) if block is not None else None
    front = front if isinstance(front, dict) else None
    return {
        "title": markdown.title_of(front, markdown.headings(text)),
        "frontmatter": None if front is None else json.dumps(front, ensure_ascii=False),
        "nprops": len(front or ()),
        "sections": markdown.sections(text),
        "links": markdown.links(text),
        "props": [dict(zip(("key", "val_txt", "val_num", "ord"), p, strict=True)) for p in markdown.flatten(front)],
    }


def structure(files: DataFrame, extractor=extract) -> DataFrame:
    """One row per markdown file with title, front matter, sections, links and properties. Persist it where it's used often."""
    importable(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = pd.DataFrame([extractor(t or "") for t in batch["content"]], columns=["title", "frontmatter", "nprops", "sections", "links", "props"])
            yield pd.concat([batch[["file_id", "path", "version"]].reset_index(drop=True), found], axis=1)

    return files.where(paths.ext_of(F.col("path")).isin(*MARKDOWN)).select("file_id", "path", "version", "content").mapInPandas(run, SCHEMA)


def _first(rows: DataFrame, limit: int | None) -> DataFrame:
    """The first rows, or all; a top-k of a very large k would reserve memory for it."""
    return rows if limit is None else rows.limit(limit)


# --- sections -----------------------------------------------------------------------------------


def sections(found: DataFrame) -> DataFrame:
    return found.select("file_id", "path", "version", F.explode("sections").alias("s")).select("file_id", "path", "version", "s.*", F.lower("s.heading").alias("heading_lc"))


def outline(found: DataFrame, folder: str = "/", heading: str | None = None, mode: str = "exact", max_level: int = 6, limit: int | None = LIMITS["outline"]) -> DataFrame:
    """Sections by path and line; heading compares folded: exact, prefix or contains."""
    rows = sections(found).where(F.col("level") <= max_level)
    rows = rows.where((F.col("path") == folder) | paths.under(F.col("path"), folder))
    if heading is not None:
        key, want = F.col("heading_lc"), F.lit(heading.lower())
        rows = rows.where({"exact": key == want, "prefix": F.startswith(key, want), "contains": F.contains(key, want)}[mode])
    return _first(rows.orderBy("path", "line_from"), limit)


def heading_names(found: DataFrame, folder: str = "/", starts: str = "", limit: int = LIMITS["headings"]) -> DataFrame:
    """(heading, sections, docs) of each heading, most frequent first."""
    rows = sections(found.where(paths.under(F.col("path"), folder))).where(F.startswith("heading_lc", F.lit(starts.lower())))
    return rows.groupBy("heading_lc").agg(F.min("heading").alias("heading"), F.count(F.lit(1)).alias("sections"), F.count_distinct("file_id").alias("docs")).orderBy(F.desc("sections"), "heading_lc").limit(limit).drop("heading_lc")


def section_text(files: DataFrame, found: DataFrame, heading: str) -> DataFrame:
    """(path, heading_path, text) of each file's section of that name: by whole path, else whole path in any case, else last part."""
    low, key = heading.lower(), F.lower("heading_path")
    rank = F.when(F.col("heading_path") == heading, 0).when(key == low, 1).when(F.endswith(key, F.lit(f" / {low}")), 2)
    best = sections(found).withColumn("rank", rank).where("rank is not null").groupBy("file_id").agg(F.min_by(F.struct("heading_path", "line_from", "line_to"), F.struct("rank", "line_from")).alias("s"))
    lines = F.split("content", r"(?<=\n)")
    return files.join(best, "file_id").select("path", "s.heading_path", F.array_join(F.slice(lines, F.col("s.line_from").cast("int"), (F.col("s.line_to") - F.col("s.line_from") + 1).cast("int")), "").alias("text"))


# --- properties ---------------------------------------------------------------------------------


def properties(found: DataFrame) -> DataFrame:
    rows = found.select("file_id", "path", F.explode("props").alias("p")).select("file_id", "path", "p.*")
    return rows.withColumns({"key_lc": F.lower("key"), "val_lc": F.lower("val_txt")})


def property_keys(props: DataFrame, starts: str = "", folder: str = "/", limit: int = LIMITS["props"]) -> DataFrame:
    """(key, docs, values_n, kind) of each key, the most used first; kind is number, text or mixed."""
    rows = props.where(paths.under(F.col("path"), folder) & F.startswith("key_lc", F.lit(starts.lower())))
    numbers, all_ = F.count_if(F.col("val_num").isNotNull()), F.count_if(F.col("val_txt").isNotNull())
    kind = F.when((all_ > 0) & (numbers == all_), "number").when(numbers == 0, "text").otherwise("mixed")
    return rows.groupBy("key").agg(F.count_distinct("file_id").alias("docs"), F.count_distinct("val_txt").alias("values_n"), kind.alias("kind")).orderBy(F.desc("docs"), "key").limit(limit)


def property_values(props: DataFrame, key: str, starts: str = "", folder: str = "/", limit: int = LIMITS["props"]) -> DataFrame:
    """(value, docs) of a key, the most used first."""
    rows = props.where((F.col("key_lc") == key.lower()) & F.col("val_txt").isNotNull() & paths.under(F.col("path"), folder) & F.startswith("val_lc", F.lit(starts.lower())))
    return rows.groupBy(F.col("val_txt").alias("value")).agg(F.count_distinct("file_id").alias("docs")).orderBy(F.desc("docs"), "value").limit(limit)


class QueryError(ValueError):
    """A property query that can't be read; at is the place in bytes."""

    def __init__(self, message: str, at: int):
        super().__init__(f"{message} at {at}")
        self.at = at


_LEXEME = re.compile(r'(?P<open>\()|(?P<close>\))|(?P<minus>-)(?=\S)|(?P<word>(?:"[^"]*"|[^\s()"])+)|(?P<stray>")')
#: how tightly a connective binds
_BINDS = {"or": 1, "and": 2, "not": 3}


def _lexemes(query: str) -> list[tuple[str, str, int]]:
    """(kind, text, place in bytes) of each part of a query; kinds are word, or, and, not, open and close."""
    found = []
    for m in _LEXEME.finditer(query):
        kind, word, at = m.lastgroup, m[0], len(query[: m.start()].encode())
        if kind == "stray" or kind == "word" and query[m.end() : m.end() + 1] == '"':
            raise QueryError("this quotation mark has no partner", len(query[: m.end() - (kind == "stray")].encode()))
        if kind == "minus" or word in ("NOT", "AND", "OR"):
            kind = "not" if kind == "minus" else word.lower()
        found.append((kind, word, at))
    return found


def parse_query(query: str):
    """A tree of ("or"|"and", parts), ("not", part), ("term", key, op, value) and ("all",).

    OR binds least, then AND, which may be left out, then NOT or a leading minus; parentheses group. A quoted value is literal.
    Operands and connectives wait on two stacks until a connective comes that binds no tighter.
    """
    values: list = []
    waiting: list[tuple[str, int]] = []

    def settle(least: int) -> None:
        while waiting and waiting[-1][0] != "open" and _BINDS[waiting[-1][0]] >= least:
            kind, _ = waiting.pop()
            right = values.pop()
            if kind == "not":
                values.append(("not", right))
            else:
                left = values.pop()
                values.append((kind, [*left[1], right] if left[0] == kind else [left, right]))

    complete = False  # whether an operand ends right here
    for kind, word, at in _lexemes(query):
        if kind in ("word", "not", "open") and complete:
            settle(_BINDS["and"])
            waiting.append(("and", at))
        if kind == "word":
            values.append(_term(word.replace('"', ""), '"' in word, at))
        elif kind in ("not", "open"):
            waiting.append((kind, at))
        elif not complete:
            raise QueryError(f"{word} stands where a filter should be", at)
        elif kind == "close":
            settle(0)
            if not waiting:
                raise QueryError("this bracket closes nothing", at)
            waiting.pop()
        else:
            settle(_BINDS[kind])
            waiting.append((kind, at))
        complete = kind in ("word", "close")
    if not values and not waiting:
        return ("all",)
    if not complete:
        raise QueryError("a filter is missing here", len(query.encode()))
    settle(0)
    if waiting:
        raise QueryError("this bracket stays open", waiting[-1][1])
    return values[0]


def _term(word: str, quoted: bool, at: int):
    if word[:4] in ("has:", "HAS:"):
        if not word[4:]:
            raise QueryError("has: lacks the name of a property", at)
        return ("term", word[4:], "exists", "")
    key, colon, raw = word.partition(":")
    if not colon or not key:
        raise QueryError("neither key:value nor has:key", at)
    if quoted:
        op, value = "=", raw
    elif raw == "*":
        op, value = "exists", ""
    else:
        op = next((o for o in (">=", "<=", "!=", ">", "<", "~") if raw.startswith(o)), "")
        value = raw[len(op) :]
        if not op:
            op, value = ("prefix", raw[:-1]) if raw.endswith("*") else ("=", raw)
    if not value and op != "exists":
        raise QueryError(f"nothing to compare {key} with", at)
    return ("term", key, op, value)


def matching(props: DataFrame, query: str) -> DataFrame:
    """(file_id) of the files with properties that satisfy a query. One aggregate by file, no join per term."""
    tree, tests = parse_query(query), []

    def number(s: str) -> float | None:
        try:
            return float(s)
        except ValueError:
            return None

    def has(row: Column) -> Column:
        tests.append(F.coalesce(F.bool_or(row), F.lit(False)).alias(f"c{len(tests)}"))
        return F.col(f"c{len(tests) - 1}")

    def build(node) -> Column:
        if node[0] in ("and", "or"):
            out = build(node[1][0])
            for part in node[1][1:]:
                out = out & build(part) if node[0] == "and" else out | build(part)
            return out
        if node[0] == "not":
            return ~build(node[1])
        if node[0] == "all":
            return F.lit(True)
        _, key, op, value = node
        own, low, num = F.col("key_lc") == key.lower(), value.lower(), number(value)
        equal = (F.col("val_lc") == low) | ((F.col("val_num") == num) if num is not None else F.lit(False))
        if op == "exists":
            return has(own)
        if op == "!=":
            return has(own) & ~has(own & equal)
        if op in ("<", "<=", ">", ">="):
            a, b = (F.col("val_num"), F.lit(num)) if num is not None else (F.col("val_lc"), F.lit(low))
            return has(own & {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op])
        return has(own & {"=": equal, "~": F.contains("val_lc", F.lit(low)), "prefix": F.startswith("val_lc", F.lit(low))}[op])

    condition = build(tree)
    return props.groupBy("file_id").agg(*(tests or [F.count(F.lit(1)).alias("n")])).where(condition).select("file_id")


def property_find(files: DataFrame, found: DataFrame, query: str, folder: str = "/", limit: int = LIMITS["find"]) -> DataFrame:
    """(path, nbytes, updated_at, frontmatter) of the files below a folder that satisfy a query, by path."""
    hit = matching(properties(found.where(paths.under(F.col("path"), folder))), query)
    return files.join(hit, "file_id").join(found.select("file_id", "frontmatter"), "file_id").select("path", F.octet_length("content").cast("bigint").alias("nbytes"), "updated_at", "frontmatter").orderBy("path").limit(limit)


# --- links --------------------------------------------------------------------------------------


def _joined(folder: Column, rel: Column) -> Column:
    """rel against a folder with . and .. resolved; null above the root."""
    parts = F.filter(F.concat(F.when(F.startswith(rel, F.lit("/")), F.array().cast("array<string>")).otherwise(F.split(folder, "/")), F.split(rel, "/")), lambda x: ~x.isin("", "."))
    step = lambda acc, x: F.when(acc.isNull() | ((x == "..") & (F.size(acc) == 0)), F.lit(None).cast("array<string>")).when(x == "..", F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.concat(acc, F.array(x)))
    out = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.when(out.isNotNull(), F.concat(F.lit("/"), F.array_join(out, "/")))


def links(found: DataFrame, files: DataFrame) -> DataFrame:
    """Every link with status and the file that it reaches.

    Columns: link_id, file_id, path, version, line, kind, target, anchor, alias, external, status, resolved_id, resolved, asset. Candidates
    come from equality joins on lower-cased paths, names and path ends, never from a comparison of all with all.
    """
    raw = found.select("file_id", "path", "version", F.posexplode("links").alias("n", "l")).select(F.concat_ws(":", "file_id", "n").alias("link_id"), "file_id", "path", "version", "l.*")
    raw = raw.withColumn("folder", paths.dir_of(F.col("path")))
    live = files.select(F.col("file_id").alias("to_id"), F.col("path").alias("to_path"))
    parts = F.split(F.lower("to_path"), "/")
    ends = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, i, F.size(parts)), "/")))
    # a wiki link without a folder finds names, one with a folder finds ends of paths; names are the last end
    keys = live.select("to_id", "to_path", F.lower("to_path").alias("key"), F.lit("path").alias("how")).unionByName(live.select("to_id", "to_path", F.explode(ends).alias("key"), F.lit("end").alias("how")))
    inner = raw.where("not external and target <> ''")
    wiki, slashed = F.col("kind").isin("wiki", "embed"), F.contains("target", F.lit("/"))
    clean = F.regexp_replace("target", "/+$", "")
    here, root = _joined(F.col("folder"), F.col("target")), _joined(F.lit("/"), F.col("target"))
    wanted = F.when(~wiki, F.array(F.struct(F.lit(0).alias("step"), F.lit("path").alias("how"), here.alias("k")), F.struct(F.lit(1).alias("step"), F.lit("path").alias("how"), root.alias("k"))))
    wanted = wanted.when(slashed, F.array(F.struct(F.lit(0).alias("step"), F.lit("path").alias("how"), root.alias("k")), F.struct(F.lit(1).alias("step"), F.lit("path").alias("how"), here.alias("k")), F.struct(F.lit(2).alias("step"), F.lit("end").alias("how"), F.concat(F.lit("/"), F.regexp_replace(clean, "^/+", "")).alias("k"))))
    wanted = wanted.otherwise(F.array(F.struct(F.lit(0).alias("step"), F.lit("end").alias("how"), F.concat(F.lit("/"), clean).alias("k"))))
    tries = inner.select("link_id", "target", "folder", F.explode(wanted).alias("w")).where("w.k is not null").select("link_id", "target", "folder", "w.step", "w.how", F.lower("w.k").alias("k"))
    spelled = F.when(F.endswith("k", F.lit(".md")), F.array(F.col("k"))).otherwise(F.array(F.col("k"), F.concat("k", F.lit(".md")), F.concat("k", F.lit(POINTER))))
    tries = tries.select("link_id", "target", "folder", "step", "how", F.explode(spelled).alias("key"))
    hits = tries.join(keys, ["how", "key"]).withColumn("asset", F.endswith("key", F.lit(POINTER)))
    shown = F.when(F.col("asset"), F.regexp_replace("to_path", r"\.tdbasset$", "")).otherwise(F.col("to_path"))
    exact = F.endswith(shown, F.col("target")) | F.endswith(shown, F.concat("target", F.lit(".md")))
    rank = F.struct(~exact, paths.dir_of(shown) != F.col("folder"), F.octet_length(shown), shown)
    # documents before pointers, then the earlier way to read the target
    first = hits.groupBy("link_id", "asset", "step").agg(F.count_distinct("to_id").alias("several"), F.min_by(F.struct("to_id", "to_path"), rank).alias("to"))
    best = first.groupBy("link_id").agg(F.min_by(F.struct("several", "to", "asset"), F.struct("asset", "step")).alias("b"))
    folders = files.select(F.explode(paths.ancestors(F.lower("path"))).alias("fkey")).where("fkey <> '/'").distinct()
    reach = inner.select("link_id", F.explode(F.array(here, root)).alias("k")).where("k is not null and k <> '/'").select("link_id", F.lower("k").alias("fkey")).join(folders, "fkey", "left_semi").select("link_id", F.lit(True).alias("is_folder")).distinct()
    heads = sections(found).select(F.col("file_id").alias("to_id"), F.regexp_replace(F.lower("heading"), r"[^\p{IsAlphabetic}\p{N}]", "").alias("akey")).distinct()
    placed = raw.join(best, "link_id", "left").join(reach, "link_id", "left")
    placed = placed.withColumn("to_id", F.when((F.col("target") == "") & F.col("anchor").isNotNull() & ~F.col("external"), F.col("file_id")).otherwise(F.col("b.to.to_id")))
    last = F.substring_index("anchor", "#", -1)
    placed = placed.withColumn("akey", F.when(F.startswith(last, F.lit("^")), None).otherwise(F.regexp_replace(F.lower(last), r"[^\p{IsAlphabetic}\p{N}]", "")))
    placed = placed.join(heads.withColumn("has_anchor", F.lit(True)), ["to_id", "akey"], "left")
    missing = F.col("akey").isNotNull() & F.col("has_anchor").isNull() & ~F.coalesce(F.col("b.asset"), F.lit(False))
    ext = F.lower(F.regexp_extract("target", r"\.([^./]+)$", 1))
    status = (
        F.when(F.col("external"), "external").when((F.col("target") == "") & F.col("anchor").isNull(), "broken").when(F.col("to_id").isNotNull() & missing, "anchor-missing")
        .when(F.col("target") == "", "ok").when(F.col("b").isNotNull() & (F.col("b.several") > 1), "ambiguous").when(F.col("b").isNotNull(), "ok")
        .when(F.col("is_folder"), "folder").when(ext.isin(*NOT_TEXT), "not-in-store").otherwise("broken")
    )
    resolved = F.when(F.col("target") == "", F.when(F.col("to_id").isNotNull(), F.col("path"))).otherwise(F.col("b.to.to_path"))
    return placed.select("link_id", "file_id", "path", "version", "line", "kind", "target", "anchor", "alias", "external", status.alias("status"), F.when(~F.col("external"), F.col("to_id")).alias("resolved_id"), resolved.alias("resolved"), F.when(F.col("b.asset"), F.regexp_replace(resolved, r"\.tdbasset$", "")).alias("asset"))


def outgoing(all_links: DataFrame, path: str = "/", status: str | None = None, limit: int | None = LIMITS["links"]) -> DataFrame:
    """Links of a file or below a folder, by path and line."""
    if status is not None and status not in STATUSES:
        raise ValueError(f"unknown status {status}")
    rows = all_links.where((F.col("path") == path) | paths.under(F.col("path"), path))
    rows = rows if status is None else rows.where(F.col("status") == status)
    return _first(rows.select("path", "version", "line", "kind", "target", "anchor", "alias", "status", "resolved", "asset").orderBy("path", "line", "target"), limit)


def backlinks(all_links: DataFrame, path: str, limit: int | None = LIMITS["links"]) -> DataFrame:
    """Links that reach a file or an asset, by path and line."""
    rows = all_links.where((F.col("resolved") == path) | (F.col("asset") == path))
    return _first(rows.select("path", "version", "line", "kind", "target", "anchor", "alias", "status", "resolved", "asset").orderBy("path", "line", "target"), limit)


def counters(found: DataFrame, all_links: DataFrame) -> DataFrame:
    """(file_id, title, nsections, nprops, nlinks, nlinks_broken) for listings."""
    broken = all_links.groupBy("file_id").agg(F.count_if(F.col("status").isin(*BROKEN)).alias("nlinks_broken"))
    own = found.select("file_id", "title", F.size("sections").cast("bigint").alias("nsections"), "nprops", F.size("links").cast("bigint").alias("nlinks"))
    return own.join(broken, "file_id", "left").withColumn("nlinks_broken", F.coalesce("nlinks_broken", F.lit(0)))


def lost_by_move(before: DataFrame, after: DataFrame) -> DataFrame:
    """Links of before whose file they no longer reach in after, both from links()."""
    old = before.where("resolved_id is not null").select("link_id", "path", "line", "target", "resolved_id", "resolved")
    return old.join(after.select("link_id", "resolved_id"), ["link_id", "resolved_id"], "left_anti")
