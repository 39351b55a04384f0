"""Full-text search over lines, ranked by BM25, and grep.

Terms are parsed on the driver. One pass over the texts counts each term in each document and keeps the counts; document frequency,
corpus size and the best score are one-row aggregates of those, which are broadcast. A document counts only if each term stands
on some line of it; lines are split for the documents that match only.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import paths, text
from quire.workers import checkpointed

K1, B = 1.2, 0.75
LIMIT, PER_FILE = 200, 10
WIDTH, LEAD = 300, 60


@dataclass(frozen=True)
class Term:
    words: tuple[str, ...]
    prefix: bool = False


def parse(query: str) -> list[Term]:
    """Terms of a query: words, "phrases" and prefixes*; a bare AND is dropped.

    A term that folds to several words is a phrase, whose star doesn't count; one that folds to none is dropped.
    """
    found = []
    for quoted, plain in re.findall(r'"([^"]*)"?|([^\s"]+)', query):
        raw = quoted or plain
        if plain and plain.upper() == "AND":
            continue
        starred, body = raw.endswith("*"), raw.rstrip("*")
        words = tuple(w for w in re.split(r"[\W_]+", text.fold_text(body)) if w)
        if words:
            found.append(Term(words, starred and len(words) == 1))
    return found


def _pattern(term: Term) -> str:
    """Matches a term's first word in spaced words and looks at the others, so that phrases may overlap."""
    first, *others = (re.escape(w) for w in term.words)
    return f" {first}" if term.prefix else f" {first}(?= {''.join(f'{w} ' for w in others)})"


def occurrences(spaced: Column, term: Term) -> Column:
    """How often a term stands in spaced search words."""
    return F.regexp_count(spaced, F.lit(_pattern(term)))


def holds(spaced: Column, term: Term) -> Column:
    return F.contains(spaced, F.lit(" " + " ".join(term.words) + " " * (not term.prefix)))


def window(line: Column, term: Term) -> Column:
    """A line of up to 300 characters whole; a longer one cut to 300 about the first place of a word."""
    at = F.greatest(F.instr(text.fold(line), term.words[0]) - 1 - LEAD, F.lit(0))
    cut = F.concat(F.when(at > 0, "…").otherwise(""), F.substring(line, at + 1, F.lit(WIDTH)), F.when(at + WIDTH < F.length(line), "…").otherwise(""))
    return F.when(F.length(line) <= WIDTH, line).otherwise(cut)


def line_hits(files: DataFrame, terms: list[Term]) -> DataFrame:
    """(file_id, path, version, line, text, t0..): lines that hold any term and which they hold."""
    each = files.select("file_id", "path", "version", F.posexplode(text.lines(F.col("content"))).alias("i", "text"))
    tests = [holds(text.spaced_words(F.col("text")), t).alias(f"t{k}") for k, t in enumerate(terms)]
    any_ = functools.reduce(Column.__or__, [F.col(f"t{k}") for k in range(len(terms))])
    return each.select("file_id", "path", "version", (F.col("i") + 1).cast("bigint").alias("line"), "text", *tests).where(any_)


def ranked(files: DataFrame, query: str, folder: str = "/") -> DataFrame:
    """(file_id, path, version, score) of the documents that hold every term; the best scores 1.

    Texts are read once: what is known of each document, a few numbers, is kept and all sums are taken from that.
    """
    terms = parse(query)
    scope = files.where(paths.under(F.col("path"), folder))
    if not terms:
        return scope.select("file_id", "path", "version", F.lit(0.0).alias("score")).limit(0)
    spaced, counts = text.spaced_words(F.col("content")), [f"f{k}" for k in range(len(terms))]
    whole = {f"l{k}": F.exists(text.lines(F.col("content")), functools.partial(_line_holds, t)) for k, t in enumerate(terms) if len(t.words) > 1}  # a phrase counts within a line
    found = [occurrences(spaced, t).alias(c) for c, t in zip(counts, terms, strict=True)]
    length = F.greatest(F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit(""))) - 1, F.lit(0))
    counted = checkpointed(scope.select("file_id", "path", "version", text.nwords(F.col("content")).alias("nwords"), length.alias("len"), *found, *[v.alias(k) for k, v in whole.items()]))
    corpus = counted.agg(F.count(F.lit(1)).alias("ndocs"), F.sum("nwords").alias("total"), *[F.count_if(F.col(c) > 0).alias(f"d{c}") for c in counts])
    every = counted.where(functools.reduce(Column.__and__, [F.col(c) > 0 for c in counts] + [F.col(k) for k in whole]))
    mean = F.greatest(F.col("total") / F.col("ndocs"), F.lit(1.0))
    score = F.lit(0.0)
    for c in counts:
        df, tf = F.col(f"d{c}"), F.col(c)
        idf = F.log(1 + (F.greatest("ndocs", df) - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / mean))
    scored = every.join(F.broadcast(corpus)).select("file_id", "path", "version", score.alias("raw"))
    best = scored.agg(F.max("raw").alias("best"))
    return scored.join(F.broadcast(best)).select("file_id", "path", "version", F.when(F.col("best") > 0, F.least(F.greatest(F.col("raw") / F.col("best"), F.lit(0.0)), F.lit(1.0))).otherwise(F.col("raw")).alias("score"))


def _line_holds(term: Term, line: Column) -> Column:
    return holds(text.spaced_words(line), term)


def search(files: DataFrame, query: str, folder: str = "/", limit: int | None = LIMIT, per_file: int | None = PER_FILE, sections: DataFrame | None = None) -> DataFrame:
    """Hit rows (path, version, line, text, section, score, more), best documents first, lines in order.

    more is how many lines of the document were held back by per_file (None: no limit). sections: (file_id, heading_path, level, line_from, line_to).
    """
    terms = parse(query)
    docs = ranked(files, query, folder)
    if not terms:
        return docs.select("path", "version", F.lit(0).cast("bigint").alias("line"), F.lit("").alias("text"), F.lit(None).cast("string").alias("section"), "score", F.lit(0).cast("bigint").alias("more"))
    matching = files.where(paths.under(F.col("path"), folder)).join(docs.select("file_id"), "file_id", "left_semi")
    hits = line_hits(matching, terms).join(docs.select("file_id", "score"), "file_id")
    if per_file is None:
        hits = hits.withColumn("more", F.lit(0).cast("bigint"))
    else:
        by_file = Window.partitionBy("file_id")
        hits = hits.withColumns({"n": F.row_number().over(by_file.orderBy("line")), "all": F.count(F.lit(1)).over(by_file)}).where(F.col("n") <= per_file)
        hits = hits.withColumn("more", F.greatest(F.col("all") - per_file, F.lit(0)).cast("bigint"))
    top = hits if limit is None else hits.orderBy(F.desc("score"), "path", "line").limit(limit)
    if sections is not None:
        inside = sections.select("file_id", "heading_path", "level", "line_from", "line_to")
        placed = top.select("file_id", "line").join(inside, "file_id").where("line between line_from and line_to").groupBy("file_id", "line").agg(F.max_by("heading_path", F.struct("line_from", "level")).alias("section"))
        top = top.join(placed, ["file_id", "line"], "left")
    else:
        top = top.withColumn("section", F.lit(None).cast("string"))
    return top.orderBy(F.desc("score"), "path", "line").select("path", "version", "line", window(F.col("text"), terms[0]).alias("text"), "section", "score", "more")


def document_frequency(files: DataFrame, words: list[str]) -> DataFrame:
    """(word, df): documents that hold each word."""
    wanted = [w for x in words for w in re.split(r"[\W_]+", text.fold_text(x)) if w]
    each = files.select("file_id", F.explode(F.array_distinct(text.search_words(F.col("content")))).alias("word")).where(F.col("word").isin(*wanted))
    return each.groupBy("word").agg(F.count(F.lit(1)).alias("df"))


def postings(files: DataFrame) -> DataFrame:
    """(word, file_id, tf, positions) of every search word; write it partitioned to reuse it."""
    each = files.select("file_id", F.posexplode(text.search_words(F.col("content"))).alias("at", "word"))
    return each.groupBy("word", "file_id").agg(F.count(F.lit(1)).alias("tf"), F.sort_array(F.collect_list("at")).alias("positions"))


def grep(files: DataFrame, pattern: str, folder: str = "/", ignore_case: bool = False, fixed: bool = False) -> DataFrame:
    """Hit rows of lines that match, without score, by path and line. Look-around and back references are refused."""
    if not fixed and re.search(r"\(\?[=!<]|\\[1-9]", pattern):
        raise ValueError("look-around and back references aren't supported")
    regex = ("(?i)" if ignore_case else "") + (r"\Q" + pattern.replace(r"\E", r"\E\\E\Q") + r"\E" if fixed else pattern)
    scope = files.where(paths.under(F.col("path"), folder))
    lines = scope.select("path", "version", F.posexplode(text.lines(F.col("content"))).alias("i", "text"))
    found = lines.where(F.contains("text", F.lit(pattern)) if fixed and not ignore_case else F.col("text").rlike(regex))
    return found.select("path", "version", (F.col("i") + 1).cast("bigint").alias("line"), "text", F.lit(None).cast("string").alias("section"), F.lit(None).cast("double").alias("score"), F.lit(0).cast("bigint").alias("more")).orderBy("path", "line")


def per_file(hits: DataFrame) -> DataFrame:
    """(path, version, matches) of hit rows, those held back included."""
    return hits.groupBy("path", "version").agg((F.count(F.lit(1)) + F.max("more")).alias("matches"))
