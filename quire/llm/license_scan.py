"""License scan: ordered signature rules behind a keyword prefilter.

A text becomes its words, each between spaces of its own, so that a rule's match has word bounds on both sides
and matches side by side don't share a space. A family's rules run only where its keyword, which every match of them
holds, occurs. Every match is an interval with its rule's priority; in
order of start, longest first, a match is dropped if a match of the same or a higher priority holds it. What
remains gives labels and score. All of it is one row's own expression: no shuffle, no Python.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Everything but 0-9, a-z and what isn't ASCII parts words.
PARTS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: (phrase, label) whose every place counts, overlapped or not.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Families: label, keyword (it occurs in every text that a rule of the family matches), the ways to write
# the name, and the versions that make a label of their own. In names and templates a word? may be missing, (a|b) is
# either word, and * is any one word.
FAMILIES = (
    ("mit", "mit", ("mit", "mit x11", "mit expat"), ()),
    ("apache", "apache", ("apache", "apache software", "apache software foundation"), ("1 0", "1 1", "2 0", "2")),
    ("bsd", "bsd", ("bsd", "bsd style", "berkeley software distribution bsd"), ("0 clause", "1 clause", "2 clause", "3 clause", "4 clause")),
    ("gpl", "gpl", ("gnu? gpl",), ("1", "2", "3", "1 0", "2 0", "3 0")),
    ("lgpl", "lgpl", ("gnu? lgpl",), ("2", "2 1", "3", "3 0")),
    ("agpl", "agpl", ("gnu? agpl",), ("1", "3", "3 0")),
    ("gpl", "general public", ("gnu? general public",), ("1", "2", "3", "2 0", "3 0")),
    ("lgpl", "lesser general", ("gnu? lesser general public",), ("2 1", "3", "3 0")),
    ("lgpl", "library general", ("gnu? library general public",), ("2", "2 0")),
    ("agpl", "affero general", ("gnu? affero general public",), ("1", "3", "3 0")),
    ("gfdl", "free documentation", ("gnu? free documentation",), ("1 1", "1 2", "1 3")),
    ("mpl", "mozilla", ("mozilla public",), ("1 0", "1 1", "2 0")),
    ("mpl", "mpl", ("mpl",), ("1 0", "1 1", "2 0")),
    ("epl", "eclipse", ("eclipse public",), ("1 0", "2 0")),
    ("cddl", "common development", ("common development and distribution",), ("1 0", "1 1")),
    ("cpl", "common public", ("common public",), ("1 0",)),
    ("eupl", "european union", ("european union public",), ("1 1", "1 2")),
    ("artistic", "artistic", ("artistic", "perl artistic"), ("1 0", "2 0")),
    ("boost", "boost", ("boost software",), ("1 0",)),
    ("zlib", "zlib", ("zlib", "zlib libpng"), ()),
    ("isc", "isc", ("isc", "internet systems consortium isc"), ()),
    ("unlicense", "unlicense", ("unlicense",), ()),
    ("wtfpl", "wtfpl", ("wtfpl",), ("2",)),
    ("ofl", "open font", ("sil? open font",), ("1 0", "1 1")),
    ("odbl", "open database", ("open database", "open data commons open database"), ("1 0",)),
    ("python", "python", ("python software foundation", "python"), ("2", "2 0")),
    ("php", "php", ("php",), ("3 0", "3 01")),
    ("openssl", "openssl", ("openssl",), ()),
    ("ms-pl", "microsoft", ("microsoft public",), ()),
    ("ms-rl", "microsoft", ("microsoft reciprocal",), ()),
    ("bsl", "business source", ("business source",), ("1 1",)),
    ("sspl", "server side", ("server side public",), ("1",)),
    ("elastic", "elastic", ("elastic",), ("2 0",)),
    ("postgresql", "postgresql", ("postgresql",), ()),
    ("ncsa", "ncsa", ("ncsa", "university of illinois ncsa open source"), ()),
    ("vim", "vim", ("vim",), ()),
    ("ruby", "ruby", ("ruby",), ()),
    ("osl", "open software", ("open software",), ("1 0", "2 1", "3 0")),
    ("afl", "academic free", ("academic free",), ("2 1", "3 0")),
    ("cecill", "cecill", ("cecill",), ("2", "2 1")),
    ("proprietary", "commercial", ("commercial", "proprietary commercial"), ()),
    ("proprietary", "proprietary", ("proprietary",), ()),
)
#: (how a name stands in a text, priority, confidence)
NAMED = (("{} (license|licence)", 1, 0.7), ("(licensed|released|distributed|available|published|provided) under the? {}", 2, 0.9), ("under the? terms (of|and) * {}", 2, 0.9), ("spdx license identifier {}", 3, 1.0), ("(license|licence) {}", 1, 0.8))
VERSIONED = (("{} (license|licence)? version? {}", 2, 0.95), ("{} (license|licence)? v{}", 2, 0.95), ("spdx license identifier {} {}", 3, 1.0))
CREATIVE = tuple((f"cc-{'-'.join(kind)}", " ".join(kind)) for kind in (("by",), ("by", "sa"), ("by", "nc"), ("by", "nd"), ("by", "nc", "sa"), ("by", "nc", "nd")))
WORDED = {"by": "attribution", "sa": "share? (alike|sharealike)", "nc": "(noncommercial|non) commercial?", "nd": "(noderivatives|noderivs|no) (derivatives|derivs)?"}
#: Keywords that are parts of words; all others are whole words.
STEMS = ("warrant",)
#: Single rules: (label, keyword, words, priority, confidence)
SINGLE = (
    ("cc0", "cc0", "cc0", 2, 0.9),
    ("cc0", "creative commons", "creative commons (zero|0|cc0)", 2, 0.9),
    ("public-domain", "public domain", "public domain", 0, 0.5),
    ("public-domain", "public domain", "(dedicated|released|placed) (to|into|in) the public domain", 2, 0.9),
    ("copyright", "copyright", "copyright", 0, 0.2),
    ("copyright", "copyright", "copyright c? * * ?", 1, 0.3),
    ("mit", "permission is hereby", "permission is hereby granted free of charge to any person obtaining a copy", 3, 1.0),
    ("isc", "permission to use", "permission to use copy modify and or? distribute this software for any purpose", 3, 1.0),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms", 3, 1.0),
    ("no-warranty", "warrant", "without warrant(y|ies) of any kind", 1, 0.4),
    ("no-warranty", "warrant", "without any? (express|implied)? (warranty|warranties)", 1, 0.4),
    ("gpl", "gnu", "gnu gpl", 1, 0.8),
    ("open-source", "open source", "open source (license|licence|software)", 0, 0.3),
    ("proprietary", "no part of", "no part of this * may be reproduced", 2, 0.9),
)


def _pattern(words: str) -> str:
    """The regular expression of a rule's words over spaced words; spaces on the outside included."""
    out = []
    for w in words.split():
        if w in ("?", "*"):
            out.append("(?: [^ ]+ )?" if w == "?" else " [^ ]+ ")
        else:
            body, maybe = w.removesuffix("?"), w.endswith("?")
            body = body.replace("(", "(?:")
            out.append(f"(?: {body} )?" if maybe else f" {body} ")
    return "".join(out)


@cache
def rules() -> tuple[tuple[str, str, str, int, float], ...]:
    """(label, keyword, regular expression, priority, confidence) of every rule, in order."""
    found = [(label, phrase, _pattern(phrase), 1, 0.6) for phrase, label in BASE]
    for label, keyword, names, versions in FAMILIES:
        for name in names:
            found += [(label, keyword, _pattern(words.format(name)), priority, sure) for words, priority, sure in NAMED]
            ways = VERSIONED if label != "bsd" else (("{1} {0}", 2, 0.95), ("{0} {1}", 2, 0.95))
            found += [(f"{label}-{version.replace(' ', '-' if label == 'bsd' else '.')}", keyword, _pattern(words.format(name, version)), priority, sure) for version in versions for words, priority, sure in ways]
    for label, kind in CREATIVE:
        found.append((label, "cc", _pattern(f"cc {kind}"), 1, 0.8))
        found += [(f"{label}-{v.replace(' ', '.')}", "cc", _pattern(f"cc {kind} {v}"), 2, 0.95) for v in ("1 0", "2 0", "2 5", "3 0", "4 0")]
        long = " ".join(WORDED[k] for k in kind.split())
        found.append((label, "creative commons", _pattern(f"creative commons {long}"), 2, 0.9))
    found += [(label, keyword, _pattern(words), priority, sure) for label, keyword, words, priority, sure in SINGLE]
    # one rule per expression: the first
    return tuple({r[2]: r for r in reversed(found)}.values())[::-1]


def spaced(text: Column) -> Column:
    """Lower-cased words of a text (null: none), each between two spaces of its own; ' a  b '."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), PARTS, " "))
    return F.when(plain == "", F.lit("")).otherwise(F.concat(F.lit(" "), F.replace(plain, F.lit(" "), F.lit("  ")), F.lit(" ")))


def _words_in(text: Column) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))) / 2).cast("bigint")


def _phrase(phrase: str) -> str:
    return "".join(f" {w} " for w in phrase.split())


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_words, n_base, first_word, last_word, base_labels, labels and score of each whole text.

    n_base counts all places of the base phrases, first_word and last_word are the least and greatest start of
    one (words from 0; null without one). base_labels and labels are distinct, sorted and comma-joined (empty without
    any); labels holds those of the base and of the rules' matches that no other suppresses; score is the greatest
    confidence among them, 0 without any. Null texts have no words. Columns of df that have these names are replaced.
    Repeated rows are scanned each for itself.
    """
    new = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    kept = [c for c in df.columns if c not in (*new, "__text")]
    rows = df.select(*[F.col(f"`{c}`") for c in kept], spaced(F.col(text)).alias("__text"))
    body = F.col("__text")
    places = [F.when(body.contains(_phrase(p)), ((F.length(body) - F.length(F.replace(body, F.lit(_phrase(p)), F.lit("")))) / len(_phrase(p))).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for p, _ in BASE]
    rows = rows.withColumns({f"__n{i}": n for i, n in enumerate(places)} | {"n_words": _words_in(body)})
    firsts = [F.when(F.col(f"__n{i}") > 0, _words_in(F.substring_index(body, _phrase(p), 1))) for i, (p, _) in enumerate(BASE)]
    lasts = [F.when(F.col(f"__n{i}") > 0, F.col("n_words") - _words_in(F.substring_index(body, _phrase(p), -1)) - len(p.split())) for i, (p, _) in enumerate(BASE)]
    base = F.array_compact(F.array(*[F.when(F.col(f"__n{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(BASE)]))
    rows = rows.withColumns({"n_base": sum((F.col(f"__n{i}") for i in range(1, len(BASE))), F.col("__n0")), "first_word": F.least(*firsts), "last_word": F.greatest(*lasts), "__base": base, "__found": _survivors(body)})
    every = F.array_distinct(F.concat("__base", F.coalesce(F.col("__found.labels"), F.array().cast("array<string>"))))
    sure = F.greatest(F.coalesce(F.col("__found.sure"), F.lit(0.0)), F.when(F.size("__base") > 0, F.lit(0.6)).otherwise(F.lit(0.0)))
    return rows.select(*[F.col(f"`{c}`") for c in kept if c != text], *([F.col(f"`{text}`")] if text in kept else []), "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort(F.array_distinct("__base")), ",").alias("base_labels"), F.array_join(F.array_sort(every), ",").alias("labels"), sure.alias("score"))


def _survivors(body: Column) -> Column:
    """struct(labels, sure) of the matches in spaced words that no other suppresses."""
    by_keyword: dict[str, list] = {}
    for r in rules():
        by_keyword.setdefault(r[1], []).append(r)
    quoted = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    groups = "array(" + ", ".join(f"named_struct('k', {quoted(_phrase(k) if k not in STEMS else k)}, 'r', array(" + ", ".join(f"named_struct('l', {quoted(label)}, 'e', {quoted(e)}, 'p', {p}, 's', {s}D)" for label, _, e, p, s in own) + "))" for k, own in by_keyword.items()) + ")"
    due = F.flatten(F.transform(F.filter(F.expr(groups), lambda g: body.contains(g["k"])), lambda g: g["r"]))

    def intervals(rule: Column) -> Column:
        """(start, -stop, -priority, label, confidence) of the rule's matches."""
        got, between = F.regexp_extract_all(body, rule["e"], F.lit(0)), F.split(body, rule["e"], -1)
        lengths = F.zip_with(between, got, lambda b, g: F.struct(F.length(b).alias("b"), F.coalesce(F.length(g), F.lit(-1)).alias("g")))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,z:int,p:int,l:string,s:double>>").alias("out"))

        def step(state: Column, x: Column) -> Column:
            a = state["at"] + x["b"]
            row = F.struct(a.alias("a"), (-(a + x["g"])).alias("z"), (-rule["p"]).alias("p"), rule["l"].alias("l"), rule["s"].alias("s"))
            return F.struct((a + F.greatest(x["g"], F.lit(0))).alias("at"), F.when(x["g"] < 0, state["out"]).otherwise(F.concat(state["out"], F.array(row))).alias("out"))

        return F.aggregate(lengths, start, step, lambda state: state["out"])

    matches = F.array_sort(F.flatten(F.transform(F.filter(due, lambda r: F.regexp_like(body, r["e"])), intervals)))
    most = max(r[3] for r in rules())
    begin = F.struct(F.array_repeat(F.lit(-1), most + 1).alias("reach"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("sure"))

    def sweep(state: Column, m: Column) -> Column:
        held = F.exists(F.slice(state["reach"], 1 - m["p"], most + 1 + m["p"]), lambda end: end >= -m["z"])
        reach = F.transform(state["reach"], lambda end, i: F.when((i == -m["p"]) & (end < -m["z"]), -m["z"]).otherwise(end))
        return F.struct(
            reach.alias("reach"),
            F.when(held | F.array_contains(state["labels"], m["l"]), state["labels"]).otherwise(F.concat(state["labels"], F.array(m["l"]))).alias("labels"),
            F.when(held, state["sure"]).otherwise(F.greatest(state["sure"], m["s"])).alias("sure"),
        )

    return F.aggregate(matches, begin, sweep, lambda state: F.struct(state["labels"].alias("labels"), state["sure"].alias("sure")))
