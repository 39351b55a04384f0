"""Markdown, merges, chunks, search terms and property queries as plain functions."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import access, chunking, markdown, merge, search, structure
from quire.operators.history import CONFLICT, INVALID, File

DOC = "---\ntitle: Test doc\ntags: [a, b]\ndraft: false\n---\n# Intro\n\nSee [[Other Note]] and [local](./x.md) and [web](https://example.com).\n\n## Goals\nline\n\n### Detail\nmore\n\n## Scope\nend\n# Second\ntail"


def test_sections():
    got = [(s["heading_path"], s["level"], s["line_from"], s["line_to"]) for s in markdown.sections(DOC)]
    assert got == [("Intro", 1, 6, 17), ("Intro / Goals", 2, 10, 15), ("Intro / Goals / Detail", 3, 13, 15), ("Intro / Scope", 2, 16, 17), ("Second", 1, 18, 19)]
    words = {s["heading"]: (s["nwords"], s["nwords_total"]) for s in markdown.sections(DOC)}
    assert words["Goals"] == (3, 6) and words["Detail"] == (3, 3)


def test_front_matter():
    block, _ = markdown.split_front_matter(DOC)
    assert markdown.parse_yaml(block) == {"title": "Test doc", "tags": ["a", "b"], "draft": False}
    assert markdown.split_front_matter("---\nno end\n") == (None, 0)
    nested = markdown.parse_yaml('a: 1 # one\nb:\n  c: "x # y"\n  d:\n    - 1\n    - two\ne: null\n')
    assert nested == {"a": 1, "b": {"c": "x # y", "d": [1, "two"]}, "e": None}
    assert markdown.flatten(nested) == [("a", "1", 1.0, 0), ("b.c", "x # y", None, 0), ("b.d", "1", 1.0, 0), ("b.d", "two", None, 1), ("e", None, None, 0)]


def test_headings_outside_code():
    assert markdown.headings("```\n# no\n```\n# yes #\n\ntext\n===\n    # code\n") == [(4, 1, "yes"), (6, 1, "text")]


def test_links():
    got = [(x["line"], x["kind"], x["target"], x["external"]) for x in markdown.links(DOC)]
    assert got == [(8, "wiki", "Other Note", False), (8, "md", "./x.md", False), (8, "md", "https://example.com", True)]
    got = markdown.links("`[[no]]` ![[pic.png|p]] [[A#B\\|c]] ![alt](a%20b.png#x) <https://x.y>")
    assert [(x["kind"], x["target"], x["anchor"], x["alias"]) for x in got] == [("embed", "pic.png", None, "p"), ("wiki", "A", "B", "c"), ("image", "a b.png", "x", "alt"), ("md", "https://x.y", None, None)]


TEXT = st.lists(st.sampled_from(["a\n", "b\n", "c\n", "d\n"]), max_size=12).map("".join)


@settings(max_examples=200, deadline=None)
@given(TEXT, TEXT)
def test_hunks_patch(a, b):
    assert merge.apply_hunks(a, merge.hunks(a, b)) == b
    assert (merge.unified(a, b) == "") == (a == b)


@settings(max_examples=100, deadline=None)
@given(TEXT, TEXT)
def test_merge_with_unchanged_side(base, theirs):
    assert merge.merge3(base, base, theirs)[:2] == (theirs, 0)
    assert merge.merge3(base, theirs, theirs)[:2] == (theirs, 0)


def test_merge_and_conflict():
    base = "line one\nline two\nline three\nline four\n"
    ours, theirs = base.replace("line one", "LINE ONE"), base.replace("line four", "LINE FOUR")
    assert merge.merge3(base, ours, theirs)[0] == "LINE ONE\nline two\nline three\nLINE FOUR\n"
    merged, conflicts, where = merge.merge3(base, ours, base.replace("line one", "Line 1"))
    assert merged is None and conflicts == 1 and where == (0, 1)


def test_fold():
    f = File()
    assert f.apply("create", {"content": "line one\nline two\nline three\nline four\n"}, None)["kind"] == "direct"
    f.apply("write", {"content": f.head.replace("line one", "LINE ONE")}, 1)
    assert f.apply("write", {"content": f.versions[0].replace("line four", "LINE FOUR")}, 1)["kind"] == "rebased"
    assert f.head == "LINE ONE\nline two\nline three\nLINE FOUR\n"
    got = f.apply("write", {"content": f.versions[0].replace("line one", "Line 1")}, 1)
    assert got["status"] == CONFLICT and got["theirs"] == "LINE ONE\n" and got["region_from"] == 1
    assert f.apply("edit", {"old": "absent", "new": "x"}, None)["status"] == INVALID
    assert f.apply("append", {"content": "tail\n"}, None)["kind"] == "direct" and len(f.versions) == 4
    assert f.apply("replace_lines", {"first": 5, "last": 5, "new": "end\n"}, 4)["kind"] == "direct" and f.head.endswith("FOUR\nend\n")


def test_chunks():
    draw = random.Random(3)
    data = "".join(draw.choice("abcdefgh \n") for _ in range(60_000)).encode()
    ends = chunking.cuts(data)
    sizes = [b - a for a, b in zip([0, *ends], ends, strict=False)]
    assert ends[-1] == len(data) and all(chunking.SMALLEST < s <= chunking.LARGEST + chunking.SNAP for s in sizes[:-1])
    edited = data[:30_000] + b"inserted" + data[30_000:]
    pieces = lambda d: {d[a:b] for a, b in zip([0, *chunking.cuts(d)], chunking.cuts(d), strict=False)}
    assert len(pieces(data) - pieces(edited)) <= 3
    assert chunking.cuts(b"") == [] and chunking.cuts(b"x" * 512) == [512]


def slow_cuts(data):
    out, at = [], 0
    while at < len(data):
        n = len(data) - at
        end, h = min(n, chunking.LARGEST), 0
        hit = n <= chunking.SMALLEST
        for i in range(chunking.SMALLEST, end) if not hit else ():
            h = ((h << 1) + int(chunking.GEAR[data[at + i]])) % (1 << 64)
            if not h & int(chunking.EARLY if i < chunking.USUAL else chunking.LATE):
                end, hit = i + 1, True
                break
        if n > chunking.SMALLEST and (hit or end < n) and data[at + end - 1] != 10:
            feed = data.find(b"\n", at + end, at + end + chunking.SNAP)
            end = feed + 1 - at if feed >= 0 else end
        out.append(at + end)
        at += end
    return out


def test_chunks_as_one_byte_at_a_time():
    draw = random.Random(5)
    for _ in range(5):
        data = bytes(draw.choice(b"abcd\n ") if draw.random() < 0.99 else 10 for _ in range(draw.randrange(20_000)))
        assert chunking.cuts(data) == slow_cuts(data)


def test_terms():
    T = search.Term
    assert search.parse('Quick "Brown fox" AND pre* foo-bar* "" …') == [T(("quick",)), T(("brown", "fox")), T(("pre",), True), T(("foo", "bar"))]
    assert search.parse("Élan ÇA") == [T(("elan",)), T(("ca",))]


def test_property_queries():
    q = structure.parse_query
    assert q("a:1 OR b:2 c:3") == ("or", [("term", "a", "=", "1"), ("and", [("term", "b", "=", "2"), ("term", "c", "=", "3")])])
    assert q("-(a:* NOT b:x*)") == ("not", ("and", [("term", "a", "exists", ""), ("not", ("term", "b", "prefix", "x"))]))
    assert q('s:">3" n:>=3 t:~x has:k') == ("and", [("term", "s", "=", ">3"), ("term", "n", ">=", "3"), ("term", "t", "~", "x"), ("term", "k", "exists", "")])
    assert q("") == ("all",)
    for bad in ("word", "a:", ":x", "(a:1", "a:1 OR", "has:", "a:>"):
        with pytest.raises(structure.QueryError):
            q(bad)


def test_grants():
    grants = [{"root": "/team/docs", "rights": "rw"}, {"root": "/b", "alias": "old", "state": "revoked"}]
    assert access.to_store(grants, "/docs/x.md", True) == "/team/docs/x.md"
    for bad in ("/nowhere/x", "/old/x"):
        with pytest.raises(access.AccessError):
            access.to_store(grants, bad)
    for clash in ([{"root": "/"}], [{"root": "/a"}, {"root": "/a/b"}], [{"root": "/a/x"}, {"root": "/b/x"}]):
        with pytest.raises(access.AccessError):
            access.check(clash)


def test_hidden_links():
    text = "see [[in]] and [[out]]"
    spans = [{"at": 6, "target": "in", "resolved": "/team/in.md", "resolved_id": 1}, {"at": 17, "target": "out", "resolved": "/else/out.md", "resolved_id": 2}]
    assert access.project_links(text, spans, [{"root": "/team"}]) == "see [[in]] and [[node:2]]"


def test_set_property():
    text = "---\na: 1\nlist:\n  - x\n  - y\nb: two\n---\nbody\n"
    assert markdown.set_property(text, "a", 5) == text.replace("a: 1", "a: 5")
    assert markdown.set_property(text, "list", ["p", "q r"]) == text.replace("list:\n  - x\n  - y", "list: [p, q r]")
    assert markdown.set_property(text, "c", "x: y") == text.replace("b: two\n", 'b: two\nc: "x: y"\n')
    assert markdown.set_property(text, "list", None, remove=True) == text.replace("list:\n  - x\n  - y\n", "")
    assert markdown.set_property("body\r\n", "k", True) == "---\r\nk: true\r\n---\r\nbody\r\n"
    assert markdown.set_property("\ufeff---\nk: 1\n---\n", "k", "true") == '\ufeff---\nk: "true"\n---\n'
    assert markdown.set_property("plain", "k", None, remove=True) == "plain"


def test_retargeted():
    text = "[a](./old.md#x) [[old]] [[dir/old.md|y]] ![i](/dir/old.md)\n"
    places = {x["at"]: "/new place/here.md" for x in markdown.links(text)}
    assert markdown.retargeted(text, places, "/dir/me.md") == "[a](./../new%20place/here.md#x) [[here]] [[new place/here.md|y]] ![i](/new%20place/here.md)\n"


@pytest.mark.parametrize(
    ("line", "value"),
    [
        ("a: 'it''s # x'", "it's # x"),
        ("a: 'it''s' # note", "it's"),
        ('a: "x \\" # y" # z', 'x " # y'),
        ("a: b#c # d", "b#c"),
        ("a: it's # fine", "it's"),
        ("a: [1, 'two, three', \"fo,ur\", [5, 6]]", [1, "two, three", "fo,ur", [5, 6]]),
        ("a: ['it''s', x] # y", ["it's", "x"]),
        ("a: [ , x, ]", ["x"]),
        ("a: [{b: 1, c: 2}, d]", ["{b: 1, c: 2}", "d"]),
    ],
)
def test_yaml_quotes_and_comments(line, value):
    assert markdown.parse_yaml(line + "\n") == {"a": value}


def test_flatten_keeps_order():
    value = {"a": [1, {"b": None, "c": True}], "d": {"e": {"f": "x"}}, "g": 1.5}
    assert markdown.flatten(value) == [("a", "1", 1.0, 0), ("a.b", None, None, 1), ("a.c", "true", None, 1), ("d.e.f", "x", None, 0), ("g", "1.5", 1.5, 0)]
    assert markdown.flatten([1]) == markdown.flatten(None) == []


def test_query_grammar():
    q, t = structure.parse_query, lambda k: ("term", k, "=", "1")
    assert q("a:1 b:1 OR NOT c:1") == ("or", [("and", [t("a"), t("b")]), ("not", t("c"))])
    assert q("-(a:1 OR b:1) AND c:1") == ("and", [("not", ("or", [t("a"), t("b")])), t("c")])
    assert q("--a:1") == ("not", ("not", t("a"))) and q("  ") == ("all",)
    assert q('a:"x (y" b:1') == ("and", [("term", "a", "=", "x (y"), t("b")])
    for query, at in [("a:1 OR", 6), ("(a:1", 0), ("a:1)", 3), ("AND a:1", 0), ('é:"x', 3), ("()", 1), ("a:1 NOT", 7), ("a:1 OR AND b:1", 7), ("a:", 0)]:
        with pytest.raises(structure.QueryError) as e:
            q(query)
        assert e.value.at == at, query


def test_term_counts(spark):
    """Overlapping phrases, prefixes and folded words; a line of 50,000 words takes no longer than its length says."""
    rows = [("a a a b",), ("Élan, vital-élan",), ("",), (None,), ("...",), ("x " * 50_000 + "rights reserved",)]
    df = spark.createDataFrame(rows, "text string")
    spaced = text.spaced_words(F.col("text"))
    T = search.Term
    terms = [T(("a", "a")), T(("elan",)), T(("vi",), True), T(("rights", "reserved")), T(("x",))]
    got = df.select(*[search.occurrences(spaced, t) for t in terms], *[search.holds(spaced, t) for t in terms]).collect()
    assert [tuple(r)[:5] for r in got] == [(2, 0, 0, 0, 0), (0, 2, 1, 0, 0), (0,) * 5, (None,) * 5, (0,) * 5, (0, 0, 0, 1, 50_000)]
    assert all((r[k] or 0) > 0 if r[k + 5] else not r[k] for r in got for k in range(5))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=14), st.lists(st.sampled_from("abc"), max_size=14))
def test_diff_is_shortest(a, b):
    """Hunks rebuild the new text and hold as few edits as the longest common subsequence allows."""
    hunks = merge.diff(a, b)
    out, at = [], 0
    for x, x_to, y, y_to in hunks:
        assert a[at:x] == b[len(out) : y]
        out += a[at:x] + b[y:y_to]
        at = x_to
    assert out + a[at:] == b
    common = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            common[i + 1][j + 1] = common[i][j] + 1 if x == y else max(common[i][j + 1], common[i + 1][j])
    assert sum(x_to - x + y_to - y for x, x_to, y, y_to in hunks) == len(a) + len(b) - 2 * common[-1][-1]
    assert merge.diff(a, b, 0) == ([] if a == b else merge.diff(a, b, 0)) and len(merge.diff(a, b, 0)) <= 1
