"""URL rules with redirect equivalence.

A rule names a host and a path prefix and fits that host, its subdomains and every path that starts with its own;
the longest rule that fits decides. Pages without a rule take the decision of their aliases: redirects and
canonical links join URLs into components, and a component that holds a blocked URL blocks all its members
without a rule. An explicit allow always stands. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import components, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules of the registered query: (host, path, verdict).
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Where a page names the URL that it stands for or leads to; group 1 is the target.
TARGETS = (
    r"""<link\s[^>]*rel\s*=\s*["']?canonical["'\s][^>]*href\s*=\s*["']?([^"'\s>]+)""",
    r"""<link\s[^>]*href\s*=\s*["']?([^"'\s>]+)["']?\s[^>]*rel\s*=\s*["']?canonical\b""",
    r"""<meta\s[^>]*http-equiv\s*=\s*["']?refresh["'\s][^>]*content\s*=\s*["'][^"'>]*url\s*=\s*([^"'\s>]+)""",
    r"""<meta\s[^>]*content\s*=\s*["'][^"'>]*url\s*=\s*([^"'\s>]+)["'][^>]*http-equiv\s*=\s*["']?refresh\b""",
)


def _rest(url: Column) -> Column:
    """What follows the first ://, or an empty text."""
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null and without ://."""
    return F.translate(F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty for null and without ://."""
    return F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def key_of(url: Column) -> Column:
    """A URL without scheme and fragment, its host lower-cased: what aliases are told apart by."""
    query = F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^?#]*(\?[^#]*)", 1)
    return F.concat(host_of(url), path_of(url), query)


def _longest(rules, host: Column, path: Column, value) -> Column:
    """value(rule) of the longest rule that fits; of equally long ones the first by host and path."""
    out = None
    for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0], r[1])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        out = F.when(fits, value(h, p, verdict)) if out is None else out.when(fits, value(h, p, verdict))
    return F.lit(None).cast("string") if out is None else out


def rule_of(rules, host: Column, path: Column) -> Column:
    return _longest(rules, host, path, lambda h, p, _: F.lit(h + p))


def verdict_of(rules, host: Column, path: Column) -> Column:
    return _longest(rules, host, path, lambda _h, _p, verdict: F.lit(verdict))


def _absolute(target: Column, host: Column, path: Column) -> Column:
    folder = F.regexp_extract(path, r"^(.*/)", 1)
    return (
        F.when(F.instr(target, "://") > 0, target)
        .when(F.startswith(target, F.lit("//")), F.concat(F.lit("http:"), target))
        .when(F.startswith(target, F.lit("/")), F.concat(F.lit("http://"), host, target))
        .otherwise(F.concat(F.lit("http://"), host, F.when(folder == "", "/").otherwise(folder), target))
    )


def aliases(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(source, target) URLs: where each of a page's canonical links and refreshes leads; pages without one give no row."""
    host, path = host_of(F.col(url)), path_of(F.col(url))
    found = [F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(f"(?is){t}"), F.lit(1)) for t in TARGETS]
    marked = pages.where(F.col(html).rlike(r"(?i)canonical|http-equiv") & (host != ""))
    told = marked.select(F.col(url).alias("source"), host.alias("host"), path.alias("path"), F.explode(F.array_distinct(F.flatten(F.array(*found)))).alias("found"))
    return told.where("found <> ''").select("source", _absolute(F.col("found"), F.col("host"), F.col("path")).alias("target"))


def judge(pages: DataFrame, rules=RULES, links: DataFrame | None = None, url: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict; columns of these names are replaced.

    links: (source, target) URLs that stand for each other. A page without a rule is blocked if its component
    holds a URL, page or not, whose rule blocks it, else allowed. Null URLs and URLs without :// have
    empty host and path, no rule and no alias. Rules are a list that fits in a query; pages and links may be
    of any size, and a URL or a link's target may be in a third of all rows.
    """
    host, path = host_of(F.col(url)), path_of(F.col(url))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    judged = pages.select(*[F.col(f"`{c}`") for c in kept], host.alias("host"), path.alias("path"), key_of(F.col(url)).alias("__key"))
    judged = judged.withColumns({"rule": rule_of(rules, F.col("host"), F.col("path")), "__own": verdict_of(rules, F.col("host"), F.col("path"))})
    if links is None:
        return judged.select(*[F.col(f"`{c}`") for c in kept], "host", "path", "rule", F.coalesce("__own", F.lit("allow")).alias("verdict"))
    ends = stored(links.select(key_of(F.col("source")).alias("u"), key_of(F.col("target")).alias("v")))
    roots = components(ends.where("u rlike '^[^/?]' and v rlike '^[^/?]'"))
    # a key holds host and path, so a node's own verdict needs no join
    blocked = verdict_of(rules, F.regexp_extract("node", r"^([^/?#]*)", 1), F.regexp_extract("node", r"^[^/?#]*([^?#]*)", 1)) == "block"
    verdicts = roots.groupBy("root").agg(F.max(F.coalesce(blocked, F.lit(False))).alias("blocked")).where("blocked").select("root")
    hit = roots.join(verdicts, "root").select(F.col("node").alias("__key"), F.lit("block").alias("__alias"))
    out = judged.join(hit, "__key", "left")
    return out.select(*[F.col(f"`{c}`") for c in kept], "host", "path", "rule", F.coalesce("__own", "__alias", F.lit("allow")).alias("verdict"))


def oracle(rules=RULES) -> str:
    """DuckDB's form of judge() over pages."""
    targets = [t.replace("'", "''") for t in TARGETS]
    rest = "coalesce(case when instr({0}, '://') > 0 then substr({0}, instr({0}, '://') + 3) else '' end, '')"
    host = lambda u: f"translate(regexp_extract({rest.format(u)}, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}')"
    path = lambda u: f"regexp_extract({rest.format(u)}, '^[^/?#]*([^?#]*)', 1)"
    key = lambda u: f"{host(u)} || {path(u)} || regexp_extract({rest.format(u)}, '^[^?#]*(\\?[^#]*)', 1)"
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0], r[1]))
    pick = lambda h, p, value: "case " + " ".join(f"when ({h} = '{r[0]}' or ends_with({h}, '.{r[0]}')) and starts_with({p}, '{r[1]}') then '{value(r)}'" for r in ordered) + " end"
    found = ", ".join(f"nullif(regexp_extract(coalesce(html, ''), '{t}', 1, 'is'), '')" for t in targets)
    folder = "regexp_extract(path, '^(.*/)', 1)"
    return f"""
WITH RECURSIVE own AS (
  SELECT page_id, url, {host('url')} AS host, {path('url')} AS path, {key('url')} AS k, coalesce({found}) AS t FROM pages
), linked AS (
  SELECT k, CASE WHEN instr(t, '://') > 0 THEN t WHEN starts_with(t, '//') THEN 'http:' || t WHEN starts_with(t, '/') THEN 'http://' || host || t
    ELSE 'http://' || host || (CASE WHEN {folder} = '' THEN '/' ELSE {folder} END) || t END AS target
  FROM own WHERE t IS NOT NULL AND host <> ''
), edges AS (
  SELECT k AS u, {key('target')} AS v FROM linked WHERE {host('target')} <> ''
), both_ways AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges),
reach(node, other) AS (
  SELECT u, v FROM both_ways UNION SELECT r.node, b.v FROM reach r JOIN both_ways b ON r.other = b.u
), hit AS (
  SELECT DISTINCT node FROM reach WHERE {pick("regexp_extract(other, '^([^/?#]*)', 1)", "regexp_extract(other, '^[^/?#]*([^?#]*)', 1)", lambda r: r[2])} = 'block'
)
SELECT page_id, host, path, {pick('host', 'path', lambda r: r[0] + r[1])} AS rule,
  coalesce({pick('host', 'path', lambda r: r[2])}, CASE WHEN hit.node IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM own LEFT JOIN hit ON hit.node = own.k"""
