"""Queries over vaults made from the driver's tables, with DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import paths, text
from quire.operators import access, chunking, history, listing, merge, search, structure, sync
from quire.sources import vault
from quire.streaming import feed

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

VAULT = f"""v AS (SELECT doc_id AS file_id, {vault.PATH} AS path, {vault.CONTENT} AS content, source AS author, doc_id AS created FROM documents)"""
COUNTED = """m AS (SELECT *, CAST(strlen(content) AS BIGINT) AS nbytes, CAST(length(content) - length(replace(content, chr(10), '')) AS BIGINT) AS nlines,
  CAST(len(regexp_extract_all(content, '[^ \\t\\n\\r\\f\\v]+')) AS BIGINT) AS nwords FROM v)"""
FOLDERS = """a AS (SELECT m.*, unnest(['/', '/' || split_part(path, '/', 2), '/' || split_part(path, '/', 2) || '/' || split_part(path, '/', 3)]) AS folder FROM m)"""
LINES = """l AS (SELECT file_id, path, content, unnest(range(1, len(t) + 1)) AS line, unnest(t) AS text FROM (SELECT *, string_split(rtrim(content, chr(10)), chr(10)) AS t FROM v))"""
CHATS = """c AS (SELECT conv_id AS file_id, '/chat/c' || lpad(CAST(conv_id AS VARCHAR), 6, '0') || '.md' AS path, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS version, role AS author,
  string_agg(text || chr(10), '') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS content FROM conversations)"""
WORDS = """w AS (SELECT file_id, path, content, list_filter(regexp_split_to_array(strip_accents(lower(content)), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS words FROM v)"""


def _query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vault.from_documents(spark, sf_dir).files


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.file_records(_files(spark, sf_dir))


def _commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vault.versions_of(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("op"), F.col("user_id").alias("file_id"), F.concat(F.lit("/u"), F.col("user_id") % 10, F.lit("/f"), "user_id", F.lit(".md")).alias("path"))


# --- listings and namespace -----------------------------------------------------------------------

TOTALS = f"WITH {VAULT}, {COUNTED}, {FOLDERS} SELECT folder AS path, CAST(sum(nbytes) AS BIGINT) AS nbytes, CAST(sum(nlines) AS BIGINT) AS nlines, CAST(sum(nwords) AS BIGINT) AS nwords, count(*) AS files, count(DISTINCT author) AS nauthors FROM a GROUP BY folder"


@_query(TOTALS + " ORDER BY nwords DESC, path")
def folder_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.folder_records(_records(spark, sf_dir)).select("path", "nbytes", "nlines", "nwords", "files", "nauthors").orderBy(F.desc("nwords"), "path")


@_query(f"WITH {VAULT}, {COUNTED} SELECT path, nbytes, nlines, nwords FROM m")
def doc_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select("path", "nbytes", "nlines", "nwords")


@_query(f"WITH {VAULT}, {COUNTED}, {FOLDERS} SELECT path, 'file' AS kind, nwords FROM m UNION ALL SELECT folder, 'folder', CAST(sum(nwords) AS BIGINT) FROM a WHERE folder <> '/' GROUP BY folder")
def listing_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.ls(_records(spark, sf_dir), "/", True).select("path", "kind", "nwords")


@_query(f"WITH {VAULT}, {COUNTED} SELECT '/src1/' || split_part(path, '/', 3) AS path, count(*) AS files FROM m WHERE starts_with(path, '/src1/') GROUP BY 1")
def ls_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.ls(_records(spark, sf_dir), "/src1").select("path", "files")


@_query(f"WITH {VAULT}, {COUNTED} SELECT path, nbytes, count(*) OVER () AS total FROM m WHERE starts_with(path, '/src2/en/') ORDER BY nbytes DESC, path LIMIT 10 OFFSET 5")
def list_page_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.page(_records(spark, sf_dir), "/src2/en", "size", True, limit=10, offset=5).select("path", "nbytes", "total")


@_query(f"WITH {VAULT}, {COUNTED}, {FOLDERS} SELECT folder AS path, CASE WHEN folder = '/' THEN 0 ELSE length(folder) - length(replace(folder, '/', '')) END AS depth, count(*) AS files, CAST(sum(nbytes) AS BIGINT) AS nbytes FROM a GROUP BY folder HAVING depth <= 1")
def tree_depth1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.tree(_records(spark, sf_dir), "/", 1).select("path", "depth", "files", "nbytes")


@_query(TOTALS.replace("FROM a GROUP", "FROM a WHERE folder = '/' GROUP"))
def entry_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.entry(_records(spark, sf_dir), "/").select("path", "nbytes", "nlines", "nwords", "files", "nauthors")


@_query(f"WITH {VAULT} SELECT 'md' AS ext, split_part(path, '/', 3) AS lang, count(*) AS n FROM v GROUP BY 2")
def ext_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).groupBy("ext", F.split_part("path", F.lit("/"), F.lit(3)).alias("lang")).agg(F.count(F.lit(1)).alias("n"))


@_query(f"WITH {VAULT}, {COUNTED} SELECT count(*) AS ndocs, CAST(sum(nwords) AS BIGINT) AS total FROM m WHERE starts_with(path, '/src3/')")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).where(paths.under(F.col("path"), "/src3")).agg(F.count(F.lit(1)).alias("ndocs"), F.sum("nwords").alias("total"))


@_query(f"WITH {VAULT} SELECT path, array_to_string(string_split(content, chr(10))[3:5], chr(10)) || chr(10) AS lines FROM v")
def lines_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("path", text.slice_lines(F.col("content"), 3, 5).alias("lines"))


@_query(f"WITH {VAULT} SELECT file_id, CASE WHEN starts_with(path, '/src1/') THEN '/archive' || path ELSE path END AS path FROM v")
def move_rewrite_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.move(_files(spark, sf_dir), "/src1", "/archive/src1").select("file_id", "path")


@_query(f"WITH {VAULT} SELECT path FROM v WHERE starts_with(path, '/src4/') ORDER BY path")
def trash_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.trash(history.delete(_files(spark, sf_dir), "/src4", "2024-01-01 00:00:00")).select("path")


@_query(f"WITH {VAULT} SELECT file_id, path AS old_path, CASE WHEN starts_with(path, '/src4/') THEN NULL ELSE '/x' || path END AS new_path, CASE WHEN starts_with(path, '/src4/') THEN 'delete' ELSE 'move' END AS op FROM v WHERE starts_with(path, '/src4/') OR starts_with(path, '/src5/')")
def path_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    after = history.move(history.live(history.delete(files, "/src4", "2024-01-01 00:00:00")), "/src5", "/x/src5")
    return history.path_events(files, after)


#: Paths of documents with names that some platform refuses, as SQL that Spark and DuckDB read alike.
_ODD = "CASE doc_id % 8 WHEN 0 THEN '/n/' || cast(doc_id as string) || '/con.md' WHEN 1 THEN '/n/what? ' || cast(doc_id as string) WHEN 2 THEN '/n/' || cast(doc_id as string) || '.' WHEN 3 THEN '/n/' || repeat('x', 250 + doc_id % 12) || cast(doc_id as string) WHEN 4 THEN '/N/Twice' || cast(doc_id - 4 as string) WHEN 5 THEN '/n/tWICE' || cast(doc_id - 5 as string) ELSE '/n/fine' || cast(doc_id as string) END"


@_query(f"""WITH v AS (SELECT {_ODD.replace('as string', 'AS VARCHAR')} AS path, doc_id FROM documents)
SELECT path, 'reserved' AS problem FROM v WHERE doc_id % 8 = 0 UNION ALL SELECT path, 'character' FROM v WHERE contains(path, '?') UNION ALL SELECT path, 'trailing' FROM v WHERE ends_with(path, '.')
UNION ALL SELECT path, 'long' FROM v WHERE length(path) > 258 UNION ALL SELECT a.path, 'case' FROM v a JOIN v b ON lower(a.path) = lower(b.path) AND a.path <> b.path""")
def portability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.clashes(spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr(f"{_ODD} AS path"))


@_query(f"WITH {VAULT} SELECT sha256(content) AS root, count(*) AS n FROM v GROUP BY 1")
def roots_by_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).groupBy(F.sha2("content", 256).alias("root")).agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT a.path, CASE WHEN b.doc_id IS NULL THEN 'created' WHEN a.text = b.text THEN 'unchanged' ELSE 'updated' END AS status FROM (SELECT doc_id, text, '/n' || CAST(doc_id AS VARCHAR) || '.md' AS path FROM documents) a LEFT JOIN (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 5 <> 0) b ON a.doc_id = b.doc_id")
def import_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("path", F.concat(F.lit("/n"), F.col("doc_id").cast("string"), F.lit(".md")))
    head = docs.where("doc_id % 5 <> 0").select("path", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("content"), F.lit(1).alias("version"))
    return vault.upsert(head, docs.select("path", F.col("text").alias("content"))).select("path", "status")


# --- search -----------------------------------------------------------------------------------------


def _hits(condition: str, folder: str = "") -> str:
    scope = f" AND starts_with(path, '{folder}')" if folder else ""
    return f"WITH {VAULT}, {LINES}, k AS (SELECT path, line, list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS words FROM l) SELECT path, line FROM k WHERE {condition}{scope}"


@_query(_hits("list_contains(words, 'missing')"))
def search_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_files(spark, sf_dir), "missing", limit=None, per_file=None).select("path", "line")


@_query(f"WITH {VAULT}, {LINES}, k AS (SELECT file_id, path, line, list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS words FROM l), g AS (SELECT file_id FROM k GROUP BY 1 HAVING bool_or(list_contains(words, 'the')) AND bool_or(list_contains(words, 'license'))) SELECT path, line FROM k WHERE file_id IN (SELECT file_id FROM g) AND (list_contains(words, 'the') OR list_contains(words, 'license'))")
def search_and2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_files(spark, sf_dir), "the AND license", limit=None, per_file=None).select("path", "line")


@_query(_hits("' ' || array_to_string(words, ' ') || ' ' LIKE '% rights reserved %'"))
def search_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_files(spark, sf_dir), '"rights reserved"', limit=None, per_file=None).select("path", "line")


@_query(_hits("len(list_filter(words, lambda x: starts_with(x, 'licen'))) > 0"))
def search_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_files(spark, sf_dir), "licen*", limit=None, per_file=None).select("path", "line")


@_query(_hits("list_contains(words, 'missing')", "/src1/"))
def search_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_files(spark, sf_dir), "missing", "/src1", limit=None, per_file=None).select("path", "line")


@_query(f"""WITH {VAULT}, {COUNTED}, {WORDS}, f AS (SELECT path, len(words) AS n, len(list_filter(words, lambda x: x = 'the')) AS a, len(list_filter(words, lambda x: x = 'license')) AS b FROM w),
g AS (SELECT count(*) AS nd, greatest(sum(nwords) / count(*), 1.0) AS mean FROM m), d AS (SELECT count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM f),
s AS (SELECT path, ln(1 + (nd - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / mean)) + ln(1 + (nd - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / mean)) AS raw FROM f, g, d WHERE a > 0 AND b > 0)
SELECT path, round(raw / (SELECT max(raw) FROM s), 6) AS score FROM s""")
def search_bm25_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(_files(spark, sf_dir), "the license").select("path", F.round("score", 6).alias("score"))


@_query(f"WITH {VAULT}, {WORDS} SELECT x AS word, count(*) AS df FROM (SELECT unnest(list_distinct(words)) AS x FROM w) t WHERE x IN ('the', 'license', 'und') GROUP BY 1")
def document_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.document_frequency(_files(spark, sf_dir), ["the", "License", "und"])


@_query(f"WITH {VAULT}, {WORDS} SELECT x AS word, file_id, count(*) AS tf FROM (SELECT file_id, unnest(words) AS x FROM w) t GROUP BY 1, 2")
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.postings(_files(spark, sf_dir)).select("word", "file_id", "tf")


@_query(f"WITH {VAULT}, {LINES} SELECT path, line, text FROM l WHERE regexp_matches(text, 'https?://[a-z.]+/(en|de)')")
def grep_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.grep(_files(spark, sf_dir), "https?://[a-z.]+/(en|de)").select("path", "line", "text")


@_query(f"WITH {VAULT}, {LINES} SELECT path, line FROM l WHERE contains(lower(text), 'see [[d')")
def grep_fixed_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.grep(_files(spark, sf_dir), "SEE [[D", ignore_case=True, fixed=True).select("path", "line")


@_query(f"WITH {VAULT}, {LINES} SELECT path, count(*) AS matches FROM l WHERE regexp_matches(text, '^#+ ') GROUP BY 1")
def grep_count_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.per_file(search.grep(_files(spark, sf_dir), "^#+ ")).select("path", "matches")


# --- structure --------------------------------------------------------------------------------------

HEADS = f"""{VAULT}, {LINES}, h AS (SELECT file_id, path, line, length(regexp_extract(text, '^(#+) ', 1)) AS level, trim(regexp_replace(text, '^#+ ', '')) AS heading FROM l WHERE regexp_matches(text, '^#{{1,6}} ')),
n AS (SELECT path, max(line) AS last FROM l GROUP BY 1),
s AS (SELECT h.path, h.heading, h.level, h.line AS line_from, coalesce((SELECT min(k.line) - 1 FROM h k WHERE k.path = h.path AND k.line > h.line AND k.level <= h.level), n.last) AS line_to FROM h JOIN n ON n.path = h.path)"""


@_query(f"WITH {HEADS} SELECT path, heading, level, line_from, line_to FROM s")
def outline_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.outline(structure.structure(_files(spark, sf_dir)), limit=None).select("path", "heading", "level", "line_from", "line_to")


@_query(f"WITH {HEADS} SELECT path, line_from FROM s WHERE lower(heading) = 'links'")
def outline_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.outline(structure.structure(_files(spark, sf_dir)), heading="LINKS", limit=None).select("path", "line_from")


@_query(f"WITH {HEADS} SELECT path, heading FROM s WHERE starts_with(lower(heading), 'doc 1') AND starts_with(path, '/src1/')")
def outline_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.outline(structure.structure(_files(spark, sf_dir)), "/src1", "Doc 1", "prefix", limit=None).select("path", "heading")


@_query(f"WITH {HEADS} SELECT path, heading FROM s WHERE contains(lower(heading), 'ote') AND level <= 3")
def outline_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.outline(structure.structure(_files(spark, sf_dir)), heading="ote", mode="contains", max_level=3, limit=None).select("path", "heading")


@_query(f"WITH {HEADS} SELECT min(heading) AS heading, count(*) AS sections, count(DISTINCT path) AS docs FROM s GROUP BY lower(heading) ORDER BY sections DESC, lower(min(heading)) LIMIT 2")
def headings_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.heading_names(structure.structure(_files(spark, sf_dir)), limit=2)


@_query(f"WITH {HEADS}, x AS (SELECT s.path, s.line_from, s.line_to, v.content FROM s JOIN v ON v.path = s.path WHERE s.heading = 'Notes') SELECT path, array_to_string(string_split(content, chr(10))[line_from:line_to], chr(10)) || chr(10) AS text FROM x")
def section_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    return structure.section_text(files, structure.structure(files), "notes").select("path", "text")


@_query(f"WITH {HEADS}, x AS (SELECT s.path, s.line_from, l.text FROM s JOIN l ON l.path = s.path AND l.line BETWEEN s.line_from AND s.line_to) SELECT path, line_from, CAST(sum(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+'))) AS BIGINT) AS nwords_total FROM x GROUP BY 1, 2")
def section_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.sections(structure.structure(_files(spark, sf_dir))).select("path", "line_from", "nwords_total")


def _props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.properties(structure.structure(_files(spark, sf_dir)))


@_query("SELECT * FROM (SELECT 'title' AS key, count(*) AS docs, count(*) AS values_n, 'text' AS kind FROM documents UNION ALL SELECT 'lang', count(*), count(DISTINCT lang), 'text' FROM documents UNION ALL SELECT 'n_chars', count(*), count(DISTINCT n_chars), 'number' FROM documents UNION ALL SELECT 'tags', count(*), count(DISTINCT lang) + count(DISTINCT source), 'text' FROM documents UNION ALL SELECT 'meta.even', count(*), 2, 'text' FROM documents) t")
def prop_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.property_keys(_props(spark, sf_dir))


@_query("SELECT x AS value, count(*) AS docs FROM (SELECT lang AS x FROM documents UNION ALL SELECT source FROM documents) t GROUP BY 1 ORDER BY docs DESC, value LIMIT 200")
def prop_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.property_values(_props(spark, sf_dir), "tags")


def _found(query: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return structure.matching(_props(spark, sf_dir), query)

    return run


for _name, _text, _where in (
    ("prop_find_eq", "tags:src3", "source = 'src3'"), ("prop_find_range", "n_chars:>=1000 n_chars:<2000", "n_chars >= 1000 AND n_chars < 2000"), ("prop_find_or_not", "(lang:de OR lang:fr) -tags:src1", "lang IN ('de', 'fr') AND source <> 'src1'"),
    ("prop_find_ne", "lang:!=en", "lang <> 'en'"), ("prop_find_prefix", "title:doc*", "true"), ("prop_find_nested", "meta.even:true NOT lang:es", "doc_id % 2 = 0 AND lang <> 'es'"), ("prop_find_has", "has:missing", "false"),
):
    QUERIES[_name], ORACLES[_name] = _found(_text), f"SELECT doc_id AS file_id FROM documents WHERE {_where}"


def _all_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    return structure.links(structure.structure(files), files)


LINKS = f"""WITH {VAULT}, k AS (
SELECT path, 'wiki' AS kind, 'd' || lpad(CAST(file_id + 1 AS VARCHAR), 6, '0') AS target, file_id + 1 AS t FROM v
UNION ALL SELECT path, 'md', 'd' || lpad(CAST(file_id - 1 AS VARCHAR), 6, '0') || '.md', file_id - 1 FROM v
UNION ALL SELECT path, 'wiki', 'nowhere-' || CAST(file_id % 7 AS VARCHAR), -5 FROM v
UNION ALL SELECT path, 'md', 'https://example.com/' || split_part(path, '/', 3), -6 FROM v),
r AS (SELECT k.path, k.kind, k.target, CASE WHEN t = -6 THEN 'external' WHEN w.path IS NULL THEN 'broken' WHEN kind = 'md' AND regexp_replace(w.path, '/[^/]*$', '') <> regexp_replace(k.path, '/[^/]*$', '') THEN 'broken' ELSE 'ok' END AS status,
CASE WHEN kind = 'md' AND regexp_replace(w.path, '/[^/]*$', '') <> regexp_replace(k.path, '/[^/]*$', '') THEN NULL ELSE w.path END AS resolved FROM k LEFT JOIN v w ON w.file_id = k.t)"""


@_query(LINKS + " SELECT path, kind, target, status, resolved FROM r")
def links_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_links(spark, sf_dir).select("path", "kind", "target", "status", "resolved")


@_query(LINKS + " SELECT resolved AS path, count(*) AS n FROM r WHERE resolved IS NOT NULL GROUP BY 1")
def backlink_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_links(spark, sf_dir).where("resolved is not null").groupBy(F.col("resolved").alias("path")).agg(F.count(F.lit(1)).alias("n"))


@_query(LINKS + " SELECT path, target FROM r WHERE status = 'broken' AND starts_with(path, '/src1/')")
def links_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.outgoing(_all_links(spark, sf_dir), "/src1", "broken", None).select("path", "target")


# --- history ------------------------------------------------------------------------------------------


@_query(f"WITH {CHATS} SELECT path, version, author, CAST(strlen(content) AS BIGINT) AS nbytes, CAST(len(regexp_extract_all(content, '[^ \\t\\n\\r\\f\\v]+')) AS BIGINT) AS nwords FROM c")
def version_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.history(_commits(spark, sf_dir)).select("path", "version", "author", "nbytes", "nwords")


@_query(f"WITH {CHATS} SELECT file_id, sha256(content) AS h FROM c WHERE version = 2")
def content_at_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.at_version(_commits(spark, sf_dir), 2).select("file_id", F.sha2("content", 256).alias("h"))


@_query(f"WITH {CHATS} SELECT file_id, max(version) AS version, sha256(arg_max(content, version)) AS h FROM c GROUP BY 1")
def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.at_version(_commits(spark, sf_dir)).select("file_id", "version", F.sha2("content", 256).alias("h"))


@_query(f"WITH {CHATS} SELECT file_id, max(version) AS version FROM c WHERE version <= 1 + file_id % 4 GROUP BY 1")
def checkpoint_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits = _commits(spark, sf_dir)
    limits = commits.select("file_id").distinct().withColumn("version", 1 + F.col("file_id") % 4)
    return history.as_of(commits, limits).select("file_id", "version")


@_query(f"WITH {CHATS}, k AS (SELECT file_id, version, CAST(len(regexp_extract_all(content, '[^ \\t\\n\\r\\f\\v]+')) AS BIGINT) AS nwords FROM c) SELECT file_id, version, nwords, nwords - coalesce(lag(nwords) OVER (PARTITION BY file_id ORDER BY version), 0) AS delta FROM k")
def version_word_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.word_deltas(_commits(spark, sf_dir))


@_query(f"WITH {CHATS} SELECT file_id, author, count(*) AS commits, min(version) AS first_version, max(version) AS last_version FROM c GROUP BY 1, 2")
def file_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.file_authors(_commits(spark, sf_dir))


@_query(f"WITH {CHATS}, k AS (SELECT file_id, author, count(*) AS n, max(version) AS l FROM c GROUP BY 1, 2) SELECT file_id, string_agg(author, ',' ORDER BY n DESC, l DESC, author) AS authors FROM k GROUP BY 1")
def authors_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = history.authors_array(history.file_authors(_commits(spark, sf_dir)))
    return found.select("file_id", F.array_join(F.transform("authors", lambda a: a["author"]), ",").alias("authors"))


def _batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _commits(spark, sf_dir).withColumn("batch", F.concat(F.lit("b"), F.floor((F.col("version") - 1) / 2)))


@_query(f"WITH {CHATS} SELECT 'b' || CAST((version - 1) // 2 AS VARCHAR) AS batch, file_id, min(version) - 1 AS from_version, max(version) AS to_version, count(*) AS commits FROM c GROUP BY 1, 2")
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.batch_summary(_batched(spark, sf_dir))


@_query(f"WITH {CHATS}, k AS (SELECT file_id, min(version) - 1 AS from_version, max(version) AS to_version FROM c WHERE (version - 1) // 2 = 1 GROUP BY 1), h AS (SELECT file_id, max(version) AS head FROM c GROUP BY 1) SELECT k.*, CASE WHEN head <> to_version THEN 'skipped' WHEN from_version = 0 THEN 'removed' ELSE 'restored' END AS action FROM k JOIN h ON h.file_id = k.file_id")
def revert_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    batched = _batched(spark, sf_dir)
    return history.revert_plan(batched, history.at_version(batched.drop("batch")), "b1")


@_query(f"WITH {CHATS}, k AS (SELECT a.path, a.version, len(string_split(a.content, chr(10))) - 1 AS n, coalesce(len(string_split(b.content, chr(10))) - 1, 0) AS o FROM c a LEFT JOIN c b ON b.file_id = a.file_id AND b.version = a.version - 1) SELECT path, version, CAST(o + 1 AS BIGINT) AS old_from, CAST(0 AS BIGINT) AS old_count, CAST(o + 1 AS BIGINT) AS new_from, CAST(n - o AS BIGINT) AS new_count FROM k")
def version_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.diffs(_commits(spark, sf_dir)).select("path", "version", "old_from", "old_count", "new_from", "new_count")


@_query(f"""WITH {CHATS}, n AS (SELECT path, version, CAST(len(string_split(content, chr(10))) - 1 AS BIGINT) AS n FROM c), h AS (SELECT path, max(n) AS n FROM n GROUP BY path)
SELECT h.path, o.n + 1 AS old_from, CAST(0 AS BIGINT) AS old_count, o.n + 1 AS new_from, h.n - o.n AS new_count FROM h JOIN n o ON o.path = h.path AND o.version = 2 WHERE h.n > o.n""")
def hunks_to_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.diffs_between(_commits(spark, sf_dir), 2).select("path", "old_from", "old_count", "new_from", "new_count")


@_query()
def unified_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.diffs(_commits(spark, sf_dir), "unified")


@_query("SELECT doc_id, sha256('top' || chr(10) || text || chr(10) || 'end' || chr(10)) AS merged, 0 AS conflicts FROM documents")
def three_way_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One side adds a first line, the other a last one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("base", F.concat("text", F.lit("\n")))
    m = docs.select("doc_id", merge.merge3_of(F.col("base"), F.concat(F.lit("top\n"), "base"), F.concat("base", F.lit("end\n"))).alias("m"))
    return m.select("doc_id", F.sha2("m.merged", 256).alias("merged"), "m.conflicts")


@_query("SELECT doc_id, sha256(CASE WHEN len(string_split(text, 'the')) = 2 THEN replace(text, 'the', 'THE') END) AS h FROM documents")
def edit_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.sha2(merge.edit_of(F.col("text"), "the", "THE"), 256).alias("h"))


@_query("SELECT conv_id, count(*) AS ops, max(n) AS version FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) t GROUP BY 1")
def commit_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's first turn creates a file, every other one is appended."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    first = F.min("turn").over(history.Window.partitionBy("conv_id"))
    ops = turns.withColumn("op", F.when(F.col("turn") == first, "create").otherwise("append")).select(
        F.col("turn").alias("seq"), F.col("conv_id").cast("string").alias("path"), "op", F.create_map(F.lit("content"), F.concat("text", F.col("turn").cast("string"), F.lit("\n"))).alias("args"), F.lit(None).cast("bigint").alias("base_version"), F.col("role").alias("author"), F.lit(None).cast("string").alias("message")
    )
    return history.fold(ops).where("status = 'ok'").groupBy(F.col("path").cast("bigint").alias("conv_id")).agg(F.count(F.lit(1)).alias("ops"), F.max("version").alias("version"))


# --- chunks ---------------------------------------------------------------------------------------------


@_query()
def chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunks(_files(spark, sf_dir)).drop("bytes")


@_query()
def chunk_sharing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.sharing(chunking.chunks(_commits(spark, sf_dir)))


@_query(f"WITH {VAULT} SELECT file_id, sha256(content) AS h FROM v")
def chunks_materialized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.materialize(chunking.chunks(_files(spark, sf_dir))).select("file_id", F.sha2("content", 256).alias("h"))


# --- feed, access, sync -----------------------------------------------------------------------------------


@_query("SELECT event_id AS seq, event_type AS op, user_id AS file_id FROM events WHERE event_id > 100 ORDER BY event_id LIMIT 500")
def feed_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.since(_changes(spark, sf_dir), 100, 500).select("seq", "op", "file_id")


@_query("SELECT max(event_id) AS last_seq FROM events")
def feed_last_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.last_seq(_changes(spark, sf_dir))


@_query("SELECT f AS folder, count(*) AS changes FROM (SELECT unnest(['/', '/u' || CAST(user_id % 10 AS VARCHAR)]) AS f FROM events) t GROUP BY 1")
def feed_folder_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.folder_activity(_changes(spark, sf_dir))


@_query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = feed.tumbling(spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@_query("WITH k AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '30 minutes' OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS b FROM events), g AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM k) SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, s")
def events_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = feed.sessions(spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


GRANTS = [{"root": "/src1/en", "alias": "english", "rights": "rw"}, {"root": "/src2", "rights": "ro"}, {"root": "/src3", "state": "dormant"}]


@_query(f"WITH {VAULT} SELECT file_id, CASE WHEN starts_with(path, '/src2/') THEN path ELSE '/english' || substr(path, 9) END AS path, CASE WHEN starts_with(path, '/src2/') THEN 'src2' ELSE 'english' END AS share, CASE WHEN starts_with(path, '/src2/') THEN 'ro' ELSE 'rw' END AS rights FROM v WHERE starts_with(path, '/src2/') OR starts_with(path, '/src1/en/')")
def access_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.view(_files(spark, sf_dir), GRANTS).select("file_id", "path", "share", "rights")


@_query("""WITH b AS (SELECT doc_id, 'f' || CAST(doc_id AS VARCHAR) || '.md' AS rel FROM documents) SELECT rel, CASE doc_id % 6 WHEN 0 THEN 'keep' WHEN 1 THEN 'to_disk' WHEN 2 THEN 'to_store' WHEN 3 THEN 'disk_delete' WHEN 4 THEN 'merge' ELSE 'conflict' END AS action FROM b""")
def sync_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six cases by doc_id: unchanged, changed in the store, on disk, gone from the store, apart and at one place on both sides."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".md")).alias("rel"), F.concat(F.lit("a\n"), "text", F.lit("\nz\n")).alias("content"))
    k, top = F.col("doc_id") % 6, lambda word: F.concat(F.lit(f"{word}\n"), F.substring("content", 3, 1 << 30))
    base = docs.select("rel", F.lit(1).alias("version"), "content", F.lit(False).alias("conflict"))
    store = docs.where(k != 3).select("rel", F.when(k.isin(0, 2), 1).otherwise(2).alias("version"), F.when(k.isin(1, 4, 5), top("s")).otherwise(F.col("content")).alias("content"))
    disk = docs.select("rel", F.when(k == 2, top("d")).when(k == 4, F.concat("content", F.lit("d\n"))).when(k == 5, top("d")).otherwise(F.col("content")).alias("content"))
    return sync.classify(base, store, disk).select("rel", "action")


@_query("SELECT CAST(doc_id AS VARCHAR) AS rel, CASE doc_id % 3 WHEN 0 THEN 'same' WHEN 1 THEN 'differ' ELSE 'only-store' END AS status FROM documents")
def git_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("rel"), F.col("text").alias("content"), (F.col("doc_id") % 3).alias("k"))
    git = docs.where("k < 2").select("rel", sync.blob_id(F.when(F.col("k") == 1, F.concat("content", F.lit("x"))).otherwise(F.col("content"))).alias("blob"))
    return sync.git_compare(docs, git)
