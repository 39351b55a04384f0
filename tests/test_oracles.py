"""Every query of the engine against its DuckDB equivalent on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from quire.operators import search
from quire.plans import registry


def plain(v):
    if hasattr(v, "asDict"):
        return tuple(map(plain, v))
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(name, spark, sf_dir, duck):
    got = registry.QUERIES[name](spark, sf_dir)
    want = duck.sql(registry.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(registry.QUERIES.keys() - registry.ORACLES.keys()))
def test_runs(name, spark, sf_dir):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_searches_without_limit(spark, tmp_path, monkeypatch):
    """A document with over 1000 hit lines against SQL; no query has a limit of lines per document, however large."""
    text = "missing the license rights reserved\n" * 1100
    docs = spark.createDataFrame([(1, text, "en", "src1", len(text))], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("search_single", "search_scoped"):
        got, want = registry.QUERIES[name](spark, str(tmp_path)), con.sql(registry.ORACLES[name])
        found = rows(got.columns, got.collect())
        assert found == rows(want.columns, want.fetchall()) and len(found) >= 1100
    limits = []
    monkeypatch.setattr(search, "search", lambda files, query, *_, limit, per_file, **__: limits.append((limit, per_file)) or files.select("path", "file_id").withColumnRenamed("file_id", "line"))
    for name in ("search_single", "search_scoped", "search_and2", "search_phrase", "search_prefix"):
        registry.QUERIES[name](spark, str(tmp_path))
    assert limits == [(None, None)] * 5
