"""Small vaults with known answers: links, properties, folds of operations, sync, feeds, SQL."""

import pytest
from pyspark.sql import functions as F

from quire.operators import access, history, listing, search, structure, sync
from quire.sources import sql, vault
from quire.streaming import feed


def files(spark, docs):
    rows = [(i, p, c, 1, "a") for i, (p, c) in enumerate(docs.items())]
    return spark.createDataFrame(rows, "file_id bigint, path string, content string, version bigint, author string").withColumns({"created_at": F.timestamp_seconds("file_id"), "updated_at": F.timestamp_seconds("file_id")})


def test_link_statuses(spark):
    vault_files = files(spark, {
        "/g/index.md": "# Guide\n[the limits](limits.md) [[Missing]] [[dup]] [[plan#next-steps]] [[plan#nope]] ![[deck.pdf]] [[notes/]] [x](https://a.b) [[#Guide]] [[pic.png]]\n",
        "/g/limits.md": "# Limits\n", "/a/dup.md": "x\n", "/b/dup.md": "x\n", "/notes/plan.md": "# Plan\n## Next steps\n", "/g/pic.png.tdbasset": "p\n",
    })
    found = structure.structure(vault_files)
    got = {(r["target"], r["anchor"]): (r["status"], r["resolved"]) for r in structure.links(found, vault_files).collect()}
    assert got == {
        ("limits.md", None): ("ok", "/g/limits.md"), ("Missing", None): ("broken", None), ("dup", None): ("ambiguous", "/a/dup.md"), ("plan", "next-steps"): ("ok", "/notes/plan.md"),
        ("plan", "nope"): ("anchor-missing", "/notes/plan.md"), ("deck.pdf", None): ("not-in-store", None), ("notes/", None): ("folder", None), ("https://a.b", None): ("external", None),
        ("", "Guide"): ("ok", "/g/index.md"), ("pic.png", None): ("ok", "/g/pic.png.tdbasset"),
    }


def test_search_by_line(spark):
    docs = {f"/a/sub{i % 3}/doc{i}.md": f"# Doc {i}\n\nThe quick brown fox {i} jumps.\n" for i in range(20)}
    vault_files = files(spark, docs)
    hits = search.search(vault_files, "quick fox", "/a/sub1").collect()
    assert len(hits) == 7 and {h["line"] for h in hits} == {3} and max(h["score"] for h in hits) == 1
    assert [h["path"] for h in search.search(vault_files, '"fox 7"').collect()] == ["/a/sub1/doc7.md"]
    assert search.search(vault_files, "quick absent").count() == 0


def test_listing_record(spark):
    records = listing.file_records(files(spark, {"/docs/a.md": "one two\n", "/docs/deep/b.md": "three\n"}))
    assert tuple(records.columns) == listing.RECORD
    got = {r["path"]: (r["files"], r["folders"], r["nbytes"], r["nwords"]) for r in listing.folder_records(records).collect()}
    assert got == {"/": (2, 2, 14, 3), "/docs": (2, 1, 14, 3), "/docs/deep": (1, 0, 6, 1)}


def test_fold_over_files(spark):
    ops = spark.createDataFrame([(1, "/a", "create", {"content": "x\ny\n"}, None), (2, "/b", "create", {"content": "b\n"}, None), (3, "/a", "write", {"content": "X\ny\n"}, 1), (4, "/a", "write", {"content": "z\ny\n"}, 1), (5, "/c", "append", {"content": "no\n"}, None)], "seq bigint, path string, op string, args map<string,string>, base_version bigint").withColumns({"author": F.lit("me"), "message": F.lit(None).cast("string")})
    got = {r["seq"]: (r["status"], r["version"]) for r in history.fold(ops).collect()}
    assert got == {1: ("ok", 1), 2: ("ok", 1), 3: ("ok", 2), 4: (history.CONFLICT, 2), 5: (history.NOT_FOUND, None)}


def test_trash(spark):
    nodes = files(spark, {"/a": "", "/a/x.md": "", "/a/y.md": ""}).select("file_id", "path")
    first = history.delete(nodes, "/a/x.md", "2024-01-01 00:00:00")
    both = history.delete(first, "/a", "2024-01-02 00:00:00")
    assert [r["path"] for r in history.trash(both).collect()] == ["/a", "/a/x.md"]
    assert {r["path"] for r in history.live(history.restore(both, "/a")).collect()} == {"/a", "/a/y.md"}


def test_sync_moves(spark):
    t = lambda rows, cols: spark.createDataFrame(rows, cols)
    base = t([("old.md", 1, "same\n", False), ("gone.md", 1, "g\n", False)], "rel string, version int, content string, conflict boolean")
    store = t([("old.md", 1, "same\n"), ("gone.md", 1, "g\n"), ("new.md", 1, "n\n")], "rel string, version int, content string")
    disk = t([("moved.md", "same\n"), ("pic.bin", "x")], "rel string, content string")
    got = {r["rel"]: (r["action"], r["new_rel"]) for r in sync.classify(base, store, disk).collect()}
    assert got == {"old.md": ("move", "moved.md"), "gone.md": ("store_delete", None), "new.md": ("to_disk", None), "pic.bin": ("left_out", None)}


def test_access_feed(spark):
    changes = spark.createDataFrame([(1, "move", "/in/a", "/out/a"), (2, "move", "/out/b", "/in/b"), (3, "commit", "/out/c", None), (4, "commit", "/in/d", None)], "seq bigint, op string, path string, new_path string")
    got = [tuple(r) for r in access.feed(changes, [{"root": "/in", "alias": "mine"}]).orderBy("seq").collect()]
    assert got == [(1, "delete", "/mine/a", None), (2, "create", "/mine/b", None), (4, "commit", "/mine/d", None)]


def test_stream(spark, tmp_path):
    changes = spark.range(1, 31).select(F.col("id").alias("seq"), F.timestamp_seconds("id").alias("ts"), F.lit("commit").alias("op"), F.col("id").alias("file_id"), F.concat(F.lit("/a/f"), "id").alias("path"), F.lit(None).cast("string").alias("new_path"), F.lit(1).cast("bigint").alias("version"), F.lit("x").alias("author"), F.lit("b").alias("batch"))
    changes.repartition(3).write.parquet(str(tmp_path / "feed"))
    seen = []
    for _ in range(2):  # a second run from the same checkpoint brings nothing again
        feed.watch(feed.stream(spark, str(tmp_path / "feed"), 1), lambda df, n: seen.extend(r["seq"] for r in df.collect()), str(tmp_path / "mark"), once=True).awaitTermination(60)
    assert sorted(seen) == list(range(1, 31))


def test_folder_import(spark, tmp_path):
    for name, data in (("a.md", b"# A\n"), ("sub/b.txt", b"b\n"), ("sub/c.bin", b"\x00\x01"), ("d.md", b"x\x00y"), (".git/e.md", b"no\n")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = vault.from_folder(spark, str(tmp_path), "/in")
    assert [(r["path"], r["content"]) for r in got.collect()] == [("/in/a.md", "# A\n"), ("/in/sub/b.txt", "b\n")]
    assert vault.from_folder(spark, str(tmp_path), include="**/*.md", exclude="a*").count() == 0


def test_sql_views(spark):
    sql.register(spark, vault.Vault(files(spark, {"/a.md": "---\nk: 1\n---\n# T\n[[b]]\n", "/b.md": "b\n"})))
    assert sql.run(spark, "SELECT path, nlinks FROM files WHERE title = :t", {"t": "T"}).collect()[0]["nlinks"] == 1
    assert sql.run(spark, "WITH x AS (SELECT status FROM links) SELECT count(*) AS n FROM x").collect()[0]["n"] == 1
    for bad in ("DROP VIEW files", "SELECT * FROM parquet.`/tmp/x`", "SELECT 1; SELECT 2"):
        with pytest.raises(ValueError):
            sql.run(spark, bad)


def test_fold_of_a_stream(spark, tmp_path):
    cols = "seq bigint, path string, op string, args map<string,string>, base_version bigint, author string, message string"
    first = [(1, "/a", "create", {"content": "x\ny\n"}, None, "m", None), (2, "/b", "create", {"content": "b\n"}, None, "m", None)]
    second = [(3, "/a", "append", {"content": "z\n"}, None, "m", None), (4, "/b", "create", {"content": "again"}, None, "m", None)]
    out = {}
    for n, batch in enumerate((first, second)):
        spark.createDataFrame(batch, cols).coalesce(1).write.mode("append").parquet(str(tmp_path / "ops"))
        stream = history.fold_stream(spark.readStream.schema(cols).parquet(str(tmp_path / "ops")))
        query = stream.writeStream.option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True)
        query.foreachBatch(lambda df, i: out.update({r["seq"]: (r["status"], r["version"], r["content"]) for r in df.collect()})).start().awaitTermination(90)
    assert out == {1: ("ok", 1, "x\ny\n"), 2: ("ok", 1, "b\n"), 3: ("ok", 2, "x\ny\nz\n"), 4: (history.INVALID, 1, None)}


def test_purge_stats(spark):
    from quire.operators import chunking

    gone, kept = files(spark, {"/a.md": "a" * 700 + "\n" + "b" * 700}), files(spark, {"/b.md": "c"})
    row = history.purge_stats(gone.select("file_id", "version"), chunking.chunks(gone), chunking.chunks(kept)).first()
    assert row["files"] == row["versions"] == 1 and row["bytes"] == 1401 and row["chunks"] >= 1
