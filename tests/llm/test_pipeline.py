"""The pipeline's stages, each on what the one before kept."""

import hashlib
import random
import re
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from fixtures_llm import edge_docs

import corpus_pipeline
from test_operators import brute_repeats

from quire.llm import simhash


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    told = corpus_pipeline.language_id(spark, docs, sf_dir)
    letters = {r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"])}
    assert told.columns == docs.columns and {r["doc_id"] for r in told.collect()} == letters
    single = corpus_pipeline.near_copies(spark, told, sf_dir)
    texts = {r["doc_id"]: r["text"] for r in single.collect()}
    assert single.columns == docs.columns and len({*texts.values()}) == len(texts)
    assert {r["text"] for r in told.collect() if r["doc_id"] == min(r["doc_id"] for r in told.collect())} <= {*texts.values()}
    cut = corpus_pipeline.repeated_passages(spark, single, sf_dir)
    ids = sorted(texts)
    want = dict(zip(ids, brute_repeats([texts[i] for i in ids], 35), strict=True))
    left = cut.collect()
    assert cut.columns == docs.columns and len(left) == len(ids)
    for r in left:
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"])
        assert hashlib.sha256(" ".join(words).encode()).hexdigest() == want[r["doc_id"]][2] and r["n_chars"] == len(r["text"])
    packed = corpus_pipeline.packed(spark, cut, sf_dir).toPandas()
    held = packed.groupby("doc_id")["length"].sum()
    assert all(held[r["doc_id"]] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) + 1 for r in left)


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0 and len(corpus_pipeline.STAGES) == 4


@pytest.mark.parametrize("empty", [False, True])
def test_edges(spark, sf_dir, empty):
    docs = edge_docs(spark).limit(0) if empty else edge_docs(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count()
    assert rows == 0 if empty else rows > 0


def test_languages_without_labels(spark, sf_dir):
    """Documents stay where no label tells a language; those without a letter go all the same."""
    rows = [(1, "some words", None, "s", 10), (2, "12 34", None, "s", 5), (3, None, None, "s", 0), (4, "漢字", None, None, 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted(r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, sf_dir).collect()) == [1, 4]


@pytest.mark.parametrize("told", ["as found", "none", "unlike too"])
def test_near_copies_by_fingerprints(spark, sf_dir, monkeypatch, told):
    """The stage links texts by fingerprints through Golay-code keys; sets verify the links, and what fingerprints miss is found too."""
    draw, texts, group = random.Random(23), {}, {}
    for g in range(12):
        base = [f"w{draw.randrange(10**6)}" for _ in range(300)]
        for k, changed in enumerate((0, 1, 1, 4, 30)):  # the last is not similar
            copy = list(base)
            for at in draw.sample(range(300), changed):
                copy[at] = f"x{draw.randrange(10**6)}"
            texts[10 * g + k], group[10 * g + k] = " ".join(copy), (g, k == 4)
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in texts.items()], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    prints = {d: int(np.uint64(simhash.fingerprint(t, 5)).astype(np.int64)) for d, t in texts.items()}
    near = {(u, v) for u in prints.values() for v in prints.values() if u < v and ((u ^ v) & (1 << 64) - 1).bit_count() <= 3}
    real, calls = simhash.links, []

    def links(*args, **kwargs):
        found = real(*args, **kwargs)
        calls.append({tuple(r) for r in found.collect()})
        if told == "none":
            return found.limit(0)
        return found if told == "as found" else found.unionByName(spark.createDataFrame([tuple(sorted((prints[0], prints[10]))), tuple(sorted((prints[0], prints[4])))], found.schema))

    monkeypatch.setattr(simhash, "links", links)
    kept = {r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, sf_dir).collect()}
    assert calls == [near] and len(near) > 5
    assert kept == {min(d for d in group if group[d] == g) for g in group.values()}
