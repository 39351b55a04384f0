"""The ten operators against brute force on small fixtures, and on rows that break careless code."""

import hashlib
import io
import random
import re
import sys
import wave
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from fixtures_llm import edge_docs, words

from quire.llm import chroma, embedding_dedup, langid, license_scan, packing, queries, sentencepiece_codec, sharding, simhash, substring_dedup, url_filter
from quire.llm.common import components

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def collected(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# --- components ---------------------------------------------------------------------------------


def test_components(spark):
    draw = random.Random(1)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (None, 3)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((top(a), top(b)))
            parent[b] = a
    got = components(spark.createDataFrame(edges, "u bigint, v bigint"))
    assert {r["node"]: r["root"] for r in got.collect()} == {x: top(x) for x in parent}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


# --- 1: SentencePiece ---------------------------------------------------------------------------


def test_codec_is_the_library():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    codec = sentencepiece_codec.Codec(sentencepiece_codec.read_model(MODEL))
    draw = random.Random(2)
    letters = "abcdeéthin  \n\t▁.<>0xAß😀漢字́�￿\x00İ"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randrange(60))) for _ in range(1500)] + ["", " ", "a" * 3000, "ab" * 900, " " * 700, "漢字" * 400, "<s></s><unk><0x0A>"]
    coded = codec.encode_batch(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in coded] == library.encode(texts, add_bos=True, add_eos=True)
    assert [codec.decode_bytes(x).decode() for x in coded] == [library.decode(np.frombuffer(x, "<u4").tolist()) for x in coded]
    broken = np.array([3 + 0xE6, 3 + 0xBC, 3 + 0x41, 3 + 0xFF], dtype="<u4")
    assert codec.decode_bytes(broken.tobytes()).decode() == library.decode(broken.tolist())


def test_codec_over_rows(spark):
    got = sentencepiece_codec.encode(edge_docs(spark), MODEL, decoded="back").select("doc_id", "text", "ids", "back", "n_tokens")
    for r in got.collect():
        assert r["ids"][0] == 1 and r["ids"][-1] == 2 and r["back"] == (r["text"] or "").replace("▁", " ") and r["n_tokens"] == "own"
    again = sentencepiece_codec.decode(got, MODEL, text="once_more")
    assert all(r["once_more"] == r["back"] for r in again.collect())
    assert sentencepiece_codec.encode(edge_docs(spark).limit(0), MODEL, digests=True).count() == 0


# --- 2: SimHash ---------------------------------------------------------------------------------


def test_golay_keys_lose_no_link():
    draw = np.random.default_rng(3)
    x = draw.integers(0, 1 << 64, 300, dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in draw.choice(64, 1 + i % 3, replace=False):
            y[i] ^= np.uint64(1 << int(b))
    keys = []
    for prints in (x, y):
        row, key = simhash.golay_keys(prints)
        keys.append([set(key[row == i].tolist()) for i in range(len(prints))])
    assert all(a & b for a, b in zip(*keys, strict=True))
    # a perfect code: every codeword is nearest to as many words
    assert (np.bincount(simhash.nearest(np.arange(1 << 23))) == 2048).all()


def brute_components(pairs, nodes):
    parent = {x: x for x in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    return {x: top(x) for x in nodes}


def test_simhash_query(spark, sf_dir, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    prints = {}
    for d, t in texts.items():
        import xxhash

        w = re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower())
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        prints[d] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    ids = sorted(prints)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 3]
    root = brute_components(pairs, ids)
    assert collected(queries.op2_simhash(spark, sf_dir), "doc_id", "fingerprint", "component_id") == sorted(((d, f"{prints[d]:016x}", root[d]) for d in ids), key=repr)


def test_simhash_edges(spark):
    got = simhash.components_of(edge_docs(spark))
    rows = [(r["doc_id"], r["component_id"]) for r in got.collect()]
    assert len(rows) == 10 and {(1, 1), (2, 1), (3, 1), (4, 4), (7, 4), (6, 6)} <= {*rows} and rows.count((6, 6)) == 2
    kept = simhash.dedup(edge_docs(spark))
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 4, 5, 6, 9] and "tag" in kept.columns
    assert simhash.dedup(edge_docs(spark).limit(0)).count() == 0 and simhash.components_of(edge_docs(spark).limit(0)).count() == 0


def test_similar_texts_meet(spark):
    """Most copies with a few edits group with their source (candidates are found with high, not full recall); unrelated texts stay alone."""
    draw = random.Random(4)
    rows, families, similar, joined = [], {}, 0, 0
    for f in range(30):
        base = words(draw, 300, 5000)
        for c in range(3):
            w = [*base]
            for _ in range(4 * (c > 0)):
                w[draw.randrange(len(w))] = "edited"
            families[len(rows)] = f
            rows.append((len(rows), " ".join(w)))
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    sets = [{" ".join(x[i : i + 5]) for i in range(len(x) - 4)} for x in (t.split() for _, t in rows)]
    for a in range(len(rows)):
        for b in range(a):
            j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            if j >= 0.87:
                similar += 1
                joined += got[a] == got[b]
            if families[a] != families[b]:
                assert got[a] != got[b]
    assert similar >= 40 and joined >= 0.85 * similar


def test_equal_fingerprints_are_verified(spark):
    """A line repeated often fixes every bit of the fingerprint; texts with nothing else in common stay apart, equal ones meet."""
    draw = random.Random(11)
    line = words(draw, 9, 5000) * 100
    rows = [(i, " ".join(line + words(draw, 90, 5000))) for i in range(4)]
    rows.append((4, rows[2][1]))
    assert len({simhash.fingerprint(t, 5) for _, t in rows}) == 1
    got = simhash.similar_components(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert collected(got, "doc_id", "component_id") == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 2)]


def test_similar_texts_are_all_found(spark, monkeypatch):
    """Components are those of brute force over all pairs of 0.8 and more, be the copies edited or a line repeated."""
    monkeypatch.setattr(simhash, "BLOCK", 4)
    draw = random.Random(12)
    rows, line = [], words(draw, 9, 5000)
    for f in range(24):
        base = words(draw, 200 + 20 * f, 5000)
        for edits in (0, 2, 3, 4, 4, 5, 6):
            w = [*base]
            for _ in range(edits):
                w[draw.randrange(len(w))] = f"edit{draw.random()}"
            rows.append((len(rows), " ".join(w)))
        rows.append((len(rows), " ".join(base + line)))
        rows.append((len(rows), " ".join(base + line * 20)))
    draw.shuffle(rows)
    sets = {d: {" ".join(x[i : i + 5]) for i in range(len(x) - 4)} for d, x in ((d, t.split()) for d, t in rows)}
    pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    want = brute_components(pairs, sets)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == want and len(pairs) > 300


# --- 3: chroma ----------------------------------------------------------------------------------


def wav(x, rate=11025):
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes((np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def test_chroma_aligns(spark):
    draw = np.random.default_rng(5)
    t = np.arange(11025 * 4) / 11025

    def tune(seed):
        notes = np.random.default_rng(seed).integers(0, 24, 40)
        return 0.4 * np.sin(2 * np.pi * np.cumsum(220 * 2 ** (np.repeat(notes, len(t) // 40 + 1)[: len(t)] / 12)) / 11025)

    a, b = tune(1), tune(2)
    shift = 20 * chroma.HOP
    rows = [(1, wav(a)), (2, wav(a[shift:] + 0.002 * draw.standard_normal(len(a) - shift))), (3, wav(b)), (4, b""), (5, None), (6, wav(a))]
    got = {r["doc_id"]: r for r in chroma.fingerprint_and_align(spark.createDataFrame(rows, "doc_id bigint, media binary")).collect()}
    assert (got[2]["aligned_id"], got[2]["offset"], got[2]["matched"]) == (1, -20, True) and got[2]["bit_error"] < 0.15
    assert (got[6]["aligned_id"], got[6]["offset"], got[6]["bit_error"]) == (1, 0, 0.0) and got[6]["fingerprint_sha256"] == got[1]["fingerprint_sha256"]
    assert not got[3]["matched"] and got[4]["n_frames"] == got[5]["n_frames"] == 0 and got[4]["aligned_id"] is None


def test_chroma_edges(spark):
    assert chroma.fingerprint_and_align(edge_docs(spark), media="text").count() == 10
    assert chroma.fingerprint_and_align(edge_docs(spark).limit(0), media="text").count() == 0


def test_patterns_of_integers(spark):
    """Copies of several lengths, a jingle in a smaller recording, noise, hot patterns: the votes are those of all places, or no pattern is shared."""
    draw = random.Random(17)
    song, codes = list(range(1000, 1100)), {}
    codes |= {1: song[:60], 2: [7, *song], 3: song, 4: song[50:], 5: [1, 1, 1, 1], 6: [1, 1, 1], 7: [1, 1], 8: [1], 9: []}
    for i in range(20, 80, 3):
        tune = [draw.randrange(1 << 20) for _ in range(draw.randrange(8, 40))]
        codes |= {i: tune, i + 1: [5, *tune], i + 2: [x if draw.random() < 0.7 else draw.randrange(1 << 20) for x in tune[draw.randrange(3) :]]}
    rows = [(d, len(c), c, hashlib.sha256(np.array(c, dtype="<u4").tobytes()).hexdigest()) for d, c in codes.items()]
    prints = spark.createDataFrame(rows, "doc_id bigint, n_frames bigint, codes array<int>, fingerprint_sha256 string")
    got, exact = ({r["doc_id"]: (r["aligned_id"], r["offset"], r["votes"]) for r in chroma.align(prints, every=e).collect()} for e in (False, True))
    for d, c in codes.items():
        held = lambda x: {tuple(x[i + k] for k in p) + (n,) for n, p in enumerate(chroma.PATTERNS) for i in range(len(x) - max(p))}
        pairs = any(c == x or held(c) & held(x) for o, x in codes.items() if o != d and c)
        if pairs:  # in a loop several offsets may have as many votes
            other, offset, votes = got[d]
            assert (other, votes) == exact[d][::2] and votes == sum(0 <= i - offset < len(codes[other]) and codes[other][i - offset] == a for i, a in enumerate(c)), d
            assert d < 10 or offset == exact[d][1]
        else:
            assert got[d] == (None, None, None)
    assert got[3] == (2, -1, 100)


def test_votes_of_all_recordings(spark):
    """Against brute force: a jingle in a smaller recording, whole copies, loops, and random codes of which many are hot."""
    draw = random.Random(13)
    song = list(range(1000, 1100))
    codes = {1: song[:60], 2: [7, *song], 3: song, 4: [8, 9, *song], 5: song, 6: [1, 2, 1, 2, 1, 2, 3], 7: [2, 1, 2, 3], 8: [5], 9: [5], 10: [5, 6], 11: [], 12: [77]}
    codes |= {i: [draw.randrange(12) for _ in range(draw.randrange(1, 6))] for i in range(20, 90)}
    rows = [(d, len(c), c, hashlib.sha256(np.array(c, dtype="<u4").tobytes()).hexdigest()) for d, c in codes.items()]
    got = {r["doc_id"]: (r["aligned_id"], r["offset"], r["votes"]) for r in chroma.align(spark.createDataFrame(rows, "doc_id bigint, n_frames bigint, codes array<int>, fingerprint_sha256 string"), every=True).collect()}
    for d, c in codes.items():
        votes = Counter((o, i - j) for o, x in codes.items() if o != d for i, a in enumerate(c) for j, b in enumerate(x) if a == b)
        best = min(((-n, o, k) for (o, k), n in votes.items()), default=None)
        assert got[d] == ((best[1], best[2], -best[0]) if best else (None, None, None))
    assert got[3] == (2, -1, 100)


def brute_votes(codes):
    """{d: (other, offset, votes)} of the recording of most votes, by all places of all integers."""
    held, found = {}, {}
    for o, x in codes.items():
        for j, b in enumerate(x):
            held.setdefault(int(b), []).append((o, j))
    for d, c in codes.items():
        votes = Counter((o, i - j) for i, a in enumerate(c) for o, j in held[int(a)] if o != d)
        if best := min(((-n, o, k) for (o, k), n in votes.items()), default=None):
            found[d] = (best[1], best[2], -best[0])
    return found


def test_chroma_query_loses_no_partner(spark, sf_dir, docs, monkeypatch):
    """The query's partners, offsets and votes are the best of all recordings, also where blocks part them."""
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    codes = {d: chroma.pack(chroma.chroma([chroma.samples((t or "").encode())]))[0] for d, t in texts.items()}
    want = brute_votes(codes)
    for places in (chroma.BLOCK_PLACES, sum(map(len, codes.values())) / 9):
        monkeypatch.setattr(chroma, "BLOCK_PLACES", places)
        got = {r["doc_id"]: (r["aligned_id"], r["offset"], r["votes"]) for r in queries.op3_chroma(spark, sf_dir).collect()}
        assert got.keys() == texts.keys() and {d: v for d, v in got.items() if v[0] is not None} == want


@pytest.mark.parametrize("pairs", [1, 7, 200, 1 << 20])
def test_best_votes(monkeypatch, pairs):
    """Against brute force: hot integers, loops and single places, however few pairs of places are joined at once."""
    monkeypatch.setattr(chroma, "PLACE_PAIRS", pairs)
    draw, ids = random.Random(29), np.arange(40) * 3
    codes = [np.array([draw.randrange(draw.choice([1, 2, 5, 40])) for _ in range(draw.randrange(1, 25))], dtype=np.int32) for _ in ids]
    best = {}
    for left, right in ((slice(0, 40, 2), slice(0, 40, 2)), (slice(1, 40, 2), slice(1, 40, 2)), (slice(0, 40, 2), slice(1, 40, 2))):
        for d, other, offset, votes in zip(*(x.tolist() for x in chroma.best_votes(ids, codes, np.arange(40)[left], np.arange(40)[right])), strict=True):
            best[d] = min(best.get(d, (0,)), (-votes, other, offset))
    assert {d: (b[1], b[2], -b[0]) for d, b in best.items()} == brute_votes(dict(zip(ids.tolist(), codes, strict=True)))


# --- 4: licenses --------------------------------------------------------------------------------


def brute_scan(text):
    low = (text or "").translate(str.maketrans(url_filter.UPPER, url_filter.LOWER))
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for phrase, label in license_scan.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    body = "".join(f" {x} " for x in w)
    found = sorted((m.start(), -m.end(), -p, label, s) for label, _, e, p, s in license_scan.rules() for m in re.finditer(e, body))
    kept = [m for i, m in enumerate(found) if not any(o[1] <= m[1] and o[2] <= m[2] for o in found[:i])]
    at = [i for i, _ in places]
    return (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted({m[3] for m in kept} | {x for _, x in places})), max([m[4] for m in kept] + [0.6] * bool(places) + [0.0]))


def test_license_scan(spark, docs):
    cases = [
        "Licensed under CC-BY 4.0. CC BY CC-BY-SA 3.0", "GNU General Public License, version 3. All rights reserved. ALL RIGHTS RESERVED!", "Apache License, Version 2.0; the Apache License", "SPDX-License-Identifier: MIT",
        "Redistribution and use in source and binary forms; BSD 3-Clause License", "under the terms of the GNU Lesser General Public License v2.1", "copyright 2020 someone. cc0 public domain without warranty of any kind", "no license at all", "Creative Commons Attribution-ShareAlike", "MIT" * 50,
    ]
    extra = spark.createDataFrame([(100_000 + i, c) for i, c in enumerate(cases)], "doc_id bigint, text string")
    table = docs.select("doc_id", "text").unionByName(extra).unionByName(edge_docs(spark).select("doc_id", "text"))
    for r in license_scan.scan(table).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"]) == brute_scan(r["text"])
    assert len(license_scan.rules()) > 300
    assert license_scan.scan(edge_docs(spark).limit(0)).count() == 0 and license_scan.scan(edge_docs(spark)).count() == 10


def test_license_scan_without_gate(spark):
    """A text of each rule's own words and no others, and texts without 'license' or 'copyright'."""

    def written(e):
        e = e.replace("(?: [^ ]+ )?", "").replace(" [^ ]+ ", " some ")
        e = re.sub(r"\(\?:([^()|]*)\)\?", r"\1", e)
        return " ".join(re.sub(r"\(\?:([^()|]*)\|[^()]*\)", r"\1", e).replace("?", "").replace("(:", " ").replace(")", " ").split())

    texts = ["Distributed under Apache 2.0", "released under the GPL v3", "BSD 3 clause", "no part of this work may be reproduced", "GNU GPL", "open source software", "under the terms of the MIT", "mitten in Permits vimeo"]
    texts += [written(e) for _, _, e, _, _ in license_scan.rules()]
    assert all(brute_scan(t)[5] for t in texts[:7])
    rows = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert sum(brute_scan(t)[6] > 0 for t in texts) > 550
    for r in rows:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"]) == brute_scan(r["text"])


# --- 5: repeated passages -----------------------------------------------------------------------


def brute_repeats(texts, window):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return out


@pytest.mark.parametrize(("window", "seed"), [(6, 3), (35, 10), (5, 5)])
def test_repeats(spark, window, seed):
    draw = random.Random(window)
    passages = [words(draw, window + draw.randrange(-2, 30)) for _ in range(6)]
    texts = []
    for _ in range(60):
        parts = [words(draw, draw.randrange(2 * window), 60) if draw.random() < 0.5 else draw.choice(passages) for _ in range(4)]
        texts.append(" ".join(x for p in parts for x in p))
    texts += ["a " * 3 * window, "a b " * 2 * window, texts[0], texts[0], "", None, " ".join(passages[0])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = substring_dedup.remove_repeats(df, window=window, seed_words=seed, digest=True)
    assert [tuple(r)[1:] for r in got.select("doc_id", "n_words", "n_removed", "kept_sha256").orderBy("doc_id").collect()] == brute_repeats(texts, window)


def test_repeats_edges(spark):
    got = substring_dedup.remove_repeats(edge_docs(spark))
    rows = {(r["doc_id"], r["n_words"], r["n_removed"], r["score"]) for r in got.collect()}
    n = 4 * 4000
    assert {(1, 0, 0, "own"), (2, 0, 0, "own"), (3, 0, 0, "own"), (4, n, n, "own"), (7, n, n, "own"), (5, 1, 0, "own")} <= rows and got.count() == 10
    assert [r["text"] for r in got.where("doc_id = 3 or doc_id = 1").orderBy("doc_id").collect()] == [None, " \t\n"]
    assert substring_dedup.remove_repeats(edge_docs(spark).limit(0)).count() == 0


# --- 6: sharding --------------------------------------------------------------------------------


def test_lookup_table():
    names = [f"s{i}" for i in range(10)]
    full, less = sharding.lookup_table(names, 1009), sharding.lookup_table(names[:-1], 1009)
    load = Counter(full)
    assert max(load.values()) - min(load.values()) <= 1
    moved = sum(a != b for a, b in zip(full, less, strict=True) if a != 9)
    assert moved < 0.15 * 1009
    for bad in (names, 1000), (names + names[:1], 1009), ([], 1009):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def test_place(spark):
    rows = sharding.place(edge_docs(spark)).collect()
    owners = sharding.lookup_table()
    assert len(rows) == 10
    for r in rows:
        slot = int(hashlib.md5(str("" if r["doc_id"] is None else r["doc_id"]).encode()).hexdigest()[:8], 16) % sharding.SLOTS
        assert r["slot"] == slot and r["shard"] == sharding.SHARDS[owners[slot]]


# --- 7: packing ---------------------------------------------------------------------------------


def test_best_fit():
    draw = np.random.default_rng(6)
    for lengths in ((64,), (16, 32, 64), (10, 25)):
        sizes = np.minimum(1 + draw.geometric(0.06, 3000), max(lengths))
        bins, offset, capacity = packing.best_fit(sizes, lengths)
        held = np.bincount(bins, weights=sizes)
        assert (held <= max(lengths)).all() and (capacity == np.array([min(c for c in lengths if c >= h) for h in held])[bins]).all()
        for b in range(0, len(held), 50):
            own = np.flatnonzero(bins == b)
            own = own[np.argsort(offset[own])]
            assert offset[own].tolist() == [0, *np.cumsum(sizes[own])[:-1].tolist()]
        assert sizes.sum() / capacity[np.unique(bins, return_index=True)[1]].sum() > 0.97
    assert [len(x) for x in packing.best_fit(np.zeros(0, dtype=np.int64))] == [0, 0, 0]


def test_pack_rows(spark):
    rows = [(1, 5), (1, 5), (2, 0), (3, None), (4, 100_000), (None, 7), (5, 4096)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id bigint, length bigint")).toPandas()
    assert sorted(got.groupby("doc_id", dropna=False)["length"].sum().items(), key=repr)[:3] == sorted([(1.0, 10), (4.0, 100_000), (5.0, 4096)], key=repr)[:3] or got["length"].sum() == 10 + 100_000 + 7 + 4096
    assert (got.groupby("bin_id")["length"].sum() <= got.groupby("bin_id")["capacity"].first()).all()
    assert got[got.doc_id == 4].sort_values("piece")["start"].tolist() == [4096 * i for i in range(25)]
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, length bigint")).count() == 0


# --- 8: URLs ------------------------------------------------------------------------------------


def test_url_rules(spark):
    cases = {
        "http://a.example.com/en/x": ("a.example.com", "/en/x", "example.com/en/", "block"), "https://WWW.Example.com/en/?q": ("www.example.com", "/en/", "www.example.com/en/", "allow"), "http://b.net/es/1#f": ("b.net", "/es/1", "net/es/", "block"),
        "http://b.net/de/": ("b.net", "/de/", None, "allow"), "http://x.com": ("x.com", "", None, "allow"), "http://x.com?a=/": ("x.com", "", None, "allow"), "no url": ("", "", None, "allow"), None: ("", "", None, "allow"), "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"), "ftp://u@h.com:80/p": ("u@h.com:80", "/p", None, "allow"), "": ("", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "own") for i, u in enumerate(cases)], "page_id bigint, url string, rule string")
    for r in url_filter.judge(pages).collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == cases[r["url"]]


def test_url_aliases(spark):
    html = {
        "http://a.org/1": '<link rel="canonical" href="http://b.org/2#x">', "http://b.org/2": '<META HTTP-EQUIV="refresh" content="0; url=/3">', "http://b.org/3": "<link href='http://z.net/es/bad' rel=canonical>",
        "http://x.com/ok": '<link rel="canonical" href="http://z.net/es/bad">', "http://c.org/": "<p>canonical</p>", "http://c.org/self": '<link rel="canonical" href="self">', "http://d.org/k": None, None: '<link rel="canonical" href="http://z.net/es/bad">',
    }
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(html.items())] + [(99, "http://a.org/1", None)], "page_id bigint, url string, html string")
    got = {(r["page_id"], r["url"]): r["verdict"] for r in url_filter.judge(pages, links=url_filter.aliases(pages)).collect()}
    blocked = {u for (_, u), v in got.items() if v == "block"}
    assert blocked == {"http://a.org/1", "http://b.org/2", "http://b.org/3"} and got[(99, "http://a.org/1")] == "block" and len(got) == 9
    pages.createOrReplaceTempView("pages_case")
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    assert {(r[0], r[1]) for r in con.sql(f"SELECT page_id, verdict FROM ({url_filter.oracle()}) q").fetchall()} == {(p, v) for (p, _), v in got.items()}
    assert url_filter.judge(pages.limit(0), links=url_filter.aliases(pages.limit(0))).count() == 0


def test_url_aliases_are_all_edges(spark):
    link, refresh = '<link rel="canonical" href="{}">', '<meta http-equiv="refresh" content="0; url={}">'
    html = [link.format("/c") + refresh.format("http://z.net/es/bad"), link.format("/c") + link.format("http://z.net/es/bad"), refresh.format("/c") + link.format("/c") + refresh.format("")]
    pages = spark.createDataFrame([(i, f"http://h{i}.org/", h) for i, h in enumerate(html)], "page_id bigint, url string, html string")
    edges = url_filter.aliases(pages)
    assert collected(edges, "source", "target") == [(f"http://h{i}.org/", t) for i in range(2) for t in (f"http://h{i}.org/c", "http://z.net/es/bad")] + [("http://h2.org/", "http://h2.org/c")]
    assert collected(url_filter.judge(pages, links=edges), "page_id", "verdict") == [(0, "block"), (1, "block"), (2, "allow")]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(name, spark, sf_dir):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    got, want = queries.QUERIES[name](spark, sf_dir), con.sql(queries.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert collected(got, *sorted(got.columns)) == sorted((tuple(dict(zip(want.columns, r, strict=True))[c] for c in sorted(got.columns)) for r in want.fetchall()), key=repr)


# --- 9: languages -------------------------------------------------------------------------------


def test_language_accuracy(spark, sf_dir):
    got = queries.op9_langid(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id")
    row = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.count(F.lit(1)).alias("n")).first()
    assert row["a"] > 0.98 and row["n"] > 200


def test_language_edges(spark, docs):
    model = langid.fit(docs.where(~langid.held_out()))
    got = langid.identify(edge_docs(spark), model).collect()
    assert len(got) == 10 and all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3)} == {"und"}
    none = langid.fit(docs.limit(0))
    assert {r["lang_pred"] for r in langid.identify(docs, none).select("lang_pred").collect()} == {"und"}
    one = langid.fit(docs.where("lang = 'en'"))
    assert {r["lang_pred"] for r in langid.identify(docs, one).select("lang_pred").collect()} == {"en"}
    codes = langid.codewords(12)
    assert min((codes[a] != codes[b]).sum() for a in range(12) for b in range(a)) >= 10
    # neither language label nor source nor doc_id are inputs
    swapped = langid.identify(docs.withColumns({"lang": F.lit("xx"), "source": F.lit("y"), "doc_id": F.col("doc_id") + 1}), model)
    assert [r[0] for r in swapped.orderBy("doc_id").select("lang_pred").collect()] == [r[0] for r in langid.identify(docs, model).orderBy("doc_id").select("lang_pred").collect()]


@pytest.mark.parametrize("n", range(1, 13))
def test_codewords_end(n):
    codes = langid.codewords(n)
    assert codes.shape[0] == n and len({tuple(c * c[0]) for c in codes.T}) == codes.shape[1] and len({tuple(r) for r in codes}) == n


# --- 10: vectors --------------------------------------------------------------------------------


def test_vectors(spark, monkeypatch):
    draw = np.random.default_rng(7)
    rows, centre = [], draw.standard_normal((8, 64))
    for i in range(1200):
        v = centre[draw.integers(8)] + 0.12 * draw.standard_normal(64) if draw.random() < 0.6 else draw.standard_normal(64)
        rows.append((i, v.astype(np.float32).tolist(), int(draw.integers(2))))
    good = len(rows)
    rows += [(5000, None, 1), (5001, [0.0] * 64, 1), (5002, [float("nan")] * 64, 1), (5003, [1.0, None], 1), (5004, rows[0][1], None), (5005, [float("inf")] + [0.0] * 63, 0), (5006, [], 1), (5007, [1.0, 2.0], 1), (5008, [2.0, 4.0], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in embedding_dedup.near_links(df, block=64).collect()}
    u = np.stack([np.array(r[1]) for r in rows[:good]])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows[:good]])
    near = (u @ u.T >= 0.98) & (label[:, None] == label[None]) & ~np.eye(good, dtype=bool)
    want, have = near.sum(axis=1), np.array([got[i]["n_links"] for i in range(good)])
    assert len(got) == len(rows) and (have <= want).all() and have.sum() >= 0.97 * want.sum() > 1000
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in (5000, 5001, 5002, 5003, 5004, 5005, 5006))
    assert got[5007]["n_links"] == got[5008]["n_links"] == 1 and got[5008]["component_id"] == 5007 and not got[5008]["kept"]
    assert embedding_dedup.near_links(df.limit(0)).count() == 0


def test_parities_lose_no_similar_set():
    """The parities rule out no pair that brute force finds, and of larger sets nearly all that have little in common."""
    draw = np.random.default_rng(14)
    sets = []
    for n in (0, 1, 5, 60, 64, 65, 130, 700):
        base = draw.integers(0, 1 << 64, n, dtype=np.uint64)
        sets += [np.unique(np.concatenate((base[: int(n * keep)], draw.integers(0, 1 << 64, int(n * new), dtype=np.uint64)))) for keep, new in ((1, 0), (0.95, 0.05), (0.9, 0.1), (1, 0.24), (0.6, 0.2), (0.3, 0.9))]
    sketches, size, root, side = [simhash.parities(s) for s in sets], np.array([*map(len, sets)]), np.array([0, 1]), np.arange(2)
    similar = unlike = passed = 0
    for a in range(len(sets)):
        for b in range(len(sets)):
            got = bool(simhash.may_be_alike([sketches[a], sketches[b]], size[[a, b]], root, side[:1], side[1:], 0.8)[0])
            both = len(np.intersect1d(sets[a], sets[b]))
            assert simhash.distance(sketches[a], sketches[b]) <= size[a] + size[b] - 2 * both
            if size[a] and simhash.alike(sets[a], sets[b], 0.8):
                similar += 1
                assert got
            if min(size[a], size[b]) >= 50 and not simhash.alike(sets[a], sets[b], 0.4):
                unlike += 1
                passed += got
    assert similar > len(sets) and unlike > 100 and passed <= 0.02 * unlike


def test_languages_that_tie(spark):
    """Equal samples under two labels give a score between 0 and 1 and the first label; a third language is still told apart."""
    rows = [(0, "the same words here", "aa"), (2, "the same words here", "bb")]
    held = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = langid.identify(held, langid.fit(held)).collect()
    assert [(r["lang_pred"], round(r["score"], 6), r["ambiguous"]) for r in got] == [("aa", 0.5, True)] * 2
    three = held.unionByName(spark.createDataFrame([(3, "zzq qqz xxk kkx", "cc")], held.schema))
    told = {r["doc_id"]: r for r in langid.identify(three, langid.fit(three)).collect()}
    assert told[3]["lang_pred"] == "cc" and told[0]["lang_pred"] in ("aa", "bb") and all(0 <= r["score"] <= 1 for r in told.values())
