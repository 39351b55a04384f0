"""Removal of repeated passages: seed on winnowed anchors, extend both ways, keep maximal repeats.

A window is a fixed number of consecutive words of one document. Of each window the smallest of its
seed hashes (leftmost on ties) is an anchor, so that equal windows hold the same anchor at the same place
and only about one position in fourteen is looked at further:

1. Anchors are counted over all documents, combined per batch before the shuffle. Those that occur
   once go. An occurrence's context is the anchor with as many words either way as any window
   through it can hold. If all occurrences of an anchor share one context, their whole contexts are
   repeated and need no extension.
2. Otherwise occurrences are classed by context. A class of two or more is repeated in full;
   one member stands for it from here on. Members of single classes are candidates.
3. Documents with candidates or such members are read again; each candidate is extended
   both ways to every window through it, and windows are matched by 128-bit hash. Those
   that start at two places or more are repeated.
4. The union of the repeated contexts and windows of a document are its maximal repeats; their
   words go.

A passage in a third of all documents is one class: it is summed before each shuffle and stands
for itself once in step 3, so no step makes pairs of its copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import importable, stored

WINDOW = 35
SEED_WORDS = 10
#: Words that one set of arrays holds; a longer document has its own.
FLAT_WORDS = 200_000
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base to the powers 0 to n-1 modulo 2^64."""
    if len(_powers.get(base, ())) < n:
        table = np.full(max(n, 2 * FLAT_WORDS), np.uint64(base & (1 << 64) - 1), dtype=np.uint64)
        table[0] = 1
        _powers[base] = np.multiply.accumulate(table)
    return _powers[base][:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class Flat:
    """Rolling hashes over the words of some documents, one after another."""

    def __init__(self, docs: list[list[bytes]], window: int, seed_words: int):
        self.window, self.seed_words, self.reach = window, seed_words, window - seed_words
        self.sizes = np.fromiter(map(len, docs), dtype=np.int64, count=len(docs))
        self.first = np.cumsum(self.sizes) - self.sizes
        n = int(self.sizes.sum())
        self.of = np.repeat(np.arange(len(docs)), self.sizes)
        digest = xxhash.xxh64_intdigest
        words = np.fromiter((digest(w) for doc in docs for w in doc), dtype=np.uint64, count=n)
        self.sums = []
        for base, x in zip(BASES, (words, _mixed(words)), strict=True):
            self.sums.append(np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(x * _power(base, n), dtype=np.uint64))))

    def hashes(self, which: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Of the words from start to before stop."""
        inverse = _power(pow(BASES[which], -1, 1 << 64), len(self.of) + 1)
        return _mixed((self.sums[which][stop] - self.sums[which][start]) * inverse[start])

    def anchors(self) -> np.ndarray:
        """Places of the anchors of all windows."""
        n, width = len(self.of), self.reach + 1
        if n < self.window:
            return np.zeros(0, dtype=np.int64)
        at = np.arange(n - self.seed_words + 1)
        value, place, span = self.hashes(0, at, at + self.seed_words), at, 1
        while span < width:
            step = min(span, width - span)
            later = value[step:] < value[:-step]
            value, place = np.where(later, value[step:], value[:-step]), np.where(later, place[step:], place[:-step])
            span += step
        whole = self.of[: n - self.window + 1] == self.of[self.window - 1 :]
        return np.unique(place[: n - self.window + 1][whole])

    def contexts(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word of each place's context, and the place behind its last."""
        begin = self.first[self.of[at]]
        return np.maximum(begin, at - self.reach), np.minimum(begin + self.sizes[self.of[at]], at + self.window)

    def seeds(self) -> tuple[np.ndarray, ...]:
        """Place, anchor hash and context hash of every anchor."""
        at = self.anchors()
        a, b = self.contexts(at)
        context = _mixed(self.hashes(1, a, b) + np.uint64(0x9E3779B97F4A7C15) * ((at - a) * 4096 + b - at).astype(np.uint64))
        return at, self.hashes(0, at, at + self.seed_words).view(np.int64), context.view(np.int64)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def _flats(texts: list, window: int, seed_words: int) -> Iterator[tuple[int, Flat]]:
    """(place of the first text, its hashes and those of the texts that follow it)"""
    docs, begin, held = [], 0, 0
    for i, text in enumerate(texts):
        words = _words(text)
        if docs and held + len(words) > FLAT_WORDS:
            yield begin, Flat(docs, window, seed_words)
            docs, begin, held = [], i, 0
        docs.append(words)
        held += len(words)
    if docs:
        yield begin, Flat(docs, window, seed_words)


def repeats(docs: DataFrame, window: int = WINDOW, seed_words: int = SEED_WORDS) -> DataFrame:
    """The repeated stretches of docs (rid bigint, th bigint, text and any others; the first two never null).

    One row per document (rid, th) that has any: contexts, an array of anchors' places whose whole contexts are repeated, and
    starts, an array of places where a repeated window starts. Documents with equal rid and th are equal; each counts.
    """
    importable(docs.sparkSession)
    reach = window - seed_words

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [flat.seeds()[1:] for _, flat in _flats(batch["text"].tolist(), window, seed_words)]
            anchor, context = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, dtype=np.int64),) * 2
            order = np.argsort(anchor, kind="stable")
            anchor, context = anchor[order], context[order]
            if len(anchor):
                new = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
                yield pd.DataFrame({"anchor": anchor[new], "n": np.diff(np.append(new, len(anchor))), "low": np.minimum.reduceat(context, new), "high": np.maximum.reduceat(context, new)})

    def seeded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rid, th = batch["rid"].to_numpy(), batch["th"].to_numpy()
            for begin, flat in _flats(batch["text"].tolist(), window, seed_words):
                at, anchor, context = flat.seeds()
                doc = flat.of[at]
                yield pd.DataFrame({"rid": rid[begin + doc], "th": th[begin + doc], "at": at - flat.first[doc], "anchor": anchor, "context": context})

    counts = docs.select("text").mapInPandas(counted, "anchor bigint, n bigint, low bigint, high bigint")
    # The joins' added keys are functions of the others. They give both sides a plain shuffle of their own, which adaptive
    # execution can split where an anchor or a class is hot; an aggregate's shuffle it can't.
    shared = counts.groupBy("anchor").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).where("n > 1").select("anchor", (F.col("low") != F.col("high")).alias("several"), F.hash("anchor").alias("tag"))
    # an occurrence is one array, so that the three branches below read the same columns and share one shuffle
    names = ("rid", "th", "at", "context")
    found_at = docs.select("rid", "th", "text").mapInPandas(seeded, "rid bigint, th bigint, at int, anchor bigint, context bigint")
    seeds = found_at.select("anchor", F.hash("anchor").alias("tag"), F.array(*[F.col(c).cast("bigint") for c in names]).alias("o")).where("o[3] is not null").join(shared, ["anchor", "tag"])
    unpacked = [F.col("o")[i].cast("int" if c == "at" else "bigint").alias(c) for i, c in enumerate(names)]
    several = seeds.where("several").select("anchor", *unpacked)
    classes = several.groupBy("anchor", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "th", "at")).alias("member"))
    kind = F.when(F.col("n") == 1, 1).when(F.col("member") == F.struct("rid", "th", "at"), 2).otherwise(0)
    both = ["anchor", "context", "tag"]
    classed = several.withColumn("tag", F.hash("anchor", "context")).join(classes.withColumn("tag", F.hash("anchor", "context")), both).select("rid", "th", F.struct("at", kind.alias("kind")).alias("s"))
    alike = seeds.where("not several").select(*unpacked[:3]).select("rid", "th", F.struct("at", F.lit(0).alias("kind")).alias("s"))
    found = stored(classed.unionByName(alike).groupBy("rid", "th").agg(F.collect_set("s").alias("seeds")), "seeds")

    def extended(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rid, th, places, kinds = batch["rid"].to_numpy(), batch["th"].to_numpy(), batch["places"].tolist(), batch["kinds"].tolist()
            for begin, flat in _flats(batch["text"].tolist(), window, seed_words):
                own = slice(begin, begin + len(flat.sizes))
                doc = np.repeat(np.arange(len(flat.sizes)), [*map(len, places[own])])
                at, kind = np.concatenate(places[own]).astype(np.int64) + flat.first[doc], np.concatenate(kinds[own])
                low, high = np.maximum(at - reach, flat.first[doc]), np.minimum(at, flat.first[doc] + flat.sizes[doc] - window) + 1
                n = len(flat.of)
                candidate, member = (np.cumsum(np.bincount(low[kind == k], minlength=n + 1) - np.bincount(high[kind == k], minlength=n + 1)) > 0 for k in (1, 2))
                start = np.flatnonzero(candidate | member)
                doc = flat.of[start]
                key = [flat.hashes(w, start, start + window).view(np.int64) for w in (0, 1)]
                yield pd.DataFrame({"rid": rid[begin + doc], "th": th[begin + doc], "start": start - flat.first[doc], "candidate": candidate[start], "k0": key[0], "k1": key[1]})

    open_ = found.select("rid", "th", F.filter("seeds", lambda s: s["kind"] > 0).alias("s")).where("size(s) > 0").select("rid", "th", F.col("s.at").alias("places"), F.col("s.kind").alias("kinds"))
    # all columns of docs go through, so that this join and the one that cuts the texts share one shuffle of them
    windows = docs.join(open_, ["rid", "th"]).mapInPandas(extended, "rid bigint, th bigint, start int, candidate boolean, k0 bigint, k1 bigint")
    again = windows.groupBy("k0", "k1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = again.withColumn("tag", F.hash("k0", "k1"))
    extra = windows.where("candidate").withColumn("tag", F.hash("k0", "k1")).join(again, ["k0", "k1", "tag"]).groupBy("rid", "th").agg(F.collect_set("start").alias("starts"))
    whole = found.select("rid", "th", F.transform(F.filter("seeds", lambda s: s["kind"] != 1), lambda s: s["at"]).alias("contexts"))
    return whole.join(extra, ["rid", "th"], "full")


def remove_repeats(df: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, seed_words: int = SEED_WORDS, digest: bool = False) -> DataFrame:
    """df with each whole text less its repeated words, and n_words and n_removed (bigint).

    A word goes if a window covers it whose word sequence also starts anywhere else, in the same document
    or in another (a row that repeats another counts as another document). The words kept are joined by one space where any
    went; other texts stay as they are. Null texts have no words and stay null. With digest, kept_sha256 (of
    the kept words joined by one space) takes the text's place. Columns n_words and n_removed of df are replaced.
    Rows whose doc_id is null are told apart by their texts.
    """
    importable(df.sparkSession)
    if not 0 < seed_words <= window < 4096:
        raise ValueError("seed_words must be from 1 to window, and window below 4096")
    rest = [c for c in df.columns if c not in (text, "n_words", "n_removed", "kept_sha256")]
    keyed = df.select(F.coalesce(F.col(doc_id).cast("bigint"), F.lit(-(1 << 63))).alias("rid"), F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull()).alias("th"), F.col(text).alias("text"), F.struct(*rest).alias("rest"))
    spans = repeats(keyed, window, seed_words)
    reach = window - seed_words

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, sizes, gone = [], [], []
            for content, contexts, starts in zip(batch["text"].tolist(), batch["contexts"].tolist(), batch["starts"].tolist(), strict=True):
                words = _words(content)
                kept, n = words, len(words)
                if contexts is not None or starts is not None:
                    at, start = (np.asarray(x if x is not None else (), dtype=np.int64) for x in (contexts, starts))
                    begin, end = np.concatenate((np.maximum(at - reach, 0), start)), np.concatenate((np.minimum(at + window, n), start + window))
                    marks = np.bincount(begin, minlength=n + 1) - np.bincount(end, minlength=n + 1)
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(marks[:-1]) == 0).tolist()]
                sizes.append(len(words))
                gone.append(len(words) - len(kept))
                if digest:
                    out.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                else:
                    out.append(content if len(kept) == len(words) else b" ".join(kept).decode())
            yield pd.DataFrame({"rest": batch["rest"], "n_words": sizes, "n_removed": gone, "out": out})

    kind = df.select(F.struct(*rest).alias("rest")).schema["rest"].dataType.simpleString()
    done = keyed.join(spans, ["rid", "th"], "left").select("text", "contexts", "starts", "rest").mapInPandas(cut, f"rest {kind}, n_words bigint, n_removed bigint, out string")
    name = "kept_sha256" if digest else text
    return done.select(*[F.col(f"rest.`{c}`") for c in rest], F.col("out").alias(name), "n_words", "n_removed")
