"""Language identification by error-correcting output codes.

Every language has a codeword of -1 and +1. For each bit, a binary naive Bayes classifier over hashed
byte n-grams tells the languages of one sign from those of the other; a text's margin is the mean
log-odds of its n-grams. Decoding takes the language whose codeword has the least logistic loss over the bits,
each weighted by how well its classifier parts the languages it was trained on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import importable

UNDETERMINED = "und"
ORDERS = (3, 4)
FEATURE_BITS = 14
FEATURES = len(ORDERS) << FEATURE_BITS
#: Rows of each language that training reads, about; chosen by a hash of doc_id.
SAMPLE_ROWS = 1500
#: Labels that a model may have.
MOST_LANGUAGES = 1000
#: A decision is ambiguous if its score is below this.
AMBIGUOUS = 0.6
#: How steeply the loss falls with a margin, in units of the bit's mean training margin.
STEEP = 4.0
FLAT_BYTES = 1 << 20
_PLAIN = bytes(c if c >= 0x80 or 97 <= c <= 122 else 32 for c in range(256))


def _clean(text: str) -> bytes:
    """Lower-cased UTF-8 with every other ASCII character than a letter as one space, spaces around."""
    return b" " + b" ".join(text.lower().encode().translate(_PLAIN).split()) + b"   "


def _has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def _grams(raw: np.ndarray, order: int) -> np.ndarray:
    """The feature of each run of order bytes."""
    code = raw[: len(raw) - order + 1].astype(np.uint32)
    for k in range(1, order):
        code = code << np.uint32(8) | raw[k : len(raw) - order + 1 + k]
    return (code * np.uint32(2654435761) >> np.uint32(32 - FEATURE_BITS)).astype(np.int64) + (ORDERS.index(order) << FEATURE_BITS)


def codewords(n: int) -> np.ndarray:
    """(n, bits) of -1 and +1: every way to part up to five languages, every balanced one of few, else random balanced columns, none twice."""
    if n <= 5:
        bits = [[1] + [1 if k >> i & 1 else -1 for i in range(n - 1)] for k in range((1 << n - 1) - 1)]
        return np.array(bits, dtype=np.int64).reshape(-1, n).T
    wanted, exist = 12 * math.ceil(math.log2(n)), math.comb(n, n // 2) // (2 - n % 2)
    if exist <= wanted:
        ways = [np.isin(np.arange(n), chosen) * 2 - 1 for chosen in combinations(range(n), n // 2)]
        return np.unique([column * column[0] for column in ways], axis=0).T
    draw, columns = np.random.default_rng(n), {}
    while len(columns) < wanted:
        column = draw.permutation(np.where(np.arange(n) < n // 2, 1, -1))
        columns.setdefault((column * column[0]).tobytes(), column * column[0])
    return np.stack([*columns.values()], axis=1)


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray
    odds: np.ndarray  # (features, bits), float32, in units of each bit's mean training margin
    weights: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Language, score (0 to 1) and whether the decision is ambiguous, of each whole text."""
        names, scores, unsure = [UNDETERMINED] * len(texts), [0.0] * len(texts), [False] * len(texts)
        todo = [i for i, t in enumerate(texts) if self.languages and _has_letter(t)]
        for chunk in _chunks([(i, _clean(texts[i])) for i in todo]):
            margins = self._margins([raw for _, raw in chunk])
            loss = np.stack([(self.weights * np.logaddexp(0, -STEEP * margins * code)).sum(axis=1) for code in self.codes], axis=1)
            share = np.exp(loss.min(axis=1, keepdims=True) - loss)
            share /= share.sum(axis=1, keepdims=True)
            for (i, _), best, row in zip(chunk, share.argmax(axis=1).tolist(), share, strict=True):
                names[i], scores[i] = self.languages[best], float(row[best])
                unsure[i] = scores[i] < AMBIGUOUS
        return names, scores, unsure

    def _margins(self, raws: list[bytes]) -> np.ndarray:
        size = np.array([*map(len, raws)])
        first, flat = np.cumsum(size) - size, np.frombuffer(b"".join(raws) + b"    ", dtype=np.uint8)
        total, count = np.zeros((len(raws), self.odds.shape[1])), np.zeros(len(raws))
        for order in ORDERS:
            bounds = np.stack((first, first + size - order + 1), axis=1).ravel()
            total += np.add.reduceat(self.odds[_grams(flat, order)], bounds, axis=0, dtype=np.float64)[::2]
            count += size - order + 1
        return total / count[:, None]


def _chunks(items: list[tuple[int, bytes]]) -> Iterator[list[tuple[int, bytes]]]:
    held, size = [], 0
    for item in items:
        if held and size + len(item[1]) > FLAT_BYTES:
            yield held
            held, size = [], 0
        held.append(item)
        size += len(item[1])
    if held:
        yield held


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", rows_per_language: int = SAMPLE_ROWS) -> Model:
    """A model of the languages of labelled rows.

    Learns from about rows_per_language whole texts of each language, chosen by a hash of doc_id that has nothing
    to do with their order; rows without doc_id, text or lang don't take part. What comes to the driver are n-gram
    counts: languages times features at most, and more than MOST_LANGUAGES labels are refused. Without usable rows the model has no
    language and every text is undetermined. Languages whose samples are alike tie: the first by name is told, with an equal share.
    """
    importable(labelled.sparkSession)
    rows = labelled.select(F.col(lang).alias("lang"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("lang is not null and doc_id is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} different labels; clean them first")
    names = sorted(counts)
    if not names:
        return Model([], np.zeros((0, 0)), np.zeros((FEATURES, 0), dtype=np.float32), np.zeros(0))
    place = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30))
    limit = F.element_at(F.create_map(*[F.lit(x) for n in names for x in (n, min(1 << 30, rows_per_language * (1 << 30) // counts[n]))]), F.col("lang"))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, texts in batch.groupby("lang")["text"]:
                n = np.zeros(FEATURES, dtype=np.int64)
                for content in texts:
                    if _has_letter(content):
                        raw = np.frombuffer(_clean(content), dtype=np.uint8)
                        for order in ORDERS:
                            n += np.bincount(_grams(raw, order), minlength=FEATURES)
                used = np.flatnonzero(n)
                yield pd.DataFrame({"lang": name, "feature": used, "n": n[used]})

    found = rows.where(place < limit).select("lang", "text").mapInPandas(counted, "lang string, feature int, n bigint").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((len(names), FEATURES))
    table[found["lang"].map(names.index).to_numpy(dtype=np.int64), found["feature"].to_numpy(dtype=np.int64)] = found["n"]
    heard = table.sum(axis=1) > 0
    names, table = [n for n, ok in zip(names, heard, strict=True) if ok], table[heard]
    shares = (table + 0.05) / (table + 0.05).sum(axis=1, keepdims=True)
    codes = codewords(len(names))
    odds = np.stack([np.log(shares[bit > 0].mean(axis=0)) - np.log(shares[bit < 0].mean(axis=0)) for bit in codes.T], axis=1) if codes.shape[1] else np.zeros((FEATURES, 0))
    margins = np.abs(shares @ odds)
    # a bit whose languages can't be told apart says nothing; without any other all languages share alike and the first is told
    telling = margins.mean(axis=0) > 1e-12
    scale = np.where(telling, margins.mean(axis=0), 1.0)
    parted = np.where(telling, margins.min(axis=0) / scale, 0.0)
    whole = parted.sum()
    return Model(names, codes, np.where(telling, odds / scale, 0.0).astype(np.float32), parted / whole * codes.shape[1] if whole > 0 else parted)


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with lang_pred, score and ambiguous for each whole text; columns of df that have these names are replaced.

    Null texts and texts without a letter are "und" with score 0. One pass without a shuffle; the model (features
    times bits) is broadcast.
    """
    importable(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def told(texts: pd.Series) -> pd.DataFrame:
        names, scores, unsure = shared.value.predict([t if isinstance(t, str) else None for t in texts])
        return pd.DataFrame({"lang_pred": names, "score": scores, "ambiguous": unsure})

    kept = [c for c in df.columns if c not in ("lang_pred", "score", "ambiguous")]
    hidden = "__told"
    while hidden in kept:
        hidden += "_"
    out = df.select(*[F.col(f"`{c}`") for c in kept], told(F.col(text)).alias(hidden))
    return out.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"{hidden}.{c}").alias(c) for c in ("lang_pred", "score", "ambiguous")])


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from training: crc32 of its doc_id as text, modulo 3, is 1 (no doc_id: no)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))
