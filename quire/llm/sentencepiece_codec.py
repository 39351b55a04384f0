"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A batch's distinct words become flat arrays of symbols. Every round finds, for each word, the
adjacent pair of lowest rank (leftmost on ties) with one segmented minimum, merges those pairs in all
words at once and compacts the arrays; words without a mergeable pair leave. The library merges
one pair at a time in that very order, so the ids agree. Words are runs of the space mark with what follows
them; no piece of the model crosses their bounds (checked when the model is read).
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import importable

SPACE = "▁"
#: A longer word (in symbols) merges by a heap, which takes n log n steps where rounds take n squared.
LONG_WORD = 256
#: Words a worker remembers.
CACHE_WORDS = 400_000
NONE = np.int64(1) << 40

codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


def read_model(path: str) -> dict:
    """What encoding and decoding need of a model file, as plain lists; read on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    kinds = ["unknown" if model.is_unknown(i) else "control" if model.is_control(i) else "byte" if model.is_byte(i) else "unused" if model.is_unused(i) else "normal" for i in range(n)]
    pieces = [model.id_to_piece(i) for i in range(n)]
    if any(re.search(f"[^{SPACE}]{SPACE}", p) for p, k in zip(pieces, kinds, strict=True) if k == "normal") or "unused" in kinds:
        raise ValueError("the model has pieces across words or unused pieces")
    if kinds.count("byte") != 256:
        raise ValueError("the model has no byte pieces")
    return {"pieces": pieces, "scores": [model.get_score(i) for i in range(n)], "kinds": kinds, "bos": model.bos_id(), "eos": model.eos_id()}


class Codec:
    """Encodes and decodes whole texts with one model."""

    def __init__(self, model: dict):
        pieces, kinds = model["pieces"], model["kinds"]
        self.bos, self.eos, n = model["bos"], model["eos"], len(pieces)
        normal = {p: i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == "normal"}
        byte_ids = [i for i, k in enumerate(kinds) if k == "byte"]
        self.byte_ids = {int(pieces[i][3:5], 16): i for i in byte_ids}
        chars = sorted({c for p in normal for c in p} - normal.keys())
        #: ids of symbols: pieces, then characters that occur only inside pieces
        symbols = normal | {c: n + i for i, c in enumerate(chars)}
        self.symbols, self.known = symbols, n
        rank_of = {s: r for r, s in enumerate(sorted({model["scores"][i] for i in normal.values()}, reverse=True))}
        keys, ranks, made = [], [], []
        for p, i in normal.items():
            for cut in range(1, len(p)):
                a, b = symbols.get(p[:cut]), symbols.get(p[cut:])
                if a is not None and b is not None:
                    keys.append(a << 24 | b)
                    ranks.append(rank_of[model["scores"][i]])
                    made.append(i)
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.keys = np.append(np.array(keys, dtype=np.int64)[order], np.iinfo(np.int64).max)
        self.ranks = np.append(np.array(ranks, dtype=np.int64)[order], NONE)
        self.made = np.append(np.array(made, dtype=np.int64)[order], 0)
        #: a line feed that no longer piece holds ends a word as a space begins one
        mark = "\n" if not any("\n" in p for p in normal) else ""
        self.word = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+" if mark else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.cache: dict[str, bytes] = {}
        self.text_of = [b"" if k == "control" else b" \xe2\x81\x87 " if k == "unknown" else bytes([int(p[3:5], 16)]) if k == "byte" else p.replace(SPACE, " ").encode() for p, k in zip(pieces, kinds, strict=True)]

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where each pair stands in the table of merges; the last place if nowhere."""
        key = left << 24 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, at, len(self.keys) - 1)

    def _final(self, symbols: list[int], chars: dict[int, str]) -> bytes:
        out: list[int] = []
        for s in symbols:
            out.extend([s] if s < self.known else [self.byte_ids[b] for b in chars[s].encode()])
        return np.array(out, dtype="<u4").tobytes()

    def _by_heap(self, sym: list[int]) -> list[int]:
        nxt, prv = [*range(1, len(sym)), -1], [*range(-1, len(sym) - 1)]
        table = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.made.tolist(), strict=True), strict=True)) if not hasattr(self, "_table") else self._table
        self._table, live, heap = table, [True] * len(sym), []

        def push(i: int) -> None:
            if i >= 0 and (j := nxt[i]) >= 0 and (hit := table.get(sym[i] << 24 | sym[j])):
                heapq.heappush(heap, (hit[0], i, sym[i], sym[j], hit[1]))

        for i in range(len(sym)):
            push(i)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = nxt[i]
            if not live[i] or j < 0 or sym[i] != a or sym[j] != b:
                continue
            sym[i], live[j], nxt[i] = new, False, nxt[j]
            if nxt[j] >= 0:
                prv[nxt[j]] = i
            push(prv[i])
            push(i)
        return [s for s, ok in zip(sym, live, strict=True) if ok]

    def _keep(self, sym: np.ndarray, size: np.ndarray, words: list[str], chars: dict[int, str]) -> None:
        """Puts finished words in the cache; characters without a piece become their bytes."""
        ends = np.cumsum(size)
        most, raw = np.maximum.reduceat(sym, ends - size), sym.astype("<u4").tobytes()
        self.cache.update({w: raw[4 * a : 4 * b] for w, a, b in zip(words, (ends - size).tolist(), ends.tolist(), strict=True)})
        for i in np.flatnonzero(most >= self.known).tolist():
            self.cache[words[i]] = self._final(sym[ends[i] - size[i] : ends[i]].tolist(), chars)

    def _merge(self, words: list[str]) -> None:
        """Puts the ids of words that aren't in the cache there."""
        chars: dict[int, str] = {}
        own: dict[str, int] = {}

        def symbol(c: str) -> int:
            s = self.symbols.get(c)
            if s is None:
                s = own.setdefault(c, self.known + (1 << 21) + len(own))
            if s >= self.known:
                chars[s] = c
            return s

        def coded(text: str) -> np.ndarray:
            points, back = np.unique(np.frombuffer(text.encode("utf-32-le"), dtype="<u4"), return_inverse=True)
            return np.array([symbol(chr(x)) for x in points.tolist()], dtype=np.int64)[back]

        for w in words:
            if len(w) > LONG_WORD:
                self.cache[w] = self._final(self._by_heap(coded(w).tolist()), chars)
        short = [w for w in words if len(w) <= LONG_WORD]
        if not short:
            return
        sym, size, names = coded("".join(short)), np.array([*map(len, short)], dtype=np.int64), np.arange(len(short))
        start = np.concatenate(([0], np.cumsum(size)[:-1]))
        at = np.full(len(sym), len(self.keys) - 1)
        at[:-1] = self._pair(sym[:-1], sym[1:])
        at[start[1:] - 1] = len(self.keys) - 1
        while len(names):
            best = np.minimum.reduceat(self.ranks[at] << 20 | np.arange(len(at)) - np.repeat(start, size), start)
            done = best >> 20 >= NONE
            if done.any():
                stay = np.repeat(~done, size)
                self._keep(sym[~stay], size[done], [short[i] for i in names[done].tolist()], chars)
                sym, at, names, size, best = sym[stay], at[stay], names[~done], size[~done], best[~done]
                start = np.concatenate(([0], np.cumsum(size)[:-1]))[: len(size)]
                if not len(names):
                    break
            p = start + (best & 0xFFFFF)
            sym[p] = self.made[at[p]]
            last = p + 2 >= start + size  # the merged pair was the word's last
            at[p] = len(self.keys) - 1
            q = p[~last]
            at[q] = self._pair(sym[q], sym[q + 2])
            q = p[p > start]
            at[q - 1] = self._pair(sym[q - 1], sym[q])
            keep = np.ones(len(sym), dtype=bool)
            keep[p + 1] = False
            sym, at, size = sym[keep], at[keep], size - 1
            start = np.concatenate(([0], np.cumsum(size)[:-1]))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Each text's ids with begin and end, as little-endian unsigned 32-bit integers."""
        split = [self.word.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        for a in range(0, len(split), 512):
            new = set().union(*split[a : a + 512]) - self.cache.keys()
            if new:
                self._merge([*new])
        head, tail = (np.array([x], dtype="<u4").tobytes() for x in (self.bos, self.eos))
        get = self.cache.__getitem__
        return [b"".join([head, *map(get, words), tail]) for words in split]

    def decode_bytes(self, ids: bytes) -> bytes:
        """The text of ids in UTF-8; bytes that make no character become U+FFFD one by one."""
        raw = b"".join(map(self.text_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))
        raw = raw[1:] if raw[:1] == b" " else raw
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode("utf-8", "each_byte").encode()


_codecs: dict[int, Codec] = {}


def _codec(shared) -> Codec:
    """One codec per worker and broadcast model."""
    if shared not in _codecs:
        _codecs.clear()
        _codecs[shared] = Codec(shared.value)
    return _codecs[shared]


def encode(df: DataFrame, model_path: str, text: str = "text", ids: str = "ids", decoded: str | None = None, digests: bool = False) -> DataFrame:
    """df's rows with the ids of each whole text (null: of the empty text), begin and end included.

    ids becomes array<int>; with decoded, a column of that name holds the text decoded from the ids.
    With digests, the columns n_tokens, ids_sha256 and decoded_sha256 come in place of both.
    Columns of df that have the new names are replaced. Works on one batch at a time without a shuffle;
    the model (as large as its vocabulary) is broadcast.
    """
    importable(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(read_model(model_path))
    new = [("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")] if digests else [(ids, "array<int>"), *([(decoded, "string")] if decoded else [])]
    kept = [c for c in df.columns if c not in {n for n, _ in new}]
    source = "__text"
    while source in kept:
        source += "_"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(shared)
        for batch in batches:
            parts = [batch[a : a + 1024] for a in range(0, len(batch), 1024)]
            for part in parts:
                coded = codec.encode_batch(part[source].tolist())
                out = part.drop(columns=source)
                if digests:
                    out["n_tokens"] = [len(x) // 4 for x in coded]
                    out["ids_sha256"] = [hashlib.sha256(x).hexdigest() for x in coded]
                    out["decoded_sha256"] = [hashlib.sha256(codec.decode_bytes(x)).hexdigest() for x in coded]
                else:
                    out[ids] = [np.frombuffer(x, dtype="<i4") for x in coded]
                    if decoded:
                        out[decoded] = [codec.decode_bytes(x).decode() for x in coded]
                yield out

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in kept]
    return df.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(text), F.lit("")).alias(source)).mapInPandas(run, ", ".join([*fields, *(f"`{n}` {t}" for n, t in new)]))


def decode(df: DataFrame, model_path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """df's rows with the text of their ids (null ids: null text)."""
    importable(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(read_model(model_path))

    @F.pandas_udf("string")
    def texts(column: pd.Series) -> pd.Series:
        codec = _codec(shared)
        return column.map(lambda x: None if x is None else codec.decode_bytes(np.asarray(x, dtype="<u4").tobytes()).decode())

    return df.withColumn(text, texts(F.col(ids)))
