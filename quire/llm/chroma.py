"""Chroma fingerprints of recordings and their alignment.

A recording (WAV, or raw unsigned 8-bit samples) is cut into overlapping frames; each frame's spectrum is folded to twelve
pitch classes. Sixteen rectangular filters over this image, each a difference of areas taken from its integral image, give two bits
in Gray code; 32 bits are one packed integer per step. Equal integers of two recordings vote for the offset between
them; the offset with most votes aligns them, and the share of differing bits over the overlap tells how well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import importable, stored

RATE = 11025
FRAME, HOP = 512, 256
LOWEST, HIGHEST = 28.0, 3520.0
#: Steps that the widest filter spans.
SPAN = 8
#: Whole units that an energy of 1 has.
UNIT = 1 << 16
GROUP_BYTES = 1 << 18
#: (shape, first pitch class, pitch classes, steps): shapes are all against zero, lower against upper, earlier against later,
#: the two diagonals against each other, and the middle third against the rest in pitch and in time.
FILTERS = tuple((k % 6, (5 * k) % 12 % (12 - (2 + k % 5)), 2 + k % 5, 3 + (3 * k) % (SPAN - 2)) for k in range(16))
#: Where a filter's value, in units of its spread, passes to the next two bits.
STEPS = (-0.6, 0.0, 0.6)
GRAY = np.array([0, 1, 3, 2], dtype=np.uint32)
#: Recordings are said to match if at most this share of bits differs over at least so many steps.
MOST_ERROR, LEAST_STEPS = 0.25, 4
#: Steps at which two recordings must hold the same integers where not every place votes: three of any four for noisy recordings, and six in
#: a row because three are found in ever more unlike recordings as a table grows.
PATTERNS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 2, 3, 4, 5))
#: Places of all recordings for each block is the square root of this times them all; pairs of places that are joined at once.
BLOCK_PLACES, PLACE_PAIRS = 1 << 14, 1 << 20


def samples(media: bytes | pa.Buffer | None) -> tuple[np.ndarray, int]:
    """(samples from -1 to 1, rate) of a WAV file with 8 or 16 bits, its channels averaged, or of raw unsigned bytes."""
    data = memoryview(media or b"")
    if data[:4] == b"RIFF" and data[8:12] == b"WAVE":
        at, rate, channels, bits, body = 12, RATE, 1, 8, b""
        while at + 8 <= len(data):
            kind, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
            chunk = data[at + 8 : at + 8 + size]
            if kind == b"fmt " and len(chunk) >= 16:
                channels, rate, bits = int.from_bytes(chunk[2:4], "little") or 1, int.from_bytes(chunk[4:8], "little") or RATE, int.from_bytes(chunk[14:16], "little")
            elif kind == b"data":
                body = chunk
            at += 8 + size + size % 2
        x = np.frombuffer(body[: len(body) // 2 * 2], dtype="<i2") / 32768 if bits == 16 else (np.frombuffer(body, dtype=np.uint8) - 128.0) / 128
        return x[: len(x) // channels * channels].reshape(-1, channels).mean(axis=1), rate
    return (np.frombuffer(data, dtype=np.uint8) - 128.0) / 128, RATE


_folds: dict[int, np.ndarray] = {}


def _fold(rate: int) -> np.ndarray:
    """(spectrum bins, 12): which pitch class each bin belongs to."""
    if rate not in _folds:
        hertz = np.fft.rfftfreq(FRAME, 1 / rate)
        used = (hertz >= LOWEST) & (hertz <= HIGHEST)
        classes = np.round(12 * np.log2(np.where(used, hertz, LOWEST) / 440.0)).astype(int) % 12
        _folds[rate] = (np.eye(12)[classes] * used[:, None]).astype(np.float64)
    return _folds[rate]


def chroma(recordings: list[tuple[np.ndarray, int]]) -> list[np.ndarray]:
    """Of each recording (samples, rate): (frames, 12) shares of energy by pitch class, in whole units of 1 / UNIT.

    A recording shorter than a frame is filled up with silence; an empty one has no frame. Frames overlap in
    memory too: only 2048 at a time are copied, however long a recording is.
    """
    padded = [np.pad(x, (0, max(0, FRAME - len(x)))) if len(x) else np.zeros(0) for x, _ in recordings]
    sizes, begins = [(len(x) - FRAME) // HOP + 1 if len(x) else 0 for x in padded], np.cumsum([0, *map(len, padded)])
    starts = np.concatenate([b + HOP * np.arange(n) for b, n in zip(begins, sizes, strict=False)])
    rates, window, energy = np.repeat([r for _, r in recordings], sizes), np.hanning(FRAME), np.zeros((len(starts), 12))
    if len(starts):
        frames = np.lib.stride_tricks.sliding_window_view(np.concatenate(padded), FRAME)
        for rate in set(rates.tolist()):
            own = np.flatnonzero(rates == rate)
            for a in range(0, len(own), 2048):
                part = np.fft.rfft(frames[starts[own[a : a + 2048]]] * window, axis=1)
                energy[own[a : a + 2048]] = (part.real**2 + part.imag**2) @ _fold(rate)
    total = energy.sum(axis=1, keepdims=True)
    shares = np.divide(energy, total, out=np.zeros_like(energy), where=total > 1e-9)
    return np.split(np.rint(shares * UNIT).astype(np.int64), np.cumsum(sizes)[:-1])


def pack(images: list[np.ndarray]) -> list[np.ndarray]:
    """The packed integers (unsigned 32 bits) of chroma images; a short image is stretched by its last frame.

    The images lie one after another in one integral image; sums of whole numbers don't depend on what else is in it.
    """
    sizes = np.array([max(SPAN, len(x)) if len(x) else 0 for x in images])
    image = np.concatenate([np.pad(x, ((0, max(0, SPAN - len(x))), (0, 0)), mode="edge") if len(x) else x for x in images])
    if not len(image):
        return [np.zeros(0, dtype=np.uint32) for _ in images]
    n = len(image) - SPAN + 1
    total = np.pad(image.cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return total[t1 : t1 + n, p1] - total[t0 : t0 + n, p1] - total[t1 : t1 + n, p0] + total[t0 : t0 + n, p0]

    packed = np.zeros(n, dtype=np.uint32)
    for shape, low, high, width in FILTERS:
        top, tm, pm = low + high, width // 2, low + high // 2
        if shape == 0:
            a, b = area(0, width, low, top), None
        elif shape == 1:
            a, b = area(0, width, low, pm), area(0, width, pm, top)
        elif shape == 2:
            a, b = area(0, tm, low, top), area(tm, width, low, top)
        elif shape == 3:
            a, b = area(0, tm, low, pm) + area(tm, width, pm, top), area(0, tm, pm, top) + area(tm, width, low, pm)
        else:
            lo, hi = (low + high // 3, low + high - high // 3) if shape == 4 else (low, top)
            t0, t1 = (0, width) if shape == 4 else (width // 3, width - width // 3)
            a = area(t0, t1, lo, hi)
            b = area(0, width, low, top) - a
        value = np.log1p(a * (12 / UNIT)) - (np.log1p(high * width) if b is None else np.log1p(b * (12 / UNIT)))
        packed = packed << np.uint32(2) | GRAY[np.searchsorted(STEPS, value)]
    ends = np.cumsum(sizes)
    return [packed[e - k : e - SPAN + 1] if k else packed[:0] for e, k in zip(ends.tolist(), sizes.tolist(), strict=True)]


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[list, list]]:
    """(doc_ids, media) in groups of about GROUP_BYTES; media are views of the batch."""
    keys, media, size = [], [], 0
    for key, value in zip(batch.column("doc_id").to_pylist(), batch.column("media"), strict=True):
        raw = value.as_buffer() if value.is_valid else None
        if keys and size + (raw.size if raw else 0) > GROUP_BYTES:
            yield keys, media
            keys, media, size = [], [], 0
        keys.append(key)
        media.append(raw)
        size += raw.size if raw else 0
    if keys:
        yield keys, media


def fingerprints(df: DataFrame, media: str = "media", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_frames, codes array<int>, fingerprint_sha256) of each row's whole recording.

    media is binary, or text whose UTF-8 bytes are samples; null or empty recordings have no frame and no code.
    """
    importable(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, media in _groups(batch):
                images = chroma([samples(raw) for raw in media])
                codes = pack(images)
                sha = [hashlib.sha256(c.astype("<u4").tobytes()).hexdigest() for c in codes]
                ends = np.cumsum([0, *map(len, codes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(codes).view(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([len(x) for x in images], pa.int64()), lists, pa.array(sha)], ["doc_id", "n_frames", "codes", "fingerprint_sha256"])

    return df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(media).cast("binary").alias("media")).mapInArrow(run, "doc_id bigint, n_frames bigint, codes array<int>, fingerprint_sha256 string")


def _tagged(df: DataFrame, key: str) -> DataFrame:
    """df with an added key, which gives a join shuffles of its own that can be split where key is hot."""
    return df.withColumn("tag", F.hash(key))


def _vote(votes, other, offset):
    """Most votes come first, then the smallest recording, then the least offset."""
    return F.struct((-votes).cast("bigint").alias("v"), other.alias("aligned_id"), offset.cast("int").alias("offset"))


def _both(u: str, v: str, offset: str, *more: str):
    """Rows of (id, other, offset) for both sides of an alignment."""
    side = lambda a, b, k: F.struct(F.col(a).alias("id"), F.col(b).alias("other"), k.alias("offset"), *more)
    return F.explode(F.array(side(u, v, F.col(offset)), side(v, u, -F.col(offset))))


def _equal_steps(offset, mine, theirs):
    """Steps at which two recordings hold the same integer, once aligned."""
    begin = F.greatest(offset, F.lit(0))
    overlap = F.greatest(F.least(F.size(mine), F.size(theirs) + offset) - begin, F.lit(0))
    same = F.zip_with(F.slice(mine, begin + 1, overlap), F.slice(theirs, begin - offset + 1, overlap), lambda a, b: (a == b).cast("int"))
    return F.aggregate(same, F.lit(0), lambda s, x: s + x)


def _across(classes: DataFrame, patterns: tuple[tuple[int, ...], ...]) -> DataFrame:
    """(id, b: best vote) by patterns of integers: the holders of equal ones meet the smallest and the largest holder.

    That makes four candidates a place and pattern at most, however many hold it. Each candidate's most frequent offset is
    then counted on whole recordings, so an integer counts for every candidate that holds it there.
    """
    keys = []
    for k, steps in enumerate(patterns):
        held = ", ".join(f"codes[i + {step}]" for step in steps)
        places = F.expr(f"transform(sequence(0, size(codes) - {max(steps) + 1}), i -> struct(i AS at, xxhash64({k}, {held}) AS key))")
        keys.append(F.when(F.size("codes") > max(steps), places).otherwise(F.array().cast("array<struct<at: int, key: bigint>>")))
    places = classes.select("id", F.explode(F.concat(*keys)).alias("p")).select("id", "p.at", "p.key")
    ends = places.groupBy("key").agg(F.min(F.struct("id", "at")).alias("low"), F.max(F.struct("id", "at")).alias("high")).where("low.id < high.id")
    hub = F.explode(F.array(F.struct(F.lit(0).alias("end"), "low.id", "low.at"), F.struct(F.lit(1).alias("end"), "high.id", "high.at")))
    votes = _tagged(places, "key").join(_tagged(ends, "key"), ["key", "tag"]).select(F.col("id").alias("u"), "at", hub.alias("hub")).where("u <> hub.id")
    counted = votes.groupBy("u", F.col("hub.id").alias("v"), "hub.end", (F.col("at") - F.col("hub.at")).alias("k")).agg(F.count(F.lit(1)).alias("votes"))
    most = stored(counted.select(_both("u", "v", "k", "votes").alias("s")).groupBy("s.id", "s.other").agg(F.min(F.struct((-F.col("s.votes")).alias("v"), F.abs("s.offset").alias("shift"), "s.offset")).alias("m")).select("id", "other", "m.offset"))
    mine = _tagged(classes.select("id", F.col("codes").alias("mine")), "id")
    theirs = _tagged(classes.select(F.col("id").alias("other"), F.col("codes").alias("theirs")), "other")
    seen = _tagged(_tagged(most, "id").join(mine, ["id", "tag"]).drop("tag"), "other").join(theirs, ["other", "tag"])
    return seen.groupBy("id").agg(F.min(_vote(_equal_steps(F.col("offset"), F.col("mine"), F.col("theirs")), F.col("other"), F.col("offset"))).alias("b"))


def _whole_histogram(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, votes) of two recordings of any length: their integers' places, or by Fourier transform where an integer has too many."""
    u, inverse, mine = np.unique(a, return_inverse=True, return_counts=True)
    order, sizes = np.argsort(inverse, kind="stable"), np.concatenate(([0], np.cumsum(mine)))
    back = np.argsort(b, kind="stable")
    low, high = np.searchsorted(b[back], u, "left"), np.searchsorted(b[back], u, "right")
    size, votes = len(a) + len(b) - 1, np.zeros(len(a) + len(b) - 1, dtype=np.int64)
    spectrum = 1 << (size - 1).bit_length()
    product = 0.0
    for c in np.flatnonzero(high > low).tolist():
        i, j = order[sizes[c] : sizes[c + 1]], back[low[c] : high[c]]
        if len(i) * len(j) <= size:
            np.add.at(votes, (i[:, None] - j[None, :] + len(b) - 1).ravel(), 1)
        else:
            x, y = np.zeros(spectrum), np.zeros(spectrum)
            x[i], y[len(b) - 1 - j] = 1, 1
            product = product + np.fft.rfft(x) * np.fft.rfft(y)
    if not np.isscalar(product):
        votes += np.rint(np.fft.irfft(product, spectrum)[:size]).astype(np.int64)
    at = np.flatnonzero(votes)
    return at - (len(b) - 1), votes[at]


def _histograms(codes: list[np.ndarray], left: np.ndarray, right: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """(u, v, offset, votes) of all pairs of a left and a right recording that share an integer; if same, of those with u < v.

    Votes of one pair are counted at once: places of both sides are joined by integer, PLACE_PAIRS at a time.
    """

    def laid(members: np.ndarray) -> tuple[np.ndarray, ...]:
        size = np.array([len(codes[m]) for m in members.tolist()], dtype=np.int64)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return np.concatenate([codes[m] for m in members.tolist()]), np.repeat(members, size), at

    code, who, at = laid(right)
    order = np.argsort(code, kind="stable")
    waiting = [(laid(left), (code[order], who[order], at[order]))]
    while waiting:
        (a, u, i), (b, v, j) = waiting.pop()
        low = np.searchsorted(b, a, "left")
        met = np.searchsorted(b, a, "right") - low
        total = int(met.sum())
        if not total or same and u[0] >= v.max():
            continue
        wide = int(i.max() + j.max()) + 1
        if total > PLACE_PAIRS or int(u[-1] - u[0] + 1) * len(codes) * wide >> 62:
            if u[0] != u[-1]:
                # a cut between two recordings near the middle
                mid = np.searchsorted(u, u[int(np.searchsorted(np.cumsum(met), total // 2))], "left") or np.searchsorted(u, u[0], "right")
                waiting += [((a[x], u[x], i[x]), (b, v, j)) for x in (slice(mid, None), slice(None, mid))]
            elif v.min() != v.max():
                first = v <= (v.min() + v.max()) // 2
                waiting += [((a, u, i), (b[x], v[x], j[x])) for x in (~first, first)]
            elif not same or u[0] < v[0]:
                offset, votes = _whole_histogram(codes[u[0]], codes[v[0]])
                yield np.full(len(offset), u[0]), np.full(len(offset), v[0]), offset, votes
            continue
        mine = np.repeat(np.arange(len(a)), met)
        theirs = np.arange(total) - np.repeat(np.cumsum(met) - met - low, met)
        if same:
            kept = u[mine] < v[theirs]
            mine, theirs = mine[kept], theirs[kept]
        least = int(u[0])
        key, votes = np.unique(((u[mine] - least) * len(codes) + v[theirs]) * wide + i[mine] - j[theirs] + int(j.max()), return_counts=True)
        pair, offset = np.divmod(key, wide)
        yield pair // len(codes) + least, pair % len(codes), offset - int(j.max()), votes


def best_votes(ids: np.ndarray, codes: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """(id, other, offset, votes) of the best alignment of each of the left recordings with any of the right ones, and the reverse.

    left and right are places in ids, which ascend. They are the same, or have none in common. Ties go to the smallest id, then the least offset.
    """
    same = len(left) == len(right) and bool((left == right).all())
    most, tie = np.zeros(len(ids), dtype=np.int64), np.full(len(ids), np.iinfo(np.int64).max)
    wide = 2 * max(map(len, codes)) + 1

    def take(who: np.ndarray, other: np.ndarray, offset: np.ndarray, votes: np.ndarray) -> None:
        now = most.copy()
        np.maximum.at(now, who, votes)
        tie[now > most] = np.iinfo(np.int64).max
        top = votes == now[who]
        np.minimum.at(tie, who[top], other[top] * wide + offset[top] + wide // 2)
        most[:] = now

    for u, v, offset, votes in _histograms(codes, left, right, same):
        take(u, v, offset, votes)
        take(v, u, -offset, votes)
    found = np.flatnonzero(most)
    other, offset = np.divmod(tie[found], wide)
    return ids[found], ids[other], offset - wide // 2, most[found]


def _across_all(classes: DataFrame) -> DataFrame:
    """(id, b: best vote) by all places of all integers of all other recordings.

    Recordings are dealt into blocks, about one for each BLOCK_PLACES of the square of all places; each pair of blocks is a group whose votes are
    counted where it lies, so only each recording's best of each group leaves it.
    """
    places = classes.agg(F.sum(F.size("codes").cast("bigint"))).first()[0] or 0
    parts = int(np.ceil(np.sqrt(places / BLOCK_PLACES))) or 1
    own = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    sides = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j")))
    dealt = classes.select("id", "codes", own.alias("own")).withColumn("p", F.explode(sides)).select("id", "codes", "own", "p.i", "p.j")

    def counted(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", ignore_index=True)
        side = group["own"].to_numpy()
        left, right = np.flatnonzero(side == group["i"][0]), np.flatnonzero(side == group["j"][0])
        found = best_votes(group["id"].to_numpy(), [*group["codes"]], left, right) if len(left) and len(right) else [[]] * 4
        return pd.DataFrame(dict(zip(("id", "other", "offset", "votes"), found, strict=True)))

    best = dealt.groupBy("i", "j").applyInPandas(lambda group: counted(group), "id bigint, other bigint, offset int, votes bigint")
    return best.groupBy("id").agg(F.min(_vote(F.col("votes"), F.col("other"), F.col("offset"))).alias("b"))


def align(prints: DataFrame, patterns: tuple[tuple[int, ...], ...] = PATTERNS, every: bool = True) -> DataFrame:
    """prints with aligned_id, offset, votes, overlap, bit_error and matched.

    Each place of an integer votes for every place of it in every other recording. aligned_id is the other recording with most votes for one
    offset (ties: the smallest doc_id, then offset): step i of the row lies on step i - offset of it. bit_error is the share of differing
    bits over the overlap. Without a shared integer they are null and matched is false. Rows without doc_id take no part.
    Repeats of a doc_id are one recording, told by its least codes.

    Recordings of equal codes are one class, told by its smallest doc_id; within it all votes are for offset 0. The work is the
    square of an integer's holders. Without every, only recordings that hold the same integers at the steps of one of the
    patterns are compared, and of those each with a pattern's smallest and largest holder: linear, but partners are lost.
    """
    known = prints.where("doc_id is not null")
    members = stored(known.groupBy("doc_id").agg(F.min(F.struct("codes", "fingerprint_sha256")).alias("m")).where("size(m.codes) > 0").select("doc_id", "m.codes", F.col("m.fingerprint_sha256").alias("sha")))
    classes = stored(members.groupBy("sha").agg(F.min("doc_id").alias("id"), F.min("codes").alias("codes")))
    seconds = _tagged(members.select("sha", "doc_id"), "sha").join(_tagged(classes.select("sha", "id"), "sha"), ["sha", "tag"]).where("doc_id <> id").groupBy("sha").agg(F.min("doc_id").alias("next"))
    across = _across_all(classes) if every else _across(classes, patterns)
    told = classes.select("sha", "id", F.size("codes").alias("n")).join(across, "id", "left").join(seconds, "sha", "left")
    own = F.when(F.col("next").isNotNull(), _vote(F.col("n"), F.when(F.col("doc_id") == F.col("id"), F.col("next")).otherwise(F.col("id")), F.lit(0)))
    chosen = _tagged(members.select("sha", "doc_id"), "sha").join(_tagged(told, "sha"), ["sha", "tag"]).select("doc_id", F.least("b", own).alias("b")).where("b is not null")
    best = chosen.select("doc_id", "b.aligned_id", "b.offset", (-F.col("b.v")).alias("votes"))
    other = known.groupBy(F.col("doc_id").alias("aligned_id")).agg(F.min("codes").alias("theirs"))
    pairs = prints.join(best, "doc_id", "left").withColumn("tag", F.hash("aligned_id")).join(other.withColumn("tag", F.hash("aligned_id")), ["aligned_id", "tag"], "left")
    begin = F.greatest("offset", F.lit(0))
    overlap = F.greatest(F.least(F.size("codes"), F.size("theirs") + F.col("offset")) - begin, F.lit(0))
    pairs = pairs.withColumn("overlap", F.when(F.col("theirs").isNotNull(), overlap))
    differing = F.zip_with(F.slice("codes", begin + 1, F.col("overlap")), F.slice("theirs", begin - F.col("offset") + 1, F.col("overlap")), lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    error = F.when(F.col("overlap") > 0, F.aggregate(differing, F.lit(0), lambda s, x: s + x) / (32.0 * F.col("overlap")))
    out = pairs.withColumn("bit_error", error)
    return out.select("doc_id", "n_frames", "fingerprint_sha256", "aligned_id", "offset", "votes", F.col("overlap").alias("overlap"), "bit_error", F.coalesce((F.col("bit_error") <= MOST_ERROR) & (F.col("overlap") >= LEAST_STEPS), F.lit(False)).alias("matched"))


def fingerprint_and_align(df: DataFrame, media: str = "media", doc_id: str = "doc_id") -> DataFrame:
    return align(stored(fingerprints(df, media, doc_id)))
