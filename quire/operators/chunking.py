"""Content-defined chunks of texts, their sharing and how they make up a version."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.workers import importable

# Fixed values, as chunk bounds must be the same everywhere: sizes in bytes, bits of the two masks, seed of the gear table.
SMALLEST, USUAL, LARGEST, SNAP = 512, 1024, 4096, 256
EARLY_BITS, LATE_BITS = 10, 8
SEED = 0x0123456789ABCDEF


def _gear() -> np.ndarray:
    """256 pseudo-random 64-bit values: splitmix64 of the seed with each byte."""
    with np.errstate(over="ignore"):
        x = (np.uint64(SEED) ^ np.arange(256, dtype=np.uint64)) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


GEAR = _gear()
EARLY, LATE = (np.uint64(sum(1 << 16 + 2 * j for j in range(bits))) for bits in (EARLY_BITS, LATE_BITS))
# a mask's highest bit is 34: a byte's part of the rolling hash has left it after 35 more
MEMORY = 35


def cuts(data: bytes) -> list[int]:
    """Where the chunks of data end.

    A chunk is at least SMALLEST bytes; from there a rolling hash that begins anew in each chunk ends it where the mask's bits are
    zero, the late mask's after USUAL bytes, LARGEST bytes at most; a line feed at most SNAP bytes on is taken along.
    """
    out, at, n = [], 0, len(data)
    raw = np.frombuffer(data, dtype=np.uint8)
    while n - at > SMALLEST:
        limit = min(n - at, LARGEST)
        part = GEAR[raw[at + SMALLEST : at + limit]]
        h = np.zeros(len(part), dtype=np.uint64)
        for k in range(min(MEMORY, len(part))):
            h[k:] += part[: len(part) - k] << np.uint64(k)
        usual = max(0, min(USUAL, limit) - SMALLEST)
        hit = np.flatnonzero(np.concatenate((h[:usual] & EARLY, h[usual:] & LATE)) == 0)
        end = SMALLEST + int(hit[0]) + 1 if len(hit) else limit
        if at + end < n or len(hit):
            if data[at + end - 1] != 10:
                feed = data.find(b"\n", at + end, min(n, at + end + SNAP))
                end = feed + 1 - at if feed >= 0 else end
        out.append(at + end)
        at += end
    if at < n:
        out.append(n)
    return out


def chunks(files: DataFrame) -> DataFrame:
    """One row per chunk: file_id, version, ord, hash, byte_from, nbytes, line_from (from 1), nlines, bytes."""
    importable(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file_id, version, content in zip(batch["file_id"], batch["version"], batch["content"], strict=True):
                data, begin, line = (content or "").encode(), 0, 1
                for k, end in enumerate(cuts(data)):
                    part = data[begin:end]
                    feeds = part.count(b"\n")
                    rows.append((file_id, version, k, hashlib.sha256(part).hexdigest(), begin, len(part), line, feeds, part))
                    begin, line = end, line + feeds
            yield pd.DataFrame(rows, columns=["file_id", "version", "ord", "hash", "byte_from", "nbytes", "line_from", "nlines", "bytes"])

    return files.select("file_id", "version", "content").mapInPandas(run, "file_id bigint, version bigint, ord int, hash string, byte_from bigint, nbytes bigint, line_from bigint, nlines bigint, bytes binary")


def sharing(found: DataFrame) -> DataFrame:
    """One row: chunks, distinct chunks, bytes, and bytes if each chunk is stored once."""
    once = found.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.first("nbytes").alias("nbytes"))
    return once.agg(F.sum("n").alias("chunks"), F.count(F.lit(1)).alias("distinct_chunks"), F.sum(F.col("n") * F.col("nbytes")).alias("bytes"), F.sum("nbytes").alias("stored_bytes"))


def roots(found: DataFrame) -> DataFrame:
    """(file_id, version, root, leaves): equal content has an equal root, whatever its history."""
    leaves = F.transform(F.array_sort(F.collect_list(F.struct("ord", "hash"))), lambda x: x["hash"])
    return found.groupBy("file_id", "version").agg(leaves.alias("l")).select("file_id", "version", F.sha2(F.array_join("l", ""), 256).alias("root"), F.size("l").alias("leaves"))


def materialize(found: DataFrame) -> DataFrame:
    """(file_id, version, content) put together from chunks."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ord", "bytes"))), lambda x: F.decode(x["bytes"], "ISO-8859-1"))
    return found.groupBy("file_id", "version").agg(F.array_join(parts, "").alias("c")).select("file_id", "version", F.decode(F.encode("c", "ISO-8859-1"), "UTF-8").alias("content"))


def unreachable(gone: DataFrame, live: DataFrame) -> DataFrame:
    """(hash) of chunks that only gone versions hold."""
    return gone.select("hash").distinct().join(live.select("hash"), "hash", "left_anti")
