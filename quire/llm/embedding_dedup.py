"""Near copies of vectors through spherical-cap filters.

Filters are directions of a structured product code: the vector, turned by a random rotation, is cut
into blocks, each block has a random codebook of unit vectors, and a filter is one codeword per block. A vector
passes the filters whose inner product with it exceeds a threshold. List decoding finds all of them: codewords of a block are
sorted by inner product and a branch is cut as soon as the best that can follow misses the threshold. Vectors of one label that pass
a common filter are compared; a pair counts only at the first filter that both pass.

A filter's vectors are compared in blocks of bounded size, one task per pair of blocks, and
what leaves a task is at most one count per vector and one forest edge per vector, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import components, importable, stored

COSINE = 0.98
#: Vectors of one filter that are compared at once.
BLOCK = 512
#: A vector that passes fewer filters is decoded again at the lower threshold.
FEWEST = 4
#: Rows of one task's pairs of blocks, about.
TASK_ROWS = 20_000


@dataclass
class Code:
    """A product code for vectors of one length."""

    rotation: np.ndarray
    books: list[np.ndarray]
    threshold: float
    lower: float  # for vectors that pass fewer than FEWEST filters

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of every filter that each unit vector passes, filters of a row ascending."""
        turned, at, products = unit @ self.rotation, 0, []
        for book in self.books:
            products.append(turned[:, at : at + book.shape[1]] @ book.T)
            at += book.shape[1]
        every = np.arange(len(unit))
        row, filt = self._exceeding(products, every, self.threshold)
        few = np.flatnonzero(np.bincount(row, minlength=len(unit)) < FEWEST)
        more = self._exceeding(products, few, self.lower)
        lost = np.setdiff1d(every, np.concatenate((row, more[0])))
        nearest = np.zeros(len(lost), dtype=np.int64)
        for p in products:
            nearest = nearest * p.shape[1] + p[lost].argmax(axis=1)
        row, filt = np.unique(np.stack((np.concatenate((row, more[0], lost)), np.concatenate((filt, more[1], nearest)))), axis=1)
        return row, filt

    @staticmethod
    def _exceeding(products: list[np.ndarray], row: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Decodes the vectors at row, block by block; a branch ends where the best of the blocks to come can't reach the threshold."""
        best = np.stack([p.max(axis=1) for p in products], axis=1)
        rest = np.concatenate((np.cumsum(best[:, ::-1], axis=1)[:, ::-1][:, 1:], np.zeros((len(best), 1))), axis=1)
        filt, total = np.zeros(len(row), dtype=np.int64), np.zeros(len(row))
        for block, p in enumerate(products):
            grown = total[:, None] + p[row]
            i, j = np.nonzero(grown + rest[row, block][:, None] >= threshold)
            row, filt, total = row[i], filt[i] * p.shape[1] + j, grown[i, j]
        return row, filt


def code_for(size: int, blocks: int = 2, words: int = 128, threshold: float = 0.38, lower: float = 0.33, seed: int = 7) -> Code:
    """The product code of blocks codebooks of words directions for vectors of size components.

    The thresholds are for 64 components and shrink as the products of random unit vectors do.
    """
    draw, blocks, scale = np.random.default_rng(seed + size), min(blocks, size), (64 / size) ** 0.5
    rotation = np.linalg.qr(draw.standard_normal((size, size)))[0]
    books = []
    for part in np.array_split(np.arange(size), blocks):
        book = draw.standard_normal((words, len(part)))
        books.append(book / np.linalg.norm(book, axis=1, keepdims=True) / np.sqrt(blocks))
    return Code(rotation, books, threshold * scale, lower * scale)


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision; not finite where that can't be."""
    with np.errstate(all="ignore"):
        unit = v / np.abs(v).max(axis=1, keepdims=True, initial=0)
        return unit / np.linalg.norm(unit, axis=1, keepdims=True)


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Places of edges that join the same vertices as all edges do, n at most."""
    parent, kept = list(range(n)), []

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = top(x), top(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append(k)
    return np.array(kept, dtype=np.int64)


def near_links(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE, block: int = BLOCK, code=None) -> DataFrame:
    """One row per row of df: vec_id, n_links, component_id, kept.

    Rows of equal label link if the cosine of their vectors in double precision is at least cosine. Vectors that are
    null, zero, of another length or hold null or non-finite components link with nothing, nor do rows
    without label or vec_id. A vec_id that comes again is one vector with the rows' links together; it
    never links with itself. component_id is the smallest vec_id that links reach; kept: vec_id is that one.
    """
    importable(df.sparkSession)
    make, cos = code or code_for, float(cosine)
    kind = "<f4" if df.schema[vector].dataType.simpleString() == "array<float>" else "<f8"
    rows = df.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), F.col(label).cast("string").alias("label"))

    def filtered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes: dict[int, Code] = {}
        for batch in batches:
            for begin in range(0, len(batch), 512):
                part = batch[begin : begin + 512]
                sizes = part["v"].map(len)
                for size in sorted(set(sizes)):
                    own = part[sizes == size]
                    v = np.stack([np.asarray(x, dtype=np.float64) for x in own["v"]])
                    unit = _unit(v)
                    good = np.isfinite(v).all(axis=1) & np.isfinite(unit).all(axis=1)
                    v, unit, own = v[good].astype(kind), unit[good], own[good]
                    if not len(own):
                        continue
                    if size not in codes:
                        codes[size] = make(size)
                    row, filt = codes[size].decode(unit)
                    counts = np.bincount(row, minlength=len(own))
                    lists = np.split(filt, np.cumsum(counts)[:-1])
                    yield pd.DataFrame({"label": own["label"].to_numpy()[row], "size": size, "filter": filt, "vec_id": own["vec_id"].to_numpy()[row], "raw": [v[i].tobytes() for i in row.tolist()], "filters": [lists[i].astype("<i4").tobytes() for i in row.tolist()]})

    clean = rows.where("vec_id is not null and label is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null)")
    passed = stored(clean.mapInPandas(filtered, "label string, size int, filter bigint, vec_id bigint, raw binary, filters binary"))
    key = ["label", "size", "filter"]
    sizes = passed.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("parts", F.ceil(F.col("n") / block).cast("int"))
    placed = passed.join(sizes, key).withColumn("own", F.pmod(F.xxhash64("vec_id", "raw"), F.col("parts")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j")))
    dealt = placed.select(*key, "vec_id", "raw", "filters", "own", F.explode(pairs).alias("p")).select(*key, "p.i", "p.j", "own", "vec_id", "raw", "filters")

    total = sizes.agg(F.sum(F.col("n") * F.col("parts"))).first()[0] or 0
    tasks = F.pmod(F.xxhash64(*key, "i", "j"), F.lit(total // TASK_ROWS + 1))

    def compared(group: pd.DataFrame) -> pd.DataFrame:
        """The links of some pairs of blocks: (u, u, links of u here) and forest edges (u, v, 0)."""
        group = group.sort_values([*key, "i", "j"], ignore_index=True)
        ids, own, filt = (group[c].to_numpy() for c in ("vec_id", "own", "filter"))
        tags = group[[*key, "i", "j"]]
        begin = np.flatnonzero(np.concatenate(([True], (tags.to_numpy()[1:] != tags.to_numpy()[:-1]).any(axis=1))))
        raw, lengths = group["raw"].to_numpy(), group["size"].to_numpy()
        edges: list[tuple[int, int]] = []
        for first, last in zip(begin.tolist(), [*begin[1:].tolist(), len(group)], strict=True):
            i, j = int(group["i"].iat[first]), int(group["j"].iat[first])
            unit = _unit(np.frombuffer(b"".join(raw[first:last]), dtype=kind).reshape(-1, lengths[first]).astype(np.float64))
            left, right = np.flatnonzero(own[first:last] == i), np.flatnonzero(own[first:last] == j)
            a, b = np.nonzero(unit[left] @ unit[right].T >= cos)
            a, b = left[a] + first, right[b] + first
            apart = (ids[a] != ids[b]) & ((i != j) | (a < b))
            edges += zip(a[apart].tolist(), b[apart].tolist(), strict=True)
        lists = {x: frozenset(np.frombuffer(group["filters"].iat[x], dtype="<i4").tolist()) for x in {x for e in edges for x in e}}
        edges = [(x, y) for x, y in edges if min(lists[x] & lists[y]) == filt[x]]
        if not edges:
            return pd.DataFrame({"u": [], "v": [], "n": []}).astype("int64")
        names, back = np.unique(ids, return_inverse=True)
        a, b = back[np.array(edges).T]
        n = np.bincount(np.concatenate((a, b)), minlength=len(names))
        tree, linked = _forest(a, b, len(names)), np.flatnonzero(n)
        return pd.DataFrame({"u": np.concatenate((names[linked], names[a[tree]])), "v": np.concatenate((names[linked], names[b[tree]])), "n": np.concatenate((n[linked], np.zeros(len(tree), dtype=np.int64)))})

    found = stored(dealt.groupBy(tasks).applyInPandas(lambda group: compared(group), "u bigint, v bigint, n bigint"))
    counts = found.where("u = v").groupBy(F.col("u").alias("vec_id")).agg(F.sum("n").alias("n_links"))
    roots = components(found.where("u <> v").select("u", "v"))
    out = rows.select("vec_id").join(counts, "vec_id", "left").join(roots.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    root = F.coalesce("root", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), root.alias("component_id"), F.coalesce(F.col("vec_id") == root, F.lit(True)).alias("kept"))
