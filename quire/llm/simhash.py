"""SimHash near copies, found through Golay-code keys.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, each read as a word of the
perfect (23, 12) Golay code. Of three or fewer differing bits, some two segments hold at most two
between them (pigeonhole). Every word lies within three bits of one codeword, so two words that differ in
one bit share the codeword nearest to either, and two words that differ in two bits share the one nearest to the
word between them; both are among the codewords within four bits, which are those nearest to the word and to
its 23 neighbours. A fingerprint's keys therefore are, for each pair of segments, (nearby, nearest) and
(nearest, nearby): about 29 of 24 bits. Fingerprints that share a key are joined and verified on all
64 bits; no link is lost.

Texts whose shingle sets are similar (the pipeline's near copies) are found the same way, by fingerprints of their distinct shingles, and
verified on the sets. As similar sets may have fingerprints further apart, what these links leave in different components is then
found through keys that are the rarest shingles of each set.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import components, importable, release, stored

SEED = 42
MAX_BITS = 3
#: Bit positions where a segment starts, and its length.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the (23, 12) Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101


def shingle_hashes(text: str | None, shingle: int = 3) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles of a whole text, repeats included; none for null or without words.

    A-Z are lower-cased; ASCII white space parts words; a text of fewer words is one shingle.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    n = max(1, len(words) - shingle + 1)
    line = b" ".join(words)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    start = np.cumsum(size + 1) - size - 1
    stop = (start + size)[shingle - 1 :] if len(words) >= shingle else start[:1] + len(line)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(start[:n].tolist(), stop.tolist(), strict=True)), dtype="<u8", count=n)


def margins(hashes: np.ndarray) -> np.ndarray:
    """Of each of 64 bits, how many more hashes have it than not."""
    ones = np.zeros(64, dtype=np.int64)
    for a in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[a : a + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return 2 * ones - len(hashes)


def fingerprint_of(hashes: np.ndarray) -> int:
    """The unsigned 64-bit fingerprint of some shingles: a bit is 1 if over half their hashes have it (none: 0)."""
    return int.from_bytes(np.packbits(margins(hashes) > 0, bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The fingerprint of a whole text's shingles, repeats included (null or without words: 0)."""
    return fingerprint_of(shingle_hashes(text, shingle))


def _remainders() -> tuple[np.ndarray, np.ndarray]:
    """Of the 12 upper bits: their remainder by the generator; of a remainder: the lightest error with it."""

    def rest(x: int) -> int:
        for k in range(22, 10, -1):
            if x >> k & 1:
                x ^= GOLAY << k - 11
        return x

    upper, leader = np.array([rest(x << 11) for x in range(1 << 12)], dtype=np.int64), np.zeros(1 << 11, dtype=np.int64)
    for weight in (3, 2, 1):
        for bits in combinations(range(23), weight):
            error = sum(1 << b for b in bits)
            leader[rest(error)] = error
    leader[0] = 0
    return upper, leader


_tables: list = []


def nearest(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each 23-bit word."""
    if not _tables:
        _tables.extend(_remainders())
    upper, leader = _tables
    return (words ^ leader[upper[words >> 11] ^ words & 0x7FF]) >> 11


def golay_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in prints, key) of every key of unsigned 64-bit fingerprints; no key twice for one."""
    near = []
    flips = np.concatenate(([0], 1 << np.arange(23)))
    for start, size in SEGMENTS:
        word = (prints >> np.uint64(start) & np.uint64((1 << size) - 1)).astype(np.int64)
        near.append(nearest(word[:, None] ^ flips[None, :]))
    keys = []
    for k, (i, j) in enumerate(combinations(range(3), 2)):
        keys.append(k << 24 | near[i] << 12 | near[j][:, :1])
        keys.append(k << 24 | near[i][:, :1] << 12 | near[j])
    every = np.sort(np.concatenate(keys, axis=1), axis=1)
    new = np.ones(every.shape, dtype=bool)
    new[:, 1:] = every[:, 1:] != every[:, :-1]
    return np.nonzero(new)[0], every[new]


def with_fingerprint(df: DataFrame, text: str = "text", name: str = "fingerprint", shingle: int = 3, drop_text: bool = False) -> DataFrame:
    """df with the fingerprint of each whole text as a signed bigint."""
    importable(df.sparkSession)

    @F.pandas_udf("bigint")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    out = df.withColumn(name, prints(F.col(text)))
    return out.drop(text) if drop_text else out


def links(prints: DataFrame, name: str = "fingerprint", bits: int = MAX_BITS) -> DataFrame:
    """(u, v), u < v: the distinct fingerprints of a bigint column that differ in bits or fewer (at most 3) bits.

    Null fingerprints link with nothing. Near copies of one text share keys, but only linked pairs leave the join.
    """
    if not 0 <= bits <= MAX_BITS:
        raise ValueError("the keys find up to 3 differing bits")
    importable(prints.sparkSession)

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), 4096):
                fp = batch["fp"].to_numpy(dtype=np.int64)[a : a + 4096]
                row, key = golay_keys(fp.view(np.uint64))
                yield pd.DataFrame({"key": key.astype(np.int32), "fp": fp[row]})

    keys = prints.select(F.col(name).alias("fp")).where("fp is not null").distinct().mapInPandas(keyed, "key int, fp bigint")
    a, b = keys.select("key", F.col("fp").alias("u")), keys.select("key", F.col("fp").alias("v"))
    return a.join(b.hint("merge"), (a.key == b.key) & (F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= bits)).select("u", "v").distinct()


def unsigned_hex(column: Column) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def components_of(df: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3) -> DataFrame:
    """One row per row of df: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that links reach, the row's own included; rows with equal fingerprints are linked.
    Rows without doc_id take part and get their component's smallest other doc_id (null if there is none).
    """
    prints = stored(with_fingerprint(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), drop_text=True), "prints")
    classes = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    roots = components(links(prints))
    grouped = classes.join(roots, classes.fingerprint == roots.node, "left").select("fingerprint", F.coalesce("root", "fingerprint").alias("root"), "least")
    smallest = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = grouped.join(smallest, "root").select("fingerprint", "component_id")
    return prints.join(by_print, "fingerprint").select("doc_id", unsigned_hex(F.col("fingerprint")).alias("fingerprint"), "component_id")


#: Rows of the sample that tells frequent shingles, frequent shingles at most, texts of one key that are compared at once,
#: and rows of a task that compares, about. The sample and its limit only order shingles: no order loses a pair.
SAMPLE_ROWS, FREQUENT, BLOCK, TASK_ROWS = 10_000, 200_000, 512, 10_000


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct shingles' hashes, ascending."""
    return np.unique(shingle_hashes(text, shingle))


def alike(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    """Whether two sets of shingles have a Jaccard similarity of least or more."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= least * (len(x) + len(y) - both) - 1e-9


def parities(hashes: np.ndarray) -> bytes:
    """A bit for each remainder of the hashes by a power of two, n or more: 1 if an odd number has it.

    Two sets' bits differ where their symmetric difference has an odd number, so not more often than it has members.
    """
    bits = 1 << max(6, (len(hashes) - 1).bit_length())
    count = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((count & 1).astype(bool), bitorder="little").tobytes()


def _folded(sketches: list[bytes], size: int) -> np.ndarray:
    """Rows of 64-bit words: the parities for a remainder of size bytes, of those for size or twice as many."""
    whole = [np.frombuffer(s, "<u8") for s in sketches]
    return np.stack([w if len(s) == size else w[: size // 8] ^ w[size // 8 :] for w, s in zip(whole, sketches, strict=True)])


def distance(a: bytes, b: bytes) -> int:
    """How many members two sets differ by, at least, told by their parities; 0 if their sizes are too far apart to tell."""
    size = min(len(a), len(b))
    if max(len(a), len(b)) > 2 * size:
        return 0
    x, y = _folded([a, b], size)
    return int(np.bitwise_count(x ^ y).sum())


def may_be_alike(sketches: list[bytes], n: np.ndarray, root: np.ndarray, left: np.ndarray, right: np.ndarray, least: float) -> np.ndarray:
    """Which of some sets may be similar to one of another root on the other side, by their parities; none that is gets lost.

    As least is over a half, sizes of similar sets differ by a factor below two and their parities' lengths by two at most.
    """
    found = np.zeros(len(n), dtype=bool)
    share = (1 - least) / (1 + least)
    length = np.array([*map(len, sketches)])
    for size in np.unique(length).tolist():
        near = np.flatnonzero((length == size) | (length == 2 * size))
        place = np.full(len(n), -1)
        place[near] = np.arange(len(near))
        words = _folded([sketches[i] for i in near.tolist()], size)
        for ours, theirs in ((left, right), (right, left)):
            ours, theirs = ours[length[ours] == size], theirs[place[theirs] >= 0]
            facing = words[place[theirs]]
            for a in ours.tolist():
                open_ = np.flatnonzero((root[theirs] != root[a]) & (np.minimum(n[theirs], n[a]) >= least * np.maximum(n[theirs], n[a]) - 1e-6))
                apart = np.bitwise_count(facing[open_] ^ words[place[a]]).sum(axis=1, dtype=np.int64)
                hit = theirs[open_[apart <= share * (n[theirs[open_]] + n[a]) + 1e-6]]
                if len(hit):
                    found[hit], found[a] = True, True
    return found


def prefix(hashes: np.ndarray, least: float, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set, rarest first, of which sets that are similar by least share one.

    Of n shingles, a similar set holds least * n or more, so it can't miss all of the first n - ceil(least * n) + 1.
    """
    rank = np.zeros(len(hashes), dtype=np.int64)
    if len(frequent) and len(hashes):
        at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        rank = np.where(frequent[at] == hashes, counts[at], 0)
    n = len(hashes)
    return hashes[np.lexsort((hashes, rank))][: n - int(np.ceil(least * n - 1e-9)) + 1]


def _frequent(rows: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes ascending, counts) of the shingles that several texts of a sample hold."""
    share = min(1 << 30, SAMPLE_ROWS * (1 << 30) // max(1, rows.count()))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(t, shingle) for t in batch["text"]]
            h, n = np.unique(np.concatenate(sets) if sets else np.zeros(0, dtype="<u8"), return_counts=True)
            yield pd.DataFrame({"h": h.view("<i8"), "n": n})

    sample = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < share)
    found = sample.mapInPandas(counted, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "h").limit(FREQUENT).collect()
    h, n = (np.array([r[k] for r in found], dtype=np.int64) for k in ("h", "n"))
    order = np.argsort(h.view(np.uint64))
    return h.view(np.uint64)[order], n[order]


def _in_blocks(rows: DataFrame) -> tuple:
    """Rows (key, id and others) with their block own of each key and the pairs of blocks (i, j) they go to, grouped to compare them; and a table to release then.

    Copies share many keys; of keys with the same members one is compared, whatever the places of its shingle.
    """
    mixed = F.sum(F.xxhash64("id").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("id", F.lit(1)))
    alike_keys = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m"), mixed[0].alias("s"), mixed[1].alias("x")).where("m > 1").groupBy("m", "s", "x").agg(F.min("key").alias("key"))
    parts = stored(alike_keys.select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("parts"), "m"), "parts")
    work = parts.agg(F.sum(F.col("parts") * F.col("m"))).first()[0] or 0
    tagged = [x.withColumn("tag", F.hash("key")) for x in (rows, parts.drop("m"))]
    held = tagged[0].join(tagged[1], ["key", "tag"]).drop("tag").withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    sides = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j")))
    dealt = held.withColumn("p", F.explode(sides)).select(*rows.columns, "own", "p.i", "p.j")
    return dealt.groupBy(F.pmod(F.xxhash64("key", "i", "j"), F.lit(work // TASK_ROWS + 1))), parts


def print_pairs(classes: DataFrame) -> DataFrame:
    """(u, v) of ids of classes (id, fp) whose fingerprints are linked, u standing for its fingerprint with its smallest id.

    v stands for another fingerprint in the same way, or is another id of the same one.
    """
    tag = F.hash("fp")
    prints = stored(classes.groupBy("fp").agg(F.min("id").alias("least")), "prints")
    equal = classes.withColumn("tag", tag).join(prints.withColumn("tag", tag), ["fp", "tag"]).where("id <> least").select(F.col("least").alias("u"), F.col("id").alias("v"))
    u, v = (prints.select(F.col("fp").alias(k), F.col("least").alias(f"i{k}")) for k in "uv")
    linked = links(prints, "fp").join(u, "u").join(v, "v").select(F.col("iu").alias("u"), F.col("iv").alias("v"))
    out = stored(equal.unionByName(linked), "pairs")
    release(prints)
    return out


def similar_components(df: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """(doc_id, component_id) of every row with doc_id: texts link if their shingle sets are similar by least or more.

    Sets whose SimHash fingerprints differ in 3 bits or fewer come first, found through Golay-code keys and verified on the whole sets; the
    rest of the work is for what these links leave apart. No similar pair is lost: similar sets share a shingle of their prefixes (see prefix), and every candidate that their parities
    (see parities) do not rule out is verified on the whole sets. Equal sets stand for one text. A round of keys links each text
    to the smallest of each of its keys; a last one compares, in blocks, what shares a key but no component yet. So a large group
    of copies costs a star for each key, and what leaves a block are edges of a forest, never its pairs. Null texts and texts
    without words are one class; a repeated doc_id stands for all its texts; an empty table gives no rows.
    """
    if not 0.5 < least <= 1:
        raise ValueError("least must be over a half")
    importable(df.sparkSession)
    rows = df.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    frequent = df.sparkSession.sparkContext.broadcast(_frequent(rows, shingle))

    def profiled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(t, shingle) for t in batch["text"]]
            keys = [prefix(s, least, *frequent.value).tobytes() for s in sets]
            yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy(), "whole": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], "n": [*map(len, sets)], "parities": [*map(parities, sets)], "fp": np.array([*map(fingerprint_of, sets)], dtype=np.uint64).view(np.int64), "keys": keys})

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), 1024):
                part = batch[a : a + 1024]
                size = np.array([len(k) // 8 for k in part["keys"]], dtype=np.int64)
                at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                n = np.repeat(part["n"].to_numpy(), size)
                yield pd.DataFrame({"key": np.frombuffer(b"".join(part["keys"]), dtype="<i8"), "id": np.repeat(part["id"].to_numpy(), size), "n": n, "rest": (n - at).astype(np.int32)})

    def taken(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(t, shingle).tobytes() for t in batch["text"]]
            own = np.array([hashlib.blake2b(s, digest_size=16).digest() == w for s, w in zip(sets, batch["whole"], strict=True)], dtype=bool)
            yield pd.DataFrame({"id": batch["id"].to_numpy()[own], "whole": batch["whole"].to_numpy()[own], "set": [s for s, ok in zip(sets, own, strict=True) if ok]})

    found = stored(rows.mapInPandas(profiled, "doc_id bigint, whole binary, n int, parities binary, fp bigint, keys binary"), "found")
    classes = stored(found.groupBy("whole").agg(F.min(F.struct("doc_id", "n", "parities", "fp", "keys")).alias("m")).select("whole", F.col("m.doc_id").alias("id"), "m.n", "m.parities", "m.fp", "m.keys"), "classes")
    members = stored(found.select("doc_id", "whole"), "members")
    release(found)
    alone = stored(classes.select("id", "whole", "n", "parities"), "alone")

    def sets_of(ids: DataFrame) -> DataFrame:
        """(id, set) of the classes of some ids."""
        wanted = ids.distinct().join(alone.select("id", "whole"), "id")
        texts = rows.join(wanted, F.col("doc_id") == F.col("id")).select("id", "whole", "text")
        return stored(texts.mapInPandas(taken, "id bigint, whole binary, set binary").dropDuplicates(["id", "whole"]).select("id", "set"), "sets")

    @F.pandas_udf("boolean")
    def close(n: pd.Series, a: pd.Series, m: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([distance(x, y) <= (1 - least) / (1 + least) * (i + j) + 1e-6 for i, x, j, y in zip(n, a, m, b, strict=True)], dtype=bool)

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([alike(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), least) for x, y in zip(a, b, strict=True)])

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of some pairs (u, v) of classes whose sets are similar; sets are read again where their parities allow it."""
        u, v = (alone.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("parities").alias(f"p{k}"), F.hash("id").alias(f"t{k}")) for k in "uv")
        paired = pairs.withColumns({"tu": F.hash("u"), "tv": F.hash("v")}).join(u, ["u", "tu"]).join(v, ["v", "tv"])
        likely = stored(paired.where(close("nu", "pu", "nv", "pv")).select("u", "v").distinct(), "candidates")
        sets = sets_of(likely.select(F.col("u").alias("id")).unionByName(likely.select(F.col("v").alias("id"))))
        u, v = (sets.select(F.col("id").alias(k), F.col("set").alias(f"s{k}"), F.hash("id").alias(f"t{k}")) for k in "uv")
        both = likely.withColumns({"tu": F.hash("u"), "tv": F.hash("v")}).join(u, ["u", "tu"]).join(v, ["v", "tv"])
        out = stored(both.where(near("su", "sv")).select("u", "v"), "links")
        release(sets, likely)
        return out

    pairs = print_pairs(classes.select("id", "fp"))
    printed = verified(pairs)
    release(pairs)
    settled = components(printed)
    tops = stored(alone.join(settled, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("root")), "tops")

    # rest: how many shingles a set has from its key on; before the first key that two share, they share none
    may = lambda n, rest, m, others: F.least(rest, others) >= least / (1 + least) * (n + m) - 1e-6
    keys = classes.select("id", "n", "keys").mapInPandas(keyed, "key bigint, id bigint, n int, rest int")
    heads = stored(keys.groupBy("key").agg(F.min(F.struct("id", "n", "rest")).alias("h"), F.count(F.lit(1)).alias("held")).where("held > 1").select("key", F.hash("key").alias("tag"), "h"), "heads")
    # the added keys give both sides of the joins a shuffle of their own, so that a hot key or a row with many partners can be split
    shared = stored(keys.withColumn("tag", F.hash("key")).join(heads, ["key", "tag"]).select("key", "id", "n", "rest", "h"), "shared")
    release(heads, classes)
    stars = shared.where((F.col("id") != F.col("h.id")) & may(F.col("n"), F.col("rest"), F.col("h.n"), F.col("h.rest"))).select(F.col("h.id").alias("u"), F.col("id").alias("v")).distinct()
    # what fingerprints have joined needs no star
    u, v = (tops.select(F.col("id").alias(k), F.col("root").alias(f"r{k}"), F.hash("id").alias(f"t{k}")) for k in "uv")
    apart = stored(stars.withColumns({"tu": F.hash("u"), "tv": F.hash("v")}).join(u, ["u", "tu"]).join(v, ["v", "tv"]).where("ru <> rv").select("u", "v"), "apart")
    starred = verified(apart)
    release(apart, tops)
    first = printed.unionByName(starred)
    roots = components(first)
    placed = stored(shared.join(roots, F.col("id") == F.col("node"), "left").select("key", "id", "n", "rest", F.coalesce("root", "id").alias("root")), "placed")
    release(shared)
    # A key whose holders are one component is settled. Of other keys only holders go on that may have a partner in another
    # component. That depends on the partner's size and place alone, so a key's holders of one size are told by the one whose
    # key comes first and the first one of any other component.
    by_key = lambda df: df.withColumn("tag", F.hash("key"))
    several = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    contested = stored(by_key(placed).join(by_key(several), ["key", "tag"]).select("key", "id", "n", "rest", "root"), "contested")
    release(placed)
    earliest = contested.groupBy("key", F.col("n").alias("m"), "root").agg(F.max("rest").alias("most"))
    best = earliest.groupBy("key", "m").agg(F.max(F.struct("most", "root")).alias("x"))
    other = earliest.withColumn("tag", F.hash("key", "m")).join(best.withColumn("tag", F.hash("key", "m")), ["key", "m", "tag"]).where(F.col("root") != F.col("x.root"))
    other = other.groupBy("key", "m").agg(F.max(F.struct("most", "root")).alias("x"))
    partners = by_key(best.unionByName(other)).select(F.col("key").alias("k"), F.col("tag").alias("t"), "m", F.col("x.most").alias("most"), F.col("x.root").alias("kroot"))
    met = (F.col("key") == F.col("k")) & (F.col("tag") == F.col("t")) & (F.col("root") != F.col("kroot")) & may(F.col("n"), F.col("rest"), F.col("m"), F.col("most"))
    active = stored(by_key(contested).join(partners, met, "left_semi"), "active")
    release(contested)
    sketched = stored(active.select("key", "id", "n", "root", F.hash("id").alias("tid")).join(alone.select("id", "parities", F.hash("id").alias("tid")), ["id", "tid"]).drop("tid"), "sketched")
    release(active)
    spread, parts = _in_blocks(sketched)

    def likely(group: pd.DataFrame) -> pd.DataFrame:
        """The rows of some pairs of blocks that may have a similar one of another component."""
        found = np.zeros(len(group), dtype=bool)
        n, root, own, parities_ = (group[c].to_numpy() for c in ("n", "root", "own", "parities"))
        for (_, i, j), rows in group.groupby(["key", "i", "j"]).indices.items():
            left, right = (np.flatnonzero(own[rows] == k) for k in (i, j))
            found[rows] |= may_be_alike([parities_[r] for r in rows], n[rows], root[rows], left, right, least)
        return group.loc[found, ["key", "id", "n", "root"]]

    unsettled = stored(spread.applyInPandas(lambda group: likely(group), "key bigint, id bigint, n int, root bigint").distinct(), "unsettled")
    release(sketched, parts)
    open_sets = sets_of(unsettled.select("id"))
    held = stored(unsettled.withColumn("tid", F.hash("id")).join(open_sets.withColumn("tid", F.hash("id")), ["id", "tid"]).drop("tid"), "held")
    release(unsettled, open_sets)

    def compared(group: pd.DataFrame) -> pd.DataFrame:
        """Edges that join what is similar in some pairs of blocks, one less than their members at most for each."""
        group = group.sort_values(["key", "i", "j", "id"], ignore_index=True)
        tags = group[["key", "i", "j"]].to_numpy()
        begin = np.flatnonzero(np.concatenate(([True], (tags[1:] != tags[:-1]).any(axis=1))))
        ids, n, root, own = (group[c].to_numpy() for c in ("id", "n", "root", "own"))
        top: dict[int, int] = {}

        def find(x: int) -> int:
            while top.setdefault(x, x) != x:
                x = top[x]
            return x

        edges = []
        for start, stop in zip(begin.tolist(), [*begin[1:].tolist(), len(group)], strict=True):
            i, j = tags[start, 1], tags[start, 2]
            left, right = (start + np.flatnonzero(own[start:stop] == k) for k in (i, j))
            if not len(left) or not len(right):
                continue
            hashes = [np.frombuffer(s, "<u8") for s in group["set"][start:stop]]
            size = np.array([*map(len, hashes)])
            code = np.split(np.unique(np.concatenate(hashes), return_inverse=True)[1], np.cumsum(size)[:-1])
            facing = np.concatenate([code[b - start] for b in right])
            first_of = np.cumsum(size[right - start]) - size[right - start]
            marked = np.zeros(int(size.sum()), dtype=bool)
            for a in left.tolist():
                open_ = (root[right] != root[a]) & (np.minimum(n[right], n[a]) >= least * np.maximum(n[right], n[a]) - 1e-6) & ((ids[right] > ids[a]) | (i != j))
                if not open_.any():
                    continue
                marked[code[a - start]] = True
                common = np.add.reduceat(marked[facing].astype(np.int64), first_of)
                marked[code[a - start]] = False
                for b in right[open_ & (common >= least * (size[a - start] + size[right - start] - common) - 1e-9)].tolist():
                    ru, rv = find(int(root[a])), find(int(root[b]))
                    if ru != rv:
                        top[ru] = rv
                        edges.append((int(ids[a]), int(ids[b])))
        return pd.DataFrame(edges, columns=["u", "v"], dtype="int64")

    spread, parts = _in_blocks(held)
    second = stored(spread.applyInPandas(lambda group: compared(group), "u bigint, v bigint"), "links")
    release(held, parts)
    final = components(first.unionByName(second))
    grouped = alone.join(final, F.col("id") == F.col("node"), "left").select("whole", F.coalesce("root", "id").alias("component_id"), F.hash("whole").alias("tag"))
    return members.select("doc_id", "whole", F.hash("whole").alias("tag")).join(grouped, ["whole", "tag"]).select("doc_id", "component_id")


def dedup(df: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """df with one row of each group of near copies: that with the smallest doc_id.

    Rows that repeat the smallest doc_id with equal texts are one document and stay once; with other texts all of them
    stay, as nothing says which is meant. Rows without doc_id stay, once for each of their texts.
    """
    groups = similar_components(df, text, doc_id, shingle, least)
    ids = groups.where("doc_id = component_id").select(F.col("doc_id").alias("__rid")).distinct()
    own = df.withColumn("__rid", F.coalesce(F.col(doc_id).cast("bigint"), F.lit(-(1 << 63))))
    kept = own.join(ids.unionByName(ids.sparkSession.range(1).select(F.lit(-(1 << 63)).alias("__rid"))), "__rid", "left_semi")
    return kept.dropDuplicates(["__rid", text]).drop("__rid")
