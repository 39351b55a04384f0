"""Variable-capacity best-fit packing of documents into sequences.

Several sequence lengths are permitted. Pieces are packed longest first: each goes into the open bin where it
leaves the least room; if none has room, the bin is opened whose length costs least for what is still to
be packed, by the share of it that the piece and the pieces expected to follow would leave unused. At the end
every bin shrinks to the smallest permitted length that holds its contents.

A piece's length alone decides, so bins are chosen among remaining capacities, not among bins. Rows are
dealt by hash into groups of bounded size and each group is packed by itself; a group of a few thousand pieces wastes
hardly more than the whole would.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import importable, stored

LENGTHS = (512, 1024, 2048, 4096)
#: Cost of a sequence: its length and a fixed overhead per sequence.
OVERHEAD = 32
GROUP_ROWS = 20_000


def word_count(text: Column) -> Column:
    """Words of a whole text as white space parts them, and one for its end; null texts have the end alone."""
    return (F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")) + 1).cast("bigint")


def best_fit(sizes: np.ndarray, lengths=LENGTHS, overhead: int = OVERHEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, capacity) of each size; sizes are from 1 to the greatest length.

    The bin to open is the one of least cost per word that it would come to hold: a bin of length c is taken to
    fill up with the sizes that remain, largest first, as far as they fit beside the piece.
    """
    lengths = sorted(lengths)
    order = np.lexsort((np.arange(len(sizes)), -sizes))
    count = np.bincount(sizes, minlength=lengths[-1] + 1)
    present = np.flatnonzero(count).tolist()
    bins, offsets = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    used: list[int] = []
    room_of: list[int] = []
    rooms: list[int] = []  # distinct remaining capacities, ascending
    having: dict[int, list[int]] = {}

    def expected(room: int) -> int:
        """Words that the sizes still to be packed would put into room."""
        got = 0
        while room:
            i = bisect_left(present, room + 1) - 1
            if i < 0:
                break
            size = present[i]
            k = min(room // size, int(count[size]))
            got, room = got + k * size, min(room - k * size, size - 1)
        return got

    for p in order.tolist():
        size = int(sizes[p])
        count[size] -= 1
        if not count[size]:
            present.pop()
        at = bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            b = having[room].pop()
            if not having[room]:
                del having[room]
                rooms.pop(at)
        else:
            room = min((c for c in lengths if c >= size), key=lambda c: ((c + overhead) / (size + expected(c - size)), c))
            b = len(used)
            used.append(0)
            room_of.append(room)
        bins[p], offsets[p] = b, used[b]
        used[b] += size
        left = room - size
        if left:
            if left not in having:
                insort(rooms, left)
                having[left] = []
            having[left].append(b)
    held = np.array(used, dtype=np.int64)
    capacity = np.array(lengths, dtype=np.int64)[np.searchsorted(lengths, held)] if len(held) else held
    return bins, offsets, capacity[bins] if len(held) else held


def pack(df: DataFrame, length: str = "length", doc_id: str = "doc_id", lengths=LENGTHS, overhead: int = OVERHEAD, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per piece of a row of df: doc_id, piece, start, length, bin_id, offset, capacity.

    A row of more than the greatest length is cut into pieces of that length and a rest; start is where a piece begins
    in its row. Rows of null or no length get no piece. bin_id is unique; within a bin, pieces
    lie side by side from 0 and never over capacity, which is the smallest permitted length that holds them. Rows that
    repeat, also in doc_id, are packed each for itself.
    """
    importable(df.sparkSession)
    if not lengths or min(lengths) < 1:
        raise ValueError("lengths must be positive")
    most = int(max(lengths))
    # the lengths are kept, as two passes need them and texts should be read once
    rows = stored(df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(length).cast("bigint").alias("n")).where("n > 0"), "lengths")
    pieces = rows.select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / most).cast("int") - 1)).alias("piece"))
    pieces = pieces.select("doc_id", "piece", (F.col("piece").cast("bigint") * most).alias("start"), F.least(F.lit(most), F.col("n") - F.col("piece").cast("bigint") * most).alias("length"))
    total = rows.agg(F.sum(F.ceil(F.col("n") / most))).first()[0] or 0
    groups = int(total) // group_rows + 1
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "piece", "length"], na_position="first", ignore_index=True)
        bins, offset, capacity = best_fit(group["length"].to_numpy(dtype=np.int64), lengths, overhead)
        grp = int(group["grp"].iat[0])
        return group[["doc_id", "piece", "start", "length"]].assign(bin_id=grp << 32 | bins, offset=offset, capacity=capacity)

    return dealt.groupBy("grp").applyInPandas(packed, "doc_id bigint, piece int, start bigint, length bigint, bin_id bigint, offset bigint, capacity bigint")
