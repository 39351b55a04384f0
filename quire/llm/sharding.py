"""Placement of rows on shards by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table whose size is prime: it starts at a
hashed offset and goes on by a hashed step. Shards take turns, each claiming the first slot of its order that is
still free, until no slot is. A row's slot is a hash of its key, so its place takes one lookup; when a
shard comes or goes, few slots change hands. The table is broadcast: its size is a parameter.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 4099
SHARDS = tuple(f"shard-{i:02d}" for i in range(16))
#: More slots than this aren't broadcast.
MOST_SLOTS = 1_000_003


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards=SHARDS, slots: int = SLOTS) -> list[int]:
    """The place in shards that owns each slot; no shard owns over one slot more than another."""
    if not _is_prime(slots) or not 0 < len(shards) <= slots <= MOST_SLOTS or len({*shards}) != len(shards):
        raise ValueError("slots must be a prime up to a million, and shards distinct names, no more than slots")
    digests = [hashlib.md5(s.encode()).hexdigest() for s in shards]
    at, step = [int(d[:8], 16) % slots for d in digests], [int(d[8:16], 16) % (slots - 1) + 1 if slots > 2 else 1 for d in digests]
    owner, left = [-1] * slots, slots
    while True:
        for i in range(len(shards)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            owner[at[i]] = i
            left -= 1
            if not left:
                return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The first 32 bits of the MD5 of the key as text (null: empty text), modulo slots."""
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("bigint") % slots).cast("int")


def place(df: DataFrame, key: str = "doc_id", shards=SHARDS, slots: int = SLOTS) -> DataFrame:
    """df with slot (int) and shard (string) of each row; columns of these names are replaced.

    Rows with equal keys, repeated or null ones included, share a shard. No shuffle: the table (slots rows, at
    most a million) is broadcast, whatever the size of df.
    """
    table = df.sparkSession.createDataFrame([(i, shards[o]) for i, o in enumerate(lookup_table(shards, slots))], "slot int, shard string")
    kept = [c for c in df.columns if c not in ("slot", "shard")]
    return df.select(*[F.col(f"`{c}`") for c in kept], slot_of(F.col(key), slots).alias("slot")).join(F.broadcast(table), "slot").select(*[F.col(f"`{c}`") for c in kept], "slot", "shard")


def oracle(shards=SHARDS, slots: int = SLOTS) -> str:
    """DuckDB's form of place() for documents; the table's owners stand in it as a list."""
    owners = ",".join(map(str, lookup_table(shards, slots)))
    names = ",".join(f"'{s}'" for s in shards)
    return f"""
WITH placed AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % {slots} AS INTEGER) AS slot FROM documents)
SELECT doc_id, slot, ([{names}])[([{owners}])[slot + 1] + 1] AS shard FROM placed"""
