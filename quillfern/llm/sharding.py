"""Shard placement by a permutation-filled lookup table, in DataFrame functions only.

Every shard has its own preference order over the slots of a prime-sized table: start, start + skip, ...
modulo the size. Shards take turns claiming their next free slot until the table is full, so each
shard owns almost the same number of slots, and adding or removing a shard moves few of the others'.
The table is filled on the driver (its size is a parameter), goes out as one broadcast of that many
rows, and a row is placed by one hash and one lookup: no shuffle, however hot a key is.

Defined cases: a null key is placed as the empty string; equal keys get equal shards; repeated rows
each get a row; columns named slot or shard in the input, the key among them, are replaced in the result; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLE_SIZE = 65537


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def preference(shard: str, size: int) -> tuple[int, int]:
    """(start, skip) of a shard's permutation of the slots; any skip from 1 to size - 1 reaches all slots of a prime size."""
    h = hashlib.md5(shard.encode()).hexdigest()
    return int(h[:15], 16) % size, int(h[16:31], 16) % (size - 1) + 1


def fill_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """For each slot the index of the shard (in sorted order of names) that claims it."""
    if not is_prime(size):
        raise ValueError("the table's size must be prime")
    names = sorted(set(shards))
    if not names or len(names) > size:
        raise ValueError("the number of shards must lie between 1 and the table's size")
    slots, filled = [-1] * size, 0
    at, skip = map(list, zip(*(preference(s, size) for s in names), strict=True))
    while True:
        for i in range(len(names)):
            while slots[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % size
            slots[at[i]] = i
            filled += 1
            if filled == size:
                return slots


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """The slot of a key: 60 bits of the MD5 of its text, modulo the size."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")


def place(df: DataFrame, key: str, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """df with the columns slot (int) and shard (string)."""
    names = sorted(set(shards))
    slots = fill_table(names, size)
    table = df.sparkSession.range(1).select(F.posexplode(F.split(F.lit(",".join(map(str, slots))), ",")).alias("slot", "i"))
    table = table.select("slot", F.element_at(F.array(*map(F.lit, names)), F.col("i").cast("int") + 1).alias("shard"))
    own = [c for c in df.columns if c.lower() not in ("slot", "shard")]
    keyed = df.select(slot_of(F.col(f"`{key}`"), size).alias("slot"), F.struct(F.lit(0).alias("_0"), *(F.col(f"`{c}`") for c in own)).alias("row"))
    return keyed.join(F.broadcast(table), "slot", "left").select(*(F.col("row").getField(c).alias(c) for c in own), "slot", "shard")
