"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a table of prime size M: from an offset in steps of
a skip, both drawn from a hash of its name, which visits all slots since M is prime. The shards take
turns; at its turn a shard claims its next preferred slot that is free, until the table is full. The
share of each shard is then M / n slots to within one turn, and adding or removing a shard moves few
others' slots. A row goes to the shard in slot hash(key) mod M.

The table follows from the shard names and M alone: its size does not depend on the data, and M is
checked against ``MAX_SLOTS`` before it is broadcast. Placement is one broadcast hash lookup in the row's
own task: no shuffle, and no key can be hot.

Defined results: a null key is placed as the empty string; equal keys go to the same shard, repeated rows
too; an empty table gives no rows. Columns of the input whose names clash with ``slot`` or ``shard`` are
replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_SLOTS = 1 << 20


def _is_prime(m: int) -> bool:
    return m > 1 and all(m % d for d in range(2, int(m**0.5) + 1))


def fill(names: list[str], slots: int) -> list[int]:
    """For each slot the index of the shard that claimed it."""
    if not _is_prime(slots) or slots > MAX_SLOTS or not 0 < len(names) <= slots or len(set(names)) < len(names):
        raise ValueError(f"needs distinct shard names, and a prime from their number to {MAX_SLOTS}: {slots}")
    at, skip = [], []
    for name in names:
        d = hashlib.md5(name.encode()).digest()
        at.append(int.from_bytes(d[:8], "big") % slots)
        skip.append(int.from_bytes(d[8:], "big") % (slots - 1) + 1 if slots > 2 else 1)
    table, free = [-1] * slots, slots
    while free:
        for i in range(len(names)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            table[at[i]] = i
            free -= 1
            if not free:
                break
    return table


def key_slot(key: Column, slots: int) -> Column:
    """Slot of a key: the first 52 bits of the MD5 of its text, modulo the number of slots."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint"), F.lit(slots).cast("bigint"))


def assign_shards(df: DataFrame, key: str, names: list[str], slots: int = 65537) -> DataFrame:
    """df with ``slot`` (long) and ``shard`` (string)."""
    table = ",".join(map(str, fill(names, slots)))
    lookup = (
        df.sparkSession.range(1)
        .select(F.posexplode(F.split(F.lit(table), ",")).alias("slot", "i"))
        .select(F.col("slot").cast("bigint").alias("slot"), F.element_at(F.array(*map(F.lit, names)), F.col("i").cast("int") + 1).alias("shard"))
    )
    return df.drop("shard").withColumn("slot", key_slot(df[key], slots)).join(F.broadcast(lookup), "slot")
