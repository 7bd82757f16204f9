"""Shard placement by a permutation-filled lookup table, without Python on the rows.

Each shard has its own permutation of the slots of a prime-sized table, given by
an offset and a step from its name. Shards take turns; at its turn a shard claims
the first slot of its permutation that is still free, until no slot is. Shares
then differ by one slot at most, and when a shard leaves, few other slots move.

The table depends on the shards' names and its size only. It is filled on the
driver, once, and travels as one binary literal of SLOT_BYTES a slot, so its
size is known before any data are read. A row is placed by the hash of its key
and one look into the literal.

Defined results
    null key           slot and shard null
    empty text key     a key like any other
    ties, repeats      equal keys share a shard
    hot key            placement is row by row; nothing is shuffled
    empty table        empty result
    no shards          an error
    clashing columns   the operator's own output columns replace those of their names
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A prime, well above a hundred times the number of shards.
TABLE_SIZE = 65_537
SLOT_BYTES = 3


def _number(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{salt}:{name}".encode(), digest_size=8).digest(), "big")


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """Position in shards of the owner of every slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be named, and differently")
    if size < len(shards) or size < 2 or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("the table's size must be a prime no smaller than the number of shards")
    spots = [_number(s, "offset") % size for s in shards]
    steps = [_number(s, "step") % (size - 1) + 1 for s in shards]
    # turns go by name, so the order in which shards are listed does not matter
    turns = sorted(range(len(shards)), key=lambda i: shards[i])
    owner, free = [-1] * size, size
    while True:
        for i in turns:
            while owner[spots[i]] >= 0:
                spots[i] = (spots[i] + steps[i]) % size
            owner[spots[i]] = i
            free -= 1
            if not free:
                return owner


def slot(key: Column, size: int = TABLE_SIZE) -> Column:
    """Slot of a key, by the XXH64 of its text."""
    text = key.cast("string")
    return F.when(text.isNotNull(), F.pmod(F.xxhash64(text), F.lit(size).cast("long")))


def place(df: DataFrame, key: str, shards: list[str], size: int = TABLE_SIZE, slot_column: str = "slot", shard_column: str = "shard") -> DataFrame:
    """Add the slot of each row's key and the name of the shard that owns it."""
    packed = b"".join(i.to_bytes(SLOT_BYTES, "big") for i in lookup_table(shards, size))
    found = df.withColumn(slot_column, slot(F.col(key), size))
    entry = F.substring(F.lit(bytearray(packed)), (F.col(slot_column) * SLOT_BYTES + 1).cast("int"), F.lit(SLOT_BYTES))
    names = F.array(*map(F.lit, shards))
    owner = F.element_at(names, F.conv(F.hex(entry), 16, 10).cast("int") + 1)
    return found.withColumn(shard_column, F.when(F.col(slot_column).isNotNull(), owner))
