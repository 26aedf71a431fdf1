"""Sharding by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table. The shards take turns; in its turn a
shard claims the first slot of its permutation that nobody holds yet. A row's key hashes to a slot, and the table
says which shard holds it. Shards then differ by at most one slot, and a changed shard list moves few rows.

The table's size is a parameter and doesn't grow with the data, so it is broadcast (at most ``MAX_TABLE`` rows).

Defined results: a null key column counts as a value of its own; rows with equal keys go to one shard; an empty
input gives an empty output; columns of the input named like the new ones are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from melisma.llm.text import hex_long, null_key

SHARDS = tuple(f"shard-{i:02d}" for i in range(16))
TABLE_SIZE = 2039
#: Largest table that may be broadcast: about 24 bytes a row.
MAX_TABLE = 1_000_003


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], table_size: int = TABLE_SIZE) -> list[int]:
    """Slot -> index of the shard that holds it."""
    if len(set(shards)) != len(shards) or not shards:
        raise ValueError("shard names must be given and differ")
    if not _is_prime(table_size) or not len(shards) <= table_size <= MAX_TABLE:
        raise ValueError(f"the table size must be a prime from the number of shards to {MAX_TABLE}")
    number = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:12], 16)
    walk = [(number(f"{s}:offset") % table_size, number(f"{s}:skip") % (table_size - 1) + 1) for s in shards]
    holder, tried, claimed = [-1] * table_size, [0] * len(shards), 0
    while claimed < table_size:
        for k, (offset, skip) in enumerate(walk):
            while holder[slot := (offset + tried[k] * skip) % table_size] >= 0:
                tried[k] += 1
            holder[slot] = k
            claimed += 1
            if claimed == table_size:
                break
    return holder


def slot_of(keys: Sequence[Column], table_size: int) -> Column:
    """The slot that a row's key columns hash to."""
    return F.pmod(hex_long(F.md5(F.concat_ws("\x1f", *[null_key(k) for k in keys]))), F.lit(table_size))


def assign_shards(df: DataFrame, keys: Sequence[str], shards: Sequence[str] = SHARDS, table_size: int = TABLE_SIZE) -> DataFrame:
    """``df`` with ``slot`` (long) and ``shard`` (string); no row of ``df`` moves between tasks."""
    table = lookup_table(shards, table_size)
    text = F.lit(",".join(map(str, table)))
    slots = df.sparkSession.range(1).select(F.posexplode(F.split(text, ",")).alias("_p", "_h"))
    names = F.array(*[F.lit(s) for s in shards])
    held = slots.select(F.col("_p").cast("long").alias("slot"), F.element_at(names, F.col("_h").cast("int") + 1).alias("shard"))
    plain = df.drop("slot", "shard")
    return plain.withColumn("slot", slot_of([df[k] for k in keys], table_size)).join(F.broadcast(held), "slot").select(*[plain[c] for c in plain.columns], "slot", "shard")


def write_shards(df: DataFrame, path: str, keys: Sequence[str], shards: Sequence[str] = SHARDS, table_size: int = TABLE_SIZE, files: int = 8) -> None:
    """Write one folder for each shard; each has up to ``files`` files, so that a shard is no single task."""
    placed = assign_shards(df, keys, shards, table_size)
    placed.repartition("shard", F.pmod(F.col("slot"), F.lit(files))).write.partitionBy("shard").parquet(path)
