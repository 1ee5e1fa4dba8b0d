"""Sharding by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table
(offset + j * skip mod size). Shards take turns and claim the next free slot of
their permutation until the table is full: loads differ by one slot at most,
and few slots change hands when a shard comes or goes. The table has
``table_size`` rows whatever the data are (4,099 by default), so it is
broadcast; a row's place is one hash and one lookup. The main path is DataFrame
functions only and nothing is shuffled.

Defined cases: a null key is placed like the empty string; equal keys always
share a shard; an empty table gives an empty result; other columns pass
through, and ``slot`` and ``shard`` replace columns of these names (one of which
may be the key).
"""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLE_SIZE = 4099
MAX_TABLE_SIZE = 1 << 20


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _digest(name: str, salt: str) -> int:
    return int(md5(f"{salt}:{name}".encode()).hexdigest()[:15], 16)


def fill_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """Slot -> index of the shard that owns it. Takes size steps and a bounded table."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct names, one at least")
    if not is_prime(size) or size < len(shards) or size > MAX_TABLE_SIZE:
        raise ValueError(f"the table's size must be a prime from {len(shards)} to {MAX_TABLE_SIZE}")
    offset = [_digest(s, "offset") % size for s in shards]
    skip = [_digest(s, "skip") % (size - 1) + 1 for s in shards]
    table, turn = [-1] * size, [0] * len(shards)
    for claimed in range(size):
        shard = claimed % len(shards)
        slot = (offset[shard] + turn[shard] * skip[shard]) % size
        while table[slot] >= 0:
            turn[shard] += 1
            slot = (offset[shard] + turn[shard] * skip[shard]) % size
        table[slot] = shard
        turn[shard] += 1
    return table


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """First 60 bits of the key's md5, modulo the table's size."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % size).cast("int")


def assign(df: DataFrame, key: str, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """df with ``slot`` and ``shard`` (the shard's name)."""
    names = ",".join(str(x) for x in fill_table(shards, size))
    spark = df.sparkSession
    table = (
        spark.range(1)
        .select(F.posexplode(F.split(F.lit(names), ",")).alias("slot", "owner"))
        .select("slot", F.get(F.array(*map(F.lit, shards)), F.col("owner").cast("int")).alias("shard"))
    )
    others = [c for c in df.columns if c not in ("slot", "shard")]
    placed = df.select(*others, slot_of(F.col(key), size).alias("slot"))  # the key may be one of the two itself
    return placed.join(F.broadcast(table), "slot").select(*others, "slot", "shard")


def write_sharded(df: DataFrame, path: str, files_per_shard: int = 1) -> None:
    """One folder for each shard. Rows of a shard are spread over files_per_shard
    tasks by a hash of the whole row, so a shard of any size has no single writer."""
    salt = F.pmod(F.xxhash64(*[c for c in df.columns if c != "shard"]), F.lit(files_per_shard))
    df.repartition(F.col("shard"), salt).write.mode("overwrite").partitionBy("shard").parquet(path)
