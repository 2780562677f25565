"""Sharding by a permutation-filled lookup table (Maglev hashing)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import hash64

SLOTS = 65_537


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: Sequence[str] | Mapping[str, int], slots: int = SLOTS) -> np.ndarray:
    """The shard index of every slot.

    Each shard has its own order of preference over the slots, ``(offset + turn * skip) % slots``, a permutation
    because ``slots`` is prime.  Shards take turns (in the order of their names) and claim their next free slot
    until none is left; a shard of weight n claims n slots in its turn.  Adding or removing a shard changes few
    other slots.  The work is bounded by the table size, not by the data.
    """
    weights = dict(shards) if isinstance(shards, Mapping) else dict.fromkeys(shards, 1)
    names = sorted(weights)
    if not names or not is_prime(slots) or slots < len(names):
        raise ValueError("needs at least one shard and a prime number of slots, no less than the shards")
    if any(w < 1 for w in weights.values()):
        raise ValueError("weights are whole numbers from 1")
    offset = [hash64(n.encode(), 1) % slots for n in names]
    skip = [hash64(n.encode(), 2) % (slots - 1) + 1 for n in names]
    table = [-1] * slots
    left = slots
    while left:
        for i, name in enumerate(names):
            for _ in range(weights[name]):
                if not left:
                    break
                at = offset[i]
                while table[at] >= 0:
                    at = (at + skip[i]) % slots
                table[at] = i
                offset[i] = (at + skip[i]) % slots
                left -= 1
    return np.array(table, np.int32)


def lookup_table(spark: SparkSession, shards: Sequence[str] | Mapping[str, int], slots: int = SLOTS) -> DataFrame:
    """``(slot, shard)``: one row per slot."""
    names = sorted(shards)
    rows = [(i, names[s]) for i, s in enumerate(fill_table(shards, slots).tolist())]
    return spark.createDataFrame(rows, "slot int, shard string")


def slot_of(keys: Sequence[Column], slots: int = SLOTS) -> Column:
    """Slot of a row: a hash of its key columns; null keys hash like any other value."""
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


def place(
    df: DataFrame, key: str | Sequence[str], shards: Sequence[str] | Mapping[str, int], slots: int = SLOTS,
    slot: str = "slot", shard: str = "shard",
) -> DataFrame:
    """``df`` with the columns ``slot`` and ``shard`` (existing columns of these names are replaced).

    Every row is placed by one lookup in the broadcast table, whose size is fixed by ``slots``; nothing is
    shuffled.  Repeated rows go to one shard; null keys are placed like a value of their own; an empty table
    stays empty.  Place by the document, not by its source: a hot source then spreads over all shards.
    """
    keys = [key] if isinstance(key, str) else list(key)
    table = lookup_table(df.sparkSession, shards, slots).select(
        F.col("slot").alias("_maglev_slot"), F.col("shard").alias("_maglev_shard")
    )
    kept = [c for c in df.columns if c not in (slot, shard)]
    placed = df.withColumn("_maglev_at", slot_of([df[k] for k in keys], slots))
    return placed.join(F.broadcast(table), F.col("_maglev_at") == F.col("_maglev_slot"), "left").select(
        *[F.col(f"`{c}`") for c in kept], F.col("_maglev_slot").alias(slot), F.col("_maglev_shard").alias(shard)
    )


def moved_slots(before: Sequence[str] | Mapping[str, int], after: Sequence[str] | Mapping[str, int], slots: int = SLOTS) -> float:
    """Share of the slots whose shard changes from one set of shards to another."""
    a, b = (np.array(sorted(s))[fill_table(s, slots)] for s in (before, after))
    return float((a != b).mean())


def write_shards(df: DataFrame, folder: str, salts: int = 1, shard: str = "shard") -> None:
    """One sub-folder per shard, ``salts`` files or more each."""
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(salts))
    df.repartition(df[shard], spread).write.partitionBy(shard).parquet(folder)
