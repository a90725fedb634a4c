"""Shard placement through a lookup table of prime size that the shards fill by turns.

Each shard has a preference order of all slots: it starts at an offset and goes on by a skip, both hashed from its
name, modulo the prime. Shards take turns; at its turn a shard claims the first slot of its order that is still
free. All shards so get the same number of slots but for one, and a shard that goes away frees only its own slots,
so few other keys move. A shard of weight w takes w turns a round.

A key's slot is its hash modulo the prime. The table has a fixed number of rows (its size is a parameter, not a matter
of the data), so it is broadcast, and placing a row takes one look-up without a shuffle.

Defined cases: equal keys share a shard, null keys too; repeated rows are each placed; an empty table gives an
empty result; a column named like a result column is not touched, as only the key columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Slots; a prime well over 100 times the number of shards keeps shares within a percent.
TABLE_SIZE = 65_537
MAX_SLOTS = 1 << 20
SHARDS = 128


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def preference(name: str, size: int) -> tuple[int, int]:
    """Offset and skip of a shard's order of slots."""
    digest = hashlib.sha256(name.encode()).digest()
    return int.from_bytes(digest[:8], "big") % size, int.from_bytes(digest[8:16], "big") % (size - 1) + 1


def fill_table(names: Sequence[str], size: int = TABLE_SIZE, weights: Sequence[int] | None = None) -> np.ndarray:
    """For each slot the number of the shard that claimed it."""
    if not _is_prime(size) or size > MAX_SLOTS:
        raise ValueError(f"{size} slots: a prime of at most {MAX_SLOTS} is needed")
    weights = list(weights or [1] * len(names))
    if not names or len(set(names)) < len(names) or len(weights) != len(names) or min(weights) < 1 or size < sum(weights):
        raise ValueError("shards need different names, weights of 1 or more, and a slot for each turn of a round")
    table = np.full(size, -1, dtype=np.int32)
    at, skip = map(list, zip(*(preference(n, size) for n in names), strict=True))
    turns = [i for i, w in enumerate(weights) for _ in range(w)]
    left = size
    while left:
        for i in turns[:left] if left < len(turns) else turns:
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % size
            table[at[i]] = i
            left -= 1
    return table


def free_name(name: str, taken: Sequence[str]) -> str:
    """The name, with as many underscores behind it as it takes to differ from those taken."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def place(df: DataFrame, keys: Sequence[str], table: np.ndarray) -> DataFrame:
    """The key columns of df with slot and shard, row by row. Where a key has one of these names, that gets underscores."""
    slot, shard, at = (free_name(x, keys) for x in ("slot", "shard", "slot_no"))
    slots = df.sparkSession.createDataFrame([(i, int(s)) for i, s in enumerate(table)], f"`{at}` int, `{shard}` int")
    columns = [F.col(f"`{k}`") for k in keys]
    placed = df.select(*columns).withColumn(slot, F.pmod(F.xxhash64(*columns), F.lit(len(table))).cast("int"))
    return placed.join(F.broadcast(slots), placed[slot] == slots[at]).drop(at)


def write_shards(df: DataFrame, key: str, table: np.ndarray, path: str, files_per_shard: int = 1) -> None:
    """Write df with one folder per shard; the rows of a shard are dealt to files_per_shard tasks by their hash.

    The folders are named by shard_no, with underscores behind it if df has such a column.
    """
    n = int(table.max()) + 1
    shard, at, slot = (free_name(x, df.columns) for x in ("shard_no", "slot_no", "slot_of"))
    slots = df.sparkSession.createDataFrame([(i, int(s)) for i, s in enumerate(table)], f"`{at}` int, `{shard}` int")
    rows = df.withColumn(slot, F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(len(table))).cast("int"))
    rows = rows.join(F.broadcast(slots), rows[slot] == slots[at]).drop(at, slot)
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(files_per_shard))
    rows.repartition(n * files_per_shard, F.col(shard), salt).write.partitionBy(shard).parquet(path)
