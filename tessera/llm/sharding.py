"""Sharding by a permutation-filled lookup table.

Every shard prefers the slots of a prime-sized table in an order of its own: an offset and a step,
both from a digest of its name. The shards take turns, each claiming the first slot of its
order that is still free, until the table is full; so every shard holds the same number
of slots to within one, and a shard that comes or goes moves few others' slots. A row is placed
by the slot of its key's digest. The table has ``slots`` rows, a parameter, which bounds what is
broadcast.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = 16
SLOTS = 4099
MAX_SLOTS = 1_000_003


def digest60(text: str) -> int:
    """The first 60 bits of the MD5 digest, as a number."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The place in ``shards`` of each slot's owner."""
    if len(set(shards)) != len(shards) or not shards:
        raise ValueError("shards need different names, at least one")
    if slots > MAX_SLOTS or slots <= len(shards) or any(slots % k == 0 for k in range(2, int(slots ** 0.5) + 1)):
        raise ValueError(f"slots must be a prime over the number of shards and at most {MAX_SLOTS}")
    nexts = [digest60(f"{s}/offset") % slots for s in shards]
    steps = [digest60(f"{s}/step") % (slots - 1) + 1 for s in shards]
    owner = [-1] * slots
    for turn in range(slots):
        i = turn % len(shards)
        while owner[nexts[i]] >= 0:
            nexts[i] = (nexts[i] + steps[i]) % slots
        owner[nexts[i]] = i
    return owner


def table_frame(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """(slot, shard): the lookup table, made on the JVM from one literal."""
    names = [shards[i] for i in lookup_table(shards, slots)]
    return spark.range(1).select(F.posexplode(F.from_json(F.lit(json.dumps(names)), "array<string>")).alias("slot", "shard"))


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key, taken as text; a null key is the empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return (F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % slots).cast("int")


def placed(df: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """``df`` with columns ``slot`` and ``shard`` (any it had under these names are replaced).

    Rows are placed where they are read: one broadcast of the table, no shuffle, whatever the key's
    distribution. Equal keys go to one shard, null keys to that of the empty text; repeated rows
    each keep their row.
    """
    if key in ("slot", "shard"):
        raise ValueError("the key column can't be called slot or shard")
    plain = df.drop("slot", "shard")
    table = F.broadcast(table_frame(df.sparkSession, shards, slots))
    return plain.withColumn("slot", slot_of(F.col(key), slots)).join(table, "slot").select(
        *plain.columns, "slot", "shard")


def write_shards(df: DataFrame, key: str, shards: list[str], path: str, slots: int = SLOTS, files: int = 4) -> None:
    """One folder per shard. Rows go to ``files`` tasks per shard by slot, so no shard is one task."""
    out = placed(df, key, shards, slots)
    out.repartition(files * len(shards), "shard", F.col("slot") % files).write.partitionBy("shard").parquet(path)
