"""Consistent placement by a permutation-filled lookup table.

Every shard prefers the slots of a table of prime size in its own order, a permutation given by an offset and a step that hash its
name. Shards take turns; at its turn a shard claims its first slot that is still free, until the table is full. Slots are
thus shared out evenly, and few slots change hands when a shard comes or goes. The table is built once from the shards' names alone
(its size is a parameter, some hundred slots per shard) and broadcast; a key's slot is a hash, so placing a row is one lookup.

Defined results: a null key is placed as the empty text; repeated keys share a shard; an empty table gives no rows. Shards must be
distinct and fewer than slots. Columns slot and shard of the rows' own give way to those added; all others stay, whatever their names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = tuple(f"shard-{i}" for i in range(16))
SLOTS = 2039  # a prime above 100 slots per shard
MOST_SLOTS = 1_000_003  # bounds what is broadcast


def lookup_table(shards: tuple[str, ...], slots: int) -> list[int]:
    """The number of the shard that owns each slot."""
    if not 0 < len(set(shards)) == len(shards) < slots <= MOST_SLOTS:
        raise ValueError(f"need distinct shards, fewer than slots, and at most {MOST_SLOTS} slots")
    if any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime, or steps would miss slots")
    digests = [hashlib.md5(name.encode()).hexdigest() for name in shards]
    place = [int(d[:15], 16) % slots for d in digests]
    step = [int(d[16:31], 16) % (slots - 1) + 1 for d in digests]
    owner: list[int] = [-1] * slots
    for turn in range(slots):
        s = turn % len(shards)
        while owner[place[s]] >= 0:
            place[s] = (place[s] + step[s]) % slots
        owner[place[s]] = s
    return owner


def slot_of(key: Column, slots: int) -> Column:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return (F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % slots).cast("int")


def place(rows: DataFrame, key: str, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """The rows with the slot of their key and the shard that owns it, as slot and shard."""
    spark = rows.sparkSession
    listed = ",".join(map(str, lookup_table(shards, slots)))
    table = spark.range(1).select(F.posexplode(F.split(F.lit(listed), ",")).alias("__slot", "__owner"))
    names = F.array(*[F.lit(s) for s in shards])
    table = table.select("__slot", F.element_at(names, F.col("__owner").cast("int") + 1).alias("shard"))
    kept = [c for c in rows.columns if c not in ("slot", "shard")]
    slotted = rows.select(*[rows[c] for c in kept], slot_of(rows[key], slots).alias("slot"))
    found = slotted.join(F.broadcast(table), slotted["slot"] == table["__slot"])  # at most MOST_SLOTS rows
    return found.select(*[slotted[c] for c in kept], slotted["slot"], table["shard"])


def query(spark: SparkSession, folder: str) -> DataFrame:
    return place(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id"), "doc_id")


ORACLE = f"""
WITH RECURSIVE shard AS (
  SELECT i, ('0x' || substr(md5('shard-' || i), 1, 15))::BIGINT % {SLOTS} AS o, ('0x' || substr(md5('shard-' || i), 17, 15))::BIGINT % {SLOTS - 1} + 1 AS k
  FROM range({len(SHARDS)}) t(i)
), claim AS (
  SELECT 0::BIGINT AS turn, -1::BIGINT AS slot, -1::BIGINT AS owner, list_transform(range({SLOTS}), lambda x: false) AS taken
  UNION ALL
  SELECT turn + 1, slot, owner, list_transform(taken, lambda x, p: x OR p = slot + 1)
  FROM (
    SELECT turn, taken, i AS owner, (o + k * list_filter(range({SLOTS}), lambda j: NOT taken[(o + j * k) % {SLOTS} + 1])[1]) % {SLOTS} AS slot
    FROM claim JOIN shard ON i = turn % {len(SHARDS)} WHERE turn < {SLOTS}
  )
), keyed AS (
  SELECT doc_id, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {SLOTS})::INTEGER AS slot FROM documents
)
SELECT doc_id, keyed.slot, 'shard-' || owner AS shard FROM keyed JOIN claim ON claim.slot = keyed.slot
"""
