"""Sharding by a permutation-filled lookup table (operator 1, DataFrame functions only).

Every shard owns a permutation of the slots 0..size-1 (size is prime): start offset and step come
from the md5 of its name. Shards take turns; each claims the first slot of its permutation that is
still free. A row goes to the shard of slot md5(key) mod size, so placement is one look-up in a
broadcast table, shares differ by one slot at most, and few slots change owner when a shard goes.

The fill runs over table slots, a parameter, never over rows; the table reaches Spark as one binary
literal that a range unpacks.

Cases: null keys count as a value of their own and go to one fixed shard; repeated rows go to the
same shard; an empty table gives no rows; a column of the input that is named like an output
column is replaced by it.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.llm.common import free_name, quoted

N_SHARDS, TABLE_SIZE = 32, 4099
#: Slots that may be broadcast: 16 bytes each.
MOST_SLOTS = 1_000_003


def _prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def _number(s: str) -> int:
    return int(hashlib.md5(s.encode()).hexdigest()[:12], 16)


def fill(n_shards: int = N_SHARDS, size: int = TABLE_SIZE) -> list[int]:
    """The shard of each slot."""
    if not _prime(size) or not 0 < n_shards <= size or size > MOST_SLOTS:
        raise ValueError(f"the table size must be a prime from the number of shards to {MOST_SLOTS}")
    at = [_number(f"offset-{i}") % size for i in range(n_shards)]
    step = [_number(f"skip-{i}") % (size - 1) + 1 for i in range(n_shards)]
    table = [-1] * size
    for turn in range(size):
        i = turn % n_shards
        while table[at[i]] >= 0:
            at[i] = (at[i] + step[i]) % size
        table[at[i]] = i
    return table


def lookup_table(spark: SparkSession, n_shards: int = N_SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """(slot, shard), one row per slot."""
    packed = F.lit(bytearray(b"".join(x.to_bytes(4, "big") for x in fill(n_shards, size))))
    return spark.range(size).select(
        F.col("id").alias("slot"),
        F.conv(F.hex(F.substring(packed, (F.col("id") * 4 + 1).cast("int"), F.lit(4))), 16, 10).cast("int").alias("shard"),
    )


def slot_of(keys: list[Column], size: int = TABLE_SIZE) -> Column:
    text = F.concat_ws("\x1f", *[F.coalesce(k.cast("string"), F.lit("\x00null")) for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long") % size


def assign_shards(df: DataFrame, keys: list[str], n_shards: int = N_SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """df with slot (long) and shard (int)."""
    at, to = free_name(df, "_slot"), free_name(df, "_shard")
    own = [quoted(c) for c in df.columns if c.lower() not in ("slot", "shard")]
    placed = df.select(*own, slot_of([F.col(quoted(k)) for k in keys], size).alias(at))
    out = placed.join(F.broadcast(lookup_table(df.sparkSession, n_shards, size).toDF(at, to)), at, "left")
    return out.select(*own, F.col(at).alias("slot"), F.col(to).alias("shard"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return assign_shards(docs, ["doc_id"])


OP1_SQL = f"""
WITH RECURSIVE shard AS (
  SELECT i, ('0x' || substr(md5('offset-' || i), 1, 12))::BIGINT % {TABLE_SIZE} AS off,
         ('0x' || substr(md5('skip-' || i), 1, 12))::BIGINT % {TABLE_SIZE - 1} + 1 AS step
  FROM range({N_SHARDS}) t(i)),
prefs AS (
  SELECT list(list_transform(range({TABLE_SIZE}), lambda k: (off + k * step) % {TABLE_SIZE}) ORDER BY i) AS p FROM shard),
claim AS (
  SELECT 0::BIGINT AS turn, p[1][1] AS slot, 0::BIGINT AS shard,
         list_transform(range({TABLE_SIZE}), lambda x: x = p[1][1]) AS taken FROM prefs
  UNION ALL
  SELECT turn, slot, shard, list_transform(taken, lambda x, i: x OR i = slot + 1) FROM (
    SELECT turn + 1 AS turn, (turn + 1) % {N_SHARDS} AS shard, taken,
           list_filter(p[(turn + 1) % {N_SHARDS} + 1], lambda s: NOT taken[s + 1])[1] AS slot
    FROM claim, prefs WHERE turn + 1 < {TABLE_SIZE}) c),
placed AS (
  SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, chr(0) || 'null')), 1, 12))::BIGINT % {TABLE_SIZE} AS slot
  FROM documents)
SELECT doc_id, placed.slot, claim.shard::INT AS shard FROM placed LEFT JOIN claim ON placed.slot = claim.slot
"""
