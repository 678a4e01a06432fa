"""Consistent placement of keys on shards through a permutation-filled lookup table.

Each shard prefers the slots of a prime-sized table in the order offset, offset + skip, offset + 2 * skip, ... (modulo
the size; offset and skip come from digests of its name). Shards take turns: each claims the first slot on its list that
is still free, until all slots are taken. A key's slot is its digest modulo the size, so placement is one look-up in a
table whose size is fixed, hence safe to broadcast. When a shard leaves, few keys of other shards move.

Keys are compared as text; null keys count as the empty text, and keys of any length are digested whole. Repeated keys go to
the same shard, whatever their number; where two shards prefer a slot, the one whose turn it is has it. An empty table gives
no rows. Extra columns, whatever their names, stay; columns named slot or shard are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracewright.llm.common import table

#: Slots (a prime over 100 times the number of shards) and shard names of the registered query.
SLOTS = 5003
SHARDS = tuple(f"shard-{i:02d}" for i in range(32))
#: Tables beyond this many slots are refused rather than broadcast.
MOST_SLOTS = 1 << 20


def digest60(text: str) -> int:
    """The first 60 bits of the MD5, as key_slot computes them in SQL."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """For each slot the number of the shard that owns it. Its size is the parameter's, whatever the data."""
    if slots < 2 or slots > MOST_SLOTS or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"slots must be a prime up to {MOST_SLOTS}")
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct, at least one, and no more than slots")
    place = [digest60("offset:" + s) % slots for s in shards]
    skip = [digest60("skip:" + s) % (slots - 1) + 1 for s in shards]
    owner = [-1] * slots
    left = slots
    while True:
        for k in range(len(shards)):
            while owner[place[k]] >= 0:
                place[k] = (place[k] + skip[k]) % slots
            owner[place[k]] = k
            left -= 1
            if not left:
                return owner


def key_slot(key: Column, slots: int) -> Column:
    digest = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15)
    return F.pmod(F.conv(digest, 16, 10).cast("long"), F.lit(slots)).cast("int")


def lookup(spark: SparkSession, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """The filled table as rows (slot, shard)."""
    owners = F.split(F.lit(",".join(map(str, fill(shards, slots)))), ",")
    names = F.array(*map(F.lit, shards))
    return spark.range(1).select(F.posexplode(owners).alias("slot", "owner")).select("slot", F.element_at(names, F.col("owner").cast("int") + 1).alias("shard"))


def place(df: DataFrame, key: str, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """The frame's rows with columns slot and shard (columns of these names are replaced)."""
    df = df.drop("slot", "shard")
    table_ = F.broadcast(lookup(df.sparkSession, shards, slots))
    return df.withColumn("slot", key_slot(df[key], slots)).join(table_, "slot", "left")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return place(docs, "doc_id", SHARDS).select("doc_id", "slot", "shard", "n_chars")


def op6_sql() -> str:
    """Placement in SQL over the filled table; the filling itself is tested against a plain simulation."""
    names = ", ".join(f"'{s}'" for s in SHARDS)
    return f"""
WITH placed(slot, shard) AS (
  SELECT unnest(range({SLOTS})), list_extract([{names}], unnest([{", ".join(map(str, fill(SHARDS)))}]) + 1))
SELECT d.doc_id, p.slot::INTEGER AS slot, p.shard, d.n_chars
FROM (SELECT doc_id, n_chars, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {SLOTS} AS slot FROM documents) d
JOIN placed p USING (slot)"""
