"""Jump consistent hashing: stable keys to shards without a ring table (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_bucket, ranked

#: Fixed values of the published jump consistent hash: the multiplier of its generator.
MULTIPLIER = 2862933555777941757
_LO, _HI, _M32, _M16 = MULTIPLIER & 0xFFFFFFFF, MULTIPLIER >> 32, 0xFFFFFFFF, 0xFFFF


def _low32(x: Column, y: int) -> Column:
    """The low 32 bits of a product of two 32-bit numbers, without overflow of a signed long."""
    return (x.bitwiseAND(_M16) * y + F.shiftleft((F.shiftright(x, 16) * y).bitwiseAND(_M16), 16)).bitwiseAND(_M32)


def _step(s: Column, n: int) -> Column:
    """One jump: the generator's next 64-bit state (as two 32-bit halves) and the next bucket."""
    upper = F.shiftright(s["lo"], 16) * _LO
    lower = s["lo"].bitwiseAND(_M16) * _LO + F.shiftleft(upper.bitwiseAND(_M16), 16) + 1
    carry = F.shiftright(lower, 32) + F.shiftright(upper, 16)
    hi = (carry + _low32(s["lo"], _HI) + _low32(s["hi"], _LO)).bitwiseAND(_M32)
    b = s["j"]
    nxt = F.struct(
        lower.bitwiseAND(_M32).alias("lo"),
        hi.alias("hi"),
        F.when(b < n, b).otherwise(s["small"]).alias("small"),
        b.alias("large"),
        F.floor((b + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(hi, 1) + 1).cast("double"))).cast("long").alias("j"),
    )
    return F.when(b <= n, nxt).otherwise(s)


def jump(key: Column, n_shards: int) -> Column:
    """struct(small, large): the shard of a long key among ``n_shards`` and among ``n_shards + 1``.

    At most ``n_shards + 1`` jumps are possible and about ln(n_shards) are made; later rounds pass the state on.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    zero = F.lit(0).cast("long")
    start = F.struct(key.bitwiseAND(_M32).alias("lo"), F.shiftrightunsigned(key, 32).alias("hi"), zero.alias("small"), zero.alias("large"), zero.alias("j"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(n_shards)), start, lambda s, _: _step(s, n_shards))


def assign_shards(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of ``docs`` (doc_id, text).

    The law is ``key``: the id and the shard count alone decide, and with one more shard
    (grown_shard) rows move only into the new one. A null text has size 16 and checksum 0; a
    null id hashes as 0. Rows with equal ids stay together. Slots run from 0 without gaps in
    each shard, by the MD5 bucket of the id, id, checksum and size, so a shard is sorted in
    256 pieces by as many tasks. Other columns are ignored. An empty table gives no rows.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long"))
    raw = F.encode(F.coalesce(F.col("text"), F.lit("")), "utf-8")
    rows = docs.select("doc_id", "text").withColumn("__j", jump(key, n_shards))
    rows = rows.select(
        "doc_id",
        (F.octet_length(raw) + 16).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.lit("key").alias("law"),
        F.col("__j.small").cast("int").alias("shard"),
        F.col("__j.large").cast("int").alias("grown_shard"),
    )
    out = ranked(rows, ["shard"], id_bucket(F.col("doc_id")), ["doc_id", "text_crc32", "size"], "slot")
    return out.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
