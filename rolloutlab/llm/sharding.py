"""Sharding by jump consistent hashing (native).

A key jumps forward through the shards it would have moved to as the shard
count grew one by one; its shard is the last jump below the count. No ring
table exists, and adding a shard moves only the rows that land in it
(Lamping and Veach, 2014).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered

SLOT_BUCKETS = 1024

# Multiplier of the published generator.
MULTIPLIER = "2862933555777941757"
TWO_64 = "18446744073709551616"


def jumps(key: Column, shards: int) -> Column:
    """struct<shard, next> of a long key among ``shards``: its shard, and where it would jump to as shards are appended; a null key counts as -1.

    The 64-bit generator wraps, which ANSI arithmetic refuses, so its state is
    a decimal taken modulo 2^64. A key makes about ln(shards) jumps; after
    three times that and some more the rare rest goes on for as many rounds as
    there are shards, which are enough, as every jump moves ahead by one.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    state = F.pmod(F.coalesce(key, F.lit(-1)).cast("decimal(20,0)"), F.lit(TWO_64).cast("decimal(20,0)"))
    start = F.struct(state.cast("decimal(20,0)").alias("key"), F.lit(-1).cast("long").alias("shard"), F.lit(0).cast("long").alias("next"))

    def jump(at: Column, _: Column) -> Column:
        grown = ((at["key"] * F.lit(MULTIPLIER).cast("decimal(19,0)")).cast("decimal(38,0)") + F.lit(1)).cast("decimal(38,0)")
        drawn = F.pmod(grown, F.lit(TWO_64).cast("decimal(20,0)")).cast("decimal(20,0)")
        top = F.floor(drawn / F.lit(2**33).cast("decimal(10,0)")).cast("double") + F.lit(1.0)
        ahead = F.floor((at["next"].cast("double") + 1.0) * (F.lit(float(2**31)) / top)).cast("long")
        moved = F.struct(drawn.alias("key"), at["next"].alias("shard"), ahead.alias("next"))
        return F.when(at["next"] < shards, moved).otherwise(at)

    def ended(at: Column) -> Column:
        return F.struct(at["shard"].cast("int").alias("shard"), at["next"].alias("next"))

    few = min(shards, 20 + int(3 * math.log(shards)))
    if few == shards:
        return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, jump, ended)
    rest = lambda at: F.when(at["next"] >= shards, ended(at)).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(shards)), at, jump, ended))
    return F.aggregate(F.sequence(F.lit(1), F.lit(few)), start, jump, rest)


def jump_hash(key: Column, shards: int) -> Column:
    """The shard of a long key among ``shards``."""
    return jumps(key, shards)["shard"]


def shard_documents(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with its shard under the law ``key`` and its slot there.

    Size is the UTF-8 length of the text (null: none) plus 8. Equal keys, also
    null ones, share a shard; repeated rows get slots of their own. Empty
    input gives no rows; extra columns are left out. Only sizes and checksums
    are shuffled, and a shard's slots are numbered in sub-buckets, so no task
    holds a whole shard.
    """
    data = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(data) + F.lit(8)).cast("long").alias("size"),
        F.crc32(F.encode(data, "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
        jumps(F.col(key), shards).alias("_jump"),
    )
    # with one shard more a key moves only if its next jump lands right there
    moved = F.when(F.col("_jump.next") == shards, F.lit(shards)).otherwise(F.col("_jump.shard"))
    rows = rows.withColumns({"shard": F.col("_jump.shard"), "grown_shard": moved}).drop("_jump")
    bucket = F.coalesce(F.pmod(F.col("doc_id"), F.lit(SLOT_BUCKETS)).cast("int"), F.lit(-1))
    out = numbered(rows, ["shard"], ["doc_id", "size", "text_crc32"], "slot", bucket)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = 24, key: str = "doc_id", by: str = "shard") -> None:
    """Write documents as Parquet, one folder ``by``=number per shard; files of a shard stay bounded in rows.

    A column of the name ``by`` in the input raises: choose another. Rows
    without a key share a shard, repeated rows stay rows; an empty input
    writes no folder.
    """
    if by in docs.columns:
        raise ValueError(f"the input has a column {by}; name the folders otherwise")
    salt = F.pmod(F.xxhash64(*docs.columns), F.lit(64))
    (docs.withColumn(by, jump_hash(F.col(key), shards)).repartition(F.col(by), salt)
     .write.option("maxRecordsPerFile", 1_000_000).partitionBy(by).parquet(path))
