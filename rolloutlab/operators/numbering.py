"""Gapless numbers without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Buckets of text keys, and the keys that balance them.
PARTS, SAMPLED = 256, 8192


def place_in(cuts: Column, n: Column | int, value: Column, most: int) -> Column:
    """How many of the sorted ``cuts`` (n, ``most`` at most) the value isn't below; a binary search."""
    widths = F.array(*[F.lit(1 << k) for k in range(most.bit_length() - 1, -1, -1)])
    return F.aggregate(widths, F.lit(0), lambda low, w: F.when((low + w <= n) & (F.get(cuts, low + w - 1) <= value), low + w).otherwise(low))


def text_bucket(df: DataFrame, key: str, parts: int = PARTS) -> Column:
    """A bucket number of text keys that never falls as the key rises.

    The cuts come from a sample of about SAMPLED rows by hash of the key; only
    how even the buckets are hangs on it.
    """
    n = max(1, df.count())
    drawn = F.pmod(F.xxhash64(key), F.lit(1_000_003)) * n < F.lit(1_000_003 * SAMPLED)
    found = sorted({r[0] for r in df.filter(F.col(key).isNotNull() & drawn).select(F.col(key).cast("string")).limit(4 * SAMPLED).collect()}, key=str.encode)
    cuts = list(dict.fromkeys(found[len(found) * k // parts] for k in range(1, parts))) if found else []
    if not cuts:
        return F.lit(0)
    return place_in(F.array(*map(F.lit, cuts)), len(cuts), F.col(key).cast("string"), len(cuts))


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], out: str, bucket: Column) -> DataFrame:
    """Adds the position from 0 in each key's group; ``bucket`` must not fall as ``order`` rises.

    Rows are numbered in each (key, bucket) and start after the count of the
    buckets before; only those counts, one row per bucket, are gathered.
    """
    part = df.withColumn("_bucket", bucket)
    by = [*keys, "_bucket"]
    counts = part.groupBy(*by).agg(F.count("*").alias("_count"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*[F.col(k).alias(f"_of_{k}") for k in by], F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_base"))
    local = part.withColumn("_local", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
    on = F.lit(True)
    for k in by:
        on = on & local[k].eqNullSafe(counts[f"_of_{k}"])
    return local.join(counts, on).withColumn(out, (F.col("_base") + F.col("_local")).cast("long")).drop("_bucket", "_base", "_local", *[f"_of_{k}" for k in by])
