"""Deterministic roles and folds of episodes by hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.digests import line_digest
from ..operators.numbering import numbered, text_bucket
from ..schema import EPISODE

DEVELOPMENT, NUISANCE = "policy_development", "ope_nuisance"


def digest(seed: int, key: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def training_roles(df: DataFrame, fraction: float = 0.6, seed: int = 41, key: str = EPISODE) -> DataFrame:
    """key and role: episodes with the smallest digests develop policies, the others fit nuisances; both roles get one at least.

    Ranks come from a two-level count over digest prefixes, so that no task
    sorts all episodes.
    """
    if not 0 < fraction < 1:
        raise ValueError("the fraction must lie between 0 and 1")
    ids = df.select(F.col(key).cast("string").alias(key)).filter(F.col(key).isNotNull()).distinct().withColumn("_d", digest(seed, F.col(key)))
    ranked = numbered(ids, [], ["_d", key], "_rank", F.conv(F.substring("_d", 1, 3), 16, 10).cast("int"))
    n = ids.count()
    take = min(n - 1, max(1, round(fraction * n)))
    return ranked.select(key, F.when(F.col("_rank") < take, DEVELOPMENT).otherwise(NUISANCE).alias("role"))


def manifest(roles: DataFrame, key: str = EPISODE) -> DataFrame:
    """One row: episodes per role and the SHA-256 of the sorted ``id,role`` lines."""
    counts = roles.agg(F.coalesce(F.sum((F.col("role") == DEVELOPMENT).cast("long")), F.lit(0)).alias("development"), F.coalesce(F.sum((F.col("role") == NUISANCE).cast("long")), F.lit(0)).alias("nuisance"))
    lines = roles.select(F.concat_ws(",", key, "role").alias("_text"))
    return counts.crossJoin(line_digest(lines, ["_text"], F.col("_text"), "\n", "checksum").select("checksum"))  # one row each


def dealing(sizes: Sequence[tuple[int, int]], k: int) -> list[tuple[int, list[int], list[int]]]:
    """How to deal (size, how many) to the fold with the fewest rows, largest first: size, the folds of the first ones, and the folds that the rest take in turn."""
    load, out = [0] * k, []
    for size, n in sorted(sizes, reverse=True):
        head: list[int] = []
        while len(head) < n and max(load) - min(load) >= size:
            at = load.index(min(load))
            head.append(at)
            load[at] += size
        # folds are less than one size apart: from here on each takes one before any takes two
        turn, left = sorted(range(k), key=lambda f: (load[f], f)), n - len(head)
        for j, f in enumerate(turn):
            load[f] += size * (left // k + (j < left % k))
        out.append((size, head, turn))
    return out


def folds(df: DataFrame, k: int, key: str = EPISODE) -> DataFrame:
    """key and fold: episodes by size, then key, each to the fold with the fewest rows so far.

    One row per distinct size comes to the driver; episodes of a size are
    numbered in two levels.
    """
    ids = df.groupBy(F.col(key).cast("string").alias(key)).agg(F.count("*").alias("_n"))
    plan = dealing([(r["_n"], r["count"]) for r in ids.groupBy("_n").count().collect()], k)
    table = df.sparkSession.createDataFrame(plan, "_size long, _head array<int>, _turn array<int>")
    placed = numbered(ids, ["_n"], [key], "_at", text_bucket(ids, key)).join(F.broadcast(table), F.col("_n") == F.col("_size"))  # a row per size
    rest = F.col("_at") - F.size("_head")
    return placed.select(key, F.when(rest < 0, F.get("_head", F.col("_at").cast("int"))).otherwise(F.get("_turn", F.pmod(rest, F.lit(k)).cast("int"))).alias("fold"))


def checksum(df: DataFrame, key: str = EPISODE) -> DataFrame:
    """One row: SHA-256 of the sorted distinct keys, one per line."""
    ids = df.select(F.col(key).cast("string").alias("_text")).filter("_text is not null").distinct()
    return line_digest(ids, ["_text"], F.col("_text"), "\n", "checksum").select("checksum")
