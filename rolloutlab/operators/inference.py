"""Paired bootstraps over episodes, all estimators on the same draws.

``PoissonDraws`` need no row per draw: how often a resample holds an episode
is a function of both, with mean and variance one, so every partition adds up
its own episodes for all resamples at once, and means are ratios of such sums.
Tables of draws (``index_draws``) are for results that must agree with given
indices.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .numbering import numbered


#: Draws of an episode are counted up to this; more happen once in 10^12.
MOST_DRAWS = 14
#: Where the counts 1, 2, ... begin on a scale of 2^32: the Poisson distribution of mean one.
POISSON = [int(2**32 * sum(math.exp(-1) / math.factorial(i) for i in range(j + 1))) for j in range(MOST_DRAWS)]
# The constants of a 32-bit finaliser and the step between resamples.
MIX, STRIDE = (0x85EBCA6B, 0xC2B2AE35), 0x9E3779B1
ROWS_AT_ONCE = 4096


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit numbers (held in 64 bits) that leaves no pattern."""
    for shift, factor in ((16, MIX[0]), (13, MIX[1])):
        x = ((x ^ (x >> np.uint64(shift))) * np.uint64(factor)) & np.uint64(0xFFFFFFFF)
    return x ^ (x >> np.uint64(16))


@dataclass(frozen=True)
class PoissonDraws:
    """How often each resample holds an episode: counts of mean one, by two 32-bit hashes of the episode and the number of the resample."""

    resamples: int
    seed: int = 41

    def keys(self, idx: str = "idx") -> list[Column]:
        digest = F.md5(F.concat_ws(":", F.lit(str(self.seed)), F.col(idx).cast("string")).cast("binary"))
        return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"_k{k}") for k in range(2)]

    def counts(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """(episodes, resamples) counts."""
        b = np.arange(self.resamples, dtype=np.uint64) * np.uint64(STRIDE)
        x = mixed((first.astype(np.uint64)[:, None] + b[None]) & np.uint64(0xFFFFFFFF))
        x = mixed((x + second.astype(np.uint64)[:, None]) & np.uint64(0xFFFFFFFF))
        return np.searchsorted(np.array(POISSON, dtype=np.uint64), x, side="right")

    def sql(self, rows: str, key: str, out: str = "slots") -> str:
        """Tables of SQL that end in ``out`` (b, idx), a row per draw of the episodes of ``rows`` (idx, key)."""
        step = lambda x: f"xor(xor(x, x >> 16) * {MIX[0]} % 4294967296, (xor(x, x >> 16) * {MIX[0]} % 4294967296) >> 13) * {MIX[1]} % 4294967296".replace("x,", f"{x},").replace("x >>", f"{x} >>")
        last = lambda x: f"xor({x}, {x} >> 16)"
        return f"""{out}_k AS (SELECT idx, b, ('0x' || substr(h, 1, 8))::UBIGINT AS k, ('0x' || substr(h, 9, 8))::UBIGINT AS l FROM (SELECT idx, md5('{self.seed}:' || {key}) AS h FROM {rows}), (SELECT unnest(range(0, {self.resamples})) AS b)),
{out}_0 AS (SELECT idx, b, l, (k + b::UBIGINT * {STRIDE}) % 4294967296 AS x FROM {out}_k), {out}_1 AS (SELECT idx, b, l, {step('x')} AS x FROM {out}_0), {out}_2 AS (SELECT idx, b, ({last('x')} + l) % 4294967296 AS x FROM {out}_1),
{out}_3 AS (SELECT idx, b, {step('x')} AS x FROM {out}_2), {out}_4 AS (SELECT idx, b, {last('x')} AS x FROM {out}_3), {out} AS (SELECT b, idx, unnest(range(0, {' + '.join(f'CAST(x >= {t} AS INTEGER)' for t in POISSON)})) AS copy FROM {out}_4)"""


def generator_draws(spark: SparkSession, episodes: int, resamples: int, seed: int = 41) -> DataFrame:
    """The same shape from numpy's default generator, for results that must agree with a given index matrix."""
    return index_draws(spark, np.random.default_rng(seed).integers(0, episodes, size=(resamples, episodes)))


def index_draws(spark: SparkSession, indices: np.ndarray) -> DataFrame:
    """(b, idx, m) of a resamples-by-slots matrix of episode numbers."""
    b, idx = np.repeat(np.arange(len(indices)), indices.shape[1]), indices.ravel()
    keys, m = np.unique(np.stack([b, idx]), axis=1, return_counts=True)
    return spark.createDataFrame(pa.table({"b": keys[0].astype(np.int64), "idx": keys[1].astype(np.int64), "m": m.astype(np.int64)}))


def indexed(values: DataFrame, key: str) -> DataFrame:
    """Adds idx: the place of the episode by key."""
    ids = values.select(key).distinct()
    bounds = F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 3), 16, 10).cast("int")
    at = numbered(ids, [], [F.sha2(F.col(key).cast("string"), 256), key], "idx", bounds)
    return values.join(at, key)


def resampled_sums(values: DataFrame, draws: DataFrame | PoissonDraws, columns: Sequence[str]) -> DataFrame:
    """b, m (episodes drawn) and the sum of each column over each resample; ``values`` has one row per idx.

    Under Poisson draws every task adds up all resamples of its own episodes:
    it holds some thousand at a time and gives one row per resample. A table of
    draws is joined by idx.
    """
    names = list(columns)
    if not isinstance(draws, PoissonDraws):
        met = draws.join(values.select("idx", *names), "idx")
        return met.groupBy("b").agg(F.sum("m").alias("m"), *[F.sum(F.col(c) * F.col("m")).alias(c) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((draws.resamples, len(names) + 1))
        for batch in batches:
            for s in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(s, ROWS_AT_ONCE)
                k = [part.column(f"_k{i}").to_numpy(zero_copy_only=False) for i in range(2)]
                x = np.column_stack([np.ones(part.num_rows), *[part.column(f"_v{i}").to_numpy(zero_copy_only=False) for i in range(len(names))]]).astype(float)
                total += draws.counts(*k).T.astype(float) @ x
        yield pa.RecordBatch.from_pydict({"b": pa.array(range(draws.resamples), pa.int64()), "m": pa.array(total[:, 0]), **{f"_v{i}": pa.array(total[:, i + 1]) for i in range(len(names))}})

    rows = values.select(*draws.keys(), *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(names)])
    parts = rows.mapInArrow(run, "b long, m double, " + ", ".join(f"_v{i} double" for i in range(len(names))))
    return parts.groupBy("b").agg(F.sum("m").alias("m"), *[F.sum(f"_v{i}").alias(c) for i, c in enumerate(names)])


def resampled_means(values: DataFrame, draws: DataFrame | PoissonDraws, columns: Sequence[str]) -> DataFrame:
    """b and the mean of each column over each resample, null where it drew nothing; ``values`` has one row per idx."""
    return resampled_sums(values, draws, columns).select("b", *[F.try_divide(F.col(c), F.col("m")).alias(c) for c in columns])


def bootstrap_samples(values: DataFrame, draws: DataFrame | PoissonDraws, policies: Sequence[str], baseline: str) -> DataFrame:
    """b, policy, value, difference: the mean of every resample, and what it is above the baseline's."""
    rows = F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), F.col(p).alias("value"), (F.col(p) - F.col(baseline)).alias("difference")) for p in policies]))
    return resampled_means(values, draws, policies).select("b", rows.alias("_x")).select("b", "_x.*")


def summarised(samples: DataFrame, horizon: int, confidence: float = 0.95) -> DataFrame:
    """Per policy of bootstrap samples: interval of the total and per decision."""
    low, high = (1 - confidence) / 2, 1 - (1 - confidence) / 2
    out = samples.groupBy("policy").agg(F.percentile("value", F.lit(low)).alias("low"), F.percentile("value", F.lit(high)).alias("high"))
    return out.withColumns({"low_per_decision": F.col("low") / horizon, "high_per_decision": F.col("high") / horizon})


def raw_availability(values: DataFrame, draws: DataFrame | PoissonDraws, policies: Sequence[str], baseline: str, confidence: float = 0.95) -> DataFrame:
    """Per policy of unclipped values (null, NaN or infinite where weights overflow): available, finite_fraction, reason, and what the bootstrap says.

    A policy with a value that isn't finite has no estimate; it isn't clipped.
    Differences need an available baseline, too.
    """
    facts = values.agg(*[F.avg(F.coalesce(~F.isnan(p) & (F.abs(p) != float("inf")), F.lit(False)).cast("double")).alias(p) for p in policies]).first()  # one row
    share = {p: facts[p] or 0.0 for p in policies}
    usable = [p for p in policies if share[p] == 1.0]
    kind = "policy string, available boolean, finite_fraction double, reason string, difference_reason string"
    rows = [(p, p in usable, share[p], None if p in usable else "an unclipped weight gave a value that is not finite",
             None if p in usable and baseline in usable else "no estimate" if p not in usable else "the baseline has no estimate") for p in policies]
    table = values.sparkSession.createDataFrame(rows, kind)
    if not usable:
        return table.select("*", *[F.lit(None).cast("double").alias(c) for c in ("mean", "difference", "low", "high", "difference_low", "difference_high")])
    found = paired_bootstrap(values, draws, usable, baseline if baseline in usable else usable[0], confidence)
    if baseline not in usable:
        found = found.withColumns({c: F.lit(None).cast("double") for c in ("difference", "difference_low", "difference_high")})
    return table.join(found, "policy", "left")


def block_sums(values: DataFrame, columns: Sequence[str], resamples: int, blocks: int, seed: int = 41) -> DataFrame:
    """b, and per column the sum over resample b, its size ``m``: multinomial draws of any number of episodes without a row per draw.

    Episodes are dealt into blocks by hash. How many of a resample's draws fall
    to each block is drawn first, by block size; each block then draws its own,
    and one row per block and resample leaves it. ``values`` has one row per
    episode.
    """
    names = list(columns)
    dealt = values.select(F.pmod(F.xxhash64("idx"), F.lit(blocks)).cast("int").alias("block"), "idx", *names)
    sizes = np.zeros(blocks, dtype=np.int64)
    for row in dealt.groupBy("block").count().collect():  # one row per block
        sizes[row["block"]] = row["count"]
    n = int(sizes.sum())
    shares = np.random.default_rng(seed).multinomial(n, sizes / max(1, n), size=resamples)

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        block = int(key[0])
        v = frame.sort_values("idx")[names].to_numpy(dtype=float)
        out = np.zeros((resamples, len(names)))
        for b in range(resamples):
            m = np.random.default_rng((seed, b, block)).multinomial(shares[b, block], np.full(len(v), 1 / len(v)))
            out[b] = m @ v
        return pd.DataFrame({"b": np.arange(resamples), "m": shares[:, block], **{c: out[:, i] for i, c in enumerate(names)}})

    parts = dealt.groupBy("block").applyInPandas(run, "b long, m long, " + ", ".join(f"{c} double" for c in names))
    return parts.groupBy("b").agg(F.sum("m").alias("m"), *[F.sum(c).alias(c) for c in names])


def permuted_rows(df: DataFrame, order: Sequence[str], column: str, seed: int = 41) -> DataFrame:
    """``column`` dealt anew over the rows: the row at place i by key gets the value of the row at place i by hash."""
    from .numbering import text_bucket

    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), *order), 256)
    rows = df.withColumn("_d", digest)
    own = numbered(rows, [], order, "_i", text_bucket(df, order[0]))
    other = numbered(rows.select("_d", *order, F.col(column).alias("_moved")), [], ["_d", *order], "_i", F.conv(F.substring("_d", 1, 3), 16, 10).cast("int")).select("_i", "_moved")
    return own.join(other, "_i").withColumn(column, F.col("_moved")).drop("_i", "_moved", "_d")


def paired_bootstrap(values: DataFrame, draws: DataFrame | PoissonDraws, policies: Sequence[str], baseline: str, confidence: float = 0.95) -> DataFrame:
    """Per policy: mean, difference from the baseline, and percentile intervals of both."""
    if not 0 < confidence < 1 or baseline not in policies:
        raise ValueError("confidence must lie between 0 and 1, the baseline among the policies")
    low, high = (1 - confidence) / 2, 1 - (1 - confidence) / 2
    samples = resampled_means(values, draws, policies)
    point = values.agg(*[F.avg(p).alias(p) for p in policies])

    def long(df: DataFrame, key: list[str]) -> DataFrame:
        rows = F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), F.col(p).alias("v"), (F.col(p) - F.col(baseline)).alias("d")) for p in policies]))
        return df.select(*key, rows.alias("_x")).select(*key, "_x.*")

    spread = long(samples, ["b"]).groupBy("policy").agg(*[F.percentile(c, F.lit(q)).alias(n) for c, q, n in
                                                          (("v", low, "low"), ("v", high, "high"), ("d", low, "difference_low"), ("d", high, "difference_high"))])
    return long(point, []).select("policy", F.col("v").alias("mean"), F.col("d").alias("difference")).join(spread, "policy")


def paired_gap(values: DataFrame, draws: DataFrame | PoissonDraws, left: str, right: str, confidence: float = 0.95) -> DataFrame:
    """One row: mean gap, its interval and standard error, and whether the interval excludes zero."""
    gaps = values.withColumn("gap", F.col(left) - F.col(right))
    low, high = (1 - confidence) / 2, 1 - (1 - confidence) / 2
    point = gaps.agg(F.avg("gap").alias("point"), F.count("*").alias("episodes")).first()
    spread = resampled_means(gaps, draws, ["gap"]).agg(F.percentile("gap", F.lit(low)).alias("low"), F.percentile("gap", F.lit(high)).alias("high"),
                                                       F.stddev_samp("gap").alias("standard_error"), F.count("*").alias("resamples"))
    return spread.select(F.lit(point["point"]).alias("point"), "low", "high", "standard_error", ((F.col("low") > 0) | (F.col("high") < 0)).alias("excludes_zero"),
                         F.lit(point["episodes"]).cast("long").alias("episodes"), "resamples")


def contrasts(policies: Sequence[str]) -> list[tuple[str, str]]:
    """Unordered pairs in canonical order."""
    return [(a, b) for i, a in enumerate(policies) for b in policies[i + 1:]]


def max_t(values: DataFrame, draws: DataFrame | PoissonDraws, policies: Sequence[str], estimators: Sequence[str], confidence: float = 0.95) -> DataFrame:
    """Simultaneous intervals of all policy pairs under all estimators: one critical value from the largest studentised error of each draw.

    ``values`` has a column <estimator>_<policy> and one row per idx. A
    contrast without bootstrap variance counts as known. The critical value is
    the order statistic at or above the quantile.
    """
    family = [(e, a, b) for e in estimators for a, b in contrasts(policies)]
    names = [f"c{i}" for i in range(len(family))]
    wide = values.select("idx", *[(F.col(f"{e}_{a}") - F.col(f"{e}_{b}")).alias(n) for n, (e, a, b) in zip(names, family)])
    samples = resampled_means(wide, draws, names)
    facts = wide.agg(*[F.avg(n).alias(n) for n in names]).first()
    errors = samples.agg(*[F.stddev_samp(n).alias(n) for n in names], F.count("*").alias("_b")).first()
    scaled = [F.abs((F.col(n) - facts[n]) / errors[n]) if errors[n] else F.lit(0.0) for n in names]
    rank = int(np.ceil(confidence * (errors["_b"] - 1)))
    tops = samples.select(F.greatest(*scaled, F.lit(0.0)).alias("t"))
    at = F.row_number().over(Window.orderBy("t"))  # one row per resample
    critical = tops.withColumn("_at", at).filter(F.col("_at") == rank + 1).first()["t"]
    rows = [(e, a, b, facts[n], errors[n], facts[n] - critical * errors[n], facts[n] + critical * errors[n], critical) for n, (e, a, b) in zip(names, family)]
    return values.sparkSession.createDataFrame(rows, "estimator string, left_policy string, right_policy string, point double, standard_error double, low double, high double, critical double")


def directed(intervals: DataFrame) -> DataFrame:
    """Every contrast both ways: turned round, its sign and its ends swap."""
    turned = intervals.select("estimator", F.col("right_policy").alias("left_policy"), F.col("left_policy").alias("right_policy"), (-F.col("point")).alias("point"),
                              "standard_error", (-F.col("high")).alias("low"), (-F.col("low")).alias("high"), "critical")
    return intervals.unionByName(turned)


def cluster_shift(df: DataFrame, before: str, after: str, cluster: str, draws: DataFrame | PoissonDraws) -> DataFrame:
    """Per action: mean signed shift of probability and its 95 % interval over resampled clusters; clusters are summed once, then resampled.

    ``df`` has idx, the number of the cluster.
    """
    n = 3
    sums = df.groupBy("idx").agg(*[F.sum(F.col(after)[i] - F.col(before)[i]).alias(f"s{i}") for i in range(n)], F.count("*").alias("n"))
    met = resampled_sums(sums, draws, [*[f"s{i}" for i in range(n)], "n"]).select("b", *[F.try_divide(F.col(f"s{i}"), F.col("n")).alias(f"s{i}") for i in range(n)])
    point = df.agg(*[F.avg(F.col(after)[i] - F.col(before)[i]).alias(f"s{i}") for i in range(n)])

    def long(x: DataFrame) -> DataFrame:
        return x.select(F.explode(F.array(*[F.struct(F.lit(i).alias("action_no"), F.col(f"s{i}").alias("shift")) for i in range(n)])).alias("_x")).select("_x.*")

    spread = long(met).groupBy("action_no").agg(F.percentile("shift", F.lit(0.025)).alias("low"), F.percentile("shift", F.lit(0.975)).alias("high"))
    return long(point).withColumnRenamed("shift", "mean_shift").join(spread, "action_no")
