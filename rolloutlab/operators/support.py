"""Overlap of target and behaviour, and how concentrated the weights are."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import INFINITY, LARGEST_EXPONENT, entropy, expectation, mass_below, overlap, safe_exp
from ..plans.validation import finite
from ..schema import ACTIONS, EPISODE, STEP
from .quantiles import exact_quantiles
from .sdr import cap_name, cumulative_weights

#: Quantiles of weights and ratios, besides the maximum.
QUANTILES = (0.5, 0.9, 0.95, 0.99)


def concentration(df: DataFrame, log_weight: str, keys: Sequence[str]) -> DataFrame:
    """keys, ess, max_share: effective sample size and largest share, from log-weights.

    Both are free of scale: weights are taken relative to the group's largest.
    With infinite weights these alone count; with none positive both are 0.
    """
    lw = F.col(log_weight)
    tops = df.groupBy(*keys).agg(F.max(log_weight).alias("_top"))
    named = tops.select(*[F.col(k).alias(f"_of_{k}") for k in keys], "_top")
    on = F.lit(True)
    for k in keys:
        on = on & df[k].eqNullSafe(named[f"_of_{k}"])
    shifted = F.when(lw == F.col("_top"), F.lit(1.0)).when(F.col("_top") == INFINITY, F.lit(0.0)).otherwise(F.exp(lw - F.col("_top")))
    w = F.when(F.col("_top") == -INFINITY, F.lit(0.0)).otherwise(shifted)
    sums = df.join(named, on).withColumn("_w", w).groupBy(*keys).agg(F.sum("_w").alias("_s"), F.sum(F.col("_w") * F.col("_w")).alias("_q"))
    return sums.select(*keys, F.coalesce(F.try_divide(F.col("_s") * F.col("_s"), F.col("_q")), F.lit(0.0)).alias("ess"),
                       F.coalesce(F.try_divide(F.lit(1.0), F.col("_s")), F.lit(0.0)).alias("max_share"))


def finite_quantiles(df: DataFrame, value: Column, keys: Sequence[str], prefix: str = "") -> DataFrame:
    """keys and the exact quantiles and the maximum of the finite values; groups without one have no row."""
    named = {f"{prefix}p{round(q * 100)}": q for q in QUANTILES} | {f"{prefix}max": 1.0}
    return exact_quantiles(df, F.when(finite(value), value), keys, named)


def weight_summary(df: DataFrame, log_weight: str, keys: Sequence[str]) -> DataFrame:
    """keys, overflow_count, linear_scale_valid, zero_fraction and the weights' quantiles (null once one overflows), also on the log scale."""
    lw = F.col(log_weight)
    over = F.sum((lw > LARGEST_EXPONENT).cast("long"))
    out = df.groupBy(*keys).agg(over.alias("overflow_count"), F.avg((lw == -INFINITY).cast("double")).alias("zero_fraction"))
    for part in (finite_quantiles(df, lw, keys, "log_"), finite_quantiles(df, safe_exp(lw), keys)):
        out = out.join(part.withColumnsRenamed({k: f"_of_{k}" for k in keys}), reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys], F.lit(True)), "left").drop(*[f"_of_{k}" for k in keys])
    valid = F.col("overflow_count") == 0
    plain = [f"p{round(q * 100)}" for q in QUANTILES] + ["max"]
    return out.withColumns({c: F.when(valid, F.col(c)) for c in plain}).withColumn("linear_scale_valid", valid)


def support_report(df: DataFrame, caps: Sequence[float], thresholds: Sequence[float] = (0.01, 0.05), low_pressure: float = 65.0) -> dict[str, DataFrame]:
    """All that is known of a policy's support: ``state``, ``low_pressure`` (the slice under that), ``actions``, ``ratios`` (quantiles of
    target over behaviour) and ``weights`` (by step and cap, null for none: effective sample size, largest share, quantiles)."""
    weighted = cumulative_weights(df, caps)
    weights = None
    for cap in (None, *caps):
        column = "log_w" if cap is None else f"log_w_{cap_name(cap)}"
        part = concentration(weighted, column, [STEP]).join(weight_summary(weighted, column, [STEP]), STEP).withColumn("cap", F.lit(cap).cast("double"))
        weights = part if weights is None else weights.unionByName(part)
    return {"state": state_support(df, (), thresholds=thresholds), "low_pressure": slice_support(df, F.col("map_mm_hg") < low_pressure, thresholds=thresholds), "actions": action_support(df),
            "ratios": finite_quantiles(weighted, F.col("ratio"), []), "weights": weights}


def state_support(df: DataFrame, keys: Sequence[str] = (), target: str = "target", behavior: str = "behavior", thresholds: Sequence[float] = (0.01, 0.05)) -> DataFrame:
    """keys, mean target distribution, entropy, overlap, behaviour under the target, and target mass where behaviour is rare."""
    p, b = F.col(target), F.col(behavior)
    marks = [F.avg(mass_below(p, b, t)).alias(f"mass_below_{t:g}".replace(".", "_")) for t in thresholds]
    return df.groupBy(*keys).agg(
        F.count("*").alias("rows"), *[F.avg(p[i]).alias(f"target_{a}") for i, a in enumerate(ACTIONS)], F.avg(entropy(p)).alias("mean_entropy"),
        F.avg(overlap(p, b)).alias("mean_overlap"), F.avg(expectation(p, b)).alias("mean_behavior_under_target"), *marks)


def action_support(df: DataFrame, target: str = "target", behavior: str = "behavior", action: str = "action_no", threshold: float = 0.01) -> DataFrame:
    """One row per action: how often it is logged, mean and least behaviour, mean target, share of rows with rare behaviour."""
    one = F.explode(F.array(*[F.struct(F.lit(i).alias("no"), F.lit(a).alias("action"), F.col(target)[i].alias("p"), F.col(behavior)[i].alias("b"))
                              for i, a in enumerate(ACTIONS)]))
    rows = df.select(F.col(action).alias("logged"), one.alias("_x")).select("logged", "_x.*")
    return rows.groupBy("action").agg(
        F.sum((F.col("logged") == F.col("no")).cast("long")).alias("logged_rows"), F.avg("p").alias("mean_target"), F.avg("b").alias("mean_behavior"),
        F.min("b").alias("min_behavior"), F.avg((F.col("b") < threshold).cast("double")).alias("rare_fraction"))


def slice_support(df: DataFrame, condition: Column, **how) -> DataFrame:
    """State support within a slice, with its episodes and its share of all rows."""
    marked = df.withColumn("_in", F.coalesce(condition, F.lit(False)))
    share = marked.agg(F.avg(F.col("_in").cast("double")).alias("fraction"), F.countDistinct(F.when(F.col("_in"), F.col(EPISODE))).alias("episodes"))
    one = share.first()
    return state_support(marked.filter("_in"), **how).withColumns({"fraction": F.lit(one["fraction"]), "episodes": F.lit(one["episodes"]).cast("long")})
