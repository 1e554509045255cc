"""Calibration, decision rules, reward shortcuts, agreement and state dependence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import N, Reward, gather, items, margin, top_action, total, total_variation
from ..schema import ACTION, ACTIONS, EVENTS
from ..sources.files import settled
from .quantiles import exact_quantiles


def log_loss(p: Column, action_no: Column) -> Column:
    """Per row; probabilities under 1e-15 count as that."""
    return -F.ln(F.least(F.greatest(gather(p, action_no), F.lit(1e-15)), F.lit(1.0)))


def brier(p: Column, action_no: Column) -> Column:
    return total([(x - F.when(action_no == i, 1.0).otherwise(0.0)) * (x - F.when(action_no == i, 1.0).otherwise(0.0)) for i, x in enumerate(items(p))])


def left_closed_bin(x: Column, bins: int) -> Column:
    """Number of the bin [lower, upper), the last closed; by comparison with the edges."""
    return total([F.when(x >= i / bins, 1).otherwise(0) for i in range(1, bins)])


def right_closed_bin(x: Column, bins: int) -> Column:
    """Number of the bin (lower, upper], 0 in the first."""
    return total([F.when(x > i / bins, 1).otherwise(0) for i in range(1, bins)])


def calibration_bins(df: DataFrame, p: str, action_no: str, keys: Sequence[str] = (), bins: int = 10, right_closed: bool = False) -> DataFrame:
    """keys, bin, rows, mean confidence and accuracy of the top action."""
    confidence = F.array_max(F.col(p))
    number = right_closed_bin(confidence, bins) if right_closed else left_closed_bin(confidence, bins)
    hit = (top_action(F.col(p)) == F.col(action_no)).cast("double")
    return df.groupBy(*keys, number.alias("bin")).agg(F.count("*").alias("rows"), F.avg(confidence).alias("confidence"), F.avg(hit).alias("accuracy"))


def calibration(df: DataFrame, p: str, action_no: str, keys: Sequence[str] = (), bins: int = 10, right_closed: bool = False) -> DataFrame:
    """keys, rows, log_loss, brier, accuracy, ece."""
    c = F.col(p)
    base = df.groupBy(*keys).agg(F.count("*").alias("rows"), F.avg(log_loss(c, F.col(action_no))).alias("log_loss"), F.avg(brier(c, F.col(action_no))).alias("brier"),
                                 F.avg((top_action(c) == F.col(action_no)).cast("double")).alias("accuracy"))
    table = calibration_bins(df, p, action_no, keys, bins, right_closed)
    ece = table.groupBy(*keys).agg((F.sum(F.col("rows") * F.abs(F.col("accuracy") - F.col("confidence"))) / F.sum("rows")).alias("ece"))
    return base.join(ece, list(keys)) if keys else base.withColumn("ece", F.lit(ece.first()["ece"]))


def decision_rule(df: DataFrame, p: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, rows, how often each action is the top one, least and mean margin to the second."""
    best = top_action(F.col(p))
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), *[F.sum((best == i).cast("long")).alias(f"top_{a}") for i, a in enumerate(ACTIONS)],
                                 F.min(margin(F.col(p))).alias("min_margin"), F.avg(margin(F.col(p))).alias("mean_margin"))


def reward_components(df: DataFrame, reward: Reward, keep: Sequence[str]) -> DataFrame:
    return df.select(*keep, *[c.alias(n) for n, c in reward.components().items()], reward.total().alias("total_reward"))


def reward_shortcut(df: DataFrame, reward: Reward) -> DataFrame:
    """Per slice (all rows, pressure above 75): escalate less maintain in reward, its pressure part and event rates; the part's share is null at no gap."""
    parts = reward.components()
    rows = df.select("map_mm_hg", F.col(ACTION).alias("action"), reward.total().alias("reward"), parts["map_component"].alias("map_part"),
                     F.col(EVENTS[0]).alias("deterioration"), F.col(EVENTS[3]).alias("tachyarrhythmia"))
    slices = F.when(F.col("map_mm_hg") > 75, F.array(F.lit("all_rows"), F.lit("map_above_75"))).otherwise(F.array(F.lit("all_rows")))
    rows = rows.withColumn("slice", F.explode(slices))

    def gap(c: str) -> Column:
        return F.avg(F.when(F.col("action") == ACTIONS[2], F.col(c))) - F.avg(F.when(F.col("action") == ACTIONS[0], F.col(c)))

    out = rows.groupBy("slice").agg(F.count("*").alias("rows"), *[gap(c).alias(f"{c}_gap") for c in ("reward", "map_part", "deterioration", "tachyarrhythmia")])
    return out.withColumn("map_share", F.when(F.abs(F.col("reward_gap")) > 1e-8, F.try_divide("map_part_gap", "reward_gap")))


def agreement(df: DataFrame, left: str, right: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, rows, share and count of top-action (dis)agreement, mean total variation."""
    same = (top_action(F.col(left)) == top_action(F.col(right))).cast("double")
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), F.avg(same).alias("agreement"), F.sum(1 - same).cast("long").alias("disagreements"),
                                 F.avg(total_variation(F.col(left), F.col(right))).alias("mean_tv"))


def state_dependence(df: DataFrame, p: str) -> DataFrame:
    """One row: mean and largest variation from the policy's own marginal, and each action's deviation over states."""
    mean = df.agg(*[F.avg(F.col(p)[i]).alias(f"m{i}") for i in range(N)]).first()
    marginal = F.array(*[F.lit(mean[f"m{i}"]) for i in range(N)])
    tv = total_variation(F.col(p), marginal)
    return df.agg(F.avg(tv).alias("mean_tv"), F.max(tv).alias("max_tv"), *[F.stddev_samp(F.col(p)[i]).alias(f"sd_{a}") for i, a in enumerate(ACTIONS)],
                  *[F.first(F.lit(mean[f"m{i}"])).alias(f"marginal_{a}") for i, a in enumerate(ACTIONS)])


def action_marginal(df: DataFrame, action_no: str) -> DataFrame:
    return df.agg(*[F.avg((F.col(action_no) == i).cast("double")).alias(f"share_{a}") for i, a in enumerate(ACTIONS)])


def robust_scale(df: DataFrame, values: str, floor: float = 0.05) -> DataFrame:
    """One row: 1.4826 times the median absolute deviation of all action values; their deviation where that is under the floor; the floor at least.

    The values are written once: three passes read them, and exploding would
    compute an expression behind them anew for every part of it.
    """
    flat = settled(df.select(F.col(values).alias("_x"))).select(F.explode("_x").alias("x"))
    sd = flat.agg(F.stddev_pop("x").alias("sd")).first()["sd"]
    middle = exact_quantiles(flat, F.col("x"), [], {"m": 0.5}).first()["m"]
    mad = exact_quantiles(flat, F.abs(F.col("x") - F.lit(middle)), [], {"m": 0.5}).select((F.col("m") * 1.4826).alias("mad"))
    return mad.select(F.greatest(F.lit(floor), F.when(F.col("mad") < floor, F.lit(sd)).otherwise(F.col("mad"))).alias("scale"))


def greedy_identity(df: DataFrame, left: str, right: str) -> DataFrame:
    """One row: whether the top actions agree on all rows."""
    return df.agg(F.bool_and(top_action(F.col(left)) == top_action(F.col(right))).alias("identical"))
