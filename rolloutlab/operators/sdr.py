"""Sequential doubly robust returns as one window and one aggregate."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expressions import bellman, safe_exp, safe_log
from ..plans.validation import require, sdr_checks
from ..schema import EPISODE, STEP


def next_values(df: DataFrame, value: str, keys: Sequence[str] = (), out: str = "v_next") -> DataFrame:
    """Adds the value of the episode's next step, 0 after the last."""
    w = Window.partitionBy(*keys, EPISODE).orderBy(STEP)
    return df.withColumn(out, F.coalesce(F.lead(value).over(w), F.lit(0.0)))


def cap_name(cap: float) -> str:
    return f"cap_{cap:g}".replace(".", "_")


def cumulative_weights(df: DataFrame, caps: Sequence[float], keys: Sequence[str] = (), target: str = "target_logged", behavior: str = "behavior_logged") -> DataFrame:
    """Adds ratio, log_w (sum of log ratios up to the step) and log_w_<cap>: the cumulative weight, not the step's, is capped."""
    if any(not (c > 0 and math.isfinite(c)) for c in caps):
        raise ValueError("caps must be positive and finite")
    w = Window.partitionBy(*keys, EPISODE).orderBy(STEP).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("ratio", F.col(target) / F.col(behavior)).withColumn("log_w", F.sum(safe_log(F.col(target)) - safe_log(F.col(behavior))).over(w))
    return out.withColumns({f"log_w_{cap_name(c)}": F.least("log_w", F.lit(math.log(c))) for c in caps})


def sequential_dr(df: DataFrame, caps: Sequence[float] = (2.0, 10.0, 50.0), gamma: float = 1.0, keys: Sequence[str] = (), check: bool = True) -> tuple[DataFrame, DataFrame]:
    """(steps with weights, episodes with raw and value_<cap>).

    Needs reward, terminal, q_logged, v, v_next, target_logged and
    behavior_logged. An episode's value is V of its first step plus the
    discounted, weighted temporal differences. Weights that overflow give
    infinite raw values; they are reported, not clipped.
    """
    if check:
        require(df, sdr_checks(F.col("behavior_logged"), F.col("target_logged"), [F.col(c) for c in ("reward", "q_logged", "v", "v_next")]), "sequential estimate")
    steps = cumulative_weights(df, caps, keys)
    difference = bellman(F.col("reward"), F.col("terminal"), F.col("v_next"), gamma) - F.col("q_logged")
    discount = F.when(F.col(STEP) == 0, F.lit(1.0)).otherwise(F.pow(F.lit(float(gamma)), F.col(STEP)))

    def episode(log_weight: str) -> Column:
        return F.max(F.when(F.col(STEP) == 0, F.col("v"))) + F.sum(discount * safe_exp(F.col(log_weight)) * difference)

    values = [episode("log_w").alias("raw"), *[episode(f"log_w_{cap_name(c)}").alias(f"value_{cap_name(c)}") for c in caps]]
    return steps, steps.groupBy(*keys, EPISODE).agg(*values)
