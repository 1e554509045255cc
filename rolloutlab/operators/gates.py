"""Eligibility, ranking and the winner's verdict; inputs are a few rows per policy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of the six gates.
GATES = {"max_fallback_rate": 0.02, "min_mean_overlap": 0.5, "max_low_support_mass": 0.05, "min_terminal_ess": 10.0, "max_weight_share": 0.2}


def eligibility(metrics: DataFrame, gates: Mapping[str, float] = GATES) -> DataFrame:
    """Adds a column per gate and ``eligible``; needs schema_pass, fallback_rate, overlap, low_mass, ess and share. A missing number fails its gate."""
    checks = {
        "gate_schema": F.col("schema_pass"), "gate_fallback": F.col("fallback_rate") <= gates["max_fallback_rate"], "gate_overlap": F.col("overlap") >= gates["min_mean_overlap"],
        "gate_low_mass": F.col("low_mass") <= gates["max_low_support_mass"], "gate_ess": F.col("ess") >= gates["min_terminal_ess"], "gate_share": F.col("share") <= gates["max_weight_share"],
    }
    out = metrics.withColumns({n: F.coalesce(c, F.lit(False)) for n, c in checks.items()})
    whole = F.lit(True)
    for n in checks:
        whole = whole & F.col(n)
    return out.withColumn("eligible", whole)


def ranked(means: Mapping[str, float], policies: Sequence[str]) -> list[str]:
    """Policies by mean, largest first; of equals the earlier."""
    return sorted((p for p in policies if p in means), key=lambda p: -means[p])


def verdict(policies: Sequence[str], eligible: Sequence[str], primary: Mapping[str, float], alternative: Mapping[str, float], sensitivity: Mapping[str, float],
            intervals: Sequence[Mapping], estimators: Sequence[str]) -> dict:
    """The winner and whether it is robust.

    ``intervals`` are simultaneous contrasts, both ways. Robust needs a lower
    bound above zero against every eligible opponent under every estimator,
    first rank under the alternative reward and the other learner too, and
    differences larger than what the learner changes.
    """
    order = ranked(primary, [p for p in policies if p in set(eligible)])
    everyone = ranked(primary, policies)
    if not order:
        return {"status": "no eligible policy", "winner": None, "runner_up": None, "robust": False, "ranking": everyone, "eligible": [], "reasons": []}
    winner, reasons = order[0], []
    low = {(r["estimator"], r["left_policy"], r["right_policy"]): r["low"] for r in intervals}
    if len(order) < 2:
        reasons.append("fewer than two eligible policies")
    else:
        if not all(low[e, winner, o] > 0 for e in estimators for o in order[1:]):
            reasons.append("a simultaneous lower bound is not positive")
        if ranked(alternative, order)[0] != winner:
            reasons.append("another policy leads under the alternative reward")
        if ranked(sensitivity, order)[0] != winner:
            reasons.append("another policy leads under the other learner")
        for o in order[1:]:
            gap, other = primary[winner] - primary[o], sensitivity[winner] - sensitivity[o]
            if not abs(gap) > abs(gap - other):
                reasons.append("a difference does not exceed what the learner changes")
                break
    robust = not reasons
    return {"status": "robust winner" if robust else "highest point estimate; no robust winner", "winner": winner, "runner_up": order[1] if len(order) > 1 else None,
            "robust": robust, "ranking": everyone, "eligible": order, "reasons": reasons}


def stress_grid(values: DataFrame) -> DataFrame:
    """Per reward, learner and estimator: policies ranked by mean, and the first policy's lead over the baseline ``always_maintain``."""
    means = values.groupBy("reward", "learner", "estimator", "policy", "policy_no").agg(F.avg("value").alias("mean"))
    rank = F.array_sort(F.collect_list(F.struct((-F.col("mean")).alias("m"), F.col("policy_no").alias("n"), F.col("policy").alias("p"))))
    return means.groupBy("reward", "learner", "estimator").agg(
        F.transform(rank, lambda x: x["p"]).alias("ranking"),
        (F.max(F.when(F.col("policy") == "llm_improved", F.col("mean"))) - F.max(F.when(F.col("policy") == "always_maintain", F.col("mean")))).alias("improved_minus_maintain"))
