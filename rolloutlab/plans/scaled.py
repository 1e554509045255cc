"""The evaluation of policies on tables of any size: no stage gathers rows.

Policies are column expressions, the behaviour's probabilities a column, and
the learners those whose fit is an aggregate: ``ridge`` (one Gram sum per step
for all policies) or ``tabular`` (cell means). Bootstraps draw counts by block
of episodes. Only sums, one row per policy and one per block reach the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import gather
from ..operators import gates as G
from ..operators import inference as I
from ..operators import sdr as S
from ..operators import support as U
from ..operators.fqe import by_step, distributed_ridge, initial_values, tabular
from ..schema import EPISODE, STEP, ContractError
from ..sources.files import settled


@dataclass
class ScaledEvaluation:
    episodes: DataFrame  # policy, patient_id, direct, raw, value_<cap>
    summary: DataFrame  # policy, direct and capped means with bootstrap intervals
    support: DataFrame  # policy, overlap, concentration and gates


def evaluate_scaled(fit: DataFrame, valid: DataFrame, policies: Mapping[str, Column], learner: str, horizon: int, *, features: Sequence[Column] = (), cell: Sequence[str] = (), action: str = "action_no", reward: str = "reward",
                    behavior: str = "behavior", caps: Sequence[float] = (2.0, 10.0, 50.0), cap: float = 10.0, gamma: float = 1.0, alpha: float = 5.0, resamples: int = 200, confidence: float = 0.95, blocks: int = 64, seed: int = 41,
                    gates: Mapping[str, float] = G.GATES) -> ScaledEvaluation:
    """Fits action values on ``fit``, estimates on ``valid``; both have the keys, action number, reward, terminal, and what policies and features read, ``valid`` the behaviour."""
    if cap not in caps or learner not in ("ridge", "tabular"):
        raise ContractError("the primary cap must be one of the caps, the learner ridge or tabular")
    names = list(policies)
    marks = {n: f"_p{i}" for i, n in enumerate(names)}
    # tables are written where many plans would start from them
    fit, valid = (by_step(df.withColumns({marks[n]: policies[n] for n in names})) for df in (fit, valid))
    if learner == "ridge":
        fit, valid = (df.withColumn("_f", F.array(*features)) for df in (fit, valid))
        known = distributed_ridge(fit, "_f", action, reward, [marks[n] for n in names], horizon, gamma, alpha, len(features), valid)
        each = [F.struct(F.lit(n).alias("policy"), F.lit(i).alias("policy_no"), F.col(marks[n]).alias("target"), F.col(f"q_{marks[n]}").alias("q"), F.col(f"v_{marks[n]}").alias("v")) for i, n in enumerate(names)]
        long = known.withColumn("_x", F.explode(F.array(*each))).select(EPISODE, STEP, action, reward, "terminal", behavior, "_x.*")
    else:
        long = None
        for i, n in enumerate(names):
            part = tabular(fit, cell, action, reward, marks[n], horizon, gamma, valid)
            part = part.select(EPISODE, STEP, action, reward, "terminal", behavior, F.lit(n).alias("policy"), F.lit(i).alias("policy_no"), F.col(marks[n]).alias("target"), "q", "v")
            long = part if long is None else long.unionByName(part)
    no = F.col(action)
    rows = long.withColumns({"reward": F.col(reward), "q_logged": F.coalesce(gather(F.col("q"), no), F.lit(0.0)), "target_logged": gather(F.col("target"), no), "behavior_logged": gather(F.col(behavior), no)})
    rows = settled(S.next_values(rows, "v", ["policy"]))
    steps, values = S.sequential_dr(rows, caps, gamma, ["policy", "policy_no"])
    episodes = settled(values.join(initial_values(rows, "v", ["policy"]), ["policy", EPISODE]))
    capped = f"value_{S.cap_name(cap)}"
    wide = episodes.groupBy(EPISODE).pivot("policy", names).agg(F.first("direct").alias("direct"), F.first(capped).alias("sdr"))
    columns = {f"{n}_{e}": f"c{i}_{e}" for i, n in enumerate(names) for e in ("direct", "sdr")}
    placed = I.indexed(wide.withColumnsRenamed(columns), EPISODE)
    drawn = I.block_sums(placed, list(columns.values()), resamples, blocks, seed)
    low, high = (1 - confidence) / 2, 1 - (1 - confidence) / 2
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("policy"), F.lit(e).alias("estimator"), (F.col(f"c{i}_{e}") / F.col("m")).alias("x")) for i, n in enumerate(names) for e in ("direct", "sdr")]))
    spread = drawn.select(cells.alias("_x")).select("_x.*").groupBy("policy", "estimator").agg(F.percentile("x", F.lit(low)).alias("low"), F.percentile("x", F.lit(high)).alias("high"))  # one value per resample
    means = episodes.groupBy("policy").agg(F.count("*").alias("episodes"), F.avg("direct").alias("direct"), F.avg(capped).alias("sdr"))
    both = F.explode(F.array(*[F.struct(F.lit(e).alias("estimator"), F.col(e).alias("mean"), (F.col(e) / horizon).alias("per_decision")) for e in ("direct", "sdr")]))
    summary = means.select("policy", "episodes", both.alias("_x")).select("policy", "episodes", "_x.*").join(spread, ["policy", "estimator"])
    last = U.concentration(steps.filter(F.col(STEP) == horizon - 1), "log_w", ["policy"])
    state = U.state_support(rows, ["policy"], behavior=behavior, thresholds=(0.01,))
    support = G.eligibility(state.join(last, "policy").withColumns({"schema_pass": F.lit(True), "fallback_rate": F.lit(0.0), "overlap": F.col("mean_overlap"), "low_mass": F.col("mass_below_0_01"), "share": F.col("max_share")}), gates)
    return ScaledEvaluation(episodes, summary, support)
