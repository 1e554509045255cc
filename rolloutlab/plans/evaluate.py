"""Building the four policies and evaluating them through one stack of estimators."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field, fields, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import ALTERNATIVE, PRIMARY, Reward, gather
from ..operators import diagnostics as D
from ..operators import gates as G
from ..operators import inference as I
from ..operators import sdr as S
from ..operators import support as U
from ..operators.booster import BoostConfig
from ..operators.fqe import FittedQ, initial_values
from ..operators.learners import Distiller, Features, Logistic, Propensity, SupportAdapter, attach, choose_c, fit_checksum, group_folds, local
from ..operators.policies import NAMES, Analytic, Constant, Improved, model_selection
from ..schema import ACTION, ACTIONS, EPISODE, OBSERVED, STEP, ContractError, policy_columns
from .roles import DEVELOPMENT, NUISANCE, manifest, training_roles
from .validation import require_cover, require_disjoint, require_distribution, require_realigned, validate_trajectory


@dataclass(frozen=True)
class Settings:
    seed: int = 41
    horizon: int = 3
    gamma: float = 1.0
    fraction: float = 0.6
    resamples: int = 200
    confidence: float = 0.95
    floor: float = 1e-3
    caps: tuple[float, ...] = (2.0, 10.0, 50.0)
    cap: float = 10.0
    learners: tuple[str, str] = ("hist_gradient_boosting", "ridge")
    c_grid: tuple[float, ...] = (0.1, 1.0)
    folds: int = 3
    boost: BoostConfig = BoostConfig(25, 0.1, 7, 5, 1.0)
    alpha: float = 5.0
    variant: str = "behavior_blend_50"
    parameters: Mapping[str, float] = field(default_factory=lambda: {"base_temperature": 2.0, "advantage_weight": 0.3, "support_weight": 0.2})
    rewards: Mapping[str, Reward] = field(default_factory=lambda: {"primary": PRIMARY, "alternative": ALTERNATIVE})
    gates: Mapping[str, float] = field(default_factory=lambda: dict(G.GATES))
    observed: tuple[str, ...] = OBSERVED

    def __post_init__(self) -> None:
        if self.cap not in self.caps:
            raise ContractError("the primary cap must be one of the caps")
        policy_columns(self.observed)


def with_rewards(df: DataFrame, settings: Settings) -> DataFrame:
    return df.withColumns({f"reward_{n}": r.total() for n, r in settings.rewards.items()})


def centered(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    return q - (q * p).sum(axis=1, keepdims=True)


def advantage_scale(a: np.ndarray, floor: float = 0.05) -> float:
    mad = 1.4826 * float(np.median(np.abs(a - np.median(a))))
    return max(floor, mad if mad >= floor else float(a.std()))


def read_config(spark: SparkSession, path: str) -> dict:
    """A configuration from a JSON file that Spark can read."""
    text = spark.read.text(path, wholetext=True).first()
    found = json.loads(text[0]) if text else None
    if not isinstance(found, dict):
        raise ContractError("a configuration is a JSON object")
    return found


def settings_of(config: Mapping) -> Settings:
    """Settings of a configuration with experiment, behavior_model, fqe, improvement, reward and alternative_reward; what it leaves out has its default."""
    base = Settings()
    e, b, fqe, gates = config.get("experiment", {}), config.get("behavior_model", {}), config.get("fqe", {}), dict(config.get("experiment", {}).get("winner_gates", {}))
    if "min_terminal_raw_ess" in gates:
        gates["min_terminal_ess"] = gates.pop("min_terminal_raw_ess")
    if "max_episode_weight_share" in gates:
        gates["max_weight_share"] = gates.pop("max_episode_weight_share")
    if unknown := set(gates) - set(base.gates):
        raise ContractError(f"unknown gates: {', '.join(sorted(unknown))}")
    tree = fqe.get("hist_gradient_boosting", {})
    boost = BoostConfig(int(tree.get("max_iter", base.boost.iterations)), float(tree.get("learning_rate", base.boost.rate)), int(tree.get("max_leaf_nodes", base.boost.leaves)),
                        int(tree.get("min_samples_leaf", base.boost.least)), float(tree.get("l2_regularization", base.boost.ridge)))
    rewards = {"primary": reward_of(config["reward"]) if "reward" in config else PRIMARY, "alternative": reward_of(config["alternative_reward"]) if "alternative_reward" in config else ALTERNATIVE}
    if "map_ablated_reward" in config:
        rewards["map_ablated"] = reward_of(config["map_ablated_reward"])
    chosen = model_selection(config)
    return Settings(
        seed=int(e.get("seed", base.seed)), horizon=int(e.get("horizon", base.horizon)), gamma=float(e.get("gamma", base.gamma)), fraction=float(e.get("policy_development_fraction", base.fraction)),
        resamples=int(e.get("bootstrap_resamples", base.resamples)), confidence=float(e.get("bootstrap_confidence", base.confidence)), floor=float(e.get("behavior_probability_floor", base.floor)),
        caps=tuple(map(float, e.get("importance_ratio_caps", base.caps))), cap=float(e.get("primary_importance_ratio_cap", base.cap)),
        learners=(e.get("primary_q_learner", base.learners[0]), e.get("q_learner_sensitivity", base.learners[1])), c_grid=tuple(map(float, b.get("c_grid", base.c_grid))),
        folds=int(b.get("group_folds", base.folds)), boost=boost, alpha=float(fqe.get("ridge", {}).get("alpha", base.alpha)),
        variant=chosen[0] if chosen else base.variant, parameters=config["improvement"]["selected_parameters"] if chosen else base.parameters, rewards=rewards, gates={**base.gates, **gates})


def reward_of(values: Mapping) -> Reward:
    """A reward from the names of a configuration, each the long form of a field."""
    names = {f.name: f.name for f in fields(Reward)} | {f"{n}_penalty": n for n in ("deterioration", "hypotension", "overload", "tachyarrhythmia")} | {"fluid_overload_penalty": "overload", "fluid_overload": "overload"}
    if unknown := set(values) - set(names):
        raise ContractError(f"unknown reward settings: {', '.join(sorted(unknown))}")
    return Reward(**{names[k]: float(v) for k, v in values.items()})


def build_policies(training: DataFrame, settings: Settings = Settings(), base=None) -> tuple[dict, dict]:
    """(the four policies, a receipt): all fitted on policy-development episodes only."""
    validate_trajectory(training, settings.horizon)
    roles = training_roles(training, settings.fraction, settings.seed)
    chosen = roles.filter(F.col("role") == DEVELOPMENT)
    frame = local(with_rewards(training.join(chosen, EPISODE, "left_semi"), settings))
    base = base or Analytic()
    p = base.predict(frame)
    c, losses = choose_c(frame, Features(settings.observed, True), settings.c_grid, settings.folds)
    rewards = frame["reward_primary"].to_numpy()
    fold = group_folds(frame[EPISODE].astype(str).to_numpy(), settings.folds)
    teacher = np.zeros((len(frame), len(ACTIONS)))
    for f in range(settings.folds):  # each row is judged by trees that didn't see its episode
        on = fold != f
        q = FittedQ(settings.observed + (STEP,), settings.horizon, settings.gamma, boost=settings.boost).fit(frame[on].reset_index(drop=True), rewards[on], p[on])
        teacher[~on] = centered(q.predict(frame[~on]), p[~on])
    distiller = Distiller(settings.observed, 5.0).fit(frame, teacher)
    scale = advantage_scale(centered(distiller.predict(frame), p))
    support = SupportAdapter(Propensity(settings.observed, settings.c_grid, settings.folds, settings.floor).fit(frame), settings.observed)
    clone = Logistic(settings.observed, c).fit(frame)
    improved = Improved(base, distiller, support, settings.variant, settings.parameters, scale)
    counts = manifest(roles).first()
    receipt = {"development_episodes": counts["development"], "nuisance_episodes": counts["nuisance"], "role_manifest_sha256": counts["checksum"], "selected_c": c, "c_losses": losses,
               "advantage_scale": scale, "parameters": dict(settings.parameters), "variant": settings.variant}
    return dict(zip(NAMES, (Constant(), clone, base, improved))), receipt


def audit_fit_scope(policies: Mapping, allowed: set[str]) -> dict[str, int]:
    """How many episodes each fitted part was fitted on; raises if one lies outside development, or the clone and the anchor miss some."""
    counts: dict[str, int] = {}

    def visit(name: str, part, seen: set[int]) -> None:
        if id(part) in seen or not hasattr(part, "__dict__"):
            return
        seen.add(id(part))
        ids = getattr(part, "episodes", None)
        if isinstance(ids, (list, tuple, set)):
            outside = sorted(set(map(str, ids)) - allowed)
            if outside:
                raise ContractError(f"{name} was fitted on {outside[0]}, which is no development episode")
            counts[name] = len(set(ids))
            told = getattr(part, "checksum", None)
            if told is not None and told != fit_checksum(ids):
                raise ContractError(f"the checksum of {name} is not that of the episodes it names")
        for key, value in vars(part).items():
            for k, v in enumerate(value if isinstance(value, (list, tuple)) else [value]):
                visit(f"{name}.{key}" + (f"[{k}]" if isinstance(value, (list, tuple)) else ""), v, seen)

    for name, policy in policies.items():
        visit(name, policy, set())
    for name in ("behavior_clone", "llm_improved.support", "llm_improved.values"):
        if counts.get(name) != len(allowed):
            raise ContractError(f"{name} was not fitted on exactly the development episodes")
    return counts


def runtime_of(policy, rows: int) -> dict:
    """Requests, fallbacks and malformed answers of a policy's run, by its ``diagnostics`` or its own attributes; a policy without any answered every row."""
    told = getattr(policy, "diagnostics", None)

    def number(*names: str, default: int = 0) -> int:
        for holder in (told, policy):
            for n in names:
                value = holder.get(n) if isinstance(holder, Mapping) else getattr(holder, n, None)
                if value is not None and not callable(value):
                    return int(value)
        return default

    requests, fallbacks = number("requests", "total_requests", default=rows), number("fallbacks", "fallback_count")
    rate = getattr(policy, "fallback_rate", None)
    return {"requests": requests, "fallbacks": fallbacks, "malformed": number("malformed_outputs", "malformed_count"), "cache_hits": number("cache_hits"), "cache_misses": number("cache_misses"),
            "fallback_rate": float(rate) if rate is not None else fallbacks / requests if requests else 0.0, "schema_pass": bool(getattr(policy, "schema_pass", True)),
            "model_id": str(getattr(policy, "model_id", type(policy).__name__)), "prompt_version": getattr(policy, "prompt_version", None)}


def recovered_base(blend: np.ndarray, behavior: np.ndarray, weight: float) -> np.ndarray:
    """The part of a convex blend that isn't behaviour; raises unless blending it again gives the blend within 1e-12."""
    if not 0 < weight <= 1:
        raise ContractError("the blend weight must lie between 0 and 1")
    part = np.maximum((blend - (1 - weight) * behavior) / weight, 0.0)
    part /= part.sum(axis=1, keepdims=True)
    if np.abs(weight * part + (1 - weight) * behavior - blend).max(initial=0.0) > 1e-12:
        raise ContractError("the blend can't be made again of its parts")
    return part


@dataclass
class Evaluation:
    episodes: DataFrame  # reward, learner, policy, patient_id, direct, raw, value_<cap>
    summary: DataFrame  # policy, estimator and its intervals
    support: DataFrame  # policy, gates and their numbers
    calibration: DataFrame  # predictor and how well it agrees with the log
    stress: DataFrame
    simultaneous: DataFrame
    raw: DataFrame  # policy, whether its unclipped estimate is available, and the estimate
    gaps: DataFrame  # policy, capped less direct estimate
    samples: DataFrame  # estimator, policy, resample, value, difference
    shortcut: DataFrame  # reward parts by slice, over training and validation
    runtime: DataFrame  # policy, requests, fallbacks, schema
    behavior: dict
    verdict: dict
    receipt: dict


ROWS = "policy string, policy_no int, reward string, learner string, patient_id string, time_step int, action_no int, map_mm_hg double, terminal int, reward_value double, q_logged double, v double, target array<double>, behavior array<double>"


def estimated(spark: SparkSession, fit_frame: pd.DataFrame, frame: pd.DataFrame, targets: Mapping, b: np.ndarray, settings: Settings, columns: Sequence[str], rewards: Sequence[str], learners: Sequence[str]) -> DataFrame:
    """One row per policy, reward, learner and validation step: action values of a nuisance fit, target and behaviour."""
    action, at = frame[ACTION].map({a: i for i, a in enumerate(ACTIONS)}).to_numpy(), np.arange(len(frame))
    tables = []
    for no, (name, (p_fit, p)) in enumerate(targets.items()):
        for reward in rewards:
            for learner in learners:
                q = FittedQ(tuple(columns), settings.horizon, settings.gamma, learner, settings.boost, settings.alpha).fit(fit_frame, fit_frame[f"reward_{reward}"].to_numpy(), p_fit).predict(frame)
                tables.append(pd.DataFrame({
                    "policy": name, "policy_no": no, "reward": reward, "learner": learner, EPISODE: frame[EPISODE].astype(str), STEP: frame[STEP].astype("int32"), "action_no": action.astype("int32"),
                    "map_mm_hg": frame["map_mm_hg"], "terminal": frame["terminal"].astype("int32"), "reward_value": frame[f"reward_{reward}"], "q_logged": q[at, action], "v": (p * q).sum(axis=1),
                    "target": p.tolist(), "behavior": b.tolist()}))
    rows = spark.createDataFrame(pd.concat(tables, ignore_index=True), ROWS)
    require_distribution(rows, "target")
    return rows.withColumns({"target_logged": gather(F.col("target"), F.col("action_no")), "behavior_logged": gather(F.col("behavior"), F.col("action_no"))})


BY = ["policy", "policy_no", "key_reward", "learner"]


def episode_values(rows: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """(steps with weights, episodes with direct, raw and capped values)."""
    steps = S.next_values(rows, "v", ["policy", "policy_no", "reward", "learner"]).withColumn("key_reward", F.col("reward")).withColumn("reward", F.col("reward_value"))
    weighted, values = S.sequential_dr(steps, settings.caps, settings.gamma, BY)
    return weighted, values.join(initial_values(steps, "v", BY), [*BY, EPISODE]).withColumnRenamed("key_reward", "reward")


@dataclass
class Prepared:
    fit_frame: pd.DataFrame
    frame: pd.DataFrame
    targets: dict
    scope: dict
    runtime: dict
    marginal: np.ndarray


def prepared(training: DataFrame, validation: DataFrame, policies: Mapping, settings: Settings) -> Prepared:
    """Checks the tables and what the policies were fitted on, and freezes every policy's probabilities once."""
    if set(policies) != set(NAMES):
        raise ContractError(f"the policies must be {', '.join(NAMES)}")
    validate_trajectory(training, settings.horizon)
    validate_trajectory(validation, settings.horizon)
    roles = training_roles(training, settings.fraction, settings.seed)
    development, nuisance = (training.join(roles.filter(F.col("role") == r), EPISODE, "left_semi") for r in (DEVELOPMENT, NUISANCE))
    require_disjoint(policy_development=development, ope_nuisance=nuisance, validation=validation)
    require_cover(training, development, nuisance)
    allowed = {r[EPISODE] for r in development.select(F.col(EPISODE).cast("string")).distinct().collect()}  # one role's ids, bounded by MOST_ROWS of the fit
    scope = audit_fit_scope(policies, allowed)
    fit_frame, frame = local(with_rewards(nuisance, settings)), local(with_rewards(validation, settings))
    targets = {n: (policies[n].predict(fit_frame), policies[n].predict(frame)) for n in NAMES}
    shares = training.agg(*[F.avg((F.col(ACTION) == a).cast("double")).alias(f"s{i}") for i, a in enumerate(ACTIONS)]).first()
    return Prepared(fit_frame, frame, targets, scope, {n: runtime_of(policies[n], len(frame)) for n in NAMES}, np.array(list(shares)))


def evaluate_policies(training: DataFrame, validation: DataFrame, policies: Mapping, settings: Settings = Settings()) -> Evaluation:
    """Fits nuisances on the nuisance role, estimates on validation.

    Probabilities of every policy are frozen once. Controls run as further
    policies: the logged marginal, the uniform policy, the improved policy's
    rows permuted, and the improved policy with its base made uniform.
    """
    ready = prepared(training, validation, policies, settings)
    fit_frame, frame, targets, spark = ready.fit_frame, ready.frame, dict(ready.targets), validation.sparkSession
    behavior = Propensity(settings.observed + (STEP,), settings.c_grid, settings.folds, settings.floor).fit(fit_frame)
    b = behavior.predict(frame)
    rng = np.random.default_rng(settings.seed + 91337)
    order_fit, order = rng.permutation(len(fit_frame)), rng.permutation(len(frame))
    anchor, weight, third = policies["llm_improved"].support, policies["llm_improved"].weight, 1 / len(ACTIONS)
    anchored, tiled = anchor.predict(frame), lambda p, f: np.tile(p, (len(f), 1))
    uniform = np.full(len(ACTIONS), third)
    predictors = {"base_zero_shot": targets["llm_zero_shot"][1], "base_before_blend": recovered_base(targets["llm_improved"][1], anchored, weight), "improved_blend": targets["llm_improved"][1],
                  "behavior_anchor": anchored, "training_marginal": tiled(ready.marginal, frame), "uniform": tiled(uniform, frame)}
    targets |= {
        "control_marginal": tuple(tiled(ready.marginal, f) for f in (fit_frame, frame)),
        "control_uniform_base": tuple(weight * third + (1 - weight) * anchor.predict(f) for f in (fit_frame, frame)),
        "control_permuted": (targets["llm_improved"][0][order_fit], targets["llm_improved"][1][order]),
        "control_uniform": tuple(tiled(uniform, f) for f in (fit_frame, frame)),
    }
    rows = estimated(spark, fit_frame, frame, targets, b, settings, settings.observed + (STEP,), list(settings.rewards), settings.learners).persist()
    require_realigned(rows.filter((F.col("policy") == NAMES[0]) & (F.col("reward") == "primary") & (F.col("learner") == settings.learners[0])), validation)
    weighted, episodes = episode_values(rows, settings)
    episodes = episodes.persist()
    first, second = settings.learners
    capped = f"value_{S.cap_name(settings.cap)}"
    n = frame[EPISODE].nunique()
    draws = I.generator_draws(spark, n, settings.resamples, settings.seed).persist()
    place = spark.createDataFrame([(e, i) for i, e in enumerate(sorted(frame[EPISODE].astype(str).unique()))], "patient_id string, idx long")
    primary = episodes.filter((F.col("reward") == "primary") & (F.col("learner") == first)).join(place, EPISODE)
    wide = primary.groupBy("idx").pivot("policy", list(NAMES)).agg(F.first("direct").alias("direct"), F.first(capped).alias("sdr"), F.first("raw").alias("raw")).persist()
    summaries = samples = gaps = None
    for estimator in ("direct", "sdr"):
        values = wide.select("idx", *[F.col(f"{p}_{estimator}").alias(p) for p in NAMES])
        part = I.paired_bootstrap(values, draws, NAMES, NAMES[0], settings.confidence).withColumn("estimator", F.lit(estimator))
        part = part.withColumns({f"{c}_per_decision": F.col(c) / settings.horizon for c in ("mean", "low", "high")}).withColumnRenamed("mean_per_decision", "per_decision")
        drawn = I.bootstrap_samples(values, draws, NAMES, NAMES[0]).withColumn("estimator", F.lit(estimator))
        summaries = part if summaries is None else summaries.unionByName(part)
        samples = drawn if samples is None else samples.unionByName(drawn)
    for p in NAMES:
        part = I.paired_gap(wide.select("idx", f"{p}_sdr", f"{p}_direct"), draws, f"{p}_sdr", f"{p}_direct", settings.confidence).withColumn("policy", F.lit(p))
        gaps = part if gaps is None else gaps.unionByName(part)
    raw = I.raw_availability(wide.select("idx", *[F.col(f"{p}_raw").alias(p) for p in NAMES]), draws, NAMES, NAMES[0], settings.confidence)
    named = wide.select("idx", *[F.col(f"{p}_{e}").alias(f"{e}_{p}") for p in NAMES for e in ("direct", "sdr")])
    simultaneous = I.max_t(named, draws, NAMES, ["direct", "sdr"], settings.confidence).persist()
    one = weighted.filter((F.col("key_reward") == "primary") & (F.col("learner") == first))
    last = U.concentration(one.filter(F.col(STEP) == settings.horizon - 1), "log_w", ["policy"])
    raw_valid = primary.groupBy("policy").agg(F.bool_and(F.coalesce(~F.isnan("raw") & (F.abs("raw") != float("inf")), F.lit(False))).alias("raw_valid"))
    runtime = spark.createDataFrame([(p, *[r[c] for c in ("requests", "fallbacks", "malformed", "cache_hits", "cache_misses", "fallback_rate", "schema_pass", "model_id", "prompt_version")]) for p, r in ready.runtime.items()],
                                    "policy string, requests long, fallbacks long, malformed long, cache_hits long, cache_misses long, fallback_rate double, schema_pass boolean, model_id string, prompt_version string")
    state = U.state_support(one, ["policy"], thresholds=(0.01, 0.05))
    # controls answer no requests: they pass the first two gates
    known = state.join(last, "policy").join(raw_valid, "policy").join(runtime.select("policy", "schema_pass", "fallback_rate"), "policy", "left")
    support = G.eligibility(known.withColumns({"schema_pass": F.coalesce("schema_pass", F.lit(True)), "fallback_rate": F.coalesce("fallback_rate", F.lit(0.0)), "overlap": F.col("mean_overlap"),
                                               "low_mass": F.col("mass_below_0_01"), "share": F.col("max_share")}), settings.gates).persist()
    eligible = [r["policy"] for r in support.filter("eligible").select("policy").collect() if r["policy"] in NAMES]

    def means(reward: str, learner: str) -> dict[str, float]:
        picked = episodes.filter((F.col("reward") == reward) & (F.col("learner") == learner)).groupBy("policy").agg(F.avg("direct").alias("m")).collect()
        return {r["policy"]: r["m"] for r in picked if r["policy"] in NAMES}

    verdict = G.verdict(NAMES, eligible, means("primary", first), means("alternative", first) if "alternative" in settings.rewards else means("primary", first), means("primary", second),
                        [r.asDict() for r in I.directed(simultaneous).collect()], ["direct", "sdr"])
    action = frame[ACTION].map({a: i for i, a in enumerate(ACTIONS)}).astype("int32")
    told = pd.concat([pd.DataFrame({"predictor": name, "p": p.tolist(), "action_no": action}) for name, p in predictors.items()], ignore_index=True)
    calibration = D.calibration(spark.createDataFrame(told, "predictor string, p array<double>, action_no int"), "p", "action_no", ["predictor"])
    shared = [c for c in training.columns if c in validation.columns]
    shortcut = D.reward_shortcut(training.select(*shared).unionByName(validation.select(*shared)), settings.rewards["primary"])
    long = episodes.select("reward", "learner", "policy", "policy_no", F.explode(F.array(F.struct(F.lit("direct").alias("estimator"), F.col("direct").alias("value")),
                                                                                        F.struct(F.lit("sdr").alias("estimator"), F.col(capped).alias("value")))).alias("x")).select("reward", "learner", "policy", "policy_no", "x.*")
    stress = G.stress_grid(long.filter(F.col("policy").isin(*NAMES)))
    receipt = {"fit_scope": ready.scope, "runtime": ready.runtime, "settings": {k: v for k, v in asdict(settings).items() if k not in ("rewards", "boost")}}
    return Evaluation(episodes, summaries, support, calibration, stress, simultaneous, raw, gaps, samples, shortcut, runtime, behavior.diagnostics(fit_frame), verdict, receipt)


def comparison(result: Evaluation) -> DataFrame:
    """One row per policy: eligible, direct estimate with its interval, capped estimate, direct estimates under the alternative reward and the other learner, overlap, effective sample size."""
    first, second = result.receipt["settings"]["learners"]

    def direct(reward: str, learner: str, name: str) -> DataFrame:
        return result.episodes.filter((F.col("reward") == reward) & (F.col("learner") == learner)).groupBy("policy").agg(F.avg("direct").alias(name))

    summary = {e: result.summary.filter(F.col("estimator") == e) for e in ("direct", "sdr")}
    base = summary["direct"].select("policy", F.col("mean").alias("primary_fqe_total"), F.col("low").alias("primary_fqe_ci_low"), F.col("high").alias("primary_fqe_ci_high"))
    out = base.join(summary["sdr"].select("policy", F.col("mean").alias("primary_sdr_cap_10_total")), "policy").join(direct("alternative", first, "alternative_fqe_total"), "policy", "left")
    out = out.join(direct("primary", second, "ridge_primary_fqe_total"), "policy").join(result.support.select("policy", "eligible", F.col("overlap").alias("mean_action_overlap"), F.col("ess").alias("terminal_raw_ess")), "policy")
    return out.select("policy", "eligible", "primary_fqe_total", "primary_fqe_ci_low", "primary_fqe_ci_high", "primary_sdr_cap_10_total", "alternative_fqe_total", "ridge_primary_fqe_total", "mean_action_overlap", "terminal_raw_ess")


def refit_sensitivity(training: DataFrame, validation: DataFrame, policies: Mapping, settings: Settings, sensitivity_columns: Sequence[str]) -> tuple[DataFrame, dict]:
    """(per policy direct, per decision and capped values when the nuisance models also see ``sensitivity_columns``, and their change; the behaviour model's diagnostics).

    Target policies never see these columns. One refit each with and without
    them, of the primary reward and the first learner.
    """
    ready, spark = prepared(training, validation, policies, settings), validation.sparkSession
    first, capped = settings.learners[0], f"value_{S.cap_name(settings.cap)}"

    def values(more: tuple[str, ...]) -> tuple[DataFrame, Propensity]:
        columns = settings.observed + (STEP,) + more
        model = Propensity(columns, settings.c_grid, settings.folds, settings.floor).fit(ready.fit_frame)
        rows = estimated(spark, ready.fit_frame, ready.frame, ready.targets, model.predict(ready.frame), settings, columns, ["primary"], [first])
        return episode_values(rows, settings)[1].select("policy", EPISODE, "direct", F.col(capped).alias("sdr")), model

    plain, _ = values(())
    wide, model = values(tuple(sensitivity_columns))
    met = wide.join(plain.withColumnsRenamed({"direct": "_d", "sdr": "_s"}), ["policy", EPISODE])
    out = met.groupBy("policy").agg(F.avg("direct").alias("direct"), (F.avg("direct") / settings.horizon).alias("direct_per_decision"), F.avg("sdr").alias("sdr"), F.avg(F.col("direct") - F.col("_d")).alias("mean_change"),
                                    F.max(F.abs(F.col("direct") - F.col("_d"))).alias("max_change"), F.avg(F.col("sdr") - F.col("_s")).alias("mean_sdr_change"))
    return out, model.diagnostics(ready.fit_frame)


def seed_sensitivity(training: DataFrame, validation: DataFrame, policies: Mapping, settings: Settings, episodes: DataFrame) -> DataFrame:
    """Per policy: direct value of a refit under the next seed, and its mean and largest change by episode.

    The learners draw no random numbers, so a change tells of a fit that isn't
    repeatable. Roles keep their seed.
    """
    ready, first = prepared(training, validation, policies, settings), settings.learners[0]
    b = np.full((len(ready.frame), len(ACTIONS)), 1 / len(ACTIONS))
    rows = estimated(validation.sparkSession, ready.fit_frame, ready.frame, ready.targets, b, replace(settings, seed=settings.seed + 1), settings.observed + (STEP,), ["primary"], [first])
    again = initial_values(rows, "v", ["policy"]).withColumnRenamed("direct", "again")
    known = episodes.filter((F.col("reward") == "primary") & (F.col("learner") == first)).select("policy", EPISODE, "direct")
    gap = F.col("again") - F.col("direct")
    return again.join(known, ["policy", EPISODE]).groupBy("policy").agg(F.avg("again").alias("direct"), F.avg(gap).alias("mean_change"), F.max(F.abs(gap)).alias("max_change"))


def predictions(df: DataFrame, policy, columns: Sequence[str] = OBSERVED) -> DataFrame:
    """Key, three probabilities, the top action and where the policy comes from, of an outcome-free table."""
    out = attach(df, policy, list(columns), "_p")
    best = F.element_at(F.array(*[F.lit(a) for a in ACTIONS]), F.array_position("_p", F.array_max("_p")).cast("int"))
    origin = getattr(policy, "origin", getattr(getattr(policy, "base", None), "origin", "caller_supplied"))
    return out.select(EPISODE, STEP, *[F.col("_p")[i].alias(f"prob_{a}") for i, a in enumerate(ACTIONS)], best.alias("chosen_action"), F.lit(origin).alias("policy_origin"))
