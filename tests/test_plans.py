"""Folds, digests, quantiles, audits, raw estimates, gates inside an evaluation, and the configured run."""

import dataclasses
import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from rolloutlab.functions import expressions as X
from rolloutlab.operators import inference as I
from rolloutlab.operators import support as U
from rolloutlab.operators.booster import BoostConfig, Booster
from rolloutlab.operators.digests import block_digest, line_digest
from rolloutlab.operators.features import fitted_features, ridge_columns
from rolloutlab.operators.fqe import FittedQ
from rolloutlab.operators.learners import Features, Propensity, SupportAdapter, fit_checksum, fit_ridge, group_folds
from rolloutlab.operators.policies import Analytic, Constant
from rolloutlab.operators.quantiles import exact_quantiles
from rolloutlab.plans import evaluate as E
from rolloutlab.plans import observations as O
from rolloutlab.plans import roles as R
from rolloutlab.plans import validation as V
from rolloutlab.plans.example import CONFIG, run_example
from rolloutlab.plans.scaled import evaluate_scaled
from rolloutlab.schema import ACTION, EPISODE, OBSERVED, STEP, ContractError
from rolloutlab.sources.files import release_faults
from rolloutlab.sources.synthetic import generate


@pytest.fixture(scope="module")
def made(spark):
    return {k: v.cache() for k, v in generate(spark).items()}


@pytest.fixture(scope="module")
def built(made):
    return E.build_policies(made["train"])[0]


@pytest.mark.parametrize("seed", range(6))
def test_folds_go_to_the_lightest(spark, seed):
    rng = np.random.default_rng(seed)
    sizes = rng.choice([1, 2, 3, 7, 20], rng.integers(1, 40)) if seed else np.array([5, 3, 3])
    k = int(rng.integers(2, 5)) if seed else 2
    groups = np.repeat([f"e{i:03d}" for i in range(len(sizes))], sizes)
    want = dict(zip(groups, group_folds(groups, k)))
    got = {r[EPISODE]: r.fold for r in R.folds(spark.createDataFrame([(str(g),) for g in groups], f"{EPISODE} string"), k).collect()}
    assert got == want


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(4)
    rows = [("a", float(x)) for x in rng.normal(size=700)] + [("b", float(x)) for x in rng.integers(0, 3, 500)] + [("c", 2.5)] + [(None, 1.0), (None, 3.0)] + [("d", None)]
    named = {"low": 0.025, "mid": 0.5, "high": 0.99, "top": 1.0}
    got = {r.g: r for r in exact_quantiles(spark.createDataFrame(rows, "g string, x double"), F.col("x"), ["g"], named).collect()}
    assert set(got) == {"a", "b", "c", None}
    for g, r in got.items():
        values = [x for k, x in rows if k == g]
        for name, q in named.items():
            assert r[name] == pytest.approx(np.quantile(values, q), abs=1e-12)
    whole = exact_quantiles(spark.createDataFrame(rows, "g string, x double"), F.col("x"), [], {"m": 0.5}).first()
    assert whole.m == pytest.approx(np.median([x for _, x in rows if x is not None]))


def test_digests(spark):
    rows = [(f"k{i:04d}",) for i in range(1000)]
    df = spark.createDataFrame(rows, "k string").repartition(7)
    lines = [f"{k}\n" for (k,) in rows]
    line = F.concat("k", F.lit("\n"))
    assert line_digest(df, ["k"], line, "").first().digest == hashlib.sha256("".join(lines).encode()).hexdigest()
    parts = [hashlib.sha256("".join(lines[s: s + 64]).encode()).hexdigest() for s in range(0, 1000, 64)]
    found = block_digest(df, ["k"], line, 64).first()
    assert found.digest == hashlib.sha256("".join(parts).encode()).hexdigest() and found.rows == 1000
    with pytest.raises(ContractError):
        line_digest(df, ["k"], line, "", most=999)


def test_role_audits(spark):
    ids = lambda *xs: spark.createDataFrame([(x,) for x in xs], f"{EPISODE} string")
    found = V.role_overlaps(a=ids("x", "y"), b=ids("y", "z"), c=ids("x", "y")).collect()
    assert {(r.left_role, r.right_role, r.shared, r.example) for r in found} == {("a", "b", 1, "y"), ("a", "c", 2, "x"), ("b", "c", 1, "y")}
    with pytest.raises(ContractError, match="a and b share"):
        V.require_disjoint(a=ids("x"), b=ids("x"))
    with pytest.raises(ContractError, match="cover 1 of 2"):
        V.require_cover(ids("x", "y"), ids("x"))
    keyed = lambda *xs: spark.createDataFrame(list(xs), f"{EPISODE} string, {STEP} int")
    V.require_realigned(keyed(("a", 0), ("a", 1)), keyed(("a", 1), ("a", 0)))
    for other in (keyed(("a", 0)), keyed(("a", 0), ("a", 1), ("b", 0)), keyed(("a", 0), ("a", 1), ("a", 1))):
        with pytest.raises(ContractError):
            V.require_realigned(keyed(("a", 0), ("a", 1)), other)


def test_observations(made):
    seen = O.observations(made["train"], OBSERVED)
    back = O.observation_table(seen, OBSERVED)
    assert back.orderBy(EPISODE, STEP).collect() == made["train"].select(EPISODE, STEP, *OBSERVED).orderBy(EPISODE, STEP).collect()
    with pytest.raises(ContractError):
        O.observation_table(seen, OBSERVED[:2])


def test_fit_scope_checksum(built, made):
    allowed = set(built["behavior_clone"].episodes)
    assert E.audit_fit_scope(built, allowed)["behavior_clone"] == 36
    built["behavior_clone"].checksum = fit_checksum(built["behavior_clone"].episodes)
    E.audit_fit_scope(built, allowed)
    built["behavior_clone"].checksum = "0" * 64
    with pytest.raises(ContractError, match="checksum"):
        E.audit_fit_scope(built, allowed)
    del built["behavior_clone"].checksum


def test_support_adapter(made):
    frame = made["train"].toPandas()
    model = Propensity(OBSERVED, (1.0,), 2).fit(frame)
    adapter = SupportAdapter(model, OBSERVED)
    assert np.allclose(adapter.predict(frame), model.predict(frame)) and adapter.episodes == model.episodes
    told = model.diagnostics(frame)
    assert 0 < told["log_loss"] < 2 and 0 < told["brier"] < 2 and 0 <= told["ece"] <= 1 and told["fit_checksum"] == fit_checksum(model.episodes)
    with pytest.raises(ContractError):
        adapter.predict(frame.drop(columns=["sex"]))
    with pytest.raises(ContractError):
        SupportAdapter(model, OBSERVED[:2])


def test_fitted_q_refuses(made):
    frame = made["train"].toPandas()
    rewards, target = np.zeros(len(frame)), np.full((len(frame), 3), 1 / 3)
    with pytest.raises(ContractError, match="gamma"):
        FittedQ(OBSERVED, 3, 1.5).fit(frame, rewards, target)
    on = ~((frame[EPISODE] == frame[EPISODE].iloc[0]) & (frame[STEP] == 1)).to_numpy()
    with pytest.raises(ContractError, match="no step 1"):
        FittedQ(OBSERVED, 3).fit(frame[on], rewards[on], target[on])


def test_booster_without_ridge_is_quiet(recwarn):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 2))
    x[:30, 0] = np.nan
    Booster(BoostConfig(5, 0.1, 7, 1, 0.0)).fit(x, rng.normal(size=60))
    assert not [w for w in recwarn if issubclass(w.category, RuntimeWarning)]


def test_features_as_columns_equal_the_local_ones(spark, made):
    rows = made["train"].withColumn("map_mm_hg", F.when(F.col("time_step") != 1, F.col("map_mm_hg"))).withColumn("sex", F.when(F.col(EPISODE).endswith("5"), None).otherwise(F.col("sex")))
    frame = rows.toPandas()
    want = Features(OBSERVED, True).fit(frame).transform(frame)
    columns = fitted_features(rows, ["map_mm_hg", "lactate_mmol_l"], ["sex", "previous_action"], True)
    names = ["map_mm_hg", "lactate_mmol_l", "map_mm_hg_missing", *[c for c in columns if c.startswith(("sex", "previous")) and not (c == "previous_action_missing")]]
    got = rows.select(EPISODE, STEP, *[columns[n].alias(n) for n in names]).toPandas()
    met = frame[[EPISODE, STEP]].merge(got, on=[EPISODE, STEP])[names].to_numpy(dtype=float)
    assert np.allclose(met, want, atol=1e-9)
    x, y = frame[["lactate_mmol_l", "time_step"]].to_numpy(dtype=float), frame[["next_6h_map_delta", "next_6h_lactate_delta"]].to_numpy()
    w, b = fit_ridge(x, y, 5.0)
    out = ridge_columns(rows, [F.col("lactate_mmol_l"), F.col("time_step")], [F.col("next_6h_map_delta"), F.col("next_6h_lactate_delta")], 5.0)
    p = rows.select(EPISODE, STEP, *[c.alias(f"p{i}") for i, c in enumerate(out)]).toPandas()
    assert np.allclose(frame[[EPISODE, STEP]].merge(p, on=[EPISODE, STEP])[["p0", "p1"]].to_numpy(), x @ w + b, atol=1e-9)


def test_block_bootstrap_has_the_moments_of_a_resample(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(3, 2, 400)
    values = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "idx long, x double")
    got = I.block_sums(values, ["x"], 400, 7, seed=5).toPandas()
    means = got["x"] / got["m"]
    assert (got["m"] == 400).all() and abs(means.mean() - v.mean()) < 4 * v.std() / 20 / 20 and means.std() == pytest.approx(v.std() / 20, rel=0.15)
    again = I.block_sums(values.repartition(5), ["x"], 400, 7, seed=5).toPandas()
    assert got.sort_values("b").x.to_numpy() == pytest.approx(again.sort_values("b").x.to_numpy())


def test_permuted_rows(spark):
    df = spark.createDataFrame([(f"e{i}", t, i * 10 + t) for i in range(30) for t in range(3)], f"{EPISODE} string, {STEP} int, x int")
    out = I.permuted_rows(df, [EPISODE, STEP], "x").toPandas()
    assert sorted(out.x) == sorted(i * 10 + t for i in range(30) for t in range(3)) and (out.sort_values([EPISODE, STEP]).x.to_numpy() != df.toPandas().sort_values([EPISODE, STEP]).x.to_numpy()).mean() > 0.8


def test_raw_values_that_overflow_have_no_estimate(spark):
    values = spark.createDataFrame([(i, 1.0 + i, float("inf") if i == 2 else 2.0, float("nan") if i == 0 else 1.0) for i in range(4)], "idx long, a double, b double, c double")
    draws = I.PoissonDraws(20)
    got = {r.policy: r for r in I.raw_availability(values, draws, ["a", "b", "c"], "a").collect()}
    assert got["a"].available and got["a"].mean == 2.5 and got["a"].difference == 0 and got["a"].reason is None
    assert not got["b"].available and got["b"].finite_fraction == 0.75 and got["b"].mean is None and got["b"].reason
    turned = {r.policy: r for r in I.raw_availability(values, draws, ["a", "b", "c"], "b").collect()}
    assert turned["a"].available and turned["a"].mean == 2.5 and turned["a"].difference is None and turned["a"].difference_reason == "the baseline has no estimate"
    assert I.raw_availability(values.select("idx", "b", "c"), draws, ["b", "c"], "b").filter("available").count() == 0


def test_support_report(spark):
    rows = spark.createDataFrame([(f"e{i}", t, 60.0 + i, t % 3, [0.2, 0.3, 0.5], [0.4, 0.3, 0.3], [0.2, 0.3, 0.5][t % 3], [0.4, 0.3, 0.3][t % 3]) for i in range(10) for t in range(3)],
                                 "patient_id string, time_step int, map_mm_hg double, action_no int, target array<double>, behavior array<double>, target_logged double, behavior_logged double")
    got = U.support_report(rows, (1.2,))
    assert got["state"].first().mean_overlap == pytest.approx(0.8) and got["low_pressure"].first().episodes == 5 and got["actions"].count() == 3
    assert got["ratios"].first()["max"] == pytest.approx(5 / 3)
    weights = {(r[STEP], r.cap): r for r in got["weights"].collect()}
    assert len(weights) == 6 and weights[2, None].ess == pytest.approx(10) and weights[2, None].p50 == pytest.approx(0.5 * 1 * 5 / 3)


class Told:
    """A policy that answers like another and tells of its run."""

    def __init__(self, policy, **told):
        self.policy, self.diagnostics = policy, told
        self.schema_pass = told.get("schema_pass", True)

    def predict(self, frame):
        return self.policy.predict(frame)


def test_gates_see_the_run(built, made):
    """Every gate can fail inside an evaluation; fallbacks and schema come from the policy's run."""
    loose = E.Settings(gates={"max_fallback_rate": 0.02, "min_mean_overlap": 0.0, "max_low_support_mass": 1.0, "min_terminal_ess": 0.0, "max_weight_share": 1.0}, resamples=20)
    told = dict(built) | {"llm_zero_shot": Told(built["llm_zero_shot"], requests=100, fallbacks=3, malformed_outputs=3), "always_maintain": Told(built["always_maintain"], requests=72, schema_pass=False)}
    result = E.evaluate_policies(made["train"], made["validation"], told, loose)
    got = {r.policy: r for r in result.support.collect()}
    assert not got["llm_zero_shot"].gate_fallback and got["llm_zero_shot"].gate_schema and not got["llm_zero_shot"].eligible
    assert not got["always_maintain"].gate_schema and got["always_maintain"].gate_fallback and not got["always_maintain"].eligible
    assert got["behavior_clone"].eligible and got["llm_improved"].eligible and result.verdict["winner"] in ("behavior_clone", "llm_improved")
    run = {r.policy: r for r in result.runtime.collect()}
    assert run["llm_zero_shot"].fallback_rate == pytest.approx(0.03) and run["behavior_clone"].requests == 72 and run["llm_zero_shot"].malformed == 3
    assert result.samples.count() == 2 * 4 * 20 and result.gaps.count() == 4 and result.calibration.count() == 6 and result.shortcut.filter("slice = 'all_rows'").first()["rows"] == 252
    assert result.raw.filter("available").count() == 4 and result.behavior["fit_checksum"]
    strict = dataclasses.replace(loose, gates={"max_fallback_rate": 0.02, "min_mean_overlap": 2.0, "max_low_support_mass": -1.0, "min_terminal_ess": 1e9, "max_weight_share": -1.0})
    support = E.evaluate_policies(made["train"], made["validation"], built, strict).support
    assert support.filter("gate_overlap or gate_low_mass or gate_ess or gate_share").count() == 0 and support.filter("gate_schema and gate_fallback").count() == 8


def test_recovered_base():
    rng = np.random.default_rng(3)
    base, b = rng.dirichlet([1, 1, 1], 20), rng.dirichlet([1, 1, 1], 20)
    assert np.allclose(E.recovered_base(0.25 * base + 0.75 * b, b, 0.25), base, atol=1e-12)
    with pytest.raises(ContractError):
        E.recovered_base(base, b, 0.25)


def test_settings_of_a_configuration(spark, tmp_path):
    settings = E.settings_of(CONFIG)
    assert settings == dataclasses.replace(E.Settings(), gates=settings.gates) and settings.gates == E.Settings().gates
    changed = json.loads(json.dumps(CONFIG))
    changed["experiment"] |= {"horizon": 5, "seed": 7}
    changed["improvement"] = {"selected_variant": "value_only", "selected_parameters": {"base_temperature": 1.0, "advantage_weight": 0.2, "support_weight": 0.1}}
    changed["alternative_reward"] = {"map_weight": 0.0, "deterioration_penalty": 1.5}
    (tmp_path / "c.json").write_text(json.dumps(changed))
    found = E.settings_of(E.read_config(spark, str(tmp_path / "c.json")))
    assert (found.horizon, found.seed, found.variant, found.rewards["alternative"].deterioration) == (5, 7, "value_only", 1.5)
    (tmp_path / "d.json").write_text("[1]")
    with pytest.raises(ContractError):
        E.read_config(spark, str(tmp_path / "d.json"))
    for bad in ({"experiment": {"winner_gates": {"min_luck": 1}}}, {"reward": {"colour": 1}}, {"experiment": {"primary_importance_ratio_cap": 3.0}}, {"improvement": {"selected_variant": "value_only"}}):
        with pytest.raises((ContractError, ValueError)):
            E.settings_of(bad)


def test_release_faults(spark, tmp_path):
    for name, text in (("a.md", "fine"), ("b.py", "key = 'AKIA" + "A" * 16 + "'"), ("c.bin", "x"), ("d.csv", "y" * 500_001), ("sub/e.json", "-----BEGIN RSA PRIVATE KEY-----"), ("f.toml", "sk-" + "b" * 30)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {r.path.rsplit("/", 1)[1]: r.fault for r in release_faults(spark, str(tmp_path)).collect()}
    assert got == {"b.py": "cloud key", "c.bin": "kind of file", "d.csv": "size", "e.json": "private key", "f.toml": "service key"}


def test_scaled_evaluation(spark, made):
    """The ridge path fits and estimates like the local one: its values are those of ridge weights fitted by hand on the same rows."""
    rows = made["train"].withColumns({"action_no": X.action_number(F.col(ACTION)), "reward": X.PRIMARY.total(), "behavior": F.array(*[F.lit(1 / 3)] * 3)})
    valid = made["validation"].withColumns({"action_no": X.action_number(F.col(ACTION)), "reward": X.PRIMARY.total(), "behavior": F.array(*[F.lit(1 / 3)] * 3)})
    policies = {"always_maintain": Constant().column(), "llm_zero_shot": Analytic().column()}
    found = evaluate_scaled(rows, valid, policies, "ridge", 3, features=[F.col("map_mm_hg") / 100, F.col("lactate_mmol_l")], resamples=50, blocks=4)
    frame, other = rows.toPandas(), valid.toPandas()
    values = {}
    p = Analytic().predict(frame)
    ahead = {}
    for t in (2, 1, 0):
        on = (frame[STEP] == t).to_numpy()
        part, state = frame[on], np.column_stack([frame["map_mm_hg"][on] / 100, frame["lactate_mmol_l"][on]])

        def design(state, action):
            hot = np.eye(3)[action]
            return np.column_stack([state, hot, *[state * hot[:, a: a + 1] for a in range(3)]])

        y = part["reward"].to_numpy() + np.array([0.0 if t == 2 else ahead[e] for e in part[EPISODE]])
        w, b = fit_ridge(design(state, part["action_no"].to_numpy()), y, 5.0)
        q = np.column_stack([design(state, np.full(len(part), a)) @ w + b for a in range(3)])
        ahead = dict(zip(part[EPISODE], (p[on] * q).sum(axis=1)))
        if t == 0:
            first = other[other[STEP] == 0]
            state = np.column_stack([first["map_mm_hg"] / 100, first["lactate_mmol_l"]])
            q = np.column_stack([design(state, np.full(len(first), a)) @ w + b for a in range(3)])
            values = dict(zip(first[EPISODE], (Analytic().predict(first) * q).sum(axis=1)))
    got = {r[EPISODE]: r.direct for r in found.episodes.filter("policy = 'llm_zero_shot'").collect()}
    assert got == pytest.approx(values, abs=1e-9)
    summary = {(r.policy, r.estimator): r for r in found.summary.collect()}
    assert len(summary) == 4 and all(r.low <= r.mean <= r.high and r.per_decision == pytest.approx(r["mean"] / 3) for r in summary.values())
    assert {r.policy: r.ess for r in found.support.collect()}["always_maintain"] == 0
    with pytest.raises(ContractError):
        evaluate_scaled(rows, valid, policies, "trees", 3)


def test_configured_run(spark, tmp_path):
    root = str(tmp_path / "out")
    verdict = run_example(spark, root)
    assert verdict["status"] == "no eligible policy"
    read = lambda name: json.loads("\n".join(r.value for r in spark.read.text(f"{root}/{name}").collect()))
    manifest = read("input_manifest")
    assert manifest["splits"]["train"] | {"sha256": ""} == {"rows": 180, "episodes": 60, "sha256": ""} and len(manifest["splits"]["test"]["sha256"]) == 64
    assert read("policy_build")["development_episodes"] == 36 and read("config")["experiment"]["horizon"] == 3 and read("metrics")["provider_behavior"]["columns"][-1] == "provider_id"
    seeds = spark.read.parquet(f"{root}/seed_sensitivity").collect()
    assert len(seeds) == 4 and all(r.max_change == pytest.approx(0, abs=1e-12) for r in seeds)
    sites = spark.read.parquet(f"{root}/provider_sensitivity").collect()
    assert len(sites) == 4 and any(abs(r.mean_change) > 1e-6 for r in sites) and all(np.isfinite(r.sdr) for r in sites)
    table = spark.read.option("header", True).csv(f"{root}/comparison")
    assert len(table.columns) == 10 and table.count() == 4
    assert spark.read.option("header", True).csv(f"{root}/predictions").filter("policy_origin = 'deterministic_synthetic_not_llm'").count() == 36
