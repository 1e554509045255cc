"""Estimators, contracts, learners and the whole evaluation against hand-computed and published values."""

import json
import math
import os
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from rolloutlab import queries as registry
from rolloutlab.functions import expressions as X
from rolloutlab.operators import diagnostics as D
from rolloutlab.operators import gates as G
from rolloutlab.operators import inference as I
from rolloutlab.operators import sdr as S
from rolloutlab.operators import support as U
from rolloutlab.operators.booster import BoostConfig, Booster
from rolloutlab.operators.fqe import FittedQ, distributed_ridge
from rolloutlab.operators.learners import Features, Logistic, fit_ridge, fit_softmax, group_folds, softmax_rows
from rolloutlab.operators.policies import VARIANTS, Improved, model_selection, rerank, variant_parameters
from rolloutlab.plans import evaluate as E
from rolloutlab.plans import roles as R
from rolloutlab.plans import validation as V
from rolloutlab.schema import ACTION, ACTIONS, EPISODE, OBSERVED, STEP, ContractError, policy_columns
from rolloutlab.scoring import cache as C
from rolloutlab.scoring import prompts as P
from rolloutlab.sources.files import finite_or_null, json_safe, probability_digest, read_columns, read_trajectories, write_artifacts
from rolloutlab.sources.synthetic import generate
from rolloutlab.streaming.replay import LoggedReplay, running_rewards


@pytest.fixture(scope="module")
def made(spark):
    return {k: v.cache() for k, v in generate(spark).items()}


def sdr_rows(spark, rows):
    kind = "patient_id string, time_step int, reward double, terminal int, q_logged double, v double, v_next double, target_logged double, behavior_logged double"
    return spark.createDataFrame(rows, kind)


@pytest.mark.parametrize(("q", "v", "target", "behavior", "raw", "cap"), [
    ((3.0, 2.0), (3.0, 2.0), (1.0, 1.0), (1.0, 1.0), 3.0, 3.0), ((0.0, 0.0), (0.0, 0.0), (0.9, 0.9), (0.1, 0.1), 171.0, 15.0),
    ((0.0, 0.0), (0.0, 0.0), (0.0, 0.9), (0.5, 0.1), 0.0, 0.0), ((0.0, 0.0), (0.0, 0.0), (1.0, 1.0), (1e-300, 1e-300), math.inf, 10.0)])
def test_sequential_dr(spark, q, v, target, behavior, raw, cap):
    rewards = (1.0, 2.0)
    if cap == 10.0:
        rewards = (1.0, 1.0)
    rows = [("a", t, rewards[t], t, q[t], v[t], v[1] if t == 0 else 0.0, target[t], behavior[t]) for t in (0, 1)]
    steps, episodes = S.sequential_dr(sdr_rows(spark, rows), (5.0,))
    got = episodes.first()
    assert got["raw"] == pytest.approx(raw) and got["value_cap_5"] == pytest.approx(cap)
    if target[0] == 0:
        assert {r.log_w for r in steps.collect()} == {-math.inf}


@pytest.mark.parametrize("change", [{"target_logged": float("nan")}, {"behavior_logged": 0.0}, {"behavior_logged": 1.5}, {"target_logged": -0.1}, {"reward": math.inf}])
def test_sequential_dr_refuses(spark, change):
    row = {"patient_id": "a", "time_step": 0, "reward": 1.0, "terminal": 1, "q_logged": 0.0, "v": 0.0, "v_next": 0.0, "target_logged": 0.5, "behavior_logged": 0.5} | change
    with pytest.raises(ContractError):
        S.sequential_dr(sdr_rows(spark, [tuple(row.values())]), (5.0,))
    with pytest.raises(ValueError):
        S.cumulative_weights(sdr_rows(spark, [tuple(row.values())]), (0.0,))


def test_concentration(spark):
    rows = [("a", math.log(k) + 700) for k in (1, 2, 3)] + [("z", -math.inf)] * 2 + [("i", math.inf)] * 2 + [("i", 3.0)]
    got = {r.g: r for r in U.concentration(spark.createDataFrame(rows, "g string, lw double"), "lw", ["g"]).collect()}
    assert got["a"].ess == pytest.approx(36 / 14) and got["a"].max_share == pytest.approx(0.5)
    assert (got["z"].ess, got["z"].max_share) == (0, 0) and got["i"].ess == 2
    summary = {r.g: r for r in U.weight_summary(spark.createDataFrame(rows, "g string, lw double"), "lw", ["g"]).collect()}
    assert summary["i"].overflow_count == 2 and not summary["i"].linear_scale_valid and summary["i"].p50 is None and summary["z"].zero_fraction == 1


def test_reward_signs(spark):
    cols = "next_6h_map_delta double, next_6h_lactate_delta double, next_6h_deterioration int, adverse_hypotension_next_6h int, adverse_fluid_overload_next_6h int, adverse_tachyarrhythmia_next_6h int"
    df = spark.createDataFrame([(5.0, 1.0, 1, 0, 1, 0)], cols)
    want = 0.45 * math.tanh(1) - 0.25 * math.tanh(1) - 0.9 - 0.7
    assert df.select(X.PRIMARY.total()).first()[0] == pytest.approx(want)
    assert df.select(X.ALTERNATIVE.total()).first()[0] == pytest.approx(-0.25 * math.tanh(1) - 2.4)
    assert df.select(X.PRIMARY.faults()).first()[0] is False
    with pytest.raises(ValueError):
        X.Reward(map_scale=0)
    with pytest.raises(ValueError):
        X.Reward(deterioration=-1)


def test_expressions_on_edges(spark):
    one = spark.createDataFrame([([1 / 3, 1 / 3, 1 / 3], [1.0, 0.0, 0.0])], "u array<double>, c array<double>")
    row = one.select(X.top_action(F.col("u")), X.entropy(F.col("c")), X.margin(F.col("c")), X.total_variation(F.col("u"), F.col("c")), X.safe_log(F.lit(0.0)), X.safe_exp(F.lit(1000.0))).first()
    assert row[0] == 0 and row[1] == 0 and row[2] == 1 and row[3] == pytest.approx(2 / 3) and row[4] == -math.inf and row[5] == math.inf
    with pytest.raises(Exception, match="unknown action"):
        spark.createDataFrame([("jump",)], "a string").select(X.action_index(F.col("a"))).collect()


def test_transform_twins_agree(spark):
    rng = np.random.default_rng(1)
    base, values, support = softmax_rows(rng.normal(size=(20, 3))), rng.normal(size=(20, 3)), softmax_rows(rng.normal(size=(20, 3)) * 3)
    how = dict(temperature=2.0, advantage=0.5, anchor=1.0, scale=0.75, penalty=0.25)
    df = spark.createDataFrame([(i, base[i].tolist(), values[i].tolist(), support[i].tolist()) for i in range(20)], "i int, b array<double>, v array<double>, s array<double>")
    got = df.select("i", X.reranked(F.col("b"), F.col("v"), F.col("s"), **how).alias("p")).orderBy("i").toPandas()
    assert np.allclose(np.stack(got.p), rerank(base, values, support, **how), atol=1e-12)


class Fixed:
    def __init__(self, p):
        self.p, self.episodes = p, []

    def predict(self, frame):
        return self.p


@pytest.mark.parametrize("variant", list(VARIANTS))
def test_variants(variant):
    base, values, support = np.array([[0.6, 0.3, 0.1]]), np.array([[0.0, 1.0, 2.0]]), np.array([[0.2, 0.2, 0.6]])
    chosen = {"base_temperature": 2.0, "advantage_weight": 0.5, "support_weight": 1.0}
    got = Improved(Fixed(base), Fixed(values), Fixed(support), variant, chosen, 0.75).predict(pd.DataFrame({"x": [1]}))
    t, a, s = VARIANTS[variant]
    want = rerank(base, values, support, 2.0 if t else 1.0, 0.5 * a, 1.0 * s, 0.75)
    weight = {"behavior_blend_25": 0.25, "behavior_blend_50": 0.5, "behavior_blend_75": 0.75}.get(variant, 1)
    assert np.allclose(got, base if variant == "zero_shot" else weight * want + (1 - weight) * support)
    with pytest.raises(ValueError):
        variant_parameters(variant, {"base_temperature": 1.0})
    assert model_selection({}) is None and model_selection({"improvement": {"selected_variant": variant, "selected_parameters": chosen}})[0] == variant
    with pytest.raises(ValueError):
        model_selection({"improvement": {"selected_variant": variant}})


def test_policy_columns():
    assert policy_columns(list(OBSERVED)) == OBSERVED
    for bad in ([], ["sex", "sex"], ["icu_mortality"], ["next_6h_map_delta"], ["adverse_x"], [ACTION], [EPISODE]):
        with pytest.raises(ContractError):
            policy_columns(bad)


@pytest.mark.parametrize(("column", "value", "what"), [
    (ACTION, "'jump'", "unknown action"), ("terminal", "0", "terminal"), (STEP, "time_step + 1", "consecutive"), ("previous_action", "'iv_fluids'", "previous action"), (EPISODE, "'one'", "repeated key")])
def test_trajectory_contract(made, column, value, what):
    V.validate_trajectory(made["train"], 3)
    V.validate_environment(made["train"], OBSERVED)
    with pytest.raises(ContractError, match=what):
        V.validate_trajectory(made["train"].withColumn(column, F.expr(value)), 3)
    with pytest.raises(ContractError, match="length"):
        V.validate_trajectory(made["train"], 4)


def test_environment_contract(made):
    with pytest.raises(ContractError, match="binary"):
        V.validate_environment(made["train"].withColumn("next_6h_deterioration", F.lit(2)), OBSERVED)
    with pytest.raises(ContractError, match="maintain"):
        V.validate_environment(made["train"].withColumn("previous_action", F.when(F.col(STEP) == 0, "iv_fluids").otherwise(F.col("previous_action"))), OBSERVED)
    with pytest.raises(ContractError, match="share"):
        V.require_disjoint(a=made["train"], b=made["train"].limit(3))


def test_roles(spark, made):
    got = R.manifest(R.training_roles(made["train"])).first()
    assert tuple(got) == (36, 24, "ea87b42f8678e379256a911d78a42c49d34383463b888ed7b9082465d263712c")
    ids = spark.createDataFrame([(f"p{i:03d}",) for i in range(10)], "patient_id string")
    roles = R.training_roles(ids, 0.6, 7)
    assert {r["role"]: r["count"] for r in roles.groupBy("role").count().collect()} == {R.DEVELOPMENT: 6, R.NUISANCE: 4}
    again = R.training_roles(ids.orderBy(F.desc("patient_id")), 0.6, 7)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, roles.collect()))
    assert sorted(np.bincount(group_folds(np.repeat([f"p{i}" for i in range(7)], 3), 3))) == [6, 6, 9]


def test_bootstrap_pairs_share_draws(spark):
    values = spark.createDataFrame([(i, float(i), float(i) + 1) for i in range(4)], "idx long, base double, other double")
    draws = I.PoissonDraws(40)
    rows = {r.policy: r for r in I.paired_bootstrap(values, draws, ["base", "other"], "base").collect()}
    assert (rows["other"].difference, rows["other"].difference_low, rows["other"].difference_high) == pytest.approx((1, 1, 1))
    gap = I.paired_gap(values, I.index_draws(spark, np.array([[0, 0, 1], [1, 2, 3], [3, 3, 3]])), "other", "base").first()
    assert gap.excludes_zero and gap.standard_error == pytest.approx(0) and gap.resamples == 3


def test_max_t(spark):
    rng = np.random.default_rng(0)
    data = {f"{e}_{p}": rng.normal(size=6) for e in ("direct", "sdr") for p in ("a", "b", "c")}
    data["sdr_c"] = data["sdr_b"]
    values = spark.createDataFrame(pd.DataFrame({"idx": range(6), **data}))
    at = rng.integers(0, 6, (250, 6))
    got = I.max_t(values, I.index_draws(spark, at), ["a", "b", "c"], ["direct", "sdr"]).collect()
    assert len(got) == 6
    tops = np.zeros(250)
    for r in got:
        gap = data[f"{r.estimator}_{r.left_policy}"] - data[f"{r.estimator}_{r.right_policy}"]
        samples = gap[at].mean(axis=1)
        assert r.point == pytest.approx(gap.mean()) and r.standard_error == pytest.approx(samples.std(ddof=1), abs=1e-12)
        if r.standard_error > 1e-12:
            tops = np.maximum(tops, abs(samples - gap.mean()) / samples.std(ddof=1))
    assert got[0].critical == pytest.approx(np.quantile(tops, 0.95, method="higher"))
    turned = I.directed(spark.createDataFrame(got)).filter("left_policy = 'b' and right_policy = 'a'").collect()
    assert {r.estimator: r.low for r in turned} == pytest.approx({r.estimator: -r.high for r in got if (r.left_policy, r.right_policy) == ("a", "b")})


def test_cluster_shift(spark):
    df = spark.createDataFrame([(0, [0.5, 0.3, 0.2], [0.6, 0.2, 0.2]), (0, [0.5, 0.3, 0.2], [0.6, 0.2, 0.2]), (1, [0.2, 0.2, 0.6], [0.2, 0.2, 0.6])], "idx long, p array<double>, q array<double>")
    rows = {r.action_no: r for r in I.cluster_shift(df, "p", "q", "idx", I.PoissonDraws(100)).collect()}
    assert rows[0].mean_shift == pytest.approx(0.2 / 3) and rows[0].low == pytest.approx(0) and rows[0].high == pytest.approx(0.1) and rows[2].mean_shift == 0


def test_calibration_edges(spark):
    identity = spark.createDataFrame([([1.0, 0.0, 0.0], 0), ([0.0, 1.0, 0.0], 1), ([0.0, 0.0, 1.0], 2)], "p array<double>, a int")
    row = D.calibration(identity, "p", "a").first()
    assert (row.ece, row.accuracy, row.brier) == (0, 1, 0) and row.log_loss == pytest.approx(0)
    at = spark.createDataFrame([(x,) for x in (0.0, 0.1, 0.4, 0.5, 0.95, 1.0)], "x double")
    assert [r[0] for r in at.select(D.left_closed_bin(F.col("x"), 10)).collect()] == [0, 1, 4, 5, 9, 9]
    assert [r[0] for r in at.select(D.right_closed_bin(F.col("x"), 10)).collect()] == [0, 0, 3, 4, 9, 9]


def test_gates_and_verdict(spark):
    good = dict(policy="a", schema_pass=True, fallback_rate=0.0, overlap=0.6, low_mass=0.0, ess=12.0, share=0.1)
    rows = [good, {**good, "policy": "b", "ess": 9.0}, {**good, "policy": "c", "share": None}, {**good, "policy": "d", "fallback_rate": 0.5}]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "policy string, schema_pass boolean, fallback_rate double, overlap double, low_mass double, ess double, share double")
    assert {r.policy: r.eligible for r in G.eligibility(df).collect()} == {"a": True, "b": False, "c": False, "d": False}
    means, both = {"a": 2.0, "b": 1.0, "c": 2.0}, [{"estimator": e, "left_policy": "a", "right_policy": "b", "low": 0.1} for e in ("direct", "sdr")]
    ask = lambda **k: G.verdict(["a", "b", "c"], k.get("eligible", ["a", "b"]), means, k.get("alternative", means), k.get("sensitivity", means), k.get("both", both), ["direct", "sdr"])
    assert ask()["robust"] and ask()["ranking"] == ["a", "c", "b"]
    assert not ask(alternative={"a": 0, "b": 1})["robust"] and not ask(sensitivity={"a": 2.5, "b": 0})["robust"] and not ask(eligible=["a"])["robust"]
    assert not ask(both=[both[0], {**both[1], "low": -0.1}])["robust"] and ask(eligible=[])["status"] == "no eligible policy"


def test_fqe_recursion():
    rows = [{EPISODE: f"e{i}", STEP: t, "map_mm_hg": 60.0 + i, "previous_action": ACTIONS[0] if t == 0 else ACTIONS[i % 3], ACTION: ACTIONS[(i + t) % 3], "terminal": t} for i in range(30) for t in (0, 1)]
    frame = pd.DataFrame(rows)
    action = frame[ACTION].map({a: i for i, a in enumerate(ACTIONS)}).to_numpy()
    rewards = np.where(frame[STEP] == 1, action + 1.0, 0.0)
    target = np.tile([1.0, 0.0, 0.0], (60, 1))
    q = FittedQ(("map_mm_hg",), 2, learner="ridge", alpha=1e-8).fit(frame, rewards, target).predict(frame)
    assert np.allclose(q[frame[STEP] == 1], [1, 2, 3], atol=1e-6) and np.allclose(q[frame[STEP] == 0][:, 0], 1, atol=1e-6)
    with pytest.raises(ContractError):
        FittedQ(("map_mm_hg",), 3).fit(frame, rewards, target)


def test_booster():
    x = np.arange(40.0)[:, None]
    y = (x[:, 0] >= 20) * 2.0
    fitted = Booster(BoostConfig(200, 0.2, 3, 5, 0.0)).fit(x, y)
    assert np.allclose(fitted.predict(x), y, atol=1e-6)
    x[3] = np.nan
    assert np.isfinite(Booster(BoostConfig(5, 0.1, 3, 5, 1.0)).fit(x, y).predict(x)).all()
    assert np.allclose(Booster(BoostConfig(5, least=30)).fit(x, y).predict(x), y.mean())


def test_softmax_is_optimal():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(80, 3)), rng.integers(0, 3, 80)
    w = fit_softmax(x, y, 0.7)
    design = np.column_stack([x, np.ones(80)])
    gradient = 0.7 * design.T @ (softmax_rows(design @ w) - np.eye(3)[y])
    gradient[:-1] += w[:-1]
    assert np.abs(gradient).max() < 1e-8


def test_features_with_gaps():
    frame = pd.DataFrame({"map_mm_hg": [1.0, np.nan, 3.0, 8.0], "sex": ["F", None, "F", "M"]})
    f = Features(("map_mm_hg", "sex"), True).fit(frame)
    x = f.transform(frame)
    assert x.shape == (4, 5) and np.allclose(x[:, :2].mean(axis=0), 0) and x[1, 4] == 1
    assert np.allclose(f.transform(pd.DataFrame({"map_mm_hg": [np.nan], "sex": ["X"]}))[0, 2:4], 0)


def test_clone_needs_all_actions(made):
    frame = made["train"].toPandas()
    with pytest.raises(ContractError):
        Logistic(OBSERVED, 1.0).fit(frame[frame[ACTION] != ACTIONS[2]])


def test_distributed_ridge_equals_local(spark, made):
    rows = made["train"].withColumns({"features": F.array(F.col("map_mm_hg") / 100, "lactate_mmol_l"), "no": X.action_index(F.col(ACTION)), "r": X.PRIMARY.total(), "pi": F.array(F.lit(0.2), F.lit(0.3), F.lit(0.5))})
    got = distributed_ridge(rows, "features", "no", "r", ["pi"], 3, alpha=5.0, width=2).toPandas()
    frame = rows.toPandas()
    ahead = {}
    for t in (2, 1, 0):
        part = frame[frame[STEP] == t]
        y = part.r.to_numpy() + np.array([ahead.get(e, 0.0) for e in part[EPISODE]])
        x = lambda a: np.column_stack([np.stack(part.features), np.eye(3)[a], *[np.stack(part.features) * np.eye(3)[a][:, k: k + 1] for k in range(3)]])  # noqa: B023, E731
        w, b = fit_ridge(x(part.no.to_numpy()), y, 5.0)
        q = np.column_stack([x(np.full(len(part), a)) @ w + b for a in range(3)])
        ahead = dict(zip(part[EPISODE], q @ [0.2, 0.3, 0.5]))
        mine = got[got[STEP] == t].set_index(EPISODE).loc[part[EPISODE]]
        assert np.allclose(np.stack(mine.q_pi), q, atol=1e-9)


def test_published_values(spark, made, tmp_path):
    """The deterministic example: direct and capped values, intervals, role counts and verdict."""
    policies, receipt = E.build_policies(made["train"])
    result = E.evaluate_policies(made["train"], made["validation"], policies)
    rows = {(r.estimator, r.policy): r for r in result.summary.collect()}
    direct = {"always_maintain": -0.22509150229498975, "behavior_clone": -0.13446690481846524, "llm_zero_shot": -0.1411894468321771, "llm_improved": -0.13400782603184636}
    capped = {"always_maintain": 0.07847705988359262, "behavior_clone": -0.0832700769786972, "llm_zero_shot": -0.06275146064473001, "llm_improved": -0.11287866196532347}
    exact = {"always_maintain": 1e-12, "llm_zero_shot": 1e-12, "llm_improved": 1e-5, "behavior_clone": 1e-4}
    for p in direct:
        assert rows["direct", p]["mean"] == pytest.approx(direct[p], abs=exact[p]) and rows["sdr", p]["mean"] == pytest.approx(capped[p], abs=1e-4)
    assert rows["direct", "always_maintain"].low == pytest.approx(-0.350401, abs=1e-6) and rows["direct", "always_maintain"].high == pytest.approx(-0.1198, abs=1e-6)
    ess = {r.policy: r.ess for r in result.support.collect()}
    assert ess["always_maintain"] == 0 and ess["llm_zero_shot"] == pytest.approx(9.561982, abs=1e-2)
    assert result.verdict["status"] == "no eligible policy" and result.simultaneous.count() == 12
    assert (receipt["development_episodes"], receipt["nuisance_episodes"]) == (36, 24)
    assert E.comparison(result).count() >= 4 and result.stress.count() == 8
    write_artifacts(result, R.training_roles(made["train"]), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/episodes")).count() == 8 * 2 * 2 * 24
    test = E.predictions(made["test"], policies["llm_improved"]).collect()
    assert len(test) == 36 and all(abs(sum(r[2:5]) - 1) < 1e-9 for r in test)
    policies["behavior_clone"].episodes = ["SYN-VALIDATION-000"]
    with pytest.raises(ContractError):
        E.evaluate_policies(made["train"], made["validation"], policies)


def test_files(spark, made, tmp_path):
    made["train"].coalesce(1).write.option("header", True).csv(str(tmp_path / "t"))
    assert read_trajectories(spark, str(tmp_path / "t")).orderBy(EPISODE, STEP).collect() == made["train"].orderBy(EPISODE, STEP).collect()
    (tmp_path / "c.json").write_text(json.dumps(list(OBSERVED)))
    assert read_columns(spark, str(tmp_path / "c.json")) == OBSERVED
    assert json_safe({"a": float("nan"), "b": [np.float64(1), True]}) == {"a": None, "b": [1.0, True]}
    assert finite_or_null(spark.createDataFrame([(math.inf,)], "x double")).first()[0] is None
    assert len(probability_digest(made["train"].withColumn("p", F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))), "p")) == 64


def test_notes_and_answers(spark):
    assert P.note_block(None).count("\n") == 2
    block = P.note_block('He said "stop"\né')
    assert block.isascii() and len(block.splitlines()) == 3 and json.loads(block.splitlines()[1])["text"].endswith("é")
    for bad in ("begin_untrusted_handoff_note", "<|im_start|>", "x" * 4001):
        with pytest.raises(P.NoteError):
            P.note_block(bad)
        assert spark.createDataFrame([(bad,)], "n string").select(P.note_faults(F.col("n"))).first()[0]
    with pytest.raises(P.NoteError):
        P.note_block(" ", required=True)
    assert P.parse_answer('{"probabilities": {"maintain": 2, "iv_fluids": 1, "escalate_vasopressor": 1}, "rationale": "x"}')[0] == [0.5, 0.25, 0.25]
    assert P.average_orders([[0.6, 0.3, 0.1], [0.3, 0.1, 0.6], [0.1, 0.6, 0.3]]) == pytest.approx([0.6, 0.3, 0.1])
    state = {"map_mm_hg": 60.0, "lactate_mmol_l": float("nan"), "sex": "F", "previous_action": "maintain"}
    assert P.request_key(P.choice_messages(state, OBSERVED), model_id="m") != P.request_key(P.choice_messages(state, OBSERVED, (1, 2, 0)), model_id="m")
    with pytest.raises(ContractError):
        P.policy_messages({**state, "extra": 1}, OBSERVED)
    answers = spark.createDataFrame([("not json",), ('{"probabilities": {}, "rationale": ""}',)], "raw string")
    out = C.parsed_answers(answers, "raw")
    assert C.runtime(out).first().fallbacks == 2 and out.first().target == [0.8, 0.15, 0.05]


def test_cache_replay(spark, made, tmp_path):
    keyed = C.with_keys(made["validation"].select(EPISODE, STEP, *OBSERVED), OBSERVED, "m").cache()
    path = str(tmp_path / "cache")
    record = F.struct(F.lit(0.5).alias("maintain"), F.lit(0.25).alias("iv_fluids"), F.lit(0.25).alias("escalate_vasopressor")).alias("probabilities")
    new = keyed.limit(5).select("key", F.lit("m").alias("model_id"), F.lit("h").alias("prompt_sha256"), record)
    C.append_lines(None, new, path)
    cache = C.read_lines(spark, path, C.PROBABILITIES)
    with pytest.raises(ContractError):
        C.replay(keyed, cache)
    done = C.replay(keyed, cache, lambda keys: np.tile([0.2, 0.3, 0.5], (len(keys), 1)))
    assert done.count() == keyed.count() and done.filter("target[0] = 0.5").count() >= 5
    with pytest.raises(ContractError):
        C.append_lines(cache, new.withColumn("model_id", F.lit("other")), path)
    (tmp_path / "bad").write_text('{"key": "a", "response": "x"}\n{"key": "a", "response": "y"}\n')
    with pytest.raises(ContractError):
        C.read_lines(spark, str(tmp_path / "bad"), C.RESPONSES)


def test_logged_replay(spark, made, tmp_path):
    walk = LoggedReplay(made["train"], OBSERVED)
    with pytest.raises(ContractError):
        walk.step_logged()
    assert walk.reset("SYN-TRAIN-003").previous_action == "maintain"
    steps = [walk.step_logged() for _ in range(3)]
    assert [s["terminated"] for s in steps] == [False, False, True] and steps[2]["next_observation"] is None and steps[0]["next_observation"] == steps[1]["observation"]
    with pytest.raises(ContractError):
        walk.step_logged()
    path = str(tmp_path / "s")
    timed = made["train"].withColumn("at", F.timestamp_seconds(F.col(STEP) * 90_000))
    timed.write.parquet(path)
    stream = running_rewards(spark.readStream.schema(timed.schema).parquet(path), "at").writeStream.format("memory").queryName("rewards").outputMode("complete").start()
    stream.processAllAvailable()
    stream.stop()
    assert spark.table("rewards").agg(F.sum("rows")).first()[0] == 180


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_queries_match_sql(spark, data, name):
    out = registry.queries()[name](spark, data).toPandas()
    assert len(out)
    sql = registry.oracle_sql().get(name)
    if not sql:
        return
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{data}/{f}'")
    want = con.execute(sql).fetchdf()
    assert sorted(out.columns) == sorted(want.columns)
    plain = lambda df: sorted(tuple(f"{v:.5f}" if isinstance(v, float) else str(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))
    a, b = plain(out), plain(want)
    close = lambda x, y: x == y or all(p == q or (re.fullmatch(r"-?\d+\.\d+", p) and abs(float(p) - float(q)) < 2e-5) for p, q in zip(x, y))
    assert len(a) == len(b) and all(close(x, y) for x, y in zip(a, b))


def test_fqe_ridge_runs_whole_episodes(spark, data):
    frame = registry.with_behavior(spark, data).toPandas()
    sizes = frame.groupby(STEP).size().to_dict()
    assert sorted(sizes) == list(range(12))
    ahead, want = {}, {}
    for t in range(11, -1, -1):
        part = frame[frame[STEP] == t]
        value, no = part["value"].to_numpy()[:, None] / 100, part.action_no.to_numpy()
        y = part.reward.to_numpy() + np.array([ahead.get(e, 0.0) for e in part[EPISODE]])
        x = lambda a: np.column_stack([value, np.eye(3)[a], value * np.eye(3)[a]])  # noqa: B023, E731
        w, b = fit_ridge(x(no), y, 5.0)
        v = sum(np.stack(part.target)[:, a] * (x(np.full(len(part), a)) @ w + b) for a in range(3))
        ahead, want[t] = dict(zip(part[EPISODE], v)), v.mean()
    ridge = registry.queries()["fqe_ridge"](spark, data).toPandas().set_index(STEP)
    assert ridge.rows.to_dict() == sizes
    assert all(abs(ridge.v_target[t] - want[t]) < 2e-6 for t in want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 12
