"""Learners fitted where the rows are, against those fitted in memory."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rolloutlab.operators import boosted as B
from rolloutlab.operators import learners as M
from rolloutlab.operators import logistic as L
from rolloutlab.operators.fqe import FittedQ, distributed_ridge
from rolloutlab.operators.teacher import held_out_values
from rolloutlab.queries import queries, steps
from rolloutlab.schema import ACTION, ACTIONS, EPISODE, STEP, ContractError
from rolloutlab.sources.events import HORIZON

NUMERIC, CATEGORICAL = ("map_mm_hg", "lactate_mmol_l"), ("sex", "previous_action")
COLUMNS = (*NUMERIC, *CATEGORICAL)
GRID = (0.01, 0.1, 1.0, 10.0)


def log_frame(seed, episodes, steps=4, gaps=True, repeats=False):
    """A log of decisions with gaps, rare categories and episodes of unequal length."""
    rng = np.random.default_rng(seed)
    rows = []
    for e in range(episodes):
        before = "maintain"
        for t in range(steps + (e % 3 if repeats else 0)):
            m, lac, sex = rng.normal(70, 12), rng.gamma(2.0), "F" if rng.random() < 0.5 else "M"
            z = np.array([0.3, (65 - m) / 15 + 0.3 * lac, lac - 2 + (sex == "F")]) * 0.7
            a = ACTIONS[rng.choice(3, p=np.exp(z - z.max()) / np.exp(z - z.max()).sum())]
            rows.append((f"e{e:03d}", t, m if not gaps or rng.random() < 0.8 else None, lac if not gaps or rng.random() < 0.95 else None, sex if rng.random() < 0.9 else None, before if rng.random() < 0.95 else None, a, rng.normal() + (a == "maintain") - 0.02 * m))
            before = a
    return pd.DataFrame(rows, columns=[EPISODE, STEP, *COLUMNS, ACTION, "reward"])


def table(spark, frame, parts=5):
    clean = frame.astype(object).where(frame.notna(), None)
    df = spark.createDataFrame([tuple(r) for r in clean.itertuples(index=False)], f"{EPISODE} string, {STEP} int, map_mm_hg double, lactate_mmol_l double, sex string, previous_action string, {ACTION} string, reward double")
    no = sum((F.when(F.col(ACTION) == a, i).otherwise(0) for i, a in enumerate(ACTIONS)), F.lit(0))
    return df.withColumn("action_no", no).repartition(parts)


@pytest.fixture(scope="module", params=[(1, 40, True), (2, 31, False)])
def logged(request, spark):
    frame = log_frame(request.param[0], request.param[1], gaps=request.param[2], repeats=True)
    return frame, table(spark, frame).persist()


def predicted(df, column):
    found = df.select(EPISODE, STEP, column).toPandas().sort_values([EPISODE, STEP])
    return np.stack(found[column].to_list())


def in_order(frame, p):
    return p[frame.reset_index(drop=True).sort_values([EPISODE, STEP]).index.to_numpy()]


def test_clone_is_the_one_fitted_in_memory(logged):
    frame, df = logged
    for c in (0.1, 10.0):
        want = M.Logistic(COLUMNS, c).fit(frame).predict(frame)
        model = L.fit_clone(df, NUMERIC, CATEGORICAL, "action_no", c)
        assert np.allclose(predicted(L.with_probabilities(df, [model], F.lit(0), "p"), "p"), in_order(frame, want), atol=1e-8)


def test_weights_are_the_same_up_to_the_free_direction(logged):
    frame, df = logged
    want = M.Logistic(COLUMNS, 1.0).fit(frame)
    got = L.fit_clone(df, NUMERIC, CATEGORICAL, "action_no", 1.0)
    assert want.weights.shape == got.fitted.own[0].shape
    assert np.allclose(got.fitted.own[0] - got.fitted.own[0].mean(axis=1, keepdims=True), want.weights - want.weights.mean(axis=1, keepdims=True), atol=1e-8)


def test_penalty_by_stacked_folds(logged):
    frame, df = logged
    want, losses = M.choose_c(frame, M.Features(COLUMNS, True), GRID, 3)
    got, found = L.choose_penalty(df, NUMERIC, CATEGORICAL, "action_no", GRID, 3)
    assert got == want and found == pytest.approx(losses, rel=1e-9)


def test_a_newton_step_of_all_models_is_one_job(logged, spark):
    _, df = logged
    placed = df.join(L.folds(df, 3), EPISODE)
    design = L.raw_design(df, NUMERIC, CATEGORICAL)
    rows = L.prepared(placed, design, "action_no", [], *L.fold_marks(F.col("fold"), 3))
    turned = L.transforms(rows, design, 3)
    spark.sparkContext.setJobGroup(f"newton {id(df)}", "one step")
    L.newton_sums(rows, design, 3, [s for s in range(3) for _ in GRID], [t @ np.zeros((t.shape[1], 3)) for t in turned for _ in GRID])
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(f"newton {id(df)}")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 2  # the shuffle's own map stage counts as one under adaptive plans


def test_calibrated_propensity(logged):
    frame, df = logged
    want = M.Propensity(COLUMNS, GRID, 3, 1e-3).fit(frame)
    model, losses = L.fit_propensity(df, NUMERIC, CATEGORICAL, "action_no", GRID, 3, 1e-3)
    assert losses == pytest.approx(want.losses, rel=1e-9)
    assert np.allclose(predicted(L.with_probabilities(df, [model], F.lit(0), "p"), "p"), in_order(frame, want.predict(frame)), atol=1e-7)


def test_propensity_of_one_episode_is_not_calibrated(spark):
    frame = log_frame(5, 1, 40)
    df = table(spark, frame)
    model, losses = L.fit_propensity(df, NUMERIC, CATEGORICAL, "action_no")
    assert model.sigmoids is None and losses == {} and L.choose_penalty(df, NUMERIC, CATEGORICAL, "action_no", (0.5, 1.0), 3) == (0.5, {})
    want = M.Propensity(COLUMNS).fit(frame)
    assert np.allclose(predicted(L.with_probabilities(df, [model], F.lit(0), "p"), "p"), in_order(frame, want.predict(frame)), atol=1e-8)


def test_nested_out_of_fold_probabilities(logged):
    frame, df = logged
    want = M.Propensity(COLUMNS, (0.1, 1.0), 3, 1e-3).fit(frame).out_of_fold(frame)
    got = L.out_of_fold(df, NUMERIC, CATEGORICAL, "action_no", (0.1, 1.0), 3, 1e-3)
    assert got.columns == [*df.columns, "behavior"]
    assert np.allclose(predicted(got, "behavior"), in_order(frame, want), atol=1e-7)


def test_a_missing_action_is_refused(spark):
    df = table(spark, log_frame(3, 10)).filter(F.col("action_no") < 2)
    with pytest.raises(ContractError, match="every action"):
        L.fit_clone(df, NUMERIC, CATEGORICAL, "action_no", 1.0)


# ---- boosted trees ------------------------------------------------------------


def wide_rows(seed, n, width, gaps=True, values=40):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, values, (n, width)) / 7
    y = np.sin(x[:, 0]) + (x[:, 1] > 2) * x[:, -1] + rng.normal(size=n) * 0.3
    if gaps:
        x = np.where(rng.random(x.shape) < 0.1, np.nan, x)
    return x, y


@pytest.mark.parametrize(("config", "gaps"), [(B.BoostConfig(12, 0.2, 7, 10), True), (B.BoostConfig(3, 0.5, 15, 5, 1.0), False), (B.BoostConfig(2, 0.1, 2, 200), True), (B.BoostConfig(1, 0.3, 31, 3), True)])
def test_boosted_trees_are_those_of_memory(spark, config, gaps):
    x, y = wide_rows(6, 500, 4, gaps)
    want = B.Booster(config).fit(x, y)
    df = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y)], "x array<double>, y double").repartition(4)
    got = B.fit_boosted(df, "x", "y", 4, config)
    assert len(got.trees) == config.iterations
    assert [sorted(len(n) for n in t) for t in got.trees] == [sorted(len(n) for n in t) for t in want.trees]
    assert np.allclose(got.predict(x), want.predict(x), atol=1e-9)


def test_bins_of_many_values_are_quantiles(spark):
    df = spark.range(20_000).select(F.array(F.col("id").cast("double"), F.lit(1.0), F.lit(None).cast("double")).alias("x"))
    many, one, none = B.bin_cuts(df, "x", 3)
    assert len(many) == B.MOST_BINS - 1 and np.abs(np.diff(many) - 20_000 / 256).max() < 3 and len(one) == 0 and len(none) == 0


def test_boosted_fitted_q_is_the_one_in_memory(spark):
    rng = np.random.default_rng(9)
    frame = log_frame(4, 60, 4, gaps=False)
    frame = frame.assign(map_mm_hg=frame["map_mm_hg"].round(0), lactate_mmol_l=frame["lactate_mmol_l"].round(1), terminal=(frame[STEP] == 3).astype(int))
    target = rng.dirichlet([1, 1, 1], len(frame))
    config = B.BoostConfig(4, 0.3, 5, 8)
    want = FittedQ(NUMERIC, 4, 0.9, boost=config).fit(frame, frame["reward"].to_numpy(), target).predict(frame)
    rows = [(r[EPISODE], int(r[STEP]), [r["map_mm_hg"], r["lactate_mmol_l"]], ACTIONS.index(r[ACTION]), r["reward"], int(r["terminal"]), p.tolist()) for r, p in zip(frame.to_dict("records"), target)]
    df = spark.createDataFrame(rows, f"{EPISODE} string, {STEP} int, f array<double>, action_no int, reward double, terminal int, target array<double>").repartition(3)
    got = B.boosted_values(df, "f", "action_no", "reward", "target", 4, 2, 0.9, config)
    assert got.columns == [*df.columns, "q", "v"]
    assert np.allclose(predicted(got, "q"), in_order(frame, want), atol=1e-7)
    with pytest.raises(ContractError, match="no rows"):
        B.boosted_values(df.limit(0), "f", "action_no", "reward", "target", 4, 2)


# ---- the teacher --------------------------------------------------------------


def test_a_teacher_judges_each_row_by_models_without_its_fold(spark):
    rng = np.random.default_rng(2)
    frame = log_frame(8, 45, 4, gaps=False)
    frame = frame.assign(terminal=(frame[STEP] == 3).astype(int), fold=frame[EPISODE].str[1:].astype(int) % 3)
    target = rng.dirichlet([1, 1, 1], len(frame))
    rows = [(r[EPISODE], int(r[STEP]), [r["map_mm_hg"] / 50, r["lactate_mmol_l"]], ACTIONS.index(r[ACTION]), r["reward"], int(r["terminal"]), p.tolist(), int(r["fold"])) for r, p in zip(frame.to_dict("records"), target)]
    df = spark.createDataFrame(rows, f"{EPISODE} string, {STEP} int, f array<double>, action_no int, reward double, terminal int, target array<double>, fold int").repartition(3)
    got = held_out_values(df, "f", "action_no", "reward", "target", "fold", 3, 4, 2, 0.9, 5.0)
    want = np.zeros((len(frame), 3))
    for f in range(3):
        on = (frame["fold"] != f).to_numpy()
        part = df.filter(F.col("fold") != f)
        q = distributed_ridge(part, "f", "action_no", "reward", ["target"], 4, 0.9, 5.0, 2, apply_to=df.filter(F.col("fold") == f))
        want[~on] = predicted(q, "q_target")
    q = predicted(got, "q")
    assert np.allclose(q, want, atol=1e-9)
    assert np.allclose(predicted(got, "advantage"), q - (q * target).sum(axis=1, keepdims=True), atol=1e-12)
    with pytest.raises(ContractError, match="all rows of step"):
        held_out_values(df.filter("fold = 0"), "f", "action_no", "reward", "target", "fold", 3, 4, 2)


# ---- the queries --------------------------------------------------------------


@pytest.fixture(scope="module")
def logs(spark, data):
    """The queries' rows in memory, under the names that the in-memory learners know."""
    frame = steps(spark, data).toPandas().sort_values([EPISODE, STEP]).reset_index(drop=True)
    return frame.assign(previous_action=frame["previous_no"].astype(str), **{ACTION: frame["action_no"].map(dict(enumerate(ACTIONS)))})


def asked(spark, data, name):
    out = queries()[name](spark, data).toPandas()
    return out.sort_values([EPISODE, STEP]).reset_index(drop=True) if EPISODE in out else out


def test_queries_over_learners(spark, data, logs):
    columns, grid = ("value", "previous_action"), (0.01, 0.1, 1.0, 10.0)
    got = asked(spark, data, "clone_fit")
    assert np.allclose(got[["p0", "p1", "p2"]], M.Logistic(columns, 1.0).fit(logs).predict(logs), atol=1e-6)
    best, losses = M.choose_c(logs, M.Features(columns, True), grid, 3)
    got = asked(spark, data, "clone_selection")
    assert dict(zip(got["c"], got["loss"])) == pytest.approx(losses, abs=1e-6) and got["c"][got["chosen"]].tolist() == [best]
    got = asked(spark, data, "propensity")
    model = M.Propensity(columns, grid, 3).fit(logs)
    assert np.allclose(got[["b0", "b1", "b2"]], model.predict(logs), atol=2e-6)
    told = M.Propensity(columns, (0.1, 1.0), 3).fit(logs).diagnostics(logs)
    row = asked(spark, data, "out_of_fold").iloc[0]
    assert row["rows"] == told["rows"] and row["log_loss"] == pytest.approx(told["log_loss"], abs=1e-6) and row["brier"] == pytest.approx(told["brier"], abs=1e-6)


def test_query_over_boosted_values(spark, data, logs):
    got = asked(spark, data, "fqe_boosted")
    config, ahead = B.BoostConfig(3, 0.3, 5, 20), {}
    want = np.zeros((len(logs), 3))
    for t in range(HORIZON - 1, -1, -1):
        part = logs[logs[STEP] == t]
        state, p = part[["value", "previous_no"]].to_numpy(dtype=float), np.stack(part["target"].to_list())
        y = part["reward"].to_numpy() + np.array([0.0 if end else ahead.get(e, 0.0) for e, end in zip(part[EPISODE], part["terminal"])])
        assert len(np.unique(state[:, 0])) <= B.MOST_BINS  # so that bins are exact
        model = B.Booster(config).fit(np.column_stack([state, np.eye(3)[part["action_no"]]]), y)
        want[part.index] = np.column_stack([model.predict(np.column_stack([state, np.tile(np.eye(3)[a], (len(part), 1))])) for a in range(3)])
        ahead = dict(zip(part[EPISODE], (want[part.index] * p).sum(axis=1)))
    assert np.allclose(got[["q0", "q1", "q2"]], want, atol=2e-6)
