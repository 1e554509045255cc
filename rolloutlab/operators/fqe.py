"""Finite-horizon fitted Q evaluation, last step first.

Two fits share one shape of result. ``FittedQ`` fits boosted trees or ridge on
a bounded table, one model per step. ``distributed_ridge`` never gathers rows:
a step's Gram matrix is summed where the rows are, once for all target
policies and rewards (these only change the right-hand sides), and a small
system is solved on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import bellman
from ..schema import ACTIONS, EPISODE, STEP, ContractError
from ..sources.files import settled
from .booster import BoostConfig, Booster
from .learners import Features, action_numbers, fit_ridge, solve_ridge

K = len(ACTIONS)


@dataclass
class FittedQ:
    columns: tuple[str, ...]
    horizon: int = 12
    gamma: float = 1.0
    learner: str = "hist_gradient_boosting"
    boost: BoostConfig = BoostConfig()
    alpha: float = 5.0
    stages: dict[int, tuple] = field(default_factory=dict)

    def design(self, state: np.ndarray, action: np.ndarray) -> np.ndarray:
        hot = np.eye(K)[action]
        parts = [state, hot]
        if self.learner == "ridge":
            parts += [state * hot[:, a: a + 1] for a in range(K)]
        return np.column_stack(parts)

    def fit(self, frame: pd.DataFrame, rewards: np.ndarray, target: np.ndarray) -> FittedQ:
        """``rewards`` and ``target`` (three probabilities) lie row by row beside the frame."""
        if self.learner not in ("hist_gradient_boosting", "ridge"):
            raise ContractError(f"unknown learner {self.learner}")
        if not 0 <= self.gamma <= 1:
            raise ContractError("gamma must lie between 0 and 1")
        steps, action = frame[STEP].to_numpy(), action_numbers(frame)
        terminal, ids = frame["terminal"].to_numpy() == 1, frame[EPISODE].astype(str).to_numpy()
        whole = set(ids)
        for t in range(self.horizon):
            if missing := whole - set(ids[steps == t]):
                raise ContractError(f"episode {min(missing)} has no step {t}")
        ahead: dict[str, float] = {}
        for t in range(self.horizon - 1, -1, -1):
            rows = np.flatnonzero(steps == t)
            if not len(rows):
                raise ContractError(f"no rows at step {t}")
            part = frame.iloc[rows]
            follow = np.array([0.0 if terminal[r] else ahead[ids[r]] for r in rows])
            y = rewards[rows] + self.gamma * follow
            features = Features(self.columns).fit(part)
            state = features.transform(part)
            x = self.design(state, action[rows])
            model = Booster(self.boost).fit(x, y) if self.learner != "ridge" else fit_ridge(x, y, self.alpha)
            self.stages[t] = (features, model)
            q = self._stage_q(t, part)
            ahead = dict(zip(ids[rows], (target[rows] * q).sum(axis=1)))
        return self

    def _stage_q(self, t: int, part: pd.DataFrame) -> np.ndarray:
        features, model = self.stages[t]
        state = features.transform(part)
        out = []
        for a in range(K):
            x = self.design(state, np.full(len(part), a))
            out.append(model.predict(x) if self.learner != "ridge" else x @ model[0] + model[1])
        return np.column_stack(out)

    def predict(self, frame: pd.DataFrame) -> np.ndarray:
        """Q of every action, rows in the frame's order; unknown steps raise."""
        steps = frame[STEP].to_numpy()
        if not set(np.unique(steps)) <= set(self.stages):
            raise ContractError("a step outside the horizon")
        out = np.zeros((len(frame), K))
        for t in np.unique(steps):
            at = np.flatnonzero(steps == t)
            out[at] = self._stage_q(int(t), frame.iloc[at])
        return out


def by_step(df: DataFrame) -> DataFrame:
    """The table written with a folder for each step, so that a pass over one step reads no other."""
    return settled(df, STEP)


def stage_rows(df: DataFrame, step: int) -> DataFrame:
    """The rows of one step, one per episode."""
    return df.filter(F.col(STEP) == step)


def initial_values(df: DataFrame, value: str = "v", keys: Sequence[str] = ()) -> DataFrame:
    """keys, episode and ``direct``: the value of each episode's first step."""
    return stage_rows(df, 0).select(*keys, EPISODE, F.col(value).alias("direct"))


def step_faults(df: DataFrame, horizon: int) -> DataFrame:
    """One row: rows, and how many have a step that no stage is fitted for."""
    outside = ~F.coalesce((F.col(STEP) >= 0) & (F.col(STEP) < horizon) & (F.col(STEP).cast("double") == F.floor(F.col(STEP).cast("double"))), F.lit(False))
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(outside.cast("long")), F.lit(0)).alias("outside"))


def design(features: Sequence[Column], action_no: Column, interactions: bool = True) -> list[Column]:
    """State, one column per action, and (for linear learners) their products."""
    hot = [F.when(action_no == a, 1.0).otherwise(0.0) for a in range(K)]
    return [*features, *hot, *([f * h for h in hot for f in features] if interactions else [])]


def sums(df: DataFrame, features: str, action: str, targets: Sequence[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Gram sums of state, action and their products, and of these with the targets: each partition adds up its own rows, the driver adds one row per partition."""
    size = width + K + K * width
    m = len(targets)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        xx, xy, sx, sy, n = np.zeros((size, size)), np.zeros((size, m)), np.zeros(size), np.zeros(m), 0
        for b in batches:
            if not len(b):
                continue
            state = np.stack(b["features"].to_numpy()).astype(float)
            hot = np.eye(K)[b["action"].to_numpy()]
            x = np.column_stack([state, hot, *[state * hot[:, a: a + 1] for a in range(K)]])
            y = b[[f"y{i}" for i in range(m)]].to_numpy(dtype=float)
            xx += x.T @ x
            xy += x.T @ y
            sx += x.sum(axis=0)
            sy += y.sum(axis=0)
            n += len(b)
        yield pd.DataFrame({"v": [np.concatenate([xx.ravel(), xy.ravel(), sx, sy, [n]])]})

    rows = df.select(F.col(features).alias("features"), F.col(action).cast("int").alias("action"), *[F.col(t).alias(f"y{i}") for i, t in enumerate(targets)])
    # partials meet in a few tasks before the driver sees them
    parts = rows.mapInPandas(run, "v array<double>").select(F.posexplode("v").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).toPandas()
    flat = parts.sort_values("at")["v"].to_numpy()
    cuts = np.cumsum([size * size, size * m, size, m])
    xx, xy, sx, sy, n = np.split(flat, cuts)
    return xx.reshape(size, size), xy.reshape(size, m), sx, sy, int(n[0])


def ridge_values(df: DataFrame, features: str, targets: Sequence[str], w: np.ndarray, b: np.ndarray, width: int) -> DataFrame:
    """Adds q_<target> and v_<target> by one step's weights (a column per target)."""
    state = [F.col(features)[j] for j in range(width)]
    for i, p in enumerate(targets):
        values = []
        for a in range(K):
            cell = F.lit(float(b[i] + w[width + a, i]))
            for j in range(width):
                cell = cell + state[j] * float(w[j, i] + w[width + K + a * width + j, i])
            values.append(cell)
        df = df.withColumn(f"q_{p}", F.array(*values))
        df = df.withColumn(f"v_{p}", sum((F.col(p)[a] * F.col(f"q_{p}")[a] for a in range(1, K)), F.col(p)[0] * F.col(f"q_{p}")[0]))
    return df


def distributed_ridge(df: DataFrame, features: str, action: str, reward: str, targets: Sequence[str], horizon: int, gamma: float = 1.0, alpha: float = 5.0, width: int = 1,
                      apply_to: DataFrame | None = None) -> DataFrame:
    """Adds q_<target> (three values) and v_<target> to every row, for all target policies at once.

    ``features`` is an array of ``width`` numbers, ``targets`` are columns of
    distributions. Per step: one join with the next step's values, one Gram
    sum, one solve. With ``apply_to`` the fit's values go to the rows of that
    table instead.
    """
    done, ahead = None, None
    for t in range(horizon - 1, -1, -1):
        rows = stage_rows(df, t)
        if ahead is None:
            rows = rows.withColumns({f"_n_{p}": F.lit(0.0) for p in targets})
        else:
            rows = rows.join(ahead.hint("merge"), EPISODE, "left").withColumns({f"_n_{p}": F.coalesce(f"_n_{p}", F.lit(0.0)) for p in targets})  # a row per episode: never gathered
        rows = rows.withColumns({f"_y_{p}": bellman(F.col(reward), F.col("terminal"), F.col(f"_n_{p}"), gamma) for p in targets})
        w, b = solve_ridge(*sums(rows, features, action, [f"_y_{p}" for p in targets], width), alpha)
        out = ridge_values(rows, features, targets, w, b, width)
        # one small row per episode, written, so that no step recomputes the steps after it
        ahead = settled(out.select(EPISODE, *[F.col(f"v_{p}").alias(f"_n_{p}") for p in targets]))
        source = out if apply_to is None else ridge_values(stage_rows(apply_to, t), features, targets, w, b, width)
        kept = source.select(*(df if apply_to is None else apply_to).columns, *[f"{x}_{p}" for p in targets for x in ("q", "v")])
        done = kept if done is None else done.unionByName(kept)
    return done


def tabular(df: DataFrame, cell: Sequence[str], action: str, reward: str, target: str, horizon: int, gamma: float = 1.0, apply_to: DataFrame | None = None) -> DataFrame:
    """Adds q (three values; null for an action never logged in the cell) and v: means of Bellman targets by step, cell and action.

    Per step one join with the next step's values and one aggregate; where the
    cell never saw an action its value counts as 0 in v. With ``apply_to`` the
    fit's values go to the rows of that table instead; a cell that the fit
    never saw has none.
    """
    done, ahead = None, None
    for t in range(horizon - 1, -1, -1):
        rows = stage_rows(df, t)
        rows = rows.withColumn("_next", F.lit(0.0)) if ahead is None else rows.join(ahead.hint("merge"), EPISODE, "left").withColumn("_next", F.coalesce("_next", F.lit(0.0)))  # a row per episode: never gathered
        y = bellman(F.col(reward), F.col("terminal"), F.col("_next"), gamma)
        means = rows.groupBy(*cell).agg(*[F.avg(F.when(F.col(action) == a, y)).alias(f"_q{a}") for a in range(K)])
        means = means.select(*[F.col(c).alias(f"_of_{c}") for c in cell], F.array(*[F.col(f"_q{a}") for a in range(K)]).alias("q"))
        value = sum((F.col(target)[a] * F.coalesce(F.col("q")[a], F.lit(0.0)) for a in range(1, K)), F.col(target)[0] * F.coalesce(F.col("q")[0], F.lit(0.0)))

        def valued(to: DataFrame, columns: Sequence[str]) -> DataFrame:
            on = F.lit(True)
            for c in cell:
                on = on & to[c].eqNullSafe(means[f"_of_{c}"])
            return to.join(means, on, "left").select(*columns, "q").withColumn("v", F.coalesce(value, F.lit(0.0)))

        out = valued(rows, df.columns)
        # one small row per episode, written: the plan of a step would otherwise hold those of all steps after it twice over
        ahead = settled(out.select(EPISODE, F.col("v").alias("_next")))
        kept = out if apply_to is None else valued(stage_rows(apply_to, t), apply_to.columns)
        done = kept if done is None else done.unionByName(kept)
    return done
