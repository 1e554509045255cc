"""Multinomial logistic models fitted where the rows are, many at a time.

All models share one raw design: numbers with gaps as zero, gap indicators,
one column per category, an intercept. What a model's training rows decide
(medians, scales, the commonest category) is a small matrix that turns the raw
design into its own, so models of other folds and penalties read the same
rows. A Newton step of all models is one job: every partition adds up
gradients, Hessian blocks and losses in the raw design, and one vector comes
to the driver. Rows say which training sets they belong to, so no fold is
ever filtered, copied or read again. Equal rows are kept once with their
number, so a pass costs as much as there are different ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.roles import folds
from ..schema import ACTIONS, EPISODE, ContractError
from ..sources.files import settled
from .features import MOST_LEVELS
from .learners import softmax_rows
from .quantiles import exact_quantiles

K = len(ACTIONS)
STEPS, HALVINGS = 100, 40
#: Rows that a pass looks at together, few enough for a core's cache and for products in one thread, and numbers that it may hold for them.
BLOCK, HELD = 1024, 2_000_000
#: Columns of the chunks in which rows are kept, and the types of their numbers.
CHUNK = {"_r": "<f8", "_y": "<i4", "_in": "?", "_out": "?", "_n": "<i8"}


@dataclass(frozen=True)
class Design:
    """The raw design of a table: its numeric and categorical columns and the levels that occur anywhere."""

    numeric: tuple[str, ...]
    levels: dict[str, tuple[str, ...]]

    @property
    def width(self) -> int:
        return 2 * len(self.numeric) + sum(len(v) + 1 for v in self.levels.values()) + 1

    def column(self) -> Column:
        """The raw design of a row: values, gaps, per category its levels and its gap, 1."""
        known = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in self.numeric}
        parts = [F.coalesce(v, F.lit(0.0)) for v in known.values()] + [v.isNull().cast("double") for v in known.values()]
        for c, levels in self.levels.items():
            text = F.col(c).cast("string")
            parts += [F.coalesce((text == level).cast("double"), F.lit(0.0)) for level in levels] + [text.isNull().cast("double")]
        return F.array(*parts, F.lit(1.0))


def raw_design(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = ()) -> Design:
    """The design of a table; the distinct levels of each category come to the driver, MOST_LEVELS at most."""
    levels = {}
    for c in categorical:
        found = [r[0] for r in df.select(F.col(c).cast("string")).filter(F.col(c).isNotNull()).distinct().limit(MOST_LEVELS + 1).collect()]
        if len(found) > MOST_LEVELS:
            raise ContractError(f"{c} has more than {MOST_LEVELS} levels")
        levels[c] = tuple(sorted(found))
    return Design(tuple(numeric), levels)


def prepared(df: DataFrame, design: Design, action_no: str, keys: Sequence[str], training: Column, held_out: Column) -> DataFrame:
    """Raw design, action and, as booleans, for which training sets the row trains and is held out; rows that are equal, also in ``keys``, once, with how many they are.

    Written once, in chunks of many rows each: passes over them cost Spark little a row.
    """
    used = [F.col(c).cast("double").alias(c) for c in design.numeric] + [F.col(c).cast("string").alias(c) for c in design.levels]
    rows = df.select(*keys, *used, F.col(action_no).cast("int").alias("_y"), training.alias("_in"), held_out.alias("_out"))
    different = rows.groupBy(*rows.columns).agg(F.count("*").alias("_n"))
    width = design.width

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                plain = {c: batch.column(c) if c in ("_y", "_n") else batch.column(c).flatten() for c in CHUNK}
                found = {c: v.to_numpy(zero_copy_only=False).astype(CHUNK[c]) for c, v in plain.items()}
                found["_r"] = found["_r"].reshape(-1, width).T  # a column's values lie together
                yield pa.RecordBatch.from_pydict({c: [v.tobytes()] for c, v in found.items()})

    return settled(different.select(design.column().alias("_r"), "_y", "_in", "_out", "_n").mapInArrow(pack, ", ".join(f"{c} binary" for c in CHUNK)))


def unpacked(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Raw design, actions, training and held-out marks and numbers of equal rows of each chunk."""
    for batch in batches:
        for chunk in zip(*(batch.column(c) for c in CHUNK)):
            r, y, inside, out, n = [np.frombuffer(v.as_buffer(), dtype=t) for v, t in zip(chunk, CHUNK.values())]
            yield r.reshape(width, -1).T, y, inside.reshape(len(n), -1), out.reshape(len(n), -1), n


def summed(rows: DataFrame, size: int, width: int, add: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of a vector of ``size`` that ``add`` makes of a chunk: one vector per partition, added by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for chunk in unpacked(batches, width):
            total += add(*chunk)
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(size), pa.int32()), "v": pa.array(total)})

    found = rows.mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(size)
    out[found["at"].to_numpy()] = found["v"].to_numpy()
    return out


def known_values(rows: DataFrame, design: Design, i: int) -> DataFrame:
    """set, v and n: the values of a numeric column, gaps left out, in each training set, and how often a row has them."""
    width, gap = design.width, len(design.numeric) + i

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, _, inside, _, n in unpacked(batches, width):
            at, sets = np.nonzero(inside & (r[:, [gap]] == 0))
            yield pa.RecordBatch.from_pydict({"set": sets.astype(np.int32), "v": r[at, i], "n": n[at]})

    return rows.mapInArrow(run, "set int, v double, n long")


def transforms(rows: DataFrame, design: Design, sets: int, mark_categories: bool = False) -> list[np.ndarray]:
    """Per training set the matrix from the raw design to its own, whose last column is the intercept.

    Numbers: gaps filled with the set's exact median, scaled by its mean and
    spread, then scaled indicators where the set has gaps. Categories: one
    column per level of the set, gaps filled with its commonest (of equals the
    first), with an indicator under ``mark_categories`` where the set has gaps.
    One pass gives counts and sums, a second the squares about the means, one
    more the median of a column that has gaps.
    """
    m, width = len(design.numeric), design.width

    def count(r: np.ndarray, y: np.ndarray, inside: np.ndarray, _: np.ndarray, n: np.ndarray) -> np.ndarray:
        return ((inside * n[:, None]).T @ np.column_stack([r, np.eye(K)[y]])).ravel()

    sums = summed(rows, sets * (width + K), width, count).reshape(sets, width + K)
    if not sums[:, width:].all():
        raise ContractError("every action must occur in each training set")
    known = sums[:, [width - 1]] - sums[:, m: 2 * m]
    means = sums[:, :m] / np.maximum(known, 1)

    def spread_out(r: np.ndarray, _: np.ndarray, inside: np.ndarray, __: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.array([(inside[:, s] * n) @ ((r[:, :m] - means[s]) ** 2 * (r[:, m: 2 * m] == 0)) for s in range(sets)]).ravel()

    variances = (summed(rows, sets * m, width, spread_out).reshape(sets, m) if m else np.zeros((sets, 0))) / np.maximum(known, 1)
    middle: dict[tuple[int, int], float] = {}
    for i in range(m):
        if ((0 < known[:, i]) & (known[:, i] < sums[:, width - 1])).any():
            for q in exact_quantiles(known_values(rows, design, i), F.col("v"), ["set"], {"m": 0.5}, F.col("n")).collect():
                middle[q["set"], i] = q["m"]
    out = []
    for s in range(sets):
        f, columns = sums[s], []
        n = f[width - 1]
        gaps = []
        for i in range(m):
            lost = f[m + i]
            mid, mean, var = middle.get((s, i), 0.0), means[s, i], variances[s, i]
            whole = ((n - lost) * mean + lost * mid) / n
            spread = np.sqrt(((n - lost) * (var + (mean - whole) ** 2) + lost * (mid - whole) ** 2) / n) or 1.0
            t = np.zeros(width)
            t[i], t[m + i], t[-1] = 1 / spread, mid / spread, -whole / spread
            columns.append(t)
            if lost:
                share = lost / n
                spread = np.sqrt(share * (1 - share)) or 1.0
                t = np.zeros(width)
                t[m + i], t[-1] = 1 / spread, -share / spread
                gaps.append(t)
        columns += gaps
        at = 2 * m
        for levels in design.levels.values():
            counts = f[at: at + len(levels)]
            lost = f[at + len(levels)]
            mode = int(np.argmax(counts)) if any(counts) else None
            for k in range(len(levels)):
                if counts[k]:
                    t = np.zeros(width)
                    t[at + k], t[at + len(levels)] = 1.0, float(k == mode)
                    columns.append(t)
            if mark_categories and lost:
                t = np.zeros(width)
                t[at + len(levels)] = 1.0
                columns.append(t)
            at += len(levels) + 1
        one = np.zeros(width)
        one[-1] = 1.0
        out.append(np.column_stack([*columns, one]))
    return out


@dataclass(frozen=True)
class Fitted:
    """Models of one Newton fit: model i is of training set ``sets[i]`` and penalty ``cs[i]``; ``raw[i]`` are its weights on the raw design."""

    design: Design
    sets: tuple[int, ...]
    cs: tuple[float, ...]
    own: list[np.ndarray]
    raw: list[np.ndarray]

    def scores(self, r: np.ndarray, i: int) -> np.ndarray:
        return r @ self.raw[i]


def newton_sums(rows: DataFrame, design: Design, sets: int, of: Sequence[int], weights: Sequence[np.ndarray]) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """Loss, gradient (width, K) and Hessian (K, K, width, width) of each model (its training set in ``of``) at its raw weights; one job."""
    d, models = design.width, len(of)
    pairs = [(a, b) for a in range(K) for b in range(a, K)]
    i, j = np.triu_indices(d)
    size = 1 + d * K + len(pairs) * len(i)
    of_action = [np.stack([w[:, a] for w in weights]) for a in range(K)]
    block = max(1, min(BLOCK, HELD // len(i)))

    def part(x: np.ndarray, y: np.ndarray, times: np.ndarray) -> np.ndarray:
        scores = [w @ x for w in of_action]
        top = np.maximum.reduce(scores)
        grown = [np.exp(s - top) for s in scores]
        whole = sum(grown)
        p = [g / whole for g in grown]
        loss = (times * (top + np.log(whole) - np.choose(y, scores))).sum(axis=1)
        gradient = np.stack([(times * (p[a] - (y == a))) @ x.T for a in range(K)], axis=2)
        products = (x[i] * x[j]).T
        hessian = np.stack([(times * p[a] * ((a == b) - p[b])) @ products for a, b in pairs], axis=1)
        return np.column_stack([loss, gradient.reshape(models, -1), hessian.reshape(models, -1)])

    def add(r: np.ndarray, y: np.ndarray, inside: np.ndarray, _: np.ndarray, n: np.ndarray) -> np.ndarray:
        x, times, out = r.T, (inside * n[:, None]).T[list(of)], np.zeros((models, size))
        for k in range(0, len(y), block):
            out += part(x[:, k: k + block], y[k: k + block], times[:, k: k + block])
        return out.ravel()

    flat = summed(rows, models * size, d, add).reshape(models, size)
    found = []
    for v in flat:
        hessian = np.zeros((K, K, d, d))
        for (a, b), half in zip(pairs, v[1 + d * K:].reshape(len(pairs), -1), strict=True):
            for at in ((a, b), (b, a)):
                hessian[at][i, j] = hessian[at][j, i] = half
        found.append((float(v[0]), v[1: 1 + d * K].reshape(d, K), hessian))
    return found


def stalled(step: np.ndarray, before: np.ndarray | float) -> bool:
    """Whether a Newton step is rounding only: near the end each is far smaller than the full one before, until sums over many rows can't tell."""
    now = np.abs(step).max()
    return bool(now < 1e-6 and now > np.abs(before).max() / 2)


def fit_models(rows: DataFrame, design: Design, turned: Sequence[np.ndarray], cs: Sequence[float]) -> Fitted:
    """A model for every training set and penalty: c times the summed loss and half the squared weights, the intercept free, by Newton steps of all at once.

    A step that raises a model's loss is halved in the next job; models that
    have settled or whose steps no longer shrink keep their weights.
    """
    of = [(s, float(c)) for s in range(len(turned)) for c in cs]
    w = [np.zeros((turned[s].shape[1], K)) for s, _ in of]
    last: list[tuple[float, np.ndarray] | None] = [None] * len(of)  # loss and weights before the step
    step: list[np.ndarray | None] = [None] * len(of)
    size, busy = [1.0] * len(of), list(range(len(of)))
    for _ in range(STEPS + HALVINGS):
        if not busy:
            break
        sums = newton_sums(rows, design, len(turned), [of[i][0] for i in busy], [turned[of[i][0]] @ w[i] for i in busy])
        still = []
        for i, (loss, gradient, hessian) in zip(busy, sums, strict=True):
            (s, c), t = of[i], turned[of[i][0]]
            penalty = np.ones_like(w[i])
            penalty[-1] = 0.0
            now = c * loss + 0.5 * float((penalty * w[i] ** 2).sum())
            # sums over partitions round apart, so that a hair more is no rise
            if last[i] is not None and now > last[i][0] + 1e-13 * abs(now) and size[i] > 1e-6:
                size[i] /= 2
                w[i] = last[i][1] - size[i] * step[i]
                still.append(i)
                continue
            if last[i] is not None and np.abs(size[i] * step[i]).max() < 1e-12:
                continue
            g = c * t.T @ gradient + penalty * w[i]
            if np.abs(g).max() < 1e-10:
                continue
            d = t.shape[1]
            h = np.block([[c * t.T @ hessian[a, b] @ t for b in range(K)] for a in range(K)]) + np.diag(penalty.T.ravel())
            ahead = np.linalg.lstsq(h, g.T.ravel(), rcond=None)[0].reshape(K, d).T
            if last[i] is not None and size[i] == 1.0 and stalled(ahead, step[i]):
                continue
            step[i], last[i], size[i] = ahead, (now, w[i]), 1.0
            w[i] = w[i] - step[i]
            still.append(i)
        busy = still
    return Fitted(design, tuple(s for s, _ in of), tuple(c for _, c in of), w, [turned[s] @ x for (s, _), x in zip(of, w, strict=True)])


def held_out_losses(rows: DataFrame, fitted: Fitted, sets: int) -> np.ndarray:
    """Mean log loss of every model over the rows held out of its training set; one job."""

    def add(r: np.ndarray, y: np.ndarray, _: np.ndarray, out: np.ndarray, n: np.ndarray) -> np.ndarray:
        found = np.zeros((len(fitted.raw), 2))
        for i, s in enumerate(fitted.sets):
            x, hit, times = r[out[:, s]], y[out[:, s]], n[out[:, s]]
            if len(x):
                p = softmax_rows(fitted.scores(x, i))
                found[i] = -(times * np.log(np.clip(p[np.arange(len(x)), hit], 1e-15, 1))).sum(), times.sum()
        return found.ravel()

    found = summed(rows, 2 * len(fitted.raw), fitted.design.width, add).reshape(-1, 2)
    return found[:, 0] / found[:, 1]


def fit_sigmoids(rows: DataFrame, fitted: Fitted, sets: int, chosen: Sequence[int]) -> np.ndarray:
    """(models, K, 2): a and b of 1 / (1 + exp(a s + b)) per chosen model and action, on the rows held out of it, by Newton steps of all at once."""

    def count(_: np.ndarray, y: np.ndarray, __: np.ndarray, out: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.array([[n[out[:, fitted.sets[i]] & (y == a)].sum() for a in range(K)] for i in chosen]).ravel()

    yes = summed(rows, len(chosen) * K, fitted.design.width, count).reshape(-1, K)
    no = yes.sum(axis=1, keepdims=True) - yes
    goals = np.stack([1 / (no + 2), (yes + 1) / (yes + 2)], axis=-1)
    w, before = np.stack([np.zeros_like(yes), np.log((no + 1) / (yes + 1))], axis=-1), np.inf
    for _ in range(STEPS):
        at = w.copy()

        def add(r: np.ndarray, y: np.ndarray, _: np.ndarray, out: np.ndarray, n: np.ndarray) -> np.ndarray:
            found = np.zeros((len(chosen), K, 6))
            for j, i in enumerate(chosen):
                part = out[:, fitted.sets[i]]
                scores, hit, times = fitted.scores(r[part], i), y[part], n[part]
                for a in range(K):
                    x = np.column_stack([scores[:, a], np.ones(len(hit))])
                    p = 1 / (1 + np.exp(np.clip(x @ at[j, a], -500, 500)))
                    found[j, a] = np.concatenate([x.T @ (times * (goals[j, a][(hit == a).astype(int)] - p)), ((x * (times * p * (1 - p))[:, None]).T @ x).ravel()])
            return found.ravel()

        sums = summed(rows, len(chosen) * K * 6, fitted.design.width, add).reshape(len(chosen), K, 6)
        step = np.linalg.solve(sums[..., 2:].reshape(len(chosen), K, 2, 2) + 1e-12 * np.eye(2), sums[..., :2, None])[..., 0]
        if stalled(step, before):
            break
        w, before = w - step, step
        if np.abs(step).max() < 1e-12:
            break
    return w


@dataclass(frozen=True)
class Ensemble:
    """Averaged probabilities of some models, each with its sigmoids or (without) plain, floored."""

    fitted: Fitted
    chosen: tuple[int, ...]
    sigmoids: np.ndarray | None
    floor: float = 0.0

    def predict(self, r: np.ndarray) -> np.ndarray:
        total = np.zeros((len(r), K))
        for j, i in enumerate(self.chosen):
            scores = self.fitted.scores(r, i)
            if self.sigmoids is None:
                p = softmax_rows(scores)
            else:
                p = 1 / (1 + np.exp(np.clip(scores * self.sigmoids[j, :, 0] + self.sigmoids[j, :, 1], -500, 500)))
                whole = p.sum(axis=1, keepdims=True)
                p = np.where(whole > 0, p / np.where(whole > 0, whole, 1), 1 / K)
            total += p / len(self.chosen)
        p = np.maximum(total, self.floor)
        return p / p.sum(axis=1, keepdims=True)


def with_probabilities(df: DataFrame, models: Sequence[Ensemble], which: Column, name: str) -> DataFrame:
    """Adds each row's three probabilities by the model that ``which`` numbers; batches are scored on the executors."""
    sent = df.sparkSession.sparkContext.broadcast(list(models))
    width = models[0].fitted.design.width

    @F.arrow_udf("array<double>")
    def of(r: pa.Array, no: pa.Array) -> pa.Array:
        x, at = r.flatten().to_numpy(zero_copy_only=False).reshape(-1, width), no.to_numpy(zero_copy_only=False)
        out = np.zeros((len(x), K))
        for k in np.unique(at):
            out[at == k] = sent.value[k].predict(x[at == k])
        return pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, K), pa.int32()), pa.array(out.ravel()))

    return df.withColumn(name, of(models[0].fitted.design.column(), which))


# ---- folds, choices and calibration ------------------------------------------


def fit_clone(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], action_no: str, c: float, mark_categories: bool = True) -> Ensemble:
    """One policy that imitates the log, of penalty ``c``, fitted on all rows."""
    design = raw_design(df, numeric, categorical)
    rows = prepared(df, design, action_no, [], F.array(F.lit(True)), F.array(F.lit(False)))
    return Ensemble(fit_models(rows, design, transforms(rows, design, 1, mark_categories), [c]), (0,), None)


def fold_marks(fold: Column, k: int) -> tuple[Column, Column]:
    """Training and held-out marks of k sets, set f holding out fold f; a null fold is in neither."""
    inside = F.coalesce(fold, F.lit(-1))
    return F.array(*[(inside >= 0) & (inside != f) for f in range(k)]), F.array(*[inside == f for f in range(k)])


def choose_penalty(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], action_no: str, grid: Sequence[float], k: int, key: str = EPISODE, mark_categories: bool = True) -> tuple[float, dict[float, float]]:
    """The penalty with the least mean held-out loss over k folds of episodes, the first of equals, and all losses; the first without two episodes."""
    k = min(k, df.select(key).distinct().limit(k).count())
    if k < 2:
        return float(grid[0]), {}
    placed = df.join(folds(df, k, key), key)
    design = raw_design(df, numeric, categorical)
    rows = prepared(placed, design, action_no, [], *fold_marks(F.col("fold"), k))
    fitted = fit_models(rows, design, transforms(rows, design, k, mark_categories), grid)
    losses = held_out_losses(rows, fitted, k).reshape(k, len(grid)).mean(axis=0)
    return float(grid[int(losses.argmin())]), dict(zip(map(float, grid), losses.tolist(), strict=True))


def calibrated(rows: DataFrame, design: Design, sets: int, members: Sequence[Sequence[int]], grid: Sequence[float], floor: float) -> tuple[list[Ensemble], list[dict[float, float]]]:
    """One calibrated ensemble per group of training sets, all from the same jobs: penalties chosen by held-out loss, then sigmoids on what each set holds out."""
    fitted = fit_models(rows, design, transforms(rows, design, sets), grid)
    losses = held_out_losses(rows, fitted, sets).reshape(sets, len(grid))
    means = [losses[list(group)].mean(axis=0) for group in members]
    chosen = [tuple(s * len(grid) + int(mean.argmin()) for s in group) for group, mean in zip(members, means, strict=True)]
    flat = [i for group in chosen for i in group]
    w = fit_sigmoids(rows, fitted, sets, flat)
    out, at = [], 0
    for group in chosen:
        out.append(Ensemble(fitted, group, w[at: at + len(group)], floor))
        at += len(group)
    return out, [dict(zip(map(float, grid), mean.tolist(), strict=True)) for mean in means]


def fit_propensity(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], action_no: str, grid: Sequence[float] = (0.01, 0.1, 1.0, 10.0), k: int = 3, floor: float = 1e-3, key: str = EPISODE) -> tuple[Ensemble, dict[float, float]]:
    """The behaviour's probabilities and the losses of all penalties: the penalty by folds of episodes, one model per fold with sigmoids fitted on what it left out, averaged and floored.

    With fewer than two episodes the one model is not calibrated.
    """
    k = min(k, df.select(key).distinct().limit(k).count())
    if k < 2:
        model = fit_clone(df, numeric, categorical, action_no, float(grid[0]), False)
        return Ensemble(model.fitted, model.chosen, None, floor), {}
    placed = df.join(folds(df, k, key), key)
    design = raw_design(df, numeric, categorical)
    rows = prepared(placed, design, action_no, [], *fold_marks(F.col("fold"), k))
    models, losses = calibrated(rows, design, k, [range(k)], grid, floor)
    return models[0], losses[0]


def out_of_fold(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], action_no: str, grid: Sequence[float] = (0.01, 0.1, 1.0, 10.0), k: int = 3, floor: float = 1e-3, key: str = EPISODE, name: str = "behavior") -> DataFrame:
    """Adds each row's calibrated probabilities from models that saw none of its episode's fold.

    Every outer fold's complement is dealt into folds of its own; a row
    carries its inner fold in each, and the k * k * penalties models are
    fitted together.
    """
    outer = settled(folds(df, k, key).withColumnRenamed("fold", "_outer"))
    placed = df.join(outer, key)
    for f in range(k):
        inner = settled(folds(placed.filter(F.col("_outer") != f), k, key).withColumnRenamed("fold", f"_inner{f}"))
        outer = outer.join(inner, key, "left")
    outer = settled(outer)
    placed = df.join(outer, key)
    design = raw_design(df, numeric, categorical)
    marks = [fold_marks(F.col(f"_inner{f}"), k) for f in range(k)]
    rows = prepared(placed, design, action_no, [], F.concat(*[m[0] for m in marks]), F.concat(*[m[1] for m in marks]))
    models, _ = calibrated(rows, design, k * k, [range(f * k, (f + 1) * k) for f in range(k)], grid, floor)
    return with_probabilities(placed, models, F.col("_outer"), name).drop("_outer", *[f"_inner{f}" for f in range(k)])
