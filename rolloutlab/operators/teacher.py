"""A teacher's advantages for every row, from values that were fitted without the row's episode.

All folds' models come from the same pass: Gram sums are kept by the fold of
the rows, and what a fold's model is fitted on is all sums less its own. Every
model has next values of its own, which each row carries side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import bellman
from ..schema import ACTIONS, EPISODE, ContractError
from ..sources.files import settled
from .fqe import stage_rows
from .learners import solve_ridge

K = len(ACTIONS)


def fold_sums(rows: DataFrame, width: int, k: int) -> tuple[np.ndarray, ...]:
    """By fold of the rows: Gram matrices, products with each model's targets, sums of both, and counts; one vector per partition is added up by place."""
    size = width + K + K * width
    shapes = [(k, size, size), (k, size, k), (k, size), (k, k), (k,)]
    whole = sum(int(np.prod(s)) for s in shapes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.zeros(s) for s in shapes]
        for b in batches:
            if not b.num_rows:
                continue
            flat = lambda name, n: b.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
            state, y, fold = flat("_f", width), flat("_y", k), b.column("_fold").to_numpy(zero_copy_only=False)
            hot = np.eye(K)[b.column("_a").to_numpy(zero_copy_only=False)]
            x = np.column_stack([state, hot, *[state * hot[:, a: a + 1] for a in range(K)]])
            for g in np.unique(fold):
                at = fold == g
                for part, more in zip(parts, (x[at].T @ x[at], x[at].T @ y[at], x[at].sum(axis=0), y[at].sum(axis=0), at.sum()), strict=True):
                    part[g] += more
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(whole), pa.int32()), "v": pa.array(np.concatenate([p.ravel() for p in parts]))})

    found = rows.mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
    flat = np.zeros(whole)
    flat[found["at"].to_numpy()] = found["v"].to_numpy()
    cuts = np.cumsum([int(np.prod(s)) for s in shapes])[:-1]
    return tuple(p.reshape(s) for p, s in zip(np.split(flat, cuts), shapes, strict=True))


def linear_value(state: Column, action: int, width: int, w: np.ndarray, b: float) -> Column:
    """The value of an action under one model's weights."""
    out = F.lit(float(b + w[width + action]))
    for j in range(width):
        out = out + state[j] * float(w[j] + w[width + K + action * width + j])
    return out


def held_out_values(df: DataFrame, features: str, action: str, reward: str, target: str, fold: str, k: int, horizon: int, width: int, gamma: float = 1.0, alpha: float = 5.0) -> DataFrame:
    """Adds q (three values) and advantage (q less its mean under ``target``) from the model that left the row's fold out.

    ``fold`` numbers folds of whole episodes from 0; ``features`` is an array
    of ``width`` numbers. Per step one join with the k next values of each
    episode, one pass of sums, k small systems. Steps that no episode has are
    left out; a fold that holds all rows of a step raises.
    """
    done, ahead = None, None
    for t in range(horizon - 1, -1, -1):
        rows = stage_rows(df, t)
        none = F.array_repeat(F.lit(0.0), k)
        rows = rows.withColumn("_next", none) if ahead is None else rows.join(ahead.hint("merge"), EPISODE, "left").withColumn("_next", F.coalesce("_next", none))
        y = F.array(*[bellman(F.col(reward), F.col("terminal"), F.col("_next")[f], gamma) for f in range(k)])
        fit = rows.select(F.col(features).cast("array<double>").alias("_f"), y.alias("_y"), F.col(fold).cast("int").alias("_fold"), F.col(action).cast("int").alias("_a"))
        xx, xy, sx, sy, n = fold_sums(fit, width, k)
        if not n.sum():
            continue
        if (n == n.sum()).any():
            raise ContractError(f"one fold holds all rows of step {t}")
        models = [solve_ridge(xx.sum(axis=0) - xx[f], xy[:, :, f].sum(axis=0) - xy[f, :, f], sx.sum(axis=0) - sx[f], sy[:, f].sum() - sy[f, f], n.sum() - n[f], alpha) for f in range(k)]
        state = F.col(features)
        every = F.array(*[F.array(*[linear_value(state, a, width, w, float(b)) for a in range(K)]) for w, b in models])
        valued = rows.withColumn("_q", every)
        mean = lambda q: sum((F.col(target)[a] * q[a] for a in range(1, K)), F.col(target)[0] * q[0])
        q = F.get("_q", F.col(fold))
        out = settled(valued.select(*df.columns, q.alias("q"), F.array(*[mean(F.col("_q")[f]) for f in range(k)]).alias("_next")))
        ahead = out.select(EPISODE, "_next")
        kept = out.select(*df.columns, "q", F.array(*[F.col("q")[a] - mean(F.col("q")) for a in range(K)]).alias("advantage"))
        done = kept if done is None else done.unionByName(kept)
    if done is None:
        raise ContractError("no rows at any step")
    return done
