"""Imputed, scaled and encoded features of a table of any size, and learners whose fit is an aggregate."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ContractError
from .learners import solve_ridge
from .quantiles import exact_quantiles

MOST_LEVELS = 1000


def fitted_features(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), mark_categories: bool = False) -> dict[str, Column]:
    """Named expressions: numbers with gaps filled by the exact median and scaled, an indicator (scaled, too) where a column has gaps, and one column
    per category, gaps filled by the most frequent one (of equals the first), with an indicator of the gap under ``mark_categories``."""
    out: dict[str, Column] = {}
    for c in numeric:
        value = F.col(c).cast("double")
        known = F.when(~F.isnan(value), value)
        middle = exact_quantiles(df, known, [], {"m": 0.5}).first()
        filled, gap = F.coalesce(known, F.lit(middle["m"] if middle and middle["m"] is not None else 0.0)), known.isNull().cast("double")
        facts = df.agg(F.avg(filled).alias("m"), F.stddev_pop(filled).alias("s"), F.avg(gap).alias("gm"), F.stddev_pop(gap).alias("gs")).first()
        out[c] = (filled - facts["m"]) / (facts["s"] or 1.0)
        if facts["gm"]:
            out[f"{c}_missing"] = (gap - facts["gm"]) / (facts["gs"] or 1.0)
    for c in categorical:
        text = F.col(c).cast("string")
        counts = df.filter(text.isNotNull()).groupBy(text.alias("level")).count().limit(MOST_LEVELS + 1).collect()
        if len(counts) > MOST_LEVELS:
            raise ContractError(f"{c} has more than {MOST_LEVELS} levels")
        mode = min(counts, key=lambda r: (-r["count"], r["level"]))["level"] if counts else ""
        for level in sorted(r["level"] for r in counts):
            out[f"{c}_{level}"] = (F.coalesce(text, F.lit(mode)) == level).cast("double")
        if mark_categories:
            out[f"{c}_missing"] = text.isNull().cast("double")
    return out


def ridge_columns(df: DataFrame, features: Sequence[Column], targets: Sequence[Column], alpha: float) -> list[Column]:
    """Predictions of a ridge with free intercepts, one per target: a single aggregate of products, a small system on the driver."""
    d, m = len(features), len(targets)
    sums = [F.sum(features[i] * features[j]).alias(f"x{i}_{j}") for i in range(d) for j in range(i, d)]
    sums += [F.sum(features[i] * t).alias(f"y{i}_{k}") for i in range(d) for k, t in enumerate(targets)]
    sums += [F.sum(f).alias(f"s{i}") for i, f in enumerate(features)] + [F.sum(t).alias(f"t{k}") for k, t in enumerate(targets)] + [F.count("*").alias("n")]
    row = df.agg(*sums).first()
    xx = np.array([[row[f"x{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)], dtype=float)
    xy = np.array([[row[f"y{i}_{k}"] for k in range(m)] for i in range(d)], dtype=float)
    w, b = solve_ridge(xx, xy, np.array([row[f"s{i}"] for i in range(d)], dtype=float), np.array([row[f"t{k}"] for k in range(m)], dtype=float), row["n"], alpha)
    out = []
    for k in range(m):
        value = F.lit(float(b[k]))
        for i in range(d):
            value = value + features[i] * float(w[i, k])
        out.append(value)
    return out


def smoothing_losses(df: DataFrame, folds: DataFrame, cell: str, action_no: str, key: str, grid: Sequence[float], actions: int = 3) -> DataFrame:
    """alpha, loss, chosen: mean log loss over grouped folds of action frequencies by cell with alpha added to each count; of equal losses the smaller alpha.

    A fold's model counts the other folds: all counts less the fold's own.
    """
    rows = df.join(folds, key).groupBy("fold", F.col(cell).alias("cell"), F.col(action_no).alias("a")).agg(F.count("*").alias("own"))
    both = rows.groupBy("cell", "a").agg(F.sum("own").alias("all"))
    cells = rows.groupBy("fold", "cell").agg(F.sum("own").alias("own_cell"))
    whole = rows.groupBy("cell").agg(F.sum("own").alias("all_cell"))
    met = rows.join(both, ["cell", "a"]).join(cells, ["fold", "cell"]).join(whole, "cell")
    met = met.withColumn("alpha", F.explode(F.array(*[F.lit(float(g)) for g in grid])))
    p = (F.col("all") - F.col("own") + F.col("alpha")) / (F.col("all_cell") - F.col("own_cell") + F.col("alpha") * actions)
    each = met.groupBy("alpha", "fold").agg((F.sum(-F.ln(F.greatest(p, F.lit(1e-15))) * F.col("own")) / F.sum("own")).alias("l"))
    losses = each.groupBy("alpha").agg(F.avg("l").alias("loss"))
    best = losses.agg(F.min(F.struct("loss", "alpha")).alias("b")).select(F.col("b.alpha").alias("_best"))
    return losses.join(F.broadcast(best)).withColumn("chosen", F.col("alpha") == F.col("_best")).drop("_best")  # one row
