"""Embedding whitening by residue-number scatter.

Vectors on an integer grid have an integer scatter matrix once they are
centred by n * x - S. Each partition multiplies their residues by a few primes
as double matrices, which is exact there, the residues of all partitions are
summed, and Chinese remaindering gives the whole numbers back. So the
covariance has one rounding, whatever the number of rows and however far from
zero they lie, before the eigenvectors are taken in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

GRID, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Residues lie in -PRIME_TOP / 2 to PRIME_TOP / 2: their products stay under 2^40, and of BLOCK rows under 2^53, where doubles are exact.
PRIME_TOP, BLOCK = 1 << 21, 1 << 13
#: Entries beyond this on the grid are refused: a double tells no whole numbers apart there.
FARTHEST = 1 << 52
#: Eigenvalues below this share of the largest are rounding; their directions have no spread to divide by.
RANK = 1e-13


def primes_for(bound: int) -> list[int]:
    """The largest primes below PRIME_TOP whose product exceeds 2 * bound + 1, so that residues tell all numbers of that size apart."""
    found, product = [], 1
    for p in count(PRIME_TOP - 1, -2):
        if all(p % k for k in range(3, math.isqrt(p) + 1, 2)):
            found.append(p)
            product *= p
            if product > 2 * bound + 1:
                return found
    raise AssertionError


def remaindered(residues: Sequence[np.ndarray], primes: Sequence[int]) -> list[int]:
    """The whole numbers nearest to zero with such residues, one array of residues a prime."""
    product = math.prod(primes)
    weights = [product // p * pow(product // p, -1, p) for p in primes]
    out = []
    for parts in zip(*(r.tolist() for r in residues), strict=True):
        x = sum(w * r for w, r in zip(weights, parts, strict=True)) % product
        out.append(x - product if x > product // 2 else x)
    return out


def centred_residues(x: np.ndarray, n: int, sums: Sequence[int], p: int) -> np.ndarray:
    """n * x - sums modulo p, as doubles nearest to zero."""
    z = (x % p * (n % p) - np.array([s % p for s in sums], dtype=np.int64)) % p
    return np.where(z > p // 2, z - p, z).astype(np.float64)


def rows_of(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, width)


@dataclass(frozen=True)
class Sums:
    """Number of fitted vectors, their sum per dimension, and the most that any n * x - S is off zero."""

    n: int
    per_dimension: list[int]
    farthest: int


def grid_sums(fit: DataFrame, width: int) -> Sums:
    """One pass over fit (x); a task gives one row of sums, which are exact."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, low, high = 0, [0] * width, None, None
        for b in batches:
            x = rows_of(b.column(0), width)
            if not len(x):
                continue
            n += len(x)
            # halves, as whole numbers of 2^53 would overflow a long in a thousand rows
            total = [t + (h << 32) + lo for t, h, lo in zip(total, (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist(), strict=True)]
            low, high = (x.min(axis=0), x.max(axis=0)) if low is None else (np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0)))
        if n:
            yield pa.RecordBatch.from_pydict({"dim": pa.array(range(width), pa.int32()), "n": pa.array([n] * width, pa.int64()), "total": pa.array([str(t) for t in total]),
                                              "low": pa.array(low), "high": pa.array(high)})

    parts = fit.mapInArrow(partial, "dim int, n long, total string, low long, high long")
    found = parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.min("low").alias("low"), F.max("high").alias("high")).collect()
    found.sort(key=lambda r: r["dim"])
    n, totals = found[0]["n"], [int(r["total"]) for r in found]
    far = max(max(n * r["high"] - s, s - n * r["low"]) for r, s in zip(found, totals, strict=True))
    return Sums(n, totals, far)


def exact_scatter(fit: DataFrame, sums: Sums) -> list[list[int]]:
    """The sum over fit (x) of z z', z = n * x - S, in whole numbers.

    Every task multiplies residues by each prime and gives one number per
    prime and pair of dimensions; these are summed by pair, so what comes to
    the driver depends on the width and the size of the numbers only.
    """
    width, n, per = len(sums.per_dimension), sums.n, sums.per_dimension
    primes = primes_for(n * sums.farthest ** 2)
    upper = np.triu_indices(width)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros((len(primes), width, width), dtype=np.int64)
        seen = False
        for b in batches:
            x = rows_of(b.column(0), width)
            seen = seen or len(x) > 0
            for s in range(0, len(x), BLOCK):
                for k, p in enumerate(primes):
                    z = centred_residues(x[s: s + BLOCK], n, per, p)
                    acc[k] = (acc[k] + (z.T @ z).astype(np.int64)) % p
        if seen:
            for k in range(len(primes)):
                yield pa.RecordBatch.from_pydict({"prime": pa.array([k] * len(upper[0]), pa.int32()), "pair": pa.array(range(len(upper[0])), pa.int32()), "residue": pa.array(acc[k][upper])})

    parts = fit.mapInArrow(products, "prime int, pair int, residue long").groupBy("prime", "pair").agg(F.sum("residue").alias("residue")).toPandas()
    parts = parts.sort_values(["prime", "pair"])
    found = remaindered([parts.loc[parts["prime"] == k, "residue"].to_numpy() for k in range(len(primes))], primes)
    whole = [[0] * width for _ in range(width)]
    for i, j, m in zip(*(u.tolist() for u in upper), found, strict=True):
        whole[i][j] = whole[j][i] = m
    return whole


@dataclass(frozen=True)
class Whitening:
    """What turns a grid vector into its whitened components: (n * x - S) / n times ``scaled``."""

    sums: Sums
    scaled: np.ndarray
    explained: np.ndarray
    identity_error: float

    def deviations(self, x: np.ndarray) -> np.ndarray:
        return x * np.int64(self.sums.n) - np.array(self.sums.per_dimension, dtype=np.int64)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (self.deviations(x).astype(np.float64) / self.sums.n) @ self.scaled


def fit_whitening(fit: DataFrame, width: int, most: int = COMPONENTS) -> Whitening:
    """Components of the distinct grid vectors ``fit`` (x, all of one width), up to ``most``, those without spread left out."""
    sums = grid_sums(fit, width)
    if width * sums.farthest ** 2 >= 1 << 63:
        raise ValueError("a squared deviation n * x - S would not fit a long")
    scatter = exact_scatter(fit, sums)
    # a quotient of whole numbers is rounded once
    covariance = np.array([[m / sums.n ** 3 for m in row] for row in scatter])
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:most]
    order = order[values[order] > RANK * max(values.max(), 0.0)]
    values_kept, vectors = values[order], vectors[:, order]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)
    trace = sum(scatter[i][i] for i in range(width)) / sums.n ** 3
    bare = Whitening(sums, vectors / np.sqrt(values_kept), values_kept / trace if trace else values_kept, 0.0)
    return Whitening(sums, bare.scaled, bare.explained, identity_error(fit, bare, width))


def identity_error(fit: DataFrame, model: Whitening, width: int) -> float:
    """The largest absolute entry of the covariance of the whitened fit vectors minus the identity."""
    kept = model.scaled.shape[1]
    if not kept:
        return 0.0
    sent = fit.sparkSession.sparkContext.broadcast(model)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros((kept + 1, kept))
        for b in batches:
            x = rows_of(b.column(0), width)
            for s in range(0, len(x), BLOCK):
                w = sent.value.whitened(x[s: s + BLOCK])  # deviations are whole numbers that sum to zero: centred before multiplying
                acc += np.vstack([w.sum(axis=0), w.T @ w])
        yield pa.RecordBatch.from_pydict({"place": pa.array(range(acc.size), pa.int32()), "part": pa.array(acc.ravel())})

    parts = fit.mapInArrow(products, "place int, part double").groupBy("place").agg(F.sum("part").alias("part")).toPandas().sort_values("place")
    acc = parts["part"].to_numpy().reshape(kept + 1, kept) / model.sums.n
    return float(np.abs(acc[1:] - np.outer(acc[0], acc[0]) - np.eye(kept)).max())


def on_grid(vectors: DataFrame, key: str, embedding: str) -> DataFrame:
    """(vec_id, x) of the vectors without nulls and non-finite entries: floor(64 * c) + 1000000 of each entry as a double."""
    c = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col(key).alias("vec_id"), F.col(embedding).alias("embedding"))
    infinite = F.lit(float("inf"))
    fine = F.col("embedding").isNotNull() & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != infinite))
    far = F.exists(c, lambda v: F.abs(v) * GRID >= FARTHEST)
    checked = F.when(far, F.raise_error(F.lit("an entry is too large for the grid"))).otherwise(F.transform(c, lambda v: F.floor(v * GRID).cast("long") + SHIFT))
    return rows.filter(F.coalesce(fine, F.lit(False))).select("vec_id", checked.alias("x"))


def whiten(vectors: DataFrame, components: int = COMPONENTS, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per remaining vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null or hold a null or non-finite entry are dropped, the
    others go to a grid of 1/64. Mean and components come from each distinct
    grid vector once, so copies have no weight; copies are whitened like
    their first. Vectors of each width are whitened apart. Directions without
    spread have no component: fewer rows per vector then, none where all
    vectors are equal or of width zero. Repeated rows and null keys stay rows;
    extra columns are left out; an empty input gives no rows. Entries of 2^46
    and more raise, as do deviations whose squares exceed a long.
    """
    rows = cut(on_grid(vectors, key, embedding).withColumn("width", F.size("x")))
    fit = cut(rows.select("width", "x").distinct())
    found = None
    for width in sorted(r["width"] for r in rows.filter("width > 0").select("width").distinct().collect()):
        out = projected(rows.filter(F.col("width") == width), fit_whitening(fit.filter(F.col("width") == width).select("x"), width, components))
        found = out if found is None else found.unionByName(out)
    return projected(rows.limit(0), None) if found is None else found


def projected(rows: DataFrame, model: Whitening | None) -> DataFrame:
    """vec_id and what ``whiten`` says of rows (vec_id, x) under one model."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<deviation: long, whitened: array<double>>")
    def of(x: pd.Series) -> pd.DataFrame:
        if not len(x):
            return pd.DataFrame({"deviation": np.zeros(0, dtype=np.int64), "whitened": []})
        grid = np.stack(x.to_list()).astype(np.int64, copy=False)
        return pd.DataFrame({"deviation": (sent.value.deviations(grid) ** 2).sum(axis=1), "whitened": list(sent.value.whitened(grid))})

    explained = F.array(*[F.lit(float(e)) for e in (model.explained if model else [])]).cast("array<double>")
    made = rows.select("vec_id", of("x").alias("_m")).select("vec_id", "_m.deviation", F.posexplode("_m.whitened").alias("_at", "whitened"))
    return made.select("vec_id", (F.col("_at") + 1).cast("int").alias("component"), F.lit(model.sums.n if model else 0).cast("long").alias("n"), "deviation", "whitened",
                       F.get(explained, F.col("_at")).alias("explained"), F.lit(model.identity_error if model else 0.0).alias("identity_error"))
