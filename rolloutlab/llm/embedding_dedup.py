"""Embedding near-dedup through a pivot-permutation index.

A vector is described by its ``near`` nearest reference points in order of
nearness. The inverted lists are kept per set of ``share`` pivots, each the
intersection of their lists: a vector is posted under every such set among its
nearest, so that two vectors meet if and only if they share that many pivots.
Of the lists they meet in, that of the pivots they share first counts. There
the orders are compared: a pair whose orders lie too far apart (footrule, with
pivots beyond the nearest taken as just behind them) goes, the rest is
verified by its cosine in double precision. Lists are cut into blocks and a
task compares two blocks, so that no list, however long, meets in one task; of
a pair of blocks come each vector's links and one link to a root, not pairs.

Pivots are vectors of the input, a bounded sample without near-copies of each
other, so that a large group of near-copies has one pivot and its members
share their nearest; every vector is indexed. Their number grows with the cube
root of the number of vectors: three pivots shared by chance then become rarer
as fast as vectors become more. Widths that are rare have random directions
for pivots instead.

Identical vectors of a label are collapsed first: however large a group of
copies, it is one entry of the index.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut, spread_join

NEAR = 7
SHARE = 3
COSINE = 0.98
#: Of the greatest possible footrule between two orders, the part that a pair may lie apart.
APART = 0.65
#: Pivots: this many times the cube root of the number of vectors, this many at least, and no more numbers than this in all of them.
PER_ROOT, LEAST_PIVOTS, MOST_NUMBERS = 32, 64, 1 << 22
#: Pivots are at most this alike, and chosen from so many candidates a pivot.
PIVOT_COSINE = 0.9
CANDIDATES = 4
#: Widths that have pivots of their own vectors; others have LEAST_PIVOTS random directions.
WIDTHS = 16
BASE = 1 << 20
BLOCK = 512
PAIRS_AT_ONCE = 100_000


def unit_rows(vectors: list | np.ndarray, width: int) -> np.ndarray:
    """Vectors of one width as unit rows."""
    out = np.asarray(vectors, dtype=np.float64).reshape(-1, width)
    out = out / np.abs(out).max(axis=1, keepdims=True)
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def usable(embedding: Column) -> Column:
    """Whether a vector takes part: not null, no null or non-finite component, not zero."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(embedding) > 0) & ~bad & F.exists(embedding, lambda x: x != 0), F.lit(False))


def thinned(points: np.ndarray, most: int) -> np.ndarray:
    """The first ``most`` of the unit rows whose cosine to each one taken is PIVOT_COSINE at most."""
    free, taken = np.ones(len(points), dtype=bool), []
    while len(taken) < most and free.any():
        taken.append(int(free.argmax()))
        free &= points @ points[taken[-1]] <= PIVOT_COSINE
        free[taken[-1]] = False
    return points[taken]


def pivot_count(vectors: int, width: int) -> int:
    return max(LEAST_PIVOTS, min(round(PER_ROOT * vectors ** (1 / 3)), MOST_NUMBERS // max(1, width * CANDIDATES)))


def choose_pivots(vectors: DataFrame, pivots: int | None = None) -> dict[int, np.ndarray]:
    """Reference points of the WIDTHS most frequent widths: vectors by hash that aren't near-copies of one before."""
    rows = vectors.select("embedding", F.size("embedding").alias("n"), F.xxhash64("embedding", F.lit(41)).alias("h"))
    widths = rows.groupBy("n").count().orderBy(F.desc("count"), "n").limit(WIDTHS).collect()
    out = {}
    for n, count in widths:
        most = pivots or pivot_count(count, n)
        found = rows.filter(F.col("n") == n).orderBy("h").limit(CANDIDATES * most).collect()
        out[n] = thinned(unit_rows([r["embedding"] for r in found], n), most)
    return out


def reference_points(points: dict[int, np.ndarray], width: int, near: int) -> np.ndarray:
    """The pivots of a width; random directions where it has fewer than an order needs."""
    found = points.get(width)
    if found is None or len(found) < near:
        found = unit_rows(np.random.default_rng(width).normal(size=(max(LEAST_PIVOTS, near), width)), width)
    return found


def orders(vectors: np.ndarray, points: np.ndarray, near: int) -> np.ndarray:
    """Numbers of the nearest pivots of unit rows, nearest first, of equals the first pivot."""
    likeness = vectors @ points.T
    found = np.sort(np.argpartition(-likeness, near - 1, axis=1)[:, :near], axis=1)
    return np.take_along_axis(found, np.argsort(-np.take_along_axis(likeness, found, 1), axis=1, kind="stable"), 1)


def described(points: dict[int, np.ndarray], near: int, share: int):
    """A function from vectors to the order of their nearest pivots, the pivot sets they are posted under, and each set's last place in the order."""
    sets = list(combinations(range(near), share))

    @F.pandas_udf("struct<order: array<int>, keys: array<long>>")
    def of(vectors: pd.Series) -> pd.DataFrame:
        widths = np.array([len(v) for v in vectors])
        order, keys = np.zeros((len(vectors), near), dtype=np.int32), np.zeros((len(vectors), len(sets)), dtype=np.int64)
        for width in np.unique(widths):
            rows = np.flatnonzero(widths == width)
            for part in np.array_split(rows, -(-len(rows) // 1024)):
                order[part] = orders(unit_rows([vectors.iat[i] for i in part], int(width)), reference_points(points, int(width), near), near)
        for k, chosen in enumerate(sets):
            for c in np.sort(order[:, chosen], axis=1).T:
                keys[:, k] = keys[:, k] * BASE + c
        return pd.DataFrame({"order": list(order), "keys": list(keys)})

    lasts = F.array(*[F.lit(s[-1]) for s in sets])
    return of, lasts


def compared(first: np.ndarray, second: np.ndarray, last: np.ndarray, share: int) -> np.ndarray:
    """Which pairs of orders count here: the set's pivots are the first they share, up to place ``last`` of the first order, and the orders are near enough."""
    near = first.shape[1]
    equal = first[:, :, None] == second[:, None, :]
    shared, place = equal.any(axis=2), equal.argmax(axis=2)
    at = np.arange(near)
    own = (shared & (at <= last[:, None])).sum(axis=1) == share
    whole = near * (near + 1) // 2
    footrule = np.where(shared, np.abs(place - at), near - at).sum(axis=1) + whole - np.where(shared, near - place, 0).sum(axis=1)
    return own & (footrule <= APART * 2 * whole)


def roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest number that each of 0..n-1 reaches by the links."""
    low = np.arange(n)
    while True:
        least = np.minimum(low[u], low[v])
        new = low.copy()
        np.minimum.at(new, u, least)
        np.minimum.at(new, v, least)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def links_of(groups: np.ndarray, rows: pa.Table, width: int, cosine: float, share: int) -> Iterator[pa.RecordBatch]:
    """Links within the groups of the rows (all of one width), as node, others (vectors linked to it, copies included) and root."""
    n = len(rows)
    rep, block, copies, last = (rows[c].to_numpy() for c in ("rep", "block", "copies", "last"))
    alone = (rows["low"].to_numpy() == rows["high"].to_numpy())
    order = rows["order"].combine_chunks().flatten().to_numpy().reshape(n, -1)
    vectors = unit_rows(rows["embedding"].combine_chunks().flatten().to_numpy(), width)
    ends = np.searchsorted(groups, groups, side="right")
    later = ends - 1 - np.arange(n)
    total = np.cumsum(later)
    start = 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + PAIRS_AT_ONCE, side="right")))
        own = later[start:stop]
        a = np.repeat(np.arange(start, stop), own)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(own) - own, own)
        on = alone[a] | (block[a] != block[b])
        a, b = a[on], b[on]
        on = compared(order[a], order[b], last[a], share)
        a, b = a[on], b[on]
        on = np.einsum("ij,ij->i", vectors[a], vectors[b]) >= cosine
        a, b = a[on], b[on]
        if len(a):
            nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            u, v = at[: len(a)], at[len(a):]
            others = np.bincount(u, copies[b], len(nodes)) + np.bincount(v, copies[a], len(nodes))
            root = roots(len(nodes), u, v)
            yield pa.RecordBatch.from_arrays([pa.array(rep[nodes]), pa.array(others.astype(np.int64)), pa.array(rep[nodes[root]])], ["node", "others", "root"])
        start = stop


def found_links(dealt: DataFrame, cosine: float, share: int) -> DataFrame:
    """node, others, root from entries that lie together by list and pair of blocks, in order of rep."""
    by = ["label", "width", "key", "low", "high"]

    def numbered_groups(table: pa.Table) -> np.ndarray:
        changed = np.zeros(len(table), dtype=bool)
        for c in by:
            col = table[c].combine_chunks()
            changed[1:] |= pc.not_equal(col.slice(1), col.slice(0, len(col) - 1)).to_numpy(zero_copy_only=False)
        return np.cumsum(changed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole(table: pa.Table, groups: np.ndarray) -> Iterator[pa.RecordBatch]:
            widths = table["width"].to_numpy()
            for width in np.unique(widths):
                rows = np.flatnonzero(widths == width)
                yield from links_of(groups[rows], table.take(pa.array(rows)), int(width), cosine, share)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([*held, batch])
            groups = numbered_groups(table)
            at = int(np.searchsorted(groups, groups[-1]))
            if at:
                yield from whole(table.slice(0, at), groups[:at])
            held = table.slice(at).to_batches()
        if held:
            table = pa.Table.from_batches(held)
            yield from whole(table, numbered_groups(table))

    return dealt.mapInArrow(run, "node long, others long, root long")


def near_vectors(vectors: DataFrame, cosine: float = COSINE, pivots: int | None = None, near: int = NEAR, share: int = SHARE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors link if their labels are equal and not null and their cosine is
    ``cosine`` at least. n_links counts the others linked directly, copies
    included; component_id is the smallest vec_id reachable. Vectors that are
    null, zero or hold null or non-finite components, or have a null label,
    link with nothing and stand for themselves. Repeated rows are vectors of
    their own with one vec_id. Empty input gives no rows; extra columns are
    left out.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")
    ok = rows.withColumn("_ok", F.col("label").isNotNull() & usable(F.col("embedding")))
    single = ok.filter("not _ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    used = ok.filter("_ok").withColumn("h", F.xxhash64("label", "embedding"))
    distinct = used.groupBy("label", "h", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    # a number of its own for each distinct vector, fixed by the written table
    reps = cut(distinct.withColumn("rep", F.monotonically_increasing_id()))
    n = reps.count()
    of, lasts = described(choose_pivots(reps, pivots), near, share)
    post = F.explode(F.arrays_zip(F.col("_p.keys").alias("key"), lasts.alias("last")))
    found = reps.select("rep", "label", F.size("embedding").alias("width"), of("embedding").alias("_p"))
    posts = cut(found.select("rep", "label", "width", F.col("_p.order").alias("order"), post.alias("_x")).select("rep", "label", "width", "order", F.col("_x.key").alias("key"), F.col("_x.last").alias("last")))
    by = ["label", "width", "key"]
    lists = posts.groupBy(*by).agg(F.count("*").alias("n")).filter("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    entries = spread_join(posts, cut(lists), by, "n", n * comb(near, share), ["rep"]).join(reps.select("rep", "copies", "embedding"), "rep")
    entries = entries.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = entries.select(*by, F.least("block", "_j").alias("low"), F.greatest("block", "_j").alias("high"), "rep", "block", "copies", "last", "order", "embedding")
    dealt = dealt.repartition(*by, "low", "high").sortWithinPartitions(*by, "low", "high", "rep")
    links = cut(found_links(dealt, cosine, share))
    degree = links.groupBy("node").agg(F.sum("others").alias("others")).withColumnRenamed("node", "rep")
    groups = components(links.select(F.col("node").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "rep")
    known = cut(reps.join(degree, "rep", "left").join(groups, "rep", "left").withColumn("component", F.coalesce("component", "rep")))
    names = known.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = known.join(names, "component").select("label", "h", F.col("embedding").alias("_e"), "component_id", "copies", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    linked = spread_join(used, cut(classes), ["label", "h"], "copies", n, ["vec_id"]).filter(F.col("embedding") == F.col("_e")).select("vec_id", "n_links", "component_id")
    return linked.unionByName(single).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
