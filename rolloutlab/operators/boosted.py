"""Boosted trees fitted where the rows are, and fitted Q evaluation with them.

Bins come from the distinct values or, where these are many, from a mergeable
quantile sketch. A tree grows by histograms: every partition adds up gradients
and counts per node, feature and bin, their sums come to the driver, and the
split goes back as a few numbers. Nodes that could be split next are looked at
together, so a tree of many leaves takes about as many jobs as it is deep, and
yet grows best first.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import bellman
from ..schema import ACTIONS, EPISODE, STEP, ContractError
from ..sources.files import settled
from .booster import MOST_BINS, BoostConfig, Booster
from .fqe import stage_rows

K = len(ACTIONS)
#: Relative error of the quantiles behind the bins, as one part in so many.
ACCURACY = 100_000
#: Trees after which the rows' scores are written again, so that no pass evaluates more.
WRITTEN_AFTER = 10
#: Columns of the binned rows.
CHUNK = ("_b", "_y", "_s")


def bin_cuts(df: DataFrame, features: str, width: int) -> list[np.ndarray]:
    """Per feature the midpoints of its distinct values, or of its quantiles where there are more than MOST_BINS; gaps are left out."""
    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [np.zeros(0)] * width
        for batch in batches:
            for f, c in enumerate(matrix(batch.column("x"), width).T):
                if len(found[f]) <= MOST_BINS:
                    found[f] = np.union1d(found[f], c[~np.isnan(c)] + 0.0)[: MOST_BINS + 1]
        yield pa.RecordBatch.from_pydict({"f": pa.array(np.repeat(np.arange(width), [len(v) for v in found])), "v": pa.array(np.concatenate(found))})

    rows = df.select(F.col(features).cast("array<double>").alias("x"))
    seen = rows.mapInArrow(distinct, "f long, v double").groupBy("f").agg(F.slice(F.collect_set("v"), 1, MOST_BINS + 1).alias("v"))
    found = {r["f"]: set(r["v"]) for r in seen.collect()}
    many = [f for f, v in found.items() if len(v) > MOST_BINS]
    if many:
        at = [k / (MOST_BINS + 1) for k in range(1, MOST_BINS + 1)]
        marks = rows.agg(*[F.percentile_approx(F.when(~F.isnan(F.col("x")[f]), F.col("x")[f]), at, ACCURACY) for f in many]).first()
        found |= {f: set(m) for f, m in zip(many, marks)}
    values = [np.array(sorted(found.get(f, ())), dtype=float) for f in range(width)]
    return [(v[:-1] + v[1:]) / 2 for v in values]


def matrix(x: pa.Array, width: int) -> np.ndarray:
    """Arrays of ``width`` numbers as rows, gaps as NaN."""
    return x.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def chunk(b: np.ndarray, y: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    """Many rows' bins, targets and scores as one row of three binary values: passes over them cost Spark little a row."""
    return pa.RecordBatch.from_pydict({"_b": [np.ascontiguousarray(b, dtype="<i2").tobytes()], "_y": [y.astype("<f8").tobytes()], "_s": [score.astype("<f8").tobytes()]})


def unpacked(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The chunks again; a feature's bins lie together."""
    for batch in batches:
        for b, y, score in zip(*(batch.column(c) for c in CHUNK)):
            yield np.asfortranarray(np.frombuffer(b.as_buffer(), dtype="<i2").reshape(-1, width)), np.frombuffer(y.as_buffer(), dtype="<f8"), np.frombuffer(score.as_buffer(), dtype="<f8")


def binned(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """The bin of every value: how many cuts lie below; gaps have one of their own, after the last."""
    return np.column_stack([np.where(np.isnan(c), len(t) + 1, np.searchsorted(t, c, side="left")) for c, t in zip(x.T, cuts, strict=True)]).astype(np.int64)


class Grown:
    """A tree while it grows: nodes with the split they would make, whether made or not."""

    def __init__(self, cuts: Sequence[np.ndarray]):
        self.cuts, self.split, self.children, self.facts = cuts, {}, {}, {}

    def places(self, b: np.ndarray, made: set[int] | None = None) -> np.ndarray:
        """The deepest known node of each row, or with ``made`` its leaf."""
        at = np.zeros(len(b), dtype=np.int64)
        work = [0]
        while work:
            node = work.pop()
            if node not in self.children or (made is not None and node not in made):
                continue
            f, cut, missing_left = self.split[node][1:4]
            left, right = self.children[node]
            rows = np.flatnonzero(at == node)
            bins = b[rows, f]
            at[rows] = np.where(np.where(bins == len(self.cuts[f]) + 1, missing_left, bins <= cut), left, right)
            work += [left, right]
        return at


def best_split(sums: Sequence[np.ndarray], counts: Sequence[np.ndarray], config: BoostConfig) -> tuple | None:
    """(gain, feature, bin, whether gaps go left, the left side's sum and count) of a node's histograms; the first of equals, none without a gain."""
    whole, n = float(sums[0].sum()), int(counts[0].sum())
    best = None
    for f, (g, c) in enumerate(zip(sums, counts, strict=True)):
        for missing_left in (False, True) if c[-1] else (False,):
            left_g, left_n = np.cumsum(g[:-2]) + missing_left * g[-1], np.cumsum(c[:-2]) + missing_left * c[-1]
            right_g, right_n = whole - left_g, n - left_n
            fine = (left_n >= config.least) & (right_n >= config.least)
            if not fine.any():
                continue
            gain = left_g**2 / np.maximum(left_n + config.ridge, 1e-300) + right_g**2 / np.maximum(right_n + config.ridge, 1e-300) - whole**2 / (n + config.ridge)
            at = int(np.where(fine, gain, -np.inf).argmax())
            if gain[at] > 0 and (best is None or gain[at] > best[0]):
                best = (float(gain[at]), f, at, missing_left, (float(left_g[at]), int(left_n[at])))
    return best


def histograms(rows: DataFrame, config: BoostConfig, cuts: Sequence[np.ndarray], trees: Sequence[tuple], tree: Grown, nodes: Sequence[int]) -> dict[int, tuple[list[np.ndarray], list[np.ndarray]]]:
    """Per node the gradient sums and counts of each feature's bins; one job, whose result grows with nodes and bins only."""
    sizes = [len(t) + 2 for t in cuts]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    whole = int(starts[-1])
    number = {node: k for k, node in enumerate(nodes)}
    slots = np.full(max(0, *nodes, *(c for pair in tree.children.values() for c in pair)) + 1, -1)
    slots[list(nodes)] = np.arange(len(nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((len(nodes), 2, whole))
        for b, y, score in unpacked(batches, len(cuts)):
            raw = score + tree_values(b, trees, len(b))
            gradient = (raw - y).astype(np.float32).astype(np.float64)
            slot = slots[tree.places(b)]
            known = np.flatnonzero(slot >= 0)
            slot, g = slot[known], gradient[known]
            for f, size in enumerate(sizes):
                at = slot * size + b[known, f]
                out[:, 0, starts[f]: starts[f + 1]] += np.bincount(at, g, len(nodes) * size).reshape(-1, size)
                out[:, 1, starts[f]: starts[f + 1]] += np.bincount(at, minlength=len(nodes) * size).reshape(-1, size)
        flat = out.ravel()
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_pydict({"at": pa.array(at), "v": pa.array(flat[at])})

    found = rows.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
    flat = np.zeros(len(nodes) * 2 * whole)
    flat[found["at"].to_numpy()] = found["v"].to_numpy()
    parts = flat.reshape(len(nodes), 2, whole)
    return {node: tuple([parts[k, i, starts[f]: starts[f + 1]] for f in range(len(cuts))] for i in range(2)) for node, k in number.items()}


def tree_values(b: np.ndarray, trees: Sequence[tuple], n: int) -> np.ndarray:
    """The sum over trees (tree, made splits, leaf values) of each row's leaf."""
    out = np.zeros(n)
    for tree, made, values in trees:
        of = np.zeros(max(values) + 1)
        of[list(values)] = list(values.values())
        out += of[tree.places(b, made)]
    return out


def grow(rows: DataFrame, config: BoostConfig, cuts: Sequence[np.ndarray], trees: Sequence[tuple]) -> tuple[Grown, set[int], dict[int, float]]:
    """One tree on the present gradients: the nodes, which splits are made, and the values of the leaves.

    The waiting split with the largest gain is made first. Where its children
    aren't known yet, those of all waiting splits are looked at in one job; the
    last split's need no look, as their sums follow from the split.
    """
    tree = Grown(cuts)
    made: set[int] = set()
    leaves, waiting, last = {0}, [], 0

    def look(nodes: Sequence[int]) -> None:
        for node, (sums, counts) in histograms(rows, config, cuts, trees, tree, nodes).items():
            tree.facts[node] = (float(sums[0].sum()), int(counts[0].sum()))
            tree.split[node] = best_split(sums, counts, config)

    def offer(node: int) -> None:
        if tree.split.get(node):
            heapq.heappush(waiting, (-tree.split[node][0], node))

    look([0])
    offer(0)
    while waiting and len(leaves) < config.leaves:
        _, node = heapq.heappop(waiting)
        made.add(node)
        if node not in tree.children and len(leaves) + 1 == config.leaves:
            tree.children[node] = (last + 1, last + 2)
            (g, n), (left_g, left_n) = tree.facts[node], tree.split[node][4]
            tree.facts[last + 1], tree.facts[last + 2] = (left_g, left_n), (g - left_g, n - left_n)
        elif node not in tree.children:
            new = []
            for parent in (node, *(n for _, n in waiting)):
                if parent not in tree.children:
                    tree.children[parent] = (last + 1, last + 2)
                    new += [last + 1, last + 2]
                    last += 2
            look(new)
        leaves = leaves - {node} | set(tree.children[node])
        for child in tree.children[node]:
            offer(child)
    values = {node: -config.rate * tree.facts[node][0] / (tree.facts[node][1] + config.ridge) for node in leaves}
    return tree, made, values


def as_nodes(tree: Grown, made: set[int], values: dict[int, float]) -> list[tuple]:
    """The tree as a booster keeps it: (feature, cut, gaps left, left, right) or (value,), the root first."""
    out: list[tuple] = [()]
    work = [(0, 0)]
    while work:
        node, at = work.pop()
        if node in made:
            f, cut, missing_left = tree.split[node][1:4]
            left, right = len(out), len(out) + 1
            out += [(), ()]
            out[at] = (f, tree.cuts[f][cut], missing_left, left, right)
            work += list(zip(tree.children[node], (left, right)))
        else:
            out[at] = (values[node],)
    return out


def fit_boosted(df: DataFrame, features: str, target: str, width: int, config: BoostConfig = BoostConfig(), cuts: Sequence[np.ndarray] | None = None) -> Booster:
    """A booster of ``features`` (an array of ``width`` numbers, gaps null or NaN) for a numeric target; raises without rows.

    The rows are binned and written once; their scores are written anew every
    WRITTEN_AFTER trees.
    """
    cuts = bin_cuts(df, features, width) if cuts is None else list(cuts)
    mean = df.agg(F.avg(target)).first()[0]
    if mean is None:
        raise ContractError("no rows to fit on")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield chunk(binned(matrix(batch.column("x"), width), cuts), batch.column("_y").to_numpy(zero_copy_only=False), np.full(batch.num_rows, mean))

    rows = settled(df.select(F.col(features).cast("array<double>").alias("x"), F.col(target).cast("double").alias("_y")).mapInArrow(place, ", ".join(f"{c} binary" for c in CHUNK)))
    model = Booster(config)
    model.cuts, model.base = cuts, float(mean)
    recent: list[tuple] = []
    for k in range(config.iterations):
        recent.append(grow(rows, config, cuts, recent))
        model.trees.append(as_nodes(*recent[-1]))
        if len(recent) == WRITTEN_AFTER and k + 1 < config.iterations:
            rows, recent = settled(scored(rows, recent, width)), []
    return model


def scored(rows: DataFrame, trees: Sequence[tuple], width: int) -> DataFrame:
    """The rows with the trees' values in their scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, y, score in unpacked(batches, width):
            yield chunk(b, y, score + tree_values(b, trees, len(b)))

    return rows.mapInArrow(run, rows.schema)


def with_action_values(df: DataFrame, model: Booster, features: str, width: int, name: str = "q") -> DataFrame:
    """Adds the model's value of each action; the model's features are ``width`` numbers and one indicator per action."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("array<double>")
    def of(x: pa.Array) -> pa.Array:
        state = matrix(x, width)
        each = [sent.value.predict(np.column_stack([state, np.tile(np.eye(K)[a], (len(state), 1))])) for a in range(K)]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * K, pa.int32()), pa.array(np.column_stack(each).ravel()))

    return df.withColumn(name, of(F.col(features).cast("array<double>")))


def boosted_values(df: DataFrame, features: str, action: str, reward: str, target: str, horizon: int, width: int, gamma: float = 1.0, config: BoostConfig = BoostConfig(), apply_to: DataFrame | None = None,
                   cuts: Callable[[DataFrame], Sequence[np.ndarray]] | None = None) -> DataFrame:
    """Adds q (three values) and v to every row: fitted Q evaluation of one target policy, last step first, boosted trees at every step.

    ``features`` is an array of ``width`` numbers, ``target`` a distribution;
    the trees see an indicator of the action, too. Steps that no episode has are left
    out. With ``apply_to`` the fit's values go to the rows of that table.
    """
    hot = F.array(*[F.when(F.col(action) == a, 1.0).otherwise(0.0) for a in range(K)])
    present = {r[0] for r in df.filter(F.col(STEP).isin(list(range(horizon)))).select(STEP).distinct().collect()}
    done, ahead = None, None
    for t in range(horizon - 1, -1, -1):
        if t not in present:
            continue
        rows = stage_rows(df, t)
        follow = rows.withColumn("_next", F.lit(0.0)) if ahead is None else rows.join(ahead.hint("merge"), EPISODE, "left").withColumn("_next", F.coalesce("_next", F.lit(0.0)))
        y = bellman(F.col(reward), F.col("terminal"), F.col("_next"), gamma)
        written = settled(follow.select(*df.columns, y.alias("_y")))
        fit = written.withColumn("_x", F.concat(F.col(features).cast("array<double>"), hot))
        model = fit_boosted(fit, "_x", "_y", width + K, config, cuts(fit) if cuts else None)

        def valued(to: DataFrame) -> DataFrame:
            out = with_action_values(to, model, features, width)
            return out.withColumn("v", sum((F.col(target)[a] * F.col("q")[a] for a in range(1, K)), F.col(target)[0] * F.col("q")[0]))

        own = settled(valued(written.select(*df.columns)))
        ahead = own.select(EPISODE, F.col("v").alias("_next"))
        kept = own if apply_to is None else valued(stage_rows(apply_to, t))
        done = kept if done is None else done.unionByName(kept)
    if done is None:
        raise ContractError("no rows at any step")
    return done
