"""Column expressions over action distributions, weights and rewards.

Distributions and action values are arrays of three doubles in canonical
action order. Everything stays in generated code: no lambda over arrays.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ACTIONS, EVENTS, OUTCOMES

N = len(ACTIONS)
INFINITY = float("inf")
LARGEST_EXPONENT = math.log(1.7976931348623157e308)


def items(values: Column) -> list[Column]:
    return [values[i] for i in range(N)]


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def action_number(action: Column) -> Column:
    """0-based index of an action, null if it is unknown."""
    return reduce(lambda c, i: c.when(action == ACTIONS[i], i), range(1, N), F.when(action == ACTIONS[0], 0))


def action_index(action: Column) -> Column:
    """0-based index of an action; an unknown one raises."""
    return F.coalesce(action_number(action), F.raise_error(F.concat(F.lit("unknown action: "), F.coalesce(action, F.lit("null")))).cast("int"))


def gather(values: Column, index: Column) -> Column:
    """The value of the action with the 0-based index."""
    return F.element_at(values, index.cast("int") + 1)


def safe_log(x: Column) -> Column:
    """ln, minus infinity at zero and below (Spark's ln is null there, and sums skip nulls)."""
    return F.when(x > 0, F.ln(x)).otherwise(F.lit(-INFINITY))


def safe_exp(x: Column) -> Column:
    return F.when(x > LARGEST_EXPONENT, F.lit(INFINITY)).otherwise(F.exp(F.greatest(x, F.lit(-745.0))))


def softmax(logits: list[Column]) -> Column:
    top = F.greatest(*logits)
    grown = [F.exp(x - top) for x in logits]
    return F.array(*[g / total(grown) for g in grown])


def normalized(values: Column) -> Column:
    whole = total(items(values))
    return F.array(*[F.try_divide(v, whole) for v in items(values)])


def floored(values: Column, floor: float) -> Column:
    """No probability under the floor, renormalised."""
    return normalized(F.array(*[F.greatest(v, F.lit(floor)) for v in items(values)]))


def expectation(weights: Column, values: Column) -> Column:
    return total([w * v for w, v in zip(items(weights), items(values))])


def centered(values: Column, weights: Column) -> Column:
    """Action values less their mean under the weights."""
    mean = expectation(weights, values)
    return F.array(*[v - mean for v in items(values)])


def blend(policy: Column, behavior: Column, weight: float) -> Column:
    if not 0 < weight < 1:
        raise ValueError("the blend weight must lie between 0 and 1")
    return F.array(*[p * weight + b * (1 - weight) for p, b in zip(items(policy), items(behavior))])


def reranked(base: Column, values: Column, support: Column, *, temperature: float, advantage: float, anchor: float, scale: float,
             floor: float = 0.01, clip: float = 2.0, penalty: float = 0.0, tiny: float = 1e-12) -> Column:
    """A base policy tempered, moved to better actions and anchored to what was logged."""
    if min(temperature, scale, clip, floor, tiny) <= 0 or min(advantage, anchor, penalty) < 0 or max(floor, tiny) >= 1:
        raise ValueError("temperature, scale, clip and floors must be positive (floors below 1), weights not negative")
    logits = []
    for b, a, s in zip(items(base), items(centered(values, base)), items(support)):
        x = F.ln(F.greatest(b, F.lit(tiny))) / temperature + F.least(F.greatest(a / scale, F.lit(-clip)), F.lit(clip)) * advantage
        x = x + F.ln(F.greatest(s, F.lit(floor))) * anchor
        if penalty:
            x = x - F.greatest(F.lit(math.log(floor)) - F.ln(F.greatest(s, F.lit(tiny))), F.lit(0.0)) * penalty
        logits.append(x)
    return softmax(logits)


def entropy(p: Column) -> Column:
    """In nats; a zero probability adds nothing."""
    return -total([F.when(x > 0, x * F.ln(x)).otherwise(0.0) for x in items(p)])


def overlap(p: Column, q: Column) -> Column:
    return total([F.least(a, b) for a, b in zip(items(p), items(q))])


def total_variation(p: Column, q: Column) -> Column:
    return total([F.abs(a - b) for a, b in zip(items(p), items(q))]) * 0.5


def mass_below(p: Column, q: Column, threshold: float) -> Column:
    """The mass that p puts where q is below the threshold."""
    return total([F.when(b < threshold, a).otherwise(0.0) for a, b in zip(items(p), items(q))])


def top_action(p: Column) -> Column:
    """0-based index of the largest probability; the earlier action wins a tie."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def margin(p: Column) -> Column:
    ranked = F.sort_array(p, asc=False)
    return ranked[0] - ranked[1]


def bellman(reward: Column, terminal: Column, next_value: Column, gamma: float) -> Column:
    """Reward and what follows; nothing follows a last step, whatever the value says."""
    return reward + F.when(terminal.cast("int") == 1, F.lit(0.0)).otherwise(next_value * gamma)


@dataclass(frozen=True)
class Reward:
    """Weights of the continuous outcomes and penalties of the events, in the order of schema.EVENTS."""

    map_weight: float = 0.45
    map_scale: float = 5.0
    lactate_weight: float = 0.25
    lactate_scale: float = 1.0
    deterioration: float = 0.9
    hypotension: float = 0.8
    overload: float = 0.7
    tachyarrhythmia: float = 0.7

    def __post_init__(self) -> None:
        values = [getattr(self, f.name) for f in fields(self)]
        if not all(math.isfinite(v) for v in values) or min(self.map_scale, self.lactate_scale) <= 0 or min(values[4:]) < 0:
            raise ValueError("reward settings must be finite, scales positive, penalties not negative")

    def components(self) -> dict[str, Column]:
        """The six parts by name."""
        m, lac = F.col(OUTCOMES[0]).cast("double"), F.col(OUTCOMES[1]).cast("double")
        out = {"map_component": F.tanh(m / self.map_scale) * self.map_weight, "lactate_component": -F.tanh(lac / self.lactate_scale) * self.lactate_weight}
        for name, event in zip(("deterioration", "hypotension", "overload", "tachyarrhythmia"), EVENTS):
            out[f"{name}_component"] = F.col(event).cast("double") * -getattr(self, name)
        return out

    def total(self) -> Column:
        return total(list(self.components().values()))

    def faults(self) -> Column:
        """True where an outcome isn't finite or an event isn't 0 or 1."""
        bad = F.lit(False)
        for c in OUTCOMES:
            bad = bad | F.coalesce(F.isnan(c) | (F.abs(F.col(c)) == INFINITY), F.lit(True))
        for c in EVENTS:
            bad = bad | ~F.coalesce(F.col(c).isin(0, 1), F.lit(False))
        return bad


PRIMARY = Reward()
ALTERNATIVE = Reward(0.0, 5.0, 0.25, 1.0, 1.2, 1.2, 1.2, 1.2)
