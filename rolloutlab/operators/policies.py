"""Target policies: each attaches a distribution over actions to a table.

A policy is anything with ``predict(frame) -> rows by three`` and, if fitted,
``episodes`` it was fitted on. Analytic ones have a column expression too.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.expressions import blend, reranked, softmax
from ..schema import ACTIONS
from .learners import softmax_rows

NAMES = ("always_maintain", "behavior_clone", "llm_zero_shot", "llm_improved")
PARAMETERS = ("base_temperature", "advantage_weight", "support_weight")
#: Weight of the improved policy in the blends with behaviour.
BLENDS = {"behavior_blend_25": 0.25, "behavior_blend_50": 0.5, "behavior_blend_75": 0.75}
#: Which of temperature, advantage and support a variant uses.
VARIANTS = {"zero_shot": (0, 0, 0), "temperature_only": (1, 0, 0), "support_only": (0, 0, 1), "value_only": (0, 1, 0), "value_plus_support": (1, 1, 1), **dict.fromkeys(BLENDS, (1, 1, 1))}


def variant_parameters(variant: str, chosen: Mapping[str, float]) -> dict[str, float]:
    """The parameters a variant applies; what it doesn't use is neutral."""
    if variant not in VARIANTS:
        raise ValueError(f"unknown variant {variant}")
    if not isinstance(chosen, Mapping) or set(chosen) != set(PARAMETERS):
        raise ValueError(f"parameters must be exactly {', '.join(PARAMETERS)}")
    values = [float(chosen[p]) for p in PARAMETERS]
    if not all(map(math.isfinite, values)) or values[0] <= 0 or min(values[1:]) < 0:
        raise ValueError("the temperature must be positive, weights not negative, all finite")
    return {p: v if used else neutral for p, v, used, neutral in zip(PARAMETERS, values, VARIANTS[variant], (1.0, 0.0, 0.0))}


def model_selection(config: Mapping) -> tuple[str, dict[str, float]] | None:
    """An explicit choice of variant and parameters: both or neither."""
    given = config.get("improvement", {})
    keys = [k for k in ("selected_variant", "selected_parameters") if given.get(k) is not None]
    if not keys:
        return None
    if len(keys) < 2:
        raise ValueError("selected_variant and selected_parameters go together")
    return given["selected_variant"], variant_parameters(given["selected_variant"], given["selected_parameters"])


class Constant:
    """Always the first action."""

    def predict(self, frame: pd.DataFrame) -> np.ndarray:
        return np.tile(np.eye(len(ACTIONS))[0], (len(frame), 1))

    def column(self) -> Column:
        return F.array(*[F.lit(1.0 if i == 0 else 0.0) for i in range(len(ACTIONS))])


class Analytic:
    """Softmax of a line in pressure and one in lactate."""

    origin = "deterministic_synthetic_not_llm"

    def predict(self, frame: pd.DataFrame) -> np.ndarray:
        m, lac = frame["map_mm_hg"].to_numpy(dtype=float), frame["lactate_mmol_l"].to_numpy(dtype=float)
        return softmax_rows(np.column_stack([np.full(len(frame), 0.5), (70 - m) / 15, (lac - 3) / 2]))

    def column(self) -> Column:
        return softmax([F.lit(0.5), (F.lit(70.0) - F.col("map_mm_hg")) / 15, (F.col("lactate_mmol_l") - 3) / 2])


def rerank(base: np.ndarray, values: np.ndarray, support: np.ndarray, temperature: float, advantage: float, anchor: float, scale: float,
           floor: float = 0.01, clip: float = 2.0, penalty: float = 0.0, tiny: float = 1e-12) -> np.ndarray:
    """The arrays' twin of functions.expressions.reranked."""
    if min(temperature, scale, clip, floor, tiny) <= 0 or min(advantage, anchor, penalty) < 0 or max(floor, tiny) >= 1:
        raise ValueError("temperature, scale, clip and floors must be positive (floors below 1), weights not negative")
    gain = np.clip((values - (base * values).sum(axis=1, keepdims=True)) / scale, -clip, clip)
    scores = np.log(np.maximum(base, tiny)) / temperature + advantage * gain + anchor * np.log(np.maximum(support, floor))
    if penalty:
        scores = scores - penalty * np.maximum(0, math.log(floor) - np.log(np.maximum(support, tiny)))
    return softmax_rows(scores)


def improved(base: Column, values: Column, support: Column, variant: str, parameters: Mapping[str, float], scale: float, floor: float = 0.01, penalty: float = 0.0) -> Column:
    """The improved policy as an expression: a base moved by action values and anchored to behaviour, by variant."""
    if variant == "zero_shot":
        return base
    a = variant_parameters(variant, parameters)
    moved = reranked(base, values, support, temperature=a["base_temperature"], advantage=a["advantage_weight"], anchor=a["support_weight"], scale=scale, floor=floor, penalty=penalty)
    return blend(moved, support, BLENDS[variant]) if variant in BLENDS else moved


@dataclass
class Improved:
    """A base policy moved by distilled advantages and anchored to behaviour."""

    base: object
    values: object
    support: object
    variant: str
    parameters: Mapping[str, float]
    scale: float
    floor: float = 0.01
    penalty: float = 0.0
    applied: dict[str, float] = field(init=False)

    def __post_init__(self) -> None:
        self.applied = variant_parameters(self.variant, self.parameters)
        self.weight = BLENDS.get(self.variant, 1.0)

    @property
    def episodes(self) -> list[str]:
        return sorted(set(self.values.episodes) | set(self.support.episodes))

    def predict(self, frame: pd.DataFrame) -> np.ndarray:
        base = self.base.predict(frame)
        if self.variant == "zero_shot":
            return base
        support = self.support.predict(frame)
        a = self.applied
        moved = rerank(base, self.values.predict(frame), support, a["base_temperature"], a["advantage_weight"], a["support_weight"], self.scale, self.floor, penalty=self.penalty)
        return self.weight * moved + (1 - self.weight) * support if self.weight < 1 else moved
