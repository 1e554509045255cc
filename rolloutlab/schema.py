"""Actions, columns and types of logged trajectories."""

from __future__ import annotations

from pyspark.sql import types as T

#: Canonical order; ties go to the earlier action.
ACTIONS = ("maintain", "iv_fluids", "escalate_vasopressor")
EPISODE, STEP, ACTION = "patient_id", "time_step", "observed_clinician_action"
OUTCOMES = ("next_6h_map_delta", "next_6h_lactate_delta")
EVENTS = ("next_6h_deterioration", "adverse_hypotension_next_6h", "adverse_fluid_overload_next_6h", "adverse_tachyarrhythmia_next_6h")
OBSERVED = ("map_mm_hg", "lactate_mmol_l", "sex", "previous_action")
CATEGORICAL = frozenset({"sex", "previous_action", "hospital_id", "provider_id"})
#: Never an input of a policy, besides anything that starts with next_ or adverse_.
FORBIDDEN = frozenset({EPISODE, STEP, "split", "hospital_id", "provider_id", ACTION, "terminal", "handoff_note", "icu_mortality", "hospital_mortality"})
POST_PREFIXES = ("next_", "adverse_")

_TYPES = {
    EPISODE: T.StringType(), STEP: T.IntegerType(), "split": T.StringType(), "hospital_id": T.StringType(), "provider_id": T.StringType(),
    "map_mm_hg": T.DoubleType(), "lactate_mmol_l": T.DoubleType(), "sex": T.StringType(), "previous_action": T.StringType(), ACTION: T.StringType(),
    "terminal": T.IntegerType(), **{c: T.DoubleType() for c in OUTCOMES}, **{c: T.IntegerType() for c in EVENTS},
}
TRAJECTORY = T.StructType([T.StructField(n, t) for n, t in _TYPES.items()])
OUTCOME_FREE = T.StructType([T.StructField(n, _TYPES[n]) for n in (EPISODE, STEP, "split", *OBSERVED)])


class ContractError(ValueError):
    """A table breaks its contract."""


def policy_columns(columns: list[str] | tuple[str, ...]) -> tuple[str, ...]:
    """The columns, if a policy may see them: some, distinct, none an identifier, a label or known only after the action."""
    names = tuple(columns)
    if not names:
        raise ContractError("a policy needs at least one column")
    if any(not isinstance(c, str) or not c for c in names):
        raise ContractError("column names must be non-empty text")
    if len(set(names)) < len(names):
        raise ContractError("a column is named twice")
    leaked = [c for c in names if c in FORBIDDEN or c.startswith(POST_PREFIXES)]
    if leaked:
        raise ContractError(f"a policy may not see {', '.join(leaked)}")
    return names
