"""What a policy sees of a step: allowed fields and a note, and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import EPISODE, STEP, ContractError, policy_columns
from ..scoring.prompts import MISSING_NOTE


def observations(df: DataFrame, columns: Sequence[str], note: str | None = None, keep: Sequence[str] = (EPISODE, STEP)) -> DataFrame:
    """keep, ``structured`` (the allowed fields, numbers that are NaN as null) and ``handoff_note`` (the sentinel where there is none)."""
    names, kinds = policy_columns(tuple(columns)), dict(df.dtypes)
    fields = [F.when(~F.isnan(c), F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in names]
    text = F.coalesce(F.col(note), F.lit(MISSING_NOTE)) if note else F.lit(MISSING_NOTE)
    return df.select(*keep, F.struct(*fields).alias("structured"), text.alias("handoff_note"))


def observation_table(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (EPISODE, STEP)) -> DataFrame:
    """The allowed fields as columns again; raises unless ``structured`` has exactly them."""
    names = policy_columns(tuple(columns))
    if set(df.schema["structured"].dataType.names) != set(names):
        raise ContractError(f"an observation must have exactly {', '.join(names)}")
    return df.select(*keep, *[F.col(f"structured.{n}").alias(n) for n in names])


def observation_fault(text: Column, columns: Sequence[str]) -> Column:
    """What is wrong with an observation as JSON text, null if nothing: its fields, or those of ``structured``."""
    names = F.array(*[F.lit(n) for n in sorted(policy_columns(tuple(columns)))])
    keys = F.json_object_keys(text)
    inner = F.get_json_object(text, "$.structured")
    other = F.exists(keys, lambda k: ~k.isin("structured", "handoff_note"))
    return (F.when(keys.isNull(), "not an object").when(other, "unsupported field").when(inner.isNull() | F.json_object_keys(inner).isNull(), "no structured fields")
            .when(F.array_sort(F.json_object_keys(inner)) != names, "other structured fields"))
