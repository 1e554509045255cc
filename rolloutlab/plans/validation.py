"""Contracts as aggregate queries: one pass counts every kind of fault, and any fault raises."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expressions import INFINITY, PRIMARY, items, normalized, total
from ..schema import ACTION, ACTIONS, EPISODE, EVENTS, OUTCOMES, POST_PREFIXES, STEP, ContractError, policy_columns


def count_faults(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row: how many rows break each check."""
    return df.agg(*[F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long").alias(n) for n, c in checks.items()])


def require(df: DataFrame, checks: dict[str, Column], what: str) -> None:
    """Raises ContractError if a row breaks a check."""
    row = count_faults(df, checks).first()
    broken = [f"{n}: {row[n]} rows" for n in checks if row[n]]
    if broken:
        raise ContractError(f"{what}: {'; '.join(broken)}")


def finite(c: Column) -> Column:
    return F.coalesce(~F.isnan(c) & (F.abs(c) != INFINITY), F.lit(False))


def distribution_faults(p: Column) -> Column:
    """True unless p holds three finite probabilities that sum to 1 within 1e-8."""
    parts = [F.get(p, F.lit(i)) for i in range(len(ACTIONS))]
    ok = F.coalesce(F.size(p) == len(ACTIONS), F.lit(False))
    for x in parts:
        ok = ok & finite(x) & F.coalesce(x >= 0, F.lit(False))
    return ~(ok & F.coalesce(F.abs(total(parts) - 1) <= 1e-8, F.lit(False)))


def require_distribution(df: DataFrame, column: str) -> None:
    require(df, {"not a distribution": distribution_faults(F.col(column))}, column)


def marked_trajectory(df: DataFrame) -> DataFrame:
    """Adds what the contract compares: place and length of the step in its episode, the action before."""
    w = Window.partitionBy(EPISODE).orderBy(STEP)
    return df.withColumns({"_place": F.row_number().over(w) - 1, "_ahead": F.lead(F.lit(1)).over(w), "_before": F.lag(ACTION).over(w),
                           "_copies": F.count("*").over(Window.partitionBy(EPISODE, STEP))})


def trajectory_checks(df: DataFrame, horizon: int | None = None) -> dict[str, Column]:
    last = F.col("_ahead").isNull()
    checks = {
        "null key": F.col(EPISODE).isNull() | F.col(STEP).isNull(),
        "repeated key": F.col("_copies") > 1,
        "unknown action": ~F.coalesce(F.col(ACTION).isin(*ACTIONS), F.lit(False)),
        "step not an integer": F.col(STEP).cast("double") != F.floor(F.col(STEP).cast("double")),
        "steps not consecutive from 0": F.col(STEP) != F.col("_place"),
        "terminal not 0 or 1": ~F.coalesce(F.col("terminal").cast("int").isin(0, 1), F.lit(False)),
        "terminal not on the last step alone": F.coalesce((F.col("terminal").cast("int") == 1) != last, F.lit(True)),
    }
    if "previous_action" in df.columns:
        checks["previous action not the one before"] = F.col("_before").isNotNull() & ~F.coalesce(F.col("previous_action") == F.col("_before"), F.lit(False))
    if horizon is not None:
        checks["episode of another length"] = last & (F.col("_place") != horizon - 1)
    return checks


def validate_trajectory(df: DataFrame, horizon: int | None = None) -> DataFrame:
    """The table, if it holds whole, ordered, well-labelled episodes."""
    needed = {EPISODE, STEP, ACTION, "terminal"}
    if missing := sorted(needed - set(df.columns)):
        raise ContractError(f"columns are missing: {', '.join(missing)}")
    require(marked_trajectory(df), trajectory_checks(df, horizon), "trajectory")
    return df


def environment_checks(df: DataFrame) -> dict[str, Column]:
    checks = trajectory_checks(df)
    checks["outcome not finite or event not binary"] = PRIMARY.faults()
    if "previous_action" in df.columns:
        checks["first step not preceded by maintain"] = (F.col("_place") == 0) & ~F.coalesce(F.col("previous_action") == ACTIONS[0], F.lit(False))
    return checks


def validate_environment(df: DataFrame, observed: list[str] | tuple[str, ...]) -> DataFrame:
    """As validate_trajectory; outcomes must be finite, events binary, first steps preceded by ``maintain``, and policies see no outcome."""
    names = policy_columns(observed)
    if missing := sorted({*names, *OUTCOMES, *EVENTS, EPISODE, STEP, ACTION, "terminal"} - set(df.columns)):
        raise ContractError(f"columns are missing: {', '.join(missing)}")
    require(marked_trajectory(df), environment_checks(df), "environment")
    if any(c.startswith(POST_PREFIXES) for c in names):
        raise ContractError("a policy sees an outcome")
    return df


def role_overlaps(**roles: DataFrame) -> DataFrame:
    """left_role, right_role, shared, example: pairs of roles that have episodes in common, how many and the first of them."""
    rows = None
    for no, (name, df) in enumerate(roles.items()):
        part = df.select(F.col(EPISODE).cast("string").alias(EPISODE)).distinct().select(EPISODE, F.struct(F.lit(no).alias("no"), F.lit(name).alias("role")).alias("_r"))
        rows = part if rows is None else rows.unionByName(part)
    held = rows.groupBy(EPISODE).agg(F.array_sort(F.collect_set("_r")).alias("_rs")).filter(F.size("_rs") > 1)  # at most one entry per role
    pairs = [F.when(F.size("_rs") > j, F.struct(F.col("_rs")[i]["role"].alias("left_role"), F.col("_rs")[j]["role"].alias("right_role"))) for i in range(len(roles)) for j in range(i + 1, len(roles))]
    met = held.select(EPISODE, F.explode(F.array_compact(F.array(*pairs))).alias("_p")).select(EPISODE, "_p.*")
    return met.groupBy("left_role", "right_role").agg(F.count("*").alias("shared"), F.min(EPISODE).alias("example"))


def require_disjoint(**roles: DataFrame) -> None:
    """Raises if an episode has two roles; each table needs the episode key."""
    found = role_overlaps(**roles).orderBy("left_role", "right_role").first()
    if found:
        raise ContractError(f"roles {found['left_role']} and {found['right_role']} share episodes, for example {found['example']}")


def role_cover(whole: DataFrame, *parts: DataFrame) -> DataFrame:
    """One row: rows of the whole, rows of the parts together, and whether they agree."""
    both = whole.select(F.lit(1).alias("w"), F.lit(0).alias("p"))
    for part in parts:
        both = both.unionByName(part.select(F.lit(0).alias("w"), F.lit(1).alias("p")))
    return both.agg(F.coalesce(F.sum("w"), F.lit(0)).cast("long").alias("whole_rows"), F.coalesce(F.sum("p"), F.lit(0)).cast("long").alias("part_rows")).withColumn("covered", F.col("whole_rows") == F.col("part_rows"))


def require_cover(whole: DataFrame, *parts: DataFrame) -> None:
    """Raises unless the parts have as many rows as the whole."""
    found = role_cover(whole, *parts).first()
    if not found["covered"]:
        raise ContractError(f"roles cover {found['part_rows']} of {found['whole_rows']} rows")


def realignment(left: DataFrame, right: DataFrame, keys: Sequence[str] = (EPISODE, STEP)) -> DataFrame:
    """One row: keys on both sides, on one only, and repeated ones; the sides align one to one if only the first isn't zero."""
    a = left.groupBy(*keys).agg(F.count("*").alias("_a"))
    b = right.groupBy(*[F.col(k).alias(f"_of_{k}") for k in keys]).agg(F.count("*").alias("_b"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    met = a.join(b, on, "full")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return met.agg(count(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("matched"), count(F.col("_b").isNull()).alias("left_only"), count(F.col("_a").isNull()).alias("right_only"),
                   count((F.coalesce("_a", F.lit(0)) > 1) | (F.coalesce("_b", F.lit(0)) > 1)).alias("repeated"))


def require_realigned(left: DataFrame, right: DataFrame, keys: Sequence[str] = (EPISODE, STEP)) -> None:
    found = realignment(left, right, keys).first()
    if found["left_only"] or found["right_only"] or found["repeated"]:
        raise ContractError(f"rows do not align one to one: {found['left_only']} and {found['right_only']} keys on one side only, {found['repeated']} repeated")


def horizon_faults(df: DataFrame, horizon: int) -> DataFrame:
    """One row: episodes, and how many don't have each step of the horizon once."""
    steps = df.groupBy(EPISODE).agg(F.count("*").alias("_n"), F.countDistinct(STEP).alias("_d"), F.min(STEP).alias("_low"), F.max(STEP).alias("_high"))
    whole = (F.col("_n") == horizon) & (F.col("_d") == horizon) & (F.col("_low") == 0) & (F.col("_high") == horizon - 1)
    return steps.agg(F.count("*").alias("episodes"), F.coalesce(F.sum((~F.coalesce(whole, F.lit(False))).cast("long")), F.lit(0)).alias("incomplete"))


def scope_audit(fitted: DataFrame, allowed: DataFrame, exact: Sequence[str] = ()) -> DataFrame:
    """component, episodes, outside, same: how many episodes each part was fitted on, how many of them aren't allowed, and whether they are exactly
    the allowed ones; ``ok`` if none lies outside and a component of ``exact`` misses none.

    ``fitted`` has component and the episode key, ``allowed`` the key.
    """
    known = allowed.select(F.col(EPISODE).cast("string").alias("_id")).distinct()
    rows = fitted.select("component", F.col(EPISODE).cast("string").alias(EPISODE)).distinct()
    met = rows.join(known, F.col(EPISODE) == F.col("_id"), "left").groupBy("component").agg(F.count("*").alias("episodes"), F.sum(F.col("_id").isNull().cast("long")).alias("outside"))
    n = known.count()
    same = (F.col("outside") == 0) & (F.col("episodes") == n)
    return met.withColumn("same", same).withColumn("ok", (F.col("outside") == 0) & (F.col("same") | ~F.col("component").isin(*(exact or [""]))))


def blend_error(blend: Column, behavior: Column, weight: float) -> Column:
    """How far a convex blend is from the one made again of the part that is recovered from it (clipped at zero, renormalised)."""
    if not 0 < weight <= 1:
        raise ContractError("the blend weight must lie between 0 and 1")
    part = normalized(F.array(*[F.greatest((p - b * (1 - weight)) / weight, F.lit(0.0)) for p, b in zip(items(blend), items(behavior))]))
    return F.greatest(*[F.abs(x * weight + b * (1 - weight) - p) for x, b, p in zip(items(part), items(behavior), items(blend))])


def sdr_checks(behavior: Column, target: Column, numbers: list[Column]) -> dict[str, Column]:
    bad = F.lit(False)
    for c in numbers:
        bad = bad | ~finite(c)
    return {"number not finite": bad | ~finite(behavior) | ~finite(target), "behavior probability not in (0, 1]": ~F.coalesce((behavior > 0) & (behavior <= 1), F.lit(False)),
            "target probability not in [0, 1]": ~F.coalesce((target >= 0) & (target <= 1), F.lit(False))}
