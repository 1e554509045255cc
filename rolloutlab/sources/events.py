"""Trajectories read out of an event log: a user's events in order, cut into episodes, every event a step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expressions import softmax
from ..operators.numbering import numbered
from ..schema import ACTIONS, EPISODE, STEP

HORIZON = 12
#: Days of events of a user that one task may have to order.
DAYS = 1
#: Episode k of a user has their number plus k times this.
LATER = 10_000_000_000


def event_trajectories(spark: SparkSession, sf_dir: str, horizon: int = HORIZON, days: int = DAYS) -> DataFrame:
    """One row per (patient_id, time_step < horizon), for every event but a user's last, which is an outcome only.

    Successive events of a user make episodes of ``horizon`` steps, the last
    one shorter; every episode ends with its own terminal step. Outcomes look
    one event ahead, also past the end of the episode; histories start anew
    with each. value is the state, dvalue and is_error the outcome, reward a
    fixed mix of both, target an analytic policy.

    A user may have most of the events: they are numbered by days,
    and the windows after that hold one episode and the first event after it.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    kind = F.when(F.col("event_type").isin("view", "signup"), 0).when(F.col("event_type").isin("click", "purchase"), 1).otherwise(2)
    placed = numbered(events, ["user_id"], ["ts", "event_id"], "_n", F.floor(F.unix_date(F.to_date("ts")) / days))
    no, at = F.floor(F.col("_n") / horizon), (F.col("_n") % horizon).cast("int")
    here = F.struct(no.alias("_k"), at.alias(STEP))
    behind = F.struct((no - 1).alias("_k"), F.lit(horizon).alias(STEP))
    both = placed.select("user_id", "value", kind.alias("action_no"), (F.col("event_type") == "error").alias("_error"),
                         F.explode(F.when((at == 0) & (no > 0), F.array(here, behind)).otherwise(F.array(here))).alias("_at")).select("*", "_at.*")
    w = Window.partitionBy("user_id", "_k").orderBy(STEP)
    rows = both.select(
        (F.col("user_id") + F.col("_k") * LATER).cast("string").alias(EPISODE), STEP, "value", "action_no", F.coalesce(F.lag("action_no").over(w), F.lit(0)).alias("previous_no"),
        (F.lead("value").over(w) - F.col("value")).alias("dvalue"), F.lead("_error").over(w).alias("_ahead"), F.lead(F.lit(1), 2).over(w).isNull().cast("int").alias("terminal"))
    kept = rows.filter(F.col("_ahead").isNotNull()).withColumn("is_error", F.col("_ahead").cast("int")).drop("_ahead")
    reward = F.tanh(F.col("dvalue") / 50) * 0.45 - F.col("is_error") * 0.9
    logits = [F.lit(0.5), (F.lit(70.0) - F.col("value")) / 150, (F.col("value") - 30) / 100]
    return kept.withColumns({"reward": reward, "target": softmax(logits)})


def smoothed_behavior(steps: DataFrame, name: str = "behavior") -> DataFrame:
    """Adds Laplace-smoothed action frequencies given the previous action: three counts for each of the three, sent to every task."""
    counts = steps.groupBy("previous_no").agg(*[F.sum((F.col("action_no") == i).cast("long")).alias(f"_c{i}") for i in range(3)], F.count("*").alias("_n"))
    table = counts.select(F.col("previous_no").alias("_prev"), F.array(*[(F.col(f"_c{i}") + 1.0) / (F.col("_n") + 3.0) for i in range(3)]).alias(name))
    return steps.join(F.broadcast(table), steps["previous_no"] == table["_prev"]).drop("_prev")


def action_name(no: str = "action_no") -> F.Column:
    return F.element_at(F.array(*[F.lit(a) for a in ACTIONS]), F.col(no) + 1)
