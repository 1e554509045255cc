"""Logged episodes replayed step by step, and transitions taken in as a stream."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expressions import PRIMARY, Reward
from ..plans.validation import validate_environment
from ..schema import ACTION, EPISODE, STEP, ContractError


def transitions(df: DataFrame, observed: tuple[str, ...], reward: Reward = PRIMARY) -> DataFrame:
    """One row per step: observation, logged action, factual reward, next observation (null after the last), terminated."""
    w = Window.partitionBy(EPISODE).orderBy(STEP)
    state = F.struct(*observed)
    return df.select(EPISODE, STEP, state.alias("observation"), F.col(ACTION).alias("action"), reward.total().alias("reward"), F.lead(state).over(w).alias("next_observation"),
                     (F.col("terminal") == 1).alias("terminated"))


class LoggedReplay:
    """Walks one episode as it was logged; no other action can be tried."""

    def __init__(self, df: DataFrame, observed: tuple[str, ...], reward: Reward = PRIMARY):
        self.rows = transitions(validate_environment(df, observed), observed, reward)
        self.walk: Iterator | None = None

    def reset(self, episode: str):
        """The first observation of an episode."""
        found = self.rows.filter(F.col(EPISODE) == episode).orderBy(STEP).collect()  # one episode
        if not found:
            raise ContractError(f"no episode {episode}")
        self.walk = iter(found)
        return found[0]["observation"]

    def step_logged(self) -> dict:
        """The next logged step; raises when the episode is over or none was begun."""
        row = next(self.walk, None) if self.walk else None
        if row is None:
            raise ContractError("reset first")
        return row.asDict()


def running_rewards(stream: DataFrame, time: str, late: str = "1 hour", window: str = "1 day", reward: Reward = PRIMARY) -> DataFrame:
    """Mean factual reward by action and event-time window of a stream (or table) of transitions; rows later than the watermark are left out."""
    rows = stream.withWatermark(time, late) if stream.isStreaming else stream
    return rows.groupBy(F.window(time, window).alias("window"), F.col(ACTION).alias("action")).agg(F.count("*").alias("rows"), F.avg(reward.total()).alias("mean_reward"))
