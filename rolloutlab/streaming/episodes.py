"""Logged episodes replayed from a stream, step by step, as a keyed state."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..schema import ACTION, EPISODE, STEP, ContractError

#: What a fault says of a step, for reports.
FAULTS = {"late": "its step is past", "repeated": "its step waits already", "ended": "the episode has ended", "beyond": "its step is outside the horizon", "gap": "the steps before it never came", "unfinished": "no step came after it"}
#: The episodes of a lane as compressed JSON.
STATE = "episodes binary"
#: Lanes that the episodes of a stream without idle time are dealt over.
LANES = 8192


def replayed(stream: DataFrame, observed: Sequence[str], horizon: int, idle: str | None = None, reward: str = "reward") -> DataFrame:
    """One row per step of a stream of logged steps: observation, action, reward, next_<observation>, terminated, fault.

    ``stream`` has the keys, ``observed``, the action, ``reward`` and
    ``terminal``. Of an episode is kept: the step that it waits for, the one
    whose successor is awaited, and steps that came early (fewer than
    ``horizon``); episodes of a lane share a state. Steps leave it in order, whatever the order in which they
    came, each once the next is known; the terminal one at once. Steps that
    are past, repeated, outside the horizon or behind the end leave with a
    fault and change nothing. With ``idle``, an episode of a stream that hears
    nothing for so long closes: the awaited step leaves as ``unfinished``,
    early ones as ``gap``, and that the episode ever was is forgotten. Such a
    stream runs batches without data, too, so it never counts as processed;
    without ``idle`` a stream may be run to the end of its data. Null keys
    are refused with ``beyond``; nulls elsewhere pass. Where a stream is over,
    what still waits is not given out.
    """
    if horizon < 1 or not observed:
        raise ContractError("a replay needs a horizon and something observed")
    if not stream.isStreaming:
        raise ContractError("a table is replayed by transitions")
    fields = {f.name: f.dataType for f in stream.schema.fields}
    columns = [*observed, ACTION, reward]
    out = T.StructType([T.StructField(EPISODE, T.StringType()), T.StructField(STEP, T.IntegerType()), *[T.StructField(c, fields[c]) for c in columns],
                        *[T.StructField(f"next_{c}", fields[c]) for c in observed], T.StructField("terminated", T.BooleanType()), T.StructField("fault", T.StringType())])
    live = idle is not None
    wait = int(pd.Timedelta(idle).total_seconds() * 1000) if live else 0

    width = len(observed)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known: dict[str, list] = json.loads(zlib.decompress(bytes(state.get[0]))) if state.exists else {}
        done: list[tuple] = []

        def give(episode: str | None, step: int | None, of: list, follow: list | None = None, terminated: bool = False, fault: str | None = None) -> None:
            done.append((episode, step, *of, *(follow[:width] if follow else [None] * width), terminated, fault))

        def close(episode: str, ended: bool, held: dict[str, list]) -> None:
            for step in sorted(held, key=int):
                give(episode, int(step), held[step][0], fault="ended" if ended else "gap")
            held.clear()

        if state.hasTimedOut:
            for episode, (_, ended, pending, held) in known.items():
                if pending:
                    give(episode, *pending, fault="unfinished")
                close(episode, ended, held)
            state.remove()
        else:
            rows = [(episode, None if s is None else int(s), t == 1, of) for frame in frames
                    for episode, s, t, *of in frame[[EPISODE, STEP, "terminal", *columns]].astype(object).where(lambda f: f.notna(), None).itertuples(index=False, name=None)]
            for episode, step, end, of in sorted(rows, key=lambda r: -1 if r[1] is None else r[1]):
                if episode is None:
                    give(None, step, of, fault="beyond")
                    continue
                # the step that it waits for, whether it has ended, the step whose successor is awaited, early steps
                it = known.setdefault(episode, [0, False, None, {}])
                expected, ended, pending, held = it
                fault = "beyond" if step is None or not 0 <= step < horizon else "ended" if ended else "late" if step < expected else "repeated" if str(step) in held else None
                if fault:
                    give(episode, step, of, fault=fault)
                    continue
                held[str(step)] = [of, end]
                while not ended and str(expected) in held:
                    of, ended = held.pop(str(expected))
                    if pending:
                        give(episode, *pending, follow=of)
                    expected, pending = expected + 1, [expected, of]
                    if ended:
                        give(episode, *pending, terminated=True)
                        pending = None
                        close(episode, ended, held)
                it[:] = expected, ended, pending, held
            state.update((zlib.compress(json.dumps(known).encode(), 1),))
            if live:
                state.setTimeoutDuration(wait)
        frame = pd.DataFrame(done, columns=out.fieldNames(), dtype=object)
        yield frame.astype({f.name: "float64" for f in out.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))})

    episode = F.col(EPISODE).cast("string")
    # a live episode times out by itself; without an end of time, many share a state, as a call for each would cost more than its steps
    lane = episode if live else F.pmod(F.xxhash64(episode), F.lit(LANES)).cast("string")
    keyed = stream.select(lane.alias("_lane"), episode.alias(EPISODE), STEP, "terminal", *columns).groupBy("_lane")
    return keyed.applyInPandasWithState(run, out, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if live else GroupStateTimeout.NoTimeout)
