"""Answers and token probabilities kept as JSON lines, replayed by a join on the key."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.validation import distribution_faults, require
from ..schema import ACTIONS, ContractError
from .prompts import choice_messages, parse_answer, request_key, sha256

RESPONSES = "key string, response string"
PROBABILITIES = "key string, model_id string, prompt_sha256 string, probabilities struct<maintain: double, iv_fluids: double, escalate_vasopressor: double>"


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per key; a malformed line or two different records of a key raise."""
    rows = spark.read.schema(schema + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path).cache()
    require(rows, {"malformed record": F.col("_bad").isNotNull() | F.col("key").isNull()}, "cache")
    names = [c for c in rows.columns if c != "_bad"]
    kinds = rows.groupBy("key").agg(F.countDistinct(F.to_json(F.struct(*names))).alias("kinds"))
    require(kinds, {"conflicting records of a key": F.col("kinds") > 1}, "cache")
    return rows.select(*names).dropDuplicates(["key"])


def append_lines(cache: DataFrame | None, new: DataFrame, path: str) -> None:
    """Appends records of unknown keys; a different record of a known key raises."""
    new = new.dropDuplicates()
    if cache is not None:
        body = F.to_json(F.struct(*new.columns))
        met = new.select("key", body.alias("a")).join(cache.select(*new.columns).select(F.col("key").alias("_k"), body.alias("b")), F.col("key") == F.col("_k"))
        require(met, {"a known key with another record": F.col("a") != F.col("b")}, "cache")
        new = new.join(cache.select("key"), "key", "left_anti")
    new.write.mode("append").json(path)


def with_keys(df: DataFrame, columns: Sequence[str], model: str, note: str | None = None, required: bool = False, **settings) -> DataFrame:
    """Adds ``key``, the request key of each row's prompt, ``prompt_sha256`` and ``prompt``, the last message; batches on the executors.

    ``settings`` (revision, prompt version, tokens, decoding, fingerprint) are
    part of the key. A missing note is fatal where one is ``required``.
    """
    names = list(columns)

    @F.pandas_udf("struct<key: string, prompt_sha256: string, prompt: string>")
    def key(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in rows.to_dict("records"):
            state = {c: None if pd.isna(r[c]) else r[c].item() if isinstance(r[c], np.generic) else r[c] for c in names}
            messages = choice_messages(state, names, note=r.get(note) if note else None, required=required)
            out.append((request_key(messages, model_id=model, **settings), sha256(messages), messages[-1]["content"]))
        return pd.DataFrame(out, columns=["key", "prompt_sha256", "prompt"])

    found = df.withColumn("_k", key(F.struct(*names, *([note] if note else []))))
    return found.withColumns({c: F.col(f"_k.{c}") for c in ("key", "prompt_sha256", "prompt")}).drop("_k")


def replay(keyed: DataFrame, cache: DataFrame, score: Callable[[Sequence[str]], np.ndarray] | None = None, batch: int = 8) -> DataFrame:
    """Adds ``target`` from the cache; keys that miss are scored once each in padded batches, or raise without a scorer."""
    arrays = cache.select("key", F.array(*[F.col(f"probabilities.{a}") for a in ACTIONS]).alias("target"))
    missing = keyed.select("key").distinct().join(arrays, "key", "left_anti")
    if score is None:
        require(missing, {"key not in the cache": F.lit(True)}, "replay")
    else:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                keys, out = frame["key"].tolist(), []
                for s in range(0, len(keys), batch):
                    part = keys[s: s + batch]
                    full = part + [part[-1]] * (batch - len(part))
                    out += np.asarray(score(full))[: len(part)].tolist()
                yield pd.DataFrame({"key": keys, "target": out})

        arrays = arrays.unionByName(missing.mapInPandas(run, "key string, target array<double>"))
    require(arrays, {"not a distribution": distribution_faults(F.col("target"))}, "replay")
    return keyed.join(arrays, "key")


def parsed_answers(df: DataFrame, raw: str, fallback: Sequence[float] = (0.8, 0.15, 0.05)) -> DataFrame:
    """Adds ``target`` parsed from JSON answers and ``fell_back``: a malformed answer gets the fallback and is counted."""

    @F.pandas_udf("struct<target: array<double>, fell_back: boolean>")
    def of(answers: pd.Series) -> pd.DataFrame:
        out = []
        for a in answers:
            try:
                out.append((parse_answer(a)[0], False))
            except (ContractError, ValueError, TypeError, KeyError):
                out.append((list(fallback), True))
        return pd.DataFrame(out, columns=["target", "fell_back"])

    return df.withColumn("_p", of(raw)).withColumns({"target": F.col("_p.target"), "fell_back": F.col("_p.fell_back")}).drop("_p")


def runtime(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, requests, fallbacks and their rate."""
    return df.groupBy(*keys).agg(F.count("*").alias("requests"), F.sum(F.col("fell_back").cast("long")).alias("fallbacks"), F.avg(F.col("fell_back").cast("double")).alias("fallback_rate"))
