"""Records of token probabilities: written, read, checked and matched as columns.

A record is a JSON text with what was asked, of which model and how, and the
three probabilities. Checks run in generated code; nothing is trusted because
its key is right.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.validation import require
from ..schema import ACTIONS, ContractError
from .prompts import LABELS, require_sha256

# Format and decoding names of the record contract.
FORMAT = "token-logit-v1"
METHOD = "candidate_normalized_exact_next_token_logits"
SCHEMA = ("cache_format_version string, key string, model_id string, model_revision string, prompt_version string, prompt_sha256 string, choice_tokens array<string>, "
          "decoding struct<method: string, logit_temperature: double, generation: boolean, configured_batch_size: int, dtype: string, final_position_logits_only: boolean, scorer_semantic_fingerprint: string>, "
          "schema struct<actions: array<string>, schema_valid: boolean>, probabilities map<string, double>, rationale string, fallback_reason string")


@dataclass(frozen=True)
class Request:
    """What every record of a policy must say."""

    model_id: str
    model_revision: str
    prompt_version: str
    choice_tokens: tuple[str, ...] = LABELS
    logit_temperature: float = 1.0
    batch_size: int = 32
    dtype: str = "bfloat16"
    fingerprint: str | None = None

    def __post_init__(self) -> None:
        if not self.model_id or not self.model_revision:
            raise ContractError("a request names a model and its revision")
        if len(set(self.choice_tokens)) != len(ACTIONS) or self.logit_temperature <= 0 or self.batch_size <= 0:
            raise ContractError("three distinct tokens, a positive temperature and batch size are needed")
        if self.fingerprint is not None:
            require_sha256(self.fingerprint, "fingerprint")

    def decoding(self) -> dict:
        """The part of a key that says how probabilities are read."""
        return {"method": METHOD, "logit_temperature": self.logit_temperature, "generation": False, "final_position_logits_only": True}


def record_text(request: Request, key: Column, prompt_sha256: Column, probabilities: Column, rationale: Column | None = None) -> Column:
    """The record of a scored prompt as one JSON text."""
    r = request
    decoding = F.struct(F.lit(METHOD).alias("method"), F.lit(float(r.logit_temperature)).alias("logit_temperature"), F.lit(False).alias("generation"), F.lit(r.batch_size).alias("configured_batch_size"),
                        F.lit(r.dtype).alias("dtype"), F.lit(True).alias("final_position_logits_only"), F.lit(r.fingerprint).cast("string").alias("scorer_semantic_fingerprint"))
    return F.to_json(F.struct(
        F.lit(FORMAT).alias("cache_format_version"), key.alias("key"), F.lit(r.model_id).alias("model_id"), F.lit(r.model_revision).alias("model_revision"), F.lit(r.prompt_version).alias("prompt_version"),
        prompt_sha256.alias("prompt_sha256"), F.array(*map(F.lit, r.choice_tokens)).alias("choice_tokens"), decoding.alias("decoding"),
        F.struct(F.array(*map(F.lit, ACTIONS)).alias("actions"), F.lit(True).alias("schema_valid")).alias("schema"),
        F.struct(*[probabilities[i].alias(a) for i, a in enumerate(ACTIONS)]).alias("probabilities"),
        (rationale if rationale is not None else F.lit("restricted-token probabilities; no prose was generated")).alias("rationale")))


def parsed(text: Column) -> Column:
    """A record read back; null where the text is no JSON object of these fields."""
    return F.from_json(text, SCHEMA)


def record_fault(r: Column) -> Column:
    """What is wrong with a parsed record, null if nothing; the first of several."""
    values = F.map_values(r["probabilities"])
    named = F.coalesce(F.array_sort(F.map_keys(r["probabilities"])) == F.array_sort(F.array(*map(F.lit, ACTIONS))), F.lit(False))
    fine = F.forall(values, lambda x: F.coalesce(~F.isnan(x) & (x >= 0) & (x < float("inf")), F.lit(False)))
    whole = F.abs(F.aggregate(values, F.lit(0.0), lambda a, x: a + x) - 1) <= 1e-8
    texts = F.lit(True)
    for name in ("key", "model_id", "model_revision", "prompt_version", "prompt_sha256", "rationale"):
        texts = texts & r[name].isNotNull()
    mark = r["decoding"]["scorer_semantic_fingerprint"]
    return (F.when(r.isNull() | F.coalesce(r["cache_format_version"], r["key"], r["model_id"]).isNull(), "not a record").when(~F.coalesce(r["cache_format_version"] == FORMAT, F.lit(False)), "format")
            .when(~F.coalesce(r["schema"]["actions"] == F.array(*map(F.lit, ACTIONS)), F.lit(False)), "actions").when(~named, "probability names")
            .when(~F.coalesce(fine & whole, F.lit(False)), "not a distribution").when(r["decoding"].isNull() | r["decoding"]["logit_temperature"].isNull(), "decoding")
            .when(~F.coalesce(F.forall(r["choice_tokens"], lambda x: x.isNotNull()) & (F.size(r["choice_tokens"]) > 0), F.lit(False)), "choice tokens").when(~texts, "text fields")
            .when(mark.isNotNull() & ~mark.rlike("^[0-9a-f]{64}$"), "fingerprint"))


def mismatch(r: Column, request: Request, prompt_sha256: Column) -> Column:
    """Why a parsed record may not answer a request, null if it may: other model, prompt, tokens, temperature or scorer, or no scored answer."""
    q = request
    same = lambda a, b: F.coalesce(a == F.lit(b), F.lit(False))
    tokens = F.coalesce(r["choice_tokens"] == F.array(*map(F.lit, q.choice_tokens)), F.lit(False))
    return (F.when(~same(r["model_id"], q.model_id) | ~same(r["model_revision"], q.model_revision), "model").when(~same(r["prompt_version"], q.prompt_version), "prompt version")
            .when(~F.coalesce(r["prompt_sha256"] == prompt_sha256, F.lit(False)), "prompt").when(~tokens, "choice tokens").when(~same(r["decoding"]["logit_temperature"], float(q.logit_temperature)), "temperature")
            .when(~r["decoding"]["scorer_semantic_fingerprint"].eqNullSafe(F.lit(q.fingerprint).cast("string")), "fingerprint")
            .when(~F.coalesce(r["schema"]["schema_valid"], F.lit(False)) | r["fallback_reason"].isNotNull(), "not scored by the model"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """key and record of a JSON-line cache, one row per key; a faulty line or two different records of a key raise."""
    rows = spark.read.text(path).filter("trim(value) <> ''").select("value", parsed(F.col("value")).alias("record"))
    rows = rows.withColumn("fault", record_fault(F.col("record")))
    require(rows, {"faulty record": F.col("fault").isNotNull()}, "cache")
    kinds = rows.groupBy(F.col("record.key").alias("key")).agg(F.countDistinct(F.to_json("record")).alias("kinds"), F.first("record").alias("record"))
    require(kinds, {"conflicting records of a key": F.col("kinds") > 1}, "cache")
    return kinds.select("key", "record")


def replay_records(keyed: DataFrame, records: DataFrame, request: Request) -> DataFrame:
    """``keyed`` (key, prompt_sha256) with ``target`` from the records; a missing record or one that says otherwise raises."""
    met = keyed.join(records, "key", "left")
    why = F.when(F.col("record").isNull(), "missing").otherwise(mismatch(F.col("record"), request, F.col("prompt_sha256")))
    checked = met.withColumn("_why", why)
    require(checked, {"no matching record": F.col("_why").isNotNull()}, "replay")
    return checked.withColumn("target", F.array(*[F.element_at("record.probabilities", a) for a in ACTIONS])).drop("_why", "record")


def request_of(values: Mapping) -> Request:
    names = {f.name for f in fields(Request)}
    if unknown := set(values) - names:
        raise ContractError(f"unknown settings: {', '.join(sorted(unknown))}")
    return Request(**{k: tuple(v) if isinstance(v, Sequence) and not isinstance(v, str) else v for k, v in values.items()})
