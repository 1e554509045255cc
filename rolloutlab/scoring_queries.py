"""Registered queries over prompts, keys, answers and records, each with its SQL. What is asked and answered is made of the event log."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .queries import user, TRAJ, query, split, steps
from .schema import ACTIONS, EPISODE, STEP, ContractError
from .scoring import prompts as P
from .scoring.cache import parsed_answers, runtime, with_keys
from .scoring.identity import Fingerprint, identity, identity_sha256
from .scoring.records import METHOD, Request, mismatch, parsed, record_fault, record_text
from .scoring.responses import label_scores

K = "CAST(patient_id AS BIGINT)"


# ---- notes -----------------------------------------------------------------------


@query("note_blocks", """WITH n AS (SELECT doc_id, nfc_normalize(text) AS t FROM documents) SELECT doc_id, CASE WHEN t IS NULL THEN 'none' WHEN length(t) > 4000 THEN 'refused' WHEN regexp_matches(t, '(?i)(?:BEGIN|END)_UNTRUSTED_HANDOFF_NOTE(?:_JSON_V1)?') THEN 'refused'
 WHEN regexp_matches(t, '<\\|[^|\\r\\n]{1,64}\\|>') THEN 'refused' ELSE 'shown' END AS state, CASE WHEN t IS NOT NULL AND length(t) <= 4000 THEN length(t) ELSE -1 END::BIGINT AS n_chars FROM n""")
def note_blocks(spark, sf_dir):
    """Every document as an untrusted note: shown between markers, refused or absent, and its length once normalised (-1 where it is too long or absent)."""

    @F.pandas_udf("struct<state: string, n_chars: long>")
    def of(notes: pd.Series) -> pd.DataFrame:
        out = []
        for note in notes:
            n = len(unicodedata.normalize("NFC", note)) if note is not None else None
            try:
                lines = P.note_block(note).split("\n")
                state = "none" if note is None else "shown" if len(lines) == 3 and lines[1].isascii() else "broken"
            except P.NoteError:
                state = "refused"
            out.append((state, n if n is not None and n <= P.NOTE_LIMIT else -1))
        return pd.DataFrame(out, columns=["state", "n_chars"])

    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", of("text").alias("x")).select("doc_id", "x.*")


# ---- prompts and keys ---------------------------------------------------------------


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps(spark, sf_dir).select(EPISODE, STEP, F.round("value").cast("int").alias("map_mm_hg"), F.when(user() % 3 == 0, F.concat(F.lit("step "), F.col(STEP), F.lit(' "quoted"'))).alias("note"), "target")


SYSTEM = P.choice_messages({"x": 1}, ["x"])[0]["content"]
CHOICES = ",".join(f'"{lab}":"{a}"' for lab, a in zip(P.LABELS, ACTIONS))
ASKED = f"""{TRAJ}, asked AS (SELECT patient_id, time_step, '{{"choices":{{{CHOICES}}},"observation":{{"map_mm_hg":' || CAST(round(value) AS INTEGER) || '}}}}' || chr(10) || CASE WHEN {K} % 3 = 0 THEN '{P.NOTE_BEGIN}' || chr(10)
 || '{{"encoding":"{P.NOTE_ENCODING}","text":' || to_json('step ' || time_step || ' "quoted"') || '}}' || chr(10) || '{P.NOTE_END}' ELSE '{P.PLAIN_BEGIN}' || chr(10) || '{P.MISSING_NOTE}' || chr(10) || '{P.PLAIN_END}' END AS prompt FROM traj),
told AS (SELECT *, '[{{"content":"{SYSTEM}","role":"system"}},{{"content":' || to_json(prompt) || ',"role":"user"}}]' AS messages FROM asked)"""


@query("choice_prompts", f"WITH {ASKED} SELECT patient_id, time_step, prompt, sha256(messages) AS prompt_sha256 FROM told")
def choice_prompts(spark, sf_dir):
    return with_keys(states(spark, sf_dir), ["map_mm_hg"], "m", "note").select(EPISODE, STEP, "prompt", "prompt_sha256")


@query("request_keys", f"WITH {ASKED} SELECT sha256('{{\"messages\":' || messages || ',\"model_id\":\"m\"}}') AS key, count(*)::BIGINT AS requests FROM told GROUP BY 1")
def request_keys(spark, sf_dir):
    """Requests by key: what is asked twice is scored once."""
    return with_keys(states(spark, sf_dir), ["map_mm_hg"], "m", "note").groupBy("key").agg(F.count("*").alias("requests"))


MARK = "ab" * 32
DECODING = f'{{"final_position_logits_only":true,"generation":false,"logit_temperature":1.0,"method":"{METHOD}"}}'


@query("record_keys", f"""WITH {ASKED} SELECT patient_id, time_step, sha256('{{"actions":["maintain","iv_fluids","escalate_vasopressor"],"choice_tokens":["A","B","C"],"decoding":{DECODING},"messages":' || messages || ',"model_id":"m","model_revision":"r1","prompt_version":"v1","scorer_semantic_fingerprint":"{MARK}"}}') AS key FROM told""")
def record_keys(spark, sf_dir):
    """Keys that a scorer's fingerprint, revision and decoding are part of."""
    r = Request("m", "r1", "v1", fingerprint=MARK)
    return with_keys(states(spark, sf_dir), ["map_mm_hg"], "m", "note", model_revision="r1", prompt_version="v1", choice_tokens=list(r.choice_tokens), decoding=r.decoding(), actions=list(ACTIONS),
                     scorer_semantic_fingerprint=MARK).select(EPISODE, STEP, "key")


@query("policy_prompts", f"""WITH {TRAJ}, v AS (SELECT DISTINCT CAST(round(value) AS INTEGER) AS m FROM traj) SELECT m AS map_mm_hg, '{{"actions":["maintain","iv_fluids","escalate_vasopressor"],"observation":{{"map_mm_hg":' || m || '}}}}' || chr(10)
 || '{P.PLAIN_BEGIN}' || chr(10) || '{P.MISSING_NOTE}' || chr(10) || '{P.PLAIN_END}' AS prompt FROM v""")
def policy_prompts(spark, sf_dir):
    """Prompts that ask for probabilities as JSON, one per distinct state."""

    @F.pandas_udf("string")
    def of(values: pd.Series) -> pd.Series:
        return pd.Series([P.policy_messages({"map_mm_hg": int(v)}, ["map_mm_hg"])[1]["content"] for v in values])

    return states(spark, sf_dir).select("map_mm_hg").distinct().select("map_mm_hg", of("map_mm_hg").alias("prompt"))


FIELDS = [({"map_mm_hg": 1}, True), ({}, False), ({"map_mm_hg": 1, "age": 2}, False), ({"age": 1}, False)]


@query("payload_fields", "SELECT * FROM (VALUES " + ", ".join(f"({i}, {str(ok).lower()})" for i, (_, ok) in enumerate(FIELDS)) + ") t(state, accepted)")
def payload_fields(spark, sf_dir):
    out = []
    for i, (state, _) in enumerate(FIELDS):
        try:
            P.observation(state, ["map_mm_hg"])
            out.append((i, True))
        except ContractError:
            out.append((i, False))
    return spark.createDataFrame(out, "state int, accepted boolean")


BLOCKS = [P.candidate_block(o).replace("\n", "' || chr(10) || '") for o in P.cyclic_orders()]


@query("cyclic_prompts", f"""WITH {TRAJ}, c AS (SELECT patient_id, time_step, 'State ' || time_step || chr(10) || '{BLOCKS[0]}' AS content FROM traj), r AS (SELECT patient_id, time_step, unnest([0, 1, 2]) AS turn,
 unnest([content, replace(content, '{BLOCKS[0]}', '{BLOCKS[1]}'), replace(content, '{BLOCKS[0]}', '{BLOCKS[2]}')]) AS content FROM c) SELECT patient_id, time_step, turn, content FROM r""")
def cyclic_prompts(spark, sf_dir):
    """Every prompt under the three rotations of its labels."""
    content = F.concat(F.lit("State "), F.col(STEP), F.lit("\n" + P.candidate_block()))
    turns = F.explode(F.array(*[F.struct(F.lit(t).alias("turn"), P.rotated(content, t).alias("content")) for t in range(3)]))
    return steps(spark, sf_dir).select(EPISODE, STEP, turns.alias("x")).select(EPISODE, STEP, "x.*")


@query("candidate_blocks", f"WITH {TRAJ} SELECT patient_id, time_step, CASE {K} % 4 WHEN 1 THEN 'no candidate block' WHEN 2 THEN 'several candidate blocks' WHEN 3 THEN 'empty' END AS fault FROM traj")
def candidate_blocks(spark, sf_dir):
    block = P.candidate_block()
    content = F.when(user() % 4 == 1, "State").when(user() % 4 == 2, f"{block}\n{block}").when(user() % 4 == 3, "").otherwise(f"State\n{block}")
    return steps(spark, sf_dir).select(EPISODE, STEP, P.block_fault(content).alias("fault"))


# ---- answers ---------------------------------------------------------------------------


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON answers, five of six malformed in some way; the probabilities are whole numbers."""
    k = user() % 8
    whole = [F.round(F.col("target")[i] * 1000).cast("int") + 1 for i in range(3)]
    body = lambda a, b, c, more="", why="because": F.concat(F.lit('{"probabilities":{"maintain":'), a, F.lit(',"iv_fluids":'), b, F.lit(',"escalate_vasopressor":'), c, F.lit('},"rationale":"' + why + '"' + more + "}"))
    raw = (F.when(k == 1, F.lit("not json")).when(k == 2, body(*whole, more=',"x":1')).when(k == 3, F.concat(F.lit('{"probabilities":{"maintain":'), whole[0], F.lit('},"rationale":"r"}')))
           .when(k == 4, body(*whole, why="y" * 401)).when(k == 5, body(F.lit(-1), whole[1], whole[2])).when(k == 6, body(F.lit(0), F.lit(0), F.lit(0))).otherwise(body(*whole)))
    return steps(spark, sf_dir).select(EPISODE, STEP, raw.alias("raw"))


ANSWERED = f"{TRAJ}, w AS (SELECT patient_id, time_step, {K} % 8 BETWEEN 1 AND 6 AS bad, {', '.join(f'CAST(round(p{i} * 1000) AS INTEGER) + 1 AS w{i}' for i in range(3))} FROM traj)"


@query("parsed_answers", f"WITH {ANSWERED} SELECT patient_id, time_step, bad AS fell_back, {', '.join(f'round(CASE WHEN bad THEN {f} ELSE CAST(w{i} AS DOUBLE) / (w0 + w1 + w2) END, 6) AS p{i}' for i, f in enumerate((0.8, 0.15, 0.05)))} FROM w")
def parsed_answer_rows(spark, sf_dir):
    return parsed_answers(answers(spark, sf_dir), "raw").select(EPISODE, STEP, "fell_back", *split("target", "p"))


@query("policy_runtime", f"WITH {ANSWERED} SELECT time_step, count(*)::BIGINT AS requests, sum(CASE WHEN bad THEN 1 ELSE 0 END)::BIGINT AS fallbacks, round(avg(CASE WHEN bad THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS fallback_rate FROM w GROUP BY 1")
def policy_runtime(spark, sf_dir):
    """Requests and fallbacks of a run, by step."""
    return runtime(parsed_answers(answers(spark, sf_dir), "raw"), [STEP])


IDS = (11, 7, 42)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A completion server's answers, most faulty in some way; probabilities in thousandths."""
    k = user() % 11
    a, b = (F.round(F.col("target")[i] * 1000).cast("int") for i in (0, 1))
    c = F.lit(1000) - a - b
    text = lambda x: F.format_string("%.3f", x / F.lit(1000.0))
    entry = lambda i, x: F.concat(F.lit(f'{{"id":{i},"prob":'), text(x), F.lit("}"))
    top = F.concat(entry(7, b), F.lit(","), F.when(k == 5, entry(9, a)).otherwise(entry(11, F.when(k == 6, a + 200).otherwise(a))), F.lit(","), F.when(k == 7, entry(42, -c - 1)).otherwise(entry(42, c)))
    steps_ = F.concat(F.lit('[{"top_probs":['), top, F.lit("]}]"))
    field = F.when(k == 9, F.lit("top_logprobs")).when(k == 10, F.lit("probs")).otherwise(F.lit("completion_probabilities"))
    made = F.concat(F.lit('{"truncated":'), F.when(k == 2, "true").otherwise("false"), F.lit(',"tokens":['), F.when(k == 3, "99").when(k == 8, "11,7").otherwise("11"), F.lit('],"content":"'), F.when(k == 4, "B").otherwise("A"), F.lit('","'), field, F.lit('":'), steps_, F.lit("}"))
    return steps(spark, sf_dir).select(EPISODE, STEP, F.when(k == 1, F.lit("no json")).otherwise(made).alias("response"))


@query("label_scores", f"""WITH {TRAJ}, w AS (SELECT patient_id, time_step, {K} % 11 AS k, CAST(round(p0 * 1000) AS INTEGER) AS a, CAST(round(p1 * 1000) AS INTEGER) AS b FROM traj)
SELECT patient_id, time_step, CASE k WHEN 1 THEN 'not an answer' WHEN 2 THEN 'truncated' WHEN 3 THEN 'token' WHEN 4 THEN 'text' WHEN 5 THEN 'token ids' WHEN 6 THEN CASE WHEN a + 200 > 1000 THEN 'probability' ELSE 'not the whole mass' END WHEN 7 THEN 'probability' WHEN 8 THEN 'token' WHEN 9 THEN 'probability field' END AS fault,
 CASE WHEN k IN (0, 10) THEN round(a / CAST(1000 AS DOUBLE), 6) END AS s0, CASE WHEN k IN (0, 10) THEN round(b / CAST(1000 AS DOUBLE), 6) END AS s1, CASE WHEN k IN (0, 10) THEN round((1000 - a - b) / CAST(1000 AS DOUBLE), 6) END AS s2 FROM w""")
def label_score_rows(spark, sf_dir):
    out = responses(spark, sf_dir).select(EPISODE, STEP, label_scores(F.col("response"), IDS).alias("x"))
    return out.select(EPISODE, STEP, "x.fault", *[F.col("x.scores")[i].alias(f"s{i}") for i in range(3)])


# ---- records ------------------------------------------------------------------------------

REQUEST = Request("m", "r1", "v1", fingerprint=MARK)


def record_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = user() % 12
    prompt = F.sha2(F.concat(F.lit("prompt "), F.col(EPISODE)), 256)
    text = record_text(REQUEST, F.sha2(F.concat(F.lit("key "), F.col(EPISODE), F.col(STEP)), 256), prompt, F.col("target"))
    swap = lambda old, new: F.replace(text, F.lit(old), F.lit(new))
    odd = (F.when(k == 1, swap('"token-logit-v1"', '"token-logit-v0"')).when(k == 2, swap('"maintain":', '"rest":')).when(k == 3, swap('"iv_fluids":', '"iv_fluids":9')).when(k == 4, swap('["maintain","iv_fluids","escalate_vasopressor"]', '["maintain"]'))
           .when(k == 5, F.lit("[")).when(k == 6, swap('"model_id":"m"', '"model_id":null')).when(k == 7, swap(MARK, "xyz")).when(k == 8, swap('"model_revision":"r1"', '"model_revision":"r2"'))
           .when(k == 9, swap('"schema_valid":true', '"schema_valid":false')).when(k == 10, swap('"logit_temperature":1.0', '"logit_temperature":2.0')).otherwise(text))
    asked = F.when(k == 11, F.sha2(F.lit("another"), 256)).otherwise(prompt)
    return steps(spark, sf_dir).select(EPISODE, STEP, odd.alias("text"), asked.alias("asked")).withColumn("record", parsed(F.col("text")))


@query("token_records", f"""WITH {TRAJ}, x AS (SELECT patient_id, time_step, {K} % 12 AS k, p0 FROM traj) SELECT patient_id, time_step, CASE k WHEN 1 THEN 'format' WHEN 2 THEN 'probability names' WHEN 3 THEN 'not a distribution' WHEN 4 THEN 'actions' WHEN 5 THEN 'not a record' WHEN 6 THEN 'text fields' WHEN 7 THEN 'fingerprint' END AS fault,
 CASE k WHEN 8 THEN 'model' WHEN 9 THEN 'not scored by the model' WHEN 10 THEN 'temperature' WHEN 11 THEN 'prompt' END AS mismatch, round(CASE WHEN k NOT BETWEEN 1 AND 7 THEN p0 END, 6) AS p0 FROM x""")
def token_records(spark, sf_dir):
    """Records of token probabilities, written, read back, checked and held against what is asked."""
    fault = record_fault(F.col("record"))
    rows = record_rows(spark, sf_dir).withColumn("fault", fault)
    fine = F.col("fault").isNull()
    return rows.select(EPISODE, STEP, "fault", F.when(fine, mismatch(F.col("record"), REQUEST, F.col("asked"))).alias("mismatch"), F.when(fine, F.element_at("record.probabilities", ACTIONS[0])).alias("p0"))


SERVED = Fingerprint("b1-abc", "abc", "repo", "rev", "model.gguf", "cd" * 32, "q4", "ef" * 32, IDS)


@query("scorer_identity", f"SELECT sha256('{P.canonical(identity(SERVED))}') AS sha256")
def scorer_identity(spark, sf_dir):
    return spark.createDataFrame([(identity_sha256(SERVED),)], "sha256 string")

