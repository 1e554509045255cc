"""Registered queries over the event log, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import expressions as X
from .operators import diagnostics as D
from .operators.digests import block_digest, line_digest
from .operators import fqe as Q
from .operators import gates as G
from .operators import inference as I
from .operators import sdr as S
from .operators import support as U
from .plans import roles as R
from .plans import validation as V
from .scoring.prompts import note_faults
from .schema import ACTION, ACTIONS, EPISODE, STEP
from .sources.files import settled
from .sources.events import HORIZON, LATER, action_name, event_trajectories, smoothed_behavior

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
CAPS = (2.0, 10.0, 50.0)

# ---- the same inputs in SQL --------------------------------------------------

TRAJ = f"""numbered AS (
  SELECT user_id, row_number() OVER w - 1 AS n, count(*) OVER (PARTITION BY user_id) AS total, value,
    CASE WHEN event_type IN ('view','signup') THEN 0 WHEN event_type IN ('click','purchase') THEN 1 ELSE 2 END AS action_no,
    lag(CASE WHEN event_type IN ('view','signup') THEN 0 WHEN event_type IN ('click','purchase') THEN 1 ELSE 2 END) OVER w AS before_no,
    lead(value) OVER w - value AS dvalue, CASE WHEN lead(event_type) OVER w = 'error' THEN 1 ELSE 0 END AS is_error
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
logits AS (
  SELECT CAST(user_id + {LATER} * (n // {HORIZON}) AS VARCHAR) AS patient_id, CAST(n % {HORIZON} AS INTEGER) AS time_step, value, action_no, CASE WHEN n % {HORIZON} = 0 THEN 0 ELSE before_no END AS previous_no, dvalue, is_error,
    CAST(0.5 AS DOUBLE) AS l0, (70 - value) / 150 AS l1, (value - 30) / 100 AS l2, 0.45 * tanh(dvalue / 50) - CAST(0.9 AS DOUBLE) * is_error AS reward,
    CASE WHEN n % {HORIZON} = {HORIZON - 1} OR n = total - 2 THEN 1 ELSE 0 END AS terminal
  FROM numbered WHERE n < total - 1),
grown AS (SELECT *, exp(l0 - greatest(l0, l1, l2)) AS e0, exp(l1 - greatest(l0, l1, l2)) AS e1, exp(l2 - greatest(l0, l1, l2)) AS e2 FROM logits),
traj AS (
  SELECT patient_id, time_step, value, action_no, previous_no, dvalue, is_error, reward, terminal,
    e0 / (e0 + e1 + e2) AS p0, e1 / (e0 + e1 + e2) AS p1, e2 / (e0 + e1 + e2) AS p2 FROM grown)"""
PROP = TRAJ + """,
counts AS (SELECT previous_no, count(*) + 3.0 AS n, sum(CASE WHEN action_no = 0 THEN 1 ELSE 0 END) + 1.0 AS c0, sum(CASE WHEN action_no = 1 THEN 1 ELSE 0 END) + 1.0 AS c1,
  sum(CASE WHEN action_no = 2 THEN 1 ELSE 0 END) + 1.0 AS c2 FROM traj GROUP BY 1),
prop AS (
  SELECT t.*, CAST(c0 AS DOUBLE) / n AS b0, CAST(c1 AS DOUBLE) / n AS b1, CAST(c2 AS DOUBLE) / n AS b2,
    CASE action_no WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END AS pa, CAST(CASE action_no WHEN 0 THEN c0 WHEN 1 THEN c1 ELSE c2 END AS DOUBLE) / n AS ba
  FROM traj t JOIN counts c USING (previous_no))"""
#: Three folds of episodes, each, the longest first, to the fold with the fewest rows.
FOLDED = TRAJ + """,
ids AS MATERIALIZED (SELECT patient_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, patient_id) AS r FROM traj GROUP BY 1),
dealt AS (SELECT 0::BIGINT AS r, 0::BIGINT AS a, 0::BIGINT AS b, 0::BIGINT AS c, -1 AS fold UNION ALL
 SELECT i.r, CASE WHEN f = 0 THEN a + n ELSE a END, CASE WHEN f = 1 THEN b + n ELSE b END, CASE WHEN f = 2 THEN c + n ELSE c END, f
 FROM (SELECT *, CASE WHEN a <= b AND a <= c THEN 0 WHEN b <= c THEN 1 ELSE 2 END AS f FROM dealt) h JOIN ids i ON i.r = h.r + 1),
folds AS MATERIALIZED (SELECT patient_id, CAST(fold AS INTEGER) AS fold FROM dealt JOIN ids USING (r))"""
WEIGHTED = PROP + """,
lw AS (SELECT *, sum(ln(pa) - ln(ba)) OVER (PARTITION BY patient_id ORDER BY time_step ROWS UNBOUNDED PRECEDING) AS log_w FROM prop)"""
#: Q of an action at a step: mean reward of that action at that step; V its mean under the target.
CELLS = WEIGHTED + """,
cell AS (SELECT time_step, avg(CASE WHEN action_no = 0 THEN reward END) AS q0, avg(CASE WHEN action_no = 1 THEN reward END) AS q1, avg(CASE WHEN action_no = 2 THEN reward END) AS q2
  FROM traj GROUP BY 1),
qv AS (SELECT l.*, q0, q1, q2, CASE action_no WHEN 0 THEN q0 WHEN 1 THEN q1 ELSE q2 END AS q, p0*q0 + p1*q1 + p2*q2 AS v FROM lw l JOIN cell USING (time_step)),
dr AS (SELECT *, coalesce(lead(v) OVER (PARTITION BY patient_id ORDER BY time_step), 0) AS v_next FROM qv),
episode AS (SELECT patient_id, max(CASE WHEN time_step = 0 THEN v END) AS v0,
  max(CASE WHEN time_step = 0 THEN v END) + sum(exp(log_w) * (reward + CASE WHEN terminal = 1 THEN 0 ELSE v_next END - q)) AS raw,
  max(CASE WHEN time_step = 0 THEN v END) + sum(exp(least(log_w, ln(CAST(2 AS DOUBLE)))) * (reward + CASE WHEN terminal = 1 THEN 0 ELSE v_next END - q)) AS value_cap_2,
  max(CASE WHEN time_step = 0 THEN v END) + sum(exp(least(log_w, ln(CAST(10 AS DOUBLE)))) * (reward + CASE WHEN terminal = 1 THEN 0 ELSE v_next END - q)) AS value_cap_10,
  max(CASE WHEN time_step = 0 THEN v END) + sum(exp(least(log_w, ln(CAST(50 AS DOUBLE)))) * (reward + CASE WHEN terminal = 1 THEN 0 ELSE v_next END - q)) AS value_cap_50,
  sum(reward) AS factual FROM dr GROUP BY 1)"""


def query(name: str, sql: str | None, places: int | None = 6) -> Callable[[Query], Query]:
    """Registers a query; doubles are rounded, in the SQL by hand."""

    def register(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(spark, sf_dir)
            return out.select(*[F.round(c, places).alias(c) if places is not None and t == "double" else F.col(c) for c, t in out.dtypes])

        run.__name__ = name
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return register


def user() -> Column:
    """The user number of an episode; faults are planted by it."""
    return F.col(EPISODE).cast("long")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_trajectories(spark, sf_dir)


def with_behavior(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = smoothed_behavior(steps(spark, sf_dir))
    no = F.col("action_no")
    return out.withColumns({"target_logged": X.gather(F.col("target"), no), "behavior_logged": X.gather(F.col("behavior"), no)})


def with_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = with_behavior(spark, sf_dir)
    cells = base.groupBy(STEP).agg(*[F.avg(F.when(F.col("action_no") == i, F.col("reward"))).alias(f"q{i}") for i in range(3)])
    cells = cells.select(F.col(STEP).alias("_t"), F.array("q0", "q1", "q2").alias("q"))
    met = base.join(F.broadcast(cells), base[STEP] == cells["_t"]).drop("_t")  # one row a step
    met = met.withColumns({"q_logged": X.gather(F.col("q"), F.col("action_no")), "v": X.expectation(F.col("target"), F.col("q"))})
    return S.next_values(met, "v")


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_cells(spark, sf_dir)
    values = S.sequential_dr(rows, CAPS, check=False)[1]
    more = rows.groupBy(EPISODE).agg(F.max(F.when(F.col(STEP) == 0, F.col("v"))).alias("v0"), F.sum("reward").alias("factual"))
    return values.join(more, EPISODE)


def split(column: str, names: str) -> list[Column]:
    return [F.col(column)[i].alias(f"{names}{i}") for i in range(3)]


# ---- trajectories, validation, roles ----------------------------------------


@query("traj_projection", f"WITH {TRAJ} SELECT patient_id, time_step, round(value, 6) AS value, action_no, previous_no, round(dvalue, 6) AS dvalue, is_error, terminal FROM traj")
def traj_projection(spark, sf_dir):
    return steps(spark, sf_dir).select(EPISODE, STEP, "value", "action_no", "previous_no", "dvalue", "is_error", "terminal")


@query("traj_validate", f"""WITH {TRAJ}, marked AS (SELECT *, row_number() OVER w - 1 AS place, lead(1) OVER w AS ahead, lag(action_no) OVER w AS before FROM traj WINDOW w AS (PARTITION BY patient_id ORDER BY time_step))
SELECT coalesce(sum(CASE WHEN time_step <> place THEN 1 ELSE 0 END), 0)::BIGINT AS not_consecutive, coalesce(sum(CASE WHEN (terminal = 1) <> (ahead IS NULL) THEN 1 ELSE 0 END), 0)::BIGINT AS bad_terminal,
 coalesce(sum(CASE WHEN before IS NOT NULL AND before <> previous_no THEN 1 ELSE 0 END), 0)::BIGINT AS bad_history, coalesce(sum(CASE WHEN ahead IS NULL AND place <> 11 THEN 1 ELSE 0 END), 0)::BIGINT AS bad_length,
 count(*)::BIGINT AS rows FROM marked""")
def traj_validate(spark, sf_dir):
    rows = steps(spark, sf_dir).withColumn(ACTION, action_name()).withColumn("previous_action", F.element_at(F.array(*[F.lit(a) for a in ACTIONS]), F.col("previous_no") + 1))
    checks = V.trajectory_checks(rows, HORIZON)
    wanted = {"not_consecutive": "steps not consecutive from 0", "bad_terminal": "terminal not on the last step alone", "bad_history": "previous action not the one before", "bad_length": "episode of another length"}
    return V.count_faults(V.marked_trajectory(rows), {n: checks[c] for n, c in wanted.items()} | {"rows": F.lit(True)})


ROLES_SQL = f"""{TRAJ}, ids AS (SELECT DISTINCT patient_id FROM traj), ranked AS (SELECT patient_id, row_number() OVER (ORDER BY sha256('41:' || patient_id), patient_id) AS r, count(*) OVER () AS n FROM ids),
roles AS (SELECT patient_id, CASE WHEN r <= least(n - 1, greatest(1, CAST(round_even(n * CAST(0.6 AS DOUBLE), 0) AS BIGINT))) THEN 'policy_development' ELSE 'ope_nuisance' END AS role FROM ranked)"""


@query("role_split", f"WITH {ROLES_SQL} SELECT patient_id, role FROM roles")
def role_split(spark, sf_dir):
    return R.training_roles(steps(spark, sf_dir), 0.6, 41)


@query("role_manifest", f"""WITH {ROLES_SQL} SELECT sum(CASE WHEN role = 'policy_development' THEN 1 ELSE 0 END)::BIGINT AS development, sum(CASE WHEN role = 'ope_nuisance' THEN 1 ELSE 0 END)::BIGINT AS nuisance,
 sha256(string_agg(patient_id || ',' || role, chr(10) ORDER BY patient_id || ',' || role)) AS checksum FROM roles""")
def role_manifest(spark, sf_dir):
    return R.manifest(R.training_roles(steps(spark, sf_dir), 0.6, 41))


@query("group_folds", """WITH RECURSIVE ids AS (SELECT CAST(user_id AS VARCHAR) AS patient_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, CAST(user_id AS VARCHAR)) AS r FROM events GROUP BY 1),
g AS (SELECT 0::BIGINT AS r, 0::BIGINT AS a, 0::BIGINT AS b, 0::BIGINT AS c, -1 AS fold UNION ALL
 SELECT i.r, CASE WHEN f = 0 THEN a + n ELSE a END, CASE WHEN f = 1 THEN b + n ELSE b END, CASE WHEN f = 2 THEN c + n ELSE c END, f
 FROM (SELECT *, CASE WHEN a <= b AND a <= c THEN 0 WHEN b <= c THEN 1 ELSE 2 END AS f FROM g) h JOIN ids i ON i.r = h.r + 1)
SELECT patient_id, CAST(fold AS INTEGER) AS fold FROM g JOIN ids USING (r)""")
def group_folds(spark, sf_dir):
    """All events of every user: episodes of 45 to 99 steps."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("string").alias(EPISODE))
    return R.folds(events, 3)


@query("development_rows", f"WITH {ROLES_SQL} SELECT patient_id, time_step, action_no FROM traj SEMI JOIN (SELECT * FROM roles WHERE role = 'policy_development') USING (patient_id)")
def development_rows(spark, sf_dir):
    rows = steps(spark, sf_dir)
    picked = R.training_roles(rows, 0.6, 41).filter(F.col("role") == R.DEVELOPMENT)
    return rows.join(picked, EPISODE, "left_semi").select(EPISODE, STEP, "action_no")


@query("id_checksum", f"WITH {TRAJ}, ids AS (SELECT DISTINCT patient_id FROM traj) SELECT sha256(string_agg(patient_id, chr(10) ORDER BY patient_id)) AS checksum FROM ids")
def id_checksum(spark, sf_dir):
    return R.checksum(steps(spark, sf_dir))


@query("row_key_digest", f"WITH {TRAJ} SELECT sha256(string_agg('[\"' || patient_id || '\",' || time_step || ']' || chr(10), '' ORDER BY patient_id, time_step)) AS digest, count(*)::BIGINT AS rows FROM traj")
def row_key_digest(spark, sf_dir):
    return line_digest(steps(spark, sf_dir), [EPISODE, STEP], key_line(), "")


def key_line() -> Column:
    return F.concat(F.lit('["'), EPISODE, F.lit('",'), STEP, F.lit("]\n"))


@query("row_key_blocks", f"""WITH {TRAJ}, n AS (SELECT patient_id, time_step, (row_number() OVER (ORDER BY patient_id, time_step) - 1) // 500 AS block FROM traj),
b AS (SELECT block, count(*) AS n, sha256(string_agg('[\"' || patient_id || '\",' || time_step || ']' || chr(10), '' ORDER BY patient_id, time_step)) AS d FROM n GROUP BY 1)
SELECT sha256(string_agg(d, '' ORDER BY block)) AS digest, sum(n)::BIGINT AS rows FROM b""")
def row_key_blocks(spark, sf_dir):
    """The digest for tables of any size: of the digests of 500 lines each."""
    return block_digest(steps(spark, sf_dir), [EPISODE, STEP], key_line(), 500)


# ---- rewards and policies -----------------------------------------------------


@query("reward_by_action", f"WITH {TRAJ} SELECT action_no, count(*)::BIGINT AS rows, round(avg(reward), 6) AS mean_reward, round(avg(dvalue), 6) AS mean_dvalue, round(avg(is_error), 6) AS error_rate FROM traj GROUP BY 1")
def reward_by_action(spark, sf_dir):
    return steps(spark, sf_dir).groupBy("action_no").agg(F.count("*").alias("rows"), F.avg("reward").alias("mean_reward"), F.avg("dvalue").alias("mean_dvalue"), F.avg("is_error").alias("error_rate"))


def clinical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log under the names of a trajectory, so that the reward operators apply as they are."""
    return steps(spark, sf_dir).select(
        EPISODE, STEP, action_name().alias(ACTION), F.col("value").alias("map_mm_hg"), (F.col("dvalue") / 10).alias("next_6h_map_delta"), (F.col("dvalue") / 100).alias("next_6h_lactate_delta"),
        F.col("is_error").alias("next_6h_deterioration"), F.when(F.col("dvalue") < -60, 1).otherwise(0).alias("adverse_hypotension_next_6h"),
        F.when(F.col("dvalue") > 60, 1).otherwise(0).alias("adverse_fluid_overload_next_6h"), F.when(F.col("action_no") == 2, F.col("is_error")).otherwise(0).alias("adverse_tachyarrhythmia_next_6h"))


CLINICAL = TRAJ + """, parts AS (SELECT patient_id, time_step, value, action_no, is_error, CASE WHEN action_no = 2 THEN is_error ELSE 0 END AS tachy,
 0.45 * tanh(dvalue / 10 / 5) AS map_component, -0.25 * tanh(dvalue / 100 / 1) AS lactate_component, is_error * CAST(-0.9 AS DOUBLE) AS deterioration_component,
 CASE WHEN dvalue < -60 THEN CAST(-0.8 AS DOUBLE) ELSE 0 END AS hypotension_component, CASE WHEN dvalue > 60 THEN CAST(-0.7 AS DOUBLE) ELSE 0 END AS overload_component,
 CASE WHEN action_no = 2 THEN is_error ELSE 0 END * CAST(-0.7 AS DOUBLE) AS tachyarrhythmia_component FROM traj),
clin AS (SELECT *, map_component + lactate_component + deterioration_component + hypotension_component + overload_component + tachyarrhythmia_component AS total_reward FROM parts)"""
PARTS = ["map_component", "lactate_component", "deterioration_component", "hypotension_component", "overload_component", "tachyarrhythmia_component", "total_reward"]


@query("reward_components", f"WITH {CLINICAL} SELECT patient_id, time_step, {', '.join(f'round({c}, 6) + 0 AS {c}' for c in PARTS)} FROM clin")
def reward_components(spark, sf_dir):
    out = D.reward_components(clinical(spark, sf_dir), X.PRIMARY, [EPISODE, STEP])
    return out.select(EPISODE, STEP, *[(F.round(c, 6) + 0.0).alias(c) for c in PARTS])


@query("reward_shortcut", f"""WITH {CLINICAL}, sliced AS (SELECT 'all_rows' AS slice, * FROM clin UNION ALL SELECT 'map_above_75', * FROM clin WHERE value > 75),
g AS (SELECT slice, count(*)::BIGINT AS rows, {', '.join(f"avg(CASE WHEN action_no = 2 THEN {c} END) - avg(CASE WHEN action_no = 0 THEN {c} END) AS {n}_gap" for c, n in (('total_reward', 'reward'), ('map_component', 'map_part'), ('is_error', 'deterioration'), ('tachy', 'tachyarrhythmia')))} FROM sliced GROUP BY 1)
SELECT slice, rows, round(reward_gap, 6) AS reward_gap, round(map_part_gap, 6) AS map_part_gap, round(deterioration_gap, 6) AS deterioration_gap, round(tachyarrhythmia_gap, 6) AS tachyarrhythmia_gap, round(CASE WHEN abs(reward_gap) > 1e-8 THEN map_part_gap / reward_gap END, 6) AS map_share FROM g""")
def reward_shortcut(spark, sf_dir):
    return D.reward_shortcut(clinical(spark, sf_dir), X.PRIMARY)


@query("policy_softmax", f"WITH {TRAJ} SELECT patient_id, time_step, round(p0, 6) AS p0, round(p1, 6) AS p1, round(p2, 6) AS p2 FROM traj")
def policy_softmax(spark, sf_dir):
    return steps(spark, sf_dir).select(EPISODE, STEP, *split("target", "p"))


@query("propensity_laplace", f"WITH {PROP} SELECT DISTINCT previous_no, round(b0, 6) AS b0, round(b1, 6) AS b1, round(b2, 6) AS b2 FROM prop")
def propensity_laplace(spark, sf_dir):
    return with_behavior(spark, sf_dir).select("previous_no", *split("behavior", "b")).distinct()


@query("propensity_floor", f"""WITH {PROP}, f AS (SELECT patient_id, time_step, greatest(b0, 0.25) AS f0, greatest(b1, 0.25) AS f1, greatest(b2, 0.25) AS f2 FROM prop)
SELECT patient_id, time_step, round(f0/(f0+f1+f2), 6) AS b0, round(f1/(f0+f1+f2), 6) AS b1, round(f2/(f0+f1+f2), 6) AS b2 FROM f""")
def propensity_floor(spark, sf_dir):
    return with_behavior(spark, sf_dir).select(EPISODE, STEP, X.floored(F.col("behavior"), 0.25).alias("f")).select(EPISODE, STEP, *split("f", "b"))


Q_SQL = PROP + ", act AS (SELECT *, value / 100 AS v0, value / 80 - 0.3 AS v1, 0.9 - value / 120 AS v2 FROM prop)"


def valued(df: DataFrame) -> DataFrame:
    value = F.col("value")
    return df.withColumn("values", F.array(value / 100, value / 80 - 0.3, F.lit(0.9) - value / 120))


def with_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valued(with_behavior(spark, sf_dir))


@query("centered_advantage", f"WITH {Q_SQL} SELECT patient_id, time_step, {', '.join(f'round(v{i} - (p0*v0 + p1*v1 + p2*v2), 6) AS a{i}' for i in range(3))} FROM act")
def centered_advantage(spark, sf_dir):
    return valued(steps(spark, sf_dir)).select(EPISODE, STEP, X.centered(F.col("values"), F.col("target")).alias("a")).select(EPISODE, STEP, *split("a", "a"))


def rerank_sql(t: float, a: float, s: float, penalty: float) -> str:
    parts = []
    for i in range(3):
        x = f"ln(greatest(p{i}, 1e-12)) / CAST({t} AS DOUBLE) + CAST({a} AS DOUBLE) * least(greatest((v{i} - (p0*v0+p1*v1+p2*v2)) / CAST(0.75 AS DOUBLE), -2.0), 2.0) + CAST({s} AS DOUBLE) * ln(greatest(b{i}, 0.3))"
        parts.append(x + (f" - CAST({penalty} AS DOUBLE) * greatest(0.0, ln(CAST(0.3 AS DOUBLE)) - ln(greatest(b{i}, 1e-12)))" if penalty else ""))
    return ", ".join(f"{p} AS x{i}" for i, p in enumerate(parts))


@query("support_transform", f"""WITH {Q_SQL}, x AS (SELECT patient_id, time_step, {rerank_sql(2.0, 0.5, 1.0, 0.25)} FROM act), e AS (SELECT *, exp(x0 - greatest(x0, x1, x2)) AS e0, exp(x1 - greatest(x0, x1, x2)) AS e1, exp(x2 - greatest(x0, x1, x2)) AS e2 FROM x)
SELECT patient_id, time_step, {', '.join(f'round(e{i} / (e0 + e1 + e2), 6) AS p{i}' for i in range(3))} FROM e""")
def support_transform(spark, sf_dir):
    p = X.reranked(F.col("target"), F.col("values"), F.col("behavior"), temperature=2.0, advantage=0.5, anchor=1.0, scale=0.75, floor=0.3, penalty=0.25)
    return with_values(spark, sf_dir).select(EPISODE, STEP, p.alias("p")).select(EPISODE, STEP, *split("p", "p"))


@query("blend", f"WITH {PROP} SELECT patient_id, time_step, {', '.join(f'round(p{i} * 0.25 + b{i} * 0.75, 6) AS p{i}' for i in range(3))} FROM prop")
def blend(spark, sf_dir):
    return with_behavior(spark, sf_dir).select(EPISODE, STEP, X.blend(F.col("target"), F.col("behavior"), 0.25).alias("p")).select(EPISODE, STEP, *split("p", "p"))


@query("robust_scale", f"""WITH {Q_SQL}, a AS (SELECT unnest([v0 - (p0*v0+p1*v1+p2*v2), v1 - (p0*v0+p1*v1+p2*v2), v2 - (p0*v0+p1*v1+p2*v2)]) AS x FROM act), m AS (SELECT median(x) AS m, stddev_pop(x) AS sd FROM a),
d AS (SELECT 1.4826 * median(abs(x - m)) AS mad, max(sd) AS sd FROM a, m) SELECT round(greatest(CAST(0.05 AS DOUBLE), CASE WHEN mad < 0.05 THEN sd ELSE mad END), 6) AS scale FROM d""")
def robust_scale(spark, sf_dir):
    return D.robust_scale(valued(steps(spark, sf_dir)).select(X.centered(F.col("values"), F.col("target")).alias("a")), "a")


# ---- weights and estimates -----------------------------------------------------


@query("is_ratios", f"WITH {WEIGHTED} SELECT patient_id, time_step, round(pa / ba, 6) AS ratio, round(log_w, 6) AS log_w, round(least(log_w, ln(CAST(10 AS DOUBLE))), 6) AS log_w_cap_10 FROM lw")
def is_ratios(spark, sf_dir):
    return S.cumulative_weights(with_behavior(spark, sf_dir), (10.0,)).select(EPISODE, STEP, "ratio", "log_w", "log_w_cap_10")


@query("capped_is_by_step", f"""WITH {WEIGHTED}, top AS (SELECT time_step, max(log_w) AS m FROM lw GROUP BY 1)
SELECT time_step, round(avg(least(exp(log_w), 10) * reward), 6) AS mean_reward, round(sum(exp(log_w - m)) * sum(exp(log_w - m)) / sum(exp(log_w - m) * exp(log_w - m)), 6) AS ess, round(1 / sum(exp(log_w - m)), 6) AS max_share
FROM lw JOIN top USING (time_step) GROUP BY 1""")
def capped_is_by_step(spark, sf_dir):
    """Per step: capped importance-weighted reward, effective sample size and largest weight share."""
    rows = S.cumulative_weights(with_behavior(spark, sf_dir), (10.0,))
    means = rows.groupBy(STEP).agg(F.avg(X.safe_exp(F.col("log_w_cap_10")) * F.col("reward")).alias("mean_reward"))
    return means.join(U.concentration(rows, "log_w", [STEP]), STEP)


@query("sdr_episodes", f"WITH {CELLS} SELECT patient_id, round(raw, 6) AS raw, round(value_cap_2, 6) AS value_cap_2, round(value_cap_10, 6) AS value_cap_10, round(value_cap_50, 6) AS value_cap_50 FROM episode")
def sdr_episodes(spark, sf_dir):
    return S.sequential_dr(with_cells(spark, sf_dir), CAPS)[1]


@query("sdr_estimate", f"WITH {CELLS} SELECT count(*)::BIGINT AS episodes, round(avg(raw), 6) AS raw, round(avg(value_cap_10), 6) AS cap_10, round(avg(value_cap_10) / 12, 6) AS cap_10_per_decision, round(avg(v0), 6) AS direct FROM episode")
def sdr_estimate(spark, sf_dir):
    return episodes(spark, sf_dir).agg(F.count("*").alias("episodes"), F.avg("raw").alias("raw"), F.avg("value_cap_10").alias("cap_10"), (F.avg("value_cap_10") / HORIZON).alias("cap_10_per_decision"), F.avg("v0").alias("direct"))


@query("next_value", f"WITH {CELLS} SELECT patient_id, time_step, round(v, 6) AS v, round(v_next, 6) AS v_next, round(reward + CASE WHEN terminal = 1 THEN 0 ELSE 0.9 * v_next END, 6) AS bellman FROM dr")
def next_value(spark, sf_dir):
    return with_cells(spark, sf_dir).select(EPISODE, STEP, "v", "v_next", X.bellman(F.col("reward"), F.col("terminal"), F.col("v_next"), 0.9).alias("bellman"))


@query("weight_quantiles", f"WITH {WEIGHTED} SELECT time_step, 0::BIGINT AS overflow_count, {', '.join(f'round(quantile_cont(exp(log_w), {q}), 6) AS p{round(q * 100)}' for q in U.QUANTILES)}, round(max(exp(log_w)), 6) AS max FROM lw GROUP BY 1")
def weight_quantiles(spark, sf_dir):
    out = U.weight_summary(S.cumulative_weights(with_behavior(spark, sf_dir), (10.0,)), "log_w", [STEP])
    return out.select(STEP, "overflow_count", "p50", "p90", "p95", "p99", "max")


@query("ess_by_cap", f"""WITH {WEIGHTED}, c AS (SELECT time_step, cap, least(log_w, ln(cap)) AS l FROM lw, (SELECT unnest([2, 10, 50])::DOUBLE AS cap)), t AS (SELECT time_step, cap, max(l) AS m FROM c GROUP BY 1, 2)
SELECT time_step, cap, round(sum(exp(l - m)) * sum(exp(l - m)) / sum(exp(l - m) * exp(l - m)), 6) AS ess, round(1 / sum(exp(l - m)), 6) AS max_share FROM c JOIN t USING (time_step, cap) GROUP BY 1, 2""")
def ess_by_cap(spark, sf_dir):
    rows = S.cumulative_weights(with_behavior(spark, sf_dir), CAPS)
    out = None
    for c in CAPS:
        part = U.concentration(rows, f"log_w_{S.cap_name(c)}", [STEP]).withColumn("cap", F.lit(c))
        out = part if out is None else out.unionByName(part)
    return out


STATE = "avg(p0) AS target_maintain, avg(p1) AS target_iv_fluids, avg(p2) AS target_escalate_vasopressor, -avg(p0*ln(p0) + p1*ln(p1) + p2*ln(p2)) AS mean_entropy, avg(least(p0,b0) + least(p1,b1) + least(p2,b2)) AS mean_overlap, avg(p0*b0 + p1*b1 + p2*b2) AS mean_behavior_under_target, avg(CASE WHEN b0 < 0.3 THEN p0 ELSE 0 END + CASE WHEN b1 < 0.3 THEN p1 ELSE 0 END + CASE WHEN b2 < 0.3 THEN p2 ELSE 0 END) AS mass_below_0_3"
STATE_ROUND = ", ".join(f"round({c}, 6) AS {c}" for c in ("target_maintain", "target_iv_fluids", "target_escalate_vasopressor", "mean_entropy", "mean_overlap", "mean_behavior_under_target", "mass_below_0_3"))


@query("support_summary", f"WITH {PROP}, s AS (SELECT time_step, count(*)::BIGINT AS rows, {STATE} FROM prop GROUP BY 1) SELECT time_step, rows, {STATE_ROUND} FROM s")
def support_summary(spark, sf_dir):
    return U.state_support(with_behavior(spark, sf_dir), [STEP], thresholds=(0.3,))


@query("map_slice", f"WITH {PROP}, s AS (SELECT count(*)::BIGINT AS rows, {STATE}, count(*) / (SELECT count(*) FROM prop) AS fraction, count(DISTINCT patient_id)::BIGINT AS episodes FROM prop WHERE value < 65) SELECT rows, {STATE_ROUND}, round(fraction, 6) AS fraction, episodes FROM s")
def map_slice(spark, sf_dir):
    return U.slice_support(with_behavior(spark, sf_dir), F.col("value") < 65, thresholds=(0.3,))


@query("per_action_support", f"""WITH {PROP}, a AS (SELECT action_no, unnest([0,1,2]) AS no, unnest(['maintain','iv_fluids','escalate_vasopressor']) AS action, unnest([p0,p1,p2]) AS p, unnest([b0,b1,b2]) AS b FROM prop)
SELECT action, sum(CASE WHEN action_no = no THEN 1 ELSE 0 END)::BIGINT AS logged_rows, round(avg(p), 6) AS mean_target, round(avg(b), 6) AS mean_behavior, round(min(b), 6) AS min_behavior, round(avg(CASE WHEN b < 0.3 THEN 1 ELSE 0 END), 6) AS rare_fraction FROM a GROUP BY 1""")
def per_action_support(spark, sf_dir):
    return U.action_support(with_behavior(spark, sf_dir), threshold=0.3)


# ---- fitted Q evaluation ----------------------------------------------------------


def tabular_sql(name: str, cells: str, horizon: int = HORIZON) -> str:
    """The steps from the last to the first as tables of their own: Bellman targets y, cell means c, values s; then all values as ``name``."""
    means = ", ".join(f"avg(CASE WHEN action_no = {a} THEN y END) AS q{a}" for a in range(3))
    value = " + ".join(f"p{a} * coalesce(q{a}, 0)" for a in range(3))
    parts = []
    for t in range(horizon - 1, -1, -1):
        ahead = f"LEFT JOIN {name}_s{t + 1} n ON n.patient_id = r.patient_id" if t < horizon - 1 else ""
        follow = "CASE WHEN r.terminal = 1 THEN 0 ELSE coalesce(n.v, 0) END" if t < horizon - 1 else "0"
        parts += [f"{name}_y{t} AS MATERIALIZED (SELECT r.*, r.reward + {follow} AS y FROM cells r {ahead} WHERE r.time_step = {t})",
                  f"{name}_c{t} AS MATERIALIZED (SELECT {cells}, {means} FROM {name}_y{t} GROUP BY {cells})",
                  f"{name}_s{t} AS MATERIALIZED (SELECT y.patient_id, y.time_step, q0, q1, q2, {value} AS v FROM {name}_y{t} y JOIN {name}_c{t} USING ({cells}))"]
    return ",\n".join(parts) + f",\n{name} AS (" + " UNION ALL ".join(f"SELECT * FROM {name}_s{t}" for t in range(horizon)) + ")"


CELL_ROWS = f"WITH {TRAJ}, cells AS MATERIALIZED (SELECT *, CASE WHEN value >= 50 THEN 1 ELSE 0 END AS band FROM traj)"


@query("fqe_tabular", f"""{CELL_ROWS}, {tabular_sql("q", "previous_no")}
SELECT patient_id, time_step, round(q0, 6) AS q0, round(q1, 6) AS q1, round(q2, 6) AS q2, round(v, 6) AS v FROM q""")
def fqe_tabular(spark, sf_dir):
    return Q.tabular(Q.by_step(steps(spark, sf_dir)), ["previous_no"], "action_no", "reward", "target", HORIZON).select(EPISODE, STEP, *split("q", "q"), "v")


@query("cell_sensitivity", f"""{CELL_ROWS}, {tabular_sql("a", "previous_no")}, {tabular_sql("b", "previous_no, band")}
SELECT count(*)::BIGINT AS episodes, round(avg(a.v), 6) AS direct, round(avg(b.v), 6) AS direct_wide, round(avg(b.v - a.v), 6) AS mean_change, round(max(abs(b.v - a.v)), 6) AS max_change FROM a JOIN b USING (patient_id, time_step) WHERE time_step = 0""")
def cell_sensitivity(spark, sf_dir):
    """How the direct values change when the nuisance cells also tell low from high values."""
    rows = settled(steps(spark, sf_dir).withColumn("band", F.when(F.col("value") >= 50, 1).otherwise(0)))
    plain = Q.initial_values(Q.tabular(rows, ["previous_no"], "action_no", "reward", "target", HORIZON))
    wide = Q.initial_values(Q.tabular(rows, ["previous_no", "band"], "action_no", "reward", "target", HORIZON)).withColumnRenamed("direct", "wide")
    gap = F.col("wide") - F.col("direct")
    return plain.join(wide.hint("merge"), EPISODE).agg(F.count("*").alias("episodes"), F.avg("direct").alias("direct"), F.avg("wide").alias("direct_wide"), F.avg(gap).alias("mean_change"), F.max(F.abs(gap)).alias("max_change"))


def ridge_sql(horizon: int = HORIZON, alpha: float = 5.0) -> str:
    """The steps from the last to the first: Bellman targets y, centred products g and c, seven rounds of elimination m, weights w, values v."""
    parts = ["""rr AS MATERIALIZED (SELECT patient_id, time_step, reward, terminal, p0, p1, p2, b0, b1, b2, value / 100 AS x,
 list_concat([value / 100], [CASE WHEN action_no = a THEN 1.0 ELSE 0.0 END::DOUBLE FOR a IN [0, 1, 2]], [CASE WHEN action_no = a THEN value / 100 ELSE 0.0 END FOR a IN [0, 1, 2]]) AS f FROM prop)"""]
    for t in range(horizon - 1, -1, -1):
        ahead = f"LEFT JOIN v{t + 1} n ON n.patient_id = r.patient_id" if t < horizon - 1 else ""
        follow = {k: f"CASE WHEN r.terminal = 1 THEN 0 ELSE coalesce(n.v{k}, 0) END" if t < horizon - 1 else "0" for k in "tb"}
        parts.append(f"y{t} AS MATERIALIZED (SELECT r.*, r.reward + {follow['t']} AS yt, r.reward + {follow['b']} AS yb FROM rr r {ahead} WHERE r.time_step = {t})")
        parts.append(f"g{t} AS MATERIALIZED (SELECT i, j, sum(f[i] * f[j]) - count(*) * avg(f[i]) * avg(f[j]) + CASE WHEN i = j THEN {alpha} ELSE 0 END AS a FROM y{t}, range(1, 8) q(i), range(1, 8) s(j) GROUP BY i, j)")
        parts.append(f"c{t} AS MATERIALIZED (SELECT i, sum(f[i] * yt) - count(*) * avg(f[i]) * avg(yt) AS ct, sum(f[i] * yb) - count(*) * avg(f[i]) * avg(yb) AS cb, avg(f[i]) AS m, avg(yt) AS mt, avg(yb) AS mb FROM y{t}, range(1, 8) q(i) GROUP BY i)")
        parts.append(f"m{t}_0 AS MATERIALIZED (SELECT i, list_concat(list(a ORDER BY j), [max(ct), max(cb)]) AS r FROM g{t} JOIN c{t} USING (i) GROUP BY i)")
        parts += [f"m{t}_{k} AS MATERIALIZED (SELECT m.i, CASE WHEN m.i = {k} THEN [x / p.r[{k}] FOR x IN p.r] ELSE [m.r[j] - m.r[{k}] / p.r[{k}] * p.r[j] FOR j IN range(1, 10)] END AS r FROM m{t}_{k - 1} m, (SELECT r FROM m{t}_{k - 1} WHERE i = {k}) p)" for k in range(1, 8)]
        parts.append(f"w{t} AS MATERIALIZED (SELECT list(r[8] ORDER BY i) AS wt, list(r[9] ORDER BY i) AS wb, max(mt) - sum(m * r[8]) AS bt, max(mb) - sum(m * r[9]) AS bb FROM m{t}_7 JOIN c{t} USING (i))")
        value = {k: " + ".join(f"{k if k == 'b' else 'p'}{a} * (b{k} + w{k}[1] * x + w{k}[{2 + a}] + w{k}[{5 + a}] * x)" for a in range(3)) for k in "tb"}
        parts.append(f"v{t} AS MATERIALIZED (SELECT patient_id, time_step, {value['t']} AS vt, {value['b']} AS vb FROM y{t}, w{t})")
    every = " UNION ALL ".join(f"SELECT * FROM v{t}" for t in range(horizon))
    return f"WITH {PROP}, " + ",\n".join(parts) + f" SELECT time_step, count(*)::BIGINT AS rows, round(avg(vt), 6) AS v_target, round(avg(vb), 6) AS v_behavior FROM ({every}) GROUP BY 1"


@query("fqe_ridge", ridge_sql())
def fqe_ridge(spark, sf_dir):
    """Distributed ridge over state, action and their products, for two policies at once."""
    rows = with_behavior(spark, sf_dir).withColumn("features", F.array(F.col("value") / 100))
    out = Q.distributed_ridge(Q.by_step(rows), "features", "action_no", "reward", ["target", "behavior"], HORIZON)
    return out.groupBy(STEP).agg(F.count("*").alias("rows"), F.avg("v_target").alias("v_target"), F.avg("v_behavior").alias("v_behavior"))


# ---- calibration and diagnostics ------------------------------------------------


@query("calibration_left", f"""WITH {PROP}, c AS (SELECT time_step, greatest(p0,p1,p2) AS conf, CASE WHEN list_position([p0,p1,p2], greatest(p0,p1,p2)) - 1 = action_no THEN 1.0 ELSE 0.0 END AS hit, -ln(greatest(pa, 1e-15)) AS loss,
 (p0 - CASE WHEN action_no = 0 THEN 1 ELSE 0 END)^2 + (p1 - CASE WHEN action_no = 1 THEN 1 ELSE 0 END)^2 + (p2 - CASE WHEN action_no = 2 THEN 1 ELSE 0 END)^2 AS brier FROM prop),
b AS (SELECT time_step, least(floor(conf * 10), 9) AS bin, count(*) AS n, avg(conf) AS c, avg(hit) AS h FROM c GROUP BY 1, 2), e AS (SELECT time_step, sum(n * abs(h - c)) / sum(n) AS ece FROM b GROUP BY 1)
SELECT time_step, count(*)::BIGINT AS rows, round(avg(loss), 6) AS log_loss, round(avg(brier), 6) AS brier, round(CAST(avg(hit) AS DOUBLE), 6) AS accuracy, round(CAST(max(ece) AS DOUBLE), 6) AS ece FROM c JOIN e USING (time_step) GROUP BY 1""")
def calibration_left(spark, sf_dir):
    return D.calibration(with_behavior(spark, sf_dir), "target", "action_no", [STEP])


@query("ece_right", f"""WITH {PROP}, c AS (SELECT time_step, greatest(b0,b1,b2) AS conf, CASE WHEN list_position([b0,b1,b2], greatest(b0,b1,b2)) - 1 = action_no THEN 1.0 ELSE 0.0 END AS hit FROM prop),
b AS (SELECT time_step, greatest(ceil(conf * 10) - 1, 0) AS bin, count(*) AS n, avg(conf) AS c, avg(hit) AS h FROM c GROUP BY 1, 2) SELECT time_step, round(CAST(sum(n * abs(h - c)) / sum(n) AS DOUBLE), 6) AS ece FROM b GROUP BY 1""")
def ece_right(spark, sf_dir):
    return D.calibration(with_behavior(spark, sf_dir), "behavior", "action_no", [STEP], right_closed=True).select(STEP, "ece")


@query("calibration_bins", f"""WITH {PROP}, c AS (SELECT greatest(p0,p1,p2) AS conf, CASE WHEN list_position([p0,p1,p2], greatest(p0,p1,p2)) - 1 = action_no THEN 1.0 ELSE 0.0 END AS hit FROM prop)
SELECT CAST(least(floor(conf * 10), 9) AS INTEGER) AS bin, count(*)::BIGINT AS rows, round(avg(conf), 6) AS confidence, round(CAST(avg(hit) AS DOUBLE), 6) AS accuracy FROM c GROUP BY 1""")
def calibration_bins(spark, sf_dir):
    return D.calibration_bins(with_behavior(spark, sf_dir), "target", "action_no")


@query("decision_rule", f"""WITH {TRAJ}, d AS (SELECT list_position([p0,p1,p2], greatest(p0,p1,p2)) - 1 AS best, list_sort([p0,p1,p2], 'DESC')[1] - list_sort([p0,p1,p2], 'DESC')[2] AS gap FROM traj)
SELECT count(*)::BIGINT AS rows, sum(CASE WHEN best = 0 THEN 1 ELSE 0 END)::BIGINT AS top_maintain, sum(CASE WHEN best = 1 THEN 1 ELSE 0 END)::BIGINT AS top_iv_fluids, sum(CASE WHEN best = 2 THEN 1 ELSE 0 END)::BIGINT AS top_escalate_vasopressor, round(min(gap), 6) AS min_margin, round(avg(gap), 6) AS mean_margin FROM d""")
def decision_rule(spark, sf_dir):
    return D.decision_rule(steps(spark, sf_dir), "target")


@query("total_variation", f"WITH {PROP} SELECT patient_id, time_step, round(0.5 * (abs(p0-b0) + abs(p1-b1) + abs(p2-b2)), 6) AS tv, round(-(p0*ln(p0) + p1*ln(p1) + p2*ln(p2)), 6) AS entropy FROM prop")
def total_variation(spark, sf_dir):
    return with_behavior(spark, sf_dir).select(EPISODE, STEP, X.total_variation(F.col("target"), F.col("behavior")).alias("tv"), X.entropy(F.col("target")).alias("entropy"))


@query("state_dependence", f"""WITH {TRAJ}, m AS (SELECT avg(p0) AS m0, avg(p1) AS m1, avg(p2) AS m2 FROM traj), t AS (SELECT p0, p1, p2, m0, m1, m2, 0.5 * (abs(p0-m0) + abs(p1-m1) + abs(p2-m2)) AS tv FROM traj, m)
SELECT round(avg(tv), 6) AS mean_tv, round(max(tv), 6) AS max_tv, round(stddev_samp(p0), 6) AS sd_maintain, round(stddev_samp(p1), 6) AS sd_iv_fluids, round(stddev_samp(p2), 6) AS sd_escalate_vasopressor,
 round(max(m0), 6) AS marginal_maintain, round(max(m1), 6) AS marginal_iv_fluids, round(max(m2), 6) AS marginal_escalate_vasopressor FROM t""")
def state_dependence(spark, sf_dir):
    return D.state_dependence(steps(spark, sf_dir), "target")


@query("agreement", f"""WITH {PROP}, d AS (SELECT CASE WHEN list_position([p0,p1,p2], greatest(p0,p1,p2)) = list_position([b0,b1,b2], greatest(b0,b1,b2)) THEN 1 ELSE 0 END AS same, 0.5 * (abs(p0-b0) + abs(p1-b1) + abs(p2-b2)) AS tv FROM prop)
SELECT count(*)::BIGINT AS rows, round(avg(same), 6) AS agreement, sum(1 - same)::BIGINT AS disagreements, round(avg(tv), 6) AS mean_tv FROM d""")
def agreement(spark, sf_dir):
    return D.agreement(with_behavior(spark, sf_dir), "target", "behavior")


@query("greedy_identity", f"WITH {PROP} SELECT bool_and(list_position([p0,p1,p2], greatest(p0,p1,p2)) = list_position([b0,b1,b2], greatest(b0,b1,b2))) AS identical FROM prop")
def greedy_identity(spark, sf_dir):
    return D.greedy_identity(with_behavior(spark, sf_dir), "target", "behavior")


@query("action_marginal", f"WITH {TRAJ} SELECT {', '.join(f'round(avg(CASE WHEN action_no = {i} THEN 1 ELSE 0 END), 6) AS share_{a}' for i, a in enumerate(ACTIONS))} FROM traj")
def action_marginal(spark, sf_dir):
    return D.action_marginal(steps(spark, sf_dir), "action_no")


# ---- inference ------------------------------------------------------------------

RESAMPLES = 200
DRAWS = I.PoissonDraws(RESAMPLES)
DRAWS_SQL = f"""ix AS (SELECT *, patient_id AS idx FROM episode), {DRAWS.sql("ix", "patient_id")}"""


def with_draws(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, I.PoissonDraws]:
    return settled(episodes(spark, sf_dir).withColumn("idx", F.col(EPISODE))), DRAWS


@query("bootstrap_ci", f"""WITH {CELLS}, {DRAWS_SQL}, s AS (SELECT b, avg(v0) AS v0, avg(value_cap_10) AS value_cap_10, avg(factual) AS factual FROM slots JOIN ix USING (idx) GROUP BY b),
l AS (SELECT unnest(['v0','value_cap_10','factual']) AS policy, unnest([v0, value_cap_10, factual]) AS v, unnest([v0 - factual, value_cap_10 - factual, 0]) AS d FROM s),
p AS (SELECT unnest(['v0','value_cap_10','factual']) AS policy, unnest([avg(v0), avg(value_cap_10), avg(factual)]) AS mean, unnest([avg(v0) - avg(factual), avg(value_cap_10) - avg(factual), 0]) AS difference FROM episode)
SELECT policy, round(max(mean), 6) AS mean, round(max(difference), 6) AS difference, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high, round(quantile_cont(d, 0.025), 6) AS difference_low, round(quantile_cont(d, 0.975), 6) AS difference_high FROM l JOIN p USING (policy) GROUP BY 1""")
def bootstrap_ci(spark, sf_dir):
    values, draws = with_draws(spark, sf_dir)
    return I.paired_bootstrap(values, draws, ["v0", "value_cap_10", "factual"], "factual")


@query("paired_gap", f"""WITH {CELLS}, {DRAWS_SQL}, s AS (SELECT b, avg(v0 - value_cap_10) AS g FROM slots JOIN ix USING (idx) GROUP BY b), p AS (SELECT avg(v0 - value_cap_10) AS point, count(*) AS n FROM episode)
SELECT round(max(point), 6) AS point, round(quantile_cont(g, 0.025), 6) AS low, round(quantile_cont(g, 0.975), 6) AS high, round(stddev_samp(g), 6) AS standard_error, quantile_cont(g, 0.025) > 0 OR quantile_cont(g, 0.975) < 0 AS excludes_zero, max(n)::BIGINT AS episodes, count(*)::BIGINT AS resamples FROM s, p""")
def paired_gap(spark, sf_dir):
    values, draws = with_draws(spark, sf_dir)
    return I.paired_gap(values, draws, "v0", "value_cap_10")


@query("max_t", f"""WITH {CELLS}, {DRAWS_SQL}, c AS (SELECT idx, v0 - factual AS c0, value_cap_10 - factual AS c1, value_cap_10 - v0 AS c2 FROM ix),
s AS (SELECT b, avg(c0) AS c0, avg(c1) AS c1, avg(c2) AS c2 FROM slots JOIN c USING (idx) GROUP BY b), f AS (SELECT avg(c0) AS m0, avg(c1) AS m1, avg(c2) AS m2 FROM c), e AS (SELECT stddev_samp(c0) AS s0, stddev_samp(c1) AS s1, stddev_samp(c2) AS s2 FROM s),
t AS (SELECT greatest(abs((c0 - m0) / s0), abs((c1 - m1) / s1), abs((c2 - m2) / s2)) AS t FROM s, f, e), k AS (SELECT list_sort(list(t))[CAST(ceil(0.95 * ({RESAMPLES} - 1)) AS INTEGER) + 1] AS k FROM t),
r AS (SELECT unnest(['direct','capped','capped']) AS left_policy, unnest(['factual','factual','direct']) AS right_policy, unnest([m0, m1, m2]) AS point, unnest([s0, s1, s2]) AS standard_error, k FROM f, e, k)
SELECT 'total' AS estimator, left_policy, right_policy, round(point, 6) AS point, round(standard_error, 6) AS standard_error, round(point - k * standard_error, 6) AS low, round(point + k * standard_error, 6) AS high, round(k, 6) AS critical FROM r""")
def max_t(spark, sf_dir):
    values, draws = with_draws(spark, sf_dir)
    wide = values.select("idx", F.col("value_cap_10").alias("total_capped"), F.col("v0").alias("total_direct"), F.col("factual").alias("total_factual"))
    return I.max_t(wide, draws, ["capped", "direct", "factual"], ["total"])


@query("policy_pairs", """SELECT l AS left_policy, r AS right_policy, e AS estimator FROM (SELECT unnest(['always_maintain','behavior_clone','llm_zero_shot','llm_improved']) AS l, unnest([0,1,2,3]) AS i),
 (SELECT unnest(['always_maintain','behavior_clone','llm_zero_shot','llm_improved']) AS r, unnest([0,1,2,3]) AS j), (SELECT unnest(['direct','sdr']) AS e) WHERE i < j""")
def policy_pairs(spark, sf_dir):
    names = ["always_maintain", "behavior_clone", "llm_zero_shot", "llm_improved"]
    return spark.createDataFrame([(a, b, e) for a, b in I.contrasts(names) for e in ("direct", "sdr")], "left_policy string, right_policy string, estimator string")


@query("cluster_bootstrap", f"""WITH {CELLS}, {DRAWS_SQL}, g AS (SELECT patient_id, count(*) AS n, {', '.join(f'sum(p{i} - b{i}) AS s{i}' for i in range(3))} FROM dr GROUP BY 1), gi AS (SELECT idx, g.* FROM g JOIN ix USING (patient_id)),
s AS (SELECT b, {', '.join(f'sum(s{i}) / sum(gi.n) AS d{i}' for i in range(3))} FROM slots JOIN gi USING (idx) GROUP BY b), p AS (SELECT {', '.join(f'avg(p{i} - b{i}) AS m{i}' for i in range(3))} FROM dr),
l AS (SELECT unnest([0,1,2]) AS action_no, unnest([d0,d1,d2]) AS d, unnest([m0,m1,m2]) AS m FROM s, p) SELECT action_no, round(max(m), 6) AS mean_shift, round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.975), 6) AS high FROM l GROUP BY 1""")
def cluster_bootstrap(spark, sf_dir):
    values, draws = with_draws(spark, sf_dir)
    rows = with_behavior(spark, sf_dir).join(values.select(EPISODE, "idx"), EPISODE)
    return I.cluster_shift(rows, "behavior", "target", EPISODE, draws)


@query("gates", f"""WITH {WEIGHTED}, t AS (SELECT max(log_w) AS m FROM lw WHERE time_step = {HORIZON - 1}), e AS (SELECT sum(exp(log_w - m)) * sum(exp(log_w - m)) / sum(exp(log_w - m) * exp(log_w - m)) AS ess, 1 / sum(exp(log_w - m)) AS share FROM lw, t WHERE time_step = {HORIZON - 1}),
s AS (SELECT avg(least(p0,b0) + least(p1,b1) + least(p2,b2)) AS overlap, avg(CASE WHEN b0 < 0.01 THEN p0 ELSE 0 END + CASE WHEN b1 < 0.01 THEN p1 ELSE 0 END + CASE WHEN b2 < 0.01 THEN p2 ELSE 0 END) AS low_mass FROM prop)
SELECT round(overlap, 6) AS overlap, round(low_mass, 6) AS low_mass, round(ess, 6) AS ess, round(share, 6) AS share, overlap >= 0.5 AS gate_overlap, low_mass <= 0.05 AS gate_low_mass, ess >= 10 AS gate_ess, share <= 0.2 AS gate_share,
 overlap >= 0.5 AND low_mass <= 0.05 AND ess >= 10 AND share <= 0.2 AS eligible FROM e, s""")
def gates(spark, sf_dir):
    rows = with_behavior(spark, sf_dir)
    last = U.concentration(S.cumulative_weights(rows, ()), "log_w", [STEP]).filter(F.col(STEP) == HORIZON - 1).first()
    one = U.state_support(rows, thresholds=(0.01,)).select(F.col("mean_overlap").alias("overlap"), F.col("mass_below_0_01").alias("low_mass"), F.lit(last["ess"]).alias("ess"), F.lit(last["max_share"]).alias("share"),
                                                           F.lit(True).alias("schema_pass"), F.lit(0.0).alias("fallback_rate"))
    return G.eligibility(one).select("overlap", "low_mass", "ess", "share", "gate_overlap", "gate_low_mass", "gate_ess", "gate_share", "eligible")


@query("ranking", f"""WITH {CELLS}, v AS (SELECT unnest(['direct','capped','factual']) AS policy, unnest([avg(v0), avg(value_cap_10), avg(factual)]) AS mean FROM episode) SELECT policy, round(mean, 6) AS mean, CAST(row_number() OVER (ORDER BY mean DESC) AS INTEGER) AS place FROM v""")
def ranking(spark, sf_dir):
    row = episodes(spark, sf_dir).agg(F.avg("v0").alias("direct"), F.avg("value_cap_10").alias("capped"), F.avg("factual").alias("factual")).first().asDict()
    order = G.ranked(row, ["direct", "capped", "factual"])
    return spark.createDataFrame([(p, row[p], i + 1) for i, p in enumerate(order)], "policy string, mean double, place int")


@query("cyclic_average", f"""WITH {TRAJ}, l AS (SELECT patient_id, time_step, unnest([0,0,0,1,1,1,2,2,2]) AS mapping, unnest([0,1,2,0,1,2,0,1,2]) AS label, unnest([p0,p1,p2,p1,p2,p0,p2,p0,p1]) AS p FROM traj)
SELECT patient_id, time_step, (label + mapping) % 3 AS action_no, round(avg(p), 6) AS p FROM l GROUP BY 1, 2, 3""")
def cyclic_average(spark, sf_dir):
    """Three label orders of one question, read back to actions and averaged."""
    t = F.col("target")
    cells = F.explode(F.array(*[F.struct(((F.lit(label) + m) % 3).alias("action_no"), t[(label + m) % 3].alias("p")) for m in range(3) for label in range(3)]))
    return steps(spark, sf_dir).select(EPISODE, STEP, cells.alias("x")).select(EPISODE, STEP, "x.*").groupBy(EPISODE, STEP, "action_no").agg(F.avg("p").alias("p"))


@query("note_guard", """SELECT doc_id, CASE WHEN length(text) > 4000 THEN 'too long' WHEN regexp_matches(text, '(?i)(?:BEGIN|END)_UNTRUSTED_HANDOFF_NOTE(?:_JSON_V1)?') THEN 'marker' WHEN regexp_matches(text, '<\\|[^|\\r\\n]{1,64}\\|>') THEN 'special token' END AS fault FROM documents""")
def note_guard(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", note_faults(F.col("text")).alias("fault"))


@query("cache_dedupe", "SELECT sha256(text) AS key, count(*)::BIGINT AS requests, min(doc_id) AS first_id FROM documents GROUP BY 1")
def cache_dedupe(spark, sf_dir):
    """Requests by key: each distinct prompt is scored once."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.groupBy(F.sha2("text", 256).alias("key")).agg(F.count("*").alias("requests"), F.min("doc_id").alias("first_id"))


@query("controls", f"""WITH {PROP}, m AS (SELECT avg(CASE WHEN action_no = 0 THEN 1 ELSE 0 END) AS m0, avg(CASE WHEN action_no = 1 THEN 1 ELSE 0 END) AS m1, avg(CASE WHEN action_no = 2 THEN 1 ELSE 0 END) AS m2 FROM traj),
c AS (SELECT patient_id, time_step, ba, 'marginal' AS control, CASE action_no WHEN 0 THEN m0 WHEN 1 THEN m1 ELSE m2 END AS pa FROM prop, m UNION ALL SELECT patient_id, time_step, ba, 'uniform', CAST(1 AS DOUBLE) / 3 FROM prop),
l AS (SELECT control, time_step, sum(ln(pa) - ln(ba)) OVER (PARTITION BY control, patient_id ORDER BY time_step) AS l FROM c), t AS (SELECT control, max(l) AS m FROM l WHERE time_step = 11 GROUP BY 1)
SELECT control, round(sum(exp(l - m)) * sum(exp(l - m)) / sum(exp(l - m) * exp(l - m)), 6) AS ess, round(1 / sum(exp(l - m)), 6) AS max_share FROM l JOIN t USING (control) WHERE time_step = 11 GROUP BY 1""")
def controls(spark, sf_dir):
    """Terminal weight concentration of the logged marginal and of the uniform policy."""
    rows = with_behavior(spark, sf_dir)
    share = D.action_marginal(rows, "action_no").first()
    out = None
    for name, p in (("marginal", [share[f"share_{a}"] for a in ACTIONS]), ("uniform", [1 / 3] * 3)):
        part = rows.withColumns({"control": F.lit(name), "target_logged": X.gather(F.array(*map(F.lit, p)), F.col("action_no"))})
        out = part if out is None else out.unionByName(part)
    weighted = S.cumulative_weights(out, (), ["control"]).filter(F.col(STEP) == HORIZON - 1)
    return U.concentration(weighted, "log_w", ["control"])


def queries() -> dict[str, Query]:
    from . import contract_queries, learner_queries, policy_queries, scoring_queries  # noqa: F401  these register theirs

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
