"""Registered queries over contracts, roles, projections and files, each with its SQL. Faults are planted by user number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import expressions as X
from .operators import fqe as Q
from .operators import inference as I
from .plans import observations as O
from .plans import roles as R
from .plans import validation as V
from .queries import user, CELLS, CLINICAL, PROP, ROLES_SQL, TRAJ, clinical, query, split, steps, with_behavior, with_cells
from .schema import ACTION, ACTIONS, EPISODE, STEP, ContractError, policy_columns
from .scoring.cache import read_lines
from .scoring.prompts import MISSING_NOTE
from .sources.events import HORIZON, action_name
from .sources.files import SECRETS, file_digests, finite_or_null, probability_digest, read_columns, read_trajectories, scratch, secret_kind, write_csv, write_json
from .sources.synthetic import generate



def named_action(no: Column) -> Column:
    return F.get(F.array(*[F.lit(a) for a in ACTIONS]), no)


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectories with a fault of each kind."""
    k, t, no = user() % 11, F.col(STEP), F.col("action_no")
    rows = steps(spark, sf_dir).select(EPISODE, STEP, "action_no", "previous_no", "terminal", k.alias("k"))
    rows = rows.withColumn("c", F.explode(F.when((F.col("k") == 5) & (t == 2), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).filter(~((F.col("k") == 8) & (t == 11)))
    before = F.when((F.col("k") == 4) & (t == 6), (F.col("previous_no") + 1) % 3).otherwise(F.col("previous_no"))
    return rows.select(
        F.when((user() == 7) & (t == 4), None).otherwise(F.col(EPISODE)).alias(EPISODE), F.when(F.col("k") == 2, t + 1).otherwise(t).alias(STEP), F.when((F.col("k") == 1) & (t == 3), None).otherwise(named_action(no)).alias(ACTION),
        named_action(before).alias("previous_action"), F.when((F.col("k") == 3) & (t == 5), 1).when((F.col("k") == 6) & (t == 1), 2).otherwise(F.col("terminal")).alias("terminal"))


PLANTED = f"""{TRAJ}, planted AS (SELECT CASE WHEN u = 7 AND t = 4 THEN NULL ELSE patient_id END AS patient_id, CASE WHEN k = 2 THEN t + 1 ELSE t END AS time_step, CASE WHEN k = 1 AND t = 3 THEN NULL ELSE action_no END AS action_no,
 CASE WHEN k = 4 AND t = 6 THEN (previous_no + 1) % 3 ELSE previous_no END AS previous_no, CASE WHEN k = 3 AND t = 5 THEN 1 WHEN k = 6 AND t = 1 THEN 2 ELSE terminal END AS terminal
 FROM (SELECT *, CAST(patient_id AS BIGINT) AS u, CAST(patient_id AS BIGINT) % 11 AS k, time_step AS t FROM traj) x, (SELECT unnest([1, 2]) AS c) WHERE (c = 1 OR (k = 5 AND t = 2)) AND NOT (k = 8 AND t = 11)),
marked AS (SELECT *, row_number() OVER w - 1 AS place, lead(1) OVER w AS ahead, lag(action_no) OVER w AS before, count(*) OVER (PARTITION BY patient_id, time_step) AS copies FROM planted WINDOW w AS (PARTITION BY patient_id ORDER BY time_step))"""
COUNT = "coalesce(sum(CASE WHEN {} THEN 1 ELSE 0 END), 0)::BIGINT AS {}"
KINDS = {"null_key": ("null key", "patient_id IS NULL OR time_step IS NULL"), "repeated_key": ("repeated key", "copies > 1"), "unknown_action": ("unknown action", "action_no IS NULL"),
         "not_consecutive": ("steps not consecutive from 0", "time_step <> place"), "terminal_value": ("terminal not 0 or 1", "terminal NOT IN (0, 1)"),
         "terminal_place": ("terminal not on the last step alone", "(terminal = 1) <> (ahead IS NULL)"), "bad_history": ("previous action not the one before", "before IS NOT NULL AND before <> previous_no"),
         "bad_length": ("episode of another length", "ahead IS NULL AND place <> 11")}


@query("trajectory_faults", f"WITH {PLANTED} SELECT {', '.join(COUNT.format(c, n) for n, (_, c) in KINDS.items())}, count(*)::BIGINT AS rows FROM marked")
def trajectory_faults(spark, sf_dir):
    rows = planted(spark, sf_dir)
    checks = V.trajectory_checks(rows, HORIZON)
    return V.count_faults(V.marked_trajectory(rows), {n: checks[c] for n, (c, _) in KINDS.items()} | {"rows": F.lit(True)})


def with_outcome_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, t = user() % 9, F.col(STEP)
    rows = clinical(spark, sf_dir).join(steps(spark, sf_dir).select(EPISODE, STEP, "previous_no", "terminal"), [EPISODE, STEP])
    delta = F.when((k == 1) & (t == 2), float("nan")).otherwise(F.col("next_6h_map_delta"))
    event = F.when((k == 2) & (t == 3), 2).when((k == 3) & (t == 3), None).otherwise(F.col("next_6h_deterioration"))
    before = F.when((k == 4) & (t == 0), ACTIONS[1]).otherwise(named_action(F.col("previous_no")))
    return rows.withColumns({"next_6h_map_delta": delta, "next_6h_deterioration": event, "previous_action": before})


@query("environment_faults", f"""WITH {TRAJ}, x AS (SELECT *, CAST(patient_id AS BIGINT) % 9 AS k FROM traj) SELECT {COUNT.format("(k = 1 AND time_step = 2) OR (k IN (2, 3) AND time_step = 3)", "bad_outcome")},
 {COUNT.format("k = 4 AND time_step = 0", "bad_start")}, count(*)::BIGINT AS rows FROM x""")
def environment_faults(spark, sf_dir):
    rows = with_outcome_faults(spark, sf_dir)
    checks = V.environment_checks(rows)
    return V.count_faults(V.marked_trajectory(rows), {"bad_outcome": checks["outcome not finite or event not binary"], "bad_start": checks["first step not preceded by maintain"], "rows": F.lit(True)})


@query("reward_faults", f"WITH {TRAJ} SELECT patient_id, time_step, (CAST(patient_id AS BIGINT) % 9 = 1 AND time_step = 2) OR (CAST(patient_id AS BIGINT) % 9 IN (2, 3) AND time_step = 3) AS faulty FROM traj")
def reward_faults(spark, sf_dir):
    return with_outcome_faults(spark, sf_dir).select(EPISODE, STEP, X.PRIMARY.faults().alias("faulty"))


SETTINGS = [({}, True), ({"map_scale": 0.0}, False), ({"lactate_scale": -1.0}, False), ({"hypotension": -0.1}, False), ({"map_weight": float("inf")}, False), ({"map_weight": -2.0}, True)]


@query("reward_settings", "SELECT * FROM (VALUES " + ", ".join(f"({i}, {str(ok).lower()})" for i, (_, ok) in enumerate(SETTINGS)) + ") t(setting, accepted)")
def reward_settings(spark, sf_dir):
    """Which reward settings are accepted."""
    out = []
    for i, (how, _) in enumerate(SETTINGS):
        try:
            X.Reward(**how)
            out.append((i, True))
        except ValueError:
            out.append((i, False))
    return spark.createDataFrame(out, "setting int, accepted boolean")


LISTS = [("map_mm_hg,sex", True), ("", False), ("sex,sex", False), ("patient_id", False), ("split", False), ("terminal", False), ("handoff_note", False), ("icu_mortality", False), ("next_6h_map_delta", False),
         ("adverse_x", False), ("observed_clinician_action", False), ("time_step,sex", False), ("lactate_mmol_l", True)]


@query("policy_column_rules", "SELECT names, NOT (names = '' OR len(list_distinct(string_split(names, ','))) < len(string_split(names, ',')) OR len(list_filter(string_split(names, ','), lambda n: n IN ('patient_id', 'time_step', 'split', 'hospital_id',"
       " 'provider_id', 'observed_clinician_action', 'terminal', 'handoff_note', 'icu_mortality', 'hospital_mortality') OR starts_with(n, 'next_') OR starts_with(n, 'adverse_'))) > 0) AS accepted FROM (VALUES "
       + ", ".join(f"('{n}')" for n, _ in LISTS) + ") t(names)")
def policy_column_rules(spark, sf_dir):
    """Which lists of columns a policy may see."""
    out = []
    for names, _ in LISTS:
        try:
            policy_columns([n for n in names.split(",") if n])
            out.append((names, True))
        except ContractError:
            out.append((names, False))
    return spark.createDataFrame(out, "names string, accepted boolean")


@query("distribution_faults", f"""WITH {TRAJ}, x AS (SELECT *, CAST(patient_id AS BIGINT) % 8 AS k FROM traj), v AS (SELECT patient_id, time_step,
 CASE k WHEN 1 THEN [p0 + 0.1, p1, p2] WHEN 2 THEN [-p0, p1 + p0 + p0, p2] WHEN 3 THEN ['nan'::DOUBLE, p1, p2] WHEN 4 THEN [NULL, p1, p2] WHEN 5 THEN [p0, p1 + p2] WHEN 6 THEN NULL WHEN 7 THEN [p0 + 1e-10, p1, p2] ELSE [p0, p1, p2] END AS p FROM x)
SELECT patient_id, time_step, NOT coalesce(len(p) = 3 AND len(list_filter(p, lambda y: y IS NOT NULL AND NOT isnan(y) AND y >= 0)) = 3 AND abs(list_sum(p) - 1) <= 1e-8, false) AS faulty FROM v""")
def distribution_faults(spark, sf_dir):
    k, p = user() % 8, [F.col("target")[i] for i in range(3)]
    null = F.lit(None).cast("double")
    made = (F.when(k == 1, F.array(p[0] + 0.1, p[1], p[2])).when(k == 2, F.array(-p[0], p[1] + p[0] + p[0], p[2])).when(k == 3, F.array(F.lit(float("nan")), p[1], p[2])).when(k == 4, F.array(null, p[1], p[2]))
            .when(k == 5, F.array(p[0], p[1] + p[2])).when(k == 6, F.lit(None).cast("array<double>")).when(k == 7, F.array(p[0] + 1e-10, p[1], p[2])).otherwise(F.col("target")))
    return steps(spark, sf_dir).select(EPISODE, STEP, V.distribution_faults(made).alias("faulty"))


def by_role(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = steps(spark, sf_dir)
    roles = R.training_roles(rows, 0.6, 41)
    return rows, *[rows.join(roles.filter(F.col("role") == r), EPISODE, "left_semi") for r in (R.DEVELOPMENT, R.NUISANCE)]


@query("role_overlaps", f"""WITH {ROLES_SQL} SELECT role AS left_role, 'validation' AS right_role, count(*)::BIGINT AS shared, min(patient_id) AS example FROM roles WHERE CAST(patient_id AS BIGINT) % 5 = 0 GROUP BY 1""")
def role_overlaps(spark, sf_dir):
    rows, development, nuisance = by_role(spark, sf_dir)
    return V.role_overlaps(policy_development=development, ope_nuisance=nuisance, validation=rows.filter(user() % 5 == 0))


@query("role_cover", f"""WITH {ROLES_SQL}, r AS (SELECT t.patient_id, role FROM traj t JOIN roles USING (patient_id)), c AS (SELECT count(*) AS n, sum(CASE WHEN role = 'ope_nuisance' AND CAST(patient_id AS BIGINT) % 4 = 0 THEN 0 ELSE 1 END) AS s FROM r)
SELECT 'both' AS parts, n::BIGINT AS whole_rows, n::BIGINT AS part_rows, true AS covered FROM c UNION ALL SELECT 'without some', n::BIGINT, s::BIGINT, n = s FROM c""")
def role_cover(spark, sf_dir):
    rows, development, nuisance = by_role(spark, sf_dir)
    whole = V.role_cover(rows, development, nuisance).withColumn("parts", F.lit("both"))
    return whole.unionByName(V.role_cover(rows, development, nuisance.filter(user() % 4 != 0)).withColumn("parts", F.lit("without some")))


@query("scope_audit", f"""WITH {ROLES_SQL}, dev AS (SELECT patient_id FROM roles WHERE role = 'policy_development'), f AS (SELECT 'clone' AS component, patient_id FROM dev UNION ALL SELECT 'teacher', patient_id FROM dev WHERE CAST(patient_id AS BIGINT) % 2 = 0
 UNION ALL SELECT 'anchor', patient_id FROM dev WHERE CAST(patient_id AS BIGINT) % 3 <> 0 UNION ALL SELECT 'stray', patient_id FROM roles WHERE role = 'ope_nuisance'),
g AS (SELECT component, count(*)::BIGINT AS episodes, sum(CASE WHEN d.patient_id IS NULL THEN 1 ELSE 0 END)::BIGINT AS outside FROM f LEFT JOIN dev d USING (patient_id) GROUP BY 1), s AS (SELECT *, outside = 0 AND episodes = (SELECT count(*) FROM dev) AS same FROM g)
SELECT *, outside = 0 AND (same OR component NOT IN ('clone', 'anchor')) AS ok FROM s""")
def scope_audit(spark, sf_dir):
    _, development, nuisance = by_role(spark, sf_dir)
    ids = development.select(EPISODE)
    parts = [("clone", ids), ("teacher", ids.filter(user() % 2 == 0)), ("anchor", ids.filter(user() % 3 != 0)), ("stray", nuisance.select(EPISODE))]
    fitted = None
    for name, part in parts:
        one = part.select(F.lit(name).alias("component"), EPISODE)
        fitted = one if fitted is None else fitted.unionByName(one)
    return V.scope_audit(fitted, ids, ("clone", "anchor"))


@query("sdr_faults", f"""WITH {CELLS}, x AS (SELECT *, CAST(patient_id AS BIGINT) % 7 AS k, count(*) OVER (PARTITION BY patient_id) AS n FROM dr) SELECT {COUNT.format("k = 1 AND time_step = 1", "not_finite")}, {COUNT.format("(k = 2 AND time_step = 2) OR (k = 3 AND time_step = 2)", "behavior_out")},
 {COUNT.format("k = 4 AND time_step = 4", "target_out")}, count(DISTINCT patient_id)::BIGINT AS episodes, count(DISTINCT CASE WHEN k = 5 OR n < {HORIZON} THEN patient_id END)::BIGINT AS incomplete FROM x""")
def sdr_faults(spark, sf_dir):
    k, t = user() % 7, F.col(STEP)
    rows = with_cells(spark, sf_dir).withColumns({
        "reward": F.when((k == 1) & (t == 1), float("nan")).otherwise(F.col("reward")), "behavior_logged": F.when((k == 2) & (t == 2), 0.0).when((k == 3) & (t == 2), 1.5).otherwise(F.col("behavior_logged")),
        "target_logged": F.when((k == 4) & (t == 4), -0.1).otherwise(F.col("target_logged"))})
    checks = V.sdr_checks(F.col("behavior_logged"), F.col("target_logged"), [F.col(c) for c in ("reward", "q_logged", "v", "v_next")])
    names = {"number not finite": "not_finite", "behavior probability not in (0, 1]": "behavior_out", "target probability not in [0, 1]": "target_out"}
    faults = V.count_faults(rows, {names[n]: c for n, c in checks.items()})
    return faults.crossJoin(V.horizon_faults(rows.filter(~((k == 5) & (t == 9))), HORIZON))  # one row each


@query("blend_reconstruction", f"""WITH {PROP}, x AS (SELECT *, CASE WHEN CAST(patient_id AS BIGINT) % 10 = 0 THEN 0.05 ELSE 0 END AS d FROM prop), m AS (SELECT time_step, b0, b1, b2, p0 * 0.25 + b0 * 0.75 + d AS m0, p1 * 0.25 + b1 * 0.75 AS m1, p2 * 0.25 + b2 * 0.75 AS m2 FROM x),
r AS (SELECT *, {', '.join(f'greatest((m{i} - b{i} * 0.75) / 0.25, 0) AS r{i}' for i in range(3))} FROM m), e AS (SELECT time_step, greatest({', '.join(f'abs(r{i} / (r0 + r1 + r2) * 0.25 + b{i} * 0.75 - m{i})' for i in range(3))}) AS e FROM r)
SELECT time_step, count(*)::BIGINT AS rows, {COUNT.format("e > 1e-12", "faulty")}, round(max(e), 6) AS largest FROM e GROUP BY 1""")
def blend_reconstruction(spark, sf_dir):
    """Whether a blend with behaviour can be taken apart and made again; every tenth user's is no blend."""
    b = X.blend(F.col("target"), F.col("behavior"), 0.25)
    moved = F.array(b[0] + F.when(user() % 10 == 0, 0.05).otherwise(0.0), b[1], b[2])
    e = with_behavior(spark, sf_dir).select(STEP, V.blend_error(moved, F.col("behavior"), 0.25).alias("e"))
    return e.groupBy(STEP).agg(F.count("*").alias("rows"), F.sum((F.col("e") > 1e-12).cast("long")).alias("faulty"), F.max("e").alias("largest"))


@query("realignment", f"""WITH {TRAJ}, r AS (SELECT patient_id, time_step + CASE WHEN u % 6 = 2 AND time_step = 11 THEN 1 ELSE 0 END AS time_step FROM (SELECT *, CAST(patient_id AS BIGINT) AS u FROM traj) x, (SELECT unnest([1, 2]) AS c) WHERE (c = 1 OR (u % 6 = 1 AND time_step = 2)) AND NOT (u % 6 = 0 AND time_step = 1)),
a AS (SELECT patient_id, time_step, count(*) AS a FROM traj GROUP BY 1, 2), b AS (SELECT patient_id, time_step, count(*) AS b FROM r GROUP BY 1, 2)
SELECT {COUNT.format("a IS NOT NULL AND b IS NOT NULL", "matched")}, {COUNT.format("b IS NULL", "left_only")}, {COUNT.format("a IS NULL", "right_only")}, {COUNT.format("coalesce(a, 0) > 1 OR coalesce(b, 0) > 1", "repeated")} FROM a FULL JOIN b USING (patient_id, time_step)""")
def realignment(spark, sf_dir):
    rows = steps(spark, sf_dir).select(EPISODE, STEP)
    k, t = user() % 6, F.col(STEP)
    other = rows.filter(~((k == 0) & (t == 1))).withColumn("c", F.explode(F.when((k == 1) & (t == 2), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    other = other.select(EPISODE, (t + F.when((k == 2) & (t == 11), 1).otherwise(0)).alias(STEP))
    return V.realignment(rows, other)


@query("action_numbers", f"""WITH {TRAJ}, x AS (SELECT CASE WHEN CAST(patient_id AS BIGINT) % 13 = 0 THEN 'jump' ELSE CASE action_no WHEN 0 THEN 'maintain' WHEN 1 THEN 'iv_fluids' ELSE 'escalate_vasopressor' END END AS name FROM traj)
SELECT name, CAST(coalesce(list_position(['maintain', 'iv_fluids', 'escalate_vasopressor'], name) - 1, -1) AS INTEGER) AS action_no, count(*)::BIGINT AS rows FROM x GROUP BY 1, 2""")
def action_numbers(spark, sf_dir):
    name = F.when(user() % 13 == 0, "jump").otherwise(action_name())
    return steps(spark, sf_dir).select(name.alias("name")).groupBy("name", F.coalesce(X.action_number(F.col("name")), F.lit(-1)).alias("action_no")).agg(F.count("*").alias("rows"))


@query("step_guard", f"WITH {TRAJ}, x AS (SELECT time_step + CASE WHEN CAST(patient_id AS BIGINT) % 5 = 1 THEN 3 WHEN CAST(patient_id AS BIGINT) % 5 = 2 THEN -1 ELSE 0 END AS t FROM traj) SELECT count(*)::BIGINT AS rows, {COUNT.format('t < 0 OR t >= 12', 'outside')} FROM x")
def step_guard(spark, sf_dir):
    moved = F.col(STEP) + F.when(user() % 5 == 1, 3).when(user() % 5 == 2, -1).otherwise(0)
    return Q.step_faults(steps(spark, sf_dir).withColumn(STEP, moved), HORIZON)


@query("initial_values", f"WITH {CELLS} SELECT patient_id, round(v0, 6) AS direct FROM episode")
def initial_values(spark, sf_dir):
    return Q.initial_values(with_cells(spark, sf_dir))


# ---- observations ------------------------------------------------------------


def noted(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(user() % 6 == 1, float("nan")).when(user() % 6 == 2, None).otherwise(F.col("value"))
    note = F.when(user() % 3 == 0, F.concat(F.lit("seen at step "), F.col(STEP)))
    return steps(spark, sf_dir).select(EPISODE, STEP, value.alias("map_mm_hg"), action_name("previous_no").alias("previous_action"), note.alias("note"))


@query("observations", f"""WITH {TRAJ} SELECT patient_id, time_step, round(CASE WHEN CAST(patient_id AS BIGINT) % 6 IN (1, 2) THEN NULL ELSE value END, 6) AS map_mm_hg, CASE previous_no WHEN 0 THEN 'maintain' WHEN 1 THEN 'iv_fluids' ELSE 'escalate_vasopressor' END AS previous_action,
 CASE WHEN CAST(patient_id AS BIGINT) % 3 = 0 THEN 'seen at step ' || time_step ELSE '{MISSING_NOTE}' END AS handoff_note FROM traj""")
def observations(spark, sf_dir):
    """What a policy sees of every step, as columns again."""
    columns = ("map_mm_hg", "previous_action")
    seen = O.observations(noted(spark, sf_dir), columns, "note")
    return O.observation_table(seen, columns, (EPISODE, STEP, "handoff_note"))


@query("observation_faults", f"""WITH {TRAJ}, j AS (SELECT patient_id, time_step, CASE CAST(patient_id AS BIGINT) % 6 WHEN 1 THEN '{{"structured":{{"map_mm_hg":1,"age":2}}}}' WHEN 2 THEN '{{"structured":{{}}}}' WHEN 3 THEN '{{"structured":{{"map_mm_hg":1}},"x":1}}' WHEN 4 THEN '[1]'
 WHEN 5 THEN '{{"handoff_note":"a"}}' ELSE '{{"structured":{{"map_mm_hg":1}},"handoff_note":null}}' END AS o FROM traj)
SELECT patient_id, time_step, CASE WHEN json_type(o) <> 'OBJECT' THEN 'not an object' WHEN len(list_filter(json_keys(o), lambda k: k NOT IN ('structured', 'handoff_note'))) > 0 THEN 'unsupported field' WHEN json_extract(o, '$.structured') IS NULL THEN 'no structured fields'
 WHEN list_sort(json_keys(o, '$.structured')) <> ['map_mm_hg'] THEN 'other structured fields' END AS fault FROM j""")
def observation_faults(spark, sf_dir):
    k = user() % 6
    text = (F.when(k == 1, '{"structured":{"map_mm_hg":1,"age":2}}').when(k == 2, '{"structured":{}}').when(k == 3, '{"structured":{"map_mm_hg":1},"x":1}').when(k == 4, "[1]")
            .when(k == 5, '{"handoff_note":"a"}').otherwise('{"structured":{"map_mm_hg":1},"handoff_note":null}'))
    return steps(spark, sf_dir).select(EPISODE, STEP, O.observation_fault(text, ["map_mm_hg"]).alias("fault"))


# ---- files ---------------------------------------------------------------------


@query("csv_scan", f"""WITH {CLINICAL} SELECT patient_id, time_step, CASE action_no WHEN 0 THEN 'maintain' WHEN 1 THEN 'iv_fluids' ELSE 'escalate_vasopressor' END AS observed_clinician_action, round(value, 6) AS map_mm_hg, is_error AS next_6h_deterioration FROM clin""")
def csv_scan(spark, sf_dir):
    """Trajectories written as CSV with CRLF line ends and read under their declared schema."""
    rows = clinical(spark, sf_dir).select(EPISODE, STEP, ACTION, "map_mm_hg", "next_6h_deterioration")
    path = scratch(spark)
    write_csv(rows, path)
    return read_trajectories(spark, path, rows.schema)


@query("file_digest", f"WITH {TRAJ} SELECT sha256('patient_id,time_step' || chr(10) || string_agg(patient_id || ',' || time_step || chr(10), '' ORDER BY patient_id, time_step)) AS sha256 FROM traj")
def file_digest(spark, sf_dir):
    """The digest of a CSV file with CRLF line ends is that of the same lines with line feeds."""
    path = scratch(spark)
    write_csv(steps(spark, sf_dir).select(EPISODE, STEP), path)
    return file_digests(spark, f"{path}/part-*").select("sha256")


@query("column_list", "SELECT unnest(['map_mm_hg', 'lactate_mmol_l', 'sex', 'previous_action']) AS name, unnest([0, 1, 2, 3]) AS place")
def column_list(spark, sf_dir):
    """An allow-list of columns, written and read."""
    path = scratch(spark)
    write_json(spark, ["map_mm_hg", "lactate_mmol_l", "sex", "previous_action"], path)
    return spark.createDataFrame([(n, i) for i, n in enumerate(read_columns(spark, path))], "name string, place int")


@query("response_cache", "SELECT sha256(text) AS key, min(lang) AS response FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(DISTINCT coalesce(lang, '')) = 1")
def response_cache(spark, sf_dir):
    """Answers kept as JSON lines by key and read back, one row per key; keys with two answers aren't written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text is not null")
    found = docs.groupBy(F.sha2("text", 256).alias("key")).agg(F.min("lang").alias("response"), F.countDistinct(F.coalesce("lang", F.lit(""))).alias("n")).filter("n = 1").drop("n")
    path = scratch(spark)
    found.unionByName(found).write.option("ignoreNullFields", "false").json(path)
    return read_lines(spark, path, "key string, response string")


@query("finite_numbers", f"WITH {TRAJ} SELECT patient_id, time_step, round(CASE WHEN CAST(patient_id AS BIGINT) % 4 IN (1, 2, 3) THEN NULL ELSE value END, 6) AS value FROM traj")
def finite_numbers(spark, sf_dir):
    odd = F.when(user() % 4 == 1, float("nan")).when(user() % 4 == 2, float("inf")).when(user() % 4 == 3, -float("inf")).otherwise(F.col("value"))
    return finite_or_null(steps(spark, sf_dir).select(EPISODE, STEP, odd.alias("value")))


@query("probability_digest", f"WITH {TRAJ} SELECT sha256(unhex(repeat('000000000000F03F' || repeat('0', 32), count(*)::BIGINT))) AS digest FROM traj")
def probability_digests(spark, sf_dir):
    """The digest of the little-endian doubles of a policy that always takes the first action."""
    rows = steps(spark, sf_dir).select(EPISODE, STEP, F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)).alias("p"))
    return spark.createDataFrame([(probability_digest(rows, "p"),)], "digest string")


@query("secret_scan", "SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in SECRETS.items()) + " END AS kind FROM documents")
def secret_scan(spark, sf_dir):
    """Documents that seem to hold a credential."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", secret_kind(F.col("text")).alias("kind"))


@query("example_splits", "SELECT * FROM (VALUES ('train', 180::BIGINT, 60::BIGINT, true), ('validation', 72, 24, true), ('test', 36, 12, false)) t(split, rows, episodes, has_outcomes)")
def example_splits(spark, sf_dir):
    """The generated example: rows and episodes of each split; the last has no outcomes."""
    out = None
    for name, df in generate(spark, 41).items():
        part = df.agg(F.lit(name).alias("split"), F.count("*").alias("rows"), F.countDistinct(EPISODE).alias("episodes"), F.lit("next_6h_map_delta" in df.columns).alias("has_outcomes"))
        out = part if out is None else out.unionByName(part)
    return out


# ---- permutations ----------------------------------------------------------------


@query("permuted_rows", f"""WITH {TRAJ}, a AS (SELECT patient_id, time_step, row_number() OVER (ORDER BY patient_id, time_step) AS i FROM traj),
b AS (SELECT p0, p1, p2, row_number() OVER (ORDER BY sha256('41:' || patient_id || ':' || time_step), patient_id, time_step) AS i FROM traj) SELECT patient_id, time_step, round(p0, 6) AS p0, round(p1, 6) AS p1, round(p2, 6) AS p2 FROM a JOIN b USING (i)""")
def permuted_rows(spark, sf_dir):
    return I.permuted_rows(steps(spark, sf_dir).select(EPISODE, STEP, "target"), [EPISODE, STEP], "target").select(EPISODE, STEP, *split("target", "p"))
