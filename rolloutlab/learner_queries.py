"""Queries over learners that are fitted where the rows are."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import diagnostics as D
from .operators import boosted as B
from .operators import logistic as L
from .operators.fqe import by_step
from .operators.teacher import held_out_values
from .queries import FOLDED, query, steps
from .schema import EPISODE, STEP
from .sources.events import HORIZON
from .sources.files import settled

GRID = (0.01, 0.1, 1.0, 10.0)
NUMERIC, CATEGORICAL = ("value",), ("previous_no",)
#: Weights at which a Newton step is taken: value, its gap, the three previous actions, their gap, 1; by action.
START = np.array([[0.01, 0.0, -0.01], [0, 0, 0], [0.2, 0.0, -0.1], [0.0, 0.3, 0.0], [-0.1, 0.0, 0.2], [0, 0, 0], [0.1, 0.0, -0.3]])


def logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written once: folds, designs and scores each read it."""
    return settled(steps(spark, sf_dir).select(EPISODE, STEP, "value", "previous_no", "action_no"))


def _score(a: int) -> str:
    w = START[:, a]
    return f"CAST({w[0]} AS DOUBLE) * value + CASE previous_no WHEN 0 THEN CAST({w[2]} AS DOUBLE) WHEN 1 THEN CAST({w[3]} AS DOUBLE) ELSE CAST({w[4]} AS DOUBLE) END + CAST({w[6]} AS DOUBLE)"


_COLUMNS = {"value": "value", "previous_0": "CASE WHEN previous_no = 0 THEN 1.0 ELSE 0.0 END", "previous_1": "CASE WHEN previous_no = 1 THEN 1.0 ELSE 0.0 END", "previous_2": "CASE WHEN previous_no = 2 THEN 1.0 ELSE 0.0 END", "one": "1.0"}
_PLACES = {"value": 0, "previous_0": 2, "previous_1": 3, "previous_2": 4, "one": 6}


@query("clone_step", f"""WITH {FOLDED}, s AS (SELECT patient_id, value, previous_no, action_no, {', '.join(f'{_score(a)} AS s{a}' for a in range(3))} FROM traj),
e AS (SELECT *, exp(s0 - greatest(s0, s1, s2)) AS e0, exp(s1 - greatest(s0, s1, s2)) AS e1, exp(s2 - greatest(s0, s1, s2)) AS e2 FROM s),
q AS (SELECT fold, previous_no, value, action_no, e0 / (e0 + e1 + e2) AS q0, e1 / (e0 + e1 + e2) AS q1, e2 / (e0 + e1 + e2) AS q2 FROM e JOIN folds USING (patient_id)),
k AS (SELECT 0 AS held UNION ALL SELECT 1 UNION ALL SELECT 2), l AS (SELECT held, q.* FROM q, k WHERE fold <> held),
{', '.join(f"f_{n} AS (SELECT held, unnest([0, 1, 2]) AS action_no, unnest([{', '.join(f'sum(({c}) * (q{a} - CASE WHEN action_no = {a} THEN 1 ELSE 0 END))' for a in range(3))}]) AS gradient, unnest([{', '.join(f'sum(({c}) * ({c}) * q{a} * (1 - q{a}))' for a in range(3))}]) AS curvature FROM l GROUP BY held)" for n, c in _COLUMNS.items())},
loss AS (SELECT held, sum(-ln(CASE action_no WHEN 0 THEN q0 WHEN 1 THEN q1 ELSE q2 END)) AS loss FROM l GROUP BY 1)
{' UNION ALL '.join(f"SELECT held AS held_out, '{n}' AS feature, action_no, round(CAST(gradient AS DOUBLE), 4) AS gradient, round(CAST(curvature AS DOUBLE), 4) AS curvature, round(loss, 4) AS loss FROM f_{n} JOIN loss USING (held)" for n in _COLUMNS)}""".replace("WITH ", "WITH RECURSIVE ", 1), places=4)
def clone_step(spark, sf_dir):
    """Loss, gradient and diagonal curvature of the policy that imitates the log, at fixed weights, for the complements of three folds in one job."""
    df = logged(spark, sf_dir)
    placed = df.join(L.folds(df, 3), EPISODE)
    design = L.raw_design(df, NUMERIC, CATEGORICAL)
    rows = L.prepared(placed, design, "action_no", [], *L.fold_marks(F.col("fold"), 3))
    found = L.newton_sums(rows, design, 3, range(3), [START] * 3)
    out = [(s, n, a, float(g[j, a]), float(h[a, a, j, j]), loss) for s, (loss, g, h) in enumerate(found) for n, j in _PLACES.items() for a in range(3)]
    return spark.createDataFrame(out, "held_out int, feature string, action_no int, gradient double, curvature double, loss double")


@query("clone_fit", None)
def clone_fit(spark, sf_dir):
    """What the fitted imitation of the log says of every row."""
    df = logged(spark, sf_dir)
    out = L.with_probabilities(df, [L.fit_clone(df, NUMERIC, CATEGORICAL, "action_no", 1.0)], F.lit(0), "p")
    return out.select(EPISODE, STEP, *[F.col("p")[a].alias(f"p{a}") for a in range(3)])


@query("clone_selection", None)
def clone_selection(spark, sf_dir):
    """Held-out loss of every penalty over three folds of episodes, and which is chosen."""
    best, losses = L.choose_penalty(logged(spark, sf_dir), NUMERIC, CATEGORICAL, "action_no", GRID, 3)
    return spark.createDataFrame([(c, loss, c == best) for c, loss in losses.items()], "c double, loss double, chosen boolean")


@query("propensity", None)
def propensity(spark, sf_dir):
    """The behaviour's calibrated probabilities of every row."""
    df = logged(spark, sf_dir)
    model, _ = L.fit_propensity(df, NUMERIC, CATEGORICAL, "action_no", GRID, 3)
    out = L.with_probabilities(df, [model], F.lit(0), "p")
    return out.select(EPISODE, STEP, *[F.col("p")[a].alias(f"b{a}") for a in range(3)])


@query("out_of_fold", None)
def out_of_fold(spark, sf_dir):
    """How well out-of-fold probabilities agree with the log: log loss, Brier score, calibration error, accuracy."""
    return D.calibration(L.out_of_fold(logged(spark, sf_dir), NUMERIC, CATEGORICAL, "action_no", (0.1, 1.0), 3), "behavior", "action_no")


# ---- boosted values and the teacher --------------------------------------------


@query("fqe_boosted", None)
def fqe_boosted(spark, sf_dir):
    """Fitted Q by boosted trees: state, previous action and action; a few small trees a step."""
    rows = steps(spark, sf_dir).select(EPISODE, STEP, "action_no", "reward", "terminal", "target", F.array("value", F.col("previous_no").cast("double")).alias("features"))
    out = B.boosted_values(by_step(rows), "features", "action_no", "reward", "target", HORIZON, 2, config=B.BoostConfig(3, 0.3, 5, 20))
    return out.select(EPISODE, STEP, *[F.col("q")[a].alias(f"q{a}") for a in range(3)], "v")


def teacher_sql(horizon: int = HORIZON, alpha: float = 5.0) -> str:
    """Each of three folds held out: its models are ridges over the other folds' rows, solved by elimination, a chain of next values for each."""
    parts = [f"""rr AS MATERIALIZED (SELECT patient_id, time_step, reward, terminal, p0, p1, p2, fold, held, value / 100 AS x,
 list_concat([value / 100], [CASE WHEN action_no = a THEN 1.0 ELSE 0.0 END::DOUBLE FOR a IN [0, 1, 2]], [CASE WHEN action_no = a THEN value / 100 ELSE 0.0 END FOR a IN [0, 1, 2]]) AS f FROM traj JOIN folds USING (patient_id), (SELECT unnest([0, 1, 2]) AS held))"""]
    for t in range(horizon - 1, -1, -1):
        last = t == horizon - 1
        ahead = "" if last else f"LEFT JOIN v{t + 1} n ON n.patient_id = r.patient_id AND n.held = r.held"
        follow = "0" if last else "CASE WHEN r.terminal = 1 THEN 0 ELSE coalesce(n.v, 0) END"
        parts.append(f"y{t} AS MATERIALIZED (SELECT r.*, r.reward + {follow} AS y FROM rr r {ahead} WHERE r.time_step = {t})")
        parts.append(f"g{t} AS MATERIALIZED (SELECT held, i, j, sum(f[i] * f[j]) - count(*) * avg(f[i]) * avg(f[j]) + CASE WHEN i = j THEN {alpha} ELSE 0 END AS a FROM y{t}, range(1, 8) q(i), range(1, 8) s(j) WHERE fold <> held GROUP BY held, i, j)")
        parts.append(f"c{t} AS MATERIALIZED (SELECT held, i, sum(f[i] * y) - count(*) * avg(f[i]) * avg(y) AS c, avg(f[i]) AS m, avg(y) AS my FROM y{t}, range(1, 8) q(i) WHERE fold <> held GROUP BY held, i)")
        parts.append(f"m{t}_0 AS MATERIALIZED (SELECT held, i, list_concat(list(a ORDER BY j), [max(c)]) AS r FROM g{t} JOIN c{t} USING (held, i) GROUP BY held, i)")
        parts += [f"m{t}_{k} AS MATERIALIZED (SELECT m.held, m.i, CASE WHEN m.i = {k} THEN [x / p.r[{k}] FOR x IN p.r] ELSE [m.r[j] - m.r[{k}] / p.r[{k}] * p.r[j] FOR j IN range(1, 9)] END AS r FROM m{t}_{k - 1} m JOIN (SELECT held, r FROM m{t}_{k - 1} WHERE i = {k}) p USING (held))" for k in range(1, 8)]
        parts.append(f"w{t} AS MATERIALIZED (SELECT held, list(r[8] ORDER BY i) AS w, max(my) - sum(m * r[8]) AS b FROM m{t}_7 JOIN c{t} USING (held, i) GROUP BY held)")
        q = [f"(b + w[1] * x + w[{2 + a}] + w[{5 + a}] * x)" for a in range(3)]
        parts.append(f"v{t} AS MATERIALIZED (SELECT patient_id, time_step, fold, held, {', '.join(f'{e} AS q{a}' for a, e in enumerate(q))}, {' + '.join(f'p{a} * {e}' for a, e in enumerate(q))} AS v FROM y{t} JOIN w{t} USING (held))")
    every = " UNION ALL ".join(f"SELECT * FROM v{t} WHERE fold = held" for t in range(horizon))
    return f"WITH RECURSIVE {FOLDED}, " + ",\n".join(parts) + f" SELECT patient_id, time_step, {', '.join(f'round(q{a} - v, 5) AS a{a}' for a in range(3))} FROM ({every})"


@query("teacher_advantages", teacher_sql(), places=5)
def teacher_advantages(spark, sf_dir):
    """Centred advantages of every row from ridges that left its fold out, all folds in the same passes."""
    rows = settled(steps(spark, sf_dir))
    rows = by_step(rows.join(L.folds(rows, 3), EPISODE).withColumn("features", F.array(F.col("value") / 100)))
    out = held_out_values(rows, "features", "action_no", "reward", "target", "fold", 3, HORIZON, 1)
    return out.select(EPISODE, STEP, *[F.col("advantage")[a].alias(f"a{a}") for a in range(3)])
