"""Registered queries over policies, estimates, inference and the published example, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import expressions as X
from .operators import diagnostics as D
from .operators import fqe as Q
from .operators import gates as G
from .operators import inference as I
from .operators import policies as P
from .operators import sdr as S
from .operators import support as U
from .operators.features import fitted_features, ridge_columns, smoothing_losses
from .plans import evaluate as E
from .plans import roles as R
from .plans.scaled import evaluate_scaled
from .queries import user, CAPS, CELLS, CLINICAL, DRAWS_SQL, FOLDED, PROP, Q_SQL, RESAMPLES, ROLES_SQL, SQL, TRAJ, WEIGHTED, clinical, episodes, query, rerank_sql, split, steps, tabular_sql, with_behavior, with_cells, with_draws, with_values
from .schema import ACTION, ACTIONS, EPISODE, STEP
from .sources.events import HORIZON, action_name
from .sources.files import scratch, settled
from .sources.synthetic import generate
from .streaming.episodes import replayed
from .streaming.replay import transitions

CHOSEN = {"base_temperature": 2.0, "advantage_weight": 0.5, "support_weight": 1.0}


@query("constant_policy", f"WITH {TRAJ} SELECT time_step, round(avg(CASE WHEN action_no = 0 THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS logged, CAST(1 AS DOUBLE) AS p0, CAST(0 AS DOUBLE) AS p1, CAST(0 AS DOUBLE) AS p2 FROM traj GROUP BY 1")
def constant_policy(spark, sf_dir):
    rows = steps(spark, sf_dir).withColumn("p", P.Constant().column())
    return rows.groupBy(STEP).agg(F.avg(X.gather(F.col("p"), F.col("action_no"))).alias("logged"), *[F.avg(F.col("p")[i]).alias(f"p{i}") for i in range(3)])


@query("variant_parameters", "SELECT * FROM (VALUES " + ", ".join(f"('{v}', CAST({2.0 if t else 1.0} AS DOUBLE), CAST({0.5 if a else 0.0} AS DOUBLE), CAST({1.0 if s else 0.0} AS DOUBLE), CAST({w} AS DOUBLE))" for v, t, a, s, w in (
    ("zero_shot", 0, 0, 0, 1.0), ("temperature_only", 1, 0, 0, 1.0), ("support_only", 0, 0, 1, 1.0), ("value_only", 0, 1, 0, 1.0), ("value_plus_support", 1, 1, 1, 1.0), ("behavior_blend_25", 1, 1, 1, 0.25),
    ("behavior_blend_50", 1, 1, 1, 0.5), ("behavior_blend_75", 1, 1, 1, 0.75))) + ") t(variant, temperature, advantage, support, weight)")
def variant_parameters(spark, sf_dir):
    rows = [(v, *P.variant_parameters(v, CHOSEN).values(), P.BLENDS.get(v, 1.0)) for v in P.VARIANTS]
    return spark.createDataFrame(rows, "variant string, temperature double, advantage double, support double, weight double")


def improved_sql() -> str:
    parts = []
    for v, (t, a, s) in P.VARIANTS.items():
        if v == "zero_shot":
            parts.append(f"SELECT '{v}' AS variant, time_step, p0, p1, p2 FROM act")
            continue
        w = P.BLENDS.get(v, 1.0)
        blended = ", ".join(f"{w} * e{i} / (e0 + e1 + e2) + {1 - w} * b{i} AS p{i}" for i in range(3))
        parts.append(f"SELECT '{v}' AS variant, time_step, {blended} FROM (SELECT *, exp(x0 - greatest(x0, x1, x2)) AS e0, exp(x1 - greatest(x0, x1, x2)) AS e1, exp(x2 - greatest(x0, x1, x2)) AS e2 FROM "
                     f"(SELECT time_step, b0, b1, b2, {rerank_sql(2.0 if t else 1.0, 0.5 if a else 0.0, 1.0 if s else 0.0, 0)} FROM act))")
    return f"WITH {Q_SQL}, every AS ({' UNION ALL '.join(parts)}) SELECT variant, time_step, round(avg(p0), 6) AS p0, round(avg(p1), 6) AS p1, round(avg(p2), 6) AS p2 FROM every GROUP BY 1, 2"


@query("improved_policy", improved_sql())
def improved_policy(spark, sf_dir):
    """Mean probabilities of every variant of the improved policy, by step."""
    rows, out = with_values(spark, sf_dir), None
    for v in P.VARIANTS:
        p = P.improved(F.col("target"), F.col("values"), F.col("behavior"), v, CHOSEN, scale=0.75, floor=0.3)
        part = rows.select(F.lit(v).alias("variant"), STEP, p.alias("p")).groupBy("variant", STEP).agg(*[F.avg(F.col("p")[i]).alias(f"p{i}") for i in range(3)])
        out = part if out is None else out.unionByName(part)
    return out


@query("normalized_vectors", f"WITH {TRAJ} SELECT patient_id, time_step, round(value / (value + 1 + abs(dvalue)), 6) AS n0, round(1 / (value + 1 + abs(dvalue)), 6) AS n1, round(abs(dvalue) / (value + 1 + abs(dvalue)), 6) AS n2 FROM traj")
def normalized_vectors(spark, sf_dir):
    return steps(spark, sf_dir).select(EPISODE, STEP, X.normalized(F.array(F.col("value"), F.lit(1.0), F.abs("dvalue"))).alias("n")).select(EPISODE, STEP, *split("n", "n"))


@query("ridge_design", f"WITH {TRAJ} SELECT time_step, round(sum(value / 100), 6) AS d0, {', '.join(f'round(CAST(sum(CASE WHEN action_no = {a} THEN 1 ELSE 0 END) AS DOUBLE), 6) AS d{a + 1}' for a in range(3))}, {', '.join(f'round(sum(CASE WHEN action_no = {a} THEN value / 100 ELSE 0 END), 6) AS d{a + 4}' for a in range(3))} FROM traj GROUP BY 1")
def ridge_design(spark, sf_dir):
    columns = Q.design([F.col("value") / 100], F.col("action_no"))
    return steps(spark, sf_dir).groupBy(STEP).agg(*[F.sum(c).alias(f"d{i}") for i, c in enumerate(columns)])


def discounted_sql(gamma: float) -> str:
    discount = f"CASE WHEN time_step = 0 THEN 1 ELSE power(CAST({gamma} AS DOUBLE), time_step) END"
    value = f"max(CASE WHEN time_step = 0 THEN v END) + sum({discount} * exp(least(log_w, ln(CAST(10 AS DOUBLE)))) * (reward + CASE WHEN terminal = 1 THEN 0 ELSE {gamma} * v_next END - q))"
    return f"SELECT CAST({gamma} AS DOUBLE) AS gamma, avg(x) AS m, stddev_samp(x) AS s FROM (SELECT patient_id, {value} AS x FROM dr GROUP BY 1)"


@query("discounted_sdr", f"WITH {CELLS}, e AS ({' UNION ALL '.join(map(discounted_sql, (0.0, 0.9, 1.0)))}) SELECT gamma, round(m, 6) AS cap_10, round(s, 6) AS deviation FROM e")
def discounted_sdr(spark, sf_dir):
    """Capped estimates under several discounts; at 0 the first step alone counts."""
    rows, out = with_cells(spark, sf_dir), None
    for gamma in (0.0, 0.9, 1.0):
        part = S.sequential_dr(rows, (10.0,), gamma, check=False)[1].agg(F.lit(gamma).alias("gamma"), F.avg("value_cap_10").alias("cap_10"), F.stddev_samp("value_cap_10").alias("deviation"))
        out = part if out is None else out.unionByName(part)
    return out


# ---- support ---------------------------------------------------------------------


@query("weight_report", f"""WITH {WEIGHTED}, z AS (SELECT time_step, CASE WHEN CAST(patient_id AS BIGINT) % 9 = 0 THEN '-inf'::DOUBLE WHEN CAST(patient_id AS BIGINT) % 50 = 1 AND time_step = 11 THEN 1000 ELSE log_w END AS l FROM lw),
f AS (SELECT time_step, {', '.join(f'quantile_cont(l, {q}) AS log_p{round(q * 100)}' for q in U.QUANTILES)}, max(l) AS log_max FROM z WHERE NOT isinf(l) GROUP BY 1), w AS (SELECT time_step, CASE WHEN l > 709.782712893384 THEN 'inf'::DOUBLE WHEN isinf(l) THEN 0 ELSE exp(l) END AS w FROM z),
g AS (SELECT time_step, {', '.join(f'quantile_cont(w, {q}) AS p{round(q * 100)}' for q in U.QUANTILES)}, max(w) AS top FROM w WHERE NOT isinf(w) GROUP BY 1),
o AS (SELECT time_step, sum(CASE WHEN l > 709.782712893384 THEN 1 ELSE 0 END)::BIGINT AS overflow_count, avg(CASE WHEN isinf(l) THEN 1.0 ELSE 0.0 END)::DOUBLE AS zero_fraction FROM z GROUP BY 1)
SELECT time_step, overflow_count, round(zero_fraction, 6) AS zero_fraction, {', '.join(f'round(log_p{round(q * 100)}, 6) AS log_p{round(q * 100)}' for q in U.QUANTILES)}, round(log_max, 6) AS log_max,
 {', '.join(f'round(CASE WHEN overflow_count = 0 THEN p{round(q * 100)} END, 6) AS p{round(q * 100)}' for q in U.QUANTILES)}, round(CASE WHEN overflow_count = 0 THEN top END, 6) AS max, overflow_count = 0 AS linear_scale_valid FROM o JOIN f USING (time_step) JOIN g USING (time_step)""")
def weight_report(spark, sf_dir):
    """All of a weight summary, with zero and overflowing weights planted."""
    lw = F.when(user() % 9 == 0, -float("inf")).when((user() % 50 == 1) & (F.col(STEP) == 11), 1000.0).otherwise(F.col("log_w"))
    return U.weight_summary(S.cumulative_weights(with_behavior(spark, sf_dir), ()).withColumn("log_w", lw), "log_w", [STEP])


@query("ratio_quantiles", f"WITH {PROP} SELECT {', '.join(f'round(quantile_cont(pa / ba, {q}), 6) AS p{round(q * 100)}' for q in U.QUANTILES)}, round(max(pa / ba), 6) AS max FROM prop")
def ratio_quantiles(spark, sf_dir):
    rows = with_behavior(spark, sf_dir).withColumn("map_mm_hg", F.col("value"))
    return U.support_report(rows, (10.0,))["ratios"]


# ---- gates, verdict, stress --------------------------------------------------------

FAILING = ("nothing", "schema", "fallback", "overlap", "low_mass", "ess", "share")
GATE_NAMES = ("gate_schema", "gate_fallback", "gate_overlap", "gate_low_mass", "gate_ess", "gate_share")


@query("gate_matrix", f"""WITH {PROP}, m AS (SELECT avg(least(p0,b0) + least(p1,b1) + least(p2,b2)) AS o FROM prop), c AS (SELECT unnest({list(FAILING)}) AS failing)
SELECT failing, failing <> 'schema' AS gate_schema, failing <> 'fallback' AS gate_fallback, CASE WHEN failing = 'overlap' THEN o - 0.6 ELSE o END >= 0.5 AS gate_overlap, failing <> 'low_mass' AS gate_low_mass, failing <> 'ess' AS gate_ess, failing <> 'share' AS gate_share,
 failing = 'nothing' AND o >= 0.5 AS eligible FROM c, m""")
def gate_matrix(spark, sf_dir):
    """Each gate fails on its own."""
    overlap = U.state_support(with_behavior(spark, sf_dir), thresholds=(0.01,)).select(F.col("mean_overlap").alias("o"))
    rows = spark.createDataFrame([(f,) for f in FAILING], "failing string").join(F.broadcast(overlap))  # one row
    f = F.col("failing")
    metrics = rows.withColumns({"schema_pass": f != "schema", "fallback_rate": F.when(f == "fallback", 0.03).otherwise(0.02), "overlap": F.when(f == "overlap", F.col("o") - 0.6).otherwise(F.col("o")),
                                "low_mass": F.when(f == "low_mass", 0.06).otherwise(0.05), "ess": F.when(f == "ess", None).otherwise(10.0), "share": F.when(f == "share", 0.21).otherwise(0.2)})
    return G.eligibility(metrics).select("failing", *GATE_NAMES, "eligible")


#: scenario: eligible policies, means under the primary and the alternative reward and under the other learner, and the least simultaneous lower bound of the winner.
SCENARIOS = {
    "robust": (("a", "b"), (3.0, 1.0), (3.0, 1.0), (2.8, 1.0), 0.5), "nobody": ((), (3.0, 1.0), (3.0, 1.0), (2.8, 1.0), 0.5), "one": (("a",), (3.0, 1.0), (3.0, 1.0), (2.8, 1.0), 0.5),
    "bound": (("a", "b"), (3.0, 1.0), (3.0, 1.0), (2.8, 1.0), -0.1), "reward": (("a", "b"), (3.0, 1.0), (1.0, 3.0), (2.8, 1.0), 0.5), "learner": (("a", "b"), (3.0, 1.0), (3.0, 1.0), (0.5, 1.0), 0.5),
    "small": (("a", "b"), (3.0, 2.9), (3.0, 2.9), (3.5, 2.9), 0.5), "other": (("b",), (3.0, 1.0), (3.0, 1.0), (2.8, 1.0), 0.5),
}


@query("winner_verdict", "WITH s(scenario, ea, eb, pa, pb, aa, ab, la, lb, low) AS (VALUES " + ", ".join(f"('{n}', {str('a' in e).lower()}, {str('b' in e).lower()}, {', '.join(f'CAST({x} AS DOUBLE)' for x in (*p, *a, *o, low))})" for n, (e, p, a, o, low) in SCENARIOS.items()) + """)
SELECT scenario, CASE WHEN NOT ea AND NOT eb THEN NULL WHEN ea AND (NOT eb OR pa >= pb) THEN 'a' ELSE 'b' END AS winner, CASE WHEN NOT ea AND NOT eb THEN 'no eligible policy'
 WHEN ea AND eb AND low > 0 AND (pa >= pb) = (aa >= ab) AND (pa >= pb) = (la >= lb) AND abs(pa - pb) > abs((pa - pb) - (la - lb)) THEN 'robust winner' ELSE 'highest point estimate; no robust winner' END AS status FROM s""")
def winner_verdict(spark, sf_dir):
    out = []
    for name, (eligible, primary, alternative, other, low) in SCENARIOS.items():
        means = [dict(zip("ab", m)) for m in (primary, alternative, other)]
        intervals = [{"estimator": e, "left_policy": a, "right_policy": b, "low": low} for e in ("direct", "sdr") for a, b in (("a", "b"), ("b", "a"))]
        found = G.verdict(["a", "b"], list(eligible), *means, intervals, ["direct", "sdr"])
        out.append((name, found["winner"], found["status"]))
    return spark.createDataFrame(out, "scenario string, winner string, status string")


@query("stress_grid", f"""WITH {CELLS}, v AS (SELECT unnest(['direct', 'direct', 'sdr', 'sdr']) AS estimator, unnest(['always_maintain', 'llm_improved', 'always_maintain', 'llm_improved']) AS policy, unnest([0, 1, 0, 1]) AS no, unnest([factual, v0, factual, value_cap_10]) AS x FROM episode),
r AS (SELECT 'plain' AS reward, * FROM v UNION ALL SELECT 'turned', estimator, policy, no, -x FROM v), m AS (SELECT reward, estimator, policy, no, avg(x) AS mean FROM r GROUP BY 1, 2, 3, 4)
SELECT reward, 'cells' AS learner, estimator, string_agg(policy, ',' ORDER BY -mean, no) AS ranking, round(max(CASE WHEN policy = 'llm_improved' THEN mean END) - max(CASE WHEN policy = 'always_maintain' THEN mean END), 6) AS improved_minus_maintain FROM m GROUP BY 1, 3""")
def stress_grid(spark, sf_dir):
    item = lambda e, p, n, c: F.struct(F.lit(e).alias("estimator"), F.lit(p).alias("policy"), F.lit(n).alias("policy_no"), F.col(c).alias("x"))
    cells = F.array(item("direct", "always_maintain", 0, "factual"), item("direct", "llm_improved", 1, "v0"), item("sdr", "always_maintain", 0, "factual"), item("sdr", "llm_improved", 1, "value_cap_10"))
    rows = episodes(spark, sf_dir).select(F.explode(cells).alias("c")).select("c.*")
    signs = F.explode(F.array(F.struct(F.lit("plain").alias("reward"), F.col("x").alias("value")), F.struct(F.lit("turned").alias("reward"), (-F.col("x")).alias("value"))))
    values = rows.select("estimator", "policy", "policy_no", F.lit("cells").alias("learner"), signs.alias("s")).select("estimator", "policy", "policy_no", "learner", "s.*")
    return G.stress_grid(values).withColumn("ranking", F.array_join("ranking", ","))


# ---- inference ----------------------------------------------------------------------


@query("direct_sdr_gaps", f"""WITH {CELLS}, {DRAWS_SQL}, s AS (SELECT b, {', '.join(f'avg(value_cap_{c:g} - v0) AS g{c:g}' for c in CAPS)} FROM slots JOIN ix USING (idx) GROUP BY b), p AS (SELECT {', '.join(f'avg(value_cap_{c:g} - v0) AS p{c:g}' for c in CAPS)} FROM episode)
""" + " UNION ALL ".join(f"SELECT CAST({c} AS DOUBLE) AS cap, round(max(p{c:g}), 6) AS point, round(quantile_cont(g{c:g}, 0.025), 6) AS low, round(quantile_cont(g{c:g}, 0.975), 6) AS high, round(stddev_samp(g{c:g}), 6) AS standard_error FROM s, p" for c in CAPS))
def direct_sdr_gaps(spark, sf_dir):
    values, draws = with_draws(spark, sf_dir)
    out = None
    for c in CAPS:
        part = I.paired_gap(values, draws, f"value_{S.cap_name(c)}", "v0").select(F.lit(c).alias("cap"), "point", "low", "high", "standard_error")
        out = part if out is None else out.unionByName(part)
    return out


@query("bootstrap_samples", f"""WITH {CELLS}, {DRAWS_SQL}, s AS (SELECT b, avg(v0) AS v0, avg(value_cap_10) AS value_cap_10, avg(factual) AS factual FROM slots JOIN ix USING (idx) GROUP BY b),
l AS (SELECT b, unnest(['v0', 'value_cap_10', 'factual']) AS policy, unnest([v0, value_cap_10, factual]) AS value, unnest([v0 - factual, value_cap_10 - factual, 0]) AS difference FROM s)
SELECT b::BIGINT AS b, policy, round(value, 6) AS value, round(difference, 6) AS difference FROM l""")
def bootstrap_samples(spark, sf_dir):
    values, draws = with_draws(spark, sf_dir)
    return I.bootstrap_samples(values, draws, ["v0", "value_cap_10", "factual"], "factual")


@query("summary_intervals", f"""WITH {CELLS}, {DRAWS_SQL}, s AS (SELECT b, avg(v0) AS v0, avg(value_cap_10) AS value_cap_10 FROM slots JOIN ix USING (idx) GROUP BY b), l AS (SELECT unnest(['v0', 'value_cap_10']) AS policy, unnest([v0, value_cap_10]) AS v FROM s)
SELECT policy, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high, round(quantile_cont(v, 0.025) / 12, 6) AS low_per_decision, round(quantile_cont(v, 0.975) / 12, 6) AS high_per_decision FROM l GROUP BY 1""")
def summary_intervals(spark, sf_dir):
    values, draws = with_draws(spark, sf_dir)
    return I.summarised(I.bootstrap_samples(values, draws, ["v0", "value_cap_10"], "v0"), HORIZON)


RAW = """SELECT '{name}' AS baseline, 'factual' AS policy, true AS available, CAST(1 AS DOUBLE) AS finite_fraction, round(mf, 6) AS mean, {d0} AS difference, round(lf, 6) AS low FROM f, q UNION ALL
 SELECT '{name}', 'raw', true, 1, round(mr, 6), {d1}, round(lr, 6) FROM f, q UNION ALL SELECT '{name}', 'exploding', false, round((n - x) / n, 6), NULL, NULL, NULL FROM f"""


@query("raw_availability", f"""WITH {CELLS}, {DRAWS_SQL}, f AS (SELECT avg(factual) AS mf, avg(raw) AS mr, count(*)::DOUBLE AS n, sum(CASE WHEN CAST(patient_id AS BIGINT) % 5 = 0 THEN 1 ELSE 0 END)::DOUBLE AS x FROM episode),
s AS (SELECT b, avg(factual) AS sf, avg(raw) AS sr FROM slots JOIN ix USING (idx) GROUP BY b), q AS (SELECT quantile_cont(sf, 0.025) AS lf, quantile_cont(sr, 0.025) AS lr FROM s)
{RAW.format(name='factual', d0='CAST(0 AS DOUBLE)', d1='round(mr - mf, 6)')} UNION ALL {RAW.format(name='exploding', d0='NULL', d1='NULL')}""")
def raw_availability(spark, sf_dir):
    """Unclipped estimates: one of the policies has infinite values and isn't clipped; as baseline it takes the differences with it."""
    values, draws = with_draws(spark, sf_dir)
    wide = values.select("idx", "factual", "raw", F.when(user() % 5 == 0, float("inf")).otherwise(F.col("raw")).alias("exploding"))
    out = None
    for baseline in ("factual", "exploding"):
        part = I.raw_availability(wide, draws, ["factual", "raw", "exploding"], baseline).select(F.lit(baseline).alias("baseline"), "policy", "available", "finite_fraction", "mean", "difference", "low")
        out = part if out is None else out.unionByName(part)
    return out


@query("directed_contrasts", f"""WITH m AS ({SQL['max_t']}) SELECT left_policy, right_policy, point, low, high FROM m UNION ALL SELECT right_policy, left_policy, -point, -high, -low FROM m""")
def directed_contrasts(spark, sf_dir):
    values, draws = with_draws(spark, sf_dir)
    wide = values.select("idx", F.col("value_cap_10").alias("total_capped"), F.col("v0").alias("total_direct"), F.col("factual").alias("total_factual"))
    return I.directed(I.max_t(wide, draws, ["capped", "direct", "factual"], ["total"])).select("left_policy", "right_policy", "point", "low", "high")


@query("block_bootstrap", None)
def block_bootstrap(spark, sf_dir):
    """Resampled means without a row per draw; multinomial draws by numpy, so SQL can't repeat them. Its test holds them against the exact moments."""
    values = I.indexed(episodes(spark, sf_dir), EPISODE)
    sums = I.block_sums(values, ["v0", "value_cap_10"], RESAMPLES, 16)
    return sums.select("b", (F.col("v0") / F.col("m")).alias("v0"), (F.col("value_cap_10") / F.col("m")).alias("value_cap_10"))


# ---- controls, calibration, replay ----------------------------------------------------


@query("every_control", f"""WITH {PROP}, m AS (SELECT avg(CASE WHEN action_no = 0 THEN 1 ELSE 0 END) AS m0, avg(CASE WHEN action_no = 1 THEN 1 ELSE 0 END) AS m1, avg(CASE WHEN action_no = 2 THEN 1 ELSE 0 END) AS m2 FROM traj),
i AS (SELECT *, row_number() OVER (ORDER BY patient_id, time_step) AS i FROM prop), j AS (SELECT p0 AS r0, p1 AS r1, p2 AS r2, row_number() OVER (ORDER BY sha256('91378:' || patient_id || ':' || time_step), patient_id, time_step) AS i FROM prop), x AS (SELECT * FROM i JOIN j USING (i)),
c AS (SELECT patient_id, time_step, ba, 'marginal' AS control, CASE action_no WHEN 0 THEN m0 WHEN 1 THEN m1 ELSE m2 END AS pa FROM x, m UNION ALL SELECT patient_id, time_step, ba, 'uniform', CAST(1 AS DOUBLE) / 3 FROM x
 UNION ALL SELECT patient_id, time_step, ba, 'uniform_base', 0.5 * CAST(1 AS DOUBLE) / 3 + 0.5 * ba FROM x UNION ALL SELECT patient_id, time_step, ba, 'permuted', CASE action_no WHEN 0 THEN r0 WHEN 1 THEN r1 ELSE r2 END FROM x),
l AS (SELECT control, time_step, sum(ln(pa) - ln(ba)) OVER (PARTITION BY control, patient_id ORDER BY time_step) AS l FROM c), t AS (SELECT control, max(l) AS m FROM l WHERE time_step = 11 GROUP BY 1)
SELECT control, round(sum(exp(l - m)) * sum(exp(l - m)) / sum(exp(l - m) * exp(l - m)), 6) AS ess, round(1 / sum(exp(l - m)), 6) AS max_share FROM l JOIN t USING (control) WHERE time_step = 11 GROUP BY 1""")
def every_control(spark, sf_dir):
    """Terminal weight concentration of all four controls."""
    rows = with_behavior(spark, sf_dir)
    share = D.action_marginal(rows, "action_no").first()
    third = F.array(*[F.lit(1 / 3)] * 3)
    permuted = I.permuted_rows(rows, [EPISODE, STEP], "target", 91378)
    out = None
    for name, table, p in (("marginal", rows, F.array(*[F.lit(share[f"share_{a}"]) for a in ACTIONS])), ("uniform", rows, third), ("uniform_base", rows, X.blend(third, F.col("behavior"), 0.5)), ("permuted", permuted, F.col("target"))):
        part = table.select(EPISODE, STEP, "behavior_logged", F.lit(name).alias("control"), X.gather(p, F.col("action_no")).alias("target_logged"))
        out = part if out is None else out.unionByName(part)
    return U.concentration(S.cumulative_weights(out, (), ["control"]).filter(F.col(STEP) == HORIZON - 1), "log_w", ["control"])


@query("calibration_predictors", f"""WITH {PROP}, m AS (SELECT avg(CASE WHEN action_no = 0 THEN 1 ELSE 0 END) AS m0, avg(CASE WHEN action_no = 1 THEN 1 ELSE 0 END) AS m1, avg(CASE WHEN action_no = 2 THEN 1 ELSE 0 END) AS m2 FROM traj),
v AS (SELECT action_no AS a, unnest(['base_zero_shot', 'improved_blend', 'behavior_anchor', 'training_marginal', 'uniform']) AS predictor, unnest([[p0, p1, p2], [p0 * 0.25 + b0 * 0.75, p1 * 0.25 + b1 * 0.75, p2 * 0.25 + b2 * 0.75], [b0, b1, b2], [m0, m1, m2], [CAST(1 AS DOUBLE) / 3, CAST(1 AS DOUBLE) / 3, CAST(1 AS DOUBLE) / 3]]) AS p FROM prop, m),
c AS (SELECT predictor, list_max(p) AS conf, CASE WHEN list_position(p, list_max(p)) - 1 = a THEN 1.0 ELSE 0.0 END AS hit, -ln(greatest(p[a + 1], 1e-15)) AS loss, (p[1] - CASE WHEN a = 0 THEN 1 ELSE 0 END)^2 + (p[2] - CASE WHEN a = 1 THEN 1 ELSE 0 END)^2 + (p[3] - CASE WHEN a = 2 THEN 1 ELSE 0 END)^2 AS brier FROM v),
b AS (SELECT predictor, least(floor(conf * 10), 9) AS bin, count(*) AS n, avg(conf) AS c, avg(hit) AS h FROM c GROUP BY 1, 2), e AS (SELECT predictor, sum(n * abs(h - c)) / sum(n) AS ece FROM b GROUP BY 1),
o AS (SELECT predictor, count(*)::BIGINT AS rows, avg(loss) AS log_loss, avg(brier) AS brier, avg(hit) AS accuracy, max(ece) AS ece FROM c JOIN e USING (predictor) GROUP BY 1), z AS (SELECT * FROM o UNION ALL SELECT 'base_before_blend', rows, log_loss, brier, accuracy, ece FROM o WHERE predictor = 'base_zero_shot')
SELECT predictor, rows, round(log_loss, 6) AS log_loss, round(brier, 6) AS brier, round(CAST(accuracy AS DOUBLE), 6) AS accuracy, round(CAST(ece AS DOUBLE), 6) AS ece FROM z""")
def calibration_predictors(spark, sf_dir):
    """How well six predictors agree with the log; the base taken out of the blend is the base again."""
    rows = with_behavior(spark, sf_dir)
    share = D.action_marginal(rows, "action_no").first()
    blend = X.blend(F.col("target"), F.col("behavior"), 0.25)
    base = X.normalized(F.array(*[F.greatest((p - b * 0.75) / 0.25, F.lit(0.0)) for p, b in zip(X.items(blend), X.items(F.col("behavior")))]))
    predictors = {"base_zero_shot": F.col("target"), "base_before_blend": base, "improved_blend": blend, "behavior_anchor": F.col("behavior"), "training_marginal": F.array(*[F.lit(share[f"share_{a}"]) for a in ACTIONS]), "uniform": F.array(*[F.lit(1 / 3)] * 3)}
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("predictor"), p.alias("p")) for n, p in predictors.items()]))
    return D.calibration(rows.select("action_no", each.alias("x")).select("action_no", "x.*"), "p", "action_no", ["predictor"])


def seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps(spark, sf_dir).select(EPISODE, STEP, F.col("value").alias("map_mm_hg"), (F.col("value") / 20).alias("lactate_mmol_l"))


@query("predictions", f"""WITH {TRAJ}, l AS (SELECT patient_id, time_step, CAST(0.5 AS DOUBLE) AS l0, (70 - value) / 15 AS l1, (value / 20 - 3) / 2 AS l2 FROM traj), e AS (SELECT *, exp(l0 - greatest(l0, l1, l2)) AS e0, exp(l1 - greatest(l0, l1, l2)) AS e1, exp(l2 - greatest(l0, l1, l2)) AS e2 FROM l)
SELECT patient_id, time_step, round(e0 / (e0 + e1 + e2), 6) AS prob_maintain, round(e1 / (e0 + e1 + e2), 6) AS prob_iv_fluids, round(e2 / (e0 + e1 + e2), 6) AS prob_escalate_vasopressor,
 ['maintain', 'iv_fluids', 'escalate_vasopressor'][list_position([l0, l1, l2], greatest(l0, l1, l2))] AS chosen_action, 'deterministic_synthetic_not_llm' AS policy_origin FROM e""")
def predictions(spark, sf_dir):
    return E.predictions(seen(spark, sf_dir), P.Analytic(), ["map_mm_hg", "lactate_mmol_l"])


@query("logged_replay", f"""WITH {CLINICAL}, r AS (SELECT c.*, terminal FROM clin c JOIN traj t USING (patient_id, time_step)) SELECT patient_id, time_step, round(value, 6) AS map_mm_hg, CASE action_no WHEN 0 THEN 'maintain' WHEN 1 THEN 'iv_fluids' ELSE 'escalate_vasopressor' END AS action,
 round(total_reward, 6) AS reward, round(lead(value) OVER (PARTITION BY patient_id ORDER BY time_step), 6) AS next_map_mm_hg, terminal = 1 AS terminated FROM r""")
def logged_replay(spark, sf_dir):
    rows = clinical(spark, sf_dir).join(steps(spark, sf_dir).select(EPISODE, STEP, "terminal"), [EPISODE, STEP])
    out = transitions(rows, ("map_mm_hg",))
    return out.select(EPISODE, STEP, F.col("observation.map_mm_hg").alias("map_mm_hg"), "action", "reward", F.col("next_observation.map_mm_hg").alias("next_map_mm_hg"), "terminated")


@query("streamed_replay", SQL["logged_replay"])
def streamed_replay(spark, sf_dir):
    """The same from a stream of files in which an episode's steps lie scattered: two files a batch, episodes as states."""
    rows = clinical(spark, sf_dir).join(steps(spark, sf_dir).select(EPISODE, STEP, "terminal"), [EPISODE, STEP])
    logged = rows.select(EPISODE, STEP, "map_mm_hg", ACTION, X.PRIMARY.total().alias("reward"), "terminal")
    folder = scratch(spark)
    logged.repartition(8, F.xxhash64(EPISODE, STEP)).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(logged.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    out = replayed(stream, ["map_mm_hg"], HORIZON)
    out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    done = spark.read.schema(out.schema).parquet(f"{folder}/out").filter("fault is null")
    return done.select(EPISODE, STEP, "map_mm_hg", F.col(ACTION).alias("action"), "reward", "next_map_mm_hg", "terminated")


CONFIGS = [({}, "none"), ({"improvement": {"selected_variant": "value_only"}}, "refused"), ({"improvement": {"selected_variant": "value_only", "selected_parameters": CHOSEN}}, "value_only"),
           ({"improvement": {"selected_variant": "unheard", "selected_parameters": CHOSEN}}, "refused"), ({"improvement": {"selected_parameters": CHOSEN}}, "refused"),
           ({"improvement": {"selected_variant": "value_only", "selected_parameters": CHOSEN | {"base_temperature": 0.0}}}, "refused")]


@query("model_selection", "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{v}')" for i, (_, v) in enumerate(CONFIGS)) + ") t(config, choice)")
def model_selection(spark, sf_dir):
    out = []
    for i, (config, _) in enumerate(CONFIGS):
        try:
            found = P.model_selection(config)
            out.append((i, found[0] if found else "none"))
        except ValueError:
            out.append((i, "refused"))
    return spark.createDataFrame(out, "config int, choice string")


# ---- learners --------------------------------------------------------------------------


@query("features", f"""WITH {TRAJ}, x AS (SELECT patient_id, time_step, CASE WHEN CAST(patient_id AS BIGINT) % 4 = 0 AND time_step % 5 = 0 THEN NULL ELSE value END AS v, CASE WHEN CAST(patient_id AS BIGINT) % 5 = 0 THEN NULL ELSE previous_no END AS c FROM traj),
m AS (SELECT median(v) AS m FROM x), l AS (SELECT c AS mode FROM x WHERE c IS NOT NULL GROUP BY c ORDER BY count(*) DESC, CASE c WHEN 0 THEN 'maintain' WHEN 1 THEN 'iv_fluids' ELSE 'escalate_vasopressor' END LIMIT 1),
f AS (SELECT *, coalesce(v, m) AS fv, CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS gap, coalesce(c, mode) AS fc FROM x, m, l), s AS (SELECT avg(fv) AS a, stddev_pop(fv) AS sd, avg(gap) AS ga, stddev_pop(gap) AS gs FROM f)
SELECT patient_id, time_step, round((fv - a) / sd, 6) AS v, round((gap - ga) / gs, 6) AS v_missing, CAST(fc = 2 AS DOUBLE) AS c_escalate_vasopressor, CAST(fc = 1 AS DOUBLE) AS c_iv_fluids, CAST(fc = 0 AS DOUBLE) AS c_maintain, CAST(c IS NULL AS DOUBLE) AS c_missing FROM f, s""")
def features(spark, sf_dir):
    """Gaps filled, scaled and encoded, with indicators of the gaps."""
    rows = steps(spark, sf_dir).select(EPISODE, STEP, F.when(~((user() % 4 == 0) & (F.col(STEP) % 5 == 0)), F.col("value")).alias("v"), F.when(user() % 5 != 0, action_name("previous_no")).alias("c"))
    return rows.select(EPISODE, STEP, *[e.alias(n) for n, e in fitted_features(rows, ["v"], ["c"], True).items()])


@query("distilled_advantages", f"""WITH {Q_SQL}, a AS (SELECT patient_id, time_step, value / 100 AS x, {', '.join(f'v{i} - (p0*v0 + p1*v1 + p2*v2) AS y{i}' for i in range(3))} FROM act), m AS (SELECT count(*) AS n, avg(x) AS mx, {', '.join(f'avg(y{i}) AS m{i}' for i in range(3))} FROM a),
w AS (SELECT max(mx) AS mx, {', '.join(f'(sum(x * y{i}) - max(n * mx * m{i})) / (sum(x * x) - max(n * mx * mx) + 5) AS w{i}, max(m{i}) AS m{i}' for i in range(3))} FROM a, m)
SELECT patient_id, time_step, {', '.join(f'round(m{i} + w{i} * (x - mx), 6) AS a{i}' for i in range(3))} FROM a, w""")
def distilled_advantages(spark, sf_dir):
    """A ridge from observations to three advantages, fitted by one aggregate."""
    rows = with_values(spark, sf_dir).withColumn("a", X.centered(F.col("values"), F.col("target")))
    out = ridge_columns(rows, [F.col("value") / 100], [F.col("a")[i] for i in range(3)], 5.0)
    return rows.select(EPISODE, STEP, *[c.alias(f"a{i}") for i, c in enumerate(out)])


GRID = (0.5, 1.0, 5.0, 50.0)


@query("smoothing_selection", f"""WITH RECURSIVE {FOLDED}, r AS (SELECT fold, previous_no AS c, action_no AS a, count(*) AS own FROM traj JOIN folds USING (patient_id) GROUP BY 1, 2, 3),
n AS (SELECT fold, c, sum(own) AS nc FROM r GROUP BY 1, 2), ta AS (SELECT c, a, sum(own) AS t FROM r GROUP BY 1, 2), tc AS (SELECT c, sum(own) AS tt FROM r GROUP BY 1), g AS (SELECT unnest([{', '.join(map(str, GRID))}]::DOUBLE[]) AS alpha),
l AS (SELECT alpha, fold, sum(-ln((t - own + alpha) / (tt - nc + 3 * alpha)) * own) / sum(own) AS l FROM r JOIN n USING (fold, c) JOIN ta USING (c, a) JOIN tc USING (c), g GROUP BY 1, 2), m AS (SELECT alpha, avg(l) AS loss FROM l GROUP BY 1)
SELECT alpha, round(loss, 6) AS loss, alpha = (SELECT alpha FROM m ORDER BY loss, alpha LIMIT 1) AS chosen FROM m""")
def smoothing_selection(spark, sf_dir):
    """Smoothing of a behaviour model by log loss over grouped folds; of equal ones the smaller."""
    rows = steps(spark, sf_dir)
    return smoothing_losses(rows, R.folds(rows, 3), "previous_no", "action_no", EPISODE, GRID)


# ---- training and validation together ---------------------------------------------------


@query("pooled_shortcut", f"""WITH {ROLES_SQL.replace(TRAJ, CLINICAL)}, pooled AS (SELECT c.*, role FROM clin c JOIN roles USING (patient_id)), g AS (SELECT count(*)::BIGINT AS rows, sum(CASE WHEN role = 'ope_nuisance' THEN 1 ELSE 0 END)::BIGINT AS second_rows, avg(CASE WHEN action_no = 2 THEN total_reward END) - avg(CASE WHEN action_no = 0 THEN total_reward END) AS gap FROM pooled)
SELECT rows, second_rows, round(gap, 6) AS reward_gap FROM g""")
def pooled_shortcut(spark, sf_dir):
    """The reward shortcut over two tables put together."""
    rows = clinical(spark, sf_dir)
    roles = R.training_roles(rows, 0.6, 41)
    first, second = (rows.join(roles.filter(F.col("role") == r), EPISODE, "left_semi") for r in (R.DEVELOPMENT, R.NUISANCE))
    both = D.reward_shortcut(first.unionByName(second), X.PRIMARY).filter("slice = 'all_rows'")
    return both.select("rows", F.lit(second.count()).cast("long").alias("second_rows"), "reward_gap")


# ---- at scale -------------------------------------------------------------------------------


def split_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nuisance rows to fit on, the other role's to estimate on."""
    rows = settled(with_behavior(spark, sf_dir))
    roles = settled(R.training_roles(rows, 0.6, 41))
    return tuple(rows.join(roles.filter(F.col("role") == r), EPISODE, "left_semi") for r in (R.NUISANCE, R.DEVELOPMENT))


def mild() -> F.Column:
    return X.blend(F.col("target"), F.array(*[F.lit(1 / 3)] * 3), 0.5)


def scaled_sql() -> str:
    parts, out = [], []
    for name, p in (("softmax", "p{i}"), ("mild", "(p{i} * 0.5 + CAST(1 AS DOUBLE) / 3 * 0.5)")):
        ps = ", ".join(f"{p.format(i=i)} AS p{i}" for i in range(3))
        rest = "patient_id, time_step, action_no, previous_no, reward, terminal, b0, b1, b2, ba"
        parts.append(f"{name}_all AS MATERIALIZED (SELECT {rest}, role, {ps} FROM prop JOIN roles USING (patient_id)), {name}_fit AS MATERIALIZED (SELECT * FROM {name}_all WHERE role = 'ope_nuisance')")
        parts.append(tabular_sql(f"{name}_q", "previous_no").replace("FROM cells r", f"FROM {name}_fit r"))
        cells = " UNION ALL ".join(f"SELECT {t} AS time_step, previous_no, q0, q1, q2 FROM {name}_q_c{t}" for t in range(HORIZON))
        parts.append(f"""{name}_c AS ({cells}), {name}_v AS (SELECT a.*, coalesce(CASE action_no WHEN 0 THEN q0 WHEN 1 THEN q1 ELSE q2 END, 0) AS q, p0 * coalesce(q0, 0) + p1 * coalesce(q1, 0) + p2 * coalesce(q2, 0) AS v, CASE action_no WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END AS pa
 FROM {name}_all a LEFT JOIN {name}_c USING (time_step, previous_no) WHERE role = 'policy_development'), {name}_w AS (SELECT *, coalesce(lead(v) OVER w, 0) AS v_next, sum(ln(pa) - ln(ba)) OVER (w ROWS UNBOUNDED PRECEDING) AS log_w FROM {name}_v WINDOW w AS (PARTITION BY patient_id ORDER BY time_step)),
{name}_e AS (SELECT patient_id, max(CASE WHEN time_step = 0 THEN v END) AS direct, max(CASE WHEN time_step = 0 THEN v END) + sum(exp(least(log_w, ln(CAST(10 AS DOUBLE)))) * (reward + CASE WHEN terminal = 1 THEN 0 ELSE v_next END - q)) AS sdr FROM {name}_w GROUP BY 1),
{name}_o AS (SELECT avg(least(p0, b0) + least(p1, b1) + least(p2, b2)) AS overlap FROM {name}_v)""")
        out.append(f"SELECT '{name}' AS policy, count(*)::BIGINT AS episodes, round(avg(direct), 6) AS direct, round(avg(sdr), 6) AS sdr, round(max(overlap), 6) AS overlap FROM {name}_e, {name}_o")
    return f"WITH {ROLES_SQL.replace(TRAJ, PROP)}, {', '.join(parts)} {' UNION ALL '.join(out)}"


@query("scaled_evaluation", scaled_sql())
def scaled_evaluation(spark, sf_dir):
    """Two policies evaluated without gathering rows: values fitted on one role, estimates on the other."""
    fit, valid = split_rows(spark, sf_dir)
    found = evaluate_scaled(fit, valid, {"softmax": F.col("target"), "mild": mild()}, "tabular", HORIZON, cell=["previous_no"], resamples=RESAMPLES, blocks=8)
    wide = found.summary.groupBy("policy", "episodes").pivot("estimator", ["direct", "sdr"]).agg(F.first("mean"))
    return wide.join(found.support.select("policy", "overlap"), "policy")


# ---- the published example -----------------------------------------------------------------

# Results published for the generated example, to three places.
PUBLISHED = [("always_maintain", -0.225, -0.350, -0.120, 0.078, False), ("behavior_clone", -0.134, -0.260, -0.020, -0.083, False), ("llm_zero_shot", -0.141, None, None, -0.063, False), ("llm_improved", -0.134, None, None, -0.113, False)]
ROLE_DIGEST = "ea87b42f8678e379256a911d78a42c49d34383463b888ed7b9082465d263712c"


@query("example_comparison", "SELECT * FROM (VALUES " + ", ".join(f"('{p}', CAST({d} AS DOUBLE), CAST({s} AS DOUBLE), {str(e).lower()})" for p, d, _, _, s, e in PUBLISHED) + ") t(policy, primary_fqe_total, primary_sdr_cap_10_total, eligible)", 3)
def example_comparison(spark, sf_dir):
    """Policies built and evaluated on the generated example, against its published results."""
    made = generate(spark, 41)
    policies, _ = E.build_policies(made["train"])
    result = E.evaluate_policies(made["train"], made["validation"], policies)
    return E.comparison(result).select("policy", "primary_fqe_total", "primary_sdr_cap_10_total", "eligible")


@query("example_roles", f"SELECT 36::BIGINT AS development, 24::BIGINT AS nuisance, '{ROLE_DIGEST}' AS checksum")
def example_roles(spark, sf_dir):
    return R.manifest(R.training_roles(generate(spark, 41)["train"], 0.6, 41))
