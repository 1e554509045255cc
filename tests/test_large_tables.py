"""Steps that must hold for tables of any size."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rolloutlab import queries  # noqa: F401  registers before the others
from rolloutlab import learner_queries, policy_queries
from rolloutlab.operators import boosted as B
from rolloutlab.operators import diagnostics as D
from rolloutlab.operators import fqe, quantiles
from rolloutlab.operators import logistic as L
from rolloutlab.operators.booster import BoostConfig, Booster
from rolloutlab.operators.digests import line_digest
from rolloutlab.schema import ACTION, EPISODE, STEP
from rolloutlab.sources.files import file_digests, probability_digest, write_csv
from rolloutlab.streaming import episodes


def test_probabilities_of_many_rows(spark):
    n = 2_000_001
    df = spark.range(n, numPartitions=8).select(F.lpad(F.col("id").cast("string"), 9, "0").alias(EPISODE), F.lit(0).alias(STEP), F.array(F.col("id") / 4, F.lit(0.5)).alias("p"))
    want = np.column_stack([np.arange(n) / 4, np.full(n, 0.5)]).astype("<f8")
    assert probability_digest(df.repartition(5), "p") == hashlib.sha256(want.tobytes()).hexdigest()
    assert probability_digest(df.limit(0), "p") == hashlib.sha256().hexdigest()
    with pytest.raises(Exception, match="no values"):
        probability_digest(df.limit(3).withColumn("p", F.when(F.col(EPISODE) > "000000000", F.col("p"))), "p")


def test_lines_of_many_rows(spark):
    n = 5_000_001
    df = spark.range(n, numPartitions=8).select(F.lpad(F.col("id").cast("string"), 9, "0").alias("k"))
    want = hashlib.sha256("\r\n".join(f"{i:09d}" for i in range(n)).encode()).hexdigest()
    found = line_digest(df, ["k"], F.col("k"), "\r\n").first()
    assert (found.digest, found.rows) == (want, n)


def test_lines_without_some(spark):
    df = spark.createDataFrame([("b", 1), (None, 2), ("a", 3), ("a", 1), ("", 0)], "k string, n int")
    found = line_digest(df, ["k"], F.concat("k", F.col("n").cast("string")), "; ").first()
    assert (found.digest, found.rows) == (hashlib.sha256(b"0; a1; a3; b1").hexdigest(), 5)
    assert line_digest(df.limit(0), ["k"], F.col("k"), ";").first()[:] == (hashlib.sha256().hexdigest(), 0)


def test_episodes_share_states(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(episodes, "LANES", 4, raising=False)
    kind = f"{EPISODE} string, {STEP} int, map_mm_hg double, {ACTION} string, reward double, terminal int"
    rows = [(f"e{e}", s, 60.0 + e + s / 3, "maintain", 0.1 * s, int(s == 3)) for e in range(300) for s in range(4)]
    np.random.default_rng(3).shuffle(rows)
    for i in range(3):
        spark.createDataFrame([(e, int(s), float(m), a, float(r), int(t)) for e, s, m, a, r, t in rows[i::3]], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = episodes.replayed(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), ["map_mm_hg"], 4)
    query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert len(query.recentProgress) >= 3 and query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4
    found = {(r[0], r[1]): (r.map_mm_hg, r.next_map_mm_hg, r.terminated, r.fault) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found == {(f"e{e}", s): (60.0 + e + s / 3, 60.0 + e + (s + 1) / 3 if s < 3 else None, s == 3, None) for e in range(300) for s in range(4)}


def test_quantiles_with_one_set_of_cuts(spark, monkeypatch):
    """Cuts that come out otherwise each time they are made, as those of a sketch merged in another order do."""
    values = np.random.default_rng(5).permutation(4000) / 4
    df = spark.createDataFrame([("a" if i % 3 else None, float(x)) for i, x in enumerate(values)], "g string, x double")
    real = quantiles.F.percentile_approx
    monkeypatch.setattr(quantiles.F, "percentile_approx", lambda *a: F.array_sort(F.transform(real(*a), lambda c: c + F.floor(F.rand() * 40))))
    named = {f"q{k}": k / 20 for k in range(21)}
    found = {r.g: r for r in quantiles.exact_quantiles(df.repartition(6), F.col("x"), ["g"], named).collect()}
    for g in ("a", None):
        own = [x for i, x in enumerate(values) if ("a" if i % 3 else None) == g]
        assert [found[g][n] for n in named] == pytest.approx(np.quantile(own, list(named.values())), abs=1e-9)
    monkeypatch.setattr(quantiles, "CUTS", 2)
    whole = quantiles.exact_quantiles(spark.createDataFrame([(x,) for x in (3.0, 1.0, 1.0, float("inf"), -float("inf"), -0.0)], "x double"), F.col("x"), [], {"m": 0.5, "t": 1.0}).first()
    assert whole.m == 1.0


@pytest.mark.parametrize("content", [b"a,b\r\n1,2\r\n\xff\xe9,3\n", b"a\rb\r\rc", b"a\r\n\r\n\nlast\r", b"one line", b"\n", b"x\n" * 5000 + b"y\r\n" * 5000])
def test_large_files_digest_the_same(spark, tmp_path, content):
    (tmp_path / "f.csv").write_bytes(content)
    want = hashlib.sha256(content.replace(b"\r\n", b"\n").replace(b"\r", b"\n")).hexdigest()
    for large in (0, 10**6):
        assert file_digests(spark, str(tmp_path / "f.csv"), large).first()["sha256"] == want


def test_csv_in_one_file_in_order(spark, tmp_path):
    rows = [(f"p{i % 7}", i, 'say "x", é' if i % 3 else None, i / 3) for i in range(500)]
    df = spark.createDataFrame(rows, f"{EPISODE} string, {STEP} int, note string, x double").repartition(6)
    for name, some in (("a", df), ("none", df.filter("x < 0"))):
        write_csv(some, str(tmp_path / name))
        some.coalesce(1).sortWithinPartitions(EPISODE, STEP).write.option("header", True).option("lineSep", "\r\n").csv(str(tmp_path / f"{name}_plain"))
        ours, plain = (list((tmp_path / n).glob("part-*")) for n in (name, f"{name}_plain"))
        assert len(ours) == 1 and ours[0].read_bytes() == plain[0].read_bytes()


def test_next_values_are_not_gathered(spark):
    rows = spark.createDataFrame([(f"e{i}", t, i % 3, 1.0, int(t == 1), [0.2, 0.3, 0.5]) for i in range(40) for t in range(2)], f"{EPISODE} string, {STEP} int, action_no int, reward double, terminal int, target array<double>")
    for out in (fqe.tabular(rows, ["action_no"], "action_no", "reward", "target", 2), fqe.distributed_ridge(rows.withColumn("f", F.array("reward")), "f", "action_no", "reward", ["target"], 2)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert f"BroadcastHashJoin [{EPISODE}" not in plan


def test_inputs_of_many_passes_are_written_once(spark, data):
    for df in (learner_queries.logged(spark, data), *policy_queries.split_rows(spark, data)):
        assert "Window" not in df._jdf.queryExecution().executedPlan().toString()


def test_scale_computes_values_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def values(i):
        seen.add(1)
        return [i / 7, -i / 3, None]

    found = D.robust_scale(spark.range(1000).select(values("id").alias("a")), "a").first()["scale"]
    x = np.concatenate([np.arange(1000) / 7, -np.arange(1000) / 3])
    assert found == pytest.approx(1.4826 * np.median(np.abs(x - np.median(x)))) and seen.value == 1000
    assert D.robust_scale(spark.createDataFrame([], "a array<double>"), "a").first()["scale"] == 0.05


def test_steps_are_read_apart(spark):
    rows = spark.createDataFrame([(t, f"e{e}", e / 3 + t) for e in range(9) for t in range(4)], f"{STEP} int, {EPISODE} string, x double")
    apart = fqe.by_step(rows)
    assert apart.schema == rows.schema and sorted(apart.collect()) == sorted(rows.collect())
    assert fqe.by_step(rows.limit(0)).count() == 0
    one = fqe.stage_rows(apart, 2)
    assert one.count() == 9 and {f"{STEP}=2" in r[0] for r in one.select(F.input_file_name()).collect()} == {True}


def test_boosted_passes(spark, monkeypatch):
    seen, n = spark.sparkContext.accumulator(0), 900

    @F.udf("array<double>")
    def features(i):
        seen.add(1)
        return [float(i % 50), None if i % 5 == 0 else float(i % 3), -0.0 if i % 2 else 0.0]

    cuts = B.bin_cuts(spark.range(n).select(features("id").alias("x")), "x", 3)
    assert [c.tolist() for c in cuts] == [[i + 0.5 for i in range(49)], [0.5, 1.5], []] and seen.value == n
    rows = spark.createDataFrame([([float(i % 50), float(i % 3)], float((i % 50) ** 2 + i % 3)) for i in range(n)], "x array<double>, y double")
    looks, look = [], B.histograms
    monkeypatch.setattr(B, "histograms", lambda *a: looks.append(a[-1]) or look(*a))
    model = B.fit_boosted(rows, "x", "y", 2, BoostConfig(3, 0.3, 2, 20))
    assert looks == [[0]] * 3
    table = rows.toPandas()
    x = np.stack(table["x"].to_list())
    assert np.allclose(model.predict(x), Booster(BoostConfig(3, 0.3, 2, 20)).fit(x, table["y"].to_numpy()).predict(x))


def test_equal_rows_are_kept_once(spark, monkeypatch):
    rows = [(f"e{i}", None if i % 7 == 0 else float(i % 4), str(i % 2), i % 3, i % 5 % 3) for i in range(1200)]
    df = spark.createDataFrame(rows, f"{EPISODE} string, x double, c string, action_no int, fold int").repartition(5)
    design = L.raw_design(df, ["x"], ["c"])
    kept = L.prepared(df, design, "action_no", [], *L.fold_marks(F.col("fold"), 3))
    passed = spark.sparkContext.accumulator(0)

    def add(r, y, inside, out, n):
        passed.add(len(y))
        return np.array([n.sum()])

    assert L.summed(kept, 1, design.width, add)[0] == 1200 and passed.value == len({r[1:] for r in rows}) < 300
    w = [np.random.default_rng(s).normal(size=(design.width, 3)) for s in range(4)]
    found = L.newton_sums(kept, design, 3, [0, 1, 2, 0], w)
    monkeypatch.setattr(L, "BLOCK", 7)
    for (loss, g, h), again, s, v in zip(found, L.newton_sums(kept, design, 3, [0, 1, 2, 0], w), (0, 1, 2, 0), w):
        own = [r for r in rows if r[4] != s]
        x = np.array([[r[1] or 0, r[1] is None, r[2] == "0", r[2] == "1", 0, 1] for r in own], dtype=float)
        p, hit = np.exp(x @ v) / np.exp(x @ v).sum(axis=1, keepdims=True), np.eye(3)[[r[3] for r in own]]
        assert loss == pytest.approx(-np.log((p * hit).sum(axis=1)).sum()) and np.allclose(g, x.T @ (p - hit))
        assert np.allclose(h, [[(x * (p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ x for b in range(3)] for a in range(3)])
        assert np.allclose(again[1], g) and np.allclose(again[2], h)
    own = [r[1] for r in rows if r[4] != 1 and r[1] is not None]
    filled = [r[1] if r[1] is not None else np.median(own) for r in rows if r[4] != 1]
    t = L.transforms(kept, design, 3)[1]
    assert t[[0, 1, -1], 0] == pytest.approx([1 / np.std(filled), np.median(own) / np.std(filled), -np.mean(filled) / np.std(filled)])


def test_rounding_does_not_prolong_a_fit(spark, monkeypatch):
    """Sums over many rows round, so that steps stay larger than any fixed bound."""
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(float(rng.normal()), int(rng.integers(3))) for _ in range(400)], "x double, action_no int")
    exact = L.fit_clone(df, ["x"], [], "action_no", 1.0).fitted.own[0]
    calls, sums = [], L.newton_sums

    def rounded(*a):
        calls.append(len(a[-1]))
        return [(loss, g + rng.normal(size=g.shape) * 1e-8, h) for loss, g, h in sums(*a)]

    monkeypatch.setattr(L, "newton_sums", rounded)
    assert np.allclose(L.fit_clone(df, ["x"], [], "action_no", 1.0).fitted.own[0], exact, atol=1e-7) and len(calls) < 12


def test_quantiles_of_counted_rows(spark):
    rows = [(i % 2, float(i * 37 % 101), i % 9) for i in range(1, 400)]
    df = spark.createDataFrame(rows, "g int, x double, n int").repartition(4)
    named = {f"q{k}": k / 8 for k in range(9)}
    for r in quantiles.exact_quantiles(df, F.col("x"), ["g"], named, F.col("n")).collect():
        assert [r[k] for k in named] == pytest.approx(np.quantile([x for g, x, n in rows if g == r.g for _ in range(n)], list(named.values())))
