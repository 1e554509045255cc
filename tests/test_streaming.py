"""Episodes replayed from a stream."""

import time

import pytest
from rolloutlab.schema import ACTION, EPISODE, STEP, ContractError
from rolloutlab.streaming.episodes import replayed

KIND = f"{EPISODE} string, {STEP} int, map_mm_hg double, sex string, {ACTION} string, reward double, terminal int"


def row(episode, step, end=0, **change):
    return tuple(({"e": episode, "s": step, "m": 60.0 + (step or 0) / 3, "x": "F" if (step or 0) % 2 else None, "a": "maintain", "r": 0.1 * (step or 0), "t": end} | change).values())


def batches(spark, folder, *parts):
    """What comes out when the parts come one after another, each a batch."""
    name = f"replay_{time.time_ns()}"
    query = None
    for part in parts:
        spark.createDataFrame(part, KIND).coalesce(1).write.mode("append").parquet(str(folder))
        if query is None:
            out = replayed(spark.readStream.schema(KIND).parquet(str(folder)), ["map_mm_hg", "sex"], 4)
            query = out.writeStream.format("memory").queryName(name).outputMode("append").start()
        query.processAllAvailable()
    found = spark.table(name).collect()
    query.stop()
    return found


def short(rows):
    return sorted(((r[EPISODE] or "", -1 if r[STEP] is None else r[STEP], r["next_map_mm_hg"], r["terminated"], r["fault"] or "") for r in rows), key=lambda r: (*r[:2], r[4], repr(r)))


def test_steps_leave_in_order_whatever_the_order_they_come_in(spark, tmp_path):
    got = batches(spark, tmp_path / "in", [row("a", 2), row("b", 0), row("b", 1, 1)], [row("a", 1), row("c", 0, 1)], [row("a", 0), row("a", 3, 1)])
    at = lambda s: 60.0 + s / 3
    assert short(got) == [("a", 0, at(1), False, ""), ("a", 1, at(2), False, ""), ("a", 2, at(3), False, ""), ("a", 3, None, True, ""), ("b", 0, at(1), False, ""), ("b", 1, None, True, ""), ("c", 0, None, True, "")]
    first = next(r for r in got if r[EPISODE] == "a" and r[STEP] == 1)
    assert (first["map_mm_hg"], first["sex"], first[ACTION], first["reward"], first["next_sex"]) == (at(1), "F", "maintain", 0.1, None)
    assert [r[STEP] for r in got if r[EPISODE] == "a"] == [0, 1, 2, 3]


def test_what_does_not_fit_leaves_with_a_fault(spark, tmp_path):
    got = batches(spark, tmp_path / "in", [row("a", 0), row("a", 1), row("a", 1, m=1.0), row("a", 3), row("a", 4), row("a", None), row(None, 0)], [row("a", 3, 1), row("a", 0)], [row("a", 2, 1)], [row("a", 3)])
    assert [(s, f) for _, s, _, _, f in short(got) if f] == [(0, "beyond"), (-1, "beyond"), (0, "late"), (1, "late"), (3, "ended"), (3, "ended"), (3, "repeated"), (4, "beyond")]
    assert [(s, end) for e, s, _, end, f in short(got) if e == "a" and not f] == [(0, False), (1, False), (2, True)]


def test_a_silent_episode_closes(spark, tmp_path):
    spark.createDataFrame([row("a", 0), row("a", 2), row("b", 0, 1)], KIND).coalesce(1).write.parquet(str(tmp_path / "in"))
    name = f"replay_{time.time_ns()}"
    out = replayed(spark.readStream.schema(KIND).parquet(str(tmp_path / "in")), ["map_mm_hg", "sex"], 4, idle="1 second")
    query = out.writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        for _ in range(90):
            time.sleep(1)
            if spark.table(name).count() >= 3:
                break
        assert [(e, s, f) for e, s, _, _, f in short(spark.table(name).collect())] == [("a", 0, "unfinished"), ("a", 2, "gap"), ("b", 0, "")]
    finally:
        query.stop()


def test_a_replay_needs_something_to_show(spark):
    with pytest.raises(ContractError):
        replayed(spark.createDataFrame([], KIND), [], 4)
    with pytest.raises(ContractError, match="transitions"):
        replayed(spark.createDataFrame([], KIND), ["map_mm_hg"], 4)
