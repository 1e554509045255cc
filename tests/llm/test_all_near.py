"""All pairs of wide fingerprints within a radius."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rolloutlab.llm import simhash_dedup as S


def words_of(v):
    return [int(np.uint64(v >> 64 * k & (2**64 - 1)).astype(np.int64)) for k in range(3)]


def family(rng, n, flips):
    base = int.from_bytes(rng.bytes(24), "little")
    out = {base}
    for _ in range(n):
        out.add(base ^ sum(1 << int(k) for k in rng.choice(192, int(rng.integers(1, flips)), replace=False)))
    return out


def pairs_within(fps, radius):
    return {(i, j) for i, a in enumerate(fps) for j in range(i + 1, len(fps)) if (a ^ fps[j]).bit_count() <= radius}


@pytest.mark.parametrize("tile, dense", [(16384, 96), (30, 8), (30, 1000)])
def test_no_pair_is_left_out(spark, monkeypatch, tile, dense):
    monkeypatch.setattr(S, "TILE", tile)
    monkeypatch.setattr(S, "DENSE", dense)
    rng = np.random.default_rng(7)
    fps = sorted(set().union(*[family(rng, 25, 28) for _ in range(8)], family(rng, 150, 16), [int.from_bytes(rng.bytes(24), "little") for _ in range(60)]))
    nodes = spark.createDataFrame([(i, words_of(v)) for i, v in enumerate(fps)], "node long, fp array<long>").repartition(3)
    got = [tuple(r) for r in S.all_near(nodes, 3, 24).collect()]
    want = pairs_within(fps, 24)
    assert len(got) == len(set(got)) and set(got) == want
    assert any(min((fps[i] ^ fps[j]) >> 32 * k & 0xFFFFFFFF for k in range(6)).bit_count() > 1 for i, j in want)


def test_a_pair_apart_in_every_segment_is_one_group(spark, monkeypatch):
    """24 bits, four in each segment of 32: found only by the complete search."""
    near = sum(1 << (32 * s + 7 * k) for s in range(6) for k in range(4))
    at = {"a": 12345678901234567890, "b": 12345678901234567890 ^ near, "c": 2**191 - 12345}
    monkeypatch.setattr(S, "wide_simhash", lambda texts, width, words: np.array([words_of(at[t]) for t in texts]))
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id long, text string").filter(F.lit(True))
    assert {r.doc_id: r.component_id for r in S.wide_groups(docs).collect()} == {1: 1, 2: 1, 3: 3}
