"""Slow versions of the operators that SQL can't express, column by column; and the pipeline on odd tables."""

import math
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from rolloutlab.llm.common import components, cut
from rolloutlab.llm.embedding_dedup import APART, CANDIDATES, compared, near_vectors, orders, pivot_count, roots, thinned, unit_rows
from rolloutlab.llm.fingerprints import LONGEST, fingerprint_documents, within
from rolloutlab.llm.language_id import BOUNDARY, ORDER, fit_model
from rolloutlab.llm.mixing import Mix, mix_blocks, target_sizes
from rolloutlab.llm.simhash_dedup import LANE_ROWS, simhash, wide_simhash
from rolloutlab.llm.toxicity import MOST_ALIKE, NOTABLE, START, Scorer, fit, sentences_of, words_of

from .test_operators import DOCS, empty, odd, prose, reach, slow_jaccard, slow_simhash, toxic_texts  # noqa: F401  fixtures

# ---- fingerprints -----------------------------------------------------------


def slow_fingerprint(text):
    words = {w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w}
    weight = {w: min(len(w), LONGEST) for w in words}
    hashes = {w: xxhash.xxh64_intdigest(w.encode(), 42) for w in words}
    whole = sum(weight.values())
    return sum(1 << b for b in range(64) if 2 * sum(weight[w] for w in words if hashes[w] >> b & 1) > whole)


def likeness(a, b):
    return 1 - (a ^ b).bit_count() / 64


def check_fingerprints(df):
    known = sorted(((r.doc_id is not None, r.doc_id or 0), r.doc_id, r.text or "") for r in df.collect())
    texts = [t for _, _, t in known]
    fps = [slow_fingerprint(t) for t in texts]
    want = []
    for i, (_, doc, t) in enumerate(known):
        half, after = len(t) // 2, (i + 1) % len(known)
        edited = slow_fingerprint(t[: len(t) - half] + texts[after][:half])
        near = len({f for f in fps if f != fps[i] and (f ^ fps[i]).bit_count() <= 3}) if doc is not None and doc % 20 == 0 else None
        want.append((doc, len(t), f"{fps[i]:016x}", f"{edited:016x}", likeness(fps[i], edited), likeness(fps[i], fps[after]), near))
    got = [(r.doc_id, r.n_chars, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next, r.n_near) for r in fingerprint_documents(df).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_fingerprints_by_hand(spark):
    base = [prose(k, 30) for k in range(8)]
    rows = [(i, base[i % 8] if i % 3 else base[i % 8] + f" tail{i}") for i in range(60)] + [(70, ""), (71, None), (71, None), (72, base[0]), (72, base[0]), (80, "Ein Wort"), (100, "ein wort")]
    check_fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))


def test_fingerprints_of_one_document(spark):
    check_fingerprints(spark.createDataFrame([(20, prose(5, 11))], "doc_id long, text string"))


def test_radius_search_by_hand(spark):
    rng = np.random.default_rng(6)
    values = {int(v) for v in rng.integers(-2**63, 2**63 - 1, 20)}
    for v in list(values):
        for _ in range(10):
            u = v % 2**64
            for k in rng.choice(64, rng.integers(1, 6), replace=False):
                u ^= 1 << int(k)
            values.add(u - 2**64 if u >= 2**63 else u)
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    asked = sorted(values)[::5]
    got = {(r.fp, r.found) for r in within(df, spark.createDataFrame([(v,) for v in asked], "fp long")).collect()}
    assert got == {(a, b) for a in asked for b in values if ((a ^ b) % 2**64).bit_count() <= 3}


def test_simhash_of_more_words_than_a_counter_holds():
    text = " ".join(f"w{k % 911}x{k % 7}" for k in range(LANE_ROWS + 4000))
    assert int(simhash([text, "short one", None], 3)[0]) % 2**64 == slow_simhash(text, 3)


# ---- language models ----------------------------------------------------------


class SlowKneserNey:
    """Interpolated Kneser-Ney by dictionaries: raw counts of the longest n-grams, below that how many n-grams end in each."""

    def __init__(self, parts, alphabet):
        grams = Counter()
        for p in parts:
            whole = [BOUNDARY] * (ORDER - 1) + [int(x) for x in p]
            grams.update(tuple(whole[i - ORDER + 1: i + 1]) for i in range(ORDER - 1, len(whole)))
        self.base = 1 / (alphabet + 1)
        self.counts = {ORDER: grams}
        for n in range(ORDER - 1, 0, -1):
            self.counts[n] = Counter(g[1:] for g in self.counts[n + 1])
        self.discount, self.total, self.kinds = {}, {}, {}
        for n, c in self.counts.items():
            once, twice = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
            self.discount[n] = once / (once + 2 * twice) if once and twice else 0.5
            self.total[n], self.kinds[n] = Counter(), Counter()
            for g, v in c.items():
                self.total[n][g[:-1]] += v
                self.kinds[n][g[:-1]] += 1

    def p(self, gram):
        n = len(gram)
        if not n:
            return self.base
        h = gram[:-1]
        if not self.total[n][h]:
            return self.p(gram[1:])
        d = self.discount[n]
        return max(self.counts[n][gram] - d, 0) / self.total[n][h] + d * self.kinds[n][h] / self.total[n][h] * self.p(gram[1:])

    def entropy(self, part):
        whole = [BOUNDARY] * (ORDER - 1) + [int(x) for x in part]
        return -sum(math.log(self.p(tuple(whole[i - ORDER + 1: i + 1]))) for i in range(ORDER - 1, len(whole))) / len(part)


def test_kneser_ney_by_hand():
    rng = np.random.default_rng(3)
    make = {"aa": "der die und ich nicht ein schon", "bb": "the of and with from this which"}
    texts = [" ".join(rng.permutation(make[k].split() * 3)) for k in ("aa", "bb") for _ in range(10)]
    langs = ["aa"] * 10 + ["bb"] * 10
    model = fit_model(texts, langs)
    parts = [model.alphabet.symbols(t) for t in ("der und the", "schon which xyz", "und", "7 of die")]
    got = model.cross_entropy(parts)
    for k, lang in enumerate(("aa", "bb")):
        own = [model.alphabet.symbols(t) for t, x in zip(texts, langs) if x == lang]
        slow = SlowKneserNey([p for i, p in enumerate(own) if i % 5 != 4], model.alphabet.size)
        assert got[:, k] == pytest.approx([slow.entropy(p) for p in parts], rel=1e-4)
        history = parts[0][:4]
        assert sum(slow.p(tuple(map(int, (*history, s)))) for s in range(model.alphabet.size)) == pytest.approx(1, abs=0.02)


# ---- toxicity -----------------------------------------------------------------------


def slow_value(word, mark, power, order=4, decay=0.7):
    def weights(w):
        out = defaultdict(float)
        for at in combinations(range(len(w)), order):
            out["".join(w[i] for i in at)] += decay ** (at[-1] - at[0] + 1)
        return out

    a, b = weights(START + word), weights(mark)
    return min(sum(v * b.get(k, 0) for k, v in a.items()) / sum(v * v for v in b.values()), 1.0) ** power


def test_document_scores_by_hand(toxic_texts):  # noqa: F811
    toxic, clean, sentence = toxic_texts
    model = fit(toxic[:50], clean[:90])
    texts = [toxic[60], clean[120], "grob.nix and zwackel. A clean sentence here!\nhuckxfurz at the end", "", "no word of that"]
    got = Scorer(model)(texts)
    for text, score in zip(texts, got):
        margins = []
        for s in sentences_of(text):
            vector, notable = np.zeros(len(model.kernel.landmarks)), False
            for w in words_of(s):
                values = np.array([slow_value(w, m, p) for m, p in zip(model.kernel.landmarks, model.kernel.powers)])
                values[values < NOTABLE] = 0
                vector, notable = vector + values, notable or values.any()
            if notable:
                margins.append(float(np.minimum(vector, MOST_ALIKE) @ (model.whiten @ model.weights[:-1]) + model.weights[-1]))
        top = sorted((min(m, 3.0) for m in margins), reverse=True) + [model.weights[-1]] * 3
        x = np.array([*top[:3], math.log1p(sum(m > 0 for m in margins)), 1.0])
        assert score == pytest.approx(1 / (1 + math.exp(-x @ model.curve)), abs=2e-3)


def test_words_that_tell_only_in_pairs():
    """A stem that many words of toxic documents have and one word of some clean ones by chance: one occurrence rejects nobody."""
    rng = np.random.default_rng(4)
    end = lambda: "".join("aeioubdgklm"[k] for k in rng.integers(0, 11, 3))
    plain = lambda n: ["".join("aeiounrstlm"[k] for k in rng.integers(0, 11, rng.integers(4, 9))) for _ in range(n)]

    def text(stems):
        words = plain(50)
        for k in rng.choice(50, stems, replace=False):
            words[k] = "zortvip" + end()
        return " ".join(w + ("." if i % 9 == 8 else "") for i, w in enumerate(words))

    toxic, clean = [text(6) for _ in range(90)], [text(int(rng.random() < 0.3)) for _ in range(200)]
    score = Scorer(fit(toxic[:60], clean[:150]))
    held = score(toxic[60:] + clean[150:])
    assert (held[:30] >= 0.7).mean() >= 0.9 and (held[30:] >= 0.7).mean() <= 0.04


# ---- mixing --------------------------------------------------------------------------------


def slow_targets(sizes, weights, total, most):
    """By bisection on the level: everyone gets level times weight, but at most ``most`` times the size."""
    low, high = 0.0, 1e9
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(mid * w, most * n) for w, n in zip(weights, sizes)) < total else (low, mid)
    return [min(low * w, most * n) for w, n in zip(weights, sizes)]


def test_targets_by_bisection():
    rng = np.random.default_rng(1)
    for _ in range(50):
        k = int(rng.integers(1, 7))
        sizes = [int(x) for x in rng.integers(1, 1000, k)]
        weights = [(3, 1, 2)[i % 3] for i in range(k)]
        assert target_sizes(sizes, weights, 1.5 * sum(sizes), 2) == pytest.approx(slow_targets(sizes, weights, 1.5 * sum(sizes), 2), rel=1e-6)


def test_packed_blocks_hold_the_mix(odd):  # noqa: F811
    mix = Mix(odd, block=8, shards=4)
    blocks, rows = mix.packed(odd).collect(), mix.per_document().collect()
    assert all(len(b.text.split()) == b.words <= 8 for b in blocks)
    for shard in {b.shard for b in blocks}:
        assert sorted(b.slot for b in blocks if b.shard == shard) == list(range(sum(b.shard == shard for b in blocks)))
    for s in {r.source for r in rows}:
        assert sum(b.words for b in blocks if b.source == s) == sum(r.taken for r in rows if r.source == s)
    texts = {r.doc_id: Counter((r.text or "").split()) for r in odd.collect()}
    taken = sum((Counter(b.text.split()) for b in blocks), Counter())
    assert all(taken[w] <= 2 * sum(t[w] for i, t in texts.items()) * 2 for w in taken)  # at most twice each row; two rows are repeated
    used = [r for r in rows if r.taken]
    assert all(r.first_shard is not None and r.first_slot is not None for r in used) and mix_blocks(empty(odd)).count() == 0


# ---- embeddings -------------------------------------------------------------------------------


def pairs_near(rng, n, low, high, width=64):
    base = unit_rows(rng.normal(size=(n, width)), width)
    cosine = rng.uniform(low, high, n)[:, None]
    side = rng.normal(size=(n, width))
    side = unit_rows(side - (side * base).sum(axis=1, keepdims=True) * base, width)
    return np.concatenate([base, cosine * base + np.sqrt(1 - cosine**2) * side])


def test_links_just_over_the_bound(spark):
    """Pairs of cosine 0.98 to 0.985 among unrelated vectors: nine of ten at least are found, and none below the bound."""
    rng = np.random.default_rng(12)
    v = np.concatenate([pairs_near(rng, 300, 0.9801, 0.985), pairs_near(rng, 100, 0.97, 0.9799), rng.normal(size=(1200, 64))])
    rows = [(i, [float(x) for x in row], i % 2 if i >= 800 else 0) for i, row in enumerate(v)]
    got = {r.vec_id: r.n_links for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert sum(got[i] for i in range(600)) >= 0.95 * 600 and sum(got[i] for i in range(600, len(v))) == 0


def met_pairs(n, seed):
    rng = np.random.default_rng(seed)
    v = unit_rows(rng.normal(size=(n, 64)), 64)
    points = thinned(v[: CANDIDATES * pivot_count(n, 64)], pivot_count(n, 64))
    found = np.sort(orders(v, points, 7), axis=1)
    return sum(int((c * (c - 1) // 2).sum()) for s in combinations(range(7), 3) for c in [np.unique(found[:, s], axis=0, return_counts=True)[1]])


def test_candidates_grow_with_the_vectors():
    small, large = np.mean([met_pairs(2000, k) for k in range(3)]), np.mean([met_pairs(8000, k) for k in range(3)])
    assert large / small <= 4**1.2


def test_orders_and_roots():
    points = np.eye(8)
    order = orders(np.array([[8, 7, 6, 5, 4, 3, 2, 1.0]]), points, 7)
    assert order.tolist() == [[0, 1, 2, 3, 4, 5, 6]]
    turned = order[:, ::-1].copy()
    assert compared(order, order, np.array([2]), 3).all() and not compared(order, order, np.array([4]), 3).any()
    apart = np.abs(np.arange(7) - np.arange(7)[::-1]).sum()
    assert compared(order, turned, np.array([2]), 3).all() == (apart <= APART * 56)
    assert roots(6, np.array([1, 2, 4]), np.array([0, 1, 5])).tolist() == [0, 0, 0, 3, 4, 4]


# ---- components ------------------------------------------------------------------------------------


@pytest.mark.parametrize("spread_from", [0, 10**9])
def test_components_of_a_hub_and_chains(spark, spread_from):
    rng = np.random.default_rng(5)
    links = [(5000, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(40)] + [(1020, 399), (2000, 2001), (2001, 2000), (2002, 2002)]
    links += [(int(a), int(b)) for a, b in rng.integers(3000, 3100, (60, 2))]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long"), spread_from=spread_from).collect()}
    assert got == {i: find(i) for i in root}


# ---- the pipeline on odd tables ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("labels")
    spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    return str(folder)


def test_stages_on_odd_tables(spark, odd, labelled):  # noqa: F811
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        out = cut(stage(spark, docs, labelled))
        assert name == "packing" or out.columns == odd.columns
        docs = out
    assert docs.count() > 0 and docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 1024


def test_stages_on_empty_tables(spark, odd, labelled):  # noqa: F811
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty(odd), labelled)
        assert out.count() == 0 and (name == "packing" or out.columns == odd.columns)


def test_stages_keep_documents_columns(spark, labelled):
    rows = [(i, prose(i, 80), "en", "s", 0) for i in range(6)] + [(6, prose(0, 80), "en", "s", 0), (7, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    kept = {r.doc_id for r in corpus_pipeline.simhash_dedup(spark, df, labelled).collect()}
    assert kept == {0, 1, 2, 3, 4, 5, 7}
    left = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.line_dedup(spark, df, labelled).collect()}
    assert set(left) == {0, 1, 2, 3, 4, 5, 7} and left[0] == (prose(0, 80), 0) and left[7] == (None, None)


def test_simhash_stage_keeps_one_of_each_component(spark, labelled):
    """By 192-bit fingerprints: linked at 24 bits or fewer if a 32-bit segment differs in one at most."""
    texts = {}
    for g in range(40):
        words = prose(2000 + g, (6, 30, 120, 400)[g % 4]).split()
        for k in range(5):
            copy = list(words)
            for j in range(k):
                copy[(2 * j + 1) * len(copy) // 9] = f"new{g}x{j}"
            texts[1000 - 10 * g - k] = " ".join(copy) + "\n" * k
    texts |= {5000: "", 5001: None, 5002: " \t"}
    prints = {i: sum(int(w) << 64 * k for k, w in enumerate(row.view(np.uint64))) for i, row in zip(texts, wide_simhash(list(texts.values()), 5))}
    apart = lambda a, b: [((prints[a] ^ prints[b]) >> 32 * k & 0xFFFFFFFF).bit_count() for k in range(6)]
    links = {(a, b) for a, b in combinations(texts, 2) if sum(apart(a, b)) <= 24 and min(apart(a, b)) <= 1}
    alike = {(a, b) for a, b in combinations([i for i in texts if i < 5000 and len(texts[i].split()) > 5], 2) if slow_jaccard(texts[a].split(), texts[b].split()) >= 0.9}
    groups = reach(texts, links)
    assert len(links & alike) > 0.8 * len(alike) > 0 and len(set(groups.values())) > 40  # 121 of 140
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts.items()], DOCS)
    assert sorted(r.doc_id for r in corpus_pipeline.simhash_dedup(spark, df, labelled).collect()) == sorted(set(groups.values()))
