"""Toxicity by a subsequence-kernel support vector machine with Nystroem landmarks.

The kernel of two words counts their common subsequences of ORDER letters,
each weighted by DECAY to the length it spans in either, so that gaps and
inserted characters lower a match and don't break it. A sentence's kernel with
a landmark is the sum over its words (of matches of NOTABLE at least, capped),
itself a kernel. Landmarks are strings that labelled toxic documents hold and
clean ones don't, or hold many words with where clean ones have one by
chance, and frequent clean words. A sentence's kernel values against them,
whitened, are its features; a linear support vector machine on these separates
sentences of toxic documents from sentences of clean ones. A document's score
is a logistic curve over the largest margins of its sentences and the number
of positive ones, fitted on labelled documents.

Fitting reads a bounded sample of labelled documents (``toxic_docs``,
``clean_docs``, ``longest``); scoring reads whole texts.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import aside
from .language_id import fold

ORDER = 4
DECAY = 0.7
#: Powers of the kernel, themselves kernels, that lower half matches: for strings of which one word tells, and of which it takes two.
POWER, DENSE_POWER = 2, 6
WINDOW = 24
LANDMARKS = 30
RIDGE = 1e-5
REMEMBERED = 200_000
#: Kernel values that count in a sentence, and the most that one landmark adds up to.
NOTABLE, MOST_ALIKE = 0.2, 2.0
#: Sentences are cut after so many words; dense strings have so many characters at least.
SENTENCE_WORDS, DENSE = 40, 6
#: Weight of a landmark's near misses in clean documents against its sentences in toxic ones.
NEAR_MISS = 0.5
TOXIC_DOCS, CLEAN_DOCS, LONGEST = 900, 1600, 20_000
THRESHOLD = 0.7
START = "<"
LONGEST_LANDMARK = 12
EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SPELLED = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")
ENDS = re.compile(r"(?<=[.!?])\s+|\n+")


def sentences_of(text: str) -> list[str]:
    """Stretches up to a sentence's or line's end, of SENTENCE_WORDS words at most."""
    out = []
    for part in ENDS.split(text):
        words = part.split(" ")
        out += [part] if len(words) <= SENTENCE_WORDS else [" ".join(words[k: k + SENTENCE_WORDS]) for k in range(0, len(words), SENTENCE_WORDS)]
    return out


def words_of(text: str) -> set[str]:
    """The distinct lower-case words of a text without punctuation at their ends, spelled-out words joined.

    A word of more than WINDOW characters counts as its windows of that length
    at half-length steps.
    """
    low = text.lower()
    found = set(low.split())
    found.update(m.replace(" ", "").replace("\t", "") for m in SPELLED.findall(low))
    out = {w.strip(EDGE) for w in found}
    for w in [w for w in out if len(w) > WINDOW]:
        out.discard(w)
        out.update(w[s: s + WINDOW] for s in range(0, len(w) - WINDOW // 2, WINDOW // 2))
    return {w for w in out if len(w) >= ORDER}


def codes(words: list[str], width: int) -> np.ndarray:
    return np.array(words, dtype=f"U{width}").view(np.uint32).reshape(len(words), width)


def subsequence_kernel(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Kernel of row i of s with row i of t; codes, 0 pads s and matches nothing."""
    rows, width = t.shape
    lam, lam2 = np.float32(DECAY), np.float32(DECAY * DECAY)
    part = [np.ones((width + 1, rows), dtype=np.float32)] + [np.zeros((width + 1, rows), dtype=np.float32) for _ in range(ORDER - 1)]
    out = np.zeros(rows, dtype=np.float32)
    t = np.ascontiguousarray(t.T)
    for j in range(s.shape[1]):
        c = s[:, j]
        hit = ((t == c) & (c != 0)).astype(np.float32) * lam2
        out += (hit * part[ORDER - 1][:-1]).sum(axis=0)
        for i in range(ORDER - 1, 0, -1):
            gain = hit * part[i - 1][:-1]
            run = np.zeros(rows, dtype=np.float32)
            part[i] *= lam
            for k in range(width):
                run *= lam
                run += gain[k]
                part[i][k + 1] += run
    return out


def kernel_pairs(words: list[str], of: np.ndarray, others: list[str], to: np.ndarray) -> np.ndarray:
    """Kernel values of words[of[k]] with others[to[k]]; by length, so that little is padded."""
    out = np.zeros(len(of), dtype=np.float32)
    if not len(of):
        return out
    lengths = np.array([len(w) for w in words])[of]
    t = codes(others, max(map(len, others)))
    order = np.argsort(lengths, kind="stable")
    for piece in np.array_split(order, max(1, len(order) // 16384)):
        if len(piece):
            width = int(lengths[piece].max())
            local, inverse = np.unique(of[piece], return_inverse=True)
            out[piece] = subsequence_kernel(codes([words[i] for i in local], width)[inverse], t[to[piece]])
    return out


@dataclass
class Kernel:
    """Kernel values of words against the landmarks, 1 where a word holds a whole landmark; a word starts with START.

    The longest common subsequence, found bit-parallel, tells which pairs have
    no common subsequence of ORDER: their value is zero.
    """

    landmarks: list[str]
    powers: np.ndarray
    norms: np.ndarray = field(init=False)
    letters: dict[str, int] = field(init=False)
    masks: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        own = np.arange(len(self.landmarks))
        self.norms = np.sqrt(np.maximum(kernel_pairs(self.landmarks, own, self.landmarks, own), 1e-20))
        self.letters = {c: i + 1 for i, c in enumerate(sorted(set("".join(self.landmarks))))}
        self.masks = np.zeros((len(self.letters) + 1, len(self.landmarks)), dtype=np.uint32)
        for j, mark in enumerate(self.landmarks):
            for k, c in enumerate(mark):
                self.masks[self.letters[c], j] |= np.uint32(1 << k)

    def common(self, words: list[str]) -> np.ndarray:
        """Lengths of the longest common subsequences, words by landmarks."""
        raw = codes(words, max(map(len, words)))
        table = np.zeros(int(raw.max()) + 1, dtype=np.int64)
        for c, i in self.letters.items():
            if ord(c) < len(table):
                table[ord(c)] = i
        at = table[raw]
        open_ = np.full((len(words), len(self.landmarks)), 0xFFFFFFFF, dtype=np.uint32)
        for k in range(raw.shape[1]):
            rows = np.flatnonzero(at[:, k])
            v = open_[rows]
            u = v & self.masks[at[rows, k]]
            open_[rows] = (v + u) | (v - u)
        return np.bitwise_count(~open_)

    def values(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.landmarks)), dtype=np.float32)
        if not words or not self.landmarks:
            return out
        words = [START + w for w in words]
        order = sorted(range(len(words)), key=lambda k: len(words[k]))
        for s in range(0, len(order), 2048):
            rows = np.array(order[s: s + 2048])
            part = [words[k] for k in rows]
            of, to = np.nonzero(self.common(part) >= ORDER)
            if len(of):
                used, inverse = np.unique(of, return_inverse=True)
                found = kernel_pairs([part[k] for k in used], inverse, self.landmarks, to) / (self.norms[to] * self.norms[to])
                out[rows[of], to] = np.minimum(found, 1.0) ** self.powers[to]
        return out


def families(docs: list[set[str]]) -> list[int]:
    """A number for each document, shared by those that have two of their five least long words (by hash) in common; fewer words tell no copy."""
    least = [sorted((w for w in d if len(w) > 6), key=lambda w: zlib.crc32(w.encode()))[:5] for d in docs]
    least = [words if len(words) == 5 else [] for words in least]
    root = list(range(len(docs)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    first: dict[tuple[str, str], int] = {}
    for i, words in enumerate(least):
        for pair in combinations(sorted(words), 2):
            a, b = find(first.setdefault(pair, i)), find(i)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(docs))]


def telling_strings(toxic: list[set[str]], clean: list[set[str]], most: int, stray: float = 0.04, impure: float = 0.15) -> list[tuple[str, bool]]:
    """Strings of ORDER letters or more that tell toxic documents from clean ones, and whether it takes two words to tell.

    Words of toxic documents hold them and those of clean ones hardly do (share
    ``stray``); or many toxic documents have two such words or more and hardly
    a clean one does (share ``impure``). The one in most toxic documents comes first (of equals the longest);
    the words it explains are set aside, and so on. Copies count once.
    """
    family = families(toxic)
    grouped: dict[int, set[str]] = defaultdict(set)
    for i, d in enumerate(toxic):
        grouped[family[i]] |= d
    where: dict[str, list[int]] = defaultdict(list)
    for i, words in grouped.items():
        for w in words:
            where[w].append(i)
    held: Counter[str] = Counter(w for d in clean for w in d)
    least = max(6, len(toxic) // 33)
    scale = len(toxic) / max(1, len(clean))

    def parts(w: str, n: int, known: set[str] | None) -> set[str]:
        w = START + w
        found = {w[a: a + n] for a in range(len(w) - n + 1)}
        return found if known is None else {p for p in found if p[1:] in known and p[:-1] in known}

    # longer strings only grow from shorter ones that enough documents hold
    size: dict[str, int] = {}
    twice: set[str] = set()
    against: dict[str, float] = {}
    known: set[str] | None = None
    for n in range(ORDER, LONGEST_LANDMARK + 1):
        counts: Counter[str] = Counter()
        pairs: Counter[str] = Counter()
        for words in grouped.values():
            if n < DENSE:
                counts.update(set().union(*[parts(w, n, known) for w in words]))
            else:
                own = Counter(p for w in words for p in parts(w, n, known))
                counts.update(own.keys())
                pairs.update(p for p, k in own.items() if k > 1)
        known = {p for p, k in counts.items() if k >= least}
        if not known:
            break
        once: Counter[str] = Counter()
        hit: dict[str, set[str]] = {}
        for w, k in held.items():
            if found := parts(w, n, None) & known:
                for p in found:
                    once[p] += k
                if n >= DENSE:
                    hit[w] = found
        more: Counter[str] = Counter()
        if n >= DENSE:
            for d in clean:
                own = Counter(p for w in d if w in hit for p in hit[w])
                more.update(p for p, k in own.items() if k > 1)
        for p in known:
            if len(p.lstrip(START)) < ORDER:
                continue
            if once[p] * scale <= stray * counts[p]:
                size[p], against[p] = counts[p], once[p]
            elif n >= DENSE and pairs[p] >= least and more[p] * scale <= impure * pairs[p]:
                size[p], against[p] = pairs[p], more[p]
                twice.add(p)
    alive = set(where)
    chosen: list[tuple[str, bool]] = []
    while size and len(chosen) < most:
        best = max(size, key=lambda p: (size[p] - 2 * scale * against[p], len(p), p))
        # its words that nothing chosen explains yet
        own = [w for w in alive if best in START + w]
        docs = Counter(i for w in own for i in where[w])
        now = sum(k > 1 for k in docs.values()) if best in twice else len(docs)
        if now < size[best]:
            if now >= least:
                size[best] = now
            else:
                del size[best]
            continue
        chosen.append((best, best in twice))
        alive.difference_update(own)
        del size[best]
    return chosen


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    """Primal support vector machine with squared hinge loss by Newton steps; the last column of x is the bias."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-9
    for _ in range(60):
        short = 1 - y * (x @ w)
        on = short > 0
        gradient = penalty @ w - x[on].T @ (weight[on] * y[on] * short[on])
        step = np.linalg.solve(penalty + (x[on] * weight[on, None]).T @ x[on], gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def logistic(x: np.ndarray, goal: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1]), x.T @ (goal - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def stretched(word: str, rng: np.random.Generator) -> str:
    """The word with a character put in at one to all of its gaps."""
    extra = ".-*_ x"[rng.integers(6)].strip() or "."
    gaps = rng.random(len(word) - 1) < rng.choice([0.25, 1.0])
    gaps[rng.integers(len(word) - 1)] = True
    return "".join(c + (extra if i < len(gaps) and gaps[i] else "") for i, c in enumerate(word))


@dataclass
class Model:
    kernel: Kernel
    whiten: np.ndarray
    weights: np.ndarray
    curve: np.ndarray

    def margins(self, vectors: np.ndarray) -> np.ndarray:
        """Of sentences, from their kernel values with the landmarks."""
        return np.minimum(vectors, MOST_ALIKE) @ (self.whiten @ self.weights[:-1]) + self.weights[-1]

    def features(self, margins: np.ndarray) -> list[float]:
        """Of a document, from the margins of its sentences with a notable word: the three largest, and how many are positive."""
        top = np.concatenate([np.sort(np.minimum(margins, 3.0))[::-1], [float(self.weights[-1])] * 3])
        return [float(top[0]), float(top[1]), float(top[2]), float(np.log1p((margins > 0).sum())), 1.0]


class Scorer:
    """Scores texts; words are compared with the landmarks once and remembered, only notable ones with their kernel values."""

    def __init__(self, model: Model):
        self.model = model
        self.seen: set[str] = set()
        self.notable: dict[str, np.ndarray] = {}

    def learn(self, words: set[str]) -> None:
        if not self.model.kernel.landmarks:
            return
        new = [w for w in words if w not in self.seen]
        if len(self.seen) + len(new) > REMEMBERED:
            self.seen.clear()
            self.notable.clear()
            new = list(words)
        new.sort()
        for s in range(0, len(new), 8192):
            part = new[s: s + 8192]
            values = self.model.kernel.values(part)
            values[values < NOTABLE] = 0
            self.notable.update((part[i], values[i].copy()) for i in np.flatnonzero(values.any(axis=1)))
            self.seen.update(part)

    def vectors(self, text: str, words: set[str]) -> np.ndarray:
        """Kernel values of the sentences that have a notable word; ``words`` are the text's."""
        out = []
        if any(w in self.notable for w in words):
            for sentence in sentences_of(text):
                found = [self.notable[w] for w in words_of(sentence) if w in self.notable]
                if found:
                    out.append(np.sum(found, axis=0))
        return np.array(out, dtype=np.float64).reshape(-1, len(self.model.kernel.landmarks))

    def features(self, texts: list[str | None]) -> np.ndarray:
        out = []
        for s in range(0, len(texts), 64):
            part = [t or "" for t in texts[s: s + 64]]
            docs = [words_of(t) for t in part]
            self.learn(set().union(*docs))
            out += [self.model.features(self.model.margins(self.vectors(t, d)) if self.model.kernel.landmarks else np.zeros(0)) for t, d in zip(part, docs)]
        return np.array(out).reshape(-1, 5)

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.model.curve, -30, 30)))


def fit(toxic: list[str], clean: list[str], landmarks: int = LANDMARKS, seed: int = 41) -> Model:
    """Learns from toxic and clean texts; with either kind missing, or nothing that tells them apart, every score is the share of toxic ones, a half at most."""
    rng = np.random.default_rng(seed)
    bad, good = [set(map(sys.intern, words_of(t))) for t in toxic], [set(map(sys.intern, words_of(t))) for t in clean]
    contrast = landmarks // 6
    told = telling_strings(bad, good, landmarks - contrast) if bad and good else []
    marks = [m for m, _ in told]
    share = min(len(bad) / max(1, len(bad) + len(good)), 0.5)
    if not marks:
        base = np.log(max(share, 1e-3) / max(1 - share, 1e-3))
        return Model(Kernel([], np.zeros(0)), np.zeros((0, 0)), np.full(1, -1.0), np.array([0.0, 0.0, 0.0, 0.0, base]))
    common = Counter(w for d in good for w in d)
    telling = list(marks)
    marks += [START + w for w, _ in sorted(common.items(), key=lambda x: (-x[1], x[0])) if len(w) < LONGEST_LANDMARK][:contrast]
    powers = np.array([DENSE_POWER if dense else POWER for _, dense in told] + [POWER] * (len(marks) - len(told)), dtype=np.float32)
    kernel = Kernel(marks, powers)
    every = np.arange(len(marks))
    gram = kernel_pairs(marks, np.repeat(every, len(marks)), marks, np.tile(every, len(marks))).reshape(len(marks), -1).astype(float)
    gram = (gram / np.outer(kernel.norms, kernel.norms)) ** ((powers[:, None] + powers) / 2)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    whiten = vectors * np.where(values > 1e-6, 1 / np.sqrt(np.maximum(values, 1e-6)), 0.0)
    model = Model(kernel, whiten, np.append(np.zeros(len(marks)), -1.0), np.zeros(5))
    scorer = Scorer(model)
    scorer.learn(set().union(*bad, *good))
    # sentences of toxic documents with a telling string: every string weighs the same, its sentences alike
    yes, weight_yes = [], []
    stretch = {m: [] if dense else sorted({stretched(w, rng) for w in sorted(w for w in scorer.notable if m in START + w and len(w) < WINDOW // 2)[:50] * 8} - set(common)) for m, dense in told}
    scorer.learn(set().union(*map(set, stretch.values())))
    none = np.zeros(len(marks))
    by_mark: dict[str, list[np.ndarray]] = defaultdict(list)
    for text, words in zip(toxic, bad):
        if not any(w in scorer.notable for w in words):
            continue
        for sentence in sentences_of(text):
            found = [w for w in words_of(sentence) if w in scorer.notable]
            for m in telling:
                if any(m in START + w for w in found):
                    by_mark[m].append(np.sum([scorer.notable[w] for w in found], axis=0))
    for m in telling:
        wide = [scorer.notable.get(w, none) for w in stretch[m]]
        yes += by_mark[m] + wide
        weight_yes += [0.7 / max(1, len(by_mark[m]))] * len(by_mark[m]) + [0.3 / max(1, len(wide))] * len(wide)
    # sentences of clean documents; those without a notable word are all alike
    no = [v for t, d in zip(clean, good) for v in scorer.vectors(t, d)]
    no = [no[i] for i in np.argsort([-v[: len(telling)].max() for v in no], kind="stable")[:20_000]]
    x = np.minimum(np.array(yes + no + [none]).reshape(-1, len(marks)), MOST_ALIKE) @ whiten
    x = np.column_stack([x, np.ones(len(x))])
    y = np.concatenate([np.ones(len(yes)), -np.ones(len(no) + 1)])
    # a clean sentence that holds a telling string weighs as all of a toxic document's do, by how often documents of its kind are drawn; near misses are shared out by landmark
    scale = len(bad) / max(1, len(good))
    each = np.array([scale / (len(telling) * max(1, sum(any(m in START + w for w in d) for d in bad))) for m in telling])
    likest = np.array([int(np.argmax(v[: len(telling)])) for v in no], dtype=np.int64)
    company = np.bincount(likest, minlength=len(telling))
    weight_no = [max((each[j] for j in np.flatnonzero(v[: len(telling)] >= 1)), default=NEAR_MISS / (len(telling) * company[k])) for v, k in zip(no, likest)]
    weight = np.concatenate([np.array(weight_yes) / len(telling), weight_no, [0.5]])
    model.weights = squared_hinge(x, y, weight, RIDGE)
    seen = scorer.features(toxic + clean)
    goal = np.concatenate([np.full(len(bad), (len(bad) + 1) / (len(bad) + 2)), np.full(len(good), 1 / (len(good) + 2))])
    model.curve = logistic(seen, goal)
    return model


def learn(docs: DataFrame, labels: DataFrame, toxic_docs: int = TOXIC_DOCS, clean_docs: int = CLEAN_DOCS, longest: int = LONGEST) -> Model:
    """Fits on a sample by hash of labelled documents outside fold 1 of 3: about so many toxic and clean ones of at most ``longest`` characters.

    A document with several labels is toxic if one says so; null labels tell
    nothing.
    """
    known = labels.filter((fold(3) != 1) & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {int(r["toxic"] > 0): r["count"] for r in known.groupBy("toxic").count().collect()}
    most = {0: clean_docs, 1: toxic_docs}
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(43)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    rate = F.when(F.col("toxic") > 0, F.lit(most[1] / max(1, counts.get(1, 0)))).otherwise(F.lit(most[0] / max(1, counts.get(0, 0))))
    picked = known.filter(drawn < rate)  # bounded: some thousand rows of two numbers
    rows = (docs.select("doc_id", "text").filter(F.col("text").isNotNull() & (F.char_length("text") <= longest))
            .join(F.broadcast(picked), "doc_id").select("doc_id", "text", "toxic").toPandas())
    rows = rows.sort_values(["doc_id", "text"])
    bad = rows["toxic"] > 0
    return fit(rows["text"][bad].tolist(), rows["text"][~bad].tolist())


def scores(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and the toxicity score of ``text``."""
    holder: list[Scorer] = []

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        if not holder:
            holder.append(Scorer(model))
        return pd.Series(holder[0](texts.tolist()))

    return docs.select(*keep, of("text").alias("score"))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **how) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    held_out marks fold 1 of 3, which the fit leaves out. Null and empty texts
    score like a text without telling words. Repeated rows stay rows; extra
    columns are left out; empty input gives no rows.
    """
    held = fold(3) == 1
    out = scores(docs, learn(docs, labels, **how), ["doc_id"])
    return out.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **how) -> DataFrame:
    """The documents that score below ``threshold``, in their columns, whatever their names.

    Null and empty texts score like a text without telling words; repeated
    rows share a fate; without labels of both kinds all documents stay. Empty
    input gives no rows.
    """
    order = docs.columns
    plain, names = aside(docs, ("doc_id", "text"))
    held = scores(plain, learn(docs, labels, **how), plain.columns).filter(F.col("score") < threshold).drop("score")
    return held.withColumnsRenamed(names).select(*order)
