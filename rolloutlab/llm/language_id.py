"""Language identification by interpolated Kneser-Ney character models.

One model per language, of order five, over letters and word boundaries. All
n-grams live in sorted arrays of 64-bit hashes that the languages share: a row
holds the interpolated log-probability under every language, a context row
the log back-off weight, so a character costs one lookup where its n-gram was
seen by any model. The language with the lowest cross-entropy per character
wins; a logistic curve over the margin, fitted on documents that the models
did not see, gives the score, and a threshold on it the rejection.

The models are fitted on a bounded sample (``train_chars``); scoring reads
whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDER = 5
TRAIN_CHARS = 4_000_000
CHUNK = 1 << 20
UNKNOWN, BOUNDARY = 0, 1
ROLL = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray, order: int) -> np.ndarray:
    x = x + np.uint64(order * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class HashArray:
    """Sorted 64-bit hashes with a directory by their top bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = np.uint64(64 - max(1, int(len(keys)).bit_length() + 1))
        top = (keys >> self.shift).astype(np.int64)
        self.first = np.searchsorted(top, np.arange((1 << int(64 - int(self.shift))) + 1)).astype(np.int32)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Positions of the wanted keys, -1 where absent."""
        out = np.full(len(wanted), -1, dtype=np.int32)
        if not len(self.keys):
            return out
        top = (wanted >> self.shift).astype(np.int64)
        at, end = self.first[top], self.first[top + 1]
        who = np.flatnonzero(at < end)
        at, end, want = at[who], end[who], wanted[who]
        while len(who):
            hit = self.keys[at] == want
            out[who[hit]] = at[hit]
            more = ~hit & (at + 1 < end)
            who, at, end, want = who[more], at[more] + 1, end[more], want[more]
        return out


class Alphabet:
    """Symbols of the letters seen in training; other letters are unknown, all else is a boundary."""

    def __init__(self, texts: list[str]):
        seen = sorted({c for t in texts for c in set(t.lower()) if c.isalpha()})
        self.codes = {ord(c): i + 2 for i, c in enumerate(seen)}
        self.size = len(seen) + 2
        self.table = np.full(0x110000, BOUNDARY, dtype=np.uint16)
        letters = [i for i in range(0x110000) if chr(i).isalpha()]
        self.table[letters] = UNKNOWN
        for code, symbol in self.codes.items():
            self.table[code] = symbol

    def __getstate__(self) -> dict:
        return {"codes": self.codes, "size": self.size}

    def __setstate__(self, state: dict) -> None:
        self.codes, self.size = state["codes"], state["size"]
        self.table = np.full(0x110000, BOUNDARY, dtype=np.uint16)
        self.table[[i for i in range(0x110000) if chr(i).isalpha()]] = UNKNOWN
        for code, symbol in self.codes.items():
            self.table[code] = symbol

    def symbols(self, text: str) -> np.ndarray:
        """The text's symbols, runs of boundaries as one, boundaries at both ends."""
        raw = self.table[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        keep = np.ones(len(raw), dtype=bool)
        keep[1:] = (raw[1:] != BOUNDARY) | (raw[:-1] != BOUNDARY)
        return raw[keep]


def joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All parts in one array, each after ORDER - 1 boundaries; and which positions count."""
    pad = np.full(ORDER - 1, BOUNDARY, dtype=np.uint16)
    rows = [x for p in parts for x in (pad, p)]
    counts = np.concatenate([x for p in parts for x in (np.zeros(ORDER - 1, dtype=bool), np.ones(len(p), dtype=bool))]) if parts else np.zeros(0, bool)
    return (np.concatenate(rows) if rows else np.zeros(0, np.uint16)), counts


def rolled(symbols: np.ndarray) -> list[np.ndarray]:
    """Unmixed hashes of the n-grams that end at each position, n = 0..ORDER."""
    s = symbols.astype(np.uint64) + np.uint64(1)
    out, power = [np.zeros(len(s), dtype=np.uint64)], 1
    for n in range(1, ORDER + 1):
        term = np.zeros(len(s), dtype=np.uint64)
        term[n - 1:] = s[: len(s) - n + 1] * np.uint64(power)
        out.append(out[-1] + term)
        power = power * ROLL & (1 << 64) - 1
    return out


def before(hashes: np.ndarray) -> np.ndarray:
    """The hashes one position earlier."""
    return np.concatenate([hashes[:1] * np.uint64(0), hashes[:-1]])


@dataclass
class Counts:
    """Of one language and order: n-grams with their discounted share, contexts with their back-off weight."""

    grams: np.ndarray
    share: np.ndarray
    contexts: np.ndarray
    weight: np.ndarray


def fit_language(symbols: np.ndarray, counted: np.ndarray) -> tuple[list[Counts], list[np.ndarray], np.ndarray]:
    """Kneser-Ney counts of orders 1..ORDER, and for each order where its n-grams end first."""
    keys, at = rolled(symbols), np.flatnonzero(counted)
    found: list[Counts] = []
    places: list[np.ndarray] = []
    grams, first, count = np.unique(keys[ORDER][at], return_index=True, return_counts=True)
    place = at[first]
    for n in range(ORDER, 0, -1):
        once, twice = (count == 1).sum(), (count == 2).sum()
        discount = once / (once + 2 * twice) if once and twice else 0.5
        context = before(keys[n - 1])[place]
        contexts, which = np.unique(context, return_inverse=True)
        total = np.bincount(which, count)
        kinds = np.bincount(which)
        found.append(Counts(mixed(grams, n), np.maximum(count - discount, 0) / total[which], mixed(contexts, 100 + n), discount * kinds / total))
        places.append(place)
        if n > 1:
            grams, first, count = np.unique(keys[n - 1][place], return_index=True, return_counts=True)
            place = place[first]
    return found[::-1], places[::-1], symbols


@dataclass
class Model:
    """Tables by order, over all languages: log-probabilities of n-grams, log back-off weights of contexts."""

    languages: list[str]
    alphabet: Alphabet
    grams: list[HashArray]
    logs: list[np.ndarray]
    contexts: list[HashArray]
    weights: list[np.ndarray]
    floor: float
    curve: tuple[float, float, float] = (0.0, 1.0, 0.0)
    reject: float = 0.0

    def cross_entropy(self, parts: list[np.ndarray]) -> np.ndarray:
        """Nats per character of each symbol array under each language."""
        symbols, counted = joined(parts)
        keys, at = rolled(symbols), np.flatnonzero(counted)
        cost = np.zeros((len(at), len(self.languages)), dtype=np.float32)
        open_ = np.arange(len(at))
        for n in range(ORDER, 0, -1):
            row = self.grams[n - 1].find(mixed(keys[n][at[open_]], n))
            hit = row >= 0
            cost[open_[hit]] += self.logs[n - 1][row[hit]]
            open_ = open_[~hit]
            if not len(open_):
                break
            row = self.contexts[n - 1].find(mixed(keys[n - 1][at[open_] - 1], 100 + n))
            hit = row >= 0
            cost[open_[hit]] += self.weights[n - 1][row[hit]]
        cost[open_] += self.floor
        sizes = np.array([len(p) for p in parts])
        ends = np.cumsum(sizes)
        sums = np.concatenate([np.zeros((1, cost.shape[1])), np.cumsum(cost, axis=0, dtype=np.float64)])
        return -(sums[ends] - sums[ends - sizes]) / np.maximum(sizes, 1)[:, None]

    def features(self, entropy: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Winner, its margin over the second per character, and the log of the margin's sum."""
        if len(self.languages) == 1:
            margin = np.full(len(entropy), 1.0)
        else:
            two = np.partition(entropy, 1, axis=1)
            margin = two[:, 1] - two[:, 0]
        return entropy.argmin(axis=1), margin, np.log1p(margin * sizes)

    def score(self, margin: np.ndarray, mass: np.ndarray) -> np.ndarray:
        a, b, c = self.curve
        return 1 / (1 + np.exp(-np.clip(a + b * mass + c * margin, -30, 30)))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether to reject, for whole texts; ``und``, 0 and True where there is no letter."""
        names, scores, rejected = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
        batch: list[np.ndarray] = []
        rows: list[int] = []

        def flush() -> None:
            if not rows:
                return
            sizes = np.array([len(p) for p in batch])
            win, margin, mass = self.features(self.cross_entropy(batch), sizes)
            got = self.score(margin, mass)
            for r, w, g in zip(rows, win, got):
                names[r], scores[r], rejected[r] = self.languages[w], g, g < self.reject
            batch.clear()
            rows.clear()

        held = 0
        for at, text in enumerate(texts):
            symbols = self.alphabet.symbols(text or "")
            if not self.languages or not (symbols != BOUNDARY).any():
                continue
            batch.append(symbols)
            rows.append(at)
            held += len(symbols)
            if held > CHUNK:
                flush()
                held = 0
        flush()
        return names, scores, rejected


def fit_model(texts: list[str], langs: list[str]) -> Model:
    """Models of all languages in the sample; every fifth document of each calibrates the score."""
    languages = sorted(set(langs))
    alphabet = Alphabet(texts)
    parts = [alphabet.symbols(t) for t in texts]
    fits, held = [], []
    for lang in languages:
        own = [p for p, x in zip(parts, langs) if x == lang]
        spare = own[4::5]
        held += [(p, lang) for p in spare if (p != BOUNDARY).any()]
        fits.append(fit_language(*joined([p for i, p in enumerate(own) if i % 5 != 4])))
    floor = -np.log(alphabet.size + 1)
    model = Model(languages, alphabet, [], [], [], [], float(floor))
    below: np.ndarray | None = None
    for n in range(1, ORDER + 1):
        grams = np.concatenate([f[0][n - 1].grams for f in fits])
        keys, first = np.unique(grams, return_index=True)
        context, suffix = [], []
        for _, places, symbols in fits:
            rolls, place = rolled(symbols), places[n - 1]
            context.append(mixed(before(rolls[n - 1])[place], 100 + n))
            suffix.append(mixed(rolls[n - 1][place], n - 1))
        context_of, suffix_of = np.concatenate(context)[first], np.concatenate(suffix)[first]
        contexts = np.unique(np.concatenate([f[0][n - 1].contexts for f in fits]))
        lower = np.full((len(keys), len(languages)), np.exp(floor)) if below is None else below[model.grams[-1].find(suffix_of)]
        p = np.zeros((len(keys), len(languages)))
        weights = np.ones((len(contexts), len(languages)))
        for k, (counts, _, _) in enumerate(fits):
            c = counts[n - 1]
            weights[np.searchsorted(contexts, c.contexts), k] = c.weight
            p[np.searchsorted(keys, c.grams), k] = c.share
        p += weights[np.searchsorted(contexts, context_of)] * lower
        model.grams.append(HashArray(keys))
        model.logs.append(np.log(np.maximum(p, 1e-30)).astype(np.float32))
        model.contexts.append(HashArray(contexts))
        model.weights.append(np.log(np.maximum(weights, 1e-30)).astype(np.float32))
        below = p
    calibrate(model, held)
    return model


def calibrate(model: Model, held: list[tuple[np.ndarray, str]], error: float = 0.01) -> None:
    """Fits the score to being right on documents and short pieces of them; sets the rejection threshold."""
    pieces = [(p[:n], lang) for p, lang in held for n in (10, 40, 160, len(p)) if (p[:n] != BOUNDARY).any()]
    if len(pieces) < 20:
        return
    sizes = np.array([len(p) for p, _ in pieces])
    win, margin, mass = model.features(model.cross_entropy([p for p, _ in pieces]), sizes)
    right = np.array([model.languages[w] == lang for w, (_, lang) in zip(win, pieces)])
    yes, no = right.sum(), (~right).sum()
    goal = np.where(right, (yes + 1) / (yes + 2), 1 / (no + 2))
    x = np.column_stack([np.ones(len(mass)), mass, margin])
    w = np.zeros(3)
    for _ in range(50):  # Newton steps, lightly ridged
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3), x.T @ (goal - p) - 1e-2 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    model.curve = (float(w[0]), float(w[1]), float(w[2]))
    score = model.score(margin, mass)
    order = np.argsort(score)
    wrong_above = np.cumsum((~right[order])[::-1])[::-1] / np.arange(len(order), 0, -1)
    fine = np.flatnonzero(wrong_above <= error)
    model.reject = float(score[order][fine[0]]) if len(fine) else 1.0


def fold(folds: int) -> F.Column:
    """CRC-32 of doc_id as text, modulo the folds; an empty text where it is null."""
    return F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % folds


def learn(docs: DataFrame, train_chars: int = TRAIN_CHARS) -> Model:
    """Fits on about ``train_chars`` characters, shared evenly by the languages, of documents outside fold 0 of 5.

    Documents are drawn by hash. One longer than its language's share is not
    drawn.
    """
    known = docs.filter((fold(5) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", "doc_id")
    chars = F.char_length("text")
    sums = known.groupBy("lang").agg(F.sum(chars).alias("chars")).collect()  # one row per language
    if not sums:
        return Model([], Alphabet([]), [], [], [], [], 0.0)
    share = train_chars / len(sums)
    rate = F.create_map(*[x for r in sums for x in (F.lit(r["lang"]), F.lit(min(1.0, share / max(r["chars"] or 1, 1))))])
    drawn = F.pmod(F.xxhash64("doc_id", "text", F.lit(41)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    rows = known.filter((drawn < rate[F.col("lang")]) & (chars <= share)).select("lang", "text", "doc_id").toPandas()
    rows = rows.sort_values(["lang", "doc_id", "text"])
    return fit_model(rows["text"].tolist(), rows["lang"].tolist())


def identify(docs: DataFrame, model: Model | None = None, train_chars: int = TRAIN_CHARS) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, rejected.

    held_out marks fold 0 of 5, which the fit leaves out. lang_pred is a
    learned language, or ``und`` with score 0 where the text is null, empty or
    without letters, or where nothing could be learned. Repeated rows stay
    rows; extra columns are left out; empty input gives no rows.
    """
    model = model or learn(docs, train_chars)

    @F.pandas_udf("struct<lang: string, score: double, rejected: boolean>")
    def of(texts: pd.Series) -> pd.DataFrame:
        lang, score, rejected = model.predict(texts.tolist())
        return pd.DataFrame({"lang": lang, "score": score, "rejected": rejected})

    out = docs.select("doc_id", (fold(5) == 0).alias("held_out"), of("text").alias("_p"))
    return out.select("doc_id", "held_out", F.col("_p.lang").alias("lang_pred"), F.col("_p.score").alias("score"), F.col("_p.rejected").alias("rejected"))
