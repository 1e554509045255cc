"""URL filters by a cascade of Bloom filters.

The listed keys go into the first filter. Of the keys that the corpus has,
those that pass it and are not listed go into the second, the listed ones
that pass that into the third, and so on, until a filter lets no key of the
other kind through. For the keys of that corpus the first filter that a key
fails tells exactly whether it is listed, without any join. All filters
together take a few bits a listed key and grow with the logarithm of the
corpus only, so they are small enough to send to every task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, cut

#: Share of the other kind that a filter after the first lets through, and the most for the first.
PASSED = 0.5
#: Levels after which building gives up: each halves what is left.
MOST_LEVELS = 200
#: Listed keys of one kind at most: their filters take under 200 MB for 10^12 keys of the corpus.
MOST_LISTED = 20_000_000
_ODD = 0x9E3779B97F4A7C15

#: (host, path, verdict): fits the host and all its subdomains if the path starts so; the longest that fits decides.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that leaves no pattern."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Bloom:
    """A Bloom filter of ``bits`` bits in 64-bit words, asked at ``hashes`` places; ``salt`` sets it apart from other levels."""

    words: np.ndarray
    bits: int
    hashes: int
    salt: int

    @staticmethod
    def sized(n: int, passed: float, salt: int) -> Bloom:
        """An empty one for n keys that lets about ``passed`` of all others through."""
        bits = max(64, math.ceil(-n * math.log(passed) / math.log(2) ** 2))
        return Bloom(np.zeros(-(-bits // 64), dtype=np.uint64), bits, max(1, round(-math.log2(passed))), salt)

    def places(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """(hashes, keys): the bits of keys given by two hashes."""
        salt = np.uint64(self.salt * _ODD % 2**64)
        first, step = mixed(a ^ salt), mixed(b + salt) | np.uint64(1)
        turns = np.arange(self.hashes, dtype=np.uint64)[:, None]
        return (first[None] + turns * step[None]) % np.uint64(self.bits)

    def has(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        at = self.places(a, b)
        return ((self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=0)

    def filled(self, keys: DataFrame) -> Bloom:
        """This filter with the keys (a, b) of a table; the words that any of them sets come to the driver."""
        shape = Bloom(np.zeros(0, dtype=np.uint64), self.bits, self.hashes, self.salt)

        @F.pandas_udf("array<long>")
        def bits_of(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series(list(shape.places(unsigned(a), unsigned(b)).T.astype(np.int64)), dtype=object)

        at = keys.select(F.explode(bits_of("a", "b")).alias("at"))
        words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("set")).toPandas()
        out = self.words.copy()
        out[words["word"].to_numpy(dtype=np.int64)] = unsigned(words["set"])
        return Bloom(out, self.bits, self.hashes, self.salt)


def unsigned(x: pd.Series) -> np.ndarray:
    return x.to_numpy(dtype=np.int64).view(np.uint64)


@dataclass(frozen=True)
class Cascade:
    """Exact membership of the keys it was built over; levels 0, 2, ... hold listed keys, levels 1, 3, ... unlisted ones."""

    levels: Sequence[Bloom]

    def listed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each key (by its two hashes) is listed: the kind of the last level is right about all keys that pass every level."""
        verdict = np.zeros(len(a), dtype=bool)
        open_ = np.arange(len(a))
        for k, level in enumerate(self.levels):
            passes = level.has(a[open_], b[open_])
            verdict[open_[~passes]] = k % 2 == 1
            open_ = open_[passes]
            verdict[open_] = k % 2 == 0
        return verdict


def hashed(key: Column) -> list[Column]:
    """The two 64-bit hashes that stand for a key."""
    return [F.xxhash64(key).alias("a"), F.xxhash64(F.lit("url"), key).alias("b")]


def passing(keys: DataFrame, bloom: Bloom) -> DataFrame:
    """The keys (a, b, ...) that a filter lets through; the filter is sent to each executor once."""
    sent = keys.sparkSession.sparkContext.broadcast(bloom)

    @F.pandas_udf("boolean")
    def has(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(sent.value.has(unsigned(a), unsigned(b)))

    return keys.filter(has("a", "b"))


def build(listed: DataFrame, universe: DataFrame, others: int | None = None) -> Cascade:
    """The cascade of the distinct keys ``listed`` over all keys of ``universe``, tables (a, b).

    Repeated and listed keys in the universe do no harm, nulls must be gone.
    ``others`` is about the number of distinct keys there (counted if not
    given); only the sizes hang on it. Only what passes the first filter is made distinct and compared with the
    list, about as many keys as are listed; the levels after it shrink by half
    each.
    """
    listed = cut(listed.distinct())
    n = listed.count()
    if n > MOST_LISTED:
        raise ValueError(f"{n} keys are listed; a cascade is sent whole to every task and takes {MOST_LISTED} at most: split the list by host")
    if not n:
        return Cascade(())
    others = max(1, distinct_keys(universe) if others is None else others)
    # Fixed rule: with this rate the second filter has about 0.7 times as many keys as the first, which keeps the sum of all sizes least.
    bloom = Bloom.sized(n, min(PASSED, math.sqrt(PASSED) * n / others), 0).filled(listed)
    levels, inside = [bloom], listed
    outside = cut(passing(universe, bloom).distinct().join(listed, ["a", "b"], "left_anti"))
    while n := outside.count():
        if len(levels) == MOST_LEVELS:
            raise RuntimeError("keys could not be told apart")
        bloom = Bloom.sized(n, PASSED, len(levels)).filled(outside)
        levels.append(bloom)
        inside, outside = outside, cut(passing(inside, bloom))
    return Cascade(tuple(levels))


def distinct_keys(keys: DataFrame) -> int:
    """About how many distinct keys (a, b) there are, from a sketch of bounded size."""
    return keys.agg(F.approx_count_distinct("a")).first()[0]


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null and without ://."""
    return F.translate(F.regexp_extract(_after(url), "^([^/?#]*)", 1), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.regexp_extract(_after(url), "^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")


def candidates(host: Column, path: Column, labels: Sequence[int], lengths: Sequence[int]) -> Column:
    """The keys under which a rule for a url could be listed, the longest first (of equal ones the longer host first).

    A host counts with its last n labels for each n of ``labels``, a path with
    its first k code points for each k of ``lengths``.
    """
    parts = F.split(host, r"\.")
    found = []
    for n in labels:
        tail = F.array_join(F.slice(parts, -n, n), ".")
        for k in lengths:
            key = F.struct((-F.char_length(tail) - k).alias("long"), (-F.char_length(tail)).alias("host_long"), F.concat(tail, F.substring(path, 1, k)).alias("key"))
            found.append(F.when((host != "") & (F.size(parts) >= n) & (F.char_length(path) >= k), key))
    return F.transform(F.array_sort(F.array_compact(F.array(*found))), lambda x: x["key"])


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    ``rules`` has host, path (empty or beginning with /) and verdict, ``allow``
    or ``block``. The rule with the longest host and path that fits decides,
    of two as long that with the longer host; without a rule (null) the
    verdict is ``default``. One cascade holds the allowing and one the
    blocking keys, both over all keys that any url of the table has. Null urls
    and those without :// have an empty host and path and fit no rule;
    repeated rows stay rows; extra columns are left out; without rules all
    pages have the default. Rules with a null, or listed with both verdicts,
    raise.
    """
    known = rules.select(F.translate("host", UPPER, UPPER.lower()).alias("host"), "path", "verdict").distinct()
    known = cut(known.withColumn("key", F.concat("host", "path")))
    wrong = F.col("verdict").isNull() | ~F.col("verdict").isin("allow", "block") | F.col("key").isNull() | (F.col("host") == "") | F.col("host").rlike("[/?#]") | ~F.col("path").rlike("^(/|$)")
    if known.filter(wrong).limit(1).count() or known.groupBy("key").count().filter("count > 1").limit(1).count():
        raise ValueError("a rule needs a host, a path that is empty or begins with / and one verdict, allow or block")
    # the numbers of labels and code points that occur: a handful, whatever the number of rules
    shape = known.agg(F.sort_array(F.collect_set(F.size(F.split("host", r"\.")))).alias("labels"), F.sort_array(F.collect_set(F.char_length("path"))).alias("lengths")).first()
    rows = pages.select(F.col(key).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    if not shape["labels"]:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    rows = rows.withColumn("keys", candidates(F.col("host"), F.col("path"), shape["labels"], shape["lengths"]))
    universe = rows.select(F.explode("keys").alias("key")).select(*hashed(F.col("key")))
    others = distinct_keys(universe)
    cascades = {v: build(known.filter(F.col("verdict") == v).select(*hashed(F.col("key"))), universe, others) for v in ("block", "allow")}
    sent = pages.sparkSession.sparkContext.broadcast(cascades)

    @F.pandas_udf("struct<place: int, verdict: string>")
    def decided(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        sizes = a.str.len().to_numpy(dtype=np.int64)
        ends = np.cumsum(sizes)
        flat_a, flat_b = (np.concatenate([np.zeros(0, dtype=np.int64), *x]).astype(np.int64).view(np.uint64) for x in (a, b))
        verdicts = np.full(len(flat_a), None, dtype=object)
        for verdict, cascade in sent.value.items():
            verdicts[cascade.listed(flat_a, flat_b)] = verdict
        place, out = np.zeros(len(a), dtype=np.int32), np.full(len(a), default, dtype=object)
        at = np.flatnonzero(verdicts != np.array(None))[::-1]  # backwards, so that the first of a row stays
        row = np.searchsorted(ends, at, side="right")
        place[row], out[row] = at - (ends - sizes)[row] + 1, verdicts[at]
        return pd.DataFrame({"place": place, "verdict": out})

    rows = rows.withColumn("_d", decided(F.transform("keys", lambda k: hashed(k)[0]), F.transform("keys", lambda k: hashed(k)[1])))
    return rows.select("page_id", "host", "path", F.when(F.col("_d.place") > 0, F.get("keys", F.col("_d.place") - 1)).alias("rule"), F.col("_d.verdict").alias("verdict"))


def rule_table(like: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    return like.sparkSession.createDataFrame(list(rules), "host string, path string, verdict string")
