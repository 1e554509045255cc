"""Fill-in-middle, URL filters and whitening against slow versions, and on nulls, repeats, empty tables and clashing columns."""

import hashlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from rolloutlab.llm import queries
from rolloutlab.llm.infilling import GRAMMARS, Grammar, Marks, fill_in_middle, infilled_digests, restored, units
from rolloutlab.llm.url_filters import RULES, build, filter_urls, hashed, rule_table
from rolloutlab.llm.whitening import BLOCK, FARTHEST, PRIME_TOP, centred_residues, primes_for, remaindered, whiten

from .test_operators import empty, odd, prose  # noqa: F401  fixtures

# ---- fill-in-middle -----------------------------------------------------------

#: The unit grammars as patterns matched one after another.
PATTERNS = {
    "code_point": r"(?s).",
    "line": r"[^\n]*\n|[^\n]+",
    "word": r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+",
    "run": r"(?V1)[\p{L}\p{M}]+|\p{Nd}+|[ \t-\r]+|(?s).",
}
TEXTS = ["a\U0001f600b\U0001f600\U0001f600", "\U0001d49c\U0001d49cx 12\xe9 \U0001d7d8\U0001d7d9z", "a\n\nb\r\n", "  hi there \t yo ", "\U0001f600\n\U0001f600 \U0001f600", "", "x", "\n", " \n ", "e\u0301e\u0301 9a9", "<P", "a<P>b", "..--..", "\x00\x1f\x7f\u2028 \x85"]


@pytest.mark.parametrize("name", sorted(GRAMMARS))
def test_boundaries_cut_as_the_grammar_matches(spark, name):
    rng = np.random.default_rng(3)
    letters = list("ab1 \n\t.\xe9\u0301\U0001f600\U0001d49c\U0001d7d8\ud7ff\ue000")
    texts = TEXTS + ["".join(letters[k] for k in rng.integers(0, len(letters), rng.integers(1, 40))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "text string")
    for t, u in df.select("text", units(F.col("text"), GRAMMARS[name])).collect():
        assert u == regex.findall(PATTERNS[name], t or "")


def test_a_grammar_without_ends_is_refused():
    with pytest.raises(ValueError):
        Grammar({"a": "a", "b": "^a"}, frozenset({("a", "a"), ("a", "b"), ("b", "a"), ("b", "b")})).boundary()


def slow_infilling(doc, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * k: 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    b, e = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = f"<P>{text[:b]}", f"<M>{text[b:e]}", f"<S>{text[e:]}"
    return (n, "spm", b, e - b, s + p + m) if h[3] % 100 < 20 else (n, "psm", b, e - b, p + s + m)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def check_infilling(df):
    want = []
    for r in df.collect():
        n, form, b, m, out = slow_infilling(r.doc_id, r.text)
        want.append((r.doc_id, n, form, b, m, sha(out), sha(r.text or "")))
    assert Counter(map(tuple, infilled_digests(df).collect())) == Counter(want)


def test_infilling_by_hand(spark, odd):
    check_infilling(odd.withColumns({"units": F.lit(1), "h": F.lit(1), "form": F.lit("x"), "n": F.lit(0), "begin": F.lit(2)}))
    rows = [(i, t) for i, t in enumerate([*TEXTS, *(prose(k, 3 + k) for k in range(200))])] + [(-5, "minus"), (2**62, "far"), (900, "long " * 20_000 + "\U0001f600")]
    check_infilling(spark.createDataFrame(rows, "doc_id long, text string"))
    assert infilled_digests(empty(odd)).count() == 0


@pytest.mark.parametrize("name", sorted(GRAMMARS))
def test_output_and_form_give_the_text_back(spark, name):
    marks = Marks("[[", "]]", "(.*)")
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, "[[", "x [ ] (.*", *(prose(k, k) for k in range(40))])], "doc_id long, text string")
    out = fill_in_middle(df, name, rate=100, spm_rate=50, marks=marks)
    got = {r.doc_id: r for r in out.select("*", restored(F.col("output"), F.col("form"), marks).alias("back")).collect()}
    for r in df.collect():
        assert got[r.doc_id].back == r.text
        assert (got[r.doc_id].form == "plain") == (r.text == "" or "[[" in r.text)
    assert {r.form for r in got.values()} == {"plain", "psm", "spm"}


# ---- URL filters --------------------------------------------------------------


def slow_verdict(url, rules):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = regex.match(r"[^/?#]*", rest)[0]
        path = regex.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits)[2:]) if fits else (host, path, None, "allow")


URLS = ["http://example.com/en/1", "http://EXAMPLE.com/en/", "https://www.example.com/en/a?b#c", "http://a.www.example.com/en/", "http://notexample.com/en/", "http://example.com/EN/", "http://example.com", "http://com/", "http://x.net/es/", "http://x.net/es",
        "http://net/fr/9", "http://x.org/en/", "no scheme.com/en/", None, "", "http:///en/", "http://example.com?x=/en/", "http://example.com#/en/", "a://b://example.com/en/", "http://example.com:80/en/", "http://u@example.com/en/", "http://example.com./en/",
        "http://\xc4.example.com/en/\U0001f600", "http://x.com\n/en/", "://com/x", "http://..com/", "http://.net/fr/"]


def check_urls(df, rules, pages_rules):
    want = [(r.page_id, *slow_verdict(r.url, rules)) for r in df.collect()]
    assert Counter(map(tuple, filter_urls(df, pages_rules).collect())) == Counter(want)


def test_url_filters_by_hand(spark):
    df = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(URLS)] + [(0, URLS[0], "x", 1), (None, URLS[2], None, None)], "page_id long, url string, host string, keys int")
    check_urls(df, RULES, rule_table(df))
    assert filter_urls(empty(df), rule_table(df)).count() == 0
    check_urls(df, [], rule_table(df).limit(0))


def test_many_rules(spark):
    rng = np.random.default_rng(8)
    names = ["a", "bb", "c.a", "x.c.a", "org", "y.org"]
    paths = ["", "/", "/a", "/a/", "/a/b", "/bcd"]
    rules = [(h, p, ("allow", "block")[int(rng.integers(2))]) for h in names for p in paths if rng.random() < 0.6]
    urls = [f"http://{'w' * int(rng.integers(3))}.{names[rng.integers(6)]}{paths[rng.integers(6)]}{rng.integers(9)}" for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    check_urls(df, rules, spark.createDataFrame(rules, "host string, path string, verdict string"))


@pytest.mark.parametrize("rules", [[("a", "/", "allow"), ("a", "/", "block")], [("a", "x", "block")], [("", "/", "block")], [("a", "/", None)], [(None, "/", "allow")], [("a", "/", "maybe")], [("a/b", "/", "block")]])
def test_wrong_rules_are_refused(spark, rules):
    df = spark.createDataFrame([(1, "http://a/")], "page_id long, url string")
    with pytest.raises(ValueError):
        filter_urls(df, spark.createDataFrame(rules, "host string, path string, verdict string"))


@pytest.mark.parametrize(("n", "listed"), [(5000, 700), (5000, 1), (300, 299), (40, 0), (50, 50)])
def test_cascades_are_exact(spark, n, listed):
    keys = spark.range(n).select("id", *hashed(F.concat(F.lit("k"), F.col("id"))))
    cascade = build(keys.filter(F.col("id") < listed).select("a", "b"), keys.select("a", "b").unionByName(keys.select("a", "b")))
    known = keys.orderBy("id").toPandas()
    got = cascade.listed(known["a"].to_numpy().view(np.uint64), known["b"].to_numpy().view(np.uint64))
    assert got.tolist() == [k < listed for k in range(n)]
    if listed == 700:
        assert len(cascade.levels) > 2
        assert sum(level.bits for level in cascade.levels) < 12 * listed


# ---- whitening ----------------------------------------------------------------


def test_residues_give_whole_numbers_back():
    rng = np.random.default_rng(4)
    for bound in (0, 1, 10**9, 10**40):
        primes = primes_for(bound)
        whole = [0, bound, -bound, *(int(x) * bound // 10**6 for x in rng.integers(-10**6, 10**6, 20))]
        assert remaindered([np.array([w % p for w in whole]) for p in primes], primes) == whole
        assert all(p < PRIME_TOP for p in primes) and len(set(primes)) == len(primes)
    assert (PRIME_TOP // 2) ** 2 * BLOCK <= 2**53
    x = rng.integers(-FARTHEST, FARTHEST, (50, 3))
    p, sums = primes_for(1)[0], [int(s) for s in x.sum(axis=0)]
    z = centred_residues(x, 50, sums, p)
    assert all((int(a) - (50 * int(b) - s)) % p == 0 for row, of in zip(z, x, strict=True) for a, b, s in zip(row, of, sums, strict=True))


def slow_whitening(vectors, most=16):
    """n, deviation per row, components as columns, eigenvalues and shares, by fractions and one eigh."""
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors], dtype=object)
    fit = np.array(sorted(set(map(tuple, x.tolist()))), dtype=object)
    n, total = len(fit), fit.sum(axis=0)
    z = n * fit - total
    exact = z.T.dot(z)
    v = np.array([[float(Fraction(int(m), n**3)) for m in row] for row in exact])
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values)[:most]
    off = n * x - total
    return n, [int((r * r).sum()) for r in off], (off / n).astype(float) @ vectors[:, order] / np.sqrt(values[order]), values[order] / np.trace(v)


@pytest.mark.parametrize(("n", "width", "centre", "spread"), [(300, 20, 0.0, 1.0), (80, 5, 5e6, 0.5), (500, 8, -3.0, 40.0), (40, 1, 2.0, 1.0)])
def test_whitening_by_hand(spark, n, width, centre, spread):
    rng = np.random.default_rng(n)
    made = (centre + spread * rng.normal(size=(n, width)) @ rng.normal(size=(width, width))).tolist()
    rows = [(i, v, 1) for i, v in enumerate(made)] + [(i, made[0], 1) for i in range(n, n + 30)] + [(7, made[7], 1), (None, made[1], None)]
    bad = [(900, None, 1), (901, [None] * width, 1), (902, [float("nan")] * width, 1), (903, [float("inf")] * width, 1)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit("x") for c in ("x", "n", "component", "width", "deviation")})
    count, deviation, want, share = slow_whitening([r[1] for r in rows])
    got = whiten(df).toPandas()
    assert len(got) == len(rows) * min(width, 16) and set(got["n"]) == {count} and not set(got["vec_id"]) & {900, 901, 902, 903}
    assert got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-9
    signs = {}
    for i, r in enumerate(rows):
        mine = got[got["vec_id"].isna() if r[0] is None else got["vec_id"] == r[0]]
        assert set(mine["deviation"]) == {deviation[i]}
        for k, part in mine.groupby("component"):
            sign = signs.setdefault(k, np.sign(part["whitened"].iloc[0] * want[i][k - 1]))
            assert np.allclose(part["whitened"], sign * want[i][k - 1], rtol=1e-6, atol=1e-7)
            assert np.allclose(part["explained"], share[k - 1], rtol=1e-8)


def test_whitening_of_odd_tables(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [3.0, 2.0]), (4, [5.0]), (5, [])], "vec_id long, embedding array<float>")
    got = sorted((r.vec_id, r.component, r.n, r.deviation, round(abs(r.whitened), 9), r.explained) for r in whiten(df).collect())
    # two distinct vectors that differ in one direction; a width with a single vector and one of no width have no component
    assert got == [(i, 1, 2, 128**2, 1.0, 1.0) for i in (1, 2, 3)]
    assert whiten(empty(df)).count() == 0 and whiten(df.filter("vec_id > 3")).count() == 0
    assert whiten(empty(df)).schema.simpleString() == whiten(df).schema.simpleString()
    with pytest.raises(Exception, match="too large for the grid"):
        whiten(spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<double>")).collect()


@pytest.mark.parametrize("name", ["op11_infilling", "op12_url_filters"])
def test_new_queries_equal_their_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    rel = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in rel.description]
    got = queries.queries()[name](spark, data)
    assert sorted(got.columns) == sorted(columns)
    assert Counter(map(tuple, got.select(*columns).collect())) == Counter(rel.fetchall())
