"""Line dedup through a suffix array over line-ID sequences (native).

Documents are sequences of line IDs. Ranks of all suffixes by their first 1,
2, 4, ... lines come from distributed prefix doubling: a class of suffixes
with equal rank is split by the rank of the suffix 2^k lines on, and a
suffix's new rank is the old one plus the number of suffixes of its class that
sort before. Lines that occur once end every repeated run, so only repeated
lines take part. The longest-common-prefix interval of depth m around a suffix
is named by the ranks of its first and its last 2^k lines (2^k <= m < 2^(k+1)).

A run of lines counts as repeated from ``min_words`` words on. Around each
line the shortest such run that starts there and the shortest that ends there
are looked up; together these cover every maximal repeated run that is long
enough. All but the first copy, by (doc_id, text hash, line), are deleted.
As a line has a word at least, ``min_words`` lines are the deepest prefix
needed: the number of doubling rounds doesn't grow with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, aside, cut, numbered, spread_join

MIN_WORDS = 50
RANK_BUCKETS = 256
#: A class of more than total / MOST_HOT lines is dealt over WAYS tasks.
MOST_HOT, WAYS = 1000, 64
DOC = ["doc_id", "tag"]


def text_lines(text: Column) -> Column:
    """The lines of a text that aren't blank, in order; trailing blanks don't tell lines apart."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_replace(x, SPACE + "$", "")), lambda x: x != "")


def line_ids(docs: DataFrame) -> DataFrame:
    """One row per line: doc_id, tag (text hash), line (from 0), two hashes as its ID, words; repeated rows count once."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("tag"), F.posexplode(text_lines(F.col("text"))).alias("line", "_l"))
    words = F.regexp_count("_l", F.lit(SPACE)) + F.when(F.col("_l").rlike(r"^[\x20\x09-\x0D]"), 0).otherwise(1)
    return rows.select(*DOC, "line", F.xxhash64("_l").alias("a"), F.hash("_l").alias("b"), words.cast("int").alias("words")).distinct()


def first_ranks(lines: DataFrame) -> DataFrame:
    """Lines that occur more than once, with the rank r0 of their ID and the size of its class."""
    ids = lines.groupBy("a", "b").agg(F.count("*").alias("size")).filter("size > 1")
    ranked = cut(numbered(ids, [], ["a", "b"], "r0", F.shiftright("a", 54).cast("int"), "size"))
    total = ranked.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    return spread_join(lines, ranked, ["a", "b"], "size", total, [*DOC, "line"], WAYS, MOST_HOT).drop("a", "b")


def double(at: DataFrame, k: int, total: int) -> DataFrame:
    """Adds rank r{k+1} by the first 2^(k+1) lines and renews ``size``, the size of the class."""
    old, new = f"r{k}", f"r{k + 1}"
    ahead = Window.partitionBy(*DOC).orderBy("line").rangeBetween(2**k, 2**k)
    seen = at.withColumn("_next", F.when(F.col("size") > 1, F.coalesce(F.max(old).over(ahead), F.lit(-1))))
    classes = seen.filter("size > 1").groupBy(old, "_next").agg(F.count("*").alias("_size"), F.max("size").alias("_whole"))
    step = max(1, total // RANK_BUCKETS)
    classes = numbered(classes, [old], ["_next"], "_before", F.floor(F.col("_next") / step).cast("int"), "_size")
    # lines know how large their class was, so both sides know which classes are dealt
    large = max(1000, total // MOST_HOT)
    ways = F.when(F.col("_whole") > large, F.sequence(F.lit(0), F.lit(WAYS - 1))).otherwise(F.array(F.lit(0)))
    classes = classes.withColumn("_there", F.explode(ways)).drop("_whole").withColumnRenamed(old, "_old").withColumnRenamed("_next", "_then")
    seen = seen.withColumn("_way", F.when(F.col("size") > large, F.pmod(F.xxhash64(*DOC, "line"), F.lit(WAYS)).cast("int")).otherwise(0))
    met = seen.join(classes, (F.col(old) == F.col("_old")) & (F.col("_next") == F.col("_then")) & (F.col("_way") == F.col("_there")), "left")
    return (met.withColumn(new, F.col(old) + F.coalesce("_before", F.lit(0)))
            .withColumn("size", F.coalesce("_size", F.lit(1)))
            .drop("_next", "_old", "_then", "_size", "_before", "_way", "_there"))


def shortest_runs(at: DataFrame, min_words: int) -> DataFrame:
    """For each line the shortest runs of ``min_words`` words that start or end there: doc_id, tag, start, m (lines)."""
    part = at.withColumn("_run", F.col("line") - F.row_number().over(Window.partitionBy(*DOC).orderBy("line")))

    def reach(words: Column) -> Column:
        """How many words of the list, from its start, make min_words; null if it has fewer."""
        start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n"))
        ended = F.aggregate(words, start, lambda s, w: F.when(s["sum"] >= min_words, s).otherwise(F.struct((s["sum"] + w).alias("sum"), (s["n"] + 1).alias("n"))))
        return F.when(ended["sum"] >= min_words, ended["n"])

    by_run = Window.partitionBy(*DOC, "_run").orderBy("line")
    on = F.when(F.col("words") >= min_words, F.lit(1)).otherwise(reach(F.collect_list("words").over(by_run.rowsBetween(0, min_words - 1))))
    back = F.when(F.col("words") >= min_words, F.lit(1)).otherwise(reach(F.reverse(F.collect_list("words").over(by_run.rowsBetween(1 - min_words, 0)))))
    both = part.select(*DOC, "line", on.alias("_on"), back.alias("_back"))
    found = both.select(*DOC, F.explode(F.array(F.struct(F.col("line").alias("start"), F.col("_on").alias("m")),
                                                F.struct((F.col("line") - F.col("_back") + 1).alias("start"), F.col("_back").alias("m")))).alias("_w"))
    return found.select(*DOC, "_w.*").filter("m is not null").distinct()


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, tag and ``lines``, the numbers of the lines to delete, for documents that lose any."""
    at = cut(first_ranks(cut(line_ids(docs))))
    total = at.count()
    runs = cut(shortest_runs(at, min_words))
    deepest = runs.agg(F.max("m")).first()[0] or 1
    levels = deepest.bit_length()  # the last level's prefix is at most the deepest run
    for k in range(levels - 1):
        at = cut(double(at, k, total))
    ranks = at.select(*[F.col(c).alias(f"_{c}") for c in DOC], F.col("line").alias("_line"), F.array(*[f"r{k}" for k in range(levels)]).alias("_ranks"))
    level = F.expr("cast(floor(log2(m)) as int)")
    keyed = runs.withColumn("_k", level).withColumn("_last", F.col("start") + F.col("m") - F.expr("cast(shiftleft(1, _k) as int)"))

    def look(rows: DataFrame, place: str, name: str) -> DataFrame:
        same = rows["doc_id"].eqNullSafe(ranks["_doc_id"]) & (rows["tag"] == ranks["_tag"]) & (rows[place] == ranks["_line"])
        return rows.join(ranks, same).withColumn(name, F.element_at("_ranks", F.col("_k") + 1)).drop("_doc_id", "_tag", "_line", "_ranks")

    keyed = look(keyed, "start", "head")
    if levels > 1:
        keyed = look(keyed, "_last", "tail")
    else:
        keyed = keyed.withColumn("tail", F.col("head"))
    keyed = cut(keyed.select(*DOC, "start", "m", "head", "tail"))
    place = F.struct(*DOC, "start")
    firsts = cut(keyed.groupBy("m", "head", "tail").agg(F.min(place).alias("_first"), F.count("*").alias("_n")).filter("_n > 1"))
    later = spread_join(keyed, firsts, ["m", "head", "tail"], "_n", 2 * total, [*DOC, "start"], WAYS, MOST_HOT).filter(place > F.col("_first"))
    gone = later.select(*DOC, F.explode(F.sequence("start", F.col("start") + F.col("m") - 1)).alias("line"))
    return gone.groupBy(*DOC).agg(F.array_sort(F.collect_set("line")).alias("lines"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of ``docs`` with the text left after deletion, and n_lines, n_deleted.

    Texts that lose nothing stay as they are, also null and empty ones; a text
    that loses lines loses its blank lines too, and may end up empty. Repeated
    rows with one doc_id and text share a fate. Empty input gives no rows.
    Extra columns pass through, but n_lines and n_deleted are this operator's.
    """
    docs = docs.drop("n_lines", "n_deleted")
    order = docs.columns
    docs, names = aside(docs, ("doc_id", "text"))
    gone = repeated_lines(docs, min_words).select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), "lines")
    tagged = docs.withColumn("_t", F.xxhash64("text"))
    met = tagged.join(gone, tagged["doc_id"].eqNullSafe(gone["_id"]) & (tagged["_t"] == gone["_tag"]), "left")
    lines = text_lines(F.col("text"))
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("lines", i)), "\n")
    out = met.select(*[c for c in docs.columns if c != "text"], F.size(lines).cast("long").alias("n_lines"),
                      F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_deleted"),
                      F.when(F.col("lines").isNull(), F.col("text")).otherwise(left).alias("text"))
    return out.withColumnsRenamed(names).select(*[c for c in order if c != "text"], "n_lines", "n_deleted", "text")
