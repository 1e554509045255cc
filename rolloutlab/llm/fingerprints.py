"""Document fingerprints by SimHash (native).

The distinct words of a text, weighted by their length, vote with their hashes
on 64 signed bits. Two 32-bit counters are added in one long, so that 32 sums
hold all votes and partial sums leave each map task as one row per document.
Permuted block tables answer radius queries: of six blocks three agree exactly
wherever three bits differ at most, and there is one table per choice of
three blocks, keyed by them.
"""

from __future__ import annotations

import json
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, cut

LONGEST = 12
#: Fills the place of a null doc_id in comparisons that tell null ones apart first.
NO_ID = -(1 << 63)
#: Documents that the ranges are balanced on, at least so many a range.
SAMPLED, SAMPLED_A_RANGE = 20_000, 20
#: Documents a task, ranges a task, and the most tasks that this asks for: the cuts between ranges are part of the plan.
DOCS_A_TASK, RANGES_A_TASK, MOST_TASKS = 20_000, 4, 10_000
KEY = ["doc_id", "tag"]
#: Bit offsets of the six blocks and the end.
BLOCKS = (0, 11, 22, 33, 43, 54, 64)


def fingerprints(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys and ``fp``: one row per distinct keys; zero where the text has no words."""
    votes = rows.select(*keys, F.explode_outer(F.array_distinct(F.split(F.lower(text), SPACE))).alias("_t"))
    votes = votes.select(*keys, F.xxhash64("_t").alias("_h"),
                         F.when(F.length("_t") > 0, F.least(F.length("_t"), F.lit(LONGEST))).otherwise(0).cast("long").alias("_w"))
    pair = F.lit(0x0000000100000001)
    sums = votes.groupBy(*keys).agg(F.sum("_w").alias("_all"), *[
        F.sum(F.shiftrightunsigned("_h", i).bitwiseAND(pair) * F.col("_w")).alias(f"_s{i}") for i in range(32)])
    fp = F.lit(0).cast("long")
    for i in range(32):
        low, high = F.col(f"_s{i}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"_s{i}", 32)
        fp = fp.bitwiseOR(F.when(low * 2 > F.col("_all"), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
        fp = fp.bitwiseOR(F.when(high * 2 > F.col("_all"), F.shiftleft(F.lit(1).cast("long"), i + 32)).otherwise(F.lit(0).cast("long")))
    return sums.select(*keys, fp.alias("fp"))


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal bits."""
    return 1.0 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def tables(fps: DataFrame, keep: list[str]) -> DataFrame:
    """One row per fingerprint and block table: keep, fp, table, key."""
    choices = []
    for no, chosen in enumerate(combinations(range(6), 3)):
        mask = sum((1 << BLOCKS[b + 1]) - (1 << BLOCKS[b]) for b in chosen)
        mask -= (1 << 64) if mask >= 1 << 63 else 0
        choices.append(F.struct(F.lit(no).alias("table"), F.col("fp").bitwiseAND(F.lit(mask).cast("long")).alias("key")))
    return fps.select(*keep, "fp", F.explode(F.array(*choices)).alias("_c")).select(*keep, "fp", "_c.*")


def within(fps: DataFrame, asked: DataFrame, radius: int = 3) -> DataFrame:
    """All pairs (fp of asked, found of fps) of distinct fingerprints at ``radius`` bits or fewer (up to 3)."""
    if not 0 <= radius <= 3:
        raise ValueError("six blocks of which three agree find up to three differing bits")
    left = tables(asked.select("fp").distinct(), []).withColumnRenamed("fp", "asked")
    right = tables(fps.select("fp").distinct(), []).select(F.col("fp").alias("found"), F.col("table").alias("_t"), F.col("key").alias("_k"))
    near = F.bit_count(F.col("asked").bitwiseXOR(F.col("found"))) <= radius
    # Spark takes the tables for no larger than the file of the fingerprints, of which each makes twenty rows: without the hint it would gather them in the driver
    met = left.join(right.hint("merge"), (F.col("table") == F.col("_t")) & (F.col("key") == F.col("_k")) & near)
    return met.select(F.col("asked").alias("fp"), "found").distinct()


def bounds(ids: DataFrame, parts: int) -> list[tuple]:
    """Up to parts - 1 pairs (doc_id, tag), in order, that cut the distinct documents into about equal ranges.

    They come from a sample of documents by hash, about SAMPLED_A_RANGE a range
    and SAMPLED at least: only the balance of the ranges hangs on it, no result
    does. The sample is bounded by the number of tasks.
    """
    n, most = ids.count(), max(SAMPLED, SAMPLED_A_RANGE * parts)
    drawn = F.pmod(F.xxhash64("doc_id", "tag", F.lit(7)), F.lit(1_000_003)) * max(n, 1) < F.lit(1_000_003 * most)
    found = [tuple(r) for r in ids.filter(drawn).select(*KEY).limit(4 * most).collect()]
    found.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    return list(dict.fromkeys(found[len(found) * k // parts] for k in range(1, parts))) if found else []


def range_of(cuts: list[tuple]) -> Column:
    """The number of the range of a document: how many of the cuts it doesn't come before."""
    pairs = F.from_json(F.lit(json.dumps([{"known": i is not None, "id": NO_ID if i is None else i, "tag": t} for i, t in cuts])),
                        "array<struct<known: boolean, id: bigint, tag: bigint>>")
    number = F.coalesce(F.col("doc_id"), F.lit(NO_ID).cast("long"))
    at = F.struct(F.col("doc_id").isNotNull().alias("known"), number.alias("id"), F.col("tag").alias("tag"))
    widths = F.array(*[F.lit(1 << k) for k in range(len(cuts).bit_length() - 1, -1, -1)])
    # a binary search, as there are as many cuts as tasks
    return F.aggregate(widths, F.lit(0), lambda low, w: F.when(F.get(pairs, low + w - 1) <= at, low + w).otherwise(low))


def with_successors(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs (doc_id, tag, text) with next_id, next_tag and next_text, those of the next document.

    Documents go by doc_id (null first) and, where it is shared, by text hash;
    the last is followed by the first. Of repeated rows each is followed by
    its like and the last by the next document. ``ids`` are the distinct
    documents. Whole texts travel once, to the task of their range, and look
    ahead one row there; the first document of a range goes to the range
    before too, where it stands behind the last one. There are as many tasks
    as their number asks for, DOCS_A_TASK each up to MOST_TASKS, and several
    ranges a task.
    """
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, -(-ids.count() // DOCS_A_TASK)))
    part = range_of(bounds(ids, RANGES_A_TASK * parts))
    first = ids.withColumn("part", part).groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), *KEY)).alias("_f"))
    heads = sorted((r["part"], r["_f"]["doc_id"], r["_f"]["tag"]) for r in first.collect())  # one row per range
    known = dict.fromkeys(range(heads[-1][0] + 1 if heads else 0))
    known |= {p: {"known": i is not None, "id": NO_ID if i is None else i, "tag": tag, "before": heads[k - 1][0]} for k, (p, i, tag) in enumerate(heads)}
    head = F.get(F.from_json(F.lit(json.dumps(list(known.values()))), "array<struct<known: boolean, id: bigint, tag: bigint, before: int>>"), part)
    number = F.coalesce(F.col("doc_id"), F.lit(NO_ID).cast("long"))
    lead = F.when((head["known"] == F.col("doc_id").isNotNull()) & (head["id"] == number) & (head["tag"] == F.col("tag")), head["before"])
    here = F.struct(F.lit(False).alias("behind"), part.alias("part"))
    places = F.when(lead.isNull(), F.array(here)).otherwise(F.array(here, F.struct(F.lit(True).alias("behind"), lead.alias("part"))))
    placed = docs.select("doc_id", "tag", "text", F.explode(places).alias("_p")).select("doc_id", "tag", "text", "_p.*").repartition(parts, "part")
    w = Window.partitionBy("part").orderBy("behind", F.asc_nulls_first("doc_id"), "tag")
    ahead = placed.withColumns({"next_id": F.lead("doc_id").over(w), "next_tag": F.lead("tag").over(w), "next_text": F.lead("text").over(w)})
    return ahead.filter("not behind").drop("behind", "part")


def fingerprint_documents(docs: DataFrame, radius: int = 3, every: int = 20) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near.

    The edited text has its last half (rounded down) replaced by as many first
    code points of the next document. n_near, for doc_ids divisible by
    ``every``, counts the distinct other fingerprints within ``radius`` bits;
    null elsewhere. Null texts count as empty; texts without words have
    fingerprint zero. Repeated rows stay rows. Empty input gives no rows;
    extra columns are left out.
    """
    text = F.coalesce("text", F.lit(""))
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text"))
    own = cut(fingerprints(whole, KEY, "text"))
    n = F.char_length("text").cast("long")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (n - half).cast("int")), F.substring(F.col("next_text"), F.lit(1), half))
    made = with_successors(whole, own.select(*KEY)).select(*KEY, n.alias("n_chars"), "next_id", "next_tag", edited.alias("edited"))
    made = made.withColumn("edited_sha256", F.sha2("edited", 256)).withColumn("row", F.monotonically_increasing_id())
    keys = ["row", *KEY, "n_chars", "next_id", "next_tag", "edited_sha256"]
    new = cut(fingerprints(made, keys, "edited").withColumnRenamed("fp", "edited_fp"))
    near = within(own, own.filter(F.col("doc_id") % every == 0), radius).filter("fp <> found").groupBy("fp").agg(F.count("*").alias("_near"))
    mine = own.select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), "fp")
    theirs = own.select(F.col("doc_id").alias("_nid"), F.col("tag").alias("_ntag"), F.col("fp").alias("next_fp"))
    # one row per document on every side, so none is gathered in the driver, however small its file
    out = (new.join(mine.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tag") == F.col("_tag")))
           .join(theirs.hint("merge"), F.col("next_id").eqNullSafe(F.col("_nid")) & (F.col("next_tag") == F.col("_ntag")))
           .join(near.hint("merge"), "fp", "left"))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", hexed(F.col("fp")).alias("fingerprint"), hexed(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        F.when(F.col("doc_id") % every == 0, F.coalesce("_near", F.lit(0))).cast("long").alias("n_near"))
