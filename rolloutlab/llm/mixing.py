"""Mixing sources to target weights.

Every source's documents, in a fixed order, are one stream of words cut into
fixed-length blocks. Output shards draw how many of their slots each source
fills from a multinomial over what the sources still owe, so that the totals
come out as planned. A slot's rank in its source goes through a pseudorandom
permutation of the source's block numbers, one permutation per pass, and slots
and blocks are joined by number. No block is used a third time before all
were used twice, so a target of at most twice a source's size holds for each
of its documents.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import WORD, aside, cut, numbered

BLOCK = 64
SHARDS = 64
CHUNK = 4096
STREAM_BUCKETS = 1024
MASK = (1 << 64) - 1


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def target_sizes(sizes: Sequence[int], weights: Sequence[float], total: float, most: float) -> list[float]:
    """Shares of ``total`` by weight; none above ``most`` times its size, the excess reshared by weight."""
    out: list[float | None] = [None] * len(sizes)
    while True:
        open_ = [i for i, t in enumerate(out) if t is None]
        left = total - sum(t for t in out if t is not None)
        weight = sum(weights[i] for i in open_)
        above = [i for i in open_ if left * weights[i] / weight > most * sizes[i]]
        if not above:
            break
        for i in above:
            out[i] = most * sizes[i]
    return [left * weights[i] / weight if t is None else t for i, t in enumerate(out)]


def draw_counts(owed: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Slots by shard and source: multinomial draws over what is still owed; columns sum to ``owed``."""
    rng = np.random.default_rng(seed)
    left = owed.astype(np.int64).copy()
    out = np.zeros((shards, len(left)), dtype=np.int64)
    for shard in range(shards):
        need = int(-(-left.sum() // (shards - shard)))
        while need > 0:
            drawn = np.minimum(rng.multinomial(need, left / left.sum()), left)
            out[shard] += drawn
            left -= drawn
            need -= int(drawn.sum())
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(index: np.ndarray, size: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """A bijection of 0..size-1 for each (size, salt): a Feistel network, walked until it falls inside."""
    at, n, key = index.astype(np.uint64), size.astype(np.uint64), salt.astype(np.uint64)
    half = np.array([max(1, (int(v - 1).bit_length() + 1) // 2) for v in size.tolist()], dtype=np.uint64)
    low = (np.uint64(1) << half) - np.uint64(1)
    open_ = np.arange(len(at))
    while len(open_):
        h, m, k = half[open_], low[open_], key[open_]
        left, right = at[open_] >> h, at[open_] & m
        for turn in range(4):
            left, right = right, left ^ (mixed(right + k + np.uint64(turn * 0x9E3779B97F4A7C15 & MASK)) & m)
        at[open_] = (left << h) | right
        open_ = open_[at[open_] >= n[open_]]
    return at.astype(np.int64)


@F.pandas_udf(StructType([StructField("slot", LongType()), StructField("block", LongType())]))
def dealt(place: pd.Series, slots: pd.Series, shard_salt: pd.Series, rank: pd.Series, blocks: pd.Series, source_salt: pd.Series) -> pd.DataFrame:
    """The slot of a place in a shard and the block of a rank in a source: one call for both, so that a task needs one worker."""
    return pd.DataFrame({"slot": permute(place.to_numpy(), slots.to_numpy(), shard_salt.to_numpy()), "block": permute(rank.to_numpy(), blocks.to_numpy(), source_salt.to_numpy())})


#: Its block number is a join key: as a function that may not be repeated it runs once, and not again in a filter for nulls.
dealt = dealt.asNondeterministic()


class Mix:
    """The mix of ``docs`` (doc_id, text, source): weights repeat over the sources in code point order, null last.

    Sizes are words; a null text has none. ``total`` is the share of all words
    that the targets sum to. One row per source comes to the driver. Repeated
    rows are documents of their own; empty input gives no rows.
    """

    def __init__(self, docs: DataFrame, weights: Sequence[float] = (3, 1, 2), total: float = 1.5, most: float = 2.0,
                 block: int = BLOCK, shards: int = SHARDS, seed: int = 41):
        spark = docs.sparkSession
        rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text", "source").alias("tag"))
        rows = cut(rows)
        found = rows.groupBy("source").agg(F.sum("size").alias("size")).collect()  # one row per source
        found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
        sizes = [int(r["size"]) for r in found]
        targets = target_sizes(sizes, [weights[i % len(weights)] for i in range(len(found))], total * sum(sizes), most)
        words = [min(round(t), int(most * n)) for t, n in zip(targets, sizes)]
        blocks = [-(-n // block) for n in sizes]
        passes = [w // n if n else 0 for w, n in zip(words, sizes)]
        rest = [w - p * n for w, p, n in zip(words, passes, sizes)]
        owed = [p * b + -(-r // block) for p, b, r in zip(passes, blocks, rest)]
        last = [(r - 1) % block + 1 if r else block for r in rest]
        kind = pa.schema([("source_no", pa.int64()), ("source", pa.string()), ("source_size", pa.int64()), ("target", pa.float64()),
                          ("blocks", pa.int64()), ("owed", pa.int64()), ("last", pa.int64())])
        columns = [list(range(len(found))), [r["source"] for r in found], sizes, targets, blocks, owed, last]
        self.sources = spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind)], schema=kind))
        self.block, self.seed = block, seed
        named = rows.join(self.sources.select("source_no", F.col("source").alias("_name")), F.col("source").eqNullSafe(F.col("_name"))).drop("_name")
        bucket = F.pmod(F.xxhash64("doc_id", "tag"), F.lit(STREAM_BUCKETS)).cast("int")
        #: Each document's place in its source's stream of words.
        self.stream = cut(numbered(named, ["source_no"], ["doc_id", "tag"], "begin", bucket, "size"))
        counts = draw_counts(np.array(owed, dtype=np.int64), shards, seed) if sum(owed) else np.zeros((0, len(owed)), dtype=np.int64)
        shard, source = np.nonzero(counts)
        cells = pa.table({"shard": shard.astype(np.int64), "source_no": source.astype(np.int64), "count": counts[shard, source],
                          "rank": (np.cumsum(counts, axis=0) - counts)[shard, source], "place": (np.cumsum(counts, axis=1) - counts)[shard, source],
                          "shard_slots": counts.sum(axis=1)[shard] if len(counts) else np.zeros(0, dtype=np.int64)})
        self.cells = spark.createDataFrame(cells)

    def slots(self) -> DataFrame:
        """One row per slot: shard, slot (its place there), source_no, pass, block number, and how many words it may take."""
        step = F.lit(CHUNK).cast("long")
        chunks = self.cells.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("count") - 1) / step))))
        width = F.least(step, F.col("count") - F.col("_c") * step)
        rows = (chunks.withColumn("_w", width).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_w") - 1)))
                .withColumn("_n", F.col("_c") * step + F.col("_i"))
                .select("shard", "source_no", "shard_slots", (F.col("rank") + F.col("_n")).alias("rank"), (F.col("place") + F.col("_n")).alias("place")))
        rows = rows.join(self.sources.select("source_no", "blocks", "owed", "last"), "source_no")
        turn = F.expr("rank div blocks")
        both = dealt("place", "shard_slots", F.col("shard") * 2 + F.lit(1 + 2 * self.seed * 1_000_003), F.col("rank") % F.col("blocks"), "blocks",
                     F.col("source_no") * 2_000_006 + turn * 2 + F.lit(2 * self.seed))
        room = F.when(F.col("rank") == F.col("owed") - 1, F.col("last")).otherwise(F.lit(self.block))
        return rows.select("shard", "source_no", turn.alias("pass"), room.alias("room"), both.alias("_d")).select("shard", F.col("_d.slot").alias("slot"), "source_no", "pass", F.col("_d.block").alias("block"), "room")

    def pieces(self) -> DataFrame:
        """One row per slot and document in it: the slot's columns, source_no, begin (the document), first and words (its words taken)."""
        size = F.lit(self.block).cast("long")
        end = F.col("begin") + F.col("size")
        spread = (self.stream.filter("size > 0").select("source_no", "begin", "size", "doc_id", "tag", F.explode(
            F.sequence(F.floor(F.col("begin") / size), F.floor((end - 1) / size))).alias("block")))
        start = F.col("block") * size
        spread = (spread.withColumn("_from", F.greatest("begin", start) - start).withColumn("_to", F.least(end, start + size) - start)
                  .withColumn("first", F.greatest("begin", start) - F.col("begin")))
        met = self.slots().join(spread, ["source_no", "block"])
        return met.withColumn("words", F.least("_to", "room") - F.col("_from")).filter("words > 0").drop("_from", "_to", "room")

    def per_document(self) -> DataFrame:
        """doc_id, source, size, source_size, target, taken, first_shard, first_slot (where the mix first uses it): one row per document, also those that the mix leaves out."""
        taken = self.pieces().groupBy("source_no", "begin").agg(F.sum("words").alias("_taken"), F.min(F.struct("shard", "slot")).alias("_at"))
        key = (F.col("s.source_no") == F.col("t.source_no")) & (F.col("s.begin") == F.col("t.begin")) & (F.col("s.size") > 0)
        rows = self.stream.alias("s").join(taken.alias("t"), key, "left").select("s.*", F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"), F.col("_at.shard").alias("first_shard"), F.col("_at.slot").alias("first_slot"))
        return (rows.join(self.sources.drop("source", "blocks", "owed", "last"), "source_no")
                .select("doc_id", "source", "size", "source_size", "target", "taken", "first_shard", "first_slot"))

    def packed(self, docs: DataFrame) -> DataFrame:
        """The mix as it is written out: shard, slot (gapless from 0 in each shard), source, words and text, one row per block.

        A block's words are joined by single spaces; the last block of a
        source may be shorter than the others.
        """
        texts = docs.select("doc_id", "text", F.xxhash64("text", "source").alias("tag")).dropDuplicates(["doc_id", "tag"])
        texts = texts.withColumnsRenamed({"doc_id": "_id", "tag": "_tag"})
        pieces = self.pieces()
        met = pieces.join(texts, pieces["doc_id"].eqNullSafe(texts["_id"]) & (pieces["tag"] == texts["_tag"]))

        @F.pandas_udf("string")
        def part(texts: pd.Series, first: pd.Series, words: pd.Series) -> pd.Series:
            return pd.Series([" ".join(m[0] for m in islice(re.finditer(WORD, t), int(a), int(a + n))) for t, a, n in zip(texts, first, words)])

        cut_out = met.select("shard", "slot", "source_no", "begin", "words", part("text", "first", "words").alias("_part"))
        ordered = F.sort_array(F.collect_list(F.struct("begin", "_part")))  # a block has few pieces
        blocks = cut_out.groupBy("shard", "slot", "source_no").agg(F.sum("words").alias("words"), F.array_join(F.transform(ordered, lambda x: x["_part"]), " ").alias("text"))
        return blocks.join(self.sources.select("source_no", "source"), "source_no").select("shard", "slot", "source", "words", "text")

    def documents(self, docs: DataFrame) -> DataFrame:
        """The documents as the mix takes them, in the columns of ``docs``: one row per document and pass, n_chars renewed.

        A document taken whole keeps its text as it is; of one taken in part,
        each run of consecutive words taken is kept with the white space
        inside, runs joined by a line break.
        """
        spans = (self.pieces().groupBy("source_no", "begin", "pass", "doc_id", "tag", "size")
                 .agg(F.sort_array(F.collect_list(F.struct("first", "words"))).alias("_spans"))
                 .select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), F.col("size").alias("_size"), "_spans"))
        order = docs.columns
        docs, names = aside(docs, ("doc_id", "text", "source", "n_chars"))
        tagged = docs.withColumn("_t", F.xxhash64("text", "source")).dropDuplicates(["doc_id", "_t"])
        met = tagged.join(spans, tagged["doc_id"].eqNullSafe(spans["_id"]) & (tagged["_t"] == spans["_tag"]))

        @F.pandas_udf("string")
        def parts(texts: pd.Series, sizes: pd.Series, spans: pd.Series) -> pd.Series:
            return pd.Series([taken_text(t, int(n), s) for t, n, s in zip(texts, sizes, spans)])

        out = met.withColumn("text", parts("text", "_size", "_spans"))
        if "n_chars" in docs.columns:
            out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
        return out.select(*docs.columns).withColumnsRenamed(names).select(*order)


def taken_text(text: str, size: int, spans: Sequence[dict]) -> str:
    """The runs of words that the spans (first, words) take; the text itself if they take all."""
    runs: list[list[int]] = []
    for s in spans:
        first, n = int(s["first"]), int(s["words"])
        if runs and runs[-1][1] == first:
            runs[-1][1] = first + n
        else:
            runs.append([first, first + n])
    if runs == [[0, size]]:
        return text
    at = [m.span() for m in re.finditer(WORD, text)]
    return "\n".join(text[at[a][0]: at[b - 1][1]] for a, b in runs)


def mix_sizes(docs: DataFrame, **how) -> DataFrame:
    """How much of each document the mix takes: one row per document, also of null and empty texts (size 0, none taken); repeated rows are documents of their own."""
    return Mix(docs, **how).per_document()


def mix_blocks(docs: DataFrame, **how) -> DataFrame:
    """The mix as packed blocks by output shard and slot; null and empty texts give none, an empty input no rows."""
    return Mix(docs, **how).packed(docs)


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """The documents as the mix takes them, in their columns: one row per document and pass. Null and empty texts aren't taken; of repeated rows with one
    doc_id, text and source any one's further columns stand for all; columns may have any names; empty input gives no rows."""
    return Mix(docs, **how).documents(docs)


