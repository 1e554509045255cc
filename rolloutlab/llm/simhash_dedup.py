"""SimHash near-duplicates through deletion-variant signatures.

Fingerprints of 64 bits link at a Hamming distance of three or less. Cut into
two segments of 32 bits, a linked pair has a segment in which it differs by
one bit at most. Each segment is indexed under its 32 one-wildcard variants
(bit i masked, i part of the key), so that such a pair meets in an equality
join; the whole distance is verified there. Copies share a fingerprint and are
collapsed first: the join sees distinct fingerprints only. Wide fingerprints
have more segments of the same size and reach further (``near_nodes``).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut

RADIUS = 3
SEED = 42
LANES = np.uint64(0x0001000100010001)
LANE_ROWS = 65535
BATCH_HASHES = 1 << 20


def shingle_digests(text: str | None, width: int) -> list[bytes]:
    """XXH64 digests of all shingles of a text in order, repeats included.

    Only A-Z are lower-cased and only ASCII white space separates words, which
    is what bytes.lower() and bytes.split() do. Fewer words than the width make
    one shingle, no words none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_digest(line, SEED)]
    ends = list(accumulate(map(len, words), lambda at, n: at + 1 + n))
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_digest
    return [digest(line[s:e], SEED) for s, e in zip(starts, ends[width - 1:])]


def majority_bits(hashes: np.ndarray, counts: list[int]) -> np.ndarray:
    """Per document the 64 bits set in over half of its hashes; hashes lie document after document.

    Four 16-bit counters are added at once; segments are short enough that
    none overflows.
    """
    starts, owner, at = [], [], 0
    for doc, n in enumerate(counts):
        for s in range(at, at + n, LANE_ROWS):
            starts.append(s)
            owner.append(doc)
        at += n
    votes = np.zeros((len(counts), 64), dtype=np.int64)
    if starts:
        who = np.array(owner)
        for i in range(16):
            sums = np.add.reduceat((hashes >> np.uint64(i)) & LANES, starts)
            for lane in range(4):
                np.add.at(votes[:, i + 16 * lane], who, ((sums >> np.uint64(16 * lane)) & np.uint64(0xFFFF)).astype(np.int64))
    bits = votes * 2 > np.array(counts, dtype=np.int64)[:, None]
    return (bits.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def simhash(texts: list[str | None], width: int) -> np.ndarray:
    """Signed 64-bit fingerprints of the texts; zero where there is no word."""
    out, digests, counts = [], [], []

    def flush() -> None:
        hashes = np.frombuffer(b"".join(digests), dtype=">u8").astype(np.uint64)
        out.append(majority_bits(hashes, counts))
        digests.clear()
        counts.clear()

    for text in texts:
        found = shingle_digests(text, width)
        digests.extend(found)
        counts.append(len(found))
        if len(digests) >= BATCH_HASHES:
            flush()
    if counts:
        flush()
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, dtype=np.int64)


def fingerprint(text: Column, width: int) -> Column:
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(simhash(texts.tolist(), width))

    return of(text)


def linked_pairs(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """All pairs (u < v) of distinct long fingerprints ``fp`` that differ in ``radius`` bits or fewer (up to 3)."""
    if not 0 <= radius <= 3:
        raise ValueError("two segments with one wildcard find up to three differing bits")
    masked = F.expr("(seg & ~shiftleft(1L, i % 32)) | shiftleft(cast(i as bigint), 32)")
    variants = (fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
                .withColumn("seg", F.when(F.col("i") < 32, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
                            .otherwise(F.shiftrightunsigned("fp", 32)))
                .select("fp", "i", masked.alias("key")))
    left = variants.select(F.col("fp").alias("u"), "key", "i")
    right = variants.select(F.col("fp").alias("v"), F.col("key").alias("key2"))
    apart = F.col("u").bitwiseXOR(F.col("v"))
    seg = F.when(F.col("i") < 32, apart.bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned(apart, 32))
    # an equal segment meets under all its variants: only the first of them counts
    once = (seg != 0) | (F.col("i") % 32 == 0)
    # Spark takes the variants for no larger than the file of the fingerprints, of which each makes 64: without the hint it would gather them in the driver
    met = left.join(right.hint("merge"), (F.col("key") == F.col("key2")) & (F.col("u") < F.col("v")) & (F.bit_count(apart) <= radius) & once)
    return met.select("u", "v").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, radius: int = RADIUS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, n_links.

    component_id is the smallest doc_id reachable by links; texts without words
    have fingerprint zero and link like any other. Null texts count as empty.
    Documents with a null doc_id take part, but name a component only if all
    its members lack one (null then). n_links counts the documents linked
    directly, copies included. Repeated rows stay rows; extra columns are left
    out; empty input gives no rows. Joins are by sorting: all their sides grow
    with the documents, and files of a few MB tell little about rows in memory.
    """
    marked = cut(docs.select(F.col(key).alias("doc_id"), fingerprint(F.col(text), width).alias("fp")))
    fps = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")))
    links = cut(linked_pairs(fps, radius))
    groups = components(links).withColumnRenamed("node", "fp")
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    degree = (both.join(fps.select(F.col("fp").alias("v"), "copies").hint("merge"), "v").groupBy("u").agg(F.sum("copies").alias("others"))
              .withColumnRenamed("u", "fp"))
    known = cut(fps.join(groups.hint("merge"), "fp", "left").join(degree.hint("merge"), "fp", "left")
                .select("fp", "least", F.coalesce("component", "fp").alias("component"),
                        (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    names = known.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = known.join(names.hint("merge"), "component").select("fp", "component_id", "n_links")
    return (marked.join(classes.hint("merge"), "fp")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links"))


def first_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id names a component of found; of rows with one doc_id one."""
    chosen = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_chosen")).distinct()
    first = docs.dropDuplicates(["doc_id"])
    return first.join(chosen, first["doc_id"].eqNullSafe(chosen["_chosen"]), "left_semi")


# ---- wide fingerprints -------------------------------------------------------

#: The stage's fingerprint: 192 bits in six segments of 32, so that keys stay selective when there are billions of texts.
WORDS, SEGMENT = 3, 32
#: Differing bits of 192 up to which texts link: 29 are expected at a Jaccard similarity of 0.8, with a spread of 5.
NEAR = 24


def wide_simhash(texts: list[str | None], width: int, words: int = WORDS) -> np.ndarray:
    """(texts, words) signed 64-bit words: the bits set in over half of a text's hashes, and of further hashes made of these."""
    out, digests, counts = [], [], []

    def flush() -> None:
        hashes = np.frombuffer(b"".join(digests), dtype=">u8").astype(np.uint64)
        out.append(np.column_stack([majority_bits(further(hashes, k), counts) for k in range(words)]))
        digests.clear()
        counts.clear()

    for text in texts:
        found = shingle_digests(text, width)
        digests.extend(found)
        counts.append(len(found))
        if len(digests) >= BATCH_HASHES:
            flush()
    if counts:
        flush()
    return np.concatenate(out).view(np.int64) if out else np.zeros((0, words), dtype=np.int64)


def further(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th 64-bit hash made of each; the 0-th is itself."""
    if not k:
        return hashes
    x = hashes + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def differing(a: Column, b: Column, words: int) -> Column:
    return sum((F.bit_count(a[k].bitwiseXOR(b[k])) for k in range(1, words)), F.bit_count(a[0].bitwiseXOR(b[0])))


def near_nodes(nodes: DataFrame, words: int, radius: int, segments: int) -> DataFrame:
    """All pairs (u < v) of nodes (node, fp of ``words`` words) that differ in ``radius`` bits at most and in one at most of some segment.

    Up to 2 * segments - 1 bits leave such a segment, so up to that radius
    these are all pairs within it; beyond, the segment is part of what a link
    is. A segment is indexed once per wildcard: its other bits and the place
    are the key. A pair meets once a segment: with the wildcard where it
    differs, or with the first where it is equal. Only names and one bit
    travel with the keys; fingerprints are fetched for the pairs that met.
    """
    bits = 64 * words
    cuts = [bits * k // segments for k in range(segments + 1)]
    if any(b - a > 53 for a, b in zip(cuts, cuts[1:])):
        raise ValueError("a segment has 53 bits at most, as its wildcard's place stands above it")
    variants = []
    for a, b in zip(cuts, cuts[1:]):
        word, shift, length = a // 64, a % 64, b - a
        low = F.shiftrightunsigned(F.col("fp")[word], shift)
        if shift + length > 64:
            low = low.bitwiseOR(F.shiftleft(F.col("fp")[word + 1], 64 - shift))
        variants.append(_wildcards(low.bitwiseAND(F.lit((1 << length) - 1)), F.sequence(F.lit(a), F.lit(b - 1)), a))
    rows = nodes.select("node", F.explode(F.concat(*variants)).alias("_v")).select("node", "_v.*")
    other = rows.select(F.col("key").alias("_k"), F.col("bit").alias("_b"), F.col("node").alias("v"))
    # both sides have a row per wildcard: without the hint Spark would judge them by the size of the fingerprints' file
    met = rows.join(other.hint("merge"), (F.col("key") == F.col("_k")) & (F.col("node") < F.col("v")) & ((F.col("bit") != F.col("_b")) | F.col("first")))
    pairs = cut(met.select(F.col("node").alias("u"), "v").distinct())
    far = pairs.join(nodes.select(F.col("node").alias("u"), F.col("fp").alias("_fu")).hint("merge"), "u").join(nodes.select(F.col("node").alias("v"), F.col("fp").alias("_fv")).hint("merge"), "v")
    return far.filter(differing(F.col("_fu"), F.col("_fv"), words) <= radius).select("u", "v")


def _wildcards(segment: Column, places: Column, start: int) -> Column:
    """Per place struct<key, bit, first>: the segment without that bit, the bit, and whether it is the segment's first."""

    def variant(i: Column) -> Column:
        one = F.call_function("shiftleft", F.lit(1).cast("long"), i - start)
        key = segment.bitwiseAND(F.bitwise_not(one)).bitwiseOR(F.call_function("shiftleft", i.cast("long"), F.lit(53)))
        return F.struct(key.alias("key"), (segment.bitwiseAND(one) != 0).alias("bit"), (i == start).alias("first"))

    return F.transform(places, variant)


#: Blocks that stay equal in any pair within the radius, and the groups of blocks, of which one holds two of these.
SPARE, GROUPS = 8, 7
#: Members of a key that are compared in one go, and so many as make it dense.
TILE, DENSE = 16384, 96


def block_pairs(bits: int, radius: int) -> tuple[list[np.ndarray], list[tuple[int, int]]]:
    """The places of radius + 8 blocks of bits, and pairs of blocks of which each two fingerprints within the radius share one.

    Such fingerprints differ in ``radius`` blocks at most, so 8 or more are
    equal; blocks lie in seven groups, so two of these are of one group, and
    all pairs within groups are taken.
    """
    if bits < radius + SPARE:
        raise ValueError("too few bits for that radius")
    blocks = np.array_split(np.arange(bits), radius + SPARE)
    return blocks, [(i, j) for i in range(len(blocks)) for j in range(i + 1, len(blocks)) if i % GROUPS == j % GROUPS]


def bits_of(words: np.ndarray) -> np.ndarray:
    """(rows, 64 * words) bits of (rows, words) numbers, each word's lowest first."""
    return np.unpackbits(np.ascontiguousarray(words).astype("<u8").view(np.uint8), axis=1, bitorder="little")


def block_keys(words: np.ndarray, blocks: list[np.ndarray], pairs: list[tuple[int, int]]) -> np.ndarray:
    """(rows, pairs) keys: the number of the pair of blocks and what stands in them."""
    bits = bits_of(words).astype(np.int64)
    values = np.column_stack([bits[:, b] @ (1 << np.arange(len(b), dtype=np.int64)) for b in blocks])
    wide = max(map(len, blocks))
    return np.column_stack([(n << 2 * wide) | (values[:, i] << wide) | values[:, j] for n, (i, j) in enumerate(pairs)])


def candidates(fp: np.ndarray, side: np.ndarray, start: int, end: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i < j) of a dense group's rows within the radius; a tile of two parts compares only across."""
    out_i, out_j = [], []
    own = np.arange(start, end)
    left, right = (own[side[own] == 0], own[side[own] == 1]) if side[own].any() else (own, own)
    for at in range(0, len(left), 256):
        some = left[at: at + 256]
        apart = np.bitwise_count(fp[some, 0][:, None] ^ fp[right, 0][None, :])
        i, j = np.nonzero(apart <= radius)
        i, j = some[i], right[j]
        fine = (i != j) if left is not right else (i < j)
        out_i.append(i[fine])
        out_j.append(j[fine])
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (own[:0], own[:0])


def all_near(nodes: DataFrame, words: int, radius: int) -> DataFrame:
    """All pairs (u < v) of nodes (node, fp of ``words`` words) that differ in ``radius`` bits at most; none is left out.

    A node is sent under its keys of ``block_pairs``; those that share a key
    are compared bit by bit. A pair comes out under the first key that it
    shares. Keys of many nodes are dealt over tiles of at most about TILE
    nodes on a side, so no task holds a whole one. The comparisons grow with
    the square of the nodes, as 58 / 4,096 of all pairs for 192 bits and 24.
    """
    blocks, pairs = block_pairs(64 * words, radius)
    wide = max(map(len, blocks))
    firsts = np.array(pairs)
    spans = np.cumsum([0, *map(len, blocks)])[:-1]

    @F.pandas_udf("array<long>")
    def keys(fps: pd.Series) -> pd.Series:
        return pd.Series(list(block_keys(np.stack(fps.to_list()).view(np.uint64), blocks, pairs)), dtype=object) if len(fps) else pd.Series([], dtype=object)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            last = [b.column(c)[b.num_rows - 1].as_py() for c in ("key", "a", "b")]
            same = np.ones(b.num_rows, dtype=bool)
            for c, x in zip(("key", "a", "b"), last, strict=True):
                same &= b.column(c).to_numpy() == x
            cut_at = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if cut_at:
                yield from found(held + [b.slice(0, cut_at)])
                held = []
            elif held and [held[-1].column(c)[held[-1].num_rows - 1].as_py() for c in ("key", "a", "b")] != last:
                yield from found(held)
                held = []
            held.append(b.slice(cut_at))
        if held:
            yield from found(held)

    def found(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts)
        key, a, b, side, node = (t.column(c).to_numpy() for c in ("key", "a", "b", "side", "node"))
        fp = np.column_stack([t.column(f"f{k}").to_numpy() for k in range(words)]).view(np.uint64)
        new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        sizes = np.diff(np.r_[new, len(key)])
        ends = np.repeat(new + sizes, sizes)
        is_, js = [], []
        at, d = np.flatnonzero(np.repeat(sizes, sizes) <= DENSE), 1
        while len(at := at[at + d < ends[at]]):
            near = at[np.bitwise_count(fp[at, 0] ^ fp[at + d, 0]) <= radius]
            near = near[(a[near] == b[near]) | (side[near] != side[near + d])]
            is_.append(near)
            js.append(near + d)
            d += 1
        for s, n in zip(new, sizes, strict=True):
            if n > DENSE:
                i, j = candidates(fp, side if a[s] != b[s] else np.zeros_like(side), s, s + n, radius)
                is_.append(i)
                js.append(j)
        i, j = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (is_, js))
        for lo in range(0, len(i), 65536):
            p, q = i[lo: lo + 65536], j[lo: lo + 65536]
            apart = fp[p] ^ fp[q]
            fine = np.bitwise_count(apart).sum(axis=1) <= radius
            p, q, apart = p[fine], q[fine], apart[fine]
            if len(p):
                equal = np.add.reduceat(bits_of(apart), spans, axis=1) == 0
                first = (equal[:, firsts[:, 0]] & equal[:, firsts[:, 1]]).argmax(axis=1)
                fine = first == key[p] >> 2 * wide
                u, v = node[p[fine]], node[q[fine]]
                yield pa.RecordBatch.from_pydict({"u": pa.array(np.minimum(u, v)), "v": pa.array(np.maximum(u, v))})

    sent = cut(nodes.select("node", "fp", keys("fp").alias("_keys")))
    rows = sent.select("node", *[F.col("fp")[k].alias(f"f{k}") for k in range(words)], F.explode("_keys").alias("key"))
    many = sent.select(F.explode("_keys").alias("_key")).groupBy("_key").agg(F.ceil(F.count("*") / TILE).cast("int").alias("_ways")).filter("_ways > 1")
    ways = F.coalesce("_ways", F.lit(1))
    placed = rows.join(F.broadcast(many), F.col("key") == F.col("_key"), "left").withColumn("_own", F.pmod(F.xxhash64("node"), ways).cast("int"))  # few keys have many nodes
    other = F.explode(F.sequence(F.lit(0), ways - 1))
    tiles = placed.select("*", other.alias("_other")).select("key", F.least("_own", "_other").alias("a"), F.greatest("_own", "_other").alias("b"), (F.col("_own") > F.col("_other")).cast("int").alias("side"), "node", *[f"f{k}" for k in range(words)])
    return tiles.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b").mapInArrow(compare, "u long, v long")


def wide_groups(docs: DataFrame, width: int = 5, radius: int = NEAR, words: int = WORDS) -> DataFrame:
    """One row per document: doc_id, component_id (the smallest doc_id reachable by links).

    Fingerprints of 64 * words bits over ``width``-word shingles link at
    ``radius`` differing bits or fewer, all of them: ``near_nodes`` finds these
    where the radius leaves a segment of SEGMENT bits with one difference at
    most, ``all_near`` beyond. Equal fingerprints are one node. Null texts count as empty; texts without words share a fingerprint
    that no other text has. Documents with a null doc_id take part and name a
    component only where all lack one. Repeated rows stay rows, extra columns
    are left out, empty input gives no rows.
    """

    @F.pandas_udf("array<long>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(list(wide_simhash(texts.tolist(), width, words)), dtype=object)

    marked = cut(docs.select("doc_id", of("text").alias("fp")))
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("node", F.monotonically_increasing_id())
    nodes = cut(nodes)  # numbers are given once, when the table is written
    segments = 64 * words // SEGMENT
    nearby = near_nodes(nodes.select("node", "fp"), words, radius, segments) if radius < 2 * segments else all_near(nodes.select("node", "fp"), words, radius)
    groups = components(cut(nearby))
    known = cut(nodes.join(groups.hint("merge"), "node", "left").select("fp", "least", F.coalesce("component", "node").alias("component")))
    names = known.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = known.join(names.hint("merge"), "component").select("fp", "component_id")
    return marked.join(classes.hint("merge"), "fp").select("doc_id", "component_id")


def keep_one_of_alike(docs: DataFrame, width: int = 5, radius: int = NEAR, words: int = WORDS) -> DataFrame:
    """One document of each group of ``wide_groups``: that with the smallest doc_id; of rows with its doc_id one.

    Columns stay as they are, whatever their names. Texts without words, null
    ones too, form one group; a group without any doc_id keeps one row, and of
    all such groups one row stays. Empty input gives no rows.
    """
    return first_of_each(docs, wide_groups(docs, width, radius, words))
