"""Best-fit packing of token sequences by length patterns.

Documents become pieces of at most a sequence length. A histogram of piece
lengths, bounded by the sequence length whatever the corpus size, goes to the
driver. Patterns of one to three lengths that fill a sequence are fitted to it
by non-negative least squares (Krell et al., 2021), their repeat counts are
rounded down, and what is left is packed best-fit decreasing by length. Every
piece finds its sequence from its length and its number among the pieces of
that length.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import cut, numbered

SEQUENCE = 1024
END = 2
#: Pieces of one length that a task numbers, about, and the buckets of a length at least.
BUCKET_PIECES, LEAST_BUCKETS = 200_000, 256
# Fixed value: the split pattern of the byte-level vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable bytes for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Encoder:
    """Token ids of a text as little-endian 32-bit bytes.

    The vocabulary's ids are its merge ranks, so that a plain byte-pair coder
    over them gives what the tokenizer gives, several times faster. Texts with
    special tokens or with characters past the Latin blocks, where the Unicode
    tables of two libraries may differ, go to the tokenizer itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        letters = byte_letters()
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        ranks = {bytes(letters[c] for c in token): i for token, i in self.tokenizer.get_vocab().items() if token not in special}
        self.ordinary = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.rare = regex.compile(r"[^\x00-\u024f\u2010-\u2027]" + "".join("|" + regex.escape(s) for s in sorted(special))).search

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        return self.whole(text) if self.rare(text) else np.array(self.ordinary(text), dtype="<u4").tobytes()


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def piece_spans(n: int, sequence: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: the first may be shorter, the others are full."""
    first = n % sequence or sequence
    return [(0, first), *((s, sequence) for s in range(first, n, sequence))]


def tokenize(docs: DataFrame, path: str, sequence: int = SEQUENCE, end: int = END, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and with ``with_ids`` the ids."""
    kind = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                      *([("ids", pa.list_(pa.int32()))] if with_ids else [])])
    stop = np.array([end], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = encode(text or "") + stop
                for piece, (start, n) in enumerate(piece_spans(len(data) // 4, sequence)):
                    part = data[4 * start: 4 * (start + n)]
                    row = (doc, piece, start, n, zlib.crc32(part))
                    rows.append((*row, np.frombuffer(part, dtype="<u4").astype(np.int32)) if with_ids else row)
                if len(rows) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)], schema=kind)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)], schema=kind)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, from_arrow_schema(kind))


def patterns(sequence: int, present: np.ndarray) -> np.ndarray:
    """Length patterns of two or three present lengths that fill a sequence exactly; 0 pads.

    A histogram of the lengths decides nothing but which exist. There are
    about sequence**2 / 12 patterns of three at most.
    """
    have = np.zeros(sequence + 1, dtype=bool)
    have[present] = True
    a = np.arange(1, sequence // 2 + 1)
    two = np.stack([a, sequence - a, np.zeros_like(a)], axis=1)[have[a] & have[sequence - a]]
    x, y = np.meshgrid(np.flatnonzero(have), np.flatnonzero(have), indexing="ij")
    z = sequence - x - y
    ok = (x <= y) & (y <= z)
    ok[ok] = have[z[ok]]
    three = np.stack([x[ok], y[ok], z[ok]], axis=1)
    return np.concatenate([two, three]) if len(three) else two


def fit_counts(found: np.ndarray, histogram: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative least squares by multiplicative updates: repeats whose lengths come near the histogram."""
    b = histogram.astype(float).copy()
    b[0] = 0.0
    used = found > 0

    def lengths(x: np.ndarray) -> np.ndarray:
        out = np.bincount(found.ravel(), np.repeat(x, 3), len(b))
        out[0] = 0.0
        return out

    def back(v: np.ndarray) -> np.ndarray:
        return (v[found] * used).sum(axis=1)

    x = np.maximum(back(b), 1e-9)
    x *= b.sum() / max(lengths(x).sum(), 1e-9)
    goal = back(b)
    for _ in range(rounds):
        x *= goal / np.maximum(back(lengths(x)), 1e-12)
    return x


def plan(histogram: np.ndarray, sequence: int = SEQUENCE) -> dict[str, np.ndarray]:
    """Packs counts of lengths 1..sequence: arrays length, first, count, sequence, offset.

    The pieces of ``length`` numbered first .. first + count - 1 go to the
    sequences from ``sequence`` on, one each, at ``offset``. Exact: every
    count of the histogram is placed.
    """
    left = histogram.astype(np.int64).copy()
    used = np.zeros_like(left)
    rows: list[tuple[int, int, int, int, int]] = []
    at = 0

    def place(lengths: list[int], repeats: int) -> None:
        nonlocal at
        offset, seen = 0, at
        for n in lengths:
            rows.append((n, used[n], repeats, seen, offset))
            used[n] += repeats
            left[n] -= repeats
            offset += n
        at += repeats

    if left[sequence]:
        place([sequence], int(left[sequence]))
    found = patterns(sequence, np.flatnonzero(left[:sequence]))
    if len(found):
        counts = np.floor(fit_counts(found, left[: sequence + 1] * (np.arange(sequence + 1) < sequence)) + 1e-6).astype(np.int64)
        for k in np.argsort(-counts, kind="stable"):
            lengths = [int(n) for n in found[k] if n]
            need = np.bincount(lengths, minlength=sequence + 1)
            has = need > 0
            fits = min(int(counts[k]), int((left[has] // need[has]).min()))
            if fits > 0:
                place(lengths, fits)
    # what rounding left: best fit decreasing, whole runs of like sequences at a time
    rest = left.copy()
    while rest.any():
        longest = int(np.flatnonzero(rest)[-1])
        lengths, room, taken = [longest], sequence - longest, np.zeros_like(rest)
        taken[longest] = 1
        while room > 0:
            fit = np.flatnonzero(rest[: room + 1] > taken[: room + 1])
            if not len(fit):
                break
            n = int(fit[-1])
            lengths.append(n)
            taken[n] += 1
            room -= n
        has = taken > 0
        repeats = int((rest[has] // taken[has]).min())
        place(lengths, repeats)
        rest = left.copy()
    table = np.array(rows, dtype=np.int64).reshape(-1, 5)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    return dict(zip(("length", "first", "count", "sequence", "offset"), table.T))


def pack_pieces(pieces: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """Adds sequence_id and offset to pieces with doc_id, piece, start, length."""
    histogram = np.zeros(sequence + 1, dtype=np.int64)
    for row in pieces.groupBy("length").count().collect():  # one row per length
        histogram[row["length"]] = row["count"]
    packed = plan(histogram, sequence)
    begin = np.searchsorted(packed["length"], np.arange(sequence + 2))
    wide = int(histogram.max()) + 1
    keys = packed["length"] * wide + packed["first"]

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def placed(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        row = np.searchsorted(keys, length.to_numpy() * wide + number.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": packed["sequence"][row] + number.to_numpy() - packed["first"][row], "offset": packed["offset"][row]})

    assert begin[-1] == len(packed["length"])
    # nearly all pieces of long documents have one length: as many buckets as the commonest length asks for
    buckets = max(LEAST_BUCKETS, -(-int(histogram.max()) // BUCKET_PIECES))
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(buckets)).cast("int")
    ranked = numbered(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], "_number", bucket)
    return (ranked.withColumn("_at", placed("length", "_number"))
            .select(*pieces.columns, F.col("_at.sequence_id").alias("sequence_id"), F.col("_at.offset").alias("offset")))


def pack_documents(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE, end: int = END, with_ids: bool = True) -> DataFrame:
    """Packs whole documents: one row per piece with doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is its end token alone. Only documents longer than a
    sequence are cut. What the patterns leave is packed best fit, no piece is
    left out. Repeated rows and rows without doc_id are packed each on its
    own. Empty input gives no rows; extra columns are left out.
    """
    pieces = cut(tokenize(docs, path or vocabulary_path(), sequence, end, with_ids))
    return pack_pieces(pieces, sequence)
