"""SHA-256 digests of tables in key order."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..schema import ContractError
from ..sources.files import settled
from .numbering import numbered, text_bucket

BLOCK = 65_536
CHUNK = "_g string, _p long, _at long, _x binary, _n long"


def joined(values: pa.Array) -> bytes:
    return b"".join(v for v in values.to_pylist() if v is not None)


def chunks(rows: DataFrame, content: str, as_bytes: Callable[[pa.Array], bytes] = joined) -> DataFrame:
    """The content of many successive rows of a partition as one compressed chunk: _g (empty), _p (the partition), _at (from 0 in it), _x, _n (how many rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for at, b in enumerate(batches):
            if b.num_rows:
                yield pa.RecordBatch.from_pydict({"_g": [""], "_p": [part], "_at": [at], "_x": [zlib.compress(as_bytes(b.column(0)), 1)], "_n": [b.num_rows]},
                                                 schema=pa.schema([("_g", pa.string()), ("_p", pa.int64()), ("_at", pa.int64()), ("_x", pa.binary()), ("_n", pa.int64())]))

    return rows.select(content).mapInArrow(run, CHUNK)


def line_chunks(rows: DataFrame) -> DataFrame:
    """``chunks`` of lines (_x) read from splits (_p), each line with a line feed, carriage returns as line feeds; also _raw (bytes before that) and _cr (whether the last line ends with a carriage return)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for b in batches:
            starts = b.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(starts[1:] != starts[:-1]) + 1).tolist(), len(starts)]
            for s, e in zip(cuts, cuts[1:]):
                if e > s:
                    lines = b.column(0)[s:e].to_pylist()
                    raw = b"\n".join(lines) + b"\n"
                    yield pa.RecordBatch.from_pydict({"_g": [""], "_p": [int(starts[s])], "_at": [at], "_x": [zlib.compress(raw.replace(b"\r\n", b"\n").replace(b"\r", b"\n"), 1)], "_n": [e - s], "_raw": [len(raw)], "_cr": [lines[-1].endswith(b"\r")]},
                                                     schema=pa.schema([("_g", pa.string()), ("_p", pa.int64()), ("_at", pa.int64()), ("_x", pa.binary()), ("_n", pa.int64()), ("_raw", pa.int64()), ("_cr", pa.bool_())]))
                    at += 1

    return rows.select("_x", "_p").mapInArrow(run, f"{CHUNK}, _raw long, _cr boolean")


def in_order(df: DataFrame, order: Sequence[str], content: Column, as_bytes: Callable[[pa.Array], bytes] = joined) -> DataFrame:
    """The table's content as ``chunks`` that follow each other by (_p, _at): keys are dealt and sorted by ranges, equal keys go by content."""
    rows = settled(df.select(*order, content.alias("_x")))
    return chunks(rows.repartitionByRange(*order).sortWithinPartitions(*order, "_x"), "_x", as_bytes)


def chained(parts: DataFrame, drop: int = 0) -> DataFrame:
    """_g, digest and rows: SHA-256 of each group's chunks in order, without its last ``drop`` bytes.

    Each byte depends on those before, so a group's chunks go through one
    task; it holds one of them at a time, and sorts them compressed.
    """

    def run(rows: Iterator[Row]) -> Iterator[tuple]:
        group, found, tail, n = None, None, b"", 0
        for r in rows:
            if found is None or r["_g"] != group:
                if found is not None:
                    yield group, found.hexdigest(), n
                group, found, tail, n = r["_g"], hashlib.sha256(), b"", 0
            data = tail + zlib.decompress(bytes(r["_x"]))
            end = max(0, len(data) - drop)
            found.update(data[:end])
            tail, n = data[end:], n + r["_n"]
        if found is not None:
            yield group, found.hexdigest(), n

    placed = parts.repartition("_g").sortWithinPartitions("_g", "_p", "_at")
    return parts.sparkSession.createDataFrame(placed.select("_g", "_x", "_n").rdd.mapPartitions(run), "_g string, digest string, rows long", verifySchema=False)


def line_digest(df: DataFrame, order: Sequence[str], line: Column, separator: str, name: str = "digest", most: int | None = None) -> DataFrame:
    """One row: the digest of the lines in order, joined by ``separator``, and their number; more than ``most`` lines raise. Null lines are left out, but counted."""
    if most is not None and df.count() > most:
        raise ContractError(f"more than {most} lines for one digest; use block_digest")
    found = chained(in_order(df, order, F.concat(line, F.lit(separator)).cast("binary")), len(separator.encode()))
    return found.agg(F.coalesce(F.first("digest"), F.lit(hashlib.sha256().hexdigest())).alias(name), F.coalesce(F.first("rows"), F.lit(0)).cast("long").alias("rows"))


def value_digest(df: DataFrame, order: Sequence[str], values: str) -> str:
    """SHA-256 of the little-endian doubles of an array column in key order; a null array raises."""

    def as_bytes(found: pa.Array) -> bytes:
        if found.null_count:
            raise ContractError("no values to digest in a row")
        return found.flatten().to_numpy(zero_copy_only=False).astype("<f8").tobytes()

    found = chained(in_order(df, order, F.col(values).cast("array<double>"), as_bytes)).first()
    return found["digest"] if found else hashlib.sha256().hexdigest()


def block_digest(df: DataFrame, order: Sequence[str], line: Column, block: int = BLOCK, name: str = "digest") -> DataFrame:
    """One row: the digest of the digests of ``block`` lines each, in order, and the number of lines.

    For tables of any size: lines are numbered in two levels, blocks are
    digested where their lines meet, and only block digests come together.
    """
    rows = df.select(*order, line.alias("_line"))
    placed = numbered(rows, [], order, "_at", text_bucket(rows, order[0]))
    ordered = F.array_sort(F.collect_list(F.struct("_at", "_line")))
    parts = placed.groupBy(F.expr(f"_at div {block}").alias("_block")).agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x["_line"]), ""), 256).alias("_d"), F.count("*").alias("_n"))
    whole = F.array_sort(F.collect_list(F.struct("_block", "_d")))
    return parts.agg(F.sha2(F.array_join(F.transform(whole, lambda x: x["_d"]), ""), 256).alias(name), F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"))
