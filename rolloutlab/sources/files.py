"""Tables, allow-lists, digests and artifacts on disk."""

from __future__ import annotations

import json
import math
import re
import tempfile
import uuid
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schema import EPISODE, STEP, TRAJECTORY, ContractError, policy_columns


# Shapes of common credentials, files that may be released, and their largest size.
SECRETS = {"private key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "repository token": r"\b(?:ghp_|github_pat_)[A-Za-z0-9_]{20,}", "cloud key": r"\bAKIA[A-Z0-9]{16}\b", "service key": r"\bsk-[A-Za-z0-9_-]{24,}"}
SUFFIXES = ("py", "md", "toml", "json", "csv")
LARGEST = 500_000
#: From so many bytes on a file is digested in splits; names of files that Spark's reader unpacks.
LARGE = 16_000_000
PACKED = r"\.(gz|gzip|bz2|zst|lz4|snappy|deflate)$"


def secret_kind(text: Column) -> Column:
    """The kind of credential that a text seems to hold, null if none; the first of several."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(SECRETS.items()):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def release_faults(spark: SparkSession, path: str) -> DataFrame:
    """path and fault of every file under a folder that may not be released: another kind of file, a large one, or one that seems to hold a credential."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    suffix = F.lower(F.element_at(F.split("path", r"\."), -1))
    fault = F.when(~suffix.isin(*SUFFIXES), "kind of file").when(F.col("length") > LARGEST, "size").otherwise(secret_kind(F.decode("content", "ISO-8859-1")))
    return files.select("path", fault.alias("fault")).filter("fault is not null")


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir; where that is unset, under the temporary folder in local mode and the warehouse elsewhere."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        alone = re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master)
        root = tempfile.gettempdir() if alone else spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/scratch-{uuid.uuid4().hex}"


def settled(df: DataFrame, *by: str) -> DataFrame:
    """The table written once and read back, in a folder for each value of ``by``: what follows plans from the files, and a lost executor costs a reread."""
    path = scratch(df.sparkSession)
    df.write.partitionBy(*by).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    return out.select(*df.columns) if by else out


def read_trajectories(spark: SparkSession, path: str, schema: StructType = TRAJECTORY) -> DataFrame:
    """CSV with a header, under a declared schema; columns are matched by name."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def read_columns(spark: SparkSession, path: str) -> tuple[str, ...]:
    """An allow-list of observation columns from a JSON array."""
    text = spark.read.text(path, wholetext=True).first()
    names = json.loads(text[0]) if text else None
    if not isinstance(names, list):
        raise ContractError("an allow-list is a JSON array")
    return policy_columns(tuple(names))


def file_digests(spark: SparkSession, path: str, large: int = LARGE) -> DataFrame:
    """path and SHA-256 of each file with its line ends as single line feeds; files over ``large`` bytes are read in splits, unless they are packed as a whole."""
    text = F.regexp_replace(F.decode("content", "ISO-8859-1"), "\r\n?", "\n")
    files = spark.read.format("binaryFile").load(path)
    split = (F.col("length") > large) & ~F.lower("path").rlike(PACKED)
    found = files.filter(~split).select("path", F.sha2(F.encode(text, "ISO-8859-1"), 256).alias("sha256"))
    for r in files.filter(split).select("path", "length").collect():  # names of files only
        found = found.unionByName(_large_digest(spark, r["path"], r["length"]))
    return found


def _large_digest(spark: SparkSession, path: str, length: int) -> DataFrame:
    """The same of one file read by lines: pieces up to a line feed, in the order of splits and of lines in these."""
    from ..operators.digests import chained, line_chunks

    rows = spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary").alias("_x"), F.col("_metadata.file_block_start").alias("_p"))
    parts = line_chunks(rows)
    # the reader gives each line without its line feed, which the last one may lack; a carriage return there is a line end itself
    ends = settled(parts)
    raw = ends.agg(F.sum("_raw").alias("raw"), F.max_by("_cr", F.struct("_p", "_at")).alias("cr")).first()
    drop = 1 if raw["raw"] != length and not raw["cr"] else 0
    return chained(ends.drop("_raw", "_cr"), drop).select(F.lit(path).alias("path"), F.col("digest").alias("sha256"))


def probability_digest(df: DataFrame, column: str) -> str:
    """SHA-256 of the little-endian doubles in key order, of any number of rows."""
    from ..operators.digests import value_digest

    return value_digest(df, [EPISODE, STEP], column)


def finite_or_null(df: DataFrame) -> DataFrame:
    """Doubles that aren't finite as null, which JSON can hold."""
    def safe(c: str) -> Column:
        return F.when(~F.isnan(c) & (F.abs(F.col(c)) != math.inf), F.col(c)).alias(c)

    return df.select(*[safe(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def json_safe(value):
    """The same for nested Python values; numpy scalars become plain ones."""
    if isinstance(value, dict):
        return {str(k): json_safe(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [json_safe(v) for v in value]
    if isinstance(value, np.ndarray):
        return json_safe(value.tolist())
    if isinstance(value, np.generic):
        return json_safe(value.item())
    return None if isinstance(value, float) and not math.isfinite(value) else value


def write_csv(df: DataFrame, path: str, line_end: str = "\r\n") -> None:
    """One CSV file with a header in a folder, rows in key order where there is a key, of any number: one task writes them, but holds and sorts only compressed chunks of lines."""
    from ..operators.digests import chunks, in_order

    keys = [c for c in (EPISODE, STEP) if c in df.columns]
    header = df.sparkSession.range(1, numPartitions=1).select(F.concat(F.to_csv(F.struct(*[F.lit(c).alias(c) for c in df.columns])), F.lit(line_end)).cast("binary").alias("_x"))
    line = F.concat(F.to_csv(F.struct(*[F.col(c) for c in df.columns])), F.lit(line_end)).cast("binary")
    parts = in_order(df, keys, line) if keys else chunks(df.select(line.alias("_x")), "_x")
    every = chunks(header, "_x").withColumn("_p", F.lit(-1).cast("long")).unionByName(parts)

    def text(rows: Iterator[Row]) -> Iterator[tuple[str]]:
        for r in rows:
            yield (zlib.decompress(bytes(r["_x"])).decode("utf-8", "surrogatepass")[: -len(line_end)],)

    lines = every.repartition(1).sortWithinPartitions("_p", "_at").select("_x").rdd.mapPartitions(text)
    df.sparkSession.createDataFrame(lines, "value string", verifySchema=False).write.mode("overwrite").option("lineSep", line_end).text(path)


def write_json(spark: SparkSession, value, path: str) -> None:
    """A nested value as one JSON text with sorted keys, in a folder."""
    text = json.dumps(json_safe(value), sort_keys=True, indent=2, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_artifacts(result, roles: DataFrame, root: str, more: Mapping[str, DataFrame] | None = None) -> None:
    """The tables of an evaluation as Parquet, the comparison and roles as CSV, the verdict as JSON text."""
    from ..plans.evaluate import comparison

    names = ("episodes", "summary", "support", "calibration", "simultaneous", "stress", "raw", "gaps", "samples", "shortcut", "runtime")
    for name, df in ({n: getattr(result, n) for n in names} | dict(more or {})).items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")
    write_csv(comparison(result), f"{root}/comparison")
    write_csv(roles, f"{root}/roles")
    write_json(roles.sparkSession, {"verdict": result.verdict, "receipt": result.receipt}, f"{root}/verdict")
