"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from spark.checkpoint.dir; in local mode a temporary one where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def remove_tables(spark: SparkSession) -> None:
    """Deletes the tables that ``cut`` wrote in this application; what was read from them can't be used after."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    Later stages start from the table: a lost executor costs a reread, and
    nothing above is computed twice.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def aside(docs: DataFrame, needed: Sequence[str]) -> tuple[DataFrame, dict[str, str]]:
    """docs with all but the needed columns under names that clash with nothing, and the names to give back."""
    names = {c: f"_aside_{i}_" for i, c in enumerate(docs.columns) if c not in needed}
    return docs.withColumnsRenamed(names), {v: k for k, v in names.items()}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], out: str, bucket: Column,
             weight: str | None = None) -> DataFrame:
    """Add ``out``: the gapless position from 0 in each key's group, or with ``weight`` its running sum before the row.

    Two levels, so that one group may hold most rows: groups are split by
    ``bucket``, rows are numbered in each (key, bucket), and each bucket starts
    after the sum of those before it. Null keys form a group.
    """
    w = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    part = df.withColumn("_bucket", bucket)
    ks = [*keys, "_bucket"]
    sums = part.groupBy(*ks).agg(F.sum(w).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inner = Window.partitionBy(*ks).orderBy(*order)
    if weight is None:
        local = F.row_number().over(inner).cast("long") - 1
    else:
        local = F.coalesce(F.sum(w).over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = part.withColumn("_local", local)
    for k in ks:
        sums = sums.withColumnRenamed(k, f"_r_{k}")
    on = F.lit(True)
    for k in ks:
        on = on & part[k].eqNullSafe(sums[f"_r_{k}"])
    return (part.join(sums, on).withColumn(out, F.col("_local") + F.col("_base"))
            .drop("_local", "_base", "_bucket", *[f"_r_{k}" for k in ks]))


def spread_join(many: DataFrame, few: DataFrame, keys: Sequence[str], size: str, total: int, by: Sequence[str], ways: int = 64, most: int = 1000, least: int = 1000) -> DataFrame:
    """Inner join of many rows with few that have one row per key, so that no key meets in one task.

    ``size`` of few says how many rows of ``many`` have the key, ``total`` about
    how many there are. Keys with over ``total / most`` rows, of which there are
    fewer than ``most``, are dealt by ``by`` over ``ways`` tasks, if they have
    over ``least`` rows; only these keys are broadcast. Null keys meet nothing.
    """
    bar = max(least, total // most)
    hot = F.broadcast(few.filter(F.col(size) > bar).select(*keys, F.lit(True).alias("_hot")))
    left = many.join(hot, list(keys), "left").withColumn("_way", F.when(F.col("_hot"), F.pmod(F.xxhash64(*by), F.lit(ways)).cast("int")).otherwise(0)).drop("_hot")
    right = few.withColumn("_way", F.explode(F.when(F.col(size) > bar, F.sequence(F.lit(0), F.lit(ways - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [*keys, "_way"]).drop("_way")


#: From so many edges on, the edges of a hub are dealt over many tasks.
SPREAD_FROM = 5_000_000


def components(edges: DataFrame, max_rounds: int = 60, spread_from: int = SPREAD_FROM) -> DataFrame:
    """Connected components of long edges (u, v): rows (node, component), component the smallest node reached.

    Alternating large-star and small-star steps; each is an aggregate of minima
    and a join, so a hub costs no more than its edges, and with many edges
    these meet in many tasks. Nodes without edges do not occur. Every round is
    a written table; it ends when a round changes nothing.
    """
    def meet(some: DataFrame, n: int) -> DataFrame:
        """The edges with m, the smallest neighbour of u."""
        low = some.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n"))
        if n < spread_from:
            return some.join(low.drop("_n"), "u")
        return spread_join(some, cut(low), ["u"], "_n", n, ["v"], least=min(1000, n // 10)).drop("_n")

    e = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state, n = None, e.count()
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = meet(both, 2 * n).withColumn("m", F.least("u", "m")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        linked = meet(large, n)
        small = (linked.select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(large.groupBy("u").agg(F.min("v").alias("v"))).filter("u <> v").distinct())
        e = cut(small)
        now = e.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("decimal(20,0)")).alias("h"),
                    F.sum(F.xxhash64("v", "u").cast("decimal(30,0)")).alias("g")).first()
        if now == state:
            break
        state, n = now, now["n"]
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
