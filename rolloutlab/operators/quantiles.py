"""Exact quantiles by linear interpolation without one buffer per group.

Approximate quantiles cut a group's values into buckets, whose counts say in
which of them the wanted ranks lie. Only the values of these are ranked, equal
ones counted, each bucket on its own behind the count of those before it. So
no task holds the distinct values of a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.files import settled
from .numbering import place_in

CUTS = 64
ACCURACY = 2000


def exact_quantiles(df: DataFrame, value: Column, keys: Sequence[str], named: dict[str, float], times: Column | None = None) -> DataFrame:
    """keys and a column per name: the quantile of the values that aren't null, null where there are none.

    ``named`` gives the quantiles, 1 for the maximum. Values must not be NaN.
    Null keys are a group. A row counts ``times`` times, by default once. Values and cuts are written once: a sketch merges
    in the order in which its parts come, so cuts made anew may differ, and
    counts by one set of cuts don't fit buckets by another.
    """
    many = [] if times is None else [times.cast("long").alias("_w")]
    count = F.sum("_w") if many else F.count("*")
    weight = ["_w"] if many else []
    rows = settled(df.select(*keys, value.cast("double").alias("_v"), *many).filter("_v is not null"))
    marks = [i / CUTS for i in range(1, CUTS)]
    of = {k: f"_of_{k}" for k in keys}
    sketch = settled(rows.groupBy(*keys).agg(F.percentile_approx("_v", F.array(*map(F.lit, marks)), F.lit(ACCURACY)).alias("_cuts"), count.alias("_n")).withColumnsRenamed(of))

    def same(left: DataFrame, right: DataFrame) -> Column:
        on = F.lit(True)
        for k in keys:
            on = on & left[k].eqNullSafe(right[of[k]])
        return on

    met = rows.join(sketch, same(rows, sketch)) if keys else rows.crossJoin(F.broadcast(sketch))  # one row
    met = met.select(*keys, "_v", *weight, "_n", place_in(F.col("_cuts"), F.size("_cuts"), F.col("_v"), CUTS).alias("_b"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = met.groupBy(*keys, "_b").agg(count.alias("_s"), F.max("_n").alias("_n")).withColumn("_base", F.coalesce(F.sum("_s").over(before), F.lit(0)))
    at = {name: (F.col("_n") - 1) * F.lit(float(q)) for name, q in named.items()}
    wanted = F.lit(False)
    for r in (f(a) for a in at.values() for f in (F.floor, F.ceil)):
        wanted = wanted | ((F.col("_base") <= r) & (r < F.col("_base") + F.col("_s")))
    # a few buckets a group, as ranges of values: looking for a row's bucket once more would cost more than comparing
    b = F.col("_ob")
    cuts = whole.filter(wanted).select(*[F.col(k).alias(f"_in_{k}") for k in keys], F.col("_b").alias("_ob"), "_base")
    on = F.lit(True)
    for k in keys:
        on = on & cuts[f"_in_{k}"].eqNullSafe(sketch[of[k]])
    ends = [F.when(b > 0, F.get("_cuts", b - 1)).alias("_from"), F.when(b < F.size("_cuts"), F.get("_cuts", b)).alias("_to")]
    base = settled((cuts.join(sketch, on) if keys else cuts.crossJoin(F.broadcast(sketch))).select(*of.values(), "_ob", "_base", "_n", *ends))
    inside = (F.col("_from").isNull() | (F.col("_v") >= F.col("_from"))) & (F.col("_to").isNull() | (F.col("_v") < F.col("_to")))
    picked = rows.join(F.broadcast(base) if not keys else base, same(rows, base) & inside)
    counted = picked.select(*keys, F.col("_ob").alias("_b"), "_v", *weight, "_n", "_base").groupBy(*keys, "_b", "_v").agg(count.alias("_c"), F.max("_n").alias("_n"), F.max("_base").alias("_base"))
    upto = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumn("_end", F.col("_base") + F.sum("_c").over(upto))
    out = []
    for name, a in at.items():
        low, high = [F.max(F.when((F.col("_end") - F.col("_c") <= r) & (r < F.col("_end")), F.col("_v"))) for r in (F.floor(a), F.ceil(a))]
        part = F.max(a - F.floor(a))
        out.append((low + (high - low) * part).alias(name))
    return placed.groupBy(*keys).agg(*out)
