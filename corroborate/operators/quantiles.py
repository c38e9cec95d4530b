"""Exact percentiles by distributed selection, for groups of any size.

A group's values are never gathered. Each wanted rank has a range that holds it: a pass counts the values of the range by BINS
equal bins, with the least and the largest value of each, and the bin of the rank becomes the range. Where at most LEFT values
are left, or one value repeated, the rank is read off; the value after it comes from the range, or from the next bin. A pass shuffles
at most BINS rows a task and rank.

Cases: nulls don't count, a group without values has null; NaN is larger than all else, as in Spark's percentile, whose
interpolation this is; null groups are groups; without columns to group by, all rows are one group, and no rows give no row.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corroborate.operators.retrieval import small
from corroborate.session import remove, written

BINS = 1024
LEFT = 4096
LARGEST = 1.7976931348623157e308


def _bin():
    """The bin of v in [lo, hi], lo in the first and hi in the last, never falling as v rises; halves, as hi - lo may overflow."""
    half = lambda c: F.least(F.greatest(F.col(c), F.lit(-LARGEST)), F.lit(LARGEST)) / 2
    place = F.try_divide(half("v") - half("lo"), half("hi") - half("lo")) * BINS
    inner = F.least(F.floor(F.coalesce(place, F.lit(1.0))), F.lit(BINS - 1)).cast("int")
    return F.when(F.col("v") == F.col("lo"), 0).when(F.col("v") == F.col("hi"), BINS - 1).otherwise(inner)


def percentiles(rows: DataFrame, by: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """A4: by, and for each name in points its percentile of value, of groups with values."""
    spark = rows.sparkSession
    key = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    # groups and values alone, once: every pass reads these, not what rows are made of
    base = written(spark, rows.select(key.alias("g"), F.col(value).cast("double").alias("v")).filter("v is not null"), "values")
    ends = base.groupBy("g").agg(F.count("*").alias("here"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    wanted = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(p)).alias("p")) for n, p in points.items()])).alias("x")
    ranks = ends.select("g", "here", "lo", "hi", wanted).withColumn("pos", F.col("x.p") * (F.col("here") - 1))
    state = written(spark, ranks.select("g", F.col("x.name").alias("name"), "pos", F.floor("pos").alias("k"), "here", "lo", "hi", F.lit(None).cast("double").alias("next")), "ranks")
    for _ in range(2100):  # a pass narrows a range by BINS where values are spread evenly, and always at least by one value
        many = state.filter((F.col("lo") != F.col("hi")) & (F.col("here") > LEFT))
        if many.isEmpty():
            break
        met = base.join(small(many.select("g", "name", "lo", "hi")), "g").filter("v >= lo and v <= hi")
        bins = met.groupBy("g", "name", _bin().alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
        order = W.partitionBy("g", "name").orderBy("bin")
        bins = bins.withColumns({"done": F.sum("n").over(order), "after": F.lead("least").over(order)})
        found = many.join(bins, ["g", "name"]).filter("done > k and done - n <= k")
        found = found.select("g", "name", "pos", (F.col("k") - F.col("done") + F.col("n")).alias("k"), F.col("n").alias("here"), F.col("least").alias("lo"), F.col("most").alias("hi"), F.coalesce("after", "next").alias("next"))
        new = written(spark, state.filter((F.col("lo") == F.col("hi")) | (F.col("here") <= LEFT)).unionByName(found), "ranks")
        remove(spark, state)
        state = new
    few = state.filter("lo <> hi")
    order = W.partitionBy("g", "name").orderBy("v")
    met = base.join(small(few.select("g", "name", "lo", "hi")), "g").filter("v >= lo and v <= hi").select("g", "name", "v")
    read = met.withColumns({"at": F.row_number().over(order) - 1, "then": F.lead("v").over(order)})
    read = few.join(read, ["g", "name"]).filter("at = k").select("g", "name", "pos", "v", F.coalesce("then", "next").alias("then"))
    one = state.filter("lo = hi").select("g", "name", "pos", F.col("lo").alias("v"), F.when(F.col("k") + 1 < F.col("here"), F.col("lo")).otherwise(F.col("next")).alias("then"))
    lower, upper = F.floor("pos"), F.ceil("pos")
    told = F.when((lower == upper) | (F.col("v") == F.col("then")), F.col("v")).otherwise((upper - F.col("pos")) * F.col("v") + (F.col("pos") - lower) * F.col("then"))
    out = read.unionByName(one).groupBy("g").agg(*[F.max(F.when(F.col("name") == n, told)).alias(n) for n in points])
    return out.select(*[F.col(f"g.{c}").alias(c) for c in by], *points)


def with_percentiles(grouped: DataFrame, rows: DataFrame, by: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """grouped, which has one row a group, with the percentiles of its rows; null without values."""
    p = percentiles(rows, by, value, points).select(*[F.col(c).alias(f"__{c}") for c in by], *points)
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by] or [F.lit(True)]
    on = same[0]
    for c in same[1:]:
        on &= c
    return grouped.join(p, on, "left").drop(*[f"__{c}" for c in by])


def plain(values: list[float], p: float) -> float | None:
    """The same percentile of a list, in plain Python."""
    v = sorted(values, key=lambda x: (math.isnan(x), x))
    if not v:
        return None
    pos = p * (len(v) - 1)
    a, b = v[math.floor(pos)], v[math.ceil(pos)]
    return a if math.floor(pos) == math.ceil(pos) or a == b else (math.ceil(pos) - pos) * a + (pos - math.floor(pos)) * b
