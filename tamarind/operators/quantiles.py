"""Exact quantiles of large groups by counting, so that no task holds all values of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Buckets for each power of e: the buckets of a group are a few thousand, whatever its rows.
FINENESS = 1024


def exact_quantile(rows: DataFrame, by: list[str], value: str, share: float, to: str) -> DataFrame:
    """``(by, to)``: the quantile of each group, interpolated between the two values around its rank.

    Values are counted in buckets that rise with the value; running counts name the one or two
    buckets that hold the ranks, and only the distinct values of these are put in order.  Null values
    do not count; a group without values has no row; null keys are a group.
    """
    v = F.col(value).cast("double")
    counted = rows.where(v.isNotNull()).select(F.struct(*by).alias("_g"), v.alias("_v")).groupBy("_g", "_v").agg(F.count("*").alias("_n"))
    bucket = F.floor(F.signum("_v") * F.log1p(F.abs("_v")) * FINENESS)
    counted = counted.withColumn("_b", bucket)
    upto = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    sums = counted.groupBy("_g", "_b").agg(F.sum("_n").alias("_n")).withColumn("_upto", F.sum("_n").over(upto)).withColumn("_all", F.sum("_n").over(Window.partitionBy("_g")))
    rank = (F.col("_all") - 1) * F.lit(share)
    wanted = sums.select("_g", "_b", (F.col("_upto") - F.col("_n")).alias("_before"), "_upto", rank.alias("_rank")).where("_before <= ceil(_rank) and _upto > floor(_rank)").drop("_upto")
    inside = Window.partitionBy("_g", "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    near = counted.join(wanted, ["_g", "_b"]).withColumn("_upto", F.sum("_n").over(inside) + F.col("_before"))
    low, high = (F.min(F.when(F.col("_upto") > f("_rank"), F.col("_v"))) for f in (F.floor, F.ceil))
    found = near.groupBy("_g").agg(low.alias("_low"), high.alias("_high"), F.first("_rank").alias("_rank"))
    return found.select("_g.*", (F.col("_low") + (F.col("_rank") - F.floor("_rank")) * (F.col("_high") - F.col("_low"))).alias(to))
