"""Weighted centroids, moments and histograms by built-in partial and final aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def weighted_mean(x: Column | str, w: Column | str) -> Column:
    x, w = (F.col(c) if isinstance(c, str) else c for c in (x, w))
    return F.sum(x * w) / F.sum(w)


def weighted_centroid(df: DataFrame, keys: list[str], coords: list[str], weight: str) -> DataFrame:
    """Per group the summed weight, the weighted mean of each coordinate, the number of rows."""
    return df.groupBy(*keys).agg(F.sum(weight).alias(weight), *(weighted_mean(c, weight).alias(c) for c in coords), F.count(F.lit(1)).alias("n"))


def weighted_moments(df: DataFrame, keys: list[str], x: str, weight: str | None = None, prefix: str = "") -> DataFrame:
    """Per group n, w_sum, mean, var (population), sd, var_bessel, var_reliability, skew, kurtosis (non-excess), min, max.

    Two passes: the mean, then sums of central powers; raw power sums would cancel. skew is 0 and
    kurtosis null for zero variance. Two of the three variances are null for a single weight unit.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(*keys, F.col(x).cast("double").alias("x"), w.alias("w")).where("x IS NOT NULL AND w IS NOT NULL")
    mean = rows.groupBy(*keys).agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("mean"))
    joined = rows.join(mean, keys) if keys else rows.crossJoin(F.broadcast(mean))  # the ungrouped mean is one row
    d = F.col("x") - F.col("mean")
    power = lambda k: F.sum(F.col("w") * F.pow(d, k))
    sums = joined.groupBy(*keys).agg(F.first("mean").alias("mean"), F.count(F.lit(1)).alias("n"), F.sum("w").alias("w_sum"), F.sum(F.col("w") * F.col("w")).alias("w2"), power(2).alias("m2"), power(3).alias("m3"), power(4).alias("m4"), F.min("x").alias("min"), F.max("x").alias("max"))
    c = F.col
    out = {
        "n": c("n"), "w_sum": c("w_sum"), "mean": c("mean"), "var": c("m2") / c("w_sum"), "sd": F.sqrt(c("m2") / c("w_sum")),
        "var_bessel": F.when(c("n") > 1, c("m2") / (c("w_sum") - c("w_sum") / c("n"))), "var_reliability": F.when(c("w_sum") * c("w_sum") > c("w2"), c("m2") / (c("w_sum") - c("w2") / c("w_sum"))),
        "skew": F.when(c("m2") == 0, F.lit(0.0)).otherwise(F.sqrt("w_sum") * c("m3") / F.pow(c("m2"), 1.5)), "kurtosis": F.when(c("m2") > 0, c("w_sum") * c("m4") / (c("m2") * c("m2"))), "min": c("min"), "max": c("max"),
    }
    return sums.select(*keys, *(v.alias(prefix + k) for k, v in out.items()))


def summary_stats(df: DataFrame, x: str) -> DataFrame:
    """One row: mean, sd, skew, kurtosis, n, min, max of a column, each row of weight 1."""
    return weighted_moments(df, [], x).select("mean", "sd", "skew", "kurtosis", "n", "min", "max")


def group_stats(df: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Per group the greatest and summed weight and the number of rows."""
    return df.groupBy(*keys).agg(F.max(weight).alias("max_intensity"), F.count(F.lit(1)).alias("num_peaks"), F.sum(weight).alias("tot_intensity"))


def histogram(df: DataFrame, keys: list[str], x: str, weight: str, size: float, offset: Column | None = None) -> DataFrame:
    """(keys, offset, bin, weight): summed weights by bin of x. offset: by default the group's least x less half a bin.

    Grouping is by (keys, bin), so a long series never meets in one task.
    """
    if offset is None:
        first = df.groupBy(*keys).agg((F.min(x) - F.lit(size / 2)).alias("offset"))
        df = df.join(first, keys) if keys else df.crossJoin(F.broadcast(first))
    else:
        df = df.withColumn("offset", offset)
    number = F.floor((F.col(x) + F.lit(1e-9) - F.col("offset")) / F.lit(size)).cast("int")
    return df.groupBy(*keys, "offset", number.alias("bin")).agg(F.sum(weight).alias("weight"))


def merge_histograms(a: DataFrame, b: DataFrame, keys: list[str], size: float) -> DataFrame:
    """a's bins plus b's, b's re-binned by their left edges into a's offset; groups of b alone keep b's."""
    anchors = a.select(*keys, F.col("offset").alias("anchor")).distinct()
    moved = b.join(anchors, keys, "left") if keys else b.crossJoin(F.broadcast(anchors))
    edge = F.col("bin") * F.lit(size) + F.col("offset")
    moved = moved.select(*keys, F.coalesce("anchor", "offset").alias("offset"), F.when(F.col("anchor").isNull(), F.col("bin")).otherwise(F.floor((edge + F.lit(1e-9) - F.col("anchor")) / F.lit(size)).cast("int")).alias("bin"), "weight")
    return a.select(*keys, "offset", "bin", "weight").unionByName(moved).groupBy(*keys, "offset", "bin").agg(F.sum("weight").alias("weight"))


def histogram_ranges(h: DataFrame, keys: list[str], size: float) -> DataFrame:
    """Per group the least and greatest bin, their edges, and the number of bins with weight."""
    return h.groupBy(*keys, "offset").agg(F.min("bin").alias("bin_min"), F.max("bin").alias("bin_max"), F.countDistinct("bin").alias("num_bins")).withColumns({"x_min": F.col("bin_min") * size + F.col("offset"), "x_max": (F.col("bin_max") + 1) * size + F.col("offset")})


def histogram_map(h: DataFrame, keys: list[str]) -> DataFrame:
    """Per group a map bin -> weight. For groups whose number of bins is bounded, as traces' are."""
    return h.groupBy(*keys, "offset").agg(F.map_from_entries(F.collect_list(F.struct("bin", "weight"))).alias("bins"))


def cycle_time(df: DataFrame, group: str, time: str) -> DataFrame:
    """One row: the mean over groups of the mean successive time difference, the first one counted from 0."""
    step = F.col(time) - F.lag(time, 1, 0.0).over(W.partitionBy(group).orderBy(time))
    return df.select(group, step.alias("step")).groupBy(group).agg(F.avg("step").alias("step")).agg(F.avg("step").alias("cycle_time"))


def cycle_time_telescoped(df: DataFrame, group: str, time: str) -> DataFrame:
    """The same from a plain aggregate: the differences telescope to last / n, so no group needs to be sorted."""
    return df.groupBy(group).agg((F.max(time) / F.count(time)).alias("step")).agg(F.avg("step").alias("cycle_time"))


def sum_difference(df: DataFrame, label: str, score: str) -> DataFrame:
    """Summed score of rows labelled 1 less that of rows labelled below 0."""
    part = lambda cond: F.sum(F.when(cond, F.col(score)).otherwise(0.0))
    return df.agg((part(F.col(label) == 1) - part(F.col(label) < 0)).alias("difference"))
