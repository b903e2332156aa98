"""Ordered scans within keys, for keys of any size.

A window over a key puts all of its rows in one task. Here rows are range-partitioned by key and
order, so a large key spans several partitions; each (key, partition) is scanned by itself, and what earlier
or later partitions of the key add comes from a table of one row a (key, partition).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from peakloom.workspace import materialize, partition_count


def segmented_scan(df: DataFrame, keys: list[str], order: list[str], *, previous: dict[str, str] | None = None, running_sum: dict[str, str] | None = None, least_after: dict[str, str] | None = None, partitions: int | None = None) -> DataFrame:
    """df with columns scanned in ascending order within keys; each argument maps a new column to the one that it is made of.

    previous: the value of the row before (null for the first; null values count as values).
    running_sum: the sum up to and with the row, nulls left out (null while there is none). least_after: the
    least value from the row on. order must be total within a key for a defined result; null keys are a key.
    """
    previous, running_sum, least_after = previous or {}, running_sum or {}, least_after or {}
    n = partitions or partition_count(df)
    sort = [*keys, *order]
    placed = materialize(df.repartitionByRange(n, *sort).sortWithinPartitions(*sort).withColumn("__at", F.monotonically_increasing_id()), "scan").withColumn("__part", F.shiftright("__at", 33))
    own = [*keys, "__part"]
    ends = placed.groupBy(*own).agg(
        F.count(F.lit(1)).alias("__n"),
        *(F.max_by(F.struct(F.col(c).alias("v")), "__at").alias(f"__p_{k}") for k, c in previous.items()),
        *(F.sum(c).alias(f"__s_{k}") for k, c in running_sum.items()),
        *(F.min(c).alias(f"__m_{k}") for k, c in least_after.items()),
    )
    # at most a row a partition in each of these windows
    across = W.partitionBy(*keys).orderBy("__part") if keys else W.orderBy("__part")
    before, after = across.rowsBetween(W.unboundedPreceding, -1), across.rowsBetween(1, W.unboundedFollowing)
    carry = ends.select(
        *own,
        *(F.lag(f"__p_{k}").over(across).alias(f"__p_{k}") for k in previous),
        *(F.sum(f"__s_{k}").over(before).alias(f"__s_{k}") for k in running_sum),
        *(F.min(f"__m_{k}").over(after).alias(f"__m_{k}") for k in least_after),
    )
    cond = F.col("a.__part") == F.col("b.__part")
    for k in keys:
        cond = cond & F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`"))
    joined = placed.alias("a").join(carry.alias("b"), cond).select("a.*", *(f"b.{c}" for c in carry.columns if c not in own))
    inside = W.partitionBy(*own).orderBy("__at")
    up = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    # from the end up: a frame to UNBOUNDED FOLLOWING is worked out anew for each row, which is quadratic
    down = W.partitionBy(*own).orderBy(F.col("__at").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = {}
    for k, c in previous.items():
        out[k] = F.coalesce(F.lag(F.struct(F.col(c).alias("v"))).over(inside), F.col(f"__p_{k}"))["v"]
    for k, c in running_sum.items():
        here, earlier = F.sum(c).over(up), F.col(f"__s_{k}")
        out[k] = F.coalesce(here + earlier, here, earlier)
    for k, c in least_after.items():
        out[k] = F.least(F.min(c).over(down), F.col(f"__m_{k}"))
    return joined.select(*df.columns, *(v.alias(k) for k, v in out.items()))
