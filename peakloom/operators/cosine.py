"""Pairs of sparse vectors by cosine, without all pairs: inverted lists of the rare parts of the vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peakloom.workspace import materialize, partition_count

#: Listed vectors of a dimension that one task takes as its own; dimensions up to which their counts are broadcast; pairs that are held at a time.
LISTED, BROADCAST, PAIRS = 20_000, 400_000, 1 << 20


def cosine_join(entries: DataFrame, id_col: str, dim_col: str, value_col: str, least: float) -> DataFrame:
    """(left, right, cosine) of the ids left < right whose vectors have a cosine of at least `least` (over 0).

    entries: a row an entry; several of one id and dimension add up. Dimensions are ordered by how many
    vectors have them, rare ones first. Of a vector only the entries before its norm left to go falls under `least` of the whole are listed:
    two vectors that share none of these have all that they share where one of them has less
    norm left than the cosine needs. So every pair is met, and dimensions that most vectors have are hardly ever listed. Vectors travel with their
    listed entries; a task verifies the pairs of a list that share another dimension, or whose product at this one suffices, where their first shared listed dimension is
    this one. Pairs that aren't similar are never rows. Null ids, dimensions and values, zeros and vectors of norm 0 play no part.
    """
    if not 0 < least <= 1:
        raise ValueError("the cosine must be over 0 and at most 1")
    fine = entries.select(F.col(id_col).alias("id"), F.col(dim_col).alias("dim"), F.col(value_col).cast("double").alias("v")).where("id IS NOT NULL AND dim IS NOT NULL AND v IS NOT NULL")
    # any order of the dimensions would do, if it is one for all
    common = fine.groupBy("dim").agg(F.count(F.lit(1)).alias("n"))
    if common.count() <= BROADCAST:
        common = F.broadcast(common)
    # one shuffle for both groupings
    cells = fine.join(common, "dim").repartition(partition_count(entries), "id").groupBy("id", "n", "dim").agg(F.sum("v").alias("v")).where("v <> 0 AND NOT isnan(v)")
    vectors = cells.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "dim", "v"))).alias("e"))
    # the norm left from an entry on, the entry itself counted; a hair's breadth covers rounding
    square = F.aggregate("e", F.lit(0.0), lambda s, x: s + x["v"] * x["v"])
    zero = F.struct(F.lit(0.0).alias("seen"), F.lit(0).alias("n"))
    bound = F.lit(least * least * (1 - 1e-9)) * F.col("norm2")
    listed = F.aggregate("e", zero, lambda acc, x: F.struct((acc["seen"] + x["v"] * x["v"]).alias("seen"), (acc["n"] + F.when(F.col("norm2") - acc["seen"] >= bound, 1).otherwise(0)).alias("n")), lambda acc: acc["n"])
    vectors = vectors.withColumn("norm2", square).withColumn("listed", listed).select("id", "norm2", "listed", F.col("e.dim").alias("dims"), F.col("e.v").alias("vs"))
    vectors = materialize(vectors, "cosine-vectors")
    lists = vectors.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("listed") - 1)))
    lists = lists.withColumn("dim", F.get("dims", F.col("at")))
    # a long list is dealt to shares: each has some of it as its own and all of it to compare with
    long = vectors.select(F.explode(F.slice("dims", 1, F.col("listed"))).alias("dim")).groupBy("dim").count().where(F.col("count") > LISTED)
    long = F.broadcast(long.select("dim", F.ceil(F.col("count") / LISTED).cast("int").alias("shares")))
    lists = lists.join(long, "dim", "left").withColumn("shares", F.coalesce("shares", F.lit(1)))
    lists = lists.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).withColumn("own", F.col("share") == F.pmod(F.xxhash64("id"), F.col("shares")))
    kind = vectors.schema["id"].dataType
    out = T.StructType([T.StructField("left", kind), T.StructField("right", kind), T.StructField("cosine", T.DoubleType())])
    return lists.groupBy("dim", "share").applyInArrow(_list_task(least, out), out)


def _list_task(least: float, out: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(out)

    def task(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks().sort_by("id")
        n = len(rows)
        dims, vs = rows["dims"].combine_chunks(), rows["vs"].combine_chunks()
        sizes = dims.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        # dimensions as numbers of this task
        dim = dims.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        value = vs.flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        starts, of = ends - sizes, np.repeat(np.arange(n), sizes)
        place = np.arange(len(of)) - starts[of]
        at, listed = rows["at"].to_numpy(), rows["listed"].to_numpy()
        norm = np.sqrt(rows["norm2"].to_numpy())
        here = value[starts + at]
        share = here / norm
        own = np.flatnonzero(rows["own"].to_numpy(zero_copy_only=False))
        # entries but that of the list, by dimension and vector
        entry = np.flatnonzero(place != at[of])
        entry = entry[np.argsort(dim[entry], kind="stable")]
        held = dim[entry]
        mine = np.flatnonzero(place != at[of])
        mine_at = np.searchsorted(of[mine], np.arange(n + 1))
        low, high = np.searchsorted(held, dim[mine]), np.searchsorted(held, dim[mine], "right")
        met = np.concatenate([[0], np.cumsum(high - low)])[mine_at]
        by_share = np.argsort(share, kind="stable")
        level = share[by_share]
        # by this dimension alone: a product that suffices, both positive or both negative
        with np.errstate(divide="ignore"):
            need = least * (1 - 1e-9) / share
        first = np.where(share > 0, np.searchsorted(level, need), 0)
        last = np.where(share > 0, n, np.searchsorted(level, need, "right"))
        alone = np.maximum(last - first, 0)
        work = np.cumsum((met[1:] - met[:-1] + alone)[own])
        parts = []
        i = 0
        while i < len(own):
            j = max(i + 1, int(np.searchsorted(work, (work[i - 1] if i else 0) + PAIRS, "right")))
            some = own[i:j]
            a, b = _expand(some, first[some], alone[some])
            b = by_share[b]
            alone_keys = (a * n + b)[a < b]
            _, e = _expand(some, mine_at[some], mine_at[some + 1] - mine_at[some])
            src, dst = _expand(e, low[e], high[e] - low[e])
            src, dst = mine[src], entry[dst]
            a, b = of[src], of[dst]
            up = a < b
            src, dst, shared = src[up], dst[up], (a * n + b)[up]
            # met in an earlier list: a dimension that both list before this one
            earlier = (place[src] < at[of[src]]) & (place[dst] < listed[of[dst]]) & (place[dst] < at[of[dst]])
            keys = np.unique(np.concatenate([alone_keys, shared]))
            where = np.searchsorted(keys, shared)
            dot = here[keys // n] * here[keys % n] + np.bincount(where, value[src] * value[dst], minlength=len(keys))
            again = np.bincount(where, earlier, minlength=len(keys)) > 0
            cosine = dot / (norm[keys // n] * norm[keys % n])
            good = ~again & (cosine >= least)
            parts.append((keys[good], cosine[good]))
            i = j
        keys = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
        cosine = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0)
        ids = rows["id"]
        return pa.Table.from_arrays([ids.take(pa.array(keys // n)), ids.take(pa.array(keys % n)), pa.array(cosine)], names=schema.names).cast(schema)

    return task


def _expand(which: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(w, place): for each w of which the places from its start on, as many as its count."""
    return np.repeat(which, counts), np.arange(counts.sum()) + np.repeat(starts - (np.cumsum(counts) - counts), counts)
