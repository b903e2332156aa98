"""Weighted moments as mergeable states: one scan of the rows, then only states.

A state is (n, w, w2, mean, m2, m3, m4, min, max): the number of rows, the sums of weights and of
their squares, the weighted mean, the sums of weighted central powers, the ends. States of any two sets of
rows merge to that of both, so they can be stored, and added to later.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATE = T.StructType([T.StructField("n", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("w", "w2", "mean", "m2", "m3", "m4", "min", "max"))])
_NAMES = STATE.names


def merge_arrays(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """States, a row each, merged pairwise; a state of no weight leaves the other's mean and powers."""
    n, w, w2 = a[0] + b[0], a[1] + b[1], a[2] + b[2]
    with np.errstate(all="ignore"):
        share = np.where(w != 0, b[1] / w, 0.0)
        d = b[3] - a[3]
        mean = np.where(a[1] == 0, b[3], np.where(b[1] == 0, a[3], a[3] + d * share))
        da, db = np.where(a[1] == 0, 0.0, a[3] - mean), np.where(b[1] == 0, 0.0, b[3] - mean)
    m2 = a[4] + b[4] + a[1] * da**2 + b[1] * db**2
    m3 = a[5] + b[5] + 3 * (da * a[4] + db * b[4]) + a[1] * da**3 + b[1] * db**3
    m4 = a[6] + b[6] + 4 * (da * a[5] + db * b[5]) + 6 * (da**2 * a[4] + db**2 * b[4]) + a[1] * da**4 + b[1] * db**4
    return np.array([n, w, w2, mean, m2, m3, m4, np.minimum(a[7], b[7]), np.maximum(a[8], b[8])])


def states_of(group: np.ndarray, groups: int, x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The states of `groups` groups of rows, about their own means."""
    add = lambda v: np.bincount(group, v, groups)
    total = add(w)
    with np.errstate(all="ignore"):
        mean = np.where(total != 0, add(w * x) / total, 0.0)
    d = x - mean[group]
    low, high = np.full(groups, np.inf), np.full(groups, -np.inf)
    np.minimum.at(low, group, x)
    np.maximum.at(high, group, x)
    return np.array([np.bincount(group, minlength=groups).astype(float), total, add(w * w), mean, add(w * d**2), add(w * d**3), add(w * d**4), low, high])


def moment_states(df: DataFrame, keys: list[str], x: str, weight: str | None = None, *, most_keys: int = 100_000) -> DataFrame:
    """(keys, state): each task's state of each of its keys, in one scan without a shuffle; merge_states makes them one a key.

    Rows without x or a weight are left out. A task holds up to most_keys states, then sends them on and begins anew.
    """
    rows = df.select(*(F.col(f"`{k}`") for k in keys), F.col(f"`{x}`").cast("double").alias("__x"), (F.col(f"`{weight}`").cast("double") if weight else F.lit(1.0)).alias("__w")).where("__x IS NOT NULL AND __w IS NOT NULL")
    schema = T.StructType([*rows.schema.fields[:-2], T.StructField("state", STATE)])

    def out(held: pa.Table | None, states: np.ndarray) -> Iterator[pa.RecordBatch]:
        parts = [pa.array(states[0].astype(np.int64)), *(pa.array(v) for v in states[1:])]
        struct = pa.StructArray.from_arrays(parts, names=_NAMES)
        yield from pa.Table.from_arrays([*(c.combine_chunks() for c in held.columns), struct], names=[*keys, "state"]).to_batches()

    def run(batches) -> Iterator[pa.RecordBatch]:
        held, states = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if keys:
                at, group = _numbered(table.select(keys))
                groups, names = len(at), table.select(keys).take(pa.array(at))
            else:
                group, groups, names = np.zeros(batch.num_rows, np.int64), 1, None
            new = states_of(group, groups, table["__x"].to_numpy(), table["__w"].to_numpy())
            if not keys:
                states = new if states is None else merge_arrays(states, new)
                continue
            held, states, full = _gather(held, states, names, new, most_keys)
            if full is not None:
                yield from out(*full)
        if states is not None:
            if keys:
                yield from out(held, states)
            else:
                parts = [pa.array(states[0].astype(np.int64)), *(pa.array(v) for v in states[1:])]
                yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(parts, names=_NAMES)], names=["state"])

    return rows.mapInArrow(run, schema)


def _numbered(keys: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(a row of each distinct key, the key number of each row); nulls are values."""
    codes = [c.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) for c in keys.columns]
    _, at, group = np.unique(np.column_stack(codes), axis=0, return_index=True, return_inverse=True)
    return at, group.ravel()


def _gather(held, states, names: pa.Table, new: np.ndarray, most: int):
    """(keys, states) of both, and what had to go out because they would be over `most`."""
    if held is None:
        return names, new, None
    if held.num_rows + names.num_rows > most:
        return names, new, (held, states)
    both = pa.concat_tables([held, names])
    at, group = _numbered(both)
    empty = np.zeros((len(_NAMES), len(at)))
    empty[7], empty[8] = np.inf, -np.inf
    a, b = empty.copy(), empty.copy()
    a[:, group[: held.num_rows]] = states
    b[:, group[held.num_rows :]] = new
    return both.take(pa.array(at)), merge_arrays(a, b), None


def merged(a: Column, b: Column) -> Column:
    """The state of both sets of rows."""
    w = a["w"] + b["w"]
    mean = F.when(a["w"] == 0, b["mean"]).when(b["w"] == 0, a["mean"]).otherwise(a["mean"] + (b["mean"] - a["mean"]) * (b["w"] / w))
    # as one value, so that it is worked out once
    return F.get(F.transform(F.array(F.struct(mean.alias("mean"), F.when(a["w"] == 0, 0.0).otherwise(a["mean"] - mean).alias("da"), F.when(b["w"] == 0, 0.0).otherwise(b["mean"] - mean).alias("db"))), lambda s: F.struct(
        (a["n"] + b["n"]).alias("n"), w.alias("w"), (a["w2"] + b["w2"]).alias("w2"), s["mean"].alias("mean"),
        (a["m2"] + b["m2"] + a["w"] * s["da"] * s["da"] + b["w"] * s["db"] * s["db"]).alias("m2"),
        (a["m3"] + b["m3"] + F.lit(3.0) * (s["da"] * a["m2"] + s["db"] * b["m2"]) + a["w"] * F.pow(s["da"], 3) + b["w"] * F.pow(s["db"], 3)).alias("m3"),
        (a["m4"] + b["m4"] + F.lit(4.0) * (s["da"] * a["m3"] + s["db"] * b["m3"]) + F.lit(6.0) * (s["da"] * s["da"] * a["m2"] + s["db"] * s["db"] * b["m2"]) + a["w"] * F.pow(s["da"], 4) + b["w"] * F.pow(s["db"], 4)).alias("m4"),
        F.least(a["min"], b["min"]).alias("min"), F.greatest(a["max"], b["max"]).alias("max"),
    )), F.lit(0))


def merge_states(states: DataFrame, keys: list[str], state: str = "state") -> DataFrame:
    """One state a key. There are at most a few states a key and task, whatever the rows."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), *(F.lit(0.0).alias(c) for c in _NAMES[1:-2]), F.lit(float("inf")).alias("min"), F.lit(float("-inf")).alias("max"))
    lists = states.groupBy(*keys).agg(F.collect_list(state).alias("__all"))
    return lists.select(*keys, F.aggregate("__all", zero, merged).alias(state))


def finish_moments(states: DataFrame, keys: list[str], state: str = "state") -> DataFrame:
    """keys with n, w_sum, mean, var, sd, var_bessel, var_reliability, skew, kurtosis, min and max, as aggregates.weighted_moments."""
    s = F.col(state)
    positive = s["m2"] > 0
    ratio = lambda a, b: F.when(b != 0, a / b)
    return states.where(s["n"] > 0).select(
        *keys, s["n"].alias("n"), s["w"].alias("w_sum"), s["mean"].alias("mean"), ratio(s["m2"], s["w"]).alias("var"), F.sqrt(ratio(s["m2"], s["w"])).alias("sd"),
        ratio(s["m2"], s["w"] - s["w"] / s["n"]).alias("var_bessel"), ratio(s["m2"], s["w"] - F.when(s["w"] != 0, s["w2"] / s["w"]).otherwise(0.0)).alias("var_reliability"),
        F.when(positive, F.sqrt(s["w"]) * s["m3"] / F.pow(s["m2"], 1.5)).otherwise(F.lit(0.0)).alias("skew"), F.when(positive, s["w"] * s["m4"] / (s["m2"] * s["m2"])).alias("kurtosis"), s["min"].alias("min"), s["max"].alias("max"),
    )
