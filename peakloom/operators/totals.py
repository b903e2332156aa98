"""Totals over the neighbours of each point without forming pairs: runs of sorted coordinates and running sums.

Tables are parted by keys and by ranges of the first coordinate, with a margin of one reach on both sides, so a row is
shuffled once (few of them twice), not once a cell. A task sorts its points on the first axis; the neighbours of a point that share the other coordinates
are a run there, so their number and weight are differences of running sums. Where the other coordinates hardly repeat,
pairs are formed in batches.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Reaches that a range is wide; 2 of SPAN + 2 rows come twice.
SPAN = 16
#: Pairs that are held at a time.
PAIRS = 1 << 20


def in_ranges(df: DataFrame, x: Column) -> DataFrame:
    """df with __range, its copies for ranges whose margin a row lies in, and __own for the one that it lies in itself. x: in reaches; rows without x have one copy."""
    cell = lambda v: F.floor(v / F.lit(float(SPAN)))
    reach = F.lit(1 + 1e-9) + F.abs(x) * F.lit(1e-14)
    copies = df.withColumn("__range", F.explode(F.coalesce(F.sequence(cell(x - reach), cell(x + reach)), F.array(F.lit(0).cast("long")))))
    return copies.withColumn("__own", F.coalesce(F.col("__range") == cell(x), F.lit(True)))


def is_near(metric: str, closed: bool):
    """deltas (a list, one an axis) -> which are near; never becomes true again as a delta grows."""

    def near(deltas: list) -> np.ndarray:
        if metric == "box":
            ok = deltas[0] <= 1 if closed else deltas[0] < 1
            for d in deltas[1:]:
                ok = ok & (d <= 1 if closed else d < 1)
            return ok
        total = deltas[0] if metric == "l1" else deltas[0] * deltas[0]
        for d in deltas[1:]:
            total = total + (d if metric == "l1" else d * d)
        return total <= 1 if closed else total < 1

    return near


def near_totals(points: np.ndarray, weight: np.ndarray, own: np.ndarray, near) -> tuple[np.ndarray, np.ndarray]:
    """(number, weight) of the points near each of the points `own`, themselves included. points: (n, axes), finite, in radii."""
    first, rest = points[:, 0], points[:, 1:]
    kinds, kind = np.unique(rest, axis=0, return_inverse=True) if rest.shape[1] else (np.zeros((1, 0)), np.zeros(len(points), np.int64))
    kind = kind.reshape(-1)
    n, total = np.zeros(len(points), np.int64), np.zeros(len(points), weight.dtype)
    if len(kinds) <= 1024 and len(points) >= 8 * len(kinds):
        _by_kinds(first, kinds, kind, weight, own, near, n, total)
    else:
        _by_pairs(first, rest, weight, own, near, n, total)
    return n[own], total[own]


def _by_kinds(first, kinds, kind, weight, own, near, n, total) -> None:
    order = np.lexsort((first, kind))
    parts = np.split(order, np.searchsorted(kind[order], np.arange(1, len(kinds))))
    mine = np.zeros(len(first), bool)
    mine[own] = True
    held = []
    for part in parts:
        x, at = np.unique(first[part], return_index=True)
        ends = np.concatenate([at, [len(part)]])
        held.append((x, ends, np.concatenate([np.zeros(1, weight.dtype), np.cumsum(weight[part])])[ends]))
    zero = np.zeros(1)
    for a, part in enumerate(parts):
        part = part[mine[part]]
        if not len(part):
            continue
        x, back = np.unique(first[part], return_inverse=True)
        number, mass = np.zeros(len(x), np.int64), np.zeros(len(x), weight.dtype)
        apart = np.abs(kinds[a] - kinds)
        for b in np.flatnonzero(near([np.zeros(len(kinds)), *apart.T])).tolist():
            other, counts, sums = held[b]
            deltas = list(apart[b])
            # about how far, by bisection on the rule itself; then to the exact ends
            low, high = 0.0, 1.0
            for _ in range(30):
                middle = (low + high) / 2
                low, high = (middle, high) if near([zero + middle, *deltas])[0] else (low, middle)
            lo, hi = np.searchsorted(other, x - low), np.searchsorted(other, x + low, "right")
            fits = lambda i, ok: ok & near([np.abs(x - other[np.clip(i, 0, len(other) - 1)]), *deltas])  # noqa: E731, B023
            while (more := fits(lo - 1, lo > 0)).any():
                lo = lo - more
            while (less := (lo < hi) & ~fits(lo, lo < hi)).any():
                lo = lo + less
            hi = np.maximum(hi, lo)
            while (more := fits(hi, hi < len(other))).any():
                hi = hi + more
            while (less := (lo < hi) & ~fits(hi - 1, lo < hi)).any():
                hi = hi - less
            number += counts[hi] - counts[lo]
            mass += sums[hi] - sums[lo]
        n[part], total[part] = number[back.reshape(-1)], mass[back.reshape(-1)]


def _by_pairs(first, rest, weight, own, near, n, total) -> None:
    cells, cell = np.unique(np.floor(rest).astype(np.int64), axis=0, return_inverse=True)
    cell = cell.reshape(-1)
    order = np.lexsort((first, cell))
    bounds = np.searchsorted(cell[order], np.arange(len(cells) + 1))
    place = {tuple(c): i for i, c in enumerate(cells.tolist())}
    mine = own[np.argsort(cell[own], kind="stable")]
    starts = np.searchsorted(cell[mine], np.arange(len(cells) + 1))
    for a, c in enumerate(cells.tolist()):
        left = mine[starts[a] : starts[a + 1]]
        for step in product((-1, 0, 1), repeat=rest.shape[1]):
            b = place.get(tuple(u + v for u, v in zip(c, step, strict=True)))
            if b is None or not len(left):
                continue
            others = order[bounds[b] : bounds[b + 1]]
            x = first[others]
            lo, hi = np.searchsorted(x, first[left] - 1 - 1e-9), np.searchsorted(x, first[left] + 1 + 1e-9, "right")
            sizes = hi - lo
            ends = np.cumsum(sizes)
            i = 0
            while i < len(left):
                done = ends[i - 1] if i else 0
                j = max(i + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
                which = np.repeat(np.arange(j - i), sizes[i:j])
                p = left[i:j][which]
                q = others[np.arange(len(which)) + np.repeat(lo[i:j] - (ends[i:j] - sizes[i:j] - done), sizes[i:j])]
                good = near([np.abs(first[p] - first[q]), *np.abs(rest[p] - rest[q]).T])
                which, q = which[good], q[good]
                n[left[i:j]] += np.bincount(which, minlength=j - i)
                np.add.at(total, p[good], weight[q])
                i = j


def neighbor_sums(df: DataFrame, keys: list[str], coords: list[tuple[str, float]], uid: list[str], weight: str, *, metric: str = "l1", closed: bool = False, total: str = "near") -> DataFrame:
    """(keys, uid, n, total): of each uid the number and the weight of all rows of its group that are near (as density.radius_join of df with itself).

    Rows with a null key or a null, NaN or infinite coordinate are near nothing. Weights are whole numbers, a null counts 0. Rows of one uid add up.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    (x, scale), *_ = coords
    columns = list(dict.fromkeys([*keys, *uid, *(c for c, _ in coords)]))
    fine = F.lit(True)
    for k in keys:
        fine &= F.col(k).isNotNull()
    for c, _ in coords:
        v = F.col(c).cast("double")
        fine &= v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    lean = df.where(fine).select(*columns, F.coalesce(F.col(weight).cast("long"), F.lit(0).cast("long")).alias("__w"))
    copies = in_ranges(lean, F.col(x).cast("double") / F.lit(float(scale)))
    out = T.StructType([*(lean.schema[c] for c in dict.fromkeys([*keys, *uid])), T.StructField("n", T.LongType()), T.StructField(total, T.LongType())])
    schema, named = to_arrow_schema(out), [f.name for f in out.fields[:-2]]
    near = is_near(metric, closed)
    # rows of one uid lie in one range then
    together = x in uid

    def task(rows: pa.Table) -> pa.Table:
        own = np.flatnonzero(rows["__own"].to_numpy(zero_copy_only=False))
        points = np.column_stack([rows[c].to_numpy().astype(float) / s for c, s in coords])
        n, sums = near_totals(points, rows["__w"].to_numpy(), own, near)
        kept = rows.select(named).take(pa.array(own)).append_column("__n", pa.array(n)).append_column("__s", pa.array(sums))
        if together:
            kept = kept.group_by(named, use_threads=False).aggregate([("__n", "sum"), ("__s", "sum")]).select([*named, "__n_sum", "__s_sum"])
        return kept.rename_columns(schema.names).cast(schema)

    found = copies.groupBy(*keys, "__range").applyInArrow(task, out)
    if together:
        return found
    return found.groupBy(*dict.fromkeys([*keys, *uid])).agg(F.sum("n").alias("n"), F.sum(total).alias(total))


def local_components(points: np.ndarray) -> np.ndarray:
    """A number for each point, alike for points that steps of an L1 distance under 1 join. points: (n, axes), finite, in radii.

    Points that share all coordinates but the first are joined to the next along it; others to the nearest on both
    sides in each other such line, which joins all that are near.
    """
    first, rest = points[:, 0], points[:, 1:]
    kinds, kind = np.unique(rest, axis=0, return_inverse=True) if rest.shape[1] else (np.zeros((1, 0)), np.zeros(len(points), np.int64))
    kind = kind.reshape(-1)
    order = np.lexsort((first, kind))
    x, line = first[order], kind[order]
    bounds = np.searchsorted(line, np.arange(len(kinds) + 1))
    chain = np.cumsum(np.concatenate([[0], (line[1:] != line[:-1]) | ~(np.abs(x[1:] - x[:-1]) < 1)]))
    links = []
    for a in range(len(kinds)):
        apart = np.abs(kinds[a + 1 :] - kinds[a])
        total = sum((apart[:, i] for i in range(1, apart.shape[1])), apart[:, 0]) if apart.shape[1] else np.zeros(0)
        mine = np.arange(bounds[a], bounds[a + 1])
        for b in (a + 1 + np.flatnonzero(total < 1)).tolist():
            at = bounds[b] + np.searchsorted(x[bounds[b] : bounds[b + 1]], x[mine])
            for other, there in ((at - 1, at > bounds[b]), (at, at < bounds[b + 1])):
                near = np.abs(x[mine] - x[np.clip(other, 0, len(x) - 1)])
                for d in np.abs(kinds[b] - kinds[a]).tolist():
                    near = near + d
                hit = there & (near < 1)
                links.append(np.unique(np.stack([chain[mine[hit]], chain[other[hit]]]), axis=1))
    label = np.arange(chain[-1] + 1 if len(chain) else 0)
    if links:
        u, v = np.concatenate(links, axis=1)
        while True:
            low = np.minimum(label[u], label[v])
            if (label[u] == low).all() and (label[v] == low).all():
                break
            np.minimum.at(label, label[u], low)
            np.minimum.at(label, label[v], low)
            while (label[label] != label).any():
                label = label[label]
    out = np.empty(len(points), np.int64)
    out[order] = label[chain]
    return out


def eps_roots(df: DataFrame, keys: list[str], coords: list[tuple[str, float]], uid: list[str]) -> DataFrame:
    """(root, n): of each component of rows at an L1 distance under 1 within their group, the least uid (a struct) and the number of different uids. Rows of one uid are joined.

    A task joins the rows of a range of the first coordinate and its margin, so what leaves it is a root a row; only roots
    that a row has in two ranges, or by two of its rows, are edges of a graph.
    """
    from peakloom.operators.graph import connected_components
    from peakloom.workspace import materialize
    from pyspark.sql.pandas.types import to_arrow_schema

    (x, scale), *_ = coords
    fine = F.lit(True)
    for k in keys:
        fine &= F.col(k).isNotNull()
    for c, _ in coords:
        v = F.col(c).cast("double")
        fine &= v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    lean = df.select(*dict.fromkeys([*keys, *uid, *(c for c, _ in coords)]), fine.alias("__fine"))
    # a row that is near nothing is still a row of its uid
    copies = in_ranges(lean, F.when(F.col("__fine"), F.col(x).cast("double") / F.lit(float(scale))))
    fields = [lean.schema[c] for c in uid]
    out = T.StructType([*fields, *(T.StructField(f"__r{i}", f.dataType) for i, f in enumerate(fields))])
    schema = to_arrow_schema(out)

    def task(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in uid])
        good = np.flatnonzero(rows["__fine"].to_numpy(zero_copy_only=False))
        root = np.arange(len(rows))
        points = np.column_stack([rows[c].to_numpy(zero_copy_only=False).astype(float)[good] / s for c, s in coords])
        if len(good):
            label = local_components(points)
            least = np.full(label.max() + 1, len(rows))
            np.minimum.at(least, label, good)
            root[good] = least[label]
        ids = rows.select(uid)
        roots = ids.take(pa.array(root))
        return pa.Table.from_arrays([*ids.columns, *roots.columns], names=schema.names).cast(schema)

    found = copies.groupBy(*keys, "__range").applyInArrow(task, out)
    root = F.struct(*(F.col(f"__r{i}").alias(c) for i, c in enumerate(uid)))
    ids = found.groupBy(*uid).agg(F.collect_set(root).alias("roots"))
    ids = materialize(ids.select(F.array_min("roots").alias("root"), F.when(F.size("roots") > 1, F.col("roots")).alias("more")), "roots")
    links = ids.where("more IS NOT NULL").select("root", F.explode("more").alias("other")).where("root <> other").distinct()
    joined = connected_components(links, "root", "other").select(F.col("node").alias("root"), "component")
    counts = ids.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(joined, "root", "left").groupBy(F.coalesce("component", "root").alias("root")).agg(F.sum("n").alias("n"))
