"""Radius joins on space partitions: split planes from a sample, halo copies, one owner a pair.

The fixed cells of `density.radius_join` spread a table over tasks as long as no cell is dense. Here
dense cells are cut further by planes through their points, as in a k-d tree: a row is owned by the
leaf that it lies in and is copied to the leaves within the radius, so each pair is met once, in
the leaf that owns its left row. Points that no plane can part (copies) are dealt to shares of their
leaf. Only where the planes lie comes from the sample; the rows of the join do not depend on it.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.operators.density import radius_join
from peakloom.workspace import partition_count

#: Rows of each side that the planes are laid by, on the driver.
SAMPLE_ROWS = 20_000


@dataclass(frozen=True)
class Space:
    """A tree of planes. Node i parts axis[i] at at[i] into child[i] (below) and child[i] + 1; a leaf
    has axis -1 and the shares first[i] .. first[i] + ways[i] - 1. Coordinates are in radii."""

    axis: np.ndarray
    at: np.ndarray
    child: np.ndarray
    first: np.ndarray
    ways: np.ndarray

    @property
    def shares(self) -> int:
        return int(self.ways.sum())

    def owner(self, points: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """The one share that owns each point; salt deals the points of a leaf to its shares."""
        node = np.zeros(len(points), np.int64)
        while (inner := np.flatnonzero(self.axis[node] >= 0)).size:
            n = node[inner]
            node[inner] = self.child[n] + (points[inner, self.axis[n]] >= self.at[n])
        return self.first[node] + salt % self.ways[node]

    def near(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, share) for all shares of all leaves within 1 of each point, by point."""
        rows, nodes = np.arange(len(points)), np.zeros(len(points), np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while rows.size:
            leaf = self.axis[nodes] < 0
            r, n = rows[leaf], nodes[leaf]
            step = np.repeat(np.arange(len(r)), self.ways[n])
            within = np.arange(len(step)) - np.repeat(np.cumsum(self.ways[n]) - self.ways[n], self.ways[n])
            done.append((r[step], self.first[n][step] + within))
            rows, nodes = rows[~leaf], nodes[~leaf]
            x, at = points[rows, self.axis[nodes]], self.at[nodes]
            reach = 1 + 1e-9 + 1e-14 * np.abs(at)  # a plane is no bound of the join: rather one copy more
            low, high = x - reach < at, x + reach >= at
            rows, nodes = np.concatenate([rows[low], rows[high]]), np.concatenate([self.child[nodes[low]], self.child[nodes[high]] + 1])
        out, share = (np.concatenate(a) for a in zip(*done, strict=True)) if done else (np.zeros(0, np.int64),) * 2
        order = np.argsort(out, kind="stable")
        return out[order], share[order]


def lay_planes(own: np.ndarray, held: np.ndarray, units: int) -> Space:
    """Planes for a join of own with held, both (n, axes) in radii, so that no cell of a leaf has many more than one in `units` of the candidate pairs.

    The heaviest cell of all leaves is parted next, at the median of its owned points on the axis
    where they spread most; if all of them are one point, its leaf gets shares.
    """
    cells = np.unique(np.floor(np.concatenate([own, held])), axis=0, return_inverse=True)[1].reshape(-1)
    own_cell, held_cell = cells[: len(own)], cells[len(own) :]
    axis, at, child, ways = [-1], [0.0], [0], [1]

    def heaviest(o: np.ndarray, h: np.ndarray) -> tuple[float, int, float]:
        if not len(o) or not len(h):
            return 0.0, -1, 0.0
        n = int(max(own_cell[o].max(), held_cell[h].max())) + 1
        pairs = np.bincount(own_cell[o], minlength=n).astype(float) * np.bincount(held_cell[h], minlength=n)
        return float(pairs.max()), int(pairs.argmax()), float(pairs.sum())

    everything = np.arange(len(own)), np.arange(len(held))
    work, cell, total = heaviest(*everything)
    most = total / max(units, 1)
    queue = [(-work, 0, cell, *everything)]
    while queue and -queue[0][0] > most:
        work, node, cell, o, h = heapq.heappop(queue)
        points = own[o[own_cell[o] == cell]]
        spread = points.max(axis=0) - points.min(axis=0)
        if not spread.max() > 0:
            ways[node] = int(np.ceil(-work / most))
            continue
        a = int(spread.argmax())
        plane = float(np.median(points[:, a]))
        if plane <= points[:, a].min():
            plane = float(points[points[:, a] > plane, a].min())
        axis[node], at[node], child[node] = a, plane, len(axis)
        reach = 1 + 1e-9
        for part in ((o[own[o, a] < plane], h[held[h, a] - reach < plane]), (o[own[o, a] >= plane], h[held[h, a] + reach >= plane])):
            axis.append(-1)
            at.append(0.0)
            child.append(0)
            ways.append(1)
            work, cell, _ = heaviest(*part)
            heapq.heappush(queue, (-work, len(axis) - 1, cell, *part))
    leaf = np.array(axis) < 0
    count = np.where(leaf, ways, 0)
    return Space(np.array(axis), np.array(at), np.array(child), np.cumsum(count) - count, count)


def sampled_space(left: DataFrame, right: DataFrame, coords: list[tuple[str, float]], *, radius: float = 1.0, units: int, sample_rows: int = SAMPLE_ROWS) -> Space:
    """Planes by about sample_rows rows of each side, which is all that comes to the driver."""
    scaled = [(F.col(c) / F.lit(s * radius)).alias(f"c{i}") for i, (c, s) in enumerate(coords)]

    def points(df: DataFrame) -> np.ndarray:
        df = df.select(*scaled)
        count = df.count()
        if count > sample_rows:
            df = df.sample(sample_rows / count, seed=1)
        x = df.toPandas().to_numpy(float).reshape(-1, len(coords))
        return x[np.isfinite(x).all(axis=1)]

    own = points(left)
    return lay_planes(own, own if right is left else points(right), units)


def balanced_radius_join(left: DataFrame, right: DataFrame, keys: list[str], coords: list[tuple[str, float]], left_cols: list[str], right_cols: list[str], *, metric: str = "l1", closed: bool = False, radius: float = 1.0, box: list[float] | None = None, units: int | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of `density.radius_join`, with dense places spread over tasks.

    units: how many parts of the candidate pairs no cell of a leaf is to exceed by much, by default
    four for each shuffle partition. A table without dense cells gets few planes and few copies.
    Rows with a null, NaN or infinite coordinate are near nothing. Columns named __space and __salt are taken.
    """
    units = units or 4 * partition_count(left)
    space = sampled_space(left, right, coords, radius=radius, units=units, sample_rows=sample_rows)
    scaled = [(F.col(c) / F.lit(s * radius)).cast("double") for c, s in coords]
    finite = F.lit(True)
    for x in scaled:
        finite &= x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))

    def stacked(columns) -> np.ndarray:
        return np.column_stack([c.to_numpy(float) for c in columns])

    @F.pandas_udf("int")
    def owner(salt: pd.Series, *columns: pd.Series) -> pd.Series:
        return pd.Series(space.owner(stacked(columns), salt.to_numpy()).astype(np.int32))

    @F.pandas_udf("array<int>")
    def near(*columns: pd.Series) -> pd.Series:
        rows, share = space.near(stacked(columns))
        ends = np.searchsorted(rows, np.arange(1, len(columns[0])))
        return pd.Series(np.split(share.astype(np.int32), ends))

    if space.shares == 1:
        return radius_join(left.where(finite), right.where(finite), keys, coords, left_cols, right_cols, metric=metric, closed=closed, radius=radius, box=box)
    salt = F.xxhash64(*left_cols).bitwiseAND(F.lit((1 << 40) - 1))
    le = left.where(finite).withColumn("__space", owner(salt, *scaled))
    ri = right.where(finite).withColumn("__space", F.explode(near(*scaled)))
    return radius_join(le, ri, [*keys, "__space"], coords, left_cols, right_cols, metric=metric, closed=closed, radius=radius, box=box).drop("__space")
