"""Space partitions: the join's rows equal those of all pairs, dense places and copies are spread."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakloom.operators import density, space

SCHEMA = "id long, k long, x double, y double"
COORDS = [("x", 1.0), ("y", 2.0)]


def skewed(n, seed=3):
    rng = np.random.default_rng(seed)
    wide = rng.uniform(0, 200, (n, 2))
    dense = rng.normal(50, 0.15, (n // 3, 2))
    copies = np.full((n // 6, 2), 120.25)
    return np.concatenate([wide, dense, copies])


def frame(spark, points):
    rows = [(i, i % 2, float(x), float(y)) for i, (x, y) in enumerate(points)]
    rows += [(-1, 0, None, 1.0), (-2, 0, float("nan"), 1.0), (-3, 0, float("inf"), 1.0), (-4, 1, 0.0, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.mark.parametrize("keys", [[], ["k"]])
@pytest.mark.parametrize(("metric", "closed", "radius"), [("l1", False, 1.0), ("l2", True, 0.5), ("box", True, 1.0)])
def test_equals_all_pairs(spark, keys, metric, closed, radius):
    points = np.round(skewed(300), 2)
    df = frame(spark, points)
    got = space.balanced_radius_join(df, df, keys, COORDS, ["id"], ["id"], metric=metric, closed=closed, radius=radius, units=60)
    d = np.abs(points[:, None] / np.array([1.0, 2.0]) / radius - points[None] / np.array([1.0, 2.0]) / radius)
    size = {"l1": d.sum(axis=2), "l2": (d * d).sum(axis=2), "box": d.max(axis=2)}[metric]
    near = size <= 1 if closed else size < 1
    if keys:
        near &= (np.arange(len(points))[:, None] - np.arange(len(points))[None]) % 2 == 0
    assert sorted(map(tuple, got.select("l_id", "r_id").collect())) == sorted(map(tuple, np.argwhere(near).tolist()))


def test_other_side_and_empty_tables(spark):
    left, right = frame(spark, np.round(skewed(100, 1), 2)), frame(spark, np.round(skewed(150, 2), 2))
    got = space.balanced_radius_join(left, right, [], COORDS, ["id"], ["id"], units=40)
    want = density.radius_join(left, right, [], COORDS, ["id"], ["id"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    for a, b in ((left.limit(0), right), (left, right.limit(0)), (left.limit(0), right.limit(0))):
        assert space.balanced_radius_join(a, b, [], COORDS, ["id"], ["id"], units=40).count() == 0


def test_no_share_is_heavy(spark):
    points = skewed(3000)
    tree = space.lay_planes(points, points, 64)
    own = tree.owner(points, np.arange(len(points)))
    rows, share = tree.near(points)
    assert (np.bincount(rows) >= 1).all()
    d = np.abs(points[:, None] - points[None])
    near = (d.max(axis=2) < 1) & (d.sum(axis=2) < 1)
    pairs = np.zeros(tree.shares)
    reach = np.zeros((len(points), tree.shares), bool)
    reach[rows, share] = True
    for s in range(tree.shares):
        mine = np.flatnonzero(own == s)
        pairs[s] = near[mine].sum()
        assert reach[near[mine].any(axis=0), s].all()
    # a fixed cell holds a third of all pairs or more
    cells = np.unique(np.floor(points), axis=0, return_inverse=True)[1].reshape(-1)
    assert np.bincount(cells, weights=near.sum(axis=1)).max() > pairs.sum() / 5 and pairs.max() < pairs.sum() / 16


def test_largest_task_of_a_skewed_table(spark):
    df = frame(spark, skewed(6000))
    join = lambda f, **more: f(df, df, [], COORDS, ["id"], ["id"], **more)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        rows = lambda j: [r[1] for r in j.groupBy(F.spark_partition_id()).count().collect()]
        plain, spread = rows(join(density.radius_join)), rows(join(space.balanced_radius_join, units=64))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(plain) == sum(spread)
    assert len(spread) == 8 and max(spread) < 4 * np.median(spread) and max(spread) < max(plain) / 2
    assert max(plain) > 4 * np.median(plain)
