"""Interval joins, ordered scans and mergeable moments against plain forms."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakloom.operators import aggregates, density, moments, reshape, scans
from peakloom.operators.cosine import cosine_join

INF = float("inf")


def interval_tables(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([None, float("nan"), rng.uniform(-50, 50), float(rng.randrange(-20, 20)), 1e300, -0.0])) for i in range(300)]
    windows = [(k, rng.choice(["a", "b", None]), *sorted((rng.uniform(-60, 60), rng.uniform(-60, 60)))) for k in range(40)]
    windows += [(100, "a", -INF, 3.0), (101, "b", 2.0, INF), (102, "a", 5.0, 5.0), (103, "a", 7.0, 6.0), (104, "a", None, 3.0), (105, "a", 1.0, None), (106, "a", 0.0, 4.0), (107, "a", -4.0, 4.0), (108, "a", 3.0, 3.0000001), (109, "b", -1e300, 1e301), (110, "a", float("nan"), 1.0)]
    return rows, windows, spark.createDataFrame(rows, "id long, g string, v double"), spark.createDataFrame(windows, "w long, g string, lo double, hi double")


@pytest.mark.parametrize("most", [100_000, 0])
def test_windows_against_all_pairs(spark, monkeypatch, most):
    monkeypatch.setattr(reshape, "MOST_WINDOWS", most)
    rows, windows, df, w = interval_tables(spark)
    holds = lambda v, lo, hi: None not in (v, lo, hi) and lo <= v < hi
    want = sorted((i, k) for i, _, v in rows for k, _, lo, hi in windows if holds(v, lo, hi))
    free = reshape.split_by_windows(df, w.drop("g"), "v", "lo", "hi")
    assert sorted((r["id"], r["w"]) for r in free.collect()) == want and free.columns == ["id", "g", "v", "w", "lo", "hi"]
    keyed = reshape.split_by_windows(df, w, "v", "lo", "hi", ["g"])
    assert sorted((r["id"], r["w"]) for r in keyed.collect()) == sorted((i, k) for i, g, v in rows for k, h, lo, hi in windows if g is not None and g == h and holds(v, lo, hi))
    for found in (free, keyed):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert reshape.split_by_windows(df, w.limit(0), "v", "lo", "hi", ["g"]).count() == 0 and reshape.split_by_windows(df.limit(0), w, "v", "lo", "hi", ["g"]).count() == 0


def test_no_query_splits_by_nested_loops(spark):
    from peakloom.plans import queries

    for name in ("window_split", "bundle_by_group", "split_dense_frames"):
        plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan, name


def test_scans_against_plain_loops(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["hot"] * 6 + ["b", None, "c"]), rng.randrange(1000), i, rng.choice([None, rng.randrange(-50, 50)])) for i in range(400)] + [("one", 1, 900, None)]
    df = spark.createDataFrame(rows, "k string, t long, id long, v long").repartition(5)
    got = {r["id"]: r for r in scans.segmented_scan(df, ["k"], ["t", "id"], previous={"p": "v"}, running_sum={"s": "v"}, least_after={"m": "v"}, partitions=7).collect()}
    assert len(got) == len(rows)
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        total = None
        for j, (_, _, i, v) in enumerate(own):
            if v is not None:
                total = (total or 0) + v
            rest = [x[3] for x in own[j:] if x[3] is not None]
            assert (got[i]["p"], got[i]["s"], got[i]["m"]) == (own[j - 1][3] if j else None, total, min(rest) if rest else None)
    assert scans.segmented_scan(df.limit(0), ["k"], ["t", "id"], previous={"p": "v"}).count() == 0
    whole = scans.segmented_scan(df, [], ["t", "id"], running_sum={"s": "v"}, partitions=3).orderBy(F.desc("t"), F.desc("id")).first()
    assert whole["s"] == sum(r[3] for r in rows if r[3] is not None)


def test_moment_states(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, 2]), 1e6 + rng.gauss(0, 3), rng.choice([0.0, 1.0, 2.5, 7.0])) for _ in range(500)] + [("c", 1, 4.0, 2.0), ("d", 1, None, 1.0), ("e", 1, 1.0, None), ("z", 1, 5.0, 0.0)]
    df = spark.createDataFrame(rows, "k string, j int, x double, w double").repartition(6)
    for keys, most in ((["k", "j"], 100_000), (["k", "j"], 2), ([], 10)):
        states = moments.moment_states(df, keys, "x", "w", most_keys=most)
        assert "hashpartitioning" not in states._jdf.queryExecution().executedPlan().toString()
        got = {tuple(r[k] for k in keys): r for r in moments.finish_moments(moments.merge_states(states, keys), keys).collect()}
        for key in {tuple(dict(zip(("k", "j"), r))[k] for k in keys) for r in rows if None not in r[2:]}:
            own = [(x, w) for k, j, x, w in rows if x is not None and w is not None and (not keys or (k, j) == key)]
            x, w = np.array([o[0] for o in own]), np.array([o[1] for o in own])
            r, total = got[key], w.sum()
            assert r["n"] == len(own) and r["min"] == x.min() and r["max"] == x.max()
            if total == 0:
                continue
            mean = (w * x).sum() / total
            m2, m3, m4 = ((w * (x - mean) ** k).sum() for k in (2, 3, 4))
            assert math.isclose(r["mean"], mean, rel_tol=1e-12) and math.isclose(r["var"], m2 / total, rel_tol=1e-6, abs_tol=1e-9)
            assert m2 < 1e-6 or (math.isclose(r["skew"], math.sqrt(total) * m3 / m2**1.5, rel_tol=1e-5, abs_tol=1e-6) and math.isclose(r["kurtosis"], total * m4 / m2**2, rel_tol=1e-5))
        assert len(got) == len({tuple(dict(zip(("k", "j"), r))[k] for k in keys) for r in rows if None not in r[2:]})
    plain = df.where("k IS NOT NULL AND w > 0")
    one = {r["k"]: r for r in moments.finish_moments(moments.merge_states(moments.moment_states(plain, ["k"], "x", "w"), ["k"]), ["k"]).collect()}
    for r in aggregates.weighted_moments(plain, ["k"], "x", "w").collect():
        assert all(r[c] is None and one[r["k"]][c] is None or math.isclose(r[c], one[r["k"]][c], rel_tol=1e-5, abs_tol=1e-6) for c in ("n", "w_sum", "mean", "var", "var_reliability", "skew", "kurtosis"))
    assert moments.merge_states(moments.moment_states(df.limit(0), ["k"], "x"), ["k"]).count() == 0


def test_boxes_under_one_cut_the_ball(spark):
    rng = random.Random(1)
    rows = [(i, rng.uniform(0, 3), rng.uniform(0, 3)) for i in range(60)] + [(60, 0.5, 1.0), (61, 0.75, 1.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    for box in ([0.25, 1.0], [0.25, 0.5], [1.0, 9.0], None):
        got = {(r["l_id"], r["r_id"]) for r in density.radius_join(df, df, [], [("x", 1.0), ("y", 1.0)], ["id"], ["id"], box=box).collect()}
        bx, by = box or (1, 1)
        assert got == {(a, b) for a, x, y in rows for b, u, v in rows if abs(x - u) + abs(y - v) < 1 and (bx >= 1 or abs(x - u) <= bx) and (by >= 1 or abs(y - v) <= by)}


def test_cosine_join_finds_every_pair(spark):
    rng = random.Random(7)
    vectors = {i: {d: rng.choice([-1.0, 1.0, 2.0, 5.0]) for d in rng.sample(range(12), rng.randrange(1, 6))} | ({99: 3.0} if i % 3 else {}) for i in range(80)}
    vectors |= {i: dict(vectors[i - 80]) for i in range(80, 90)}
    rows = [(i, d, v) for i, own in vectors.items() for d, v in own.items()] + [(5, None, 1.0), (None, 3, 1.0), (6, 3, None), (200, 1, 0.0), (201, 2, 4.0), (201, 2, -4.0)]
    df = spark.createDataFrame(rows, "i long, d long, v double")

    def cosine(a, b):
        return sum(v * b.get(d, 0.0) for d, v in a.items()) / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))

    for least in (0.3, 0.77, 0.95):
        got = {(r["left"], r["right"]): r["cosine"] for r in cosine_join(df, "i", "d", "v", least).collect()}
        want = {(a, b): cosine(vectors[a], vectors[b]) for a in vectors for b in vectors if a < b}
        assert all(k in got for k, c in want.items() if c >= least + 1e-9) and all(want[k] >= least - 1e-9 and math.isclose(want[k], c, abs_tol=1e-12) for k, c in got.items())
    assert cosine_join(df.limit(0), "i", "d", "v", 0.5).count() == 0
    with pytest.raises(ValueError):
        cosine_join(df, "i", "d", "v", 0.0)
