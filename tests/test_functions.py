"""Published vectors for the functions and aggregates."""

import math

import pytest
from pyspark.sql import functions as F

from peakloom.functions import intervals as I
from peakloom.functions import profiles as P
from peakloom.operators import aggregates as A
from peakloom.operators import density as D


def one(spark, **cols):
    return spark.range(1).select(*(v.alias(k) for k, v in cols.items())).first()


def arr(*v):
    return F.array(*(F.lit(float(x)) for x in v))


def mapped(d):
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])


def test_interval_overlap_is_signed(spark):
    row = one(spark, **{f"x{i}": I.iou(F.lit(0.0), F.lit(10.0), F.lit(a), F.lit(b)) for i, (a, b) in enumerate([(5.0, 15.0), (10.0, 15.0), (15.0, 20.0)])})
    assert [round(v, 9) for v in row] == [round(1 / 3, 9), 0.0, -0.25]


def test_count_of_neighbours_is_half_open(spark):
    df = spark.createDataFrame([(float(i),) for i in range(5)], "x double")
    got = [r["n_neighbors"] >= 3 for r in D.neighbor_counts(df, [], "x", 1.1).orderBy("x").collect()]
    assert got == [False, True, True, True, False]
    exact = {r["x"]: r["n_neighbors"] for r in D.neighbor_counts(df, [], "x", 1.0).collect()}
    assert exact == {0.0: 1, 1.0: 2, 2.0: 2, 3.0: 2, 4.0: 2}


@pytest.mark.parametrize("values, expect", [([8.04, 6.95, 7.58, 8.81, 8.33, 9.96, 7.24, 4.26, 10.84, 4.82, 5.68], (7.50, 3.752, -0.055, 2.179))])
def test_moments(spark, values, expect):
    m = A.weighted_moments(spark.createDataFrame([(v,) for v in values], "x double"), [], "x").first()
    assert (m["mean"], m["var"], m["skew"], m["kurtosis"]) == pytest.approx(expect, abs=1e-3)


def test_weighted_and_constant_moments(spark):
    m = A.weighted_moments(spark.createDataFrame([(8.0, 1000), (19.0, 100)], "x double, w long"), [], "x", "w").first()
    assert (m["mean"], m["var"], m["min"], m["max"]) == pytest.approx((9, 10, 8, 19))
    c = A.weighted_moments(spark.createDataFrame([(1.0,), (1.0,)], "x double"), [], "x").first()
    assert (c["mean"], c["var"], c["var_bessel"], c["var_reliability"], c["skew"], c["kurtosis"]) == (1, 0, 0, 0, 0, None)


def test_histogram_and_merge(spark):
    h = lambda rows, off: A.histogram(spark.createDataFrame(rows, "rt double, w long"), [], "rt", "w", 1.0, F.lit(off))
    as_map = lambda d: {r["bin"]: r["weight"] for r in d.collect()}
    assert as_map(h([(0.0, 1), (1.0, 2), (2.0, 3), (2.0, 4), (3.0, 5)], 1.1)) == {-2: 1, -1: 2, 0: 7, 1: 5}
    a = h([(0.0, 1), (1.0, 2), (2.0, 3), (5.0, 5)], -0.45)
    b = h([(0.0, 11), (1.0, 12), (2.0, 13), (3.0, 15)], 1.55)
    got = as_map(A.merge_histograms(a, b, [], 1.0))
    assert (got[0], got[1], got[2], got.get(4), got[5]) == (12, 14, 16, None, 5)


def test_cosines(spark):
    r = one(spark, same=P.array_cosine(arr(1, 1, 1, 1, 1), arr(1, 1, 1, 1, 1)), other=P.array_cosine(arr(1, 1, 1, 1, 1), arr(1, 1, 1, 1, 20)), zero=P.array_cosine(arr(0, 0), arr(1, 1)))
    assert r["same"] == pytest.approx(1) and r["other"] <= 0.9 and r["zero"] is None
    m = {0: 1.0, 1: 1.0, 2: 2.0, 3: 1.0}
    r = one(spark, same=P.map_cosine(mapped(m), mapped(m)), other=P.map_cosine(mapped(m), mapped({**m, 2: 22.0})))
    assert r["same"] == pytest.approx(1) and r["other"] <= 0.9


def test_shifted_cosine(spark):
    c = lambda a, b, sa, sb, za=1.0, zb=1.0: P.shifted_cosine(a, b, F.lit(sa), F.lit(sb), F.lit(za), F.lit(zb))
    r = one(spark, shifted=c(arr(0, 1, 2, 3), arr(2, 3, 0, 0), 0.0, 2.0), back=c(arr(2, 3, 0, 0), arr(0, 1, 2, 3), 2.0, 0.0), apart=c(arr(1, 1), arr(1, 1), 0.0, 9.0), sizes=c(arr(1, 1), arr(1, 1), 0.0, 0.0, 1.0, 2.0))
    assert r["shifted"] == pytest.approx(1) and r["back"] == pytest.approx(1) and r["apart"] is None and r["sizes"] is None


def test_dense_profile_and_order(spark):
    r = one(spark, dense=P.dense_profile(mapped({0: 5, 2: 7}), F.lit(1.5), 1.0, F.lit(0.0), 5), order=P.argsort(arr(4, 1, 3, 2, 5)))
    assert r["dense"] == [0, 5, 0, 7, 0] and r["order"] == [1, 3, 2, 0, 4]
    letters = F.array(*map(F.lit, "pqrst"))
    assert one(spark, v=P.reorder(letters, P.argsort(arr(4, 1, 3, 2, 5))))["v"] == ["q", "s", "r", "p", "t"]


def test_boxes_and_scalars(spark):
    r = one(spark, inside=I.box_contains(F.lit(1.0), F.lit(1.0), F.lit(2.0)), touch=I.boxes_intersect(F.lit(0), F.lit(1), F.lit(1), F.lit(2)), top=I.saturate(F.lit(1 << 40)), text=I.profile_text(arr(0, 1)), l1=I.l1(F.lit(-3.0), F.lit(4.0)), l2=I.l2(F.lit(-3.0), F.lit(4.0)))
    assert tuple(r) == (True, False, 4294967295, "[0.0, 1.0]", 7.0, 5.0)
    assert one(spark, d=I.fallback_discriminant(F.lit(-9.0), F.lit(0.6)))["d"] == pytest.approx(math.log(10) + 0.2)


def test_cycle_time_forms_agree(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 5.0), (1, 9.0), (2, 4.0)], "g int, t double")
    assert A.cycle_time(df, "g", "t").first()[0] == pytest.approx((3 + 4) / 2)
    assert A.cycle_time_telescoped(df, "g", "t").first()[0] == pytest.approx((3 + 4) / 2)
