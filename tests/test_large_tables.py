"""Plans and kernels that must not grow with the square of a table or a dense place."""

import random

import numpy as np
from pyspark.sql import functions as F

from peakloom.operators import ranking, scans


def test_no_frame_runs_to_the_end(spark):
    """A frame from a row to the end of its partition is worked out anew for each row."""
    df = spark.range(40).selectExpr("id", "id % 3 AS k", "id * 7 % 11 AS v", "IF(id % 4 = 0, -1, 1) AS label")
    scanned = scans.segmented_scan(df, ["k"], ["id"], least_after={"m": "v"})
    rated = ranking.q_values(df, [F.col("v").desc(), F.col("id")], "label")
    for found in (scanned, rated):
        assert "currentrow$(), unboundedfollowing$()" not in found._jdf.queryExecution().executedPlan().toString()
    rows = [(r["k"], r["id"], r["v"], r["m"]) for r in scanned.collect()]
    assert len(rows) == 40 and all(m == min(v for k2, i2, v, _ in rows if k2 == k and i2 >= i) for k, i, _, m in rows)


def test_search_forms_no_rows_of_ions_or_hits(spark, monkeypatch):
    """A search writes no table of ions, and its candidates pass no join but the one of spectra and peptides by block."""
    from peakloom.plans import fragment_blocks, fragment_index, scoring

    monkeypatch.setattr(fragment_blocks, "BATCH_HITS", 50)
    rng = random.Random(3)
    proteins = [(f"P{i}", "".join(rng.choice("GASKRM") for _ in range(50)), i % 2 == 0) for i in range(30)]
    peptides = scoring.with_masses(scoring.digest(spark.createDataFrame(proteins, "accession string, sequence string, is_decoy boolean")), variable_mods={"M": 15.994915})
    some = scoring.fragments(peptides).where("length(peptide) > 8").orderBy("mass", "peptide", "site").limit(60).collect()
    rows = [(i, (p["mass"] + 2 * scoring.PROTON) / 2, [(m * (1 + rng.uniform(-3e-5, 3e-5)), rng.randrange(1, 4)) for m in (*p["b"], *p["y"]) if rng.random() < 0.7]) for i, p in enumerate(some)] + [(99, 600.0, []), (100, 600.0, None)]
    spectra = spark.createDataFrame(rows, "spec_id long, precursor_mz double, peaks array<struct<mz:double,intensity:long>>")
    index = fragment_index.build_index(peptides)
    found = fragment_index.search_index(spectra, index, block_peptides=5)
    columns = ["spec_id", "charge", "peptide", "site", "matched_b", "matched_y", "b_intensity", "y_intensity", "longest_b", "longest_y", "proteins"]
    table = lambda df: sorted((*(str(r[c]) for c in columns), round(r["average_ppm"], 6)) for r in df.collect())
    want = scoring.match_spectra(spectra, scoring.fragments(peptides), most_fragment_charge=3)
    # candidates need two ions from the second on, so what matches by first ions alone is no candidate here
    got = table(found)
    assert len(got) > 100 and set(got) <= set(table(want)) and len(set(got)) == len(got)
    assert not spark.catalog.tableExists(index.table)
    # what tasks leave out changes no rank
    columns = ["spec_id", "charge", "peptide", "site", "rank", "scored_candidates"]
    ranks = lambda df: sorted((*(str(r[c]) for c in columns), *(round(r[c], 6) for c in ("poisson", "delta_next", "delta_best"))) for r in df.collect())
    assert ranks(scoring.best_matches(spectra, index=index, report=3, chimera=False)) == ranks(scoring.rank_matches(found, report=3))


def _peak_bytes(f):
    import tracemalloc

    tracemalloc.start()
    try:
        out = f()
        return out, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_clusters_of_a_dense_place_in_bounded_memory():
    """3000 points of one place: all nine million pairs are neighbours; 300 of them as a check of the rules."""
    from peakloom.operators import blocks, dbscan

    rng = np.random.default_rng(4)
    points, weight = rng.uniform(0, 0.3, (3000, 3)), np.sort(rng.integers(1, 50, 3000))[::-1].astype(float)
    labels, peak = _peak_bytes(lambda: dbscan.cluster(points, weight, np.arange(3000), 3, 60, np.ones(3)))
    assert (labels == 0).all() and peak < 60e6

    def in_blocks():
        out = np.full(3000, dbscan.UNSEEN)
        waits = blocks.run_block(points, weight, np.ones(3000, bool), out, 3, 60, np.ones(3), lambda seed, others: np.ones(len(others), bool))
        return out, waits

    (labels, waits), peak = _peak_bytes(in_blocks)
    assert (labels == 0).all() and not waits and peak < 60e6


def test_core_points_are_those_of_all_pairs():
    from peakloom.operators.dbscan import core_mask

    rng = np.random.default_rng(6)
    for dims in (1, 2, 3):
        points, weight = rng.uniform(-3, 3, (400, dims)), rng.integers(-1 if dims == 2 else 0, 30, 400).astype(float)
        near = np.abs(points[:, None] - points[None]).sum(axis=2) < 1
        want = (near.sum(axis=1) >= 4) & (near @ weight >= 50)
        assert (core_mask(points, weight, 4, 50) == want).all() and 0 < want.sum() <= 400


def test_totals_against_all_pairs(spark):
    """Totals of neighbours by rows that are shuffled once: repeated and free coordinates, copies, ties at the bound."""
    from peakloom.operators import density, totals

    rng = random.Random(7)
    for name, y in (("repeated", lambda: rng.randrange(5) * 0.01), ("free", lambda: rng.uniform(0, 0.05))):
        rows = [(rng.choice(["a", "b", None]), i % 130, rng.choice([rng.uniform(-40, 40), float(rng.randrange(-9, 9))]), y(), rng.choice([None, 1, 5, 9])) for i in range(300)]
        rows += [("a", 500, None, 0.01, 3), ("a", 501, float("nan"), 0.01, 3), ("b", 502, 1.0, float("inf"), 3)]
        df = spark.createDataFrame(rows, "g string, id long, x double, y double, w long")
        for metric, near in {"l1": lambda a, b: a + b, "l2": lambda a, b: a * a + b * b, "box": max}.items():
            for closed in (False, True):
                want = {}
                for a in rows:
                    for b in rows:
                        if a[0] is None or a[0] != b[0] or a[1] > 499 or b[1] > 499:  # null, NaN and infinite coordinates
                            continue
                        d = near(abs(a[2] / 2.0 - b[2] / 2.0), abs(a[3] / 0.02 - b[3] / 0.02))
                        if d < 1 or (closed and d == 1):
                            n, s = want.get((a[0], a[1]), (0, 0))
                            want[a[0], a[1]] = n + 1, s + (b[4] or 0)
                found = totals.neighbor_sums(df, ["g"], [("x", 2.0), ("y", 0.02)], ["id"], "w", metric=metric, closed=closed)
                assert {(r["g"], r["id"]): (r["n"], r["near"]) for r in found.collect()} == want, (name, metric, closed)
    plan = density.neighbor_counts(df, ["g"], "x", 2.0)._jdf.queryExecution().executedPlan().toString()
    assert "RangeFrame, -2.0, 2.0" not in plan
    got = sorted((r["id"], str(r["x"]), r["n_neighbors"]) for r in density.neighbor_counts(df, ["g"], "x", 2.0).collect())
    assert got == sorted((r[1], str(r[2]), sum(b[0] == r[0] and b[2] is not None and r[2] - 2.0 <= b[2] < r[2] + 2.0 for b in rows) if r[2] is not None else 0) for r in rows)


def test_components_of_a_dense_place_by_few_edges(spark, monkeypatch):
    """Roots against all pairs: rows of one uid in two groups, rows near nothing; a dense place makes no edges but between ranges."""
    from peakloom.operators import graph, totals

    rng = random.Random(11)
    for y in (lambda: rng.randrange(6) * 0.01, lambda: rng.uniform(0, 0.06)):
        rows = [(rng.choice(["a", "b", None]), i % 200, i % 2, rng.uniform(0, 90) if i % 3 else float(rng.randrange(90)), y()) for i in range(260)] + [("a", 900, 0, None, 0.01), ("a", 3, 1, float("nan"), 0.0)]
        df = spark.createDataFrame(rows, "g string, o long, l int, x double, y double")
        head = {r[1:3]: r[1:3] for r in rows}

        def find(u, head=head):
            while head[u] != u:
                u = head[u]
            return u

        for a in rows:
            for b in rows:
                if a[0] is not None and a[0] == b[0] and None not in (a[3], b[3]) and abs(a[3] - b[3]) + abs(a[4] / 0.02 - b[4] / 0.02) < 1:
                    u, v = sorted((find(a[1:3]), find(b[1:3])))
                    head[v] = u
        want = {}
        for u in head:
            want[find(u)] = want.get(find(u), 0) + 1
        got = totals.eps_roots(df, ["g"], [("x", 1.0), ("y", 0.02)], ["o", "l"])
        assert {tuple(r["root"]): r["n"] for r in got.collect()} == want
    made = []
    whole = graph.connected_components
    monkeypatch.setattr(graph, "connected_components", lambda edges, *a: made.append(edges.count()) or whole(edges, *a))
    dense = spark.range(3000).selectExpr("'a' AS g", "id AS o", "id % 100 / 20.0D AS x", "0.0D AS y")
    assert [(r["root"]["o"], r["n"]) for r in totals.eps_roots(dense, ["g"], [("x", 1.0), ("y", 1.0)], ["o"]).collect()] == [(0, 3000)] and made[0] < 10


def test_similar_vectors_make_no_rows_of_the_others(spark, monkeypatch):
    """Long lists in shares and small batches give each pair once; the plan has no join of pairs with vectors."""
    from peakloom.operators import cosine

    monkeypatch.setattr(cosine, "LISTED", 7)
    rng = random.Random(13)
    rows = [(i, rng.choice([1, 1, 1, 2, 3, 4, 5]), float(rng.choice([-2, -1, 1, 2, 9]))) for i in range(90) for _ in range(rng.randrange(1, 5))]
    vectors = {}
    for i, d, v in rows:
        vectors.setdefault(i, {}).setdefault(d, 0.0)
        vectors[i][d] += v
    found = cosine.cosine_join(spark.createDataFrame(rows, "i long, d long, v double"), "i", "d", "v", 0.8)
    plan = found._jdf.queryExecution().executedPlan().toString()
    got = [(r["left"], r["right"], round(r["cosine"], 9)) for r in found.collect()]
    size = {i: sum(v * v for v in x.values()) ** 0.5 for i, x in vectors.items()}
    want = [(a, b, sum(v * vectors[b].get(d, 0.0) for d, v in vectors[a].items()) / (size[a] * size[b])) for a in vectors for b in vectors if a < b and size[a] and size[b]]
    assert sorted(got) == sorted((a, b, round(c, 9)) for a, b, c in want if c >= 0.8) and len(got) > 100
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") <= 1


def test_ladders_without_growing_arrays(spark):
    from peakloom.plans import scoring
    from peakloom.plans.fragment_blocks import ladder_rows

    peptides = scoring.with_masses(spark.createDataFrame([(p,) for p in ("GASPVMK", "MK", "W" * 20, "ACDEFGHIMLMNPQR")], "peptide string"), variable_mods={"M": 15.994915}, lightest=0.0)
    found = ladder_rows(peptides)
    from peakloom.plans.search_queries import fragment_ladders

    assert "posexplode" not in fragment_ladders(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    want = [(r["peptide"], r["site"], k + 1, round(b, 5), round(y, 5)) for r in scoring.fragments(peptides).collect() for k, (b, y) in enumerate(zip(r["b"], r["y"], strict=True))]
    assert sorted(map(tuple, found.collect())) == sorted(want) and len(want) > 40
