"""Substring dedup, n-gram join and embeddings against brute force; hard inputs."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakloom.llm.embedding_dedup import embedding_components
from peakloom.llm.ngram_join import ngram_components
from peakloom.llm.substring_dedup import dedup_substrings

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def texts_with_copies(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["é", "漢字", "the", "a"]
    out = []
    for i in range(n):
        t = [rng.choice(words) for _ in range(rng.choice([0, 1, 4, 12, 13, 14, 40, 120]))]
        if out and rng.random() < 0.6:
            src = rng.choice(out)[1].split() if rng.choice(out)[1] else []
            if src:
                a = rng.randrange(len(src))
                t[len(t) // 2 : len(t) // 2] = src[a : a + rng.randrange(1, 60)]
        if out and rng.random() < 0.2:
            t = (rng.choice(out)[1] or "").split()
            if t and rng.random() < 0.7:
                t[rng.randrange(len(t))] = "edit"
        out.append((i * 3, rng.choice([" ", "\t", "\n", "  "]).join(t)))
    rng.shuffle(out)
    return out


def plain_substrings(rows, n=13):
    first = {}
    split = [(i, SPACE.findall(t or "")) for i, t in rows]
    for i, w in split:
        if i is None:
            continue
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - n + 1):
            if i is not None and first[tuple(w[k : k + n])] < i:
                gone.update(range(k, k + n))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), kept))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings(spark, seed):
    rows = texts_with_copies(seed) + [(1000, None), (1001, ""), (1002, " \n"), (None, "x " * 40), (7, "x " * 40), (7, "x " * 40)]
    got = dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got.collect()), key=str) == plain_substrings(rows)


def test_substring_spans_are_maximal(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(1, passage), (2, f"a b {passage} c {passage}")]
    got = {r["doc_id"]: r for r in dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(s) for s in got[2]["removed"]] == [(2, 32), (33, 63)] and got[2]["kept"] == "a b c" and got[1]["removed"] == []


def test_a_very_long_text_and_clashing_columns(spark):
    rng = random.Random(4)
    long = " ".join(f"v{rng.randrange(10**6)}" for _ in range(400_000))
    rows = [(1, long, "x", 1), (2, "start " + long[:200_000], "y", 2)]
    got = {r["doc_id"]: r for r in dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string, kept string, batch int")).collect()}
    want = {i: (n, g, k) for i, n, g, k in plain_substrings([(a, b) for a, b, *_ in rows])}
    assert {i: (r["n_words"], r["n_removed"], r["kept"]) for i, r in got.items()} == want


def plain_components(rows, n=5, percent=75):
    sets = []
    for i, t in rows:
        w = SPACE.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append((i, {tuple(w[k : k + n]) for k in range(max(len(w) - n + 1, 1))} if w else set()))
    root = list(range(len(sets)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            common = len(sets[a][1] & sets[b][1])
            if sets[a][1] and 100 * common >= percent * len(sets[a][1] | sets[b][1]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(s), least.get(find(k)) if s else i) for k, (i, s) in enumerate(sets)), key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ngram_components(spark, seed):
    rng = random.Random(seed)
    base = [f"b{rng.randrange(50)}" for _ in range(60)]
    rows = texts_with_copies(seed)
    for i in range(40):  # a large group of near copies, some beyond the bound
        w = list(base)
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(9)}"
        rows.append((500 + i, " ".join(w)))
    rows += [(900, None), (901, ""), (902, "One two"), (903, "one TWO"), (None, "one two"), (904, "solo"), (5000, "Solo"), (5000, "solo")]
    got = ngram_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()), key=str) == plain_components(rows)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert dedup_substrings(docs).count() == 0 and ngram_components(docs).count() == 0
    assert embedding_components(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_nothing_similar(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "g h i j k l")], "doc_id long, text string")
    assert sorted(map(tuple, ngram_components(docs).collect())) == [(1, 2, 1), (2, 2, 2)]


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows = []
    for g in range(60):
        center = rng.standard_normal(24)
        for _ in range(int(rng.integers(1, 6))):
            rows.append((center + rng.standard_normal(24) * 0.04).tolist())
    rows += [rows[0], rows[0], [2 * x for x in rows[0]]]
    hot = rng.standard_normal(24)
    rows += [(hot + rng.standard_normal(24) * 0.02).tolist() for _ in range(120)]
    data = [(i, v, i % 2) for i, v in enumerate(rows)]
    odd = [(9000, None, 1), (9001, [0.0] * 24, 1), (9002, [float("nan")] * 24, 1), (9003, [None] + [1.0] * 23, 1), (9004, rows[0], None), (9005, rows[0][:7], 0), (9006, [], 1)]
    got = {r["vec_id"]: r for r in embedding_components(spark.createDataFrame(data + odd, "vec_id long, embedding array<double>, label int"), block=32).collect()}
    assert len(got) == len(data) + len(odd)
    x = np.array(rows)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    label = np.arange(len(rows)) % 2
    near = (unit @ unit.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    links = near.sum(axis=1)
    mine = np.array([got[i]["n_links"] for i in range(len(rows))])
    assert (mine <= links).all() and mine.sum() >= 0.99 * links.sum()
    comp = np.arange(len(rows))
    for _ in range(len(rows)):
        new = np.minimum(comp, np.where(near, comp[None, :], len(rows)).min(axis=1))
        if (new == comp).all():
            break
        comp = new
    agree = np.mean([got[i]["component_id"] == comp[i] for i in range(len(rows))])
    assert agree >= 0.97
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i, *_ in odd)


def test_embeddings_of_a_large_bucket_null_ids_and_clashing_names(spark):
    rng = np.random.default_rng(9)
    base = rng.standard_normal(16)
    rows = [(i, (base + 0.01 * rng.standard_normal(16)).tolist(), 1) for i in range(120)] + [(None, base.tolist(), 1), (500, base.tolist(), None), (501, rng.standard_normal(16).tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    df = df.withColumns({c: F.lit("clash") for c in ("node", "mark", "mark2", "v", "id", "key", "links", "component", "bucket", "codes")})
    got = embedding_components(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["vec_id"] in (500, 501):
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, r["vec_id"], True)
        else:  # all near each other, the one without an id too
            assert (r["n_links"], r["component_id"], r["kept"]) == (120, 0, r["vec_id"] == 0)
