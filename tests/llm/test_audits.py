"""Manifest, filter audit and license scans against brute force; hard inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import permutations

from pyspark.sql import functions as F

from peakloom.llm import filter_audit, license_rules, licenses, merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def framed(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def fold_up(leaves, fanout):
    """(root, a path of (left, right) a leaf) of one tree."""
    paths, place, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        for k, p in enumerate(place):
            run = p // fanout * fanout
            paths[k].append(("".join(nodes[run:p]), "".join(nodes[p + 1 : run + fanout])))
        nodes = [sha("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
        place = [p // fanout for p in place]
    return nodes[0], paths


def plain_manifest(rows, fanout):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for name in names:
        those = sorted(groups[name], key=lambda r: (r[0] is not None, r[0] or 0, framed(r)))
        trees.append((those, *fold_up([framed(r) for r in those], fanout)))
    root, tops = fold_up([t[1] for t in trees], fanout)
    out = []
    for (those, subroot, paths), top in zip(trees, tops):
        for r, path in zip(those, paths):
            path = path + top
            h = framed(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                h = framed((*r[:4], None if r[4] is None else r[4].replace("\n", "")))
            for left, right in path:
                h = sha(left + h + right)
            out.append((r[0], framed(r), subroot, root, sha("".join(a + b for a, b in path)), h, h == root))
    return out


def manifest_rows(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = "hot" if rng.random() < 0.5 else rng.choice([None, "", "a", "é", "漢", "zz", *(f"s{k}" for k in range(8))])
        rows.append((None if rng.random() < 0.03 else rng.choice([i, i, i, rng.randrange(-n, n)]), source, rng.choice([None, "en", ""]), rng.choice([None, 3]), rng.choice([None, "", "x\ny", "\n", "ab " * rng.randrange(5), "é🙂\n"])))
    return rows + rows[: n // 10]


def test_manifest_equals_brute_force(spark):
    key = lambda r: tuple(str(x) for x in r)
    for n, fanout, levels in ((400, 3, 2), (70, 2, 1), (90, 3, 6), (1, 3, 6)):
        rows = manifest_rows(n, n)
        docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("leaf", "digest", "tree", "idx", "root", "block")})
        changed = [F.translate("text", "\n", "") if c == "text" else F.col(c) for c in merkle.FIELDS]
        hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
        found = merkle.merkle_manifest(docs, carry={"tampered": F.when(hit, merkle.leaf_digest(changed))}, fanout=fanout, levels=levels)
        siblings = F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), "")
        folded = found.withColumn("f", merkle.fold_proof(F.coalesce("tampered", "leaf"), F.col("proof")))
        got = folded.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256), "f", F.col("f") == F.col("root")).collect()
        assert sorted(map(key, got)) == sorted(map(key, plain_manifest(rows, fanout)))


def test_manifest_of_no_rows(spark):
    assert merkle.merkle_manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_manifest_of_a_long_text(spark):
    rows = [(1, "a", "en", 1, "long \n" * 400_000), (2, "a", "en", 1, "short")]
    got = {r["doc_id"]: r for r in merkle.merkle_manifest(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1]["leaf"] == framed(rows[0]) and got[1]["root"] == got[1]["subroot"] == sha(framed(rows[0]) + framed(rows[1]))


def plain_audit(rows, labels):
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    docs = []
    for i, part, text in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 3 * len(t)) + "D" * bool(re.search(r"[#$%&*|]", t))
        f += "E" * any(j is not None and i is not None and j < i and (u or "") == t for j, _, u in rows)
        docs.append((part or "", f, i in good, i in toxic))
    out, shapley = [], Counter()
    for part in {d[0] for d in docs}:
        those = [d for d in docs if d[0] == part]
        for order in permutations("ABCDE"):
            left, gone = those, []
            for step, c in enumerate(order, 1):
                here = [d for d in left if c in d[1]]
                out.append([part, "".join(order), step, len(left) - len(here), len(here), sum(c in d[1] for d in gone), sum(d[1] == c for d in those), sum(d[2] for d in here), sum(d[3] for d in here)])
                shapley[part, c] += len(here)
                left, gone = [d for d in left if c not in d[1]], gone + here
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def audit_rows(n, seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    hot = "Same text\vhere"
    rows = []
    for i in range(n):
        text = rng.choice([None, "", hot, hot, "x\x1cy z " * 230, " ".join(rng.choices(words, k=rng.randrange(150, 400))), " ".join(rng.choices(words[:20], k=250)), "ABC def $ " * 3, "É" * 9, "#"])
        rows.append((None if rng.random() < 0.05 else rng.randrange(n), rng.choice([None, "", "en", "de"]), text))
    return rows


def test_filter_audit_equals_brute_force(spark, monkeypatch):
    rows = audit_rows(300, 5)
    labels = [(i, random.Random(i).choice([None, 0, 1]), random.Random(i + 9).choice([None, 0, 1])) for i in range(0, 330, 2)] + [(4, 1, 1), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumns({c: F.lit("clash") for c in ("id", "part", "mask", "n", "f", "t")}).repartition(5)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit("clash"))
    want = plain_audit(rows, labels)
    assert sorted(tuple(r) for r in filter_audit.audit_filters(docs, marks).collect()) == want
    # texts that all have one fingerprint, and batches of one text each
    scan = filter_audit._scan
    monkeypatch.setattr(filter_audit, "_scan", lambda *a: lambda rows: scan(*a)((7, *r[1:]) for r in rows))
    monkeypatch.setattr(filter_audit, "HELD_BYTES", 1)
    masks = filter_audit.failure_masks(docs).groupBy("id", "part", "mask").agg(F.sum("n").alias("n")).collect()
    assert sum(r["n"] for r in masks) == len(rows)
    duplicates = Counter()
    for r in masks:
        duplicates[r["id"]] += r["n"] * (r["mask"] >> 4 & 1)
    assert {k: v for k, v in duplicates.items() if v} == dict(Counter(i for i, _, t in rows if i is not None and any(j is not None and j < i and (u or "") == (t or "") for j, _, u in rows)))


def test_filter_audit_of_no_rows_and_long_texts(spark):
    none = spark.createDataFrame([], "doc_id long, lang string, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_filters(none, labels).count() == 0
    rows = [(1, "en", "word " * 500_000), (2, "en", "word " * 500_000), (3, None, None)]
    got = filter_audit.audit_filters(spark.createDataFrame(rows, "doc_id long, lang string, text string"), labels).collect()
    assert sorted(tuple(r) for r in got) == plain_audit(rows, [])


LICENSE_TEXTS = [
    "Licensed under CC BY-NC 4.0.", "released under the MIT License, mit-license; MIT\nLICENSE", "GNU General Public License, version 3 or later", "gnu general public licenses", "GNU Lesser General Public License version 2.1 or (at your option) any later version",
    "SPDX-License-Identifier: Apache-2.0 OR MIT", "https://creativecommons.org/licenses/by-sa/3.0/ and CC BY", "éMIT License", "mit licenseß", "", "cc by", "cc by cc by", "(c) 1999 someone else and others. All rights reserved.", "the the the", "KKMIT LICENSE",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
]


def plain_licenses(text, ordered):
    folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)
    base = [(i, label) for phrase, label in licenses.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.decode().split()]
    line = " " + "".join(w + " " for w in words)
    found = []
    for k, r in enumerate(ordered):
        for m in re.finditer(rf"(?<= )(?:{r.pattern})(?= )", line, re.A):
            found.append((len(line[: m.start()].split()), len(line[: m.end()].split()), k))
    better = lambda a, b: (ordered[a[2]].priority, a[0] - a[1], a[2]) < (ordered[b[2]].priority, b[0] - b[1], b[2])
    kept = []
    for d in sorted(found, key=lambda d: (ordered[d[2]].priority, d[0] - d[1], d[2])):
        if not any(k[0] <= d[0] and d[1] <= k[1] and better(k, d) for k in kept):
            kept.append(d)
    labels = {b for _, b in base} | {ordered[k].label for _, _, k in kept}
    return len(words), len(base), min((i for i, _ in base), default=None), max((i for i, _ in base), default=None), sorted({b for _, b in base}), sorted(labels), sorted((s, e, ordered[k].name) for s, e, k in kept)


def test_licenses_equal_brute_force(spark):
    ordered = license_rules.rules()
    rng = random.Random(2)
    parts = ["gnu", "General", "public", "license", "version", "2", "2.0", "or", "later", "any later version", "cc", "by", "nc", "sa", "4.0", "apache", "mit", "bsd", "3", "clause", "é", "-", "lesser", "the", "public domain", "gpl", "v3", "all rights reserved", "copyright", "licensed under"]
    texts = LICENSE_TEXTS + [" ".join(rng.choice(parts) for _ in range(rng.randrange(1, 60))) for _ in range(150)] + [None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("labels", "score", "n_words")})
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs).collect()}
    for i, t in enumerate(texts):
        r, want = got[i], plain_licenses(t, ordered)
        assert r["text"] == t
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], sorted((d["start"], d["end"], d["rule"]) for d in r["detections"])) == want, t
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"]) and set(r["base_labels"]) <= set(r["labels"])


def test_rules_are_sound():
    ordered = license_rules.rules()
    assert len(ordered) > 300 and len({r.name for r in ordered}) == len(ordered)
    scanner = licenses.Scanner(ordered)
    order = {r.name: k for k, r in enumerate(ordered)}
    for text, label in (("Apache License, Version 2.0", "apache-2.0"), ("GPL v2 or later", "gpl-2.0-or-later"), ("2-Clause BSD", "bsd-2-clause"), ("CC BY-NC-SA 3.0", "cc-by-nc-sa-3.0"), ("Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa-4.0"), ("Mozilla Public License Version 1.1", "mpl-1.1"), ("the Unlicense", "unlicense")):
        assert [d.rule.label for d in licenses.resolve(scanner.detect(scanner.words(text)[1]), order)] == [label], text


def test_licenses_of_hard_inputs(spark):
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    long = "mit license " * 100_000 + "neither the name of " * 20_000
    docs = spark.createDataFrame([(1, long), (1, long), (None, None)], "doc_id long, text string")
    got = licenses.scan_licenses(docs, keep=["doc_id"]).collect()
    assert [r["n_base"] for r in got if r["doc_id"]] == [100_000] * 2 and {r["last_word"] for r in got} == {199_998, None}
