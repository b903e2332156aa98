"""Toxicity, quality, sharding, the pipeline and the registry."""

import random
import threading

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from peakloom.llm import quality, shards, toxicity
from peakloom.llm.textblocks import ALNUM_WORDS, Words, mix, text_bytes

SMALL = toxicity.ToxicityConfig(buckets=1 << 10, dim=6, hidden=4, attention=4, window=6, stride=3, epochs=15)
FULL = toxicity.ToxicityConfig(buckets=1 << 12, window=12, stride=6, epochs=20)


def toxic_texts(n, seed):
    rng = random.Random(seed)
    clean = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnr')}{rng.choice('aeiou')}{rng.choice('st')}" for _ in range(150)]
    rows = []
    for i in range(n):
        w = [rng.choice(clean) for _ in range(rng.randrange(3, 60))]
        y = int(rng.random() < 0.3)
        if y:  # a stem with endings never all seen
            w[rng.randrange(len(w))] = "zorgu" + rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("abcdefghij")
        rows.append((i, " ".join(w), y))
    return rows


def test_slices_give_the_logits_of_windows():
    net = toxicity.BiGru(FULL)
    rng = np.random.default_rng(5)
    for n in (3, 12, 13, 60):
        xp = rng.standard_normal((n, 6 * FULL.hidden)).astype(np.float32)
        windows = np.arange(max(n - FULL.window + 1, 0))[:, None] + np.arange(FULL.window)
        want = net.forward(xp[windows], np.ones(windows.shape, np.float32)) if len(windows) else np.zeros(0)
        assert np.allclose(net.full_logits(xp, most=7), want, atol=1e-5)


def test_repeated_words_are_projected_once():
    net = toxicity.BiGru(FULL)
    rng = np.random.default_rng(7)
    distinct = rng.standard_normal((9, 6 * FULL.hidden)).astype(np.float32)
    of = rng.integers(0, 9, 50)
    windows = of[np.arange(50 - FULL.window + 1)[:, None] + np.arange(FULL.window)]
    want = net.forward(distinct[windows], np.ones(windows.shape, np.float32))
    for most in (1, 7, 1024):
        assert np.allclose(net.full_logits(distinct, of, most=most), want, atol=1e-5)


def test_products_of_scoring_stay_on_one_thread(monkeypatch):
    """OpenBLAS shares products of more than 2^18 multiplications with threads that wait busily."""
    sizes = []
    matmul = np.matmul
    monkeypatch.setattr(toxicity.np, "matmul", lambda a, b, **k: sizes.append(a.shape[0] * a.shape[1] * b.shape[1]) or matmul(a, b, **k))
    net = toxicity.BiGru(toxicity.ToxicityConfig())
    net.full_logits(np.zeros((5000, 6 * net.config.hidden), np.float32))
    assert sizes and max(sizes) <= 1 << 18


def test_gradients_by_differences():
    rng = np.random.default_rng(1)
    net = toxicity.BiGru(SMALL)
    for k, v in net.p.items():
        net.p[k] = v.astype(np.float64)
    xp = rng.standard_normal((3, 5, 24))
    mask = np.ones((3, 5))
    mask[1, 3:] = 0
    weight = rng.standard_normal(3)
    value = lambda: float((net.forward(xp, mask) * weight).sum())
    toxicity.F32 = np.float64
    try:
        _, cache = net.forward(xp, mask, keep=True)
        d_xp, g = net.backward(weight, cache)
        for name in ("u", "a", "ba", "va", "o", "bo"):
            flat = net.p[name].reshape(-1)
            for at in rng.choice(len(flat), min(6, len(flat)), replace=False):
                if name == "u" and net.block.reshape(-1)[at] == 0:
                    continue
                old = flat[at]
                flat[at] = old + 1e-4
                up = value()
                flat[at] = old - 1e-4
                down = value()
                flat[at] = old
                assert g[name].reshape(-1)[at] == pytest.approx((up - down) / 2e-4, abs=2e-3)
        for at in [(0, 0, 3), (1, 2, 10), (2, 4, 20)]:
            old = xp[at]
            xp[at] = old + 1e-4
            up = value()
            xp[at] = old - 1e-4
            down = value()
            xp[at] = old
            assert d_xp[at] == pytest.approx((up - down) / 2e-4, abs=2e-3)
    finally:
        toxicity.F32 = np.float32


def test_windows_cover_every_word():
    raw, offsets = text_bytes(pa.array(["a b c d e f g h i j k", "", "x", None, "a b c d e f g"]))
    words = Words(raw, offsets, ALNUM_WORDS)
    starts, owner = toxicity.window_starts(words.bounds, 6, 3)
    covered = {(int(o), int(s) + k) for s, o in zip(starts, owner) for k in range(6) if s + k < words.bounds[o + 1]}
    assert covered == {(t, k) for t in range(5) for k in range(words.bounds[t], words.bounds[t + 1])}


def test_every_window_is_scored():
    net = toxicity.BiGru(SMALL)
    rng = random.Random(6)
    w = [rng.choice("abcdefgh") * 4 for _ in range(40)]
    logits = lambda texts: net.text_logits(Words(*text_bytes(pa.array(texts)), ALNUM_WORDS))
    for n in range(6, 41):
        assert logits([" ".join(w[:n])])[0] == pytest.approx(logits([" ".join(w[i : i + 6]) for i in range(n - 5)]).max(), abs=1e-5)


def test_words_met_again_are_worked_out_once(monkeypatch):
    rng = random.Random(8)
    net = toxicity.BiGru(SMALL)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(500)]
    texts = [" ".join([*vocabulary, *rng.choices(vocabulary, k=9500)]) for _ in range(20)]  # more than one block of bytes
    want = [net.scores(pa.array([t]))[0] for t in texts]
    met = []
    vectors = toxicity.BiGru.words
    monkeypatch.setattr(toxicity.BiGru, "words", lambda self, f: met.append(len(f[0])) or vectors(self, f))
    assert np.allclose(net.scores(pa.array(texts)), want, atol=1e-6)
    assert sum(met) == len(set(vocabulary))


@pytest.mark.parametrize("most", [1, 10, 30, 45, 1000])
def test_known_words_are_bounded_and_change_no_logit(most):
    rng = random.Random(9)
    net = toxicity.BiGru(SMALL)
    known = toxicity.KnownWords(net, most)
    for _ in range(12):
        words = Words(*text_bytes(pa.array([" ".join(f"w{min(rng.randrange(60), rng.randrange(60)) ** 2}x" for _ in range(n)) for n in (0, 3, 25, 40)])), ALNUM_WORDS)
        assert np.allclose(net.text_logits(words, known)[1:], net.text_logits(words)[1:], atol=1e-6)
        distinct = np.unique(words.hashes)
        assert len(distinct) <= len(known.hashes) <= max(most, len(distinct)) and np.all(np.diff(known.hashes.astype(float)) >= 0)


def test_known_words_keep_those_met_again():
    net = toxicity.BiGru(SMALL)
    known = toxicity.KnownWords(net, 6)
    words = lambda text: Words(*text_bytes(pa.array([text])), ALNUM_WORDS)
    for text in ("aa bb cc dd", "aa bb ee", "ff gg"):
        known.rows(words(text))
    assert set(known.hashes.tolist()) == set(words("aa bb ff gg").hashes.tolist())


def test_chunks_of_windows_of_any_width():
    net = toxicity.BiGru(toxicity.ToxicityConfig(hidden=5, attention=3, window=4))
    rng = np.random.default_rng(3)
    net.p["ba"] += rng.standard_normal(3).astype(np.float32)
    xp = rng.standard_normal((4100, 30)).astype(np.float32)
    windows = np.arange(len(xp) - 3)[:, None] + np.arange(4)
    want = net.forward(xp[windows], np.ones(windows.shape, np.float32))
    for most in (50, 1960, 4097, 9000):
        assert np.allclose(net.full_logits(xp, most=most), want, atol=1e-5)
    assert np.array_equal(net.projected(net.steps(xp)), xp)
    one = toxicity.BiGru(toxicity.ToxicityConfig(window=1))
    xp = rng.standard_normal((30, 48)).astype(np.float32)
    assert np.allclose(one.full_logits(xp, most=7), one.forward(xp[:, None], np.ones((30, 1), np.float32)), atol=1e-5)


def test_vectors_of_short_and_very_long_words():
    net = toxicity.BiGru(SMALL)
    words = Words(*text_bytes(pa.array(["a " + "xyzzy" * 60 + " plugh " + "b" * 49 + " " + "c" * 47 + " plugh"])), ALNUM_WORDS)
    word, gram, owner, _ = features = toxicity.word_features(words, SMALL)
    want = net.p["word"][word].astype(float)
    np.add.at(want, owner, net.p["gram"][gram])
    assert np.bincount(owner).max() > toxicity.MOST_ADDED and np.allclose(net.words(features), want, atol=1e-5)


def plain_logit(net, xp, length):
    """One window, a step and a number at a time."""
    c, p = net.config, {k: v.astype(float) for k, v in net.p.items()}
    h2 = 2 * c.hidden
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    out = np.zeros((length, h2))
    for side, steps in ((0, range(length)), (1, range(length - 1, -1, -1))):
        mine = slice(side * c.hidden, (side + 1) * c.hidden)
        gate = lambda k, mine=mine: slice(k * h2 + mine.start, k * h2 + mine.stop)
        h = np.zeros(c.hidden)
        for t in steps:
            z = sigmoid(xp[t, gate(0)] + h @ p["u"][mine, gate(0)])
            r = sigmoid(xp[t, gate(1)] + h @ p["u"][mine, gate(1)])
            new = np.tanh(xp[t, gate(2)] + r * (h @ p["u"][mine, gate(2)]))
            h = z * h + (1 - z) * new
            out[t, mine] = h
    e = [float(np.tanh(o @ p["a"] + p["ba"]) @ p["va"]) for o in out]
    a = np.exp(np.array(e) - max(e))
    return float((a / a.sum()) @ out @ p["o"] + p["bo"][0])


def test_forward_against_plain_steps():
    rng = np.random.default_rng(5)
    net = toxicity.BiGru(SMALL)
    xp = rng.standard_normal((6, 6, 24)).astype(np.float32)
    lengths = [6, 5, 3, 1, 6, 2]
    mask = (np.arange(6) < np.array(lengths)[:, None]).astype(np.float32)
    assert np.allclose(net.forward(xp, mask), [plain_logit(net, x, n) for x, n in zip(xp, lengths)], atol=1e-4)


def test_scores_against_plain_windows():
    """A score is that of the largest window, its words summed from their own and their letter runs' vectors."""
    rng = random.Random(2)
    net = toxicity.BiGru(SMALL)
    net.scale, net.shift = 1.3, 0.2
    texts = [" ".join("".join(rng.choice("abcé") for _ in range(rng.randrange(1, 8))) for _ in range(n)) for n in (1, 4, 6, 9, 20)]
    for text, score in zip(texts, net.scores(pa.array(texts)).tolist()):
        rows = []
        for w in text.split():
            one = Words(*text_bytes(pa.array([w])), ALNUM_WORDS)
            x = net.p["word"][int(one.hashes[0] % np.uint64(SMALL.buckets))].astype(float)
            letters = [0, *(b + 1 for b in w.encode()), 0]
            for n in SMALL.grams:
                for k in range(len(letters) - n + 1):
                    value = n
                    for b in letters[k : k + n]:
                        value = (value * 0x100000001B3 + b) % (1 << 64)
                    x = x + net.p["gram"][int(mix(np.array([value], np.uint64))[0] % np.uint64(SMALL.buckets))]
            rows.append(x @ net.p["x"] + net.p["bx"])
        best = max(plain_logit(net, np.array(rows[s : s + 6]), len(rows[s : s + 6])) for s in range(max(1, len(rows) - 5)))
        assert score == pytest.approx(1 / (1 + np.exp(-(1.3 * best + 0.2))), abs=1e-4)


def test_toxicity_learns_from_long_texts():
    rng = random.Random(12)
    rows = toxic_texts(300, 3)
    texts = [" ".join(rng.choice(["bafi", "dulo", "gamo", "cera"]) for _ in range(1500)) + " " + t if i % 3 == 0 else t for i, t, _ in rows]
    labels = np.array([y for *_, y in rows])
    net = toxicity.train(texts, labels, np.ones(len(rows)), toxicity.ToxicityConfig(buckets=1 << 12, window=12, stride=6, epochs=12, top_windows=40))
    assert np.mean((net.scores(pa.array(texts)) >= 0.5) == (labels == 1)) >= 0.95


def test_toxicity_on_held_out_texts(spark):
    rows = toxic_texts(900, 1)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5000, None)], "doc_id long, toxic int")
    net = toxicity.train(*toxicity.training_sample(docs, labels, FULL, id_col="doc_id", text_col="text", label_col="toxic"), FULL)
    new = toxic_texts(400, 2)
    odd = [(9000, None), (9001, ""), (9002, "!!"), (9003, "x" * 50_000), (9003, "x" * 50_000), (9004, "lone " * 20_000 + "zorguqa")]
    df = spark.createDataFrame([(i, t) for i, t, _ in new] + odd, "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = toxicity.score_toxicity(df, net).collect()
    assert len(got) == 406 and all(0 <= r["score"] <= 1 for r in got)
    score = {r["doc_id"]: r["score"] for r in got}
    hits = [(score[i] >= 0.7) == bool(y) for i, _, y in new]
    assert np.mean(hits) >= 0.93
    assert score[9000] == score[9001] == score[9002] < 0.5 and score[9004] > 0.7  # the end of a long text counts
    assert toxicity.score_toxicity(spark.createDataFrame([], "doc_id long, text string"), net).count() == 0


@pytest.mark.parametrize("n", [1250, 1260])
def test_toxicity_trains_as_often_at_every_size(n, monkeypatch):
    steps = []
    backward = toxicity.BiGru.backward
    monkeypatch.setattr(toxicity.BiGru, "backward", lambda *a: steps.append(1) or backward(*a))
    config = toxicity.ToxicityConfig(buckets=64, dim=2, hidden=2, attention=2, window=3, stride=3, epochs=2, batch=100)
    toxicity.train([f"word{i % 7} {'bad' if i % 9 == 0 else 'good'}" for i in range(n)], np.arange(n) % 9 == 0, np.ones(n), config)
    assert len(steps) == 2 * -(-(n - -(-n // 5)) // 100)


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    net = toxicity.train(*toxicity.training_sample(docs, none, SMALL, id_col="doc_id", text_col="text", label_col="toxic"), SMALL)
    assert 0 <= toxicity.score_toxicity(docs, net).first()["score"] < 0.5


def quality_rows(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        good = rng.random() < 0.8
        w = ["".join(rng.choice("abcdeimnorst") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(5, 80))]
        if not good:
            w = [x + "%%%" for x in w] if rng.random() < 0.5 else [x for x in w for _ in range(6)]
        text = " ".join(w)
        rows.append((i, text, "en", f"src{rng.randrange(3) if good else rng.randrange(2, 6)}", len(text), int(good)))
    return rows


def test_features_of_a_text_are_its_own():
    rng = random.Random(8)
    config = quality.QualityConfig()
    texts = ["".join(rng.choice("abAB 09%.,é\n") for _ in range(rng.randrange(0, 50))) for _ in range(60)] + ["", None, "x" * 700_000, "y z"]
    alone = [quality.content_features(pa.array([t], pa.string()), config)[0][0] for t in texts]
    for order in (range(len(texts)), rng.sample(range(len(texts)), len(texts))):
        together = quality.content_features(pa.array([texts[i] for i in order], pa.string()), config)[0]
        assert all((together[k] == alone[i]).all() for k, i in enumerate(order))
    t = "abcab é"
    pairs = np.zeros(config.bigrams)
    for a, b in zip(t.encode(), t.encode()[1:]):
        pairs[(a * 131 + b) % config.bigrams] += 1
    assert np.allclose(quality.content_features(pa.array([t]), config)[0][0][14:], np.sqrt(pairs / len(t.encode())))


def test_logistic_against_gradient_descent():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((200, 3)) * [1, 5, 0.2] + 2
    y = (x[:, 0] + rng.standard_normal(200) > 2).astype(float)
    fit = quality.Logistic(1.0).fit(x, y)
    z = (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-3)
    w, b = np.zeros(3), 0.0
    for _ in range(20_000):
        p = 1 / (1 + np.exp(-(z @ w + b)))
        w, b = w - 0.005 * (z.T @ (p - y) + w), b - 0.005 * ((p - y).sum() + 1e-3 * b)
    assert np.allclose(fit.w, [*w, b], atol=1e-4)


def test_co_training_against_plain_rounds():
    """Each view hands its surest documents, bad then good, to the other; nobody is handed over twice."""
    rng = np.random.default_rng(7)
    config = quality.QualityConfig(rounds=3, per_round=5, sure=0.7)
    y = rng.integers(0, 2, 80)
    x = tuple(rng.standard_normal((80, 4)) + y[:, None] * k for k in (1.2, 0.9))
    hidden = rng.integers(0, 2, 300)
    pool = tuple(rng.standard_normal((300, 4)) + hidden[:, None] * k for k in (1.2, 0.9))

    def surest(views, taken):
        out = []
        for me in (0, 1):
            p = 1 / (1 + np.exp(-views[me].logit(pool[me])))
            for sure in (1 - p, p):
                order = [i for i in np.argsort(-sure, kind="stable").tolist() if sure[i] >= 0.7 and i not in taken]
                out.append([(i, (pool[0][i], pool[1][i])) for i in order[:20]])
        return out

    got = quality.co_train(x, y, surest, config)
    train = [i for i in range(80) if i % 4]
    sets = [([*x[m][train]], [*y[train]]) for m in (0, 1)]
    taken = set()
    for _ in range(3):
        views = [quality.Logistic(1.0).fit(np.array(a), np.array(b, float)) for a, b in sets]
        found = surest(views, taken)
        for me in (0, 1):
            for label in (0, 1):
                for i, f in [r for r in found[2 * me + label] if r[0] not in taken][:5]:
                    sets[1 - me][0].append(f[1 - me])
                    sets[1 - me][1].append(label)
                    taken.add(i)
    for view, (a, b) in zip(got.views, sets):
        assert np.allclose(view.w, quality.Logistic(1.0).fit(np.array(a), np.array(b, float)).w)
    assert sum(map(sum, got.trace)) == len(taken) > 20


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_quality_on_held_out_texts(spark):
    rows = quality_rows(900, 1)
    docs = spark.createDataFrame([r[:5] for r in rows], DOCS)
    labels = spark.createDataFrame([(r[0], r[5]) for r in rows[:300]] + [(None, 1), (7777, None)], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels)
    assert any(a or b for a, b in model.trace)  # labels went from view to view
    new = quality_rows(400, 2)
    odd = [(9000, None, None, None, None), (9001, "", "en", "src0", 0), (9002, "word " * 100_000, "en", "src0", 500_000), (9003, "漢字 " * 30, None, None, None)]
    got = {r["doc_id"]: r for r in quality.score_quality(spark.createDataFrame([r[:5] for r in new] + odd, DOCS).withColumn("quality_score", F.lit("clash")), model).collect()}
    keep = lambda i: got[i]["quality_score"] >= quality.LEAST_QUALITY
    assert np.mean([keep(r[0]) == bool(r[5]) for r in new]) >= 0.97
    assert np.mean([keep(r[0]) for r in new if r[5]]) >= 0.99
    assert got[9000]["quality_score"] == got[9001]["quality_score"] == 0 and len(got) == 404


def test_quality_of_sources_that_differ_at_the_front(spark):
    c = quality.QualityConfig()
    names = [f"site{i}.example.com" for i in range(200)]
    x = quality.metadata_features(names, [f"{i}-language" for i in range(200)], np.ones(200), c)
    assert len(set(x[:, : c.sources].argmax(axis=1))) > 50 and len(set(x[:, c.sources : c.sources + 16].argmax(axis=1))) > 12
    rng = random.Random(5)
    text = lambda: " ".join("".join(rng.choice("abcdeimnorst") for _ in range(5)) for _ in range(30))
    rows = [(i, text(), "en", ("spam" if i % 4 == 0 else "news") + ".example.com", 179, int(i % 4 > 0)) for i in range(400)]
    docs = spark.createDataFrame([r[:5] for r in rows], DOCS)
    model = quality.fit_quality(docs, spark.createDataFrame([(r[0], r[5]) for r in rows[:300]], "doc_id long, quality int"))
    got = {r["doc_id"]: r for r in quality.score_quality(docs, model).collect()}
    assert all((got[r[0]]["metadata_score"] > 0.5) == bool(r[5]) and (got[r[0]]["quality_score"] > 0.5) == bool(r[5]) for r in rows[300:])


def test_quality_hands_over_the_surest_of_all_unlabelled(spark):
    c = quality.QualityConfig(max_rows=100, rounds=2, per_round=5)
    rows = quality_rows(1200, 4)
    rows += [(5000 + i, "%%% " * (8000 + i), "en", "src5", 32_000, 0) for i in range(3)] + [(None, "%%% " * 40, "en", "src5", 160, 0)]
    docs = spark.createDataFrame([r[:5] for r in rows], DOCS).repartition(7)
    labels = spark.createDataFrame([(r[0], r[5]) for r in rows[:400]], "doc_id long, quality int")
    pools = []
    whole = quality.Unlabelled.__init__

    def keep(self, *a):
        whole(self, *a)
        pools.append({r["__id"]: np.frombuffer(r["x"], np.float32) for r in self.features.collect()})
        surest = self.surest

        def spy(views, taken):
            got = surest(views, taken)
            x = np.array(list(pools[0].values()), float)
            ids, width = np.array(list(pools[0])), 14 + c.bigrams
            for me, part in enumerate((x[:, :width], x[:, width:])):
                logit = np.where(np.isin(ids, list(taken)), 0, views[me].logit(part))
                for label, sure in enumerate((-logit, logit)):
                    want = sorted(sure[sure >= np.log(c.sure / (1 - c.sure))])[::-1][:20]
                    assert np.allclose(sorted((sure[ids == r[0]][0] for r in got[2 * me + label]), reverse=True), want)
            return got

        self.surest = spy

    quality.Unlabelled.__init__ = keep
    try:
        model = quality.fit_quality(docs, labels, config=c)
    finally:
        quality.Unlabelled.__init__ = whole
    assert set(pools[0]) == {r[0] for r in rows[400:] if r[0] is not None}  # all of them, long ones too
    assert all(a <= 10 and b <= 10 for a, b in model.trace) and any(a or b for a, b in model.trace)


def test_quality_without_labels_or_rows(spark):
    docs = spark.createDataFrame([r[:5] for r in quality_rows(5, 1)], DOCS)
    assert quality.fit_quality(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int")) is None
    assert {r["quality_score"] for r in quality.score_quality(docs, None).collect()} == {1.0}
    assert quality.score_quality(docs.limit(0), None).count() == 0


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_sharding_tiers_and_versions(spark, tmp_path):
    store = shards.ShardStore(spark, f"file://{tmp_path}/store", target_bytes=40_000, fanout=3, smallest=500)
    data = []
    for k in range(7):
        part = [(k * 100 + i, None if i % 17 == 0 else "" if i % 13 == 0 else f"text {i} " * (i % 30)) for i in range(100)] + [(1, "again")]
        data += part
        store.append(spark.createDataFrame(part, "doc_id long, text string").coalesce(1))
    v = store.manifest()["version"]
    assert v == 7 and len(store.shards()) == 7 and sum(s.rows for s in store.shards()) == len(data)
    while store.compact() is not None:
        pass
    assert len(store.shards()) < 7 and all(s.bytes <= 1.5 * 40_000 for s in store.shards())
    want = sorted(data, key=str)
    assert _rows(store.read()) == want and _rows(store.read(v)) == want  # the old version can still be read
    before = store.versions()[-2]
    store.vacuum()
    assert len(store.versions()) == 2 and _rows(store.read(before)) == want  # its readers need not hurry
    assert store.vacuum(1) > 0 and len(store.versions()) == 1 and _rows(store.read()) == want
    store.append(spark.createDataFrame([], "doc_id long, text string"))
    assert _rows(store.read()) == want
    with pytest.raises(ValueError):
        store.append(spark.createDataFrame([(1,)], "other int"))


def test_several_merges_at_once(spark, tmp_path):
    store = shards.ShardStore(spark, f"file://{tmp_path}/store", target_bytes=6_000, fanout=2, smallest=500)
    data = [(i, "".join(chr(97 + (i * 7919 + k * k * 31) % 26) for k in range(300))) for i in range(120)]
    for k in range(0, 120, 10):
        store.append(spark.createDataFrame(data[k : k + 10], "doc_id long, text string").coalesce(1))
    groups = store.merge_groups(store.shards())
    assert len(groups) > 1
    store.compact()
    assert len(store.shards()) == 12 - sum(len(g) - 1 for g in groups) and _rows(store.read()) == sorted(data, key=str)
    for s in store.shards():
        assert spark.read.parquet(s.path).count() == s.rows


def test_merges_in_several_jobs_of_small_files(spark, tmp_path):
    """A session that splits files by rows, several jobs a round, and what a lost writer left."""
    store = shards.ShardStore(spark, f"file://{tmp_path}/store", target_bytes=8_000, fanout=2, smallest=500, merges_per_job=2)
    data = [(i, "".join(chr(97 + (i * 7919 + k * k * 31) % 26) for k in range(300))) for i in range(120)]
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 3)
    try:
        for k in range(0, 120, 40):
            store.append(spark.createDataFrame(data[k : k + 40], "doc_id long, text string").coalesce(1))
        assert len(store.shards()) == 42 and len(store.merge_groups(store.shards())) > 4
        store.compact()
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert len(store.shards()) < 42 and _rows(store.read()) == sorted(data, key=str)
    assert all(spark.read.parquet(s.path).count() == s.rows for s in store.shards())
    lost = tmp_path / "store/data/lost"
    lost.mkdir()
    store.vacuum(1)
    assert lost.exists()
    store.vacuum(1, orphans_after=-60)
    assert not lost.exists() and _rows(store.read()) == sorted(data, key=str)


def test_commits_are_atomic(spark, tmp_path):
    store = shards.ShardStore(spark, f"file://{tmp_path}/store")
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string").coalesce(1)
    base = store.manifest()
    store.append(df)
    with pytest.raises(shards.CommitConflict):
        store.commit(base, [], "append", None)
    threads = [threading.Thread(target=store.append, args=(df,)) for _ in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert store.read().count() == 5 and store.versions() == [1, 2, 3, 4, 5]
    assert not [p for p in (tmp_path / "store/manifest").iterdir() if p.suffix != ".json" and not p.name.endswith(".crc")]


def test_sharding_of_nothing(spark, tmp_path):
    store = shards.ShardStore(spark, f"file://{tmp_path}/store")
    assert shards.shard_by_compaction([], store).count() == 0
    assert shards.shard_by_compaction([spark.createDataFrame([], "doc_id long, text string")], store).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rows = quality_rows(300, 3)
    bench = " ".join(f"q{i}" for i in range(20))
    good = [r for r in rows if r[5]]
    extra = [(1000, good[0][1], "en", "src0", 9, 1), (1001, bench, "en", "src0", 99, 1), (1002, "a plain text with token=abcdefgh12 in it and more words so that it is long", "en", "src0", 70, 1)]
    folder = f"file://{tmp_path}"
    spark.createDataFrame([r[:5] for r in rows + extra], DOCS).withColumn("extra", F.lit(1)).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(r[0], r[5]) for r in rows], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == list(corpus_pipeline.COLUMNS)
        out.write.parquet(f"{folder}/out{len(seen)}")
        docs = spark.read.parquet(f"{folder}/out{len(seen)}")
        seen.append({r["doc_id"]: r for r in docs.collect()})
    bad = {r[0] for r in rows if not r[5]}
    assert len(bad & set(seen[0])) <= 0.05 * len(bad) and len(set(seen[0]) - bad) >= 0.98 * (len(good) + 3)
    if {good[0][0], 1000} <= set(seen[0]):
        assert (good[0][0] in seen[1]) and 1000 not in seen[1]
    assert 1001 in seen[1] and 1001 not in seen[2]
    assert seen[3][1002]["text"] == "a plain text with [SECRET] in it and more words so that it is long" and seen[3][1002]["n_chars"] == len(seen[3][1002]["text"])
    assert set(seen[4]) == set(seen[3]) and all(r["n_tokens"] == len(r["ids"]) for r in seen[4].values())
    whole = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, folder).collect()}
    assert whole == {i: r["ids"] for i, r in seen[4].items()}


def test_pipeline_stages_of_hard_rows(spark, tmp_path):
    import corpus_pipeline

    folder = f"file://{tmp_path}"
    copy, other = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    rows = [(1, copy, "en", "a", 3), (5, copy, "en", "a", 3), (5, other, None, None, None), (5, other, None, None, None), (None, copy, "en", "a", 3), (None, None, None, None, None), (7, "", "en", "a", 0), (8, "long " * 200_000 + "token=abcdefgh12", "en", "a", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in ("mark", "of", "ids", "decoded", "secrets", "n_words", "items", "component_id")})
    spark.createDataFrame([(1, None), (2, other)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    key = lambda rows: sorted(((r[0], r[1]) for r in rows), key=str)
    stages = dict(corpus_pipeline.STAGES)
    assert key(stages["n-gram Jaccard join"](spark, docs, folder).collect()) == key(r for r in rows if r[:2] != (5, copy))
    assert key(stages["benchmark decontamination"](spark, docs, folder).collect()) == key(r for r in rows if r[1] != other)
    cut = {r[1]: r[4] for r in stages["secret scans"](spark, docs, folder).collect() if r[0] == 8}
    assert cut == {"long " * 200_000 + "[SECRET]": 1_000_008}
    coded = stages["BPE encoding"](spark, docs, folder).collect()
    assert len(coded) == len(rows) and all(r["n_tokens"] == len(r["ids"]) for r in coded) and [r["n_tokens"] for r in coded if r["doc_id"] == 7] == [0]
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_registry():
    import __spark_entry__

    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
