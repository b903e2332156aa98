"""Quality classifier by co-training (Blum & Mitchell 1998).

Two views of a document, its text content and its page metadata, each have a logistic classifier.
In rounds, each view scores all unlabelled documents on the executors, labels those it is surest about
and hands them to the *other* view's training set. At the end both views are calibrated on labelled rows held back
from training, and the calibrated log-odds are combined to score all documents.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from peakloom.llm.packing import bound_batches, tidy
from peakloom.llm.textblocks import PLAIN_WORDS, Words, blocks, mix, text_bytes
from peakloom.workspace import materialize, remove


@dataclass(frozen=True)
class QualityConfig:
    """Bounds and steps. Of each label at most max_rows texts, of any length, are learnt from. In each of the rounds each view labels the per_round unlabelled documents of each label that it is surest of, if at least `sure`."""

    max_rows: int = 1500
    rounds: int = 4
    per_round: int = 40
    sure: float = 0.97
    bigrams: int = 128
    sources: int = 64
    ridge: float = 1.0


_KINDS = np.zeros(256, np.int64)  # lower, upper, digit, space, punctuation, other letters
_KINDS[:] = 4
_KINDS[97:123], _KINDS[65:91], _KINDS[48:58] = 0, 1, 2
_KINDS[[32, *range(9, 14)]] = 3
_KINDS[128:] = 5


def content_features(column, config: QualityConfig) -> tuple[np.ndarray, np.ndarray]:
    """(features of the text view, number of words) of each text of an Arrow column."""
    raw, offsets = text_bytes(column)
    out, counts = [], []
    for i, j in blocks(offsets):
        words = Words(raw, offsets[i : j + 1], PLAIN_WORDS)
        n, size = j - i, np.diff(words.cuts)
        owner = np.repeat(np.arange(n), size)
        kind = _KINDS[words.raw]
        shares = np.bincount(owner * 6 + kind, minlength=n * 6).reshape(n, 6) / np.maximum(size, 1)[:, None]
        inside = np.flatnonzero(owner[1:] == owner[:-1])  # pairs of bytes of one text
        pairs = (words.raw[inside].astype(np.int64) * 131 + words.raw[inside + 1]) % config.bigrams
        grams = np.bincount(owner[inside] * config.bigrams + pairs, minlength=n * config.bigrams).reshape(n, -1)
        grams = np.sqrt(grams / np.maximum(size, 1)[:, None])
        of = words.text_of_word()
        held = np.diff(words.bounds)
        per = np.maximum(held, 1)
        length = words.ends - words.starts
        last = kind[words.ends - 1] == 4 if len(of) else np.zeros(0, bool)
        two = last & (length > 1) & (kind[np.maximum(words.ends - 2, 0)] == 4) if len(of) else last
        bare = last & (length == 1)
        upper = (kind[words.starts] == 1) & (length > 1) & (kind[np.minimum(words.starts + 1, len(kind) - 1)] == 1) if len(of) else last
        again = np.zeros(len(of), bool)
        again[1:] = (words.hashes[1:] == words.hashes[:-1]) & (of[1:] == of[:-1])
        order = np.lexsort((words.hashes, of))
        fresh = np.ones(len(of), bool)
        fresh[1:] = (words.hashes[order][1:] != words.hashes[order][:-1]) | (of[order][1:] != of[order][:-1])
        rate = lambda x, o=of: np.bincount(o, x, n) / per  # noqa: E731, B023
        dense = np.column_stack([shares, rate(last), rate(two), rate(bare), rate(upper), rate(again), np.bincount(of[order], fresh, n) / np.sqrt(per), rate(length) / 10, np.log1p(held) / 5])
        out.append(np.hstack([dense, grams]))
        counts.append(held)
    width = 14 + config.bigrams
    return (np.concatenate(out), np.concatenate(counts)) if out else (np.zeros((0, width)), np.zeros(0, np.int64))


def _bucket(value, n: int) -> int:
    """One of n buckets, by a hash of all bytes of the value."""
    return int.from_bytes(blake2b(str(value).encode(), digest_size=8).digest(), "little") % n


def metadata_features(source: list, lang: list, n_chars: np.ndarray, config: QualityConfig) -> np.ndarray:
    """Features of the metadata view: source and language, the whole of each hashed into config.sources and 16 buckets, logarithm of the recorded length."""
    out = np.zeros((len(source), config.sources + 18))
    codes = {s: _bucket(s, config.sources) for s in set(source)}
    langs = {s: _bucket(s, 16) for s in set(lang)}
    rows = np.arange(len(source))
    out[rows, [codes[s] for s in source]] = 1
    out[rows, [config.sources + langs[s] for s in lang]] = 1
    n = np.log1p(np.maximum(np.nan_to_num(n_chars), 0))
    out[:, -2], out[:, -1] = n / 10, (n / 10) ** 2
    return out


class Logistic:
    """Ridge logistic regression on standardised features, by Newton steps."""

    def __init__(self, ridge: float):
        self.ridge = ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        self.mean, self.std = x.mean(axis=0), x.std(axis=0) + 1e-3
        z = np.column_stack([(x - self.mean) / self.std, np.ones(len(x))])
        w = np.zeros(z.shape[1])
        penalty = np.full(len(w), self.ridge)
        penalty[-1] = 1e-3
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + np.diag(penalty), z.T @ (p - y) + penalty * w)
            w -= step
            if np.abs(step).max() < 1e-5:
                break
        self.w = w
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.std) @ self.w[:-1] + self.w[-1], -30, 30)


class CoTrained:
    """Both views' classifiers and the calibration that combines them."""

    def __init__(self, config: QualityConfig, views: tuple[Logistic, Logistic], combine: Logistic, trace: list[tuple[int, int]]):
        self.config, self.views, self.combine, self.trace = config, views, combine, trace

    def scores(self, x: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(content, metadata, combined) probabilities of good quality."""
        logits = [v.logit(f) for v, f in zip(self.views, x, strict=True)]
        both = self.combine.logit(np.column_stack(logits))
        return tuple(1 / (1 + np.exp(-v)) for v in (*logits, both))


def co_train(x: tuple[np.ndarray, np.ndarray], y: np.ndarray, surest, config: QualityConfig) -> CoTrained:
    """x: features of the two views of the labelled documents; surest(views, taken): see Unlabelled."""
    held = np.arange(len(y)) % 4 == 0
    if not len(y) or len(set(y[~held].tolist())) < 2 or len(set(y[held].tolist())) < 2:
        held = np.zeros(len(y), bool)
    sets = [[f[~held], y[~held].astype(float)] for f in x]
    taken: set[int] = set()
    trace = []
    views = [Logistic(config.ridge).fit(*s) for s in sets]
    for _ in range(config.rounds):
        given = [0, 0]
        found = surest(views, taken)
        for me in (0, 1):
            for label in (0, 1):
                chosen = [r for r in found[2 * me + label] if r[0] not in taken][: config.per_round]
                if chosen:
                    sets[1 - me][0] = np.vstack([sets[1 - me][0], *(r[1][1 - me] for r in chosen)])
                    sets[1 - me][1] = np.concatenate([sets[1 - me][1], np.full(len(chosen), float(label))])
                taken.update(r[0] for r in chosen)
                given[me] += len(chosen)
        trace.append(tuple(given))
        views = [Logistic(config.ridge).fit(*s) for s in sets]
        if not any(given):
            break
    fit_on = held if held.any() else np.ones(len(y), bool)
    logits = np.column_stack([v.logit(f[fit_on]) for v, f in zip(views, x, strict=True)])
    return CoTrained(config, tuple(views), Logistic(0.3).fit(logits, y[fit_on].astype(float)), trace)


def _featured(rows: DataFrame, config: QualityConfig) -> DataFrame:
    """(__id, x): the features of both views, side by side as 32-bit floats, worked out on the executors. rows: __id, text, source, lang, n_chars."""

    @tidy
    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                ids, text, source, lang, chars = whole.slice(i, 1024).columns
                x = np.hstack([content_features(text, config)[0], metadata_features(source.to_pylist(), lang.to_pylist(), chars.to_numpy(zero_copy_only=False), config)])
                yield pa.RecordBatch.from_arrays([ids, pa.array([v.tobytes() for v in x.astype(np.float32)], pa.binary())], names=["__id", "x"])

    bound_batches(rows.sparkSession)
    texts = rows.where("__id IS NOT NULL AND text <> ''").select("__id", "text", "source", "lang", F.coalesce("n_chars", F.lit(0.0)).alias("n_chars"))
    return texts.mapInArrow(run, "__id long, x binary")


class Unlabelled:
    """The features of all documents with text and id that are not among the labels, of any length, worked out once."""

    def __init__(self, rows: DataFrame, labelled: DataFrame, config: QualityConfig):
        """rows: __id, text, source, lang, n_chars; labelled: __id."""
        self.config, self.spark = config, rows.sparkSession
        # joined by id after the texts are left behind
        self.features = materialize(_featured(rows, config).join(labelled, "__id", "left_anti"), "quality-features")

    def surest(self, views: list[Logistic], taken: set[int]) -> list[list[tuple[int, tuple[np.ndarray, np.ndarray]]]]:
        """(id, features of both views) of the surest documents that are not taken: bad and good by the first view, bad and good by the second.

        Each list is long enough to lose what the lists before it take.
        """
        c, most = self.config, 4 * self.config.per_round
        least, width = np.log(c.sure / (1 - c.sure)), 14 + c.bigrams
        shared = self.spark.sparkContext.broadcast((views, np.fromiter(taken, np.int64, len(taken))))

        @tidy
        def run(batches):
            views, taken = shared.value
            best = [None] * 4
            for b in batches:
                ids = b.column(0).to_numpy(zero_copy_only=False)
                x = np.frombuffer(b"".join(b.column(1).to_pylist()), np.float32).reshape(len(ids), -1)
                left = ~np.isin(ids, taken)
                tie = mix(ids.astype(np.uint64))
                for me, part in enumerate((x[:, :width], x[:, width:])):
                    logit = views[me].logit(part)
                    for label, sure in enumerate((-logit, logit)):
                        at = np.flatnonzero(left & (sure >= least))
                        more = (sure[at], tie[at], ids[at], x[at])
                        old = best[2 * me + label]
                        if old is not None:
                            more = tuple(np.concatenate(p) for p in zip(old, more, strict=True))
                        order = np.lexsort((more[1], -more[0]))[:most]
                        best[2 * me + label] = tuple(p[order] for p in more)
            for kind, found in enumerate(best):
                if found is not None and len(found[0]):
                    sure, tie, ids, x = found
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * len(ids), pa.int32()), pa.array(sure, pa.float64()), pa.array(tie.view(np.int64)), pa.array(ids, pa.int64()), pa.array([v.tobytes() for v in x], pa.binary())], names=["kind", "sure", "tie", "id", "x"])

        found = self.features.mapInArrow(run, "kind int, sure double, tie long, id long, x binary")
        rank = F.row_number().over(W.partitionBy("kind").orderBy(F.desc("sure"), "tie", "x"))
        out: list[list] = [[], [], [], []]
        for r in found.withColumn("rank", rank).where(F.col("rank") <= most).orderBy("kind", "rank").collect():
            x = np.frombuffer(r["x"], np.float32).astype(float)
            out[r["kind"]].append((r["id"], (x[:width], x[width:])))
        return out


def fit_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", chars_col: str = "n_chars", label_col: str = "quality", config: QualityConfig | None = None) -> CoTrained | None:
    """Learn from the labelled ids that are in docs and whose crc32 mod 3 is not 1; None if they lack one of the labels.

    Bounded: at most max_rows ids of each label, the first by a hash. The unlabelled documents are all used.
    """
    c = config or QualityConfig()
    known = labels.select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).cast("int").alias("__y")).where("__id IS NOT NULL AND __y IN (0, 1)").where(F.crc32(F.col("__id").cast("string").cast("binary")) % 3 != 1)
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"), F.col(chars_col).cast("double").alias("n_chars"))
    totals = {r["__y"]: r["n"] for r in known.groupBy("__y").agg(F.count(F.lit(1)).alias("n")).collect()}
    pick = lambda df: df.orderBy(F.xxhash64("__id"), "__id").limit(c.max_rows)
    ids = pick(known.where("__y = 0")).union(pick(known.where("__y = 1")))
    ids = ids.groupBy("__id").agg(F.max("__y").alias("__y"))  # at most 2 * max_rows
    got = _featured(rows.join(F.broadcast(ids), "__id", "left_semi"), c).join(F.broadcast(ids), "__id").collect()
    got.sort(key=lambda r: ((r["__id"] * 2654435761) & 0xFFFFFFFF, r["__id"], bytes(r["x"])))
    y = np.array([r["__y"] for r in got], int)
    if not (y == 0).any() or not (y == 1).any():
        return None
    x = np.frombuffer(b"".join(r["x"] for r in got), np.float32).reshape(len(got), -1).astype(float)
    content, meta = x[:, : 14 + c.bigrams], x[:, 14 + c.bigrams :]
    pool = Unlabelled(rows, labels.select(F.col(id_col).cast("long").alias("__id")), c)
    model = co_train((content, meta), y, pool.surest, c)
    remove(pool.features)
    # the sample holds the labels in other shares than the table: move the log-odds to the table's
    model.combine.w[-1] += np.log(totals[1] / (y == 1).sum()) - np.log(totals[0] / (y == 0).sum())
    return model


_ADDED = ("content_score", "metadata_score", "quality_score")


def score_quality(docs: DataFrame, model: CoTrained | None, *, text_col: str = "text", source_col: str = "source", lang_col: str = "lang", chars_col: str = "n_chars") -> DataFrame:
    """docs with content_score, metadata_score and quality_score, probabilities of good quality.

    Null and empty texts and those without words have quality and content scores of 0. Without a model
    (no labels of both kinds) every other text scores 1. Null metadata is a value of its own. Rows pass
    through, repeated ones too; columns named as the added ones are replaced; an empty table stays empty.
    """
    bound_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in _ADDED]
    df = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text_col}`").cast("string").alias("__text"), F.col(f"`{source_col}`").cast("string").alias("__source"), F.col(f"`{lang_col}`").cast("string").alias("__lang"), F.coalesce(F.col(f"`{chars_col}`").cast("double"), F.lit(0.0)).alias("__chars"))
    schema = docs.select(*(F.col(f"`{c}`") for c in keep), *(F.lit(0.0).alias(c) for c in _ADDED)).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @tidy
    def run(batches):
        model = shared.value
        config = model.config if model else QualityConfig()
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                b = whole.slice(i, 1024)
                *kept, text, source, lang, chars = b.columns
                content, words = content_features(text, config)
                if model:
                    a, m, q = model.scores((content, metadata_features(source.to_pylist(), lang.to_pylist(), chars.to_numpy(zero_copy_only=False), config)))
                else:
                    a, m, q = (np.ones(len(words)) for _ in range(3))
                a, q = np.where(words > 0, a, 0.0), np.where(words > 0, q, 0.0)
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(v, pa.float64()) for v in (a, m, q))], names=[*keep, *_ADDED])

    return df.mapInArrow(run, schema)


#: Documents under this probability of good quality are rejected: doubt keeps a document.
LEAST_QUALITY = 0.3


def op9_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, model).select("doc_id", *_ADDED, (F.col("quality_score") >= LEAST_QUALITY).alias("kept"))


QUERIES = {"op9_quality": op9_quality}
ORACLE_SQL: dict[str, str] = {}
