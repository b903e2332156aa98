"""Substring dedup by seed and extend.

Seeds are winnowed anchors: of the word 5-grams in every window of `min_words` words, the one with
the least hash. Two documents that share a window therefore share its anchor. Anchors are joined
across documents; around each shared one, every window that chose it is extended to its full length
on both sides and joined on its content, with the least doc_id that holds it; overlapping and
adjacent duplicate windows of a document merge into maximal repeated spans.

Anchors and windows travel as packed distinct keys of document batches (see packing), so hot
passages are pre-aggregated and no pair of documents is ever formed. Keys are 64-bit; windows are
dealt to buckets by an independent second hash, which adds the bits of the bucket count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.llm.packing import batch_of, blob, in_batches, runs, split_by_bucket, text_batches, tidy
from peakloom.llm.textblocks import PLAIN_WORDS, Words, blocks, gram_texts, grams, mix, sliding_min, text_bytes

_U = np.uint64
_SEEDS = pa.schema([("batch", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("repeated", pa.binary())])
_WINDOWS = pa.schema([("batch", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("first", pa.binary()), ("repeated", pa.binary())])
_RESULT = "id long, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept string"


def _words_of(table: pa.Table):
    """Yield (ids, Words) for blocks of a batch's rows. A null id is -1 with `known` False."""
    raw, offsets = text_bytes(table["text"])
    ids = table["id"].combine_chunks()
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    ids = ids.fill_null(-1).to_numpy(zero_copy_only=False)
    for i, j in blocks(offsets):
        yield ids[i:j], known[i:j], Words(raw, offsets[i : j + 1], PLAIN_WORDS)


def _anchors(words: Words, min_words: int, seed_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window positions, text of each window, anchor of each window)."""
    at, owner = gram_texts(words.bounds, min_words)
    least = sliding_min(grams(words.hashes, seed_words), min_words - seed_words + 1)
    return at, owner, least[at]


def _distinct(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, least id of each, whether it has more than one id)."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    first, _ = runs(keys)
    last = np.concatenate([first[1:], [len(keys)]]) - 1 if len(keys) else first
    return keys[first], ids[first], ids[first] != ids[last]


def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 13, seed_words: int = 5, partitions: int | None = None) -> DataFrame:
    """Find, and cut out, the words covered by a repeat of at least min_words words.

    A word of a document goes when it lies in a run of min_words consecutive words
    (`[^\\x20\\x09-\\x0D]+`, as written) that also starts in a document with a smaller id. Runs are
    judged on the input. Returns (id, n_words, n_removed, removed: maximal word spans, end exclusive,
    kept: the other words joined by one space), one row per input row.

    Null and empty texts, and texts under min_words words, lose nothing. Rows with one id don't count
    against each other; rows with a null id lose nothing and are nobody's earlier copy. An empty
    table gives an empty result. Other columns are ignored, whatever their names.
    """
    if not 1 <= seed_words <= min_words:
        raise ValueError("seed_words must lie between 1 and min_words")
    n = partitions or text_batches(docs, text_col)
    batched = in_batches(docs, id_col, text_col, n)

    @tidy
    def seeds(table: pa.Table) -> pa.Table:
        keys, ids = [], []
        for doc, known, words in _words_of(table):
            _, owner, anchor = _anchors(words, min_words, seed_words)
            new = np.ones(len(anchor), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
            new &= known[owner]
            keys.append(anchor[new])
            ids.append(doc[owner[new]])
        keys, _, several = _distinct(np.concatenate(keys), np.concatenate(ids))
        rows = [(b, k.tobytes(), np.packbits(s).tobytes()) for b, k, s in split_by_bucket((mix(keys) >> _U(33)) % _U(n), keys, several)]
        return _table(_SEEDS, table["batch"][0].as_py(), rows)

    @tidy
    def shared(table: pa.Table) -> pa.Table:
        parts = [blob(table["keys"], i, np.uint64) for i in range(len(table))]
        flags = [np.unpackbits(blob(table["repeated"], i, np.uint8), count=len(k)).astype(bool) for i, k in enumerate(parts)]
        keys, flag = np.concatenate(parts), np.concatenate(flags)
        order = np.argsort(keys, kind="stable")
        first, number = runs(keys[order])
        hit = (np.diff(np.concatenate([first, [len(keys)]])) > 1) | np.logical_or.reduceat(flag[order], first)
        wanted = np.empty(len(keys), bool)
        wanted[order] = hit[number]
        return _answers(table, parts, wanted, [keys])

    @tidy
    def extend(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table) or not len(answers):
            return _WINDOWS.empty_table()
        wanted = np.sort(np.concatenate([blob(answers["keys"], i, np.uint64) for i in range(len(answers))]))
        keys, others, ids = [], [], []
        for doc, known, words in _words_of(table):
            at, owner, anchor = _anchors(words, min_words, seed_words)
            take = _member(anchor, wanted) & known[owner]
            at, owner = at[take], owner[take]
            keys.append(grams(words.hashes, min_words)[at])
            others.append(grams(words.hashes, min_words, second=True)[at])
            ids.append(doc[owner])
        keys, others, ids = map(np.concatenate, (keys, others, ids))
        order = np.lexsort((ids, keys, others))
        keys, others, ids = keys[order], others[order], ids[order]
        if not len(keys):
            return _WINDOWS.empty_table()
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (others[1:] != others[:-1])])
        first = np.flatnonzero(new)
        several = ids[first] != ids[np.concatenate([first[1:], [len(ids)]]) - 1]
        rows = [(b, k.tobytes(), i.tobytes(), np.packbits(s).tobytes()) for b, k, i, s in split_by_bucket((others[first] >> _U(33)) % _U(n), keys[first], ids[first], several)]
        return _table(_WINDOWS, table["batch"][0].as_py(), rows)

    @tidy
    def earliest(table: pa.Table) -> pa.Table:
        parts = [blob(table["keys"], i, np.uint64) for i in range(len(table))]
        ids = np.concatenate([blob(table["first"], i, np.int64) for i in range(len(table))])
        flag = np.concatenate([np.unpackbits(blob(table["repeated"], i, np.uint8), count=len(k)).astype(bool) for i, k in enumerate(parts)])
        keys = np.concatenate(parts)
        order = np.argsort(keys, kind="stable")
        first, number = runs(keys[order])
        hit = (np.diff(np.concatenate([first, [len(keys)]])) > 1) | np.logical_or.reduceat(flag[order], first)
        least = np.minimum.reduceat(ids[order], first)
        wanted, earliest_id = np.empty(len(keys), bool), np.empty(len(keys), np.int64)
        wanted[order], earliest_id[order] = hit[number], least[number]
        wanted &= (earliest_id < ids) | flag  # others of the batch learn nothing from the answer
        return _answers(table, parts, wanted, [keys, earliest_id])

    @tidy
    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        out: dict[str, list] = {"n_words": [], "n_removed": [], "removed": [], "kept": []}
        buckets: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for i in range(len(answers)):
            keys, ids = blob(answers["keys"], i, np.uint64), blob(answers["first"], i, np.int64)
            order = np.argsort(keys)
            buckets[answers["bucket"][i].as_py()] = keys[order], ids[order]
        for doc, known, words in _words_of(table):
            covered = np.zeros(len(words.hashes) + 1, np.int64)
            if buckets:
                at, owner = gram_texts(words.bounds, min_words)
                keys = grams(words.hashes, min_words)[at]
                bucket = (grams(words.hashes, min_words, second=True)[at] >> _U(33)) % _U(n)
                for b, key, pos, own in split_by_bucket(bucket, keys, at, owner):
                    if b in buckets:
                        have, ids = buckets[b]
                        k = np.minimum(np.searchsorted(have, key), len(have) - 1)
                        go = (have[k] == key) & (ids[k] < doc[own]) & known[own]
                        np.add.at(covered, pos[go], 1)
                        np.add.at(covered, pos[go] + min_words, -1)
            gone = np.cumsum(covered[:-1]) > 0
            sums = np.concatenate([[0], np.cumsum(gone)])
            text = words.raw.tobytes()
            for t in range(len(doc)):
                a, b = words.bounds[t], words.bounds[t + 1]
                n_gone = int(sums[b] - sums[a])
                pieces = text[words.starts[a] : words.ends[b - 1]].split() if b > a else []
                spans = []
                if n_gone:
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone[a:b], [False]]).astype(np.int8)))
                    spans = [{"start": int(s), "end": int(e)} for s, e in edge.reshape(-1, 2)]
                    pieces = [w for w, g in zip(pieces, gone[a:b].tolist(), strict=True) if not g]
                out["n_words"].append(int(b - a))
                out["n_removed"].append(n_gone)
                out["removed"].append(spans)
                out["kept"].append(b" ".join(pieces).decode("utf-8", "replace"))
        return pa.table({"id": table["id"].combine_chunks(), "n_words": pa.array(out["n_words"], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()), "removed": pa.array(out["removed"], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "kept": pa.array(out["kept"], pa.string())})

    asked = batched.groupBy("batch").applyInArrow(seeds, "batch int, bucket int, keys binary, repeated binary")
    common = asked.groupBy("bucket").applyInArrow(shared, "batch int, keys binary")
    windows = batched.groupBy("batch").cogroup(common.groupBy("batch")).applyInArrow(extend, "batch int, bucket int, keys binary, first binary, repeated binary")
    answers = windows.groupBy("bucket").applyInArrow(earliest, "batch int, bucket int, keys binary, first binary")
    return batched.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(cut, _RESULT).withColumnRenamed("id", id_col)


def _member(values: np.ndarray, have: np.ndarray) -> np.ndarray:
    if not len(have):
        return np.zeros(len(values), bool)
    k = np.minimum(np.searchsorted(have, values), len(have) - 1)
    return have[k] == values


def _table(schema: pa.Schema, batch: int, rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [()] * (len(schema) - 1)
    arrays = [pa.array([batch] * len(rows), pa.int32()), *(pa.array(c, f.type) for c, f in zip(cols, list(schema)[1:], strict=True))]
    return pa.Table.from_arrays(arrays, schema=schema)


def _answers(table: pa.Table, parts: list[np.ndarray], wanted: np.ndarray, arrays: list[np.ndarray]) -> pa.Table:
    """To each batch the wanted of its own keys, with what else arrays hold of them."""
    rows, at = [], 0
    for i, part in enumerate(parts):
        take = wanted[at : at + len(part)]
        if take.any():
            rows.append((table["batch"][i].as_py(), table["bucket"][i].as_py(), *(a[at : at + len(part)][take].tobytes() for a in arrays)))
        at += len(part)
    cols = list(zip(*rows, strict=True)) if rows else [()] * (2 + len(arrays))
    out = {"batch": pa.array(cols[0], pa.int32()), "bucket": pa.array(cols[1], pa.int32()), "keys": pa.array(cols[2], pa.binary())}
    if len(arrays) > 1:
        out["first"] = pa.array(cols[3], pa.binary())
    else:
        del out["bucket"]
    return pa.table(out)


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = dedup_substrings(docs)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


QUERIES = {"op1_substring_dedup": op1_substring_dedup}

ORACLE_SQL = {
    "op1_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
x AS (SELECT doc_id, i, hash(w[i:i + 12]) AS h, array_to_string(w[i:i + 12], ' ') AS s FROM p),
f AS (SELECT h, s, min(doc_id) AS m FROM x GROUP BY h, s),
c AS (SELECT DISTINCT x.doc_id, unnest(range(x.i, x.i + 13)) AS k FROM x JOIN f USING (h, s) WHERE f.m < x.doc_id),
g AS (SELECT doc_id, list(k) AS gone FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda k: NOT list_contains(gone, k)), lambda k: w[k]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
""",
}
