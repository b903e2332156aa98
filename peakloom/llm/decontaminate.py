"""Benchmark decontamination.

The word n-grams of the test items form a hash set that is broadcast; training texts are scanned
window by window against it; each hit is verified on the words themselves. What is broadcast is
bounded: test items whose index would exceed `max_broadcast_bytes` are dealt into blocks that keep to
it, and the scan runs once a block over the same rows, adding to what earlier blocks found.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.llm.packing import bound_batches, tidy
from peakloom.llm.textblocks import ALNUM_WORDS, Words, blocks, gram_texts, grams, text_bytes
from peakloom.workspace import materialize

_ADDED = ("n_words", "n_hit", "items", "contaminated", "hit_spans", "cleaned")
_SPAN = "array<struct<start:long,end:long>>"


class ItemIndex:
    """Windows of test items in flat arrays, of at most _INDEX_BYTES bytes a byte of text and id.

    `raw` holds the folded words of the items, each followed by a space. For each window length: the
    sorted hashes of the windows and, in that order, where they start and end in raw and whose they are.
    """

    def __init__(self, items: list[tuple[str, str | None]], n: int):
        self.items = pa.array([item for item, _ in items], pa.string())
        parts: list[np.ndarray] = []
        found: dict[int, list[tuple[np.ndarray, ...]]] = {}
        size = 0
        for k, (_, text) in enumerate(items):
            raw, offsets = text_bytes(pa.array([text], pa.string()))
            words = Words(raw, offsets, ALNUM_WORDS)
            if not len(words.hashes):
                continue
            length = min(n, len(words.hashes))
            sizes = words.ends - words.starts
            ends = np.cumsum(sizes + 1) - 1
            starts = ends - sizes
            source = np.repeat(words.starts - starts, sizes + 1) + np.arange(ends[-1] + 1)
            line = ALNUM_WORDS[1][words.raw[np.minimum(source, len(words.raw) - 1)]]
            line[ends] = 32
            every = grams(words.hashes, length)
            hashes, first, which = np.unique(every, return_index=True, return_inverse=True)
            spelled = lambda i: line[starts[i] : ends[i + length - 1]].tobytes()
            # of the windows with one hash the first, and those that are spelled otherwise
            others = [i for i in np.setdiff1d(np.arange(len(every)), first).tolist() if spelled(i) != spelled(int(first[which[i]]))]
            kept = np.concatenate([first, np.array(others, np.int64)])
            found.setdefault(length, []).append((every[kept], size + starts[kept], size + ends[kept + length - 1], np.full(len(kept), k)))
            parts.append(line)
            size += len(line)
        self.raw = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
        self.windows: dict[int, tuple[np.ndarray, ...]] = {}
        for length, those in found.items():
            hashes, starts, ends, owners = (np.concatenate(x) for x in zip(*those, strict=True))
            order = np.argsort(hashes, kind="stable")
            self.windows[length] = hashes[order], starts[order].astype(np.int32), ends[order].astype(np.int32), owners[order].astype(np.int32)

    @property
    def nbytes(self) -> int:
        return self.items.nbytes + self.raw.nbytes + sum(a.nbytes for w in self.windows.values() for a in w)

    def having(self, length: int, h: np.uint64, spelled: bytes) -> list[str]:
        """The items with the window `spelled`, whose hash is h."""
        hashes, starts, ends, owners = self.windows[length]
        i, j = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
        return [self.items[o].as_py() for s, e, o in zip(starts[i:j].tolist(), ends[i:j].tolist(), owners[i:j].tolist(), strict=True) if self.raw[s:e].tobytes() == spelled]


#: A word takes two bytes of text or more with its separator, its window 20 bytes of index.
_INDEX_BYTES = 12


def _spelled(words: Words):
    folded = ALNUM_WORDS[1][words.raw].tobytes()
    starts, ends = words.starts, words.ends

    def spell(i: int, length: int) -> bytes:
        return b" ".join([folded[s:e] for s, e in zip(starts[i : i + length].tolist(), ends[i : i + length].tolist(), strict=True)])

    return spell


def scan_texts(column, index: ItemIndex):
    """Yield (number of words, hit word ranges, items, Words, text number) for each text."""
    raw, offsets = text_bytes(column)
    for i, j in blocks(offsets):
        words = Words(raw, offsets[i : j + 1], ALNUM_WORDS)
        ranges: list[list[tuple[int, int]]] = [[] for _ in range(j - i)]
        items: list[set[str]] = [set() for _ in range(j - i)]
        spell = None
        for length, (have, *_) in index.windows.items():
            at, owner = gram_texts(words.bounds, length)
            keys = grams(words.hashes, length)[at]
            k = np.minimum(np.searchsorted(have, keys), len(have) - 1)
            for h in np.flatnonzero(have[k] == keys).tolist():
                spell = spell or _spelled(words)
                start, t = int(at[h]), int(owner[h])
                those = index.having(length, keys[h], spell(start, length))
                if those:
                    first = start - int(words.bounds[t])
                    ranges[t].append((first, first + length))
                    items[t].update(those)
        for t in range(j - i):
            yield int(words.bounds[t + 1] - words.bounds[t]), ranges[t], items[t], words, t


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = 13, least_share: float = 0.05, max_broadcast_bytes: int = 192 << 20) -> DataFrame:
    """docs with what each text shares with the test items.

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. A window is n consecutive
    words of an item, or a shorter item's whole sequence; a word is hit if it lies in an occurrence of
    a window. Adds n_words, n_hit, items (ids as strings, sorted), contaminated (some word is hit, and
    at least least_share of all), hit_spans (code points of the maximal hit runs, end exclusive) and
    cleaned (the text without those spans; null where the text is null): take `cleaned` to remove
    spans, or filter by `contaminated` to remove documents.

    max_broadcast_bytes bounds the built index of a block of items. Items are dealt
    into so many blocks that each keeps to it; one that exceeds it alone has a block of its own. With
    more than one block the rows are written between scans, so one index at a time is held.

    Null and empty texts have no words and aren't contaminated. Items whose id is null or that have no
    words are left out; items with one id count once. Empty docs give an empty result, an empty
    benchmark no hits. Other columns pass through; those with a name of the added ones are replaced.
    """
    bound_batches(docs.sparkSession)
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text")).where(F.col("item").isNotNull() & F.col("text").isNotNull())
    items = items.distinct()
    n_blocks = _block_count(items, max_broadcast_bytes // _INDEX_BYTES)
    items = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)))
    keep = [c for c in docs.columns if c not in (*_ADDED, "__ranges", "__items", "__text")]
    df = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text_col}`").cast("string").alias("__text"), F.array().cast(_SPAN).alias("__ranges"), F.array().cast("array<string>").alias("__items"))
    context = docs.sparkSession.sparkContext
    for block in range(n_blocks):
        rows = items.where(F.col("block") == block).select("item", "text").collect()
        index = context.broadcast(ItemIndex([(r["item"], r["text"]) for r in rows], n))
        last = block == n_blocks - 1
        names = [*keep, *(_ADDED if last else ("__text", "__ranges", "__items"))]
        schema = df.select(*(F.col(f"`{c}`") for c in keep), *((F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"), F.lit(True).alias("contaminated"), F.array().cast(_SPAN).alias("hit_spans"), F.lit(None).cast("string").alias("cleaned")) if last else ("__text", "__ranges", "__items"))).schema
        df = df.mapInArrow(_scanner(index, names, last, least_share), schema)
        if not last:
            df = materialize(df, "decontaminate")
            index.destroy()
    return df


def _block_count(items: DataFrame, limit: int) -> int:
    """The number of blocks by which none holds over limit bytes of texts and ids, unless it is one item."""
    size = F.octet_length("text") + F.octet_length("item") + F.lit(1)
    total = items.agg(F.sum(size)).first()[0] or 0
    n = max(1, math.ceil(total / limit))
    while n > 1:
        block = F.pmod(F.xxhash64("item", "text"), F.lit(n)).alias("block")
        if not items.groupBy(block).agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("n")).where((F.col("bytes") > limit) & (F.col("n") > 1)).take(1):
            break
        n *= 2
    return n


def _scanner(index, names: list[str], last: bool, least_share: float):
    spans_type, list_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string())

    @tidy
    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                batch = whole.slice(i, 512)
                *kept, text, ranges, items = batch.columns
                old_ranges, old_items = ranges.to_pylist(), items.to_pylist()
                counts, out_ranges, out_items, hits, bad, spans, cleaned = [], [], [], [], [], [], []
                for k, (count, found, those, words, t) in enumerate(scan_texts(text, index.value)):
                    all_ranges = merged([*((r["start"], r["end"]) for r in old_ranges[k]), *found]) if found or old_ranges[k] else []
                    out_items.append(sorted(those.union(old_items[k])))
                    if not last:
                        out_ranges.append([{"start": s, "end": e} for s, e in all_ranges])
                        continue
                    n_hit = sum(e - s for s, e in all_ranges)
                    counts.append(count)
                    hits.append(n_hit)
                    bad.append(n_hit > 0 and n_hit >= least_share * count - 1e-9)
                    where, rest = code_points(words, t, all_ranges) if all_ranges else ([], None)
                    spans.append(where)
                    cleaned.append(rest)
                if not last:
                    arrays = [*kept, text, pa.array(out_ranges, spans_type), pa.array(out_items, list_type)]
                else:
                    arrays = [*kept, pa.array(counts, pa.int64()), pa.array(hits, pa.int64()), pa.array(out_items, list_type), pa.array(bad, pa.bool_()), pa.array(spans, spans_type), _either(pa.array(cleaned, pa.string()), text)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def _either(new: pa.Array, text: pa.Array) -> pa.Array:
    import pyarrow.compute as pc

    return pc.coalesce(new, text.cast(pa.string()))


def code_points(words: Words, t: int, ranges: list[tuple[int, int]]) -> tuple[list[dict], str]:
    """Word ranges of a text as code points, and the text without them."""
    first = int(words.bounds[t])
    start, end = _text_bounds(words, t)
    spans, rest, at, points = [], [], start, 0
    for s, e in ranges:
        a, b = int(words.starts[first + s]), int(words.ends[first + e - 1])
        before, inside = words.raw[at:a].tobytes().decode(), words.raw[a:b].tobytes().decode()
        points += len(before)
        spans.append({"start": points, "end": points + len(inside)})
        points += len(inside)
        rest.append(before)
        at = b
    rest.append(words.raw[at:end].tobytes().decode())
    return spans, "".join(rest)


def _text_bounds(words: Words, t: int) -> tuple[int, int]:
    return int(words.cuts[t]), int(words.cuts[t + 1])


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


QUERIES = {"op5_decontaminate": op5_decontaminate}

ORACLE_SQL = {
    "op5_decontaminate": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
k AS (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM k)),
l AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, l WHERE len(w) >= n)),
h AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
""",
}
