"""Interaction audit of corpus filters.

Each document gets a mask of the filters that it fails; whatever is asked about an order of filters
follows from how often each mask occurs. The masks of the single-text filters are worked out where
the texts are read. Exact duplicates take one trip: texts are routed by fingerprint, each partition
keeps a chain per fingerprint with every different text and its least id, and rows that are not of
the least id are sent on as duplicates. Before that trip each batch of texts keeps only its own least ids, so a
text that fills the table is sent once a batch. combineByKey then merges vectors of mask counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.llm.packing import text_batches

_UPPER = bytes(range(65, 91))
_SYMBOLS = b"#$%&*|"


def fails_length(text: str, raw: bytes, words: list[bytes]) -> bool:
    return len(words) < 200


def fails_repetition(text: str, raw: bytes, words: list[bytes]) -> bool:
    return 100 * len(set(words)) < 50 * len(words)


def fails_capitals(text: str, raw: bytes, words: list[bytes]) -> bool:
    return 100 * (len(raw) - len(raw.translate(None, _UPPER))) > 3 * len(text)


def fails_symbols(text: str, raw: bytes, words: list[bytes]) -> bool:
    return len(raw.translate(None, _SYMBOLS)) < len(raw)


#: letter -> test on (text, its UTF-8 bytes, its words); the letter DUPLICATE is decided over the table
FILTERS: dict[str, Callable[[str, bytes, list[bytes]], bool]] = {"A": fails_length, "B": fails_repetition, "C": fails_capitals, "D": fails_symbols}
DUPLICATE = "E"

#: Bytes of packed texts that a map task holds before it routes them, and bytes of text, unpacked, a routed partition stands for.
HELD_BYTES, ROUTED_BYTES = 16 << 20, 64 << 20


def _least_first(table: dict, key, row: tuple, packed) -> Iterator[tuple]:
    """Keep the rows of the least id of a key in table; yield those that are thereby known to be none: (id, part, mask, number of rows)."""
    doc, part, mask, n = row
    held = table.get(key)
    if held is None or doc < held[0]:
        if held is not None:
            for (p, m), k in held[1].items():
                yield held[0], p, m, k
        table[key] = doc, {(part, mask): n}, packed if held is None else held[2]
    elif doc == held[0]:
        held[1][part, mask] = held[1].get((part, mask), 0) + n
    else:
        yield doc, part, mask, n


def _scan(filters: dict, bit: int):
    """Rows (fingerprint, id, part, text) to (fingerprint, (packed text, row)) where a text's least id is to be found, (any key, (None, row)) where a document is decided."""
    tests = list(filters.values())

    def scan(rows: Iterable) -> Iterator[tuple]:
        held: dict[tuple[int, bytes], tuple] = {}
        size = 0
        for fingerprint, doc, part, text in rows:
            raw = text.encode()
            words = raw.split()  # of bytes: at space and \t\n\v\f\r alone
            mask = sum(1 << k for k, fails in enumerate(tests) if fails(text, raw, words))
            if doc is None:  # no id is smaller or larger than none
                yield fingerprint, (None, (None, part, mask, 1))
                continue
            packed = zlib.compress(raw, 1)
            new = (fingerprint, packed) not in held
            for d, p, m, k in _least_first(held, (fingerprint, packed), (doc, part, mask, 1), None):
                yield d, (None, (d, p, m | bit, k))
            size += (len(packed) + 200) if new else 0
            if size > HELD_BYTES:
                yield from _asked(held)
                held.clear()
                size = 0
        yield from _asked(held)

    return scan


def _asked(held: dict) -> Iterator[tuple]:
    for (fingerprint, packed), (doc, rows, _) in held.items():
        for (part, mask), n in rows.items():
            yield fingerprint, (packed, (doc, part, mask, n))


def _chains(bit: int):
    """Routed rows to decided ones, decided ones as they are; a fingerprint's chain holds each different text once, with its least id."""

    def decide(rows: Iterable) -> Iterator[tuple]:
        chains: dict[int, dict[int, tuple]] = {}
        for fingerprint, (packed, row) in rows:
            if packed is None:
                yield row
                continue
            chain = chains.setdefault(fingerprint, {})
            place = next((k for k, (_, _, text) in chain.items() if text == packed or zlib.decompress(text) == zlib.decompress(packed)), len(chain))
            for doc, part, mask, n in _least_first(chain, place, row, packed):
                yield doc, part, mask | bit, n
        for chain in chains.values():
            for doc, held, _ in chain.values():
                for (part, mask), n in held.items():
                    yield doc, part, mask, n

    return decide


def failure_masks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", filters: dict | None = None) -> DataFrame:
    """(id, part, mask, n): the filters that documents fail, bit k for the k-th of filters, the bit after them for duplicates; n rows are alike.

    A row is a duplicate if its text is that of a row with a smaller id, anywhere in the table; texts
    are compared in full. Null texts are empty, a null part is the empty string. A row without an id
    is no duplicate and makes none. Rows with one id don't make each other duplicates. Rows may come out summed: n
    tells how many. No rows give none; other columns of docs play no part.
    """
    filters = FILTERS if filters is None else filters
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.xxhash64(text).alias("f"), F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), text.alias("t"))
    bit = 1 << len(filters)
    scanned = rows.rdd.mapPartitions(_scan(filters, bit))
    n = text_batches(docs, text_col, ROUTED_BYTES)
    # both kinds of rows take one shuffle, so that texts are read once
    decided = scanned.partitionBy(n, lambda key: key).mapPartitions(_chains(bit))
    return spark.createDataFrame(decided, "id long, part string, mask int, n long", verifySchema=False)


def order_report(counts: list[int], good: list[int], toxic: list[int], letters: str) -> Iterator[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of all orders, from the number of documents of each mask, and of those the good and the toxic ones."""
    n, masks = len(letters), range(len(counts))
    orders = list(permutations(range(n)))
    # in all orders together a document is removed by each filter that it fails equally often
    shapley = [sum(counts[m] * (len(orders) // m.bit_count()) for m in masks if m >> k & 1) for k in range(n)]
    unique = [counts[1 << k] for k in range(n)]
    for order in orders:
        before, left = 0, sum(counts)
        for step, k in enumerate(order, 1):
            here = [m for m in masks if m >> k & 1 and not m & before]
            removed = sum(counts[m] for m in here)
            left -= removed
            redundant = sum(counts[m] for m in masks if m >> k & 1 and m & before)
            yield "".join(letters[i] for i in order), step, left, removed, redundant, unique[k], sum(good[m] for m in here), sum(toxic[m] for m in here), shapley[k]
            before |= 1 << k


REPORT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit_filters(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", filters: dict | None = None) -> DataFrame:
    """REPORT: for each part, order of the filters and step, what the step's filter does there.

    kept: documents left after the step; removed: those it takes; redundant: those that fail it but
    were taken before; unique_fails: those that fail no other filter; good_lost and toxic_lost: of the
    removed those with a label quality = 1 and toxic = 1; shapley: what its filter removes, summed over
    all orders. failure_masks says what a null, empty or repeated row is. Null labels and labels without a document count
    for nothing, several of one id as one that is good or toxic if any is. No documents give no parts.
    """
    filters = FILTERS if filters is None else filters
    letters = "".join(filters) + DUPLICATE
    size = 1 << len(letters)
    spark = docs.sparkSession
    marks = labels.where(F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").cast("long").alias("id")).agg(F.max(F.expr("coalesce(quality = 1, false)")).alias("good"), F.max(F.expr("coalesce(toxic = 1, false)")).alias("toxic"))
    masks = failure_masks(docs, id_col=id_col, text_col=text_col, part_col=part_col, filters=filters)
    marked = masks.join(marks, "id", "left").select("part", "mask", "n", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))

    def add(vector: list[int], row: tuple) -> list[int]:
        mask, n, good, toxic = row
        vector[mask] += n
        if good:
            vector[size + mask] += n
        if toxic:
            vector[2 * size + mask] += n
        return vector

    def merge(a: list[int], b: list[int]) -> list[int]:
        return [x + y for x, y in zip(a, b, strict=True)]

    vectors = marked.rdd.map(lambda r: (r[0], tuple(r)[1:])).combineByKey(lambda row: add([0] * (3 * size), row), add, merge, int(spark.conf.get("spark.sql.shuffle.partitions")))
    lines = vectors.flatMap(lambda x: [(x[0], *line) for line in order_report(x[1][:size], x[1][size : 2 * size], x[1][2 * size :], letters)])
    return spark.createDataFrame(lines, REPORT, verifySchema=False)


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    return audit_filters(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op12_filter_audit": op12_filter_audit}

ORACLE_SQL = {
    "op12_filter_audit": r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS least FROM t),
f AS (SELECT doc_id, part, concat(CASE WHEN len(w) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' END,
  CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' END, CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END, CASE WHEN doc_id > least THEN 'E' END) AS fails FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
p AS (SELECT a.c || b.c || d.c || e.c || g.c AS o FROM c a, c b, c d, c e, c g WHERE len(list_distinct([a.c, b.c, d.c, e.c, g.c])) = 5),
s AS (SELECT o, k, substr(o, k, 1) AS c, substr(o, 1, k - 1) AS before FROM p, (SELECT unnest(range(1, 6)) AS k)),
x AS (SELECT part, o, k, c, n, good, toxic, fails, contains(fails, c) AS failing, before <> '' AND translate(fails, before, '') <> fails AS gone FROM m, s),
y AS (SELECT part, o, k, c, sum(CASE WHEN NOT failing AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN failing AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN failing AND gone THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN fails = c THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN failing AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN failing AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost FROM x GROUP BY ALL)
SELECT part, o AS filter_order, CAST(k AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, c) AS BIGINT) AS shapley FROM y
""",
}
