"""Near-dedup of embeddings by Euclidean p-stable hashing (Datar et al. 2004) and exact cosine checks.

Normalised vectors are projected on random normal directions; each table joins a few projections,
shifted and quantised to a width, into a bucket. Vectors at cosine c are sqrt(2 - 2c) apart, so near
ones fall into one bucket of some table with known probability. In each bucket every pair of vectors
with equal labels is checked exactly.

Equal vectors are one node with a multiplicity. A large bucket is dealt into blocks, and pairs of
blocks are checked by separate tasks, so no task holds more than two blocks. A pair that meets in
several tables counts in the first. Pairs stay inside a task: out come a count per node and a
spanning forest of the links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.operators.graph import connected_components
from peakloom.workspace import materialize, partition_count


def projections(dim: int, tables: int, per_table: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dim])
    return rng.standard_normal((dim, tables * per_table)), rng.random(tables * per_table)


def bucket_codes(unit: np.ndarray, tables: int, per_table: int, width: float, seed: int) -> np.ndarray:
    """(rows, tables) int64: the bucket of each normalised vector in each table."""
    lines, shifts = projections(unit.shape[1], tables, per_table, seed)
    cells = np.floor(unit @ lines / width + shifts).astype(np.int64).reshape(len(unit), tables, per_table)
    code = np.zeros((len(unit), tables), np.uint64)
    for k in range(per_table):
        code = (code + cells[:, :, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(29)
    return code.view(np.int64)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _rows(column) -> list[np.ndarray]:
    lists = column if isinstance(column, pa.Array) else column.combine_chunks()
    offsets = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False)
    return [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _coder(tables: int, per_table: int, width: float, seed: int):
    def code(batches):
        for b in batches:
            vectors = _rows(b.column(1))
            out = np.zeros((len(vectors), tables), np.int64)
            dims = np.array([len(v) for v in vectors])
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                out[at] = bucket_codes(unit_rows(np.stack([vectors[i] for i in at])), tables, per_table, width, seed)
            codes = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * tables, pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), codes], names=["node", "codes"])

    return code


#: Groups of at most so many rows are checked together, pair by pair; larger ones by a matrix product.
_SMALL = 48
#: A matrix product may be off by less than this; pairs nearer to the bound are decided by the formula of small groups.
_ROUNDING = 1e-12
_CHUNK = 4096


def _chunks(batches):
    """Yield tables of whole groups (runs of equal first column), of about _CHUNK rows or one larger group."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        keys = b.column(0).to_numpy()
        at = 0
        while at < b.num_rows:
            # the part that may end a chunk stops at the last change of key within reach
            to = min(b.num_rows, at + _CHUNK)
            edges = np.flatnonzero(keys[at + 1 : to] != keys[at : to - 1]) + at + 1
            if held and rows >= _CHUNK and held[-1].column(0)[-1].as_py() != int(keys[at]):
                yield pa.Table.from_batches(held)
                held, rows = [], 0
            cut = int(edges[-1]) if len(edges) and rows + to - at >= _CHUNK else to
            held.append(b.slice(at, cut - at))
            rows += cut - at
            at = cut
    if held:
        yield pa.Table.from_batches(held)


def _pairs_within(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j), i < j, of rows of one group."""
    rows = np.repeat(starts, sizes) + _ramp(sizes)
    after = np.repeat(starts + sizes, sizes) - rows - 1
    i = np.repeat(rows, after)
    return i, i + 1 + _ramp(after)


def _ramp(counts: np.ndarray) -> np.ndarray:
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _linked(unit, starts, sizes, left, right, least):
    """Pairs of rows of a group, from different blocks if it is of two, at cosine least or more."""
    small = sizes <= _SMALL
    found = []
    i, j = _pairs_within(starts[small], sizes[small])
    for s in range(0, len(i), 1 << 16):
        a, b = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
        ok = (left[a] & right[b]) | (left[b] & right[a])
        a, b = a[ok], b[ok]
        near = np.einsum("ij,ij->i", unit[a], unit[b]) >= least
        found.append((a[near], b[near]))
    for start, size in zip(starts[~small].tolist(), sizes[~small].tolist(), strict=True):
        rows = np.arange(start, start + size)
        both = bool((left[rows] & right[rows]).all())
        a, b = (rows, rows) if both else (rows[left[rows]], rows[right[rows]])
        for s in range(0, len(a), 512):
            cosine = unit[a[s : s + 512]] @ unit[b].T
            x, y = np.nonzero(cosine >= least - _ROUNDING)
            edge = np.flatnonzero(cosine[x, y] < least + _ROUNDING)
            x, y = a[s + x], b[y]
            below = edge[np.einsum("ij,ij->i", unit[x[edge]], unit[y[edge]]) < least]
            x, y = np.delete(x, below), np.delete(y, below)
            if both:
                x, y = x[x < y], y[x < y]
            found.append((x, y))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _check(least: float):
    def check(batches):
        for g in _chunks(batches):
            key, node, label, times, left, right, table = (g[c].to_numpy() for c in ("key", "node", "label", "times", "left", "right", "table"))
            vectors, codes = _rows(g["v"]), np.stack(_rows(g["codes"]))
            dims = np.array([len(v) for v in vectors])
            links, comp = np.zeros(len(node), np.int64), np.arange(len(node))
            ends = []
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                starts = np.flatnonzero(np.concatenate([[True], key[at][1:] != key[at][:-1]]))
                sizes = np.diff(np.concatenate([starts, [len(at)]]))
                if (sizes > 1).any():
                    i, j = _linked(unit_rows(np.stack([vectors[i] for i in at])), starts[sizes > 1], sizes[sizes > 1], left[at], right[at], least)
                    ends.append((at[i], at[j]))
            i, j = (np.concatenate(x) for x in zip(*ends, strict=True)) if ends else (np.zeros(0, int), np.zeros(0, int))
            ok = (label[i] == label[j]) & (node[i] != node[j])
            i, j = i[ok], j[ok]
            first = np.zeros(len(i), bool)  # this is the first table that the pair has in common
            for s in range(0, len(i), 1 << 18):
                a, b = i[s : s + (1 << 18)], j[s : s + (1 << 18)]
                first[s : s + (1 << 18)] = (codes[a] == codes[b]).argmax(axis=1) == table[a]
            i, j = i[first], j[first]
            np.add.at(links, i, times[j])
            np.add.at(links, j, times[i])
            while len(i):  # least row of each component
                before = comp.copy()
                low = np.minimum(comp[i], comp[j])
                np.minimum.at(comp, i, low)
                np.minimum.at(comp, j, low)
                comp = comp[comp]
                if (comp == before).all():
                    break
            hit = links > 0
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (node[hit], links[hit], node[comp[hit]])], names=["node", "links", "linked_to"])

    return check


def embedding_components(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least_cosine: float = 0.98, tables: int = 24, per_table: int = 12, width: float = 1.5, seed: int = 7, block: int = 1024) -> DataFrame:
    """(id, n_links, component_id, kept) for each row of vectors.

    Vectors link when their labels are equal and not null and their cosine in double precision is at
    least least_cosine; pairs are those that share a bucket of some table. n_links counts the other
    rows linked directly, component_id is the least id reachable by links, kept marks the row whose
    own id that is. A pair at the defaults' bound is met with probability 0.99 and more; nearer pairs more surely.

    Null or zero vectors and those with null or non-finite components link with nothing, nor do
    vectors of different lengths. Rows with equal vectors and labels link, repeated rows too. A null
    id is nobody's least and never kept. An empty table gives an empty result; other columns are ignored.
    """
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))
    marks = ["mark", "mark2"]  # two hashes: one of 64 bits would take some of a billion different vectors as equal
    rows = rows.withColumns({"mark": F.when(usable, F.xxhash64(F.col("label").cast("string"), v)), "mark2": F.when(usable, F.xxhash64(F.lit("second"), v, F.col("label").cast("string")))})
    classes = rows.where("mark IS NOT NULL").groupBy(*marks).agg(F.any_value("label").cast("string").alias("label_name"), F.any_value("v").alias("v"), F.count(F.lit(1)).alias("times"), F.min("id").alias("least"))
    classes = materialize(classes.withColumn("label", F.xxhash64("label_name")).withColumn("node", F.monotonically_increasing_id()), "embedding-nodes")
    codes = materialize(classes.select("node", "v").mapInArrow(_coder(tables, per_table, width, seed), "node long, codes array<long>"), "embedding-codes")
    keyed = codes.join(classes.select("node", F.xxhash64("label", F.size("v")).alias("kind")), "node").select("node", F.posexplode("codes").alias("table", "code"), "kind").select("node", "table", F.xxhash64("kind", "table", "code").alias("bucket"))
    shared = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    mine = F.pmod(F.col("node"), F.col("blocks")).cast("int")
    dealt = keyed.join(shared, "bucket").withColumn("blocks", blocks).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"), "node", "table", (F.col("mine") <= F.col("other")).alias("left"), (F.col("mine") >= F.col("other")).alias("right"))
    full = dealt.join(classes.select("node", "label", "times", "v"), "node").join(codes, "node").select("key", "node", "label", "times", "left", "right", "table", "v", "codes")
    n = partition_count(vectors, (128 << 20) // tables)  # a vector travels once a table that it shares a bucket in
    found = materialize(full.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_check(least_cosine), "node long, links long, linked_to long"), "embedding-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    components = connected_components(found, "node", "linked_to")
    rooted = classes.select("node", *marks, "times", "least").join(components, "node", "left").join(links, "node", "left").withColumn("root", F.coalesce("component", "node"))
    roots = rooted.groupBy("root").agg(F.min("least").alias("of_root"))
    known = rooted.join(roots, "root").select(*marks, (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "of_root")
    # rows without a mark meet no other: they need no shuffle partner and stay with their own id
    out = rows.where("mark IS NOT NULL").select("id", *marks).join(known, marks).select("id", "n_links", F.col("of_root").alias("c"))
    out = out.union(rows.where("mark IS NULL").select("id", F.lit(0).cast("long"), F.col("id")))
    return out.select(F.col("id").alias(id_col), "n_links", F.col("c").alias("component_id"), F.coalesce(F.col("id") == F.col("c"), F.lit(False)).alias("kept"))


def op6_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return embedding_components(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op6_embedding_dedup": op6_embedding_dedup}

ORACLE_SQL = {
    "op6_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
u AS MATERIALIZED (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id, vec_id AS m FROM embeddings UNION SELECT l.y, r.m FROM r JOIN l ON l.x = r.vec_id),
c AS (SELECT vec_id, min(m) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT x AS vec_id, count(*) AS k FROM l GROUP BY x)
SELECT c.vec_id, CAST(coalesce(n.k, 0) AS BIGINT) AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM c LEFT JOIN n USING (vec_id)
""",
}
