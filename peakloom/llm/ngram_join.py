"""Similarity join of documents by the Jaccard coefficient of their word n-gram sets.

Prefix filtering (Chaudhuri et al. 2006; Bayardo et al. 2007) with the length, positional and suffix
filters of PPJoin+ (Xiao et al. 2008):

* n-grams are ordered rare first, by the number of documents that hold them. Two sets that are
  similar enough share one of the first n - ceil(t*n) + 1 of either. An n-gram of one document can't
  be shared, so most documents end here.
* Documents with equal sets (equal in number and in two 64-bit sums of their members) are one node.
* The holders of a prefix n-gram are its list. Each list first offers the pairs of its members with
  one leader, the one with the least share of n-grams that nobody else has; the verified links are joined to components, and lists whose members are all in one
  component are done. What remains, pairs across components, is offered in a last round. So a list
  of k copies costs k pairs, not k*k, and no link between components is lost.
* A pair is dropped early by the sizes (length), by what can follow the common n-gram in both
  (positional), and by the counts of the two sets in ranges of the hash space (in place of the suffix
  filter). The others are verified once, on the whole sets: the texts of these nodes are read again,
  so no text is carried along.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakloom.llm.packing import blob, in_batches, runs, split_by_bucket, text_batches, tidy
from peakloom.llm.textblocks import FOLDED_WORDS, Words, blocks, gram_texts, grams, mix, text_bytes
from peakloom.operators.graph import connected_components
from peakloom.workspace import materialize, remove

_U = np.uint64
#: Ranges of the hash space whose counts are compared.
_RANGES = 64


#: Rows of three numbers (24 bytes) that may be broadcast to the texts, which else are shuffled to them.
MOST_BROADCAST = 400_000


def shingle_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash) of the distinct n-grams of each text, ascending; a shorter text's words are one n-gram."""
    at, owner = gram_texts(words.bounds, n)
    keys = [grams(words.hashes, n)[at]]
    owners = [owner]
    counts = np.diff(words.bounds)
    for short in range(1, n):
        texts = np.flatnonzero(counts == short)
        if len(texts):
            keys.append(grams(words.hashes, short)[words.bounds[texts]])
            owners.append(texts)
    keys, owners = np.concatenate(keys), np.concatenate(owners)
    order = np.lexsort((keys, owners))
    keys, owners = keys[order], owners[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])
    return owners[new], keys[new]


def _sets_of(column, n: int):
    """Yield (first row, rows, owner, hash) for blocks of a text column."""
    raw, offsets = text_bytes(column)
    for i, j in blocks(offsets):
        owner, keys = shingle_sets(Words(raw, offsets[i : j + 1], FOLDED_WORDS), n)
        yield i, j - i, owner, keys


def least_overlap(nx: Column, ny: Column, percent: int) -> Column:
    """The least common size of two sets that link: 100 * common >= percent * union."""
    return F.ceil((nx + ny) * F.lit(percent) / F.lit(100.0 + percent) - F.lit(1e-9))


def _ask(n: int, parts: int):
    @tidy
    def ask(table: pa.Table) -> pa.Table:
        keys = np.sort(np.concatenate([k for *_, k in _sets_of(table["text"], n)]))
        first, _ = runs(keys)
        counts = np.diff(np.concatenate([first, [len(keys)]])).astype(np.uint32)
        keys = keys[first]
        rows = [(b, (k >> _U(32)).astype(np.uint32).tobytes(), c.tobytes()) for b, k, c in split_by_bucket(mix(keys) % _U(parts), keys, counts)]
        cols = list(zip(*rows, strict=True)) if rows else [()] * 3
        return pa.table({"batch": pa.array([table["batch"][0].as_py()] * len(rows), pa.int32()), "bucket": pa.array(cols[0], pa.int32()), "keys": pa.array(cols[1], pa.binary()), "counts": pa.array(cols[2], pa.binary())})

    return ask


@tidy
def _count(table: pa.Table) -> pa.Table:
    """To each batch those of its n-grams that more than one document holds, with that number."""
    parts = [blob(table["keys"], i, np.uint32) for i in range(len(table))]
    keys, counts = np.concatenate(parts), np.concatenate([blob(table["counts"], i, np.uint32) for i in range(len(table))])
    order = np.argsort(keys, kind="stable")
    first, number = runs(keys[order])
    total = np.empty(len(keys), np.int64)
    total[order] = np.add.reduceat(counts[order].astype(np.int64), first)[number]
    rows, at = [], 0
    for i, part in enumerate(parts):
        mine = total[at : at + len(part)]
        if (take := mine > 1).any():
            rows.append((table["batch"][i].as_py(), table["bucket"][i].as_py(), part[take].tobytes(), np.minimum(mine[take], (1 << 32) - 1).astype(np.uint32).tobytes()))
        at += len(part)
    cols = list(zip(*rows, strict=True)) if rows else [()] * 4
    return pa.table({"batch": pa.array(cols[0], pa.int32()), "bucket": pa.array(cols[1], pa.int32()), "keys": pa.array(cols[2], pa.binary()), "counts": pa.array(cols[3], pa.binary())})


_STATE = "id long, mark long, n long, node long, node2 long, skip int, prefix array<long>, ranges array<int>"


def _prefixes(n: int, parts: int, percent: int):
    @tidy
    def prefixes(table: pa.Table, answers: pa.Table) -> pa.Table:
        known = np.zeros(0, np.uint64)
        counts = np.zeros(0, np.uint32)
        if len(answers):
            known = np.concatenate([(_U(answers["bucket"][i].as_py()) << _U(32)) | blob(answers["keys"], i, np.uint32).astype(np.uint64) for i in range(len(answers))])
            counts = np.concatenate([blob(answers["counts"], i, np.uint32) for i in range(len(answers))])
            order = np.argsort(known)
            known, counts = known[order], counts[order]
        size, node, node2, skip, prefix, prefix_at, ranges, active = [], [], [], [], [], [0], [], []
        for _, rows, owner, keys in _sets_of(table["text"], n):
            bounds = np.searchsorted(owner, np.arange(rows + 1))
            held = np.diff(bounds)
            sums = np.concatenate([[0], np.cumsum(mix(keys))]).astype(np.uint64)
            sums2 = np.concatenate([[0], np.cumsum(mix(keys ^ _U(0x5851F42D4C957F2D)))]).astype(np.uint64)
            node.append(mix((sums[bounds[1:]] - sums[bounds[:-1]]) ^ held.astype(np.uint64)).view(np.int64))
            node2.append((sums2[bounds[1:]] - sums2[bounds[:-1]]).view(np.int64))
            df = np.ones(len(keys), np.int64)
            if len(known):
                probe = ((mix(keys) % _U(parts)) << _U(32)) | (keys >> _U(32))
                k = np.minimum(np.searchsorted(known, probe), len(known) - 1)
                df = np.where(known[k] == probe, counts[k], 1).astype(np.int64)
            order = np.lexsort((keys, df, owner))
            place = np.arange(len(keys)) - np.repeat(bounds[:-1], held)
            length = held - (percent * held + 99) // 100 + 1
            take = (place < np.repeat(length, held)) & (df[order] > 1)
            chosen = np.add.reduceat(np.concatenate([take, [False]]).astype(np.int64), bounds[:-1]) * (held > 0)
            lone = np.add.reduceat(np.concatenate([(df == 1), [False]]).astype(np.int64), bounds[:-1]) * (held > 0)
            size.append(held)
            skip.append(np.minimum(lone, length) * (held > 0))
            prefix.append(keys[order][take].view(np.int64))
            prefix_at.extend((prefix_at[-1] + np.cumsum(chosen)).tolist())
            active.append(chosen > 0)
            table_of = np.bincount(owner * _RANGES + (keys >> _U(58)).astype(np.int64), minlength=rows * _RANGES)
            ranges.append(table_of.astype(np.int32))
        cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        on = cat(active, bool)
        flat, rows = cat(ranges, np.int32), len(table)
        import pyarrow.compute as pc

        off = pa.array(~on)
        return pa.table({
            "id": table["id"], "mark": table["mark"], "n": pa.array(cat(size, np.int64), pa.int64()), "node": pa.array(cat(node, np.int64)), "node2": pa.array(cat(node2, np.int64)),
            "skip": pa.array(cat(skip, np.int64).astype(np.int32)), "prefix": pa.ListArray.from_arrays(pa.array(prefix_at, pa.int32()), pa.array(cat(prefix, np.int64))),
            "ranges": pc.if_else(off, pa.scalar(None, pa.list_(pa.int32())), pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * _RANGES, pa.int32()), pa.array(flat))),
        })

    return prefixes


def _verify(n: int, percent: int):
    @tidy
    def verify(batches):
        for whole in batches:
            for s in range(0, whole.num_rows, 256):
                b = whole.slice(s, 256)
                owners, keys = [], []
                for name in ("tx", "ty"):
                    for first, _, owner, k in _sets_of(b.column(b.schema.get_field_index(name)), n):
                        owners.append(owner + first)
                        keys.append(k)
                owner, key = np.concatenate(owners), np.concatenate(keys)
                total = np.bincount(owner, minlength=b.num_rows)
                order = np.lexsort((key, owner))
                owner, key = owner[order], key[order]
                twice = (owner[1:] == owner[:-1]) & (key[1:] == key[:-1])
                common = np.bincount(owner[1:][twice], minlength=b.num_rows)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(100 * common >= percent * (total - common))], names=["x", "y", "linked"])

    return verify


def ngram_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 75, leader_rounds: int = 2, partitions: int | None = None, mark_col: str | None = None) -> DataFrame:
    """(id, n_shingles, component_id) for each row of docs: groups under links of Jaccard >= percent/100.

    A text's set holds the distinct runs of n words (`[^\\x20\\x09-\\x0D]+`, A-Z lower-cased); a text
    of fewer words has its whole sequence as the one member; null texts and those without words have
    the empty set and link with nothing. Sets link when 100 * common >= percent * union; component_id
    is the least id reachable by links, or the row's own.

    Rows with one id and different texts are separate; repeated rows are linked like other copies. A
    null id is nobody's least id: its component is that of the others, or null. An empty table gives
    an empty result. Other columns are ignored. Sets are compared by 64-bit hashes of their members.
    mark_col, if given, adds xxhash64 of the text, which tells rows with one id apart.
    """
    if not 1 <= percent <= 100:
        raise ValueError("percent must lie between 1 and 100")
    parts = partitions or text_batches(docs, text_col)
    batched = in_batches(docs, id_col, text_col, parts)
    asked = batched.groupBy("batch").applyInArrow(_ask(n, parts), "batch int, bucket int, keys binary, counts binary")
    answers = asked.groupBy("bucket").applyInArrow(_count, "batch int, bucket int, keys binary, counts binary")
    marked = batched.withColumn("mark", F.xxhash64("text"))
    state = materialize(marked.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_prefixes(n, parts, percent), _STATE), "ngram-state")
    # one row a node: any of its equal sets, whose prefixes are the same; it gets a number of its own
    pick = lambda *names: (F.first(c).alias(c) for c in names)
    nodes = state.where(F.size("prefix") > 0).groupBy("node", "node2").agg(F.min("id").alias("least"), F.first(F.struct("id", "mark")).alias("row"), *pick("n", "skip", "prefix", "ranges"))
    nodes = materialize(nodes.withColumnsRenamed({"node": "sum", "node2": "sum2"}).withColumn("node", F.monotonically_increasing_id()), "ngram-nodes")
    chosen = materialize(nodes.select("node", "n", F.posexplode("prefix").alias("pos", "gram"), "skip").select("gram", "node", "n", (F.col("pos") + F.col("skip")).alias("pos"), (F.col("skip") / F.col("n")).alias("lone")), "ngram-lists")
    several = chosen.groupBy("gram").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("gram")
    lists = materialize(chosen.join(several, "gram"), "ngram-lists")
    remove(chosen)
    sizes = nodes.select("node", "ranges", "n")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))

    def may_link(a: str, b: str) -> Column:
        need = least_overlap(F.col(f"{a}_n"), F.col(f"{b}_n"), percent)
        follow = F.least(F.col(f"{a}_n") - F.col(f"{a}_pos"), F.col(f"{b}_n") - F.col(f"{b}_pos"))
        # length: the smaller set can hold enough; positional: enough can follow the common n-gram, itself included
        return (F.least(F.col(f"{a}_n"), F.col(f"{b}_n")) >= need) & (follow >= need)

    def renamed(df: DataFrame, a: str) -> DataFrame:
        return df.select("gram", F.col("node").alias(f"{a}_node"), F.col("n").alias(f"{a}_n"), F.col("pos").alias(f"{a}_pos"), F.col("c").alias(f"{a}_c"))

    def pairs_of(a: DataFrame, b: DataFrame) -> DataFrame:
        met = renamed(a, "a").join(renamed(b, "b"), "gram").where((F.col("a_c") != F.col("b_c")) & may_link("a", "b"))
        return met.select(F.least("a_node", "b_node").alias("x"), F.greatest("a_node", "b_node").alias("y")).distinct()

    def links_of(pairs: DataFrame) -> DataFrame:
        common = F.aggregate(F.zip_with("rx", "ry", lambda p, q: F.least(p, q)), F.lit(0), lambda s, v: s + v)
        near = (
            pairs.join(sizes.select(F.col("node").alias("x"), F.col("ranges").alias("rx"), F.col("n").alias("nx")), "x")
            .join(sizes.select(F.col("node").alias("y"), F.col("ranges").alias("ry"), F.col("n").alias("ny")), "y")
            .where(common >= least_overlap(F.col("nx"), F.col("ny"), percent))
            .select("x", "y")
        )
        near = materialize(near, "ngram-near")
        wanted = near.select(F.explode(F.array("x", "y")).alias("node")).distinct().join(nodes.select("node", F.col("row.id").alias("of"), F.col("row.mark").alias("mark")), "node")
        wanted = materialize(wanted, "ngram-wanted")
        few = F.broadcast(wanted) if wanted.count() <= MOST_BROADCAST else wanted
        held = texts.join(few, (texts["mark"] == wanted["mark"]) & texts["id"].eqNullSafe(wanted["of"])).select("node", "text").groupBy("node").agg(F.any_value("text").alias("text"))
        held = materialize(held, "ngram-texts")
        both = near.join(held.select(F.col("node").alias("y"), F.col("text").alias("ty")), "y").join(held.select(F.col("node").alias("x"), F.col("text").alias("tx")), "x").select("x", "y", "tx", "ty")
        linked = materialize(both.mapInArrow(_verify(n, percent), "x long, y long, linked boolean").where("linked").select("x", "y"), "ngram-links")
        for done in (near, wanted, held):
            remove(done)
        return linked

    found: list[DataFrame] = []
    tested: list[DataFrame] = []
    members = lists.withColumn("c", F.col("node")).withColumn("alone", F.lit(True))
    for turn in range(leader_rounds + 1):
        if turn == leader_rounds:
            pairs = pairs_of(members, members)
        else:  # of those without a link so far the one with the least share of n-grams of its own, the likeliest centre of its copies
            first = members.where("alone").groupBy("gram").agg(F.min_by(F.struct("node", "n", "pos", "c"), F.struct("lone", F.xxhash64("node"))).alias("l")).select("gram", "l.*")
            pairs = pairs_of(first, members)
        for old in tested:
            pairs = pairs.join(old, ["x", "y"], "left_anti")
        pairs = materialize(pairs, "ngram-pairs")
        if pairs.isEmpty():
            if turn == leader_rounds:
                break
            continue
        tested.append(pairs)
        found.append(links_of(pairs))
        links = found[0]
        for more in found[1:]:
            links = links.union(more)
        components = materialize(connected_components(links, "x", "y"), "ngram-components")
        if turn == leader_rounds:
            break
        now = lists.join(components.select("node", F.col("component").alias("found")), "node", "left").withColumn("c", F.coalesce("found", "node")).withColumn("alone", F.col("found").isNull()).drop("found")
        open_lists = now.groupBy("gram").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("gram")
        members = materialize(now.join(open_lists, "gram"), "ngram-open")
        if members.isEmpty():
            break
    return _result(state, nodes, components if found else None, id_col, mark_col)


def _result(state: DataFrame, nodes: DataFrame, components: DataFrame | None, id_col: str, mark_col: str | None) -> DataFrame:
    least = nodes.select("node", "sum", "sum2", "least")
    if components is not None:
        rooted = least.join(components, "node", "left").withColumn("root", F.coalesce("component", "node"))
        roots = rooted.groupBy("root").agg(F.min("least").alias("of_root"))
        least = rooted.join(roots, "root").select("sum", "sum2", F.col("of_root").alias("least"))
    least = least.select(F.col("sum").alias("node"), F.col("sum2").alias("node2"), "least")
    active = F.size("prefix") > 0
    linked = state.where(active).select("id", "mark", "n", "node", "node2").join(least, ["node", "node2"], "left").select("id", "mark", "n", F.coalesce("least", "id").alias("c"))
    alone = state.where(~active).select("id", "mark", "n", F.col("id").alias("c"))
    return linked.union(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("c").alias("component_id"), *([F.col("mark").alias(mark_col)] if mark_col else []))


def op3_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_ngram_join": op3_ngram_join}

ORACLE_SQL = {
    "op3_ngram_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
c AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS MATERIALIZED (SELECT x, y FROM p JOIN c cx ON cx.doc_id = x JOIN c cy ON cy.doc_id = y WHERE 100 * k >= 75 * (cx.n + cy.n - k)),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS m FROM documents UNION SELECT e.y, r.m FROM r JOIN e ON e.x = r.doc_id)
SELECT d.doc_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_shingles, q.m AS component_id
FROM d LEFT JOIN c USING (doc_id) JOIN (SELECT doc_id, min(m) AS m FROM r GROUP BY doc_id) q USING (doc_id)
""",
}
