"""Merkle manifest of a dataset by superblock reduction.

Rows are the leaves of one tree a group, in the order of their ids; the roots of the groups are the
leaves of a tree on top. Leaves get their index from one range partitioning. An index divided by
fanout^levels names a superblock; each superblock's levels are collapsed in one task to one digest,
and the digests are reduced likewise until one a tree is left. On the way back every superblock gets
the path of its root and puts it behind the paths inside it. So a group of any size is spread over
superblocks of at most fanout^levels rows, and a tree of n leaves takes log(n) / levels rounds.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from peakloom.operators.reshape import with_row_id
from peakloom.workspace import materialize, partition_count

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"
_NODE = "tree long, idx long, n long, digest string"


def leaf_digest(fields: list[Column]) -> Column:
    """Hex SHA-256 of the fields in order, each its length in UTF-8 bytes, a colon and its value, or - where null."""

    def framed(value: Column) -> Column:
        s = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))

    return F.sha2(F.concat(*map(framed, fields)), 256)


def height(n: int, fanout: int) -> int:
    """Levels above n leaves."""
    levels = 0
    while n > 1:
        n = -(-n // fanout)
        levels += 1
    return levels


def _parents(digests: list[str], fanout: int) -> list[str]:
    return [hashlib.sha256("".join(digests[i : i + fanout]).encode()).hexdigest() for i in range(0, len(digests), fanout)]


def _collapser(fanout: int, levels: int):
    def collapse(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("idx")
        n = int(block["n"].iloc[0])
        digests = block["digest"].tolist()
        for _ in range(min(levels, height(n, fanout))):
            digests, n = _parents(digests, fanout), -(-n // fanout)
        return pd.DataFrame({"tree": [int(block["tree"].iloc[0])], "idx": [int(block["block"].iloc[0])], "n": [n], "digest": digests})

    return collapse


def _path_grower(fanout: int, levels: int, kept: list[str], schema: pa.Schema):
    """A block's nodes beside the row of its root: each node's path inside the block, followed by the root's."""

    def grow(nodes: pa.Table, above: pa.Table) -> pa.Table:
        nodes = nodes.take(pc.sort_indices(nodes, [("idx", "ascending")]))
        rows, n = nodes.num_rows, int(nodes["n"][0].as_py())
        level = nodes["digest"].to_pylist()
        left, right, at = [], [], []
        for k in range(min(levels, height(n, fanout))):
            at.append(len(left) + np.arange(rows) // fanout**k)
            for i in range(len(level)):
                start = i - i % fanout
                left.append("".join(level[start:i]))
                right.append("".join(level[i + 1 : start + fanout]))
            level = _parents(level, fanout)
        for step in above["path"][0].as_py():
            at.append(np.full(rows, len(left)))
            left.append(step["left"])
            right.append(step["right"])
        flat = pa.array(np.column_stack(at).ravel() if at else np.zeros(0, np.int64), pa.int64())
        steps = pa.StructArray.from_arrays([pa.array(left, pa.string()).take(flat), pa.array(right, pa.string()).take(flat)], names=["left", "right"])
        path = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * len(at), pa.int32()), steps)
        same = lambda c: pa.array([above[c][0].as_py()] * rows, pa.string())
        return pa.Table.from_arrays([*(nodes[c] for c in kept), path, same("subroot"), same("root")], names=[*kept, "path", "subroot", "root"]).cast(schema)

    return grow


def _rounds(nodes: DataFrame, most: int, fanout: int, levels: int) -> list[DataFrame]:
    """The nodes, and what is left of them after each round; a tree's last node has n = 1."""
    rounds = [nodes]
    for _ in range(math.ceil(height(most, fanout) / levels)):
        todo = _in_blocks(rounds[-1], fanout, levels).select("tree", "block", "idx", "n", "digest")
        rounds.append(materialize(todo.groupBy("tree", "block").applyInPandas(_collapser(fanout, levels), _NODE), "superblocks"))
    return rounds


def _in_blocks(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    return nodes.where("n > 1").withColumn("block", F.expr(f"idx div {fanout**levels}"))


def _paths(rounds: list[DataFrame], top: DataFrame, fanout: int, levels: int) -> DataFrame:
    """The first round's nodes with path, subroot and root; top: (tree, path, subroot, root), what each tree's root has."""
    from pyspark.sql.pandas.types import to_arrow_schema

    above = None
    for nodes in reversed(rounds):
        kept = [c for c in nodes.columns if c not in ("n", "digest")] if nodes is not rounds[0] else nodes.columns
        found = nodes.where("n = 1").select(*kept).join(top, "tree").select(*kept, "path", "subroot", "root")
        if above is not None:
            blocks = _in_blocks(nodes, fanout, levels)
            grow = _path_grower(fanout, levels, kept, to_arrow_schema(found.schema))
            grown = blocks.groupBy("tree", "block").cogroup(above.groupBy("tree", "idx")).applyInArrow(grow, found.schema)
            found = grown.unionByName(found)
        above = found
    return above


def merkle_manifest(docs: DataFrame, *, id_col: str = "doc_id", group_col: str = "source", fields: tuple[str, ...] = FIELDS, carry: dict[str, Column] | None = None, fanout: int = 3, levels: int = 6) -> DataFrame:
    """(id, leaf, proof, subroot, root, carried columns), a row a row of docs.

    A row's leaf is the digest of its fields (leaf_digest). The leaves of a group ascend by id; while
    several nodes are left, every `fanout` consecutive ones (the last run may hold fewer, even one)
    become the SHA-256 of their hex digests in a row. What is left is subroot, of a lone leaf the leaf
    itself. The subroots, in the order of their groups (null first, then by UTF-8 bytes), give root
    likewise. proof holds a step a level from the leaf up to root: the digests of the run left and right of the
    node, each possibly empty; fold_proof walks it. carry: small columns computed from docs that
    come along, named other than the result's.

    Null ids come first in their group. Rows with one id are ordered by their leaves; equal rows have equal
    leaves, in neighbouring places. Null and empty texts differ, as the framing does. An empty
    table gives an empty result. Other columns of docs play no part, whatever their names. No
    superblock holds over fanout^levels rows, however large its group.
    """
    col = lambda c: F.col(f"`{c}`")
    carry = carry or {}
    leaves = docs.select(col(group_col).alias("__group"), col(id_col).alias("__id"), leaf_digest([col(c) for c in fields]).alias("digest"), *(x.alias(f"__c_{name}") for name, x in carry.items()))
    n = partition_count(docs, 64 << 20)
    placed = leaves.repartitionByRange(n, "__group", "__id", "digest").sortWithinPartitions("__group", "__id", "digest").withColumn("__at", F.monotonically_increasing_id())
    placed = materialize(placed, "leaves").withColumn("__part", F.shiftright("__at", 33))
    # a group lies in consecutive partitions: one row of each (group, partition) places all of its leaves
    runs = materialize(placed.groupBy("__group", "__part").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n")), "leaf-runs")
    groups = with_row_id(runs.groupBy("__group").agg(F.sum("__n").alias("n"), F.min("__first").alias("__start")), ["__start"], "tree").drop("__start")
    most, n_groups = groups.agg(F.coalesce(F.max("n"), F.lit(0)), F.count(F.lit(1))).first()
    before = F.coalesce(F.sum("__n").over(W.partitionBy("__group").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = runs.withColumn("__before", before).drop("__n").alias("s").join(groups.alias("g"), F.expr("s.__group <=> g.__group")).select("s.__group", "s.__part", "s.__first", "s.__before", "g.tree", "g.n")
    placed = placed.alias("p").join(starts.alias("s"), F.expr("p.__group <=> s.__group AND p.__part = s.__part"))
    nodes = placed.select("s.tree", (F.col("p.__at") - F.col("s.__first") + F.col("s.__before")).alias("idx"), "s.n", "p.digest", "p.__id", *(f"p.__c_{name}" for name in carry))

    rounds = _rounds(nodes, most, fanout, levels)
    roots = rounds[0].where("n = 1").select("tree", "digest")
    for later in rounds[1:]:
        roots = roots.unionByName(later.where("n = 1").select("tree", "digest"))
    subroots = materialize(roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(n_groups).cast("long").alias("n"), "digest"), "subroots")
    upper = _rounds(subroots, n_groups, fanout, levels)
    whole = upper[-1].select("tree", F.array().cast(PATH).alias("path"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    top = _paths(upper, whole, fanout, levels).select(F.col("idx").alias("tree"), "path", F.col("digest").alias("subroot"), "root")
    out = _paths(rounds, materialize(top, "subroot-paths"), fanout, levels)
    return out.select(F.col("__id").alias(id_col), F.col("digest").alias("leaf"), F.col("path").alias("proof"), "subroot", "root", *(F.col(f"__c_{name}").alias(name) for name in carry))


def fold_proof(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its proof lead to."""
    return F.aggregate(proof, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    changed = [F.translate("text", "\n", "") if c == "text" else F.col(c) for c in FIELDS]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    found = merkle_manifest(docs, carry={"tampered": F.when(hit, leaf_digest(changed))})
    siblings = F.array_join(F.transform("proof", lambda step: F.concat(step["left"], step["right"])), "")
    folded = found.withColumns({"proof_sha256": F.sha2(siblings, 256), "folded_root": fold_proof(F.coalesce("tampered", "leaf"), F.col("proof"))})
    return folded.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = {"op11_merkle_manifest": op11_merkle_manifest}


def _tree_sql(name: str, keys: str, deepest: int) -> str:
    """Levels {name}0 (keys, idx, n, h) to {name}{deepest}, and {name}_runs: keys, lvl, idx, l, r (the digests of its run left and right of each node that has a parent)."""
    parts = []
    for k in range(deepest):
        parts.append(f"{name}{k + 1} AS (SELECT {keys}, idx // 3 AS idx, CAST(ceil(any_value(n) / 3.0) AS BIGINT) AS n, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY {name}{k}.idx)) ELSE any_value(h) END AS h FROM {name}{k} GROUP BY {keys}, idx // 3)")
    every = " UNION ALL ".join(f"SELECT {keys}, {k} AS lvl, idx, h FROM {name}{k} WHERE n > 1" for k in range(deepest))
    run = f"OVER (PARTITION BY {keys}, lvl, idx // 3 ORDER BY idx ROWS BETWEEN"
    return ", ".join(parts) + f""", {name}_runs AS (SELECT {keys}, lvl, idx, coalesce(string_agg(h, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM ({every}))"""


def _sql(deepest: int = 16, deepest_top: int = 8) -> str:
    framed = lambda c: f"coalesce(CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(framed(text if c == "text" else c) for c in FIELDS) + ")"
    crc = "list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten([[CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1] for c in string_split(CAST(doc_id AS VARCHAR), '')])), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END)"
    steps = deepest + deepest_top
    folds = ", ".join(f"f{k + 1} AS (SELECT f.doc_id, f.g, f.i, CASE WHEN s.l IS NULL THEN f.h ELSE sha256(s.l || f.h || s.r) END AS h, f.sib || coalesce(s.l || s.r, '') AS sib FROM f{k} f LEFT JOIN {'a' if k < deepest else 'b'}_runs s ON {'s.g = f.g AND' if k < deepest else ''} s.lvl = {k if k < deepest else k - deepest} AND s.idx = {f'f.i // {3**k}' if k < deepest else f'f.g // {3 ** (k - deepest)}'})" for k in range(steps))
    return rf"""WITH d AS (SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, {leaf('text')} AS h, CASE WHEN xor({crc}, 4294967295) % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} END AS t FROM documents),
a0 AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n, h, t, doc_id FROM d), {_tree_sql('a', 'g', deepest)},
b0 AS (SELECT 0 AS z, g AS idx, (SELECT count(DISTINCT g) FROM d) AS n, h FROM a{deepest}), {_tree_sql('b', 'z', deepest_top)},
f0 AS (SELECT doc_id, g, idx AS i, coalesce(t, h) AS h, '' AS sib FROM a0), {folds}
SELECT f.doc_id, a0.h AS leaf, x.h AS subroot, y.h AS root, sha256(f.sib) AS proof_sha256, f.h AS folded_root, f.h = y.h AS verified
FROM f{steps} f JOIN a0 ON a0.doc_id = f.doc_id JOIN a{deepest} x ON x.g = f.g, b{deepest_top} y"""


ORACLE_SQL = {"op11_merkle_manifest": _sql()}
