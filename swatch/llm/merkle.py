"""Merkle manifest of a data set, with a witness for every row, built by aligned appends.

Rows are leaves.  A leaf is the SHA-256 of its fields, each spelled ``-`` if null and else as its number of UTF-8
bytes, ``:`` and the value; all hashes are lower-case hex and are hashed as that text.  The leaves of one group ascend by
id; every two consecutive nodes (the last one alone, if it has no partner) become one, until one is left: the group's
subroot.  The subroots, ordered by group (null first, then bytewise), give the root in the same way.

* Leaves are put in order by one range shuffle of ``(group, id, leaf)``, without the texts, and numbered from
  the sizes of the ranges, so no group has to fit in a task.
* ``Appender`` takes the nodes of one aligned block of ``2 ** levels`` positions one by one.  Its open subtrees
  are perfect and grow smaller to the right; each node carries the witness it has so far.  When a node completes
  its left neighbour, both subtrees extend the witnesses of all their members by the other's root.
* The root of a block is one more append, at the next stratum, to the tree of its group, and so on until every
  group has one node; the subroots are appended to the tree of trees.  A stratum has ``2 ** LEVELS`` times fewer
  nodes than the one below, and a member's witness is its own part followed by that of its block.

Defined cases: null ids come first; rows of equal ids are ordered by leaf, and equal rows are leaves of their own;
a group of one row has its leaf as subroot; an empty table has no rows and no root.  Columns of the input that are
not named are not read, so clashing names do no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swatch.session import materialize

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LEVELS = 10  # of a block: 1,024 nodes, so that a task holds about 1,024 x 10 digests at a time


def leaf(values: Sequence[Column]) -> Column:
    """Digest of a row's fields."""
    spelled = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-"))
               for v in values]
    return F.sha2(F.concat(*spelled), 256)


def node(*digests: str) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


class Appender:
    """The nodes of one aligned block, in order; ``siblings[i][l]`` is the sibling of member i's
    ancestor at level l, or None if it has none."""

    def __init__(self, levels: int):
        self.levels = levels
        self.siblings: list[list[str | None]] = []
        self.open: list[tuple[int, int, str]] = []  # level, first member, root; from left to right

    def _join(self, level: int, first: int, root: str, last: int) -> None:
        """Put a subtree of the members ``first`` to ``last`` in place, completing those to its left."""
        while self.open and self.open[-1][0] == level:
            _, start, left = self.open.pop()
            for i in range(start, first):
                self.siblings[i].append(root)
            for i in range(first, last):
                self.siblings[i].append(left)
            level, first, root = level + 1, start, node(left, root)
        self.open.append((level, first, root))

    def append(self, digest: str) -> None:
        self.siblings.append([])
        self._join(0, len(self.siblings) - 1, digest, len(self.siblings))

    def close(self) -> str:
        """The block's root: no more nodes come, so the rightmost open subtree rises alone."""
        while len(self.open) > 1 or self.open[0][0] < self.levels:
            level, first, root = self.open.pop()
            for i in range(first, len(self.siblings)):
                self.siblings[i].append(None)
            self._join(level + 1, first, node(root), len(self.siblings))
        return self.open[0][2]


def _append_blocks(nodes: DataFrame, levels: int) -> DataFrame:
    """``nodes`` with ``siblings`` (within the block) and, at a block's first node, the block's ``top``."""
    schema = T.StructType([*nodes.schema.fields, *T.StructType.fromDDL("siblings array<binary>, top string").fields])

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("pos")
        n = block["n"][0].as_py()
        tree = Appender(levels if n > 1 << levels else (n - 1).bit_length())
        for digest in block["digest"].to_pylist():
            tree.append(digest)
        root = tree.close()
        witness = [[s and bytes.fromhex(s) for s in own] for own in tree.siblings]
        tops = [root] + [None] * (block.num_rows - 1)
        return (block.append_column("siblings", pa.array(witness, pa.list_(pa.binary())))
                .append_column("top", pa.array(tops, pa.string())))

    block = F.shiftright("pos", levels).alias("block")
    return nodes.groupBy("tree", block).applyInArrow(run, schema)


def _numbered(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Adds ``pos`` (from 0 within ``tree``, in ``order``) and ``n`` (rows of the tree)."""
    ranged = (rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
              .withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    ranged = materialize(ranged, f"{name}-ordered")
    # One row per range and tree in it: ranges + trees at most.
    sizes = ranged.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("own"), F.min("at").alias("first"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("tree", "part", "first", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("before"),
                         F.sum("own").over(Window.partitionBy("tree")).alias("n"))
    return (ranged.join(sizes, ["tree", "part"])
            .withColumn("pos", F.col("at") - F.col("first") + F.col("before")).drop("part", "at", "first", "before"))


def _grow(nodes: DataFrame, levels: int, name: str, finish=None) -> DataFrame:
    """``nodes`` (tree, pos, n, digest, carried columns) with ``siblings`` up to the tree's root, and the
    columns of ``finish(roots)`` or ``subroot``; ``roots`` has one row per tree."""
    low = materialize(_append_blocks(nodes, levels), name)
    high = low.where("top IS NOT NULL").select(
        "tree", F.shiftright("pos", levels).alias("pos"),
        F.shiftright(F.col("n") + ((1 << levels) - 1), levels).alias("n"), F.col("top").alias("digest"))
    if high.where("n > 1").limit(1).count():
        high = _grow(high, levels, name, finish).withColumnRenamed("siblings", "above").drop("n", "digest", "top")
    else:
        roots = high.select("tree", F.col("digest").alias("subroot"))
        high = (finish(roots) if finish else roots).select(
            "*", F.lit(0).cast("long").alias("pos"), F.array().cast("array<binary>").alias("above"))
    high = high.withColumnsRenamed({"tree": "h_tree", "pos": "h_pos"})
    at = (F.col("tree") == F.col("h_tree")) & (F.shiftright("pos", levels) == F.col("h_pos"))
    return (low.join(high, at).withColumn("siblings", F.concat("siblings", "above"))
            .drop("h_tree", "h_pos", "above", "top"))


def _steps(siblings: str, pos: str) -> Column:
    """Siblings with their side: ``left`` if the sibling comes before the folded node."""
    return F.expr(f"transform({siblings}, (s, i) -> struct(lower(hex(s)) AS digest, shiftright({pos}, i) % 2 = 1 AS left))")


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: Sequence[str] = FIELDS,
             carry: Mapping[str, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """Per row: ``id_col``, ``group_col``, the columns of ``carry`` (computed with the leaf, where the row is read), ``pos`` (in its
    group), ``leaf``, ``subroot``, ``root`` and ``steps``: ``array<struct<digest, left>>`` from the leaf to the root, with a
    null digest where a node has no sibling."""
    carry = dict(carry or {})
    # Null groups sort first: every other key begins with "=".
    tree = F.coalesce(F.concat(F.lit("="), docs[group_col].cast("string")), F.lit(""))
    leaves = materialize(docs.select(
        tree.alias("tree"), docs[id_col].alias("id"), docs[group_col].alias("group"),
        leaf([docs[f] for f in fields]).alias("digest"), F.struct(F.lit(1).alias("_"), *[c.alias(k) for k, c in carry.items()])
        .alias("carried")), "merkle-leaves").withColumn("row", F.monotonically_increasing_id())
    nodes = _numbered(leaves, ["id", "digest", "row"], "merkle").drop("row")

    def finish(roots: DataFrame) -> DataFrame:
        roots = materialize(roots, "merkle-subroots")
        high = _numbered(roots.select(F.lit("").alias("tree"), F.col("tree").alias("own"), F.col("subroot").alias("digest")),
                         ["own"], "merkle-top")
        high = _grow(high, levels, "merkle-top")
        return high.select(F.col("own").alias("tree"), F.col("digest").alias("own_root"), F.col("subroot").alias("root"),
                           F.col("siblings").alias("top_siblings"), F.col("pos").alias("top_pos"))

    grown = _grow(nodes, levels, "merkle-blocks", finish)
    steps = F.concat(_steps("siblings", "pos"), _steps("top_siblings", "top_pos"))
    return grown.select(F.col("id").alias(id_col), F.col("group").alias(group_col),
                        *[F.col("carried")[k].alias(k) for k in carry], "pos", F.col("digest").alias("leaf"),
                        F.col("own_root").alias("subroot"), "root", steps.alias("steps"))


def fold(start: Column, steps: Column) -> Column:
    """The root that a leaf and the siblings of a witness give."""

    def up(acc: Column, step: Column) -> Column:
        both = F.when(step["digest"].isNull(), acc).when(step["left"], F.concat(step["digest"], acc)).otherwise(
            F.concat(acc, step["digest"]))
        return F.sha2(both, 256)

    return F.aggregate(steps, start, up)


def proof(steps: Column) -> Column:
    """One digest of all siblings, in order."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: s["digest"]), ""), 256)
