"""A Merkle manifest of a table: trees of eight by language, with each row's proof made by Merkle traversal."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, fresh
from .order import numbered

ARITY = 8
#: Levels of a block, and so its leaves: what one task goes through at a time.
HEIGHT = 4
BLOCK = ARITY**HEIGHT

PROOF = "array<struct<left:string,right:string>>"


def digest(nodes: list[str]) -> str:
    """The digest of a run: of its nodes' hex texts, one after the other."""
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


class Treehash:
    """Makes the nodes of one height from leaves that are pushed one by one; holds at most eight nodes a level."""

    def __init__(self, height: int):
        self.rows: list[list[str]] = [[] for _ in range(height + 1)]

    def push(self, leaf: str) -> None:
        rows = self.rows
        rows[0].append(leaf)
        level = 0
        while level + 1 < len(rows) and len(rows[level]) == ARITY:
            rows[level + 1].append(digest(rows[level]))
            rows[level].clear()
            level += 1

    def close(self) -> list[str]:
        """No leaf follows: runs that are not full become nodes, too."""
        for level in range(len(self.rows) - 1):
            if self.rows[level]:
                self.rows[level + 1].append(digest(self.rows[level]))
                self.rows[level].clear()
        return self.rows[-1]


def height_of(leaves: int) -> int:
    """Levels above ``leaves`` nodes until one is left."""
    height = 0
    while leaves > 1:
        leaves = -(-leaves // ARITY)
        height += 1
    return height


def block_root(leaves: list[str], height: int) -> str:
    stack = Treehash(height)
    for leaf in leaves:
        stack.push(leaf)
    return stack.close()[0]


def traverse(leaves: list[str], height: int) -> Iterator[list[tuple[str, str]]]:
    """For one leaf after the other, its siblings to the left and to the right on each level of the block.

    A level keeps the run that the leaf is under and a stack that makes the next run. The next run begins as many
    leaves on as a run covers, so each step feeds each stack one leaf, and the run is ready when the leaf
    before it is done. Besides the leaves, that is at most 8 nodes for each pair of levels.
    """
    spans = [ARITY ** (level + 1) for level in range(height)]
    runs, coming = [], []
    for level, span in enumerate(spans):
        stack = Treehash(level)
        for leaf in leaves[:span]:
            stack.push(leaf)
        runs.append(stack.close())
        coming.append(Treehash(level))
    path: list[tuple[str, str]] = [("", "")] * height
    for i in range(len(leaves)):
        for level in range(height):
            below = spans[level] // ARITY
            if i % below:
                break  # levels above keep their node as well
            at = i // below % ARITY
            path[level] = ("".join(runs[level][:at]), "".join(runs[level][at + 1 :]))
        yield path
        for level, span in enumerate(spans):
            if i + span < len(leaves):
                coming[level].push(leaves[i + span])
            if (i + 1) % span == 0:
                runs[level] = coming[level].close()
                coming[level] = Treehash(level)


def leaf_hash(*columns: Column | str) -> Column:
    """The leaf of a row: lowercase hex SHA-256 of its fields, each ``-`` if null, else its UTF-8 byte count, a colon and its value."""
    fields = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in fields]), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's digest and a proof give; null if either is."""
    return F.aggregate(proof, leaf, lambda node, level: F.sha2(F.concat(level["left"], node, level["right"]), 256))


def _roots(nodes: DataFrame, tree: str, number: str, total: str, node: str) -> DataFrame:
    """The node above each block, or the tree's root where the block is all of it; placed for the next stage."""
    block = fresh(nodes.columns, 1)[0]

    def root(table: pa.Table) -> pa.Table:
        table = table.sort_by(number)
        count = table[total][0].as_py()
        found = block_root(table[node].to_pylist(), HEIGHT if count > BLOCK else height_of(count))
        return pa.table({tree: [table[tree][0].as_py()], number: [table[number][0].as_py() // BLOCK], total: [-(-count // BLOCK)], node: [found]})

    kept = nodes.select(tree, number, total, node, F.expr(f"{number} div {BLOCK}").alias(block))
    return kept.groupBy(tree, block).applyInArrow(root, T.StructType([T.StructField(tree, T.StringType()), T.StructField(number, T.LongType()), T.StructField(total, T.LongType()), T.StructField(node, T.StringType())]))


def _extend(nodes: DataFrame, paths: DataFrame, tree: str, number: str, total: str, node: str, proof: str) -> DataFrame:
    """``nodes`` with their proofs: siblings within the block by traversal, then the path of the block's own node, which ``paths`` has."""
    block = fresh([*nodes.columns, *paths.columns], 1)[0]
    kept, more = [c for c in nodes.columns], [c for c in paths.columns if c not in (tree, number, proof)]
    own = pa.struct([("left", pa.string()), ("right", pa.string())])

    def walk(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by(number)
        count, leaves, upper = left[total][0].as_py(), left[node].to_pylist(), right[proof][0].as_py()
        over = [(level["left"], level["right"]) for level in upper]
        lefts, rights, ends = [], [], [0]
        for path in traverse(leaves, HEIGHT if count > BLOCK else height_of(count)):
            for a, b in path:
                lefts.append(a)
                rights.append(b)
            for a, b in over:
                lefts.append(a)
                rights.append(b)
            ends.append(len(lefts))
        pairs = pa.StructArray.from_arrays([pa.array(lefts, pa.string()), pa.array(rights, pa.string())], fields=list(own))
        out = {c: left[c] for c in kept}
        out[proof] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
        for c in more:
            out[c] = pa.array([right[c][0].as_py()] * len(leaves), right[c].type)
        return pa.table(out)

    schema = T.StructType([*[nodes.schema[c] for c in kept], T.StructField(proof, T._parse_datatype_string(PROOF)), *[paths.schema[c] for c in more]])
    a = nodes.withColumn(block, F.expr(f"{number} div {BLOCK}")).groupBy(tree, block)
    b = paths.withColumnRenamed(number, block).groupBy(tree, block)
    return a.cogroup(b).applyInArrow(walk, schema)


def prove(rows: DataFrame, leaf: str = "leaf", tree: str = "lang", by: str = "doc_id") -> DataFrame:
    """``rows`` with ``subroot``, ``root`` and ``proof``: the siblings left and right of the row's node, from its run up to the root.

    Rows of one ``tree`` (null is one of its own) stand in the order of ``by``, nulls first, ties by the leaf's digest; each
    eight nodes in a row (the last run: fewer, even one) become the digest of their hex texts until one is left. These
    subroots, in the order of the trees' UTF-8 bytes, null first, likewise give the root. A tree of one row has that
    leaf as its subroot. Repeated rows are leaves of their own. No rows give no result. A null leaf raises in the digest.

    Trees are cut into aligned blocks of 4,096 nodes. Going up, a task turns a block into its node, stage by
    stage; going down, each block gets its node's path (one row) and goes through its leaves by ``traverse``. No tree
    is gathered: a stage holds a 4,096th of the one below it.
    """
    if clash := {"subroot", "root", "proof"} & {c.lower() for c in rows.columns}:
        raise ValueError(f"columns have names of the result: {sorted(clash)}")
    spark = rows.sparkSession
    scratch = Scratch(spark, "merkle")
    key, number, total, node, proof, member = fresh([*rows.columns, "subroot", "root", "proof"], 6)
    # '0' for null and '1' before a value: never null, and in the order of the bytes.
    keyed = scratch.put(rows.withColumn(key, F.coalesce(F.concat(F.lit("1"), F.col(tree).cast("string")), F.lit("0"))))
    placed = scratch.put(numbered(keyed, scratch, [by, leaf], number, total, tree=key))
    scratch.drop(keyed)

    def climb(nodes: DataFrame) -> list[DataFrame]:
        """All stages above ``nodes``; the last has one node for each tree."""
        stages = [nodes]
        longest = nodes.agg(F.max(total)).first()[0] or 0
        while longest > 1:
            stages.append(scratch.put(_roots(stages[-1], key, number, total, node)))
            longest = -(-longest // BLOCK)
        return stages

    trees = climb(placed.select(key, number, total, F.col(leaf).alias(node)))
    subroots = scratch.put(trees[-1].select(F.col(key).alias(member), F.lit("").alias(key), node))
    tops = climb(scratch.put(numbered(subroots, scratch, [member], number, total, tree=key)))
    # The one node of the last stage has nothing beside it or above it.
    paths = tops[-1].select(key, number, F.col(node).alias("root"), F.expr(f"CAST(array() AS {PROOF})").alias(proof))
    for stage in reversed(tops[:-1] or tops):
        below = _extend(stage, paths, key, number, total, node, proof)
        paths = scratch.put(below.drop(total, node))
    # From here on a path belongs to a tree's last stage, which has one node with number 0.
    above = paths.select(F.col(member).alias(key), F.lit(0).cast("long").alias(number), "root", proof)
    paths = above.join(subroots.select(F.col(member).alias(key), F.col(node).alias("subroot")), key)
    for stage in reversed(trees[1:-1]):
        paths = scratch.put(_extend(stage, paths, key, number, total, node, proof).drop(total, node))
    return _extend(placed, paths, key, number, total, leaf, proof).select(*rows.columns, "subroot", "root", F.col(proof).alias("proof"))


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, leaf, subroot, root, proof) for each row of a documents table; see ``leaf_hash`` and ``prove``. Other columns are ignored."""
    return prove(docs.select("doc_id", "lang", leaf_hash(*FIELDS).alias("leaf")))


def verify(docs: DataFrame, stored: DataFrame, root: str) -> DataFrame:
    """(doc_id, verified): whether the row, as it is now, folds to ``root`` by the proof in a stored manifest.

    ``verified`` is false for a row whose id the manifest lacks. Of several rows of one id (and of null ids) each is
    held against all proofs of that id: verified if one fits.
    """
    own = Scratch(docs.sparkSession, "verify").put(docs.select(F.col("doc_id").alias("id"), leaf_hash(*FIELDS).alias("now")))
    proofs = stored.select("doc_id", "proof")
    joined = own.distinct().join(proofs, F.col("id").eqNullSafe(F.col("doc_id")), "left")
    fits = F.coalesce(fold(F.col("now"), F.col("proof")) == root, F.lit(False))
    judged = joined.groupBy(F.col("id").alias("judged_id"), F.col("now").alias("judged_now")).agg(F.max(fits).alias("verified"))
    return own.join(judged, F.col("id").eqNullSafe(F.col("judged_id")) & (F.col("now") == F.col("judged_now"))).select(F.col("id").alias("doc_id"), "verified")
