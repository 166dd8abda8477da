"""Embedding near-dedup by a forest of random-projection trees with spill overlap."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, components

#: Most levels whose nodes are cut at medians of the sample; a node that no sampled row tells about is cut at the
#: median of its whole level. Bounds a tree's size, whatever its depth.
FITTED = 12
#: A tree: a direction for each level, the cuts of its first nodes in level order from 1, and a cut for each level.
Tree = tuple[np.ndarray, np.ndarray, np.ndarray]


def grow(sample: np.ndarray, depth: int, dim: int, rng: np.random.Generator) -> Tree:
    """Node i of level l splits at its cut into 2i and 2i + 1. Each is cut at the median of the sample's rows that
    reach it; where under eight do, and below FITTED levels, at the median of the whole sample along that direction."""
    directions = rng.standard_normal((depth, dim))
    directions /= np.linalg.norm(directions, axis=1, keepdims=True)
    along = sample @ directions.T if len(sample) else np.zeros((1, depth))
    levels = np.median(along, axis=0)
    cuts = np.repeat(levels[: min(depth, FITTED)], 1 << np.arange(min(depth, FITTED)))
    cuts = np.concatenate([[0.0], cuts])
    node = np.ones(len(sample), dtype=np.int64)
    for level in range(min(depth, FITTED) if len(sample) else 0):
        order = np.argsort(node, kind="stable")
        found, at = np.unique(node[order], return_index=True)
        for i, rows in zip(found, np.split(order, at[1:]), strict=True):
            if len(rows) >= 8:
                cuts[i] = np.median(along[rows, level])
        node = 2 * node + (along[:, level] > cuts[node])
    return directions, cuts, levels


def leaves(tree: Tree, x: np.ndarray, spill: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of every leaf that a row reaches; a row within ``spill`` of a cut goes both ways."""
    directions, cuts, levels = tree
    rows, node = np.arange(len(x)), np.ones(len(x), dtype=np.int64)
    for direction, level in zip(directions, levels, strict=True):
        cut = np.where(node < len(cuts), cuts[np.minimum(node, len(cuts) - 1)], level)
        along = (x @ direction)[rows] - cut
        left, right = along <= spill, along > -spill
        rows, node = np.concatenate([rows[left], rows[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1])
    return rows, node


def compare(x: np.ndarray, ids: np.ndarray, copies: np.ndarray, codes: list[np.ndarray], code: int, least: float, own: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Within one leaf: how many links of each row belong to it (to all copies of its partners), and the least id that a row's links reach here.

    ``own`` and ``other`` are the rows compared with each other (the same, or two tiles of a large leaf). A
    link that was already seen in a leaf of smaller code is not counted again: pairs share codes across trees.
    """
    links, reach = np.zeros(len(ids), dtype=np.int64), ids.copy()
    step = 512
    edges: list[tuple[np.ndarray, np.ndarray]] = []
    same = own is other
    for at in range(0, len(own), step):
        a = own[at : at + step]
        for to in range(at if same else 0, len(other), step):
            b = other[to : to + step]
            near = np.argwhere(x[a] @ x[b].T >= least)
            i, j = a[near[:, 0]], b[near[:, 1]]
            keep = i < j if same else i != j
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            edges.append((i, j))
            involved = np.unique(np.concatenate([i, j]))
            before = [c[c < code] for c in (codes[r] for r in involved)]
            known, flat = np.unique(np.concatenate(before) if before else np.empty(0, np.int64), return_inverse=True)
            if len(known):
                seen = np.zeros((len(involved), len(known)), dtype=np.float32)
                seen[np.repeat(np.arange(len(involved)), [len(c) for c in before]), flat] = 1
                pi, pj = np.searchsorted(involved, i), np.searchsorted(involved, j)
                fresh = np.empty(len(i), dtype=bool)
                for part in range(0, len(i), 4096):
                    s = slice(part, part + 4096)
                    fresh[s] = np.einsum("ij,ij->i", seen[pi[s]], seen[pj[s]]) == 0
                i, j = i[fresh], j[fresh]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
    changed = bool(edges)
    while changed:
        old = reach.copy()
        for i, j in edges:
            np.minimum.at(reach, i, reach[j])
            np.minimum.at(reach, j, reach[i])
        changed = not np.array_equal(old, reach)
    return links, reach


def near_dedup(vectors: DataFrame, least: float = 0.98, trees: int = 6, leaf: int = 256, spill: float | None = None, sample_rows: int = 8192, tile: int = 2048, seed: int = 17) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of (vec_id, embedding, label).

    Rows are linked where their labels are equal and their cosine, in double precision, is ``least`` or more.
    Rows of one label with the same components are one node from the start, with their number; so copies cost
    nothing, however many. Each label and dimension has its own forest, fitted on a sample of at most about
    ``sample_rows`` rows in all and as deep as leaves of about ``leaf`` rows need; every node is indexed. One
    within ``spill`` of a cut goes both ways, and only nodes of one leaf are compared, so a link is missed if
    every tree parts it by more than that; tests measure the recall. Two vectors at the least cosine are
    sqrt(2 - 2 least) apart, along a random direction that divided by sqrt(dim), of which ``spill`` is 1.2 times by default.
    Leaves over ``tile`` nodes, which groups of almost equal vectors make, are compared tile by tile in many tasks.

    Null labels, null or empty vectors, zero vectors and ones with null or non-finite components link with
    nothing; they are their own component. A null vec_id keeps a row with null component and kept, and links with
    nothing. Rows that repeat a vec_id are vectors of their own, each with its own links; the id names all
    their components.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    # Vectors travel in their own precision and are compared in double.
    kind = "array<float>" if vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType()) else "array<double>"
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("e"), F.col("label").cast("long").alias("label"))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("e", lambda v: v != 0), F.lit(False))
    keys = [F.when(usable, F.xxhash64(F.lit(i), "e")).alias(f"k{i}") for i in (1, 2)]  # 128 bits tell vectors apart
    keyed = base.select("vec_id", "label", "e", *keys)
    nodes = keyed.where("k1 is not null").groupBy("label", "k1", "k2").agg(F.first("e").alias("e"), F.count("*").alias("copies"), F.min("vec_id").alias("low"))
    nodes = scratch.put(nodes.withColumns({"dim": F.size("e"), "node": F.monotonically_increasing_id()}))
    sizes = nodes.groupBy("label", "dim").count()
    depth = F.greatest(F.lit(0), F.ceil(F.log2(F.col("count") / leaf))).cast("int")
    depths = scratch.put(sizes.select("label", "dim", "count", depth.alias("depth")))
    kinds = depths.groupBy("dim", "depth").agg(F.sum("count").alias("n")).collect()  # a row for each power of two
    total = sum(r.n for r in kinds)
    share = 1 << 30 if total <= sample_rows else int((1 << 30) * sample_rows / total)
    sample = nodes.where(F.pmod(F.xxhash64("k1", "k2"), F.lit(1 << 30)) < share).select("k1", "k2", "dim", "e").toPandas().sort_values(["dim", "k1", "k2"])
    by_dim = {d: unit(np.array(part.e.tolist(), dtype=float)) for d, part in sample.groupby("dim")}
    # One forest for each dimension and depth serves all labels alike (its leaves are kept apart by label). Plain
    # arrays are broadcast: workers have no copy of this package to read objects of its classes with.
    forests: dict[tuple[int, int], list[Tree]] = {}
    for r in kinds:
        rng = np.random.default_rng([seed, r.dim, r.depth])
        forests[r.dim, r.depth] = [grow(by_dim.get(r.dim, np.zeros((0, r.dim))), r.depth, r.dim, rng) for _ in range(trees)]
    shared = spark.sparkContext.broadcast(forests)
    # A leaf's code is its tree's number before its node's; both fit 32 bits but for tables of billions of nodes.
    narrow = trees << max((r.depth for r in kinds), default=0) + 1 < 1 << 31
    code_type, code_name = (pa.int32(), "int") if narrow else (pa.int64(), "long")
    reach_of = lambda dim: spill if spill is not None else 1.2 * math.sqrt(2 - 2 * least) / math.sqrt(dim)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forests = shared.value
        for batch in batches:
            dims, depths = batch.column(2).to_numpy(), batch.column(5).to_numpy()
            for dim, depth in sorted(set(zip(dims.tolist(), depths.tolist(), strict=True))):
                part = batch.filter(pa.array((dims == dim) & (depths == depth)))
                x = unit(matrix(part.column(3), dim))
                found: list[list[int]] = [[] for _ in range(len(x))]
                for number, tree in enumerate(forests[dim, depth]):
                    for row, node in zip(*(v.tolist() for v in leaves(tree, x, reach_of(dim))), strict=True):
                        found[row].append(number << depth + 1 | node)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(5)), pa.array(found, pa.list_(code_type))], ["node", "label", "dim", "e", "copies", "codes"])

    placed_at = nodes.join(depths.select("label", "dim", "depth").hint("merge"), ["label", "dim"]).select("node", "label", "dim", "e", "copies", "depth")
    indexed = scratch.put(placed_at.mapInArrow(index, f"node long, label long, dim int, e {kind}, copies long, codes array<{code_name}>"))
    counts = indexed.select("label", "dim", F.explode("codes").alias("code")).groupBy("label", "dim", "code").count()
    # Only leaves of over ``tile`` rows are listed: fewer than one for every ``tile`` rows and tree.
    large = scratch.put(counts.where(F.col("count") > tile).select("label", "dim", "code", F.ceil(F.col("count") / tile).cast("int").alias("parts")))
    spread = indexed.withColumn("code", F.explode("codes")).join(large.hint("merge"), ["label", "dim", "code"], "left") if not large.isEmpty() else indexed.withColumns({"code": F.explode("codes"), "parts": F.lit(1)})
    tiled = spread.withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts").cast("long")).cast("int"))
    # A row of part p goes to the tiles (p, q) and (q, p): every two parts meet once.
    placed = tiled.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"low": F.least("part", "q"), "high": F.greatest("part", "q")})
    # Earlier leaves alone tell whether a pair was met before, so no others travel.
    placed = placed.select("label", "dim", "code", "low", "high", "node", "copies", "part", "e", F.filter("codes", lambda c: c < F.col("code")).alias("codes"))

    def join(key: tuple, table: pa.Table) -> pa.Table:
        dim, code, low, high = (v.as_py() for v in key[1:])
        table = table.combine_chunks()
        ids, copies, part = (table.column(c).to_numpy() for c in ("node", "copies", "part"))
        order = np.argsort(ids, kind="stable")
        x = unit(matrix(table.column("e").combine_chunks(), dim)[order])
        lists = table.column("codes").combine_chunks()
        starts, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        codes = [flat[starts[i] : starts[i + 1]] for i in order.tolist()]
        ids, copies, part = ids[order], copies[order], part[order]
        own = np.flatnonzero(part == low)
        other = own if low == high else np.flatnonzero(part == high)
        links, reach = compare(x, ids, copies, codes, code, least, own, other)
        some = (links > 0) | (reach < ids)
        return pa.table({"node": ids[some], "links": links[some], "reach": reach[some]})

    partial = scratch.put(placed.groupBy("label", "dim", "code", "low", "high").applyInArrow(join, "node long, links long, reach long"))
    edges = scratch.put(partial.where("reach < node").select(F.col("node").alias("u"), F.col("reach").alias("v")).distinct())
    found = components(edges, scratch)
    linked = partial.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.select("label", "k1", "k2", "node", "copies", "low").join(linked, "node", "left").join(found, "node", "left")
    known = scratch.put(known.select("label", "k1", "k2", "low", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")))
    named = scratch.put(known.groupBy("component").agg(F.min("low").alias("component_id")))
    known = scratch.put(known.join(named.hint("merge"), "component").select("label", "k1", "k2", "n_links", "component_id"))
    rows = keyed.select("vec_id", "label", "k1", "k2")
    wide = rows.where("k1 is not null").join(known.hint("merge"), ["label", "k1", "k2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("k1 is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return wide.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def matrix(lists: pa.ListArray, dim: int) -> np.ndarray:
    """The rows of a list column as a matrix of doubles."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by their greatest component first, so that no square overflows."""
    if not len(x):
        return x
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)
