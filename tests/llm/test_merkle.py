"""Merkle proofs against trees that are built whole."""

import hashlib

import pytest
from pyspark.sql import functions as F

from sedgewren.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf int, proof string, number int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def slow_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def slow_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def slow_path(levels, i):
    path = []
    for level in levels[:-1]:
        begin = i // 8 * 8
        path.append(("".join(level[begin:i]), "".join(level[i + 1 : begin + 8])))
        i //= 8
    return path


@pytest.mark.parametrize("count", [1, 2, 7, 8, 9, 63, 64, 65, 511, 512, 513, 700])
def test_traversal_gives_each_path(count):
    leaves = [sha(str(i)) for i in range(count)]
    levels = slow_levels(leaves)
    height = merkle.height_of(count)
    assert height == len(levels) - 1 and merkle.block_root(leaves, height) == levels[-1][0]
    assert [list(p) for p in merkle.traverse(leaves, height)] == [slow_path(levels, i) for i in range(count)]


def test_traversal_memory_is_logarithmic():
    held = []
    push = merkle.Treehash.push

    def counted(self, leaf):
        push(self, leaf)
        held.append(sum(map(len, self.rows)))

    merkle.Treehash.push = counted
    try:
        for _ in merkle.traverse([sha(str(i)) for i in range(4096)], 4):
            pass
    finally:
        merkle.Treehash.push = push
    assert max(held) <= 8 * 4


def rows():
    out = [(i, f"s{i % 3}", ["en", "de", None, "é", ""][i * i % 5], i, f"Text {i} ä" if i % 7 else None, 1, "p", 2) for i in range(300)]
    out += [(i, "s", "big", None, "A" * i, 1, "p", 2) for i in range(1000, 1150)]
    out += [(5, None, "en", 1, "again", 1, "p", 2), (5, None, "en", 1, "again", 1, "p", 2), (None, None, None, None, None, 1, "p", 2), (None, "x", "en", 3, "", 1, "p", 2)]
    return out + [(9999, "s", "lone", 1, "x" * 300_000, 1, "p", 2)]


def slow_manifest(table):
    trees = {}
    for row in table:
        trees.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, slow_leaf(row)))
    order = sorted(trees, key=lambda lang: (lang is not None, (lang or "").encode()))
    levels = {lang: slow_levels([leaf for *_, leaf in sorted(trees[lang])]) for lang in order}
    upper = slow_levels([levels[lang][-1][0] for lang in order])
    out = []
    for at, lang in enumerate(order):
        for i, (there, doc_id, leaf) in enumerate(sorted(trees[lang])):
            out.append((doc_id if there else None, leaf, levels[lang][-1][0], upper[-1][0], slow_path(levels[lang], i) + slow_path(upper, at)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("height", [1, 4])
def test_manifest_equals_whole_trees(spark, monkeypatch, height):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    monkeypatch.setattr(merkle, "BLOCK", 8**height)
    found = merkle.manifest(spark.createDataFrame(rows(), SCHEMA).repartition(5))
    got = sorted(((r.doc_id, r.leaf, r.subroot, r.root, [(p.left, p.right) for p in r.proof]) for r in found.collect()), key=repr)
    assert got == slow_manifest(rows())


def test_fold_finds_what_changed(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    from sedgewren.llm.common import Scratch

    stored = Scratch(spark, "test").put(merkle.manifest(docs))
    root = stored.first().root
    assert stored.where(merkle.fold(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0
    changed = docs.withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).unionByName(spark.createDataFrame([(123456, "s", "en", 1, "new", 1, "p", 2)], SCHEMA))
    judged = merkle.verify(changed, stored, root)
    wrong = {r.doc_id for r in judged.where("not verified").collect()}
    assert wrong == {r[0] for r in rows() if r[0] is not None and r[0] % 10 == 0 and r[4] is not None} | {123456}
    assert judged.count() == len(rows()) + 1


def test_few_and_no_rows(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).count() == 0
    one = merkle.manifest(spark.createDataFrame(rows()[:1], SCHEMA)).first()
    assert one.leaf == one.subroot == one.root and one.proof == []
    with pytest.raises(ValueError):
        merkle.prove(spark.createDataFrame([("a", "b", 1, 2)], "lang string, leaf string, doc_id long, ROOT int"))
