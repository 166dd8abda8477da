"""Shards against a running sum over the sorted table."""

import zlib

import pytest

from sedgewren.llm import sharding


def slow(rows, shards):
    sized = sorted(((i is not None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows))
    whole, before, slots, out = sum(r[2] for r in sized), 0, {}, []
    for there, i, size, crc in sized:
        shard = (2 * before + size) * shards // (2 * whole)
        out.append((i if there else None, size, crc, shard, slots.setdefault(shard, 0)))
        slots[shard] += 1
        before += size
    return sorted(out, key=repr)


def rows():
    return [(i, "ä" * (i * i % 400)) for i in range(500)] + [(7, "same")] * 300 + [(None, None), (None, "x"), (501, None), (502, ""), (503, "long " * 20_000)]


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_shards_equal_running_sums(spark, shards):
    docs = spark.createDataFrame(rows(), "doc_id long, text string").selectExpr("doc_id", "text", "1 AS size", "2 AS slot", "3 AS _sw0").repartition(7)
    got = sharding.assign(docs, shards)
    assert got.columns == ["doc_id", "size", "text_crc32", "shard", "slot"]
    assert sorted(map(tuple, got.collect()), key=repr) == slow(rows(), shards)


def test_shards_are_balanced(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "repeat('x', CAST(id * 7919 % 300 AS INT)) AS text")
    sums = [r[0] for r in sharding.assign(docs).groupBy("shard").sum("size").select("sum(size)").collect()]
    assert len(sums) == 16 and max(sums) - min(sums) <= 600


def test_plan_has_no_python(spark):
    plan = sharding.assign(spark.createDataFrame(rows(), "doc_id long, text string"))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_written_shards_hold_all_rows(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows()], "doc_id long, text string, lang string")
    sharding.write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(((r.doc_id, r.text, r.lang) for r in back.collect()), key=repr) == sorted(((i, t, "en") for i, t in rows()), key=repr)
    assert sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in back.collect()), key=repr) == slow(rows(), 4)
    with pytest.raises(ValueError):
        sharding.write_shards(docs.withColumnRenamed("lang", "SLOT"), str(tmp_path / "no"), 4)


def test_no_rows(spark):
    assert sharding.assign(spark.createDataFrame([], "doc_id long, text string")).count() == 0
