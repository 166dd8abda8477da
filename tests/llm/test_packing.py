"""Packing: exact round trip of every id, capacity, little padding."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sedgewren.llm import packing


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["the", "cats", "Über", "12", "x!", "ñandú"]) for _ in range(rng.choice([1, 5, 80, 700, 3000]))) for _ in range(120)]
    odd = [None, "", " ", "<|endoftext|> a", "日本語 テキスト \u3000x", "a\u200bb 😀\r\n\t", "\u0378 ꟲ", texts[3], "tabs\tand  spaces \n\n", " " * 300_000 + "x", "a" * 200_000, "\n" * 50_000]
    return list(enumerate(texts + odd)) + [(5, texts[5]), (None, "no id")]


def test_every_id_is_in_one_piece(spark, rows):
    frame = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, start int").repartition(3)
    got = packing.pack(frame).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = {}
    for key, text in rows:
        expected.setdefault(key, []).append([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0])
    pieces, windows = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(expected)
    for key, lists in expected.items():
        own = sorted(pieces[key], key=lambda r: r.start)
        assert sum(r.length for r in own) == sum(map(len, lists))
        for r in own:  # rows of one id are told apart by what they hold
            assert any(len(ids) == r.doc_tokens and zlib.crc32(np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes()) == r.ids_crc32 for ids in lists)
        if len(lists) == 1:
            assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]]
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_little_padding_and_the_same_again():
    rng = random.Random(4)
    lengths = [rng.randrange(1, 4000) for _ in range(500)]
    packed = packing.pack_block(lengths, 1024, 128)
    assert packed == packing.pack_block(lengths, 1024, 128)
    assert len(packed) * 1024 < 1.02 * sum(lengths)


def test_differencing_is_near_equal_and_whole():
    rng = random.Random(2)
    sizes = [rng.randrange(1, 129) for _ in range(400)]
    where = packing.differencing(sizes, 30)
    sums = np.bincount(where, weights=sizes, minlength=30)
    assert sums.sum() == sum(sizes) and sums.max() - sums.min() <= 8


def test_the_count_rises_when_capacity_is_exceeded():
    assert sorted(len(w) for w in packing.pack_block([100, 100, 100], 128, 128)) == [1, 1, 1]


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
