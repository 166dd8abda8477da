"""Decontamination against edit distances by dynamic programming."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from sedgewren.llm import decontam


def best(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=1, max_size=12), st.text("abc", max_size=30))
def test_myers_is_the_edit_distance(pattern, text):
    found = decontam.myers(pattern, text, len(pattern))
    assert found is not None and found[0] == best(pattern, text)


def edited(rng, text, n):
    chars = list(text)
    for _ in range(n):
        i = rng.randrange(len(chars))
        kind = rng.randrange(3)
        if kind == 0:
            chars[i] = rng.choice("abcdefg ")
        elif kind == 1:
            del chars[i]
        else:
            chars.insert(i, rng.choice("abcdefg"))
    return "".join(chars)


def test_matches_equal_brute_force():
    rng = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    tests = [(i, say(12)) for i in range(12)]
    items = decontam.make_items(tests, 0.1, 20)
    words_ = decontam.automaton(items)
    for _ in range(150):
        item = rng.choice(tests)[1]
        text = decontam.fold_only(f"{say(20)} {edited(rng, item, rng.randrange(0, 14))} {say(20)}")
        got = {items[at].item_id: d for at, _, _, d in decontam.matches(text, items, words_)}
        assert got == {i.item_id: d for i in items if (d := best(i.text, text)) <= i.budget}


def test_leaks_and_places(spark):
    item = "The quick brown fox jumps over the lazy dog near the old river bank."
    texts = {1: f"Lead. THE  quick\nbrown fox jumps over the lazy dog near the old river bank. End", 2: f"x {edited(random.Random(1), item, 4)} y", 3: "nothing of the kind", 4: None, 5: "", 6: "pad " * 60_000 + item, 7: item[:30]}
    docs = spark.createDataFrame([(k, t, 3) for k, t in texts.items()], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(9, item), (10, None), (11, "too short"), (9, item)], "item_id long, text string")
    got = {r.doc_id: r for r in decontam.find_leaks(docs, bench).collect()}
    assert set(got) == {1, 2, 6} and got[1].distance == 0
    assert decontam.fold_only(texts[1][got[1].start : got[1].end]) == decontam.fold_only(item)
    assert texts[6][got[6].start : got[6].end] == item
    assert {r.doc_id for r in decontam.drop_leaks(docs, bench).collect()} == {3, 4, 5, 7}
    assert decontam.drop_leaks(docs, bench).columns == docs.columns


def test_several_passes_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(decontam, "PASS_CHARS", 60)
    items = [(i, f"item number {i} " + chr(97 + i) * 40) for i in range(5)]
    docs = spark.createDataFrame([(i, f"see {t} here") for i, t in items], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontam.find_leaks(docs, bench).collect()) == [(i, i) for i in range(5)]
    assert decontam.drop_leaks(docs, bench).count() == 0
    assert decontam.find_leaks(docs.limit(0), bench).count() == 0 and decontam.find_leaks(docs, bench.limit(0)).count() == 0
    assert decontam.drop_leaks(docs, bench.limit(0)).count() == 5


def test_short_items_match_as_whole_words(spark):
    texts = {1: "Q: what is  the capital of\nFrance? A: Paris", 2: "what is the capital of Francea", 3: "the cat sat on a mat", 4: "concatenate", 5: "what is the capitol of france?", 6: "Cat"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame([(1, "What is the capital of France?"), (2, "cat"), (3, " \n")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, texts[r.doc_id][r.start : r.end], r.distance) for r in decontam.find_leaks(docs, bench).collect()}
    assert got == {(1, 1, "what is  the capital of\nFrance?", 0), (3, 2, "cat", 0), (6, 2, "Cat", 0)}
    assert {r.doc_id for r in decontam.drop_leaks(docs, bench).collect()} == {2, 4, 5}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["İ", " ", "\n", "a", "Bc", "ß", "Σ"]), max_size=12).map("".join))
def test_places_of_folded_characters(text):
    out, places = decontam.fold(text)
    assert out == decontam.fold_only(text)
    places = list(range(len(text))) if places is None else places
    assert len(places) == len(out)
    assert all(c == " " and text[p].isspace() or c in (text[p].lower() + "ς") for c, p in zip(out, places, strict=True))


def test_places_after_letters_that_grow(spark):
    docs = spark.createDataFrame([(1, " İstanbul abc is a city"), (2, "abc")], "doc_id long, text string")
    got = decontam.find_leaks(docs, spark.createDataFrame([(1, "abc")], "item_id long, text string")).collect()
    assert {(r.doc_id, r.start, r.end) for r in got} == {(1, 10, 13), (2, 0, 3)}
