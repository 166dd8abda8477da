"""The name labeller and syllables by patterns."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from sedgewren.functions import hyphen
from sedgewren.functions.approx import with_entities
from sedgewren.operators import names


def test_viterbi_equals_all_sequences():
    rng = random.Random(3)
    words = ["My", "name", "is", "Ann", "."]
    pool = {f for i in range(len(words)) for f in names.features(words, i)}
    for _ in range(20):
        tagger = names.Tagger({f: tuple(rng.uniform(-1, 1) for _ in names.TAGS) for f in pool}, tuple(tuple(rng.uniform(-1, 1) for _ in names.TAGS) for _ in names.TAGS))
        score = lambda tags: sum(tagger.weights[f][t] for i, t in enumerate(tags) for f in names.features(words, i)) + sum(tagger.follow[a][b] for a, b in itertools.pairwise(tags))  # noqa: E731, B023
        best = max(itertools.product(range(4), repeat=len(words)), key=score)
        assert names.viterbi(words, tagger) == list(best)


def test_unseen_names_are_found():
    held_out = names.made_sentences(500, 7, True)
    seen = {w for s, tags in names.made_sentences() for w, t in zip(s, tags, strict=True) if t != "O"}
    assert any(w not in seen for s, tags in held_out for w, t in zip(s, tags, strict=True) if t != "O")
    tagger = names.default_tagger()
    precision, recall = names.precision_recall([[names.TAGS[t] for t in names.viterbi(s, tagger)] for s, _ in held_out], [tags for _, tags in held_out])
    assert precision > 0.9 and recall > 0.9


def test_texts_are_redacted_whole(spark):
    texts = ["My name is Laura Bianchi and I live in Saudi Arabia.", "he is fine , and so am i", None, "", "no names here . " * 3000 + "I met Dr. Hofmann in Argentina .", "!!! 123 ???"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")
    tagger = names.default_tagger()
    got = [r[0] for r in frame.select(names.redact_names(F.col("t"), tagger)).collect()]
    assert got[0] == "My name is [PERSON] and I live in [LOC]." and got[1:4] == texts[1:4] and got[4].endswith("I met Dr. [PERSON] in [LOC] .") and got[5] == texts[5]
    assert [r[0] for r in frame.select(with_entities(F.col("t"), names.recogniser(tagger), 1_000_000)).collect()] == got


def test_fit_of_a_frame_is_bounded(spark):
    rows = [(i, w, t) for i, (w, t) in enumerate(names.made_sentences(400))] + [(900, ["a"], ["O", "O"]), (901, None, None)]
    tagger = names.fit_names(spark.createDataFrame(rows, "id long, words array<string>, tags array<string>"), "id", "words", "tags", rows=300)
    assert names.spans("my name is Anna and I live in London", tagger) == [(11, 15, "PERSON"), (30, 36, "LOC")]
    assert names.fit([]) == names.Tagger({}, ((0.0,) * 4,) * 4)


PATTERNS = ["% comment", "UTF-8", "LEFTHYPHENMIN 2", ".hy3ph", "he2n", "hena4", "hen5at", "1na", "n2at", "1tio", "2io", "o2n", "1ba", "1na", "a1b", "", "plain"]


def test_syllables_by_hand():
    patterns = hyphen.read_patterns(PATTERNS, ["ta-ble", "as-so-ciate"])
    # hy-phen-ation: the classic example.
    assert hyphen.syllables("hyphenation", patterns) == 3
    assert hyphen.syllables("banana", patterns) == 3 and hyphen.syllables("table", patterns) == 2 and hyphen.syllables("associate", patterns) == 3
    assert hyphen.syllables("catharsis", hyphen.read_patterns(["2th", "t3h", "1th"])) == 2
    assert [hyphen.syllables(w, patterns) for w in ("", "a", "ba", "aba", "xyz")] == [1, 1, 1, 1, 1]


def test_readability(spark):
    patterns = hyphen.read_patterns(["1ba", "1na"])
    rows = spark.createDataFrame([(0, "banana banana bar. Banana hut!"), (1, "short"), (2, None), (3, "12 !! ?? 34 .. ,, ;; 56 ..")], "i int, t string")
    words = F.regexp_extract_all(F.lower(F.coalesce("t", F.lit(""))), F.lit("[a-z]+"), 0)
    wide = rows.select("i", "t", words.alias("w")).withColumn("s", hyphen.syllable_counts(F.col("w"), patterns, ["bananas"]))
    got = {r.i: r for r in wide.select("i", "s", *[c.alias(n) for n, c in hyphen.readability(F.col("t"), F.col("w"), F.col("s")).items()]).collect()}
    assert tuple(got[0].s) == (11, 3)
    assert got[0].f_flesch == pytest.approx(206.835 - 1.015 * 2.5 - 84.6 * 11 / 5) and got[0].f_gunning_fog == pytest.approx(0.4 * (2.5 + 60))
    assert all((got[i].f_flesch, got[i].f_gunning_fog) == (0, 0) for i in (1, 2, 3))


def test_the_decoder_finds_what_viterbi_finds():
    tagger = names.default_tagger()
    decoder, rng = names.Decoder(tagger), random.Random(2)
    sentences = [w for w, _ in names.made_sentences(300, 7, True)] + [[], ["."], ["Ann"]]
    mixed = [w for s in sentences for w in s]
    sentences += [[rng.choice([*mixed, "É", "x,y", "9", "İ"]) for _ in range(rng.randrange(60))] for _ in range(200)]
    assert all(decoder.tags(s) == names.viterbi(s, tagger) for s in sentences)
    assert len(decoder.memo) < 5_000  # a word's own figures are worked out once


def test_texts_together_have_the_tags_and_spans_of_single_ones(monkeypatch):
    tagger, rng = names.default_tagger(), random.Random(5)
    words = [w for s, _ in names.made_sentences(300, 7, True) for w in s] + ["É", "x,y", "9", "İ", "don’t", "^", "$", "e-mail", "\x1c", "\xa0", "\x85", "日本", "²", "a\u0301"]
    texts = ["", None, " ", "Ann", "Ann\nSmith", "Ann  Smith", "Ann-Smith of Oslo"] + [rng.choice(["", " "]) + rng.choice([" ", "  ", "\t", ""]).join(rng.choice(words) for _ in range(rng.randrange(90))) for _ in range(300)]
    for places, chars in ((1 << 18, 1 << 24), (200, 500)):
        monkeypatch.setattr(names.BatchDecoder, "PLACES", places)
        monkeypatch.setattr(names.BatchDecoder, "CHARS", chars)
        batch = names.BatchDecoder(tagger)
        assert list(batch.spans(texts)) == [names.spans(t or "", tagger) for t in texts]
        found = [names.regex.findall(names.TOKEN, t or "") for t in texts]
        assert [t.tolist() for t in batch.tags([batch.numbered(w) for w in found])] == [names.viterbi(w, tagger) for w in found]


def test_any_weights_give_the_tags_of_viterbi():
    rng = random.Random(6)
    sentences = [[rng.choice(["My", "name", "is", "Ann", ".", "^", "$", "NATO", "x1", "iPod", "7"]) for _ in range(rng.randrange(1, 12))] for _ in range(40)]
    pool = sorted({f for s in sentences for i in range(len(s)) for f in names.features(s, i)})
    for step in (1.0, 0.37):  # whole numbers make many equal sums
        tagger = names.Tagger({f: tuple(step * rng.randrange(-2, 3) for _ in names.TAGS) for f in pool if rng.random() < 0.7}, tuple(tuple(step * rng.randrange(-2, 3) for _ in names.TAGS) for _ in names.TAGS))
        batch = names.BatchDecoder(tagger)
        assert [t.tolist() for t in batch.tags([batch.numbered(s) for s in sentences])] == [names.viterbi(s, tagger) for s in sentences]


def test_words_that_look_alike_have_one_number():
    batch = names.BatchDecoder(names.default_tagger())
    batch.numbered([f"{a}{b}{c}xqz" for a in "bcdfghjk" for b in "bcdfghjk" for c in "bcdfghjk"])
    assert len(batch.numbers) == 512 and len(batch.numbers.kinds) == 1
