"""Language profiles and encoding repair."""

import random

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from sedgewren.functions.approx import fix_encoding_approx, repaired
from sedgewren.operators.language import WORD, Detector, Profiles, fit_profiles, gram_rows, language_by_profile

TEXTS = [
    ("en", "the quick brown fox jumps over the lazy dog and runs through the forest with its friends"), ("en", "there is nothing that we could have done about this weather"), ("en", "she thinks that they should leave before night"),
    ("de", "der schnelle braune Fuchs springt über den faulen Hund und läuft durch den Wald"), ("de", "wir konnten gegen dieses Wetter nichts machen"), ("de", "sie denkt dass sie vor der Nacht gehen sollten"),
    ("fr", "le renard brun saute par dessus le chien paresseux et court dans la forêt"), ("fr", "nous ne pouvions rien faire contre ce temps"), ("fr", "elle pense qu'ils devraient partir avant la nuit"),
]


def test_grams(spark):
    got = spark.createDataFrame([(["ab", "c"],)], "w array<string>").select(gram_rows(F.col("w"))).first()[0]
    assert got == [" ", "a", "b", " ", " a", "ab", "b ", " ab", "ab ", " ", "c", " ", " c", "c ", " c "]


def test_unseen_texts(spark):
    rows = spark.createDataFrame([(i, *r, "x") for i, r in enumerate(TEXTS)] + [(90, "xx", "rare one", "x"), (91, None, "none", "x"), (92, "en", None, "x")], "id long, lang string, text string, k string")
    profiles = fit_profiles(rows, "id", "text", "lang")
    assert profiles.codes == ("de", "en", "fr") and len(profiles.grams) < 3 * 3000
    cases = [("the weather was nice", "en"), ("das Wetter war schön und der Hund schläft", "de"), ("le temps était beau dans la forêt", "fr"), ("", "en"), (None, "en"), ("123 !?", "en"), ("der Hund " * 40_000, "de")]
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    assert [r[0] for r in frame.orderBy("i").select(language_by_profile(F.col("t"), profiles)).collect()] == [c for _, c in cases]


def test_counted_grams_equal_sums_over_words(monkeypatch):
    rng = random.Random(4)
    letters = "abcdeéßи日𐐨"
    grams = {"".join(rng.choice(letters + " ") for _ in range(rng.randrange(1, 4))) for _ in range(300)}
    profiles = Profiles(("de", "en", "fr"), {g: tuple(-rng.random() * 9 for _ in range(3)) for g in sorted(grams)}, (-9.5, -9.25, -9.125))
    texts = ["".join(rng.choice(letters + "zÜ  '1\u0301\n") for _ in range(rng.randrange(80))) for _ in range(200)] + ["a", " a ", "a b", "a'b", "İa", "12"]
    for dense, piece in ((1 << 22, 1 << 20), (1, 7)):
        monkeypatch.setattr(Detector, "DENSE", dense)
        monkeypatch.setattr(Detector, "PIECE", piece)
        detector = Detector(profiles)
        for text in texts:
            wholes = [f" {w} " for w in regex.findall(WORD, text.lower())]
            rows = [profiles.grams.get(w[i : i + n], profiles.unknown) for w in wholes for n in (1, 2, 3) for i in range(len(w) - n + 1)]
            best = max((1, 0, 2), key=lambda i: round(sum(r[i] for r in rows), 6))  # noqa: B023
            assert detector.language(text) == ("en" if not rows else profiles.codes[best])
            if piece > 7:
                found = detector.figures(text.lower())
                assert found is None if not rows else np.allclose(found, np.sum(rows, axis=0))


def test_words_that_no_text_repeats_cost_no_more_than_others(monkeypatch):
    looks = []

    class Counted(dict):
        def get(self, *at):
            looks.append(at)
            return super().get(*at)

        def __getitem__(self, at):
            looks.append(at)
            return super().__getitem__(at)

    detector = Detector(Profiles(("de", "en"), Counted({"a": (-1.0, -2.0), "e": (-2.0, -1.0)}), (-5.0, -5.0)))
    before = len(looks)
    assert detector.language(" ".join(f"a{a}{b}" for a in "bcdfghjk" for b in "bcdfghjk")) == "de" and len(looks) == before


def test_without_rows(spark):
    profiles = fit_profiles(spark.createDataFrame([], "id long, lang string, text string"), "id", "text", "lang")
    assert profiles == Profiles((), {}, ())
    assert spark.createDataFrame([("der Hund",)], "t string").select(language_by_profile(F.col("t"), profiles)).first()[0] == "en"


def misread(text, times=1):
    for _ in range(times):
        out = ""
        for byte in text.encode():
            try:
                out += bytes([byte]).decode("cp1252")
            except UnicodeDecodeError:
                out += chr(byte)
        text = out
    return text


@pytest.mark.parametrize("times", [1, 2, 3])
@pytest.mark.parametrize("text", ["café", "it’s “fine” – really…", "naïve façade, Übergröße, señor", "price: 5 €", "smile 😀!", "Привет мир", "日本語テキスト", "plain", ""])
def test_layers_come_off(text, times):
    assert repaired(misread(text, times)) == text


@pytest.mark.parametrize("text", ["café", "«CAFÉ»", "Ñandú", "5 € – „gut“ …", "Â", "Ã", "à la carte", "ÉÈ", "Ωμέγα", "ß", "x² + y³"])
def test_what_is_right_stays(text):
    assert repaired(text) == text


def test_parts_of_a_text_and_bytes_that_are_none(spark):
    assert repaired(f"é und {misread('é')} und {misread('’', 2)}") == "é und é und ’"
    assert repaired("ÃÃ©Ã") == "ÃéÃ"
    rows = spark.createDataFrame([(0, "café " + misread("café")), (1, None), (2, ""), (3, misread("ä") * 100_000)], "i int, t string")
    assert [r[0] for r in rows.orderBy("i").select(fix_encoding_approx(F.col("t"))).collect()] == ["café café", None, "", "ä" * 100_000]
