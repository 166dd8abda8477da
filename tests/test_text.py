"""Text functions on hand-made rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sedgewren.functions import approx, disclosure, perturb
from sedgewren.functions import text as T
from sedgewren.functions.lexicons import DIMENSIONS, Lexicons


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("text", ["Über café's don't stop", "a'b 'c' d_e", "x—y 1,2", "", None, "日本 語 é́"])
def test_tokens_are_those_of_python(spark, text):
    assert one(spark, T.tokens(F.col("t")), t=text) == re.findall(r"\b[\w']+\b", (text or "").lower())


def test_clean_text(spark):
    body = "see [this](http://a.b/c) &amp;amp; https://x.y now\n\n\n\nI am a bot, beep\nend    of  it\t\tx "
    assert one(spark, T.clean_text(F.col("a"), F.col("b")), a=" Title ", b=body) == "Title \n\nsee this &amp; [URL] now\n\nend of it x"
    assert one(spark, T.clean_text(F.col("a"), F.col("b")), a=None, b=None) == ""


def test_redaction(spark):
    out = one(spark, T.redact(F.col("t")), t="mail me@x.org call 555-123-4567 ask u/someone in r/place or @handle_1 at www.q.z")
    for token in ("[EMAIL]", "[PHONE]", "[USER]", "[SUB]", "[HANDLE]", "[URL]"):
        assert token in out
    assert "me@x.org" not in out


def test_strip_knows_all_white_space(spark):
    chars = [chr(c) for c in range(1, 0x3100)]
    frame = spark.createDataFrame([(f"{c} a{c}b {c}",) for c in chars] + [(None,), (" \u3000\n",)], "t string")
    got = frame.select("t", T.strip(F.col("t")).alias("s"), F.regexp_replace("t", r"(?U)^\s+|\s+$", "").alias("p")).collect()
    assert all(r.s == r.p for r in got) and sum(r.s is not None and r.s.startswith("a") and r.t[0] != "a" for r in got) == len(T.SPACES) and "regexp" not in str(T.strip(F.col("t")))


def test_what_spares_patterns_changes_nothing(spark):
    rng = random.Random(3)
    bits = ["&amp;", "&amp;lt;", "&#39;", "[a](b)", "](", "http://a.b", "https:// x", "www.q", "www. ", "\nI am a bot ha\n", "\n\n\n", "\n\n", "  ", "\t", "a@b.co", "@han_dle", "555-123-4567", "123", "12 345 6789", "/u/you", "u/me", "r/here", " ", "x", "é", "\r"]
    frame = spark.createDataFrame([("".join(rng.choice(bits) for _ in range(rng.randrange(12))),) for _ in range(3000)] + [(None,)], "t string")
    clean = F.col("t")
    for name, char in T.ENTITIES:
        clean = F.replace(clean, F.lit(name), F.lit(char))
    for pattern, new in ((T.MARKDOWN_LINK, "$1"), (T.URL, " [URL] "), (T.BOT_NOTICE, ""), (r"\n{3,}", "\n\n"), (r"[ \t]{2,}", " "), (r"(?U)^\s+|\s+$", "")):
        clean = F.regexp_replace(clean, pattern, new)
    plain = F.col("t")
    for pattern, token in ((T.URL, "URL"), (T.EMAIL, "EMAIL"), (T.PHONE, "PHONE"), (T.USER, "USER"), (T.COMMUNITY, "SUB"), (T.HANDLE, "HANDLE")):
        plain = F.regexp_replace(plain, pattern, f" [{token}] ")
    ours = T.normalize_whitespace(T.strip_bot_notices(T.strip_urls(T.strip_markdown(T.decode_entities(F.col("t"))))))
    assert frame.where(~ours.eqNullSafe(clean) | ~T.redact(F.col("t")).eqNullSafe(plain)).count() == 0


def test_tokens_keep_apostrophes_inside(spark):
    rng = random.Random(4)
    frame = spark.createDataFrame([("".join(rng.choice("ab_É1日'' -.") for _ in range(rng.randrange(16))),) for _ in range(2000)], "t string")
    slow = F.regexp_extract_all(F.lower("t"), F.lit(r"[\p{L}\p{N}_](?:[\p{L}\p{N}_']*[\p{L}\p{N}_])?"), F.lit(0))
    assert frame.where(T.tokens(F.col("t")) != slow).count() == 0


def test_pseudonym(spark):
    a, b = one(spark, T.pseudonym(F.col("t")), t="alice"), one(spark, T.pseudonym(F.col("t")), t="bob")
    assert a.startswith("u_") and len(a) == 14 and a != b and one(spark, T.pseudonym(F.col("t")), t=None) is None


def scores(spark, text):
    frame = spark.createDataFrame([(text,)], "t string").withColumn("w", T.tokens(F.col("t"), 800))
    return frame.select(*[c.alias(n) for n, c in T.lexicon_scores(F.col("t"), F.col("w"), Lexicons()).items()]).first()


def test_lexicon_scores(spark):
    assert scores(spark, "I have anxiety and panic, a panic attack").anxiety == 1.0
    s = scores(spark, "do i have cancer? please tell me, is this normal " + "word " * 190)
    assert s.health_anxiety == pytest.approx((1 + 1 + 1) / 2 / 3)
    assert tuple(scores(spark, "The weather was calm.")) == (0.0, 0.0, 0.0, 0.0)


def test_features_have_one_set_of_names(spark):
    frame = spark.createDataFrame([("I love my cat. You do?",), ("",), (None,)], "t string").withColumn("w", T.tokens(F.col("t")))
    rows = frame.select(*[c.alias(n) for n, c in T.feature_columns(F.col("t"), F.col("w")).items()]).collect()
    assert len(rows[0]) == 26 and rows[0].f_first_sing_rate > rows[0].f_third_rate and rows[0].f_n_sents == 2.0
    assert all(v == 0 for v in rows[1]) and tuple(rows[1]) == tuple(rows[2])


def test_dimensions(spark):
    frame = spark.createDataFrame([("webmd says chest pain, chest pain! should i go to the er",), ("",)], "t string").withColumn("w", T.dimension_tokens(F.col("t")))
    rows = frame.select(*[c.alias(n) for n, c in T.dimension_rates(F.col("t"), F.col("w")).items()]).collect()
    assert rows[0].bodily_vigilance == pytest.approx(2 / 12) and rows[0].medical_help_seeking > 0 and rows[0].symptom_checking > 0
    assert len(DIMENSIONS) == 7 and all(v == 0 for v in rows[1])


@pytest.mark.parametrize(("text", "gender", "age"), [("23f here", "F", 23), ("I'm a guy, 34 yo", "M", 34), ("as a woman and a man I am a man", None, None), ("m19", "M", 19), ("i am 12", None, None), ("nothing", None, None), ("25M and 30f", None, 25)])
def test_self_reports(spark, text, gender, age):
    assert one(spark, T.self_reported_gender(F.col("t")), t=text) == gender
    assert one(spark, T.self_reported_age(F.col("t")), t=text) == age


@pytest.mark.parametrize(
    ("text", "target", "found", "ruled"),
    [
        ("I was diagnosed with anxiety last spring", "anxiety", True, None), ("I've been diagnosed with generalized anxiety disorder", "anxiety", True, None), ("I have GAD", "anxiety", True, None), ("My doctor said I have anxiety", "anxiety", True, None),
        ("I'm on meds for anxiety", "anxiety", True, None), ("I was never told so and not diagnosed: i was diagnosed with anxiety", "anxiety", False, "negation"), ("What if I have panic disorder", "anxiety", False, "hypothetical"),
        ("my sister says i have panic disorder", "anxiety", False, "third_party"), ("i have health anxiety", "health_anxiety", True, None), ("I'm a hypochondriac", "health_anxiety", True, None), ("i am severely depressed", "depression", True, None),
        ("I have MDD", "depression", True, None), ("just kidding, I have depression", "depression", False, "denial"), ("", "anxiety", False, None), (None, "anxiety", False, None), ("I have anxiety", "unknown", False, None), ("i have suicidal thoughts", "suicidality", False, None),
        ("i have depression", "anxiety", False, None), ("no. " + "x" * 60 + " I have depression", "depression", True, None),
    ],
)
def test_disclosure(text, target, found, ruled):
    got = disclosure.detect(text, target)
    assert (got[0], got[2]) == (found, ruled) and (got[1] is not None) == found


def test_disclosure_frame(spark):
    frame = spark.createDataFrame([(1, "I have MDD"), (2, None), (3, "hello")], "id long, t string")
    rows = {r.id: r for r in disclosure.disclosure_labels(frame, "t").collect()}
    assert rows[1].disclosure_depression == 1 and rows[1].disclosure_depression_match == "I have MDD" and rows[1].disclosure_suicidality == 0
    assert rows[2].disclosure_anxiety == 0 and rows[3].disclosure_anxiety_match is None


def test_perturbations(spark):
    text = "Hello wonderful world, this is quite a sentence!"
    frame = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id long, t string")
    for name in perturb.PERTURBATIONS:
        a, b = ([r.x for r in frame.select(perturb.perturbed(name, F.col("t"), F.col("id"), 0.9).alias("x")).collect()] for _ in range(2))
        assert a == b and a[1] == "" and a[2] is None and len(a[0].split()) == len(text.split())
        assert a[0] != text
    assert one(spark, perturb.punct_strip(F.col("t")), t="a, b! c's") == "a b cs"


def test_approximations(spark):
    assert one(spark, approx.language_approx(F.col("t")), t="der Hund und die Katze sind nicht im Haus") == "de"
    assert one(spark, approx.language_approx(F.col("t")), t="xyzzy") == "en"
    assert one(spark, approx.fix_encoding_approx(F.col("t")), t="itâ€™s cafÃ©") == "it’s café"
    assert one(spark, approx.with_entities(F.col("t")), t="Ann") == "Ann"
    assert one(spark, approx.with_entities(F.col("t"), lambda ts: [[(0, 3, "PERSON")] for _ in ts]), t="Ann sat") == "[PERSON] sat"


def plain_edit(name, w, r, q):
    """Each edit on a Python string."""
    if name == "char_swap":
        i = int(r * (len(w) - 1))
        return w[:i] + w[i + 1] + w[i] + w[i + 2 :]
    if name == "char_delete":
        i = int(r * len(w))
        return w[:i] + w[i + 1 :]
    if name == "keyboard_typo":
        i = int(r * len(w))
        near = perturb.NEIGHBOURS.get(w[i].lower())
        return w if near is None else w[:i] + (near[int(q * len(near))].upper() if w[i].isupper() else near[int(q * len(near))]) + w[i + 1 :]
    if name == "social_elongate":
        vowels = [i for i, c in enumerate(w) if c.lower() in "aeiou"]
        if not vowels:
            return w
        i = vowels[int(r * len(vowels))]
        return w[:i] + w[i] * (2 + int(q * 2)) + w[i + 1 :]
    return "".join(c.swapcase() if len(c.swapcase()) == 1 else c for c in w)


def test_edits_equal_plain_ones(spark):
    import hashlib

    texts = ["Hello wonderful  World,\tthis is QUITE a\u00a0sentence! groß \u00c9t\u00e9 x \U0001f600 ok brr", "", None, " a ", "word " * 3000]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    least = {n: k for n, (_, k) in perturb.EDITS.items()}
    for name in perturb.EDITS:
        got = {r.id: r.x for r in frame.select("id", perturb.perturbed(name, F.col("t"), F.col("id"), 0.7).alias("x")).collect()}
        for i, text in enumerate(texts):
            if text is None:
                assert got[i] is None
                continue
            words = text.split()
            for at, w in enumerate(words):
                digest = hashlib.md5(f"42|{i}|{at}".encode()).hexdigest()
                u, r, q = (int(digest[k : k + 8], 16) / 2**32 for k in (0, 8, 16))
                if len(w) >= least[name] and u < 0.7:
                    words[at] = plain_edit(name, w, r, q)
            assert got[i] == " ".join(words)


def test_all_forms_come_from_one_reading(spark):
    """No row's text is cut into words or digested once for each form: the plan has one Python step, and forms equal single ones."""
    frame = spark.createDataFrame([(1, "Hello wonderful world of letters"), (None, "some other words"), (3, None), (4, "")], "id long, t string")
    both = perturb.all_perturbed(frame, "t", "id", 0.8)
    assert both._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    for name in perturb.PERTURBATIONS:
        single = [r.x for r in frame.select(perturb.perturbed(name, F.col("t"), F.col("id"), 0.8).alias("x")).collect()]
        assert [r[name] for r in both.collect()] == single


def test_vowel_groups_equal_a_count_for_each_word(spark):
    from pyspark.sql import functions as F

    from sedgewren.functions import text as T

    texts = ["banana table strength xyz", "", None, "Über d'été naïve queue a b", "education_1 rhythm 12 aeon ïï", "b"]
    w = T.once(spark.createDataFrame(list(enumerate(texts)), "i long, t string"), w=T.tokens(F.col("t")))
    each = F.transform("w", lambda x: F.regexp_count(x, F.lit("[aeiouyäöüéèêáíóú]+")))
    v = T.once(w, v=T.vowel_groups(F.col("w")))
    got = v.select(T.syllables(F.col("v")).alias("a"), T.hard_words(F.col("v")).alias("b"), F.aggregate(each, F.lit(0), lambda s, n: s + F.greatest(n, F.lit(1))).alias("c"), F.size(F.filter(each, lambda n: n >= 3)).alias("d")).collect()
    assert [(r.a, r.b) for r in got] == [(r.c, r.d) for r in got] and got[0].a == 7
