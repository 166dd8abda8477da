"""Text functions as column expressions: cleaning, redaction, tokens, lexicon rates, self-reports."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lexicons import DIMENSIONS, Lexicons

# The patterns of cleaning and redaction.
MARKDOWN_LINK = r"\[([^\]]+)\]\(([^)]+)\)"
URL = r"https?://\S+|www\.\S+"
BOT_NOTICE = r"(?im)^\*?I am a bot.*$|^\*?This action was performed automatically.*$"
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"))
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONE = r"\b(?:\+?\d{1,3}[\s.-]?)?(?:\(?\d{2,4}\)?[\s.-]?)?\d{3,4}[\s.-]?\d{3,4}\b"
USER = r"\b(?:/u/|u/)[A-Za-z0-9_-]+\b"
COMMUNITY = r"\b/?r/[A-Za-z0-9_-]+\b"
HANDLE = r"(?<![A-Za-z0-9])@[A-Za-z0-9_]{2,}\b"
#: Without one of these (or such digits) a text holds nothing of the kind.
NEEDED = {"URL": ["http", "www."], "EMAIL": ["@"], "PHONE": lambda t: t.rlike(r"\d{3}"), "USER": ["u/"], "SUB": ["r/"], "HANDLE": ["@"]}
SALT = "anxiety-research-v1"
AGE_SEX = r"(?i)\b(\d{2})\s?([mf])\b|\b([mf])\s?(\d{2})\b"
GENDER = r"(?i)\b(?:i am|i'?m|as)\s+a\s+(?:\d{1,2}\s+year[- ]old\s+)?(man|woman|male|female|guy|girl|dude|lady)\b"
AGE = r"(?i)\b(\d{1,2})\s?(?:years?[- ]old|yo|y/o)\b|\b(?:i am|i'?m)\s+(\d{1,2})\b"
MALE = ("man", "male", "guy", "dude")


def once(frame: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once for each row, whatever filters and projections read them later.

    Catalyst pushes filters through projections by repeating what they read, which would clean or tokenise a
    text several times. It does not push them through a generator, so the columns come out of one.
    """
    names = [c for c in frame.columns if c not in columns]
    return frame.select(*names, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def known(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


#: Unicode's white space.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Trims all white space (trim() knows the space alone) without a pattern, which would be tried at each character."""
    return F.btrim(text.cast("string"), F.lit(SPACES))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of the value, which is worked out once however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def where_found(text: Column, found: Sequence[str] | Callable[[Column], Column], change: Callable[[Column], Column]) -> Column:
    """A change of texts that hold one of the literals (or meet the condition); the others, which it would leave alone, are spared its patterns."""
    test = found if callable(found) else lambda t: reduce(or_, (F.contains(t, F.lit(f)) for f in found))
    return bound(text, lambda t: F.when(test(t), change(t)).otherwise(t))


def decode_entities(text: Column) -> Column:
    """Five entities, one after the other, so a doubly encoded one is decoded twice."""

    def decode(t: Column) -> Column:
        for name, char in ENTITIES:
            t = F.replace(t, F.lit(name), F.lit(char))
        return t

    return where_found(text, ["&"], decode)


def strip_markdown(text: Column) -> Column:
    return where_found(text, ["]("], lambda t: F.regexp_replace(t, MARKDOWN_LINK, "$1"))


def strip_urls(text: Column) -> Column:
    return where_found(text, NEEDED["URL"], lambda t: F.regexp_replace(t, URL, " [URL] "))


def strip_bot_notices(text: Column) -> Column:
    return F.regexp_replace(text, BOT_NOTICE, "")


def normalize_whitespace(text: Column) -> Column:
    text = where_found(text, ["\n\n\n"], lambda t: F.regexp_replace(t, r"\n{3,}", "\n\n"))
    return strip(where_found(text, ["  ", "\t\t", " \t", "\t "], lambda t: F.regexp_replace(t, r"[ \t]{2,}", " ")))


def clean_text(title: Column, body: Column) -> Column:
    """Title and body, decoded, without markup, addresses and notices, in tidy white space."""
    full = strip(F.concat(known(title), F.lit("\n\n"), known(body)))
    return normalize_whitespace(strip_bot_notices(strip_urls(strip_markdown(decode_entities(full)))))


def redact(text: Column) -> Column:
    """Addresses, phones, user names and community names become tokens, in this order."""
    for pattern, token in ((URL, "URL"), (EMAIL, "EMAIL"), (PHONE, "PHONE"), (USER, "USER"), (COMMUNITY, "SUB"), (HANDLE, "HANDLE")):
        text = where_found(text, NEEDED[token], lambda t, p=pattern, new=f" [{token}] ": F.regexp_replace(t, p, new))
    return text


def pseudonym(author: Column, salt: str = SALT) -> Column:
    """A stable salted pseudonym; null stays null. The name cannot be read back from any output of this library."""
    return F.concat(F.lit("u_"), F.substring(F.sha2(F.concat(F.lit(salt + "|"), author.cast("string")), 256), 1, 12))


def tokens(text: Column, most: int | None = None) -> Column:
    """Lower-case words of letters, numbers and underscores with the apostrophes inside them; the first ``most``."""
    found = F.regexp_extract_all(F.lower(known(text)), F.lit(r"[\p{L}\p{N}_]++(?:'++[\p{L}\p{N}_]++)*+"), F.lit(0))
    return F.slice(found, 1, most) if most else found


def sentences(text: Column) -> Column:
    return F.filter(F.split(strip(known(text)), r"[.!?]+\s+|\n+"), lambda s: s.rlike(r"(?U)\S"))


def token_hits(words: Column, terms: Iterable[str]) -> Column:
    listed = sorted(set(terms))
    return F.size(F.filter(words, lambda w: w.isin(listed))) if listed else F.lit(0)


def phrase_hits(lower: Column, phrases: Iterable[str]) -> Column:
    """How many different phrases stand in the text."""
    total = F.lit(0)
    for phrase in sorted(set(phrases)):
        total = total + F.contains(lower, F.lit(phrase)).cast("int")
    return total


def per_hundred(hits: Column, n: Column) -> Column:
    """Hits per hundred tokens, full at three."""
    return F.least(F.lit(1.0), hits / F.greatest(F.lit(1.0), n / 100.0) / 3.0)


def lexicon_scores(text: Column, words: Column, lex: Lexicons) -> dict[str, Column]:
    """The four scores of a text whose (cut) tokens are ``words``; phrases are looked for in the whole text."""
    lower, n = F.lower(known(text)), F.greatest(F.lit(1), F.size(words))
    hits = {
        "anxiety": token_hits(words, lex.anxiety_terms) + phrase_hits(lower, lex.anxiety_phrases),
        "health_anxiety": token_hits(words, lex.health_terms) + phrase_hits(lower, lex.health_phrases) + F.floor(phrase_hits(lower, lex.reassurance) / 2),
        "depression": token_hits(words, lex.depression_terms),
        "suicidality": token_hits(words, lex.suicidality_terms),
    }
    return {k: per_hundred(v, n) for k, v in hits.items()}


FEATURE_GROUPS = ("lexical", "pronoun", "certainty", "length", "readability", "sentiment")


VOWELS = "aeiouyäöüéèêáíóú"


def vowel_groups(words: Column) -> Column:
    """The words of ``tokens`` joined by spaces, each group of vowels and what is before it as +: one pass over a text instead of several for each word. Pass it on as a column."""
    return F.regexp_replace(F.array_join(words, " "), f"[^{VOWELS} ]*+[{VOWELS}]++", "+")


def syllables(groups: Column) -> Column:
    """Groups of vowels in all words, at least one each (``groups`` as of ``vowel_groups``)."""
    return occurrences(groups, "+").cast("long") + F.regexp_count(groups, F.lit("(?:^| )[^+ ]"))


def hard_words(groups: Column) -> Column:
    """Words of three groups of vowels or more."""
    return F.regexp_count(groups, F.lit(r"\+{3,}"))


def feature_columns(text: Column, words: Column, lex: Lexicons | None = None, groups: Sequence[str] = FEATURE_GROUPS, vowels: Column | None = None, n_sents: Column | None = None) -> dict[str, Column]:
    """The style features of a text and its tokens; pass ``words`` (and ``vowels``, its ``vowel_groups``, and ``n_sents``, the number of sentences) as columns so that they are made once.

    Readability follows the published formulas with counted vowel groups for syllables (hence _approx).
    Sentiment needs a valence lexicon that is not at hand, and is zero, as without its library.
    """
    lex = lex or Lexicons()
    whole, lower = known(text), F.lower(known(text))
    n = F.greatest(F.lit(1), F.size(words)).cast("double")
    rate = lambda terms: token_hits(words, terms) / n
    out: dict[str, Column] = {}
    if "lexical" in groups:
        out |= {
            "f_anx_term_rate": rate(lex.anxiety_terms), "f_anx_phrase_count": phrase_hits(lower, lex.anxiety_phrases).cast("long"),
            "f_health_anx_term_rate": rate(lex.health_terms), "f_health_anx_phrase_count": phrase_hits(lower, lex.health_phrases).cast("long"),
            "f_reassurance_count": phrase_hits(lower, lex.reassurance).cast("long"), "f_dep_term_rate": rate(lex.depression_terms),
            "f_suic_term_rate": rate(lex.suicidality_terms), "f_body_part_rate": rate(lex.body_parts),
        }
    if "pronoun" in groups:
        out |= {"f_first_sing_rate": rate(lex.first_singular), "f_first_plur_rate": rate(lex.first_plural), "f_second_rate": rate(lex.second_person), "f_third_rate": rate(lex.third_person)}
    if "certainty" in groups:
        for name, terms in (("f_uncertainty_rate", lex.uncertainty), ("f_certainty_rate", lex.certainty)):
            out[name] = (token_hits(words, terms) + phrase_hits(lower, terms)) / n
        out["f_question_rate"] = F.regexp_count(whole, F.lit(r"\?")) / n
    n_sents = F.size(sentences(text)) if n_sents is None else n_sents
    letters = F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.length(w).cast("long"))
    if "length" in groups:
        out |= {
            "f_n_chars": F.length(whole).cast("double"), "f_n_tokens": F.size(words).cast("double"), "f_n_sents": n_sents.cast("double"),
            "f_avg_sent_len": F.coalesce(F.try_divide(F.size(words).cast("double"), n_sents), F.lit(0.0)),
            "f_avg_word_len": F.coalesce(F.try_divide(letters.cast("double"), F.size(words)), F.lit(0.0)),
        }
    if "readability" in groups:
        per_sentence = F.size(words) / F.greatest(F.lit(1), n_sents)
        vowels = vowel_groups(words) if vowels is None else vowels
        per_word, hard = syllables(vowels) / n, hard_words(vowels) / n
        short = F.length(whole) < 20
        out["f_flesch_approx"] = F.when(short, 0.0).otherwise(206.835 - 1.015 * per_sentence - 84.6 * per_word)
        out["f_gunning_fog_approx"] = F.when(short, 0.0).otherwise(0.4 * (per_sentence + 100 * hard))
    if "sentiment" in groups:
        out |= {f"f_sent_{k}": F.lit(0.0) for k in ("compound", "pos", "neg", "neu")}
    return out


def occurrences(text: Column, term: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return (F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / F.lit(len(term))


def dimension_rates(text: Column, words: Column, dimensions: dict[str, tuple[str, ...]] | None = None) -> dict[str, Column]:
    """Of each dimension, hits per token. ``words`` are ``dimension_tokens``; entries with space or hyphen are looked for in the text."""
    lower = F.lower(known(text))
    n = F.greatest(F.lit(1), F.size(words)).cast("double")
    out = {}
    for name, terms in (dimensions or DIMENSIONS).items():
        plain = [t for t in terms if " " not in t and "-" not in t]
        hits = token_hits(words, plain).cast("double")
        for term in sorted(set(terms) - set(plain)):
            hits = hits + occurrences(lower, term)
        out[name] = hits / n
    return out


def dimension_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(known(text)), F.lit("[a-z']+"), F.lit(0))


def groups_of(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(known(text), F.lit(pattern), F.lit(group))


def self_reported_gender(text: Column) -> Column:
    """M or F if the text reports one and no other, else null."""
    tags = F.transform(F.concat(groups_of(text, AGE_SEX, 2), groups_of(text, AGE_SEX, 3)), F.upper)
    named = F.transform(groups_of(text, GENDER, 1), lambda w: F.when(F.lower(w).isin(*MALE), "M").otherwise("F"))
    found = F.array_distinct(F.filter(F.concat(tags, named), lambda x: x != ""))
    return F.when(F.size(found) == 1, F.get(found, 0))


def self_reported_age(text: Column) -> Column:
    """The first age from 13 to 99: those beside a sex first, then those of phrases."""
    pairs = [F.zip_with(groups_of(text, p, a), groups_of(text, p, b), lambda x, y: F.when(x != "", x).otherwise(y)) for p, a, b in ((AGE_SEX, 1, 4), (AGE, 1, 2))]
    ages = F.transform(F.filter(F.concat(*pairs), lambda x: x != ""), lambda x: x.cast("int"))
    return F.get(F.filter(ages, lambda a: (a >= 13) & (a <= 99)), 0)


def age_band(age: Column) -> Column:
    return F.when(age < 25, "<25").when(age < 35, "25-34").when(age.isNotNull(), "35+")


def term_pattern(terms: Iterable[str]) -> str:
    """Longest first; phrases as they are, words between word boundaries."""
    ordered = sorted(set(terms), key=lambda t: (-len(t), t))
    quoted = [re.sub(r"([\\.\[\]{}()*+?^$|#&~])", r"\\\1", t) for t in ordered]
    return "|".join(q if " " in t or "-" in t else rf"\b{q}\b" for t, q in zip(ordered, quoted, strict=True))


def mask_terms(text: Column, terms: Iterable[str]) -> Column:
    return F.regexp_replace(known(text), "(?i)" + term_pattern(terms), " ")


def count_terms(text: Column, terms: Iterable[str]) -> Column:
    return F.regexp_count(F.lower(known(text)), F.lit(term_pattern(terms)))


# The two cuts between three periods, 2020-03-11 and 2022-05-01 UTC.
PERIODS = ((1583884800, "pre"), (1651363200, "pandemic"))


def period(seconds: Column, last: str = "post") -> Column:
    """Right-closed periods of a time in Unix seconds."""
    out = None
    for cut, name in PERIODS:
        out = F.when(seconds <= cut, name) if out is None else out.when(seconds <= cut, name)
    return out.when(seconds.isNotNull(), last)


def hour_of(seconds: Column) -> Column:
    return F.floor(seconds / 3600) % 24


def weekday_of(seconds: Column) -> Column:
    """0 is the weekday of the epoch's first day, a Thursday."""
    return F.floor(seconds / 86400) % 7


def binarise(score: Column, cut: float = 0.5) -> Column:
    return (F.coalesce(score.cast("double"), F.lit(0.0)) >= cut).cast("long")


def level(score: Column, cuts: Sequence[float] = (0.1, 0.3, 0.5)) -> Column:
    """Ordinal level: how many cuts the score reaches."""
    total = F.lit(0)
    for cut in cuts:
        total = total + (score >= cut).cast("int")
    return F.when(score.isNotNull(), total).cast("long")


def vote(score: Column, high: float, low: float) -> Column:
    """1, 0, or -1 to abstain; the low cut wins where both hold."""
    return F.when(score <= low, 0).when(score >= high, 1).otherwise(-1).cast("long")


def logit(p: Column, eps: float = 1e-6) -> Column:
    p = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.log(p / (1 - p))


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def slug(query: Column) -> Column:
    """A file name of a search query."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(query), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, 80)


def first_object(text: Column) -> Column:
    """The widest {...} of an answer, fenced or not."""
    return F.regexp_extract(known(text), r"(?s)\{.*\}", 0)


def verdict(text: Column) -> Column:
    """1 or 0 by which of yes and no comes first as a word, else null."""
    lower = F.lower(known(text))
    yes, no = F.regexp_instr(lower, F.lit(r"\byes\b")), F.regexp_instr(lower, F.lit(r"\bno\b"))
    return F.when((yes > 0) & ((no == 0) | (yes < no)), 1).when(no > 0, 0)
