"""Named approximations of functions whose reference libraries are not at hand."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, known, token_hits, tokens

# Frequent words by language.
STOP_WORDS = {
    "en": "the and of to in is that it for was on with as are be this by from at or".split(),
    "fr": "le la les de des et un une est que qui dans pour sur avec pas du au en ce".split(),
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als".split(),
    "es": "el la los las de que y en un una por con para del se no al lo como es".split(),
}


def language_approx(text: Column) -> Column:
    return language_of(tokens(text))


def language_of(words: Column) -> Column:
    """The language whose frequent words occur most among the tokens; English on ties with it and where none occurs."""
    listed = sorted({w for s in STOP_WORDS.values() for w in s})
    scores = lambda some: F.array(*[F.struct(token_hits(some, s).alias("n"), F.lit(1 if code == "en" else 0).alias("first"), F.lit(code).alias("code")) for code, s in STOP_WORDS.items()])
    return F.coalesce(bound(F.filter(words, lambda w: w.isin(listed)), lambda some: F.array_max(scores(some))["code"]), F.lit("en"))


# The 27 characters that Windows-1252 has in the place of control codes 0x80 to 0x9F.
WINDOWS = {c: i for i in range(0x80, 0xA0) if (c := bytes([i]).decode("cp1252", "replace")) != "\ufffd"}


def as_byte(char: str) -> int:
    """The byte that was misread as this character; codes that Windows-1252 leaves open stand for themselves."""
    return WINDOWS.get(char, ord(char))


TRAIL = "\x80-\xbf" + "".join(WINDOWS)
#: Misread characters: a lead byte and the bytes that it asks for.
MISREAD = re.compile(f"[\xc2-\xdf][{TRAIL}]|[\xe0-\xef][{TRAIL}]{{2}}|[\xf0-\xf4][{TRAIL}]{{3}}")
#: Lead bytes that are no likely letters before a sign: of Latin-1 and Latin Extended-A, general punctuation, full-width forms, emoji.
SURE = "\xc2\xc3\xc4\xc5\xe2\xef\xf0"
RUN = re.compile(f"(?:{MISREAD.pattern})+")


def reread(run: str) -> str:
    """A run of misread characters as it was meant; one that is not UTF-8 after all, or a single one with an unlikely lead, stays."""
    parts = MISREAD.findall(run)
    out = []
    for part in parts:
        meant = None
        if len(parts) > 1 or part[0] in SURE:
            try:
                meant = bytes(map(as_byte, part)).decode("utf-8")
            except UnicodeDecodeError:
                meant = None
        out.append(part if meant is None else meant)
    return "".join(out)


def repaired(text: str) -> str:
    """Passages that were UTF-8 read as Windows-1252 or Latin-1 are read again, wherever they stand and as often as they were misread.

    What is right stays: bytes that form no character, and single letters beyond Latin before a closing quotation mark
    (``CAF\xc9\xbb``). Each pass shortens the text, so this ends.
    """
    while True:
        again = RUN.sub(lambda m: reread(m.group()), text)
        if again == text:
            return text
        text = again


def fix_encoding_approx(text: Column) -> Column:
    """Repairs texts that look misread; Python sees only those."""

    @F.pandas_udf("string")
    def fix(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else repaired(t))

    odd = known(text).rlike(f"[\\x{{C2}}-\\x{{F4}}][\\x{{80}}-\\x{{BF}}{''.join(WINDOWS)}]")
    return F.when(odd, fix(F.when(odd, text))).otherwise(text)


def with_entities(text: Column, recogniser: Callable[[list[str]], list[list[tuple[int, int, str]]]] | None = None, most: int = 5000) -> Column:
    """Names replaced by their kind in the first ``most`` characters; without a recogniser the text stays as it is."""
    if recogniser is None:
        return text

    @F.pandas_udf("string")
    def replace(texts: pd.Series) -> pd.Series:
        heads = [(t or "")[:most] for t in texts]
        out = []
        for t, head, spans in zip(texts, heads, recogniser(heads), strict=True):
            for a, b, kind in sorted(spans, reverse=True):
                head = f"{head[:a]}[{kind}]{head[b:]}"
            out.append(None if t is None else head + t[most:])
        return pd.Series(out, dtype=object)

    return replace(text)
