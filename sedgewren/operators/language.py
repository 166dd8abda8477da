"""Language identification by character n-gram profiles, fitted on a bounded sample of labelled texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .audit import capped_sample

#: Maximal runs of letters.
WORD = r"\p{L}+"
SIZES = (1, 2, 3)


@dataclass(frozen=True)
class Profiles:
    """Of each language, in the order of ``codes``: the logarithm of each n-gram's share, and that of an unknown one."""

    codes: tuple[str, ...]
    grams: dict[str, tuple[float, ...]]
    unknown: tuple[float, ...]
    default: str = "en"


def grams_of(word: Column, n: int) -> Column:
    whole = F.concat(F.lit(" "), word, F.lit(" "))
    return F.transform(F.sequence(F.lit(1), F.length(word) + 3 - n), lambda i: F.substring(whole, i, F.lit(n)))


def gram_rows(words: Column) -> Column:
    """All n-grams of words (an array) with a space at both ends."""
    return F.flatten(F.transform(words, lambda w: F.concat(*[grams_of(w, n) for n in SIZES])))


def fit_profiles(frame: DataFrame, key: str, text: str, lang: str, rows: int = 2_000, grams: int = 3_000, languages: int = 200, least: int = 3, default: str = "en", seed: int = 42) -> Profiles:
    """Counts n-grams of up to ``rows`` texts of each language (drawn by hash), and keeps the ``grams`` most frequent ones of each.

    These bounds, and at most ``languages`` languages of at least ``least`` texts, the most frequent first, bound the model
    that the driver holds. Rows without a text or a language are left out. Without rows all texts get ``default``.
    """
    known = frame.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(key).alias("k"), F.col(lang).cast("string").alias("l"), F.col(text).alias("t"))
    sizes = known.groupBy("l").count().where(F.col("count") >= least).orderBy(F.desc("count"), "l").limit(languages)
    codes = sorted(r.l for r in sizes.collect())
    drawn = capped_sample(known.where(F.col("l").isin(codes)), "l", "k", rows, seed) if codes else known.limit(0)
    words = drawn.select("l", F.explode(F.regexp_extract_all(F.lower("t"), F.lit(WORD), 0)).alias("w")).groupBy("l", "w").agg(F.count("*").alias("n"))
    counts = words.select("l", "n", F.explode(gram_rows(F.array("w"))).alias("g")).groupBy("l", "g").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("l").orderBy(F.desc("n"), "g")
    kept = counts.withColumn("r", F.row_number().over(best)).where(F.col("r") <= grams).select("l", "g", "n").collect()
    table: dict[str, dict[str, int]] = {}
    for r in kept:
        table.setdefault(r.g, {})[r.l] = r.n
    totals = {code: sum(c.get(code, 0) for c in table.values()) for code in codes}
    share = lambda n, code: float(np.log((n + 0.5) / (totals[code] + 0.5 * (len(table) + 1))))
    return Profiles(tuple(codes), {g: tuple(share(c.get(code, 0), code) for code in codes) for g, c in table.items()}, tuple(share(0, code) for code in codes), default)


def language_by_profile(text: Column, profiles: Profiles) -> Column:
    """The language whose profile makes the whole text's words likeliest; ties fall to the default, then by code. Texts without letters, and null ones, get the default.

    In Arrow batches. N-grams are counted by their numbers, without a look at each word, so words that no text repeats cost no more than others.
    """

    @F.pandas_udf("string")
    def detect(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        detector = Detector(profiles)
        for texts in batches:
            yield pd.Series([detector.language(t) for t in texts], dtype=object)

    return detect(text)


class Detector:
    """Counts the n-grams of a text as numbers: a letter is a symbol from 2 on (1: no profile has it), what stands between words is symbol 0, and
    three symbols in a row are a number below ``size`` to the third power. The figures of a text are those of its n-grams, each times its count."""

    PIECE, DENSE = 1 << 20, 1 << 22

    def __init__(self, profiles: Profiles):
        self.codes, self.default = profiles.codes, profiles.default
        self.order = sorted(range(len(self.codes)), key=lambda i: (self.codes[i] != self.default, self.codes[i]))
        self.letter = regex.compile(r"\p{L}")
        grams = [g for g in profiles.grams if len(g) in SIZES]
        letters = sorted({c for g in grams for c in g if self.letter.match(c)})
        symbols = {c: i for i, c in enumerate(letters, 2)}
        self.size = len(letters) + 2
        self.symbol_of = np.full(0x110000, -1, np.int32)  # -1: not looked at yet
        self.symbol_of[[ord(c) for c in letters]] = list(symbols.values())
        self.rows = np.array([profiles.unknown, *(profiles.grams[g] for g in grams)], dtype=np.float64).reshape(len(grams) + 1, len(self.codes))
        self.tables = []
        for n in SIZES:
            numbers = {}
            for row, g in enumerate(grams, 1):
                if len(g) == n and all(c == " " or c in symbols for c in g):
                    numbers[sum(symbols.get(c, 0) * self.size ** (n - 1 - i) for i, c in enumerate(g))] = row
            self.tables.append(self.table(numbers, self.size**n))

    def table(self, numbers: dict[int, int], most: int):
        """From arrays of n-grams' numbers to those of their rows; row 0 is that of an unknown one."""
        keys = np.array(sorted(numbers), dtype=np.int64)
        rows = np.array([numbers[k] for k in keys.tolist()], dtype=np.int64)
        if most <= self.DENSE:
            dense = np.zeros(most, np.int32)
            dense[keys] = rows
            return dense.take
        keys, rows = np.append(keys, most), np.append(rows, 0)

        def find(wanted: np.ndarray) -> np.ndarray:
            at = np.searchsorted(keys, wanted)
            return np.where(keys[at] == wanted, rows[at], 0)

        return find

    def symbols(self, text: str) -> np.ndarray:
        """Words with one symbol 0 between them, before the first and after the last; none without words."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        found = self.symbol_of.take(points)
        if found.size and found.min() < 0:
            for c in np.unique(points[found < 0]).tolist():
                self.symbol_of[c] = 1 if self.letter.match(chr(c)) else 0
            found = self.symbol_of.take(points)
        found = np.concatenate([[0], found, [0]]).astype(np.int64)
        kept = found > 0
        kept[1:] |= kept[:-1].copy()
        found = found[kept]
        return np.concatenate([[0], found]) if found.size else found

    def figures(self, text: str) -> np.ndarray | None:
        """The sum of the rows of the n-grams of the words of a lower-case text; None without words."""
        one = self.symbols(text)
        if not one.size:
            return None
        two = one[:-1] * self.size + one[1:]
        three = (two[:-1] * self.size + one[2:])[one[1:-1] > 0]
        ends = one[one == 0][1:-1]  # between two words there are the ends of both
        counts = np.bincount(np.concatenate([find(x) for find, x in zip(self.tables, (np.concatenate([one, ends]), two, three), strict=True)]))
        found = np.flatnonzero(counts)
        return (counts[found][:, None] * self.rows[found]).sum(axis=0)

    def language(self, text: str | None) -> str:
        text, total, at = (text or "").lower(), None, 0
        while at < len(text) and self.codes:
            end = min(at + self.PIECE, len(text))
            while end < len(text) and self.letter.match(text[end]):
                end += 1
            found = self.figures(text[at:end])
            total, at = found if total is None else total if found is None else total + found, end
        return self.default if total is None else self.codes[max(self.order, key=lambda i: round(total[i], 6))]
