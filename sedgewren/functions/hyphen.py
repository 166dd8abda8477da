"""Syllables by hyphenation patterns, and the readability figures that need them."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import known, sentences

#: Letters before the first and after the last hyphen.
LEFT, RIGHT = 2, 2


@dataclass(frozen=True)
class Patterns:
    """A trie of letters; where a pattern ends, its weights for the gaps before, between and after its letters."""

    trie: dict
    exceptions: dict[str, int]


def read_patterns(lines: Iterable[str], exceptions: Iterable[str] = ()) -> Patterns:
    """Patterns such as ``.ach4`` or ``a1b2c`` (a point stands for a word's edge, a digit is a gap's weight, 0 where there is none), one a line.

    Comment lines (%), settings in capitals and an encoding's name, as dictionaries have them, are left out.
    ``exceptions`` are words with their hyphens.
    """
    trie: dict = {}
    for line in lines:
        pattern = line.strip()
        if not any(c.isdigit() for c in pattern) or pattern[0] in "%#" or any(c.isupper() or c.isspace() for c in pattern):
            continue
        weights, node = [0], trie
        for char in pattern:
            if char.isdigit():
                weights[-1] = int(char)
            else:
                weights.append(0)
                node = node.setdefault(char, {})
        node[""] = tuple(map(max, weights, node.get("", weights)))  # patterns may have the same letters
    return Patterns(trie, {w.replace("-", ""): w.count("-") + 1 for w in exceptions})


def syllables(word: str, patterns: Patterns) -> int:
    """One more than the gaps of odd weight: each gap has the greatest weight that a pattern found at any place of the word gives it."""
    if word in patterns.exceptions:
        return patterns.exceptions[word]
    whole = f".{word}."
    weights = [0] * (len(whole) + 1)
    for start in range(len(whole)):
        node = patterns.trie
        for char in whole[start:]:
            node = node.get(char)
            if node is None:
                break
            for i, weight in enumerate(node.get("", ())):
                weights[start + i] = max(weights[start + i], weight)
    # weights[i + 1] is that of the gap before the word's letter i.
    return 1 + sum(weights[i + 1] % 2 for i in range(LEFT, len(word) - RIGHT + 1))


def syllable_counts(words: Column, patterns: Patterns, easy: Iterable[str] = ()) -> Column:
    """A struct of n (syllables of all words, at least one each) and hard (words of three or more that are not ``easy``), in Arrow batches.

    Words (no spaces in them) travel as one string a text, since lists of words take many times the room; a batch is
    gone through row by row. A word is looked up once for each batch, and kept for up to 100,000 words.
    """
    simple = frozenset(easy)

    @F.arrow_udf("struct<n: bigint, hard: bigint>")
    def count(rows: pa.Array) -> pa.Array:
        memo: dict[str, int] = {}
        totals, hards = [], []
        for row in rows:
            total = hard = 0
            for word in (row.as_py() or "").split(" "):
                if not word:
                    continue
                n = memo.get(word)
                if n is None:
                    n = syllables(word, patterns)
                    if len(memo) < 100_000:
                        memo[word] = n
                total += n
                hard += n >= 3 and word not in simple
            totals.append(total)
            hards.append(hard)
        return pa.StructArray.from_arrays([pa.array(totals, pa.int64()), pa.array(hards, pa.int64())], ["n", "hard"])

    return count(F.array_join(words, " "))


def readability(text: Column, words: Column, counts: Column) -> dict[str, Column]:
    """Reading ease and fog index of a text, its lower-case words, and their ``syllable_counts`` (pass these as columns). Texts under 20 characters, and ones without words, get zeros."""
    n_words = F.size(words).cast("double")
    per_sentence = n_words / F.greatest(F.lit(1), F.size(sentences(text)))
    short = (F.length(known(text)) < 20) | (n_words == 0)
    return {
        "f_flesch": F.when(short, 0.0).otherwise(206.835 - 1.015 * per_sentence - 84.6 * counts["n"] / n_words),
        "f_gunning_fog": F.when(short, 0.0).otherwise(0.4 * (per_sentence + 100.0 * counts["hard"] / n_words)),
    }
