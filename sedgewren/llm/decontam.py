"""Benchmark decontamination: exact pieces by pigeonhole, verified by Myers' bit-parallel distance."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Characters of benchmark text in one automaton. A larger benchmark is matched in several passes of this
#: size, so what a task is sent never grows with the benchmark.
PASS_CHARS = 2_000_000
SCHEMA = "doc_id long, item_id long, start long, end long, distance long, item_chars long"


def fold(text: str) -> tuple[str, list[int] | None]:
    """Lower case with runs of white space as one space, trimmed; and each character's place (None: unchanged)."""
    low = text.lower()
    out = " ".join(low.split())
    if len(out) == len(low) == len(text):  # no letter grew, no white space went
        return out, None
    places: list[int] = []
    gap = False
    for at, char in enumerate(text):
        if char.isspace():
            gap = bool(places)
            continue
        if gap:
            places.append(at - 1)
            gap = False
        places += [at] * len(char.lower())
    return out, places


def fold_only(text: str) -> str:
    return " ".join(text.lower().split())


def myers(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """Least edit distance of ``pattern`` to a substring of ``text`` and that substring's end (the first such), if at most ``most``."""
    m = len(pattern)
    if not m:
        return (0, 0)
    masks: dict[str, int] = {}
    for i, char in enumerate(pattern):
        masks[char] = masks.get(char, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score, best, end = full, 0, m, m, 0
    get = masks.get
    for at, char in enumerate(text, 1):
        x = get(char, 0) | vn
        d0 = ((vp + (x & vp)) ^ vp) | x
        hn = vp & d0
        hp = vn | (full & ~(vp | d0))
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
            if score < best:
                best, end = score, at
        x = hp << 1 & full
        vn = x & d0
        vp = (hn << 1 & full) | (full & ~(x | d0))
    return (best, end) if best <= most else None


@dataclass
class Item:
    item_id: int
    text: str
    budget: int
    short: bool = False
    cuts: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        parts = self.budget + 1
        self.cuts = [i * len(self.text) // parts for i in range(parts + 1)]


def make_items(rows: list[tuple[int, str]], rate: float, least: int) -> list[Item]:
    """Distinct test items with their error budgets; one of fewer than ``least`` folded characters has none and matches as whole words."""
    folded = sorted({(key, fold_only(text)) for key, text in rows if key is not None and text})
    return [Item(key, text, int(len(text) * rate) if len(text) >= least else 0, len(text) < least) for key, text in folded if text]


def whole_words(text: str, start: int, end: int) -> bool:
    """Whether no word of the text goes on over either end of the stretch."""
    word = lambda at: text[at].isalnum() or text[at] == "_"
    return not (start > 0 and word(start - 1) and word(start) or end < len(text) and word(end - 1) and word(end))


def automaton(items: list[Item]) -> ahocorasick.Automaton:
    found: dict[str, list[tuple[int, int]]] = {}
    for at, item in enumerate(items):
        for piece in range(item.budget + 1):
            found.setdefault(item.text[item.cuts[piece] : item.cuts[piece + 1]], []).append((at, piece))
    words = ahocorasick.Automaton()
    for piece, owners in found.items():
        words.add_word(piece, (len(piece), owners))
    words.make_automaton()
    return words


def grows(item: Item, piece: int, start: int, text: str) -> bool:
    """Whether a piece found at ``start`` survives in ever larger parts of its item.

    Parts are halves of halves; a part of n pieces may hold n - 1 errors. If a whole item is within its
    budget, some chain of parts from a piece to the item is too (errors of two halves beyond n - 1 each would
    sum up to more than the whole may hold), so this loses no match, and most chance hits end at a short part.
    """
    low, high = 0, item.budget + 1
    chain = []
    while high - low > 1:
        chain.append((low, high))
        middle = (low + high) // 2
        low, high = (low, middle) if piece < middle else (middle, high)
    for low, high in reversed(chain):
        most = high - low - 1
        left = start - (item.cuts[piece] - item.cuts[low]) - most
        right = start + (item.cuts[high] - item.cuts[piece]) + most
        if myers(item.text[item.cuts[low] : item.cuts[high]], text[max(0, left) : max(0, right)], most) is None:
            return False
    return True


def matches(text: str, items: list[Item], words: ahocorasick.Automaton) -> Iterator[tuple[int, int, int, int]]:
    """(item index, start, end, distance) of the best occurrence of each item in a folded text, within its budget."""
    best: dict[int, tuple[int, int, int]] = {}
    tried: set[tuple[int, int]] = set()
    for last, (size, owners) in words.iter(text):
        start = last + 1 - size
        for at, piece in owners:
            item = items[at]
            held = best.get(at)
            if held and held[0] == 0:
                continue
            if item.short:
                if whole_words(text, start, last + 1):
                    best[at] = (0, start, last + 1)
                continue
            place = (at, start - item.cuts[piece])
            if place in tried or not grows(item, piece, start, text):
                continue
            tried.add(place)
            left = max(0, place[1] - item.budget)
            # grows() ends with the whole item over the same stretch, so there is a match here.
            found = myers(item.text, text[left : place[1] + len(item.text) + item.budget], item.budget)
            if found is None:
                continue
            distance, end = found
            back = myers(item.text[::-1], text[left : left + end][::-1], distance)
            begin = left + end - back[1] if back else left
            if held is None or (distance, begin) < (held[0], held[1]):
                best[at] = (distance, begin, left + end)
    for at, (distance, begin, end) in sorted(best.items()):
        yield at, begin, end, distance


def passes(benchmark: DataFrame, rate: float, least: int) -> Iterator[tuple[list[Item], bool]]:
    """The test items, so many at a time as PASS_CHARS allows, and whether there are more to come.

    A benchmark beyond that is dealt to passes by a hash of its texts and read pass by pass, so that neither the
    driver nor a task ever holds more than about one pass of it.
    """
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text <> ''")
    chars = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-chars // PASS_CHARS))
    for part in range(parts):
        own = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == part)
        yield make_items([(r.item_id, r.text) for r in own.toLocalIterator()], rate, least), part + 1 < parts


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, least: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, start, end, distance, item_chars): each text's best occurrence of each item within ``rate`` errors.

    Texts and items are compared in lower case with white space collapsed; start and end are code points of the
    text as it is. Every whole text is scanned once per PASS_CHARS of benchmark text. Null or empty texts and
    null items match nothing; items under ``least`` characters match exactly, as whole words (with errors they
    occur by chance); rows that repeat an id each give their own rows; an empty table on either side gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "leaks")

    def scan(own: list[Item]) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = automaton(own) if own else None
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            for batch in batches:
                columns: list[list] = [[] for _ in names]
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if not text or words is None:
                        continue
                    folded = fold_only(text)
                    found = list(matches(folded, own, words))
                    places = fold(text)[1] if found else None
                    for at, begin, end, distance in found:
                        if places is not None:
                            begin, end = places[begin], places[end - 1] + 1
                        for column, value in zip(columns, (key, own[at].item_id, begin, end, distance, len(own[at].text)), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, SCHEMA)

    found = None
    for own, more in passes(benchmark, rate, least):
        part = scratch.put(scan(own)) if more or found is not None else scan(own)
        found = part if found is None else found.unionAll(part)
    return found


def drop_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, least: int = 40, text_col: str = "text") -> DataFrame:
    """The rows in whose whole text no test item occurs within ``rate`` errors, with all their columns.

    Null and empty texts stay, as do all rows if the benchmark is empty; repeated rows stay or go alike.
    """
    scratch = Scratch(docs.sparkSession, "drop-leaks")
    place, schema = docs.columns.index(text_col), docs.schema
    for items, more in passes(benchmark, rate, least):
        if not items:
            continue

        def work(batches: Iterator[pa.RecordBatch], own: list[Item] = items) -> Iterator[pa.RecordBatch]:
            words = automaton(own)
            for batch in batches:
                clean = [not t or next(matches(fold_only(t), own, words), None) is None for t in batch.column(place).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(work, schema)
        docs = scratch.put(docs) if more else docs
    return docs
