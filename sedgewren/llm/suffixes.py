"""Repeated passages by sparse suffix arrays over minimiser positions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

WORD = re.compile(r"\S+")
#: An odd multiplier and its inverse modulo 2**64, for hashes of word runs from prefix sums.
STEP = 0x9E3779B97F4A7C15
BACK = pow(STEP, -1, 1 << 64)


def word_hasher() -> Callable[[str], np.ndarray]:
    """A function from a text to its words' 64-bit hashes; words are what white space parts."""
    known: dict[str, int] = {}

    def hashes(text: str) -> np.ndarray:
        if len(known) > 1_000_000:
            known.clear()
        words = text.split()
        for word in words:
            if word not in known:
                known[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return np.fromiter((known[w] for w in words), dtype=np.uint64, count=len(words))

    return hashes


def runs(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    count = len(words)
    if count < n:
        return np.empty(0, dtype=np.uint64)
    power = np.empty(count, dtype=np.uint64)
    power[0] = 1
    power[1:] = STEP
    back = np.empty(count, dtype=np.uint64)
    back[0] = 1
    back[1:] = BACK
    sums = np.zeros(count + 1, dtype=np.uint64)
    np.cumsum(words * np.cumprod(power), out=sums[1:])
    out = (sums[n:] - sums[:-n]) * np.cumprod(back)[: count - n + 1]
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    out = (out ^ (out >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(32))


def minimisers(seeds: np.ndarray, window: int) -> np.ndarray:
    """Positions of the least seed (the first of equal ones) of each ``window`` consecutive ones."""
    if len(seeds) < window:
        return np.empty(0, dtype=np.int64)
    view = np.lib.stride_tricks.sliding_window_view(seeds, window)
    return np.unique(np.arange(len(view)) + view.argmin(axis=1))


#: Contexts that are compared at once; a group of equal beginnings that is larger goes on in further blocks.
BLOCK = 16_384
#: Between words in sort keys: below every character that a word's key holds, so that order is by whole words.
BETWEEN = "\0"
OUT = "kind int, c1 long, c2 long, k1 long, k2 long, l int, low long, high long, doc_id long, own long, w0 int, w1 int, places array<int>"


def sort_words(text: str) -> list[str]:
    """The text's words as sort keys keep them: a NUL, and what stands for one, is spelled with two characters."""
    words = text.split()
    if "\0" in text or "\1" in text:
        words = [w.replace("\1", "\1\2").replace("\0", "\1\1") for w in words]
    return words


def codes(known: dict[str, int], contexts: list[tuple[str, str]], least: int, back: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words as numbers: those from each suffix's start on, those before it (nearest first), and how many of either.

    What is missing at a text's ends is a number of its own in each row, so it equals nothing.
    """
    n = len(contexts)
    missing = -1 - np.arange(n, dtype=np.int64)[:, None]
    right, left = np.repeat(missing, least, axis=1), np.repeat(missing, back, axis=1)
    counts = np.zeros((2, n), dtype=np.int64)
    code = known.setdefault
    for i, (suffix, before) in enumerate(contexts):
        own = [code(w, len(known)) for w in suffix.split(BETWEEN)]
        right[i, : len(own)] = own
        counts[0, i] = len(own)
        if before:
            own = [code(w, len(known)) for w in reversed(before.split(BETWEEN))]
            left[i, : len(own)] = own
            counts[1, i] = len(own)
    return right, left, counts[0], counts[1]


def neighbours(seeds: np.ndarray, contexts: list[tuple[str, str]], low: np.ndarray, high: np.ndarray, known: dict[str, int], least: int, shortest: int) -> tuple[np.ndarray, ...]:
    """For sorted contexts, of the run of ``least`` words that begins l words before each suffix, l = 0, 1, ...: whether
    there is one, whether this is the first context that has it, and the least and greatest document that do.

    ``low`` and ``high`` are the least and greatest document of each context. The longest common beginnings of
    neighbours part the sorted suffixes into ever longer runs of equal beginnings; within those of least - l
    words, suffixes are extended to the left, and those with the same l words there have the same run.
    """
    n, back = len(seeds), least - shortest
    right, left, after, before = codes(known, contexts, least, back)
    equal = right[1:] == right[:-1]
    common = np.where(equal.all(axis=1), least, equal.argmin(axis=1))
    common[seeds[1:] != seeds[:-1]] = 0
    there, lead = np.zeros((n, back + 1), dtype=bool), np.zeros((n, back + 1), dtype=bool)
    lows, highs = np.zeros((n, back + 1), dtype=np.int64), np.zeros((n, back + 1), dtype=np.int64)
    side, width = np.zeros(n, dtype=np.int64), len(known) + n + 1
    for l in range(back + 1):  # noqa: E741
        if l:
            side = np.unique(side * width + left[:, l - 1] + n, return_inverse=True)[1]
        begin = np.concatenate([[0], np.cumsum(common < least - l)])
        key = begin * n + side
        order = np.argsort(key, kind="stable")
        at = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
        sizes = np.diff(np.append(at, n))
        lows[order, l] = np.repeat(np.minimum.reduceat(low[order], at), sizes)
        highs[order, l] = np.repeat(np.maximum.reduceat(high[order], at), sizes)
        lead[order[at], l] = True
        there[:, l] = (after >= least - l) & (before >= l)
    return there, lead, lows, highs


def signed(digest: int) -> tuple[int, int]:
    """A 128-bit number as two signed ones."""
    return tuple(v - (1 << 64) if v >> 63 else v for v in (digest >> 64, digest & (1 << 64) - 1))


def frame_of(columns: dict, n: int) -> pa.RecordBatch:
    names = [c.split() for c in OUT.split(", ")]
    types = {"int": pa.int32(), "long": pa.int64(), "array<int>": pa.list_(pa.int32())}
    return pa.RecordBatch.from_arrays([pa.nulls(n, types[t]) if c not in columns else columns[c] if c == "places" else pa.array(columns[c], types[t]) for c, t in names], [c for c, _ in names])


def compare_sorted(least: int, shortest: int):
    """The task over one range of sorted suffixes, as a function for mapInArrow.

    Runs that occur in two documents of the range are found here (kind 0: doc_id, own, first and last run as
    words). The first and last group of equal seeds may go on in the ranges beside this one, and a group of over
    BLOCK contexts is taken in parts; of those come the runs that they hold (kind 1: the run's 128-bit hash, least
    and greatest document; with context and l where a single document has it here), and the rows of contexts
    that ask for such runs (kind 2), for which the ranges exchange what they hold.
    """
    back = least - shortest

    def settle(seeds: np.ndarray, contexts: list[tuple[str, str]], docs: np.ndarray, owns: np.ndarray, places: np.ndarray, of: np.ndarray, open_: np.ndarray, known: dict[str, int]) -> Iterator[pa.RecordBatch]:
        if not len(seeds):
            return
        at = np.searchsorted(of, np.arange(len(seeds)))
        there, lead, lows, highs = neighbours(seeds, contexts, np.minimum.reduceat(docs, at), np.maximum.reduceat(docs, at), known, least, shortest)
        hit = there & (lows != highs)
        nearest, farthest = hit.argmax(axis=1), back - hit[:, ::-1].argmax(axis=1)
        take = hit.any(axis=1)[of]
        own = of[take]
        yield frame_of({"kind": np.zeros(len(own), np.int32), "doc_id": docs[take], "own": owns[take], "w0": places[take] - farthest[own], "w1": places[take] - nearest[own]}, len(own))
        asks = there & ~hit & open_[:, None]
        tells = there & open_[:, None] & (lead | asks)
        names = np.zeros((len(seeds), 2), dtype=np.int64)
        some = np.flatnonzero(tells.any(axis=1))
        for part in range(0, len(some), 1024):
            rows: list[tuple] = []
            for i in some[part : part + 1024].tolist():
                suffix, before = contexts[i]
                names[i] = signed(xxhash.xxh3_128_intdigest(f"{before}{BETWEEN}{BETWEEN}{suffix}".encode("utf-8", "surrogatepass")))
                ahead, behind = suffix.split(BETWEEN), before.split(BETWEEN) if before else []
                for l in np.flatnonzero(tells[i]).tolist():  # noqa: E741
                    run = BETWEEN.join([*behind[len(behind) - l :], *ahead[: least - l]])
                    rows.append((*names[i].tolist(), *signed(xxhash.xxh3_128_intdigest(run.encode("utf-8", "surrogatepass"))), l if asks[i, l] else -1, int(lows[i, l]), int(highs[i, l])))
            columns = dict(zip(("c1", "c2", "k1", "k2", "l", "low", "high"), map(np.array, zip(*rows, strict=True)), strict=True))
            yield frame_of(columns | {"kind": np.ones(len(rows), np.int32)}, len(rows))
        take = np.flatnonzero(asks.any(axis=1)[of])
        if len(take):
            # A document's places of one context come as one row.
            own = of[take]
            new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (docs[take][1:] != docs[take][:-1]) | (owns[take][1:] != owns[take][:-1])]))
            lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(take)), pa.int32()), pa.array(places[take], pa.int32()))
            yield frame_of({"kind": np.full(len(new), 2, np.int32), "c1": names[own[new], 0], "c2": names[own[new], 1], "doc_id": docs[take][new], "own": owns[take][new], "places": lists}, len(new))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        seeds, contexts = np.empty(0, np.int64), []
        rows = [np.empty(0, np.int64) for _ in range(4)]  # doc_id, own, place, context
        border = None  # the seed of the group that the range before this one, or the block before this one, may hold as well

        def flush(upto: int, more: bool) -> Iterator[pa.RecordBatch]:
            """Settles the first ``upto`` contexts; ``more``: their last group goes on."""
            nonlocal seeds, contexts, rows, border
            own, kept = seeds[:upto], int(np.searchsorted(rows[3], upto))
            open_ = own == border
            if more and upto:
                open_ |= own == own[-1]
                border = own[-1]
            yield from settle(own, contexts[:upto], rows[0][:kept], rows[1][:kept], rows[2][:kept], rows[3][:kept], open_, known)
            seeds, contexts = seeds[upto:], contexts[upto:]
            rows = [r[kept:] for r in rows[:3]] + [rows[3][kept:] - upto]
            if len(known) > 500_000:
                known.clear()

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            seed, suffix, before = batch.column(0).to_numpy(), batch.column(1), batch.column(2)
            if border is None:
                border = seed[0]
            new = np.ones(n, dtype=bool)
            new[1:] = seed[1:] != seed[:-1]
            for column in (suffix, before):
                new[1:] |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            new[0] = not contexts or (suffix[0].as_py(), before[0].as_py()) != contexts[-1] or seed[0] != seeds[-1]
            mask = pa.array(new)
            place = len(contexts) - 1 + np.cumsum(new)
            contexts += zip(suffix.filter(mask).to_pylist(), before.filter(mask).to_pylist(), strict=True)
            seeds = np.concatenate([seeds, seed[new]])
            rows = [np.concatenate([r, v]) for r, v in zip(rows, (*(batch.column(c).to_numpy().astype(np.int64) for c in (3, 4, 5)), place), strict=True)]
            if len(contexts) >= BLOCK or len(rows[0]) >= 64 * BLOCK:
                last = int(np.flatnonzero(seeds == seeds[-1])[0])
                yield from flush(last or len(contexts), not last)
        yield from flush(len(contexts), True)

    return work


def repeated_passages(docs: DataFrame, least: int = 50, seed_words: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, end, n_words): each maximal stretch of a text in which every run of ``least`` words occurs in another document.

    1. A suffix is kept where its first ``seed_words`` words are the least of a window (by hash), so a passage of
       ``least`` words keeps the same suffixes wherever it stands: about one in thirteen. Those whose seed a single
       document has are dropped.
    2. The others, with as many words after and before their start as a run may take, are sorted over ranges of
       about equal size: by seed, then by their words. A sort key ends in the document's id, so a passage that a
       third of all documents share is spread over many ranges.
    3. Neighbours are compared: their longest common beginnings give runs of equal beginnings, in which matches
       are extended to the left and right, word by word (words are compared, not hashes). All suffixes of such a run count, not the nearest alone,
       since one further off may reach further to the left. Groups that go over a range's end are settled by
       exchanging their runs.
    4. What the suffixes of a text found is merged to stretches.
    ``start`` and ``end`` are code points.

    Rows of one id are one document: passages that only they share don't count. Rows of one id and one text are one; different texts of an id
    each have their own stretches. Null ids and null texts take no part, texts under ``least`` words have no
    passage, and other columns are ignored.
    """
    window = least - seed_words + 1
    scratch = Scratch(docs.sparkSession, "suffixes")
    texts = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("own"), F.col(text_col).cast("string").alias("text"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = word_hasher()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                columns: list[list[np.ndarray]] = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.empty(0, np.int64)]]
                for key, own, text in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    found_seeds = runs(hasher(text), seed_words)
                    found = minimisers(found_seeds, window)
                    for column, values in zip(columns, (np.full(len(found), key, dtype=np.int64), np.full(len(found), own, dtype=np.int64), found.astype(np.int32), found_seeds[found].view(np.int64)), strict=True):
                        column.append(values)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], ["doc_id", "own", "place", "seed"])

    kept = scratch.put(texts.mapInArrow(keep, "doc_id long, own long, place int, seed long"))
    shared = scratch.put(kept.groupBy("seed").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a <> b").select("seed"))
    live = kept.join(shared.hint("merge"), "seed")
    around = scratch.put(live.groupBy("doc_id", "own").agg(F.collect_set(F.struct("place", "seed")).alias("places")))
    scratch.drop(kept)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["seed", "suffix", "before", "doc_id", "own", "place", "tail"]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            for key, own, text, places in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                words = sort_words(text)
                for found in places:
                    place = found["place"]
                    for column, value in zip(columns, (found["seed"], BETWEEN.join(words[place : place + least]), BETWEEN.join(words[max(0, place - window + 1) : place]), key, own, place, BETWEEN.join(words[place + seed_words : place + seed_words + 8])), strict=True):
                        column.append(value)
                if len(columns[0]) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
                    columns = [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    order = ["seed", "suffix", "before", "doc_id"]
    suffixes = scratch.put(texts.join(around.hint("merge"), ["doc_id", "own"]).select("doc_id", "own", "text", "places").mapInArrow(cut, "seed long, suffix string, before string, doc_id long, own long, place int, tail string"))
    # Ranges are cut by seed and the eight words behind it, which come before the rest in the order: the driver
    # gets a sample of keys of a bounded size.
    done = scratch.put(suffixes.repartitionByRange("seed", "tail", "doc_id").drop("tail").sortWithinPartitions(*order).mapInArrow(compare_sorted(least, seed_words), OUT))
    scratch.drop(suffixes)
    scratch.drop(around)
    told = done.where("kind = 1").select("c1", "c2", "k1", "k2", "l", "low", "high")
    held = told.groupBy("k1", "k2").agg(F.min("low").alias("a"), F.max("high").alias("b")).where("a <> b").select("k1", "k2")
    answers = told.where("l >= 0").join(held.hint("merge"), ["k1", "k2"]).groupBy("c1", "c2").agg(F.max("l").alias("far"), F.min("l").alias("near"))
    across = done.where("kind = 2").select("c1", "c2", "doc_id", "own", "places").join(answers.hint("merge"), ["c1", "c2"])
    across = across.select("doc_id", "own", "far", "near", F.explode("places").alias("at")).select("doc_id", "own", (F.col("at") - F.col("far")).alias("w0"), (F.col("at") - F.col("near")).alias("w1"))
    within = done.where("kind = 0").select("doc_id", "own", "w0", "w1")
    lists = within.unionByName(across).groupBy("doc_id", "own").agg(F.sort_array(F.collect_set(F.struct("w0", "w1"))).alias("found"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "own", "start", "end", "n_words"]
        for batch in batches:
            rows = []
            for key, own, text, found in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                stretches: list[list[int]] = []
                for run in found:
                    if stretches and run["w0"] <= stretches[-1][1] + least:
                        stretches[-1][1] = max(stretches[-1][1], run["w1"])
                    else:
                        stretches.append([run["w0"], run["w1"]])
                spans = [m.span() for m in WORD.finditer(text)]
                rows += [(key, own, spans[a][0], spans[b + least - 1][1], b + least - a) for a, b in stretches]
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names)

    # Rows that repeat under one id and text give the same stretches; one of each stays.
    found = texts.join(lists.hint("merge"), ["doc_id", "own"]).select("doc_id", "own", "text", "found").mapInArrow(merge, "doc_id long, own long, start long, end long, n_words long")
    return found.dropDuplicates(["doc_id", "own", "start"]).select("doc_id", "start", "end", "n_words")
