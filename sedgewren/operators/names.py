"""Names of people, places and organisations by a sequence labeller: a perceptron over words and their neighbours, decoded by Viterbi."""

from __future__ import annotations

import random
import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .splits import unit_hash

TAGS = ("O", "PERSON", "LOC", "ORG")
#: Words with inner apostrophes and hyphens, numbers, and single signs.
TOKEN = r"\p{L}+(?:['’-]\p{L}+)*|\p{N}+|[^\s\p{L}\p{N}]"
#: The same tokens of texts that are ASCII alone, for the standard library, which takes half the time.
ASCII_TOKEN = r"[A-Za-z]+(?:['-][A-Za-z]+)*|[0-9]+|[^\t-\r A-Za-z0-9]"
#: The last white space of Unicode; what is beyond it is none.
LAST_SPACE = 0x3000


# Words that are no part of a name, even where a sentence begins with them.
COMMON = frozenset(
    "a an the this that these those i you he she it we they me him her us them my your his its our their and but or if so as at by for from in into of on to with about is am are was were be been do does did have has had "
    "not no yes what who when where why how there here then now today every any some all".split()
)


@dataclass(frozen=True)
class Tagger:
    """Weights by feature, one for each tag; and of each tag after each."""

    weights: dict[str, tuple[float, ...]]
    follow: tuple[tuple[float, ...], ...]


def shape(word: str) -> str:
    if not word[0].isalpha():
        return "digit" if word[0].isdigit() else "sign"
    return "lower" if word.islower() else "upper" if word.isupper() and len(word) > 1 else "title" if word[0].isupper() else "mixed"


def features(words: Sequence[str], i: int) -> list[str]:
    """What the labeller sees of a word: itself, its shape and ends, the words on both sides, and whether a sentence begins."""
    word = words[i].lower()
    back = words[i - 1].lower() if i else "^"
    back2 = words[i - 2].lower() if i > 1 else "^"
    ahead = words[i + 1].lower() if i + 1 < len(words) else "$"
    form, first = "common" if word in COMMON else shape(words[i]), back in ("^", ".", "!", "?")
    return [
        "bias", f"w={word}", f"shape={form}", f"start={first},{form}", f"end3={word[-3:]},{form}", f"back={back},{form}", f"back2={back2} {back},{form}", f"ahead={ahead},{form}",
        f"shapes={shape(words[i - 1]) if i else '^'},{form},{shape(words[i + 1]) if i + 1 < len(words) else '$'}",
    ]


def viterbi(words: Sequence[str], tagger: Tagger) -> list[int]:
    """The tags of the greatest sum of weights. Linear in the words."""
    size = len(TAGS)
    scores, marks = [0.0] * size, []
    for i in range(len(words)):
        own = [0.0] * size
        for feature in features(words, i):
            if found := tagger.weights.get(feature):
                for t in range(size):
                    own[t] += found[t]
        if i:
            best = [max(range(size), key=lambda s, t=t: (scores[s] + tagger.follow[s][t], -s)) for t in range(size)]
            scores = [scores[best[t]] + tagger.follow[best[t]][t] + own[t] for t in range(size)]
            marks.append(best)
        else:
            scores = own
    tags = [max(range(size), key=lambda t: (scores[t], -t))] if words else []
    for best in reversed(marks):
        tags.append(best[tags[-1]])
    return tags[::-1]


class Decoder:
    """Finds the tags that ``viterbi`` finds. What a word alone adds is worked out once for up to ``KNOWN`` words; sums are made in the order
    of ``features``, so they are equal to the last bit."""

    KNOWN = 100_000

    def __init__(self, tagger: Tagger):
        self.tagger, self.memo, self.forms = tagger, {}, {}
        parts: dict[str, dict[tuple[str, ...], tuple[float, ...]]] = {"back": {}, "back2": {}, "ahead": {}, "shapes": {}}
        for feature, found in tagger.weights.items():
            kind, _, rest = feature.partition("=")
            if kind == "shapes":
                parts[kind][tuple(rest.rsplit(",", 2))] = found
            elif kind in parts:
                parts[kind][tuple(rest.rsplit(",", 1))] = found
        self.back, self.back2, self.ahead, self.shapes = parts.values()

    def known(self, word: str, first: bool) -> tuple[str, str, str, tuple[float, ...]]:
        """The word in lower case, its form and shape, and the sum of the weights of its own features."""
        low = word.lower()
        kind = shape(word)
        form, own = "common" if low in COMMON else kind, [0.0] * len(TAGS)
        for feature in ("bias", f"w={low}", f"shape={form}", f"start={first},{form}", f"end3={low[-3:]},{form}"):
            if found := self.tagger.weights.get(feature):
                own = [a + b for a, b in zip(own, found, strict=True)]
        if len(self.memo) >= self.KNOWN:
            self.memo.clear()
        found = self.memo[word, first] = (low, form, kind, tuple(own))
        return found

    def tags(self, words: Sequence[str]) -> list[int]:
        if not words:
            return []
        memo, follow, every = self.memo, self.tagger.follow, range(len(TAGS))
        into = [tuple(follow[s][t] for s in every) for t in every]
        seen, back = [], "^"
        for word in words:
            first = back in ("^", ".", "!", "?")
            seen.append(memo.get((word, first)) or self.known(word, first))
            back = seen[-1][0]
        edge = ("^", "", "^", ()), ("$", "", "$", ())
        scores, marks, last = [], [], len(words) - 1
        for i, (_, form, kind, own) in enumerate(seen):
            before, after = seen[i - 1] if i else edge[0], seen[i + 1] if i < last else edge[1]
            back2 = seen[i - 2][0] if i > 1 else "^"
            for found in (self.back.get((before[0], form)), self.back2.get((f"{back2} {before[0]}", form)), self.ahead.get((after[0], form)), self.shapes.get((before[2], form, after[2]))):
                if found:
                    own = [a + b for a, b in zip(own, found, strict=True)]
            if not i:
                scores = list(own)
                continue
            best, new = [], []
            for t in every:
                at, most = 0, scores[0] + into[t][0]
                for s in every:
                    if (x := scores[s] + into[t][s]) > most:
                        at, most = s, x
                best.append(at)
                new.append(most + own[t])
            scores = new
            marks.append(best)
        tags = [scores.index(max(scores))]
        for best in reversed(marks):
            tags.append(best[tags[-1]])
        return tags[::-1]


class Numbers(dict):
    """Numbers of words, from 1 on, and by number what a ``BatchDecoder`` needs of a word. Number 0 is the edge of a text.

    Words in which the labeller sees the same have one number: most of a large vocabulary differ in form, length and end alone.
    """

    INTS = ("form", "before", "after", "back", "back2", "back1", "ahead", "ends", "length")

    def __init__(self, batch: BatchDecoder):
        super().__init__()
        self.batch, self.kinds = batch, {}
        self.ints, self.own = np.zeros((1024, len(self.INTS)), np.int64), np.zeros((1024, 2, len(TAGS)))
        self.ints[0] = (0, len(FORMS) - 1, len(FORMS), batch.back.get("^", 0), batch.back2.get("^", 0), batch.back1.get("^", 0), batch.ahead.get("$", 0), 1, 0)

    def __missing__(self, word: str) -> int:
        low, shown, batch = word.lower(), shape(word), self.batch
        form = "common" if low in COMMON else shown
        kind = (low if low in batch.named else "", form, shown, low[-3:] if f"end3={low[-3:]},{form}" in batch.one.tagger.weights else "", len(word))
        at = self.kinds.get(kind)
        if at is None:
            at = self.kinds[kind] = len(self.kinds) + 1
            if at == len(self.own):
                self.ints, self.own = (np.concatenate([a, np.zeros_like(a)]) for a in (self.ints, self.own))
            self.own[at] = batch.one.known(word, False)[3], batch.one.known(word, True)[3]
            batch.one.memo.clear()
            side = FORMS.index(shown)
            self.ints[at] = (FORMS.index(form), side, side, batch.back.get(low, 0), batch.back2.get(low, 0), batch.back1.get(low, 0), batch.ahead.get(low, 0), low in ENDS, len(word))
        self[word] = at
        return at


#: After these a sentence begins.
ENDS = ("^", ".", "!", "?")
#: Forms of words; shapes are all but the last, beside the edges "^" and "$".
FORMS = ("lower", "upper", "title", "mixed", "digit", "sign", "common")


class BatchDecoder:
    """Finds the tags that ``viterbi`` finds, of many texts at once: words are numbered, weights are looked up for all places together, and the decoding
    takes a step in all texts at a time. Sums are made in the order of ``features``, so they are equal to the last bit.

    Texts of about the same length, of up to ``PLACES`` words together (or one text), go together. After ``Decoder.KNOWN`` words the numbers begin anew with the next call.
    """

    PLACES, CHARS = 1 << 18, 1 << 24

    def __init__(self, tagger: Tagger):
        self.one = one = Decoder(tagger)
        size = len(TAGS)

        def table(weights: dict[tuple[int, str], Sequence[float]], rows: int) -> np.ndarray:
            out = np.zeros((rows, len(FORMS), size))
            for (at, form), found in weights.items():
                if form in FORMS:
                    out[at, FORMS.index(form)] = found
            return out.reshape(-1, size)

        slots = lambda found: {w: i for i, w in enumerate(sorted(set(found)), 1)}
        self.back, self.ahead = slots(w for w, _ in one.back), slots(w for w, _ in one.ahead)
        self.back_table = table({(self.back[w], f): v for (w, f), v in one.back.items()}, len(self.back) + 1)
        self.ahead_table = table({(self.ahead[w], f): v for (w, f), v in one.ahead.items()}, len(self.ahead) + 1)
        pairs = slots(w for w, _ in one.back2)
        cut = [(w[:i], w[i + 1 :], n) for w, n in pairs.items() for i, c in enumerate(w) if c == " "]
        self.back2, self.back1 = slots(a for a, _, _ in cut), slots(b for _, b, _ in cut)
        self.pairs = np.zeros((len(self.back2) + 1, len(self.back1) + 1), np.int64)
        for a, b, n in cut:
            self.pairs[self.back2[a], self.back1[b]] = n
        self.pair_table = table({(pairs[w], f): v for (w, f), v in one.back2.items()}, len(pairs) + 1)
        self.sides = len(FORMS) + 1
        before, after = [*FORMS[:-1], "^", None], [*FORMS[:-1], None, "$"]
        self.shape_table = np.zeros((self.sides, len(FORMS), self.sides, size))
        for (a, form, b), found in one.shapes.items():
            if a in before and form in FORMS and b in after:
                self.shape_table[before.index(a), FORMS.index(form), after.index(b)] = found
        self.shape_table = self.shape_table.reshape(-1, size)
        self.follow = np.array(tagger.follow)[:, :, None]
        self.plain, self.tokens = re.compile(ASCII_TOKEN), regex.compile(TOKEN)
        self.named = {f[2:] for f in tagger.weights if f.startswith("w=")}.union(self.back, self.ahead, self.back2, self.back1, ENDS)
        self.solid = np.ones(LAST_SPACE + 2, dtype=bool)
        self.solid[[m.start() for m in regex.finditer(r"\s", "".join(map(chr, range(LAST_SPACE + 1))))]] = False
        self.numbers = Numbers(self)

    def numbered(self, words: Sequence[str]) -> np.ndarray:
        return np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words))

    def tags(self, texts: Sequence[np.ndarray]) -> list[np.ndarray]:
        """Of texts as numbers of their words: the tags of each."""
        out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(texts)
        order = sorted((i for i, t in enumerate(texts) if len(t)), key=lambda i: -len(texts[i]))
        at = 0
        while at < len(order):
            end, places = at, 0
            while end < len(order) and (end == at or places + len(texts[order[end]]) <= self.PLACES):
                places += len(texts[order[end]])
                end += 1
            for i, found in zip(order[at:end], self.together([texts[i] for i in order[at:end]]), strict=True):
                out[i] = found
            at = end
        return out

    def own(self, texts: list[np.ndarray], lengths: np.ndarray) -> np.ndarray:
        """A row of weights for each word of the texts, one text after the other, which stand between edges."""
        edges = np.zeros(2, np.int32)
        line = np.concatenate([x for t in texts for x in (edges, t)] + [edges[:1]])
        at = np.arange(lengths.sum()) + 2 * np.repeat(np.arange(1, len(texts) + 1), lengths)
        form, before, after, back, back2, back1, ahead, ends, _ = self.numbers.ints[: len(self.numbers.kinds) + 1].T.copy()
        here, last, next_, n = line[at], line[at - 1], line[at + 1], len(FORMS)
        form = form[here]
        out = self.numbers.own.reshape(-1, len(TAGS)).take(2 * here + ends[last], axis=0)
        out += self.back_table.take(n * back[last] + form, axis=0)
        out += self.pair_table.take(n * self.pairs[back2[line[at - 2]], back1[last]] + form, axis=0)
        out += self.ahead_table.take(n * ahead[next_] + form, axis=0)
        out += self.shape_table.take((n * before[last] + form) * self.sides + after[next_], axis=0)
        return out

    def together(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """Tags of texts that are not empty, the longest first. Of all weights, those of the first words stand together, then those of the second ones, and so on."""
        lengths = np.array([len(t) for t in texts])
        steps = int(lengths[0])
        alive = len(texts) - np.searchsorted(lengths[::-1], np.arange(steps + 1), side="right")
        begin = np.concatenate([[0], np.cumsum(alive)])
        number = np.repeat(np.arange(len(texts)), lengths)
        place = begin[np.arange(len(number)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] + number
        sums = np.empty((len(TAGS), len(number)))  # first each word's own weights, then the greatest sums up to it
        sums[:, place] = self.own(texts, lengths).T
        last, ends, starts = np.zeros(len(texts), np.int64), alive.tolist(), begin.tolist()
        scores = sums[:, : ends[0]]
        for i in range(1, steps):
            n, a = ends[i], starts[i]
            if n < ends[i - 1]:
                last[n : ends[i - 1]] = scores[:, n:].argmax(axis=0)
            before, scores = scores[:, None, :n], sums[:, a : a + n]
            scores += np.maximum.reduce(before + self.follow, axis=0)
        last[: ends[steps - 1]] = scores.argmax(axis=0)
        marks = self.marks(sums, np.arange(ends[0], len(number)) - np.repeat(alive[: steps - 1], alive[1:steps])).reshape(-1)
        tags, row = np.zeros(len(number), np.int8), len(TAGS) * np.arange(len(texts))
        for i in range(steps - 1, 0, -1):
            n, a = ends[i], starts[i]
            found = last[:n]
            tags[a : a + n] = found
            last[:n] = marks[len(TAGS) * (a - ends[0]) :].take(row[:n] + found)
        tags[: ends[0]] = last
        return np.split(tags[place], np.cumsum(lengths)[:-1])

    def marks(self, sums: np.ndarray, before: np.ndarray) -> np.ndarray:
        """A row for each word that has one before it, whose place is given: by its tag, the tag of the one before. Of equal sums the first counts."""
        back, follow = sums[:, before], self.follow
        marks, most = np.zeros((len(TAGS), len(before)), np.int8), back[0] + follow[0]
        for s in range(1, len(TAGS)):
            x = back[s] + follow[s]
            np.copyto(marks, s, where=x > most)
            np.maximum(most, x, out=most)
        return np.ascontiguousarray(marks.T)

    def spans(self, texts: Sequence[str | None]) -> Iterator[list[tuple[int, int, str]]]:
        """What the function ``spans`` finds in each text; ``CHARS`` characters, or one text, at a time."""
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end] or "") <= self.CHARS):
                chars += len(texts[end] or "")
                end += 1
            if len(self.numbers) > Decoder.KNOWN:
                self.numbers = Numbers(self)
            block = texts[at:end]
            found = [self.numbered((self.plain if t.isascii() else self.tokens).findall(t) if t else ()) for t in block]
            for text, words, tags in zip(block, found, self.tags(found), strict=True):
                yield self.runs(text, words, tags) if tags.any() else []
            at = end

    def runs(self, text: str, words: np.ndarray, tags: np.ndarray) -> list[tuple[int, int, str]]:
        """All that is not white space is part of a token, so the characters of the tokens before a token tell where it begins."""
        at = np.flatnonzero(tags)
        chars = np.flatnonzero(self.solid[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), LAST_SPACE + 1)])
        lengths = self.numbers.ints[words, self.INT_LENGTH]
        starts = chars[(np.cumsum(lengths) - lengths)[at]]
        out: list[tuple[int, int, str]] = []
        before, kind = -2, 0
        for i, tag, a, b in zip(at.tolist(), tags[at].tolist(), starts.tolist(), (starts + lengths[at]).tolist(), strict=True):
            if i == before + 1 and tag == kind and out[-1][1] < a <= out[-1][1] + 1:
                out[-1] = (out[-1][0], b, TAGS[tag])
            else:
                out.append((a, b, TAGS[tag]))
            before, kind = i, tag
        return out

    INT_LENGTH = Numbers.INTS.index("length")


def fit(sentences: Sequence[tuple[Sequence[str], Sequence[str]]], rounds: int = 5, seed: int = 42) -> Tagger:
    """An averaged perceptron over (words, tags): where the tags found differ from those given, weights move by one."""
    size = len(TAGS)
    weights: dict[str, list[float]] = defaultdict(lambda: [0.0] * size)
    summed: dict[str, list[float]] = defaultdict(lambda: [0.0] * size)
    follow, follow_sum = [[0.0] * size for _ in TAGS], [[0.0] * size for _ in TAGS]
    order, step = list(range(len(sentences))), 1
    rng = random.Random(seed)
    for _ in range(rounds):
        rng.shuffle(order)
        for at in order:
            words, given = sentences[at][0], [TAGS.index(t) for t in sentences[at][1]]
            found = viterbi(words, Tagger(weights, follow))
            if found != given:
                for tags, sign in ((given, 1.0), (found, -1.0)):
                    for i, tag in enumerate(tags):
                        for feature in features(words, i):
                            weights[feature][tag] += sign
                            summed[feature][tag] += sign * step
                        if i:
                            follow[tags[i - 1]][tag] += sign
                            follow_sum[tags[i - 1]][tag] += sign * step
            step += 1
    mean = lambda now, total: tuple(w - s / step for w, s in zip(now, total, strict=True))
    return Tagger({f: mean(w, summed[f]) for f, w in weights.items() if any(w)}, tuple(mean(w, s) for w, s in zip(follow, follow_sum, strict=True)))


def fit_names(frame: DataFrame, key: str, words: str, tags: str, rows: int = 5_000, rounds: int = 5, seed: int = 42) -> Tagger:
    """A tagger of labelled sentences (arrays of words and of tags), of which at most ``rows``, drawn by hash, go to the driver."""
    drawn = frame.where(F.size(words) == F.size(tags)).orderBy(unit_hash(F.col(key), seed), key).limit(rows)
    return fit([(r[0], r[1]) for r in drawn.select(words, tags).collect()], rounds, seed)


def spans(text: str, tagger: Tagger | Decoder, tokens: regex.Pattern | None = None) -> list[tuple[int, int, str]]:
    """(start, end, tag) of each run of words of one tag. Give a Decoder for many texts."""
    decoder = tagger if isinstance(tagger, Decoder) else Decoder(tagger)
    found = list((tokens or regex.compile(TOKEN)).finditer(text))
    out: list[tuple[int, int, str]] = []
    last = 0
    for match, tag in zip(found, decoder.tags([m.group() for m in found]), strict=True):
        if tag and last == tag and out[-1][1] < match.start() <= out[-1][1] + 1:
            out[-1] = (out[-1][0], match.end(), TAGS[tag])
        elif tag:
            out.append((*match.span(), TAGS[tag]))
        last = tag
    return out


def recogniser(tagger: Tagger):
    """What ``functions.approx.with_entities`` takes: spans of each of a list of texts."""
    decoder = BatchDecoder(tagger)
    return lambda texts: list(decoder.spans(texts))


def redact_names(text: Column, tagger: Tagger) -> Column:
    """Names in the whole text replaced by their kind in brackets, in Arrow batches; null stays null."""

    @F.pandas_udf("string")
    def replace(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoder = BatchDecoder(tagger)
        for texts in batches:
            out = []
            for t, found in zip(texts, decoder.spans(texts.tolist()), strict=True):
                parts, at = [], 0
                for a, b, kind in found:
                    parts += [t[at:a], f"[{kind}]"]
                    at = b
                out.append("".join([*parts, t[at:]]) if parts else t)
            yield pd.Series(out, dtype=object)

    return replace(text)


# Words that made training sentences are filled with, and the sentences themselves.
FIRST = "Anna Ben Carla David Elena Frank Grace Henry Iris Jack Karen Liam Maria Noah Olivia Peter Quinn Rosa Samuel Tina Ursula Victor Wendy Yusuf Zoe Ahmed Mei Ravi Fatima Diego".split()
LAST = "Smith Jones Miller Garcia Schmidt Rossi Novak Kim Nguyen Khan Silva Haddad Larsen O'Brien Dubois Tanaka Ivanov Cohen Okafor Walker".split()
PLACES = (
    "London", "Paris", "Berlin", "Madrid", "Rome", "Oslo", "Lisbon", "Vienna", "Dublin", "New York", "Los Angeles", "San Francisco", "Chicago", "Boston", "Texas", "California", "Ohio", "Scotland", "Ireland", "Norway",
    "Spain", "Italy", "Poland", "Greece", "Turkey", "Mexico", "Australia", "New Zealand", "South Africa", "North Carolina",
)
ORGS = ("Google", "Amazon", "Siemens", "Toyota", "Red Cross", "Oxford University", "Harvard University", "World Bank", "General Hospital", "Acme Corporation", "Northern Bank", "City College", "Greenpeace", "Unilever", "Nokia", "Central Clinic")
MADE = (
    "my name is {p}", "I am {p} and I live in {l}", "hi , I'm {f} from {l}", "we moved to {l} last year", "he moved to {l} with {f}", "she lives in the {l} now", "I saw Dr. {s} at {o} today", "Mr. {s} told me to rest", "Mrs. {s} and {f} came to visit", "{f} said that it would be fine",
    "my friend {f} works at {o}", "my sister {f} lives in {l}", "I was born in {l} and grew up in {l}", "the doctor at {o} did not listen", "they study at {o} in {l}", "she flew from {l} to {l}", "I talked to {p} about it .", "{p} from {o} called me",
    "people in {l} are kind", "the weather in {l} is bad", "has anyone here been to {l} ?", "thanks to {f} and {f} for the help", "{l} is a nice place", "{o} hired me in May", "a nurse named {f} was there", "dear {f} , how are you ?",
    "I feel bad every day", "The doctor said that I am fine", "It has been a hard week", "My heart is racing again", "We went home after work on Monday", "I THINK I AM DYING", "What should I do ?", "This is the worst day . Nothing helps .",
    "Please help me", "He is fine , She is not", "Every morning I wake up at 5", "Yes . No . Maybe", "Does anyone else feel this ?", "Thank you all so much", "I take 20 mg of it in the evening", "On Friday I had a panic attack",
)


def made_sentences(number: int = 4_000, seed: int = 42, held_out: bool = False) -> list[tuple[list[str], list[str]]]:
    """Sentences of the fixed parts, drawn by seed, with their tags. A third of the names are in held-out sentences only."""
    rng = random.Random(f"{seed}{held_out}")
    part = lambda names: [n for i, n in enumerate(names) if (i % 3 == 0) == held_out]
    fill = {"f": (part(FIRST), "PERSON"), "s": (part(LAST), "PERSON"), "l": (part(PLACES), "LOC"), "o": (part(ORGS), "ORG")}
    out = []
    for _ in range(number):
        words, tags = [], []
        for piece in rng.choice(MADE).split():
            kinds = ["f", "s"] if piece == "{p}" else [piece[1:-1]] if piece[0] == "{" else []
            for kind in kinds:
                name = regex.findall(TOKEN, rng.choice(fill[kind][0]))
                words += name
                tags += [fill[kind][1]] * len(name)
            if not kinds:
                plain = regex.findall(TOKEN, piece)
                words += plain
                tags += ["O"] * len(plain)
        if rng.random() < 0.5:
            words[0] = words[0][0].upper() + words[0][1:]
        if rng.random() < 0.5 and words[-1] not in ".?!":
            words.append(".")
            tags.append("O")
        out.append((words, tags))
    return out


_DEFAULT: list[Tagger] = []


def default_tagger() -> Tagger:
    """Fitted on made sentences, once in a driver's life. A text of another kind needs labelled sentences of its own: ``fit_names``."""
    if not _DEFAULT:
        _DEFAULT.append(fit(made_sentences()))
    return _DEFAULT[0]


def precision_recall(found: Sequence[Sequence[str]], given: Sequence[Sequence[str]]) -> tuple[float, float]:
    """Of tagged words: the share of those found that are right, and of those given that are found."""
    pairs = [(a, b) for x, y in zip(found, given, strict=True) for a, b in zip(x, y, strict=True)]
    hits = sum(a == b != "O" for a, b in pairs)
    return hits / max(1, sum(a != "O" for a, _ in pairs)), hits / max(1, sum(b != "O" for _, b in pairs))
