"""Toxicity by a weighted finite-state grammar over clauses."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"\w+|[.!?;:,\n]")
ENDS = frozenset(".!?;:\n")

#: Closed word classes of the grammar in the corpus's four languages.
THREATS = frozenset("kill hurt beat burn destroy shoot stab strangle töten umbringen tuer frapper matar golpear".split())
TARGETS = frozenset("you your yourself he him she her they them these those people du dich ihr sie tu te vous toi tú usted ustedes".split())
NEGATIONS = frozenset("not no never without neither nor nicht kein keine nie pas jamais sin nunca".split())
REPORTS = frozenset("said says wrote writes called claimed quoted according quote sagte schrieb dit écrit dijo".split())

#: Symbols of the grammar's input.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, COMMA = range(7)
#: Outputs of the first two transducers.
DENIED, REPORTED, DENIED_THREAT, REPORTED_THREAT = range(7, 11)
SYMBOLS = 11


@dataclass
class Transducer:
    """A deterministic transducer: arcs[state][symbol] = (next state, output symbol, weight)."""

    arcs: list[list[tuple[int, int, float]]]


def negation(reach: int = 3) -> Transducer:
    """Turns insults and threats within ``reach`` words of a negation into denied ones."""
    arcs = []
    for state in range(reach + 1):
        row = [(max(0, state - 1), s, 0.0) for s in range(SYMBOLS)]
        if state:
            row[INSULT] = (state - 1, DENIED, 0.0)
            row[THREAT] = (state - 1, DENIED_THREAT, 0.0)
        row[NEGATION] = (reach, NEGATION, 0.0)
        row[COMMA] = (0, COMMA, 0.0)
        arcs.append(row)
    return Transducer(arcs)


def reported() -> Transducer:
    """Turns insults and threats after a verb of speech into reported ones, until the clause ends."""
    start = [(0, s, 0.0) for s in range(SYMBOLS)]
    start[REPORT] = (1, REPORT, 0.0)
    after = [(1, s, 0.0) for s in range(SYMBOLS)]
    after[INSULT], after[THREAT] = (1, REPORTED, 0.0), (1, REPORTED_THREAT, 0.0)
    return Transducer([start, after])


def clause(insult: float = 1.0, threat: float = 0.6, aimed: float = 0.5, denied: float = 0.5, told: float = 0.7) -> Transducer:
    """Weights of a clause: insults, threats, and more once the clause names a target (on either side).

    States are sums of 1 (a target was named), 2 (abuse was said) and 4 (a threat waits for its target); a threat
    counts only with a target. The weight of an insult arc is multiplied by the word's own.
    """
    insults = {INSULT: insult, DENIED: insult * denied, REPORTED: insult * told}
    threats = {THREAT: threat, DENIED_THREAT: threat * denied, REPORTED_THREAT: threat * told}
    arcs = []
    for state in range(8):
        row = [(state, s, 0.0) for s in range(SYMBOLS)]
        first = aimed if state & 3 == 1 else 0.0  # the target stood before any abuse
        for symbol, weight in insults.items():
            row[symbol] = (state | 2, symbol, weight + first)
        for symbol, weight in threats.items():
            row[symbol] = (state | 2, symbol, weight + first) if state & 1 else (state | 4, symbol, 0.0)
        late = threat if state & 4 else 0.0
        row[TARGET] = ((state & 3 | 1) | (2 if late else 0), TARGET, late + (aimed if state & 1 == 0 and state & 6 else 0.0))
        arcs.append(row)
    return Transducer(arcs)


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that feeds the first's output to the second; weights add up."""
    n = len(second.arcs)
    arcs = []
    for a in range(len(first.arcs)):
        for b in range(n):
            row = []
            for symbol in range(SYMBOLS):
                to_a, out, w1 = first.arcs[a][symbol]
                to_b, out, w2 = second.arcs[b][out]
                row.append((to_a * n + to_b, out, w1 + w2))
            arcs.append(row)
    return Transducer(arcs)


def grammar() -> Transducer:
    return compose(compose(negation(), reported()), clause())


def features_of(word: str) -> list[str]:
    """What the lexicon can list of a word: itself, and its beginnings of four to six letters."""
    return [word, *(word[:n] + "*" for n in (4, 5, 6) if len(word) > n)]


@dataclass(frozen=True)
class Classes:
    """The closed word classes of a model, lower-cased; for texts in other languages give others. Of a word in several, the last one named here counts."""

    threats: frozenset[str] = THREATS
    targets: frozenset[str] = TARGETS
    negations: frozenset[str] = NEGATIONS
    reports: frozenset[str] = REPORTS


@dataclass
class Model:
    """Weights of insults (words and beginnings) and of the final logistic curve."""

    lexicon: dict[str, float]
    curve: tuple[float, ...] = (-3.0, 1.0, 1.0, 0.0)
    machine: Transducer = field(default_factory=grammar)
    classes: Classes = field(default_factory=Classes)

    def reader(self) -> Callable[[str | None], tuple[float, float, float]]:
        """A function from a text to (greatest clause score, sum of clause scores, sum per hundred words)."""
        known: dict[str, tuple[int, float]] = {}
        for words, symbol in ((self.classes.threats, THREAT), (self.classes.targets, TARGET), (self.classes.negations, NEGATION), (self.classes.reports, REPORT)):
            known |= {w: (symbol, 1.0) for w in words}
        fixed, lexicon, arcs = dict(known), self.lexicon, self.machine.arcs
        plain = (OTHER, 0.0)

        def look(word: str) -> tuple[int, float]:
            weight = max((lexicon.get(f, 0.0) for f in features_of(word)), default=0.0)
            return (INSULT, weight) if weight > 0 else plain

        def read(text: str | None) -> tuple[float, float, float]:
            if len(known) > 500_000:
                known.clear()
                known.update(fixed)
            state, run, best, total, count = 0, 0.0, 0.0, 0.0, 0
            for match in WORD.finditer((text or "").lower()):
                word = match.group()
                if word in ENDS:
                    if run:
                        best, total = max(best, run), total + run
                    state, run = 0, 0.0
                    continue
                if word == ",":
                    state = arcs[state][COMMA][0]
                    continue
                count += 1
                found = known.get(word)
                if found is None:
                    found = known[word] = look(word)
                state, out, weight = arcs[state][found[0]]
                if weight:
                    run += weight * found[1] if found[0] == INSULT else weight
            best, total = max(best, run), total + run
            return best, total, 100.0 * total / max(count, 20)

        return read

    def score(self, read: tuple[float, float, float]) -> float:
        z = self.curve[0] + self.curve[1] * math.log1p(read[0]) + self.curve[2] * math.log1p(read[1]) + self.curve[3] * math.log1p(read[2])
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, z))))


def fit_curve(rows: np.ndarray, labels: np.ndarray, ridge: float = 0.05, rounds: int = 60) -> tuple[float, ...]:
    """Logistic regression by Newton's method; a measure whose weight would be negative is left out and gets 0."""
    used = list(range(rows.shape[1]))
    while True:
        w = newton(np.column_stack([np.ones(len(rows)), np.log1p(rows[:, used])]), labels, ridge, rounds)
        if not used or w[1:].min() >= 0:
            break
        del used[int(np.argmin(w[1:]))]
    full = np.zeros(rows.shape[1] + 1)
    full[0] = w[0]
    full[[u + 1 for u in used]] = w[1:]
    return tuple(float(v) for v in full)


def newton(x: np.ndarray, labels: np.ndarray, ridge: float, rounds: int) -> np.ndarray:
    w = np.zeros(x.shape[1])
    penalty = np.diag([0.0] + [ridge] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + penalty + 1e-9 * np.eye(len(w)), x.T @ (labels - p) - penalty @ w)
        w = w + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def surprise(t: np.ndarray, n: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """Log-likelihood ratio of a feature's counts in toxic and clean rows against independence."""
    total = toxic + clean
    with np.errstate(divide="ignore", invalid="ignore"):
        def part(observed: np.ndarray, expected: np.ndarray) -> np.ndarray:
            return np.where(observed > 0, observed * np.log(observed / expected), 0.0)

        seen = t + n
        return 2 * (part(t, seen * toxic / total) + part(n, seen * clean / total) + part(toxic - t, (total - seen) * toxic / total) + part(clean - n, (total - seen) * clean / total))


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, strength: float = 28.0, id_col: str = "doc_id", text_col: str = "text", classes: Classes | None = None) -> Model:
    """Learns the lexicon and the curve from labelled rows with crc32(doc_id) mod 5 <> 0.

    At most about ``most_rows`` labelled rows are used (chosen by a hash of their id), so the table of their
    ids and the fitted model have a bound of their own. A word or beginning is listed if its counts are more
    surprising than ``strength`` (under one chance find in a million candidates) and it is likelier in toxic
    rows by e squared. Of several texts of one id the first in order counts; null texts are empty. ``classes`` are the
    grammar's other words. Without rows of both labels the lexicon is empty and every score alike and low.
    """
    spark = docs.sparkSession
    known = labels.where("toxic in (0, 1) and doc_id is not null and crc32(cast(doc_id as string)) % 5 <> 0").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").alias("_toxic"))
    there = known.count()
    bound = 1 << 30
    share = bound if there <= most_rows else int(bound * most_rows / there)
    sample = known.where(F.pmod(F.xxhash64("_id"), F.lit(bound)) < share)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(sample), "_id")
    rows = rows.groupBy("_id", "_toxic").agg(F.min("_text").alias("_text")).select("_toxic", "_text")  # a text for each id, so repeated rows keep the bound

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = seen[1 if toxic else 0]
                own[""] += 1
                own.update({f for w in set(WORD.findall((text or "").lower())) for f in features_of(w)})
        for toxic, own in seen.items():
            items = list(own.items())
            for at in range(0, len(items), 50_000):
                part = items[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in part]), pa.array([c if toxic else 0 for _, c in part], pa.int64()), pa.array([0 if toxic else c for _, c in part], pa.int64())], ["f", "t", "n"])

    counts = rows.mapInArrow(count, "f string, t long, n long").groupBy("f").agg(F.sum("t").alias("t"), F.sum("n").alias("n")).where("t >= 4")
    found = counts.toPandas()
    total = found[found.f == ""]
    if not len(total) or not total.n.iloc[0]:
        return Model({}, (-4.0, 0.0, 0.0, 0.0), classes=classes or Classes())
    toxic, clean = int(total.t.iloc[0]), int(total.n.iloc[0])
    t, n = found.t.to_numpy(float), found.n.to_numpy(float)
    odds = np.log((t + 0.5) / (toxic + 1)) - np.log((n + 0.5) / (clean + 1))
    keep = (surprise(t, n, toxic, clean) >= strength) & (odds >= 2.0) & (found.f != "").to_numpy() & found.f.str.contains(r"\w").to_numpy()
    classes = classes or Classes()
    closed = classes.threats | classes.targets | classes.negations | classes.reports
    model = Model({f: round(float(o) / 3, 6) for f, o in zip(found.f[keep], odds[keep], strict=True) if f not in closed}, classes=classes)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = model.reader()
        for batch in batches:
            values = [read(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), *(pa.array([v[i] for v in values], pa.float64()) for i in range(3))], ["y", "a", "b", "c"])

    data = rows.mapInArrow(measure, "y int, a double, b double, c double").toPandas()
    data = data.sort_values(["y", "a", "b", "c"])  # sums of floats then come in one order
    model.curve = fit_curve(data[["a", "b", "c"]].to_numpy(), data.y.to_numpy(float))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The frame's ids with held_out, score, predicted and clause_score of each whole text (null: empty).

    A row with a null id is scored and not held out. Repeated rows are scored alike.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = model.reader()
        for batch in batches:
            values = [read(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(v) for v in values], pa.float64()), pa.array([v[0] for v in values], pa.float64())], ["doc_id", "score", "clause_score"])

    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, "doc_id long, score double, clause_score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "clause_score")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows that the model does not call toxic, with all their columns. A null text is scored as an empty one; repeated rows stay or go alike; no rows give none."""
    names = docs.columns
    place = names.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = model.reader()
        for batch in batches:
            clean = pa.array([model.score(read(t)) < 0.5 for t in batch.column(place).to_pylist()], pa.bool_())
            yield batch.filter(clean)

    return docs.mapInArrow(work, docs.schema)
