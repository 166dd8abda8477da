"""Toxicity: the grammar's parts, and held-out accuracy."""

import random
import zlib

from sedgewren.llm import toxicity

MODEL = toxicity.Model({"fool": 2.0, "scoun*": 2.0}, (-3.0, 4.0, 0.0, 0.0))


def clause(text):
    return MODEL.reader()(text)[0]


def test_grammar_scores_clauses_not_words():
    assert clause("you fool") > clause("fool") > clause("not a fool") > 0
    assert clause("he said you fool") < clause("you fool")
    assert clause("scoundrels") == 2.0 and clause("a quiet day") == 0
    assert clause("you fool") >= clause("fool you") > clause("fool")
    assert clause("not so. fool") == clause("fool")
    assert clause("I will kill you") > 0 and clause("kill the lights") == 0
    assert MODEL.reader()("you fool. fool")[1] == clause("you fool") + clause("fool")


def test_composition_equals_running_one_after_the_other():
    rng = random.Random(3)
    first, second = toxicity.negation(), toxicity.clause()
    both = toxicity.compose(first, second)
    for _ in range(200):
        a = b = c = 0
        for symbol in rng.choices(range(7), k=12):
            a, out, w1 = first.arcs[a][symbol]
            b, _, w2 = second.arcs[b][out]
            c, _, w = both.arcs[c][symbol]
            assert w == w1 + w2


def corpus():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(1500):
        toxic = i % 6 == 0
        text = [rng.choice(words) for _ in range(rng.randrange(5, 120))]
        for _ in range(rng.randrange(1, 4) if toxic else 0):
            text.insert(rng.randrange(len(text)), rng.choice(["blargh", "Zounderix", "fnordings", "fnordest"]))
        rows.append((i, " ".join(text), int(toxic)))
    return rows


def test_held_out_accuracy_and_odd_rows(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 0.1) for i, t, _ in rows] + [(None, "blargh blargh", 0.1), (5000, None, 0.1), (5001, "", 0.1), (5002, "blargh " * 100_000, 0.1), (0, rows[0][1], 0.1)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert {"blargh", "zounderix"} <= set(model.lexicon) and any(f.startswith("fnord") for f in model.lexicon)
    got = toxicity.score(docs, model).collect()
    assert len(got) == docs.count()
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    odd = {r.doc_id: r for r in got if r.doc_id in (None, 5000, 5001)}
    assert odd[None].predicted == 1 and not odd[None].held_out and odd[5000].score == odd[5001].score < 0.5
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(1 for r in got if not r.predicted)


def test_training_ignores_held_out_labels(spark):
    rows = corpus()
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, _, y in rows]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    a = toxicity.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    b = toxicity.train(docs, spark.createDataFrame(flipped, "doc_id long, toxic int"))
    assert a.lexicon == b.lexicon and a.curve == b.curve


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert toxicity.score(docs, model).count() == 0
    assert toxicity.score(spark.createDataFrame([(1, "a")], "doc_id long, text string"), model).first().predicted == 0


def plain_clause(words, lexicon, classes):
    """A clause's score by looking around from each word, without any machine."""
    weight = lambda w: max(lexicon.get(f, 0.0) for f in toxicity.features_of(w))
    kind = lambda w: next((k for k in ("reports", "negations", "targets", "threats") if w in getattr(classes, k)), "insult" if weight(w) > 0 else "")
    kinds = ["comma" if w == "," else kind(w) for w in words]

    def abuse(i):
        """An insult, or a threat that has its target by then."""
        return kinds[i] == "insult" or kinds[i] == "threats" and "targets" in kinds[:i]

    score = 0.0
    for i, k in enumerate(kinds):
        near = next(([*reversed(kinds[:i])][:n] for n in range(i + 1) if n == i or kinds[i - 1 - n] == "comma"), [])[:3]
        factor = 0.5 if "negations" in near else 0.7 if "reports" in kinds[:i] else 1.0
        targeted = "targets" in kinds[:i]
        # Abuse was said: an insult, a threat after a target, or a threat whose target came later.
        said = any(abuse(j) or kinds[j] == "threats" and "targets" in kinds[j:i] for j in range(i))
        first = 0.5 if targeted and not said else 0.0
        if k == "insult":
            score += weight(words[i]) * (factor + first)
        elif k == "threats" and targeted:
            score += 0.6 * factor + first
        elif k == "targets":
            last = max((j for j in range(i) if kinds[j] == "targets"), default=-1)
            waiting = last < 0 and "threats" in kinds[:i]
            score += 0.6 if waiting else 0.0
            score += 0.5 if not targeted and (said or waiting) else 0.0
    return score


def test_scores_equal_a_plain_reading():
    rng = random.Random(12)
    pool = ["fool", "scoundrel", "kill", "you", "not", "said", "word", "thing", ","]
    for _ in range(3000):
        words = rng.choices(pool, k=rng.randrange(1, 9))
        assert abs(clause(" ".join(words)) - plain_clause(words, MODEL.lexicon, MODEL.classes)) < 1e-9, words


def test_other_classes_and_repeated_ids(spark):
    own = toxicity.Classes(threats=frozenset(["zap"]), targets=frozenset(["ye"]))
    model = toxicity.Model({"fool": 2.0}, classes=own)
    assert model.reader()("zap ye")[0] > 0 and model.reader()("kill you")[0] == 0
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1, "blargh " * 5)] * 3000, "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    once = spark.createDataFrame([(i, min(t, "blargh " * 5) if i == 1 else t) for i, t, _ in rows], "doc_id long, text string")
    assert toxicity.train(docs, labels) == toxicity.train(once, labels)
