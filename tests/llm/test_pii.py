"""Personal data against the patterns as given, and what bootstrapping adds."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from sedgewren.llm import pii


def slow(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m.group())
        if 16 <= len(digits) <= 19 and sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(["1", "22", "255", "4539578763621486", ".", "@", "a", "b.c", "-", " ", "+1", "(", ")", "%", "é", "\n", "555-7209", "0"]), max_size=25).map("".join))
def test_base_spans_are_the_patterns(text):
    assert pii.base_spans(text) == slow(text)


def test_long_runs_take_no_square_time():
    assert pii.base_spans("a" * 300_000 + "1" * 300_000 + "." * 1000) == []


def hexes(rng):
    return "".join(rng.choice("0123456789abcdef") for _ in range(40))


def test_bootstrapping_finds_what_no_pattern_lists(spark):
    rng = random.Random(2)
    texts = [f'some words token = "{hexes(rng)}" more words {i}' for i in range(8)]
    texts += ['here token = "A1-unseen-identifier" ends', "write to a.b@mail.example.com or +1 (487) 555-7209", "plain: words, note: none = nothing", None, "", texts[0]]
    frame = spark.createDataFrame([(i if i != 3 else None, t, 4) for i, t in enumerate(texts)], "doc_id long, text string, spans int")
    got = pii.find_private(frame).collect()
    assert len(got) == len(texts)
    by = {r.doc_id: r for r in got}
    span = by[8].spans.split(":")
    assert span[0] == "secret" and texts[8][int(span[1]) : int(span[2])] == "A1-unseen-identifier"
    assert by[9].base == by[9].spans and (by[9].n_email, by[9].n_phone) == (1, 1)
    assert by[10].spans == "" and by[12].spans == "" and by[None].spans.startswith("secret:")
    clean = {r.doc_id: r.text for r in pii.redact(frame).collect()}
    assert clean[8] == 'here token = "[SECRET]" ends' and clean[9] == "write to [EMAIL] or [PHONE]" and clean[11] is None
    assert pii.redact(frame).columns == frame.columns


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find_private(empty).count() == 0 and pii.redact(empty).count() == 0


def test_long_values_are_redacted_whole(spark):
    rng = random.Random(4)
    long = "".join(rng.choice("0123456789abcdef") for _ in range(5000))
    web = "eyJ0." + "".join(rng.choice("ABCDEFabcdef0123456789_-") for _ in range(3000))
    texts = [f'some words token = "{hexes(rng)}" more words {i}' for i in range(8)]
    texts += [f'here token = "{long}" ends', f'here token = "{web}" ends', f"see link:https://host.example/{'p/' * 100}?token=\"{hexes(rng)}\" ends", f"x token = \"{web[:-1]}\" y"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.redact(frame).collect()}
    assert clean[8] == clean[9] == 'here token = "[SECRET]" ends' and clean[11] == 'x token = "[SECRET]" y'
    values = [pii.labelled(t, [])[-1] for t in (texts[9], texts[11])]
    assert values[0][1] != values[1][1]
    assert [x[0] for x in pii.labelled("a1=" + "x" * 200 + "&token=abcdef", [])][1:] == ["token = "]


def slow_learn(edges, rounds=3, support=3, sure=0.6):
    """The scoring of the pattern graph in plain dictionaries."""
    graph = {}
    for pattern, value, kind, identifier in edges:
        old = graph.get((pattern, value), (None, False))
        graph[pattern, value] = (max(filter(None, (old[0], kind)), default=None), old[1] or identifier)
    sizes = {}
    for p, _ in graph:
        sizes[p] = sizes.get(p, 0) + 1
    seeds = {(p, v, k): 1.0 for (p, v), (k, _) in graph.items() if k}
    values, scored = dict(seeds), {}
    for _ in range(rounds):
        scored = {}
        for (p, _v, k), conf in values.items():
            mass, held = scored.get((p, k), (0.0, 0))
            scored[p, k] = (mass + conf, held + 1)
        scored = {(p, k): (mass / (sizes[p] + 1), held) for (p, k), (mass, held) in scored.items()}
        best = {}
        for (p, v), (kind, identifier) in graph.items():
            if kind is None and identifier:
                for (q, k), (conf, _h) in scored.items():
                    if q == p and conf >= sure / 2:
                        best[v, k] = max(best.get((v, k), 0.0), conf)
        values = dict(seeds)
        for (p, v), (kind, identifier) in graph.items():
            if kind is None and identifier:
                values |= {(p, v, k): conf for (w, k), conf in best.items() if w == v}
    good = {}
    for (p, k), (conf, held) in scored.items():
        if conf >= sure and held >= support:
            good[p] = max(good.get(p, (0.0, "")), (conf, k))
    return {p: k for p, (_, k) in good.items()}


def test_scores_of_the_graph_equal_a_plain_version(spark):
    from sedgewren.llm.common import Scratch

    rng = random.Random(6)
    edges = [(f"p{rng.randrange(12)}", rng.randrange(40), rng.choice(["email", "phone", None, None]), rng.random() < 0.8) for _ in range(400)]
    got = {r.pattern: r.kind for r in pii.score_patterns(spark.createDataFrame(edges, "pattern string, value long, kind string, identifier boolean"), Scratch(spark, "t"), sure=0.4).collect()}
    assert got == slow_learn(edges, sure=0.4) and got


def test_words_on_both_sides_are_learned(spark):
    rng = random.Random(7)
    texts = [f"please call {rng.randrange(10**6)} and dial +1 (487) 555-{1000 + i} tonight with news {i}" for i in range(8)]
    texts += ["then dial 20-55-99-11x tonight maybe", "the year 2024-10-11 of nothing", "and dial 77a-88b-99c"]
    got = {r.doc_id: r.spans for r in pii.find_private(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[8] == f"phone:10:{10 + len('20-55-99-11x')}" and got[9] == "" and got[10] == f"phone:9:{9 + len('77a-88b-99c')}"
    assert [x[0] for x in pii.around("my id: ab12345, ok", [])] == ["id : _"] and pii.around("| 123456 |", []) == []
    assert [x[0] for x in pii.around("x " + "9" * 300_000 + " y", [])] == ["x _ y"]


def test_values_and_labels_of_any_length_follow_one_rule():
    digits = "0123456789abcdef" * 4
    for filler in ("k" * 20, "k" * 200_000):
        text = f"token={filler}secret={digits}"
        assert [(x[0], x[4], x[5]) for x in pii.labelled(text, [])] == [("token = ", 6, len(text))]
        long = f"{filler}secret={digits}"
        assert [(x[0], x[2], x[4]) for x in pii.labelled(long, [])] == [(f"{pii.named(filler + 'secret')} = ", "secret", len(filler) + 7)]
    assert [x[0] for x in pii.labelled("see https://h.example/a?token=abcdef&session=123456 12key: value", [])] == ["token = ", "session = ", "key : "]
    assert pii.labelled("ab=" * 200_000, [])[0][4:] == (3, 600_000) and pii.labelled("a" * 400_000, []) == [] and pii.labelled("ab=//" * 100_000, []) == []


def slow_words(text, place, back):
    words = [m for m in re.finditer(r"[^\W\d_]+|[^\w\s]", text[:place] if back else text[place:])]
    words = words[-2:] if back else words[:1]
    return [(w.group().casefold(), w.group().isalpha()) for w in words]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["word", "é", "1", "22", " ", "_", ".", "- ", "A", "\n", "9"]), max_size=30).map("".join), st.data())
def test_words_next_to_places(text, data):
    places = data.draw(st.lists(st.integers(0, len(text)), max_size=6))
    assert pii.words_before(text, places) == [slow_words(text, p, True) for p in places]
    assert pii.words_after(text, places) == [(slow_words(text, p, False) or [None])[0] for p in places]


def test_contexts_know_no_distance():
    gap = " " * 500
    assert [x[0] for x in pii.around(f"call dial{gap}ab12345{gap}tonight", [])] == ["call dial _", "dial _ tonight"]
    word = "w" * 40
    assert [x[0] for x in pii.around(f"my {word} ab12345", [])] == [f"my {word} _"]
    assert len(pii.around("x y " + "123456 " * 100_000, [])) == 100_000


def slow_merged(base, added):
    spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in base.split(",") if s)]
    free = [s for s in added if not any(a < s["end"] and s["start"] < b for _, a, b in spans)]
    groups = []
    for s in sorted(free, key=lambda s: (s["start"], s["end"], s["kind"])):
        for g in groups:
            if any(s["start"] < t["end"] and t["start"] < s["end"] for t in g):
                g.append(s)
                break
        else:
            groups.append([s])
    spans += [(g[0]["kind"], min(t["start"] for t in g), max(t["end"] for t in g)) for g in groups]
    order = [*pii.KINDS, *sorted({k for k, _, _ in spans} - set(pii.KINDS))]
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (order.index(s[0]), s[1], s[2])))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(pii.KINDS), st.integers(0, 40), st.integers(1, 8)), max_size=5), st.lists(st.tuples(st.sampled_from(["secret", "email", "a"]), st.integers(0, 60), st.integers(1, 9)), max_size=8))
def test_merging_equals_a_plain_version(base, added):
    spans = sorted({(k, a, a + n) for k, a, n in base}, key=lambda s: (pii.KINDS.index(s[0]), s[1], s[2]))
    more = [{"kind": k, "start": a, "end": a + n} for k, a, n in sorted(set(added))]
    assert pii.merged(pii.joined(spans), more) == slow_merged(pii.joined(spans), more)


def test_very_many_spans_in_one_text(spark):
    rng = random.Random(9)
    many = " ".join(f"a{i}@mail.example.com token: x{i}y{rng.randrange(10**9)}" for i in range(100_000))
    texts = [many, *[f"token: {hexes(rng)} {i}" for i in range(8)]]
    row = pii.find_private(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).where("doc_id = 0").first()
    assert row.n_email == 100_000 and row.spans.count(",") + 1 >= 100_000
