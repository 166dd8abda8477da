"""Repeated passages against a table of all word runs."""

import random
import re

import numpy as np

from sedgewren.llm import suffixes


def brute(rows, least=50):
    seen, texts = {}, sorted({(k, t) for k, t in rows if k is not None and t is not None})
    for key, text in texts:
        words = text.split()
        for i in range(len(words) - least + 1):
            seen.setdefault(tuple(words[i : i + least]), set()).add(key)
    out = []
    for key, text in texts:
        words, spans = text.split(), [m.span() for m in re.finditer(r"\S+", text)]
        hits = [i for i in range(len(words) - least + 1) if len(seen[tuple(words[i : i + least])]) > 1]
        groups = []
        for i in hits:
            if groups and i <= groups[-1][1] + least:
                groups[-1][1] = i
            else:
                groups.append([i, i])
        for a, b in groups:
            out.append((key, spans[a][0], spans[b + least - 1][1], b + least - a))
    return sorted(out)


def rows_of():
    rng = random.Random(6)
    vocabulary = [f"w{i}é" for i in range(500)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passages = [say(n) for n in (49, 50, 51, 60, 200)]
    rows = [(i, f"{say(rng.randrange(0, 90))}  {rng.choice(passages)}\n{say(rng.randrange(0, 90))} {rng.choice(passages)}") for i in range(80)]
    rows += [(100 + i, passages[3]) for i in range(30)] + [(200, None), (None, passages[4]), (201, ""), (202, say(49)), (203, "a " * 3000), (204, "a " * 80), (205, rows[0][1]), (206, f"{passages[1]} {say(60)} {passages[1]}"), (207, say(40_000) + " " + passages[2])]
    return rows


def found(spark, rows, parts=4):
    frame = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, start int").repartition(parts)
    return sorted((r.doc_id, r.start, r.end, r.n_words) for r in suffixes.repeated_passages(frame).collect())


def test_equal_to_brute_force(spark):
    assert found(spark, rows_of()) == brute(rows_of())


def test_groups_over_many_blocks_and_ranges(spark, monkeypatch):
    """Blocks of a few contexts: nearly every group goes over a block's end, and its parts exchange runs."""
    monkeypatch.setattr(suffixes, "BLOCK", 5)
    rng = random.Random(12)
    say = lambda n: " ".join(rng.choice("abcd") + str(rng.randrange(40)) for _ in range(n))
    core = say(55)
    rows = [(i, f"{say(rng.randrange(0, 40))} {core} {say(rng.randrange(0, 40))}") for i in range(60)]
    # Matches that reach far to the left or to the right only with one partner each.
    left, right = say(28), say(28)
    rows += [(100, f"{left} {core.split(' ', 30)[30]}"), (101, f"{left} {' '.join(core.split()[:26])} q"), (102, f"{' '.join(core.split()[30:])} {right}"), (103, f"{core} {right}"), (104, f"{left} {core} {right}")]
    rows += [(200, "\0a \1b \1\1 " * 30), (201, "x \0a \1b \1\1 " + "\0a \1b \1\1 " * 29), (202, "y\0 " * 70), (203, "y\1\1 " * 70), (204, "z y\0 " + "y\0 " * 69)]
    assert found(spark, rows) == brute(rows)


def test_texts_of_one_id_are_kept_apart(spark):
    rng = random.Random(13)
    words = [f"v{i}" for i in range(400)]
    shared = " ".join(rng.choice(words) for _ in range(60))
    tail = lambda: " ".join(rng.choice(words) for _ in range(20))
    rows = [(1, f"{shared} {tail()}"), (1, f"{tail()} {shared}"), (2, f"{tail()} {tail()} {shared}"), (2, rows_of()[0][1]), (1, "a b"), (3, f"{shared} {tail()}")]
    rows += [rows[0], rows[0]]
    assert found(spark, rows) == brute(rows) and len(found(spark, rows)) == 4


def test_passages_inside_one_document_alone_do_not_count(spark):
    text = " ".join(f"x{i}" for i in range(60))
    assert suffixes.repeated_passages(spark.createDataFrame([(1, f"{text} y {text}"), (1, text)], "doc_id long, text string")).count() == 0
    assert suffixes.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_every_long_window_keeps_a_shared_suffix():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    seeds = suffixes.runs(words, 20)
    kept = set(suffixes.minimisers(seeds, 31).tolist())
    assert all(any(p in kept for p in range(i, i + 31)) for i in range(len(seeds) - 30))
    assert len(kept) < len(seeds) / 8
