"""SimHash groups against brute force."""

import random

import xxhash

from sedgewren.llm import simhash


def slow_fingerprint(text, size=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(prints):
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def texts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(120):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 40, 400]))]
        rows.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 3])):
            copy = list(base)
            copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append(" ".join(copy))
    return rows + [None, "", " \t\n", "A b", "a B", "É é\x0bx", rows[0], rows[0].upper()] + ["long " * 50_000]


def test_groups_match_brute_force(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, fp int, rep int")
    got = {r.id: (r.fp % (1 << 64), r.component_id) for r in simhash.simhash_groups(docs).collect()}
    prints = {i: slow_fingerprint(t) for i, t in rows}
    assert {i: g[0] for i, g in got.items()} == prints
    assert {i: g[1] for i, g in got.items()} == slow_groups(prints)


def test_chains_of_single_flips_are_one_component(spark):
    from sedgewren.llm.common import Scratch, components

    values, fp = [0], 0
    for bit in range(0, 60, 2):
        fp ^= 3 << bit
        values.append(fp - (1 << 64) if fp >> 63 else fp)
    reps = spark.createDataFrame([(i * 7 % 31, v) for i, v in enumerate(values)], "rep long, fp long")
    scratch = Scratch(spark, "t")
    found = components(simhash.near_links(reps, scratch), scratch)
    assert {(r.node, r.component) for r in found.collect()} == {(i, 0) for i in range(31)}


def test_links_among_hot_and_cold_segments_equal_all_pairs(spark):
    """Half the fingerprints share a segment's value, in either segment; the others are near some of them, or not."""
    from sedgewren.llm.common import Scratch, components

    rng, values = random.Random(8), set()
    hot = [rng.getrandbits(32), rng.getrandbits(32) << 32]
    for _ in range(300):
        values.add(hot[0] | rng.getrandbits(10) << 40)
        values.add(hot[1] | rng.getrandbits(10) << 3)
    for v in rng.sample(sorted(values), 150):
        values.add(v ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
        values.add(v ^ 1 << rng.randrange(64))
    values |= {rng.getrandbits(64) for _ in range(100)}
    prints = dict(enumerate(sorted(values)))
    reps = spark.createDataFrame([(i, v - (1 << 64) if v >> 63 else v) for i, v in prints.items()], "rep long, fp long")
    scratch = Scratch(spark, "t")
    links = simhash.near_links(reps, scratch).collect()
    assert links and all((prints[r.u] ^ prints[r.v]).bit_count() <= 2 for r in links)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long"), scratch).collect()}
    assert {i: got.get(i, i) for i in prints} == slow_groups(prints)


def test_empty_table_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_groups(empty).count() == 0
    rows = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (5, "a b c"), (None, "quite other words here")], "doc_id long, text string")
    got = sorted(((r.id, r.component_id) for r in simhash.simhash_groups(rows).collect()), key=str)
    assert got == [(5, 5), (5, 5), (None, 5), (None, None)]


def test_rarest_shingles_bring_all_alike_sets_together_and_few_others(spark):
    rng, fresh = random.Random(4), iter(range(10**6, 10**7))
    sets = [set(range(i * 1000, i * 1000 + size)) for i, size in enumerate([1, 3, 7, 40, 150, 151, 400])]
    for base in list(sets):
        for _ in range(12):
            gone = set(rng.sample(sorted(base), rng.randrange(len(base) // 4 + 1)))
            sets.append(base - gone | {next(fresh) for _ in range(rng.randrange(len(base) // 8 + 1))})
    base = range(50_000, 50_150)  # each pair shares over half, none 80 %
    far = [{next(fresh) if i * 20 <= k - base[0] < i * 20 + 8 or k % 15 == 0 else k for k in base} | {next(fresh) for _ in range(8)} for i in range(7)]
    sets += far
    rows = simhash.prefix_rows(spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "whole long, hashes array<long>")).collect()
    met = {}
    for r in rows:
        met.setdefault((r.hash, r["class"]), []).append(r)
    together = {tuple(sorted((x.whole, y.whole))) for at in met.values() for x in at if x.own for y in at if x.whole != y.whole}
    alike = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    first = len(sets) - len(far)
    assert len(alike) > 150 and alike <= together
    assert all(len(sets[a] & sets[b]) > 0.5 * len(sets[a] | sets[b]) for a in range(first, len(sets)) for b in range(first, len(sets)))
    assert not any(a >= first for a, _ in together)
