"""Matched controls against plain versions of the rule."""

import hashlib
import random

import pytest

from sedgewren.operators import cohort

SCHEMA = "u string, c string, flag int, other int"


def posts_of(graph, positives, disclosed=(), each=3):
    """Each user posts ``each`` times in all, in its communities in turn."""
    rows = []
    for user, communities in graph.items():
        for i in range(max(each, len(communities))):
            rows.append((user, communities[i % len(communities)], int(user in positives), int(user in disclosed)))
    return rows


def matched(spark, rows, per_positive=2):
    got = cohort.matched_controls(spark.createDataFrame(rows, SCHEMA), "u", "c", "flag", ["flag", "other"], per_positive)
    return sorted((r.positive, r.control, r.community) for r in got.collect())


def in_rounds(graph, positives, pool, per_positive, seed=42):
    """The rounds with sets and sorted lists."""
    one = lambda who: hashlib.md5(f"{seed}|{who}".encode()).hexdigest()
    edge = lambda who, c: hashlib.md5(f"{seed}|{who}|{c}".encode()).hexdigest()
    need, free, out = dict.fromkeys(positives, per_positive), set(pool), []
    while True:
        open_ones = {c for u in free for c in graph[u]}
        asks = {}
        for p, n in need.items():
            if n and (found := [c for c in graph[p] if c in open_ones]):
                asks.setdefault(min(found, key=lambda c: edge(p, c)), []).append(p)
        if not asks:
            return sorted(out)
        offers = {}
        for u in free:
            if found := [c for c in graph[u] if c in asks]:
                offers.setdefault(min(found, key=lambda c: edge(u, c)), []).append(u)
        for c, wanting in asks.items():
            units = [p for p in sorted(wanting, key=one) for _ in range(need[p])]
            for p, u in zip(units, sorted(offers.get(c, []), key=one), strict=False):
                need[p] -= 1
                free.discard(u)
                out.append((p, u, c))


def one_by_one(graph, positives, pool, per_positive, rng):
    """A pass over positives that each take whoever is left in their communities: how many controls that gives."""
    chosen = set()
    for p in sorted(positives):
        left = per_positive
        for c in rng.sample(graph[p], len(graph[p])):
            for u in rng.sample(pool, len(pool)):
                if left and c in graph[u] and u not in chosen:
                    chosen.add(u)
                    left -= 1
    return len(chosen)


@pytest.mark.parametrize("seed, users, communities", [(1, 60, 6), (2, 90, 25), (3, 40, 1)])
def test_rounds_leave_nobody_short_who_could_be_served(spark, seed, users, communities):
    rng = random.Random(seed)
    graph = {f"u{i}": rng.sample([f"c{j}" for j in range(communities)], rng.randint(1, min(4, communities))) for i in range(users)}
    names = sorted(graph)
    positives, disclosed = set(names[: users // 3]), set(names[users // 3 : users // 3 + 5])
    pool = [u for u in names if u not in positives | disclosed]
    got = matched(spark, posts_of(graph, positives, disclosed))
    assert got == in_rounds(graph, positives, pool, 2)
    used = [u for _, u, _ in got]
    assert len(set(used)) == len(used) and set(used) <= set(pool) and all(c in graph[p] and c in graph[u] for p, u, c in got)
    served = {p: sum(g[0] == p for g in got) for p in positives}
    for p in positives:
        assert served[p] == 2 or not any(set(graph[p]) & set(graph[u]) for u in set(pool) - set(used))
    # Both leave no pair that could still be made, so neither gives fewer than half of the other; with one community they give as many.
    plain = one_by_one(graph, positives, pool, 2, rng)
    assert len(got) * 2 >= plain and len(got) <= plain * 2 and (communities > 1 or len(got) == plain)


def test_a_positive_asks_on_when_its_first_community_runs_out(spark):
    graph = {"p": ["a", "b", "c"], "x": ["a"], "y": ["b"], "z": ["c"], "q": ["a"]}
    got = matched(spark, posts_of(graph, {"p", "q"}), 3)
    assert {g[1] for g in got} == {"x", "y", "z"} and {g[0] for g in got if g[1] != "x"} == {"p"}


def test_odd_rows(spark):
    rows = posts_of({"p": ["a"], "x": ["a"]}, {"p"}) + [(None, "a", 1, 0), ("n", None, 1, 0), ("m", None, 0, 0), ("m", None, 0, 0), ("m", None, 0, 0), ("few", "a", 0, 0)]
    assert matched(spark, rows) == [("p", "x", "a")]
    assert matched(spark, rows[:0]) == []
    assert matched(spark, posts_of({"x": ["a"], "y": ["a"]}, set())) == []


def test_greedy_pass_equals_a_plain_one(spark):
    """One text after the other: it stays if no earlier one of its group that stayed is near."""
    from sedgewren.operators import dedup

    rng = random.Random(11)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(150):
        base = rng.choices(words, k=30) if i % 3 == 0 or not rows else rows[rng.randrange(len(rows))][2].split()
        if i % 3:
            base[rng.randrange(len(base))] = rng.choice(words)
        rows.append((i, f"g{i % 2}", " ".join(base)))
    frame = spark.createDataFrame(rows, "id long, g string, t string")
    signature = {r.id: r.sig for r in dedup.signatures(frame, "id", "t", ("g",)).collect()}
    near = lambda a, b: ((signature[a] ^ signature[b]) & ((1 << 64) - 1)).bit_count() <= 5
    kept = []
    for i, g, _ in rows:
        if not any(h == g and near(i, j) for j, h in kept):
            kept.append((i, g))
    assert {r.id for r in dedup.greedy_near_dedup(frame, "id", "g", "t").collect()} == {i for i, _ in kept} and len(kept) < 150
    links = {(r.a, r.b): r.distance for r in dedup.near_links(dedup.signatures(frame, "id", "t", ("g",)), "id", "g").collect()}
    firsts = {}
    for i, g, _ in rows:
        firsts.setdefault((g, signature[i]), i)
    heads = sorted(firsts.values())
    want = {(a, b): ((signature[a] ^ signature[b]) & ((1 << 64) - 1)).bit_count() for a in heads for b in heads if a < b and rows[a][1] == rows[b][1] and near(a, b)}
    want |= {(firsts[g, signature[i]], i): 0 for i, g, _ in rows if firsts[g, signature[i]] != i}
    assert links == want
