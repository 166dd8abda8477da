"""Embedding near-dedup: links, components and recall against brute force."""

import numpy as np

from sedgewren.llm import embeddings


def brute(rows, least=0.98):
    vectors, root = {}, {k: k for k, _, _ in rows}
    for key, e, label in rows:
        if label is not None and e and all(v is not None and np.isfinite(v) for v in e) and any(e):
            scaled = np.array(e, dtype=float) / np.abs(e).max()  # so that no square overflows
            vectors[key] = (scaled / np.linalg.norm(scaled), label)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = {k: 0 for k, _, _ in rows}
    keys = sorted(vectors)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if vectors[a][1] == vectors[b][1] and len(vectors[a][0]) == len(vectors[b][0]) and vectors[a][0] @ vectors[b][0] >= least:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (links[k], find(k)) for k in links}


def rows_of(n=1200, dim=32):
    rng = np.random.default_rng(3)
    rows, base = [], rng.normal(size=(n, dim))
    for i in range(n):
        e = base[i] if i % 3 else base[i - i % 60] + rng.normal(size=dim) * 0.09
        rows.append((i, [float(v) for v in e], int(i % 2)))
    rows += [(n + i, [float(v) for v in base[7] + rng.normal(size=dim) * 0.02], 1) for i in range(150)]
    rows += [(9001, None, 1), (9002, [0.0] * dim, 1), (9003, [float("nan")] * dim, 1), (9004, [None] * dim, 1), (9005, rows[1][1], None), (9006, [float("inf")] + [1.0] * (dim - 1), 1), (9007, [], 0), (9008, [1e200] * dim, 0), (9009, [2e-200] * dim, 0), (9010, [1.0, 2.0], 0), (9011, [2.0, 4.0], 0)]
    return rows


def test_equal_to_brute_force(spark):
    rows = rows_of()
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, kept int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_dedup(frame, leaf=64, tile=60).collect()}
    expected = brute(rows)
    assert set(got) == set(expected)
    found, there = sum(v[0] for v in got.values()), sum(v[0] for v in expected.values())
    assert all(got[k][0] <= expected[k][0] for k in got) and found >= 0.97 * there
    assert sum(got[k][1] == expected[k][1] for k in got) >= 0.99 * len(got)
    assert got[9008] == (1, 9008) and got[9009] == (1, 9008) and got[9010] == (1, 9010)


def test_tiles_lose_nothing(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in 1 + rng.normal(size=8) * 0.01], 0) for i in range(300)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = embeddings.near_dedup(frame, tile=40).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(299, 0)} and [r.vec_id for r in got if r.kept] == [0]


def test_null_ids_and_empty_table(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert embeddings.near_dedup(spark.createDataFrame([], schema)).count() == 0
    got = embeddings.near_dedup(spark.createDataFrame([(None, [1.0], 1), (4, [1.0], 1)], schema)).collect()
    assert sorted(((r.vec_id, r.n_links) for r in got), key=str) == [(4, 0), (None, 0)]


def test_repeated_ids_and_copies_are_vectors_of_their_own(spark):
    rows = [(5, [1.0, 0.0], 0), (5, [1.0, 0.0], 0), (6, [1.0, 0.0], 0), (7, [0.999, 0.01], 0), (5, [0.0, 1.0], 0), (8, [1.0, 0.0], 1), (4, [0.0, 1.0], None)]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [(4, 0, 4, True), (5, 0, 5, True), (5, 3, 5, True), (5, 3, 5, True), (6, 3, 5, False), (7, 3, 5, False), (8, 0, 8, True)]


def test_recall_below_the_fitted_levels_and_away_from_the_origin():
    """Trees of 14 levels on data far from the origin: pairs at the least cosine still meet in some leaf."""
    rng = np.random.default_rng(4)
    for dim, shift in ((64, 0.0), (384, 0.0), (64, 0.6)):
        a = embeddings.unit(rng.normal(size=(3000, dim)) + shift)
        noise = rng.normal(size=a.shape)
        noise -= (noise * a).sum(axis=1, keepdims=True) * a
        b = embeddings.unit(a + embeddings.unit(noise) * np.tan(np.arccos(0.981)))
        met, copies, spill = np.zeros(len(a), dtype=bool), 0, 1.2 * np.sqrt(0.04) / np.sqrt(dim)
        for t in range(6):
            tree = embeddings.grow(a, 14, dim, np.random.default_rng(t))
            at = [dict() for _ in range(2)]
            for side, x in enumerate((a, b)):
                rows, node = embeddings.leaves(tree, x, spill)
                copies += len(rows)
                for r, n in zip(rows.tolist(), node.tolist(), strict=True):
                    at[side].setdefault(r, set()).add(n)
            met |= np.array([bool(at[0][i] & at[1][i]) for i in range(len(a))])
        assert met.mean() >= 0.97, (dim, shift, met.mean())
