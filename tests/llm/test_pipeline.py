"""Near copies and the pipeline against brute force on a small corpus."""

import random

import corpus_pipeline
from sedgewren.llm import decontam, pii, simhash, toxicity
from tests.llm.test_decontam import best


def shingles(text, size=5):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def alike(a, b):
    return 1.0 if a == b else len(a & b) / len(a | b)


def mutate(rng, words, text, n):
    out = text.split()
    for _ in range(n):
        out[rng.randrange(len(out))] = rng.choice(words)
    return " ".join(out)


def corpus():
    rng = random.Random(11)
    words = ["".join(rng.choice(["ba", "ke", "li", "mo", "nu", "ty", "sor", "vex"]) for _ in range(rng.randrange(1, 5))) for _ in range(900)]
    rows = [" ".join(rng.choice(words) for _ in range(rng.randrange(60, 300))) for _ in range(150)]
    for i in range(0, 60, 3):
        rows += [mutate(rng, words, rows[i], rng.choice([1, 2])) for _ in range(2)] + [rows[i].upper()]
    rows += [mutate(rng, words, rows[100], 1) for _ in range(90)]
    return [(i, t) for i, t in enumerate(rows)], words


def test_near_copies_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 40)
    rows, _ = corpus()
    frame = spark.createDataFrame([*rows, (900, None), (901, ""), (None, rows[0][1]), (902, " ")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_copies(frame).collect()}
    sets = {i: shingles(t) for i, t in rows}
    ids, lost, pairs = sorted(sets), 0, 0
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            s = alike(sets[a], sets[b])
            if s >= 0.8:
                pairs += 1
                lost += got[a] != got[b]
            elif s == 0:
                assert got[a] != got[b]
    assert pairs > 3000 and lost <= 0.03 * pairs
    assert got[900] == got[901] == got[902] == 900 and None not in got


def test_one_of_each_group_stays(spark):
    rows = [(5, "one two three four five six", 1), (5, "one two three four five six", 1), (7, "ONE two three four five six", 2), (None, "one two three four five six", 3), (9, "other words entirely here to stay", 4), (9, "yet another text of this same id", 5)]
    got = sorted(simhash.drop_copies(spark.createDataFrame(rows, "doc_id long, text string, n int")).collect(), key=str)
    assert [(r.doc_id, r.n) for r in got] == [(5, 1), (9, 4), (9, 5), (None, 3)]
    assert simhash.drop_copies(spark.createDataFrame([], "doc_id long, text string, n int")).count() == 0


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(3)
    rows, words = corpus()
    item = " ".join(rng.choice(words) for _ in range(30))
    rows = [(i, f"{t} zounder blargh {t[:40]} blargh" if i % 7 == 0 and i < 150 else t) for i, t in rows]
    rows += [(1000, f"{rows[1][1]} {item} {rows[2][1]}"), (1001, f'mail a@b.example.com token = "{"0a1b" * 10}" {rows[3][1]} {rows[4][1]}'), (1002, None), (1003, "")]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t) if t is not None else None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int("blargh" in (t or ""))) for i, t in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sf_dir, current = str(tmp_path), spark.read.parquet(f"{tmp_path}/documents.parquet")
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = current.collect() if name != "packing" else None
        stage(spark, current, sf_dir).write.parquet(f"{tmp_path}/out{number}")
        after_frame = spark.read.parquet(f"{tmp_path}/out{number}")
        after = after_frame.collect()
        if name != "packing":
            assert after_frame.columns == docs.columns
        kept = {r.doc_id for r in after}
        if name == "toxicity":
            model = toxicity.train(current, spark.read.parquet(f"{sf_dir}/labels.parquet"))
            read = model.reader()
            assert kept == {r.doc_id for r in before if model.score(read(r.text)) < 0.5}
            assert not any("blargh" in (r.text or "") for r in after) and len(after) > 0.8 * len(before)
        elif name == "simhash_near_dedup":
            sets = {r.doc_id: shingles(r.text) for r in before}
            for gone in set(sets) - kept:
                assert any(alike(sets[gone], sets[k]) >= 0.6 for k in sets if k != gone)
            left = sorted(kept)
            both = sum(alike(sets[a], sets[b]) >= 0.8 for n, a in enumerate(left) for b in left[n + 1 :])
            assert both <= 3
        elif name == "benchmark_decontamination":
            test = decontam.make_items([(1, item)], 0.1, 40)[0]
            assert kept == {r.doc_id for r in before if best(test.text, decontam.fold_only(r.text or "")) > test.budget}
            assert 1000 not in kept
        elif name == "pii":
            assert kept == {r.doc_id for r in before}
            own = next(r for r in after if r.doc_id == 1001)
            assert own.text.startswith('mail [EMAIL] token = "') and own.n_chars == len(own.text)
            assert all(not pii.base_spans(r.text or "") for r in after)
        else:
            assert {r.doc_id for r in after} == {r.doc_id for r in current.collect()}
        current = after_frame
    assert corpus_pipeline.run(spark, sf_dir).count() == current.count()


def blocks():
    """Pairs of a text and the same text with a block appended or its tail cut, alike to 0.8 or more, and somewhat less."""
    rng = random.Random(5)
    words = ["".join(rng.choice("aeioubdgklmnprst") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    near, apart = [], []
    for _ in range(150):
        base = [rng.choice(words) for _ in range(rng.randrange(100, 700))]
        for share in (0.1, 0.15, 0.22, 0.32):
            more = [rng.choice(words) for _ in range(int(len(base) * share))]
            for other in (base + more, base[: int(len(base) / (1 + share))]):
                pair = " ".join(base), " ".join(other)
                (near if alike(shingles(pair[0]), shingles(pair[1])) >= 0.8 else apart).append(pair)
    return near, apart


def test_appended_and_cut_copies_meet():
    near, _ = blocks()
    missed = sum(not set(simhash.sketches(a, 5)[1].tolist()) & set(simhash.sketches(b, 5)[1].tolist()) for a, b in near)
    assert len(near) > 800 and missed == 0


def test_exact_similarity_decides(spark):
    near, apart = blocks()
    short = [f"s{i}" for i in range(9)]
    near = [*near[:300], (" ".join(short), " ".join(short[:8]))]
    pairs = near + apart[:300]
    rows = [(2 * i + k, text) for i, pair in enumerate(pairs) for k, text in enumerate(pair)]
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    groups, sets = {}, {text: shingles(text) for _, text in rows}
    for key, text in rows:
        groups.setdefault(got[key], []).append(text)
    for texts in groups.values():  # connected by pairs at 0.8 or more alone
        reached, todo = {texts[0]}, [texts[0]]
        while todo:
            a = todo.pop()
            new = {b for b in texts if b not in reached and alike(sets[a], sets[b]) >= 0.8}
            reached |= new
            todo += new
        assert reached == set(texts)
    at = {text: key for key, text in rows}
    assert all(got[at[a]] == got[at[b]] for a, b in near)


def test_near_copies_are_looked_up_by_hamming_balls(spark, monkeypatch):
    seen, plain = [], simhash.near_links

    def watched(reps, scratch):
        seen.append(reps.count())
        return plain(reps, scratch)

    monkeypatch.setattr(simhash, "near_links", watched)
    text = " ".join(f"w{i * i % 997}" for i in range(800))
    frame = spark.createDataFrame([(5, text), (3, text + " end"), (9, "other words that nobody else has at all")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_copies(frame).collect()}
    assert got == {3: 3, 5: 3, 9: 9} and seen and seen[0] in (2, 3)
