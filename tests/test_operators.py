"""Operators on hand-computed rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sedgewren.operators import audit, cohort, dedup, early, labels, metrics, models, ordered, preprocess, splits, stats, threads, users
from sedgewren.schemas import require_columns
from sedgewren.session import stored

TARGETS = {"a": "d_a", "b": "d_b"}


def test_exact_and_near_dedup(spark):
    rows = [(1, "s", "Hello  World"), (2, "s", "hello world"), (3, "s", "other"), (4, "t", "HELLO\nworld "), (5, "t", None), (6, "t", "")]
    frame = spark.createDataFrame(rows, "id long, c string, t string")
    assert sorted(r.id for r in dedup.exact_dedup(frame, "t", "id").collect()) == [1, 3, 5]
    assert dedup.exact_dedup(frame.limit(0), "t", "id").count() == 0
    words = " ".join(f"w{i}" for i in range(300))
    near = spark.createDataFrame([(1, "s", words), (2, "s", words + " x"), (3, "t", words), (4, "s", "quite different text of few words")], "id long, c string, t string")
    assert sorted(r.id for r in dedup.greedy_near_dedup(near, "id", "c", "t").collect()) == [1, 3, 4]


def test_greedy_pass_is_not_transitive(spark):
    # 1 ~ 2 and 2 ~ 3 but not 1 ~ 3: the pass drops 2 and keeps 3.
    sigs = spark.createDataFrame([(1, "g", 0), (2, "g", 0b11111), (3, "g", 0b1111111111)], "id long, c string, sig long")
    assert sorted((r.a, r.b) for r in dedup.near_pairs(sigs, "id", "c").collect()) == [(1, 2), (2, 3)]


def test_merge(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "id long, t string"), spark.createDataFrame([(1, "Y"), (3, "z")], "id long, t string")
    assert sorted((r.id, r.t) for r in dedup.merge_and_dedupe([a, b], "t", "id").collect()) == [(1, "x"), (2, "y"), (3, "z")]


def scored(spark, rows):
    return spark.createDataFrame([(int(y), float(s)) for y, s in rows], "y long, score double")


def test_curves_by_hand(spark):
    frame = scored(spark, [(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.3), (0, 0.1)])
    assert metrics.auroc(frame).first().auroc == pytest.approx((3 + 2.5) / 6)
    assert metrics.auprc(frame).first().auprc == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)
    best = metrics.best_threshold(frame).first()
    assert best.threshold == 0.8 and best.f1 == pytest.approx(0.8)
    basic = metrics.basic_metrics(frame).first()
    assert (basic.accuracy, basic.precision, basic.recall, basic.support_pos) == (0.8, pytest.approx(2 / 3), 1.0, 2)
    assert metrics.auroc(scored(spark, [(1, 0.5), (1, 0.2)])).first().auroc is None
    assert metrics.auroc(scored(spark, [(1, 0.5), (0, 0.5)])).first().auroc == 0.5


def test_running_sums_cross_buckets(spark):
    frame = spark.createDataFrame([(float(i % 37), i) for i in range(37)], "k double, v long")
    got = {r.k: r.s for r in ordered.running(frame, "k", {"s": "v"}, buckets=5).collect()}
    assert got == {float(k): sum(range(k + 1)) for k in range(37)}


def test_calibration_edges(spark):
    rows = {r.bin: r for r in metrics.calibration(scored(spark, [(1, 1.0), (0, 0.0), (1, 0.95), (0, 0.1)])).collect()}
    assert rows[9].n == 2 and rows[9].observed == 1.0 and rows[0].n == 1 and rows[1].n == 1


def test_fairness(spark):
    rows = [("A", 1, 1)] * 10 + [("A", 0, 0)] * 30 + [("B", 1, 1)] * 5 + [("B", 1, 0)] * 5 + [("B", 0, 0)] * 30 + [("C", 1, 1)] * 2 + [(None, 1, 1)] * 50
    sub = metrics.subgroup_metrics(spark.createDataFrame(rows, "g string, y int, pred int"), "g")
    assert {r.g: r.tpr for r in sub.collect()} == {"A": 1.0, "B": 0.5}
    assert metrics.fairness_gaps(sub).first().tpr_gap == 0.5
    assert metrics.fairness_gaps(sub.where("g = 'A'")).first().tpr_gap is None


def test_group_thresholds(spark):
    rows = [("A", int(i >= 70), i / 100) for i in range(100)] + [("B", int(i >= 30), i / 100) for i in range(100)] + [("C", 1, 0.2)]
    got = {r.g: r for r in metrics.group_thresholds(spark.createDataFrame(rows, "g string, y int, score double"), "g").collect()}
    assert got["A"].threshold == 0.7 and got["B"].threshold == 0.3 and got["C"].tuned == 0
    applied = metrics.apply_thresholds(spark.createDataFrame([("A", 0.6), ("A", 0.8), ("Z", 0.6)], "g string, score double"), spark.createDataFrame([("A", 0.7)], "g string, threshold double"), "g")
    assert sorted((r.g, r.score, r.pred) for r in applied.collect()) == [("A", 0.6, 0), ("A", 0.8, 1), ("Z", 0.6, 1)]


def test_effect_sizes_and_corrections(spark):
    frame = spark.createDataFrame([(1, 3.0, 1.0), (1, 5.0, 1.0), (0, 1.0, 1.0), (0, 3.0, 1.0)], "y int, f double, g double")
    got = {r.feature: r for r in stats.cohens_d(frame, "y", ["f", "g"]).collect()}
    assert got["f"].cohen_d == pytest.approx(2 / math.sqrt(2)) and got["g"].cohen_d == 0.0
    u = {r.feature: r for r in stats.mann_whitney(frame, "y", ["f", "g"]).collect()}
    assert u["f"].u == 3.5 and u["g"].u == 2.0
    adjusted = {r.feature: r.p_bh for r in stats.bh_adjust(spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.9)], "feature string, p double")).collect()}
    assert adjusted == {"a": pytest.approx(0.04), "c": pytest.approx(0.16 / 3), "b": pytest.approx(0.16 / 3), "d": pytest.approx(0.9)}


def test_normal_tails(spark):
    for z in (0.0, 0.5, 1.96, 4.0):
        got = spark.range(1).select(stats.normal_tails(F.lit(z)).alias("p")).first().p
        assert got == pytest.approx(math.erfc(z / math.sqrt(2)), rel=2e-6)


def test_mcnemar(spark):
    rows = [(1, 1, 0)] * 40 + [(1, 1, 1)] * 80
    got = stats.mcnemar(spark.createDataFrame(rows, "y int, a int, b int"), "y", "a", "b").first()
    assert (got.b, got.c) == (40, 0) and got.p < 0.001 and stats.mcnemar_p(0, 0) == 1.0 and stats.mcnemar_p(3, 3) == 1.0


def test_delong_and_bootstraps(spark):
    rows = [(i, i % 2, (i * 37 % 100) / 100 + 0.3 * (i % 2), (i * 53 % 100) / 100) for i in range(300)]
    frame = spark.createDataFrame(rows, "id long, y int, s double, t double").withColumns({"p": (F.col("s") >= 0.6).cast("int"), "q": (F.col("t") >= 0.6).cast("int")})
    d = stats.delong_test(frame, "y", ("s", "t"))
    assert d["auc_a"] == pytest.approx(metrics.auroc(frame, score="s").first().auroc) and d["p"] < 0.01
    b = stats.bootstrap_f1(frame, "id", "y", "p", draws=60).first()
    assert b.lo <= b.point <= b.hi
    pair = stats.paired_bootstrap(frame, "id", "y", "p", "q", draws=60).first()
    assert pair.lo > 0 and pair.p < 0.2
    same = stats.paired_bootstrap(frame, "id", "y", "p", "p", draws=20).first()
    assert same.delta == 0 and same.p == 1.0


def test_temperature(spark):
    rows = []
    for i in range(4000):
        z = (i % 41 - 20) / 5
        p = 1 / (1 + math.exp(-z))
        rows.append((int((i * 7919 % 1000) / 1000 < p), 1 / (1 + math.exp(-3 * z))))
    t = stats.fit_temperature(scored(spark, rows))
    assert 2 < t < 4.5


def test_label_precedence(spark):
    rows = [(1, 0.0, 1.0, 1, 0.9), (2, None, 0.3, 1, 0.9), (3, None, None, 1, 0.2), (4, None, None, 0, 0.2), (5, None, None, 0, None)]
    got = {r.id: (r.label_x, r.label_x_source, r.label_x_weight) for r in labels.aggregate_labels(spark.createDataFrame(rows, "id long, manual_x double, llm_x double, disclosure_x long, weak_x double"), "x").collect()}
    assert got == {1: (0.0, "manual", 1.0), 2: (0.3, "llm", 0.7), 3: (1.0, "disclosure", 0.85), 4: (0.2, "weak", 0.4)}


def test_issues_votes_and_dawid_skene(spark):
    frame = spark.createDataFrame([(1, 0.05), (1, 0.5), (0, 0.95), (0, 0.2), (1, 0.1)], "y int, s double")
    assert [r.issue for r in labels.label_issues(frame, "y", "s").collect()] == [1, 0, 2, 0, 1]
    rng = random.Random(1)
    votes = [(i, *[-1 if rng.random() < 0.1 else t if rng.random() < 0.85 else 1 - t for _ in range(3)], t) for i in range(400) for t in [i % 2]]
    v = spark.createDataFrame(votes, "id long, a int, b int, c int, t int")
    assert v.select(labels.majority(["a", "b", "c"]).alias("m")).where("m < 0 or m > 1").count() == 0
    got, fitted = labels.dawid_skene(v, ["a", "b", "c"])
    right = got.where("(posterior >= 0.5) = (t = 1)").count()
    assert right > 330 and all(s > 0.6 for s in fitted["sensitivity"]) and got.count() == 400


def corpus(spark):
    rows = [("alice", "x", 1, 0), ("alice", "x", 0, 0), ("alice", "y", 0, 0), ("bob", "x", 0, 0), ("bob", "x", 0, 0), ("bob", "x", 0, 0), ("carl", "y", 0, 0), ("carl", "y", 0, 0), ("carl", "x", 0, 0), ("dave", "y", 0, 1), ("eve", "x", 0, 0), (None, "x", 1, 0), ("", "x", 1, 0)]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, u string, c string, d_a long, d_b long")


def test_cohorts(spark):
    frame = corpus(spark)
    table = {r.u: r for r in cohort.user_table(frame, "u", "c", TARGETS).collect()}
    assert set(table) == {"alice", "bob", "carl", "dave", "eve"} and table["alice"].user_group == "disclosed_a" and table["alice"].subreddits == "x,y"
    chosen = cohort.matched_controls(frame, "u", "c", "d_a", list(TARGETS.values())).collect()
    assert {r.control for r in chosen} <= {"bob", "carl"} and len({r.control for r in chosen}) == len(chosen)
    users_ = {r.u: r for r in cohort.test_users(frame, "u", "c", TARGETS).collect()}
    assert {"alice", "dave"} <= set(users_) and "eve" not in users_
    posts = cohort.test_posts(frame, cohort.test_users(frame, "u", "c", TARGETS), "u", TARGETS)
    assert posts.where("is_disclosure_post = 1").count() == 2
    marked = cohort.mark_held_out(frame, frame.where("u = 'bob'").select("u"), "u")
    assert marked.count() == 13 and marked.where("held_out_split").count() == 3
    again = {r.u: r.user_group for r in cohort.regroup(frame, spark.createDataFrame([("bob",), ("dave",), ("zoe",), (None,)], "u string"), "u", "c", TARGETS).collect()}
    assert again == {"bob": "matched_control", "dave": "disclosed_b", "zoe": "matched_control"}


def decisions(spark, rows):
    return spark.createDataFrame(rows, "user_id string, true_label long, predicted_label long, posts_seen long, n_posts_total long")


def test_early_detection_costs(spark):
    assert decisions(spark, [("a", 1, 1, 5, 9)]).agg(early.erde(None, 5).alias("e")).first().e == pytest.approx(0.5)
    assert decisions(spark, [("a", 1, 0, 9, 9), ("b", 0, 1, 1, 9)]).agg(early.erde(None, 5).alias("e")).first().e == pytest.approx(0.75)
    r = early.report(decisions(spark, [("a", 1, 1, 2, 10), ("b", 1, 0, 10, 10), ("c", 0, 0, 10, 10), ("d", 0, 1, 4, 8)])).first()
    assert (r.precision, r.recall, r.p_at_5, r.speed) == (0.5, 0.5, 0.5, pytest.approx(0.8)) and r.p_at_1 is None
    lw = early.latency_weighted_f1(decisions(spark, [("a", 1, 1, 1, 3)])).first()
    assert (lw.f1, lw.speed, lw.latency_weighted_f1, lw.median_latency) == (1.0, 1.0, 1.0, 1.0)
    assert early.latency_weighted_f1(decisions(spark, [("a", 0, 0, 1, 3)])).first().speed == 0.0


def test_decisions_and_streaks(spark):
    rows = [("p", 1, 0.1, 1), ("p", 2, 0.9, 0), ("p", 3, 0.9, 0), ("p", 4, 0.2, 0), ("n", 1, 0.9, 0), ("n", 2, 0.1, 0), ("n", 3, 0.9, 0)]
    frame = spark.createDataFrame(rows, "u string, t long, s double, y int")
    one = {r.user_id: r for r in early.decisions(frame, "u", "s", "y", "t", "t").collect()}
    two = {r.user_id: r for r in early.decisions(frame, "u", "s", "y", "t", "t", streak=2).collect()}
    assert (one["p"].posts_seen, one["n"].posts_seen) == (2, 1)
    assert (two["p"].predicted_label, two["p"].posts_seen, two["p"].true_label) == (1, 3, 1) and (two["n"].predicted_label, two["n"].posts_seen) == (0, 3)
    first = {r.u: (r.decision, r.latency) for r in early.first_crossing(frame, "u", "s", "t", "t", 0.95).collect()}
    assert first == {"p": (0, 4), "n": (0, 3)}


def test_user_sequences_and_scores(spark):
    rows = [("u", 10.0 * i, i, 0, 0.1 * i) for i in range(1, 7)] + [(None, 1.0, 9, 1, 0.5), ("v", 1.0, 8, 1, 0.3)]
    frame = spark.createDataFrame(rows, "u string, t double, i long, y int, s double")
    got = {r.u: r for r in users.sequences(frame, "u", "t", "i", "y", width=3).collect()}
    assert got["u"]["items"] == [4, 5, 6] and got["v"]["items"] == [8, 0, 0] and got["v"]["mask"] == [True, False, False] and got["v"].y == 1 and None not in got
    assert {r.u: r["items"] for r in users.sequences(frame, "u", "t", "i", "y", width=3, order="first").collect()}["u"] == [1, 2, 3]
    top = {r.u: r.score for r in users.aggregate_scores(frame, "u", "s", "y", "topk_mean").collect()}
    assert top["u"] == pytest.approx(0.4) and top["v"] == pytest.approx(0.3)
    s = {r.u: r for r in users.score_summary(frame, "u", "s", "t", "i").collect()}
    assert s["u"].s_slope == pytest.approx(0.1) and s["u"].s_first_cross == pytest.approx(4 / 6) and s["v"].s_slope == 0.0


def test_threads(spark):
    rows = [("a", 1, None), ("a", 2, 1), ("a", 4, 2), ("a", 3, 1), ("b", 7, 99)]
    frame = spark.createDataFrame(rows, "th string, n long, p long")
    got = sorted((r.th, r.position, r.n, r.depth) for r in threads.depth_first(frame, "th", "n", "p").collect())
    assert got == [("a", 1, 1, 0), ("a", 2, 2, 1), ("a", 3, 4, 2), ("a", 4, 3, 1), ("b", 1, 7, 0)]
    frame.createOrReplaceTempView("thread_rows")
    again = sorted((r.th, r.position, r.n, r.depth) for r in spark.sql(threads.depth_first_sql("thread_rows", "th", "n", "p")).collect())
    assert again == got


def test_deep_threads_are_walked_to_the_end(spark):
    rows = [("a", i, i - 1) for i in range(500)] + [("c", 1, 2), ("c", 2, 1), ("d", 4, 4), ("e", 1, 0), ("e", 2, 1), ("e", 2, 3), ("e", 3, 2)]
    got = sorted((r.th, r.position, r.n, r.depth) for r in threads.depth_first(spark.createDataFrame(rows, "th string, n long, p long"), "th", "n", "p").collect())
    assert got == [("a", i + 1, i, i) for i in range(500)] + [("e", 1, 1, 0), ("e", 2, 2, 1), ("e", 3, 3, 2)]


def test_splits(spark):
    frame = spark.range(1000).selectExpr("id", "id % 4 = 0 as y", "id % 50 as g")
    sizes = {(r.y, r.split): r["count"] for r in splits.stratified_split(frame, "id", "y").groupBy("y", "split").count().collect()}
    assert sizes[True, "test"] == 50 and sizes[False, "test"] == 150 and sizes[True, "val"] == 25
    assert splits.group_split(frame, "g").groupBy("g").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    assert splits.fixed_sample(frame, "id", 10).count() == 10 and splits.held_out(frame, splits.fixed_sample(frame, "id", 10), "id").count() == 990
    masks = splits.feature_masks(["f_a", "f_b", "s_c"], {"f": ["f_"]})
    assert masks == {"without_f": ["s_c"], "only_f": ["f_a", "f_b"]}


def test_audit(spark):
    frame = corpus(spark)
    assert {r.target: r.n_users for r in audit.user_stats(frame, "u", TARGETS).collect()} == {"a": 2, "b": 1}
    assert audit.community_breakdown(frame, "c", list(TARGETS.values()), 1).first().c == "x"
    assert "| x |" in audit.markdown("t", {"s": audit.rates_by(frame, ["c"], ["d_a"])}) and audit.warnings({"n_posts": 5, "users_a": 1}) == ["only 5 posts", "only 1 disclosed users for a"]
    assert audit.capped_sample(frame, "c", "id", 2).count() == 4


def test_preprocess(spark):
    long = "this is the long body of a post that talks of it with words, and it is on the way to be kept"
    rows = [("1", "s", "T", long, "ann"), ("2", "s", "T", long.upper(), "bob"), ("3", "s", "", "[deleted]", "x"), ("4", "s", "", "short", "y"), ("5", "s", long, None, "z"), ("6", "s", "", "der Hund und die Katze sind nicht im Haus, sie sind auf dem Weg zu uns und mit dem Bus", None)]
    out = preprocess.preprocess(spark.createDataFrame(rows, "id string, subreddit string, title string, body string, author string"))
    assert sorted(r.id for r in out.collect()) == ["1", "5"] and "author" not in out.columns and "author_hash" in out.columns
    german = preprocess.preprocess(spark.createDataFrame(rows, "id string, subreddit string, title string, body string, author string"), language=None)
    assert {r.id: r.lang for r in german.collect()}["6"] == "de"


def test_near_joins_send_no_key_rows_through_the_driver(spark):
    classes = stored(spark.range(2000).select(F.lit("c").alias("c"), F.xxhash64("id").alias("sig")))
    for frame in (dedup.near_classes(classes, "c"), dedup.near_some(classes, classes, "c")):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_preprocess_near_equals_both_passes_in_turn(spark):
    words = "this is the body of a post that talks of it with words and it is on the way to be kept by all of us here".split()
    text = lambda i: " ".join([*words[: 20 + i % 4], *[f"word{i % 9}{j}" for j in range(3 * (i % 2))]])
    rows = [(i % 70, f"s{i % 3}", None, text(i).upper() if i % 5 == 0 else text(i), "ann", i) for i in range(80)]
    frame = spark.createDataFrame(rows, "id long, subreddit string, title string, body string, author string, score long").withColumn("none", F.lit(None))
    exact = preprocess.preprocess(frame)
    plain = dedup.greedy_near_dedup(exact, "id", "subreddit", "clean_text", 5)
    out = preprocess.preprocess(frame, near=5)
    assert set(out.columns) == set(plain.columns)
    names = sorted(plain.columns)
    assert sorted(map(str, out.select(names).collect())) == sorted(map(str, plain.select(names).collect())) and 0 < out.count() < exact.count()
    few = preprocess.preprocess(frame, near=5, columns=("score", "author"))
    assert few.columns == ["id", "subreddit", "score", "clean_text", "lang", "author_hash"] and few.count() == out.count()


def test_models(spark):
    rows = [(i, f"{'good fine calm' if i % 2 else 'bad awful dread'} text number {i % 7}", i % 2, float(i % 2) + (i * 37 % 10) / 20) for i in range(120)]
    frame = spark.createDataFrame(rows, "id long, text string, y int, f double")
    fitted = models.build_model("tfidf", min_df=2).fit(frame)
    assert fitted.score(frame).where("pred = y").count() == 120
    assert {"good", "fine", "calm"} & {t for t, _ in models.top_terms(fitted, 3)[:3]}
    assert models.permutation_importance(frame, fitted, "id", "text") > 0.2
    for name in ("gbt", "forest", "elastic", "svm"):
        assert models.build_model(name, features=["f"]).fit(frame).score(frame).where("pred = y").count() > 100
    with pytest.raises(ValueError, match="unknown model"):
        models.build_model("none")
    with pytest.raises(ValueError, match="missing columns"):
        require_columns(frame, "nothing")


def test_model_round_trip(spark, tmp_path):
    frame = spark.createDataFrame([(i, i % 2, float(i % 2)) for i in range(40)], "id long, y int, f double")
    fitted = models.build_model("elastic", features=["f"]).fit(frame)
    fitted.save(str(tmp_path / "m"))
    again = models.build_model("elastic", features=["f"]).load(str(tmp_path / "m"))
    assert [r.pred for r in again.score(frame).orderBy("id").collect()] == [i % 2 for i in range(40)]


def test_greedy_rounds_equal_a_pass_in_order(spark):
    """A community's near texts, whose chains take several rounds."""
    import random

    from sedgewren.operators import dedup

    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    base = [rng.choice(words) for _ in range(30)]
    rows = []
    for i in range(150):
        if i % 10 == 0:
            base = [rng.choice(words) for _ in range(30)]
        else:
            base = list(base)
            base[rng.randrange(30)] = rng.choice(words)
        rows.append((i, f"c{i % 2}", " ".join(base)))
    frame = spark.createDataFrame(rows, "id long, community string, text string")
    sigs = {r.id: (r.community, r.sig) for r in dedup.signatures(frame, "id", "text", ("community",)).collect()}
    kept = []
    for i in sorted(sigs):
        if not any(sigs[j][0] == sigs[i][0] and ((sigs[i][1] ^ sigs[j][1]) & (1 << 64) - 1).bit_count() <= 5 for j in kept):
            kept.append(i)
    assert sorted(r.id for r in dedup.greedy_near_dedup(frame, "id", "community", "text").collect()) == kept and len(kept) < 150


def test_greedy_pass_over_a_dense_group_lays_down_few_pairs(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(400)]
    rows = [(i, "c", " ".join(w if rng.random() > 0.02 else f"x{rng.randrange(99)}" for w in base)) for i in range(400)]
    frame, most, stored = spark.createDataFrame(rows, "id long, c string, t string"), [], dedup.stored

    def counted(table):
        out = stored(table)
        most.append(out.count())
        return out

    monkeypatch.setattr(dedup, "stored", counted)
    monkeypatch.setattr(dedup, "FIRST_BLOCK", 8, raising=False)
    sigs = {i: dedup.token_signature(t, {}) for i, _, t in rows}
    near = lambda i, j: ((sigs[i] ^ sigs[j]) & (1 << 64) - 1).bit_count() <= 5
    kept = []
    for i in sorted(sigs):
        if not any(near(i, j) for j in kept):
            kept.append(i)
    assert sorted(r.id for r in dedup.greedy_near_dedup(frame, "id", "c", "t").collect()) == kept
    assert max(most) < 0.1 * sum(near(i, j) for i in sigs for j in sigs if i < j)


def test_running_sums_with_an_outlier(spark):
    from sedgewren.operators.ordered import running

    frame = spark.createDataFrame([(float(i), i) for i in range(500)] + [(1e18, 7)], "k double, n long").repartition(5)
    got = {r.k: r.upto for r in running(frame, "k", {"upto": "n"}, buckets=16).collect()}
    assert got == {float(i): i * (i + 1) // 2 for i in range(500)} | {1e18: 499 * 250 + 7}
    down = {r.k: r.upto for r in running(frame, "k", {"upto": "n"}, descending=True, buckets=16).collect()}
    assert down[499.0] == 7 + 499 and down[0.0] == 499 * 250 + 7


def test_drawn_sums_equal_weights_row_by_row(spark):
    rows = [(i, i % 2 if i % 7 else None, (i % 5) / 4 if i % 11 else None) for i in range(200)] + [(None, 1, 0.5), (7 * 10**17, 1, 0.25)]
    frame = spark.createDataFrame(rows, "id long, y int, s double").repartition(3)
    wide = frame.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(25)))).withColumn("w", stats.poisson_weight(F.col("id"), F.col("draw"), 42))
    for by in ((), ("s",)):
        want = wide.groupBy("draw", *by).agg(F.sum("w").alias("n"), F.sum(F.col("y") * F.col("w")).alias("y"))
        want = want.where("n > 0") if by else want
        got = stats.drawn_sums(frame, "id", ["y"], 25, by=by[0] if by else None)
        plain = lambda rows: sorted((tuple(r) for r in rows), key=str)
        mine, theirs = plain(got.select("draw", *by, "n", F.coalesce("y", F.lit(0))).collect()), plain(want.select("draw", *by, "n", F.coalesce("y", F.lit(0))).collect())
        assert mine == theirs


def test_resampled_curves_pass_through_counts(spark):
    counted = spark.createDataFrame([(1, 0.9, 3, 1), (1, 0.4, 1, 2)], "draw int, score double, _pos long, _neg long")
    rows = [(1, int(k == "_pos"), r.score) for r in counted.collect() for k in ("_pos", "_neg") for _ in range(r[k])]
    each = spark.createDataFrame(rows, "draw int, y int, score double")
    for area in (metrics.auroc, metrics.auprc):
        assert area(counted, by=("draw",)).first()[1] == pytest.approx(area(each, by=("draw",)).first()[1])


def test_capped_sample_brings_few_rows_together(spark):
    import hashlib

    rows = [(i, None if i % 9 == 0 else "abc"[i % 3 and i % 2]) for i in range(6000)]
    frame = spark.createDataFrame(rows, "id long, g string")
    marked = frame.withColumn("_o", F.md5(F.concat_ws("|", F.lit("42"), F.col("id").cast("string"))))
    assert max(r["count"] for r in audit.under_cut(marked, "g", "_o", 50).groupBy("g").count().collect()) < 60
    want = set()
    for g in {g for _, g in rows}:
        want |= set(sorted((i for i, h in rows if h == g), key=lambda i: hashlib.md5(f"42|{i}".encode()).hexdigest())[:50])
    got = audit.capped_sample(frame, "g", "id", 50)
    assert {r.id for r in got.collect()} == want and got.columns == ["id", "g"]
