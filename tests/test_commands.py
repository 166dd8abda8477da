"""The commands, end to end on synthetic posts."""

from pyspark.sql import functions as F

from sedgewren import __main__ as commands
from sedgewren import config
from sedgewren.sources import corpora

YAML = """
subreddits:
  - name: Worry
    group: primary
    expected_anxiety_prior: 0.9
  - name: calm
"""
BANK = {"anxiety": ("I can't stop worrying and my panic is back.", "My anxiety and dread are bad today, I was diagnosed with GAD."), "neutral": ("The garden looks fine this week.", "We went to the market for some bread.", "It was a quiet day at home with the cat.")}


def test_end_to_end(spark, tmp_path):
    (tmp_path / "c.yaml").write_text(YAML)
    known = config.load_communities(tmp_path / "c.yaml")
    assert [(c.name, c.group, c.priors["anxiety"]) for c in known] == [("Worry", "primary", 0.9), ("calm", "baseline", 0.0)]
    raw = corpora.synthetic_posts(spark, spark.createDataFrame([("worry", 0.8), ("calm", 0.02)], "name string, anxiety double"), BANK, 80)
    raw.write.parquet(str(tmp_path / "raw"))

    def run(name, source, out, *more):
        assert commands.main([name, "--in", str(tmp_path / source), "--out", str(tmp_path / out), *more]) == 0
        return spark.read.parquet(str(tmp_path / out))

    clean = run("preprocess", "raw", "interim")
    assert "author" not in clean.columns and 100 < clean.count() <= 160
    run("label-weak", "interim", "weak", "--communities", str(tmp_path / "c.yaml"))
    both = run("label-disclosure", "weak", "tiers")
    assert both.where("disclosure_anxiety = 1").count() > 10
    assert run("disclosure-summary", "tiers", "summary").count() == 8
    full = run("label-aggregate", "tiers", "labelled")
    assert {r.s for r in full.select(F.col("label_anxiety_source").alias("s")).distinct().collect()} <= {"disclosure", "weak"}
    assert run("audit", "labelled", "stats").first().n_posts == full.count()
    assert len([c for c in run("features", "labelled", "features").columns if c.startswith("f_")]) == 26
    run("split", "labelled", "split", "--by-author")
    scored = run("train", "split", "scores", "--model", "tfidf")
    assert run("evaluate", "scores", "metrics").first().f1 >= 0.4
    assert run("evaluate-groups", "scores", "groups").count() == 2
    assert run("build-testset", "tiers", "users").count() > 0
    labelled = scored.withColumn("user_anxiety", F.col("y"))
    labelled.write.parquet(str(tmp_path / "user_scores"))
    assert run("evaluate-users", "user_scores", "user_metrics").count() == 1
    assert run("evaluate-early", "user_scores", "early").first().n_users > 10


def test_settings(tmp_path):
    (tmp_path / "l.yaml").write_text("tier1_weak:\n  thresholds:\n    anxiety: 0.7\naggregate:\n  precedence: [weak]\n")
    own = config.load_labelling(tmp_path / "l.yaml")
    assert own.thresholds["anxiety"] == 0.7 and own.thresholds["depression"] == 0.55 and own.precedence == ("weak",)
    (tmp_path / "m.yaml").write_text("name: gbt\noptions: {maxIter: 5}\nodd: 1\n")
    model = config.load_model(tmp_path / "m.yaml")
    assert (model.name, model.options, model.extra) == ("gbt", {"maxIter": 5}, {"odd": 1})
