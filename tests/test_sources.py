"""Sources, sinks and streams on files."""

import json

import pytest
import zstandard

from sedgewren.operators import early
from sedgewren.sources import corpora, files
from sedgewren.streaming import events

TREC = "<DOC>\n<DOCNO>s_1</DOCNO>\n<PRE>before</PRE>\n<TEXT> some\ntext </TEXT>\n<POST></POST>\n</DOC><doc><docno>s_2</docno><pre></pre><text>x</text><post>y</post></doc><DOC><DOCNO>cut"
SUBMISSIONS = [
    {"submissionId": "sub_1", "author": "a", "date": "2024-01-02T03:04:05Z", "title": "T", "body": "B", "number": 1, "targetSubject": "a", "comments": [{"commentId": "c_1", "author": "b", "date": "bad", "body": "x", "parent": "sub_1"}, {"commentId": "c_2", "author": "a", "date": "", "body": "y", "parent": "c_1"}]},
    {"submissionId": "sub_2", "author": "a", "date": "2024-01-02", "title": None, "body": "C", "number": 2, "targetSubject": "a", "comments": []},
]


def test_trec(spark, tmp_path):
    (tmp_path / "b.trec").write_text(TREC)
    (tmp_path / "a.trec").write_text(TREC.replace("some", "other"))
    rows = corpora.trec_sentences(spark, str(tmp_path / "b.trec")).collect()
    assert [(r.sentence_id, r.pre, r.text, r.post, r.source_file) for r in rows] == [("s_1", "before", "some\ntext", "", "b.trec"), ("s_2", "", "x", "y", "b.trec")]
    once = {r.sentence_id: r for r in corpora.unique_sentences(corpora.trec_sentences(spark, str(tmp_path))).collect()}
    assert len(once) == 2 and once["s_1"].source_file == "a.trec"


def test_nested_submissions(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps(SUBMISSIONS))
    rows = {r.item_id: r for r in corpora.nested_submissions(spark, str(tmp_path / "s.json")).collect()}
    assert set(rows) == {"sub_1", "sub_2", "c_1", "c_2"} and rows["c_2"].parent_id == "c_1" and rows["c_1"].target_subject == "a"
    frame = corpora.nested_submissions(spark, str(tmp_path / "s.json"))
    own = {r.id: r.created_utc for r in corpora.to_canonical(frame).collect()}
    assert own["sub_1"] == 1704164645.0 and len(own) == 2
    both = {r.id: r.created_utc for r in corpora.to_canonical(frame, ("submission", "comment")).collect()}
    assert both["c_1"] == 0.0 and len(both) == 4
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(ValueError, match="list"):
        corpora.nested_submissions(spark, str(tmp_path / "bad.json"))


def test_jsonl_and_zst(spark, tmp_path):
    lines = '{"id": "1", "n": 2}\n\nnot json\n{"id": "2", "n": null}\n'
    (tmp_path / "x.jsonl").write_text(lines)
    assert sorted(r.id for r in files.read_jsonl(spark, str(tmp_path / "x.jsonl"), "id string, n long").collect()) == ["1", "2"]
    (tmp_path / "RS_1.zst").write_bytes(zstandard.compress(lines.encode()))
    assert sorted(r.id for r in files.read_zst_jsonl(spark, str(tmp_path / "*.zst"), "id string, n long", chunk=7).collect()) == ["1", "2"]


def test_shards_and_upserts(spark, tmp_path):
    files.write_parquet(spark.createDataFrame([(1, "a")], "id long, x string"), str(tmp_path / "c" / "one.parquet"))
    files.write_parquet(spark.createDataFrame([(2, 5)], "id long, y long"), str(tmp_path / "c" / "two.parquet"))
    both = files.read_shards(spark, [str(tmp_path / "c" / n) for n in ("one.parquet", "two.parquet")])
    assert both.count() == 2 and set(both.columns) == {"id", "x", "y"}
    assert files.read_corpus(spark, str(tmp_path / "c")).count() == 2
    new, prior = spark.createDataFrame([("m", 2)], "k string, v long"), spark.createDataFrame([("m", 1), ("n", 1)], "k string, v long")
    assert sorted((r.k, r.v) for r in files.upsert(new, prior, ["k"]).collect()) == [("m", 2), ("n", 1)]
    assert [r.k for r in files.not_yet_done(prior, new, ["k"]).collect()] == ["n"]
    files.write_report_csv(new, str(tmp_path / "r"))
    files.write_jsonl(new, str(tmp_path / "j"))
    files.append(new, str(tmp_path / "p"))
    files.append(new, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2


def test_external_csv(spark, tmp_path):
    (tmp_path / "anx_2018.csv").write_text('subreddit,author,post\nanx,a,"a post that is long enough, with a comma"\nanx,b,short\nanx,c,"another post that is long enough\nover two lines"\n')
    (tmp_path / "ctl_2018.csv").write_text("subreddit,author,post\nctl,d,a control post that is long enough too\nctl,e,\n")
    got = corpora.community_csv(spark, str(tmp_path), ["anx", "missing"], ["ctl"]).collect()
    assert sorted((r.author, r.y) for r in got) == [("a", 1), ("c", 1), ("d", 0)]
    assert corpora.community_csv(spark, str(tmp_path), ["none"], []).count() == 0
    assert corpora.expert_csv(spark, str(tmp_path)) is None
    (tmp_path / "test.csv").write_text("Text,Label\nsome longer text here,Anxiety\nsome other text here,control\n")
    assert sorted(r.y for r in corpora.expert_csv(spark, str(tmp_path)).collect()) == [0, 1]


def test_synthetic_and_listings(spark):
    bank = {"sad": ("Sad one.", "Sad two."), "neutral": ("Plain.",)}
    make = lambda: [tuple(r) for r in corpora.synthetic_posts(spark, spark.createDataFrame([("x", 1.0)], "name string, sad double"), bank, 5).collect()]
    assert make() == make() and len(make()) == 5 and all("Sad" in r[4] for r in make())
    page = spark.createDataFrame([({"children": [{"kind": "t3", "data": {"id": "1"}}, {"kind": "t1", "data": {"id": "9"}}, {"kind": "t3", "data": {"id": "1"}}]},)], "data struct<children: array<struct<kind: string, data: struct<id: string>>>>")
    assert [r.id for r in corpora.listing_posts(page).collect()] == ["1"]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, 1_700_000_000 + i * 100, i % 7, (i * 37 % 100) / 100) for i in range(210)]
    frame = spark.createDataFrame(rows, "event_id long, s long, user_id long, score double").selectExpr("*", "timestamp_seconds(s) as ts")
    for part in range(3):  # three files, in time order
        frame.where(f"event_id div 70 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = events.run_to_table(events.early_decisions(stream, 0.6, 2), str(tmp_path / "w"))
    got = sorted((r.user_id, r.posts_seen) for r in out.collect())
    batch = early.decisions(frame.selectExpr("*", "0 as y"), "user_id", "score", "y", "s", "event_id", 0.6, 2).where("predicted_label = 1")
    assert got == sorted((r.user_id, r.posts_seen) for r in batch.collect())


def test_streams_do_not_depend_on_the_number_of_files(spark, tmp_path):
    from sedgewren.plans.all_queries import queries

    rows = [(i, i * 7 % 11, ["view", "click"][i % 3 == 0], float(i * 37 % 500), 1_700_000_000 + i * 5000) for i in range(400)]
    frame = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, t long").selectExpr("event_id", "user_id", "event_type", "value", "cast(cast(t as timestamp) as timestamp_ntz) as ts")
    frame.coalesce(1).write.parquet(str(tmp_path / "one/events.parquet"))
    frame.repartition(5, "value").write.parquet(str(tmp_path / "many/events.parquet"))
    for name in ("stream_tumbling", "stream_sessions", "stream_distinct", "stream_early_decision"):
        one, many = (sorted(map(tuple, queries()[name](spark, str(tmp_path / kind)).collect())) for kind in ("one", "many"))
        assert one == many and one, name


def test_zst_files_of_each_partition(spark, tmp_path):
    rows = spark.createDataFrame([(i, "é" * (i % 5), None if i % 3 else i) for i in range(100)], "id long, t string, n long").repartition(3)
    files.write_zst_jsonl(rows, str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("*.jsonl.zst"))) == 3 and not list((tmp_path / "out").glob("*.tmp"))
    back = files.read_zst_jsonl(spark, str(tmp_path / "out" / "*.zst"), "id long, t string, n long")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    with pytest.raises(FileExistsError):
        files.write_zst_jsonl(rows, str(tmp_path / "out"))


def test_settings_in_a_folder_that_spark_wrote(spark, tmp_path):
    from sedgewren import config

    spark.createDataFrame([("subreddits:\n  - {name: Anxiety, group: clinical, expected_anxiety_prior: 0.8}",)], "value string").coalesce(1).write.text(str(tmp_path / "s"))
    found = config.load_communities(str(tmp_path / "s"))
    assert [(c.name, c.group, c.priors["anxiety"], c.priors["depression"]) for c in found] == [("Anxiety", "clinical", 0.8, 0.0)]
