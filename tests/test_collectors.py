"""Collectors over saved pages, dumps and both."""

import json

import pytest

from sedgewren.sources import collectors
from sedgewren.sources.collectors import Collection, make_collector, posts_of
from sedgewren.streaming.events import run_to_table


def page(ids, community="Anxiety", **more):
    return json.dumps({"data": {"after": None, "children": [{"kind": "t3", "data": {"id": i, "subreddit": community, "title": "T", "selftext": f"body of {i}", "author": "ann", "score": 5, "num_comments": 1, "created_utc": 10.5, "is_self": True} | more} for i in ids]}})


@pytest.fixture
def folder(tmp_path):
    for name, number, text in [
        ("Anxiety", 1, page(["a1", "a2"])), ("Anxiety", 2, page(["a2", "a3"]) + "\n" + page(["a4"])), ("depression", 1, page(["d1"], "depression")),
        ("depression", 2, "no json\n[]\n{}\n" + json.dumps({"data": {"children": [{"kind": "t1", "data": {"id": "c"}}, {"kind": "t3", "data": None}, 7, {"kind": "t3", "data": {"title": "no id"}}]}})),
        ("other", 1, page(["o1"], "other")),
    ]:
        (tmp_path / "in" / name).mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name / f"{number:03}.json").write_text(text)
    (tmp_path / "in" / "Anxiety" / "_SUCCESS").write_text(page(["no"]))
    return tmp_path


def test_pages_are_one_scan_over_communities(spark, folder):
    found = make_collector("listing", spark, Collection(["anxiety", "DEPRESSION"]), path=str(folder / "in"))
    rows = {r.id: r for r in found.collect_all().collect()}
    assert sorted(rows) == ["a1", "a2", "a3", "a4", "d1"]
    assert rows["a1"].asDict() == {
        "id": "a1", "subreddit": "Anxiety", "created_utc": 10.5, "title": "T", "body": "body of a1", "author": "ann", "score": 5, "num_comments": 1, "permalink": "", "is_self": True, "over_18": False, "source": "scraper", "collected_at": 0.0, "kind": "submission", "parent_id": None,
    }
    assert [r.id for r in found.collect_community("depression").collect()] == ["d1"]


def test_filters(spark, folder):
    (folder / "in" / "Anxiety" / "003.json").write_text(page(["link"], is_self=False) + "\n" + page(["low"], score=-1) + "\n" + page(["short"], selftext=""))
    found = make_collector("listing", spark, Collection(["Anxiety"], least_score=0, least_chars=3), path=str(folder / "in"))
    assert {r.id for r in found.collect_all().collect()} == {"a1", "a2", "a3", "a4"}


def test_stream_goes_on_at_its_cursor(spark, folder):
    found = make_collector("listing", spark, Collection(["Anxiety", "depression", "later"]), path=str(folder / "in"))
    read = lambda: sorted(r.id for r in run_to_table(found.stream(), str(folder / "run")).collect())
    assert read() == ["a1", "a2", "a2", "a3", "a4", "d1"]
    assert read() == ["a1", "a2", "a2", "a3", "a4", "d1"]
    (folder / "in" / "Anxiety" / "003.json").write_text(page(["a5"]))
    (folder / "in" / "later").mkdir()
    (folder / "in" / "later" / "001.json").write_text(page(["l1"], "later"))
    assert read() == ["a1", "a2", "a2", "a3", "a4", "a5", "d1", "l1"]


def test_pages_are_dealt_to_tasks(folder):
    pages = collectors.Pages({"path": str(folder / "in"), "filespertask": "2"})
    assert [len(p.files) for p in collectors.ListingReader({"path": str(folder / "in"), "filespertask": "2"}).partitions()] == [2, 2, 1]
    assert pages.found() == {"Anxiety": ["001.json", "002.json"], "depression": ["001.json", "002.json"], "other": ["001.json"]}


def test_odd_values_of_a_page():
    assert list(posts_of(json.dumps({"data": {"children": {"kind": "t3"}}}), "c")) == []
    got = list(posts_of(json.dumps({"data": {"children": [{"kind": "t3", "data": {"id": 5, "score": None, "selftext": None, "author": None, "created_utc": "x"}}]}}), "c"))
    assert got == [("5", "c", 0.0, "", "", None, 0, 0, "", True, False, "scraper", 0.0, "submission", None)]


def test_other_collectors(spark, folder):
    dump = spark.createDataFrame([("a1", "anxiety", 1.0, "dump", "text", "bob", 3, 0, "", True, False), ("x9", "Anxiety", 1.0, "dump", "text", "bob", 3, 0, "", True, False), ("o9", "other", 1.0, "t", "b", "bob", 3, 0, "", True, False)], "id string, subreddit string, created_utc double, title string, selftext string, author string, score long, num_comments long, permalink string, is_self boolean, over_18 boolean")
    settings = Collection(["Anxiety"])
    first = make_collector("dump", spark, settings, dump=dump)
    assert {r.id for r in first.collect_all().collect()} == {"a1", "x9"}
    both = make_collector("merged", spark, settings, parts=[first, make_collector("listing", spark, settings, path=str(folder / "in"))])
    assert {r.id: r.title for r in both.collect_all().collect()} == {"a1": "dump", "x9": "dump", "a2": "T", "a3": "T", "a4": "T"}
    with pytest.raises(ValueError, match="unknown collector"):
        make_collector("live", spark, settings)
    with pytest.raises(ValueError, match="path"):
        collectors.Pages({})
