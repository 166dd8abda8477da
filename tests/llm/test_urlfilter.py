"""The Bloom cascade against plain rules."""

import random
import time

from sedgewren.llm import urlfilter


def plain(url):
    at = (url or "").find("://")
    if at < 0:
        return "", "", None, "allow"
    rest = url[at + 3 :]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, tail = rest[:end], rest[end:]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    fit = [(len(h + p), len(h), h + p, v) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[2:] if fit else (None, "allow")))


def urls():
    rng = random.Random(5)
    hosts = ["example.com", "www.example.com", "WWW.Example.COM", "a.b.www.example.com", "notexample.com", "com", "x.net", "net", "planet", "x.org", "example.com:80", "user@x.net", "", "a..com", "com."]
    paths = ["", "/", "/en/", "/en", "/en/x?q=/es/", "/es/1", "/fr/#top", "/EN/", "//en/", "?x=/", "#/", "/é/"]
    made = [f"{rng.choice(['http', 'https', ''])}://{h}{p}" for h in hosts for p in paths]
    return [*made, None, "", "no scheme", "://", "mailto:a@b", "http://x.com/a://b", "http://" + "a." * 300 + "com/" + "y" * 20_000]


def test_verdicts_equal_plain_rules(spark):
    frame = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls())], "page_id long, url string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(frame).collect()}
    assert got == {i: plain(u) for i, u in enumerate(urls())}


def test_very_long_hosts(spark):
    long = ["http://" + "a." * 50_000 + "example.com/en/", "http://" + "b" * 100_000 + ".net/fr/x", "http://" + "." * 100_000 + "/", "x://" + "www.example.com." * 7_000 + "com/en/"]
    frame = spark.createDataFrame(list(enumerate(long)), "page_id long, url string")
    began = time.time()
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge(frame).collect()}
    assert got == {0: ("example.com/en/", "block"), 1: ("net/fr/", "block"), 2: (None, "allow"), 3: ("com/", "allow")} and time.time() - began < 60


def test_columns_of_any_names_stay(spark):
    frame = spark.createDataFrame([(1, "http://x.net/es/", "a", "b", "c")], "page_id long, url string, _keys string, _hit string, _sw0 string")
    row = urlfilter.judge(frame).first()
    assert (row._keys, row._hit, row._sw0, row.rule, row.verdict) == ("a", "b", "c", "net/es/", "block")


def test_a_full_cascade_of_rules(spark):
    """50,000 rules are one cascade; verdicts equal a lookup of the rules."""
    rng = random.Random(4)
    rules = tuple(("block", f"h{i}.example{i % 7}.org", "/") for i in range(50_000))
    hosts = [f"{rng.choice(['', 'www.'])}h{rng.randrange(100_000)}.example{rng.randrange(7)}.org" for _ in range(20_000)]
    listed = {h for _, h, _ in rules}
    began = time.time()
    got = {r.page_id: r.verdict for r in urlfilter.judge(spark.createDataFrame([(i, f"http://{h}/p") for i, h in enumerate(hosts)], "page_id long, url string"), rules).collect()}
    print(f"50,000 rules over 20,000 urls: {time.time() - began:.1f} s")
    assert got == {i: "block" if h.removeprefix("www.") in listed else "allow" for i, h in enumerate(hosts)} and time.time() - began < 300


def test_many_rules_are_dealt_to_several_cascades(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "CASCADE_RULES", 40)
    rng = random.Random(9)
    rules = tuple(sorted({(rng.choice(["block", "allow"]), f"h{rng.randrange(60)}.org", rng.choice(["/", "/a/", "/a/b"])) for _ in range(160)}))
    rules = tuple({(h, p): (v, h, p) for v, h, p in rules}.values())
    assert len(rules) > 80
    pages = [f"http://{rng.choice(['', 'x.', 'y.z.'])}h{rng.randrange(70)}.org{rng.choice(['/', '/a/', '/a/b', '/a/bc', '', '/q'])}" for _ in range(400)]
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge(spark.createDataFrame(list(enumerate(pages)), "page_id long, url string"), rules).collect()}
    monkeypatch.setattr(urlfilter, "RULES", rules)
    assert got == {i: plain(u)[2:] for i, u in enumerate(pages)}


def test_cascade_is_exact_over_its_universe(spark):
    listed = spark.createDataFrame([(f"k{i}",) for i in range(0, 3000, 30)], "key string")
    universe = spark.range(3000).selectExpr("concat('k', id) as key")
    levels = urlfilter.build_cascade(listed, universe)
    rows = universe.select("key", urlfilter.holds(universe.key, levels).alias("in")).collect()
    assert {r.key for r in rows if r["in"]} == {f"k{i}" for i in range(0, 3000, 30)}
    assert len(levels) >= 1


def test_no_python_in_the_plan(spark):
    frame = spark.createDataFrame([(1, "http://x.net/es/")], "page_id long, url string")
    plan = urlfilter.judge(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_table_and_no_rules(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert urlfilter.judge(empty).count() == 0
    one = spark.createDataFrame([(1, "http://x.net/es/")], "page_id long, url string")
    assert urlfilter.judge(one, ()).first().verdict == "allow"
