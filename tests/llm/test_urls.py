from datetime import date

from papyra.llm.urls import intervals, judge

CAPTURES, ENTRIES = "page_id long, url string, day date, host string, n_matches int", "pattern string, category string, day date, action string"
D = lambda m, d=1: date(2024, m, d)


def test_intervals(spark):
    rows = [("a.b", "x", D(1), "add"), ("a.b", "x", D(1), "add"), ("a.b", "x", D(2), "add"), ("a.b", "x", D(3), "remove"), ("a.b", "x", D(3), "add"), ("a.b", "x", D(5), "add"), ("c.d", None, D(4), "remove"), ("c.d", None, D(6), "add"), (None, "x", D(1), "add"), ("e.f", "x", None, "add"), ("g.h", "x", D(1), "other")]
    got = {(r.pattern, r.category, r.since, r.until) for r in intervals(spark.createDataFrame(rows, ENTRIES)).collect()}
    assert got == {("a.b", "x", D(1), D(3)), ("a.b", "x", D(5), None), ("c.d", "", D(6), None)}


def test_captures_by_the_list_of_their_day(spark):
    entries = [("bad.org", "spam", D(2), "add"), ("bad.org", "spam", D(4), "remove"), ("www.bad.org", "adult", D(3), "add"), ("ok.com/x/y", "path", D(1), "add"), ("ok.com", "b", D(6), "add"), ("ok.com", "a", D(6), "add")]
    urls = [
        ("http://www.bad.org/p", D(1), None), ("http://www.bad.org/p", D(2), "bad.org"), ("https://u@WWW.bad.org:80?q", D(3), "www.bad.org"), ("http://www.bad.org/p", D(5), "www.bad.org"), ("http://x.y.bad.org", D(3, 31), "bad.org"),
        ("http://bad.org", D(4), None), ("http://notbad.org", D(3), None), ("http://ok.com/x/y/z?u=/x", D(1), "ok.com/x/y"), ("http://ok.com/x/yy", D(1), None), ("http://ok.com/x//y", D(7), "ok.com/x/y"), ("http://ok.com/", D(7), "ok.com"),
        (None, D(3), None), ("not a url", D(3), None), ("http://", D(3), None), ("http://www.bad.org", None, None), ("http://bad.org/" + "a/" * 300, D(3), "bad.org"),
    ]
    urls += [urls[1]] * 50
    docs = spark.createDataFrame([(k, u, d, "clash", 1) for k, (u, d, _) in enumerate(urls)], CAPTURES).repartition(3)
    got = {r.page_id: r for r in judge(docs, spark.createDataFrame(entries, ENTRIES)).collect()}
    assert len(got) == len(urls)
    for k, (_, _, rule) in enumerate(urls):
        assert (got[k].rule, got[k].blocked) == (rule, rule is not None), urls[k]
    assert got[10].category == "a" and got[10].n_matches == 2 and got[9].n_matches == 3 and got[2].host == "www.bad.org"


def test_addresses_suffixes_and_odd_names(spark):
    entries = spark.createDataFrame([(p, "x", D(1), "add") for p in ("2.3", "1.2.3", "co.uk", "bad.co.uk", "10.0.0.9")], ENTRIES)
    urls = ["http://10.1.2.3/", "http://10.0.0.9:80/", "http://shop.co.uk", "http://www.bad.co.uk/a", "http://x.2.3.example"]
    rows = spark.createDataFrame([(k, u, D(2), "c", 1, "v") for k, u in enumerate(urls)], CAPTURES.replace("n_matches int", "`_url` int, `a.b` string"))
    got = sorted(judge(rows, entries).collect(), key=lambda r: r.page_id)
    assert [r.rule for r in got] == [None, "10.0.0.9", None, "bad.co.uk", None]
    assert got[0]["a.b"] == "v" and got[0]["_url"] == 1


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], CAPTURES), spark.createDataFrame([(1, "http://a.b", D(1), "x", 0)], CAPTURES)
    entries = spark.createDataFrame([], ENTRIES)
    assert judge(none, entries).count() == 0 and [r.blocked for r in judge(some, entries).collect()] == [False]
