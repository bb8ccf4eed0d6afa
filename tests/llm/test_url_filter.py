from colkit.llm.queries import URL_RULES
from colkit.llm.url_filter import filter_urls

CASES = [
    ("http://www.Foo.COM/en/1", "www.foo.com", "/en/1", "com/en/", "block"),
    ("https://example.com/en/77?x=1", "example.com", "/en/77", "example.com/en/7", "allow"),
    ("https://sub.example.com/en/8#f", "sub.example.com", "/en/8", "com/en/", "block"),
    ("http://notexample.com/en/7", "notexample.com", "/en/7", "com/en/", "block"),
    ("http://a.example.net/de/80", "a.example.net", "/de/80", "example.net/de/8", "block"),
    ("http://a.example.net/de/7", "a.example.net", "/de/7", "net/de/", "allow"),
    ("http://x.org/es/", "x.org", "/es/", "org/es/", "block"),
    ("http://x.org/es", "x.org", "/es", None, None),
    ("http://host?q=/en/", "host", "", None, None),
    ("http://host#a/b", "host", "", None, None),
    ("http://com", "com", "", None, None),
    ("http://com/en/", "com", "/en/", "com/en/", "block"),
    ("no scheme.com/en/1", "", "", None, None),
    ("a://b://c/d", "b:", "//c/d", None, None),
    ("", "", "", None, None),
    (None, "", "", None, None),
    ("http://É.Com/en/é\n", "É.com", "/en/é\n", "com/en/", "block"),
]


def frame(spark, urls):
    return spark.createDataFrame([(k, u, "clash", "clash") for k, u in enumerate(urls)], "page_id long, url string, host string, segs string").repartition(3)


def test_parsing_and_rules(spark):
    got = {r["page_id"]: r for r in filter_urls(frame(spark, [c[0] for c in CASES]), URL_RULES).collect()}
    assert len(got) == len(CASES)
    for k, (_, host, path, rule, verdict) in enumerate(CASES):
        r = got[k]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), CASES[k]
        assert r["verdict"] in ("allow", "block") and (verdict is None or r["verdict"] == verdict)


def test_templates_learn_from_the_rules(spark):
    rules = [("block", "site.example/bad/1"), ("allow", "site.example/good/1")]
    urls = [f"http://site.example/bad/1{k}" for k in range(40)] + [f"http://site.example/good/1{k}" for k in range(40)]
    urls += ["http://site.example/bad/999", "http://site.example/good/999", "http://site.example/other/5", "http://unknown.example/x"]
    got = {r["page_id"]: r for r in filter_urls(frame(spark, urls), rules).collect()}
    assert got[80]["verdict"] == "block" and got[80]["template"] == "/bad/*" and got[80]["rule"] is None
    assert got[81]["verdict"] == "allow" and got[81]["template"] == "/good/*"
    assert got[82]["verdict"] == got[83]["verdict"] == "allow"


def test_similar_branches_are_merged(spark):
    urls = [f"http://h.example/sec{k % 8}/{k}" for k in range(160)]
    got = filter_urls(frame(spark, urls), [("block", "h.example/sec")]).collect()
    assert {r["template"] for r in got} == {"/*/*"} and {r["verdict"] for r in got} == {"block"}


def test_empty_table_repeats_and_deep_paths(spark):
    assert filter_urls(frame(spark, ["x"]).where("page_id > 5"), URL_RULES).count() == 0
    deep = "http://d.example/" + "/".join(f"p{k}" for k in range(2000))
    got = filter_urls(spark.createDataFrame([(1, deep), (1, deep), (None, deep)], "page_id long, url string"), URL_RULES).collect()
    assert len(got) == 3 and len({r["verdict"] for r in got}) == 1


def test_branches_below_the_fourth_segment_are_told_apart(spark):
    rules = [("block", "h.example/a/b/c/spam/1"), ("allow", "h.example/a/b/c/ok/1")]
    urls = [f"http://h.example/a/b/c/{kind}/1{k}" for kind in ("spam", "ok") for k in range(40)]
    urls += ["http://h.example/a/b/c/spam/999", "http://h.example/a/b/c/ok/999"]
    urls += [f"http://i.example/a/b/{x}/c/d/e/f/{k}" for x in "pq" for k in range(9)] + ["http://i.example/a/z/1", "http://i.example/"]
    got = {r["url"]: r for r in filter_urls(frame(spark, urls), rules).join(frame(spark, urls).select("page_id", "url"), "page_id").collect()}
    assert len(got) == len(urls)
    spam, ok = got["http://h.example/a/b/c/spam/999"], got["http://h.example/a/b/c/ok/999"]
    assert spam["rule"] is None and (spam["template"], spam["verdict"]) == ("/*/*/*/spam/*", "block")
    assert ok["rule"] is None and (ok["template"], ok["verdict"]) == ("/*/*/*/ok/*", "allow")
    assert got["http://i.example/a/b/q/c/d/e/f/3"]["template"] == "/a/b/q/c/d/e/f/*"
    assert got["http://i.example/a/z/1"]["template"] == "/a/*/*" and got["http://i.example/"]["template"] == ""
