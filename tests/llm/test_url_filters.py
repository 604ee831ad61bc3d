import xxhash

from keyloom.llm import url_filters as U


def test_urls(spark):
    urls = ["http://a.Example.NET/en/x?y", "http://example.net/en", "http://notexample.net/en/", "http://example.com/de/1", "https://x.org/fr/#a", "http://org/fr/", "nothing", None, "a://b", "://", "http://u@h.net:80/p", "x://y.net/a://b", "http://h.net?/en/"]
    rows = {r.page_id: r for r in U.url_filter(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    want = {
        0: ("a.example.net", "/en/x", "example.net/en/", "allow"), 1: ("example.net", "/en", "net/", "block"), 2: ("notexample.net", "/en/", "net/", "block"),
        3: ("example.com", "/de/1", "example.com/de/", "block"), 4: ("x.org", "/fr/", "org/fr/", "allow"), 5: ("org", "/fr/", "org/fr/", "allow"), 6: ("", "", None, "allow"),
        7: ("", "", None, "allow"), 8: ("b", "", None, "allow"), 9: ("", "", None, "allow"), 10: ("u@h.net:80", "/p", None, "allow"), 11: ("y.net", "/a://b", "net/", "block"), 12: ("h.net", "", None, "allow"),
    }
    assert {i: (r.host, r.path, r.rule, r.verdict) for i, r in rows.items()} == want


def test_collisions_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda raw: len(raw) % 2)
    path = str(tmp_path / "rules")
    U.DigestArray.write([("a.b/", "block"), ("c.d/", "allow"), ("e/", "block"), ("no slash", "block")], path)
    array = U.DigestArray(path)
    assert array.judge(["a.b", "c.d", "x.e", "zz.z", ""], ["/", "/q", "/", "/", "/"]) == [("a.b/", "block"), ("c.d/", "allow"), ("e/", "block"), (None, None), (None, None)]


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.net/", "kept", "x")], "page_id long, url string, extra string, host string")
    row = U.url_filter(pages, []).first()
    assert (row.rule, row.verdict, row.host, row.extra) == (None, "allow", "a.net", "kept")
    assert U.url_filter(pages.where("false")).count() == 0


def test_opening_reads_a_head_and_many_rules(tmp_path):
    rules = [(f"h{i}.net/" + "p" * (i % 5), ("block", "allow")[i % 2]) for i in range(20_000)]
    path = str(tmp_path / "rules")
    U.DigestArray.write(rules, path)
    array = U.DigestArray(path)
    # Nothing but the head is copied to memory: all else is mapped.
    assert all(isinstance(x, U.np.memmap) for x in (array.digests, array.offsets, array.hosts, array.ends, array.lengths, array.verdicts, array.text))
    got = array.judge([f"www.h{i}.net" for i in range(500)], ["/ppppp"] * 500)
    assert got == [(f"h{i}.net/" + "p" * (i % 5), ("block", "allow")[i % 2]) for i in range(500)]
    assert array.judge(["h1.com", "net"], ["/", "/"]) == [(None, None)] * 2
