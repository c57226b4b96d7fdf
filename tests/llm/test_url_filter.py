"""URL filter against a plain scan over all rules, by trie and by joins."""

import pytest

URLS = [None, "", "no scheme", "http://example.org/es/1", "http://www.Example.ORG/en/12?x=/es/", "https://example.org/en/2#a", "http://org", "http://org/",
        "http://a.com/fr/x", "http://a.com/de/", "http://a.com/de", "http://notexample.org/es/", "http://x.net/de/1", "a://b://c.org/es/", "://example.org/en/1",
        "http://example.org.:80/es/", "http://.org/", "http://user@com/fr/\n/x", "http://com/fr/é", "http://EXÄMPLE.org/?q", "HTTP://deep.a.b.example.org/en/1/2/3", "http://com/" + "s/" * 30000, "http://example.org/en/19"]
MORE = [("block", "", ""), ("allow", "example.org", "/en/1"), ("block", "b.example.org", "/"), ("allow", "a.b.example.org", "/en/1/"), ("block", "net", "/de/1"),
        ("allow", "com", "/s/s/s"), ("allow", "ORG", "/e"), ("allow", None, "/es/"), (None, "com", "/fr/x")]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
    rest = rest[:end]
    at = rest.find("/") if "/" in rest else len(rest)
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:at])
    return low, rest[at:]


def plain(url, rules, default):
    host, path = parts(url)
    fits = []
    for action, h, p in rules:
        h, p = (h or "").lower(), p or ""
        if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(h.split(".")) if h else 0, len(p), action != "allow", h + p))
    return host, path, max(fits)[3] if fits else None, ("block" if max(fits)[2] else "allow") if fits else default


@pytest.mark.parametrize("extra", [[], MORE])
@pytest.mark.parametrize("trie_bytes", [1 << 20, 0])
def test_urls(spark, extra, trie_bytes):
    from specflow.llm.op11_url_filter import RULES, url_filter

    rows = [(i if i % 5 else None, u, "x", "y") for i, u in enumerate(URLS * 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string, host string").repartition(3)
    got = url_filter(pages, RULES + extra, default="block", trie_bytes=trie_bytes).collect()
    want = [(i, *plain(u, RULES + extra, "block")) for i, u, *_ in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_no_pages_and_no_rules(spark):
    from specflow.llm.op11_url_filter import url_filter

    pages = spark.createDataFrame([(1, "http://example.org/es/")], "page_id long, url string")
    assert url_filter(pages.limit(0)).count() == 0
    for most in (100, -1):
        assert url_filter(pages, [], trie_bytes=most).first().asDict() == {"page_id": 1, "host": "example.org", "path": "/es/", "rule": None, "verdict": "allow"}
