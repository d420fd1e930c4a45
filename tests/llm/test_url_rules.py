from marginkit.llm import url_rules
from marginkit.llm.queries import URL_RULES
from helpers import rows

RULES = URL_RULES + [("block", "a.b.c", ""), ("allow", "b.c", "/x"), ("block", "b.c", "/x/y/"), ("block", "b.c", "/"),
                     ("allow", "same", "/"), ("block", "same", "/")]
URLS = [None, "", "no scheme", "http://", "https://WWW.Example.NET/en/1?x#y", "http://example.net/en", "http://example.net", "http://x.net/?q",
        "http://example.com/de/9", "http://notexample.com/de/9", "http://o.org/fr/", "ftp://a.b.c", "ftp://z.a.b.c/q", "http://b.c/xx", "http://b.c/x/y/z",
        "http://b.c/x/y", "http://q.b.c//x", "http://same/", "http://u:p@example.net:80/en/", "http://net/a://net/b", "http://..net/", "http://ü.net/é"]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        n = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = rest[:n].translate({c: c + 32 for c in range(65, 91)}), rest[n:]
        path = rest[:min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [(len(h.split(".")), len(p), v == "allow", h + p, v) for v, h, p in RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def test_broadcast_and_join_equal_brute_force(spark, monkeypatch):
    pages = spark.createDataFrame([(i, u, "t") for i, u in enumerate(URLS + URLS[:3])], "page_id long, url string, host string")
    want = [brute(u) for u in URLS + URLS[:3]]
    for limit in (url_rules.MAX_BROADCAST_RULES, 0):
        monkeypatch.setattr(url_rules, "MAX_BROADCAST_RULES", limit)
        got = rows(url_rules.judge_urls(pages, RULES), ["page_id"])
        assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in got] == want
    table = spark.createDataFrame(RULES, "verdict string, host string, path string")
    assert len(url_rules.judge_urls(pages.limit(0), table).collect()) == 0
