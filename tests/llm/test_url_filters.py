"""URL rules against a plain loop."""

from marlstone.llm.url_filters import QUERY_RULES, judge_urls, rule_table

URLS = [
    None,
    "",
    "no scheme",
    "http://",
    "https://EXAMPLE.com/en/1?x#y",
    "https://www.example.com/en/",
    "https://www.example.com/en",
    "https://a.b.www.example.com/en/q",
    "https://notexample.com/en/",
    "https://example.com",
    "https://example.com?/en/",
    "ftp://shop.net/es/1",
    "ftp://shop.net/fr/1://x",
    "ftp://net/fr/#",
    "x://a.com./",
    "http://h.com/" + "p/" * 5000,
    "http://" + "s." * 3000 + "net/es/",
]


def plain(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    after = rest[cut:]
    path = after[: min([after.find(c) for c in "?#" if c in after] + [len(after)])]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[1], best[2] if best else "allow"


def test_equals_plain_loop(spark):
    rows = [(i, u, "clash") for i, u in enumerate(URLS)] + [(4, URLS[4], "again"), (None, URLS[5], None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    rules = [*QUERY_RULES, ("b.www.example.com", "/en", "block"), ("h.com", "/p/p/p/", "block")]
    got = sorted((tuple(r) for r in judge_urls(pages, rule_table(spark, rules)).collect()), key=str)
    assert got == sorted(((i, *plain(u, rules)) for i, u, _ in rows), key=str)


def test_without_rules_and_without_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    none = rule_table(spark, [("", "/", "block")])
    assert [tuple(r) for r in judge_urls(pages, none).collect()] == [(1, "a.com", "/", None, "allow")]
    assert judge_urls(pages.limit(0), rule_table(spark, QUERY_RULES)).count() == 0
