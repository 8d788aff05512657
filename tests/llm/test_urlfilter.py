"""URL rules against a plain computation."""

import re
import time

from vqspark.llm import urlfilter
from vqspark.llm.queries import URL_RULES

URLS = [
    "http://x.example.org/es/1", "https://EXAMPLE.org/es", "http://example.org/en/123?x=/es/", "http://example.org/en/2#a", "ftp://org/", "http://org", "http://notexample.org/es/1",
    "http://a.b.com/fr/", "http://com/de/x", "http://a.com?/fr/", "http://a.net/de/", "no scheme", "", None, "x://y://z.org/q", "http://É.COM/de/ü", "http:///es/", "http://a..org/", "http://example.org./es/", "http://a.org:80/es/", "http://a.org/" + "p" * 50_000,
]


def plain(url, rules):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        raw = re.match(r"[^/?#]*", rest).group()
        host, path = re.sub("[A-Z]", lambda m: m.group().lower(), raw), re.match(r"[^?#]*", rest[len(raw) :]).group()
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def test_against_plain(spark):
    pages = spark.createDataFrame([(i if i else None, u, "h", "r") for i, u in enumerate(URLS + URLS[:3])], "page_id long, url string, host string, rule string")
    found = urlfilter.judge_urls(pages, urlfilter.rule_table(spark, URL_RULES)).collect()
    assert sorted((tuple(r) for r in found), key=str) == sorted(((i if i else None, *plain(u, URL_RULES)) for i, u in enumerate(URLS + URLS[:3])), key=str)


def test_precedence_ties_and_odd_rules(spark):
    rules = [("a.org", "/x", "allow"), ("a.org", "/x", "block"), ("org", "/x/yy", "allow"), ("A.ORG", "/x/y", "block"), ("net", "", "block")]
    urls = ["http://a.org/x", "http://a.org/x/yy", "http://b.net", "http://b.org/x/yyy"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    table = urlfilter.rule_table(spark, [*rules, (None, "/", "block"), ("org", None, "block"), ("", "/", "block")])
    found = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge_urls(pages, table).collect()}
    low = [(h.lower(), p, v) for h, p, v in rules]
    assert found == {i: plain(u, low)[2:] for i, u in enumerate(urls)}


def test_shuffled_rules_give_the_same(spark, monkeypatch):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    rules = urlfilter.rule_table(spark, URL_RULES)
    want = sorted(map(str, urlfilter.judge_urls(pages, rules).collect()))
    monkeypatch.setattr(urlfilter, "BROADCAST_ROWS", 0)
    assert sorted(map(str, urlfilter.judge_urls(pages, rules).collect())) == want


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    rules = urlfilter.rule_table(spark, [])
    assert urlfilter.judge_urls(pages, rules).count() == 0
    some = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert [r.verdict for r in urlfilter.judge_urls(some, rules).collect()] == ["allow"]


def test_a_host_of_many_labels(spark):
    hosts = [".".join(["a"] * n) for n in (2_000, 20_000)]
    urls = [f"http://{h}.example.org/es/x" for h in hosts] + [f"http://{h}/de/" for h in hosts]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    table = urlfilter.rule_table(spark, [*URL_RULES, (f"{hosts[0]}.example.org", "/", "allow")])
    urlfilter.judge_urls(pages.limit(0), table).count()
    begin = time.perf_counter()
    found = {r.page_id: (r.rule and r.rule[-20:], r.verdict) for r in urlfilter.judge_urls(pages, table).collect()}
    assert time.perf_counter() - begin < 20  # two or three seconds on a quiet machine
    assert found == {0: (f"{hosts[0]}.example.org/"[-20:], "allow"), 1: (f"{hosts[0]}.example.org/"[-20:], "allow"), 2: (None, "allow"), 3: (None, "allow")}
