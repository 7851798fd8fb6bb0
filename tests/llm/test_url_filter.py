import re
from collections import Counter
from itertools import combinations

import pytest

from tideline.llm import url_filter

URLS = [None, "", "no scheme", "http://", "http://NET", "http://a.net/", "http://a.net", "http://anet/", "http://x.Example.NET/en/1", "http://example.net/en", "http://example.com/de/x", "http://www.example.com/DE/x",
        "https://a.org/fr/?q", "http://org/fr/", "ftp://u@h.net:80/p?q#f", "x://?a://b.net/", "http://example.net?en/", "http://a.net#/", "://c.org/fr/1", "http://É.net/ü"]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for kind, text in url_filter.LIST:
        h, p = text.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(text) > len(best[1])):
            best = (kind, text)
    return host, path, best


def test_listed_rules_equal_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(URLS)], "page_id long, url string, Host string, key int")
    out = url_filter.judge(pages, spark.createDataFrame([], "url string, bad boolean"))
    assert out.columns == ["page_id", "url", "key", "host", "path", "rule", "verdict", "confidence"]
    for r in out.collect():
        host, path, best = brute(r.url)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best and best[1], best[0] if best else "allow"), r.url


def labelled():
    rows = []
    for i in range(300):
        rows.append((f"http://www.casino.org/win/{i}?utm={i}", i % 10 != 0))
        rows.append((f"http://www.casino.org/news/{i}", i % 10 == 0))
        rows.append((f"http://blog.plain.org/win/{i}", i % 8 == 0))
    return rows


def brute_rules(rows, tokens, count, confidence, lift):
    n, bad = len(rows), sum(b for _, b in rows)
    every, hit = Counter(), Counter()
    for (_, b), own in zip(rows, tokens):
        for k in range(1, len(own) + 1):
            for c in combinations(sorted(own), k):
                every[c] += 1
                hit[c] += b
    return {c: hit[c] / every[c] for c in every if hit[c] >= count and hit[c] / every[c] >= confidence and hit[c] / every[c] / (bad / n) >= lift}


def test_mined_rules_equal_brute_force(spark):
    rows = labelled()
    df = spark.createDataFrame(rows, "url string, bad boolean")
    from pyspark.sql import functions as F

    tokens = [r.t for r in df.select("url", url_filter.tokens_of(F.col("url")).alias("t")).collect()]
    want = brute_rules(rows, tokens, 20, 0.5, 1.5)
    smallest = {c for c in want if not any(set(d) < set(c) and want[d] >= want[c] for d in want)}
    got = url_filter.mine(df).collect()
    assert {tuple(r.tokens) for r in got} == smallest and smallest
    assert all(r.confidence == pytest.approx(want[tuple(r.tokens)]) and r["head"] in r.tokens for r in got)


def test_mined_rules_decide_where_the_list_is_silent(spark):
    labels = spark.createDataFrame(labelled(), "url string, bad boolean")
    urls = ["http://www.casino.org/win/x", "http://www.casino.org/win/x", "http://www.casino.org/news/x", "http://www.casino.net/win/1?utm=2", "http://other.org/", "http://casino.org/fr/win/?utm", None]
    out = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), labels).collect()}
    assert [out[i].verdict for i in range(3)] == ["block", "block", "allow"] and out[0].confidence >= 0.5
    assert out[3].rule == "net/" and out[4].verdict == "allow" and out[6].verdict == "allow"
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), labels).collect() == []


def test_labels_come_by_the_number_in_the_path(spark):
    pages = spark.createDataFrame([(1, f"http://a.org/en/{x}") for x in ("7", "8.html", "9/", "7?page=2", "7#top", "x", "99999999999999999999")] + [(2, None)], "page_id long, url string")
    labels = spark.createDataFrame([(7, 0, 0), (8, 1, 1), (9, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = sorted((r.url[12:], r.bad) for r in url_filter.labelled_urls(pages, labels).collect())
    assert sorted(u.removeprefix("/en/") for u, _ in got) == ["7", "7#top", "7?page=2", "8.html", "9/"]
    assert all(bad == ("9" not in u) for u, bad in got)


def test_whole_table(spark):
    rows = url_filter.op4_url_filter(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 250 and {r.verdict for r in rows} <= {"allow", "block"}


def test_mostly_bad_labels_still_give_rules(spark):
    rows = [(f"http://spam.example/{i}", True) for i in range(160)] + [(f"http://good.example/{i}", i % 2 == 0) for i in range(40)]
    found = url_filter.mine(spark.createDataFrame(rows, "url string, bad boolean")).collect()
    assert {tuple(r.tokens) for r in found if r.confidence == 1} and not any("good" in t for r in found for t in r.tokens)
    pages = spark.createDataFrame([("http://spam.example/x",), ("http://good.example/x",)], "url string")
    got = {r.url: r.verdict for r in url_filter.judge(pages, spark.createDataFrame(rows, "url string, bad boolean"), rules=()).collect()}
    assert got == {"http://spam.example/x": "block", "http://good.example/x": "allow"}
