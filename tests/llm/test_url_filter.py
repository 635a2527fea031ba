import pytest

from specflow.llm.queries import URL_RULES
from specflow.llm.url_filter import build_trie, judge, judge_urls, split_url

URLS = [
    None, "", "no scheme", "http://", "https://A.Example.ORG/es/x?y#z", "http://example.org/es", "http://example.org/en/12",
    "http://example.org", "ftp://x.org?q=/", "http://com/de/", "http://www.shop.com/fr/a/b", "http://notexample.org/es/1",
    "http://shop.com/de/1", "http://shop.com:80/de/1", "http://a@shop.com/de/1", "http://x.net/de/", "http://shop.com/DE/1",
    "x://http://shop.com/de/1", "http://shop.com#/de/1", "http://.com/de/1", "http://org/", "http://exämple.org/es/ÀB",
]


def brute(url, rules, default="allow"):
    host, path = split_url(url)
    fits = []
    for verdict, rule_host, rule_path in rules:
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith(rule_path):
            fits.append((rule_host.count("."), len(rule_path), verdict == "block", rule_host + rule_path, verdict))
    if not fits:
        return host, path, None, default
    best = max(fits)
    return host, path, best[3], best[4]


RULES = URL_RULES + [("allow", "example.org", "/es/"), ("allow", "shop.com", "/de/1"), ("block", "shop.com", ""), ("allow", "a.example.org", "/")]


@pytest.mark.parametrize("rules", [URL_RULES, RULES, []])
@pytest.mark.parametrize("per_trie", [500_000, 2])
def test_like_brute_force(spark, rules, per_trie):
    df = spark.createDataFrame([(i, u, 1) for i, u in enumerate(URLS)], "page_id int, url string, _found int")
    got = judge_urls(df, rules, per_trie=per_trie).orderBy("page_id").collect()
    assert [tuple(r["judged"]) for r in got] == [brute(u, rules) for u in URLS]


def test_longest_match_in_the_trie():
    root = build_trie([("allow", "b.c", "/x"), ("block", "b.c", "/x/y/z"), ("block", "c", "/x/y/z/w")])
    assert judge(root, "a.b.c", "/x/y/zz")[1] == ("block", "b.c", "/x/y/z")
    assert judge(root, "a.b.c", "/xx")[1] == ("allow", "b.c", "/x")
    assert judge(root, "q.c", "/x/y/z/w")[1][1] == "c"
    assert judge(root, "q.c", "/x/y") is None


def test_empty_table(spark):
    assert judge_urls(spark.createDataFrame([], "page_id int, url string"), URL_RULES).count() == 0
