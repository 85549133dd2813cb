import re

from hypothesis import given, settings
from hypothesis import strategies as st

from shopstat.llm import url_filter as U
from shopstat.llm.queries import URL_RULES

LABELS, PIECES = ["a", "b", "www", "com", "net"], ["", "x", "y", "xy"]
RULES = URL_RULES + [("b.com", "/x", "block"), ("a.b.com", "/", "allow"), ("com", "/x/y", "block"), ("net", "", "block"), ("net", "/es/", "allow")]


def brute(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]) if m else ""
    path = m[2] if m else ""
    fits = [(len(h), len(p), v, h + p) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, "allow", None))       # block sorts after allow, so it wins a tie
    return host, path, best[3], best[2]


URLS = [None, "", "no scheme", "http://", "http:///x", "HTTP://A.B.Com/x?y#z", "http://com", "http://xcom/", "http://b.com/xylophone",
        "ftp://u:p@b.com:80/x", "http://x.net/es/1://y", "http://net?es", "http://example.com/en/", "http://www.example.com/en/a", "http://ÀB.com/x/y",
        "http://a.b.com./x", "http://.com/", "http://x.net\n/es/\nq", "http://net/es/"]


def _check(spark, urls):
    frame = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string")
    rules = spark.createDataFrame(RULES, U.RULE_SCHEMA)
    want = {i: brute(u, RULES) for i, u in enumerate(urls)}
    for limit in (U.MAX_TRIE_BYTES, 0):                   # by trie, and by join beyond the limit
        got = U.filter_urls(frame, rules, max_trie_bytes=limit).collect()
        assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == want


def test_edges(spark):
    _check(spark, URLS)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from(LABELS), min_size=1, max_size=4), st.lists(st.sampled_from(PIECES), max_size=4)), min_size=20, max_size=40))
def test_random_urls(spark, parts):
    _check(spark, ["http://" + ".".join(h) + "".join("/" + p for p in ps) for h, ps in parts])


def test_empty_tables_and_clashing_columns(spark):
    rules = spark.createDataFrame(RULES, U.RULE_SCHEMA)
    frame = spark.createDataFrame([(1, "http://b.com/", "x", "y")], "page_id bigint, url string, host string, rule string")
    out = U.filter_urls(frame, rules)
    assert out.columns == ["page_id", "url", "host", "path", "rule", "verdict"] and out.first().host == "b.com"
    assert U.filter_urls(frame.limit(0), rules).collect() == []
    assert U.filter_urls(frame, rules.limit(0)).first().verdict == "allow"
    nulls = spark.createDataFrame([(None, "/", "block"), ("com", None, "block"), ("com", "/", None)], U.RULE_SCHEMA)
    assert U.filter_urls(frame, nulls).first().verdict == "allow"
