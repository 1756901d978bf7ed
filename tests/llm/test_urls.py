from hypothesis import given, settings
from hypothesis import strategies as st

from fleetgauge.llm.queries import URL_RULES
from fleetgauge.llm.url_filter import Rule, filter_urls


def judge(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:].split("?")[0].split("#")[0]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best.verdict if best else "allow"


URLS = [
    None, "", "no scheme", "http://", "http://EXAMPLE.com/en/x", "https://www.example.com/en/", "http://a.www.example.com/en/1?q#f",
    "http://example.com", "http://notexample.com/en/", "x://b.net/es/1", "x://net/fr/", "x://net.com/fr/", "x://b.net/de/", "x://b.net?/es/",
    "ftp://com/", "http://a b.com/en/", "http://..com//", "http://É.COM/", "x://example.com/en/://net/es/",
]


def test_urls_agree_with_brute_force(spark):
    rows = [(i, u, "x") for i, u in enumerate(URLS * 2)]
    found = filter_urls(spark.createDataFrame(rows, "page_id long, url string, key string"), URL_RULES).collect()
    assert {r.page_id: tuple(r)[1:] for r in found} == {i: judge(u, URL_RULES) for i, u, _ in rows}
    plan = filter_urls(spark.createDataFrame(rows, "page_id long, url string, key string"), URL_RULES)
    plan = plan._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Python" not in plan and "Arrow" not in plan


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abcd"), st.sampled_from(["/", "/x/", "/y"])), min_size=1, max_size=8, unique=True))
def test_other_lists(spark, listed):
    rules = [Rule("block" if i % 2 else "allow", f"{h}.org", p) for i, (h, p) in enumerate(listed)]
    urls = [f"s://{s}{h}.org{p}{t}" for s in ("", "w.") for h in "abcde" for p in ("", "/", "/x/", "/y") for t in ("", "z")]
    rows = [(i, u) for i, u in enumerate(urls)]
    found = filter_urls(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()
    assert {r.page_id: tuple(r)[1:] for r in found} == {i: judge(u, rules) for i, u in rows}


def test_no_pages_no_rules(spark, empty):
    assert filter_urls(empty("page_id long, url string"), URL_RULES).collect() == []
    found = filter_urls(spark.createDataFrame([(1, "a://b.c/d")], "page_id long, url string"), []).collect()
    assert [tuple(r) for r in found] == [(1, "b.c", "/d", None, "allow")]
