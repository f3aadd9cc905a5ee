import re

import pytest
from pyspark.sql import Row

from weftline.llm import linkgraph
from weftline.llm.queries import RULES


def page(number, url, *links):
    return Row(page_id=number, url=url, html="".join(f'<a class="x" href="{u}">y</a>' for u in links))


def test_hosts_paths_and_rules(spark):
    urls = [
        "http://a.example.com/en/1?q", "https://EXAMPLE.com", "http://www.example.com/en/x", "http://x.www.example.com/en/x",
        "http://example.net/es/1", "http://net/fr/", "http://internet/fr/", "http://b.com/?a://b/c", "://h/p#f", "no scheme", None, "",
        "http://example.com/EN/1", "a\nb://C.com/d\ne", "http://ÄB.com/x",
    ]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: r for r in linkgraph.judge(pages, RULES).collect()}
    for i, url in enumerate(urls):
        m = re.search(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host = re.sub("[A-Z]", lambda c: c.group().lower(), m[1]) if m else ""
        path = m[2] if m else ""
        fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits)[1:] if fits else (None, "allow")
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict), url


def test_trust_and_distrust_spread(spark):
    pages = [
        page(1, "http://good.com/", "http://friend.org/a"),
        page(2, "https://friend.org/x", "//both.io/1", "/own"),
        page(3, "http://both.io/", "http://BAD.net/es/1", "http://bad.net/es/2"),
        page(4, "http://linker.io/q?x", "http://bad.net/es/1"),
        page(5, "http://bad.net/es/a"),
        page(6, "http://bad.net/fr/a", "http://victim.org"),
        page(7, "http://second.io", "http://linker.io"),
        page(8, "http://victim.org/"),
        page(9, "http://mostly.net/es/1"),
        page(10, "http://mostly.net/en/1"),
        page(11, "http://mostly.net/en/2"),
    ]
    got = {r.page_id: r.verdict for r in linkgraph.judge(spark.createDataFrame(pages), RULES).collect()}
    # Who links to blocked hosts is distrusted, unless more trust comes to them; whom those link to is
    # not. A host with a third of its pages blocked is no blocked host.
    assert got == {1: "allow", 2: "allow", 3: "allow", 4: "block", 5: "block", 6: "block", 7: "block", 8: "allow", 9: "block", 10: "allow", 11: "allow"}


def test_spread_equals_brute_force(spark):
    links = [("a", "b"), ("a", "c"), ("b", "c"), ("c", "a"), ("d", "c"), ("c", "d")]
    out = {h: [t for s, t in links if s == h] for h in "abcd"}
    weight = {(s, t): 1 / len(out[s]) for s, t in links}
    into = {h: sum(w for (_, t), w in weight.items() if t == h) for h in "abcd"}
    seeds = {"a": (1.0, 0.0), "d": (0.0, 1.0)}
    trust = {h: 0.15 * seeds.get(h, (0, 0))[0] for h in "abcd"}
    distrust = {h: 0.15 * seeds.get(h, (0, 0))[1] for h in "abcd"}
    first = dict(trust), dict(distrust)
    for _ in range(linkgraph.ROUNDS):
        trust = {h: first[0][h] + 0.85 * sum(trust[s] * w for (s, t), w in weight.items() if t == h) for h in "abcd"}
        distrust = {h: first[1][h] + 0.85 * sum(distrust[t] * w / into[t] for (s, t), w in weight.items() if s == h) for h in "abcd"}
    edges = spark.createDataFrame([(s, t, w) for (s, t), w in weight.items()], "src string, dst string, weight double")
    start = spark.createDataFrame([(h, *v) for h, v in seeds.items()], "host string, trust double, distrust double")
    got = {r.host: r for r in linkgraph.spread(start, edges).collect()}
    for h in "abcd":
        assert got[h].trust == pytest.approx(trust[h]) and got[h].distrust == pytest.approx(distrust[h])


def test_odd_pages(spark):
    schema = "page_id long, url string, html string, host string, verdict string"
    rows = [(1, "http://a.io/", None, "x", "y"), (1, "http://a.io/", None, "x", "y"), (None, None, "", "x", "y"), (2, "http://", '<a href="//">', "x", "y")]
    got = linkgraph.judge(spark.createDataFrame(rows, schema), RULES).collect()
    assert sorted((r.page_id or 0, r.host, r.verdict) for r in got) == [(0, "", "allow"), (1, "a.io", "allow"), (1, "a.io", "allow"), (2, "", "allow")]
    assert linkgraph.judge(spark.createDataFrame([], schema), RULES).count() == 0


def test_native(spark):
    out = linkgraph.judge(spark.createDataFrame([page(1, "http://a.io/", "http://b.io")]), RULES)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
