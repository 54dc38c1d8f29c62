import random
import re

from vocaris.llm import components, url_filter
from vocaris.llm.url_filter import RULES, Rule

SCHEMA = "page_id long, url string, html string, host int, verdict string"


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :], re.S)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def brute_rule(host, path, rules):
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: len(r.text), default=None)


def test_components_equal_union_find(spark, monkeypatch):
    rnd = random.Random(1)
    pairs = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(200)] + [(7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    for per_task in (components.EDGES_PER_TASK, 100):  # in one task, and in rounds
        monkeypatch.setattr(components, "EDGES_PER_TASK", per_task)
        got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
        assert got == {x: find(x) for x in parent}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rules_equal_brute_force(spark):
    rnd = random.Random(2)
    hosts = ["a.example.org", "EXAMPLE.org", "xexample.org", "org", "b.com", "É.Com", "c.example.net", ""]
    paths = ["", "/", "/es/x", "/en/1", "/en/12", "/en/2", "/fr/1", "/de/", "/de", "/a\nb"]
    urls = [f"{rnd.choice(['http', 'HTTPS', 'x'])}://{rnd.choice(hosts)}{rnd.choice(paths)}{rnd.choice(['', '?q=1/2', '#f', '?a://b'])}" for _ in range(300)]
    urls += [None, "", "no scheme/de/", "://org/", "dup://b.com/de/1", "dup://b.com/de/1"]
    df = spark.createDataFrame([(i, u, None if i % 2 else "<p>", 1, "z") for i, u in enumerate(urls)], SCHEMA)
    rows = url_filter.judge(df, RULES).collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path = brute_parts(urls[r.page_id])
        rule = brute_rule(host, path, RULES)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule and rule.text, rule.verdict if rule else "allow")
    assert url_filter.judge(df.limit(0), RULES).count() == 0


def test_aliases_carry_blocks_and_allows_win(spark):
    canonical = '<head><LINK href="{}" rel="canonical"></head>'
    pages = [
        (1, "http://bad.com/de/x", ""),
        (2, "http://mirror.net/x", canonical.format("http://BAD.com/de/x#top")),
        (3, "http://third.net/y", '<meta http-equiv="refresh" content="0; url=http://mirror.net/x">'),
        (4, "http://free.net/", canonical.format("/self?a=1&amp;b=2")),
        (5, "http://good.net/1", canonical.format("http://bad.com/de/z")),
        (6, "http://good.net/2", canonical.format("http://good.net/1")),
        (7, "http://x.com/fr/1", canonical.format("http://good.net/2")),
        (8, "http://moved.net/a", None),
        (9, "http://moved.net/a#x", None),
    ]
    df = spark.createDataFrame([(*p, 1, "z") for p in pages], SCHEMA)
    redirects = spark.createDataFrame([("http://moved.net/a", "http://bad.com/de/q"), (None, "http://moved.net/a")], "from_url string, to_url string")
    got = {r.page_id: r.verdict for r in url_filter.judge(df, RULES, redirects).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "block", 9: "block"}
    edges = {(r.a, r.b) for r in url_filter.page_edges(df).collect()}
    assert ("http://free.net/", "http://free.net/self?a=1&b=2") in edges
    assert Rule("allow", "org", "/").text == "org/"


def test_links_are_resolved(spark):
    page = "http://a.net/x/y/z?q=1"
    link = '<link rel="canonical" href="{}">'
    made = [
        ("../w", "", "http://a.net/x/w"),
        ("./v/../w", "", "http://a.net/x/y/w"),
        ("?id=3", "", "http://a.net/x/y/z?id=3"),
        ("//B.net/&#x65;s/", "", "http://b.net/es/"),
        ("w&quot;", "<base href='/root/'>", 'http://a.net/root/w"'),
        ("http://[", "", None),
        ("", "", None),
        ("#top", "", None),
    ]
    for href, base, want in made:
        df = spark.createDataFrame([(1, page, base + link.format(href), 1, "z")], SCHEMA)
        assert [r.b for r in url_filter.page_edges(df).collect()] == ([want] if want else []), href
