import pytest
from pyspark.sql import functions as F

from kinetable.llm import url_filter as U


@pytest.mark.parametrize(
    "url, host, path",
    [
        (None, "", ""), ("", "", ""), ("no scheme/x", "", ""), ("http://A.Org", "a.org", ""), ("https://a.org/x/Y?q#z", "a.org", "/x/Y"), ("http://a.org?x://b.com/", "a.org", ""),
        ("http://a.org#f", "a.org", ""), ("x://É.org/p", "É.org", "/p"), ("://h/p?", "h", "/p"), ("http://a://b/c", "a:", "//b/c"), ("http://a\n.org/b\nc?d", "a\n.org", "/b\nc"),
    ],
)
def test_parts(spark, url, host, path):
    df = spark.createDataFrame([(url,)], "url string").select(U.host_of(F.col("url")), U.path_of(F.col("url")))
    assert tuple(df.first()) == (host, path)


def test_longest_rule(spark):
    rows = [("a.example.org", "/es/x"), ("example.org", "/en/12"), ("notexample.org", "/es/"), ("example.org", "/en/2"), ("x.com", "/fr/"), ("x.com", "/de/1"), ("x.com", "/en/"), ("org", "/"), ("org", "")]
    text, verdict = U.rule_of(F.col("h"), F.col("p"), U.RULES)
    got = [tuple(r) for r in spark.createDataFrame(rows, "h string, p string").select(text, verdict).collect()]
    assert got == [("example.org/es/", "block"), ("example.org/en/1", "block"), ("org/", "allow"), ("org/", "allow"), ("com/fr/", "allow"), ("com/de/", "block"), (None, None), ("org/", "allow"), (None, None)]


def test_links(spark):
    html = """<a href="http://B.com/x"><a HREF='//c.net'><a href=https://b.com/y> <a href="/own"><a href="mailto:x"><a href="http://a.com/z"><p data-href="http://no.com">"""
    rows = [("http://a.com/", html), ("http://a.com/2", html), ("nothing", html), ("http://d.com", None), (None, html)]
    got = {tuple(r) for r in U.host_links(spark.createDataFrame(rows, "url string, html string")).collect()}
    assert {x for x in got if x[1] != "no.com"} == {("a.com", "b.com", 2), ("a.com", "c.net", 2)}


def plain_scores(pages, rounds=U.ROUNDS):
    from urllib.parse import urlsplit

    links, seeds = {}, {"allow": {}, "block": {}}
    for url, targets, verdict in pages:
        h = urlsplit(url).hostname
        for t in set(targets) - {h}:
            links[h, t] = links.get((h, t), 0) + 1
        if verdict:
            seeds[verdict][h] = seeds[verdict].get(h, 0) + 1
    out = {}
    for kind, own in (("allow", links), ("block", {(b, a): n for (a, b), n in links.items()})):
        s = {h: n / sum(seeds[kind].values()) for h, n in seeds[kind].items()}
        total = {}
        for (a, _), n in own.items():
            total[a] = total.get(a, 0) + n
        r = dict(s)
        for _ in range(rounds):
            new = {h: v * (1 - U.DAMPING) for h, v in s.items()}
            for (a, b), n in own.items():
                if a in r:
                    new[b] = new.get(b, 0) + r[a] * n / total[a] * U.DAMPING
            r = new
        out[kind] = r
    return out


def test_scores_by_plain_rounds(spark):
    pages = [
        ("http://good.com/fr/1", ["mid.net", "far.net"], "allow"), ("http://good.com/fr/2", ["mid.net"], "allow"), ("http://mid.net/x", ["far.net", "bad.com"], None),
        ("http://farm.net/x", ["bad.com"], None), ("http://farm.net/y", ["bad.com", "farm2.net"], None), ("http://bad.com/de/1", ["good.com"], "block"), ("http://farm2.net/", ["farm.net"], None), ("http://alone.net/", [], None),
    ]
    rows = [(i, u, "".join(f'<a href="http://{t}/">' for t in ts), "x", 1.0) for i, (u, ts, _) in enumerate(pages)]
    df = spark.createDataFrame(rows + [(None, None, None, "x", 1.0), (1, None, None, "x", 1.0)], "page_id long, url string, html string, host string, trust double")
    want = plain_scores(pages)
    got = {r.host: (r.trust, r.distrust) for r in U.host_scores(df).collect()}
    hosts = {h for k in want.values() for h in k} | {"alone.net"}
    assert set(got) == hosts
    for h in hosts:
        assert got[h] == pytest.approx((want["allow"].get(h, 0), want["block"].get(h, 0)))
    by = {r.page_id: r for r in U.judge(df).collect() if r.host}
    assert by[3].verdict == "block" and by[2].verdict == "allow" and by[7].verdict == "allow" and by[0].verdict == "allow" and by[5].verdict == "block"
    assert all(r.verdict == "allow" and r.path == "" for r in U.judge(df).collect() if not r.host)


def test_empty(spark):
    assert U.judge(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def html(*targets):
    return "".join(f'<a href="http://{t}/">' for t in targets)


def test_small_scores_still_decide(spark):
    """Distrust of 6e-12 and no trust: five times one link out of a hundred to a blocked host."""
    rows, target = [("http://bad.com/de/1", "")], "bad.com"
    for level in range(5):
        rows += [(f"http://h{level}x{k}.net/", html(target)) for k in range(100)]
        target = f"h{level}x0.net"
    got = {r.host: r for r in U.judge(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")).collect()}
    assert 0 < got[target].distrust < 1e-10 and got[target].trust == 0
    assert all(r.verdict == "block" for r in got.values())


def test_hosts_far_from_every_seed_are_reached(spark):
    """A chain of 14 links to a blocked host."""
    pages = [("http://bad.com/de/1", ["good.com"], "block"), *[(f"http://c{k}.net/", [f"c{k - 1}.net" if k else "bad.com"], None) for k in range(14)]]
    pages += [("http://good.com/fr/1", ["far.net"], "allow")]
    df = spark.createDataFrame([(i, u, html(*ts)) for i, (u, ts, _) in enumerate(pages)], "page_id long, url string, html string")
    got = {r.host: r for r in U.judge(df).collect()}
    want = plain_scores(pages, rounds=100)
    for h, r in got.items():
        assert (r.trust, r.distrust) == pytest.approx((want["allow"].get(h, 0), want["block"].get(h, 0)), rel=1e-7)
    assert got["c13.net"].distrust > 0 and got["c13.net"].verdict == "block"
