"""Operator 13 against a plain reading of the rules and dense matrices."""

import random
import re

import numpy as np
import pytest

from furrow.llm import url_filter as uf
from furrow.llm.queries import op13_link_trust


def parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")


def ruled(host, path, rules):
    best = (None, None)
    for verdict, rule in rules:
        h, rest = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + rest) and (best[0] is None or len(rule) > len(best[0])):
            best = rule, verdict
    return best


def walks(hosts, seeds, links, damping=uf.DAMPING):
    """Where walks from seeds (host -> 1) end; links {(src, dst): pages}."""
    hosts = sorted(hosts)
    move = np.zeros((len(hosts), len(hosts)))
    for (a, b), n in links.items():
        move[hosts.index(a), hosts.index(b)] = n
    out = move.sum(1, keepdims=True)
    move = np.divide(move, out, out=np.zeros_like(move), where=out > 0)
    s = np.array([float(h in seeds) for h in hosts])
    return dict(zip(hosts, (1 - damping) * np.linalg.solve(np.eye(len(hosts)) - damping * move.T, s)))


def plain(pages, links, rules, damping=uf.DAMPING):
    """{page_id: (host, path, rule, verdict, trust, distrust)}"""
    rows = [(i, *parts(u), *ruled(*parts(u), rules)) for i, u in pages]
    hosts = {r[1] for r in rows} | {h for e in links for h in e}
    seeds = {v: {h for h in hosts if h and (all_ := [r[4] for r in rows if r[1] == h]) and all_.count(v) >= max(uf.SEED_SHARE * len(all_), 1)}
             for v in (uf.ALLOW, uf.BLOCK)}
    trust = walks(hosts, seeds[uf.ALLOW], links, damping)
    distrust = walks(hosts, seeds[uf.BLOCK], {(b, a): n for (a, b), n in links.items()}, damping)
    out = []
    for i, h, p, rule, verdict in rows:
        bad = distrust[h] > trust[h] and distrust[h] >= uf.LEAST * (1 - damping)
        out.append((i, h, p, rule, verdict or (uf.BLOCK if bad else uf.ALLOW), trust[h], distrust[h]))
    return out


def check(rows, want):
    assert len(rows) == len(want)
    key = lambda r: tuple(str(x) for x in r[:5])
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict, r.trust, r.distrust) for r in rows), key=key)
    for g, w in zip(got, sorted(want, key=key)):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], abs=1e-4)


def test_op13_over_a_table(spark, sf):
    import pyarrow.parquet as pq
    pages = [(r["page_id"], r["url"]) for r in pq.read_table(f"{sf}/pages.parquet").to_pylist()]
    rows = op13_link_trust(spark, sf).collect()
    check(rows, plain(pages, {}, uf.RULES))
    assert {r.rule for r in rows} >= {None, "com/", "net/es/", "net/fr/", "example.com/en/"}


def test_a_graph_of_links(spark):
    rng = random.Random(3)
    rules = [("allow", "good.org/"), ("block", "bad.net/"), ("block", "bad.net/x/"), ("allow", "bad.net/x/y"), ("block", "half.org/b/")]
    hosts = [f"h{i}.org" for i in range(30)] + ["a.good.org", "good.org", "bad.net", "x.bad.net", "notbad.net", "half.org"]
    pages, links, n = [], {}, 0
    for h in hosts:
        # a host in the middle of the graph has a third of all pages
        for _ in range(150 if h == "h7.org" else 8):
            to = set(rng.sample(hosts[:12] if h in hosts[:12] else hosts, 2)) - {h}
            p = rng.choice(["/x/1", "/x/y", "/b/2", "/c"])
            body = "".join(f"<a class='q' href=\"https://{t.upper()}/p?q#z\">x</a>" for t in to) + "<a href=/own>y</a>" * 3
            pages.append((n, f"https://{h}{p}?u", body))
            for t in to:
                links[h, t] = links.get((h, t), 0) + 1
            n += 1
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    rows = uf.judge(df, rules, damping=0.5).collect()
    check(rows, plain([(i, u) for i, u, _ in pages], links, rules, 0.5))
    unruled = {r.host: r.verdict for r in rows if r.rule is None}
    assert set(unruled.values()) == {"allow", "block"}


def test_links_of_a_page():
    page = """<!-- <a href='http://c.org/'> --><script>x="<a href=http://s.org>"</script><A HREF = http://A.org:80/p>1</a>
      <a title="<b href='http://t.org'>" href='//B.org?x'>2</a><a href="mailto:x@m.org">3</a><a rel="x NoFollow" href="http://n.org">4</a>
      <area href="HTTPS:\\\\d.org\\p"><a href="http&#58;//e.org">5</a><a href=" ht\ntp://f.org ">6</a><link href="http://l.org">
      <a data-href="http://no.org" href=x>7</a><a href="ftp://g.org/">8</a><a href>9</a><abbr href="http://z.org">10</abbr><a/href=//s.lash>"""
    assert uf.linked_hosts(page, "own.org") == {"a.org:80", "b.org", "d.org", "e.org", "f.org", "s.lash"}
    assert uf.linked_hosts("<base href='//k.org/x/'><a href=y>", "own.org") == {"k.org"}
    for odd in (None, "", "//", "<a href", "<a href=//", "<!--" * 50_000 + "//", "<script " * 20_000 + "//", "<a " * 50_000):
        assert uf.linked_hosts(odd, "own.org") == set()
    assert uf.linked_hosts("<a href='/x\">" * 20_001 + "<a href='//u.org'>", "own.org") == {"u.org"}


def test_odd_rows(spark):
    urls = [None, "", "no scheme", "http://", "http:///p", "x://HOST.com", "http://a.com/é?x#y", "http://a.com#f/g", "http://a.com?u=b://c.net/es/",
            "http://x.net/es/1\n2", "http://x.net/es", "http://x.net/fr/" + "z" * 50_000, "http://net/fr/", "http://\n.net/es/?", "http://com/",
            "http://www.example.com/en/", "http://a.www.example.com/en/x", "http://wwwexample.com/en/", "HTTP://EXAMPLE.COM/en/", "http://a b.org/"]
    pages = [(i, u) for i, u in enumerate(urls)] + [(None, "http://x.net/es/"), (3, "http://x.net/es/"), (3, "http://x.net/es/")]
    df = spark.createDataFrame([(i, u, None if i == 1 else "<a href=//x.net>", 1, "r", 2.0) for i, u in pages],
                               "page_id long, url string, html string, Host int, rule string, Trust double")
    made = uf.judge(df)
    assert made.columns == ["page_id", "url", "host", "path", "rule", "verdict", "trust", "distrust"]
    hosts = [parts(u)[0] for i, u in pages if i != 1]
    check(made.collect(), plain(pages, {(h, "x.net"): hosts.count(h) for h in set(hosts) if h not in ("", "x.net")}, uf.RULES))
    assert uf.judge(df.limit(0)).count() == 0
