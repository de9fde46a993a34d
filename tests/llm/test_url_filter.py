from __future__ import annotations

import random

import pytest

from matchlake.llm import queries, url_filter


def test_parsing_and_rules(spark):
    urls = {
        "https://WWW.Example.com/en/71?x=/a#b": ("www.example.com", "/en/71", "example.com/en/7", "allow"),
        "http://example.com/en/81": ("example.com", "/en/81", "com/en/", "block"),
        "http://notexample.com/en/7": ("notexample.com", "/en/7", "com/en/", "block"),
        "http://a.example.net/de/8/": ("a.example.net", "/de/8/", "example.net/de/8", "block"),
        "x://org/es/#y": ("org", "/es/", "org/es/", "block"),
        "http://org?q=://z/es/": ("org", "", None, None),
        "a://b://c/d": ("b:", "//c/d", None, None),
        "no-scheme.com/en/7": ("", "", None, None),
        "": ("", "", None, None),
        None: ("", "", None, None),
        "http://ÄB.com:8/en/": ("Äb.com:8", "/en/", None, None),
    }
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df, queries.RULES).collect()}
    for i, want in enumerate(urls.values()):
        assert got[i][:3] == want[:3]
        if want[3]:
            assert got[i][3] == want[3]


def test_propagation_equals_dense_iteration(spark):
    edges = [("a", "b", 2), ("a", "c", 1), ("b", "c", 1), ("d", "spam", 3), ("e", "d", 1), ("c", "a", 1), ("spam", "x", 1)]
    seeds = {"a": (1.0, 0.0), "spam": (0.0, 1.0), "b": (0.0, 0.25)}
    got = {r["host"]: (r["trust"], r["distrust"]) for r in url_filter.propagated(spark.createDataFrame(edges, "src string, dst string, pages long"), spark.createDataFrame([(k, *v) for k, v in seeds.items()], "host string, trust double, distrust double")).collect()}
    hosts = {h for a, b, _ in edges for h in (a, b)}
    rank = {h: list(seeds.get(h, (0.0, 0.0))) for h in hosts}
    for _ in range(200):
        new = {h: list(seeds.get(h, (0.0, 0.0))) for h in hosts}
        for a, b, n in edges:
            new[b][0] += 0.85 * rank[a][0] * n / sum(m for x, _, m in edges if x == a)
            new[a][1] += 0.85 * rank[b][1] * n / sum(m for _, y, m in edges if y == b)
        rank = new
    for h in hosts:
        assert abs(got.get(h, (0, 0))[0] - rank[h][0]) < 1e-3 and abs(got.get(h, (0, 0))[1] - rank[h][1]) < 1e-3
    assert got["d"][1] > got["d"][0]


def test_links_and_verdicts(spark):
    page = lambda *links: "<p>" + "".join(f'<A class="x" href="{u}">t</a>' for u in links) + "</p>"
    rows = [(1, "http://good.net/de/1", page("https://friend.io/a", "/local", "//Friend.io/b")), (2, "http://bad.com/en/1", page("http://other.io")), (3, "http://farm.io/", page("http://bad.com/x")), (4, "http://friend.io/", None), (5, "http://plain.io/", "")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, host string")
    assert sorted(tuple(r) for r in url_filter.host_edges(df).collect()) == [("bad.com", "other.io", 1), ("farm.io", "bad.com", 1), ("good.net", "friend.io", 1)]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(df, queries.RULES).collect()}
    assert got == {1: "allow", 2: "block", 3: "block", 4: "allow", 5: "allow"}


def test_empty_table(spark):
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string, html string"), queries.RULES).collect() == []


def test_links_of_base_references_comments_and_scripts(spark):
    rows = [
        ("http://a.io/x", '<base href="https://B.io/"><a href="/rel">t</a><a href="c">t</a>', {("a.io", "b.io")}),
        ("http://c.io/x", '<!-- <a href="http://no.io/">t</a> --><script>"<a href=http://no2.io/>"</script><a href=http://yes.io>t</a>', {("c.io", "yes.io")}),
        ("http://d.io/x", '<a title="x" href="https&#58;&#x2F;&sol;e.io&quest;q=1">t</a><a href="http://f.io&#47;p?a=1&amp;b=2">t</a>', {("d.io", "e.io"), ("d.io", "f.io")}),
        ("http://g.io/x", '<a data-href="http://no.io/" href="/own">t</a><a href="mailto:x@h.io">t</a><a href="http://i.io">t</a>', {("g.io", "i.io")}),
        ("http://j.io/x", '<style><a href="http://no.io/"></style><a href="//k.io/">t', {("j.io", "k.io")}),
        ("nowhere", '<a href="http://l.io">t</a>', set()),
    ]
    df = spark.createDataFrame([(u, h) for u, h, _ in rows], "url string, html string")
    assert {(r["src"], r["dst"]) for r in url_filter.host_edges(df).collect()} == set().union(*(e for _, _, e in rows))


def test_verdicts_equal_brute_force(spark):
    """Parsed pages to verdicts, with a hub host that a third of all pages link to."""
    rng = random.Random(2)
    hosts = [f"h{i}.com" for i in range(12)] + [f"s{i}.net" for i in range(6)] + ["hub.io"]
    pages, links = [], {}
    for i in range(260):
        host = rng.choice(hosts)
        path = rng.choice(["/en/1", "/de/2", "/x", "/en/7"])
        to = {rng.choice(hosts) for _ in range(rng.randint(0, 3))} | ({"hub.io"} if rng.random() < 0.3 else set())
        pages.append((i, f"http://{host}{path}", "".join(f'<a href="http://{t}/p">x</a>' for t in sorted(to)) + '<a href="/own">y</a>'))
        for t in to - {host}:
            links[(host, t)] = links.get((host, t), 0) + 1
    rows = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), queries.RULES).collect()
    own = {}
    for r in rows:
        own.setdefault(r["host"], []).append(r["verdict"] if r["rule"] else None)
    seed = {h: (sum(v == "allow" for v in vs) / len(vs), sum(v == "block" for v in vs) / len(vs)) for h, vs in own.items()}
    rank = {h: seed.get(h, (0, 0)) for h in {*seed, *(x for e in links for x in e)}}
    for _ in range(300):
        new = {h: list(seed.get(h, (0, 0))) for h in rank}
        for (a, b), n in links.items():
            new[b][0] += 0.85 * rank[a][0] * n / sum(m for (x, _), m in links.items() if x == a)
            new[a][1] += 0.85 * rank[b][1] * n / sum(m for (_, y), m in links.items() if y == b)
        rank = new
    decided = 0
    for r in rows:
        trust, distrust = rank[r["host"]]
        assert abs(r["trust"] - trust) < 5e-3 and abs(r["distrust"] - distrust) < 5e-3
        if not r["rule"] and abs(distrust - 0.5) > 0.01 and abs(distrust - trust) > 0.01:
            assert r["verdict"] == ("block" if distrust >= 0.5 and distrust > trust else "allow")
            decided += (r["verdict"] == "block") != (seed[r["host"]][1] >= 0.5)
    assert decided  # the links decide some


def test_unconverged_ranks_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "ROUNDS", 4)
    monkeypatch.setattr(url_filter, "TOLERANCE", 0.0)
    edges = spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], "src string, dst string, pages long")
    with pytest.raises(RuntimeError, match="rounds"):
        url_filter.propagated(edges, spark.createDataFrame([("a", 1.0, 0.0)], "host string, trust double, distrust double"))
