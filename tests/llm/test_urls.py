from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from skerry.llm import urls
from skerry.llm.common import table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    ends = [i for i in map(rest.find, "/?#") if i >= 0]
    cut = min(ends, default=len(rest))
    host, tail = rest[:cut].translate(LOWER), rest[cut:]
    return host, tail[: min([i for i in map(tail.find, "?#") if i >= 0], default=len(tail))]


def rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_whole_table(spark):
    got = {r.page_id: r for r in urls.op7_url_rules(spark, "/root/testdata/sf0.01").collect()}
    pages = table(spark, "/root/testdata/sf0.01", "pages").collect()
    assert len(pages) == len(got)
    for p in pages:
        r, (host, path) = got[p.page_id], parts(p.url)
        name, verdict = rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, name) and (r.verdict == verdict if name else r.verdict in ("allow", "block"))


ODD = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.COM/en/7x", "http://example.com/en/6", "http://notexample.com/en/7", "http://com/en/", "x://y://z/w", "http://é.COM/en/É?q#f", "http://a.net/de/8", "http://a.example.net#/de/8", "http://a.example.net?x/de/8", "http://b.example.net/de/8\n9?z", "//h/p", "http://q.org/es/" + "x" * 100_000, "http://İ.com/en/"]


def test_odd_urls(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(ODD)] + [(0, None), (None, "http://x.com/en/1")], "page_id long, url string").withColumns({c: F.lit("x") for c in ("host", "rule", "tokens", "mined", "bad", "row", "key")})
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = urls.judge(pages, labels).collect()
    assert len(out) == len(ODD) + 2
    for r in out:
        if r.page_id is not None:
            host, path = parts(ODD[r.page_id])
            name, verdict = rule(host, path)
            assert (r.host, r.path, r.rule, r.verdict) == (host, path, name, verdict or "allow")
    assert urls.judge(pages.limit(0), labels).collect() == []


def test_verdicts_of_the_contract(spark):
    """Each rule's word as its contract has it, not as the list in the code."""
    said = {
        "http://a.com/en/6": ("com/en/", "block"),
        "http://b.example.com/en/7x": ("example.com/en/7", "allow"),
        "http://a.net/de/8": ("net/de/", "allow"),
        "http://example.net/de/7": ("net/de/", "allow"),
        "http://c.example.net/de/81": ("example.net/de/8", "block"),
        "http://a.org/es/": ("org/es/", "block"),
    }
    pages = spark.createDataFrame(list(enumerate(said)), "page_id long, url string")
    out = urls.judge(pages, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert {list(said)[r.page_id]: (r.rule, r.verdict) for r in out} == said


@pytest.mark.parametrize("literal", [2000, 0])
def test_mined_rules(spark, monkeypatch, literal):
    """A token pair that is bad only together; both ways to look rules up agree."""
    monkeypatch.setattr(urls, "LITERAL_RULES", literal)
    rows = [(i, f"http://{'spam' if i % 2 else 'ham'}.example.io/{'win' if i % 3 else 'read'}/p{i}") for i in range(600)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, 1, int(bool(i % 2 and i % 3))) for i in range(0, 600)], "doc_id long, quality int, toxic int")
    out = {r.page_id: r.verdict for r in urls.judge(pages, labels.where("doc_id % 5 <> 0"), confidence=0.9).collect()}
    assert out == {i: "block" if i % 2 and i % 3 else "allow" for i in range(600)}


def test_mining_prunes(spark):
    data = spark.createDataFrame([(["a", "b"], True)] * 40 + [(["a", "c"], True)] * 40 + [(["c"], False)] * 200, "tokens array<string>, bad boolean")
    rules = {tuple(r.tokens): r for r in urls.mine(data, 0.01, 0.9).collect()}
    assert set(rules) == {("a",), ("b",)} and rules["a",].key == "a"
    assert urls.mine(data.limit(3)).collect() == [] and urls.mine(data.limit(0)).collect() == []


def brute_rules(rows, support, confidence):
    """All token combinations with enough support and confidence that no more general one with as much makes needless."""
    n, bags = len(rows), [(frozenset(t), bad) for t, bad in rows]
    every = {frozenset(c) for t, bad in bags if bad for k in range(1, len(t) + 1) for c in itertools.combinations(sorted(t), k)}
    good = {}
    for c in every:
        hits = [bad for t, bad in bags if c <= t]
        if sum(hits) >= max(support, urls.MIN_PAGES / n) * n - 1e-9 and sum(hits) / len(hits) >= confidence:
            good[c] = sum(hits) / len(hits)
    return {tuple(sorted(c)): round(x, 9) for c, x in good.items() if not any(d < c and y >= x for d, y in good.items())}


def test_mining_equals_brute_force(spark):
    rnd = random.Random(4)
    rows = []
    for _ in range(400):
        t = rnd.sample(["h:a", "h:b", "p:en", "p:0", "q:ref", "v:ref=x", "h:spam", "p:win"], rnd.randrange(2, 6))
        rows.append((t, rnd.random() < (0.9 if {"h:spam", "p:win"} <= set(t) else 0.7 if "v:ref=x" in t else 0.2)))
    for support, confidence in ((0.01, 0.6), (0.05, 0.7), (0.001, 0.85)):
        got = {tuple(r.tokens): round(r.confidence, 9) for r in urls.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), support, confidence).collect()}
        assert got == brute_rules(rows, support, confidence) and got


def test_tokens(spark):
    pages = spark.createDataFrame([("http://Casino24.example.COM/mp3/2024/a.html?Cat=Adult&page=12&x#f",)], "url string")
    u = F.col("url")
    assert set(pages.select(urls.tokens(u, urls.host_of(u), urls.path_of(u))).first()[0]) == {"h:casino0", "h:example", "h:com", "p:mp0", "p:0", "p:a", "p:html", "q:cat", "q:page", "q:x", "v:cat=adult", "v:page=0"}


def test_held_out_lift(spark):
    """Labels that follow a value of a query field: the mined rules hold on pages they were not mined from."""
    pages = spark.createDataFrame([(i, f"http://s{i}.example.io/p?cat={'adult' if i % 4 == 0 else 'news'}") for i in range(1000)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(1000)], "doc_id long, quality int, toxic int")
    r = urls.held_out_lift(pages, labels).first()
    assert r.rules >= 1 and r.matched == r.matched_bad == r.bad and 0 < r.bad < r.pages / 2
    none = urls.held_out_lift(pages, labels.withColumn("toxic", F.lit(0))).first()
    assert (none.rules, none.matched, none.bad) == (0, 0, 0)


def test_native():
    import inspect

    assert not any(w in inspect.getsource(urls) for w in ("pandas", "udf(", "mapIn", "applyIn", ".rdd"))
