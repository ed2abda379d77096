from __future__ import annotations

import datetime
import random

from pyspark.sql import functions as F

from skerry.llm import warc

SCHEMA = "record_id long, url string, ts timestamp, kind string, etag string, last_modified string, headers map<string,string>, body string"
T0 = datetime.datetime(2024, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("url_key", "span", "full", "latest", "carried", "target", "state")})


def brute(rows):
    out = []
    for i, url, ts, kind, etag, date, _, _ in rows:
        if kind != "revisit":
            continue
        earlier = [r for r in rows if r[3] == "response" and r[1] == url and r[2] is not None and ts is not None and url is not None and r[2] < ts]
        t = max(earlier, key=lambda r: (r[2], r[0]), default=None)
        strip = lambda x: x.removeprefix("W/") if x else x
        checks = [] if t is None else [a == b for a, b in ((strip(etag), strip(t[4])), (date, t[5])) if a is not None and b is not None]
        state = "orphan" if t is None else "mismatched" if not all(checks) else "matched" if checks else "unchecked"
        out.append((i, state, t and t[0], t[7] if state in ("matched", "unchecked") else None))
    return sorted(map(repr, out))


def test_equals_brute_force(spark):
    rnd, rows = random.Random(12), []
    for i in range(3000):
        url = rnd.choice(["http://hot.example/x", *(f"http://h{k}.example/x" for k in range(40))])
        ts = T0 + datetime.timedelta(hours=rnd.randrange(24 * 30))
        rows.append((i, url, ts, rnd.choice(["response", "revisit", "revisit"]), rnd.choice([None, '"a"', 'W/"a"', '"b"']), rnd.choice([None, None, "mon", "tue"]), {"X": str(i)}, f"body{i}"))
    got = sorted(repr((r.record_id, r.state, r.target_id, r.body)) for r in warc.resolve(frame(spark, rows)).collect())
    assert got == brute(rows)


def test_headers_are_merged_as_permitted(spark):
    rows = [
        (1, "HTTPS://WWW.Example.com:443/a/?b=2&utm_source=q&a=1#f", T0, "response", '"t"', None, {"Content-Type": "text/html", "Cache-Control": "max-age=1", "Content-Length": "9", "Gone": "no"}, "hello"),
        (2, "http://example.com/a?a=1&b=2", T0 + datetime.timedelta(1), "revisit", 'W/"t"', None, {"CACHE-CONTROL": "max-age=5", "content-length": "0", "Set-Cookie": "x", "Date": "d", "Nil": None}, None),
        (3, "http://example.com/a?a=1&b=2", T0 + datetime.timedelta(1), "revisit", '"z"', None, None, None),
    ]
    out = {r.record_id: r for r in warc.resolve(frame(spark, rows)).collect()}
    assert out[2].headers == {"cache-control": "max-age=5", "content-length": "9", "content-type": "text/html", "date": "d", "gone": "no"} and out[2].body == "hello" and out[2].state == "matched"
    assert (out[3].state, out[3].target_id, out[3].body, out[3].headers) == ("mismatched", 1, None, {})


def test_awkward_rows(spark):
    rows = [(1, None, T0, "response", None, None, None, "x"), (2, None, T0, "revisit", None, None, None, None), (3, "u", None, "response", None, None, None, "y"), (4, "u", None, "revisit", None, None, None, None), (5, "u", T0, "response", None, None, None, None), (6, "u", T0, "revisit", None, None, None, None), (7, "u", T0, "revisit", "", "", {}, ""), (8, "u", T0 + datetime.timedelta(seconds=1), "revisit", None, "m", None, None), (8, "u", T0 + datetime.timedelta(seconds=1), "revisit", None, "m", None, None), (9, "u", T0, "response", None, None, None, "last")]
    got = sorted(repr((r.record_id, r.state, r.target_id, r.body)) for r in warc.resolve(frame(spark, rows)).collect())
    assert got == brute(rows)
    assert warc.resolve(frame(spark, [])).collect() == []


def test_repeated_header_names(spark):
    rows = [(1, "http://a/x", T0, "response", '"t"', None, {"Via": "1", "via": "2", "X": "o"}, "b"), (2, "http://a/x", T0 + datetime.timedelta(1), "revisit", '"t"', None, {"VARY": "a", "vary": "b", "Vary": None, "X": None}, None)]
    out = warc.resolve(frame(spark, rows)).collect()[0]
    assert out.headers == {"via": "1, 2", "x": "o", "vary": "a, b"}
    listed = spark.createDataFrame([(*r[:6], [(k, v) for k, v in r[6].items()] + [("Via", "3"), (None, "z")], r[7]) for r in rows], SCHEMA.replace("map<string,string>", "array<struct<name:string,value:string>>"))
    assert warc.resolve(listed).collect()[0].headers == {"via": "3", "x": "o", "vary": "a, b"}


def test_ids_that_are_null_or_repeat(spark):
    later = T0 + datetime.timedelta(1)
    rows = [(None, "http://a/n", T0, "response", None, None, None, "nameless"), (2, "http://a/n", later, "revisit", None, None, None, None)]
    rows += [(7, f"http://a/{k}", T0, "response", None, None, None, f"body {k}") for k in range(4)] + [(10 + k, f"http://a/{k}", later, "revisit", None, None, None, None) for k in range(4)]
    out = {r.record_id: (r.state, r.target_id, r.body) for r in warc.resolve(frame(spark, rows + rows)).collect()}
    assert out == {2: ("unchecked", None, "nameless")} | {10 + k: ("unchecked", 7, f"body {k}") for k in range(4)}
    assert warc.resolve(frame(spark, rows + rows)).count() == 10


def test_canonical_urls(spark):
    pairs = {
        "http://A.test:80/": "a.test", "https://a.test:443": "a.test", "http://a.test:443/x": "a.test:443/x", "https://a.test:80/x": "a.test:80/x", "http://a.test/%7euser/%2f%zz%": "a.test/~user/%2F%zz%",
        "http://a.test/?b=%41&a=%c3%a9&utm_source=x": "a.test?a=%C3%A9&b=A", "no url": "no url",
    }
    rows = spark.createDataFrame([(k,) for k in pairs], "u string").select("u", warc.canonical(F.col("u")).alias("c")).collect()
    assert {r.u: r.c for r in rows} == pairs
