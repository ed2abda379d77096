"""Column functions on stated inputs."""

from __future__ import annotations

import math
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skerry.functions import endpoints, js, severity, text, urls, versions


def values(spark, fn, inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r.y for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_normalize_url(spark):
    cases = {
        "HTTPS://EXAMPLE.COM": "https://example.com",
        "https://example.com:443/": "https://example.com",
        "http://example.com:80/a": "http://example.com/a",
        "https://example.com/page?b=2&a=1": "https://example.com/page?a=1&b=2",
        "https://example.com/p?b=2&a=3&a=1#frag": "https://example.com/p?a=3&a=1&b=2",
        "//example.com/path": "https://example.com/path",
        "example.com/x/": "https://example.com/x",
        "ftp://example.com": "",
        "mailto:a@b": "",
        "": "",
        "https://": "",
    }
    assert values(spark, urls.normalize, list(cases)) == list(cases.values())


def test_resolve(spark):
    refs = ["/a", "b/c", "../up", "https://x.test/y", "javascript:void(0)", " mailto:x@y", "?q=1", "/a/../b", "//other.test/z", ""]
    got = values(spark, lambda c: urls.resolve(F.lit("https://h.test/d/e?f=1"), c), refs)
    assert got == ["https://h.test/a", "https://h.test/d/b/c", "https://h.test/up", "https://x.test/y", "", "", "https://h.test/d/e?q=1", "https://h.test/b", "https://other.test/z", "https://h.test/d/e?f=1"]


def test_versions(spark):
    raw = ["^18.2.0", "~1.6.0", ">= 5.0", "v1.8.1", "1.0 - 2.0", "=2.0,<3", "~> 7.0", "!=1", "  3.1 ", ""]
    assert values(spark, versions.bare, raw) == ["18.2.0", "1.6.0", "5.0", "1.8.1", "1.0", "2.0", "7.0", "1", "3.1", ""]
    pairs = [("1.0", "1.0.0", -1), ("v1.0.0", "1.0.0", 0), ("1.10.0", "1.9.9", 1), ("1.2.3-beta", "1.2.3", 0), ("4.17.19", "4.17.21", -1), ("x", "0", 0)]
    df = spark.createDataFrame(pairs, "a string, b string, want int")
    assert df.where(versions.compare(F.col("a"), F.col("b")) != F.col("want")).collect() == []


def test_severity(spark):
    assert values(spark, severity.of_cvss, [9.0, 7.0, 6.9, 4.0, 0.1, 0.0], "double") == [4, 3, 2, 2, 1, 0]
    assert values(spark, severity.priority, [5.0, 4.99, 3.0, 1.5, 0.5, 0.49, 0.0], "double") == ["CRITICAL", "HIGH", "HIGH", "MEDIUM", "LOW", "NONE", "NONE"]
    assert values(spark, severity.parse, [" high ", "Critical", "moderate", "LOW", "medium"]) == [3, 4, 0, 1, 2]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.characters(blacklist_categories=("Cs",), blacklist_characters="\x00"), max_size=30), min_size=1, max_size=40))
def test_entropy_and_cut_equal_python(spark, texts):
    def want(t):
        n = len(t.encode())
        return -sum(c / n * math.log2(c / n) for c in Counter(t).values()) if n else 0.0

    assert values(spark, text.entropy, texts) == pytest.approx(list(map(want, texts)), abs=1e-9)
    cut = values(spark, lambda c: text.cut(c, 7), texts)
    assert all(b == t if len(t.encode()) <= 7 else b.endswith("...") and b[:-3].rstrip("�") in t for t, b in zip(texts, cut, strict=True))


def test_text(spark):
    assert values(spark, text.hash16, ["abc"]) == ["ba7816bf8f01cfea"]
    assert values(spark, text.label, ['a"b\nc', "x" * 90]) == ["a'b c", "x" * 77 + "..."]
    assert values(spark, lambda c: text.between(c, "<a>", "</a>"), ["<a>x</a><a>y</a>", "<a>x", ""]) == ["x", "", ""]
    assert values(spark, lambda c: text.around(c, F.lit("key"), 3), ["ab\ncdkeyef\rgh", "no"]) == [" cdkeyef", ""]


def test_endpoints(spark):
    u = ["https://h/Admin/x", "https://h/wp-admin", "https://h/a"]
    assert values(spark, endpoints.is_admin, u) == [True, True, False]
    assert values(spark, endpoints.cookie_type, ["connect.sid", "XSRF-TOKEN", "my_refresh_token", "theme", "id_token"]) == ["session", "csrf", "refresh", "unknown", "id"]
    assert values(spark, endpoints.is_token, ["eyJ" + "a" * 20, "A1" * 25, "x" * 30, "a b" * 20, "eyJ"]) == [True, True, False, False, False]
    assert values(spark, endpoints.retry_status, [429, 500, 599, 404, 200], "int") == [True, True, True, False, False]


def test_javascript(spark):
    t = "const a = \"https://c.test/x.js\"; f('/api/v1.json'); g(`//cdn.test/l`); h('no url'); import(\"./d.js\"); import('./d.js');"
    assert values(spark, js.script_urls, [t])[0] == ["https://c.test/x.js", "./d.js", "/api/v1.json", "//cdn.test/l"]
    assert values(spark, js.dynamic_imports, [t])[0] == ["./d.js"]
    maps = values(spark, js.source_maps, ["//# sourceMappingURL=a.map\n/*# sourceMappingURL=b.map */\n//# sourceMappingURL=data:application/json;base64,QUJD"])[0]
    assert [(m.url[:5], m.inline, m.inline_data) for m in maps] == [("a.map", False, ""), ("data:", True, "QUJD"), ("b.map", False, "")] or sorted(m.inline_data for m in maps) == ["", "", "QUJD"]
    assert values(spark, js.css_urls, ["a{b:url( 'x.png' )} c{d:url(#id)} @import \"t.css\";"])[0] == ["x.png", "t.css"]
    assert values(spark, js.hash_fragments, ["go #/a/b and #!/c 'x#/d' #e"])[0] == ["#/a/b", "#!/c", "#/d"]
