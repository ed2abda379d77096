"""Small recorded inputs for what the tables do not hold: visits, manifests, sources, scripts."""

from __future__ import annotations

import base64
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Row

from skerry import schemas


def _part(x: dict) -> str:
    return base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")


TOKEN = ".".join((_part({"alg": "RS256", "typ": "JWT"}), _part({"sub": "user123", "iss": "https://issuer.example", "exp": 1900000000, "iat": 1700000000, "scope": "openid mail"}), "c2lnbmF0dXJl"))
REFRESH = ".".join((_part({"alg": "HS256"}), _part({"type": "refresh", "sub": "u2"}), "c2ln"))


def visits() -> list[dict]:
    r = lambda url, method="GET", code=200, **h: {"url": url, "method": method, "resource_type": "fetch", "status_code": code, "headers": h}
    oauth = "https://id.test/oauth/authorize?response_type=code&client_id=c1&redirect_uri=https%3A%2F%2Fapp.test%2Fcb&scope=openid+mail&code_challenge=x"
    return [
        {
            "url": "https://app.test/",
            "requests": [r("https://app.test/"), r("https://app.test/login", "POST"), r("https://api.test/me", Authorization=f"Bearer {TOKEN}"), r(oauth), r("https://app.test/auth/callback?code=1"), r("https://id.test/oauth/token", "POST"), r("https://id.test/token/refresh?grant_type=refresh_token", "POST"), r("https://app.test/logout"), r(f"https://api.test/x?access_token={REFRESH}"), r("https://app.test/admin/upload", "POST", 403)],
            "web_sockets": [{"url": "wss://app.test/ws"}],
            "event_sources": [{"url": "https://app.test/sse"}],
            "cookies": [{"name": n, "value": v, "domain": "app.test", "path": "/", "secure": s, "http_only": not s} for n, v, s in (("sessionid", "abc", True), ("my_refresh_token", "abc", False), ("theme", "dark", False), ("jwt", TOKEN, True))],
            "local_storage": [{"key": "id_token", "value": TOKEN}, {"key": "note", "value": "x" * 30}],
            "session_storage": [{"key": "opaque", "value": "A1" * 25}],
            "indexed_db": [{"database": "db", "version": 2, "stores": [{"name": "auth", "records": ["token=" + "Z9" * 12, "plain"]}]}],
            "service_workers": [{"url": "https://app.test/sw.js", "scope": "/", "active": True}],
        },
        {"url": "https://quiet.test", "requests": [], "web_sockets": [], "event_sources": [], "cookies": [], "local_storage": [], "session_storage": [], "indexed_db": [], "service_workers": []},
    ]


def runtime(spark: SparkSession) -> DataFrame:
    text = spark.createDataFrame([Row(j=json.dumps(v)) for v in visits()], "j string")
    from pyspark.sql import functions as F

    return text.select(F.from_json("j", schemas.RUNTIME).alias("v")).select("v.*")


PAGES = [
    ("https://a.test/x/", '<html><head><title> One </title><base href="/b/"><link rel="stylesheet" href="s.css"><link rel="icon" href="i.ico"><meta name="k" content="v"><meta http-equiv="refresh" content="3;url=/next"></head><body><a href="p">x</a><a href="#/route">r</a><img src="a.png" srcset="b.png 1x, c.png 2x"><script src="m.js"></script><script>import("./d.js"); fetch("/api/v1.json")</script><style>@import "t.css"; p{background:url(u.png)}</style><form action="/go" method="post"><input name="q"><input type="submit"></form><iframe src="f.html"></iframe><button onclick="go(\'/h/i.js\')">b</button></body></html>'),
    ("https://a.test/empty", ""),
    ("https://a.test/broken", "<a href='q'<b><form><input name=z>"),
]
SCRIPTS = [("a.js", "const x = import('./lazy.js'); import(\"./lazy.js\"); new URL('./img.png', import.meta.url);\n//# sourceMappingURL=a.js.map\n"), ("b.js", '__webpack_public_path__ = "/static/"; load("chunk-0af3"); var u = "https://cdn.test/lib.js"; var v = "no url";\n'), ("c.js", "")]
SCOPE = [("1", "w1", "domain", "example.com"), ("2", "w1", "exclude", "/logout"), ("3", "w2", "domain", "other.com")]
ROBOTS = [("a.test", "User-agent: x\nDisallow: /x\nUser-agent: *\nDisallow: /admin\nAllow: /admin/public\nCrawl-delay: 2\nSitemap: https://a.test/s.xml\n"), ("b.test", "User-agent: *\nUser-agent: y\nDisallow: /\n"), ("c.test", "")]
SITEMAPS = [("a.test", 0, "<html></html>"), ("a.test", 1, "<urlset><url><loc> https://a.test/1 </loc></url><url><loc>https://a.test/2</loc></url></urlset>"), ("a.test", 2, "<loc>https://a.test/3</loc>")]
SECRETS = [
    ("key AKIA" + "ABCDEFGHIJKLMNOP and ghp_" + "a1" * 18, "one"),
    ("aws_secret_access_key = '" + "Ab1/" * 10 + "'", "two"),
    ("password: hunter2hunter2 your-name", "placeholder"),
    ("mongodb://user:secretpw@db.test/x", "three"),
    (None, "none"),
    ("-----BEGIN RSA PRIVATE KEY-----", "four"),
]
MANIFESTS = [
    ("app/package.json", '{"dependencies": {"react": "^18.2.0"}, "devDependencies": {"vite": "~5.0.1"}}'),
    ("app/node_modules/z/package.json", '{"dependencies": {"hidden": "1.0.0"}}'),
    ("bad/package.json", "{"),
    ("go/go.mod", "module m\n\ngo 1.22\n\nrequire github.com/a/b v1.2.3\n\nrequire (\n\tgithub.com/c/d v0.1.0+incompatible // indirect\n)\n"),
    ("rb/Gemfile", 'source "x"\ngem "rails", "~> 7.0"\n'),
    ("rb/Gemfile.lock", "GEM\n  specs:\n    rack (2.2.3)\n      deep (>= 1)\n\nPLATFORMS\n  ruby\n"),
    ("rs/Cargo.toml", '[package]\nname = "x"\nversion = "1.0.0"\n[dependencies]\nserde = "1.0"\ntokio = { version = "1.2", features = ["full"] }\n'),
    ("rs/Cargo.lock", '[[package]]\nname = "libc"\nversion = "0.2.1"\n'),
    ("php/composer.json", '{"require": {"php": ">=8", "a/b": "^2.1"}}'),
    ("php/composer.lock", '{"packages": [{"name": "c/d", "version": "v3.0.0"}], "packages-dev": [{"name": "e/f", "version": "1"}]}'),
    ("mv/pom.xml", "<project><properties><v>4.5</v></properties><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId><version>${v}</version></dependency><dependency><groupId>t</groupId><artifactId>t</artifactId><version>1</version><scope>test</scope></dependency></dependencies></project>"),
    ("py/requirements.txt", "# c\nflask==2.0.1\nnopin\n"),
]
EXPECTED_PACKAGES = [
    ("react", "18.2.0", "npm", "package.json"),
    ("vite", "5.0.1", "npm", "package.json"),
    ("github.com/a/b", "v1.2.3", "Go", ""),
    ("github.com/c/d", "v0.1.0", "Go", ""),
    ("rails", "7.0", "RubyGems", "Gemfile"),
    ("rack", "2.2.3", "RubyGems", "Gemfile.lock"),
    ("serde", "1.0", "crates.io", "Cargo.toml"),
    ("tokio", "1.2", "crates.io", "Cargo.toml"),
    ("libc", "0.2.1", "crates.io", "Cargo.lock"),
    ("a/b", "2.1", "Packagist", "composer.json"),
    ("c/d", "3.0.0", "Packagist", "composer.lock"),
    ("g:a", "4.5", "Maven", "pom.xml"),
    ("flask", "2.0.1", "PyPI", "requirements.txt"),
]
FILES = [
    ("p1", "package.json", '{"dependencies": {"react": "18", "next": "14"}}', 0),
    ("p1", "next.config.js", "module.exports = {}", 1),
    ("p1", "src/App.jsx", "import React from 'react'; const [a] = useState(1);", 2),
    ("p2", "main.txt", "from 'react'", 0),
    ("p3", "src/a.vue", "import { createApp } from 'vue'; createApp({})", 0),
]
EXPECTED_FRAMEWORKS = [("p1", "react", 1.0), ("p1", "next", 0.95), ("p3", "vue", 1.0)]
MODULES = [
    ("m.js", 'import { readFile } from "fs"; import def from "mod"; import * as ns from "all"; import "side"; export { a as b, c }; export default function main() { return readFile(`x${def}y`); } export const k = 1, l = 2; export * from "re";'),
    ("c.js", "function a(){ b(); const f = () => b(); } function b(){ c(); } function c(){} a(); obj.c();"),
    ("t.js", "const s = `plain`; tag`a${1 + 2}b`; h.css`z`; switch (x) { foo } class K extends L { m(p) { let q = p; } static n() {} }"),
    ("e.js", "let x = ; @@ 'open"),
]
EXPECTED_IMPORTS = [("m.js", "fs", "readFile", "readFile", False, False), ("m.js", "mod", "default", "def", True, False), ("m.js", "all", "*", "ns", False, True)]
EXPECTED_CALLS = [("c.js", "a", "b"), ("c.js", "a", "b"), ("c.js", "b", "c"), ("c.js", "(global)", "a"), ("c.js", "(global)", "c")]


def modules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODULES, "file string, text string")
