"""All queries by name, each with the SQL it is held against where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.functions import endpoints as E
from skerry.functions import js, urls, versions
from skerry.functions import severity as S
from skerry.functions import text as T
from skerry.operators import deps, frameworks, graph, html, js_relations, scope, scoring, secrets, workspace
from skerry.operators import auth as A
from skerry.plans import fixtures, pipelines
from skerry.sources import dims, files, sinks
from skerry.streaming import crawl

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

# Views that the SQL shares; the other side is in skerry.sources.files.
_REQUESTS = """req as (select event_id, user_id, 'https://api' || (user_id % 7) || '.example.com' as page,
  'https://api' || (user_id % 7) || '.example.com' || case event_type when 'signup' then '/register' when 'purchase' then '/api/admin/orders'
    when 'error' then '/oauth/token' when 'click' then '/login?next=/home' else '/graphql' end as url,
  case when event_type in ('signup', 'purchase', 'error') then 'POST' else 'GET' end as method, 'fetch' as resource_type,
  case when event_type = 'error' then 500 else 200 end as status_code from events)"""
_DEPS = """dep as (select case p_partkey % 6 when 0 then 'lodash' when 1 then 'express' when 2 then 'axios' when 3 then 'next-auth'
  when 4 then 'minimatch' else 'left-pad' end as name, (p_partkey % 5) || '.' || p_size || '.' || (p_partkey % 25) as version,
  'npm' as ecosystem, p_brand as source from part)"""
_KEY = r"list_transform(string_split(regexp_replace(regexp_replace({0}, '^v', ''), '^V', ''), '.'), lambda x: coalesce(try_cast(nullif(regexp_extract(x, '^[0-9]+'), '') as bigint), 0))"
_LINKS = r"""hrefs as (select url as src, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) as href from pages),
links as (select src, regexp_extract(src, '^(https?://[^/?#]+)', 1) || href as dst from hrefs)"""


def _norm(u: str) -> str:
    """Normal form of http(s) URLs that have no port, query or odd scheme beyond what the tables hold."""
    return rf"""regexp_replace(lower(regexp_extract({u}, '^([A-Za-z]+://[^/?#]*)', 1)) || regexp_extract({u}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)
      || case when len(list_filter(string_split(regexp_extract({u}, '\?([^#]*)', 1), '&'), lambda f: f <> '')) > 0
         then '?' || array_to_string(list_sort(list_filter(string_split(regexp_extract({u}, '\?([^#]*)', 1), '&'), lambda f: f <> '')), '&') else '' end, '/$', '')"""


def _values(rows: list[tuple], cols: str) -> str:
    def one(x) -> str:
        return "null" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else str(x)

    return f"(values {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) as v({cols})"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def wrap(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return wrap


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return files.table(spark, d, "pages")


def _hrefs(spark: SparkSession, d: str) -> DataFrame:
    return html.hrefs(_pages(spark, d), "html")


def _links(spark: SparkSession, d: str) -> DataFrame:
    return _hrefs(spark, d).select(F.col("url").alias("src"), urls.from_root(F.col("url"), F.col("href")).alias("dst"))


def _requests(spark: SparkSession, d: str) -> DataFrame:
    return files.requests(files.table(spark, d, "events"))


def _deps(spark: SparkSession, d: str) -> DataFrame:
    return files.dependencies(files.table(spark, d, "part"))


def _vulns(spark: SparkSession, d: str) -> DataFrame:
    return deps.vulnerabilities(_deps(spark, d), dims.advisories(spark))


# Links, pages, scripts


@query("link_extract", f"with {_LINKS} select src, dst from links")
def _(spark, d):
    return _links(spark, d)


@query("link_normalize", f"with {_LINKS} select dst, {_norm('dst')} as url from links")
def _(spark, d):
    return _links(spark, d).select("dst", urls.normalize(F.col("dst")).alias("url"))


@query("url_normalize", f"select url, {_norm('url')} as normal from pages")
def _(spark, d):
    return _pages(spark, d).select("url", urls.normalize(F.col("url")).alias("normal"))


@query("link_dedup", f"with {_LINKS} select distinct {_norm('dst')} as url from links")
def _(spark, d):
    return _links(spark, d).select(urls.normalize(F.col("dst")).alias("url")).distinct()


@query("url_parts", r"select page_id, lower(regexp_extract(url, '://([^/:?#]*)', 1)) as host, regexp_extract(url, '://([^/?#]*)', 1) as authority, list_sort(list_distinct(list_transform(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda f: f <> ''), lambda f: string_split(f, '=')[1]))) as fields from pages")
def _(spark, d):
    u = F.col("url")
    return _pages(spark, d).select("page_id", urls.host(u).alias("host"), urls.authority(u).alias("authority"), urls.field_names(u).alias("fields"))


def _parsed(spark, d):
    return html.parse(_pages(spark, d).select("url", F.col("html").alias("body")))


@query("page_titles", "select url, replace(replace(replace(trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') as title from pages")
def _(spark, d):
    return html.titles(_pages(spark, d), "html")


@query("page_links", f"with {_LINKS} select distinct src as url, dst as link from links")
def _(spark, d):
    return _parsed(spark, d).select("url", F.explode("links").alias("link")).where("link <> ''").distinct()


@query("page_route", "select page_id, case when page_id % 4 = 0 then 'html' when page_id % 4 = 1 then 'css' when page_id % 4 = 2 then 'js' else 'json' end as kind from pages")
def _(spark, d):
    t = F.element_at(F.array(*map(F.lit, ("text/html; charset=utf-8", "text/css", "application/javascript", "application/json"))), (F.col("page_id") % 4 + 1).cast("int"))
    return html.route(_pages(spark, d).withColumn("content_type", t)).select("page_id", "kind")


@query("page_meta", "select 'https://a.test/x/' as url, 'k' as name, 'v' as content")
def _(spark, d):
    return html.parse(spark.createDataFrame(fixtures.PAGES, "url string, body string")).select("url", F.explode("metadata").alias("name", "content"))


@query("inline_scripts", r"select url, unnest(regexp_extract_all(html, '(?s)<script>(.*?)</script>', 1)) as script from pages")
def _(spark, d):
    return _parsed(spark, d).select("url", F.explode("inline_scripts").alias("script"))


_Q = r"""['"]([^'"]+)['"]"""
_SCRIPTS = _values(fixtures.SCRIPTS, "file, text")


@query("js_dynamic_imports", rf"select file, unnest(list_distinct(regexp_extract_all(text, 'import\s*\(\s*{_Q.replace(chr(39), chr(39) * 2)}\s*\)', 1))) as spec from {_SCRIPTS}")
def _(spark, d):
    return spark.createDataFrame(fixtures.SCRIPTS, "file string, text string").select("file", F.explode(js.dynamic_imports(F.col("text"))).alias("spec"))


@query("css_urls", r"select url, unnest(regexp_extract_all(html, 'url\(([^)#][^)]*)\)', 1)) as ref from pages")
def _(spark, d):
    return _pages(spark, d).select("url", F.explode(js.css_urls(F.col("html"))).alias("ref"))


@query("hash_fragments", r"select page_id, unnest(list_distinct(regexp_extract_all(html, '#!?/[^\s""''<>]*'))) as fragment from pages".replace('""', '"'))
def _(spark, d):
    return _pages(spark, d).select("page_id", F.explode(js.hash_fragments(F.col("html"))).alias("fragment"))


@query("likely_urls", r"select distinct href, strlen(href) >= 4 and (regexp_matches(href, '^https?://') or href like '//%' or (href like '/%' and contains(href, '.') and not contains(href, ' ')) or (contains(href, '.') and contains(href, '/') and not contains(href, ' '))) as likely from hrefs".replace("from hrefs", f"from (with {_LINKS} select href from hrefs)"))
def _(spark, d):
    return _hrefs(spark, d).select("href", urls.looks_like_url(F.col("href")).alias("likely")).distinct()


# Scope, robots, crawl


_HOST = "lower(regexp_extract(url, '://([^/:?#]*)', 1))"


@query("scope_gate", f"select url, ({_HOST} = 'example.com' or {_HOST} like '%.example.com') and not (regexp_extract(url, '://[^/?#]*([^?#]*)', 1) like '/de%') and not ({_HOST} = 'blog.tionsh.example.com') as in_scope from pages")
def _(spark, d):
    s = scope.Scope(domains=["example.com"], excludes=["/de", "blog.tionsh.example.com"])
    return _pages(spark, d).select("url", s.contains(F.col("url")).alias("in_scope"))


@query("scope_target", f"select url, {_HOST} = 'example.org' or {_HOST} like '%.example.org' as in_scope from pages")
def _(spark, d):
    return _pages(spark, d).select("url", scope.Scope(target="example.org").contains(F.col("url")).alias("in_scope"))


@query("scope_regex", r"select url, regexp_matches(url, '/en/[0-9]{4}') as in_scope from pages")
def _(spark, d):
    return _pages(spark, d).select("url", scope.Scope(regexes=["/en/[0-9]{4}", "["]).contains(F.col("url")).alias("in_scope"))


@query("scope_cidr", "select s_suppkey, s_suppkey % 256 between 16 and 31 as in_scope from supplier")
def _(spark, d):
    u = F.concat(F.lit("http://10.0.0."), (F.col("s_suppkey") % 256).cast("string"), F.lit("/x"))
    return files.table(spark, d, "supplier").select("s_suppkey", scope.Scope(cidrs=["10.0.0.16/28", "bad"]).contains(u).alias("in_scope"))


@query("scope_entries", "select entry_type, pattern from " + _values(fixtures.SCOPE, "id, workspace_id, entry_type, pattern") + " where workspace_id = 'w1'")
def _(spark, d):
    rows = spark.createDataFrame(fixtures.SCOPE, "id string, workspace_id string, entry_type string, pattern string").withColumn("created_at", F.timestamp_seconds(F.lit(0)))
    return scope.list_entries(rows, "w1").select("entry_type", "pattern")


@query("robots_allowed", r"""with p as (select url, regexp_extract(url, '://([^/?#]*)', 1) as host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) as path from pages),
r as (select url, max(case when k = 'd' and starts_with(path, x) then length(x) end) as ban, max(case when k = 'a' and starts_with(path, x) then length(x) end) as ok
      from p, (values ('d', '/en/'), ('a', '/en/7'), ('d', '/fr/8'), ('a', '/fr/8')) v(k, x) where host like '%.example.com' group by url)
select p.url, r.ban is null or coalesce(r.ok, 0) > r.ban as allowed from p left join r on p.url = r.url""")
def _(spark, d):
    body = "User-agent: bad\nDisallow: /\nUser-agent: *\nDisallow: /en/ # no\r\nAllow: /en/7\nDisallow: /fr/8\nAllow: /fr/8\nSitemap: x\n"
    pages = _pages(spark, d).select("url")
    hosts = pages.select(urls.host(F.col("url")).alias("host")).distinct().where("host like '%.example.com'")
    return scope.robots_allowed(pages, scope.robots_rules(hosts.withColumn("body", F.lit(body))))


_GRID = "grid as (select 'https://s' || n_regionkey || '.test' as src, 'https://s' || n_regionkey || '.test/n' || n_nationkey as dst from nation union all select 'https://s' || (n_nationkey % 5) || '.test/n' || n_nationkey, 'https://s' || ((n_nationkey + 1) % 5) || '.test' from nation)"


def _grid(spark, d):
    n = files.table(spark, d, "nation")
    site = lambda k: F.concat(F.lit("https://s"), k.cast("string"), F.lit(".test"))
    page = lambda k: F.concat(site(k), F.lit("/n"), F.col("n_nationkey").cast("string"))
    k = F.col("n_nationkey")
    return n.select(site(F.col("n_regionkey")).alias("src"), page(F.col("n_regionkey")).alias("dst")).union(n.select(page(k % 5), site((k + 1) % 5)))


@query("crawl_frontier", f"with recursive {_GRID}, w(url, depth) as (select 'https://s0.test', 0 union select g.dst, w.depth + 1 from w join grid g on g.src = w.url where w.depth < 3) select url, min(depth) as depth from w group by url")
def _(spark, d):
    return crawl.frontier(_grid(spark, d), spark.createDataFrame([("HTTPS://S0.test/",)], "url string"), 3)


@query("crawl_stats", "select count(*) as pages, cast(sum(o_orderkey % 4) as bigint) as links, cast(sum(o_orderkey % 3) as bigint) as assets, count(*) filter (o_orderstatus = 'P') as errors, cast(sum(length(o_orderpriority)) as bigint) as bytes from orders")
def _(spark, d):
    o = files.table(spark, d, "orders")
    k = F.col("o_orderkey")
    return crawl.stats(o.select(F.array_repeat(F.lit(1), (k % 4).cast("int")).alias("links"), F.array_repeat(F.lit(1), (k % 3).cast("int")).alias("assets"), F.when(F.col("o_orderstatus") == "P", "x").alias("error"), F.length("o_orderpriority").cast("long").alias("size")))


@query("first_response", "with q as (select event_type as url, event_id as seq, row_number() over (partition by event_type order by event_id) as k from events), r as (select event_type as url, status, row_number() over (partition by event_type order by event_id) as k from (select *, cast(200 + event_id % 3 as int) as status from events where event_id % 2 = 0)) select q.url, q.seq, r.status as got_status from q left join r on q.url = r.url and q.k = r.k")
def _(spark, d):
    e = files.table(spark, d, "events").select(F.col("event_type").alias("url"), F.col("event_id").alias("seq"))
    got = e.where("seq % 2 = 0").select("url", "seq", (200 + F.col("seq") % 3).cast("int").alias("status_code"), F.lit(None).cast("map<string,string>").alias("headers"))
    return crawl.first_response(e, got).select("url", "seq", "got_status")


# Secrets

_PS = dims.secret_patterns()
_HEX, _B64, _TOK = _PS[-2].regex, _PS[-1].regex, _PS[-3].regex


def _re(x: str) -> str:
    return x.replace("'", "''")


def _secret_sql(select: str) -> str:
    parts = " union all ".join(
        f"select doc_id, text, {i} as ord, '{p.type}' as secret_type, {p.severity} as severity, '{p.provider}' as provider, '{p.key.replace(chr(39), chr(39) * 2)}' as key, unnest(list_distinct(regexp_extract_all(text, '{_re(p.regex)}'))) as m from documents where not regexp_matches(lower(text), 'your[-_]|xxxx')" for i, p in enumerate(_PS)
    )
    cut = "case when strlen(m) > 80 then substr(m, 1, 80) || '...' else m end"
    return f"with f as ({parts}), g as (select *, {cut} as match from f where strlen(m) >= 8 and not contains(lower(m), 'placeholder')), h as (select *, row_number() over (partition by doc_id, secret_type, match order by ord) as rn from g) {select} from h where rn = 1"


def _doc_findings(spark, d, **kw):
    docs = files.table(spark, d, "documents").select("text", F.col("doc_id").cast("string").alias("source"))
    return secrets.scan(files.spread(docs), **kw)


@query("secret_findings", _secret_sql("select cast(doc_id as varchar) as source, secret_type, cast(severity as int) as severity, provider, key, match"))
def _(spark, d):
    return _doc_findings(spark, d).select("source", "secret_type", "severity", "provider", "key", "match")


@query("secret_counts_by_type", _secret_sql("select secret_type, provider, count(*) as n").replace("where rn = 1", "where rn = 1 group by 1, 2"))
def _(spark, d):
    return _doc_findings(spark, d).groupBy("secret_type", "provider").agg(F.count("*").alias("n"))


@query("secret_severity", _secret_sql("select cast(doc_id as varchar) as source, key, match").replace("where rn = 1", "where rn = 1 and severity >= 2"))
def _(spark, d):
    return _doc_findings(spark, d, min_severity=2).select("source", "key", "match")


@query("secret_max_per_source", "select source, count(*) as n from (" + _secret_sql("select cast(doc_id as varchar) as source") + ") group by source having count(*) < 2 union all select source, 2 from (" + _secret_sql("select cast(doc_id as varchar) as source") + ") group by source having count(*) >= 2")
def _(spark, d):
    return _doc_findings(spark, d, max_findings=2).groupBy("source").agg(F.count("*").alias("n"))


@query("secret_samples")
def _(spark, d):
    return secrets.scan(spark.createDataFrame(fixtures.SECRETS, "text string, source string"))


@query("text_entropy", "select p_partkey, round(-list_sum(list_transform(list_distinct(string_split(p_name, '')), lambda c: len(list_filter(string_split(p_name, ''), lambda x: x = c)) / strlen(p_name) * log2(len(list_filter(string_split(p_name, ''), lambda x: x = c)) / strlen(p_name)))), 6) as entropy from part")
def _(spark, d):
    return files.table(spark, d, "part").select("p_partkey", F.round(T.entropy(F.col("p_name")), 6).alias("entropy"))


@query("text_cut_hash", "select p_partkey, case when strlen(p_name) > 9 then substr(p_name, 1, 9) || '...' else p_name end as cut, substr(sha256(p_name), 1, 16) as hash from part")
def _(spark, d):
    n = F.col("p_name")
    return files.table(spark, d, "part").select("p_partkey", T.cut(n, 9).alias("cut"), T.hash16(n).alias("hash"))


# Dependencies


@query("version_compare", f"with {_DEPS}, v as (select distinct version from dep) select version, case when {_KEY.format('version')} < [2, 10, 3] then -1 when {_KEY.format('version')} > [2, 10, 3] then 1 else 0 end as cmp from v")
def _(spark, d):
    return _deps(spark, d).select("version").distinct().select("version", versions.compare(F.col("version"), F.lit("v2.10.3")).alias("cmp"))


_ADV = _values([(i, p, s, f) for i, p, _, s, _, f, _ in dims.advisory_rows()], "id, package_name, severity, fixed_in")
_HITS = f"{_DEPS}, hits as (select distinct a.id, d.name as affected_package, d.version as affected_version, cast(a.severity as int) as severity, a.fixed_in as fixed_version from dep d, (select * from {_ADV}) a where starts_with(d.name, a.package_name) and {_KEY.format('d.version')} < {_KEY.format('a.fixed_in')})"


@query("vuln_lookup", f"with {_HITS} select * from hits")
def _(spark, d):
    return deps.lookup(_deps(spark, d), dims.advisories(spark)).select("id", "affected_package", "affected_version", "severity", "fixed_version")


@query("vuln_exact", f"with {_HITS} select h.* from hits h join (select * from {_ADV}) a on a.id = h.id where a.package_name = h.affected_package")
def _(spark, d):
    return deps.lookup(_deps(spark, d), dims.advisories(spark), exact=True).select("id", "affected_package", "affected_version", "severity", "fixed_version")


@query("vuln_min_severity", f"with {_HITS} select id, affected_package, affected_version from hits where severity >= 3")
def _(spark, d):
    return deps.vulnerabilities(_deps(spark, d), dims.advisories(spark), min_severity=3).select("id", "affected_package", "affected_version")


@query("vuln_dedup", f"with {_HITS} select id, affected_package, affected_version, 'advisory-db' as source from hits")
def _(spark, d):
    v = deps.lookup(_deps(spark, d), dims.advisories(spark))
    return deps.dedup(v.unionByName(v.withColumn("source", F.lit("osv")))).select("id", "affected_package", "affected_version", "source")


@query("vuln_by_severity", f"with {_HITS} select case severity when 1 then 'LOW' when 2 then 'MEDIUM' when 3 then 'HIGH' when 4 then 'CRITICAL' else 'UNKNOWN' end as severity, count(*) as n from hits group by severity")
def _(spark, d):
    return _vulns(spark, d).groupBy(S.name(F.col("severity")).alias("severity")).agg(F.count("*").alias("n"))


@query("package_counts", f"with {_DEPS} select ecosystem, count(*) as n, count(distinct name) as names from dep group by ecosystem")
def _(spark, d):
    return _deps(spark, d).groupBy("ecosystem").agg(F.count("*").alias("n"), F.count_distinct("name").alias("names"))


@query("vuln_orphans", "select 'CVE-x' as id, 'gone' as affected_package")
def _(spark, d):
    v = _vulns(spark, d).select("id", "affected_package").unionByName(spark.createDataFrame([("CVE-x", "gone")], "id string, affected_package string"))
    return deps.orphans(v, _deps(spark, d)).select("id", "affected_package")


@query("manifest_packages", "select * from " + _values(fixtures.EXPECTED_PACKAGES, "name, version, ecosystem, source"))
def _(spark, d):
    return deps.packages(spark.createDataFrame(fixtures.MANIFESTS, "path string, content string")).select("name", "version", "ecosystem", "source")


@query("manifest_requirements", "select p_partkey, lower(replace(p_brand, '#', '-')) as name, cast(p_size as varchar) || '.0' as version from part")
def _(spark, d):
    p = files.table(spark, d, "part")
    name = F.lower(F.replace("p_brand", F.lit("#"), F.lit("-")))
    m = p.select(F.concat_ws("/", F.col("p_partkey").cast("string"), F.lit("requirements.txt")).alias("path"), F.concat(F.lit("# made\n"), name, F.lit(" >= "), F.col("p_size").cast("string"), F.lit(".0 ; x\nbare\n")).alias("content"))
    return deps.packages(m).select(F.split_part("path", F.lit("/"), F.lit(1)).cast("bigint").alias("p_partkey"), "name", "version")


# Authentication


_AUTH = r"case when regexp_matches(url, '/login|/signin|/sign-in|/authenticate') then 'login' when regexp_matches(url, '/register|/signup|/sign-up') then 'register' when regexp_matches(url, '/token$|/o?auth/token') then 'token' else '' end"


@query("auth_endpoints", f"with {_REQUESTS}, t as (select page, url, method, {_AUTH} as endpoint_type, event_id from req) select page, url, method, endpoint_type from t where endpoint_type <> '' qualify row_number() over (partition by page, url, endpoint_type order by event_id) = 1")
def _(spark, d):
    return A.auth_endpoints(_requests(spark, d)).select("page", "url", "method", "endpoint_type")


@query("jwt_decode", "select * from (values ('RS256', 'access', 'user123', 'https://issuer.example')) v(algorithm, token_type, subject, issuer)")
def _(spark, d):
    return spark.createDataFrame([(fixtures.TOKEN,)], "t string").select(A.jwt(F.col("t")).alias("j")).select("j.algorithm", "j.token_type", "j.subject", "j.issuer")


@query("auth_cookies", "select * from (values ('sessionid', 'session', false), ('my_refresh_token', 'refresh', false), ('theme', 'unknown', false), ('jwt', 'access', true)) v(name, token_type, suspicious)")
def _(spark, d):
    return A.auth_cookies(fixtures.runtime(spark)).select("name", "token_type", "suspicious")


@query("auth_diagram")
def _(spark, d):
    return A.diagram(fixtures.runtime(spark))


# Scores


def _scored(spark, d):
    return scoring.score(scoring.of_requests(_requests(spark, d)))


_SCORES = f"""{_REQUESTS}, s as (select method || ' ' || url as label,
 case when regexp_matches(url, 'login|signin|signup|register|auth|oauth|token|authorize|callback|logout|refresh|revoke') then case when contains(url, 'token') then 1.0 when method = 'POST' then 0.8 else 0.5 end end as a,
 case when regexp_matches(url, '/admin|/dashboard|/manage|/panel|/backend|wp-admin') then 1.0 end as b,
 case when regexp_matches(url, '/graphql|graphql\\?|/gql') then 1.0 end as c,
 case when regexp_matches(url, '/redirect|/callback|/return|/next|/goto|/forward|/proxy|/logout|redirect_uri|\\?return|\\?next|\\?dest=|\\?url=') then 1.0 end as e from req),
z as (select label, round(cast(coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) + coalesce(e, 0) + 0.5 as double), 6) as score, a, b, c, e from s),
p as (select *, case when score >= 5 then 'CRITICAL' when score >= 3 then 'HIGH' when score >= 1.5 then 'MEDIUM' when score >= 0.5 then 'LOW' else 'NONE' end as priority from z)"""


@query("score_endpoints", f"with {_SCORES} select label, score, priority from p")
def _(spark, d):
    return _scored(spark, d).select("label", "score", "priority")


@query("score_breakdown", f"with {_SCORES} select distinct label, array_to_string(list_filter([case when b > 0 then 'admin_routes' end, case when a > 0 then 'authentication' end, case when c > 0 then 'graphql' end, 'new_endpoints', case when e > 0 then 'redirects' end], lambda x: x is not null), ', ') as summary from p")
def _(spark, d):
    return _scored(spark, d).select("label", "summary").distinct()


@query("rank_by_priority", f"with {_SCORES} select priority, count(*) as n from p group by priority")
def _(spark, d):
    return scoring.counts(_scored(spark, d))


@query("rank_topk", f"with {_SCORES} select label, score from (select distinct label, score from p) order by score desc, label limit 10")
def _(spark, d):
    return scoring.top(_scored(spark, d).dropDuplicates(["id"]).withColumn("id", F.col("label")), 10).select("label", "score")


@query("rank_min_priority", f"with {_SCORES} select label, score from p where score >= 1.5")
def _(spark, d):
    return scoring.at_least(_scored(spark, d), "MEDIUM").select("label", "score")


@query("new_endpoints", f"with {_REQUESTS} select distinct url from req where page <> 'https://api3.example.com'")
def _(spark, d):
    r = _requests(spark, d)
    known = r.where("page = 'https://api3.example.com'").select("url")
    s = scoring.score(scoring.of_requests(r), known)
    return s.where(F.map_contains_key("breakdown", "new_endpoints")).select(F.regexp_extract("id", "^api:[A-Z]+:(.*)$", 1).alias("url")).distinct()


@query("score_deps", f"with {_HITS} select 'cve:' || id as id, affected_package, round(0.5 + case when severity >= 3 then 0.8 else 0 end + severity / 4.0, 6) as score from hits")
def _(spark, d):
    v = _vulns(spark, d)
    items = scoring.of_vulnerabilities(v).withColumn("provider", F.col("name"))
    return scoring.score(items).select("id", F.col("source").alias("affected_package"), "score")


_SECRET_SCORE = """round(case when contains(key || ': ' || match, 'token') then 1.0 else 0.5 end + case when contains(key || ': ' || match, 'graphql') then 0.8 else 0 end
  + case when secret_type in ('aws', 'gcp', 'azure', 'private_key', 'password', 'jwt', 'oauth', 'token', 'connection_string') then 1.0 when provider in ('AWS', 'Azure', 'GitHub') then 0.7 else 0 end
  + case when secret_type = 'private_key' then 1.0 else severity / 4.0 end + 0.5, 6)"""


@query("score_secrets", _secret_sql(f"select secret_type || ':' || match as id, cast({_SECRET_SCORE} as double) as score, count(*) as n").replace("where rn = 1", "where rn = 1 group by 1, 2"))
def _(spark, d):
    return scoring.score(scoring.of_secrets(_doc_findings(spark, d))).groupBy("id", "score").agg(F.count("*").alias("n"))


@query("rank_union")
def _(spark, d):
    return pipelines.rank(fixtures.runtime(spark), _deps(spark, d), dims.advisories(spark), top=50)


@query("endpoint_tests", f"with {_REQUESTS} select distinct url, regexp_matches(url, '/admin|/dashboard|/manage|/panel|/backend|wp-admin') as admin, regexp_matches(url, '/upload|/file|/media|/attachment|/image|/document|/import|/export') as upload, regexp_matches(url, '/graphql|graphql\\?|/gql') as graphql from req")
def _(spark, d):
    u = F.col("url")
    return _requests(spark, d).select("url", E.is_admin(u).alias("admin"), E.is_upload(u).alias("upload"), E.is_graphql(u).alias("graphql")).distinct()


@query("retry_status", "select distinct cast(400 + o_orderkey % 200 as int) as code, (400 + o_orderkey % 200) = 429 or (400 + o_orderkey % 200) >= 500 or (400 + o_orderkey % 200) = 408 as again from orders")
def _(spark, d):
    c = (400 + F.col("o_orderkey") % 200).cast("int")
    return files.table(spark, d, "orders").select(c.alias("code"), E.retry_status(c, (408,)).alias("again")).distinct()


# Graph


def _link_graph(spark, d):
    return graph.Graph().add_links(_links(spark, d))


_CLEAN = "regexp_replace({0}, '/$', '')"
_G = f"{_LINKS}, nodes as (select distinct 'page::' || {_CLEAN.format('u')} as id, {_CLEAN.format('u')} as label from (select src as u from links union all select dst from links)), edges as (select 'page::' || {_CLEAN.format('src')} as source, 'page::' || {_CLEAN.format('dst')} as target from links)"


@query("graph_nodes", f"with {_G} select id, 'page' as type, label from nodes")
def _(spark, d):
    return _link_graph(spark, d).nodes.select("id", "type", "label")


@query("graph_edges", f"with {_G} select source, target, 'references' as type from edges")
def _(spark, d):
    return _link_graph(spark, d).edges.select("source", "target", "type")


@query("graph_stats", f"with {_G} select 'node' as kind, 'page' as type, count(*) as n from nodes union all select 'node', '', count(*) from nodes union all select 'edge', 'references', count(*) from edges union all select 'edge', '', count(*) from edges")
def _(spark, d):
    g = _link_graph(spark, d)
    return graph.stats(g.nodes, g.edges)


@query("graph_requests", f"with {_REQUESTS} select 'page::' || page as source, 'api::' || method || '::' || url as target, count(*) as n from req group by 1, 2")
def _(spark, d):
    return graph.Graph().add_requests(_requests(spark, d)).edges.groupBy("source", "target").agg(F.count("*").alias("n"))


def _request_graph(spark, d):
    return graph.Graph().add_requests(_requests(spark, d))


@query("graph_neighbors", f"with {_REQUESTS} select distinct 'api::' || method || '::' || url as id from req where page = 'https://api1.example.com'")
def _(spark, d):
    g = _request_graph(spark, d)
    return graph.neighbours(g.nodes, g.edges, "page::https://api1.example.com").select("id")


@query("graph_edges_between", f"with {_REQUESTS} select count(*) as n from req where page = 'https://api1.example.com' and url = page || '/graphql'")
def _(spark, d):
    e = _request_graph(spark, d).edges
    return graph.between(e, "page::https://api1.example.com", "api::GET::https://api1.example.com/graphql").agg(F.count("*").alias("n"))


@query("graph_search", f"with {_REQUESTS} select distinct 'api::' || method || '::' || url as id from req where url like '%login%' or url like '%oauth%'")
def _(spark, d):
    return graph.search(_request_graph(spark, d).nodes, "Login oauth").select("id")


@query("graph_search_ranked", f"with {_REQUESTS} select distinct 'api::' || method || '::' || url as id, 6 as score from req where url like '%login%'")
def _(spark, d):
    return graph.search_ranked(_request_graph(spark, d).nodes, "LOGIN").select("id", "score")


@query("graph_degrees", f"with {_G}, b as (select source as id, target as o from edges union select target, source from edges) select id, count(*) as neighbours from b group by id")
def _(spark, d):
    return graph.degrees(_link_graph(spark, d).edges)


def _nation_edges(spark, d):
    n = files.table(spark, d, "nation")
    node = lambda c: F.concat(F.lit("n"), c.cast("string"))
    k = F.col("n_nationkey")
    return n.select(node(k).alias("source"), node((k * 3 + 1) % 25).alias("target")).union(n.select(node(k), node((k + 7) % 25)))


_NATION = "e as (select 'n' || n_nationkey as s, 'n' || ((n_nationkey * 3 + 1) % 25) as t from nation union all select 'n' || n_nationkey, 'n' || ((n_nationkey + 7) % 25) from nation)"


@query("graph_paths", f"with recursive {_NATION}, w(path, h, n) as (select ['n0'], 'n0', 0 union all select list_append(path, e.t), e.t, n + 1 from w join e on e.s = w.h where n < 6 and not list_contains(path, e.t)) select path, n as hops from w where h = 'n11' and n = (select min(n) from w where h = 'n11')")
def _(spark, d):
    return graph.paths(_nation_edges(spark, d), "n0", "n11")


@query("graph_reachable", f"with recursive {_NATION}, w(id) as (select 'n2' union select e.t from w join e on e.s = w.id) select id from w where id <> 'n2'")
def _(spark, d):
    return graph.reachable(_nation_edges(spark, d), "n2")


@query("graph_all_sources")
def _(spark, d):
    g = pipelines.build_graph(fixtures.runtime(spark), spark.createDataFrame(fixtures.FILES, "project string, path string, content string, ord int"), _deps(spark, d), dims.advisories(spark), "https://app.test")
    return g.stats()


@query("score_graph", f"with {_SCORES} select distinct 'api::' || replace(label, ' ', '::') as id, 'api_endpoint' as item_type, score from p union all select distinct 'page::' || page, 'page', 0.5::double from req")
def _(spark, d):
    return scoring.score(scoring.of_nodes(_request_graph(spark, d).nodes)).select("id", "item_type", "score")


# Frameworks


@query("framework_confidence", "select * from " + _values(fixtures.EXPECTED_FRAMEWORKS, "project, framework, confidence"))
def _(spark, d):
    return frameworks.detect(spark.createDataFrame(fixtures.FILES, "project string, path string, content string, ord int")).select("project", "framework", F.col("confidence").cast("decimal(3,2)").alias("confidence"))


# Scripts as trees


@query("js_tokens")
def _(spark, d):
    return js_relations.tokens(fixtures.modules(spark))


@query("js_ast")
def _(spark, d):
    return js_relations.tree(fixtures.modules(spark))


@query("js_imports", "select * from " + _values(fixtures.EXPECTED_IMPORTS, "file, source, imported, local, is_default, is_namespace"))
def _(spark, d):
    return js_relations.imports(js_relations.tree(fixtures.modules(spark))).select("file", "source", "imported", "local", "is_default", "is_namespace")


@query("js_callgraph", "select * from " + _values(fixtures.EXPECTED_CALLS, "file, caller, callee"))
def _(spark, d):
    return js_relations.call_edges(js_relations.tree(fixtures.modules(spark)))


# Sinks, workspaces


@query("export_json", f"with {_REQUESTS}, n as (select distinct 'page' as type, 'page::' || page as id, page as label from req union select distinct 'api_endpoint', 'api::' || method || '::' || url, method || ' ' || url from req) select '{{\"kind\":\"node\",\"id\":\"' || id || '\",\"type\":\"' || type || '\",\"label\":\"' || label || '\"' as line, count(*) as n from n group by 1 union all select '{{\"kind\":\"edge\",\"id\":\"page::' || page || '->api::' || method || '::' || url || ':calls\",\"type\":\"calls\",\"source\":\"page::' || page || '\",\"target\":\"api::' || method || '::' || url || '\",\"label\":\"' || method || ' fetch\"', count(*) from req group by 1")
def _(spark, d):
    g = _request_graph(spark, d)
    return graph.to_json(g.nodes, g.edges).groupBy(F.regexp_replace("line", ',"properties":.*$', "").alias("line")).agg(F.count("*").alias("n"))


@query("export_dot", f"with {_NATION} select 2 as part, '  \"' || s || '\" -> \"' || t || '\" [label=\"references\", fontsize=8];' as line from e union all select 1, '  \"n' || n_nationkey || '\" [label=\"page\\\\n' || n_name || '\", color=\"#4A90D9\", fontsize=10];' from nation union all select * from (values (0, 'digraph G {{'), (0, '  rankdir=LR;'), (0, '  node [shape=box, style=rounded];'), (3, '}}')) v(part, line)")
def _(spark, d):
    e = _nation_edges(spark, d).select(F.concat("source", F.lit("->"), "target").alias("id"), F.lit("references").alias("type"), "source", "target", F.lit("x").alias("label"))
    n = files.table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.lit("page").alias("type"), F.col("n_name").alias("label"))
    return graph.to_dot(n, e).select("part", "line")


@query("workspace_hash", "select c_custkey, sha256('w' || c_custkey || '|' || c_name || '|' || c_mktsegment || '|/w|1') as hash from customer")
def _(spark, d):
    c = files.table(spark, d, "customer").select("c_custkey", F.concat(F.lit("w"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("target"), F.lit("/w").alias("root"), F.lit(1).alias("version"))
    return c.select("c_custkey", workspace.content_hash().alias("hash"))


@query("snapshot_diff", "select o_orderkey, case when o_orderkey % 10 = 0 then 'removed' when o_orderkey % 10 = 1 then 'added' else 'changed' end as change from orders where o_orderkey % 10 in (0, 1, 2)")
def _(spark, d):
    o = files.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = o.where("o_orderkey % 10 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 10 == 2, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return workspace.difference(o.where("o_orderkey % 10 <> 1"), new, ["o_orderkey"])


from skerry import catalogue_tables  # noqa: E402, F401  registers more queries


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
