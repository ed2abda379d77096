"""More queries by name: client, scope, workspace, authentication, script and manifest operators over inputs made from the tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skerry import schemas
from skerry.catalogue import _DEPS, _G, _HITS, _REQUESTS, _SCORES, _deps, _link_graph, _request_graph, _scored, _secret_sql, _vulns, query
from skerry.functions import endpoints as E
from skerry.functions import js, urls
from skerry.functions import severity as S
from skerry.functions import text as T
from skerry.operators import auth as A
from skerry.operators import client, deps, frameworks, graph, html, js_relations, scope, scoring, secrets, workspace
from skerry.plugins import Plugin, Registry
from skerry.sources import dims, files, sinks
from skerry.streaming import crawl

C = F.col


def _text(x: str) -> F.Column:
    return C(x).cast("string")


def _filled(template: str, **parts) -> F.Column:
    """``template`` with the columns in place of @NAME, in the order given."""
    out = F.lit(template)
    for name, part in parts.items():
        out = F.replace(out, F.lit("@" + name), part)
    return out


# Texts and URLs


@query("text_labels", "with t as (select page_id, replace(replace('\"' || url || chr(10) || url, '\"', ''''), chr(10), ' ') as flat from pages) select page_id, case when strlen(flat) > 80 then substr(flat, 1, 77) || '...' else flat end as label from t")
def _(spark, d):
    u = C("url")
    return files.table(spark, d, "pages").select("page_id", T.label(F.concat(F.lit('"'), u, F.lit("\n"), u)).alias("label"))


@query("text_helpers", "select p_partkey, coalesce(nullif(case when p_size % 2 = 0 then '' else p_type end, ''), 'none') as filled, case when length(p_brand) < 12 then rpad(p_brand, 12, ' ') else p_brand end as padded, regexp_extract(p_name, ' (.*?) ', 1) as inner_word from part")
def _(spark, d):
    t = F.when(C("p_size") % 2 == 0, "").otherwise(C("p_type"))
    return files.table(spark, d, "part").select("p_partkey", T.if_empty(t, "none").alias("filled"), T.pad_right(C("p_brand"), 12).alias("padded"), T.between(C("p_name"), " ", " ").alias("inner_word"))


_ENTROPY = "-list_sum(list_transform(list_distinct(string_split(h, '')), lambda c: len(list_filter(string_split(h, ''), lambda x: x = c)) / strlen(h) * log2(len(list_filter(string_split(h, ''), lambda x: x = c)) / strlen(h))))"


@query("high_entropy", f"select p_partkey, strlen(h) >= 20 and round({_ENTROPY}, 9) >= 3.2 as high from (select p_partkey, substr(md5(p_name), 1, 8 + p_size) as h from part)")
def _(spark, d):
    h = F.expr("substring(md5(p_name), 1, 8 + p_size)")
    return files.table(spark, d, "part").select("p_partkey", ((F.octet_length(h) >= 20) & (F.round(T.entropy(h), 9) >= 3.2)).alias("high"))


@query("url_shortened", "with t as (select page_id, url || '/' || repeat('p', cast(page_id % 90 as int)) || '?q=' || repeat('v', cast(page_id % 50 as int)) as u from pages) select page_id, case when strlen(u) <= 80 then u when instr(u, '?') between 2 and 80 then substr(u, 1, instr(u, '?')) || '...' else substr(u, 1, 77) || '...' end as short, 'GET:' || u as key from t")
def _(spark, d):
    u = F.concat("url", F.lit("/"), F.expr("repeat('p', cast(page_id % 90 as int))"), F.lit("?q="), F.expr("repeat('v', cast(page_id % 50 as int))"))
    return files.table(spark, d, "pages").select("page_id", urls.shortened(u).alias("short"), urls.cache_key(F.lit("GET"), u).alias("key"))


_DOMAIN = "case c_custkey % 4 when 0 then ' HTTPS://Shop' || c_custkey || '.Example.com:8080/x ' when 1 then '*.Site' || c_custkey || '.test' when 2 then 'plain' || c_custkey else 'Host' || c_custkey || '.test:90/p' end"


@query("domain_names", f"with t as (select c_custkey, {_DOMAIN} as raw from customer) select c_custkey, case c_custkey % 4 when 0 then 'shop' || c_custkey || '.example.com' when 1 then '*.site' || c_custkey || '.test' when 2 then 'plain' || c_custkey else 'host' || c_custkey || '.test' end as normal, contains(raw, '.') and not contains(raw, '/') and not contains(raw, '*') as is_domain, c_custkey % 4 = 1 as is_wildcard, regexp_replace(raw, '^\\*\\.', '') as bare from t")
def _(spark, d):
    t = files.table(spark, d, "customer").select("c_custkey", F.expr(_DOMAIN).alias("raw"))
    return t.select("c_custkey", urls.normal_domain(C("raw")).alias("normal"), scope.is_domain(C("raw")).alias("is_domain"), scope.is_wildcard(C("raw")).alias("is_wildcard"), scope.without_wildcard(C("raw")).alias("bare"))


_RULES = [("domain", "a.test"), ("domain", "plain"), ("domain", "*.b.test"), ("subdomain", "*.c.test"), ("cidr", "10.0.0.0/8"), ("cidr", "10.0.0.1"), ("cidr", "300.0.0.0/8"), ("regex", "^/x"), ("regex", "["), ("exclude", "/logout"), ("other", "x")]


@query("scope_checked", "select * from (values ('domain', 'a.test', 'domain', 'a.test'), ('domain', 'plain', null, null), ('domain', '*.b.test', 'domain', 'b.test'), ('subdomain', '*.c.test', 'domain', 'c.test'), ('cidr', '10.0.0.0/8', 'cidr', '10.0.0.0/8'), ('cidr', '10.0.0.1', null, null), ('cidr', '300.0.0.0/8', null, null), ('regex', '^/x', 'regex', '^/x'), ('regex', '[', null, null), ('exclude', '/logout', 'exclude', '/logout'), ('other', 'x', null, null)) v(entry_type, pattern, stored_type, stored_pattern)")
def _(spark, d):
    def stored(kind: str, pattern: str):
        try:
            return scope.checked(kind, pattern)
        except ValueError:
            return None, None

    return spark.createDataFrame([(k, p, *stored(k, p)) for k, p in _RULES], "entry_type string, pattern string, stored_type string, stored_pattern string")


# Severities and priorities

_WORD = "case o_orderkey % 7 when 0 then ' high ' when 1 then 'Critical' when 2 then 'low' when 3 then 'MEDIUM' when 4 then 'none' when 5 then '' else 'urgent' end"
_RANK = "case o_orderkey % 7 when 0 then 3 when 1 then 4 when 2 then 1 when 3 then 2 else 0 end"
_CVSS = "case when x >= 9 then 4 when x >= 7 then 3 when x >= 4 then 2 when x > 0 then 1 else 0 end"


@query("severity_parse", f"with t as (select o_orderkey, {_WORD} as word, (o_orderkey % 101) / 10.0 as x from orders) select o_orderkey, cast({_RANK} as int) as rank, ['UNKNOWN', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][1 + {_RANK}] as name, cast({_RANK} as double) as number, cast({_CVSS} as int) as of_cvss, cast(case when o_orderkey % 7 in (1, 2, 3) then {_RANK} else {_CVSS} end as int) as of_advisory from t")
def _(spark, d):
    x = (C("o_orderkey") % 101) / 10.0
    rank = S.parse(C("word"))
    t = files.table(spark, d, "orders").select("o_orderkey", F.expr(_WORD).alias("word"), x.alias("x"))
    # a stated word with blanks is none of the four, so the score decides
    return t.select("o_orderkey", rank.cast("int").alias("rank"), S.name(rank).alias("name"), S.number(rank).alias("number"), S.of_cvss(C("x")).cast("int").alias("of_cvss"), S.of_advisory(C("word"), F.array(C("x").cast("string"))).cast("int").alias("of_advisory"))


@query("priority_parse", f"with t as (select o_orderkey, {_WORD} as word, (o_orderkey % 61) / 10.0 as x from orders) select o_orderkey, cast(case when o_orderkey % 7 = 4 then 0 when o_orderkey % 7 in (5, 6) then 1 else {_RANK} end as int) as rank, case when x >= 5 then 'CRITICAL' when x >= 3 then 'HIGH' when x >= 1.5 then 'MEDIUM' when x >= 0.5 then 'LOW' else 'NONE' end as priority from t")
def _(spark, d):
    x = (C("o_orderkey") % 61) / 10.0
    return files.table(spark, d, "orders").select("o_orderkey", S.priority_rank(F.expr(_WORD)).alias("rank"), S.priority(x).alias("priority"))


# Client


_ERROR = "case o_orderkey % 6 when 0 then 'i/o timeout' when 1 then 'connection refused' when 2 then 'no such host' when 3 then 'bad request' when 4 then 'read: connection reset by peer' else null end"


@query("retry_plan", "select o_orderkey, coalesce(o_orderkey % 6 in (0, 1, 2, 4), false) as again, least(10.0, pow(2.0, o_orderkey % 8) * 0.5) as wait, least(10.0, pow(2.0, o_orderkey % 8) * 0.5 + 0.25) as wait_jittered from orders")
def _(spark, d):
    n = (C("o_orderkey") % 8 + 1).cast("double")
    return files.table(spark, d, "orders").select("o_orderkey", E.retry_error(F.expr(_ERROR)).alias("again"), E.backoff(n, 0.5, 10.0).alias("wait"), E.backoff(n, 0.5, 10.0, F.lit(0.5)).alias("wait_jittered"))


_VALUE = "case c_custkey % 5 when 0 then 'eyJ' || md5(c_name) when 1 then md5(c_name) || md5(c_name) when 2 then md5(c_name) when 3 then repeat('? ', 30) else c_name end"


@query("endpoint_values", f"with t as (select c_custkey, {_VALUE} as v from customer) select c_custkey, c_custkey % 5 in (0, 1) as is_token, c_custkey % 3 <> 2 as dangerous, c_custkey % 4 = 0 as is_event, case c_custkey % 4 when 0 then 'js' when 1 then 'css' when 2 then 'font' else 'unknown' end as asset_type from t")
def _(spark, d):
    k = C("c_custkey")
    kind = F.element_at(F.array(*map(F.lit, ("AWS", "token", "other"))), (k % 3 + 1).cast("int"))
    attr = F.element_at(F.array(*map(F.lit, ("onClick", "class", "data-on", "one"))), (k % 4 + 1).cast("int"))
    load = F.element_at(F.array(*map(F.lit, ("Script", "style", "font", "x"))), (k % 4 + 1).cast("int"))
    return files.table(spark, d, "customer").select("c_custkey", E.is_token(F.expr(_VALUE)).alias("is_token"), E.is_dangerous(kind).alias("dangerous"), E.is_event_attribute(attr).alias("is_event"), js.asset_type(load).alias("asset_type"))


# Scope rules and robots


_ENTRIES = "select 'e' || c_custkey as id, 'w' || (c_custkey % 3) as workspace_id, case c_custkey % 2 when 0 then 'domain' else 'exclude' end as entry_type, case c_custkey % 2 when 0 then 'd' || c_custkey || '.test' else '/x' || c_custkey end as pattern from customer"


def _entries(spark, d):
    return _sql(spark, d, _ENTRIES, "customer").withColumn("created_at", F.timestamp_seconds(F.lit(0)))


def _sql(spark, d, sql: str, table: str) -> DataFrame:
    """A selection that reads the same in both dialects."""
    return spark.sql(sql.replace(f"from {table}", "from {t}"), t=files.table(spark, d, table))


@query("scope_changes", f"with e as ({_ENTRIES}) select workspace_id, entry_type, pattern from e where id <> 'e7' and not (workspace_id = 'w1' and entry_type = 'exclude') union all select 'w2', 'domain', 'new.test'")
def _(spark, d):
    e = scope.add_rule(scope.remove_rule(_entries(spark, d), "e7"), "w2", "subdomain", "*.new.test")
    return scope.clear_rules(e, "w1", "exclude").select("workspace_id", "entry_type", "pattern")


@query("scope_cleared", f"with e as ({_ENTRIES}) select workspace_id, count(*) as n from e where workspace_id <> 'w0' group by 1")
def _(spark, d):
    return scope.clear_rules(_entries(spark, d), "w0").groupBy("workspace_id").agg(F.count("*").alias("n"))


@query("scope_loaded", f"with e as ({_ENTRIES}), u as (select c_custkey, 'https://d' || c_custkey || '.test/x' || (c_custkey % 9) as url from customer) select c_custkey, c_custkey % 6 = 4 and (not exists (select 1 from e where workspace_id = 'w1' and entry_type = 'exclude' and starts_with('/x' || (c_custkey % 9), pattern))) as in_scope from u")
def _(spark, d):
    u = F.concat(F.lit("https://d"), _text("c_custkey"), F.lit(".test/x"), (C("c_custkey") % 9).cast("string"))
    pages = files.table(spark, d, "customer").select("c_custkey", u.alias("url"))
    return scope.contained(pages, _entries(spark, d), "w1").select("c_custkey", "in_scope")


@query("scope_config", "select 'w' || n_nationkey as workspace_id, case when n_nationkey = 3 then 2.5 else 10.0 + n_regionkey end as rate, cast(case when n_nationkey = 3 then 7 else 5 end as int) as burst, case when n_nationkey = 3 then 'bearer' end as auth_type, case when n_nationkey = 3 then 'v' end as header, n_nationkey <> 3 as respect_robots from nation union all select 'new', 1.0, 5, null, null, true")
def _(spark, d):
    n = files.table(spark, d, "nation")
    config = n.select(F.concat(F.lit("w"), _text("n_nationkey")).alias("workspace_id"), (F.lit(10.0) + C("n_regionkey")).alias("rate_limit_rps"), F.lit(5).alias("rate_limit_burst"), F.lit(None).cast("string").alias("auth_type"), F.lit(None).cast("string").alias("auth_value"), F.lit(None).cast("map<string,string>").alias("custom_headers"), F.lit(True).alias("respect_robots"), F.lit(None).cast("timestamp").alias("updated_at"))
    for values in ({"rate_limit_rps": 2.5, "rate_limit_burst": 7}, {"auth_type": "bearer", "auth_value": "t"}, {"custom_headers": {"X-A": "v"}}, {"respect_robots": False}):
        config = scope.upsert_config(config, "w3", **values)
    config = scope.upsert_config(config, "new", rate_limit_rps=1.0)
    return config.select("workspace_id", C("rate_limit_rps").alias("rate"), C("rate_limit_burst").alias("burst"), "auth_type", C("custom_headers")["X-A"].alias("header"), "respect_robots")


@query("robots_rules", "select 's' || s_suppkey || '.test' as host, kind, case kind when 'disallow' then '/a' || (s_suppkey % 7) when 'allow' then '/a' || (s_suppkey % 7) || '/b' when 'crawl-delay' then '2' else 'https://s' || s_suppkey || '.test/m.xml' end as path, line from supplier, (values ('disallow', 3), ('allow', 4), ('crawl-delay', 5), ('sitemap', 8)) v(kind, line)")
def _(spark, d):
    body = "User-agent: other\nDisallow: /\nUser-agent: *\nDisallow: /a@M # none\nALLOW : /a@M/b\r\nCrawl-delay: 2\nDisallow:\nno rule\nSitemap: https://s@K.test/m.xml\n"
    s = files.table(spark, d, "supplier")
    return scope.robots_rules(s.select(F.concat(F.lit("s"), _text("s_suppkey"), F.lit(".test")).alias("host"), _filled(body, M=(C("s_suppkey") % 7).cast("string"), K=_text("s_suppkey")).alias("body")))


@query("sitemap_urls", "select 's' || s_suppkey || '.test' as base, 'https://s' || s_suppkey || '.test/' || case when s_suppkey % 2 = 0 then 'p' else 'q' end || i as loc from supplier, (values (1), (2)) v(i)")
def _(spark, d):
    s, k = files.table(spark, d, "supplier"), C("s_suppkey")
    base = F.concat(F.lit("s"), _text("s_suppkey"), F.lit(".test"))
    body = "<urlset><url><loc> https://s@K.test/@P1 </loc></url>\n<url><loc>https://s@K.test/@P2</loc><lastmod>x</lastmod></url><url><loc> </loc></url></urlset>"
    one = s.select(base.alias("base"), F.lit(1).alias("priority"), F.when(k % 2 == 0, _filled(body, P=F.lit("p"), K=_text("s_suppkey"))).otherwise("<html></html>").alias("body"))
    return scope.sitemap_urls(one.unionByName(s.select(base.alias("base"), F.lit(2).alias("priority"), _filled(body, P=F.lit("q"), K=_text("s_suppkey")).alias("body"))))


# Workspaces


_WS = "select 'w' || c_custkey as id, c_name as name, c_mktsegment as target, '/w' as root, 1 as version, 'idle' as status, 0 as scan_count from customer"
_WSH = "sha256(id || '|' || name || '|' || target || '|/w|1')"


def _workspaces(spark, d):
    t = F.lit(None).cast("timestamp")
    w = _sql(spark, d, _WS, "customer").withColumns({"created_at": F.timestamp_seconds(F.lit(0)), "modified_at": t, "last_scan_at": t})
    return w.withColumn("hash", F.when(F.substring("id", -1, 1) == "9", "bad").otherwise(workspace.content_hash()))


@query("workspace_changes", f"with w as ({_WS}) select id, name, case when id = 'w6' then 'running' else status end as status, case when id = 'w5' then 2 else 0 end as scan_count, case when id like '%9' then 'bad' else {_WSH} end as hash, id in ('w5', 'w6', 'w8') as changed from w where id <> 'w7'")
def _(spark, d):
    w = workspace.deleted(_workspaces(spark, d), "w7")
    w = workspace.scanned(workspace.scanned(w, "w5"), "w5")
    w = workspace.updated(workspace.with_status(w, "w6", "running"), "w8")
    return w.select("id", "name", "status", "scan_count", "hash", C("modified_at").isNotNull().alias("changed"))


@query("workspace_checked", f"with w as ({_WS}) select id, case when id like '%9' or id like '%4' then 'error' else 'idle' end as status from w")
def _(spark, d):
    w = _workspaces(spark, d)
    folders = w.select("id", F.explode(F.array(*map(F.lit, workspace.FOLDERS))).alias("folder")).where("not (id like '%4' and folder = 'logs')")
    return workspace.checked(w, folders).select("id", "status")


@query("workspace_new", "select 'n' as name, 't' as target, 'idle' as status, 0 as scan_count, 1 as version, true as hashed")
def _(spark, d):
    w = workspace.create(spark, "n", "t", "/w")
    return w.select("name", "target", "status", "scan_count", "version", (C("hash") == workspace.content_hash()).alias("hashed"))


@query("workspace_newest", f"with w as ({_WS}) select id, cast(row_number() over (order by c desc, id) as int) as pos from (select id, cast(substr(id, 2) as int) % 11 as c from w) order by pos limit 20")
def _(spark, d):
    w = _workspaces(spark, d).withColumn("created_at", F.timestamp_seconds(F.expr("cast(substring(id, 2) as int) % 11")))
    top = w.orderBy(F.desc("created_at"), "id").limit(20)
    from pyspark.sql import Window

    return top.select("id", F.row_number().over(Window.orderBy(F.desc("created_at"), "id")).alias("pos"))


@query("workspace_get", f"with w as ({_WS}) select id, name from w where id = 'w12'")
def _(spark, d):
    return workspace.get(_workspaces(spark, d), "w12").select("id", "name")


# OSV and manifests


_OSV = "osv as (select 'OSV-' || p_partkey as id, name, version, case when p_size % 2 = 0 then '1.0.' || p_size else '' end as fixed, cast(case p_size % 4 when 0 then 4 when 1 then 3 when 2 then 2 else 0 end as int) as severity from (select *, case p_partkey % 6 when 0 then 'lodash' when 1 then 'express' when 2 then 'axios' when 3 then 'next-auth' when 4 then 'minimatch' else 'left-pad' end as name, (p_partkey % 5) || '.' || p_size || '.' || (p_partkey % 25) as version from part) where p_partkey % 3 = 0)"


def _dump(spark, d):
    """An OSV dump made from parts: every third part's package has an entry."""
    p = files.table(spark, d, "part").where("p_partkey % 3 = 0").withColumn("fix", F.when(C("p_size") % 2 == 0, F.concat(F.lit("1.0."), _text("p_size"))).otherwise(""))
    dep = p.select(F.concat(F.lit("OSV-"), _text("p_partkey")).alias("id"), F.expr("case p_partkey % 6 when 0 then 'lodash' when 1 then 'express' when 2 then 'axios' when 3 then 'next-auth' when 4 then 'minimatch' else 'left-pad' end").alias("name"), F.expr("concat(p_partkey % 5, '.', p_size, '.', p_partkey % 25)").alias("version"), "fix", "p_size")
    return dep.select(F.lit("npm").alias("ecosystem"), "name", "version", "id", F.array(F.lit("A")).alias("aliases"), F.lit("s").alias("summary"), F.when(C("p_size") % 4 == 0, "CRITICAL").otherwise("unstated").alias("stated"), F.when(C("p_size") % 4 == 1, F.array(F.lit("7.5"))).when(C("p_size") % 4 == 2, F.array(F.lit("4.0"), F.lit("9.9"))).otherwise(F.array(F.lit("CVSS:3.1/AV:N"))).alias("scores"), F.array(F.lit("0.9"), C("fix"), F.lit("")).alias("fixes"))


@query("osv_lookup", f"with {_DEPS}, {_OSV} select o.id, o.name as affected_package, o.version as affected_version, o.severity, case when o.fixed = '' then '0.9' else o.fixed end as fixed_version from osv o join (select distinct name, version from dep) d on d.name = o.name and d.version = o.version")
def _(spark, d):
    return deps.osv(_deps(spark, d), _dump(spark, d)).select("id", "affected_package", "affected_version", "severity", "fixed_version")


@query("osv_merged", f"with {_HITS}, {_OSV}, o as (select distinct id, name as p, version as v, severity from osv) select id, affected_package, affected_version, 'advisory-db' as source from hits where severity >= 3 union all select id, p, v, 'osv' from o where severity >= 3")
def _(spark, d):
    return deps.vulnerabilities(_deps(spark, d), dims.advisories(spark), _dump(spark, d), min_severity=3).select("id", "affected_package", "affected_version", "source")


_FORMATS = {
    # name: (content; @N a name, @V a version), (name, version, ecosystem, source) of each package in SQL
    "package.json": ('{"dependencies": {"@N": "^@V"}, "devDependencies": {"dev-@N": "~@V"}}', ["n, v, 'npm', 'package.json'", "'dev-' || n, v, 'npm', 'package.json'"]),
    "go.mod": ("module m\n\ngo 1.22\n\nrequire g.test/@N v@V\n\nrequire (\n\tg.test/in-@N v@V+incompatible // indirect\n)\nreplace ./x => ./y\n", ["'g.test/' || n, 'v' || v, 'Go', ''", "'g.test/in-' || n, 'v' || v, 'Go', ''"]),
    "requirements.txt": ("# c\n@N==@V\nlow-@N >= @V ; x\nbare\n", ["n, v, 'PyPI', 'requirements.txt'", "'low-' || n, v, 'PyPI', 'requirements.txt'"]),
    "Gemfile": ('source "x"\ngem "@N", "~> @V"\ngem \'bare-@N\'\n', ["n, v, 'RubyGems', 'Gemfile'", "'bare-' || n, '', 'RubyGems', 'Gemfile'"]),
    "Gemfile.lock": ("GEM\n  specs:\n    @N (@V)\n      deep (>= 1)\n\nPLATFORMS\n    ruby (1)\n", ["n, v, 'RubyGems', 'Gemfile.lock'"]),
    "Cargo.toml": ('[package]\nname = "x"\nversion = "1.0.0"\n[dependencies]\n@N = "@V"\nin-@N = { version = "@V", features = ["f"] }\n[profile]\nz = "1"\n', ["n, v, 'crates.io', 'Cargo.toml'", "'in-' || n, v, 'crates.io', 'Cargo.toml'"]),
    "Cargo.lock": ('version = 3\n[[package]]\nname = "@N"\nversion = "@V"\n\n[[package]]\nname = "only"\n', ["n, v, 'crates.io', 'Cargo.lock'"]),
    "composer.json": ('{"require": {"php": ">=8", "a/@N": "^@V"}, "require-dev": {"b/@N": "@V"}}', ["'a/' || n, v, 'Packagist', 'composer.json'", "'b/' || n, v, 'Packagist', 'composer.json'"]),
    "composer.lock": ('{"packages": [{"name": "a/@N", "version": "v@V"}]}', ["'a/' || n, v, 'Packagist', 'composer.lock'"]),
    "pom.xml": ("<project><properties><p>@V</p></properties><dependencies><dependency><groupId>g</groupId><artifactId>@N</artifactId><version>${p}</version></dependency><dependency><groupId>t</groupId><artifactId>t</artifactId><version>1</version><scope>test</scope></dependency></dependencies></project>", ["'g:' || n, v, 'Maven', 'pom.xml'"]),
}


def _manifest(name: str, content: str):
    def run(spark, d):
        p = files.table(spark, d, "part")
        n, v = F.concat(F.lit("lib"), _text("p_partkey")), F.concat(_text("p_size"), F.lit("."), (C("p_partkey") % 25).cast("string"))
        rows = p.select(F.concat(F.lit("d"), _text("p_partkey"), F.lit("/" + name)).alias("path"), _filled(content, N=n, V=v).alias("content"))
        skipped = rows.select(F.concat(F.lit("node_modules/"), "path").alias("path"), "content")
        return deps.packages(rows.unionByName(skipped)).select("path", "name", "version", "ecosystem", "source")

    return run


for _name, (_content, _found) in _FORMATS.items():
    _rows = " union all ".join(f"select 'd' || k || '/{_name}' as path, {a} as name, {b} as version, {c} as ecosystem, {e} as source from p" for a, b, c, e in (x.split(", ") for x in _found))
    query("manifest_" + _name.lower().replace(".", "_"), f"with p as (select p_partkey as k, 'lib' || p_partkey as n, p_size || '.' || (p_partkey % 25) as v from part) {_rows}")(_manifest(_name, _content))


_LOCKS = ["package.json", "go.mod", "yarn.lock", "Gemfile", "Cargo.lock", "composer.lock", "pom.xml", "readme.md"]


@query("manifest_ecosystem", "select 'd' || p_partkey as dir, case p_partkey % 8 when 0 then 'npm' when 1 then 'Go' when 2 then 'npm' when 4 then 'crates.io' when 5 then 'Packagist' else 'PyPI' end as ecosystem, case p_partkey % 8 when 0 then 'package.json' when 1 then 'go.mod' when 2 then 'yarn.lock' when 4 then 'Cargo.lock' when 5 then 'composer.lock' else 'requirements.txt' end as file from part")
def _(spark, d):
    p = files.table(spark, d, "part")
    name = F.element_at(F.array(*map(F.lit, _LOCKS)), (C("p_partkey") % 8 + 1).cast("int"))
    at = F.concat(F.lit("d"), _text("p_partkey"), F.lit("/"))
    rows = p.select(F.concat(at, name).alias("path")).union(p.select(F.concat(at, F.lit("requirements.txt"))))
    return deps.ecosystem(rows.withColumn("content", F.lit("")))


# Frameworks


@query("framework_signals", "select 'p' || p_partkey as project, framework, description, file, weight from part, (values ('react', 'dependency: react@^18', 'package.json', 0.5), ('vite', 'dependency: vite@5', 'package.json', 0.35), ('vite', 'Vite config', 'vite.config.ts', 0.5), ('react', 'JSX file', 'src/a.jsx', 0.2), ('react', 'import from react', 'src/a.jsx', 0.3), ('react', 'React hook usage', 'src/a.jsx', 0.25), ('vite', 'import.meta.env', 'src/a.jsx', 0.25)) v(framework, description, file, weight) where p_partkey % 3 > 0 or weight in (0.2, 0.25) or file = 'vite.config.ts' or description = 'import from react'")
def _(spark, d):
    return frameworks.signals(_project_files(spark, d)).withColumn("weight", C("weight").cast("decimal(3,2)"))


def _project_files(spark, d):
    """Files of a project for each part; every third has no package.json."""
    rows = [("package.json", '{"dependencies": {"react": "^18", "own": "1"}, "devDependencies": {"vite": "5"}}', 0), ("vite.config.ts", "export default {}", 1), ("src/a.jsx", "import React from 'react'; useState(import.meta.env)", 2), ("src/b.jsx", "", 3), ("notes.txt", "from 'vue'", 4)]
    f = spark.createDataFrame(rows, "path string, content string, ord int")
    p = files.table(spark, d, "part").select(C("p_partkey").alias("k"), F.concat(F.lit("p"), _text("p_partkey")).alias("project"))
    return p.join(F.broadcast(f)).where("k % 3 > 0 or path <> 'package.json'").select("project", "path", "content", "ord")


@query("framework_detected", "select 'p' || p_partkey as project, framework, cast(case when framework = 'react' then case when p_partkey % 3 > 0 then 1.0 else 0.75 end else case when p_partkey % 3 > 0 then 1.0 else 0.75 end end as decimal(3,2)) as confidence from part, (values ('react'), ('vite')) v(framework)")
def _(spark, d):
    return frameworks.detect(_project_files(spark, d)).select("project", "framework", C("confidence").cast("decimal(3,2)").alias("confidence"))


# Pages


_FORM = '<html><head><meta name="n@K" content="v@K"><link rel="stylesheet" href="/s@K.css"></head><body><form action="/go@K" method="POST" id="f"><input name="a@K" type="text" value="1"><select name="b"></select><textarea name="c"></textarea></form><form><input name="z"></form><img src="/i@K.png"><script src="/m@K.js"></script></body></html>'


def _form_pages(spark, d):
    n = files.table(spark, d, "supplier")
    return html.parse(n.select(F.concat(F.lit("https://s"), _text("s_suppkey"), F.lit(".test/")).alias("url"), _filled(_FORM, K=_text("s_suppkey")).alias("body")))


@query("page_assets", "select 'https://s' || s_suppkey || '.test/' as page, 'https://s' || s_suppkey || '.test' || case type when 'css' then '/s' || s_suppkey || '.css' when 'image' then '/i' || s_suppkey || '.png' else '/m' || s_suppkey || '.js' end as url, type from supplier, (values ('css'), ('image'), ('js')) v(type)")
def _(spark, d):
    return html.assets(_form_pages(spark, d)).select("page", "url", "type")


@query("page_forms", "select 'https://s' || s_suppkey || '.test/' as url, case i when 1 then '/go' || s_suppkey else '' end as action, case i when 1 then 'POST' else 'GET' end as method, 1 as n_inputs, case i when 1 then 'a' || s_suppkey else 'z' end as first_input from supplier, (values (1), (2)) v(i)")
def _(spark, d):
    return _form_pages(spark, d).select("url", F.explode("forms").alias("f")).select("url", "f.action", "f.method", F.size("f.inputs").alias("n_inputs"), C("f.inputs")[0]["name"].alias("first_input"))


@query("page_metadata", "select 'https://s' || s_suppkey || '.test/' as url, 'n' || s_suppkey as name, 'v' || s_suppkey as content from supplier")
def _(spark, d):
    return _form_pages(spark, d).select("url", F.explode("metadata").alias("name", "content"))


_JS = "import('./c@K.js'); const a = new URL('./i@K.png', import.meta.url); import.meta.glob('./g@K/*.js');\n__webpack_public_path__ = \"/p@K/\"; x(\"chunk-ab@K\"); var u = 'https://cdn.test/@K.js';\n//# sourceMappingURL=m@K.map\n/*# sourceMappingURL=data:application/json;base64,e@K */\n"


@query("js_assets", "select n_nationkey as k, kind, case kind when 'dynamic' then './c' || n_nationkey || '.js' when 'webpack' then case i when 0 then '/p' || n_nationkey || '/' else 'ab' || n_nationkey end when 'vite' then case i when 0 then './i' || n_nationkey || '.png' else './g' || n_nationkey || '/*.js' end else case i when 0 then 'm' || n_nationkey || '.map' else 'data:application/json;base64,e' || n_nationkey end end as value, case when kind = 'map' and i = 1 then 'e' || n_nationkey else '' end as data from nation, (values ('dynamic', 0), ('webpack', 0), ('webpack', 1), ('vite', 0), ('vite', 1), ('map', 0), ('map', 1)) v(kind, i)")
def _(spark, d):
    s = files.table(spark, d, "nation").select(C("n_nationkey").alias("k"), js.scan(_filled(_JS, K=_text("n_nationkey"))).alias("s"))
    plain = lambda kind, c: s.select("k", F.lit(kind).alias("kind"), F.explode(c).alias("value"), F.lit("").alias("data"))
    maps = s.select("k", F.lit("map").alias("kind"), F.explode("s.source_maps").alias("m")).select("k", "kind", C("m.url").alias("value"), C("m.inline_data").alias("data"))
    return plain("dynamic", "s.dynamic_imports").union(plain("webpack", "s.webpack_chunks")).union(plain("vite", "s.vite_assets")).union(maps)


_QUOTED = "list_concat(list_concat(list_filter(string_split(t, '\"'), lambda x, i: i % 2 = 0), list_filter(string_split(t, chr(39)), lambda x, i: i % 2 = 0)), list_filter(string_split(t, '`'), lambda x, i: i % 2 = 0))"


@query("js_scan", f"with s as (select url as file, unnest(regexp_extract_all(html, '(?s)<script>(.*?)</script>', 1)) as t from pages) select file, cast(len(list_distinct(list_filter({_QUOTED}, lambda u: strlen(u) >= 4 and (regexp_matches(u, '^https?://') or u like '//%' or (u like '/%' and contains(u, '.') and not contains(u, ' ')) or (contains(u, '.') and contains(u, '/') and not contains(u, ' ')))))) as int) as n_urls from s")
def _(spark, d):
    p = html.parse(files.table(spark, d, "pages").select("url", C("html").alias("body")))
    s = p.select(C("url").alias("file"), F.explode("inline_scripts").alias("text")).select("file", js.scan(C("text")).alias("s"))
    return s.select("file", F.size("s.script_urls").alias("n_urls"))


@query("js_script_urls", "with s as (select page_id, unnest(regexp_extract_all(html, '(?s)<script>(.*?)</script>', 1)) as t from pages), q as (select page_id, unnest(list_filter(string_split(t, '\"'), lambda x, i: i % 2 = 0)) as u from s union all select page_id, unnest(list_filter(string_split(t, ''''), lambda x, i: i % 2 = 0)) from s union all select page_id, unnest(list_filter(string_split(t, '`'), lambda x, i: i % 2 = 0)) from s) select distinct page_id, u as url from q where strlen(u) >= 4 and (regexp_matches(u, '^https?://') or u like '//%' or (u like '/%' and contains(u, '.') and not contains(u, ' ')) or (contains(u, '.') and contains(u, '/') and not contains(u, ' ')))")
def _(spark, d):
    p = files.table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"(?s)<script>(.*?)</script>"), 1)).alias("t"))
    return p.select("page_id", F.explode(js.script_urls(C("t"))).alias("url")).distinct()


# Scripts as trees


_MODULE = "import { f@J } from './m@J.js';\nimport d from 'lib';\nexport function f@K(a) { f@J(); h(a); }\nfunction h(p) { let q = p; return q; }\nh(1);\nconst s = `plain@K`;\nconst t = tag`a${s}b`;\n"
_M = "m as (select 'm' || n_nationkey || '.js' as file, 'f' || n_nationkey as own, 'f' || ((n_nationkey + 1) % 25) as other, './m' || ((n_nationkey + 1) % 25) || '.js' as source, n_nationkey as k from nation)"


def _modules(spark, d):
    k = C("n_nationkey")
    return files.table(spark, d, "nation").select(F.concat(F.lit("m"), k.cast("string"), F.lit(".js")).alias("file"), _filled(_MODULE, K=k.cast("string"), J=((k + 1) % 25).cast("string")).alias("text"))


def _tree(spark, d):
    return js_relations.tree(_modules(spark, d))


@query("js_module_imports", f"with {_M} select file, source, other as imported, other as local, false as is_default from m union all select file, 'lib', 'default', 'd', true from m")
def _(spark, d):
    return js_relations.imports(_tree(spark, d)).select("file", "source", "imported", "local", "is_default")


@query("js_local_import", f"with {_M} select file, 'lib' as source from m")
def _(spark, d):
    return js_relations.local(js_relations.imports(_tree(spark, d)), "d").select("file", "source")


@query("js_exports", f"with {_M} select file, own as exported, own as local, '' as source, 'declaration' as kind from m")
def _(spark, d):
    return js_relations.exports(_tree(spark, d))


@query("js_calls", f"with {_M} select file, own as caller, 'h' as callee from m union all select file, '(global)', 'h' from m")
def _(spark, d):
    return js_relations.call_edges(_tree(spark, d))


@query("js_callers", f"with {_M} select file, own as caller from m union all select file, '(global)' from m")
def _(spark, d):
    return js_relations.callers(js_relations.call_edges(_tree(spark, d)), "h")


@query("js_callees", f"with {_M} select file, 'h' as callee from m where own = 'f3'")
def _(spark, d):
    return js_relations.callees(js_relations.call_edges(_tree(spark, d)), "f3")


@query("js_depgraph", f"with {_M} select file, '(entry)' as source, source as target from m union all select file, '(entry)', 'lib' from m")
def _(spark, d):
    return js_relations.dep_edges(_tree(spark, d))


@query("js_dep_nodes", f"with {_M} select file, unnest(['(entry)', 'lib', source]) as node from m")
def _(spark, d):
    return js_relations.dep_nodes(js_relations.dep_edges(_tree(spark, d)))


@query("js_reverse_deps", f"with {_M} select file, '(entry)' as source from m where source = './m4.js'")
def _(spark, d):
    return js_relations.reverse_deps(js_relations.dep_edges(_tree(spark, d)), "./m4.js")


@query("js_templates", f"with {_M} select file, '' as tag, 0 as n_expressions, true as is_static, 'plain' || k as text from m union all select file, 'tag', 1, false, 'ab' from m")
def _(spark, d):
    return js_relations.templates(_tree(spark, d)).select("file", "tag", C("n_expressions").cast("int").alias("n_expressions"), "is_static", "text")


@query("js_symbols", f"with {_M} select file, own as name, 'function' as kind from m union all select file, other, 'import' from m union all select file, unnest(['d', 'h', 's', 't', 'a', 'p', 'q']), unnest(['import', 'function', 'variable', 'variable', 'parameter', 'parameter', 'variable']) from m")
def _(spark, d):
    return js_relations.symbols(_tree(spark, d)).select("file", "name", "kind")


@query("js_resolved", f"with {_M} select file, 'parameter' as kind from m")
def _(spark, d):
    return js_relations.resolve(_tree(spark, d), "a").select("file", "kind")


@query("js_token_texts", "select 't' || n_nationkey as file, n - 1 as n, text from (select n_nationkey, unnest(['let', 'x' || n_nationkey, '=', cast(n_nationkey as varchar), '+', '31', ';']) as text, unnest([1, 2, 3, 4, 5, 6, 7]) as n from nation)")
def _(spark, d):
    k = _text("n_nationkey")
    s = files.table(spark, d, "nation").select(F.concat(F.lit("t"), k).alias("file"), F.concat(F.lit("let x"), k, F.lit(" = "), k, F.lit(" /* c */ + 0x1F; // end")).alias("text"))
    return js_relations.tokens(s).where("text <> ''").select("file", "n", "text")


# Authentication over visits made from the customers


def _b64(x: str) -> str:
    import base64

    return base64.urlsafe_b64encode(x.encode()).decode().rstrip("=")


_HEAD = _b64('{"alg":"RS256","typ":"JWT"}')
_BODY = '{"sub":"user@K","iss":"https://issuer.example","exp":1900000000,"scope":"openid mail"}'
_V = "v as (select c_custkey as k, 'https://app' || c_custkey || '.test' as page, 'app' || c_custkey || '.test' as host, 'https://id.test/oauth/authorize?response_type=code&client_id=c' || c_custkey || '&redirect_uri=https%3A%2F%2Fapp' || c_custkey || '.test%2Fcb&scope=openid+mail' || case when c_custkey % 2 = 0 then '&code_challenge=x' else '' end as oauth, 'https://id.test/token/refresh?grant_type=refresh_token&u=' || c_custkey as refresh, case when c_custkey % 3 = 0 then 401 else 200 end as code from customer)"


def _visits(spark, d):
    n = C("c_custkey")
    k, lit = _text("c_custkey"), F.lit
    join = lambda *parts: F.concat(*[lit(x) if isinstance(x, str) else x for x in parts])
    body = F.regexp_replace(F.translate(F.regexp_replace(F.base64(_filled(_BODY, K=k).cast("binary")), "[\r\n]", ""), "+/", "-_"), "=+$", "")
    token, host = join(_HEAD + ".", body, ".c2lnbmF0dXJl"), join("app", k, ".test")
    page = join("https://", host)
    oauth = join("https://id.test/oauth/authorize?response_type=code&client_id=c", k, "&redirect_uri=https%3A%2F%2F", host, "%2Fcb&scope=openid+mail", F.when(n % 2 == 0, "&code_challenge=x").otherwise(""))
    record = lambda **cols: F.struct(*[(lit(v) if isinstance(v, (str, int, bool)) else v).alias(c) for c, v in cols.items()])
    none = F.create_map().cast("map<string,string>")
    headers = F.create_map(lit("Authorization"), F.when(n % 4 == 0, "none").otherwise(join("Bearer ", token)))
    calls = ((join(page, "/login"), "POST", 200, none), ("https://api.test/me", "GET", 200, headers), (oauth, "GET", 302, none), (join("https://id.test/token/refresh?grant_type=refresh_token&u=", k), "POST", F.when(n % 3 == 0, 401).otherwise(200), none), (join(page, "/logout"), "GET", 200, none))
    parts = {
        "url": page,
        "requests": F.array(*[record(url=u, method=m, resource_type="fetch", status_code=c, headers=h) for u, m, c, h in calls]),
        "web_sockets": F.array(record(url=join("wss://", host, "/ws"))),
        "event_sources": F.array(record(url=join(page, "/sse"))),
        "cookies": F.array(*[record(name=name, value=v, domain=host, path="/", secure=s, http_only=not s) for name, v, s in (("sessionid", "abc", True), ("theme", "dark", False), ("my_refresh_token", "z" * 50, False))]),
        "local_storage": F.array(record(key="id_token", value=token), record(key="note", value="x" * 30)),
        "session_storage": F.array(record(key="opaque", value="A1" * 25)),
        "indexed_db": F.array(record(database="db", version=2, stores=F.array(record(name="auth", records=F.array(lit("token=" + "Z9" * 24), lit("plain")))))),
        "service_workers": F.array(record(url=join(page, "/sw.js"), scope="/", active=True)),
    }
    types = {f.name: f.dataType for f in StructType.fromDDL(schemas.RUNTIME)}
    return files.spread(files.table(spark, d, "customer").select("c_custkey")).select(*[v.cast(types[c]).alias(c) for c, v in parts.items()])


@query("auth_jwts", f"with {_V} select page, case when k % 4 = 0 then 'storage' else 'header' end as source, case when k % 4 = 0 then 'localStorage/id_token' else 'Authorization' end as location, 'RS256' as algorithm, 'access' as token_type, 'user' || k as subject, 'https://issuer.example' as issuer from v")
def _(spark, d):
    return A.jwts(_visits(spark, d)).select("page", "source", "location", "algorithm", "token_type", "subject", "issuer")


@query("auth_cookie_types", f"with {_V} select page, name, host as domain, token_type, suspicious from v, (values ('sessionid', 'session', false), ('theme', 'unknown', false), ('my_refresh_token', 'refresh', true)) c(name, token_type, suspicious)")
def _(spark, d):
    return A.auth_cookies(_visits(spark, d)).select("page", "name", "domain", "token_type", "suspicious")


@query("storage_tokens", f"with {_V} select page, source, key, token_type from v, (values ('localStorage', 'id_token', 'id'), ('sessionStorage', 'opaque', 'unknown'), ('indexedDB:db', 'auth', 'unknown')) c(source, key, token_type)")
def _(spark, d):
    return A.storage_tokens(_visits(spark, d)).select("page", "source", "key", "token_type")


@query("auth_endpoint_types", f"with {_V} select page, page || '/login' as url, 'POST' as method, 'login' as endpoint_type, 'url_path' as signal from v union all select page, oauth, 'GET', 'authorize', 'oauth_url_pattern' from v union all select page, refresh, 'POST', 'token', 'oauth_url_pattern' from v union all select page, refresh, 'POST', 'refresh', 'url_path' from v union all select page, page || '/logout', 'GET', 'logout', 'url_path' from v")
def _(spark, d):
    return A.auth_endpoints(A.requests_of(_visits(spark, d))).select("page", "url", "method", "endpoint_type", "signal")


@query("oauth_flows", f"with {_V} select page, 'authorization_code' as type, oauth as auth_endpoint, page || '/cb' as redirect_uri, 'c' || k as client_id, 'openid mail' as scopes, k % 2 = 0 as pkce, true as oidc from v union all select page, 'refresh', '', '', '', '', false, false from v")
def _(spark, d):
    return A.oauth_flows(A.requests_of(_visits(spark, d))).select("page", "type", "auth_endpoint", "redirect_uri", "client_id", F.array_join("scopes", " ").alias("scopes"), "pkce", "oidc")


_STEPS = "select page, name, cast(s.order as int) as pos, s.action, s.url, s.method, s.detail"


def _steps(flows: DataFrame) -> DataFrame:
    return flows.select("page", "name", F.explode("steps").alias("s")).select("page", "name", C("s.order").alias("pos"), "s.action", "s.url", "s.method", "s.detail")


_REFRESH = "select page, 'token_refresh' as name, 1 as pos, 'request' as action, refresh as url, 'POST' as method, 'refresh token request' as detail from v union all select page, 'token_refresh', 2, 'request', '', '', 'grant_type: refresh_token' from v union all select page, 'token_refresh', 3, 'response', case when code < 400 then refresh else '' end, '', 'status: ' || code || case when code < 400 then ' — new tokens issued' else ' — refresh failed/expired' end from v"


@query("refresh_flows", f"with {_V} {_REFRESH}")
def _(spark, d):
    return _steps(A.refresh_flows(A.requests_of(_visits(spark, d))))


@query("auth_flows", f"with {_V} {_REFRESH} union all select page, 'login', 1, 'request', page || '/login', 'POST', 'login request' from v union all select page, 'login', 2, 'response', '', '', 'authentication response (cookies/tokens issued)' from v union all select page, 'logout', 1, 'request', page || '/logout', 'GET', 'logout request' from v union all select page, 'logout', 2, 'response', '', '', 'session invalidated, cookies cleared' from v union all select page, 'logout', 3, 'response', '', '', 'auth cookies should be cleared client-side' from v union all select page, 'oauth_authorization_code', 1, 'request', oauth, '', 'authorization request to authorization_code flow' from v union all select page, 'oauth_authorization_code', 2, 'redirect', page || '/cb', '', 'user redirected back to app' from v union all select page, 'oauth_authorization_code', 3, 'script', '', '', 'PKCE code_challenge/code_verifier generated' from v where k % 2 = 0")
def _(spark, d):
    return _steps(A.flows(_visits(spark, d)))


_TEXTS = f"{_V}, texts as (select distinct doc_id, text from (select 'header:https://api.test/me' as doc_id, 'Authorization: none' as text from v where k % 4 = 0 union all select 'url', page || '/login' from v union all select 'url', 'https://api.test/me' from v union all select 'url', oauth from v union all select 'url', refresh from v union all select 'url', page || '/logout' from v union all select 'cookie:' || host, 'sessionid=abc' from v union all select 'cookie:' || host, 'theme=dark' from v union all select 'cookie:' || host, 'my_refresh_token=' || repeat('z', 50) from v union all select 'localStorage', 'note=' || repeat('x', 30) from v union all select 'sessionStorage', 'opaque=' || repeat('A1', 25) from v union all select 'indexedDB:db', 'token=' || repeat('Z9', 24) from v union all select 'indexedDB:db', 'plain' from v union all select 'websocket', 'wss://' || host || '/ws' from v))"


@query("secret_runtime", "with " + _TEXTS + ", " + _secret_sql("select doc_id as source, secret_type, key, match").removeprefix("with ").replace("from documents", "from texts"))
def _(spark, d):
    found = secrets.scan_runtime(_visits(spark, d))
    # the visits' tokens are left to auth_jwts: their text is no easy literal in SQL
    return found.where("match not like '%eyJ%'").select("source", "secret_type", "key", "match")


@query("score_auth", f"with {_V}, i as (select 'auth:' || t || ':' || u as id, s as score from (select 'login' as t, page || '/login' as u, 1.5 as s from v union all select 'authorize', oauth, 2.5 from v union all select 'token', refresh, 1.5 from v union all select 'refresh', refresh, 1.5 from v union all select 'logout', page || '/logout', 2.5 from v) union all select 'oauth:authorization_code:' || oauth, 2.5 from v union all select 'oauth:refresh:', 1.0 from v union all select 'jwt:{_HEAD[:20]}', 2.0 from v union all select 'cookie:' || n || '@' || host, 1.5 from v, (values ('sessionid'), ('theme'), ('my_refresh_token')) c(n)) select id, cast(score as double) as score, count(*) as n from i group by 1, 2")
def _(spark, d):
    v = _visits(spark, d)
    req = A.requests_of(v)
    items = scoring.of_endpoints(A.auth_endpoints(req)).unionByName(scoring.of_flows(A.oauth_flows(req))).unionByName(scoring.of_jwts(A.jwts(v))).unionByName(scoring.of_cookies(A.auth_cookies(v)))
    return scoring.score(items).groupBy("id", "score").agg(F.count("*").alias("n"))


@query("score_runtime", f"with {_V}, r as (select m || ' ' || u as label, 1.0 * s as score from (select page || '/login' as u, 'POST' as m, 1.3 as s from v union all select 'https://api.test/me', 'GET', 0.5 from v union all select oauth, 'GET', 2.0 from v union all select refresh, 'POST', 1.5 from v union all select page || '/logout', 'GET', 2.0 from v union all select 'wss://' || host || '/ws', 'WS', 0.5 from v)) select label, cast(score as double) as score, count(*) as n from r group by 1, 2")
def _(spark, d):
    v = _visits(spark, d)
    items = scoring.of_requests(A.requests_of(v)).unionByName(scoring.of_sockets(v.selectExpr("inline(web_sockets)")))
    return scoring.score(items).groupBy("label", "score").agg(F.count("*").alias("n"))


# Graphs


_RUNTIME_NODES = f"{_V}, n as (select 'page::' || page as id, 'page' as type from v union all select 'api::' || m || '::' || u, 'api_endpoint' from (select page || '/login' as u, 'POST' as m from v union all select 'https://api.test/me', 'GET' from v union all select oauth, 'GET' from v union all select refresh, 'POST' from v union all select page || '/logout', 'GET' from v union all select 'wss://' || host || '/ws', 'WS' from v union all select page || '/sse', 'GET' from v) union all select 'cookie::' || c || '::' || host, 'cookie' from v, (values ('sessionid'), ('theme'), ('my_refresh_token')) x(c) union all select 'storage::' || s || '::' || y || '::' || page, 'storage' from v, (values ('localStorage', 'id_token'), ('localStorage', 'note'), ('sessionStorage', 'opaque')) x(s, y) union all select 'storage::indexeddb::db::' || page, 'storage' from v union all select 'sw::' || page || '/sw.js', 'service_worker' from v)"


@query("graph_runtime", f"with {_RUNTIME_NODES} select distinct id, type from n")
def _(spark, d):
    return graph.Graph().add_runtime(_visits(spark, d)).nodes.select("id", "type")


@query("graph_runtime_edges", f"with {_V} select page as url, type, n * 1 as n from (select page, unnest(['calls', 'stores', 'serves']) as type, unnest([7, 7, 1]) as n from v)")
def _(spark, d):
    e = graph.Graph().add_runtime(_visits(spark, d)).edges
    return e.groupBy(F.regexp_replace("source", "^page::", "").alias("url"), "type").agg(F.count("*").cast("int").alias("n"))


@query("graph_dependencies", f"with {_HITS}, p as (select distinct name, version from dep where version <> '') select 'dep::npm::' || name as source, 'vuln::' || id as target, count(*) as n from (select d.name, h.id from dep d join hits h on h.affected_package = d.name where d.version <> '') group by 1, 2")
def _(spark, d):
    g = graph.Graph().add_dependencies(_deps(spark, d), _vulns(spark, d))
    return g.edge_counts.groupBy("source", "target").agg(F.sum("n").alias("n"))


@query("graph_dependency_nodes", f"with {_HITS} select distinct 'dep::npm::' || name as id, 'dependency' as type from dep union all select distinct 'vuln::' || id, 'vulnerability' from hits")
def _(spark, d):
    return graph.Graph().add_dependencies(_deps(spark, d), _vulns(spark, d)).nodes.select("id", "type")


@query("graph_frameworks", "select 'framework::' || framework as id, 'framework' as type from (values ('react'), ('vite')) v(framework) union all select 'page::https://x.test', 'page'")
def _(spark, d):
    found = frameworks.detect(_project_files(spark, d).where("project = 'p1'"))
    return graph.Graph().add_frameworks(found, "https://x.test").nodes.select("id", "type")


@query("graph_auth", f"with {_V}, n as (select 'auth_endpoint::' || t || '::' || u as id, 'auth_endpoint' as type from (select 'login' as t, page || '/login' as u from v union all select 'authorize', oauth from v union all select 'token', refresh from v union all select 'refresh', refresh from v union all select 'logout', page || '/logout' from v) union all select 'auth_flow::authorization_code::' || oauth, 'auth_flow' from v union all select 'auth_flow::refresh::', 'auth_flow' from v union all select 'cookie::' || c || '::' || host, 'cookie' from v, (values ('sessionid'), ('theme'), ('my_refresh_token')) x(c) union all select 'storage::' || s || '::' || y, 'storage' from v, (values ('localStorage', 'id_token'), ('sessionStorage', 'opaque'), ('indexedDB:db', 'auth')) x(s, y)) select distinct id, type from n")
def _(spark, d):
    v = _visits(spark, d)
    req = A.requests_of(v)
    g = graph.Graph().add_auth(A.auth_endpoints(req), A.oauth_flows(req), A.jwts(v), A.auth_cookies(v), A.storage_tokens(v))
    return g.nodes.where("type not in ('page', 'api_endpoint', 'finding')").select("id", "type")


@query("graph_by_type", f"with {_REQUESTS} select distinct 'page::' || page as id from req")
def _(spark, d):
    return graph.by_type(_request_graph(spark, d).nodes, "page").select("id")


@query("graph_node", f"with {_G} select id, label from nodes where id = (select min(id) from nodes)")
def _(spark, d):
    n = _link_graph(spark, d).nodes
    return graph.get(n, n.agg(F.min("id")).first()[0]).select("id", "label")


@query("graph_colours", f"with {_REQUESTS} select distinct type, colour from (select 'page' as type, '#4A90D9' as colour from req union all select 'api_endpoint', '#50C878' from req) union all select 'other', '#7F8C8D'")
def _(spark, d):
    n = _request_graph(spark, d).nodes.select("type").distinct().union(spark.createDataFrame([("other",)], "type string"))
    return n.select("type", graph.colour(C("type")).alias("colour"))


@query("graph_document", "select cast(25 as bigint) as nodes, cast(50 as bigint) as edges")
def _(spark, d):
    n = files.table(spark, d, "nation")
    node = lambda c: F.concat(F.lit("n"), c.cast("string"))
    k = C("n_nationkey")
    e = n.select(node(k).alias("source"), node((k * 3 + 1) % 25).alias("target")).union(n.select(node(k), node((k + 7) % 25)))
    e = e.select(F.concat("source", F.lit("->"), "target").alias("id"), F.lit("t").alias("type"), "source", "target", F.lit("l").alias("label"))
    doc = graph.document(n.select(node(k).alias("id"), F.lit("page").alias("type"), C("n_name").alias("label")), e)
    parsed = F.from_json("json", "nodes array<struct<id:string>>, edges array<struct<id:string>>")
    return doc.select(F.size(parsed["nodes"]).cast("long").alias("nodes"), F.size(parsed["edges"]).cast("long").alias("edges"))


# Reports


@query("report_graph", f"with {_REQUESTS}, n as (select distinct 'page' as type, 'page::' || page as id, page as label from req union select distinct 'api_endpoint', 'api::' || method || '::' || url, method || ' ' || url from req), e as (select 'page::' || page as s, 'api::' || method || '::' || url as t from req), g as (select s as id, count(distinct t) as c from e group by 1 union all select t, count(distinct s) from e group by 1) select 1 as part, n.id as key, '[' || type || '] ' || label || ' (' || coalesce(c, 0) || ' connections)' as line from n left join g on g.id = n.id union all select 0, 'node:', 'nodes ' || count(*) from n union all select 0, 'node:' || type, '  ' || type || ' ' || count(*) from n group by type union all select 0, 'edge:', 'edges ' || count(*) from e union all select 0, 'edge:calls', '  calls ' || count(*) from e")
def _(spark, d):
    g = _request_graph(spark, d)
    return sinks.graph_text(g.nodes, g.edges)


@query("report_deps", f"with {_HITS} select 0 as part, ecosystem as key, ecosystem || ' (' || count(*) || ')' as line from dep group by ecosystem union all select 0, ecosystem || '/' || name || '/' || version, '  ' || name || ' @ ' || version from dep union all select 1, id, '[' || ['UNKNOWN', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][1 + severity] || '] ' || id || ': ' || affected_package || ' ' || affected_version || ' (fixed in ' || fixed_version || ')' from hits")
def _(spark, d):
    return sinks.deps_text(_deps(spark, d), _vulns(spark, d))


@query("report_auth", f"with {_V} select 3 as part, name as key, 'cookie ' || name || ' @ ' || host || ' (' || t || ')' as line from v, (values ('sessionid', 'session'), ('theme', 'unknown'), ('my_refresh_token', 'refresh')) c(name, t) union all select 1, 'authorization_code', 'OAuth authorization_code pkce=' || (k % 2 = 0) || ' oidc=true' from v union all select 1, 'refresh', 'OAuth refresh pkce=false oidc=false' from v union all select 0, u, '[' || t || '] ' || m || ' ' || u from (select page || '/login' as u, 'login' as t, 'POST' as m from v union all select oauth, 'authorize', 'GET' from v union all select refresh, 'token', 'POST' from v union all select refresh, 'refresh', 'POST' from v union all select page || '/logout', 'logout', 'GET' from v)")
def _(spark, d):
    v = _visits(spark, d)
    req = A.requests_of(v)
    return sinks.auth_text(A.auth_endpoints(req), A.oauth_flows(req), A.jwts(v), A.auth_cookies(v), A.storage_tokens(v)).where("part in (0, 1, 3)")


@query("report_json", "select '{\"n\":' || n_nationkey || ',\"name\":\"' || n_name || '\"}' as line from nation")
def _(spark, d):
    return sinks.as_json(files.table(spark, d, "nation").select(C("n_nationkey").alias("n"), C("n_name").alias("name")))


@query("rank_lines", f"with {_SCORES}, t as (select label, score, priority, row_number() over (order by score desc, label) as pos from (select distinct label, score, priority from p)) select cast(pos as int) as pos, format('{{}}. [{{}}] {{:.1f}} ', pos, priority, score) || label as line from t where pos <= 15")
def _(spark, d):
    top = scoring.top(_scored(spark, d).dropDuplicates(["id"]).withColumn("id", C("label")), 15)
    return sinks.rank_text(top.withColumns({"item_type": F.lit("X"), "summary": F.lit("Y")})).select("pos", F.regexp_replace(F.regexp_replace("line", "X — ", ""), r" \(Y\)$", "").alias("line"))


# Client replay


@query("token_bucket", "with recursive e as (select cast(user_id as varchar) as key, event_id, epoch_us(ts) / 1e6 as t, row_number() over (partition by user_id order by ts, event_id) as rn from events), w(key, event_id, t, rn, tokens, upto) as (select key, event_id, t, rn, 1.0::double, t from e where rn = 1 union all select e.key, e.event_id, e.t, e.rn, greatest(least(2.0, w.tokens + (greatest(e.t, w.upto) - w.upto) * 0.001), 1.0) - 1.0, greatest(e.t, w.upto) + greatest(0.0, (1.0 - least(2.0, w.tokens + (greatest(e.t, w.upto) - w.upto) * 0.001)) / 0.001) from w join e on e.key = w.key and e.rn = w.rn + 1) select key, event_id, round(tokens, 3) as tokens, round(upto - t, 3) as wait from w")
def _(spark, d):
    out = crawl.token_bucket(files.table(spark, d, "events").select(C("user_id").alias("key"), "event_id", "ts"), 0.001, 2)
    return out.select("key", "event_id", F.round("tokens", 3).alias("tokens"), F.round("wait", 3).alias("wait"))


@query("ttl_cache_hits", "with recursive e as (select event_type as key, event_id, epoch_us(ts) as t from events), w(key, t) as (select key, min(t) from e group by key union all select key, (select min(e.t) from e where e.key = w.key and e.t - w.t > 3600000000) from w where exists (select 1 from e where e.key = w.key and e.t - w.t > 3600000000)), m as (select w.key, w.t, min(e.event_id) as event_id from w join e on e.key = w.key and e.t = w.t group by 1, 2) select e.key, e.event_id, m.event_id is null as hit from e left join m on m.key = e.key and m.event_id = e.event_id")
def _(spark, d):
    return crawl.cache_hits(files.table(spark, d, "events").select(C("event_type").alias("key"), "event_id", "ts"), 3600.0)


@query("crawl_limited", "with recursive grid as (select 'https://s' || n_regionkey || '.test' as src, 'https://s' || n_regionkey || '.test/n' || n_nationkey as dst from nation union all select 'https://s' || (n_nationkey % 5) || '.test/n' || n_nationkey, 'https://s' || ((n_nationkey + 1) % 5) || '.test' from nation), w(url, depth) as (select 'https://s0.test', 0 union select g.dst, w.depth + 1 from w join grid g on g.src = w.url where w.depth < 3) select url, depth from (select url, min(depth) as depth from w group by url) order by depth, url limit 7")
def _(spark, d):
    from skerry.catalogue import _grid

    return crawl.frontier(_grid(spark, d), spark.createDataFrame([("HTTPS://S0.test/",)], "url string"), 3, max_pages=7)


_LAST = "(e is null and not (s = 429 or s >= 500)) or e = 'bad request' or a >= 3"
_ATTEMPTS = "t as (select l_orderkey as r, l_linenumber - 1 as a, case l_partkey % 5 when 0 then 200 when 1 then 503 when 2 then 429 when 3 then 404 end as s, case when l_partkey % 5 = 4 then case l_suppkey % 2 when 0 then 'i/o timeout' else 'bad request' end end as e, l_partkey as b from (select l_orderkey, l_linenumber, max(l_partkey) as l_partkey, max(l_suppkey) as l_suppkey from lineitem group by 1, 2))"
_OUTCOMES = f"{_ATTEMPTS}, f as (select r, min(a) as a from t where {_LAST} group by r), g as (select t.r, coalesce(f.a, m) as retries, case when f.a is null then 'open' when x.e is not null then 'failed' else 'successful' end as outcome, x.s, x.e, x.b from (select r, max(a) as m from t group by r) t left join f on f.r = t.r left join (select distinct * from t) x on x.r = f.r and x.a = f.a)"


def _outcomes(spark, d):
    li = files.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("l_partkey"), F.max("l_suppkey").alias("l_suppkey"))
    p = C("l_partkey") % 5
    status = F.when(p == 0, 200).when(p == 1, 503).when(p == 2, 429).when(p == 3, 404)
    error = F.when(p == 4, F.when(C("l_suppkey") % 2 == 0, "i/o timeout").otherwise("bad request"))
    return client.outcomes(li.select(C("l_orderkey").alias("request_id"), (C("l_linenumber") - 1).alias("attempt"), status.alias("status_code"), error.alias("error"), C("l_partkey").alias("bytes")))


@query("client_outcomes", f"with {_OUTCOMES} select r as request_id, outcome, cast(s as int) as status_code, e as error, cast(retries as int) as retries, case when retries <= 5 then 0.5 * (pow(2, retries) - 1) else 25.5 end as waited from g")
def _(spark, d):
    return _outcomes(spark, d).drop("bytes")


@query("client_metrics", f"with {_OUTCOMES}, h as (select count(*) as n, sum(p_size) as b from part) select count(*) + (select n from h) as total_requests, count(*) filter (outcome = 'successful') + (select n from h) as successful, count(*) filter (outcome = 'failed') as failed, (select n from h) as cached, cast(coalesce(sum(b) filter (outcome = 'successful'), 0) + (select b from h) as bigint) as bytes_received, cast(sum(retries) as bigint) as retries from g")
def _(spark, d):
    return client.metrics(_outcomes(spark, d), files.table(spark, d, "part").select(C("p_size").cast("long").alias("bytes")))


@query("client_settings", "select 'w' || n_nationkey as workspace_id, case when n_regionkey = 0 then 10.0 else n_regionkey * 1.5 end as rate_limit, cast(case when n_regionkey = 0 then 5 else n_nationkey end as int) as burst, case n_nationkey % 4 when 0 then 'u:' || n_name else '' end as bearer, case n_nationkey % 4 when 1 then 'u' else '' end as user, case n_nationkey % 4 when 1 then n_name else '' end as password, case n_nationkey % 4 when 2 then n_name end as u, 'v' as x from nation")
def _(spark, d):
    n = files.table(spark, d, "nation")
    kind = F.element_at(F.array(*map(F.lit, ("bearer", "basic", "header", "none"))), (C("n_nationkey") % 4 + 1).cast("int"))
    config = n.select(F.concat(F.lit("w"), _text("n_nationkey")).alias("workspace_id"), (C("n_regionkey") * 1.5).alias("rate_limit_rps"), C("n_nationkey").cast("int").alias("rate_limit_burst"), kind.alias("auth_type"), F.concat(F.lit("u:"), F.col("n_name")).alias("auth_value"), F.create_map(F.lit("X"), F.lit("v")).alias("custom_headers"))
    return client.settings(config).select("workspace_id", "rate_limit", "burst", "bearer", "user", "password", C("headers")["u"].alias("u"), C("headers")["X"].alias("x"))


@query("client_redirects", "with recursive h as (select 'u' || n_nationkey as url, 'u' || (n_nationkey + n_regionkey + 1) as location from nation where n_nationkey % 5 <> 4), w(id, url, n) as (select n_nationkey, 'u' || n_nationkey, 0 from nation union all select w.id, h.location, w.n + 1 from w join h on h.url = w.url where w.n < 3) select id as request_id, url, 'a' || id as auth, n as redirects, case when n = 3 and url in (select url from h) then 'stopped after 3 redirects' end as error from (select *, row_number() over (partition by id order by n desc) as rn from w) where rn = 1")
def _(spark, d):
    n, k = files.table(spark, d, "nation"), C("n_nationkey")
    u = lambda c: F.concat(F.lit("u"), c.cast("string"))
    hops = n.where("n_nationkey % 5 <> 4").select(u(k).alias("url"), u(k + C("n_regionkey") + 1).alias("location"))
    out = client.redirected(n.select(k.alias("request_id"), u(k).alias("url"), F.concat(F.lit("a"), k.cast("string")).alias("authorization")), hops, 3)
    return out.select("request_id", "url", C("authorization").alias("auth"), "redirects", "error")


@query("home_paths", "select n_nationkey, case n_nationkey % 3 when 0 then '/home/u/' || n_name when 1 then n_name else '~' || n_name end as path from nation")
def _(spark, d):
    k = C("n_nationkey") % 3
    p = F.when(k == 0, F.concat(F.lit("~/"), "n_name")).when(k == 1, C("n_name")).otherwise(F.concat(F.lit("~"), "n_name"))
    return files.table(spark, d, "nation").select("n_nationkey", client.expand_home(p, "/home/u").alias("path"))


@query("cache_deletions", "with e as (select user_id, event_id, epoch_us(ts) as t, event_type, row_number() over (partition by user_id order by ts, event_id) as rn from events), g as (select *, event_type <> 'error' as reads, sum(case when event_type = 'error' then 1 else 0 end) over (partition by user_id order by rn) as run from e), f as (select *, row_number() over (partition by user_id, run, reads order by rn) as k from g) select count(*) filter (reads and k > 1) as hits, count(*) filter (reads and k = 1) as misses from f")
def _(spark, d):
    e = files.table(spark, d, "events").select(C("user_id").alias("key"), "event_id", "ts", F.when(C("event_type") == "error", "delete").otherwise("get").alias("op"))
    return crawl.cache_stats(crawl.cache_hits(e, 1e12))


@query("cache_cleared", "with e as (select user_id, event_id, epoch_us(ts) as t from events), c as (select epoch_us(timestamp '2024-01-10 00:00:00') as c), f as (select e.*, row_number() over (partition by user_id, t >= c order by t, event_id) as k from e, c) select count(*) filter (k > 1) as hits, count(*) filter (k = 1) as misses from f")
def _(spark, d):
    import datetime

    at = datetime.datetime(2024, 1, 10, tzinfo=datetime.timezone.utc).timestamp()
    return crawl.cache_stats(crawl.cache_hits(files.table(spark, d, "events").select(C("user_id").alias("key"), "event_id", "ts"), 1e12, [at]))


@query("crawl_errors", "select 'u' || o_orderkey as url, 'failed' as error from orders where o_orderstatus = 'P'")
def _(spark, d):
    o = files.table(spark, d, "orders")
    return crawl.errors(o.select(F.concat(F.lit("u"), _text("o_orderkey")).alias("url"), F.when(C("o_orderstatus") == "P", "failed").alias("error")))


# Plugins


@query("plugin_runs", "select 'by_region' as plugin, cast(n_regionkey as varchar) as key, count(*) as n from nation group by n_regionkey union all select 'total', '', count(*) from nation")
def _(spark, d):
    r = Registry()
    count = lambda c: lambda df: df.groupBy(c.cast("string").alias("key")).agg(F.count("*").alias("n"))
    for p in (Plugin("total", "1", "analyzer", count(F.lit(""))), Plugin("by_region", "1", "analyzer", count(C("n_regionkey"))), Plugin("lines", "1", "exporter", lambda df: df), Plugin("gone", "1", "analyzer", count(F.lit("x")))):
        r.register(p)
    r.unregister("gone")
    n, out = files.table(spark, d, "nation"), None
    for p in r.by_kind("analyzer"):
        part = r.get(p.name).run(n).withColumn("plugin", F.lit(p.name))
        out = part if out is None else out.unionByName(part)
    return out
