"""Authentication mapping: tokens, endpoints, flows and cookies out of recorded visits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.functions import endpoints as E
from skerry.functions import text as T
from skerry.functions import urls

_PART = "[A-Za-z0-9_-]+"
_JWT = rf"eyJ{_PART}\.eyJ{_PART}\.{_PART}"
_PATHS = {
    "oauth": ("/oauth/", "/authorize", "/token", "/auth/realms/", "/oidc/"),
    "login": ("/login", "/signin", "/sign-in", "/authenticate"),
    "logout": ("/logout", "/signout", "/sign-out", "/revoke"),
    "refresh": ("/refresh", "/token/refresh", "/renew"),
    "register": ("/register", "/signup", "/sign-up"),
    "callback": ("/callback", "/redirect"),
    "authorize": ("/authorize",),
}


def looks(url: Column, kind: str) -> Column:
    if kind == "token":
        return F.lower(url).rlike(r"/token\z|/o?auth/token")
    return E.contains_any(url, _PATHS[kind])


def _json(part: Column) -> Column:
    """The text behind base64url; null if the letters or their number are not base64's."""
    std = F.translate(F.regexp_replace(part, "=+$", ""), "-_", "+/")
    ok = std.rlike("^[A-Za-z0-9+/]+$") & (F.length(std) % 4 != 1)
    padded = F.rpad(std, (F.ceil(F.length(std) / 4) * 4).cast("int"), F.lit("="))
    return F.when(ok, F.try_to_binary(padded, F.lit("base64")).cast("string"))


def jwt(token: Column) -> Column:
    """A struct of the token's claims, null if it is no JWT.

    The decoded parts are bound by a lambda, so they are worked out once for all claims and the code stays small.
    """
    parts = F.split(token, "[.]")
    decoded = F.struct(parts.alias("parts"), _json(F.try_element_at(parts, F.lit(1))).alias("head"), _json(F.try_element_at(parts, F.lit(2))).alias("body"))
    return F.transform(F.array(decoded), lambda x: _claims(token, x["parts"], x["head"], x["body"]))[0]


def _claims(token: Column, parts: Column, head: Column, body: Column) -> Column:
    shape = (F.size(parts) == 3) & (F.length(parts[0]) >= 10) & (F.length(parts[1]) >= 10)
    one = lambda j, k: F.get_json_object(j, f"$.{k}")
    object_ = lambda j: F.coalesce(F.from_json(j, "map<string,string>"), F.lit(None)).isNotNull() & j.rlike(r"^\s*\{")
    scopes = F.concat(F.coalesce(F.filter(F.split(one(body, "scope"), r"\s+"), lambda x: x != ""), F.array().cast("array<string>")), F.coalesce(F.from_json(one(body, "scopes"), "array<string>"), F.array().cast("array<string>")))
    stated = F.coalesce(one(body, "type"), one(body, "token_type"))
    n = lambda k: one(body, k).try_cast("double").cast("bigint")
    kind = F.when(stated.isNotNull(), stated)
    kind = kind.when((F.coalesce(one(body, "sub"), F.lit("")) != "") & (F.coalesce(one(body, "iss"), F.lit("")) != "") & n("exp").isNotNull(), "access")
    kind = kind.when(one(body, "nonce").isNotNull(), "id").when(one(body, "refresh").isNotNull() | token.contains("refresh"), "refresh").when(F.array_contains(scopes, "openid"), "id").otherwise("access")
    text = lambda j, k: F.coalesce(one(j, k), F.lit(""))
    fields = F.struct(
        token.alias("token"), F.from_json(head, "map<string,string>").alias("header"), F.from_json(body, "map<string,string>").alias("payload"), text(head, "alg").alias("algorithm"), kind.alias("token_type"),
        F.timestamp_seconds(n("exp")).alias("expires_at"), F.timestamp_seconds(n("iat")).alias("issued_at"), text(body, "sub").alias("subject"), text(body, "iss").alias("issuer"), scopes.alias("scopes"),
    )
    return F.when(F.coalesce(shape & object_(head) & object_(body), F.lit(False)), fields)


def _exploded(runtime: DataFrame, array: str) -> DataFrame:
    return runtime.select(F.col("url").alias("page"), F.posexplode(array).alias("seq", "x")).select("page", "seq", "x.*")


def _parsed(rows: DataFrame) -> DataFrame:
    """Rows with ``raw``: those that are JWTs, their fields added."""
    # exploded, for a filter on the column would work it out a second time
    return rows.select("*", F.explode(F.array_compact(F.array(jwt(F.col("raw"))))).alias("jwt"))


def jwts(runtime: DataFrame) -> DataFrame:
    """Tokens in headers, query fields, cookies and storage: each token of a page once, where it was first seen."""
    req = _exploded(runtime, "requests")
    heads = req.select("page", "seq", F.explode("headers").alias("k", "v"))
    bearer, plain = rf"(?i)bearer\s+(eyJ{_PART}\.{_PART}\.{_PART})", rf"({_JWT})"
    raw = F.when(F.col("v").rlike(bearer), F.regexp_extract("v", bearer, 1)).when(F.lower("k") != "authorization", F.regexp_extract("v", plain, 1))
    out = heads.select("page", F.lit(0).alias("rank"), "seq", F.col("k").alias("location"), F.lit("header").alias("source"), raw.alias("raw")).where("raw <> ''")
    field = r"(?i)((?:access_|refresh_|id_)?token)=([^&\s]+)"
    params = req.select("page", "seq", F.expr("substring(url, instr(url, '?') + 1)").alias("q")).where("q is not null").select("page", "seq", F.posexplode(F.arrays_zip(F.regexp_extract_all("q", F.lit(field), 1).alias("k"), F.regexp_extract_all("q", F.lit(field), 2).alias("v"))).alias("p", "m"))
    out = out.unionByName(params.select("page", F.lit(0).alias("rank"), "seq", F.col("m.k").alias("location"), F.lit("param").alias("source"), F.col("m.v").alias("raw")))
    out = out.unionByName(_exploded(runtime, "cookies").select("page", F.lit(1).alias("rank"), "seq", F.col("name").alias("location"), F.lit("cookie").alias("source"), F.col("value").alias("raw")))
    out = out.unionByName(storage_tokens(runtime).select("page", F.lit(2).alias("rank"), F.lit(0).alias("seq"), F.concat_ws("/", "source", "key").alias("location"), F.lit("storage").alias("source"), F.col("value").alias("raw")))
    first = Window.partitionBy("page", "raw").orderBy("rank", "seq", F.when(F.col("source") == "header", 0).otherwise(1), "location")
    return _parsed(out.withColumn("rn", F.row_number().over(first)).where("rn = 1")).select("page", "source", "location", "jwt.*")


def storage_tokens(runtime: DataFrame) -> DataFrame:
    """Storage entries whose key names a token or whose value looks like one."""
    parts = [("local_storage", "localStorage"), ("session_storage", "sessionStorage")]
    out = None
    for array, name in parts:
        p = _exploded(runtime, array).select("page", F.lit(name).alias("source"), "key", "value")
        out = p if out is None else out.unionByName(p)
    idb = runtime.select(F.col("url").alias("page"), F.explode("indexed_db").alias("d")).select("page", F.col("d.database").alias("db"), F.explode("d.stores").alias("s")).select("page", F.concat(F.lit("indexedDB:"), "db").alias("source"), F.col("s.name").alias("key"), F.explode("s.records").alias("value"))
    low = F.lower("key")
    kind = F.lit(None).cast("string")
    for word in reversed(("access_token", "refresh_token", "id_token", "token", "jwt")):
        kind = F.when(F.instr(low, word) > 0, word.replace("_token", "")).otherwise(kind)
    rows = out.unionByName(idb).where("value <> ''").withColumn("kind", kind).where(F.col("kind").isNotNull() | E.is_token(F.col("value")))
    claimed = jwt(F.col("value"))["token_type"]
    return rows.select("page", "source", "key", "value", F.coalesce("kind", claimed, F.lit("unknown")).alias("token_type"))


def endpoint_type(url: Column) -> Column:
    out = F.lit("")
    for kind in reversed(("login", "logout", "register", "refresh", "token", "authorize", "callback")):
        out = F.when(looks(url, kind), kind).otherwise(out)
    return out


def oauth_type(url: Column) -> Column:
    """What an OAuth URL is for: by its path, else by its fields."""
    has = lambda n: urls.has_field(url, n)
    return F.when(looks(url, "authorize"), "authorize").when(looks(url, "token"), "token").when(looks(url, "callback"), "callback").when(has("response_type") | has("client_id"), "authorize").when(has("grant_type") | has("code"), "token").otherwise("oauth")


def auth_endpoints(requests: DataFrame) -> DataFrame:
    """(url, method, endpoint_type, parameters, signal): the first request of each (page, url, type) that fits.

    ``requests`` has page, seq, url and method; a URL that is OAuth's and fits a path besides gives two rows.
    """
    u = F.col("url")
    a = requests.where(looks(u, "oauth")).select("page", "seq", "url", "method", oauth_type(u).alias("endpoint_type"), F.lit("oauth_url_pattern").alias("signal"), F.lit(0).alias("rank"))
    b = requests.withColumn("endpoint_type", endpoint_type(u)).where("endpoint_type <> ''").select("page", "seq", "url", "method", "endpoint_type", F.lit("url_path").alias("signal"), F.lit(1).alias("rank"))
    w = Window.partitionBy("page", "url", "endpoint_type").orderBy("seq", "rank")
    return a.unionByName(b).withColumn("rn", F.row_number().over(w)).where("rn = 1").select("page", "seq", "rank", "url", "method", "endpoint_type", urls.field_names(u).alias("parameters"), "signal")


def oauth_flows(requests: DataFrame) -> DataFrame:
    """OAuth flows that a request's fields give away, with their type, scopes, PKCE and OIDC."""
    u = F.col("url")
    v = lambda n: F.coalesce(urls.query_value(u, n), F.lit(""))
    has = lambda n: urls.has_field(u, n)
    rt, gt = v("response_type"), v("grant_type")
    base = F.when(rt == "code", "authorization_code").when(rt.isin("token", "id_token"), "implicit").when(rt.isin("code id_token", "id_token code"), "hybrid")
    base = base.when(has("client_id") & ~has("response_type"), F.when(gt == "client_credentials", gt).otherwise("authorization_code")).otherwise("")
    kind = F.when(gt.isin("authorization_code", "implicit", "client_credentials"), gt).when((gt == "refresh_token") & (base == ""), "refresh").otherwise(base)
    rows = requests.where(looks(u, "oauth") & (has("response_type") | has("client_id") | has("grant_type")))
    oidc = F.lower(v("scope")).contains("openid") | (rt == "id_token")
    return rows.select(
        "page", "seq", kind.alias("type"), F.when(looks(u, "authorize"), u).otherwise("").alias("auth_endpoint"), F.when(looks(u, "token"), u).otherwise("").alias("token_endpoint"), v("redirect_uri").alias("redirect_uri"),
        v("client_id").alias("client_id"), F.filter(F.split(v("scope"), r"\s+"), lambda x: x != "").alias("scopes"), F.lower(u).contains("code_challenge=").alias("pkce"), oidc.alias("oidc"), F.lit("oauth_endpoint_detected").alias("signal"),
    ).where("type <> ''")


def auth_cookies(runtime: DataFrame) -> DataFrame:
    return _exploded(runtime, "cookies").select("page", "seq", "name", "domain", "path", "secure", "http_only", F.lit("").alias("same_site"), E.cookie_type(F.col("name")).alias("token_type"), E.is_token(F.col("value")).alias("suspicious"))


def _step(action: str, detail, url=None, method=None) -> Column:
    c = lambda x: F.lit(x) if isinstance(x, str) else F.lit("") if x is None else x
    return F.struct(F.lit(action).alias("action"), c(url).alias("url"), c(method).alias("method"), c(detail).alias("detail"))


def _numbered(steps: Column) -> Column:
    return F.transform(steps, lambda s, i: F.struct((i + 1).cast("int").alias("order"), s["action"].alias("action"), s["url"].alias("url"), s["method"].alias("method"), s["detail"].alias("detail")))


def refresh_flows(requests: DataFrame) -> DataFrame:
    code = F.col("status_code")
    grant = urls.query_value(F.col("url"), "grant_type")
    steps = F.array(_step("request", "refresh token request", F.col("url"), F.col("method")))
    steps = F.when(F.coalesce(grant, F.lit("")) != "", F.concat(steps, F.array(_step("request", F.concat(F.lit("grant_type: "), grant))))).otherwise(steps)
    done = F.concat(F.lit("status: "), code.cast("string"))
    good, bad = _step("response", F.concat(done, F.lit(" — new tokens issued")), F.col("url")), _step("response", F.concat(done, F.lit(" — refresh failed/expired")))
    steps = F.when((code > 0) & (code < 400), F.concat(steps, F.array(good))).when(code >= 400, F.concat(steps, F.array(bad))).otherwise(steps)
    # the response keeps the third number, grant or not
    numbered = F.transform(_numbered(steps), lambda s: F.when(s["action"] == "response", s.withField("order", F.lit(3))).otherwise(s))
    return requests.where(looks(F.col("url"), "refresh")).select("page", "seq", F.lit("token_refresh").alias("name"), numbered.alias("steps"))


def flows(runtime: DataFrame) -> DataFrame:
    """(page, ord, name, steps) of each page: refreshes, login, login by OAuth, logouts, complete OAuth flows."""
    req = _exploded(runtime, "requests").select("page", "seq", "url", "method", "status_code")
    ends, kinds = auth_endpoints(req), oauth_flows(req)
    row = F.struct("seq", "rank", "url", "method")
    of = lambda t: F.array_sort(F.collect_list(F.when(F.col("endpoint_type") == t, row))).alias(t)
    by_page = ends.groupBy("page").agg(*[of(t) for t in ("login", "callback", "token", "logout")])
    known = auth_cookies(runtime).groupBy("page").agg(F.max((F.col("token_type") != "unknown") | F.col("suspicious")).alias("cookies"), F.max(F.col("token_type") != "unknown").alias("typed"))
    tokens = jwts(runtime).groupBy("page").agg(F.lit(True).alias("tokens"))
    pages = by_page.join(known, "page", "left").join(tokens, "page", "left").fillna(False, ["cookies", "typed", "tokens"])
    each = lambda t, action, detail: F.transform(t, lambda e: _step(action, detail, e["url"], e["method"]))
    answered = F.flatten(F.transform("login", lambda e: F.array(_step("request", "login request", e["url"], e["method"]), _step("response", "authentication response (cookies/tokens issued)"))))
    login = pages.where((F.size("login") > 0) & (F.col("cookies") | F.col("tokens"))).select("page", F.lit(10_000_000).alias("ord"), F.lit("login").alias("name"), _numbered(answered).alias("steps"))
    last = F.when(F.col("tokens"), F.array(_step("response", "access/refresh/id tokens issued"))).otherwise(F.array().cast("array<struct<action:string,url:string,method:string,detail:string>>"))
    both = F.concat(each("login", "request", "initial login request"), each("callback", "redirect", "OAuth callback with authorization code"), each("token", "request", "token exchange (code → tokens)"), last)
    by_oauth = pages.where((F.size("login") > 0) & (F.size("callback") > 0)).select("page", F.lit(10_000_001).alias("ord"), F.lit("oauth_login").alias("name"), _numbered(both).alias("steps"))
    out_steps = F.array(_step("request", "logout request", F.col("e.url"), F.col("e.method")), _step("response", "session invalidated, cookies cleared"))
    cleared = F.when(F.col("typed"), F.concat(out_steps, F.array(_step("response", "auth cookies should be cleared client-side")))).otherwise(out_steps)
    logout = pages.select("page", "typed", F.posexplode("logout").alias("i", "e")).select("page", (F.col("i") + 10_000_002).alias("ord"), F.lit("logout").alias("name"), _numbered(cleared).alias("steps"))
    first = kinds.withColumn("rn", F.row_number().over(Window.partitionBy("page", "type").orderBy("seq"))).where("rn = 1")
    maybe = F.array(
        F.when(F.col("auth_endpoint") != "", _step("request", F.concat(F.lit("authorization request to "), "type", F.lit(" flow")), F.col("auth_endpoint"))),
        F.when(F.col("redirect_uri") != "", _step("redirect", "user redirected back to app", F.col("redirect_uri"))),
        F.when(F.col("token_endpoint") != "", _step("request", "token exchange", F.col("token_endpoint"), "POST")),
        F.when(F.col("pkce"), _step("script", "PKCE code_challenge/code_verifier generated")),
    )
    complete = first.select("page", (F.col("seq") + 20_000_000).alias("ord"), F.concat(F.lit("oauth_"), "type").alias("name"), _numbered(F.filter(maybe, lambda s: s.isNotNull())).alias("steps"))
    refresh = refresh_flows(req).select("page", F.col("seq").alias("ord"), "name", "steps")
    return refresh.unionByName(login).unionByName(by_oauth).unionByName(logout).unionByName(complete)


def diagram(runtime: DataFrame) -> DataFrame:
    """(page, diagram): a Mermaid sequence diagram; pages without flows, tokens and cookies have none."""
    line = lambda *p: F.concat(F.lit("    "), *[F.lit(x) if isinstance(x, str) else x for x in p])
    note, s = "Note over Browser,Server: ", "s"
    f = flows(runtime)
    steps = f.select("page", "ord", F.explode("steps").alias(s)).select("page", "ord", F.col("s.order").alias("n"), "s.*")
    text = F.when(F.col("detail") != "", F.col("detail")).otherwise(F.col("url"))
    method = F.when(F.col("method") == "", "POST").otherwise(F.col("method"))
    detail = T.label(F.col("detail"))
    drawn = F.when(F.col("action") == "request", line("Browser->>Server: ", method, " ", T.label(urls.shortened(text)))).when(F.col("action") == "response", line("Server-->>Browser: ", detail))
    hop = F.concat(line("Server-->>Browser: Redirect to\n"), line("Browser->>Server: ", T.label(urls.shortened(F.col("url")))), F.when(F.col("detail") != "", F.concat(F.lit("\n"), line("Note over Browser: ", detail))).otherwise(""))
    drawn = drawn.when(F.col("action") == "redirect", hop).when(F.col("action") == "script", line("Note over Browser: ", detail)).otherwise(line(note, detail))
    rows = steps.select("page", F.lit(0).alias("a"), "ord", "n", drawn.alias("line")).unionByName(f.select("page", F.lit(0).alias("a"), "ord", F.lit(0).alias("n"), line(note, "=== ", T.label(F.col("name")), " ===").alias("line")))
    t = jwts(runtime).withColumn("i", F.row_number().over(Window.partitionBy("page").orderBy("source", "location", "token")))
    sub = F.when(F.col("subject") != "", F.concat(F.lit(" sub="), "subject")).otherwise("")
    rows = rows.unionByName(t.where("i = 1").select("page", F.lit(1).alias("a"), F.lit(0).alias("ord"), F.lit(0).alias("n"), line(note, "--- Token Summary ---").alias("line")))
    rows = rows.unionByName(t.select("page", F.lit(1).alias("a"), F.col("i").alias("ord"), F.lit(1).alias("n"), F.concat(line("Note over Browser: ", T.label(F.concat("token_type", F.lit(" token ("), "algorithm", F.lit(")"), sub))), F.lit("\n"), line("Note over Browser: Source: ", F.col("source"), " - ", T.label(F.col("location")))).alias("line")))
    c = auth_cookies(runtime)
    flags = F.concat(F.when(F.col("secure"), " 🔒").otherwise(""), F.when(F.col("http_only"), " 👁️").otherwise(""))
    rows = rows.unionByName(c.where("seq = 0").select("page", F.lit(2).alias("a"), F.lit(-1).alias("ord"), F.lit(0).alias("n"), line(note, "--- Auth Cookies ---").alias("line")))
    rows = rows.unionByName(c.select("page", F.lit(2).alias("a"), F.col("seq").alias("ord"), F.lit(0).alias("n"), line("Note over Browser: ", T.label(F.concat(F.lit("🍪 "), "name", F.lit(" ("), "token_type", F.lit(")"), flags))).alias("line")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("a", "ord", "n", "line"))), lambda x: x["line"])
    return rows.groupBy("page").agg(F.concat(F.lit("sequenceDiagram\n    participant Browser\n    participant Server\n    participant IdP as Identity Provider\n"), F.array_join(lines, "\n"), F.lit("\n")).alias("diagram"))


def requests_of(runtime: DataFrame) -> DataFrame:
    return _exploded(runtime, "requests")
