"""Risk scores: ten factors a row in one projection, priorities, rankings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.functions import endpoints as E
from skerry.functions import severity as S

C = F.col


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _auth() -> Column:
    worth = F.when(C("label").contains("token"), 1.0).when(C("method") == "POST", 0.8).otherwise(0.5)
    return F.when(C("item_type").isin("auth_endpoint", "auth_flow", "auth_cookie", "jwt"), 1.0).when(E.is_auth(_text("url"), _text("method"), _text("name")), worth).when(_text("secret_type").isin("jwt", "oauth"), 1.0)


def _admin() -> Column:
    return F.when(E.is_admin(_text("url")), 1.0).when((C("item_type") == "auth_endpoint") & C("label").contains("admin"), 0.8)


def _upload() -> Column:
    return F.when(E.is_upload(_text("url")), 1.0).when((C("item_type") == "api_endpoint") & C("label").contains("upload"), 0.8)


def _graphql() -> Column:
    return F.when(E.is_graphql(_text("url")), 1.0).when(C("label").contains("graphql"), 0.8)


def _redirect() -> Column:
    return F.when(E.is_redirect(_text("url")), 1.0).when((C("item_type") == "auth_endpoint") & (_text("name") == "callback"), 0.8)


def _sink() -> Column:
    return F.when(E.is_dangerous(_text("secret_type")), 1.0).when((C("item_type") == "vulnerability") & (C("severity_float") >= 3.0), 0.8).when(_text("provider").isin("AWS", "Azure", "GitHub"), 0.7)


def _secrets() -> Column:
    worth = F.when((_text("provider") == "Critical") | (_text("secret_type") == "private_key"), 1.0).otherwise(F.coalesce(C("severity_int") / 4.0, F.lit(0.5)))
    return F.when(C("item_type").isin("secret", "finding"), worth)


def _cve() -> Column:
    return F.when(C("item_type") == "vulnerability", F.least(F.lit(1.0), F.coalesce(C("severity_float") / 4.0, F.lit(0.5))))


#: Factor → its expression over the columns of a scorable; more rules may be given to :func:`score`.
RULES: dict[str, Callable[[], Column]] = {"authentication": _auth, "admin_routes": _admin, "uploads": _upload, "graphql": _graphql, "redirects": _redirect, "dangerous_sinks": _sink, "secrets": _secrets, "cve": _cve}


def score(items: DataFrame, known: DataFrame | None = None, rules: dict[str, Callable[[], Column]] | None = None) -> DataFrame:
    """(id, label, item_type, score, priority, breakdown, summary, source) of scorables.

    ``known`` (url) are known endpoints: items with another URL gain 0.5.  The sum is rounded to 6 places; the
    summary names the factors above 0 in order of their names.
    """
    rows = items
    if known is not None:
        seen = known.select(F.col("url").alias("known_url")).distinct()
        rows = rows.join(seen, rows.url == F.col("known_url"), "left")
        new = F.when((_text("url") != "") & F.col("known_url").isNull(), 0.5)
    else:
        new = F.when(_text("url") != "", 0.5)
    parts = [(n, make().cast("double")) for n, make in (rules or RULES).items()] + [("new_endpoints", new.cast("double"))]
    rows = rows.withColumns({f"f_{n}": c for n, c in parts})
    total = F.round(sum((F.coalesce(F.col(f"f_{n}"), F.lit(0.0)) for n, _ in parts[1:]), F.coalesce(F.col(f"f_{parts[0][0]}"), F.lit(0.0))), 6)
    pairs = F.filter(F.array(*[F.struct(F.lit(n).alias("k"), F.col(f"f_{n}").alias("v")) for n, _ in sorted(parts)]), lambda x: x["v"].isNotNull())
    summary = F.array_join(F.transform(F.filter(pairs, lambda x: x["v"] > 0), lambda x: x["k"]), ", ")
    return rows.withColumn("score", total).select("id", "label", "item_type", "score", S.priority(F.col("score")).alias("priority"), F.map_from_entries(pairs).alias("breakdown"), summary.alias("summary"), F.col("provider").alias("source"))


COLUMNS = [("id", "string"), ("label", "string"), ("item_type", "string"), ("url", "string"), ("method", "string"), ("name", "string"), ("secret_type", "string"), ("provider", "string"), ("severity_int", "int"), ("severity_float", "double")]


def scorable(rows: DataFrame, **cols: Column) -> DataFrame:
    """Scorables with the given columns; other texts are empty, other numbers null."""
    return rows.select(*[(cols[n] if n in cols else F.lit("") if t == "string" else F.lit(None)).cast(t).alias(n) for n, t in COLUMNS])


def of_requests(requests: DataFrame) -> DataFrame:
    m, u = F.col("method"), F.col("url")
    return scorable(requests, id=F.concat(F.lit("api:"), m, F.lit(":"), u), label=F.concat_ws(" ", m, u), item_type=F.lit("api_endpoint"), url=u, method=m)


def of_sockets(sockets: DataFrame) -> DataFrame:
    u = F.col("url")
    return scorable(sockets, id=F.concat(F.lit("ws:"), u), label=F.concat(F.lit("WS "), u), item_type=F.lit("websocket"), url=u, method=F.lit("WS"))


def of_secrets(findings: DataFrame) -> DataFrame:
    return scorable(findings, id=F.concat_ws(":", "secret_type", "match"), label=F.concat_ws(": ", "key", "match"), item_type=F.lit("secret"), url=F.col("source"), secret_type=F.col("secret_type"), name=F.col("key"), provider=F.col("provider"), severity_int=F.col("severity"))


def of_endpoints(ends: DataFrame) -> DataFrame:
    t, u, m = F.col("endpoint_type"), F.col("url"), F.col("method")
    return scorable(ends, id=F.concat(F.lit("auth:"), t, F.lit(":"), u), label=F.concat(m, F.lit(" "), u, F.lit(" ("), t, F.lit(")")), item_type=F.lit("auth_endpoint"), url=u, method=m, name=t)


def of_flows(flows: DataFrame) -> DataFrame:
    t, u = F.col("type"), F.col("auth_endpoint")
    return scorable(flows, id=F.concat(F.lit("oauth:"), t, F.lit(":"), u), label=F.concat(F.lit("OAuth "), t, F.lit(" flow")), item_type=F.lit("auth_flow"), url=u)


def of_jwts(jwts: DataFrame) -> DataFrame:
    return scorable(jwts, id=F.concat(F.lit("jwt:"), F.substring("token", 1, 20)), label=F.concat(F.lit("JWT "), "token_type", F.lit(" ("), "subject", F.lit(")")), item_type=F.lit("jwt"), secret_type=F.lit("jwt"), name=F.col("token_type"))


def of_cookies(cookies: DataFrame) -> DataFrame:
    n, d = F.col("name"), F.col("domain")
    return scorable(cookies, id=F.concat(F.lit("cookie:"), n, F.lit("@"), d), label=F.concat(F.lit("Cookie "), n, F.lit(" @"), d), item_type=F.lit("auth_cookie"), url=d, name=n)


def of_vulnerabilities(vulns: DataFrame) -> DataFrame:
    return scorable(vulns, id=F.concat(F.lit("cve:"), "id"), label=F.concat_ws(" — ", "id", "summary"), item_type=F.lit("vulnerability"), name=F.col("affected_package"), severity_float=S.number(F.col("severity")))


def of_nodes(nodes: DataFrame) -> DataFrame:
    """Graph nodes: their severity is a text, so the numeric rules fall back to 0.5."""
    p = lambda k: F.coalesce(F.try_element_at("properties", F.lit(k)), F.lit(""))
    return scorable(nodes, id=F.col("id"), label=F.col("label"), item_type=F.col("type"), url=p("url"), method=p("method"), name=p("name"), secret_type=p("finding_type"), provider=p("provider"))


def by_priority(scored: DataFrame, priority: str) -> DataFrame:
    return scored.where(F.col("priority") == priority)


def at_least(scored: DataFrame, priority: str = "LOW") -> DataFrame:
    return scored.where(S.priority_rank(F.col("priority"), "NONE") >= S.PRIORITY_RANK.get(priority.upper(), 1))


def top(scored: DataFrame, n: int) -> DataFrame:
    """The ``n`` highest, ties by id; a top-k, never a full sort."""
    return scored.orderBy(F.desc("score"), "id").limit(n)


def counts(scored: DataFrame) -> DataFrame:
    return scored.groupBy("priority").agg(F.count("*").alias("n"))


def line(scored: DataFrame) -> Column:
    del scored
    return F.format_string("[%s] %.1f %s — %s", "priority", "score", "item_type", "label")
