"""The pipelines that put the operators together: the graph, the ranking, the dependency and authentication reports."""

from __future__ import annotations

from pyspark.sql import DataFrame

from skerry.operators import auth, deps, frameworks, scoring, secrets
from skerry.operators.graph import Graph
from skerry.sources.scratch import cut


def auth_map(runtime: DataFrame) -> dict[str, DataFrame]:
    """The tables of an authentication mapping, each worked out once however often it is used."""
    req = auth.requests_of(runtime)
    tables = {"endpoints": auth.auth_endpoints(req), "flows": auth.oauth_flows(req), "jwts": auth.jwts(runtime), "cookies": auth.auth_cookies(runtime), "tokens": auth.storage_tokens(runtime)}
    return {name: cut(t) for name, t in tables.items()}


def build_graph(runtime: DataFrame, files: DataFrame, packages: DataFrame, advisories: DataFrame, page: str, dump: DataFrame | None = None) -> Graph:
    """One graph of recorded visits, authentication, secrets, frameworks of ``files`` for ``page``, and dependencies."""
    runtime, packages = cut(runtime), cut(packages)
    g = Graph().add_frameworks(cut(frameworks.detect(files)), page).add_runtime(runtime).add_auth(**auth_map(runtime))
    g.add_secrets(cut(secrets.scan_runtime(runtime)))
    return g.add_dependencies(packages, cut(deps.vulnerabilities(packages, advisories, dump)))


def rank(runtime: DataFrame, packages: DataFrame, advisories: DataFrame, min_priority: str = "LOW", top: int = 0, known: DataFrame | None = None) -> DataFrame:
    """All scored items of visits, authentication, secrets and dependencies in one ranking, ties by id.

    ``top`` keeps the highest; the order is over all sources together.
    """
    runtime = cut(runtime)
    a = auth_map(runtime)
    req = auth.requests_of(runtime)
    items = scoring.of_requests(req).unionByName(scoring.of_sockets(runtime.selectExpr("inline(web_sockets)")))
    for make, table in ((scoring.of_endpoints, a["endpoints"]), (scoring.of_flows, a["flows"]), (scoring.of_jwts, a["jwts"]), (scoring.of_cookies, a["cookies"]), (scoring.of_secrets, cut(secrets.scan_runtime(runtime))), (scoring.of_vulnerabilities, cut(deps.vulnerabilities(packages, advisories)))):
        items = items.unionByName(make(table))
    out = scoring.at_least(scoring.score(items, known), min_priority)
    return scoring.top(out, top) if top else out
