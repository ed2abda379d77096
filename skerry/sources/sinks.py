"""Reports: text lines and JSON for graphs, rankings, dependencies and authentication maps.

Lines come as rows with their order, written by all tasks; nothing is put together on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skerry.functions import severity as S
from skerry.functions import text as T
from skerry.operators import graph as G


def as_json(rows: DataFrame) -> DataFrame:
    """(line): a JSON object a row."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("line"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("line").write.mode("overwrite").text(path)


def _lines(rows: DataFrame, part: int, key, line) -> DataFrame:
    return rows.select(F.lit(part).alias("part"), key.cast("string").alias("key"), line.alias("line"))


def graph_text(nodes: DataFrame, edges: DataFrame, query: str = "") -> DataFrame:
    """(part, key, line): totals, counts by type, nodes with their number of neighbours."""
    s = G.stats(nodes, edges)
    head = _lines(s, 0, F.concat("kind", F.lit(":"), "type"), F.concat_ws(" ", F.when(F.col("type") == "", F.concat("kind", F.lit("s"))).otherwise(F.concat(F.lit("  "), "type")), F.col("n").cast("string")))
    shown = G.search_ranked(nodes, query) if query else nodes
    n = shown.join(G.degrees(edges), "id", "left")
    return head.unionByName(_lines(n, 1, F.col("id"), F.concat(F.lit("["), "type", F.lit("] "), "label", F.lit(" ("), F.coalesce("neighbours", F.lit(0)).cast("string"), F.lit(" connections)"))))


def rank_text(scored: DataFrame) -> DataFrame:
    """(pos, line) of ranked items, numbered from 1; for a top-n, which is what the report shows."""
    w = Window.orderBy(F.desc("score"), "id")
    return scored.select(F.row_number().over(w).alias("pos"), "*").select("pos", F.format_string("%d. [%s] %.1f %s — %s (%s)", "pos", "priority", "score", "item_type", "label", "summary").alias("line"))


def deps_text(packages: DataFrame, vulns: DataFrame) -> DataFrame:
    p = _lines(packages.groupBy("ecosystem").agg(F.count("*").alias("n")), 0, F.col("ecosystem"), F.format_string("%s (%d)", "ecosystem", "n"))
    p = p.unionByName(_lines(packages, 0, F.concat_ws("/", "ecosystem", "name", "version"), F.format_string("  %s @ %s", "name", "version")))
    return p.unionByName(_lines(vulns, 1, F.col("id"), F.format_string("[%s] %s: %s %s (fixed in %s)", S.name(F.col("severity")), "id", "affected_package", "affected_version", "fixed_version")))


def auth_text(endpoints: DataFrame, flows: DataFrame, jwts: DataFrame, cookies: DataFrame, tokens: DataFrame) -> DataFrame:
    out = _lines(endpoints, 0, F.col("url"), F.format_string("[%s] %s %s", "endpoint_type", "method", "url"))
    out = out.unionByName(_lines(flows, 1, F.col("type"), F.format_string("OAuth %s pkce=%s oidc=%s", "type", F.col("pkce").cast("string"), F.col("oidc").cast("string"))))
    out = out.unionByName(_lines(jwts, 2, F.col("token"), F.format_string("JWT %s %s sub=%s from %s %s", "token_type", "algorithm", "subject", "source", "location")))
    out = out.unionByName(_lines(cookies, 3, F.col("name"), F.format_string("cookie %s @ %s (%s)", "name", "domain", "token_type")))
    return out.unionByName(_lines(tokens, 4, F.col("key"), F.concat("source", F.lit("["), "key", F.lit("] = "), T.cut(F.col("value"), 40))))
