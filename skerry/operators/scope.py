"""Scope rules and robots rules as predicates over URLs."""

from __future__ import annotations

import ipaddress
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.functions import urls


def is_domain(text: Column) -> Column:
    return (F.instr(text, ".") > 0) & (F.instr(text, "/") == 0) & (F.instr(text, "*") == 0)


def is_wildcard(text: Column) -> Column:
    return text.startswith("*.") & is_domain(F.substring(text, 3, 1 << 20))


def without_wildcard(text: Column) -> Column:
    return F.regexp_replace(text, r"^\*\.", "")


def within(child: Column, parent: str | Column) -> Column:
    """Equal to the parent or a subdomain of it."""
    p = F.lower(F.lit(parent) if isinstance(parent, str) else parent)
    c = F.lower(child)
    return (c == p) | c.endswith(F.concat(F.lit("."), p))


def valid_domain(text: str) -> bool:
    return "." in text.removeprefix("*.")


def valid_cidr(text: str) -> bool:
    try:
        ipaddress.ip_network(text, strict=False)
    except ValueError:
        return False
    return "/" in text


def valid_regex(text: str) -> bool:
    try:
        re.compile(text)
    except re.error:
        return False
    return True


def ip_number(text: Column) -> Column:
    """An IPv4 literal as a number, null for anything else."""
    parts = F.split(text, "[.]")
    whole = text.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?!$)|$)){4}$")
    return F.when(whole, F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, x: a * 256 + x.try_cast("bigint")))


def _any(tests: list[Column]) -> Column:
    """Whether any of the tests holds, null counting as no; a flat tree, so that long lists of rules do not nest."""
    if not tests:
        return F.lit(False)
    if len(tests) == 1:
        return F.coalesce(tests[0], F.lit(False))
    return _any(tests[: len(tests) // 2]) | _any(tests[len(tests) // 2 :])


def ranges(cidrs: list[str]) -> list[tuple[int, int]]:
    """(lowest, highest) address of the valid IPv4 networks."""
    nets = [ipaddress.ip_network(c, strict=False) for c in cidrs if valid_cidr(c)]
    return [(int(n[0]), int(n[-1])) for n in nets if n.version == 4]


@dataclass
class Scope:
    target: str = ""
    domains: list[str] = field(default_factory=list)
    subdomains: list[str] = field(default_factory=list)
    cidrs: list[str] = field(default_factory=list)
    regexes: list[str] = field(default_factory=list)
    excludes: list[str] = field(default_factory=list)

    def __str__(self) -> str:
        return f"scope({self.target or '-'}: {len(self.domains)} domains, {len(self.subdomains)} subdomains, {len(self.cidrs)} networks, {len(self.regexes)} expressions, {len(self.excludes)} excludes)"

    def contains(self, url: Column) -> Column:
        """Excludes first; then any include; without includes the target and its subdomains.  Names are not looked up."""
        host, path = urls.host(url), F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
        no = _any([path.startswith(e) if e.startswith("/") else within(host, e) for e in self.excludes])
        out = [within(host, d) for d in self.domains] + [host == s.lower() for s in self.subdomains]
        number = ip_number(host)
        out += [number.between(a, b) for a, b in ranges(self.cidrs)] + [url.rlike("(?d)" + r) for r in self.regexes if valid_regex(r)]
        empty = not (self.domains or self.subdomains or self.cidrs or self.regexes)
        yes = _any(out + ([within(host, self.target)] if empty and self.target else []))
        return F.coalesce(~no & yes & host.isNotNull(), F.lit(False))

    @classmethod
    def of(cls, entries: DataFrame, workspace: str, target: str = "") -> Scope:
        """From the rows of a workspace's scope table: a few rules, read on the driver; for many see :func:`contained`."""
        rows: dict[str, list[str]] = {}
        for r in list_entries(entries, workspace).select("entry_type", "pattern").collect():
            rows.setdefault(r.entry_type, []).append(r.pattern)
        return cls(target, *(rows.get(k, []) for k in ("domain", "subdomain", "cidr", "regex", "exclude")))


def contained(pages: DataFrame, entries: DataFrame, workspace: str, target: str = "", url: str = "url") -> DataFrame:
    """``pages`` with ``in_scope`` as ``Scope.of(entries, workspace, target).contains(url)`` has it, for any number of rules.

    Names and paths are joined: a host with the rules of its parents, a path with the rules of its openings, of the
    lengths that rules have.  Only networks and expressions, which no join can find, are read on the driver.
    """
    rules = list_entries(entries, workspace).where("pattern is not null").select("entry_type", "pattern")
    named = F.col("entry_type").isin("domain", "subdomain") | ((F.col("entry_type") == "exclude") & ~F.col("pattern").startswith("/"))
    names = rules.where(named).groupBy(F.lower("pattern").alias("key_")).agg(*[F.max(F.col("entry_type") == k).alias(k + "_") for k in ("exclude", "domain", "subdomain")])
    openings = rules.where("entry_type = 'exclude' and startswith(pattern, '/')").select(F.col("pattern").alias("opening_")).distinct()
    few = {k: [r.pattern for r in rules.where(F.col("entry_type") == k).collect()] for k in ("cidr", "regex")}
    empty = not (few["cidr"] or few["regex"]) and rules.where("entry_type in ('domain', 'subdomain')").isEmpty()
    rest = Scope(target if empty else "", cidrs=few["cidr"], regexes=few["regex"])
    rows = pages.withColumn("host_", urls.host(F.col(url))).withColumn("path_", F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))
    parts = F.split("host_", "[.]")
    parents = rows.select("host_").where("host_ is not null").distinct().select("host_", F.posexplode(F.transform(parts, lambda x, i: F.array_join(F.slice(parts, i + 1, F.size(parts) - i), "."))).alias("i", "key_"))
    hosts = parents.join(names, "key_").groupBy("host_").agg(F.max("exclude_").alias("exclude_"), F.max(F.col("domain_") | ((F.col("i") == 0) & F.col("subdomain_"))).alias("include_"))
    lengths = openings.agg(F.collect_set(F.length("opening_")).alias("lengths_"))
    opened = rows.select("path_").distinct().crossJoin(F.broadcast(lengths)).select("path_", F.explode(F.filter("lengths_", lambda n: n <= F.length("path_"))).alias("n")).select("path_", F.substring("path_", F.lit(1), F.col("n")).alias("opening_"))
    banned = opened.join(openings, "opening_", "left_semi").select("path_", F.lit(True).alias("banned_")).distinct()
    found = rows.join(hosts, "host_", "left").join(banned, "path_", "left")
    no = F.coalesce("exclude_", F.lit(False)) | F.coalesce("banned_", F.lit(False))
    return found.select(*pages.columns, (~no & (F.coalesce("include_", F.lit(False)) | rest.contains(F.col(url))) & F.col("host_").isNotNull()).alias("in_scope"))


TYPES = ("domain", "subdomain", "cidr", "regex", "exclude")


def list_entries(entries: DataFrame, workspace: str) -> DataFrame:
    return entries.where(F.col("workspace_id") == workspace).orderBy("entry_type", "created_at")


def checked(entry_type: str, pattern: str) -> tuple[str, str]:
    """A rule as it is stored: ``*.x`` becomes the domain x; a bad one raises ValueError."""
    if entry_type not in TYPES:
        raise ValueError(f"no such type of rule: {entry_type}")
    if entry_type in ("domain", "subdomain") and pattern.startswith("*."):
        entry_type, pattern = "domain", pattern[2:]
    good = {"domain": valid_domain, "subdomain": valid_domain, "cidr": valid_cidr, "regex": valid_regex}.get(entry_type, bool)
    if not good(pattern):
        raise ValueError(f"not a {entry_type}: {pattern}")
    return entry_type, pattern


def add_rule(entries: DataFrame, workspace: str, entry_type: str, pattern: str) -> DataFrame:
    kind, value = checked(entry_type, pattern)
    row = entries.sparkSession.range(1).select(F.expr("uuid()").alias("id"), F.lit(workspace).alias("workspace_id"), F.lit(kind).alias("entry_type"), F.lit(value).alias("pattern"), F.current_timestamp().alias("created_at"))
    return entries.unionByName(row)


def remove_rule(entries: DataFrame, rule_id: str) -> DataFrame:
    if entries.where(F.col("id") == rule_id).isEmpty():
        raise KeyError(rule_id)
    return entries.where(F.col("id") != rule_id)


def clear_rules(entries: DataFrame, workspace: str, entry_type: str = "") -> DataFrame:
    gone = F.col("workspace_id") == workspace
    return entries.where(~(gone & (F.col("entry_type") == entry_type) if entry_type else gone))


def upsert_config(config: DataFrame, workspace: str, **values) -> DataFrame:
    """The configuration table with the given columns of one workspace set, other columns kept or at their defaults.

    rate_limit_rps and rate_limit_burst, auth_type and auth_value, custom_headers, respect_robots are columns.
    """
    default = {"rate_limit_rps": 10.0, "rate_limit_burst": 5, "respect_robots": True}
    lit = lambda v: F.create_map(*[F.lit(x) for kv in v.items() for x in kv]) if isinstance(v, dict) else F.lit(v)
    types = dict(config.dtypes)
    key = config.sparkSession.range(1).select(F.lit(workspace).alias("workspace_id"))
    both = config.join(key.withColumn("new", F.lit(True)), "workspace_id", "full_outer")
    cols = []
    for c in config.columns:
        if c == "workspace_id":
            cols.append(F.col(c))
            continue
        old = F.coalesce(F.col(c), lit(default[c]).cast(types[c])) if c in default else F.col(c)
        value = lit(values[c]).cast(types[c]) if c in values else F.current_timestamp() if c == "updated_at" else old
        cols.append(F.when(F.col("new"), value).otherwise(F.col(c)).alias(c))
    return both.select(*cols)


def robots_rules(robots: DataFrame) -> DataFrame:
    """(host, kind, path, line) of the lines under ``User-agent: *``; of stacked agents the last one counts."""
    lines = robots.select("host", F.posexplode(F.split("body", "\n")).alias("line", "raw"))
    plain = lines.select("host", "line", F.trim(F.split_part(F.regexp_replace("raw", "\r", ""), F.lit("#"), F.lit(1))).alias("text")).where("text <> '' and instr(text, ':') > 0")
    parts = plain.select("host", "line", F.lower(F.trim(F.substring_index("text", ":", 1))).alias("kind"), F.trim(F.expr("substring(text, instr(text, ':') + 1)")).alias("path"))
    agent = F.last(F.when(F.col("kind") == "user-agent", F.col("path")), ignorenulls=True).over(Window.partitionBy("host").orderBy("line"))
    ruled = parts.withColumn("agent", agent).where("(agent = '*' and kind in ('disallow', 'allow', 'crawl-delay') and path <> '') or kind = 'sitemap'")
    return ruled.select("host", "kind", "path", "line")


def robots_allowed(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``pages`` (url) with ``allowed``: the longest rule that opens the path decides, of equal ones the ban.

    Rules are grouped by host first, so a page meets one row, whatever its host's number of pages.
    """
    lists = rules.where("kind in ('allow', 'disallow')").groupBy("host").agg(F.collect_list(F.struct("kind", "path")).alias("rules_"))
    path = F.coalesce(F.nullif(F.try_parse_url("url", F.lit("PATH")), F.lit("")), F.lit("/"))
    rows = pages.withColumn("host_", urls.host(F.col("url"))).join(lists.withColumnRenamed("host", "host_"), "host_", "left")
    longest = lambda kind: F.array_max(F.transform(F.filter("rules_", lambda r: (r["kind"] == kind) & path.startswith(r["path"])), lambda r: F.length(r["path"])))
    ban = longest("disallow")
    allowed = ban.isNull() | (F.coalesce(longest("allow"), F.lit(0)) > ban)
    return rows.withColumn("allowed", allowed).drop("host_", "rules_")


def sitemap_urls(sitemaps: DataFrame) -> DataFrame:
    """(base, loc) of the first of a base's sitemaps, by priority, that has locations; (base, priority, body) come in."""
    locs = F.filter(F.transform(F.regexp_extract_all("body", F.lit(r"(?s)<loc>\s*(.*?)\s*</loc>"), 1), lambda x: F.trim(x)), lambda x: x != "")
    full = sitemaps.withColumn("locs", locs).where(F.size("locs") > 0)
    return full.withColumn("rn", F.row_number().over(Window.partitionBy("base").orderBy("priority"))).where("rn = 1").select("base", F.explode("locs").alias("loc"))
