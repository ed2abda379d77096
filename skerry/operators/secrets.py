"""Secret scanning: patterns over texts to findings.

All patterns are unrolled into one projection of literal expressions, so each is compiled once a task and the scan stays
within code generation.  A pattern is tried only on texts that contain the longest literal all its matches must have.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.functions import text as T
from skerry.sources.dims import Pattern, secret_patterns

SEVERITIES = ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")


def suspicious_text(text: Column) -> Column:
    """A placeholder word anywhere in the text makes all of its findings false ones."""
    return F.lower(text).rlike("your[-_]|xxxx")


def false_positive(match: Column, text: Column) -> Column:
    return suspicious_text(text) | (F.instr(F.lower(match), "placeholder") > 0) | (F.octet_length(match) < 8)


def required(regex: str) -> tuple[list[str], bool]:
    """(literals, whether case is ignored): texts of which each match of ``regex`` has one in it at least; empty if none are known."""
    tree = _parser.parse(regex)

    def walk(items) -> list[list[str]]:
        """Lists of literals, each such that any match of ``items`` has one of them; the first is of whole matches, or empty."""
        now, sure, whole = [""], [], True
        for op, arg in items:
            if op is C.LITERAL:
                now = [x + chr(arg) for x in now]
                continue
            plain = op is C.SUBPATTERN and not arg[1] and not arg[2]
            inner = [walk(arg[3])] if plain else [walk(x) for x in arg[1]] if op is C.BRANCH else []
            if inner and all(x[0] for x in inner) and len(now) * sum(len(x[0]) for x in inner) <= 64:
                now = [x + y for x in now for z in inner for y in z[0]]
                continue
            if op is C.AT:
                continue
            # what stands before goes on with the beginnings of what follows
            lead = [y for x in inner for y in x[0] or x[1]] if len(inner) <= 64 else []
            sure.append([x + y for x in now for y in lead] if lead and len(now) * len(lead) <= 64 else now)
            if inner:
                best = [max(x, key=worth) for x in inner]
                sure.append([y for x in best for y in x])
                if len(inner) == 1:
                    sure += inner[0]
            now, whole = [""], False
        return [now if whole else [], *sure, now]

    def worth(x: list[str]) -> tuple[int, int]:
        return min(map(len, x), default=-1), -len(x)

    best = list(dict.fromkeys(max(walk(tree), key=worth)))
    return (best, bool(tree.state.flags & re.IGNORECASE)) if worth(best)[0] > 1 and all(x.isascii() for x in best) else ([], False)


def _may_match(p: Pattern, text: Column, low: Column) -> Column:
    """Plain searches that spare most texts most expressions; they never turn a match away."""
    literals, any_case = required(p.regex)
    out = F.lit(not literals)
    for x in dict.fromkeys(x.lower() if any_case else x for x in literals):
        out = (low if any_case else text).contains(x) | out
    return out


def _groups(p: Pattern) -> int:
    return re.compile(p.regex).groups


def _value(p: Pattern, match: Column) -> Column:
    """Group 2, or group 1 if it is not much shorter than the match, or the match."""
    n = _groups(p)
    if not n:
        return match
    one = F.regexp_extract(match, "(?d)" + p.regex, 1)
    plain = F.when((one != "") & (F.length(one) >= F.length(match) - 10), one).otherwise(match)
    if n < 2:
        return plain
    two = F.regexp_extract(match, "(?d)" + p.regex, 2)
    return F.when(two != "", two).otherwise(plain)


def scan(texts: DataFrame, patterns: Sequence[Pattern] | None = None, min_severity: int = 0, max_findings: int = 0) -> DataFrame:
    """Findings of ``texts`` (text, source): one row per distinct (type, match cut to 80 bytes) of a source.

    Of patterns that find the same, the first in the list wins.  ``max_findings`` keeps that many a source, in the
    list's order.  Null texts have no findings.
    """
    rows = list(patterns if patterns is not None else secret_patterns())
    ps = [(i, p) for i, p in enumerate(rows) if p.severity >= min_severity]

    def matches(i: int, p: Pattern) -> Column:
        all_ = F.regexp_extract_all("text", F.lit("(?d)" + p.regex), 0)
        some = F.when(_may_match(p, F.col("text"), F.col("low")), all_).otherwise(F.array().cast("array<string>"))
        return F.transform(F.array_distinct(some), lambda m: F.struct(F.lit(i).alias("ord"), m.alias("full")))

    found = F.flatten(F.array(*[matches(i, p) for i, p in ps]))
    hits = texts.where("text is not null").where(~suspicious_text(F.col("text"))).withColumn("low", F.lower("text")).select("text", "source", F.posexplode(found).alias("pos", "hit")).select("text", "source", "pos", "hit.*").where(~false_positive(F.col("full"), F.lit("")))

    def by(fn) -> Column:
        out = None
        for i, p in ps:
            c = fn(p)
            c = c if isinstance(c, Column) else F.lit(c)
            out = F.when(F.col("ord") == i, c) if out is None else out.when(F.col("ord") == i, c)
        return out

    cols = hits.select("source", "ord", "pos", by(lambda p: p.type).alias("secret_type"), by(lambda p: p.severity).alias("severity"), by(lambda p: p.provider).alias("provider"), by(lambda p: p.key).alias("key"), "full", T.cut(F.col("full"), 80).alias("match"), T.around(F.col("text"), F.col("full")).alias("context"))
    first = Window.partitionBy("secret_type", "match", "source").orderBy("ord", "pos")
    out = cols.withColumn("rn", F.row_number().over(first)).where("rn = 1")
    if max_findings:
        out = out.withColumn("rn", F.row_number().over(Window.partitionBy("source").orderBy("ord", "pos"))).where(F.col("rn") <= max_findings)
    # so many expressions do not compile, and would hold up the scan if they stood in its stage
    out = out.withColumn("value0", by(lambda p: _value(p, F.col("full"))))
    return out.select("secret_type", "severity", "provider", "key", "match", T.cut(F.col("value0"), 200).alias("value"), "source", "context", T.entropy(F.col("value0")).alias("entropy"))


def runtime_texts(runtime: DataFrame) -> DataFrame:
    """(url, text, source) of all that a recorded visit holds: headers, URLs, cookies, storage, databases, sockets."""
    pair = lambda k, v, sep="=": F.concat(k, F.lit(sep), v)

    def part(array: str, text, source) -> DataFrame:
        return runtime.select("url", F.explode(array).alias("x")).select("url", text.alias("text"), source.alias("source"))

    x = lambda n: F.col(f"x.{n}")
    headers = runtime.select("url", F.explode("requests").alias("x")).select("url", x("url").alias("at"), F.explode(x("headers")).alias("k", "v")).select("url", pair(F.col("k"), F.col("v"), ": ").alias("text"), F.concat(F.lit("header:"), F.col("at")).alias("source"))
    out = headers.unionByName(part("requests", x("url"), F.lit("url")))
    out = out.unionByName(part("cookies", pair(x("name"), x("value")), F.concat(F.lit("cookie:"), x("domain"))))
    for name, source in (("local_storage", "localStorage"), ("session_storage", "sessionStorage")):
        out = out.unionByName(part(name, pair(x("key"), x("value")), F.lit(source)))
    idb = runtime.select("url", F.explode("indexed_db").alias("d")).select("url", F.col("d.database").alias("db"), F.explode("d.stores").alias("s")).select("url", "db", F.explode("s.records").alias("text"))
    return out.unionByName(idb.select("url", "text", F.concat(F.lit("indexedDB:"), F.col("db")).alias("source"))).unionByName(part("web_sockets", x("url"), F.lit("websocket")))


def scan_runtime(runtime: DataFrame, min_severity: int = 0) -> DataFrame:
    return scan(runtime_texts(runtime).select("text", "source").distinct(), min_severity=min_severity)
