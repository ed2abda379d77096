"""URL filtering by stated rules and by mined association rules; DataFrame functions and Spark's FP-growth only.

Stated rules come first: the longest that fits a URL decides.  The other URLs are judged by rules that FP-growth mines
from labelled pages: combinations of URL tokens (host labels, path segments, query fields) that go together with the label *block* with enough support and confidence.  Mined rules lie in an inverted index, each under the one of
its tokens that the fewest labelled pages have, and match the URLs that have all their tokens.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, table

#: (verdict, host, path)
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Share of the labelled pages that a combination occurs in together with the label; share of its pages that have it.
SUPPORT, CONFIDENCE = 0.001, 0.6
#: Least number of labelled pages behind a rule, so that few labels do not make rules of chance.
MIN_PAGES = 10
#: Mined rules up to this number are looked up in a literal map; more of them by a join.
LITERAL_RULES = 2000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLOCK = "\x00block"


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def stated(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does; of equally long ones the first by text."""
    rule = verdict = None
    for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if rule is None else (rule, verdict)


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL: ``h:`` host labels, ``p:`` path segments, ``q:`` names of query fields, ``v:`` fields with their values.

    Runs of digits count as one sign, so that page numbers are one token and ``casino24`` is still one.
    """
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    tagged = lambda tag, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(tag), F.regexp_replace(x, "[0-9]+", "0")))
    fields = F.split(F.lower(query), "&")
    return F.array_distinct(F.concat(tagged("h:", F.split(host, "[.-]")), tagged("p:", F.split(F.lower(path), "[/.]")), tagged("q:", F.transform(fields, lambda x: F.split_part(x, F.lit("="), F.lit(1)))), tagged("v:", F.filter(fields, lambda x: F.instr(x, "=") > 0))))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(key, tokens, confidence, support) of the mined rules; ``labelled`` has tokens (array) and bad (boolean).

    A rule with a more general one of no less confidence among its subsets is not needed and is left out.
    """
    spark = labelled.sparkSession
    schema = "key string, tokens array<string>, confidence double, support double"
    marked = stored(labelled.where(F.col("bad").isNotNull()).select(F.when(F.col("bad"), F.concat("tokens", F.array(F.lit(_BLOCK)))).otherwise(F.col("tokens")).alias("items")))
    n = marked.count()
    if n < MIN_PAGES:
        return spark.createDataFrame([], schema)
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(support, MIN_PAGES / n)), minConfidence=confidence).fit(marked)
    found = model.associationRules.where(F.col("consequent")[0] == _BLOCK).select(F.array_sort("antecedent").alias("tokens"), "confidence", "support")
    found = stored(found)
    wider = found.select(F.col("tokens").alias("t2"), F.col("confidence").alias("c2"), F.explode("tokens").alias("k"))
    covered = found.select("tokens", "confidence", F.explode("tokens").alias("k")).join(wider, "k").where((F.size("t2") < F.size("tokens")) & (F.size(F.array_except("t2", "tokens")) == 0) & (F.col("c2") >= F.col("confidence"))).select("tokens").distinct()
    kept = found.join(covered, "tokens", "left_anti")
    often = marked.select(F.explode("items").alias("key")).groupBy("key").count()
    keyed = kept.withColumn("key", F.explode("tokens")).join(often, "key").groupBy("tokens", "confidence", "support").agg(F.min_by("key", F.struct("count", "key")).alias("key"))
    return keyed.select("key", "tokens", "confidence", "support")


def _matched(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``pages`` (with unique row key ``row`` and ``tokens``) with ``mined``: whether a mined rule matches."""
    rules = stored(rules)
    head = rules.select("key", "tokens").limit(LITERAL_RULES + 1).collect()
    if not head:
        return pages.withColumn("mined", F.lit(False))
    if len(head) <= LITERAL_RULES:
        index: dict[str, list] = {}
        for r in head:
            index.setdefault(r.key, []).append(r.tokens)
        at = F.create_map(*[x for k, v in sorted(index.items()) for x in (F.lit(k), F.array(*[F.array(*map(F.lit, t)) for t in sorted(v)]))])
        hit = F.exists("tokens", lambda t: F.exists(F.coalesce(F.try_element_at(at, t), F.array().cast("array<array<string>>")), lambda r: F.size(F.array_except(r, F.col("tokens"))) == 0))
        return pages.withColumn("mined", hit)
    bags = pages.select("tokens").distinct()
    found = bags.withColumn("key", F.explode("tokens")).join(rules.select("key", F.col("tokens").alias("rule_tokens")), "key").where(F.size(F.array_except("rule_tokens", "tokens")) == 0).select("tokens").distinct()
    return pages.join(found.withColumn("mined", F.lit(True)), "tokens", "left").withColumn("mined", F.coalesce("mined", F.lit(False)))


def _labelled(pages: DataFrame, labels: DataFrame, id_col: str, url_col: str) -> DataFrame:
    """(page_id, tokens, bad) of the labelled pages."""
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("page_id"), tokens(url, host_of(url), path_of(url)).alias("tokens"))
    bad = F.when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), (F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1))
    named = labels.select(F.col("doc_id").alias("labelled_id"), bad.alias("bad")).where("bad is not null")
    return rows.join(named, F.col("page_id") == F.col("labelled_id")).select("page_id", "tokens", "bad")


def held_out_lift(pages: DataFrame, labels: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row: rules mined from four fifths of the labelled pages, and on the fifth fifth the pages, the bad ones, those that the rules match, the bad ones of these."""
    rows = stored(_labelled(pages, labels, id_col, url_col).withColumn("held", F.crc32(F.col("page_id").cast("string").cast("binary")) % 5 == 0))
    rules = stored(mine(rows.where("not held").select("tokens", "bad"), support, confidence))
    seen = _matched(rows.where("held"), rules)
    counts = seen.agg(F.count("*").alias("pages"), F.count_if("bad").alias("bad"), F.count_if("mined").alias("matched"), F.count_if(F.col("mined") & F.col("bad")).alias("matched_bad"))
    return counts.select(F.lit(rules.count()).alias("rules"), "*")


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, support: float = SUPPORT, confidence: float = CONFIDENCE, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict (allow or block).

    ``labels`` has doc_id (the page's id), quality and toxic; a page is bad if quality is 0 or toxic is 1, and
    unlabelled if both are null.  URLs that are null or have no ``://`` have empty host and path and fit no rule.
    Without labels, or without rules mined from them, what no stated rule decides is allowed.  Rows repeated come
    repeated; other columns are ignored.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")).withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule, verdict = stated(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("stated"), tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))
    mined = mine(_labelled(pages, labels, id_col, url_col).select("tokens", "bad"), support, confidence)
    out = _matched(rows, mined)
    return out.select("page_id", "host", "path", "rule", F.coalesce("stated", F.when(F.col("mined"), "block").otherwise("allow")).alias("verdict"))


def op7_url_rules(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
