"""Not-modified revisits resolved by an as-of join to the latest earlier full response of the same canonical URL.

Records are captures: full responses, and revisits that say *not modified* (status 304 or a revisit record) and carry
at most validators and headers.  A revisit resolves to the latest full response of its URL that is strictly earlier (of
one time, the one with the largest record id).  It is then *matched* if no validator that both have disagrees and at
least one agrees, *unchecked* if they have none in common, *mismatched* if one disagrees, *orphan* if there is none
earlier.  A resolved record has the earlier body and its headers, in which those headers that a 304 may carry replace
the stored ones (RFC 9111, 3.2: all but the ones about the body and the connection).

The as-of join is a segmented scan: a URL's records are dealt by spans of time; each span carries its last full response
forward, over one row per span; so a URL that has a third of all records is no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

#: Headers that a not-modified response never changes in what is stored.
FIXED = ("content-length", "content-encoding", "content-type", "content-range", "content-md5", "transfer-encoding", "connection", "keep-alive", "proxy-authenticate", "proxy-connection", "te", "trailer", "upgrade", "set-cookie")
#: Seconds of a span.
SPAN = 6 * 3600


#: Letters that need no percent sign in a URL (RFC 3986, 2.3).
_UNRESERVED = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~"


def _decoded(text: Column) -> Column:
    """Percent-encoded letters that need not be are decoded, the hexadecimal digits of others in upper case."""
    plain = F.create_map(*[F.lit(x) for c in _UNRESERVED for x in (f"{ord(c):02X}", c)])

    def part(x: Column, i: Column) -> Column:
        code = F.upper(F.substring(x, 1, 2))
        rest = F.substring(x, 3, 1 << 30)
        return F.when(i == 0, x).when(~code.rlike("^[0-9A-F]{2}$"), F.concat(F.lit("%"), x)).otherwise(F.concat(F.coalesce(F.try_element_at(plain, code), F.concat(F.lit("%"), code)), rest))

    return F.when(F.instr(text, "%") > 0, F.array_join(F.transform(F.split(text, "%"), part), "")).otherwise(text)


def canonical(url: Column) -> Column:
    """Scheme and host in lower case, no ``www.``, no port that is the scheme's own, no fragment, tracking fields or final slash; query fields sorted.

    http and https are one; percent-encoding is normalised; null and texts without ``://`` stay as they are.
    """
    scheme = F.lower(F.regexp_extract(url, r"^([^:/?#]+)://", 1))
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[^:/?#]+://([^/?#]*)", 1)), r"^www\.", "")
    host = F.when(scheme == "http", F.regexp_replace(host, r":80$", "")).when(scheme == "https", F.regexp_replace(host, r":443$", "")).otherwise(host)
    path = F.regexp_replace(_decoded(F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)), "/+$", "")
    fields = F.filter(F.split(_decoded(F.regexp_extract(url, r"^[^:/?#]+://[^?#]*\?([^#]*)", 1)), "&"), lambda f: (f != "") & ~f.rlike("^(utm_[a-z]+|ref|gclid|fbclid)(=|$)"))
    query = F.array_join(F.array_sort(fields), "&")
    return F.when(url.rlike("^[^:/?#]+://"), F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))).otherwise(url)


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


_PAIRS = "array<struct<key:string,value:string>>"


def _pairs(records: DataFrame) -> Column:
    """The headers, a list of (name, value) in its order or a map in that of its names, as a list; those without a name are left out."""
    if isinstance(records.schema["headers"].dataType, T.MapType):
        return F.array_sort(F.map_entries("headers").cast(_PAIRS))
    return F.filter(F.col("headers").cast(_PAIRS), lambda e: e["key"].isNotNull())


def _folded(headers: Column) -> Column:
    """(k, v) of the headers by name in lower case; fields of one name are joined by commas in their order (RFC 9110, 5.2), nulls left out."""
    pairs = F.coalesce(headers, F.array().cast(_PAIRS))
    names = F.array_distinct(F.transform(pairs, lambda e: F.lower(e["key"])))

    def of(k: Column) -> Column:
        values = F.filter(F.transform(F.filter(pairs, lambda e: F.lower(e["key"]) == k), lambda e: e["value"]), lambda v: v.isNotNull())
        return F.struct(k.alias("k"), F.when(F.size(values) > 0, F.array_join(values, ", ")).alias("v"))

    return F.transform(names, of)


def merged(stored: Column, new: Column) -> Column:
    """Stored headers with the permitted new ones in their place; names in lower case, sorted."""
    allowed = F.filter(_folded(new), lambda e: ~e["k"].isin(*FIXED) & e["v"].isNotNull())
    kept = F.filter(_folded(stored), lambda e: ~F.exists(allowed, lambda a: a["k"] == e["k"]))
    return F.map_from_entries(F.array_sort(F.concat(kept, allowed)))


def resolve(records: DataFrame, span: int = SPAN) -> DataFrame:
    """One row per revisit: record_id, url_key, state, target_id, target_ts, body, headers.

    ``records`` has record_id, url, ts (timestamp), kind (response or revisit), etag, last_modified, headers
    (map of strings) and body; other columns are ignored.  Records without time or URL resolve nothing and are, as
    revisits, orphans.  Validators are the entity tag, weak and strong ones being equal, and Last-Modified as text.
    Header names that differ only in case are one field.  Responses are told apart by their content where their ids are
    null or repeat: of those of one time, URL and id one is taken, the same on every run.
    """
    rows = records.select("record_id", canonical(F.col("url")).alias("url_key"), "ts", "kind", "etag", "last_modified", _pairs(records).alias("headers"), "body", F.floor(F.unix_micros("ts") / (span * 1_000_000)).alias("span"))
    content = F.xxhash64("url_key", "ts", "record_id", "etag", "last_modified", "body", F.to_json("headers"))
    full = rows.where("kind = 'response' and ts is not null and url_key is not null").withColumn("content", content)
    mark = F.struct("ts", "record_id", "content", "etag", "last_modified")
    # Which response is the latest needs no bodies: those come by the response's id afterwards.
    last = full.groupBy("url_key", "span").agg(F.max(mark).alias("latest"))
    spans = rows.where("kind = 'revisit' and ts is not null and url_key is not null").select("url_key", "span").distinct().join(last, ["url_key", "span"], "full_outer")
    ahead = Window.partitionBy("url_key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)  # a row per span
    carried = spans.select("url_key", "span", F.last("latest", ignorenulls=True).over(ahead).alias("carried"))
    events = full.select("url_key", "span", "ts", mark.alias("full"), F.lit(None).cast("bigint").alias("record_id"), "etag", "last_modified", F.lit(None).cast(_PAIRS).alias("headers"))
    asks = rows.where("kind = 'revisit'").select("url_key", "span", "ts", F.lit(None).cast(events.schema["full"].dataType).alias("full"), "record_id", "etag", "last_modified", "headers")
    good = asks.where("ts is not null and url_key is not null")
    seen = events.unionByName(good)
    order = Window.partitionBy("url_key", "span").orderBy("ts", F.col("full").isNotNull(), F.col("full.record_id"), F.col("full.content")).rowsBetween(Window.unboundedPreceding, -1)
    # Revisits sort before the responses of their own time: strictly earlier ones only
    near = seen.withColumn("here", F.last("full", ignorenulls=True).over(order)).where("full is null")
    found = near.join(carried, ["url_key", "span"]).withColumn("target", F.coalesce("here", "carried")).select("record_id", "url_key", "etag", "last_modified", "headers", "target")
    lost = asks.where("ts is null or url_key is null").select("record_id", "url_key", "etag", "last_modified", "headers", F.col("full").alias("target"))
    asked = found.unionByName(lost)
    tag = _weak(F.col("etag")) == _weak(F.col("target.etag"))
    date = F.col("last_modified") == F.col("target.last_modified")
    state = F.when(F.col("target").isNull(), "orphan").when((~F.coalesce(tag, F.lit(True))) | (~F.coalesce(date, F.lit(True))), "mismatched").when(F.coalesce(tag, date).isNotNull(), "matched").otherwise("unchecked")
    asked = asked.select("record_id", "url_key", "headers", state.alias("state"), F.col("target.record_id").alias("target_id"), F.col("target.ts").alias("target_ts"), F.col("target.content").alias("content"))
    source = full.select(F.col("content").alias("c"), F.col("url_key").alias("u"), F.col("ts").alias("t"), F.col("headers").alias("source_headers"), F.col("body").alias("source_body"))
    source = source.dropDuplicates(["c", "u", "t"])  # the key of the join, so both take one shuffle
    usable = F.col("state").isin("matched", "unchecked")
    own = (F.col("content") == F.col("c")) & (F.col("url_key") == F.col("u")) & (F.col("target_ts") == F.col("t"))
    out = asked.join(source, usable & own, "left")
    return out.select("record_id", "url_key", "state", "target_id", "target_ts", F.when(usable, F.col("source_body")).alias("body"), F.when(usable, merged(F.col("source_headers"), F.col("headers"))).otherwise(merged(F.lit(None).cast(_PAIRS), F.col("headers"))).alias("headers"))


def captures(pages: DataFrame) -> DataFrame:
    """WARC-like captures made from ``pages``: each page a full response at a time told by its id, and three revisits of it.

    A page's revisits come 1, 2 and 3 days later: with its entity tag, with another one, without validators.  Other
    captures of one canonical URL fall in between as their ids have it.
    """
    t = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id") % 997 * 3600 + F.floor(F.col("page_id") / 997))
    tag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 12), F.lit('"'))
    changed = F.date_format(t, "yyyy-MM-dd HH:mm:ss")
    full = pages.select(
        (F.col("page_id") * 4).alias("record_id"), "url", t.alias("ts"), F.lit("response").alias("kind"), tag.alias("etag"), changed.alias("last_modified"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Cache-Control"), F.lit("max-age=60"), F.lit("ETag"), tag).alias("headers"), F.col("html").alias("body"),
    )
    again = pages.withColumn("k", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])))
    own = F.when(F.col("k") == 1, F.concat(F.lit("W/"), tag)).when(F.col("k") == 2, F.lit('"other"'))
    revisit = again.select(
        (F.col("page_id") * 4 + F.col("k")).alias("record_id"), "url", (t + F.make_dt_interval(F.col("k"))).alias("ts"), F.lit("revisit").alias("kind"), own.alias("etag"), F.lit(None).cast("string").alias("last_modified"),
        F.create_map(F.lit("cache-control"), F.concat(F.lit("max-age="), F.col("k").cast("string")), F.lit("Content-Length"), F.lit("0")).alias("headers"), F.lit(None).cast("string").alias("body"),
    )
    return full.unionByName(revisit)


def op2_warc_revisits(spark, sf_dir: str) -> DataFrame:
    """Digest: record_id, url_key, state, target_id, n_body (characters), cache_control, n_headers."""
    out = resolve(captures(table(spark, sf_dir, "pages")))
    return out.select("record_id", "url_key", "state", "target_id", F.length("body").cast("long").alias("n_body"), F.col("headers")["cache-control"].alias("cache_control"), F.size("headers").cast("long").alias("n_headers"))


SQL = r"""
with p as (
  select page_id, html, 1700000000 + page_id % 997 * 3600 + page_id // 997 as t,
         '"' || substr(md5(html), 1, 12) || '"' as tag,
         regexp_replace(regexp_replace(lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)), '^www\.', ''),
                        case when lower(url) like 'https:%' then ':443$' else ':80$' end, '')
         || regexp_replace(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '/+$', '')
         || case when len(f) > 0 then '?' || array_to_string(list_sort(f), '&') else '' end as url_key
  from (select *, list_filter(string_split(regexp_extract(url, '^[^:/?#]+://[^?#]*\?([^#]*)', 1), '&'),
               lambda x: x <> '' and not regexp_matches(x, '^(utm_[a-z]+|ref|gclid|fbclid)(=|$)')) as f from pages)),
r as (select page_id * 4 + k as record_id, url_key, t + 86400 * k as t, k,
             case k when 1 then tag when 2 then '"other"' end as tag from p, (values (1), (2), (3)) v(k)),
j as (select r.*, p.page_id * 4 as target_id, p.tag as have, p.html,
             row_number() over (partition by r.record_id order by p.t desc nulls last, p.page_id desc) as rn
      from r left join p on p.url_key = r.url_key and p.t < r.t),
s as (select *, case when target_id is null then 'orphan' when tag <> have then 'mismatched' when tag = have then 'matched' else 'unchecked' end as state
      from j where rn = 1)
select record_id, url_key, state, target_id,
       case when state in ('matched', 'unchecked') then cast(length(html) as bigint) end as n_body,
       'max-age=' || k as cache_control, cast(case when state in ('matched', 'unchecked') then 3 else 1 end as bigint) as n_headers
from s
"""
