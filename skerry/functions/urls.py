"""URL columns: normal forms, parts and tests, as built-in expressions."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def strip_slash(url: Column) -> Column:
    """Without one final slash."""
    return F.regexp_replace(url, r"/\z", "")


def host(url: Column) -> Column:
    """Host name in lower case, without port or credentials; null where the URL cannot be parsed."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def authority(url: Column) -> Column:
    """Host and port as written."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)


def normal_domain(raw: Column) -> Column:
    """Trimmed, the host of an http(s) URL, else the text up to ``/`` and ``:``; lower case."""
    t = F.trim(raw)
    plain = F.substring_index(F.substring_index(t, "/", 1), ":", 1)
    return F.lower(F.when(t.rlike("^(?i)https?://"), F.coalesce(F.try_parse_url(t, F.lit("HOST")), plain)).otherwise(plain))


def normalize(url: Column) -> Column:
    """Normal form of an http(s) URL, empty for what is none.

    ``//`` and scheme-less texts become https; scheme and host in lower case; default port, fragment and one final
    slash go; query fields sorted by name, the order within a name kept.
    """
    t = F.trim(url)
    full = F.when(t.startswith("//"), F.concat(F.lit("https:"), t)).when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), t).otherwise(F.concat(F.lit("https://"), t))
    scheme = F.lower(F.regexp_extract(full, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    site = F.lower(F.regexp_extract(full, r"^[^:]+://([^/?#]*)", 1))
    site = F.when(scheme == "https", F.regexp_replace(site, r":443\z", "")).otherwise(F.regexp_replace(site, r":80\z", ""))
    path = F.regexp_extract(full, r"^[^:]+://[^/?#]*([^?#]*)", 1)
    fields = F.filter(F.split(F.regexp_extract(full, r"^[^:]+://[^?#]*\?([^#]*)", 1), "&"), lambda f: f != "")
    named = F.transform(fields, lambda f, i: F.struct(F.split_part(f, F.lit("="), F.lit(1)).alias("k"), i.alias("i"), F.when(F.instr(f, "=") > 0, f).otherwise(F.concat(f, F.lit("="))).alias("f")))
    query = F.array_join(F.transform(F.array_sort(named), lambda x: x["f"]), "&")
    # the final slash goes from the whole text, query included
    whole = F.concat(scheme, F.lit("://"), site, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(~scheme.isin("http", "https") | (site == "") | (t == ""), "").otherwise(strip_slash(whole))


@F.pandas_udf(StringType())
def _joined(base: pd.Series, ref: pd.Series) -> pd.Series:
    return pd.Series([urljoin(b or "", r or "") for b, r in zip(base, ref, strict=True)])


def resolve(base: Column, ref: Column) -> Column:
    """A reference against its page (RFC 3986); script, mail, phone, data and blob references come out empty.

    References from the root or with a scheme need no Python; only relative ones go through it.
    """
    r = F.trim(ref)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    plain = r.rlike(r"^/[^/]") & ~r.rlike(r"(^|/)\.\.?(/|$)")
    return F.when(r.rlike("^(?i)(javascript|mailto|tel|data|blob):"), "").when(r.rlike("^(?i)https?://"), r).when(plain, F.concat(root, r)).otherwise(_joined(base, r))


def from_root(base: Column, ref: Column) -> Column:
    """``resolve`` for references known to start with one slash; stays within code generation."""
    return F.concat(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), ref)


def looks_like_url(text: Column) -> Column:
    spaced = F.instr(text, " ") > 0
    dotted, slashed = F.instr(text, ".") > 0, F.instr(text, "/") > 0
    return (F.octet_length(text) >= 4) & (text.rlike("^https?://") | text.startswith("//") | (text.startswith("/") & dotted & ~spaced) | (dotted & slashed & ~spaced))


def shortened(url: Column) -> Column:
    """At most 80 bytes: cut at the query if it begins before, else at 77."""
    q = F.instr(url, "?")
    return F.when(F.octet_length(url) <= 80, url).when((q > 1) & (q <= 80), F.concat(F.substring(url, F.lit(1), q), F.lit("..."))).otherwise(F.concat(F.substring(url.cast("binary"), 1, 77).cast("string"), F.lit("...")))


def query_value(url: Column, name: str) -> Column:
    """The first value of a query field, decoded; null if the field is missing."""
    raw = F.regexp_extract(url, rf"[?&]{name}(?:=([^&#]*))?(?=[&#]|$)", 1)
    return F.when(has_field(url, name), F.coalesce(F.try_url_decode(raw), raw))


def has_field(url: Column, name: str) -> Column:
    return url.rlike(rf"[?&]{name}([=&#]|$)")


def field_names(url: Column) -> Column:
    """Distinct names of the query's fields, sorted."""
    fields = F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda f: f != "")
    return F.array_sort(F.array_distinct(F.transform(fields, lambda f: F.split_part(f, F.lit("="), F.lit(1)))))


def cache_key(method: Column, url: Column) -> Column:
    return F.concat_ws(":", method, url)
