"""What scripts and styles refer to, as array columns of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skerry.functions import urls

_Q = "['\"]([^'\"]+)['\"]"


def _all(text: Column, regex: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit("(?d)" + regex), group)


def quoted(text: Column) -> Column:
    """Texts between equal quotes, for each kind of quote by itself."""
    out = [F.filter(F.transform(F.split(text, q), lambda x, i: F.when(i % 2 == 1, x)), lambda x: x.isNotNull()) for q in ('"', "'", "`")]
    return F.concat(*out)


def script_urls(text: Column) -> Column:
    return F.array_distinct(F.filter(quoted(text), urls.looks_like_url))


def dynamic_imports(text: Column) -> Column:
    return F.array_distinct(_all(text, rf"import\s*\(\s*{_Q}\s*\)"))


def webpack_chunks(text: Column) -> Column:
    """Public paths as often as they come; chunk hashes, chunk names and loaded chunks once each."""
    rest = F.concat(_all(text, r"['\"]chunk-([a-f0-9]+)['\"]"), _all(text, rf"import\s*\(\s*/*\s*webpackChunkName\s*:\s*{_Q}"), _all(text, rf"__webpack_chunk_load__\({_Q}\)"))
    return F.concat(_all(text, rf"__webpack_public_path__\s*=\s*{_Q}"), F.array_distinct(rest))


def vite_assets(text: Column) -> Column:
    meta = r"import\.meta\."
    return F.array_distinct(F.concat(_all(text, rf"new\s+URL\s*\(\s*{_Q}\s*,\s*{meta}url\s*\)"), _all(text, rf"{meta}glob\s*\(\s*{_Q}")))


def source_maps(text: Column) -> Column:
    """Structs (url, inline, inline_data); a data URI is inline, its payload what follows ``base64,``."""
    line, block = _all(text, r"(?m)^[ \t]*//[#@]\s*sourceMappingURL=(.+)$"), _all(text, r"/\*\s*[#@]\s*sourceMappingURL=(.+?)\s*\*/")
    found = F.array_distinct(F.transform(F.concat(line, block), lambda u: F.trim(u)))  # F.trim itself would take the index as letters to trim
    inline = lambda u: u.startswith("data:")
    return F.transform(found, lambda u: F.struct(u.alias("url"), inline(u).alias("inline"), F.when(inline(u), F.regexp_extract(u, "base64,(.*)$", 1)).otherwise("").alias("inline_data")))


def scan(text: Column) -> Column:
    """The five lists of one script."""
    return F.struct(script_urls(text).alias("script_urls"), dynamic_imports(text).alias("dynamic_imports"), webpack_chunks(text).alias("webpack_chunks"), vite_assets(text).alias("vite_assets"), source_maps(text).alias("source_maps"))


def css_urls(text: Column) -> Column:
    """``url(...)`` not within the page, then quoted imports."""
    bare = F.transform(_all(text, r"url\(([^)]*)\)"), lambda u: F.trim(F.regexp_replace(F.trim(u), "^['\"]|['\"]$", "")))
    return F.concat(F.filter(bare, lambda u: (u != "") & ~u.startswith("#")), _all(text, rf"@import\s+{_Q}"))


def hash_fragments(text: Column) -> Column:
    return F.array_distinct(_all(text, "#!?/[^\\s\"'<>]*", 0))


def asset_type(preload: Column) -> Column:
    """Of a preload's ``as``."""
    out = F.lit("unknown")
    for k, v in {"script": "js", "style": "css", "image": "image", "font": "font", "video": "video", "audio": "audio", "fetch": "fetch"}.items():
        out = F.when(F.lower(preload) == k, v).otherwise(out)
    return out
