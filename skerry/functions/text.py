"""Text columns: byte-exact cuts, hashes, entropy, contexts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cut(text: Column, n: int) -> Column:
    """The first ``n`` bytes and ``...`` when the text has more; as it is otherwise."""
    head = F.substring(text.cast("binary"), 1, n).cast("string")
    return F.when(F.octet_length(text) > n, F.concat(head, F.lit("..."))).otherwise(text)


def hash16(text: Column) -> Column:
    """16 hexadecimal digits of the SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def node_id(*parts: Column | str) -> Column:
    """Parts joined by ``::``."""
    return F.concat_ws("::", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def entropy(text: Column) -> Column:
    """Shannon entropy in bits: counts by character over the length in bytes; 0 for empty."""
    chars = F.split(text, "")
    n = F.octet_length(text).cast("double")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    parts = F.transform(F.array_sort(F.array_distinct(chars)), lambda c: -share(c) * F.log2(share(c)))
    return F.when(F.octet_length(text) == 0, F.lit(0.0)).otherwise(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x))


def high_entropy(text: Column, bits: float = 4.5, least: int = 20) -> Column:
    return (F.octet_length(text) >= least) & (entropy(text) >= bits)


def around(text: Column, match: Column, radius: int = 60, most: int = 200) -> Column:
    """``radius`` bytes on either side of the first occurrence; new lines as spaces, carriage returns left out."""
    raw, at = text.cast("binary"), F.instr(text, match)
    before = F.octet_length(F.substring(text, F.lit(1), at - 1))
    first = F.greatest(before - radius, F.lit(0))
    part = F.substring(raw, first + 1, before + F.octet_length(match) + radius - first).cast("string")
    return F.when(at == 0, "").otherwise(cut(F.translate(F.regexp_replace(part, "\r", ""), "\n", " "), most))


def if_empty(text: Column, other: str) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(other))


def pad_right(text: Column, n: int) -> Column:
    """Padded with spaces to ``n`` characters; never cut."""
    return F.when(F.length(text) < n, F.rpad(text, n, " ")).otherwise(text)


def between(text: Column, opening: str, closing: str) -> Column:
    """What stands between the first ``opening`` and the next ``closing``; empty if either is missing."""
    return F.regexp_extract(text, rf"(?s)\Q{opening}\E(.*?)\Q{closing}\E", 1)


def label(text: Column) -> Column:
    """Text safe in a diagram: double quotes as single, new lines as spaces, at most 80 bytes."""
    flat = F.translate(text, '"\n', "' ")
    return F.when(F.octet_length(flat) > 80, F.concat(F.substring(flat.cast("binary"), 1, 77).cast("string"), F.lit("..."))).otherwise(flat)
