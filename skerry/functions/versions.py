"""Version columns: operators stripped, keys that compare part by part."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Each operator once at most, in this order, spaces behind it included.
_OPERATORS = "^" + "".join(f"(?:{op} *)?" for op in (r"\^", "~>", "~", ">=", "<=", "!=", "~=", ">", "<", "=")) + "v?"


def bare(version: Column) -> Column:
    """Without range operators and a leading v; up to the first space, then the first comma."""
    v = F.trim(F.regexp_replace(F.trim(version), _OPERATORS, ""))
    return F.substring_index(F.substring_index(v, " ", 1), ",", 1)


def key(version: Column) -> Column:
    """The leading digits of each dotted part as numbers; of equal openings the shorter array is the smaller."""
    v = F.regexp_replace(F.regexp_replace(version, "^v", ""), "^V", "")
    return F.transform(F.split(v, "[.]"), lambda x: F.coalesce(F.nullif(F.regexp_extract(x, "^[0-9]+", 0), F.lit("")).try_cast("bigint"), F.lit(0).cast("bigint")))


def compare(a: Column, b: Column) -> Column:
    x, y = key(a), key(b)
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)
