"""Results of Spark and of DuckDB as comparable rows."""

from __future__ import annotations

import datetime
import decimal
import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    """A value in a form that is the same from both engines."""
    if isinstance(x, dict):
        return {k: plain(v) for k, v in sorted(x.items())}
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (bytes, bytearray)):
        return bytes(x).hex()
    return x


def spark_rows(df) -> tuple[list[str], list]:
    names = sorted(df.columns)
    return names, sorted((repr([plain(r[n]) for n in names]) for r in df.collect()))


def duck_rows(sf_dir: str, sql: str) -> tuple[list[str], list]:
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    got = con.execute(sql)
    heads = [d[0] for d in got.description]
    names = sorted(heads)
    at = [heads.index(n) for n in names]
    return names, sorted(repr([plain(r[i]) for i in at]) for r in got.fetchall())


def difference(left: tuple, right: tuple) -> str:
    """What differs, empty if nothing does."""
    if left[0] != right[0]:
        return f"columns {left[0]} and {right[0]}"
    if left[1] == right[1]:
        return ""
    from collections import Counter

    a, b = Counter(left[1]), Counter(right[1])
    return f"{len(left[1])} and {len(right[1])} rows; only Spark: {list((a - b).items())[:3]}; only SQL: {list((b - a).items())[:3]}"
