"""Crawling as a frontier over recorded pages, and the stateful parts of a client replayed over events."""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skerry.functions import urls
from skerry.operators.scope import Scope, robots_allowed
from skerry.sources.scratch import cut


def frontier(links: DataFrame, seeds: DataFrame, max_depth: int = 3, max_pages: int = 0, scope: Scope | None = None, robots: DataFrame | None = None) -> DataFrame:
    """(url, depth) of the pages that a breadth-first crawl reaches along ``links`` (src, dst) from ``seeds`` (url).

    Links are normalised and held against scope and robots rules once, before the first round; a round is one
    join of the last depth's pages and one anti-join.  Nothing is dropped when buffers are full; ``max_pages``
    keeps the first by (depth, url).
    """
    edges = links.select("src", urls.normalize(F.col("dst")).alias("url")).where("url <> ''").distinct()
    if scope is not None:
        edges = edges.where(scope.contains(F.col("url")))
    if robots is not None:
        edges = robots_allowed(edges, robots).where("allowed").drop("allowed")
    edges = cut(edges.select(urls.normalize(F.col("src")).alias("src"), "url"))
    found = seeds.select(urls.normalize(F.col("url")).alias("url")).where("url <> ''").distinct().withColumn("depth", F.lit(0))
    found = cut(found)
    for depth in range(1, max_depth + 1):
        last = found.where(F.col("depth") == depth - 1).select(F.col("url").alias("at"))
        new = cut(edges.join(last, F.col("src") == F.col("at")).select("url").distinct().join(found.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth)))
        if new.isEmpty():
            break
        found = found.unionByName(new)
    return found.orderBy("depth", "url").limit(max_pages) if max_pages else found


def stats(pages: DataFrame) -> DataFrame:
    """Pages, links, assets, errors and bytes of crawled pages (links, assets, size, error)."""
    return pages.agg(F.count("*").alias("pages"), F.coalesce(F.sum(F.size("links")), F.lit(0)).alias("links"), F.coalesce(F.sum(F.size("assets")), F.lit(0)).alias("assets"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def distinct_stream(stream: DataFrame, wait: str = "1 hour") -> DataFrame:
    """A stream (url, ts) with each normalised URL once within the watermark; its state is bounded by the watermark."""
    return stream.withColumn("url", urls.normalize(F.col("url"))).where("url <> ''").withWatermark("ts", wait).dropDuplicatesWithinWatermark(["url"])


def counts_stream(stream: DataFrame, window: str = "10 minutes", wait: str = "1 hour") -> DataFrame:
    """Requests and failures of a stream (ts, url, status_code) by host and window."""
    w = F.window("ts", window)
    return stream.withWatermark("ts", wait).groupBy(w.alias("w"), urls.host(F.col("url")).alias("host")).agg(F.count("*").alias("requests"), F.count_if(F.col("status_code") >= 400).alias("failures")).select(F.col("w.start").alias("start"), "host", "requests", "failures")


def token_bucket(events: DataFrame, rate: float = 10.0, burst: int = 5) -> DataFrame:
    """``events`` (key, event_id, ts) with the tokens left and the wait in seconds that a bucket gives each of them.

    Rows are dealt by key and sorted in their partition, and each key is folded as a stream: its memory is one
    number, not the key's rows.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, tokens, at = None, float(burst), 0.0
        for p in parts:
            left, wait = [], []
            for k, t in zip(p["key"], p["t"], strict=True):
                if k != key:
                    key, tokens, at = k, float(burst), t
                now = max(t, at)
                tokens = min(float(burst), tokens + (now - at) * rate)
                delay = max(0.0, (1.0 - tokens) / rate)
                tokens, at = max(tokens, 1.0) - 1.0, now + delay
                left.append(round(tokens, 6))
                wait.append(round(at - t, 6))
            yield pd.DataFrame({"key": p["key"], "event_id": p["event_id"], "tokens": left, "wait": wait})

    rows = events.select(F.col("key").cast("string").alias("key"), F.col("event_id").cast("long").alias("event_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return rows.repartition("key").sortWithinPartitions("key", "t", "event_id").mapInPandas(run, "key string, event_id long, tokens double, wait double")


def cache_hits(events: DataFrame, ttl: float = 60.0, cleared: Sequence[float] = ()) -> DataFrame:
    """``events`` (key, event_id, ts) with ``hit``: whether an entry of the key, filled by a miss, is not older than ``ttl``.

    An entry keeps the time at which it was filled, so hits do not prolong it: a fold over the key's events, read as a
    stream.  With a column ``op``, rows of ``delete`` drop the key's entry and come out with a null ``hit``;
    ``cleared`` are the times, in seconds, at which the whole cache was emptied.
    """
    times = sorted(cleared)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, filled = None, None
        for p in parts:
            hit = []
            for k, t, gone in zip(p["key"], p["t"], p["gone"], strict=True):
                if k != key:
                    key, filled = k, None
                if gone:
                    filled = None
                    hit.append(None)
                    continue
                ok = filled is not None and t - filled <= ttl and bisect.bisect_right(times, filled) == bisect.bisect_right(times, t)
                hit.append(ok)
                filled = filled if ok else t
            yield pd.DataFrame({"key": p["key"], "event_id": p["event_id"], "hit": pd.array(hit, dtype="boolean")})

    gone = F.coalesce(F.col("op") == "delete", F.lit(False)) if "op" in events.columns else F.lit(False)
    rows = events.select(F.col("key").cast("string").alias("key"), F.col("event_id").cast("long").alias("event_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), gone.alias("gone"))
    return rows.repartition("key").sortWithinPartitions("key", "t", "event_id").mapInPandas(run, "key string, event_id long, hit boolean")


def cache_stats(hits: DataFrame) -> DataFrame:
    """One row: hits and misses."""
    return hits.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


def errors(pages: DataFrame) -> DataFrame:
    """(url, error) of the crawled pages that failed."""
    return pages.where(F.col("error").isNotNull()).select("url", "error")


def first_response(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests (url, seq, ...) with the response of the same URL and rank: the earliest open request takes the next one."""
    rank = lambda df: df.withColumn("k", F.row_number().over(Window.partitionBy("url").orderBy("seq")))
    got = rank(responses).select("url", "k", F.col("status_code").alias("got_status"), F.col("headers").alias("got_headers"))
    return rank(requests).join(got, ["url", "k"], "left").drop("k")
