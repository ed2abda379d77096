"""The client's rules over recorded traffic: settings from a scope, retries, redirects, metrics."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.functions import endpoints as E
from skerry.sources.scratch import cut

C = F.col


def settings(config: DataFrame, rate: float = 10.0, burst: int = 5) -> DataFrame:
    """(workspace_id, rate_limit, burst, bearer, user, password, headers) of scope configurations.

    A rate of 0 or less leaves both defaults; a ``basic`` or ``header`` value without a colon sets nothing; custom
    headers come over one that the authentication sets.
    """
    kind, value = C("auth_type"), F.coalesce("auth_value", F.lit(""))
    own = C("rate_limit_rps") > 0
    two = F.instr(value, ":") > 0
    first, rest = F.substring_index(value, ":", 1), F.expr("substring(coalesce(auth_value, ''), instr(coalesce(auth_value, ''), ':') + 1)")
    none = F.create_map().cast("map<string,string>")
    custom = F.coalesce("custom_headers", none)
    head = F.when((kind == "header") & two, F.create_map(F.trim(first), F.trim(rest))).otherwise(none)
    headers = F.map_concat(F.map_filter(head, lambda k, v: ~F.map_contains_key(custom, k)), custom)
    return config.select(
        "workspace_id", F.when(own, C("rate_limit_rps")).otherwise(F.lit(rate)).alias("rate_limit"), F.when(own, C("rate_limit_burst")).otherwise(F.lit(burst)).alias("burst"),
        F.when(kind == "bearer", value).otherwise("").alias("bearer"), F.when((kind == "basic") & two, first).otherwise("").alias("user"), F.when((kind == "basic") & two, rest).otherwise("").alias("password"), headers.alias("headers"),
    )


def _waits(retries: Column, least: float, most: float) -> Column:
    """Seconds waited before so many retries."""
    each = F.transform(F.sequence(F.lit(1), F.greatest(retries, F.lit(1))), lambda i: E.backoff(i.cast("double"), least, most))
    return F.when(retries > 0, F.aggregate(each, F.lit(0.0), lambda s, x: s + x)).otherwise(0.0)


def outcomes(attempts: DataFrame, max_retries: int = 3, retry_on: Iterable[int] = (), least: float = 0.5, most: float = 10.0) -> DataFrame:
    """(request_id, outcome, status_code, error, retries, waited, bytes) of recorded attempts, a row per request.

    ``attempts`` has request_id, attempt (from 0), status_code, error and bytes.  An attempt is the last one if its
    error cannot be retried, its status need not be, or the retries are used up; later ones are not looked at.
    Requests whose recorded attempts hold no last one are ``open``.
    """
    last = F.when(C("error").isNotNull(), ~E.retry_error(C("error"))).otherwise(~E.retry_status(C("status_code"), tuple(retry_on))) | (C("attempt") >= max_retries)
    row = F.struct("attempt", "status_code", "error", "bytes")
    g = attempts.groupBy("request_id").agg(F.min(F.when(last, row)).alias("r"), F.max("attempt").alias("seen"))
    retries = F.coalesce("r.attempt", "seen").cast("int")
    outcome = F.when(C("r").isNull(), "open").when(C("r.error").isNotNull(), "failed").otherwise("successful")
    return g.select("request_id", outcome.alias("outcome"), "r.status_code", "r.error", retries.alias("retries"), _waits(retries, least, most).alias("waited"), F.when(outcome == "successful", F.greatest("r.bytes", F.lit(0))).otherwise(0).cast("long").alias("bytes"))


def metrics(done: DataFrame, cached: DataFrame | None = None) -> DataFrame:
    """One row: total_requests, successful, failed, cached, bytes_received, retries; ``cached`` (bytes) are answers from the cache."""
    sums = done.agg(F.count("*").alias("n"), F.count_if(C("outcome") == "successful").alias("good"), F.count_if(C("outcome") == "failed").alias("bad"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("size"), F.coalesce(F.sum("retries"), F.lit(0)).cast("long").alias("retries"))
    none = done.sparkSession.createDataFrame([], "bytes long")
    hits = (cached if cached is not None else none).agg(F.count("*").alias("hits"), F.coalesce(F.sum(F.greatest("bytes", F.lit(0))), F.lit(0)).alias("hit_size"))
    return sums.join(hits).select((C("n") + C("hits")).alias("total_requests"), (C("good") + C("hits")).alias("successful"), C("bad").alias("failed"), C("hits").alias("cached"), (C("size") + C("hit_size")).alias("bytes_received"), "retries")


def redirected(requests: DataFrame, hops: DataFrame, most: int = 10) -> DataFrame:
    """(request_id, url, authorization, redirects, error): where requests (request_id, url, authorization) end.

    ``hops`` (url, location) has one row for each URL that redirects.  The first request's authorization goes along
    to every host.  A request that would take more than ``most`` redirects stops where it is, with an error.
    """
    now = cut(requests.select("request_id", "url", "authorization", F.lit(0).alias("redirects"), F.lit(False).alias("done")))
    to = hops.select(C("url").alias("at"), "location")
    for _ in range(most):
        step = now.where("not done").join(to, C("url") == C("at"), "left")
        step = step.select("request_id", F.coalesce("location", "url").alias("url"), "authorization", (C("redirects") + F.when(C("location").isNotNull(), 1).otherwise(0)).alias("redirects"), C("location").isNull().alias("done"))
        now = cut(now.where("done").unionByName(step))
        if now.where("not done").isEmpty():
            break
    left = now.join(to.select("at", F.lit(True).alias("more")), C("url") == C("at"), "left")
    error = F.when(~C("done") & C("more").isNotNull(), f"stopped after {most} redirects")
    return left.select("request_id", "url", "authorization", "redirects", error.alias("error"))


def expand_home(path: Column, home: str) -> Column:
    """A leading ``~/`` as the home folder."""
    return F.when(path.startswith("~/"), F.concat(F.lit(home.rstrip("/") + "/"), F.regexp_replace(F.substring(path, 3, 1 << 30), "^/+", ""))).otherwise(path)
