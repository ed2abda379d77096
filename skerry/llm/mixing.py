"""Mixing sources to target weights by hash-threshold histograms.

A document's hash is fixed by its id, so thresholds for growing budgets are nested: a larger budget takes all that a
smaller one takes.  Tokens are summed by source and hash bucket; the running sum over at most 4,096 buckets finds the
one that a budget ends in; only that bucket's documents are summed again, by the next 12 bits of their hash, until it
holds one hash.  A filter on the hash then takes the documents: nothing is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, fresh, stored, table

BITS, LEVELS = 12, 5
MAX_REPEATS = 3
#: Sources whose sizes the driver holds.
MAX_SOURCES = 1_000_000


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def doc_hash(doc_id: Column) -> Column:
    """60 bits of MD5 of the id as text; a null id hashes as the text 'null'."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = (1, 2, 3), cap: int = MAX_REPEATS) -> dict[str | None, float]:
    """Shares of the sum of all sizes by weight, sources in code-point order with null last, none above cap times its size.

    One entry per source is all this needs, so it runs on the driver.
    """
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    open_ = [(s, n, weights[i % len(weights)]) for i, (s, n) in enumerate(order)]
    total, out = sum(n for _, n in sizes), {}
    while True:
        left, w_sum = total - sum(int(x) for x in out.values()), sum(w for *_, w in open_)
        share = {s: left * w / w_sum for s, _, w in open_}
        over = [x for x in open_ if share[x[0]] > cap * x[1]]
        if not over:
            return out | share
        out |= {s: float(cap * n) for s, n, _ in over}
        open_ = [x for x in open_ if x not in over]
        if not open_:
            return out


def hash_thresholds(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """The hash threshold of each budget: (source, budget_id, threshold), a document being taken if its hash is below.

    ``sizes`` has source, hash (60 bits) and size; ``budgets`` has source, budget_id and budget (double).  The
    documents below the threshold come as near to the budget as whole documents in hash order can; those of one
    hash go together.  Null sources match each other.
    """
    begin = budgets.select(F.col("source").alias("s"), "budget_id", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"), F.lit(False).alias("done"), F.lit(1 << 60).cast("long").alias("threshold"))
    now = stored(begin)
    run = Window.partitionBy("s", "budget_id").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # at most 2**BITS rows
    for level in range(1, LEVELS + 1):
        shift = 60 - BITS * level
        open_ = now.where("not done").select("s", "budget_id", "budget", "prefix", "before")
        inside = open_.select("s", "prefix").distinct()
        same = F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("hash", shift + BITS) == F.col("prefix"))
        hist = sizes.where("size > 0").join(inside, same).groupBy("source", F.shiftright("hash", shift).alias("part"))
        hist = hist.agg(F.sum("size").alias("size"), F.min("hash").alias("low"), F.max("hash").alias("high"))
        sums = open_.join(hist, F.col("s").eqNullSafe(F.col("source")) & (F.shiftright("part", BITS) == F.col("prefix"))).withColumn("upto", F.col("before") + F.sum("size").over(run))
        end = F.min(F.when(F.col("upto") > F.col("budget"), F.struct("part", "size", "upto", "low", "high"))).alias("at")
        ends = sums.groupBy("s", "budget_id").agg(end).select(F.col("s").alias("s1"), F.col("budget_id").alias("b1"), "at")
        found = now.join(ends, F.col("s").eqNullSafe(F.col("s1")) & (F.col("budget_id") == F.col("b1")), "left")
        new = F.col("at").isNotNull()
        before = F.col("at.upto") - F.col("at.size")
        single = new & (F.col("at.low") == F.col("at.high"))
        nearer = F.col("at.upto") - F.col("budget") < F.col("budget") - before
        last = now
        now = stored(
            found.select(
                "s",
                "budget_id",
                "budget",
                F.when(new, F.col("at.part")).otherwise(F.col("prefix")).alias("prefix"),
                F.when(new, before).otherwise(F.col("before")).alias("before"),
                (F.col("done") | single | ~new).alias("done"),  # no end: the budget takes all there is
                F.when(single, F.col("at.low") + nearer.cast("long")).otherwise(F.col("threshold")).alias("threshold"),
            )
        )
        discard(last)
        if now.where("not done").isEmpty():
            break
    return now.select(F.col("s").alias("source"), "budget_id", "threshold")


def _sizes(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    return stored(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), doc_hash(F.col(id_col)).alias("hash")))


def _plan(sizes: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """(s, source_size, target, whole, rest, threshold): how often each source's documents are taken, a row per source."""
    spark = sizes.sparkSession
    by_source = stored(sizes.groupBy("source").agg(F.sum("size").alias("n")))
    if by_source.count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES:,} sources: their targets are worked out on the driver; map them to fewer")
    sums = [(r.source, r.n) for r in by_source.collect()]
    discard(by_source)
    goal = targets(sums, weights)
    schema = T.StructType([T.StructField("s", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("whole", T.LongType()), T.StructField("rest", T.DoubleType())])
    rows = [(s, n, float(goal[s]), q := int(goal[s] // n) if n else 0, float(goal[s] - q * n) if n else 0.0) for s, n in sums]
    plan = spark.createDataFrame(rows, schema)
    cut = hash_thresholds(sizes, plan.select(F.col("s").alias("source"), F.lit(0).alias("budget_id"), F.col("rest").alias("budget")))
    return stored(plan.join(cut.select(F.col("source").alias("s2"), "threshold"), F.col("s").eqNullSafe(F.col("s2")), "left").drop("s2"))


def _times(hash_: Column) -> Column:
    return F.col("whole") + F.when((F.col("rest") > 0) & (hash_ < F.col("threshold")), 1).otherwise(0)


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken.

    A source whose target is q times its size and a rest takes each document q times, and once more those below
    the hash threshold of the rest.  Null texts have size 0, null sources are one source, rows of a source with one id
    go together, a source without words has target 0, an empty table gives an empty result.  More than ``MAX_SOURCES``
    sources are an error.
    """
    sizes = _sizes(docs, id_col, source_col, text_col)
    out = sizes.join(_plan(sizes, weights), F.col("source").eqNullSafe(F.col("s")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * _times(F.col("hash"))).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mix itself: the rows of ``docs``, with its columns, each as often as :func:`mix` takes it.

    A filter on the source's threshold and the id's hash: documents are neither shuffled nor sorted.  Texts without
    words have nothing to take and are left out.
    """
    sizes = _sizes(docs, id_col, source_col, text_col)
    plan = _plan(sizes, weights)
    discard(sizes)
    names = fresh(docs, "s", "whole", "rest", "threshold", "mix_time")
    plan = plan.select(F.col("s").alias(names[0]), F.struct("whole", "rest", "threshold").alias(names[1]))
    due = F.col(names[1])
    times = due["whole"] + F.when((due["rest"] > 0) & (doc_hash(F.col(id_col)) < due["threshold"]), 1).otherwise(0)
    rows = docs.join(plan, F.col(source_col).cast("string").eqNullSafe(F.col(names[0])))
    some = rows.where(F.coalesce(F.col(text_col).cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")).where(times > 0)
    return some.withColumn(names[4], F.explode(F.sequence(F.lit(1).cast("long"), times))).select(*docs.columns)


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


SQL = r"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
         cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), 'null')), 1, 15) as bigint) as h from documents),
s as (select source, cast(sum(size) as bigint) as n from d group by source),
w as (select *, 1 + (row_number() over (order by source is null, encode(source)) - 1) % 3 as w from s),
k as (select *, sum(3 * n) over o - 3 * n as capped, sum(w) over () - (sum(w) over o - w) as w_left, sum(n) over () as total
      from w window o as (order by 3 * n / w, encode(source) rows unbounded preceding)),
c as (select *, cast(total - capped as double) * w / w_left > 3 * n as over_cap from k),
f as (select sum(case when over_cap then 3 * n else 0 end) as capped, sum(case when over_cap then 0 else w end) as w_sum from c),
t as (select c.source, c.n, c.w, case when over_cap then cast(3 * n as double) else cast(total - f.capped as double) * w / w_sum end as target from c, f),
p as (select *, case when n = 0 then 0 else cast(floor(target / n) as bigint) end as q from t),
r as (select d.doc_id, d.size, d.h, p.n, p.target, p.q, p.target - p.q * p.n as rest,
        sum(d.size) over (partition by d.source order by d.h) as upto from d join p on d.source is not distinct from p.source),
m as (select *, upto - sum(size) over (partition by n, target, h) as before from r)
select doc_id, size, n as source_size, target,
       cast(size * (q + case when rest > 0 and (upto <= rest or (before <= rest and upto - rest < rest - before)) then 1 else 0 end) as bigint) as taken
from m
"""
