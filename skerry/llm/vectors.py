"""Near-duplicate vectors by collision-counting projections.

1. Equal vectors of a label become one representative with a multiplicity.
2. The unit vectors are projected on many random lines.  A pair collides on a line if one lies in the window centred at
   the other.  At the threshold's distance the number of collisions is binomial, which gives the least count that
   keeps the wanted recall; only pairs with that many collisions are verified, by their cosine in double precision.
3. A label of more vectors than a block holds is dealt into cells by the signs of some projections on further lines, in
   several tables of such cells: as many as leave a pair at the threshold apart in all of them with a chance below MISS,
   whatever the data (a line through the origin parts two unit vectors with a chance of their angle over pi).  A cell is
   a task; a pair counts in the first table that has it in one cell.  So work grows with n times the number of tables,
   which grows with the logarithm of n.  A cell that holds more than a block, as where vectors crowd, is cut into
   blocks, and every two blocks meet.  No pair of vectors ever leaves a task: a task returns, for each vector, its
   number of links and one edge of a spanning forest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, groups, lean, stored, table
from .components import components

LINES, WINDOW = 64, 0.1
#: Chance to miss a pair right at the threshold.
MISS = 2e-5
BLOCK = 8192


def _lines(dim: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(23)).standard_normal((LINES, dim)).T.copy()


def least_count(threshold: float, window: float = WINDOW, lines: int = LINES, miss: float = MISS) -> int:
    """The largest count that a pair at the threshold reaches but for a chance of ``miss``."""
    p = math.erf(window / math.sqrt(2 * (2 - 2 * threshold)))
    below, k = 0.0, 0
    while k < lines:
        below += math.comb(lines, k) * p**k * (1 - p) ** (lines - k)
        if below > miss:
            break
        k += 1
    return k


def tables(bits: int, threshold: float, miss: float = MISS) -> int:
    """Tables of cells by so many signs that a pair at the threshold is in one cell of some table but for a chance of ``miss``."""
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return 1 if same >= 1 else math.ceil(math.log(miss) / math.log(1 - same))


def cells(x: np.ndarray, bits: int, count: int) -> np.ndarray:
    """The cell of each vector in each table."""
    if not bits:
        return np.zeros((len(x), count), np.int64)
    lines = np.random.Generator(np.random.PCG64(29)).standard_normal((x.shape[1], bits * count))
    return ((x @ lines > 0).reshape(len(x), count, bits) << np.arange(bits)).sum(2)


def unit(lists: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of norm 1."""
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def search(x: np.ndarray, own: np.ndarray, first: int, weight: np.ndarray, threshold: float, earlier: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(links, root) of each unit vector of ``x``: the weight of the vectors linked to it, the least row of its group.

    ``own`` is 0 or 1, the block of each row; with ``first`` set only pairs across the two blocks count, which
    then are all that is asked.  Pairs with a value in common in a column of ``earlier`` count elsewhere.
    """
    n, least = len(x), least_count(threshold)
    at = x @ _lines(x.shape[1])
    order = np.argsort(at, axis=0, kind="stable")
    low, high = np.empty((n, LINES), np.int64), np.empty((n, LINES), np.int64)
    for p in range(LINES):
        line = at[order[:, p], p]
        low[:, p], high[:, p] = np.searchsorted(line, at[:, p] - WINDOW, "left"), np.searchsorted(line, at[:, p] + WINDOW, "right")
    ranks = [np.ascontiguousarray(order[:, p]) for p in range(LINES)]
    links, root = np.zeros(n, np.int64), np.arange(n)
    count = np.zeros(n, np.int16)
    for q in range(n):
        if first and own[q]:
            continue
        count[:] = 0
        for p, (a, b) in enumerate(zip(low[q].tolist(), high[q].tolist(), strict=True)):
            count[ranks[p][a:b]] += 1
        ok = count >= least
        if first:
            ok &= own == 1
        else:
            ok[: q + 1] = False
        near = np.flatnonzero(ok)
        if len(near):
            near = near[x[near] @ x[q] >= threshold]
            if earlier is not None and len(near):
                near = near[~(earlier[near] == earlier[q]).any(1)]
            links[q] += weight[near].sum()
            links[near] += weight[q]
            for o in np.unique(root[near]):
                if o != root[q]:
                    a, b = min(o, root[q]), max(o, root[q])
                    root[root == b] = a
    return links, root


def _deal(threshold: float):
    """Adds each vector's cells, by the number of bits that its label takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dim, bits = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("dim", "bits"))
            for d, k in sorted(set(zip(dim.tolist(), bits.tolist(), strict=True))):
                part = b.filter(pa.array((dim == d) & (bits == k)))
                of = cells(unit(part.column(part.schema.get_field_index("embedding"))), k, tables(k, threshold))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(of) + 1) * of.shape[1], pa.int32()), pa.array(of.ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, "cells"])

    return lean(run)


def _task(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, at, _, i, j), t in groups(batches, ["label", "dim", "at", "cell", "i", "j"]):
            ids = t.column("rep").to_numpy()
            by = np.argsort(ids, kind="stable")
            x = unit(t.column("embedding").combine_chunks())[by]
            own = (t.column("block").to_numpy() == j).astype(np.int8)[by]
            earlier = np.array(t.column("cells").combine_chunks().flatten(), np.int64).reshape(len(ids), -1)[by, :at] if at else None
            links, root = search(x, own, int(i != j), t.column("copies").to_numpy()[by], threshold, earlier)
            ids = ids[by]
            some = links > 0
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[root[some]]), pa.array(links[some])], ["a", "b", "links"])

    return lean(run)


def near_vectors(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = BLOCK) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Vectors are compared if their labels are equal and not null and their lengths are equal.  Vectors that are
    null, empty, zero, or hold null or non-finite components link with nothing and are their own component.  Rows
    repeated with one id are linked to each other like other copies; a null id counts as a link but names no
    component.
    """
    value = F.col(vector_col).cast("array<double>")
    good = F.col(label_col).isNotNull() & F.coalesce((F.size(value) > 0) & ~F.exists(value, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(value, lambda v: v != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(good, value).alias("embedding"), F.when(good, F.col(label_col).cast("string")).alias("label"))
    reps = rows.where("embedding is not null").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    reps = stored(reps.withColumn("dim", F.size("embedding")))
    # So many signs that a cell of evenly spread vectors fills a block.
    sizes = reps.where("rep is not null").groupBy("label", "dim").agg(F.greatest(F.lit(0), F.ceil(F.log2(F.count("*") / block))).cast("int").alias("bits"))
    dealt = reps.where("rep is not null").join(sizes, ["label", "dim"]).select("label", "dim", "rep", "copies", "embedding", "bits")
    held = stored(dealt.mapInArrow(_deal(threshold), "label string, dim int, rep long, copies long, embedding array<double>, bits int, cells array<long>"))
    at = held.select("label", "dim", "rep", F.posexplode("cells").alias("at", "cell"))
    cell = ["label", "dim", "at", "cell"]
    full = at.groupBy(*cell).agg(F.count("*").alias("m")).where("m > 1").withColumn("blocks", F.ceil(F.col("m") / block).cast("int"))
    each = held.select("label", "dim", "rep", "copies", "embedding", "cells", F.posexplode("cells").alias("at", "cell")).join(full, cell)
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    met = each.withColumn("block", own).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    order = [*cell, "i", "j"]
    met = met.select(*cell, F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "rep", "copies", "embedding", "cells")
    met = met.repartition(*order).sortWithinPartitions(*order)
    found = stored(met.mapInArrow(_task(threshold), "a long, b long, links long"))
    discard(held)
    label = components(found.select("a", "b"))
    named = reps.join(found.groupBy("a").agg(F.sum("links").alias("links")), F.col("rep") == F.col("a"), "left").join(label, F.col("rep") == F.col("node"), "left")
    named = named.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    linked = rows.where("embedding is not null").join(named, ["label", "embedding"]).select("vec_id", "n_links", F.coalesce("component", "vec_id").alias("component_id"))
    alone = rows.where("embedding is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op3_near_vectors(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


SQL = """
with recursive v as (
  select vec_id, label, cast(embedding as double[]) as e from embeddings
  where label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id
      where list_cosine_similarity(a.e, b.e) >= 0.98),
r(n, c) as (select vec_id, vec_id from embeddings union select l.b, r.c from r join l on l.a = r.n),
k as (select a, count(*) as n from l group by a),
m as (select n, min(c) as c from r group by n)
select e.vec_id, cast(coalesce(k.n, 0) as bigint) as n_links, m.c as component_id, e.vec_id = m.c as kept
from embeddings e join m on m.n = e.vec_id left join k on k.a = e.vec_id
"""
