"""MinHash near-deduplication, exact on what it links.

1. A scan computes each document's distinct word shingles, their number and fingerprint, 32 band keys and a signature
   of one byte per universal hash minimum.  Documents with one fingerprint are copies; one of them goes on.
2. Banding: the members of a band bucket are paired with the bucket's hub only (its least member by a hash that differs
   by band), never with each other.
3. Signature verification: pairs whose signatures agree on too few minima for a wide margin below the threshold go.
   Where that leaves a bucket's members apart, as among documents that share boilerplate, those not close to its hub are
   banded again among themselves, by the bucket and some more of their minima, and so on.
4. Large-star and small-star rounds turn the pairs into clusters that hold every pair above the threshold.
5. Within a cluster, links are decided on the full shingle sets by search over an inverted index in which each
   document, once linked, leaves the index.  Clusters of more shingles than a task should hold are cut into chunks
   and every two chunks are searched together; the links found are joined up by the same rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, lean, sliced, stored, table, utf8
from .components import components
from .hashing import batch_words, mix64, shingles

BANDS = 32
#: Largest chance that a pair right at the threshold shares no band.
MISS = 1e-4
#: Shingles of a chunk (or texts of 16 times as many bytes): 8 MB of hashes.
CHUNK = 1 << 20
_SUB = 1 << 19
#: Rounds of banding, and bands by so many further minima into which a member goes in each round after the first.
ROUNDS, FURTHER, MINIMA = 6, 4, 3
#: Signatures count as linked from this far below the threshold on, as close from this far on; 192 minima err by less.
LOW, HIGH = 0.35, 0.15


def rows_for(threshold: float, bands: int = BANDS, miss: float = MISS) -> int:
    """Minima per band: as many as keep the chance to miss a pair at the threshold below ``miss``."""
    r = 1
    while r < 16 and (1 - threshold ** (r + 1)) ** bands <= miss:
        r += 1
    return r


def _hashes(n: int) -> tuple[np.ndarray, np.ndarray]:
    g = np.random.Generator(np.random.PCG64(11))
    return g.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1), g.integers(0, 1 << 32, n, dtype=np.uint32)


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """n universal hash minima (uint32) of each set; the sets must not be empty."""
    a, b = _hashes(n)
    out = np.empty((len(sets), n), np.uint32)
    at = 0
    while at < len(sets):
        end, size = at, 0
        while end < len(sets) and (size == 0 or size + len(sets[end]) <= _SUB):
            size += len(sets[end])
            end += 1
        flat = (np.concatenate(sets[at:end]) >> np.uint64(32)).astype(np.uint32)
        first = np.cumsum([0, *(len(s) for s in sets[at : end - 1])])
        work = np.empty_like(flat)
        for i in range(n):
            np.multiply(flat, a[i], out=work)
            np.add(work, b[i], out=work)
            out[at:end, i] = np.minimum.reduceat(work, first)
        at = end
    return out


def fingerprints(sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    one = [int(mix64(s).sum(dtype=np.uint64)) if len(s) else 0 for s in sets]
    two = [int(mix64(s ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64)) if len(s) else 0 for s in sets]
    signed = lambda v: [x - (1 << 64) if x >> 63 else x for x in v]
    return signed(one), signed(two)


def text_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    h, at = batch_words(texts)
    return [shingles(h[at[i] : at[i + 1]], k) for i in range(len(texts))]


def scanner(k: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in sliced(batch, 1):
                texts = utf8(b.column(1))
                sets, size = text_sets(texts, k), [len(t) for t in texts]
                one, two = fingerprints(sets)
                full = [i for i, s in enumerate(sets) if len(s)]
                keys, sig = [None] * len(sets), [None] * len(sets)
                if full:
                    s = signatures([sets[i] for i in full], BANDS * rows)
                    acc = np.zeros((len(full), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
                    for r in range(rows):
                        acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + s.reshape(len(full), BANDS, rows)[:, :, r].astype(np.uint64))
                    small = s.astype(np.uint8)
                    for j, i in enumerate(full):
                        keys[i], sig[i] = acc[j].view(np.int64), small[j].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(size, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sig, pa.binary())],
                    ["doc_id", "n", "size", "f1", "f2", "bands", "sig"],
                )

    return lean(run)


def _alike(low: float, high: float):
    """(a, b, near, keys) of pairs (a, b, sig_a, sig_b, keys): near is 2 for an estimated similarity of ``high`` or more, 1 of ``low``, else 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in (2, 3))
            same = ((x == y).mean(1) - 1 / 256) / (1 - 1 / 256)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array((same >= low).astype(np.int32) + (same >= high)), b.column(4)], ["a", "b", "near", "keys"])

    return lean(run)


def candidates(alive: DataFrame, threshold: float, minima: int) -> DataFrame:
    """(a, b): pairs that put documents in one cluster if a chain of links can join them; ``alive`` has rep, bands and sig.

    A pair above the threshold that meets in a bucket is either linked to the same hub or banded again together: one of
    the two that is as close as HIGH to the hub has the other within LOW.
    """
    sig = alive.select("rep", "sig")
    level, out = alive.select("rep", F.explode("bands").alias("key")), []
    for depth in range(1, ROUNDS + 1):
        hub = F.min(F.struct(F.xxhash64("key", "rep").alias("o"), "rep")).alias("hub")
        hubs = level.groupBy("key").agg(hub, F.count("*").alias("m")).where("m > 1").select("key", F.col("hub.rep").alias("b"))
        pairs = level.join(hubs, "key").where("rep <> b").groupBy(F.col("rep").alias("a"), "b").agg(F.collect_set("key").alias("keys"))
        both = pairs.join(sig.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("rep").alias("b"), F.col("sig").alias("sb")), "b")
        judged = stored(both.select("a", "b", "sa", "sb", "keys").mapInArrow(_alike(threshold - LOW, threshold - HIGH), "a long, b long, near int, keys array<long>"))
        if depth > 1:
            discard(level)
        out.append(judged)
        apart = judged.where("near < 2").select(F.col("a").alias("rep"), "near", F.explode("keys").alias("key"))
        mixed = apart.groupBy("key").agg(F.min("near").alias("low"), F.count("*").alias("m")).where("low = 0 and m > 1").select("key")
        at = np.random.Generator(np.random.PCG64(depth)).integers(1, minima + 1, (FURTHER, MINIMA)).tolist()
        more = F.array(*[F.xxhash64("key", F.lit(i), *[F.substring("sig", p, 1) for p in ps]) for i, ps in enumerate(at)])
        level = stored(apart.join(mixed, "key").join(sig, "rep").select("rep", F.explode(more).alias("key")))
        if level.isEmpty():
            break
    discard(level)
    found = out[0]
    for more_found in out[1:]:
        found = found.union(more_found)
    links = stored(found.where("near > 0").select("a", "b"))
    for x in out:
        discard(x)
    return links


def linked_groups(sets: list[np.ndarray], percent: int) -> list[int]:
    """A label for each set: two get the same if a chain of links joins them.

    Breadth-first over an inverted index of the shingles; what was reached leaves the index, so a group in which
    most are linked costs about one pass over its postings.
    """
    n = np.array([len(s) for s in sets], np.int64)
    label = [-1] * len(sets)
    if len(sets) <= 4:
        for i in range(len(sets)):
            if label[i] < 0:
                label[i], todo = i, [i]
                while todo:
                    x = todo.pop()
                    for y in range(len(sets)):
                        if label[y] < 0 and n[x] and n[y]:
                            c = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                            if 100 * c >= percent * (n[x] + n[y] - c):
                                label[y] = i
                                todo.append(y)
        return label
    first = np.concatenate([[0], np.cumsum(n)])
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), n)
    flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    order = np.argsort(flat).astype(np.int32 if len(flat) < 1 << 31 else np.int64)
    flat = flat[order]
    rank = np.cumsum(np.concatenate([[False], flat[1:] != flat[:-1]])[: len(flat)], dtype=np.int32)
    ids = np.empty(len(flat), np.int32)
    ids[order] = rank
    top = int(rank[-1]) + 1 if len(rank) else 0
    del flat, order, rank
    left = np.ones(len(sets), bool)

    def index() -> tuple[np.ndarray, np.ndarray]:
        live = left[owner]
        i, o = ids[live], owner[live]
        order = np.argsort(i, kind="stable")
        return np.concatenate([[0], np.cumsum(np.bincount(i, minlength=top))]), o[order]

    start, posts = index()
    held = len(sets)
    for i in range(len(sets)):
        if not left[i]:
            continue
        left[i], label[i], todo = False, i, [i]
        while todo:
            x = todo.pop()
            if left.sum() * 2 < held:
                start, posts = index()
                held = int(left.sum())
            if not held or not n[x]:
                continue
            mine = ids[first[x] : first[x + 1]]
            lo, size = start[mine], start[mine + 1] - start[mine]
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            c = np.bincount(posts[at], minlength=len(sets))
            hit = np.flatnonzero(left & (c > 0) & (100 * c >= percent * (n[x] + n - c)))
            for y in hit.tolist():
                label[y] = i
            left[hit] = False
            todo += hit.tolist()
    return label


def _search(k: int, percent: int):
    """(a, b, many): each document (doc_id, text, cluster, i, j, many; sorted by the last four) that is not its group's least, with that one.

    Texts become shingle sets batch by batch as they come; a task holds the sets of two chunks, not their texts.
    """

    def linked(ids: list[int], sets: list[np.ndarray], many: bool) -> Iterator[pa.RecordBatch]:
        label = linked_groups(sets, percent)
        least: dict[int, int] = {}
        for d, x in zip(ids, label, strict=True):
            least[x] = min(d, least.get(x, d))
        a = [d for d, x in zip(ids, label, strict=True) if d != least[x]]
        if a:
            b = [least[x] for d, x in zip(ids, label, strict=True) if d != least[x]]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([many] * len(a))], ["a", "b", "many"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sets = None, [], []
        for batch in batches:
            for b in sliced(batch, 1):
                keys = zip(*(b.column(c).to_pylist() for c in (2, 3, 4, 5)), strict=True)
                for d, key, own in zip(b.column(0).to_pylist(), keys, text_sets(utf8(b.column(1)), k), strict=True):
                    if key != now:
                        if ids:
                            yield from linked(ids, sets, now[3])
                        now, ids, sets = key, [], []
                    ids.append(d)
                    sets.append(own)
        if ids:
            yield from linked(ids, sets, now[3])

    return lean(run)


def near_dedup(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Words are runs without 0x20 and 0x09-0x0D, A-Z lower-cased; a document's set is its distinct shingles of
    ``shingle`` words, or its whole sequence when that is shorter.  Documents are linked if 100 times the
    intersection is ``percent`` times the union or more; component_id is the smallest doc_id reachable.  Documents
    without words (null, empty, white space) are linked with nothing.  Rows that share an id are one document; a
    null id takes the component of equal sets, if any.  Other columns are ignored.
    """
    rows = rows_for(percent / 100)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scanned = stored(plain.mapInArrow(scanner(shingle, rows), "doc_id long, n long, size long, f1 long, f2 long, bands array<long>, sig binary"))
    key = ["n", "f1", "f2"]
    reps = stored(scanned.where("n > 0 and doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("rep")))
    alive = stored(scanned.select("doc_id", *key, "size", "bands", "sig").join(reps, key).where("doc_id = rep").select("rep", F.greatest("n", F.expr("size div 16")).alias("n"), "bands", "sig"))
    pairs = candidates(alive, percent / 100, BANDS * rows)
    cluster = stored(components(pairs))
    discard(pairs)
    sized = cluster.join(alive.select("rep", "n"), cluster.node == F.col("rep"))
    parts = sized.groupBy("component").agg(F.ceil(F.sum("n") / chunk).cast("int").alias("s"))
    mine = F.pmod(F.xxhash64("node"), F.col("s")).cast("int")
    dealt = cluster.join(parts, "component").withColumn("c", mine).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    dealt = dealt.select("node", F.col("component").alias("cluster"), F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), (F.col("s") > 1).alias("many"))
    order = ["cluster", "i", "j", "many"]
    with_text = plain.join(dealt, plain.doc_id == dealt.node).select("doc_id", "text", *order).repartition(*order).sortWithinPartitions(*order)
    links = stored(with_text.mapInArrow(_search(shingle, percent), "a long, b long, many boolean"))
    label = links.where("not many").select(F.col("a").alias("node"), F.col("b").alias("component")).distinct().union(components(links.where("many").select("a", "b")))
    named = reps.join(label, reps.rep == label.node, "left").select(*key, F.coalesce("component", "rep").alias("component"))
    discard(alive)
    out = scanned.select("doc_id", *key).join(named, key, "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with its columns: of each component the document with the smallest id.

    Rows that share an id count as one document, of which one row stays; rows without an id all stay.
    """
    other = fresh(docs, "kept_id")[0]
    kept = near_dedup(docs, shingle, percent, id_col, text_col).where("kept and doc_id is not null").select(F.col("doc_id").alias(other)).distinct()
    rows = docs.join(kept, F.col(id_col).cast("long") == F.col(other)).dropDuplicates([other]).select(*docs.columns)
    return rows.unionByName(docs.where(F.col(id_col).isNull()))


def op9_minhash(spark, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), shingle=3, percent=85)
