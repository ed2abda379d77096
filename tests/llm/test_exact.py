from __future__ import annotations

import hashlib

import small

from skerry.llm import exact


def brute(rows):
    groups: dict = {}
    for i, t, _ in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t, _ in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        top = max(ids) if ids else None
        out.append((i, top, len(groups[t or ""]), i == top, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(map(repr, out))


def got(df):
    return sorted(repr((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256)) for r in df.collect())


def test_awkward_rows(spark):
    assert got(exact.exact_dedup(small.documents(spark))) == brute(small.ROWS)


def test_splitting_index(spark):
    rows = [(i, f"text {i % 700} " * 20, "a") for i in range(3000)]
    assert got(exact.exact_dedup(small.documents(spark, rows), capacity=2_000)) == brute(rows)


def test_empty(spark):
    assert exact.exact_dedup(small.documents(spark, [])).collect() == []
    assert exact.keep_one(small.documents(spark, [])).collect() == []


def test_keep_one(spark):
    docs = small.documents(spark)
    kept = exact.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [2, 3, 5, 6, 7, 8, 9, 10, 11, None]))


def test_directory():
    d = exact.Directory()
    for b in (0, 1, 0):
        d.split(b)
    assert len(d.slots) == 1 << d.depth and sorted(set(d.slots)) == list(range(4))
    for b, local in enumerate(d.depth_of):
        assert d.slots.count(b) == 1 << (d.depth - local)
    sizes = {i: (i % 7) ** 3 for i in range(64)}
    built = exact.Directory.built(sizes, 6, 300)
    load = [0] * len(built.depth_of)
    for i, n in sizes.items():
        load[built.slots[i >> (6 - built.depth)]] += n
    assert max(load) <= 343 and sum(load) == sum(sizes.values())


def test_colliding_keys_are_compared_by_bytes():
    import pyarrow as pa

    b = pa.RecordBatch.from_arrays([pa.array([5, 5, 5], pa.int64()), pa.array(["x", "y", "x"]), pa.array([b"x", b"y", b"x"], pa.binary()), pa.array([1, 2, 3], pa.int64()), pa.array([1, 1, 4], pa.int64())], ["key", "sha", "body", "top", "n"])
    rows = [r for out in exact._own(iter([b])) for r in out.to_pylist()]
    assert sorted((r["sha"], r["keep_id"], r["group_size"]) for r in rows) == [("x", 3, 5), ("y", 2, 1)]
