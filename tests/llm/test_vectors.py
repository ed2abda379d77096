from __future__ import annotations

import numpy as np
import pytest
import small

from skerry.llm import vectors
from skerry.llm.common import table


def brute(rows, threshold=0.98):
    good: dict = {}
    for i, e, lab in rows:
        if lab is not None and e and all(v is not None and np.isfinite(v) for v in e) and any(e):
            good.setdefault((lab, len(e)), []).append((i, np.array(e, np.float64)))
    links = []
    for group in good.values():
        x = np.stack([v / np.abs(v).max() for _, v in group])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near = x @ x.T >= threshold
        links += [(group[a][0], group[b][0]) for a, b in zip(*np.nonzero(near), strict=True) if a != b]
    n: dict = {}
    for a, _ in links:
        n[a] = n.get(a, 0) + 1
    comp = small.components([i for i, _, _ in rows], links)
    return sorted((i, n.get(i, 0), comp[i], comp[i] == i) for i, _, _ in rows)


def got(df):
    return sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect())


def frame(spark, rows):
    from pyspark.sql import functions as F

    return spark.createDataFrame([(i, e, lab) for i, e, lab in rows], "vec_id long, embedding array<float>, label int").withColumns({c: F.lit("x") for c in ("rep", "dim", "copies", "block", "a", "links", "node")})


def test_whole_table(spark):
    t = table(spark, "/root/testdata/sf0.01", "embeddings")
    assert got(vectors.near_vectors(t)) == brute([(r.vec_id, r.embedding, r.label) for r in t.collect()])


@pytest.mark.parametrize("block", [8192, 100])
def test_clouds_about_the_threshold(spark, block):
    g = np.random.default_rng(8)
    rows = []
    for c in range(20):
        base = g.standard_normal(32)
        for _ in range(40):
            v = base + g.standard_normal(32) * g.choice([0.0, 0.05, 0.14, 0.2]) * np.linalg.norm(base) / np.sqrt(32)
            rows.append((len(rows), [float(np.float32(x)) for x in v * g.choice([1.0, 7.0])], c % 2))
    assert got(vectors.near_vectors(frame(spark, rows), block=block)) == brute(rows)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], 2), (5, [1.0, 0.0], None), (6, None, 1), (7, [0.0, 0.0], 1), (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (10, [None, 1.0], 1), (11, [], 1), (12, [1.0, 0.0, 0.0], 1), (13, [0.0, 1.0], 1), (14, [1e-30, 0.0], 1), (15, [3e38, 0.0], 1)]
    assert got(vectors.near_vectors(frame(spark, rows))) == brute(rows)
    assert vectors.near_vectors(frame(spark, [])).collect() == []


def test_recall_of_the_count():
    for t in (0.9, 0.98, 0.999):
        k = vectors.least_count(t)
        g = np.random.default_rng(1)
        d = g.standard_normal((20_000, vectors.LINES)) * np.sqrt(2 - 2 * t)
        assert ((np.abs(d) <= vectors.WINDOW).sum(1) < k).mean() <= 5e-4 and (k > 0 or t < 0.95)
