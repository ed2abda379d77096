from __future__ import annotations

import random
import re

import numpy as np
import pytest
import small

from skerry.llm import hashing, minhash
from skerry.llm.common import table

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, k):
    w = WORDS.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k, percent):
    """(doc_id, n_shingles, component) by comparing all pairs that share a shingle."""
    sets = [shingle_set(t, k) for _, t in rows]
    where: dict = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    links = set()
    for i, s in enumerate(sets):
        common: dict = {}
        for x in s:
            for j in where[x]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        links |= {(rows[i][0], rows[j][0]) for j, c in common.items() if 100 * c >= percent * (len(s) + len(sets[j]) - c)}
    comp = small.components([i for i, _ in rows], links)
    return sorted((i, len(s), comp[i]) for (i, _), s in zip(rows, sets, strict=True))


def got(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_whole_table(spark, k, percent):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    out = minhash.near_dedup(docs, k, percent)
    assert got(out) == brute([(r.doc_id, r.text) for r in docs.collect()], k, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out.collect())


def test_mutated_copies(spark):
    """Chains and rings of copies with edits around the threshold, in chunks far smaller than a cluster."""
    rnd, rows = random.Random(3), []
    for g in range(12):
        base = [f"w{rnd.randrange(5000)}" for _ in range(120)]
        for _ in range(25):
            rows.append((len(rows) + 1, " ".join(base), "a"))
            for _ in range(rnd.choice((0, 1, 2, 6))):
                base[rnd.randrange(len(base))] = f"w{rnd.randrange(5000)}"
    want = brute([(i, t) for i, t, _ in rows], 3, 85)
    docs = small.documents(spark, rows)
    assert got(minhash.near_dedup(docs, 3, 85)) == want
    assert got(minhash.near_dedup(docs, 3, 85, chunk=1000)) == want


def test_awkward_rows(spark):
    out = {(r["doc_id"], r["n_shingles"]): r for r in small.rows(minhash.near_dedup(small.documents(spark), 3, 85)) if r["doc_id"]}
    assert {i: r["component_id"] for (i, _), r in out.items()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7, 8: 7, 9: 9, 10: 10, 11: 10}
    assert {i: n for i, n in out}[7] == 1 and {i: n for i, n in out}[4] == 0
    assert minhash.near_dedup(small.documents(spark)).count() == len(small.ROWS)


def test_empty(spark):
    assert minhash.near_dedup(small.documents(spark, [])).collect() == []
    assert minhash.keep_one(small.documents(spark, [])).collect() == []


def test_keep_one(spark):
    docs = small.documents(spark)
    kept = minhash.keep_one(docs, 3, 85)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 4, 5, 6, 7, 9, 10, None, None]))


def test_words_and_shingles():
    texts = ["A b\tC\x0bd", "", " \n", "x" * 10, "é b c", "a b c d"]
    h, at = hashing.batch_words([t.encode() for t in texts])
    assert np.diff(at).tolist() == [len(WORDS.findall(t)) for t in texts]
    assert (h[at[0] : at[1]] == h[at[5] : at[6]]).all()
    big = ("ab " * 900_000 + "q" * 2_500_000 + " ab").encode()
    h, _ = hashing.word_hashes(big)
    assert len(h) == 900_002 and h[0] == h[-1] and len(set(h.tolist())) == 2


def test_linked_groups_equals_pairs():
    g = np.random.default_rng(5)
    sets = [np.unique(g.integers(0, 40, 30).astype(np.uint64)) for _ in range(60)] + [np.empty(0, np.uint64)]
    links = [(i, j) for i in range(61) for j in range(i) if len(sets[i]) and 100 * len(np.intersect1d(sets[i], sets[j])) >= 55 * len(np.union1d(sets[i], sets[j]))]
    assert minhash.linked_groups(sets, 55) == list(small.components(range(61), links).values())


def test_pairs_within_boilerplate(spark):
    """Documents that share a third of their shingles with all others meet strangers in most buckets; pairs among them are found all the same."""
    rnd = random.Random(11)
    word = lambda: f"w{rnd.randrange(9000)}"
    common, rows = [word() for _ in range(80)], []
    for i in range(300):
        own = common + [word() for _ in range(80)]
        rows.append((len(rows) + 1, " ".join(own), "a"))
        if i % 6 == 0:
            for at in rnd.sample(range(len(own)), 3):
                own[at] = word()
            rows.append((len(rows) + 1, " ".join(own), "a"))
    rnd.shuffle(rows)
    want = brute([(i, t) for i, t, _ in rows], 3, 80)
    assert sum(i != c for i, _, c in want) >= 30
    assert got(minhash.near_dedup(small.documents(spark, rows), 3, 80)) == want


def test_workers_stay_small():
    """A search over two full chunks takes a small multiple of their sets, whatever the texts' sizes."""
    import subprocess
    import sys

    code = """
import resource, sys
import numpy as np, pyarrow as pa
from skerry.llm import minhash
g = np.random.default_rng(1)
words = np.array([f"word{i}" for i in range(50_000)])
base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
def batches():
    for i in range(100):
        text = " ".join(words[g.integers(0, 50_000, 20_000)])
        yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([text]), pa.array([1]), pa.array([0]), pa.array([1]), pa.array([True])], ["doc_id", "text", "cluster", "i", "j", "many"])
list(minhash._search(5, 80)(batches()))
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=str(__import__("pathlib").Path(__file__).resolve().parents[2]))
    assert int(out.stdout) < 260


def test_salted_hubs(spark, monkeypatch):
    from skerry.llm import components

    monkeypatch.setattr(components, "HOT", 5)
    rnd = random.Random(2)
    links = [(1000, i) for i in range(100)] + [(i, i + 1) for i in range(200, 230)] + [(rnd.randrange(300, 400), rnd.randrange(300, 400)) for _ in range(60)] + [(2000, i) for i in range(50, 220, 3)]
    nodes = sorted({x for a, b in links if a != b for x in (a, b)})
    out = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == small.components(nodes, [x for x in links if x[0] != x[1]])
