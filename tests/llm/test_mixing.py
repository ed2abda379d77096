from __future__ import annotations

import re

import pytest
import small

from skerry.llm import mixing

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def test_awkward_rows(spark):
    out = small.rows(mixing.mix(small.documents(spark)))
    assert len(out) == len(small.ROWS)
    by_source: dict = {}
    for _, t, s in small.ROWS:
        by_source[s] = by_source.get(s, 0) + len(WORDS.findall(t or ""))
    sizes = {r["doc_id"]: r["size"] for r in out}
    assert sizes[4] == sizes[5] == sizes[6] == 0 and sizes[7] == sizes[8] == 2
    for r in out:
        assert r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
    assert {r["source_size"] for r in out} == set(by_source.values())


def test_near_targets_and_reruns(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 40)), "abcd"[(i * i) % 4] if i % 5 else None) for i in range(4000)]
    docs = small.documents(spark, rows)
    one, two = (sorted(map(repr, small.rows(mixing.mix(docs.repartition(n))))) for n in (3, 11))
    assert one == two
    got = small.rows(mixing.mix(docs))
    source = {i: s for i, _, s in rows}
    taken: dict = {}
    for r in got:
        taken[source[r["doc_id"]]] = taken.get(source[r["doc_id"]], 0) + r["taken"]
    for r in got:
        assert abs(taken[source[r["doc_id"]]] - r["target"]) <= 40


def test_targets():
    assert mixing.targets([("b", 100), ("a", 100), (None, 100)]) == {"a": 50, "b": 100, None: 150}
    capped = mixing.targets([("a", 1000), ("b", 1), ("c", 999)])
    assert capped["b"] == 3 and abs(sum(capped.values()) - 2000) < 1e-6
    assert mixing.targets([("a", 0), ("b", 10)]) == {"a": 0, "b": 10}
    assert mixing.targets([]) == {}


def test_nested_thresholds(spark):
    sizes = spark.createDataFrame([("a", (i * 7919 << 44) % (1 << 60), 1 + i % 3) for i in range(2000)] + [(None, 5, 4)], "source string, hash long, size long")
    budgets = spark.createDataFrame([("a", k, float(k * 400)) for k in range(6)] + [("a", 6, 1e9), (None, 0, 3.0), (None, 1, 1.0)], "source string, budget_id int, budget double")
    cut = {(r.source, r.budget_id): r.threshold for r in mixing.hash_thresholds(sizes, budgets).collect()}
    assert [cut["a", k] for k in range(7)] == sorted(cut["a", k] for k in range(7))
    for k in range(6):
        took = sum(r.size for r in sizes.collect() if r.source == "a" and r.hash < cut["a", k])
        assert abs(took - 400 * k) <= 3
    assert cut[None, 0] > 5 and cut[None, 1] <= 5


@pytest.mark.parametrize("rows", [[], [(1, None, None), (2, "", "a")]])
def test_empty(spark, rows):
    docs = small.documents(spark, rows)
    assert [(r["size"], r["taken"]) for r in small.rows(mixing.mix(docs))] == [(0, 0)] * len(rows)
    assert mixing.mixed(docs).columns == docs.columns and mixing.mixed(docs).collect() == []


def test_mixed_repeats_rows(spark):
    rows = [(i, f"w{i} x y", "a" if i % 10 else "b") for i in range(1, 201)]
    docs = small.documents(spark, rows)
    taken = {r["doc_id"]: r["taken"] // 3 for r in small.rows(mixing.mix(docs))}
    seen: dict = {}
    for r in mixing.mixed(docs).collect():
        seen[r.doc_id] = seen.get(r.doc_id, 0) + 1
    assert seen == {i: n for i, n in taken.items() if n} and max(seen.values()) == 3


def test_one_id_in_two_sources(spark):
    """Rows of one id and size in sources that are due differently often."""
    rows = [(1, "a b c", "a"), (1, "a b c", "b"), (1, "a b c", "b")] + [(i, "x y z", s) for i in range(2, 60) for s in ("a", "b", "b", None)]
    docs = small.documents(spark, rows)
    want: dict = {}
    sources = {}
    for r in small.rows(mixing.mix(docs.where("source = 'a'").unionByName(docs.where("source = 'b' or source is null")))):
        want[r["doc_id"]] = want.get(r["doc_id"], 0) + r["taken"] // 3
    seen: dict = {}
    for r in mixing.mixed(docs).collect():
        seen[r.doc_id] = seen.get(r.doc_id, 0) + 1
        sources.setdefault(r.doc_id, set()).add(r.source)
    assert seen == {i: n for i, n in want.items() if n}


def test_mixed_does_not_shuffle_documents(spark):
    plan = mixing.mixed(small.documents(spark, [(i, f"w{i}", "ab"[i % 2]) for i in range(100)]))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Sort" not in plan


def test_too_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 3)
    with pytest.raises(ValueError, match="more than 3 sources"):
        mixing.mix(small.documents(spark, [(i, "x", f"s{i}") for i in range(5)]))
