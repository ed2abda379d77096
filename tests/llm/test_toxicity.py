from __future__ import annotations

import itertools
import random
import zlib

import pytest
import small

from skerry.llm import toxicity
from skerry.llm.common import table


def distance(a, b):
    """Edits, a swap of neighbours counting as one, none of them edited twice."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_accepts_what_is_within_the_edits():
    rnd = random.Random(4)
    terms = ["bad", "abacus", "bcabdcab", "aabbccdda", "dcbadcbad", "caba"]
    auto = toxicity.Automaton(toxicity.Lexicon({t: 1.0 for t in terms}, {}, frozenset(["abacus"])))
    allowed = {t: 0 if t == "abacus" else toxicity.edits(t) for t in terms}
    for _ in range(6000):
        w = list(rnd.choice(terms))
        for _ in range(rnd.randrange(4)):
            at = rnd.randrange(len(w) + 1)
            w[at : at + rnd.choice((0, 1, 1, 2))] = rnd.choice((["a"], ["c"], [], w[at : at + 2][::-1]))
        w = "".join(w)
        if w:
            best = min((distance(w, t) for t in terms if distance(w, t) <= allowed[t]), default=None)
            m = auto.match(w)
            assert (m and m[1]) == best, w


def test_context_tells_quotation_from_abuse():
    m = toxicity.Matcher(toxicity.Lexicon({"grumblefix": 1.0}))
    factor = lambda t: [h[3] for h in m.hits(t)]
    assert factor("such a grumblefix walked by") == [1.0]
    assert factor("you are a grumblefix indeed") == [toxicity.ADDRESSED]
    assert factor('he wrote down "what a grumblefix" on paper') == [toxicity.QUOTED]
    assert factor("she said grumblefix and left") == [toxicity.QUOTED]
    assert factor('"Nice." You grumblefix! "Yes."') == [toxicity.ADDRESSED]
    assert factor("grmublefix GRUMBLEFIX. grumblefx grumble") == [1.0, 1.0, 1.0]


def labelled(spark, n=400):
    rnd, rows, labels = random.Random(6), [], []
    for i in range(n):
        words = [f"word{rnd.randrange(300)}" for _ in range(60)]
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                words[rnd.randrange(60)] = rnd.choice(["zargoth", "blimfrak", "quodrunt"])
        rows.append((i, " ".join(words), "a"))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_learns_and_generalises_to_misspellings(spark):
    rows, labels = labelled(spark)
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = small.documents(spark, rows)
    model = toxicity.learn(docs, frame)
    assert set(model.lexicon.words) == {"zargoth", "blimfrak", "quodrunt"}
    out = {r.doc_id: r for r in toxicity.scored(docs, model).collect()}
    assert all(out[i].predicted == t for i, _, t in labels)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for i, r in out.items())
    m = toxicity.Matcher(model.lexicon)
    assert model.score("plain text with zargooth and blimfrk and qoudrunt in it", m) >= 0.5 > model.score("plain text with nothing in it", m)
    kept = toxicity.clean(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, _, t in labels if not t}


def test_held_out_labels_are_not_read(spark):
    rows, labels = labelled(spark)
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    turned = [(i, q, 1 - t if held(i) else t) for i, q, t in labels]
    docs = small.documents(spark, rows)
    one, two = (toxicity.learn(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, turned))
    assert one == two


@pytest.mark.parametrize("labels", [[], [(1, 1, 1)], [(1, 1, None), (None, 1, 1)], [(1, 1, 0), (2, 1, 1), (3, 0, 0)]])
def test_awkward_rows(spark, labels):
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = small.documents(spark)
    out = toxicity.scored(docs, toxicity.learn(docs, frame)).collect()
    assert len(out) == len(small.ROWS) and all(0 <= r.score <= 1 and r.held_out is not None for r in out)
    empty = small.documents(spark, [])
    assert toxicity.scored(empty, toxicity.learn(empty, frame)).collect() == []


def test_held_out_accuracy(spark):
    """On whole tables: rank quality over the rows whose labels the model never saw."""
    d = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in table(spark, d, "labels").collect() if r.toxic is not None}
    out = [(r.score, r.predicted, labels[r.doc_id]) for r in toxicity.op1_toxicity(spark, d).collect() if r.held_out and r.doc_id in labels]
    good, bad = [s for s, _, t in out if not t], [s for s, _, t in out if t]
    auc = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(good) * len(bad))
    assert auc > 0.9, auc


def test_misspelt_word_under_a_stem():
    """A word that a stem covers is found misspelt too, even within the stem."""
    m = toxicity.Matcher(toxicity.Lexicon({"grumblefix": 1.0}, {"grumb": 1.0}))
    assert [h[:2] for h in m.hits("grmublefix grumbling grumblefix")] == [("grumblefix", 1), ("grumb", 0), ("grumblefix", 0)]


def test_bounds_of_memory_change_nothing(monkeypatch):
    lexicon = toxicity.Lexicon({"grumblefix": 1.0, "blimfrak": 1.0}, {"zarg": 1.0})
    text = " ".join(["grmublefix", "blimfark", "zargoth", "plain", "x" * 500 + "-blimfrak"] * 20)
    want = toxicity.Matcher(lexicon).hits(text)
    for n in ("MEMO", "MEMO_BLOCK", "STATES"):
        monkeypatch.setattr(toxicity, n, 3)
    assert toxicity.Matcher(lexicon).hits(text) == want and len(want) == 80
