from __future__ import annotations

import functools
import itertools
import zlib

import numpy as np
import small
from tokenizers import Tokenizer

from skerry.llm import lexicon, packing
from skerry.llm.common import table

PATH = lexicon.default_path()


@functools.cache
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def ids_of(texts):
    t = tokenizer()
    return [[*e.ids, 2] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check(rows, pieces, length=4096):
    """Each id of each document in exactly one piece, sequences gapless and full or a power of two."""
    texts: dict = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t)
    ids = {i: ids_of(t) for i, t in texts.items()}
    seen: dict = {}
    sequences: dict = {}
    for p in pieces:
        seen.setdefault(p.doc_id, []).append(p)
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert set(seen) == set(ids)
    for i, ps in seen.items():
        assert sum(p.length for p in ps) == sum(map(len, ids[i]))
        if len(ids[i]) == 1:
            at = 0
            for p in sorted(ps, key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(ids[i][0])
                at += p.length
                assert p.ids_crc32 == zlib.crc32(np.array(ids[i][0][p.start : at], "<u4").tobytes())
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at == length or (at < length and at & (at - 1) == 0)
    return sequences


def test_whole_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    check([(r.doc_id, r.text) for r in docs.collect()], packing.pack(docs).collect())


def test_awkward_rows_and_short_sequences(spark):
    docs = small.documents(spark)
    rows = [(i, t) for i, t, _ in small.ROWS]
    check(rows, packing.pack(docs).collect())
    check(rows, packing.pack(docs, length=64).collect(), 64)
    assert packing.pack(small.documents(spark, [])).collect() == []


def test_curve_passes_each_cell_once_by_unit_steps():
    grid = np.array(list(itertools.product(range(8), repeat=3)))
    keys = packing.hilbert(grid, 3)
    assert sorted(keys.tolist()) == list(range(512))
    path = grid[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_copies_lie_together(spark):
    words = [[f"{t}{i}" for i in range(300)] for t in ("alpha", "beta", "gamma", "delta")]
    rows = [(i, " ".join(words[i % 4]), "a") for i in range(80)]
    pieces = packing.pack(small.documents(spark, rows)).collect()
    order = [p.doc_id % 4 for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset))]
    assert sum(a != b for a, b in itertools.pairwise(order)) <= 4
