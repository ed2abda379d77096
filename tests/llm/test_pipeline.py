"""The pipeline's stages, each on its own input, against brute force."""

from __future__ import annotations

import corpus_pipeline
import test_minhash
import test_packing

from skerry.llm import mixing, toxicity
from skerry.llm.common import stored, table

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, DIR, "documents")
    columns, at = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES:
        at.append(stored(stage(spark, at[-1], DIR)))
    assert [d.columns for d in at[:-1]] == [columns] * 5
    read = [sorted((tuple(r) for r in d.collect()), key=repr) for d in at]

    model = toxicity.learn(docs, table(spark, DIR, "labels"))
    m = toxicity.Matcher(model.lexicon)
    assert read[1] == [r for r in read[0] if model.score(r[1], m) < 0.5]

    last: dict = {}
    for r in read[1]:
        last[r[1] or ""] = max(last.get(r[1] or "", r), r, key=lambda x: x[0])
    assert read[2] == sorted(last.values(), key=repr)

    comp = {i: c for i, _, c in test_minhash.brute([(r[0], r[1]) for r in read[2]], 5, 80)}
    assert read[3] == [r for r in read[2] if comp[r[0]] == r[0]]

    times = {r.doc_id: r.taken // r.size for r in mixing.mix(at[3]).collect() if r.size}
    assert read[4] == sorted((r for r in read[3] for _ in range(times.get(r[0], 0))), key=repr)

    test_packing.check([(r[0], r[1]) for r in read[4]], at[5].collect())


def test_run(spark):
    whole = corpus_pipeline.run(spark, DIR)
    assert whole.count() > 0 and [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near-dedup", "mixing", "packing"]


def test_without_the_subpackage(tmp_path):
    """With the corpus folders and corpus_pipeline.py gone, the entry module still imports and gives the other queries."""
    import os
    import shutil
    import subprocess
    import sys

    top = os.path.dirname(corpus_pipeline.__file__)
    shutil.copytree(f"{top}/skerry", tmp_path / "skerry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{top}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(k.startswith('op') or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
