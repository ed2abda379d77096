"""Small tables with awkward rows, shared by the corpus operators' tests."""

from __future__ import annotations

LONG = " ".join(f"lorem{i % 977}" for i in range(40_000))

#: (doc_id, text, source): nulls, empty and white-space texts, ties, repeated rows, one very long text.
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog and runs away from here", "a"),
    (2, "the quick brown fox jumps over the lazy dog and runs away from here", "a"),
    (2, "the quick brown fox jumps over the lazy dog and runs away from here", "a"),
    (3, "The QUICK brown fox jumps over the lazy dog and runs away from here", "b"),
    (4, None, "b"),
    (5, "", None),
    (6, " \t\n ", None),
    (7, "one two", "c"),
    (8, "one  two", "c"),
    (9, "naïve café ÉCOLE 日本語   x", "c"),
    (10, LONG, "a"),
    (11, LONG + " end", "a"),
    (None, "a text without an id that stands alone here", "a"),
    (None, None, None),
]
#: Names that the operators use inside, and names like those of their results in another case.
CLASHING = ["id", "key", "n", "hash", "size", "sha", "rep", "node", "component", "label", "taken", "kept_id", "mix_n", "TEXT_SHA256", "keep_id", "a", "b", "s", "score"]


def documents(spark, rows=ROWS, extra=True):
    df = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit(f"x-{c}") for c in CLASHING})
    return df


def rows(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def components(nodes, links) -> dict:
    """The smallest node reachable from each, by brute force."""
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
