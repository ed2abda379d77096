"""Toxicity by Levenshtein automata over a learned lexicon, scored in context.

* Lexicon: words and stems (openings of many words) that labelled toxic documents have far more often than others.
* Matching: one deterministic automaton, the product of the lexicon's trie with Levenshtein automata of one or two edits
  (swaps of neighbours count as one), made state by state as texts need it.  Most words leave it after a few letters.
* Context: a hit between quotation marks, or close behind a word of reporting, weighs little; one near a second
  person weighs more.
* Score: a logistic model of the weighted hits' number and density, fitted on the labelled rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, table

#: Labelled rows that the lexicon and the model are fitted on, about: drawn by a hash of the id, so reruns agree.
FIT_ROWS = 20_000
#: Least share of the toxic documents that have a term, least log-odds, and least number of words behind a stem.
SHARE, LOG_ODDS, STEM_WORDS = 0.01, 4.0, 8
STEMS = (4, 5, 6, 7, 8)
#: Least number of different words before a term, as a share of its toxic documents: copies of one document are no evidence.
CONTEXTS = 0.15
WORD = re.compile(r"[^\W_]+")
#: Blocks on either side within which quotation marks and other signs count.
CONTEXT = 8
QUOTED, ADDRESSED, FUZZY = 0.15, 1.25, 0.8
OPENING, CLOSING = "\"“„«‘'‹", "\"”“»’'›"
REPORTING = frozenset("said says saying called calls wrote writes quote quoted quotes reported term word slur dit disait mot citation sagte sagt schrieb zitat wort genannt dijo dice escribió palabra cita".split())
PERSON = frozenset("you your youre u du dich dir dein deine ihr euch tu te toi vous votre ton tú ti tus usted ustedes".split())
#: Matches of blocks held by a worker at once, and the longest block held; states of its automaton.
MEMO, MEMO_BLOCK, STATES = 400_000, 64, 200_000


@dataclass
class Lexicon:
    """words and stems with their weights; rigid: words that are matched without edits."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    rigid: frozenset[str] = frozenset()


def edits(word: str) -> int:
    return 0 if len(word) < 5 else 1 if len(word) < 9 else 2


class Automaton:
    """Words within the edits that each lexicon word allows, stems as they are; deterministic, built lazily."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.end: list[tuple[str, int, float] | None] = [None]
        self.stem: list[tuple[str, float] | None] = [None]
        self.most = [0]  # edits that some word below allows
        for w, x in lexicon.words.items():
            k = 0 if w in lexicon.rigid else edits(w)
            self.end[self._path(w, k)] = (w, k, x)
        for s, x in lexicon.stems.items():
            self.stem[self._path(s, 0)] = (s, x)
        self._anew()

    def _anew(self) -> None:
        """Without states: they are made again as words need them, which changes no result."""
        self.ids: dict[frozenset, int] = {frozenset(): 0}
        self.sets: list[frozenset] = [frozenset()]
        self.step: list[dict[str, int]] = [{}]
        self.accept: list[tuple | None] = [None]
        self.stems_at: list[tuple | None] = [None]
        self.begin = self._state(self._closed({(0, 0, "")}))

    def _path(self, word: str, k: int) -> int:
        at = 0
        self.most[0] = max(self.most[0], k)
        for c in word:
            if c not in self.next[at]:
                self.next[at][c] = len(self.next)
                self.next.append({})
                self.end.append(None)
                self.stem.append(None)
                self.most.append(0)
            at = self.next[at][c]
            self.most[at] = max(self.most[at], k)
        return at

    def _closed(self, items: set) -> frozenset:
        """With the lexicon's letters that the text may leave out."""
        todo, seen = list(items), set(items)
        while todo:
            at, k, wait = todo.pop()
            if wait:
                continue
            for child in self.next[at].values():
                x = (child, k + 1, "")
                if k < self.most[child] and x not in seen:
                    seen.add(x)
                    todo.append(x)
        best: dict = {}
        for at, k, wait in seen:
            if k <= self.most[at] or not k:
                best[at, wait] = min(k, best.get((at, wait), k))
        return frozenset((at, k, wait) for (at, wait), k in best.items())

    def _state(self, items: frozenset) -> int:
        got = self.ids.get(items)
        if got is None:
            got = self.ids[items] = len(self.sets)
            self.sets.append(items)
            self.step.append({})
            ends = [(k, *self.end[at]) for at, k, wait in items if not wait and self.end[at] and k <= self.end[at][1]]
            k, w, _, x = min(ends) if ends else (0, None, 0, 0.0)
            self.accept.append((w, k, x * FUZZY**k) if w else None)
            stems = [self.stem[at] for at, k, wait in items if not wait and not k and self.stem[at]]
            self.stems_at.append((stems[0][0], 0, stems[0][1]) if stems else None)
        return got

    def _move(self, state: int, c: str) -> int:
        out = set()
        for at, k, wait in self.sets[state]:
            if wait:
                if wait == c:
                    out.add((at, k, ""))
                continue
            below = self.next[at]
            if c in below:
                out.add((below[c], k, ""))
            if k < self.most[at]:
                out.add((at, k + 1, ""))
                for x, child in below.items():
                    if x != c:
                        out.add((child, k + 1, ""))
                        if c in self.next[child]:
                            out.add((self.next[child][c], k + 1, x))
        self.step[state][c] = got = self._state(self._closed(out)) if out else 0
        return got

    def match(self, word: str) -> tuple[str, int, float] | None:
        """(term, edits, weight), of the word or else of a stem that it opens with."""
        if len(self.sets) > STATES:
            self._anew()
        at, stem = self.begin, None
        step = self.step
        for c in word:
            to = step[at].get(c)
            at = self._move(at, c) if to is None else to
            if not at:
                return stem
            if self.stems_at[at]:
                stem = self.stems_at[at]
        return self.accept[at] or stem


class Matcher:
    """Hits of whole texts: blocks between white space, each block's match remembered."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.automaton, self.memo = Automaton(lexicon), {}

    def _block(self, block: str) -> tuple | None:
        best = None
        for w in WORD.findall(block.lower()):
            m = self.automaton.match(w)
            if m and (best is None or m[2] > best[2]):
                best = m
        return best

    def hits(self, text: str) -> list[tuple[str, int, float, float]]:
        """(term, edits, weight, factor of its context) of each block with a match."""
        blocks, memo, out, found = text.split(), self.memo, [], []
        for i, b in enumerate(blocks):
            try:
                m = memo[b]
            except KeyError:
                m = self._block(b)
                if len(b) <= MEMO_BLOCK:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[b] = m
            if m:
                found.append((i, m))
        for i, m in found:
            out.append((*m, context(blocks, i)))
        return out


def context(blocks: list[str], i: int) -> float:
    """What a hit in block ``i`` counts for: quotation and reporting lower it, address raises it."""
    own, before, after = blocks[i], blocks[max(0, i - CONTEXT) : i], blocks[i + 1 : i + 1 + CONTEXT]

    def opened() -> bool:
        for b in [own, *reversed(before)]:
            if b is not own and b.rstrip(".,;:!?")[-1:] in CLOSING and b.rstrip(".,;:!?"):
                return False
            if b[0] in OPENING and len(b) > 1:
                return True
        return False

    def closed() -> bool:
        for b in [own, *after]:
            if b is not own and b[0] in OPENING:
                return False
            if (x := b.rstrip(".,;:!?")) and x[-1] in CLOSING and len(x) > 1:
                return True
        return False

    if opened() and closed():
        return QUOTED
    plain = lambda b: b.strip("".join({*OPENING, *CLOSING}) + ".,;:!?()").lower()
    if any(plain(b) in REPORTING for b in before[-3:]):
        return QUOTED
    return ADDRESSED if any(plain(b) in PERSON for b in [*before[-3:], *after[:3]]) else 1.0


def features(text: str | None, matcher: Matcher) -> tuple[float, float]:
    """(log of 1 + weighted hits, weighted hits for 100 blocks with 20 blocks more)."""
    found = matcher.hits(text) if text else []
    if not found:
        return 0.0, 0.0
    total = sum(w * f for _, _, w, f in found)
    return math.log1p(total), 100 * total / (len(text.split()) + 20)


@dataclass
class Model:
    lexicon: Lexicon
    weights: tuple[float, float, float]

    def score(self, text: str | None, matcher: Matcher) -> float:
        a, b = features(text, matcher)
        z = self.weights[0] + self.weights[1] * a + self.weights[2] * b
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, word behind it, toxic documents, other documents) summed within a task; stems are marked by a star."""
    sums: dict[str, list[int]] = {}

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([x[0] for x in sums.values()], pa.int64()), pa.array([x[1] for x in sums.values()], pa.int64())], ["word", "toxic", "other"])

    for b in batches:
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for w in set(WORD.findall((text or "").lower())):
                if len(w) >= 3:
                    sums.setdefault(w, [0, 0])[0 if toxic else 1] += 1
        if len(sums) > MEMO:
            yield out()
            sums = {}
    if sums:
        yield out()


def _before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different (word, hash of the word before it) of a task's texts."""
    import zlib

    pairs: set = set()
    for b in batches:
        for text in b.column(0).to_pylist():
            words = WORD.findall((text or "").lower())
            pairs.update((w, zlib.crc32(v.encode())) for v, w in zip(["", *words], words, strict=False) if len(w) >= 3)
        if len(pairs) > MEMO:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in pairs]), pa.array([x[1] for x in pairs], pa.int64())], ["w", "before"])
            pairs = set()
    if pairs:
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in pairs]), pa.array([x[1] for x in pairs], pa.int64())], ["w", "before"])


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The lexicon and the model, from labelled rows that are not held out.

    ``fit_rows`` bounds the labelled rows used (in expectation); the lexicon holds the terms above the thresholds.
    Without rows of both kinds the lexicon is empty and every text scores the share of toxic rows (0 without rows).
    """
    named = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("l"), (F.col("toxic") == 1).alias("toxic")).where(~held_out(F.col("l")))
    n = named.count()
    part = named.where(F.pmod(F.xxhash64("l"), F.lit(1 << 20)) < int(min(1.0, fit_rows / max(n, 1)) * (1 << 20)))
    rows = stored(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(part, F.col("id") == F.col("l")).select("text", "toxic"))
    t = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    bad, good = t.get(True, 0), t.get(False, 0)
    if not bad or not good:
        p = min(max(bad / max(1, bad + good), 1e-9), 1 - 1e-9)
        return Model(Lexicon(), (math.log(p / (1 - p)), 0.0, 0.0))
    near = rows.where("toxic").select("text").mapInArrow(_before, "w string, before long").distinct()
    varied = near.groupBy("w").agg(F.count("*").alias("contexts"))
    counted = stored(rows.mapInArrow(_terms, "word string, toxic long, other long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).join(varied, F.col("word") == F.col("w"), "left").select("word", "toxic", "other", F.coalesce("contexts", F.lit(0)).alias("contexts")))
    odds = F.log((F.col("toxic") + 0.5) / (bad + 1)) - F.log((F.col("other") + 0.5) / (good + 1))
    floor = max(5, SHARE * bad)
    words = {r.word: 1.0 for r in counted.where((F.col("toxic") >= floor) & (odds >= LOG_ODDS) & (F.col("contexts") >= F.greatest(F.lit(5), F.col("toxic") * CONTEXTS))).collect()}
    stems = counted.withColumn("n", F.explode(F.array(*[F.lit(k) for k in STEMS]))).where(F.length("word") > F.col("n"))
    stems = stems.groupBy(F.expr("substr(word, 1, n)").alias("stem")).agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"), F.count("*").alias("words"), F.max("toxic").alias("top"), F.sum("contexts").alias("contexts"))
    good_stem = (F.col("toxic") >= floor) & (odds >= LOG_ODDS) & (F.col("words") >= STEM_WORDS) & (F.col("top") <= F.col("toxic") * 0.5) & (F.col("contexts") >= F.col("toxic") * CONTEXTS)
    picked = {r.stem: r.toxic for r in stems.where(good_stem).collect()}
    roots: dict[str, float] = {}
    for s in sorted(picked, key=lambda x: (len(x), x)):
        if not any(s.startswith(r) for r in roots):
            # as long as it can be and still open nine tenths of the words
            longer = [x for x in picked if x.startswith(s) and picked[x] >= 0.9 * picked[s]]
            roots[max(longer, key=lambda x: (len(x), x))] = 1.0
    # Words that open with a stem stay in the lexicon, for their misspellings.  A word whose near
    # spellings are common in other documents is matched as it is.
    lexicon = Lexicon(words, roots)

    def strays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto, sums = Automaton(lexicon), Counter()
        for b in batches:
            for w, other in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                m = auto.match(w)
                if m and m[1]:
                    sums[m[0]] += other
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], ["word", "n"])

    found = counted.where("other > 0").select("word", "other").mapInArrow(strays, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    lexicon = Lexicon(words, roots, frozenset(r.word for r in found if r.n > 0.002 * good))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(lexicon)
        for b in batches:
            f = [features(t, m) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in f], pa.float64()), pa.array([x[1] for x in f], pa.float64()), b.column(1)], ["a", "b", "toxic"])

    data = rows.select("text", "toxic").mapInArrow(measure, "a double, b double, toxic boolean").groupBy(F.round("a", 2).alias("a"), F.round("b", 2).alias("b"), "toxic").count().collect()
    return Model(lexicon, fit([(r.a, r.b, r.toxic, r["count"]) for r in sorted(data)]))


def fit(rows: list[tuple[float, float, bool, int]], ridge: float = 1.0, rounds: int = 40) -> tuple[float, float, float]:
    """Weights of the logistic model by Newton's method, with a ridge on all but the constant; none falls below 0."""
    x = np.array([(1.0, r[0], r[1]) for r in rows])
    y, n = np.array([float(r[2]) for r in rows]), np.array([float(r[3]) for r in rows])
    w, pull = np.zeros(3), np.diag([1e-3, ridge, ridge])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + pull, x.T @ (n * (y - p)) - pull @ w)
        w = w + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(max(w[1], 0)), float(max(w[2], 0))


def scorer(model: Model):
    """A column function: the score of a text column."""

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = Matcher(model.lexicon)
        for s in parts:
            yield pd.Series([model.score(t, m) for t in s], dtype="float64")

    return score


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.  Null and empty texts have no hits."""
    out = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), scorer(model)(F.col(text_col).cast("string")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with its columns, whose score is below 0.5."""
    return docs.where(scorer(model)(F.col(text_col).cast("string")) < 0.5)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, learn(docs, table(spark, sf_dir, "labels")))
