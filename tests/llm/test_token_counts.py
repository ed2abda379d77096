from __future__ import annotations

import random

import pytest
import small
from tokenizers import Tokenizer

from skerry.llm import lexicon, token_counts, transducer
from skerry.llm.common import table

PATH = lexicon.default_path()
ODD = [
    "", " ", "Hello, World! It's 2024...", "don't we'll I'M you're 'S ''t", "naïve CAFÉ e\u0301cole ÅÄÖ ŀ İstanbul ẞ ß ſ ǅ", "日本語テキスト 中文 русский ελληνικά", "a\u00a0b\u2003c\u3000d\x85e", "x\x1cy\x1dz", "<|endoftext|> mid<|startoftext|>dle <|endof", "<|ENDOFTEXT|>",
    "emoji 😀👍🏽 zwj 👩‍👩‍👧", "q" * 5000, "1234567890 ١٢٣ ½ ²", "tab\tnew\nline\r\n\x0b\x0c", "\x00\x01control\x7f", "a'b'c'd 'll'll", "don’t “quoted” — dash…", "\ufeffbom \u200bzero", "ﬁ ligature Ⅷ ①", "ａｂｃ ＡＢＣ",
]


def want(texts):
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def machine():
    return transducer.Transducer(PATH)


def mixtures(n):
    rnd = random.Random(1)
    return ODD + ["".join(rnd.choice(rnd.choice(ODD) or "x") for _ in range(rnd.randrange(60))) for _ in range(n)] + [rnd.choice([" ", "", "\n"]).join(rnd.choices(ODD, k=4)) for _ in range(n // 5)]


def test_odd_texts_and_mixtures(machine):
    texts = mixtures(1500)
    assert [token_counts.count_tokens(t, machine) for t in texts] == want(texts)


def test_by_characters_alone(machine):
    """The composed machine itself, without transitions by words or blocks."""
    texts = mixtures(300)
    assert [machine.count(x) + n for x, n in map(machine.prepared, texts)] == want(texts)


def test_chunks_compose_to_the_whole(machine):
    rnd = random.Random(2)
    texts = [rnd.choice(["", " "]).join(rnd.choices(ODD, k=5)) for _ in range(40)] + ["ab c " + "q" * 5000 + " d", "a'll'ab'l'l!a''s 'll" * 20]
    for chunk in (1, 2, 3, 7, 64, 700):
        assert [token_counts.count_tokens(t, machine, chunk) for t in texts if len(t) < 300 or chunk > 9] == want([t for t in texts if len(t) < 300 or chunk > 9])


def test_prefix_scan_gives_all_prefixes(machine):
    text = "some plain words here and there, it's longer ones'll notwithstanding 42"
    for n in (1, 3, 7):
        maps = token_counts.scan([token_counts.chunk_map(text[i : i + n], machine) for i in range(0, len(text), n)], machine)
        assert [token_counts.total(m, machine) for m in maps] == want([text[:i] for i in range(n, len(text) + n, n)])


def test_merges_alone_give_the_same(machine):
    """Byte-pair merging as it is defined, on pre-tokens, against last tokens that fit."""
    m, rnd = machine.merges, random.Random(5)
    name = {i: t for t, i in m.number.items()}
    for _ in range(400):
        word = "".join(rnd.choice(["a", "e", "n", "th", "in", "é", "s", "o", "日"]) for _ in range(rnd.randrange(1, 9)))
        letters = machine._bytes(word)
        parts = [m.number[x] for x in [*letters[:-1], letters[-1] + "\n"]]
        while True:
            best = min(((m.pair[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in m.pair), default=None)
            if best is None:
                break
            parts[best[1] : best[1] + 2] = [best[0]]
        assert machine.word(word) == len(parts), [name[p] for p in parts]


def test_starting_anew_changes_nothing(monkeypatch):
    for n in ("MAX_STATES", "MAX_PAIRS", "MAX_BLOCKS"):
        monkeypatch.setattr(transducer, n, 6)
    machine = transducer.Transducer(PATH)
    assert [token_counts.count_tokens(t, machine) for t in ODD] == want(ODD)


def test_other_files_are_an_error():
    with pytest.raises(ValueError, match="only byte-pair files"):
        transducer.Transducer(PATH.replace("word_bpe_49k", "byte_bpe_50k"))


def test_chunk_rows_of_a_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    out = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, chunk=100).collect()}
    rows = docs.collect()
    assert [out[r.doc_id] for r in rows] == want([r.text or "" for r in rows])


def test_whole_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    source = {r.doc_id: r.text or "" for r in docs.collect()}
    ids = sorted(source)
    out = {r.doc_id: r for r in token_counts.token_counts(docs).collect()}
    assert sorted(out) == ids and [out[i].n_tokens for i in ids] == want([source[i] for i in ids])
    assert all(r.over_limit == (r.n_tokens > 2048) and r.n_bytes == len(source[i].encode()) for i, r in out.items())


def test_awkward_rows(spark):
    out = token_counts.token_counts(small.documents(spark))
    assert sorted((r.n_bytes, r.n_tokens) for r in out.collect()) == sorted(zip([len((t or "").encode()) for _, t, _ in small.ROWS], want([t or "" for _, t, _ in small.ROWS]), strict=True))
    assert token_counts.token_counts(small.documents(spark, [])).collect() == []
