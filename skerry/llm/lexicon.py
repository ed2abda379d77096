"""Token ids of texts by a deterministic transducer compiled from a tokenizer file.

Two levels of states.  *Between blocks* is the one state that white space leads to from anywhere: the splitter never
joins characters across white space and the normaliser works within a block, so a text's ids are those of its blocks
(maximal runs without white space) one after another.  Inside a block the splitter's automaton (letters, digits, others,
contractions) emits pre-tokens.  Both levels' transitions, from *between blocks* by a block and by a pre-token, are
annotated with the ids (or their number) that they emit; they are compiled from the tokenizer as they first appear.
Compiled transitions are kept in two generations: when the young one is full it becomes the old one, and the old one is
dropped but for what is used again.  That bounds memory and changes no result.
"""

from __future__ import annotations

import os
import re
import struct

#: Transitions by block and by pre-token in a generation; longer blocks than MAX_BLOCK are compiled each time they come.
MAX_TRANSITIONS, MAX_BLOCK = 400_000, 64
_CONTROL = "\x1c\x1d\x1e\x1f"  # white space to str.split(), not to the tokenizer
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Letters outside ASCII for which the automaton is compiled; other blocks go to the tokenizer.
_LATIN = [chr(c) for c in range(0xC0, 0x250)]


def _byte_letters() -> dict[int, str]:
    """The printable characters that stand for bytes in the vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Transitions(dict):
    """Two generations of compiled transitions; ``make`` compiles one."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key: str):
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        if len(self) >= MAX_TRANSITIONS:
            self.old = dict(self)
            self.clear()
        if len(key) <= MAX_BLOCK:
            self[key] = out
        return out


class BlockLexicon:
    """emit: what a transition emits for its list of ids, such as their number; joined: puts such outputs together."""

    def __init__(self, path: str, emit, joined) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        t = self.tokenizer = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        self.emit, self.joined, self.edges, self.words = emit, joined, Transitions(self._block), Transitions(self._word)
        added = t.get_added_tokens_decoder().values()
        self.special = [a.content for a in added]
        # A special string that takes in white space would cross blocks: such texts go to the tokenizer whole.
        self.crossing = [a.content for a in added if a.lstrip or a.rstrip or a.single_word or re.search(r"\s", a.content)]
        spec = json.loads(t.to_str())
        first = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        kinds = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.splits = first.get("pattern", {}).get("Regex") == _SPLIT and kinds == ["NFC", "Replace", "Lowercase"]
        if self.splits:
            low = [c for c in _LATIN if len(n := t.normalizer.normalize_str(c)) == 1 and n == c.lower() and len(t.pre_tokenizer.pre_tokenize_str(f"a{n}a")) == 1]
            small = "".join(sorted({c.lower() for c in low}))
            self.known = re.compile(f"[\x00-\x7f{''.join(low)}]*")
            self.find = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{small}]+|[0-9]|[^\\sa-z{small}0-9]+").findall
            self.letters = _byte_letters()

    def whole(self, text: str) -> bool:
        """Whether the text has to go to the tokenizer in one piece."""
        return any(c in text for c in _CONTROL) or any(s in text for s in self.crossing)

    def encode(self, text: str):
        return self.emit(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _word(self, word: str):
        return self.emit([t.id for t in self.tokenizer.model.tokenize("".join(map(self.letters.__getitem__, word.encode())))])

    def simple(self, text: str) -> bool:
        """Whether the automaton inside blocks is compiled for all characters of the text, which has no special string."""
        return self.splits and self.known.fullmatch(text) is not None and not any(s in text for s in self.special)

    def _block(self, block: str):
        return self.joined(map(self.words.__getitem__, self.find(block.lower()))) if self.simple(block) else self.encode(block)

    def read(self, text: str):
        """What a text emits from and to the state between blocks."""
        if self.whole(text):
            return self.encode(text)
        return self.joined(map(self.words.__getitem__, self.find(text.lower())) if self.simple(text) else map(self.edges.__getitem__, text.split()))

    def outputs(self, blocks: list[str]) -> list:
        """What the transitions of the blocks emit, in order."""
        return list(map(self.edges.__getitem__, blocks))


_HELD: dict[tuple, BlockLexicon] = {}


def lexicon(path: str, kind: str) -> BlockLexicon:
    """One per worker process, so that a worker's later tasks find the transitions compiled.  kind: count, or ids
    (little-endian, two bytes each if all ids fit, else four)."""
    if (path, kind) not in _HELD:
        _HELD.clear()
        if kind == "count":
            _HELD[path, kind] = BlockLexicon(path, len, sum)
        else:
            code = "<%dH" if kind == "ids2" else "<%dI"
            forms = [struct.Struct(code % n).pack for n in range(9)]
            _HELD[path, kind] = BlockLexicon(path, lambda ids: forms[n](*ids) if (n := len(ids)) < 9 else struct.pack(code % n, *ids), b"".join)
    return _HELD[path, kind]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


__all__ = ["BlockLexicon", "default_path", "lexicon"]
