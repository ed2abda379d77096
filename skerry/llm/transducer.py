"""A deterministic transducer that counts a tokenizer's tokens, compiled from the tokenizer's file.

Three machines are composed, state by state as texts need them, into one over characters:

* letters: a character becomes what the file's normaliser makes of it, each with its class under the file's splitter
  (letter, digit, other, space);
* the splitter's automaton: runs of letters, single digits, runs of others, contractions;
* byte-pair merging.  Of a merged word's prefixes each has one last token, and a sequence of tokens is what the merges
  come to exactly if that holds of every two neighbours.  So the last token of a longer prefix is the one token, out of
  those that end there, that goes with the last token where it begins.  A state is the longest end of what has been read
  that a token can still go on from, and for each place in it where one can begin, the last token there and its count.

Transitions are annotated with the number of tokens they emit, which may be negative where a longer token takes the
place of shorter ones.  A word's last symbol differs from others, so a symbol takes effect when the next one is known.
White space leads to the start from every state; so a block between white spaces is one long transition from the start to
the start, and those met often are kept with their sums.
"""

from __future__ import annotations

import json
import os
import re

import regex

#: States, token pairs and transitions by whole blocks that a worker holds; beyond that it starts anew, which changes no result.
MAX_STATES, MAX_PAIRS, MAX_BLOCKS, MAX_BLOCK = 250_000, 300_000, 600_000, 64
#: The splitter that is compiled, as the file states it; fixed value.
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
LETTER, DIGIT, OTHER, SPACE = "LNOS"
_KIND = [regex.compile(x) for x in (r"\p{L}", r"\p{N}", r"\s")]
_WORDS = regex.compile(SPLIT).findall
_CONTROL = re.compile("[\x1c-\x1f]")
_END = "\n"  # marks a word's last symbol; no letter of the vocabulary is a line feed
_ENDINGS, _OPENINGS = frozenset("stmd"), {"r": "e", "v": "e", "l": "l"}


def byte_letters() -> list[str]:
    """The printable characters that stand for bytes in the vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Merges:
    """Byte-pair merging by the file's merges.  Tokens are numbers in the order in which merges make them, symbols first."""

    def __init__(self, model: dict) -> None:
        suffix = model["end_of_word_suffix"]
        mark = lambda t: t[: -len(suffix)] + _END if t.endswith(suffix) else t
        made = [tuple(map(mark, m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        if len({a + b for a, b in made}) < len(made):
            raise ValueError("a token that two merges make is not supported")
        whole = {a + b for a, b in made}
        symbols = sorted(t for t in map(mark, model["vocab"]) if t not in whole)
        self.first = len(symbols)
        self.number = {t: i for i, t in enumerate(symbols)} | {a + b: self.first + i for i, (a, b) in enumerate(made)}
        parts = [(self.number[a], self.number[b]) for a, b in made]
        self.left, self.right = [*range(self.first), *(a for a, _ in parts)], [*range(self.first), *(b for _, b in parts)]
        self.pair = {p: self.first + i for i, p in enumerate(parts)}
        self.openings = {t[:i] for t in self.number for i in range(1, len(t) - t.endswith(_END))}
        # tokens that their own letters come to
        stays = [True] * self.first
        for i, (a, b) in enumerate(parts):
            stays.append(stays[a] and stays[b] and self.apart(a, b, self.first + i))
        self.tokens = {t: i for t, i in self.number.items() if stays[i]}
        self.known: dict[tuple[int, int], bool] = {}

    def apart(self, a: int, b: int, bound: int) -> bool:
        """Whether no merge made before ``bound`` joins what tokens a and b are made of across their border.

        The merges that made the two are undone at the border, the latest first: a merge across can only have come
        before the one undone last; of equal ones the left one comes first.
        """
        while True:
            across = self.pair.get((a, b))
            if across is not None and across < bound:
                return False
            if a < self.first and b < self.first:
                return True
            if a > b:
                bound, a = min(bound, a), self.right[a]
            else:
                bound, b = min(bound, b + 1), self.left[b]

    def fits(self, last: int, token: int) -> bool:
        """Whether ``token`` stays itself behind ``last`` (-1: at a word's beginning)."""
        if last < 0:
            return True
        got = self.known.get((last, token))
        if got is None:
            if len(self.known) >= MAX_PAIRS:
                self.known.clear()
            got = self.known[last, token] = self.apart(last, token, 1 << 40)
        return got


#: A state of merging: the end of the text that tokens can go on from, and (places back, last token, count) there.
Core = tuple[str, tuple[tuple[int, int, int], ...]]
FRESH: Core = ("", ((0, -1, 0),))


class State(dict):
    """A state of the composed machine by its next characters; n is what entering it emits."""

    __slots__ = ("core", "kind", "make", "n", "wait")

    def __missing__(self, char: str) -> State:
        return self.make(self, char)


class Blocks(dict):
    """Tokens that blocks of characters emit from the start to the start."""

    def __init__(self, count) -> None:
        super().__init__()
        self.count, self.old = count, {}

    def __missing__(self, block: str) -> int:
        n = self.old.get(block)
        if n is None:
            n = self.count(block)
        if len(block) <= MAX_BLOCK:
            if len(self) >= MAX_BLOCKS // 2:
                self.old = dict(self)
                self.clear()
            self[block] = n
        return n


class Transducer:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        spec = json.loads(tokenizer.to_str())
        steps = spec.get("pre_tokenizer", {}).get("pretokenizers", [{}])
        kinds = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        odd = [a["content"] for a in spec["added_tokens"] if a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"]]
        model = spec["model"]
        plain = steps[0].get("pattern", {}).get("Regex") == SPLIT and steps[0].get("invert") and [s["type"] for s in steps] == ["Split", "ByteLevel"] and not steps[1]["use_regex"] and not steps[1]["add_prefix_space"]
        if not plain or odd or kinds != ["NFC", "Replace", "Lowercase"] or model["type"] != "BPE" or model["ignore_merges"] or model["dropout"] or model["continuing_subword_prefix"] or not model["end_of_word_suffix"]:
            raise ValueError(f"{path}: only byte-pair files with word ends, lower case and this splitter are compiled: {SPLIT}")
        self.normalizer, self.pre_tokenizer = tokenizer.normalizer, tokenizer.pre_tokenizer
        from tokenizers.normalizers import NFC

        self.nfc = NFC()
        self.specials = [a["content"] for a in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.merges, self.byte = Merges(model), byte_letters()
        self.chars: dict[str, list[tuple[str, str]]] = {}
        self.blocks, self.words = Blocks(self.count), Blocks(self.word)
        self.plain: dict[str, bool] = {}
        self._anew()

    def _anew(self) -> None:
        self.states: dict[tuple, State] = {}
        self.moves: dict[tuple[Core, str], tuple[Core, int]] = {}
        self.ends = {}
        self.start = self._state("start", FRESH, "", 0)

    # Letters

    def classed(self, char: str) -> list[tuple[str, str]]:
        """(class, letter) of what the normaliser makes of a character."""
        got = self.chars.get(char)
        if got is None:
            if len(self.chars) >= MAX_STATES:
                self.chars.clear()
            got = self.chars[char] = [(self._class(c), c) for c in self.normalizer.normalize_str(char)]
        return got

    def _class(self, c: str) -> str:
        pieces = lambda s: [s[a:b] for _, (a, b) in self.pre_tokenizer.pre_tokenize_str(s)]
        return OTHER if pieces(f"!{c}!") == [f"!{c}!"] else LETTER if pieces(f"a{c}a") == [f"a{c}a"] else DIGIT if c in pieces(f"a{c}a") else SPACE

    # Merging

    def _ends(self, core: Core, symbol: str) -> tuple[int, int]:
        """The last token, and its count, of what was read and ``symbol``."""
        end, places = core
        for back, last, n in places:
            token = self.merges.tokens.get(end[len(end) - back :] + symbol)
            if token is not None and self.merges.fits(last, token):
                return token, n + 1
        raise ValueError(f"no token of the vocabulary ends with {symbol!r}")

    def _read(self, core: Core, symbol: str) -> tuple[Core, int]:
        """(state, tokens emitted) after one more symbol that does not end the word."""
        got = self.moves.get((core, symbol))
        if got is None:
            if len(self.moves) >= MAX_STATES:
                self.moves.clear()
            token, n = self._ends(core, symbol)
            end, places = core
            openings, size = self.merges.openings, len(end)
            live = [(back + 1, last, m - n) for back, last, m in places if end[size - back :] + symbol in openings]
            longest = live[-1][0] if live else 0
            got = self.moves[core, symbol] = (((end + symbol)[size + 1 - longest :], ((0, token, 0), *live)), n)
        return got

    def _word(self, core: Core, symbols: str) -> tuple[Core, int]:
        emitted = 0
        for s in symbols:
            core, n = self._read(core, s)
            emitted += n
        return core, emitted

    def word(self, word: str) -> int:
        """Tokens of a pre-token in lower case."""
        symbols = self._bytes(word)
        core, emitted = self._word(FRESH, symbols[:-1])
        return emitted + self._ends(core, symbols[-1] + _END)[1]

    def _closed(self, core: Core, wait: str) -> int:
        """Tokens emitted where a word ends with the letters ``wait``."""
        if not wait:
            return 0
        got = self.ends.get((core, wait))
        if got is None:
            at, emitted = self._word(core, wait[:-1])
            got = self.ends[core, wait] = emitted + self._ends(at, wait[-1] + _END)[1]
        return got

    # The composed machine.  kind: start; L and O, within a run; ' and 'r, 'v, 'l, an apostrophe that may open a contraction.

    def _state(self, kind: str, core: Core, wait: str, n: int) -> State:
        key = (kind, core, wait, n)
        got = self.states.get(key)
        if got is None:
            got = self.states[key] = State()
            got.kind, got.core, got.wait, got.n, got.make = kind, core, wait, n, self._compile
        return got

    def _end(self, q: State) -> int:
        """Tokens that the text's end emits."""
        return self._closed(q.core, q.wait) if q.kind in ("start", LETTER, OTHER) else sum(self._closed(FRESH, self._bytes(c)) for c in q.kind)

    def _bytes(self, text: str) -> str:
        return "".join(self.byte[b] for b in text.encode("utf-8", "surrogatepass"))

    def _step(self, kind: str, core: Core, wait: str, of: str, c: str) -> tuple[str, Core, str, int]:
        """(kind, core, wait, tokens emitted) after one letter of class ``of``."""
        n = 0
        if kind[0] == "'":
            if len(kind) == 1 and c in _ENDINGS or len(kind) == 2 and c == _OPENINGS[kind[1]]:
                return "start", FRESH, "", self._closed(FRESH, self._bytes(kind + c))
            if len(kind) == 1 and c in _OPENINGS:
                return "'" + c, FRESH, "", 0
            if len(kind) == 1:  # no contraction: a run of others has begun
                kind, core, wait = OTHER, FRESH, self._bytes("'")
            else:
                n, kind, core, wait = self._closed(FRESH, self._bytes("'")), LETTER, FRESH, self._bytes(kind[1])
        if kind == of:  # the run goes on
            core, more = self._word(core, wait)
            return kind, core, self._bytes(c), n + more
        if kind != "start":
            n += self._closed(core, wait)
        if of == SPACE:
            return "start", FRESH, "", n
        if of == DIGIT:
            return "start", FRESH, "", n + self._closed(FRESH, self._bytes(c))
        return ("'", FRESH, "", n) if c == "'" else (of, FRESH, self._bytes(c), n)

    def _compile(self, state: State, char: str) -> State:
        if len(self.states) >= MAX_STATES:
            self._anew()  # states in use live on until their text ends
        kind, core, wait, n = state.kind, state.core, state.wait, 0
        for of, c in self.classed(char):
            kind, core, wait, more = self._step(kind, core, wait, of, c)
            n += more
        got = state[char] = self._state(kind, core, wait, n)
        return got

    def count(self, text: str) -> int:
        """Tokens of a text in normal form C without special strings."""
        q, n = self.start, 0
        for c in text:
            q = q[c]
            n += q.n
        return n + self._end(q)

    def _plain(self, char: str) -> bool:
        """Whether the character becomes one letter of the class that \\p{L}, \\p{N} and \\s put it in."""
        got = self.plain.get(char)
        if got is None:
            own = self.classed(char)
            of = LETTER if _KIND[0].match(char) else DIGIT if _KIND[1].match(char) else SPACE if _KIND[2].match(char) else OTHER
            got = self.plain[char] = len(own) == 1 and (own[0][1] == char.lower() and len(own[0][1]) == 1 and own[0][0] == of and char != "Σ" or own[0][0] == of == SPACE)
        return got

    def read(self, text: str) -> int:
        """The same, by longer transitions: by words where all characters are plain, else by blocks between white spaces."""
        if all(map(self._plain, set(text))):
            return sum(map(self.words.__getitem__, _WORDS(text.lower())))
        if _CONTROL.search(text):  # white space to str.split() only
            return self.count(text)
        return sum(map(self.blocks.__getitem__, text.split()))

    def prepared(self, text: str) -> tuple[str, int]:
        """(the text in normal form C, with blanks in place of special strings; their number)."""
        found = 0
        if self.special and any(s in text for s in self.specials):
            text, found = self.special.subn(" ", text)
        return (text if text.isascii() else self.nfc.normalize_str(text)), found

    def cuts(self, char: str, before: str) -> bool:
        """Whether a word begins or ends right before ``char``, behind ``before``, whatever came earlier."""
        own = self.classed(char)
        if len(own) != 1:
            return False
        if own[0][0] in (SPACE, DIGIT):
            return True
        last = self.classed(before) if before else []
        return own[0][0] == OTHER and len(last) == 1 and last[0][0] == LETTER


_HELD: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """One per worker process, so that a worker's later tasks find the states compiled."""
    if path not in _HELD:
        _HELD.clear()
        _HELD[path] = Transducer(path)
    return _HELD[path]
