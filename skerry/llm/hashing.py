"""Vectorised word and shingle hashing shared by the near-duplicate operators.

A *word* is a maximal run of bytes other than 0x20 and 0x09-0x0D of the UTF-8 text, after A-Z are lower-cased.  Word
hashes are polynomial hashes modulo 2**64 over a random byte table, taken as differences of prefix sums so that no
Python object is made per word, and then mixed.  Hashes are functions of the bytes alone: all tasks and runs agree.
"""

from __future__ import annotations

import numpy as np

_SEG = 1 << 20
_RNG = np.random.Generator(np.random.PCG64(20240229))
_TABLE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_TABLE[65:91] = _TABLE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> np.uint64(30))
    x *= _C1
    x ^= x >> np.uint64(27)
    x *= _C2
    x ^= x >> np.uint64(31)
    return x


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW, _INV = _powers(_P, _SEG + 64), _powers(_PINV, _SEG + 64)


def _segment(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start positions of the words of a buffer of at most _SEG bytes."""
    space = _SPACE[buf]
    edge = np.empty(len(buf) + 1, bool)
    edge[0], edge[-1] = not space[0], not space[-1]
    np.not_equal(space[1:], space[:-1], out=edge[1:-1])
    at = np.flatnonzero(edge)
    start, end = at[::2], at[1::2]
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_TABLE[buf] * _POW[: len(buf)], out=sums[1:])
    h = (sums[end] - sums[start]) * _INV[start]
    return mix64(h + (end - start).astype(np.uint64) * _C1), start


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, byte offsets of the starts) of all words of ``data``.

    Long inputs go through in segments cut at white space; a single word longer than a segment is hashed in pieces
    whose hashes are folded together, the same way wherever it stands.
    """
    buf = np.frombuffer(data, np.uint8)
    if not len(buf):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    if len(buf) <= _SEG:
        return _segment(buf)
    hs, ss, at = [], [], 0
    while at < len(buf):
        end = min(len(buf), at + _SEG)
        if end < len(buf):
            gaps = np.flatnonzero(_SPACE[buf[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:  # one word fills the segment: find its end, fold its pieces
                rest = end
                while rest < len(buf) and not _SPACE[buf[rest]]:
                    rest += 1
                fold = np.zeros(1, np.uint64)
                for p in range(at, rest, _SEG):
                    fold = mix64(fold * _C2 + _segment(buf[p : min(rest, p + _SEG)])[0])
                hs.append(fold)
                ss.append(np.array([at]))
                at = rest
                continue
        h, s = _segment(buf[at:end])
        hs.append(h)
        ss.append(s + at)
        at = end
    return np.concatenate(hs), np.concatenate(ss)


def batch_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes of all texts one after another, offsets of each text in them; one more offset than texts)."""
    n = [0]
    parts: list[np.ndarray] = []
    group: list[bytes] = []
    size = 0

    def flush() -> None:
        nonlocal group, size
        if not group:
            return
        h, s = word_hashes(b"\n".join(group))
        bounds = np.cumsum([len(t) + 1 for t in group])
        n.extend((n[-1] + np.searchsorted(s, bounds, "left")).tolist())
        parts.append(h)
        group, size = [], 0

    for t in texts:
        if size + len(t) + 1 > _SEG:
            flush()
        group.append(t)
        size += len(t) + 1
    flush()
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), np.array(n, np.int64)


_ROT = [np.uint64(int(x) | 1) for x in _RNG.integers(1, 1 << 63, 64)]


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashes, sorted, of the runs of ``k`` words; of the whole sequence when it is shorter; none of none."""
    n = len(words)
    if not n:
        return words
    m = max(1, n - k + 1)
    acc = np.full(m, np.uint64(n if n < k else k), np.uint64)
    for i in range(min(k, n)):
        acc = acc * _ROT[0] + words[i : i + m]
        acc = mix64(acc)
    return np.unique(acc)
