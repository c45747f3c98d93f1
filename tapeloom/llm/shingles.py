"""Sets of hashed word shingles, computed for a slice of texts at once with NumPy."""

from __future__ import annotations

import numpy as np

WORDS = 5
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = [_U(0xA0761D6478BD642F), _U(0xE7037ED1A0B428DB), _U(0x8EBC6AF09C88C6E3), _U(0x589965CC75374CC3), _U(0x1D8E4E27C47D124F)]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = (np.ones(1, _U), np.ones(1, _U))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values evenly."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    global _powers
    if len(_powers[0]) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        up, down = np.full(n, _BASE, _U), np.full(n, inverse, _U)
        up[0] = down[0] = 1
        _powers = np.cumprod(up), np.cumprod(down)
    return _powers[0][:n], _powers[1][:n]


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles of so many words (5 at most), A-Z lower-cased; a text of
    fewer words has one, of all of them; a text without words none."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = _LOWER[np.frombuffer(b" ".join(raw) + b" ", np.uint8)]
    size = np.array([len(r) + 1 for r in raw], np.int64)
    edge = np.concatenate([[0], np.cumsum(size)])
    gap = _SPACE[data]
    change = np.flatnonzero(np.diff(np.concatenate([[True], gap]).astype(np.int8)))
    starts, ends = change[0::2], change[1::2]
    if not len(starts):
        return [np.zeros(0, _U) for _ in raw]
    up, down = _power(len(data))
    run = np.concatenate([np.zeros(1, _U), np.cumsum((data.astype(_U) + _U(1)) * up)])
    word = mix((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(_U) * _MIX[4])
    first = np.searchsorted(starts, edge)  # index of each text's first word
    n = len(word)
    five = np.zeros(n, _U)
    for k in range(words):
        five[: n - k] += word[k:] * _MIX[k]
    five = mix(five)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(five[a : b - words + 1]))
        elif b > a:
            few = np.array([b - a], _U)
            for k in range(a, b):
                few = mix(few * _MIX[0] + word[k : k + 1])
            out.append(few)
        else:
            out.append(np.zeros(0, _U))
    return out


def set_hash(s: np.ndarray) -> int:
    """Signed 64-bit hash of a set."""
    return int(mix(np.array([mix(s ^ _MIX[2]).sum(dtype=_U) + _U(len(s))], _U)).view(np.int64)[0]) if len(s) else 0
