"""64-bit hashes of the words of many texts at once, from prefix sums over the bytes.

Words are maximal runs of bytes other than U+0020 and U+0009 to U+000D. Sums of powers
modulo 2**64 tell short runs apart only, so words over LONG_WORD bytes are hashed by BLAKE2b,
as are whole texts. A text of over PIECE bytes is taken in pieces that end after white space.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

from . import arrowtext

_RNG = np.random.default_rng(20240131)
_BYTE, OTHER_BYTE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64), _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}
LONG_WORD = 512
PIECE = arrowtext.HASH_BYTES


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd base below n, and those of its inverse, modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, arrowtext.HASH_BYTES + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit values whose bits look random."""
    x = x + np.uint64((salt * 0xD1B54A32D192ED03 + 0x9E3779B97F4A7C15) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Sums of values times powers, from the first value on; entry i covers the first i values."""
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each span [start, end), independent of where it lies."""
    _, down = powers(len(prefix))
    return (prefix[ends] - prefix[starts]) * down[starts]


def word_spans(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends) of all words, and for each text the index of its first word, with the total at the end."""
    inside = ~arrowtext.is_space(raw)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(raw))]
    begins[edges] = inside[edges]
    finish = inside.copy()
    finish[:-1] &= ~inside[1:]
    finish[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(finish) + 1, np.searchsorted(starts, offsets)


def text_pieces(raw: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of one text, about PIECE bytes each, that cut no word; longer ones are a single word or white space before one."""
    at, n = 0, len(raw)
    while at < n:
        end = min(at + PIECE, n)
        if end < n:
            space = np.flatnonzero(arrowtext.is_space(raw[at:end]))
            if len(space):
                end = at + int(space[-1]) + 1
            while not len(space) and end < n:
                space = np.flatnonzero(arrowtext.is_space(raw[end : end + PIECE]))
                end = end + int(space[0]) if len(space) else min(end + PIECE, n)
        yield at, end
        at = end


def _digest(raw: np.ndarray) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(np.ascontiguousarray(raw), digest_size=8).digest(), "little"))


def _hashed(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = word_spans(offsets, raw)
    long = np.flatnonzero(ends - starts > LONG_WORD)
    if len(long) == 1 and len(starts) == 1:
        return np.array([_digest(raw[starts[0] : ends[0]])], np.uint64), first
    out = mix(span_hash(prefix_hash(_BYTE[raw]), starts, ends) + (ends - starts).astype(np.uint64))
    for i in long.tolist():
        out[i] = _digest(raw[starts[i] : ends[i]])
    return out, first


def word_hashes(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of all texts, and for each text the index of its first word."""
    if len(offsets) != 2 or len(raw) <= PIECE:
        return _hashed(offsets, raw)
    words = np.concatenate([_hashed(np.array([0, b - a]), raw[a:b])[0] for a, b in text_pieces(raw)])
    return words, np.array([0, len(words)])


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each run of k words of a text, and each text's first; a text of 1 to k-1 words has one, of all its words."""
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    starts = arrowtext.ragged(first[:-1], count)
    length = np.repeat(np.minimum(n, k).astype(np.uint8), count)
    up, _ = powers(k)
    out = np.empty(len(starts), np.uint64)
    for a in range(0, len(starts), PIECE):
        at, size = starts[a : a + PIECE], length[a : a + PIECE]
        h = size.astype(np.uint64)
        for j in range(k):
            some = size > j
            if some.all():
                h += words[at + j] * up[j]
            else:
                h[some] += words[at[some] + j] * up[j]
        out[a : a + PIECE] = mix(h, 1)
    return out, np.concatenate(([0], np.cumsum(count)))


def _joined(raw: np.ndarray, word_follows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """raw with one space before each word, and which bytes that takes; word_follows: whether a byte is no white space and of the same text, for the byte after each."""
    space = arrowtext.is_space(raw)
    keep = ~space | word_follows
    return np.where(space, np.uint8(32), raw)[keep], keep


def text_keys(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of BLAKE2b for each text's words, joined by one space."""
    out = np.zeros((len(offsets) - 1, 2), np.int64)
    if len(offsets) == 2 and len(raw) > PIECE:
        made = hashlib.blake2b(digest_size=16)
        begun = False
        for a in range(0, len(raw), PIECE):
            ahead = raw[a + 1 : a + PIECE + 1]
            follows = np.zeros(len(raw[a : a + PIECE]), bool)
            follows[: len(ahead)] = ~arrowtext.is_space(ahead)
            flat, _ = _joined(raw[a : a + PIECE], follows)
            made.update(np.ascontiguousarray(flat if begun or not len(flat) or flat[0] != 32 else flat[1:]))
            begun |= len(flat) > 0
        out[0] = np.frombuffer(made.digest(), np.int64)
        return out[:, 0].copy(), out[:, 1].copy()
    follows = np.zeros(len(raw), bool)
    follows[:-1] = ~arrowtext.is_space(raw[1:])
    follows[offsets[1:][offsets[1:] > 0] - 1] = False
    flat, keep = _joined(raw, follows)
    ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(keep)))[offsets]
    body = flat.tobytes()
    for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
        out[i] = np.frombuffer(hashlib.blake2b(body[a + (body[a : a + 1] == b" ") : b] if b > a else b"", digest_size=16).digest(), np.int64)
    return out[:, 0].copy(), out[:, 1].copy()
