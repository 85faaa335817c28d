"""Shared Arrow and numpy helpers: text columns as byte buffers, cuts at safe places, memoised token lists."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one call to a tokenizer takes at most, if no single piece is longer.
BATCH_BYTES = 1 << 22
#: The same where every byte needs several 64-bit numbers.
HASH_BYTES = 1 << 20


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give memory that nothing uses back to the machine."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run over a task's batches; what it no longer uses goes back to the machine when they are done.

    Python workers wait for further tasks, and an idle one would keep what its largest task needed.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a text column; nulls count as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("") if col.null_count else col.cast(pa.large_string())
    if not len(col):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    lo, hi = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(col.buffers()[2], np.uint8)[lo:hi] if hi > lo else np.zeros(0, np.uint8)
    return offsets - lo, raw


def slices(offsets: np.ndarray, most: int = BATCH_BYTES):
    """Ranges of rows of at most `most` bytes each; a longer row stands alone, whole."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


def is_space(raw: np.ndarray) -> np.ndarray:
    """Bytes U+0020 and U+0009 to U+000D."""
    return (raw == 32) | ((raw >= 9) & (raw <= 13))


def ends_unicode_space(raw: np.ndarray) -> np.ndarray:
    """Bytes that end a character with Unicode's White_Space, as UTF-8."""
    out = is_space(raw)
    if len(raw) < 2 or raw.max(initial=0) < 128:
        return out
    b1, b2 = raw[1:], raw[:-1]
    out[1:] |= (b2 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0))
    b1, b2, b3 = raw[2:], raw[1:-1], raw[:-2]
    out[2:] |= (b3 == 0xE1) & (b2 == 0x9A) & (b1 == 0x80)
    out[2:] |= (b3 == 0xE2) & (b2 == 0x80) & (((b1 >= 0x80) & (b1 <= 0x8A)) | (b1 == 0xA8) | (b1 == 0xA9) | (b1 == 0xAF))
    out[2:] |= (b3 == 0xE2) & (b2 == 0x81) & (b1 == 0x9F)
    out[2:] |= (b3 == 0xE3) & (b2 == 0x80) & (b1 == 0x80)
    return out


def cut_before_space(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cut every text where an ASCII space follows a character that is no white space.

    Returns the cuts' places, each text's start among them, and for each text the index of
    its first piece. An empty text has no piece.
    """
    starts = is_space(raw)
    if len(raw):
        starts[1:] &= ~ends_unicode_space(raw)[:-1]
        starts[0] = True
        starts[offsets[:-1][offsets[:-1] < len(raw)]] = True
    cuts = np.flatnonzero(starts)
    return np.append(cuts, len(raw)), np.searchsorted(cuts, offsets)


def pieces(cuts: np.ndarray, raw: np.ndarray):
    """The pieces between cuts, by distinct value: (distinct strings as Arrow, code of each piece)."""
    text = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw)))
    coded = text.dictionary_encode()
    return coded.dictionary, np.asarray(coded.indices)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[0].., starts[1].. and so on, each run as long as its length."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    lengths = lengths.astype(np.int64)
    firsts = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts.astype(np.int64) - firsts, lengths)


class Memo:
    """What a function gives for each distinct piece, worked out once while it fits.

    most bounds the bytes of kept pieces and results, about; beyond it the memo starts anew,
    which costs time and never changes a result. Pieces over `long` bytes are not kept.
    """

    def __init__(self, many, most: int = 32 << 20, long: int = 256):
        self.many, self.most, self.long = many, most, long
        self.kept: dict[str, object] = {}
        self.size = 0

    def __call__(self, texts: list[str]) -> list:
        kept = self.kept
        out = [kept.get(t) for t in texts]
        todo = [i for i, x in enumerate(out) if x is None]
        at = 0
        while at < len(todo):
            size, end = 0, at
            while end < len(todo) and (end == at or size + len(texts[todo[end]]) <= BATCH_BYTES // 4):
                size += len(texts[todo[end]])
                end += 1
            for i, x in zip(todo[at:end], self.many([texts[i] for i in todo[at:end]]), strict=True):
                out[i] = x
                if len(texts[i]) <= self.long:
                    if self.size > self.most:
                        kept.clear()
                        self.size = 0
                    kept[texts[i]] = x
                    self.size += 240 + 2 * len(texts[i])
            at = end
        return out
