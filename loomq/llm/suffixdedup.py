"""Suffix-array dedup: bytes covered by a `width`-byte string that begins at another place are removed.

Segments around shared anchors (see :mod:`.repeats`) are cut to the hull of the windows
that a hash shows twice in their group. A content met at several places is repeated as it
stands. Where a group has differing contents, a suffix array made by linear grouping
(:mod:`.suffixarray`) over them finds the windows that they share: neighbours in the array
are compared byte by byte.

Defined results: a null text is an empty one; texts shorter than width give nothing; equal
texts of width bytes or more lose every byte; repeated rows count as places of their own,
null ids too; an empty table gives an empty result. Equal texts are told apart from others
by 128 bits of hash, and so are the windows of very common passages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .repeats import Kind, Segments, hulls, remove_repeats, window_keys
from .suffixarray import repeated_windows


def decide(s: Segments, kind: Kind) -> Iterator[tuple[int, int, int]]:
    """(segment, lo, hi): ranges of window starts that occur elsewhere."""
    w = window_keys(s, kind)
    order = np.argsort(w.key, kind="stable")
    equal = w.key[order][1:] == w.key[order][:-1]
    twice = np.array([len(x) > 1 for x in s.starts], bool)[w.seg]
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    # Distinct contents of each group, with the segments and places where they stand.
    by_group: dict[int, dict[bytes, list[tuple[int, int]]]] = {}
    for seg, a, b in hulls(w, s, twice, kind):
        by_group.setdefault(int(s.h[seg]), {}).setdefault(s.items[a:b].tobytes(), []).append((seg, a))
    parts: list[np.ndarray] = []
    starts: list[np.ndarray] = []
    users: list[list[tuple[int, int]]] = []
    size = 0
    chosen = np.zeros(len(s.items) + 1, bool)
    chosen[w.at[twice]] = True
    for contents in by_group.values():
        for content, places in contents.items():
            if len(places) > 1 or len(s.starts[places[0][0]]) > 1:
                n = len(content) - kind.width
                for seg, a in places:
                    for start in s.starts[seg]:
                        lo = int(start + a - s.first[seg])
                        yield seg, lo, lo + n
        if len(contents) > 1:
            for content, places in contents.items():
                a = places[0][1]
                starts.append(np.flatnonzero(chosen[a : a + len(content) - kind.width + 1]) + size)
                parts += [np.frombuffer(content, np.uint8).astype(np.int16) + 1, np.zeros(1, np.int16)]
                users.append(places)
                size += len(content) + 1
    if not users:
        return
    flat = np.concatenate(starts)
    again = repeated_windows(np.concatenate(parts), flat, kind.width)
    at, base = 0, 0
    for own, places, content in zip(starts, users, parts[::2], strict=True):
        hit = own[again[at : at + len(own)]] - base
        at += len(own)
        base += len(content) + 1
        seg, a = places[0]
        if len(places) > 1 or len(s.starts[seg]) > 1 or not len(hit):
            continue
        shift = int(s.starts[seg][0] + a - s.first[seg])
        head = np.flatnonzero(np.concatenate(([True], hit[1:] != hit[:-1] + 1)))
        tail = np.append(head[1:], len(hit)) - 1
        for x, y in zip(hit[head].tolist(), hit[tail].tolist(), strict=True):
            yield seg, shift + x, shift + y


def remove_repeated_bytes(spark: SparkSession, docs: DataFrame, width: int = 200, gram: int = 32, **more) -> DataFrame:
    """doc, n, n_removed, n_spans and kept (binary) of every row; see :func:`.repeats.remove_repeats`."""
    return remove_repeats(spark, docs, Kind(width, min(gram, width), False, False), decide, "suffixes", **more)


def without_repeats(spark: SparkSession, docs: DataFrame, text_col: str = "text", **more) -> DataFrame:
    """docs with the repeated bytes taken out of the text; what a cut leaves of a split character goes too."""
    out = remove_repeated_bytes(spark, docs, text_col=text_col, characters=True, **more)
    kept = F.when(F.col("n_removed") == 0, F.col(f"doc.`{text_col}`")).otherwise(F.col("kept").cast("string"))
    return out.select(*((kept if c == text_col else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))
