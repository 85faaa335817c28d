"""Substring dedup by suffix automata: words covered by a window that an earlier document also has are removed.

Segments around shared anchors (see :mod:`.repeats`) meet in shards by anchor. The reference
of an anchor is its segments but for those of the last document, which none can match; a
generalised suffix automaton over the distinct reference segments keeps the smallest
document of each state. The segments of all documents but the first stream through it for
matching statistics, and windows that match in full with a smaller document are removed.
No hash selects windows before; only anchors of more than HOT places have no automaton.

The automata are not broadcast: the reference grows with the corpus, so each shard's
automaton is built where its segments lie, and only the segments that can match it go there.

Defined results: a null text has no words; rows with a null id neither lose nor cost a word;
repeated rows of one id are one document; later copies of a text of `width` words or more
lose every word; an empty table gives an empty result. Words are compared by 64 bits of
hash, equal texts and windows of very common passages by 128.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .repeats import Kind, Segments, remove_repeats


class SuffixAutomaton:
    """Of several sequences, each with an owner; a state knows the smallest owner of its strings."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.owner = [-1], [0], [1 << 62]

    def _state(self, next_: dict[int, int], link: int, length: int) -> int:
        self.next.append(next_)
        self.link.append(link)
        self.length.append(length)
        self.owner.append(1 << 62)
        return len(self.link) - 1

    def _target(self, p: int, c: int) -> int:
        """The state p goes to by c, split if it also stands for longer strings."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        twin = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1)
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        self.link[q] = twin
        return twin

    def add(self, sequence: Iterable[int], owner: int) -> None:
        last = 0
        for c in sequence:
            if c in self.next[last]:
                last = self._target(last, c)
            else:
                new = self._state({}, 0, self.length[last] + 1)
                p = last
                while p >= 0 and c not in self.next[p]:
                    self.next[p][c] = new
                    p = self.link[p]
                self.link[new] = self._target(p, c) if p >= 0 else 0
                last = new
            self.owner[last] = min(self.owner[last], owner)

    def finish(self) -> None:
        """Hand the smallest owners down the suffix links."""
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.owner[s] < self.owner[self.link[s]]:
                self.owner[self.link[s]] = self.owner[s]

    def matches(self, sequence: Iterable[int], width: int) -> Iterator[tuple[int, int]]:
        """(start, smallest owner) of each window of the sequence that the reference has."""
        state, n = 0, 0
        next_, link, length = self.next, self.link, self.length
        for i, c in enumerate(sequence):
            while state and c not in next_[state]:
                state = link[state]
                n = length[state]
            if c in next_[state]:
                state = next_[state][c]
                n += 1
            if n >= width:
                while length[link[state]] >= width:
                    state = link[state]
                n = min(n, length[state])
                yield i - width + 1, self.owner[state]


def decide(s: Segments, kind: Kind) -> Iterator[tuple[int, int, int]]:
    """(segment, lo, hi): ranges of window starts that occur in a smaller document."""
    edges = np.flatnonzero(np.concatenate(([True], s.h[1:] != s.h[:-1], [True]))) if len(s.h) else np.zeros(1, int)
    for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        rep = s.rep[i:j]
        first, last = int(rep.min()), int(rep.max())
        if first == last:
            continue
        reference: dict[bytes, int] = {}
        queries: dict[bytes, list[int]] = {}
        for seg in range(i, j):
            content, own = s.items[s.first[seg] : s.first[seg + 1]].tobytes(), int(s.rep[seg])
            if own < last:
                reference[content] = min(reference.get(content, 1 << 62), own)
            if own > first:
                queries.setdefault(content, []).append(seg)
        automaton = SuffixAutomaton()
        for content, owner in reference.items():
            automaton.add(np.frombuffer(content, "<u8").tolist(), owner)
        automaton.finish()
        for content, segs in queries.items():
            found = list(automaton.matches(np.frombuffer(content, "<u8").tolist(), kind.width))
            at, owner = np.array([x[0] for x in found], np.int64), np.array([x[1] for x in found], np.int64)
            for seg in segs:
                hit = at[owner < s.rep[seg]]
                if len(hit):
                    heads = np.flatnonzero(np.concatenate(([True], hit[1:] != hit[:-1] + 1)))
                    tails = np.append(heads[1:], len(hit)) - 1
                    for start in s.starts[seg]:
                        for x, y in zip(hit[heads].tolist(), hit[tails].tolist(), strict=True):
                            yield seg, int(start) + x, int(start) + y


def remove_repeated_words(spark: SparkSession, docs: DataFrame, width: int = 13, gram: int = 5, **more) -> DataFrame:
    """doc, n, n_removed, n_spans and kept (binary; words joined by one space) of every row; see :func:`.repeats.remove_repeats`."""
    return remove_repeats(spark, docs, Kind(width, min(gram, width), True, True), decide, "automata", **more)
