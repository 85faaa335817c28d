"""Streaming over sorted Arrow batches: rows of equal keys together, without gathering a partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """One table for each run of equal integer keys; batches must be sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [np.asarray(batch.column(batch.schema.get_field_index(k))) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for v in values:
            change[1:] |= v[1:] != v[:-1]
        change[0] = last is not None and tuple(v[0] for v in values) != last
        cuts = np.flatnonzero(change).tolist()
        last = tuple(v[-1] for v in values)
        at = 0
        for cut in cuts:
            if cut > at:
                held.append(batch.slice(at, cut - at))
            if held:
                yield pa.Table.from_batches(held)
            held, at = [], cut
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


class Forest:
    """Union-find with the smallest member as root."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (y := up.get(root, root)) != root:
            root = y
        while (y := up.get(x, x)) != root and x != root:
            up[x], x = root, y
        return root

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self) -> pa.RecordBatch:
        """(node, root) for every node that is not a root."""
        nodes = list(self.up)
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([self.find(x) for x in nodes], pa.int64())], names=["node", "root"])
