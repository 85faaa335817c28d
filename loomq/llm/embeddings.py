"""Embedding near-dedup by sorted projection passes.

A pass hashes every vector to BITS sign bits of random projections, sorts the vectors of a
label by the concatenated bits and compares each with its `window` predecessors; every pair
found at or above the threshold is verified by the exact cosine at once. The pairs of all
passes are united. How many passes are made follows from the largest label and the recall
asked for, so recall stays the same at every size (see :func:`passes_for`).

That number takes pairs to be within a window where their first :func:`bits_for` bits are
equal. Where vectors cluster, more of them share those bits than a window holds, so runs of
equal first bits that are longer are compared whole, in blocks of PIECE, save where all are
in one component by then. So each pair that shares its first bits in some pass was compared
or linked by others, whatever the data: the bits depend on the projections only. A run
costs the square of its members that no windows joined. Partitions end between runs.

Pairs between members of one component that no window showed side by side are no less
links, so links are counted exactly within each component, in blocks of BLOCK vectors,
that emit counts only. Equal vectors are one class with a count throughout.

Defined results: vectors that are null, zero or hold null or non-finite components, and
vectors with a null label or id, have no links and are components of their own (component_id
is their id, kept is true); vectors of different lengths never link; repeated rows are
vectors of their own that link with each other; an empty table gives an empty result; other
columns are not read. Classes are told apart by 128 bits of hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrowtext import lean
from .components import components
from .runs import Forest, runs
from .scratch import Scratch

BITS = 64
BLOCK = 256
PIECE = 1024


def passes_for(n: int, threshold: float, window: int, recall: float) -> int:
    """Passes after which a pair at the threshold was within a window with probability `recall`, about.

    In a pass, the pair comes close if its first log2(n / window) bits are equal.
    """
    same = 1 - math.acos(threshold) / math.pi
    hit = same ** max(0.0, math.log2(max(n, 1) / window) + 1)
    return max(2, math.ceil(math.log(1 - recall) / math.log(1 - min(hit, 0.9))))


def bits_for(n: int, window: int) -> int:
    """First bits by which runs are made: no more than :func:`passes_for` counts on."""
    return min(BITS - 1, max(0, math.floor(math.log2(max(n, 1) / window) + 1)))


def unit(lists) -> np.ndarray:
    """Rows of unit length, in double precision."""
    x = np.asarray(lists.flatten() if isinstance(lists, pa.ListArray) else lists.combine_chunks().flatten(), np.float64).reshape(len(lists), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # keeps squares in range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _keys(passes: int, seed: int, vectors: bool = True):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = np.asarray(batch.column(1))
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                if dim not in planes:
                    planes[dim] = np.random.default_rng((seed, int(dim))).standard_normal((int(dim), passes * BITS))
                for i in range(0, part.num_rows, 2048):
                    some = part.slice(i, 2048)
                    bits = np.packbits((unit(some.column(3)) @ planes[dim] > 0).reshape(some.num_rows, passes, BITS // 8, 8), axis=3)
                    keys = np.ascontiguousarray(bits[..., 0]).view(">u8")[..., 0].astype(np.uint64).view(np.int64)
                    for p in range(passes):
                        made = [some.column(0), pa.array(np.full(some.num_rows, p, np.int32)), pa.array(keys[:, p]), some.column(2), some.column(3)]
                        made, names = (made, ["g", "p", "h", "c", "v"]) if vectors else (made[:4], ["g", "p", "h", "c"])
                        yield pa.RecordBatch.from_arrays(made, names=names)

    return run


def _windows(threshold: float, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Forest()
        groups: dict[str, int] = {}
        g0, c0, x0 = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for batch in batches:
            labels = batch.column(0).dictionary_encode()
            code = np.array([groups.setdefault(s, len(groups)) for s in labels.dictionary.to_pylist()], np.int64)
            g = (code[np.asarray(labels.indices)] << 20) + np.asarray(batch.column(1))
            c, sizes = np.asarray(batch.column(3)), np.asarray(batch.column(4).value_lengths())
            edges = np.concatenate(([0], np.flatnonzero(sizes[1:] != sizes[:-1]) + 1, [len(sizes)]))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b == a:
                    continue
                x = unit(batch.column(4).slice(a, b - a))
                if x0 is None or x0.shape[1] != x.shape[1]:
                    g0, c0, x0 = np.zeros(0, np.int64), np.zeros(0, np.int64), x[:0]
                gs, cs, xs, k = np.concatenate((g0, g[a:b])), np.concatenate((c0, c[a:b])), np.concatenate((x0, x)), len(g0)
                for d in range(1, min(window, len(gs) - 1) + 1):
                    lo = max(k, d)
                    near = (gs[lo:] == gs[lo - d : len(gs) - d]) & (np.einsum("ij,ij->i", xs[lo:], xs[lo - d : len(gs) - d]) >= threshold)
                    for i in np.flatnonzero(near) + lo:
                        found.union(int(cs[i]), int(cs[i - d]))
                g0, c0, x0 = gs[-window:], cs[-window:], xs[-window:]
        yield found.edges()

    return run


def _pairs(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Forest()
        for t in runs(batches, ["g", "p", "run", "i", "j"]):
            own, c, comp = np.asarray(t["own"]), np.asarray(t["c"]), np.asarray(t["comp"])
            x = unit(t["v"])
            a, b = own == t["i"][0].as_py(), own == t["j"][0].as_py()
            near = (x[a] @ x[b].T >= threshold) & (comp[a][:, None] != comp[b][None, :])
            for y, z in zip(*np.nonzero(near), strict=True):
                found.union(int(c[a][y]), int(c[b][z]))
        yield found.edges()

    return run


def _counts(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["comp", "i", "j"]):
            own, ids, n = np.asarray(t["own"]), np.asarray(t["c"]), np.asarray(t["copies"])
            x = unit(t["v"])
            i, j = t["i"][0].as_py(), t["j"][0].as_py()
            a, b = (own == i), (own == j)
            near = x[a] @ x[b].T >= threshold
            if i == j:
                np.fill_diagonal(near, False)
                out_ids, out_n = ids[a], near @ n[b]
            else:
                out_ids, out_n = np.concatenate((ids[a], ids[b])), np.concatenate((near @ n[b], near.T @ n[a]))
            yield pa.RecordBatch.from_arrays([pa.array(out_ids), pa.array(out_n.astype(np.int64))], names=["c", "n"])

    return run


def near_vectors(spark: SparkSession, df: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", window: int = 32, recall: float = 0.999, rows_a_partition: int = 1 << 14, seed: int = 7) -> DataFrame:
    """id, n_links, component_id and kept of every row; see the module's text."""
    tmp = Scratch(spark, "embeddings")
    v = F.col("v")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).alias("v"))
    good = F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & ~F.coalesce(odd, F.lit(True)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    group = F.concat_ws("/", F.size(v).cast("string"), "label")
    rows = rows.select("id", F.when(good, group).alias("g"), F.xxhash64(F.lit(1), v).alias("k1"), F.xxhash64(F.lit(2), v).alias("k2"), F.size(v).alias("dim"), "v")
    keys = ["g", "k1", "k2"]
    classes = tmp.save(rows.where("g is not null").groupBy(*keys).agg(F.min("id").alias("c"), F.count(F.lit(1)).alias("copies"), F.first("dim").alias("dim"), F.first("v").alias("v")), "classes")
    n, largest = classes.groupBy("g").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    passes = passes_for(largest, threshold, window, recall)
    kind = classes.schema["v"].dataType.simpleString()
    hashed = classes.select("g", "dim", "c", "v").mapInArrow(lean(_keys(passes, seed)), f"g string, p int, h long, c long, v {kind}")
    parts = max(1, math.ceil(n * passes / rows_a_partition))
    bits = bits_for(largest, window)
    run = F.shiftright("h", BITS - bits) if bits else F.lit(0).cast("long")
    ordered = hashed.withColumn("run", run).repartitionByRange(parts, "g", "p", "run").drop("run").sortWithinPartitions("g", "p", "h", "c")
    stars = components(tmp, ordered.mapInArrow(lean(_windows(threshold, window)), "node long, root long"))
    # Runs that a window does not span and that are not in one component yet.
    short = classes.select("g", "dim", "c", "v").mapInArrow(lean(_keys(passes, seed, vectors=False)), "g string, p int, h long, c long").withColumn("run", run).drop("h")
    rooted = tmp.save(short.join(stars.toDF("c", "root"), "c", "left").withColumn("comp", F.coalesce("root", "c")).drop("root"), "rooted")
    spread = (F.col("n") > window + 1) & (F.col("low") < F.col("high"))
    long = rooted.groupBy("g", "p", "run").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high")).where(spread)
    long = tmp.save(long.select("g", "p", "run", F.ceil(F.col("n") / PIECE).alias("pieces")), "long")
    if not long.isEmpty():
        open_ = rooted.join(long, ["g", "p", "run"]).withColumn("own", F.pmod(F.xxhash64("c"), F.col("pieces")))
        open_ = open_.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).join(classes.select("c", "v"), "c")
        open_ = open_.select("g", "p", "run", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "c", "comp", "v")
        keyed = ["g", "p", "run", "i", "j"]
        more = open_.repartition(*keyed).sortWithinPartitions(*keyed).mapInArrow(lean(_pairs(threshold)), "node long, root long")
        stars = components(tmp, stars.union(more), "joined")
    # Every member of a component of two or more, the root included.
    members = stars.select(F.col("node").alias("c"), F.col("root").alias("comp")).union(stars.select("root", "root").distinct())
    members = tmp.save(members.toDF("c", "comp"), "members")
    sizes = members.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    dealt = members.join(sizes, "comp").withColumn("own", F.pmod(F.xxhash64("c"), F.col("blocks"))).join(classes.select("c", "copies", "v"), "c")
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("comp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "c", "copies", "v")
    counted = dealt.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j").mapInArrow(lean(_counts(threshold)), "c long, n long").groupBy("c").agg(F.sum("n").alias("n"))
    found = tmp.save(classes.select(*keys, "c", "copies").join(members, "c", "left").join(counted, "c", "left"), "found")
    out = rows.select("id", *keys).join(found, keys, "left")
    comp = F.coalesce("comp", "c", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce(F.col("copies") - 1 + F.coalesce("n", F.lit(0)), F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.col("id").eqNullSafe(comp).alias("kept"))
