"""Connected components of a graph given as a table of links, without gathering it anywhere.

Each partition first replaces its links by a spanning forest, at most one row a node. Then
rounds of large-star and small-star (every node's neighbours are tied to the smallest one)
go on until all trees are stars; minima are pre-aggregated before each shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import lean
from .runs import Forest
from .scratch import Scratch

STAR = "node long, root long"


def forest(links: DataFrame) -> DataFrame:
    """(node, root) with the components of links (a, b), one row a node and partition at most."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Forest()
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                f.union(a, b)
        yield f.edges()

    return links.toDF("a", "b").mapInArrow(lean(join), STAR)


def components(tmp: Scratch, links: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of links (a, b) but the smallest of its component, which is root."""
    now = tmp.save(forest(links), f"{name}0")
    for turn in range(1, 100):
        ends = now.select(F.col("node").alias("x"), F.lit(1).alias("n"), F.lit(0).alias("r")).union(now.select("root", F.lit(0), F.lit(1)))
        open_ = ends.groupBy("x").agg(F.sum("n").alias("n"), F.max("r").alias("r")).where("n > 1 or (n = 1 and r = 1)")
        if open_.isEmpty():
            return now
        both = now.select(F.col("node").alias("u"), F.col("root").alias("v")).union(now.select("root", "node"))
        # Written, so that the join's stage does nothing else and a root of very many nodes can be split.
        least = tmp.save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}least{turn}")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v")
        before, now = turn - 1, tmp.save(forest(small.distinct()), f"{name}{turn}")
        tmp.drop(f"{name}{before}")
        tmp.drop(f"{name}least{turn}")
    raise RuntimeError("components did not settle")
