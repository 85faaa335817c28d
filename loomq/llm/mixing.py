"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a share of the words by weight, up to `most` times what it has; what that
leaves over is shared again by weight among the others until none is above. A source's
share is made of complete epochs first; the rest is a weighted sample without replacement:
each document's key is an exponential variate, of a hash of its id, over its quality
weight, and documents are taken in the order of the keys while their running total, up to
half of the last one, is within the rest.

What is taken is the rows up to one key of each source, as running totals only grow. So the
order is worked out on narrow rows (source, key and size), and a row of docs needs no more
than its source's cut: texts are never shuffled for it. Running totals are made over ranges
of (source, key, size) that hold about ROWS_A_PART rows each, whatever the sources and the
weights are, and then within a range; sources are ranked and shared the same way.

Defined results: null texts have no words; a null source is a source of its own, after all
others; documents without words are never taken; rows of equal key and size at the cut are
taken in the order of a hash of all their columns; sources without words have target 0; an
empty table gives an empty result. Other columns pass through :func:`mixed`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quality import SPACE, SYMBOLS
from .scratch import Scratch

#: Rows of a range within which running totals are made by one task.
ROWS_A_PART = 1 << 17


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def uniform(*ids: Column, seed: int = 0) -> Column:
    """In (0, 1), by the first 52 bits of an MD5 of the seed and the ids: the same at every run and in every engine."""
    text = F.concat_ws("/", F.lit(str(seed)), *(F.coalesce(i.cast("string"), F.lit("null")) for i in ids))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def running(tmp: Scratch, rows: DataFrame, by: list[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """rows with the sums over all rows before each one in the order of by. rows must be a written table."""
    parts = max(1, math.ceil(rows.count() / ROWS_A_PART))
    dealt = tmp.save(rows.repartitionByRange(parts, *by).withColumn("__part", F.spark_partition_id()), name)
    # One row a range.
    each = dealt.groupBy("__part").agg(*(F.sum(c).alias(k) for k, c in sums.items()))
    before = Window.partitionBy(F.lit(1)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = each.select("__part", *(F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"__{k}") for k in sums))
    within = Window.partitionBy("__part").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    inside = dealt.withColumns({k: F.coalesce(F.sum(c).over(within), F.lit(0)) for k, c in sums.items()})
    return inside.join(offsets, "__part").select(*rows.columns, *((F.col(k) + F.col(f"__{k}")).alias(k) for k in sums))


def source_targets(tmp: Scratch, sizes: DataFrame, most: float = 3.0, weights: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """sizes (source, source_size; a written table) with target: one row a source throughout.

    Sources by code point, null last, weigh `weights`, repeating. A source is capped where
    most * size / weight is at most the common rate; with the sources in order of that
    ratio, the rate is what the capped ones leave over the weight of the others.
    """
    by_name = F.col("source").asc_nulls_last()
    s = running(tmp, sizes, [by_name], {"place": F.lit(1)}, "names")
    s = s.withColumn("weight", F.get(F.lit(list(weights)), (F.col("place") % len(weights)).cast("int"))).withColumn("cap", most * F.col("source_size"))
    s = tmp.save(s.withColumn("ratio", F.col("cap") / F.col("weight")), "ratios")
    total = s.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    s = running(tmp, s, [F.col("ratio"), by_name], {"capped": F.col("cap"), "lighter": F.col("weight")}, "rates")
    rate = (F.lit(total["size"]) - F.col("capped")) / (F.lit(total["weight"]) - F.col("lighter"))
    # The first source in order of the ratio that is not capped tells the rate of all that follow.
    common = s.select("ratio", "lighter", rate.alias("rate")).where("ratio > rate").agg(F.min(F.struct("ratio", "lighter", "rate")).alias("first")).first()["first"]
    target = F.col("cap") if common is None else F.least(F.col("cap"), F.lit(common["rate"]) * F.col("weight"))
    return s.select("source", "source_size", target.alias("target"))


def source_cuts(tmp: Scratch, narrow: DataFrame, most: int, weights: tuple[float, ...]) -> DataFrame:
    """For each source of narrow (source, key, size; a written table): source_size, target, epochs, the cut (key, size), how many rows equal it and how many of these are taken."""
    rows = tmp.save(running(tmp, narrow, [F.col("source").asc_nulls_last(), F.col("key"), F.col("size")], {"before": F.col("size")}, "order"), "totals")
    sizes = tmp.save(rows.groupBy("source").agg(F.min("before").alias("begin"), F.sum("size").alias("source_size")), "sizes")
    targets = source_targets(tmp, sizes.select("source", "source_size"), float(most), weights)
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    targets = tmp.save(_by_source(targets, sizes.select("source", "begin"), "inner"), "targets")
    fits = (F.col("epochs") < most) & (F.col("before") - F.col("begin") + F.col("size") / 2 <= F.col("rest"))
    told = _by_source(rows, targets, "inner").withColumn("fits", fits)
    cuts = tmp.save(told.where("fits").groupBy("source").agg(F.max(F.struct("key", "size")).alias("cut")), "cuts")
    equal = _by_source(told, cuts, "inner").where((F.col("key") == F.col("cut.key")) & (F.col("size") == F.col("cut.size")))
    equal = equal.groupBy("source").agg(F.first("cut").alias("cut"), F.count(F.lit(1)).alias("equal"), F.count(F.when(F.col("fits"), 1)).alias("fit"))
    return tmp.save(_by_source(targets.drop("begin", "rest"), equal, "left"), "plan")


def _by_source(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """left with right's columns; null sources are equal."""
    names = [c for c in right.columns if c != "source"]
    right = right.select(F.col("source").alias("__source"), *names)
    return left.join(right, F.col("source").eqNullSafe(F.col("__source")), how).drop("__source")


def mix(spark, docs: DataFrame, size: Column, quality: Column | None = None, id_col: str = "doc_id", source_col: str = "source", most: int = 3, seed: int = 0, weights: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """doc (a struct of the row's columns), size, source_size, target, taken (words) and copies of every row.

    size and quality (a positive weight) are expressions over docs. docs is read twice: for
    the order of its rows, and to tell each row by its source's cut.
    """
    tmp = Scratch(spark, "mix")
    weight = F.greatest(F.coalesce(quality, F.lit(1.0)), F.lit(1e-6)) if quality is not None else F.lit(1.0)
    key = -F.log(uniform(F.col(id_col), seed=seed)) / weight
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col(source_col).alias("source"), size.alias("size"), key.alias("key"))
    plan = source_cuts(tmp, tmp.save(rows.select("source", "key", "size"), "rows"), most, weights)
    told = _by_source(rows, plan, "inner")
    at_cut = (F.col("key") == F.col("cut.key")) & (F.col("size") == F.col("cut.size"))
    below = (F.col("key") < F.col("cut.key")) | ((F.col("key") == F.col("cut.key")) & (F.col("size") < F.col("cut.size")))
    told = told.withColumn("more", F.coalesce(below | (at_cut & (F.col("fit") == F.col("equal"))), F.lit(False)))
    if not plan.where("fit < equal").isEmpty():  # of some source's equal rows, some are taken
        split = F.coalesce(at_cut & (F.col("fit") < F.col("equal")), F.lit(False))
        nth = F.row_number().over(Window.partitionBy("source").orderBy(F.xxhash64("doc")))
        told = told.where(~split).unionByName(told.where(split).withColumn("more", nth <= F.col("fit")))
    copies = F.when(F.col("size") > 0, F.col("epochs") + F.col("more").cast("long")).otherwise(F.lit(0)).cast("long")
    return told.withColumn("copies", copies).select("doc", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed(spark, docs: DataFrame, text_col: str = "text", quality: Column | None = None, **more) -> DataFrame:
    """The mix itself: each row of docs as often as the mix takes it."""
    made = mix(spark, docs, word_count(F.col(text_col)), quality, **more).where("copies > 0")
    return made.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")


def quality_weight(text: Column) -> Column:
    """From 0.1 to 1: the squared share of a text's characters that are no markup symbols."""
    body = F.coalesce(text, F.lit(""))
    share = F.when(F.length(body) > 0, (F.length(body) - F.regexp_count(body, F.lit(f"[{SYMBOLS}]"))) / F.length(body)).otherwise(F.lit(1.0))
    return F.greatest(share * share, F.lit(0.1))
