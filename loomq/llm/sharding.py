"""Sharding along a Hilbert curve: quantised metadata, sorted by curve index, cut into runs of equal count.

Native throughout. A first pass counts rows by curve cell (2**(dims*bits) at most); cells
are split by a hash of the id into buckets of about `target` rows, buckets are counted and
their running totals joined back, and rows are numbered within their bucket only. So no
task sorts more than a bucket, whatever share of the rows one cell holds.

Languages and sources are quantised by their order, so a run holds neighbouring values and
the least and greatest of a file prune; see :func:`places`. Equal texts are rows of their own:
law `rows` gives each a slot, and those of equal language, source and size are neighbours
in the curve, but the cuts between shards may part them.

Defined results: null metadata take place 0, a null text has no bytes and the CRC-32 of
nothing (0), null ids hash like a value of their own; equal rows take neighbouring slots
in either order, which gives the same rows; an empty table gives an empty result; other
columns are not read, so clashing names do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch


def hilbert_index(point: list[int], bits: int) -> int:
    """The place on the Hilbert curve of a point with coordinates below 2**bits."""
    x, n = list(point), len(point)
    high = 1 << (bits - 1)
    q = high
    while q > 1:  # undo the excess work of the inverse transform
        p = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= p
            else:
                t = (x[0] ^ x[i]) & p
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    t, q = 0, high
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    out = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = out << 1 | (v >> b & 1)
    return out


def hilbert_cell(dims: list[Column], bits: int) -> Column:
    """The curve index of coordinates below 2**bits, looked up in a table made by rule."""
    if len(dims) * bits > 12:
        raise ValueError("dims * bits must be 12 at most: the table is part of the plan")
    side = 1 << bits
    points = [[c // side ** (len(dims) - 1 - k) % side for k in range(len(dims))] for c in range(side ** len(dims))]
    table = F.lit([hilbert_index(p, bits) for p in points])
    place = F.lit(0)
    for d in dims:
        place = place * side + d
    return F.get(table, place.cast("int"))


def log_scale(size: Column, bits: int) -> Column:
    """floor(log2(size + 1)), by its binary digits, capped to the grid."""
    digits = F.length(F.bin((F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)) + 1).cast("long")))
    return F.least(digits - 1, F.lit((1 << bits) - 1)).cast("int")


def spreading(value: Column) -> Column:
    """A number of 60 bits from the MD5 of an id: the same in every engine."""
    return F.conv(F.substring(F.md5(F.coalesce(value.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def places(rows: DataFrame, column: str, bits: int, most: int = 4096) -> list[tuple[str, int]]:
    """(least value, place) in order: how the values of a column are spread over 2**bits places, by their order.

    The places hold about equally many of the distinct values, which are told by their first
    64 characters; of more than `most`, those with the smallest hashes say where places begin.
    """
    values = rows.select(F.substring(F.col(column).cast("string"), 1, 64).alias("v")).where("v is not null").distinct()
    some = sorted(r.v for r in values.orderBy(F.xxhash64("v"), "v").limit(most).collect())
    made: dict[int, str] = {}
    for i, v in enumerate(some):
        made.setdefault((i << bits) // len(some), v)
    return [(v, p) for p, v in made.items()]


def category(value: Column, found: list[tuple[str, int]]) -> Column:
    """The place of a value by :func:`places`; 0 for null."""
    out, v = F.lit(0), F.substring(value.cast("string"), 1, 64)
    for start, place in found:
        out = F.when(v >= start, place).otherwise(out) if place else out
    return F.coalesce(out, F.lit(0)).cast("int")


def hilbert_shards(spark, rows: DataFrame, id_col: str, cell: Column, shards: int = 16, target: int = 1 << 20, split: int = 16, ties: tuple[str, ...] = ()) -> DataFrame:
    """rows with shard and slot: runs along the curve whose counts differ by one at most.

    rows should be narrow; cell is a curve index from :func:`hilbert_cell`. ties: further
    columns that order rows of equal id.
    """
    tmp = Scratch(spark, "shards")
    kept = tmp.save(rows.withColumn("__cell", cell), "rows")
    cells = kept.groupBy("__cell").agg(F.count(F.lit(1)).alias("__in_cell"))
    # At most one row for each cell of the grid.
    parts = F.greatest(F.lit(split), F.ceil(F.col("__in_cell") / target)).cast("long")
    salted = kept.join(F.broadcast(cells), "__cell").withColumn("__salt", F.pmod(spreading(F.col(id_col)), parts)).drop("__in_cell")
    # split rows for each cell and one for each `target` rows, at most.
    counts = salted.groupBy("__cell", "__salt").agg(F.count(F.lit(1)).alias("__n"))
    inner = Window.partitionBy("__cell").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))  # over the cells, a bounded number of rows
    before = cells.select("__cell", F.coalesce(F.sum("__in_cell").over(outer), F.lit(0)).alias("__before"), F.sum("__in_cell").over(whole).alias("__total"))
    offsets = counts.select("__cell", "__salt", F.coalesce(F.sum("__n").over(inner), F.lit(0)).alias("__within")).join(F.broadcast(before), "__cell")
    offsets = tmp.save(offsets, "offsets")
    order = Window.partitionBy("__cell", "__salt").orderBy(id_col, *ties)
    placed = salted.withColumn("__rank", F.row_number().over(order).cast("long")).join(F.broadcast(offsets), ["__cell", "__salt"])
    at = F.col("__before") + F.col("__within") + F.col("__rank") - 1
    small, more = F.expr(f"__total div {shards}"), F.col("__total") % shards
    head = more * (small + 1)
    placed = placed.withColumn("__at", at).withColumns({"__small": small, "__more": more, "__head": head})
    in_head = F.col("__at") < F.col("__head")
    shard = F.when(in_head, F.expr("__at div (__small + 1)")).otherwise(F.col("__more") + F.expr("(__at - __head) div greatest(__small, 1)"))
    slot = F.when(in_head, F.expr("__at % (__small + 1)")).otherwise(F.expr("(__at - __head) % greatest(__small, 1)"))
    return placed.withColumns({"shard": shard.cast("int"), "slot": slot.cast("long")}).drop("__cell", "__salt", "__rank", "__before", "__within", "__total", "__at", "__small", "__more", "__head")


def _content() -> list[Column]:
    """size, text_crc32 and meta of a document: with its id, all that its place depends on."""
    text = F.coalesce(F.col("text"), F.lit(""))
    meta = F.xxhash64(F.col("lang").isNull(), "lang", F.col("source").isNull(), "source")
    return [(F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), meta.alias("meta")]


def document_shards(spark, docs: DataFrame, shards: int = 16, bits: int = 4, **more) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32, meta (a hash of language and source), shard and slot of every document.

    The curve's dimensions are the language, the source and the size of the text.
    """
    of = {c: category(F.col(c), places(docs, c, bits)).alias(f"__{c}") for c in ("lang", "source")}
    narrow = docs.select("doc_id", *_content(), *of.values())
    cell = hilbert_cell([F.col("__lang"), F.col("__source"), log_scale(F.col("size"), bits)], bits)
    return hilbert_shards(spark, narrow, "doc_id", cell, shards, ties=("text_crc32", "size", "meta"), **more).drop("__lang", "__source")


def write_shards(df: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write df into one folder a shard, in slot order, so that file statistics prune in every dimension.

    placed is :func:`document_shards` of df. Each row goes to one place of a row with its id
    (null or not), text and metadata: rows alike in these are numbered on both sides.
    """
    alike = [id_col, "size", "text_crc32", "meta"]
    own = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("doc"), F.col(id_col), *_content())
    own = own.withColumn("nth", F.row_number().over(Window.partitionBy(*alike).orderBy(F.xxhash64("doc")))).alias("a")
    places = placed.select(*alike, "shard", "slot").withColumn("nth", F.row_number().over(Window.partitionBy(*alike).orderBy("shard", "slot"))).alias("b")
    same = F.lit(True)
    for c in (*alike, "nth"):
        same = same & F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`"))
    rows = own.join(places, same).select("doc.*", "b.shard", "b.slot")
    rows.repartition("shard", F.expr("slot div 1000000")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
