"""MinHash near-dedup by ProbMinHash: signatures that estimate the probability Jaccard of weighted shingles.

A text's shingles are its runs of five words, weighted by how often they occur in it; a
text of one to four words has one shingle. For each shingle a Poisson process of the rate
of its weight, seeded by the shingle, drops arrivals into random registers; a register
holds the shingle that came first, and a shingle stops once its time is past the latest
register of its text. Registers agree with the probability Jaccard

    J(a, b) = sum over common d of 1 / sum over e of max(a[e] / a[d], b[e] / b[d]),

which is the ordinary Jaccard where no shingle repeats. Signatures are banded (25 bands of
5: a pair at 0.8 meets with probability 0.99995), candidates are verified by the exact J
and linked pairs are united.

Texts with equal word sequences (128 bits of BLAKE2b) are one class and only its smallest
id is signed into bands. Within a bucket, every class is first compared with the smallest
one. Buckets that still hold several components are dealt in blocks of BLOCK members; those
outside the main component visit all blocks, and pairs of different components are compared
there: by the exact J, save where an upper bound of J shows that they are no link (see
:func:`may_link`). Only links leave the task, so none is lost and no bucket is expanded
into its pairs. Repeated rows are verified once: texts are joined once for each id and text.

Defined results: null texts and texts without words have no shingles, link with nothing
and are classes of their own, by their id; a row with a null id takes the class of its words
and is never the one that is kept, if a row with an id has them too; repeated rows share a class and all are kept in
the table of classes (the stage keeps one); an id with differing texts links by any of them;
an empty table gives an empty result; only the id and text columns are read; whole texts are
signed, in pieces where they are long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrowtext, wordhash
from .arrowtext import lean
from .components import components
from .runs import Forest, runs
from .scratch import Scratch

SHINGLE, BANDS, ROWS, BLOCK, VISITORS = 5, 25, 5, 256, 32
#: Bytes of texts and shingles that a task keeps from block to block.
CACHE = 32 << 20
SIGNED = "id long, k1 long, k2 long, bands array<long>, key long"
#: Shingles whose arrivals are drawn together.
PIECE = 1 << 18


def weighted(shingles: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, their counts and each text's first."""
    if not len(shingles):
        return shingles, np.zeros(0, np.int64), first
    if len(first) == 2:
        kinds, counts = np.unique(shingles, return_counts=True)
        return kinds, counts, np.array([0, len(kinds)])
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((shingles, doc))
    s, d = shingles[order], doc[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    return s[at], np.diff(np.append(at, len(s))), np.searchsorted(d[at], np.arange(len(first)))


def signatures(shingles: np.ndarray, weights: np.ndarray, first: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A row of k registers for each text; texts without shingles have zeros."""
    docs = len(first) - 1
    earliest, holder, latest = np.full(docs * k, np.inf), np.zeros(docs * k, np.uint64), np.full(docs, np.inf)
    doc = np.repeat(np.arange(docs), np.diff(first))
    for a in range(0, len(shingles), PIECE):
        some = slice(a, a + PIECE)
        _arrivals(shingles[some], weights[some], doc[some], earliest, holder, latest, k, seed)
    return holder.reshape(docs, k)


def _arrivals(item: np.ndarray, weights: np.ndarray, doc: np.ndarray, earliest: np.ndarray, holder: np.ndarray, latest: np.ndarray, k: int, seed: int) -> None:
    """Draw arrivals of some shingles into the registers until all are past the latest of their text."""
    state, time, rate = wordhash.mix(item, seed + 11), np.zeros(len(item)), weights.astype(np.float64)
    turn = 0
    while len(item):
        state = wordhash.mix(state, turn & 7)
        time = time - np.log(((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
        register = ((wordhash.mix(state, 8) >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
        ahead = time < latest[doc]
        if not ahead.all():
            state, time, rate, item, doc, register = (x[ahead] for x in (state, time, rate, item, doc, register))
        at = doc * k + register
        np.minimum.at(earliest, at, time)
        won = earliest[at] == time
        holder[at[won]] = item[won]
        turn += 1
        if turn < 8 or turn % 8 == 0:
            open_ = np.unique(doc)
            latest[open_] = earliest.reshape(-1, k)[open_].max(1)
            live = time < latest[doc]
            state, time, rate, item, doc = (x[live] for x in (state, time, rate, item, doc))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, raw = arrowtext.buffers(batch.column(1))
        for i, j in arrowtext.slices(offsets, arrowtext.HASH_BYTES):
            own, body = offsets[i : j + 1] - offsets[i], raw[offsets[i] : offsets[j]]
            words, first = wordhash.word_hashes(own, body)
            k1, k2 = wordhash.text_keys(own, body)
            shingles, counts, at = weighted(*wordhash.shingle_hashes(words, first, SHINGLE))
            regs = signatures(shingles, counts, at, BANDS * ROWS)
            bands = np.zeros((j - i, BANDS), np.uint64)
            for b in range(BANDS):
                for r in range(ROWS):
                    bands[:, b] = wordhash.mix(bands[:, b] ^ regs[:, b * ROWS + r], 100 + b)
            none = np.diff(first) == 0
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i + 1) * BANDS, BANDS, dtype=np.int32)), pa.array(bands.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(k1, mask=none), pa.array(k2, mask=none), lists, batch.column(2).slice(i, j - i)], names=["id", "k1", "k2", "bands", "key"])


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The exact probability Jaccard of two (sorted distinct shingles, counts)."""
    (sa, ca), (sb, cb) = a, b
    both, ia, ib = np.intersect1d(sa, sb, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    x, y = ca[ia].astype(np.float64), cb[ib].astype(np.float64)
    only_a, only_b = ca.sum() - x.sum(), cb.sum() - y.sum()
    kinds, n = np.unique(np.stack((x, y), 1), axis=0, return_counts=True)
    return sum(m / (np.maximum(kinds[:, 0] / p, kinds[:, 1] / q) @ n + only_a / p + only_b / q) for (p, q), m in zip(kinds, n, strict=True))


def shingles_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    words, first = wordhash.word_hashes(np.array([0, len(raw)]), raw)
    return np.unique(wordhash.shingle_hashes(words, first, SHINGLE)[0], return_counts=True)


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, of_a = None, None
        for batch in batches:
            a, b, keep = np.asarray(batch.column(0)), np.asarray(batch.column(1)), np.zeros(batch.num_rows, bool)
            for r in range(batch.num_rows):
                ta = batch.column(2)[r].as_py()
                if ta != last:
                    last, of_a = ta, shingles_of(ta)
                keep[r] = similarity(of_a, shingles_of(batch.column(3)[r].as_py())) >= threshold
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    return run


def intersections(a: list[np.ndarray], b: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """How many shingles each of a shares with each of b, by products of 0/1 matrices over the shingles that occur twice."""
    flat = np.concatenate([*a, *b])
    row = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    _, place, count = np.unique(flat, return_inverse=True, return_counts=True)
    again = count > 1
    column = np.cumsum(again) - 1
    use = again[place]
    row, column = row[use], column[place[use]]
    out = np.zeros((len(a), len(b)), np.float32)
    for start in range(0, int(again.sum()), columns):
        some = (column >= start) & (column < start + columns)
        m = np.zeros((len(a) + len(b), min(columns, int(again.sum()) - start)), np.float32)
        m[row[some], column[some] - start] = 1
        out += m[: len(a)] @ m[len(a) :].T
    return out


def may_link(both: np.ndarray, kinds_a: np.ndarray, all_a: np.ndarray, kinds_b: np.ndarray, all_b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether J can reach the threshold, for each of a with each of b: how many shingles they share, and how many kinds and shingles each has.

    Each term of J is at most the shared shingle's share of either text, so J is at most the
    shared shingles' share of either, which is greatest where what is not shared occurs once.
    """
    share_a = (all_a - kinds_a)[:, None] + both >= threshold * all_a[:, None] - 1e-3
    return share_a & ((all_b - kinds_b)[None, :] + both >= threshold * all_b[None, :] - 1e-3)


def _blocks(threshold: float):
    """Links between texts of different components: a text in its own block, and one outside the bucket's main component.

    Texts without repeated shingles are compared by the ordinary Jaccard, all of a block at
    once; for others, a pair that may link is compared in the first bucket that it shares.
    Pairs whose components something found in the block has joined are passed over.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        kept = 0
        for t in runs(batches, ["bucket", "block", "part"]):
            ids, comp = np.asarray(t["id"]), np.asarray(t["comp"])
            home, main = np.asarray(t["home"]), np.asarray(t["main"])
            bands = np.asarray(t["bands"].combine_chunks().flatten()).reshape(len(ids), -1)
            band = int(np.argmax(bands[0] == t["bucket"][0].as_py()))
            sets = []
            for text in t["text"].to_pylist():
                if (one := cache.get(text)) is None:
                    one = shingles_of(text)
                    cost = 16 * len(one[0]) + 2 * len(text)
                    if kept + cost > CACHE:
                        cache, kept = {}, 0
                    if cost <= CACHE:
                        cache[text] = one
                        kept += cost
                sets.append(one)
            size = np.array([len(x) for x, _ in sets], np.float64)
            whole = np.array([c.sum() for _, c in sets], np.float64)
            simple = whole == size
            rows, joined, found = np.flatnonzero(home), Forest(), []
            visitors = np.flatnonzero(~main)
            for v in range(0, len(visitors), BLOCK):
                own = visitors[v : v + BLOCK]
                both = intersections([sets[i][0] for i in own], [sets[i][0] for i in rows])
                apart = comp[own][:, None] != comp[rows][None, :]
                plain = simple[own][:, None] & simple[rows][None, :]
                near = plain & apart & (both >= threshold * (size[own][:, None] + size[rows][None, :] - both) - 1e-3)
                near |= ~plain & apart & (both > 0) & may_link(both, size[own], whole[own], size[rows], whole[rows], threshold)
                for i, j in np.argwhere(near).tolist():
                    x, y = own[i], rows[j]
                    if joined.find(int(comp[x])) == joined.find(int(comp[y])):
                        continue
                    if not plain[i, j] and (bands[x, :band] == bands[y, :band]).any():
                        continue
                    if similarity(sets[x], sets[y]) >= threshold:
                        found.append((int(ids[x]), int(ids[y])))
                        joined.union(int(comp[x]), int(comp[y]))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in range(2)], names=["a", "b"])

    return run


def text_key(text: Column) -> Column:
    """Tells the texts of one id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def near_documents(spark: SparkSession, docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", with_key: bool = False) -> DataFrame:
    """id, class_id (the smallest id of the component) and kept of every row; with_key adds a hash of the text."""
    tmp = Scratch(spark, "minhash")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = tmp.save(texts.withColumn("key", text_key(F.col("text"))).mapInArrow(lean(_sign), SIGNED), "signed")
    classes = signed.where("k1 is not null and id is not null").groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.min_by("bands", "id").alias("bands"))
    classes = tmp.save(classes, "classes")
    inside = classes.select("rep", F.explode("bands").alias("bucket"))
    shared = tmp.save(inside.groupBy("bucket").agg(F.min("rep").alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    dealt = tmp.save(inside.join(shared, "bucket"), "dealt")

    def texts_of(ids: DataFrame, name: str) -> DataFrame:
        """The texts of some ids, one row for each id and text; shuffled at every size, so that plans and disk grow in proportion."""
        own = texts.withColumn("key", text_key(F.col("text"))).join(ids.hint("merge"), "id", "left_semi")
        return tmp.save(own.dropDuplicates(["id", "key"]).drop("key"), f"texts_{name}")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        pairs = tmp.save(pairs.distinct(), f"pairs_{name}")
        own = texts_of(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), name)
        right, left = own.select(F.col("id").alias("b"), F.col("text").alias("tb")), own.select(F.col("id").alias("a"), F.col("text").alias("ta"))
        sides = pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a")
        links = tmp.save(sides.select("a", "b", "ta", "tb").mapInArrow(lean(_verify(threshold)), "a long, b long"), f"links_{name}")
        tmp.drop(f"texts_{name}")
        return links

    links = verified(dealt.where("rep <> m").select(F.col("m").alias("a"), F.col("rep").alias("b")), "first")
    comp = components(tmp, links, "first")
    # Buckets that still hold several components, in blocks.
    marked = tmp.save(dealt.join(comp, dealt["rep"] == comp["node"], "left").select("bucket", "n", "rep", F.coalesce("root", "rep").alias("comp")), "marked")
    tmp.drop("dealt")
    split = tmp.save(marked.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket", "lo"), "split")
    rest = marked.join(split, "bucket").join(classes.select("rep", "bands"), "rep")
    # Members of the main component stay in their block; the others visit all blocks of the bucket.
    rest = rest.withColumn("main", F.col("comp") == F.col("lo")).withColumn("blocks", F.ceil(F.col("n") / BLOCK)).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    rest = tmp.save(rest, "rest")
    own = texts_of(rest.select(F.col("rep").alias("id")).distinct(), "rest")
    visits = F.when(F.col("main"), F.array("own")).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    rest = rest.withColumn("block", F.explode(visits)).withColumn("home", F.col("own") == F.col("block"))
    # Beyond VISITORS blocks, those who visit are dealt in parts, each of which meets the whole block.
    parts = F.ceil(F.col("blocks") / VISITORS)
    part = F.pmod(F.xxhash64(F.lit(1), "rep"), parts)
    rest = rest.withColumn("part", F.explode(F.when(F.col("home"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(part))))
    rest = rest.select("bucket", "block", "part", F.col("rep").alias("id"), "comp", "home", "main", "bands").join(own.hint("merge"), "id")
    rest = rest.select("bucket", "block", "part", "id", "comp", "home", "main", "bands", "text")
    more = rest.repartition("bucket", "block", "part").sortWithinPartitions("bucket", "block", "part").mapInArrow(lean(_blocks(threshold)), "a long, b long")
    comp = components(tmp, comp.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more), "all")
    roots = tmp.save(classes.select("k1", "k2", "rep").join(comp, F.col("rep") == F.col("node"), "left").select("k1", "k2", F.coalesce("root", "rep").alias("class_id")), "roots")
    out = signed.select("id", "k1", "k2", "key").join(roots, ["k1", "k2"], "left")
    own = F.coalesce("class_id", "id")
    made = out.select(F.col("id").alias(id_col), own.alias("class_id"), F.col("id").eqNullSafe(own).alias("kept"), "key")
    return made if with_key else made.drop("key")


def without_near_copies(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """docs with one row of each group: the one of the smallest id.

    Rows that equal in all columns are one. Rows of one id with differing texts are judged
    by the words of each: a row stays if its own words' class has its id.
    """
    doc = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    # Plain columns, so that the join's partitioning serves to find repeated rows too.
    number, none = F.coalesce("id", F.lit(0)).alias("number"), F.col("id").isNull().alias("none")
    marked = near_documents(spark, docs, id_col=id_col, text_col=text_col, with_key=True, **more).where("kept").select(F.col(id_col).alias("id"), "key").distinct().select(number, none, "key")
    keyed = docs.select(doc, F.col(id_col).cast("long").alias("id"), text_key(F.col(text_col)).alias("key")).select(number, none, "key", "doc")
    kept = keyed.join(marked.hint("merge"), ["number", "none", "key"], "left_semi")
    return kept.dropDuplicates(["number", "none", "key", "doc"]).select("doc.*")
