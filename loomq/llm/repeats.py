"""Where windows of `width` symbols (bytes or words) occur again, over all documents at once.

Equal texts (by 128 bits of hash, throughout) are one text with a count. Of each window's grams of `gram` symbols the one with
the smallest hash (the first of equals) is its anchor, so equal windows have equal anchors.
Anchors that occur at one place only are dropped; around the others, each text gives one
segment for the windows that share that anchor, and segments meet by anchor. What decides
within a group of segments is the caller's: suffix arrays or suffix automata.

What a text repeats within itself counts once, with all its places. Anchors of more than
HOT places are not grouped: their windows are counted by 128 bits of hash, with map-side
aggregation, so no task holds the segments of a very common passage. A text counts as one
place of an anchor, or two, unless it has more than MANY: then all count.

A text of over PIECE symbols is taken in pieces that overlap by a window less one symbol, so
each of its windows lies in one piece and a worker holds little more than the text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrowtext, wordhash
from .arrowtext import lean
from .scratch import Scratch

HOT = 8192
MANY = 256
PIECE = arrowtext.HASH_BYTES
#: Symbols of segments that are decided together, if no single group has more.
CHUNK = 1 << 18
SEGMENT = "h long, k1 long, k2 long, rep long, starts array<long>, content binary"
RANGES = "k1 long, k2 long, lo long, hi long"


class Kind(NamedTuple):
    """width and gram in symbols; words: symbols are words, else bytes; earlier: only occurrences in texts of a smaller id count."""

    width: int
    gram: int
    words: bool
    earlier: bool


class Windows(NamedTuple):
    """For each anchor of each text: the text, the anchor's hash and the first and last start of its windows."""

    text: np.ndarray
    h: np.ndarray
    at: np.ndarray
    lo: np.ndarray
    hi: np.ndarray


class Piece(NamedTuple):
    """Texts i to j, or a piece of one: their symbols as values and as items, each text's first, and the place of the first symbol in its text."""

    i: int
    j: int
    values: np.ndarray
    items: np.ndarray
    first: np.ndarray
    shift: int


def pieces(offsets: np.ndarray, raw: np.ndarray, kind: Kind) -> Iterator[Piece]:
    for i, j in arrowtext.slices(offsets, PIECE):
        own, body = offsets[i : j + 1] - offsets[i], raw[offsets[i] : offsets[j]]
        if kind.words:
            values, first = wordhash.word_hashes(own, body)
            items = values
        else:
            values, items, first = None, body, own
        if len(items) <= PIECE:
            yield Piece(i, j, wordhash._BYTE[body] if values is None else values, items, first, 0)
            continue
        for at in range(0, max(len(items) - kind.width + 1, 1), PIECE):
            some = items[at : at + PIECE + kind.width - 1]
            yield Piece(i, j, wordhash._BYTE[some] if values is None else some, some, np.array([0, len(some)]), at)


def anchors(values: np.ndarray, prefix: np.ndarray, first: np.ndarray, kind: Kind) -> Windows:
    n, w = len(values), kind.width - kind.gram + 1
    starts = arrowtext.ragged(first[:-1], np.maximum(np.diff(first) - kind.width + 1, 0))
    if not len(starts):
        none = np.zeros(0, np.int64)
        return Windows(none, none, none, none, none)
    at = np.arange(n - kind.gram + 1)
    grams = wordhash.mix(wordhash.span_hash(prefix, at, at + kind.gram), 4)
    bits = np.uint64(max(23, int(n).bit_length()))
    low = np.uint64((1 << int(bits)) - 1)
    key = np.full(-(-len(grams) // w) * w, ~np.uint64(0))
    key[: len(grams)] = (grams & ~low) | at.astype(np.uint64)
    rows = key.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    place = (np.minimum(behind[starts], ahead[starts + w - 1]) & low).astype(np.int64)
    change = np.ones(len(starts), bool)
    change[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
    head = np.flatnonzero(change)
    tail = np.append(head[1:], len(starts)) - 1
    lo = starts[head]
    return Windows(np.searchsorted(first, lo, "right") - 1, grams[place[head]].view(np.int64), place[head], lo, starts[tail])


def _scan(kind: Kind):
    """(h, k1, k2, at, n) of anchors: of each text its anchors once, or twice if its own repeats count; n sums up to their places where these are more than MANY, else to these rows. Texts seen before in the task are left out."""
    most = 1 if kind.earlier else 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            k1, k2 = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            new = np.array([not (k in seen or seen.add(k)) for k in zip(k1.tolist(), k2.tolist(), strict=True)], bool)
            if not new.any():
                continue
            k1, k2, col = k1[new], k2[new], batch.column(2).filter(pa.array(new)) if not new.all() else batch.column(2)
            offsets, raw = arrowtext.buffers(col)
            for p in pieces(offsets, raw, kind):
                found = anchors(p.values, wordhash.prefix_hash(p.values), p.first, kind)
                order = np.lexsort((found.at, found.h, found.text))
                h, text, at = found.h[order], found.text[order], found.at[order] - p.first[found.text[order]] + p.shift
                head = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (text[1:] != text[:-1]))))[: len(h)]
                size = np.diff(np.append(head, len(h)))
                nth, size = np.arange(len(h)) - np.repeat(head, size), np.repeat(size, size)
                keep = nth < most
                n = np.where(size > MANY, np.where(nth == 0, size, 0), 1)
                at = np.zeros(len(h), np.int64) if kind.earlier else at
                own = text[keep] + p.i
                yield pa.RecordBatch.from_arrays([pa.array(h[keep]), pa.array(k1[own]), pa.array(k2[own]), pa.array(at[keep]), pa.array(n[keep].astype(np.int32))], names=["h", "k1", "k2", "at", "n"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows, sorted by (h, k1, k2, at), of anchors that occur at two places or more; equal rows count once."""
    held, joined = None, False  # the last row so far, and whether it shares its anchor with the row before

    def made(rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows[:, i].copy()) for i in (0, 1, 2, 4)], names=["h", "k1", "k2", "n"])

    for batch in batches:
        rows = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(5)], 1)
        if not len(rows):
            continue
        if held is not None:
            rows = np.concatenate((held, rows))
        keep = np.ones(len(rows), bool)
        keep[1:] = (rows[1:, :4] != rows[:-1, :4]).any(1)
        rows = rows[keep]
        same = np.zeros(len(rows) + 1, bool)
        same[1:-1] = rows[1:, 0] == rows[:-1, 0]
        same[0] = joined
        out = (same[1:] | same[:-1])[:-1]
        held, joined = rows[-1:], bool(same[len(rows) - 1])
        if out.any():
            yield made(rows[:-1][out])
    if held is not None and joined:
        yield made(held)


def _around(kind: Kind, hot: bool):
    """Segments around the shared anchors of each text, or the single windows around the hot ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1s, k2s, reps = (np.asarray(batch.column(i)) for i in range(3))
            offsets, raw = arrowtext.buffers(batch.column(3))
            lists = batch.column(4)
            wanted = lists.flatten()
            hs, hots = np.asarray(wanted.field(0)), np.asarray(wanted.field(1))
            ends = np.concatenate(([0], np.cumsum(np.asarray(lists.value_lengths()))))
            for p in pieces(offsets, raw, kind):
                prefix = wordhash.prefix_hash(p.values)
                found = anchors(p.values, prefix, p.first, kind)
                keep = np.zeros(len(found.h), bool)
                bounds = np.searchsorted(found.text, np.arange(p.j - p.i + 1))
                for t in range(p.j - p.i):
                    own = slice(ends[p.i + t], ends[p.i + t + 1])
                    a, b = bounds[t], bounds[t + 1]
                    keep[a:b] = np.isin(found.h[a:b], hs[own][hots[own] == hot])
                found = Windows(*(x[keep] for x in found))
                if hot:
                    n = found.hi - found.lo + 1
                    at = arrowtext.ragged(found.lo, n)
                    other = wordhash.prefix_hash(wordhash.mix(p.values, 7) if kind.words else wordhash.OTHER_BYTE[p.items])
                    w1, w2 = (wordhash.mix(wordhash.span_hash(x, at, at + kind.width), 5) for x in (prefix, other))
                    text = np.repeat(found.text, n)
                    order = np.lexsort((at, w2, w1, text))
                    w1, w2, text, at = w1[order], w2[order], text[order], at[order] - p.first[text[order]] + p.shift
                    head = np.flatnonzero(np.concatenate(([True], (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1]) | (text[1:] != text[:-1]))))[: len(at)]
                    starts = pa.ListArray.from_arrays(pa.array(np.append(head, len(at)).astype(np.int32)), pa.array(at))
                    own = text[head] + p.i
                    columns = [pa.array(x[head].view(np.int64)) for x in (w1, w2)] + [pa.array(x[own]) for x in (k1s, k2s, reps)] + [starts]
                    yield pa.RecordBatch.from_arrays(columns, names=["w1", "w2", "k1", "k2", "rep", "starts"])
                    continue
                starts = found.lo - p.first[found.text] + p.shift
                item = p.items.astype("<u8") if kind.words else p.items
                met: dict[tuple[int, int, bytes], list[int]] = {}
                for t, h, a, b, start in zip(found.text.tolist(), found.h.tolist(), found.lo.tolist(), found.hi.tolist(), starts.tolist(), strict=True):
                    met.setdefault((t, h, item[a : b + kind.width].tobytes()), []).append(start)
                own = np.array([k[0] for k in met], np.int64) + p.i
                columns = [pa.array([k[1] for k in met], pa.int64()), *(pa.array(x[own]) for x in (k1s, k2s, reps)), pa.array(list(met.values()), pa.list_(pa.int64())), pa.array([k[2] for k in met], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["h", "k1", "k2", "rep", "starts", "content"])

    return run


class Segments(NamedTuple):
    """Segments of whole anchor groups: columns, symbols (numbers) and their values for hashing."""

    h: np.ndarray
    k1: np.ndarray
    k2: np.ndarray
    rep: np.ndarray
    starts: list[list[int]]
    first: np.ndarray
    items: np.ndarray
    values: np.ndarray


def _segments(table: pa.Table, kind: Kind) -> Segments:
    h, k1, k2, rep = (np.asarray(table[c].combine_chunks()) for c in ("h", "k1", "k2", "rep"))
    starts = table["starts"].to_pylist()
    begin = np.array([x[0] for x in starts], np.int64)
    order = np.lexsort((begin, k2, k1, h))  # repeated rows of a document give a segment twice
    new = np.ones(len(order), bool)
    a, b = order[1:], order[:-1]
    new[1:] = (h[a] != h[b]) | (k1[a] != k1[b]) | (k2[a] != k2[b]) | (begin[a] != begin[b])
    order = order[new]
    contents = table["content"].combine_chunks().take(pa.array(order)).to_pylist()
    items = np.frombuffer(b"".join(contents), "<u8" if kind.words else np.uint8)
    sizes = np.array([len(c) for c in contents], np.int64) // items.itemsize
    return Segments(h[order], k1[order], k2[order], rep[order], [starts[x] for x in order.tolist()], np.concatenate(([0], np.cumsum(sizes))), items, items if kind.words else wordhash._BYTE[items])


def _groups(batches: Iterator[pa.RecordBatch], kind: Kind) -> Iterator[Segments]:
    """Whole groups of equal h, about CHUNK symbols at a time; batches must be sorted by h."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, 256)
            at += part.num_rows
            if size >= CHUNK:
                h, last = np.asarray(part.column(0)), held[-1].column(0)[-1].as_py()
                cut = int(np.argmax(h != last)) if (h != last).any() else None
                if cut is not None:
                    if cut:
                        held.append(part.slice(0, cut))
                    yield _segments(pa.Table.from_batches(held), kind)
                    held, size, part = [], 0, part.slice(cut)
            held.append(part)
            size += part.column(5).nbytes // (8 if kind.words else 1)
    if held:
        yield _segments(pa.Table.from_batches(held), kind)


class Hashed(NamedTuple):
    """Every window of some segments: its place, its segment, and a key that equal windows of a group share."""

    at: np.ndarray
    seg: np.ndarray
    key: np.ndarray


def window_keys(s: Segments, kind: Kind) -> Hashed:
    n = np.diff(s.first) - kind.width + 1
    at = arrowtext.ragged(s.first[:-1], n)
    seg = np.repeat(np.arange(len(n)), n)
    return Hashed(at, seg, wordhash.mix(wordhash.span_hash(wordhash.prefix_hash(s.values), at, at + kind.width) ^ wordhash.mix(s.h.view(np.uint64), 9)[seg], 10))


def hulls(w: Hashed, s: Segments, chosen: np.ndarray, kind: Kind) -> list[tuple[int, int, int]]:
    """(segment, first symbol, end) of the chosen windows' hull in each segment that has any."""
    at, seg = w.at[chosen], w.seg[chosen]
    if not len(at):
        return []
    head = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
    tail = np.append(head[1:], len(seg)) - 1
    return list(zip(seg[head].tolist(), at[head].tolist(), (at[tail] + kind.width).tolist(), strict=True))


#: (segment, lo, hi): ranges of starts, in its text, of the windows that go.
Decide = Callable[[Segments, Kind], Iterator[tuple[int, int, int]]]


def _decided(decide: Decide, kind: Kind):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _groups(batches, kind):
            rows = list(decide(s, kind))
            own = np.array([r[0] for r in rows], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(s.k1[own]), pa.array(s.k2[own]), *(pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2))], names=["k1", "k2", "lo", "hi"])

    return run


def spans(lo: np.ndarray, hi: np.ndarray, width: int) -> list[tuple[int, int]]:
    """The union of windows starting at lo to hi, as maximal runs of symbols."""
    out: list[list[int]] = []
    order = np.argsort(lo, kind="stable")
    for a, b in zip(lo[order].tolist(), hi[order].tolist(), strict=True):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + width)
        else:
            out.append([a, b + width])
    return [(a, b) for a, b in out]


def whole_characters(part: bytes, left: bool, right: bool) -> bytes:
    """part of a UTF-8 text without the rest of a character that a cut on its left or right has split."""
    a, b = 0, len(part)
    while left and a < b and part[a] & 0xC0 == 0x80:
        a += 1
    for back in range(1, min(4, b - a + 1) if right else 0):
        c = part[b - back]
        if c & 0xC0 != 0x80:
            if c >= 0xC0 and back < (2 if c < 0xE0 else 3 if c < 0xF0 else 4):
                b -= back
            break
    return part[a:b]


def _words_left(raw: bytes, cut: list[tuple[int, int]]) -> tuple[int, bytes]:
    """How many words a text has, and those outside the cuts, joined by one space; piece by piece."""
    n, at, kept, ends = 0, 0, [], [*cut, (1 << 62, 1 << 62)]
    for a, b in wordhash.text_pieces(np.frombuffer(raw, np.uint8)):
        words = raw[a:b].split()
        while words:
            lo, hi = ends[at]
            if n >= hi:
                at += 1
                continue
            inside = lo <= n
            some = words[: (hi if inside else lo) - n]
            words = words[len(some) :]
            n += len(some)
            if some and not inside:
                kept.append(b" ".join(some))
    return n, b" ".join(kept)


def _removed(kind: Kind, characters: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, whole, lists = batch.column(1), batch.column(2).to_pylist(), batch.column(3)
            n, gone, runs_, kept = [], [], [], []
            for r in range(batch.num_rows):
                raw = texts[r].as_py().encode()
                cut: list[tuple[int, int]] = []
                if lists[r].is_valid and not whole[r]:
                    found = lists[r].values
                    cut = spans(np.asarray(found.field(0)), np.asarray(found.field(1)), kind.width)
                if kind.words:
                    size, left = _words_left(raw, [(0, 1 << 62)] if whole[r] else cut)
                    if whole[r]:
                        cut, left = ([(0, size)], b"") if size >= kind.width else ([], _words_left(raw, [])[1])
                else:
                    size = len(raw)
                    if whole[r] and size >= kind.width:
                        cut = [(0, size)]
                    edges = [0, *(x for c in cut for x in c), size]
                    parts = [raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]
                    if characters:
                        parts = [whole_characters(p, i > 0, i < len(cut)) for i, p in enumerate(parts)]
                    left = b"".join(parts)
                kept.append(left)
                n.append(size)
                gone.append(sum(b - a for a, b in cut))
                runs_.append(len(cut))
            columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in (n, gone, runs_)), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "n", "n_removed", "n_spans", "kept"])

    return run


def remove_repeats(spark: SparkSession, docs: DataFrame, kind: Kind, decide: Decide, name: str, id_col: str = "doc_id", text_col: str = "text", characters: bool = False) -> DataFrame:
    """doc (a struct of the row's columns), n, n_removed, n_spans (long) and kept (the UTF-8 bytes that stay) of every row.

    characters: what a cut leaves of a split character does not stay either.
    """
    tmp = Scratch(spark, name)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(F.lit(1), text).alias("k1"), F.xxhash64(F.lit(2), text).alias("k2"))
    if kind.earlier:
        keyed = keyed.withColumn("able", F.col("id").isNotNull())
    else:
        keyed = keyed.withColumn("able", F.lit(True))
    long_enough = F.col("able") & (F.octet_length("text") >= (2 * kind.width - 1 if kind.words else kind.width))
    some = keyed.where(long_enough)
    ids = some.groupBy("k1", "k2", "id").agg(F.count(F.lit(1)).alias("rows"))
    ids = tmp.save(ids, "ids")
    reps = tmp.save(ids.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.sum("rows").alias("copies")), "reps")

    found = some.select("k1", "k2", "text").mapInArrow(lean(_scan(kind)), "h long, k1 long, k2 long, at long, n int")
    shared = tmp.save(found.repartition("h").sortWithinPartitions("h", "k1", "k2", "at").mapInArrow(lean(_shared), "h long, k1 long, k2 long, n long"), "shared")
    hot = shared.groupBy("h").agg(F.sum("n").alias("places")).where(F.col("places") > HOT).select("h", F.lit(True).alias("hot"))
    wanted = shared.select("h", "k1", "k2").distinct().join(hot, "h", "left").groupBy("k1", "k2").agg(F.collect_list(F.struct("h", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("wanted"))
    wanted = reps.join(wanted, ["k1", "k2"]).select(F.col("k1").alias("x1"), F.col("k2").alias("x2"), "rep", "wanted")
    own = (F.col("k1") == F.col("x1")) & (F.col("k2") == F.col("x2")) & F.col("id").eqNullSafe(F.col("rep"))
    suspects = tmp.save(some.join(wanted, own).select("k1", "k2", F.coalesce("rep", F.lit(0)).alias("rep"), "text", "wanted"), "suspects")

    some_hot = F.exists("wanted", lambda x: x["hot"])
    segments = suspects.where(F.exists("wanted", lambda x: ~x["hot"])).mapInArrow(lean(_around(kind, False)), SEGMENT).repartition("h").sortWithinPartitions("h")
    ranges = segments.mapInArrow(lean(_decided(decide, kind)), RANGES)
    singles = tmp.save(suspects.where(some_hot).mapInArrow(lean(_around(kind, True)), "w1 long, w2 long, k1 long, k2 long, rep long, starts array<long>").distinct(), "singles")
    counts = singles.groupBy("w1", "w2").agg(F.min("rep").alias("least"), F.sum(F.size("starts")).alias("places")).where("places > 1").select("w1", "w2", "least")
    common = singles.join(counts, ["w1", "w2"])
    if kind.earlier:
        common = common.where(F.col("rep") > F.col("least"))
    ranges = ranges.union(common.select("k1", "k2", F.explode("starts").alias("lo")).select("k1", "k2", "lo", "lo"))
    ranges = tmp.save(ranges.groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges")), "ranges")
    tmp.drop("suspects")

    whole = (F.col("id") > F.col("rep")) if kind.earlier else (F.col("copies") > 1)
    fate = ids.join(reps, ["k1", "k2"]).join(ranges, ["k1", "k2"], "left").select("id", "k1", "k2", F.coalesce(whole, F.lit(False)).alias("whole"), "ranges")
    fate = tmp.save(fate.where("whole or ranges is not null").toDF("xi", "x1", "x2", "whole", "ranges"), "fate")
    same = (F.col("k1") == F.col("x1")) & (F.col("k2") == F.col("x2")) & F.col("id").eqNullSafe(F.col("xi"))
    out = keyed.join(fate, same, "left").select("doc", "text", F.coalesce("whole", F.lit(False)).alias("whole"), "ranges")
    schema = f"doc {keyed.schema['doc'].dataType.simpleString()}, n long, n_removed long, n_spans long, kept binary"
    return out.mapInArrow(lean(_removed(kind, characters)), schema)
