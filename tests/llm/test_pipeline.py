"""Sharding, mixing, quality rules and the pipeline against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import pytest
import tiktoken
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
import public_tokenizers as P
from loomq.llm import bytebpe, mixing, quality, queries, scratch, sharding
from tests.llm.test_near import brute_documents
from tests.llm.test_repeats import brute_bytes

SF = "/root/testdata/sf0.001"
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("size", T.StringType()), T.StructField("kept", T.StringType())])
ROWS = [(1, "a b", "en", "s1", 3, "x", "y"), (1, "a b", "en", "s1", 3, "x", "y"), (2, None, None, None, None, None, None), (None, "é\n\n", "fr", None, 1, "", ""), (3, "", "", "", 0, "", ""), (4, "w " * 50_000, "de", "s2", 0, "", ""), (5, "w " * 40_000 + "\n", "de", "s2", 0, "", "")]


def words(text):
    return [w for w in re.split("[ \t\n\x0b\x0c\r]+", text or "") if w]


def test_hilbert_curve_visits_neighbours():
    for dims, bits in ((2, 3), (3, 2), (3, 4)):
        side = 1 << bits
        points = [[c // side**k % side for k in range(dims)] for c in range(side**dims)]
        order = sorted(points, key=lambda p: sharding.hilbert_index(p, bits))
        assert sorted(sharding.hilbert_index(p, bits) for p in points) == list(range(side**dims))
        assert all(sum(abs(a - b) for a, b in zip(p, q, strict=True)) == 1 for p, q in zip(order, order[1:], strict=False))


def check_shards(rows, docs, shards=16):
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows if r.doc_id is not None) == sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs if i is not None)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    counts = [len(slots.get(s, ())) for s in range(shards)]
    assert sum(counts) == len(docs) and max(counts) - min(counts) <= 1 and set(slots) <= set(range(shards))


def placing(table):
    """The place of a column's value among all of the table: by its rank."""
    ranks = {c: sorted({r[c] for r in table.select(c).collect()} - {None}) for c in ("lang", "source")}
    return lambda c, v: 0 if v is None else (ranks[c].index(v) << 4) // len(ranks[c])


def test_pruning(spark, tmp_path):
    """Least and greatest of a shard leave out most shards for one source, and for one language."""
    langs, sources = [f"l{i:02}" for i in range(8)], [f"s{i:02}" for i in range(16)]
    docs = spark.range(4096).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x "), (F.col("id") % 7 * 50).cast("int")).alias("text"), F.get(F.lit(langs), (F.col("id") % 8).cast("int")).alias("lang"), F.get(F.lit(sources), F.expr("hash(id) & 15")).alias("source"))
    sharding.write_shards(docs, sharding.document_shards(spark, docs), str(tmp_path / "out"))
    found = spark.read.parquet(str(tmp_path / "out")).groupBy("shard").agg(*(f(c).alias(f"{n}_{c}") for c in ("lang", "source") for n, f in (("low", F.min), ("high", F.max)))).collect()
    reads = {c: [sum(r[f"low_{c}"] <= v <= r[f"high_{c}"] for r in found) for v in vs] for c, vs in (("lang", langs), ("source", sources))}
    assert all(sum(n) <= 8 * len(n) for n in reads.values()), reads


def test_places(spark):
    rows = [(f"v{i:05}",) for i in range(9000)] + [(None,), ("v00000",), ("w" * 100,)]
    found = sharding.places(spark.createDataFrame(rows, "c string"), "c", 4, most=1000)
    assert [p for _, p in found] == list(range(16)) and [v for v, _ in found] == sorted(v for v, _ in found)
    assert sharding.places(spark.createDataFrame([(None,)], "c string"), "c", 4) == []


def test_shards(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, DOCS)
    check_shards(sharding.document_shards(spark, docs).collect(), [(r[0], r[1]) for r in ROWS])
    assert sharding.document_shards(spark, docs.where("false")).count() == 0
    table = spark.read.parquet(f"{SF}/documents.parquet")
    rows = queries.op7_hilbert_shards(spark, SF).collect()
    check_shards(rows, [tuple(r) for r in table.select("doc_id", "text").collect()])
    # Rows follow the curve, whatever the size of the buckets.
    placed = sharding.document_shards(spark, table, target=3, split=2)
    check_shards(placed.collect(), [tuple(r) for r in table.select("doc_id", "text").collect()])
    at = {r.doc_id: (r.shard, r.slot) for r in placed.collect()}
    code = placing(table)
    curve = sorted((sharding.hilbert_index([code("lang", r.lang), code("source", r.source), min(15, int(math.log2(len((r.text or "").encode()) + 2)))], 4), at[r.doc_id]) for r in table.collect())
    assert [x[1] for x in sorted(curve, key=lambda x: x[1])] == sorted(at.values()) and [c for c, _ in sorted(curve, key=lambda x: x[1])] == sorted(c for c, _ in curve)
    sharding.write_shards(table, placed, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == table.count()


def test_written_shards(spark, tmp_path):
    """Null and repeated ids are written once a row, each where its own text and metadata were placed."""
    rows = [*ROWS, (None, "other", "en", "s1", 5, "", ""), (None, None, "de", None, 0, "", ""), (3, "", "fr", "s9", 0, "", ""), (3, "w " * 90, "fr", "s9", 7, "a", ""), (3, "w " * 90, "fr", "s9", 8, "b", "")]
    docs = spark.createDataFrame(rows, DOCS)
    placed = sharding.document_shards(spark, docs, shards=4)
    sharding.write_shards(docs, placed, str(tmp_path / "out"))
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert Counter(tuple(r)[:7] for r in out) == Counter(rows)
    at = Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in placed.collect())
    assert Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode()), r.shard, r.slot) for r in out) == at
    # Languages and sources go where their cells are on the curve.
    code = placing(docs)
    curve = [sharding.hilbert_index([code("lang", r.lang), code("source", r.source), min(15, int(math.log2(len((r.text or "").encode()) + 2)))], 4) for r in sorted(out, key=lambda r: (r.shard, r.slot))]
    assert curve == sorted(curve)


def brute_targets(sizes, most=3):
    names = sorted(sizes, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, target, capped = sum(sizes.values()), {}, set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        target = {s: most * sizes[s] if s in capped else left * weight[s] / sum(weight[x] for x in free) for s in names}
        over = {s for s in free if target[s] > most * sizes[s]}
        if not over:
            return target
        capped |= over


def check_mix(rows, docs):
    sizes, longest = Counter(), Counter()
    for _, text, source in docs:
        sizes[source] += len(words(text))
        longest[source] = max(longest[source], len(words(text)))
    target = brute_targets({s: sizes[s] for _, _, s in docs})
    source_of = {i: s for i, _, s in docs}
    assert sorted((str(r.doc_id), r.size) for r in rows) == sorted((str(i), len(words(t))) for i, t, _ in docs)
    taken = Counter()
    for r in rows:
        s = source_of[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - target[s]) <= 1e-6 * max(1, target[s])
        assert 0 <= r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        assert not r.size or r.taken // r.size in (int(target[s] // max(sizes[s], 1)), int(target[s] // max(sizes[s], 1)) + 1)
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in target)


def test_mix(spark):
    docs = spark.createDataFrame(ROWS, DOCS)
    made = mixing.mix(spark, docs, mixing.word_count(F.col("text"))).select("doc.doc_id", "size", "source_size", "target", "taken")
    check_mix(made.collect(), [(r[0], r[1], r[3]) for r in ROWS])
    assert mixing.mixed(spark, docs.where("false")).count() == 0
    assert sorted(mixing.mixed(spark, docs).columns) == sorted(docs.columns)
    table = spark.read.parquet(f"{SF}/documents.parquet")
    first, second = (queries.op8_source_mix(spark, SF).collect() for _ in range(2))
    check_mix(first, [tuple(r) for r in table.select("doc_id", "text", "source").collect()])
    assert sorted(first) == sorted(second)


def test_many_sources_and_ranges(spark, monkeypatch):
    """Ranges of a few rows give what one range gives, for many sources and one that holds a third."""
    docs = [(i, "w " * (i * 7 % 23), "big" if i % 3 == 0 else f"s{i * 5 % 97:02}" if i % 5 else None) for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    size, quality = mixing.word_count(F.col("text")), F.when(F.col("doc_id") % 2 == 0, 0.1).otherwise(1.0)
    read = lambda: sorted(map(str, mixing.mix(spark, df, size, quality).select("doc.doc_id", "size", "source_size", "target", "taken").collect()))
    whole = read()
    monkeypatch.setattr(mixing, "ROWS_A_PART", 90)
    assert read() == whole
    check_mix(mixing.mix(spark, df, size, quality).select("doc.doc_id", "size", "source_size", "target", "taken").collect(), docs)


def test_equal_rows_at_the_cut(spark):
    """Repeated rows are rows of their own, also where only some of them are taken."""
    rows = [(1, "a b", "s", k) for k in ("x", "y", "z")] * 30 + [(None, "c", "t", None)] * 40 + [(2, "d " * 60, "u", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, more string")
    made = mixing.mix(spark, df, mixing.word_count(F.col("text")))
    sizes = {"s": 180, "t": 40, "u": 60}
    target, taken = brute_targets(sizes), {r.source: r.n for r in made.groupBy("doc.source").agg(F.sum("taken").alias("n")).collect()}
    assert all(abs(taken[s] - target[s]) <= {"s": 2, "t": 1, "u": 60}[s] for s in sizes)
    first, second = (sorted(map(str, mixing.mixed(spark, df.repartition(n)).collect())) for n in (1, 5))
    assert first == second


def test_weights_prefer(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("a b").alias("text"), (F.col("id") % 2).alias("q"))
    other = spark.range(4000).select((F.col("id") + 10_000).alias("doc_id"), F.lit("t").alias("source"), F.lit("a").alias("text"), F.lit(0).alias("q"))
    made = mixing.mix(spark, docs.union(other), mixing.word_count(F.col("text")), F.when(F.col("q") == 1, 4.0).otherwise(1.0))
    counts = {r.q: r.n for r in made.where("doc.source = 's' and copies > 0").groupBy("doc.q").agg(F.count("*").alias("n")).collect()}
    assert sum(counts.values()) == 2000 and counts[1] > 1.5 * counts[0]


def brute_quality(text):
    ws = words(text)
    grams = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    hit = {i + k for i in range(len(ws) - 2) if grams[tuple(ws[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    failed = len(ws) < 50 or 100 * len(hit) > 50 * len(ws)
    return len(ws), sum(map(len, ws)), sum(c in quality.SYMBOLS for c in text or ""), len(lines) - len(set(lines)), len(hit), failed


def test_quality(spark):
    made = [("a b c " * k).strip() for k in (1, 2, 3, 30)] + ["\n".join(f"x{i} the" for i in range(60)), "the of and " * 40 + "#|" * 100, "a a a a", "\x85 é\x1c the", "l\n\nl\nl \n \n"]
    rows = [*ROWS, *((100 + i, t, "en", "s", 1, "", "") for i, t in enumerate(made))]
    docs = spark.createDataFrame(rows, DOCS)
    got = [(r.text, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed), r.kept) for r in quality.with_quality(docs).collect()]
    assert len(got) == len(rows) and all(g == brute_quality(t) for t, g, _ in got) and not any(k and g[-1] for _, g, k in got)
    assert [c for c in quality.with_quality(docs).columns if c == "kept"] == ["kept"]
    assert quality.with_quality(docs.where("false")).count() == 0
    assert docs.where(quality.quality(F.col("text"))["kept"]).count() == sum(k for *_, k in got)


def test_quality_on_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.with_quality(docs).where("not base_failed").join(labels, "doc_id").select("quality", "kept").collect()
    assert {(r.quality, r.kept) for r in rows} == {(0, False), (1, True)}


def test_pipeline(spark):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    source = {r.doc_id: r for r in docs.collect()}
    kept = stages["quality_rules"](spark, docs, SF)
    verdicts = {r.doc_id: r.kept for r in queries.op4_quality_rules(spark, SF).collect()}
    now = {r.doc_id: r.text for r in kept.collect()}
    assert now == {i: r.text for i, r in source.items() if verdicts[i]} and kept.columns == docs.columns
    near = stages["minhash_near_dedup"](spark, kept, SF)
    now = {i: now[i] for i, _, k in brute_documents(list(now.items())) if k}
    assert {r.doc_id: r.text for r in near.collect()} == now and sorted(near.columns) == sorted(docs.columns)
    cut = stages["suffix_array_dedup"](spark, near, SF)
    rows = cut.collect()
    want = {i: (n, g, h) for i, n, g, _, h in brute_bytes(list(now.items()), 200)}
    assert {r.doc_id for r in rows} == set(now) and all(r.n_chars == len(r.text) for r in rows)
    for r in rows:
        n, gone, digest = want[r.doc_id]
        assert r.text == now[r.doc_id] if not gone else n - gone - 6 <= len(r.text.encode()) <= n - gone
        if len(r.text.encode()) == n - gone:
            assert hashlib.sha256(r.text.encode()).hexdigest() == digest
    mix = stages["source_mix"](spark, cut, SF).collect()
    counts = Counter(r.doc_id for r in mix)
    target = brute_targets({s: sum(len(words(r.text)) for r in rows if r.source == s) for s in {r.source for r in rows}})
    for s, goal in target.items():
        own = [r for r in rows if r.source == s]
        assert abs(sum(counts[r.doc_id] * len(words(r.text)) for r in own) - goal) <= max(len(words(r.text)) for r in own)
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bytebpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    last = corpus_pipeline.run(spark, SF).collect()
    text = {r.doc_id: r.text for r in mix}
    assert Counter(r.doc_id for r in last) == counts
    assert all(list(r.ids) == own.encode_ordinary(text[r.doc_id]) and r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest() for r in last)


def test_pipeline_edges(spark):
    """Each stage alone: nulls, empty and long texts, repeated rows, and columns with names that stages use."""
    long = " ".join(f"{w}{i % 977}" for i in range(30_000) for w in ("the", "of", "mix"))
    rows = [*ROWS, (8, long, "en", "s1", len(long), "x", "y"), (9, long[:-1] + "!", "en", "s1", len(long), "x", "y")]
    docs = spark.createDataFrame(rows, DOCS)
    stages = dict(corpus_pipeline.STAGES)
    for frame in (docs, docs.where("false")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert sorted(stage(spark, frame, SF).columns) == sorted(frame.columns)
    assert all(stage(spark, docs.where("false"), SF).count() == 0 for stage in stages.values())
    of = lambda name: Counter(tuple(r[c] for c in docs.columns) for r in stages[name](spark, docs, SF).collect())
    assert {r[0] for r in of("quality_rules")} <= {8, 9}
    assert of("minhash_near_dedup") == Counter({r for r in rows if r[0] not in (9, 5)} | {r for r in rows if r[0] is None})
    cut = of("suffix_array_dedup")
    assert sum(cut.values()) == len(rows) and {(r[0], r[1]) for r in cut if r[0] in (1, 2, 3, None)} == {(r[0], r[1]) for r in rows if r[0] in (1, 2, 3, None)}
    mix = of("source_mix")
    assert set(mix) <= set(rows) and not any(r[0] in (2, 3) for r in mix)
    ids = {r.doc_id: r for r in stages["byte_bpe"](spark, docs, SF).collect()}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bytebpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert {i: list(r.ids) for i, r in ids.items()} == {r[0]: own.encode_ordinary(r[1] or "") for r in rows}
    assert all(ids[r[0]].decoded_sha256 == hashlib.sha256((r[1] or "").encode()).hexdigest() for r in rows)


def test_spread(spark):
    """A small table is dealt over all cores, a large one is read as it lies."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert queries.spread(docs).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and queries.spread(docs).count() == docs.count()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        assert queries.spread(docs) is docs
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_native_plans(spark):
    """Rules and shards are worked out without Python."""
    for make in (queries.op4_quality_rules, queries.op7_hilbert_shards):
        plan = make(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "ExistingRDD"))


def test_scratch(spark, tmp_path):
    """Tables go with the session; without a shared folder there is none on a cluster."""
    tmp = scratch.Scratch(spark, "here")
    assert tmp.save(spark.range(3), "t").count() == 3 and spark.conf.get(scratch.CLEANUP, "false") == "false"
    fs, path = tmp._fs(f"{tmp.root}/t")
    tmp.drop("t")
    assert not fs.exists(path)
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(getConf=lambda: {}, master="spark://x"))
    with pytest.raises(RuntimeError):
        scratch.shared_dir(cluster)
