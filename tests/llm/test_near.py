"""Near-duplicate vectors and documents against brute force."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import types as T

from loomq.llm import embeddings, minhash, queries, wordhash


def union(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute_vectors(rows, threshold=0.93):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0]))
    ok = [i is not None and l is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, v, l in rows]
    links = []
    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                    links.append((a, b))
    n = [sum(i in p for p in links) for i in range(len(rows))]
    comp = union(len(rows), links)
    return sorted(((rows[i][0], n[i], rows[comp[i]][0], rows[i][0] == rows[comp[i]][0]) for i in range(len(rows))), key=str)


VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("c", T.StringType()), T.StructField("n", T.StringType())])


def test_vectors(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(12):
        center = rng.standard_normal(16)
        for _ in range(int(rng.integers(1, 60 if k == 3 else 9))):
            rows.append((len(rows) * 7 % 997, [float(np.float32(x)) for x in center + rng.standard_normal(16) * rng.uniform(0.02, 0.2)], int(k % 3)))
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [1.0, None], 1), (2003, [float("nan")] * 16, 1), (2004, rows[0][1], None), (None, rows[0][1], 0), (2005, [], 1), (2006, [1.0, 2.0], 1), (2007, [2.0, 4.0], 1), (2008, rows[5][1], rows[5][2]), rows[7], rows[7], (2009, [float("inf")] * 16, 0)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], VECTORS)
    got = sorted(map(tuple, embeddings.near_vectors(spark, df).collect()), key=str)
    assert got == brute_vectors(rows)
    assert embeddings.near_vectors(spark, df.where("false")).count() == 0


def test_clustered_vectors(spark):
    """Labels around one centre or a few, where far more vectors share a prefix than a window holds."""
    rng = np.random.default_rng(3)
    rows = []
    for label, centres in enumerate((1, 3)):
        middle = rng.standard_normal((centres, 64))
        middle /= np.linalg.norm(middle, axis=1, keepdims=True)
        for i in range(3000):
            noise = rng.standard_normal(64)
            v = middle[i % centres] + noise / np.linalg.norm(noise) * (0.12 / 0.88) ** 0.5
            rows.append((len(rows), [float(np.float32(x)) for x in v], label))
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    near = np.triu((x @ x.T >= 0.93) & (label[:, None] == label[None, :]), 1)
    links = list(zip(*map(np.ndarray.tolist, np.nonzero(near)), strict=True))
    want = union(len(rows), links)
    assert len(links) > 1000
    got = sorted(map(tuple, embeddings.near_vectors(spark, spark.createDataFrame([(*r, "x", "y") for r in rows], VECTORS)).collect()))
    assert sum(r[1] for r in got) >= 0.999 * 2 * len(links)
    assert sum(r[2] == w for r, w in zip(got, want, strict=True)) >= 0.999 * len(rows)


def test_vectors_with_a_common_direction(spark):
    """Unrelated vectors of cosine 0.8, as real embeddings have: pairs at 0.935 are found all the same."""
    rng = np.random.default_rng(6)
    n, pairs, mean = 12_000, 300, 0.8
    u = rng.standard_normal((n, 64))
    u[:, 0] = 0
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    v = rng.standard_normal((pairs, 64))
    v[:, 0] = 0
    v -= (v * u[:pairs]).sum(1, keepdims=True) * u[:pairs]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = (0.935 - mean) / (1 - mean)
    u[pairs : 2 * pairs] = near * u[:pairs] + (1 - near**2) ** 0.5 * v
    x = (1 - mean) ** 0.5 * u
    x[:, 0] = mean**0.5
    order = rng.permutation(n)
    at = np.argsort(order)
    x = x[order].astype(np.float32)
    df = spark.createDataFrame([(i, e, 1, "", "") for i, e in enumerate(x.tolist())], VECTORS)
    got = {r.vec_id: r for r in embeddings.near_vectors(spark, df).collect()}
    found = sum(got[a].component_id == got[b].component_id for a, b in zip(at[:pairs].tolist(), at[pairs : 2 * pairs].tolist(), strict=True))
    assert found >= 0.999 * pairs - 1
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = sum(int((y[i : i + 2000] @ y.T >= 0.93).sum()) for i in range(0, n, 2000)) - n
    assert links * 0.999 - 2 <= sum(r.n_links for r in got.values()) <= links


def test_large_component(spark):
    """Components of more vectors than a block: links are counted as brute force counts them."""
    rng = np.random.default_rng(8)
    centre = rng.standard_normal(16)
    rows = [(i, [float(np.float32(x)) for x in centre + rng.standard_normal(16) * 0.3], 1) for i in range(700)]
    rows += [(700 + i, rows[i][1], 1) for i in range(20)]
    got = sorted(map(tuple, embeddings.near_vectors(spark, spark.createDataFrame([(*r, "", "") for r in rows], VECTORS)).collect()), key=str)
    want = brute_vectors(rows)
    assert got == want and max(np.unique([w[2] for w in want], return_counts=True)[1]) > embeddings.BLOCK


def test_production_vectors(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.op1_embedding_near_dedup(spark, sf).collect()), key=str) == brute_vectors(rows)


def brute_documents(docs, threshold=0.8):
    docs = sorted(docs, key=lambda r: (r[0] is None, r[0]))
    of = [minhash.shingles_of(t) for _, t in docs]
    same = lambda a, b: (docs[a][1] or "").split() == (docs[b][1] or "").split() != []
    links = [(a, b) for a in range(len(docs)) for b in range(a + 1, len(docs)) if same(a, b) or docs[a][0] is not None and docs[b][0] is not None and minhash.similarity(of[a], of[b]) >= threshold]
    comp = union(len(docs), links)
    return sorted(((docs[i][0], docs[comp[i]][0], docs[i][0] == docs[comp[i]][0]) for i in range(len(docs))), key=str)


def edited(rng, words, vocabulary, rate):
    return [rng.choice(vocabulary) if rng.random() < rate else w for w in words]


def test_documents(spark):
    rng = random.Random(8)
    vocabulary = [f"t{i}" for i in range(300)]
    docs = []
    for k in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(1, 300))]
        for _ in range(80 if k == 5 else rng.randint(1, 4)):
            docs.append((len(docs) * 5 % 1009, " ".join(edited(rng, base, vocabulary, rng.choice([0, 0.01, 0.02, 0.05])))))
    docs += [(3000, None), (3001, ""), (3002, " \n"), (None, docs[0][1]), docs[3], docs[3], (3003, docs[3][1].replace(" ", "\n"))]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    df = spark.createDataFrame(docs, schema)
    assert sorted(map(tuple, minhash.near_documents(spark, df).collect()), key=str) == brute_documents(docs)
    assert minhash.near_documents(spark, df.where("false")).count() == 0


def test_blocks(spark, monkeypatch):
    """Buckets of many texts that are near some of the others only."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rng = random.Random(2)
    vocabulary = [f"t{i}" for i in range(5000)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    docs = [(i, " ".join(base[: 100 + i % 3] + [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))])) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, minhash.near_documents(spark, df).collect()), key=str) == brute_documents(docs)


def test_repeated_rows(spark):
    """Repeated rows are verified once, and an id with several texts links by any of them."""
    rng = random.Random(3)
    base = [f"t{rng.randint(0, 5000)}" for _ in range(200)]
    docs = [(7, " ".join(base))] * 400 + [(3, " ".join([*base[:198], "x", "y"]))] * 400 + [(9, "other words " * 9), (9, " ".join(base[:190])), (11, " ".join([*base[:195], "z"]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {(r.doc_id, r.class_id) for r in minhash.near_documents(spark, df).collect()} >= {(7, 3), (3, 3), (9, 3), (11, 3)}
    kept = minhash.without_near_copies(spark, df).collect()
    assert Counter(r.doc_id for r in kept) == {3: 1}


def test_keys_tell_texts_apart():
    """Two arrangements of two words that sums of powers modulo 2**64 cannot tell apart."""
    order = [bin(i).count("1") % 2 for i in range(4096)]
    texts = [" ".join("ab"[x ^ flip] for x in order) for flip in (0, 1)]
    raw = "".join(texts).encode()
    k1, k2 = wordhash.text_keys(np.array([0, len(texts[0]), len(raw)]), np.frombuffer(raw, np.uint8))
    assert k1[0] != k1[1] and k2[0] != k2[1]
    words = ["".join("ab"[x ^ flip] for x in order) for flip in (0, 1)]
    raw = " ".join(words).encode()
    assert len(set(wordhash.word_hashes(np.array([0, len(raw)]), np.frombuffer(raw, np.uint8))[0].tolist())) == 2


def test_bound_of_similarity():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ({rng.randint(0, 7): rng.randint(1, 5) for _ in range(rng.randint(1, 8))} for _ in range(2))
        arrays = lambda x: (np.array(sorted(x), np.uint64), np.array([x[k] for k in sorted(x)]))
        j = minhash.similarity(arrays(a), arrays(b))
        one = lambda x: np.array([float(x)])
        assert minhash.may_link(np.array([[float(len(a.keys() & b.keys()))]]), one(len(a)), one(sum(a.values())), one(len(b)), one(sum(b.values())), j)[0, 0]


def test_registers_of_pieces(monkeypatch):
    rng = np.random.default_rng(2)
    shingles = np.unique(rng.integers(0, 1 << 62, 3000).astype(np.uint64))
    first, weights = np.array([0, 1000, 1000, len(shingles)]), rng.integers(1, 4, len(shingles))
    whole = minhash.signatures(shingles, weights, first, 125)
    monkeypatch.setattr(minhash, "PIECE", 170)
    assert (minhash.signatures(shingles, weights, first, 125) == whole).all()


def test_intersections():
    rng = random.Random(6)
    sets = [np.unique(np.array([rng.randint(0, 40) for _ in range(rng.randint(1, 30))], np.uint64)) for _ in range(12)]
    want = [[len(set(x.tolist()) & set(y.tolist())) for y in sets[5:]] for x in sets[:5]]
    assert minhash.intersections(sets[:5], sets[5:], columns=7).tolist() == want


def test_similarity_is_the_sum():
    rng = random.Random(1)
    for _ in range(50):
        a, b = ({rng.randint(0, 9): rng.randint(1, 4) for _ in range(rng.randint(1, 8))} for _ in range(2))
        want = sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in a.keys() | b.keys()) for d in a.keys() & b.keys())
        arrays = lambda x: (np.array(sorted(x), np.uint64), np.array([x[k] for k in sorted(x)]))
        assert abs(minhash.similarity(arrays(a), arrays(b)) - want) < 1e-12


def test_production_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op10_minhash_near_dedup(spark, sf).collect()), key=str) == brute_documents(docs)
