"""Substring and suffix-array dedup against brute force."""

import hashlib
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomq.llm import automaton, queries, repeats, suffixdedup, wordhash

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("k1", T.StringType()), T.StructField("rep", T.StringType())])


def corpus(seed, words, n, long):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" if i % 3 else f"v{i}" for i in range(words)]
    some = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    shared = [some(rng.randint(5, 60)) for _ in range(5)]
    docs = []
    for i in range(n):
        parts = [rng.choice(shared) if rng.random() < 0.5 else some(rng.randint(0, long)) for _ in range(rng.randint(0, 5))]
        text = rng.choice([" ", "\n", "  "]).join(x for p in parts for x in p)
        docs.append((i * 3 % 101, text, "x", "y"))
        if rng.random() < 0.15:
            docs.append((i + 200, text, "x", None))
    docs += [(7, None, None, None), (None, docs[0][1], "a", "a"), (None, None, None, None), docs[1], docs[1], (500, "", "", ""), (501, "ab" * 700, "", ""), (502, "z " * 400, "", "")]
    rng.shuffle(docs)
    return docs


def brute_bytes(docs, width):
    raws = [(t or "").encode() for _, t, *_ in docs]
    seen = {}
    for d, r in enumerate(raws):
        for i in range(len(r) - width + 1):
            seen.setdefault(r[i : i + width], []).append((d, i))
    gone = [bytearray(len(r)) for r in raws]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d][i : i + width] = b"\x01" * width
    out = []
    for (doc_id, *_), r, g in zip(docs, raws, gone, strict=True):
        runs = sum(g[i] and not (i and g[i - 1]) for i in range(len(g)))
        out.append((doc_id, len(r), sum(g), runs, hashlib.sha256(bytes(b for b, x in zip(r, g, strict=True) if not x)).hexdigest()))
    return sorted(out, key=str)


def brute_words(docs, width):
    first = {}
    split = [(t or "").encode().split() for _, t, *_ in docs]
    for (doc_id, *_), w in zip(docs, split, strict=True):
        for i in range(len(w) - width + 1):
            if doc_id is not None:
                key = tuple(w[i : i + width])
                first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for (doc_id, *_), w in zip(docs, split, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if doc_id is not None and first[tuple(w[i : i + width])] < doc_id:
                gone[i : i + width] = [True] * width
        out.append((doc_id, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("seed", "words", "hot"), [(1, 500, 4096), (2, 6, 4096), (3, 40, 3), (4, 3, 2)])
def test_bytes(spark, monkeypatch, seed, words, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    docs = corpus(seed, words, 60, 60)
    made = suffixdedup.remove_repeated_bytes(spark, spark.createDataFrame(docs, SCHEMA), width=60, gram=16)
    rows = made.select("doc.doc_id", "n", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, rows), key=str) == brute_bytes(docs, 60)


@pytest.mark.parametrize(("seed", "words", "hot"), [(1, 500, 4096), (2, 6, 4096), (3, 40, 3), (4, 3, 2)])
def test_words(spark, monkeypatch, seed, words, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    docs = corpus(seed, words, 60, 60)
    made = automaton.remove_repeated_words(spark, spark.createDataFrame(docs, SCHEMA), width=13, gram=5)
    rows = made.select("doc.doc_id", "n", "n_removed", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, rows), key=str) == brute_words(docs, 13)


def test_production_queries(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = queries.op6_suffix_array_dedup(spark, sf).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, rows), key=str) == brute_bytes(docs, 200)
    rows = queries.op5_substring_dedup(spark, sf).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, rows), key=str) == brute_words(docs, 13)


def test_empty_and_text(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert suffixdedup.remove_repeated_bytes(spark, empty).count() == automaton.remove_repeated_words(spark, empty).count() == 0
    passage = "é" * 150
    docs = spark.createDataFrame([(1, "a" + passage + "b", "p", "q"), (2, "x" + passage, "r", None), (3, None, "s", None)], SCHEMA)
    out = {r.doc_id: r for r in suffixdedup.without_repeats(spark, docs).collect()}
    assert {k: (r.text, r.k1, r.rep) for k, r in out.items()} == {1: ("ab", "p", "q"), 2: ("x", "r", None), 3: (None, "s", None)}


def test_split_characters(spark):
    """A cut takes the rest of a character that it splits, and nothing that the author wrote."""
    for left, right in (("é", "è"), ("日", "旦"), ("🙂", "🙃")):
        first, second = (f"a\ufffd{c}{'x' * 250}{d}\ufffdb" for c, d in ((left, right), (right, left)))
        rows = [(1, first, "", ""), (2, second, "", ""), (3, f"{left}{'x' * 250}", "", "")]
        got = {r.doc_id: r.text for r in suffixdedup.without_repeats(spark, spark.createDataFrame(rows, SCHEMA)).collect()}
        assert got[1].replace(left, "").replace(right, "") == got[2].replace(left, "").replace(right, "") == "a\ufffd\ufffdb" and set(got[3]) <= {left}
    part = "é日🙂".encode()
    assert repeats.whole_characters(part[1:], True, False) == "日🙂".encode() and repeats.whole_characters(part[:-1], False, True) == "é日".encode()
    assert repeats.whole_characters(part, True, True) == part and repeats.whole_characters(part[1:2], True, True) == b""


def test_long_texts(spark):
    """Texts of several pieces: a passage across the seam, one at the end, and repeats within the text."""
    rng = random.Random(11)
    fill = lambda n: "".join(rng.choices("abcdefghij klmnop\n", k=n))
    passage, own = "<" + fill(997) + ">", "[" + fill(497) + "]"
    size = repeats.PIECE
    long = fill(size - 400) + "(" + passage + "1" + fill(size + 7000) + "2" + own + "3" + fill(900) + "4" + own + "5" + fill(300)
    rows = [(5, long, "", ""), (9, "0" + passage + "6", "", ""), (1, "7" + passage + "8", "", "")]
    got = {r[0]: (r[1], r[2], r[3]) for r in suffixdedup.remove_repeated_bytes(spark, spark.createDataFrame(rows, SCHEMA)).select("doc.doc_id", "n_removed", "n_spans", F.length("kept")).collect()}
    assert got == {5: (2 * len(own) + len(passage), 3, len(long) - 2 * len(own) - len(passage)), 9: (len(passage), 1, 2), 1: (len(passage), 1, 2)}
    rows = [(5, long.replace("(", " ").replace("1", " ").replace("2", " "), "", ""), (9, passage, "", ""), (1, own, "", "")]
    got = {r[0]: (r[1], r[2]) for r in automaton.remove_repeated_words(spark, spark.createDataFrame(rows, SCHEMA)).select("doc.doc_id", "n", "n_removed").collect()}
    assert got[1] == (len(own.split()), 0) and got[9] == (len(passage.split()), len(passage.split()))
    assert got[5][0] == len(rows[0][1].split()) and 2 * len(own.split()) - 4 <= got[5][1] <= 2 * len(own.split())


def test_pieces_change_nothing(monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choices(["a", "b", "é", " ", "\n", "long" * 40, "x" * 700], k=rng.randint(0, 300))) for _ in range(30)] + ["", " ", "  a", "a  ", "y" * 3000]
    for text in texts:
        raw = np.frombuffer(text.encode(), np.uint8) if text else np.zeros(0, np.uint8)
        offsets = np.array([0, len(raw)])
        whole = wordhash.word_hashes(offsets, raw)[0].tolist(), [x.tolist() for x in wordhash.text_keys(offsets, raw)]
        joined = " ".join(text.split(" ")).encode().split()
        digest = np.frombuffer(hashlib.blake2b(b" ".join(joined), digest_size=16).digest(), np.int64).tolist()
        assert [x[0] for x in whole[1]] == digest and len(whole[0]) == len(joined)
        monkeypatch.setattr(wordhash, "PIECE", 64)
        assert (wordhash.word_hashes(offsets, raw)[0].tolist(), [x.tolist() for x in wordhash.text_keys(offsets, raw)]) == whole
        cut = sorted(rng.sample(range(len(joined) + 1), min(4, len(joined) + 1)))
        cuts = list(zip(cut[::2], cut[1::2], strict=False))
        assert repeats._words_left(text.encode(), cuts) == (len(joined), b" ".join(w for i, w in enumerate(joined) if not any(a <= i < b for a, b in cuts)))
        monkeypatch.undo()
    for words in (False, True):
        kind = repeats.Kind(9, 3, words, False)
        raw = np.frombuffer(" ".join(rng.choices("abcd", k=2000)).encode(), np.uint8)
        offsets = np.array([0, len(raw)])

        def windows():
            out = {}
            for p in repeats.pieces(offsets, raw, kind):
                found = repeats.anchors(p.values, wordhash.prefix_hash(p.values), p.first, kind)
                for h, at, lo, hi in zip(found.h.tolist(), found.at.tolist(), found.lo.tolist(), found.hi.tolist(), strict=True):
                    out |= {x + p.shift: (h, at + p.shift) for x in range(lo, hi + 1)}
            return out

        whole = windows()
        monkeypatch.setattr(repeats, "PIECE", 100)
        assert windows() == whole and len(whole) > 1000
        monkeypatch.undo()


def test_worker_memory():
    """A task over a text of 64 MB takes little more than the text."""
    import subprocess
    import sys

    code = """
import resource, sys
import numpy as np, pyarrow as pa
from loomq.llm import minhash, repeats
n = 1 << int(sys.argv[2])
text = np.random.default_rng(0).choice(np.frombuffer(b"abcdefgh   \\n", np.uint8), n).tobytes().decode()
one = lambda t, x: pa.array([x], t)
for words in (False, True):
    kind = repeats.Kind(13, 5, True, True) if words else repeats.Kind(200, 32, False, False)
    batch = pa.RecordBatch.from_arrays([one(pa.int64(), 1), one(pa.int64(), 2), one(pa.string(), text)], names=["k1", "k2", "text"])
    if sys.argv[1] == "scan":
        sum(b.num_rows for b in repeats._scan(kind)(iter([batch])))
if sys.argv[1] == "sign":
    sum(b.num_rows for b in minhash._sign(iter([pa.RecordBatch.from_arrays([one(pa.int64(), 1), one(pa.string(), text), one(pa.int64(), 2)], names=["id", "text", "key"])])))
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)
"""
    for what, most in (("scan", 600), ("sign", 1100)):
        small, large = (int(subprocess.run([sys.executable, "-c", code, what, bits], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2]).stdout) for bits in ("10", "26"))
        assert large - small < most * 1024, (what, small, large)


def test_automaton():
    rng = random.Random(9)
    for _ in range(200):
        refs = [([rng.randint(0, 2) for _ in range(rng.randint(0, 12))], rng.randint(0, 9)) for _ in range(rng.randint(1, 5))]
        a = automaton.SuffixAutomaton()
        for s, o in refs:
            a.add(s, o)
        a.finish()
        q, w = [rng.randint(0, 2) for _ in range(20)], rng.randint(1, 4)
        want = []
        for i in range(len(q) - w + 1):
            own = [o for s, o in refs if any(s[j : j + w] == q[i : i + w] for j in range(len(s) - w + 1))]
            if own:
                want.append((i, min(own)))
        assert list(a.matches(q, w)) == want


def test_automata_decide(monkeypatch):
    """The automata find the windows of smaller documents themselves, without a hash of windows."""

    def refused(*_):
        raise AssertionError("windows were hashed")

    monkeypatch.setattr(repeats, "window_keys", refused)
    monkeypatch.setattr(automaton, "window_keys", refused, raising=False)
    rng = random.Random(5)
    kind = repeats.Kind(4, 2, True, True)
    for _ in range(50):
        rows = sorted((rng.randint(0, 2), rng.randint(0, 5), i, [rng.randint(0, 2) for _ in range(rng.randint(4, 9))]) for i in range(12))
        h, rep, k1 = (np.array([r[c] for r in rows], np.int64) for c in (0, 1, 2))
        items = np.array([x for r in rows for x in r[3]], "<u8")
        first = np.concatenate(([0], np.cumsum([len(r[3]) for r in rows])))
        made = automaton.decide(repeats.Segments(h, k1, k1, rep, [[10 * r[2], 1000] for r in rows], first, items, items), kind)
        got = {(rows[seg][2], x) for seg, lo, hi in made for x in range(lo, hi + 1)}
        windows = [(g, own, k, i, tuple(s[i : i + 4])) for g, own, k, s in rows for i in range(len(s) - 3)]
        want = {(k, start + i) for g, own, k, i, w in windows if any(g == x and o < own and w == y for x, o, _, _, y in windows) for start in (10 * k, 1000)}
        assert got == want
