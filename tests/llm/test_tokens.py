"""Token counts and byte-level BPE against the libraries themselves."""

import hashlib
import random

import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import types as T
from tokenizers import Tokenizer

import public_tokenizers as P
from loomq.llm import bytebpe, tokencount

rng = random.Random(5)
ALPHABET = ["a", "the", " ", "  ", "\n", "\t", " ", "　", "\x1c", "\x85", "é", "é", "'s", "'ll", "123", "½", "###", "|", "日本", "🙂", "<|endoftext|>", "<|startoftext|>", "́", "İ", "ſ", " ", "x" * 40, "Ü", "ß", ".", "_", "​"]
TEXTS = [None, "", " ", "\n\n", "a", " a ", "a" * 30_000, "ab " * 9_000 + "é"] + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 60))) for _ in range(1_500)]
TEXTS += TEXTS[:4]


def own_tiktoken():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bytebpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_lengths_equal_the_library(name):
    path = P.path(name)
    got = tokencount.lengths(pa.array(TEXTS, pa.string()), path, split=name == "word_bpe_49k.json")
    if name.endswith(".json"):
        t = Tokenizer.from_file(path)
        want = [len(x) for x in t.encode_batch([x or "" for x in TEXTS], add_special_tokens=False)]
    else:
        import sentencepiece

        want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode([x or "" for x in TEXTS])]
    assert got[1].tolist() == want
    assert got[0].tolist() == [len((x or "").encode()) for x in TEXTS]


def test_ids_equal_ranks():
    own = own_tiktoken()
    codec = bytebpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for text, ids in zip(TEXTS, codec.encode_column(pa.array(TEXTS, pa.string())), strict=True):
        assert ids.tolist() == own.encode_ordinary(text or "")
        assert codec.decode_bytes(ids) == (text or "").encode()


def test_offsets_and_split_characters():
    codec = bytebpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    text = "a 𝄞 日本語"
    ids = codec.encode(text)
    assert codec.decode(ids) == text
    assert any("�" in codec.decode(ids[:k]) for k in range(len(ids)))
    assert all(codec.decode_bytes(ids[:k]) + codec.decode_bytes(ids[k:]) == text.encode() for k in range(len(ids)))
    for i, a, b in codec.encode_with_offsets(text):
        assert 0 <= a < b <= len(text) and i in ids


def test_columns_rows_and_empty_tables(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_tokens", T.StringType()), T.StructField("id", T.StringType())])
    rows = [(1, "the cat", "x", None), (1, "the cat", "x", None), (None, None, None, "y"), (3, "", None, "y")]
    path, ranks = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.tiktoken")
    docs = spark.createDataFrame(rows, schema)
    assert sorted(map(str, tokencount.with_token_counts(docs, path).collect())) == sorted(["Row(doc_id=1, n_bytes=7, n_tokens=2)"] * 2 + ["Row(doc_id=None, n_bytes=0, n_tokens=0)", "Row(doc_id=3, n_bytes=0, n_tokens=0)"])
    made = bytebpe.round_trip(docs, ranks, P.PATTERN).collect()
    none = hashlib.sha256(b"").hexdigest()
    assert [(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in made if r.doc_id != 1] == [(0, none, none)] * 2
    assert {r.decoded_sha256 for r in made if r.doc_id == 1} == {hashlib.sha256(b"the cat").hexdigest()}
    assert [r.ids for r in bytebpe.round_trip(docs, ranks, P.PATTERN, with_ids=True).collect()][0] == own_tiktoken().encode_ordinary("the cat")
    empty = docs.where("false")
    assert tokencount.with_token_counts(empty, path).count() == bytebpe.round_trip(empty, ranks, P.PATTERN).count() == 0
