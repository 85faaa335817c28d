"""Byte-level BPE: the tokenizers library over Arrow batches, with its byte-to-character mapping and offsets.

The merge table is derived from a file of ranks: a token's merge is the pair that the ranks
below its own leave of its bytes, so applying the merges in order gives the encoding by
ranks. The pattern's matches never hold a non-space followed by white space, so texts are
cut before white space, each distinct piece is encoded once while the memo holds it, and
a text's ids are its pieces' ids in order. Decoding maps ids to characters of the byte
alphabet and those back to bytes; a slice of ids that ends within a character decodes
to bytes exactly and to text with U+FFFD for the split character.

Defined results: null and empty texts have no ids and decode to no bytes; repeated rows are
encoded row by row; an empty table gives an empty result; only the id and text columns are
read; very long texts are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext
from .arrowtext import lean


@lru_cache(1)
def byte_characters() -> dict[int, str]:
    """The byte alphabet: printable Latin-1 bytes stand for themselves, the others for U+0100 onwards."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_of(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The last two parts of token when only lower ranks merge; None if no merge makes it."""
    parts, limit = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], limit), i) for i in range(len(parts) - 1))
        if rank >= limit:
            return None
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


class Codec:
    """Encodes texts and decodes ids by one file of ranks and one pattern."""

    def __init__(self, path: str, pattern: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks = read_ranks(path)
        chars = byte_characters()
        name = lambda token: "".join(chars[b] for b in token)
        pairs = (merge_of(t, ranks) for t in sorted(ranks, key=ranks.get) if len(t) > 1)
        self.tokenizer = Tokenizer(models.BPE(vocab={name(t): r for t, r in ranks.items()}, merges=[(name(a), name(b)) for a, b in filter(None, pairs)]))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split(Regex(pattern), "isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ])
        # Decoding: the vocabulary's characters back to bytes.
        back = {c: b for b, c in chars.items()}
        tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for word, i in self.tokenizer.get_vocab().items():
            tokens[i] = bytes(back[c] for c in word)
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.table = np.frombuffer(b"".join(tokens), np.uint8)
        self.memo = arrowtext.Memo(lambda texts: [np.array(x.ids, np.uint32).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])

    def encode(self, text: str) -> list[int]:
        return self.encode_column(pa.array([text]))[0].tolist()

    def encode_with_offsets(self, text: str) -> list[tuple[int, int, int]]:
        """(id, start, end) of each token, in code points of text; tokens of a split character share its place."""
        x = self.tokenizer.encode(text, add_special_tokens=False)
        return [(i, a, b) for i, (a, b) in zip(x.ids, x.offsets, strict=True)]

    def encode_column(self, col) -> list[np.ndarray]:
        """The ids of each text."""
        offsets, raw = arrowtext.buffers(col)
        out: list[np.ndarray] = []
        for i, j in arrowtext.slices(offsets):
            lo, hi = offsets[i], offsets[j]
            cuts, first = arrowtext.cut_before_space(offsets[i : j + 1] - lo, raw[lo:hi])
            if len(cuts) == 1:
                out += [np.zeros(0, np.uint32)] * (j - i)
                continue
            values, codes = arrowtext.pieces(cuts, raw[lo:hi])
            each = self.memo(values.to_pylist())
            n = np.array([len(x) for x in each], np.int64) // 4
            flat, at = np.frombuffer(b"".join(each), np.uint32), np.cumsum(n) - n
            ids, ends = flat[arrowtext.ragged(at[codes], n[codes])], np.concatenate(([0], np.cumsum(n[codes])))
            out += [ids[ends[a] : ends[b]] for a, b in zip(first[:-1], first[1:], strict=True)]
        return out

    def decode_bytes(self, ids) -> bytes:
        ids = np.asarray(ids, np.int64)
        return self.table[arrowtext.ragged(self.starts[ids], self.sizes[ids])].tobytes()

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", errors="replace")


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def _mapped(docs: DataFrame, id_col: str, text_col: str, each, made: str) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in arrowtext.slices(arrowtext.buffers(batch.column(1))[0]):
                part = batch.slice(i, j - i)
                yield each(part.column(0), part.column(1))

    return rows.mapInArrow(lean(run), f"id {kind}, {made}").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every text, and the ids themselves if asked for."""

    def each(ids, texts):
        c = codec(path, pattern)
        lists = c.encode_column(texts)
        n = np.array([len(x) for x in lists], np.int64)
        of_ids = [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in lists]
        of_bytes = [hashlib.sha256(c.decode_bytes(x)).hexdigest() for x in lists]
        out = {"id": ids, "n_tokens": pa.array(n), "ids_sha256": pa.array(of_ids, pa.string()), "decoded_sha256": pa.array(of_bytes, pa.string())}
        if with_ids:
            flat = np.concatenate(lists).astype(np.int32) if lists else np.zeros(0, np.int32)
            out["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(flat))
        return pa.RecordBatch.from_pydict(out)

    return _mapped(docs, id_col, text_col, each, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
