"""Token counts: batches encoded in Arrow functions that return lengths only.

Texts are taken in batches balanced by bytes and split where an ASCII space follows a
character that is no white space. The vocabulary's pre-tokenizer never joins characters
across white space and its normalizer changes no character because of a neighbour beyond
it, so the lengths of the pieces add up to the length of the text; each distinct piece is
encoded once while the memo holds it.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows and ties are
counted row by row; an empty table gives an empty result; only the id and text columns are
read, so clashing names in other columns do not matter; very long texts are counted whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext
from .arrowtext import lean

_COUNTERS: dict[str, arrowtext.Memo] = {}


def counter(path: str):
    """A memoised function from texts to token counts; path names a .json or a .model file."""
    if path in _COUNTERS:
        return _COUNTERS[path]
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        many = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    else:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        many = lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    _COUNTERS[path] = arrowtext.Memo(many, 64 << 20)
    return _COUNTERS[path]


def lengths(col, path: str, split: bool) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, tokens) of each text of an Arrow column."""
    offsets, raw = arrowtext.buffers(col)
    count, tokens = counter(path), np.zeros(len(offsets) - 1, np.int64)
    for i, j in arrowtext.slices(offsets):
        lo, hi = offsets[i], offsets[j]
        cuts, first = arrowtext.cut_before_space(offsets[i : j + 1] - lo, raw[lo:hi]) if split else (offsets[i : j + 1] - lo, np.arange(j - i + 1))
        if len(cuts) > 1:
            values, codes = arrowtext.pieces(cuts, raw[lo:hi])
            each = np.asarray(count(values.to_pylist()), np.int64)
            ends = np.concatenate(([0], np.cumsum(each[codes])))
            tokens[i:j] = ends[first[1:]] - ends[first[:-1]]
    return np.diff(offsets), tokens


def with_token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", split: bool | None = None) -> DataFrame:
    """(id, n_bytes, n_tokens) of every row of docs.

    split: cut texts at white space; by default for .json vocabularies, as a sentencepiece
    model may have pieces that hold several words.
    """
    split = path.endswith(".json") if split is None else split

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_tokens = lengths(batch.column(1), path, split)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes), pa.array(n_tokens)], names=["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(lean(count), f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)
