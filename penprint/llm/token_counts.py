"""Token counts: batch encoding in Arrow functions that return lengths only.

Batches are balanced by bytes and long texts are split at safe boundaries
(``tokenizing``). One row per input row, no shuffle.

Defined cases: a null or empty text has 0 bytes and 0 tokens; a null id is
passed through; repeated rows are counted each; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penprint.llm.tokenizing import encoder
from penprint.llm.words import text_buffers

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row; ``vocabulary`` is a public file's name or a path."""
    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = text_buffers(batch.column(1))
            tokens = encoder(vocabulary).lengths(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(tokens, pa.int64()),
                 pa.array(tokens > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col), F.col(text_col))
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(lengths, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
