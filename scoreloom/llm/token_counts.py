"""Token counts of whole texts.

Arrow functions encode byte-balanced batches and return lengths only. Long texts come apart at safe
boundaries (tokens.PieceCounts): single spaces, and in long runs without spaces any two characters that
no piece has side by side. Only a run that has no such place goes to the library in one call.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import picked, texts_in
from .tokens import opened


def token_counts(docs: DataFrame, model: str, limit: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row, as the model's library counts them.

    Null texts count as empty (0 bytes, 0 tokens); null ids and repeated rows are kept as they are; an
    empty table gives an empty result; other columns, whatever their names, are not read. A text of any
    length is counted whole, in memory of a few times its bytes.
    """

    def count(batches):
        encoder = opened("piece", model)
        for part, texts in texts_in(batches):
            n = encoder.counts(texts)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pc.binary_length(texts).cast(pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = picked(docs, **{doc_id: "long", text: "string"}).toDF("doc_id", "text")
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
