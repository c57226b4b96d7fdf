"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import byte_slices, id_text, large
from .tokens import count_tokens

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def token_counts(docs: DataFrame, vocab: str, limit: int = 2048, slice_bytes: int = 16 << 20) -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit.

    ``vocab`` is the path of a tokenizers JSON file that every worker has.
    Arrow batches are cut into slices of about ``slice_bytes`` text bytes, and
    each text into chunks at boundaries where the tokenizer cuts anyway, so a
    very long text costs memory for its distinct chunks only.  Only lengths
    leave the function; nothing is shuffled.

    A null or empty text has no bytes and no tokens.  A null doc_id stays null,
    repeated rows stay repeated, an empty table gives an empty result, and
    other columns of ``docs`` are ignored.
    """
    def run(batches):
        for b in byte_slices(batches, limit=slice_bytes):
            text = large(b.column("text"))
            n = count_tokens(vocab, text)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pc.binary_length(text), pa.array(n, pa.int64()), pa.array(n > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return id_text(docs).mapInArrow(run, SCHEMA)
