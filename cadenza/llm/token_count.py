"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common
from .pieces import ByteBPE, PieceBPE, WordBPE, encoder, text_bytes

KINDS = {"byte": ByteBPE, "word": WordBPE, "piece": PieceBPE}


def token_counts(docs: DataFrame, model: str, kind: str = "byte", id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit). No begin, end or padding tokens.

    Batches are passes of about equal bytes (pieces.PASS_BYTES); a long text is cut at places that no token crosses, so its
    pieces add up exactly. Null and empty texts have 0 bytes and 0 tokens; repeated ids stay repeated rows; other columns
    are not read.
    """

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(KINDS[kind], model)
        for b in batches:
            n = enc.count(b.column(1))
            size = np.diff(text_bytes(b.column(1))[1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    common.ship(docs.sparkSession)
    kept = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    return kept.mapInArrow(lengths, "id long, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text of documents under byte_bpe_50k.json."""
    import public_tokenizers

    common.bounded_batches(spark)
    return token_counts(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
