"""Token counts of whole texts, huge ones by overlapping chunks.

Short texts are encoded whole, through the worker's memory of pre-tokens.  A
huge text is cut into overlapping chunks that are encoded with offsets and
joined where both encodings provably agree (:mod:`jurisloom.llm.encoding`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, extended, map_arrow, slices, text_or_empty
from .encoding import CHUNK_CHARS, SLICE_BYTES, encode_long, text_encoder


def count_tokens(
    df: DataFrame, path: str, text_col: str = "text", out_col: str = "n_tokens", chunk: int = CHUNK_CHARS
) -> DataFrame:
    """``df`` with the number of tokens of ``text_col`` (null: the empty text, 0).

    Narrow: no shuffle, rows stay where they are.  Other columns pass through
    unchanged, except that a column called ``out_col`` is replaced.  An empty
    table gives an empty table, repeated rows are counted one by one.
    """
    keep = df.drop(out_col)
    schema = extended(keep, **{out_col: "long"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = text_encoder(path)
        code = encode.code
        for whole in batches:
            for batch in slices(whole, text_col, SLICE_BYTES):
                texts = batch.column(text_col)
                huge = pc.fill_null(pc.greater(pc.utf8_length(texts), chunk), False).to_numpy(zero_copy_only=False) & code.resynchronises
                counts = encode.counts(pc.if_else(pa.array(huge), "", texts) if huge.any() else texts)
                for k in np.flatnonzero(huge).tolist():
                    counts[k] = sum(map(len, encode_long(texts[k].as_py(), code, chunk)))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(counts)], names=[*batch.schema.names, out_col]
                )

    return map_arrow(keep, run, schema)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents."""
    import public_tokenizers

    docs = documents(spark, sf_dir, "doc_id", "text")
    counted = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select(
        "doc_id",
        F.octet_length(text_or_empty("text")).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > 1024).alias("over_limit"),
    )
