"""Operator 9, token counts: Arrow functions that return lengths only.

A batch is handled in slices of about ``tokens.BATCH_BYTES`` bytes, not of so many rows, and
a long text is cut at safe boundaries (single inner spaces, which no piece crosses), so the
memory of a task doesn't follow the longest text.  Texts that hold U+2581, which the model
takes for a space, are encoded whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import table
from causeway.llm.tokens import IdCoder, PieceCounter, byte_chunks, coder

#: A document with more tokens is over the limit.
LIMIT = 4096


def token_count(text: Column, path: str) -> Column:
    """Tokens of each text (null: 0) as the library of the vocabulary file counts them, without added tokens.

    ``path``: a sentencepiece ``.model`` or a tokenizers ``.json``.  Empty texts have no
    tokens; repeated texts the same count.
    """
    kind = PieceCounter if path.endswith(".model") else IdCoder

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        c, out = coder(kind, path), np.zeros(len(texts), dtype=np.int64)
        for at, n, data, offsets in byte_chunks(texts):
            out[at : at + n] = c.count(data, offsets)
        return pa.array(out)

    return count(text)


def count_tokens(df: DataFrame, path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """``df`` with a count column; one of the same name is replaced, all others stay.

    Null and empty texts have 0 tokens; texts of any length are counted whole; an empty table gives no rows.
    """
    return df.withColumn(out, token_count(F.col(text), path))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text of ``documents`` under the 32k piece vocabulary."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > LIMIT).alias("over_limit"),
    )
