"""Operator 10: token counts of whole texts, without keeping any ids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm.common import table
from notelake.llm.tokenization import encode_batches, encoder


def token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", *, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, batch_bytes: int = 1 << 20, piece_chars: int = 1 << 16) -> DataFrame:
    """One row a document: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Arrow batches go to the tasks with three columns only and come back as lengths. Inside a task, texts are encoded in
    batches of about batch_bytes; a text over piece_chars is cut where no token can cross (in front of blanks and line
    ends, at punctuation, never inside a special string) and its pieces share batches with other texts. A null text counts as empty (0 bytes, 0
    tokens), a null id stays null, repeated rows are counted each, a count equal to the limit isn't over it, columns
    other than the id and the text are left out, whatever their names, and an empty table gives no row.
    """
    kind = dict(docs.dtypes)[id_col]
    schema = f"{id_col} {kind}, n_bytes long, n_tokens long, over_limit boolean"

    def count(batches):
        encode = encoder(tokenizer)
        for batch in batches:
            ids, texts, sizes = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            counts = np.zeros(len(sizes), np.int64)
            for i, lists in encode_batches(encode, texts.to_pylist(), batch_bytes, piece_chars):
                counts[i] = sum(map(len, lists))
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(counts), pa.array(counts > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col), text.alias("_text"), F.octet_length(text).cast("long").alias("_size")).mapInArrow(count, schema)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
