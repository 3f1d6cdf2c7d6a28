"""Training sequences: mixed sources, held-out documents, fixed-length chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lingua_spark.operators.mixing import take_skip
from lingua_spark.operators.sequences import pack_chunks


def training_sequences(
    df: DataFrame, model, max_length: int = 2048, eval_docs: int = 3000, source: str = "source", order: str = "doc_id"
) -> DataFrame:
    """Chunks of the interleaved sources with ``part`` eval or train. After
    the narrow search for the limits everything is map-only."""
    labelled = take_skip(df, eval_docs, source, order)
    encoded = model.encode(labelled, out="input_ids").select(source, order, "part", "input_ids")
    return pack_chunks(encoded, "input_ids", max_length)
