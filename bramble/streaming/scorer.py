"""Rules applied to a stream (an extension; the model is static)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from bramble.operators import induction


def scored_stream(rows: DataFrame, rules: DataFrame, centres: Mapping[str, Sequence[float]], label: str, order: str) -> DataFrame:
    """Each streamed row with the label of the first rule of its bins, 0 without one: a stream-static join."""
    return induction.predicted(rows, rules, centres, label, order)


def appended(stream: DataFrame, path: str, offsets: str) -> None:
    """All that the stream has now, by micro-batches to a table; a run with the same offsets goes on where this one ended."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", offsets).trigger(availableNow=True).start().awaitTermination()
