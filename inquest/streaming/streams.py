"""Questions about rows that keep arriving.

An answer depends on its row alone, so with an expression backend ``operators.ask.ask`` works on a streaming
DataFrame unchanged and composes with watermarks and windows. A model that answers outside Catalyst is asked
within each micro-batch, once for each different document of the batch.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import DataStreamWriter

from inquest.operators.ask import AskLog, ask
from inquest.operators.backends import ModelBackend
from inquest.operators.calls import ModelCall


def ask_stream(df: DataFrame, call: ModelCall, documents: Sequence[Column | str], out: str, backend: ModelBackend) -> DataFrame:
    """A streaming DataFrame with an answer column; expression backends only."""
    if not df.isStreaming:
        raise ValueError("the DataFrame is not a stream; use operators.ask.ask")
    if backend.expression(call, ["NULL"] * call.documents) is None:
        raise ValueError("this model answers in batches; use ask_each_batch")
    return ask(df, call, documents, out, backend)


def ask_each_batch(df: DataFrame, call: ModelCall, documents: Sequence[Column | str], out: str, backend: ModelBackend, sink: Callable[[DataFrame, int], None], log: AskLog | None = None) -> DataStreamWriter:
    """A writer that gives each micro-batch with its answers to ``sink(batch, number)``."""

    def each(batch: DataFrame, number: int) -> None:
        sink(ask(batch, call, documents, out, backend, log=log), number)

    return df.writeStream.foreachBatch(each)
