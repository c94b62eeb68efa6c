"""Queries on streams of documents. Documents are self-contained, so evaluating each micro-batch alone is exact: no watermark, no state."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..api import XPath, query_many, shred_documents
from ..sources.shred import NODE_COLUMNS, shred


def stream_nodes(docs: DataFrame, key: str = "doc_id", html: str = "html") -> DataFrame:
    """The node table of a stream: shredding is stateless, so this is a stream itself."""
    return shred(docs, key, html, NODE_COLUMNS)


def stream_query(
    expressions: Mapping[str, str], docs: DataFrame, sink: Callable[[DataFrame, int], None], key: str = "doc_id", html: str = "html", **options: object
) -> DataStreamWriter:
    """A writer that shreds each micro-batch once and hands the matches (with ``query_name``) to ``sink(results, batch_id)``.

    ``sink`` sees a batch again after a failure, with the same id: write idempotently.
    """
    for expression in expressions.values():
        XPath(expression)  # syntax errors belong to the driver, before the stream starts

    def run(batch: DataFrame, batch_id: int) -> None:
        table = shred_documents(batch, key, html)
        try:
            sink(query_many(expressions, table, key=key, **options), batch_id)
        finally:
            table.unpersist()

    return docs.writeStream.foreachBatch(run)
