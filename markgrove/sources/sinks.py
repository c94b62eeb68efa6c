"""Writing results: tables partitioned by query, or one JSON object per document."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..api import to_json_documents


def write_results(results: DataFrame, path: str, mode: str = "error") -> None:
    """Parquet; by ``query_name`` if the results have one."""
    writer = results.write.mode(mode)
    (writer.partitionBy("query_name") if "query_name" in results.columns else writer).parquet(path)


def write_json(results: DataFrame, path: str, key: str = "doc_id", mode: str = "error", docs: DataFrame | None = None, html: str = "html") -> None:
    """JSON lines ``{results, count, error}``, one per document that has matches; with ``docs``, one per document."""
    to_json_documents(results, key, docs, html).select("json").write.mode(mode).text(path)
