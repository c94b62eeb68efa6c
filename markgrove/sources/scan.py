"""Spreading small inputs over the cores before CPU-heavy work."""

from __future__ import annotations

from pyspark.sql import DataFrame


def _plain(plan) -> bool:
    """Whether a plan only scans, filters and projects, so that planning it runs nothing."""
    children = plan.children()
    return plan.nodeName() in ("Project", "Filter", "Relation", "LogicalRelation", "LogicalRDD") and all(_plain(children.apply(i)) for i in range(children.size()))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files make fewer partitions than that: a few small ones.

    Larger inputs stay where they are, and so do streams and plans that shuffle anyway.
    """
    if df.isStreaming or not _plain(df._jdf.queryExecution().optimizedPlan()):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
