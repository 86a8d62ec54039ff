"""A frozen forest over a stream of rows: stateless, so any trigger and any restart give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from treesum.operators.forest import predict_summary


def score_stream(trees: DataFrame, stream: DataFrame, lo: float = -0.5, span: float = 1.0, binary: bool = False) -> DataFrame:
    """stream(row_id, x, offset) to (row_id, mean, quantiles)."""
    return predict_summary(trees, stream, lo, span, binary=binary)
