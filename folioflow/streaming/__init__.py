"""Checks on streams: the row-wise rules need no state, so a stream of elements takes the same plan as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import checks


def bounds_stream(elements: DataFrame) -> DataFrame:
    """F01 and F02 on a streaming table of elements."""
    if not elements.isStreaming:
        raise ValueError("a streaming DataFrame is expected")
    return checks.bounds(elements)
