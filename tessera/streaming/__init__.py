"""Masks and closures on streams.

Masking is a projection, so it applies to a stream as it is: no state, no watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..config import Table
from ..functions.masks import apply_masks
from ..operators.lower import among, semi


def masked_stream(stream: DataFrame, table: Table, dialect: str = "null") -> DataFrame:
    """The declared columns of a stream of a table's rows, masked."""
    return apply_masks(stream, table, dialect)


def scoped_stream(stream: DataFrame, column: str, values: list) -> DataFrame:
    """Rows of a stream whose column has one of the values."""
    return among(stream, column, values)


def following_keys(stream: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows of a stream that point at kept keys, a table with the column `__key`."""
    return semi(stream, column, keys)


def patch_batches(stream: DataFrame, table: Table, apply: Callable[[DataFrame, int], None], checkpoint: str, dialect: str = "null") -> StreamingQuery:
    """Runs `apply` on the masked rows of each batch, with the batch's number, so that a repeated batch can be told."""
    return stream.writeStream.foreachBatch(lambda rows, n: apply(apply_masks(rows, table, dialect), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
