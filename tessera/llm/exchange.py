"""Shuffles of compressed blocks, and where to cut lineage.

Rows that only differ in a few bytes cost more as rows than as blocks: a task gathers what
goes to one part, writes it as one compressed Arrow stream, and sends that as a row.
"""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import shared_dir
from . import text as T

#: Bytes of text for which there is one part of an exchange.
PART_BYTES = 8 << 20
#: Bytes of text in a block of a map task.
BLOCK_BYTES = 8 << 20
#: Tasks that parts are dealt to at most.
MOST_TASKS = 20_000
_OPTIONS = pa.ipc.IpcWriteOptions(compression="zstd")


def cut(df: DataFrame) -> DataFrame:
    """Computes the rows now and writes them to the shared folder; later jobs read them from there.

    Shuffle files that only led to these rows are then of no use; Spark removes them when the JVM has collected what refers
    to them, so a collection is asked for, lest every step's files stay until the last.
    """
    shared_dir(df.sparkSession)
    out = df.checkpoint()
    del df
    gc.collect()
    out.sparkSession.sparkContext._jvm.System.gc()
    return out


def parts_for(docs: DataFrame, column: str = "text", part_bytes: int = PART_BYTES) -> int:
    """How many parts an exchange of these texts needs so that each holds about `part_bytes`."""
    size = docs.agg(F.sum(F.octet_length(F.col(column)))).first()[0] or 0
    return max(1, -(-int(size) // part_bytes))


def dealt(df: DataFrame, parts: int, key: str) -> DataFrame:
    """The rows by a number from 0 to parts - 1, a task for each; for more than MOST_TASKS by hash, so that a task has a few.

    A task's share of the input is thus that of one part, or few, at any size.
    """
    return df.repartitionById(parts, F.col(key).cast("int")) if parts <= MOST_TASKS else df.repartition(MOST_TASKS, key)


def seal(table: pa.Table | pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=_OPTIONS) as out:
        out.write(table)
    return sink.getvalue().to_pybytes()


def unseal(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def id_hash(ids) -> np.ndarray:
    """A hash of int64 ids; null counts as the least id."""
    return T.mix(ids_of(ids).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))


def ids_of(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.array(pc.fill_null(column.cast(pa.int64()), -(1 << 63)).to_numpy(zero_copy_only=False), np.int64)


def nullable_ids(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == -(1 << 63))


def grouped(keys: np.ndarray):
    """Each distinct key with the positions that have it, in order."""
    if not len(keys):
        return
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    cuts = np.flatnonzero(ordered[1:] != ordered[:-1]) + 1
    for part in np.split(order, cuts):
        yield keys[part[0]], part


def tags_of(column) -> np.ndarray:
    """A 32-bit hash of each text."""
    data, at = T.flat(column)
    out = np.zeros(len(at) - 1, np.uint32)
    for i, j in T.slices(at):
        out[i:j] = T.span_hash(data[at[i] : at[j]], at[i:j] - at[i], at[i + 1 : j + 1] - at[i]).astype(np.uint32)
    return out


def part_of(ids: np.ndarray, tags: np.ndarray, parts: int) -> np.ndarray:
    """The part of a document, by its id and text: neither many texts of one id nor many ids of one text are one part."""
    return (T.mix(id_hash(pa.array(ids)) + tags.astype(np.uint64)) % np.uint64(parts)).astype(np.int32)


def text_parts(docs: DataFrame, parts: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (part, blob): the documents of a part, as sealed tables of doc_id, tag and text. Empty texts are dealt out in turn."""

    def emit(batches):
        for block in T.blocks(batches, "text", block_bytes):
            ids, tags = ids_of(block.column("doc_id")), tags_of(block.column("text"))
            part = part_of(ids, tags, parts)
            empty = np.flatnonzero(np.asarray(pc.binary_length(block.column("text")).fill_null(0)) == 0)
            part[empty] = (empty + int(tags.sum(dtype=np.uint64) % np.uint64(parts))) % parts
            table = pa.table({"doc_id": block.column("doc_id").cast(pa.int64()), "tag": tags, "text": block.column("text").cast(pa.large_string())})
            for key, rows in grouped(part):
                yield pa.record_batch({"part": pa.array([key], pa.int32()), "blob": pa.array([seal(table.take(pa.array(rows)).combine_chunks())], pa.binary())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(emit, "part int, blob binary")
