"""Hierarchical multi-length packing of tokenized documents.

A document's ids are cut into full windows and a rest. Rests are routed to tiers by the least
power of two that holds them, the tier's context size. Tiers are packed from the longest to the
shortest: a rest opens a window of its tier, whole rests of shorter tiers fill the gap, the
largest that fit first, and the last gap is closed with a piece cut from a shorter tier. What
cannot be filled at the end of a block is cut into sequences of powers of two, so nothing is
padded. Sequences of one length are dealt to step groups of equal numbers of tokens.

A block of a task's documents is packed by itself: no shuffle, and memory for one block. Step
groups go on from block to block.
"""

from __future__ import annotations

import functools
import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

RESULT = "doc_id long, start long, length long, ids array<int>, doc_tokens long, sequence_id long, offset long, window int, step_group long"
DIGESTS = RESULT.replace("ids array<int>", "ids_crc32 long")
_KINDS = {"long": pa.int64(), "int": pa.int32(), "array<int>": pa.list_(pa.int32())}
_RESULT, _DIGESTS = (pa.schema([(c, _KINDS[k]) for c, k in map(str.split, x.split(", "))]) for x in (RESULT, DIGESTS))
#: Tokens of a step group.
STEP_TOKENS = 8192


@functools.lru_cache(2)
def encoder(path: str):
    """The byte-level BPE in a tokenizers JSON file; its ids are the ranks of its merges."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(2)
def added_tokens(path: str) -> tuple[re.Pattern | None, dict[str, int]]:
    """What finds the added tokens of a tokenizers JSON file in a text, and their ids."""
    with open(path, encoding="utf-8") as f:
        added = json.load(f).get("added_tokens", [])
    if odd := [t["content"] for t in added if any(t.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized"))]:
        raise ValueError(f"added tokens that match more or less than their content aren't supported: {odd}")
    ids = {t["content"]: t["id"] for t in added}
    longest_first = "|".join(map(re.escape, sorted(ids, key=len, reverse=True)))
    return (re.compile(f"({longest_first})") if ids else None), ids


def encode(path: str, text: str | None, end: int, added: bool = False) -> np.ndarray:
    """The ids of a text as uint32, then `end`. A null text has only `end`.

    With `added`, the content of an added token is that token's id, as by a `Tokenizer` as it is loaded; without, it is text
    like any other (`encode_special_tokens`).
    """
    pattern, of_added = added_tokens(path) if added else (None, {})
    ids = []
    for piece in pattern.split(text or "") if pattern else [text or ""]:
        if piece in of_added:
            ids.append(of_added[piece])
        elif piece:
            ids += encoder(path).encode_ordinary(piece)
    ids.append(end)
    return np.array(ids, np.uint32)


class _Rests:
    """Rests by length; the longest that is at most some length is found at once."""

    def __init__(self):
        self.by, self.mask = {}, 0

    def put(self, length: int, piece: tuple[int, int]) -> None:
        self.by.setdefault(length, []).append(piece)
        self.mask |= 1 << length

    def take(self, most: int) -> tuple[int, tuple[int, int]] | None:
        length = (self.mask & ((2 << most) - 1)).bit_length() - 1
        if length < 0:
            return None
        held = self.by[length]
        piece = held.pop()
        if not held:
            self.mask ^= 1 << length
        return length, piece


def plan(lengths: list[int], window: int) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Sequences (size, pieces (document, start, length)) that hold every id of documents of these lengths once.

    `window` is a power of two; sizes are powers of two up to it, and each sequence is full.
    """
    out, rests = [], _Rests()
    for doc, n in enumerate(lengths):
        whole = n // window * window
        out += [(window, [(doc, s, window)]) for s in range(0, whole, window)]
        if n > whole:
            rests.put(n - whole, (doc, whole))
    tier = window
    while tier:
        opened = rests.take(tier)
        if opened is None:
            break
        length, (doc, start) = opened
        while tier >= 2 * length:
            tier //= 2
        pieces, gap = [(doc, start, length)], tier - length
        while gap:
            found = rests.take(gap)
            if found:
                length, (doc, start) = found
                pieces.append((doc, start, length))
                gap -= length
                continue
            found = rests.take(tier)  # longer than the gap: cut
            if not found:
                break
            length, (doc, start) = found
            pieces.append((doc, start, gap))
            rests.put(length - gap, (doc, start + gap))
            gap = 0
        if not gap:
            out.append((tier, pieces))
            continue
        total, done, i = tier - gap, 0, 0  # nothing is left to fill it: powers of two
        size = tier
        while size:
            if total & size:
                row, need = [], size
                while need:
                    doc, start, length = pieces[i]
                    n = min(need, length - done)
                    row.append((doc, start + done, n))
                    done, need = done + n, need - n
                    if done == length:
                        i, done = i + 1, 0
                out.append((size, row))
            size //= 2
    return out


def sequences(docs: DataFrame, tokenizer: str, window: int = 1024, end: int = 0, block_bytes: int = 6 << 20) -> DataFrame:
    """Packs all documents; one row for each piece of a document in a sequence, with its token ids.

    A sequence is the ids of its pieces in the order of their offsets: `window` ids in all.

    docs: doc_id, text; other columns don't matter. tokenizer: path of a byte-level BPE in tokenizers JSON, readable on the
    executors; ids are those of its `Tokenizer`, added tokens in a text included. A null or empty text is the `end` id alone. Rows that share a doc_id are packed each by itself; a null doc_id
    stays null. An empty table gives no rows. A text of any length is cut over as many windows as it needs. Sequence ids are
    distinct, not consecutive: the task's partition in the upper bits.
    """
    if window & (window - 1):
        raise ValueError(f"window must be a power of two, not {window}")

    def emit(batches):
        sequence, used = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36, {}
        for block in T.blocks(batches, "text", block_bytes):
            doc_ids = block.column("doc_id").to_pylist()
            ids = [encode(tokenizer, t, end, added=True) for t in block.column("text").to_pylist()]
            rows = []
            for size, pieces in plan([len(x) for x in ids], window):
                offset = 0
                tokens = used[size] = used.get(size, 0) + size
                step = (tokens - 1) // STEP_TOKENS
                for doc, start, n in pieces:
                    rows.append((doc_ids[doc], start, n, ids[doc][start : start + n].astype(np.int32), len(ids[doc]), sequence, offset, size, (sequence >> 36 << 36) + (step << 11) + size))
                    offset += n
                sequence += 1
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _RESULT, strict=True)], schema=_RESULT)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(emit, RESULT)


def digests(packed: DataFrame) -> DataFrame:
    """The pieces of `sequences` with ids_crc32, of the ids as little-endian 32-bit numbers, in place of the ids."""

    def emit(batches):
        for batch in batches:
            ids = batch.column("ids")
            values, at = ids.values.to_numpy().astype("<u4"), ids.offsets.to_numpy()
            crc = pa.array([zlib.crc32(values[i:j].tobytes()) for i, j in zip(at[:-1], at[1:], strict=True)], pa.int64())
            yield pa.record_batch([crc if c == "ids_crc32" else batch.column(c) for c in _DIGESTS.names], schema=_DIGESTS)

    return packed.mapInArrow(emit, DIGESTS)


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, end: int = 0, block_bytes: int = 6 << 20) -> DataFrame:
    """The digests of `sequences`."""
    return digests(sequences(docs, tokenizer, window, end, block_bytes))
