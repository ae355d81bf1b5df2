"""Substring dedup: words inside windows that also begin earlier in the corpus go.

Every window of `width` words gets a Rabin-Karp hash. A task keeps the earliest of equal
windows of its block, so a window of a third of all rows reaches a reducer once for each
block, and sends hashes and positions to buckets, as compressed blocks. A bucket counts equal
hashes; all but the earliest position are claims, which go to the part of their document
and merge into maximal intervals there. Parts and buckets are of bounded size, and as many as the
input needs.

Equality is by 64 bits of one hash and the bucket by a second, independent hash: with n
windows and b buckets, a false match anywhere has a chance of about n^2 / (2^65 b).
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import text as T

RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
_RESULT = pa.schema({"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "kept": pa.string()})


def _seal_claims(ids, tags, starts) -> bytes:
    return X.seal(pa.table({"id": ids, "tag": tags, "start": starts}))


def _local(ids: np.ndarray, tags: np.ndarray, column, width: int):
    """Windows of a block: hashes, bucket hashes, rows and starts in order; and whether an equal one is earlier in the block."""
    words, first = T.hash_words(column, T.SPACE, lower=False)
    at = T.windows(first, width)
    row = np.searchsorted(first, at, "right") - 1
    main = T.rolling(words, width)[at]
    second = T.rolling(words, width, T._R)[at]
    order = np.argsort(main, kind="stable")
    repeat = np.zeros(len(at), bool)
    repeat[order[1:][main[order[1:]] == main[order[:-1]]]] = True
    return main, second, row, (at - first[row]).astype(np.uint32), repeat


def _claims(docs: DataFrame, width: int, parts: int) -> DataFrame:
    """Rows (part, blob): starts of windows that are not the first of their words, for documents of that part."""

    def emit(batches):
        for block in T.blocks(batches, "text", X.BLOCK_BYTES):
            ids, tags = X.ids_of(block.column("doc_id")), X.tags_of(block.column("text"))
            order = np.lexsort((tags, ids))
            same = np.zeros(len(order), bool)
            same[1:] = (ids[order[1:]] == ids[order[:-1]]) & (tags[order[1:]] == tags[order[:-1]])
            order = order[~same]
            ids, tags = ids[order], tags[order]
            main, second, row, start, repeat = _local(ids, tags, block.column("text").take(pa.array(order)), width)
            part = X.part_of(ids, tags, parts)
            held = np.flatnonzero(repeat)
            for key, which in X.grouped(part[row[held]]):
                at = held[which]
                yield _row(parts + int(key), _seal_claims(ids[row[at]], tags[row[at]], start[at]))
            sent = np.flatnonzero(~repeat)
            bucket = (second[sent] % np.uint64(parts)).astype(np.uint16 if parts < 1 << 16 else np.int32)
            for key, which in X.grouped(bucket):
                at = sent[which]
                rows = row[at]
                lead = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
                runs = np.diff(np.r_[lead, len(rows)])
                docs_ = pa.table({"id": ids[rows[lead]], "tag": tags[rows[lead]], "n": runs.astype(np.uint32)})
                steps = start[at].astype(np.int64)
                steps[1:] -= steps[:-1].copy()
                steps[lead] = start[at][lead]
                yield _row(int(key), X.seal(docs_), X.seal(pa.table({"step": steps.astype(np.uint32)})), main[at].tobytes())

    def settle(key, table: pa.Table):
        key = key[0].as_py()
        if key >= parts:
            yield from pa.table({"part": pa.array([key - parts] * len(table), pa.int32()), "blob": table["docs"]}).to_batches()
            return
        ids, tags, starts, mains = [], [], [], []
        for docs_, steps, main in zip(table["docs"], table["steps"], table["main"], strict=True):
            d, s = X.unseal(docs_.as_py()), X.unseal(steps.as_py())["step"].to_numpy().astype(np.int64)
            n = d["n"].to_numpy()
            lead = np.r_[0, np.cumsum(n)[:-1]].astype(np.int64)
            total = np.cumsum(s)
            starts.append((total - np.repeat(total[lead] - s[lead], n)).astype(np.uint32))
            ids.append(np.repeat(d["id"].to_numpy(), n))
            tags.append(np.repeat(d["tag"].to_numpy(), n))
            mains.append(np.frombuffer(main.as_py(), np.uint64))
        main = np.concatenate(mains)
        order = np.argsort(main)
        ordered = main[order]
        equal = ordered[1:] == ordered[:-1]
        many = order[np.r_[equal, False] | np.r_[False, equal]]
        if not len(many):
            return
        main, ids, tags, starts = main[many], np.concatenate(ids)[many], np.concatenate(tags)[many], np.concatenate(starts)[many]
        order = np.lexsort((starts, tags, ids, main))
        later = order[np.r_[False, main[order[1:]] == main[order[:-1]]]]
        ids, tags, starts = ids[later], tags[later], starts[later]
        part = X.part_of(ids, tags, parts)
        for to, which in X.grouped(part):
            which = which[np.lexsort((starts[which], ids[which]))]
            yield pa.record_batch({"part": pa.array([to], pa.int32()), "blob": pa.array([_seal_claims(ids[which], tags[which], starts[which])], pa.binary())})

    sent = docs.mapInArrow(emit, "key int, docs binary, steps binary, main binary")
    # keys are buckets, and behind them parts
    return X.dealt(sent, 2 * parts, "key").groupBy("key").applyInArrow(lambda k, t: pa.Table.from_batches(settle(k, t), _CLAIM), "part int, blob binary")


_CLAIM = pa.schema({"part": pa.int32(), "blob": pa.binary()})


def _row(key: int, docs: bytes, steps: bytes | None = None, main: bytes | None = None) -> pa.RecordBatch:
    return pa.record_batch({"key": pa.array([key], pa.int32()), "docs": pa.array([docs], pa.binary()), "steps": pa.array([steps], pa.binary()), "main": pa.array([main], pa.binary())})


def remove_repeats(docs: DataFrame, width: int = 20, parts: int | None = None, with_text: bool = True) -> DataFrame:
    """Removes each word that a window covers whose words also begin earlier: at a smaller doc_id, or earlier in the document.

    docs: doc_id, text; other columns don't matter. Returns doc_id, n_words, n_removed, kept_sha256 and kept (the kept words
    joined by one space; null without `with_text`). A null text has no words; a text of fewer than `width` words keeps all.
    A null doc_id comes before all others. Rows of one doc_id come in the order of a hash of their texts; rows that also
    share the text are one document and get the same result. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    parts = parts or X.parts_for(docs)

    def finish(key, texts: pa.Table, claims: pa.Table):
        marks = [X.unseal(b.as_py()) for b in claims["blob"]]
        marks = pa.concat_tables(marks) if marks else pa.table({"id": pa.array([], pa.int64()), "tag": pa.array([], pa.uint32()), "start": pa.array([], pa.uint32())})
        name = T.mix(X.id_hash(marks["id"]) + marks["tag"].to_numpy().astype(np.uint64))
        order = np.argsort(name, kind="stable")
        name, start = name[order], marks["start"].to_numpy()[order].astype(np.int64)
        for blob in texts["blob"]:
            table = X.unseal(blob.as_py())
            own = T.mix(X.id_hash(table["doc_id"]) + table["tag"].to_numpy().astype(np.uint64))
            low, high = np.searchsorted(name, own), np.searchsorted(name, own, "right")
            n, gone, digests, kept = [], [], [], []
            for text, i, j in zip(table["text"].to_pylist(), low, high, strict=True):
                words = (text or "").encode().split()
                n.append(len(words))
                left = 0
                if j > i:
                    steps = np.zeros(len(words) + 1, np.int32)
                    np.add.at(steps, start[i:j], 1)
                    np.add.at(steps, start[i:j] + width, -1)
                    keep = np.cumsum(steps)[:-1] == 0
                    left = len(words) - int(keep.sum())
                    words = list(compress(words, keep.tolist()))
                gone.append(left)
                joined = b" ".join(words)
                digests.append(hashlib.sha256(joined).hexdigest())
                kept.append(joined.decode() if with_text else None)
            yield pa.record_batch({"doc_id": X.nullable_ids(X.ids_of(table["doc_id"])), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(digests, pa.string()), "kept": pa.array(kept, pa.string())})

    left = X.dealt(X.text_parts(docs, parts), parts, "part").groupBy("part")
    right = X.dealt(_claims(docs, width, parts), parts, "part").groupBy("part")
    return left.cogroup(right).applyInArrow(lambda k, a, b: pa.Table.from_batches(finish(k, a, b), _RESULT), RESULT)
