"""Benchmark decontamination with a distributed positional inverted index.

The index is partitioned by documents: a segment holds the postings of a block of documents,
for each term its positions in the block, sorted. Stored segments hold all terms, so they can be
searched for one test set after another; a search reads the lists of its own terms.

A search takes the test items in blocks of bounded size, one block after the other: neither the driver
nor a task holds more. In each segment a window starts from
the list of the term that is rarest there, shifts it by the term's offset, and intersects it with
the shifted lists of the other terms, the next rarest first; what is left are exact phrases.
Proximity search does the same with lists widened by a slop. A document's contamination is a
summary of its phrases.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import text as T

#: Bytes of test items that are searched at a time: what the driver holds and sends to all tasks at once.
ITEM_BYTES = 4 << 20
#: Candidate positions that are intersected at a time.
STEP = 1 << 20
MATCHES = "doc_id long, item_id string, start long, width int, kind string"


@dataclass
class Windows:
    """Test windows over a vocabulary: distinct windows as term numbers, and the items that each comes from."""

    vocabulary: np.ndarray  # hashes, sorted
    groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # for each width: windows x terms; where a window's items begin; items
    names: list[str]  # of items

    def items(self, group: int, window: int) -> list[str]:
        """The sorted distinct names of a window's items."""
        _, begin, items = self.groups[group]
        return sorted({self.names[i] for i in items[begin[window] : begin[window + 1]]})


def test_windows(items: list[tuple[object, str | None]], width: int) -> Windows:
    """Windows of `width` consecutive words; an item of fewer words, but not none, is one window."""
    hashes, first = T.hash_words(pa.array([t for _, t in items], pa.string()), T.NOT_ALNUM, lower=True)
    vocabulary = np.unique(hashes)
    terms = np.searchsorted(vocabulary, hashes).astype(np.int32)
    lengths = np.diff(first)
    groups = []
    for n in range(1, width + 1):
        at = T.windows(first, n) if n == width else first[:-1][lengths == n]
        if not len(at):
            continue
        rows = np.ascontiguousarray(terms[at[:, None] + np.arange(n)])
        distinct, number = np.unique(rows.view(f"V{rows.itemsize * n}")[:, 0], return_inverse=True)
        # each window with its items, in order, once
        pairs = np.unique(np.stack([number, np.searchsorted(first, at, "right") - 1], 1), axis=0)
        groups.append((distinct.view(np.int32).reshape(-1, n), np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1)), pairs[:, 1]))
    return Windows(vocabulary, groups, [str(i) for i, _ in items])


class Segment:
    """Postings of a block of documents: term, position pairs as sorted 64-bit keys, and where documents begin."""

    def __init__(self, keys: np.ndarray, first: np.ndarray):
        self.keys, self.first = keys, first

    @classmethod
    def build(cls, texts, vocabulary: np.ndarray) -> Segment:
        hashes, first = T.hash_words(texts, T.NOT_ALNUM, lower=True)
        if not len(vocabulary) or not len(hashes):
            return cls(np.zeros(0, np.uint64), first)
        term = np.searchsorted(vocabulary, hashes)
        term[term == len(vocabulary)] = 0
        at = np.flatnonzero(vocabulary[term] == hashes)
        keys = (term[at].astype(np.uint64) << np.uint64(32)) | at.astype(np.uint64)
        return cls(np.sort(keys), first)

    @classmethod
    def read(cls, table: tuple[np.ndarray, np.ndarray, np.ndarray], first: np.ndarray, vocabulary: np.ndarray) -> Segment:
        """The segment of these terms alone, from the postings of all of a block's terms."""
        hashes, n, positions = table
        if not len(vocabulary) or not len(hashes):
            return cls(np.zeros(0, np.uint64), first)
        term = np.searchsorted(vocabulary, hashes)
        term[term == len(vocabulary)] = 0
        own = vocabulary[term] == hashes
        return cls((np.repeat(term[own], n[own]).astype(np.uint64) << np.uint64(32)) | positions[np.repeat(own, n)].astype(np.uint64), first)

    def lists(self, terms: int) -> np.ndarray:
        """Where each term's list begins; one more than terms."""
        return np.searchsorted(self.keys, np.arange(terms + 1, dtype=np.uint64) << np.uint64(32))

    def has(self, terms: np.ndarray, positions: np.ndarray) -> np.ndarray:
        wanted = (terms.astype(np.uint64) << np.uint64(32)) | positions.astype(np.uint64)
        at = np.searchsorted(self.keys, wanted)
        at[at == len(self.keys)] = 0
        return self.keys[at] == wanted if len(self.keys) else np.zeros(len(wanted), bool)

    def within(self, terms: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether a term has a position from low to high, both included."""
        least, most = np.maximum(low, 0), np.maximum(high, 0)
        base = terms.astype(np.uint64) << np.uint64(32)
        some = np.searchsorted(self.keys, base | most.astype(np.uint64), "right") > np.searchsorted(self.keys, base | least.astype(np.uint64))
        return some & (high >= least)

    def rarest(self, windows: np.ndarray, terms: int):
        """In steps: windows, the positions of their rarest terms, those positions' documents, and all windows' offsets by rarity."""
        begins = self.lists(terms)
        size = np.diff(begins).astype(np.int32)
        count = size[windows].min(axis=1) if len(windows) else np.zeros(0, np.int32)
        live = np.flatnonzero(count)
        # most windows lack a term; only those that have all are put in order
        rarity = np.zeros(windows.shape, np.int8)
        rarity[live] = np.argsort(size[windows[live]], axis=1, kind="stable")
        total = np.cumsum(count[live], dtype=np.int64)
        i = 0
        while i < len(live):
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + STEP, "right")))
            own = live[i:j]
            window = np.repeat(own, count[own])
            begin = begins[windows[own, rarity[own, 0]]]
            ends = np.cumsum(count[own])
            which = np.arange(len(window)) - np.repeat(ends - count[own], count[own]) + np.repeat(begin, count[own])
            position = (self.keys[which] & np.uint64(0xFFFFFFFF)).astype(np.int64)
            yield window, position, np.searchsorted(self.first, position, "right") - 1, rarity
            i = j

    def phrases(self, windows: np.ndarray, terms: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, position of its first word) of every occurrence inside one document."""
        width = windows.shape[1]
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for window, position, doc, rarity in self.rarest(windows, terms):
            start = position - rarity[window, 0]
            keep = (start >= self.first[doc]) & (start + width <= self.first[doc + 1])
            window, start = window[keep], start[keep]
            for k in range(1, width):
                if not len(window):
                    break
                offset = rarity[window, k]
                keep = self.has(windows[window, offset], start + offset)
                window, start = window[keep], start[keep]
            found.append((window, start))
        return np.concatenate([w for w, _ in found]), np.concatenate([s for _, s in found])

    def proximities(self, windows: np.ndarray, terms: int, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, position), sorted, of every position from which each term lies within `slop` of its offset, all in one document."""
        width = windows.shape[1]
        found = [np.zeros((0, 2), np.int64)]
        for window, position, doc, rarity in self.rarest(windows, terms):
            start = position - rarity[window, 0]
            # the rarest term itself may be off by `slop`: first what is within twice that, then each start
            for spread in (2 * slop, slop):
                if spread == slop:
                    step = np.tile(np.arange(-slop, slop + 1), len(start))
                    window, start, doc = (np.repeat(x, 2 * slop + 1) for x in (window, start, doc))
                    start = start + step
                    keep = (start >= self.first[doc]) & (start < self.first[doc + 1])
                    window, start, doc = window[keep], start[keep], doc[keep]
                for k in range(1, width):
                    if not len(window):
                        break
                    offset = rarity[window, k]
                    low = np.maximum(start + offset - spread, self.first[doc])
                    high = np.minimum(start + offset + spread, self.first[doc + 1] - 1)
                    keep = self.within(windows[window, offset], low, high)
                    window, start, doc = window[keep], start[keep], doc[keep]
                if spread == 0:
                    break
            found.append(np.stack([window, start], 1))
        both = np.unique(np.concatenate(found), axis=0)
        return both[:, 0], both[:, 1]


def _matches(segment: Segment, test: Windows, slop: int | None = None):
    """For each group of windows of one width: the group, width, kind, window, position."""
    terms = len(test.vocabulary)
    for group, (windows, _, _) in enumerate(test.groups):
        window, start = segment.phrases(windows, terms)
        yield group, windows.shape[1], "phrase", window, start
        if slop is None:
            continue
        near, at = segment.proximities(windows, terms, slop)
        # positions in a row are one match, of a document, and one that holds a phrase is that phrase
        doc = np.searchsorted(segment.first, at, "right")
        head = np.r_[True, (near[1:] != near[:-1]) | (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1])][: len(at)]
        exact = np.isin(near << 32 | at, window << 32 | start)
        loose = ~np.logical_or.reduceat(exact, np.flatnonzero(head)) if len(at) else np.zeros(0, bool)
        yield group, windows.shape[1], "proximity", near[head][loose], at[head][loose]


@dataclass
class Hits:
    """The phrases of a segment's documents: intervals of words that are hit, and items, by document with any."""

    documents: np.ndarray
    begin: list[np.ndarray]
    end: list[np.ndarray]
    items: list[list[str]]


def _hits(segment: Segment, test: Windows) -> Hits:
    """What phrases hit, as disjoint intervals in each document's words."""
    spans, names = [np.zeros((0, 3), np.int64)], {}
    for group, width, _, window, start in _matches(segment, test):
        doc = np.searchsorted(segment.first, start, "right") - 1
        at = start - segment.first[doc]
        spans.append(np.stack([doc, at, at + width], 1))
        for d, w in np.unique(np.stack([doc, window], 1), axis=0).tolist():
            names.setdefault(d, set()).update(test.items(group, w))
    spans = np.concatenate(spans)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    documents, first = np.unique(spans[:, 0], return_index=True)
    both = [joined(spans[i:j, 1], spans[i:j, 2]) for i, j in zip(first, np.r_[first[1:], len(spans)], strict=True)] if len(documents) else []
    return Hits(documents, [a for a, _ in both], [b for _, b in both], [sorted(names[d]) for d in documents.tolist()])


def joined(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals as disjoint ones, in order."""
    order = np.argsort(begin, kind="stable")
    begin, most = begin[order], np.maximum.accumulate(end[order])
    head = np.r_[True, begin[1:] > most[:-1]][: len(begin)]
    last = np.r_[np.flatnonzero(head)[1:] - 1, len(begin) - 1] if len(begin) else np.zeros(0, np.int64)
    return begin[head], most[last]


def _item_blocks(items: DataFrame, width: int) -> Iterator[Windows]:
    """The test items, in blocks of at most ITEM_BYTES of text (or one longer item); one for no items. The driver holds one."""
    held, size, some = [], 0, False
    for row in items.select("item_id", "text").toLocalIterator():
        n = len((row[1] or "").encode())
        if held and size + n > ITEM_BYTES:
            yield test_windows(held, width)
            held, size, some = [], 0, True
        held.append((row[0], row[1]))
        size += n
    if held or not some:
        yield test_windows(held, width)


def build_index(docs: DataFrame, block_bytes: int = X.BLOCK_BYTES) -> DataFrame:
    """Rows (block, ids, terms, segment): the segments of the index, with all terms of the documents. Write them to keep them."""

    def emit(batches):
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        for block in T.blocks(batches, "text", block_bytes):
            number += 1
            hashes, first = T.hash_words(block.column("text"), T.NOT_ALNUM, lower=True)
            at = np.argsort(hashes, kind="stable")
            hashes = hashes[at]
            begin = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]][: len(hashes)])
            yield pa.record_batch({
                "block": pa.array([number], pa.int64()),
                "ids": pa.array([X.seal(pa.table({"doc_id": block.column("doc_id"), "n": np.diff(first)}))], pa.binary()),
                "terms": pa.array([X.seal(pa.table({"hash": hashes[begin], "n": np.diff(np.r_[begin, len(hashes)]).astype(np.int32)}))], pa.binary()),
                "segment": pa.array([X.seal(pa.table({"step": np.diff(at, prepend=0).astype(np.int32)}))], pa.binary()),
            })

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(emit, "block long, ids binary, terms binary, segment binary")


def _segments(batches, vocabulary: np.ndarray):
    """(block, doc_ids, segment) of each row of an index, for these terms."""
    for batch in batches:
        for block, ids, terms, steps in zip(batch.column("block").to_pylist(), batch.column("ids"), batch.column("terms"), batch.column("segment"), strict=True):
            ids, terms = X.unseal(ids.as_py()), X.unseal(terms.as_py())
            first = np.r_[0, np.cumsum(ids["n"].to_numpy())].astype(np.int64)
            positions = np.cumsum(X.unseal(steps.as_py())["step"].to_numpy(), dtype=np.int64)
            yield block, ids["doc_id"].combine_chunks(), Segment.read((terms["hash"].to_numpy(), terms["n"].to_numpy(), positions), first, vocabulary)


def _by_block(index: DataFrame, items: DataFrame, width: int, one: Callable[[Windows], Callable], schema: str) -> tuple[DataFrame, int]:
    """Rows of a search for each block of test items, and how many those are. All but the last's are computed one after the other."""
    done, last = [], None
    for windows in _item_blocks(items, width):
        if last is not None:
            done.append(X.cut(last[1]))
            last[0].unpersist()
        shared = index.sparkSession.sparkContext.broadcast(windows)
        last = shared, index.mapInArrow(one(shared), schema)
    return reduce(DataFrame.unionByName, done, last[1]), len(done) + 1


def search(index: DataFrame, items: DataFrame, width: int = 10, slop: int | None = None) -> DataFrame:
    """Where windows of test items occur: doc_id, item_id (as text), start, width (in words; start counts from 0) and kind.

    index: of `build_index`, written and read again. A phrase is a window word for word. With `slop`, a proximity is a position
    from which each of the window's words has an occurrence at most `slop` words off its place, in one document: words may be
    inserted or change places, not be missing. Positions in a row are one match, at the first, and are left out where they hold
    a phrase of that window. A match has a row for each document row and each item it occurs in. Test items of any number are
    searched in blocks of ITEM_BYTES; the index is read once for each.
    """
    kinds = {"block": pa.int64(), "row": pa.int64(), "doc_id": pa.int64(), "item_id": pa.string(), "start": pa.int64(), "width": pa.int32(), "kind": pa.string()}

    def one(shared):
        def emit(batches):
            test = shared.value
            for block, doc_ids, segment in _segments(batches, test.vocabulary):
                rows = set()
                for group, n, kind, window, start in _matches(segment, test, slop):
                    doc = np.searchsorted(segment.first, start, "right") - 1
                    rows.update((d, name, p, n, kind) for d, w, p in zip(doc.tolist(), window.tolist(), (start - segment.first[doc]).tolist(), strict=True) for name in test.items(group, w))
                row, *rest = list(zip(*sorted(rows), strict=True)) or [[]] * 5
                columns = [[block] * len(row), row, doc_ids.take(pa.array(row, pa.int64())), *rest]
                yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))

        return emit

    found, blocks = _by_block(index, items, width, one, "block long, row long, " + MATCHES)
    # rows of one item_id may be in different blocks of test items
    return (found.dropDuplicates(["block", "row", "item_id", "start", "width", "kind"]) if blocks > 1 else found).drop("block", "row")


_HITS = "block long, row int, begin array<long>, end array<long>, items array<string>"


def _hit_rows(index: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """Rows of documents with phrases: their block and row in it, the words hit as intervals, the items."""

    def one(shared):
        def emit(batches):
            test = shared.value
            for block, _, segment in _segments(batches, test.vocabulary):
                hits = _hits(segment, test)
                yield pa.record_batch({
                    "block": pa.array([block] * len(hits.documents), pa.int64()), "row": pa.array(hits.documents, pa.int32()),
                    "begin": pa.array(hits.begin, pa.list_(pa.int64())), "end": pa.array(hits.end, pa.list_(pa.int64())), "items": pa.array(hits.items, pa.list_(pa.string())),
                })

        return emit

    return _by_block(index, items, width, one, _HITS)[0]


def contamination(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """For each document, how many of its words lie in windows of test items, and in how many items.

    docs: doc_id, text; items: item_id, text; other columns don't matter. The index is stored in the shared folder and then
    searched, once for each ITEM_BYTES of test items. Null and empty texts have no words and match nothing, as do items
    without words. Rows that share a doc_id are judged each by itself; a null doc_id stays null. Items that share an item_id
    count once, a null one as "None". Empty tables give no rows, or rows without hits.
    """
    index = X.cut(build_index(docs))

    def lengths(batches):
        for batch in batches:
            for block, ids in zip(batch.column("block").to_pylist(), batch.column("ids"), strict=True):
                ids = X.unseal(ids.as_py())
                yield pa.record_batch({"of": pa.array([block] * len(ids), pa.int64()), "at": pa.array(range(len(ids)), pa.int32()), "doc_id": ids["doc_id"].combine_chunks(), "n_words": ids["n"].combine_chunks().cast(pa.int64())})

    hits = _hit_rows(index, items, width).groupBy("block", "row").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("begin", "end", "items")))
    # intervals of a document, in order: each adds the words that lie behind all before it
    order = F.array_sort(F.zip_with("begin", "end", lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("most"))
    step = lambda s, x: F.struct((s["n"] + F.greatest(x["b"] - F.greatest(x["a"], s["most"]), F.lit(0).cast("long"))).alias("n"), F.greatest(s["most"], x["b"]).alias("most"))
    found = hits.select("block", "row", F.aggregate(order, start, step)["n"].alias("hit"), F.array_sort(F.array_distinct("items")).alias("names"))
    rows = index.select("block", "ids").mapInArrow(lengths, "of long, at int, doc_id long, n_words long")
    out = rows.join(found, (F.col("of") == F.col("block")) & (F.col("at") == F.col("row")), "left")
    names = F.coalesce("names", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", F.coalesce("hit", F.lit(0).cast("long")).alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), F.col("hit").isNotNull().alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """The documents, with all their columns, of which no word lies in a window of a test item."""
    left = docs
    for n, windows in enumerate(_item_blocks(items, width)):
        if n:
            left = X.cut(left)
        shared = docs.sparkSession.sparkContext.broadcast(windows)

        def keep(batches, shared=shared):
            test = shared.value
            for block in T.blocks(batches, "text", X.BLOCK_BYTES // 2):
                segment = Segment.build(block.column("text"), test.vocabulary)
                stay = np.ones(block.num_rows, bool)
                for _, _, _, _, start in _matches(segment, test):
                    stay[np.searchsorted(segment.first, start, "right") - 1] = False
                yield block.filter(pa.array(stay))

        left = left.mapInArrow(keep, docs.schema)
    return left
